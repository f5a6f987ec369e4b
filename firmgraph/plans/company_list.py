"""The company list over the driver's tables: every filter, sort and default exclusion.

Customers stand for companies; their newest large order for the newest analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.operators import company_list
from firmgraph.plans.registry import query, table

VIEW_SQL = """WITH newest AS (SELECT o_custkey, max(row(o_orderdate, o_orderkey)) AS top, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey),
ranked AS (SELECT c_custkey, c_name AS company_name, CASE WHEN c_custkey % 5 <> 0 THEN 'https://c' || c_custkey || '.example.jp/' END AS website_url,
  CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_custkey || '.example.jp' END AS website_domain, lpad(CAST(c_custkey * 7919 AS VARCHAR), 13, '1') AS corporate_number,
  n_name AS prefecture, lower(c_mktsegment) AS industry, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '1-9' WHEN c_custkey % 3 = 1 THEN '20-49' ELSE '1000+' END AS employee_range,
  CASE WHEN c_custkey % 9 <> 0 THEN c_custkey * 37 % 2000 END AS employee_count,
  CASE WHEN top IS NOT NULL AND c_custkey % 13 <> 0 THEN c_custkey * 31 % 101 END AS sales_priority_score, CASE WHEN top IS NOT NULL THEN c_custkey * 17 % 101 END AS recruitment_issue_score,
  CASE WHEN top IS NOT NULL THEN c_custkey * 19 % 101 END AS sns_activity_score, CASE WHEN top IS NOT NULL THEN c_custkey * 23 % 101 END AS web_quality_score,
  CASE WHEN top IS NOT NULL THEN c_custkey * 29 % 101 END AS dx_opportunity_score, CASE WHEN top IS NOT NULL THEN c_custkey * 41 % 101 END AS confidence_score,
  CASE c_custkey % 7 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE 'unknown' END AS sales_contact_allowed, CASE c_custkey % 6 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'unverified' WHEN 2 THEN 'manual' ELSE 'verified' END AS verification_status,
  CASE c_custkey % 8 WHEN 0 THEN 'no_signal' WHEN 1 THEN 'active_recruit' WHEN 2 THEN 'weak_recruit_page' WHEN 3 THEN 'no_recruit_page' END AS recruit_target,
  CASE WHEN c_custkey % 4 = 0 THEN 'active' ELSE 'unknown' END AS recruiting_status, c_custkey % 5 <> 0 AS has_website, c_custkey % 4 < 2 AS has_contact, c_acctbal > 5000 AS has_email, n >= 2 AS has_outreach,
  top[2] AS analysis_id, top[1] AS analyzed_at, DATE '2020-01-01' + CAST(c_custkey * 11 % 1000 AS INTEGER) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN newest ON c_custkey = o_custkey),
overview AS (SELECT *, CASE WHEN sales_priority_score >= 75 THEN 'A' WHEN sales_priority_score >= 55 THEN 'B' WHEN sales_priority_score >= 35 THEN 'C' WHEN sales_priority_score IS NOT NULL THEN 'D' END AS sales_priority_rank FROM ranked)
"""
OPEN = "sales_contact_allowed <> 'false'"
SITE = "website_url IS NOT NULL AND verification_status IN ('verified', 'manual')"
SIGNAL = "(recruit_target IS NULL OR recruit_target <> 'no_signal')"
SURE = "(analysis_id IS NULL OR (confidence_score >= 30 AND sales_priority_rank IS NOT NULL))"
SHOWN = "c_custkey, company_name, prefecture, industry, sales_priority_score, sales_priority_rank, recruit_target, analysis_id"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview: one row a customer, the newest order found by a map-side maximum."""
    k = F.col("c_custkey")
    newest = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("top"), F.count("*").alias("n"))
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # a fixed list of 25 rows
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(newest, k == F.col("o_custkey"), "left")
    known = F.col("top").isNotNull()
    scored = lambda m, also=F.lit(True): F.when(known & also, k * m % 101)
    pick = lambda m, values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), (k % m).cast("int")), F.lit(other))
    site = k % 5 != 0
    shown = rows.select(
        "c_custkey", F.col("c_name").alias("company_name"), F.when(site, F.concat(F.lit("https://c"), k, F.lit(".example.jp/"))).alias("website_url"), F.when(site, F.concat(F.lit("c"), k, F.lit(".example.jp"))).alias("website_domain"),
        F.lpad((k * 7919).cast("string"), 13, "1").alias("corporate_number"), F.col("n_name").alias("prefecture"), F.lower("c_mktsegment").alias("industry"),
        F.when(k % 9 != 0, pick(3, {0: "1-9", 1: "20-49"}, "1000+")).alias("employee_range"), F.when(k % 9 != 0, k * 37 % 2000).alias("employee_count"),
        scored(31, k % 13 != 0).alias("sales_priority_score"), scored(17).alias("recruitment_issue_score"), scored(19).alias("sns_activity_score"), scored(23).alias("web_quality_score"), scored(29).alias("dx_opportunity_score"), scored(41).alias("confidence_score"),
        pick(7, {0: "false", 1: "true"}, "unknown").alias("sales_contact_allowed"), pick(6, {0: "needs_review", 1: "unverified", 2: "manual"}, "verified").alias("verification_status"),
        pick(8, {0: "no_signal", 1: "active_recruit", 2: "weak_recruit_page", 3: "no_recruit_page"}, None).alias("recruit_target"),
        F.when(k % 4 == 0, "active").otherwise("unknown").alias("recruiting_status"), site.alias("has_website"), (k % 4 < 2).alias("has_contact"), (F.col("c_acctbal") > 5000).alias("has_email"), (F.col("n") >= 2).alias("has_outreach"),
        F.col("top.o_orderkey").alias("analysis_id"), F.col("top.o_orderdate").alias("analyzed_at"), F.date_add(F.lit("2020-01-01").cast("date"), (k * 11 % 1000).cast("int")).alias("created_at"),
    )
    s = F.col("sales_priority_score")
    return shown.withColumn("sales_priority_rank", F.when(s >= 75, "A").when(s >= 55, "B").when(s >= 35, "C").when(s.isNotNull(), "D"))


def _listed(name: str, why: str, params: dict, where: str) -> None:
    """Register a whole filtered list, by its request parameters and by SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return companies(spark, sf_dir).filter(company_list.predicate(company_list.parse(params))).selectExpr(*SHOWN.split(", "))

    run.__doc__ = why
    query(f"{VIEW_SQL} SELECT {SHOWN} FROM overview WHERE {where}", f"companies_{name}")(run)


EVERY = {"includeRestricted": "1", "includeUnverifiedSite": "on", "includeNoRecruitSignal": "true", "includeLowConfidence": "1"}
USUAL = f"{OPEN} AND {SITE} AND {SIGNAL} AND {SURE}"
_listed("default", "The usual exclusions: refusals, sites that are not confirmed, no sign of hiring, unsure analyses.", {}, USUAL)
_listed("all", "All exclusions switched off.", EVERY, "true")
_listed("keyword", "A keyword in name or domain.", {**EVERY, "q": " C12 "}, "(lower(company_name) LIKE '%c12%' OR lower(website_domain) LIKE '%c12%')")
_listed("by_number", "Thirteen digits are a corporate number too.", {**EVERY, "q": "1111111155433"}, "corporate_number = '1111111155433'")
_listed("facets", "Prefecture, industry, size, rank.", {**EVERY, "prefecture": "NATION_3", "industry": "machinery", "employeeRange": "20-49"}, "prefecture = 'NATION_3' AND industry = 'machinery' AND employee_range = '20-49'")
_listed("rank_and_target", "Rank and class of hiring.", {**EVERY, "rank": "A", "recruitTarget": "weak_recruit_page"}, "sales_priority_rank = 'A' AND recruit_target = 'weak_recruit_page'")
_listed("scores", "Four ranges of scores.", {**EVERY, "minPriority": "40", "minRecruitIssue": "20.5", "maxSns": "80", "maxWeb": "90"}, "sales_priority_score >= 40 AND recruitment_issue_score >= 20.5 AND sns_activity_score <= 80 AND web_quality_score <= 90")
_listed("switches", "Hiring, site, contact, address and draft are there.", {**EVERY, "recruiting": "1", "hasWebsite": "1", "hasContact": "1", "hasEmail": "1", "hasOutreach": "1"}, "recruiting_status = 'active' AND has_website AND has_contact AND has_email AND has_outreach")
_listed("welcome_only", "Only companies known to welcome contact.", {"excludeRestricted": "1"}, f"{USUAL} AND sales_contact_allowed = 'true'")
_listed("unanalyzed", "Without an analysis; unsure ones are no concern.", {"unanalyzed": "1"}, f"{USUAL} AND analysis_id IS NULL")
_listed("needs_review", "Waiting for review.", {**EVERY, "needsReview": "true"}, "verification_status IN ('needs_review', 'unverified')")
_listed("invalid_parameter", "One invalid parameter resets all.", {**EVERY, "minPriority": "101"}, USUAL)
_listed("low_confidence", "Unsure analyses let in, the rest as usual.", {"includeLowConfidence": "1"}, f"{OPEN} AND {SITE} AND {SIGNAL}")


def _sorted(key: str, column: str, ascending: bool) -> None:
    """Register the second page of the list by a named sort, with its places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on = company_list.parse({**EVERY, "sort": key, "page": "2", "perPage": "20"})
        return company_list.page(companies(spark, sf_dir), on, "c_custkey").select("c_custkey", F.col(column).cast("string").alias("value"))

    run.__doc__ = f"The second page of the list by {column}."
    then = "" if column == "created_at" else "created_at DESC, "
    query(f"{VIEW_SQL} SELECT c_custkey, CAST({column} AS VARCHAR) AS value FROM (SELECT * FROM overview ORDER BY {column} {'ASC' if ascending else 'DESC'} NULLS LAST, {then}c_custkey LIMIT 20 OFFSET 20) t", f"companies_by_{key}")(run)


for _key, (_column, _ascending) in company_list.SORTS.items():
    _sorted(_key, _column, _ascending)
