"""The company overview: latest child row per parent, null-aware score, rank, default filters, sorts and pages.

Customers stand for companies and their newest order for the newest analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.functions.scoring import rank_from_score, weighted_score
from firmgraph.plans.registry import query, table

#: Weight and whether high values count against the company.
SCORE_PARTS = (("f_balance", 0.3, False), ("f_price", 0.2, False), ("f_recent", 0.1, True))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with its newest order (if any), 0-100 sub-scores, score and rank."""
    # a maximum combines on the map side, where a window would sort all orders
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")).alias("newest")
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest).select("o_custkey", "newest.*")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        table(spark, sf_dir, "customer")
        .join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    parts = joined.select(
        "c_custkey", "c_name", "c_mktsegment", "n_name", "o_orderkey", "o_orderstatus",
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("f_balance"),
        F.floor(F.col("o_totalprice") / 5000).alias("f_price"),
        F.when(F.col("o_orderkey").isNotNull(), F.month("o_orderdate") * 8).cast("bigint").alias("f_recent"),
    )
    scored = parts.withColumn("score", weighted_score(SCORE_PARTS))
    return scored.withColumn("rank", rank_from_score(F.col("score")))


OVERVIEW_SQL = """
latest AS (
  SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders o) t WHERE rn = 1),
parts AS (
  SELECT c_custkey, c_name, c_mktsegment, n_name, o_orderkey, o_orderstatus,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END f_balance,
    CAST(floor(o_totalprice / 5000) AS BIGINT) f_price,
    CASE WHEN o_orderkey IS NOT NULL THEN CAST(month(o_orderdate) * 8 AS BIGINT) END f_recent
  FROM customer LEFT JOIN latest ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
num AS (
  SELECT *, coalesce(0.3e0 * least(greatest(f_balance, 0), 100), 0e0) + coalesce(0.2e0 * least(greatest(f_price, 0), 100), 0e0)
      + CASE WHEN f_recent IS NULL THEN 0e0 ELSE 0.1e0 * (100 - least(greatest(f_recent, 0), 100)) END n,
    CASE WHEN f_balance IS NULL THEN 0e0 ELSE 0.3e0 END + CASE WHEN f_price IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN f_recent IS NULL THEN 0e0 ELSE 0.1e0 END d FROM parts),
overview AS (
  SELECT c_custkey, c_name, c_mktsegment, n_name, o_orderkey, o_orderstatus, f_balance, f_price, f_recent, score,
    CASE WHEN score >= 75 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 35 THEN 'C' WHEN score IS NOT NULL THEN 'D' END AS rank
  FROM (SELECT *, CASE WHEN d > 0 THEN CAST(floor(round(n / d, 9) + 0.5e0) AS INTEGER) END score FROM num) s)
"""


@query(f"WITH {OVERVIEW_SQL} SELECT * FROM overview WHERE score IS NOT NULL AND o_orderkey IS NOT NULL ORDER BY score DESC NULLS LAST, c_custkey LIMIT 100")
def overview_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored companies with a newest analysis; a top-k report."""
    rows = overview(spark, sf_dir).filter("score IS NOT NULL AND o_orderkey IS NOT NULL")
    return rows.orderBy(F.col("score").desc_nulls_last(), "c_custkey").limit(100)


@query(f"""WITH {OVERVIEW_SQL} SELECT * FROM overview
WHERE (lower(c_name) LIKE '%1%' OR lower(n_name) LIKE '%1%') AND score >= 20 AND (o_orderstatus IS NULL OR o_orderstatus <> 'F') AND (o_orderkey IS NULL OR rank IS NOT NULL)""")
def overview_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, score range and the default exclusions, compiled from optional filters."""
    return overview(spark, sf_dir).filter(compile_filters({"keyword": "1", "min_score": 20, "exclude_status": "F", "ranked_if_analysed": True}))


@query(f"WITH {OVERVIEW_SQL} SELECT * FROM overview ORDER BY score DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50")
def overview_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the list; unscored companies come last."""
    page, per_page = 2, 50
    return overview(spark, sf_dir).orderBy(F.col("score").desc_nulls_last(), "c_custkey").offset((page - 1) * per_page).limit(per_page)


@query(f"WITH {OVERVIEW_SQL} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS total_pages FROM overview WHERE score >= 20")
def overview_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and pages of a filtered list."""
    found = overview(spark, sf_dir).filter(compile_filters({"min_score": 20})).agg(F.count("*").alias("total"))
    return found.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 50)).cast("bigint"))


@query(f"WITH {OVERVIEW_SQL} SELECT * FROM overview WHERE score < 20 OR rank = 'A'")
def population_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named populations, joined by OR."""
    return overview(spark, sf_dir).filter(F.expr(POPULATIONS["low"]) | F.expr(POPULATIONS["top"]))


#: Named populations, as predicates over the overview.
POPULATIONS = {"low": "score < 20", "top": "rank = 'A'", "unscored": "score IS NULL"}


def compile_filters(chosen: dict) -> Column:
    """One predicate out of those filters that are given; missing and blank ones do not filter."""
    clauses = {
        "keyword": lambda x: F.lower("c_name").contains(x.strip().lower()) | F.lower("n_name").contains(x.strip().lower()),
        "segment": lambda x: F.col("c_mktsegment") == x,
        "rank": lambda x: F.col("rank") == x,
        "min_score": lambda x: F.col("score") >= x,
        "max_score": lambda x: F.col("score") <= x,
        "exclude_status": lambda x: F.col("o_orderstatus").isNull() | (F.col("o_orderstatus") != x),
        "ranked_if_analysed": lambda x: F.col("o_orderkey").isNull() | F.col("rank").isNotNull(),
        "unanalysed": lambda x: F.col("o_orderkey").isNull(),
    }
    out = F.lit(True)
    for name, value in chosen.items():
        if value not in (None, "", False):
            out = out & clauses[name](value)
    return out
