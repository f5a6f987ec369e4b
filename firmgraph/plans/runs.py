"""Pools, counters and repairs of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.operators import observations, outreach, planning, tables
from firmgraph.plans.registry import query, table


@query("SELECT c_custkey AS id, c_mktsegment AS status, c_acctbal AS score FROM customer WHERE c_acctbal IS NOT NULL AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_mktsegment IN ('MACHINERY', 'BUILDING') ORDER BY score DESC NULLS LAST, id LIMIT 50")
def outreach_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best drafts that may be sent, a top-k report with five times as many as wanted."""
    c = F.col
    status = F.when(c("c_mktsegment") == "MACHINERY", "unsent").when(c("c_mktsegment") == "BUILDING", "failed").otherwise("sent")
    drafts = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").cast("string").alias("body"), F.when(c("c_custkey") % 3 != 0, "f").alias("form"), F.when(c("c_custkey") % 7 == 0, "false").otherwise("unknown").alias("allowed"), status.alias("status"), "c_mktsegment", c("c_acctbal").alias("score"))
    return outreach.pool(drafts, 10).select("id", c("c_mktsegment").alias("status"), "score")


@query("SELECT o_custkey AS run, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of runs, counted anew from their jobs instead of added up."""
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("total"), is_("F").alias("done"), is_("P").alias("failed"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'HELD' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'HELD' THEN 2 ELSE 1 END AS version FROM customer")
def stamped_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stamps the rows that it changes, and no others."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal", F.lit(1).alias("version"))
    return tables.update_stamped(rows, F.col("c_acctbal") < 0, "version", F.lit(2), segment=F.lit("HELD")).drop("c_acctbal")


@query("SELECT l_partkey AS candidate, min(row(l_linenumber, l_orderkey))[2] AS restored FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.05 GROUP BY l_partkey")
def restored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what was rejected, the first of each candidate that passes now."""
    rejected = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount < 0.05")
    return rejected.groupBy(F.col("l_partkey").alias("candidate")).agg(F.min(F.struct("l_linenumber", "l_orderkey"))["l_orderkey"].alias("restored"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 AND p_partkey % 4 <> 0 AND p_retailprice >= 1000 THEN 'verified' WHEN p_size < 10 THEN 'failed' ELSE 'kept' END AS status, p_size IN (10, 11) AND p_partkey % 4 = 0 AS to_check FROM part")
def repaired_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed candidates with a company and a good score are verified; what waits without a company is checked again."""
    c = F.col
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_size") < 10, "failed").otherwise("kept").alias("status"), F.when(c("p_partkey") % 4 != 0, c("p_partkey")).alias("company"), c("p_retailprice").alias("score"), "p_size")
    rows = rows.withColumn("to_check", c("p_size").isin(10, 11) & c("company").isNull())
    return tables.update_where(rows, (c("status") == "failed") & c("company").isNotNull() & (c("score") >= 1000), status=F.lit("verified")).select("p_partkey", "status", "to_check")


@query("SELECT c_custkey, c_mktsegment AS mail FROM customer WHERE c_custkey % 5 = 0 AND (c_custkey % 2 = 0 OR c_acctbal > 0)")
def orphaned_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies without a site that still have a contact from it."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_custkey") % 5 != 0, "u").alias("site"), c("c_mktsegment").alias("mail"), F.when(c("c_custkey") % 2 == 0, "m").alias("form"), F.when(c("c_acctbal") > 0, "p").alias("phone"))
    return rows.filter(c("site").isNull() & F.coalesce("form", "phone").isNotNull()).select("c_custkey", "mail")


@query("""SELECT kind, id, stamp FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS stamp FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'event', event_id, ts FROM events WHERE user_id = 7) t ORDER BY stamp DESC, kind, id LIMIT 10""")
def merged_job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest jobs of one company out of two lists."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey = 7").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stamp"))
    events = table(spark, sf_dir, "events").filter("user_id = 7").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("stamp"))
    return orders.unionByName(events).orderBy(F.desc("stamp"), "kind", "id").limit(10)


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC)[1:5] AS newest FROM orders GROUP BY o_custkey")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest children of each parent; ranked before they are gathered."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    kept = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(newest)).filter("rn <= 5")
    return kept.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("newest"))


@query("SELECT count(*) AS n, round(sum(value), 6) AS total FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 200) t")
def shown_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the newest 200 rows that a page shows."""
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(200).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT l_orderkey, l_linenumber, running FROM (SELECT l_orderkey, l_linenumber, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM lineitem) t")
def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been spent up to each line, in order of shipment, over the whole table."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost"))
    return planning.running_sums(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "cost").select("l_orderkey", "l_linenumber", "running")


BUDGET_SQL = "SELECT event_id, CASE WHEN event_type = 'error' THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(value * 10) AS BIGINT) END AS cost, ts FROM events"


@query(f"SELECT event_id, cost FROM (SELECT *, sum(cost) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM ({BUDGET_SQL}) e) t WHERE running <= 200000")
def budgeted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order while the budget lasts; errors give a part of it back."""
    c = F.col
    cost = F.when(c("event_type") == "error", -F.floor("value")).otherwise(F.floor(c("value") * 10))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", cost.alias("cost"))
    return planning.within_budget(rows, ["ts", "event_id"], "cost", 200_000).select("event_id", "cost")


@query("""WITH q AS (SELECT event_id AS seq, event_type AS provider, event_type = 'error' AS failed, 1 + event_id % 3 AS cost, user_id AS key FROM events), ran AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM q) t WHERE upto <= 5000),
f AS (SELECT min(seq) AS seq FROM ran WHERE NOT failed GROUP BY key)
SELECT provider, count(*) AS requests, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed) AS results, count(*) FILTER (NOT failed AND seq IN (SELECT seq FROM f)) AS new, count(*) FILTER (NOT failed AND seq NOT IN (SELECT seq FROM f)) AS duplicates FROM ran GROUP BY provider""")
def provider_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By provider, what requests within the budget found, and how much of it was new."""
    e = table(spark, sf_dir, "events")
    plan = e.select(F.col("event_id").alias("seq"), F.col("event_id").alias("id"), F.col("event_type").alias("provider"), (F.col("event_id") % 3 + 1).alias("cost"), (F.col("event_type") == "error").alias("failed"))
    return planning.provider_stats(plan, e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key")), 5000)


@query("SELECT c_custkey AS seq, c_nationkey % 4 AS source, 'q' || (row_number() OVER (ORDER BY rank, source) - 1) AS id FROM (SELECT c_custkey, c_nationkey, c_nationkey % 4 AS source, row_number() OVER (PARTITION BY c_nationkey % 4 ORDER BY c_custkey) AS rank FROM customer) t")
def interleaved_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of four sources dealt in turn: the first of each, then the second of each."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), (F.col("c_nationkey") % 4).alias("source"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("seq")))
    return planning.interleave(ranked, "source").select("seq", "source", "id")


@query("SELECT s_suppkey AS id, cost FROM (SELECT *, sum(cost) OVER (ORDER BY seq) AS running FROM (SELECT s_suppkey, s_suppkey AS seq, 1 + s_suppkey % 5 AS cost FROM supplier WHERE s_suppkey % 7 <> 0) p) t WHERE running + (SELECT sum(1 + s_suppkey % 5) FROM supplier WHERE s_suppkey % 7 = 0) <= 120")
def next_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run does next: planned requests that are not done and fit what is left."""
    k = F.col("s_suppkey")
    plan = table(spark, sf_dir, "supplier").select(k.alias("seq"), k.alias("id"), (k % 5 + 1).alias("cost"))
    return planning.next_batch(plan, plan.filter("id % 7 = 0").select("id"), "cost", 120).select("id", "cost")


RAW = "CASE WHEN event_id % 10 = 9 THEN '{bad' ELSE '{' || CASE event_id % 3 WHEN 0 THEN '\"name\":\"c' WHEN 1 THEN '\"company\":{\"name\":\"c' ELSE '\"title\":\"c' END || CAST(user_id AS STRING) || CASE event_id % 3 WHEN 1 THEN '\"}' ELSE '\"' END || ',\"place\":{\"city\":\"' || event_type || '\"},\"observed\":' || props || CASE WHEN event_id % 4 = 0 THEN ',\"tags\":[\"a\",\"b' || CAST(event_id % 7 AS STRING) || '\"]' ELSE '' END || '}' END"


@query(f"""WITH r AS (SELECT event_id, {RAW} AS raw FROM events), v AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM r)
SELECT event_id, coalesce(json_extract_string(raw, '$.name'), json_extract_string(raw, '$.company.name'), json_extract_string(raw, '$.title')) AS name, json_extract_string(raw, '$.place.city') AS city, CAST(json_extract_string(raw, '$.observed.k') AS BIGINT) AS employees, json_extract_string(raw, '$.tags[1]') AS second_tag, raw IS NOT NULL AS readable FROM v""")
def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations of several layouts as rows: nested paths with fallbacks, unreadable ones as such."""
    return observations.merged_rows(table(spark, sf_dir, "events").select("event_id", F.expr(RAW).alias("raw")), "event_id", "raw")
