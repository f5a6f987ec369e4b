"""Lists for people: logs and queues with their parents, decisions on rows, search plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.functions.scoring import auto_review, recruit_target
from firmgraph.operators.planning import interleave, search_terms
from firmgraph.plans.registry import query, table


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def failed_jobs_with_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest failed jobs with their company, if it is there; the top 20 are cut before the join."""
    failed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return failed.join(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey", "left").drop("c_custkey")


@query("SELECT event_id, event_type, c_name FROM events LEFT JOIN customer ON user_id = c_custkey ORDER BY event_id DESC LIMIT 200")
def usage_log_with_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 log rows with their company."""
    log = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("c_custkey")).orderBy(F.desc("event_id")).limit(200)
    return log.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "left").drop("c_custkey")


@query("SELECT p_partkey, score, p_brand FROM (SELECT p_partkey, p_brand, CASE WHEN p_size % 4 <> 0 THEN p_size END AS score FROM part) t ORDER BY score DESC NULLS FIRST, p_partkey LIMIT 100")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for review; rows without a score come first."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("score"), "p_brand")
    return rows.orderBy(F.desc_nulls_first("score"), "p_partkey").limit(100)


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY n_name")
def needing_review_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return rows.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_name", "n")


@query("SELECT date_trunc('week', ts) AS week, date_trunc('month', ts) AS month, count(*) AS n FROM events GROUP BY ALL")
def activity_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks start on Mondays; times have no zone."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("WEEK", "ts").alias("week"), F.date_trunc("MONTH", "ts").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN reason IS NULL THEN 'promote' ELSE 'reject' END AS action, coalesce(reason, 'site confirmed') AS reason FROM (SELECT c_custkey,
CASE WHEN c_custkey % 5 = 0 THEN 'no site' WHEN c_mktsegment = 'MACHINERY' THEN 'directory page' WHEN coalesce(CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END, 0) < 60 THEN 'site not certain' END AS reason FROM customer) t""")
def auto_review_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion or rejection, with the reason."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "directory page").alias("gate"), F.when(F.col("c_custkey") % 5 != 0, "x").alias("site"), F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100)).cast("int").alias("sure")
    )
    return rows.select("c_custkey", auto_review(F.col("gate"), F.col("site"), F.col("sure")).alias("d")).select("c_custkey", "d.action", "d.reason")


@query("""SELECT user_id, CASE WHEN pages > 0 AND CAST(clicks > 3 AS INTEGER) + CAST(views > 10 AS INTEGER) + CAST(buys > 5 AS INTEGER) >= 2 AND letters >= 1200 THEN 'active_recruit' WHEN pages > 0 THEN 'weak_recruit_page' WHEN errors > 5 OR buys > 8 THEN 'no_recruit_page' ELSE 'no_signal' END AS target
FROM (SELECT user_id, count(*) FILTER (event_type = 'signup' AND value > 60) pages, count(*) FILTER (event_type = 'click') clicks, count(*) FILTER (event_type = 'view') views, count(*) FILTER (event_type = 'purchase') buys, count(*) FILTER (event_type = 'error') errors, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) letters FROM events GROUP BY user_id) u""")
def recruit_target_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hiring activity in four classes."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "signup") & (F.col("value") > 60)).alias("pages"), n("click").alias("clicks"), n("view").alias("views"), n("purchase").alias("buys"), n("error").alias("errors"), F.sum(F.floor("value")).alias("letters"))
    c = F.col
    return u.select("user_id", recruit_target(c("pages") > 0, c("clicks") > 3, c("views") > 10, c("buys") > 5, c("letters"), c("errors") - 5, c("buys") > 8).alias("target"))


@query("SELECT n_name || ' ' || r_name AS term, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS INTEGER) AS rank, r_name AS topic FROM nation JOIN region ON n_regionkey = r_regionkey QUALIFY rank <= 3")
def search_term_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of each topic, up to three."""
    words = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("topic"), F.col("n_name").alias("word"), F.col("n_nationkey").alias("ord"))
    return search_terms(words, 3)


@query("""SELECT 'q' || (row_number() OVER (ORDER BY rank, topic) - 1) AS id, term, topic FROM (SELECT n_name || ' ' || r_name AS term, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS rank, r_name AS topic FROM nation JOIN region ON n_regionkey = r_regionkey) t WHERE rank <= 3""")
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of all topics, interleaved and numbered."""
    return interleave(search_term_plan(spark, sf_dir), "topic").select("id", "term", "topic")
