"""Table changes, the job queue and integrity reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.operators import tables
from firmgraph.operators.resolve import shared_folder
from firmgraph.plans.registry import query, table
from firmgraph.sources import csv_export
from firmgraph.streaming import queue

NOW = "2024-01-10 00:00:00"


@query("SELECT c_custkey AS k, c_mktsegment AS s FROM customer UNION ALL SELECT DISTINCT s_suppkey * 31, 'new' FROM supplier WHERE s_suppkey * 31 NOT IN (SELECT c_custkey FROM customer)")
def insert_if_absent_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows only where the key is not there, into a table that grows with the customers; about half of the suppliers' keys are new."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return tables.insert_absent(known, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 31).alias("k"), F.lit("new").alias("s")), ["k"])


UPSERT_SQL = """old AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS p, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
new AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS p, max(-o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""


@query(f"WITH {UPSERT_SQL} SELECT * FROM new UNION ALL SELECT old.* FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k = old.k AND new.p IS NOT DISTINCT FROM old.p)")
def null_safe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete-then-insert by a key whose null parts are equal."""
    part = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("p")
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), part, F.col("o_totalprice").alias("v"))
    new = orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k"), part).agg(F.max(-F.col("o_totalprice")).alias("v"))
    return tables.replace_matching(old, new, ["k", "p"])


@query("SELECT conv_id, turn, length(text) AS n FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 0 FROM conversations WHERE conv_id % 5 = 0")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of some parents, replaced."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    fresh = rows.filter("conv_id % 5 = 0").select("conv_id").distinct().select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("n"))
    return tables.replace_matching(rows, fresh, ["conv_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'R' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 0 ELSE o_custkey END AS attempts FROM orders")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state change of those rows that are in the right state."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("attempts"), "o_totalprice")
    hit = (F.col("status") == "F") & (F.col("o_totalprice") > 100000)
    return tables.update_where(rows, hit, status=F.lit("R"), attempts=F.lit(0).cast("bigint")).drop("o_totalprice")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 OR c_acctbal IS NULL THEN c_name END AS c_name, CASE WHEN c_acctbal >= 0 OR c_acctbal IS NULL THEN c_mktsegment END AS c_mktsegment FROM customer")
def retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that turned out wrong, taken back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return tables.retract(rows, F.col("c_acctbal") < 0, ["c_name", "c_mktsegment"]).drop("c_acctbal")


@query("""SELECT 'repeated line' AS "check", l_partkey || '|' || l_suppkey || '|' || l_linenumber AS key FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'no supplier', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'score out of range', CAST(event_id AS VARCHAR) FROM events WHERE value < 0 OR value > 100
UNION ALL SELECT 'unknown status', CAST(event_id AS VARCHAR) FROM events WHERE event_type NOT IN ('signup', 'click', 'view', 'purchase')""")
def violations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken constraint with its key: uniqueness, references, ranges, enumerations."""
    lines, events = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events")
    rules = {"score out of range": F.col("value").between(0, 100), "unknown status": F.col("event_type").isin("signup", "click", "view", "purchase")}
    found = tables.repeated_keys(lines, ["l_partkey", "l_suppkey", "l_linenumber"], "repeated line")
    found = found.unionAll(tables.orphans(lines, table(spark, sf_dir, "supplier"), "l_partkey", "s_suppkey", "no supplier"))
    return found.unionAll(tables.broken_rules(events, "event_id", rules))


@query('''SELECT concat_ws(',', CAST(c_custkey AS VARCHAR), '"' || c_name || ', ""' || c_mktsegment || '"""', CASE WHEN c_acctbal >= 0 THEN 'yes' ELSE '' END) AS line FROM customer''')
def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV lines with labels and quoting."""
    title = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    return csv_export.lines(table(spark, sf_dir, "customer"), {"id": F.col("c_custkey"), "name": title, "active": F.when(F.col("c_acctbal") >= 0, "yes")})


@query(f"""SELECT event_id, user_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 'stale' ELSE 'pending' END AS origin FROM events
WHERE event_type = 'click' OR (event_type = 'view' AND ts < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE) ORDER BY value DESC, ts, event_id LIMIT 100""")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next jobs by priority and age: pending ones and those whose worker was lost."""
    stale = (F.col("event_type") == "view") & (F.col("ts") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 15 MINUTES"))
    ready = table(spark, sf_dir, "events").withColumn("origin", F.when(stale, "stale").otherwise("pending")).filter((F.col("event_type") == "click") | stale)
    return ready.orderBy(F.desc("value"), "ts", "event_id").limit(100).select("event_id", "user_id", "origin")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def enqueue_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs, except where one is active."""
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey").join(active, "c_custkey", "left_anti")


@query("""SELECT e.user_id, CASE WHEN errors >= 3 THEN 'failed' WHEN errors > 0 THEN 'pending' WHEN done IS NOT NULL THEN 'completed' ELSE 'pending' END AS status, CAST(errors AS INTEGER) AS attempts, handled FROM
(SELECT user_id, count(*) AS handled, count(*) FILTER (event_type = 'error' AND (done IS NULL OR (ts, event_id) > done)) AS errors, any_value(done) AS done FROM
 (SELECT *, max(CASE WHEN event_type = 'purchase' THEN row(ts, event_id) END) OVER (PARTITION BY user_id) AS done FROM events) d GROUP BY user_id) e""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of jobs from a stream of their events; the last state of each."""
    schema = table(spark, sf_dir, "events").schema
    # a stream reads folders: the pattern picks the events table out of its folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    folder = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    states = queue.run_to_table(queue.job_states(stream.select("user_id", "event_type", "ts", "event_id")), folder, "update")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts", "handled"), "batch").alias("s"))
    return last.select("user_id", "s.status", "s.attempts", "s.handled")
