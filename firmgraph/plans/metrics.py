"""Counts, funnels, shares and costs. Events stand for the job queue and the run log, line items for usage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.functions.dims import SOURCE_PRIORITY, TOKEN_RATES
from firmgraph.functions.scoring import token_cost
from firmgraph.plans.registry import query, table

STATUSES = ("signup", "click", "view", "purchase", "error", "cancelled")
NOW = "2024-01-15 00:00:00"


@query(f"""SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%') AS urgent,
(SELECT count(*) FROM events WHERE ts >= date_trunc('week', TIMESTAMP '{NOW}')) AS this_week,
(SELECT count(*) FROM events WHERE event_type IN ('error', 'click')) AS queued""")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar counts in one row; each table is read once."""
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("companies"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    orders = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    week = F.date_trunc("WEEK", F.lit(NOW).cast("timestamp_ntz"))
    events = table(spark, sf_dir, "events").agg(F.count_if(F.col("ts") >= week).alias("this_week"), F.count_if(F.col("event_type").isin("error", "click")).alias("queued"))
    return customers.crossJoin(orders).crossJoin(events)  # one row each


STATUS_VALUES = ", ".join(f"('{s}')" for s in STATUSES)


@query(f"SELECT s AS status, count(event_id) AS n FROM (VALUES {STATUS_VALUES}) d(s) LEFT JOIN events ON event_type = s GROUP BY s")
def status_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, with 0 for statuses that do not occur."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS duplicate, count(*) - count(*) FILTER (event_type = 'error') AS discovered,
count(*) FILTER (event_type = 'purchase' AND value > 50) AS promoted, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS pending,
count(*) FILTER (event_type IN ('view', 'click', 'signup')) = 0 AS finished FROM events GROUP BY user_id""")
def recount_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run, recounted from its rows."""
    kind = F.col("event_type")
    pending = F.count_if(kind.isin("view", "click", "signup"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(kind == "error").alias("duplicate"), (F.count("*") - F.count_if(kind == "error")).alias("discovered"),
        F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("promoted"), pending.alias("pending"), (pending == 0).alias("finished"),
    )


@query("""SELECT l_returnflag AS model, count(*) AS calls, count(*) FILTER (l_linestatus = 'F') AS succeeded, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_in,
CAST(sum(l_partkey % 100) AS BIGINT) AS tokens_out FROM lineitem GROUP BY l_returnflag""")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, successes and token sums by model."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("l_linestatus") == "F").alias("succeeded"), F.sum(F.col("l_quantity").cast("bigint")).alias("tokens_in"), F.sum(F.col("l_partkey") % 100).alias("tokens_out"),
    )


RATES_SQL = ", ".join(f"('{m}', {a!r}e0, {b!r}e0)" for m, (a, b) in TOKEN_RATES.items())
COST_SQL = f"""usage AS (SELECT l_returnflag AS model, year(l_shipdate) AS y, month(l_shipdate) AS m, sum(CAST(l_quantity AS BIGINT)) AS i, sum(l_partkey % 100) AS o, sum(l_linenumber) AS cw, sum(l_suppkey % 10) AS cr
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
priced AS (SELECT usage.*, ((i + cw * 1.25e0 + cr * 0.1e0) * a + o * b) / 1e6 AS usd FROM usage LEFT JOIN (VALUES {RATES_SQL}) r(rm, a, b) ON model = rm)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful usage by model and month, with its cost; null for models without a known rate."""
    rates = spark.createDataFrame([(m, a, b) for m, (a, b) in TOKEN_RATES.items()], "model string, rate_in double, rate_out double")
    used = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))
    used = used.agg(F.sum(F.col("l_quantity").cast("bigint")).alias("i"), F.sum(F.col("l_partkey") % 100).alias("o"), F.sum("l_linenumber").alias("cw"), F.sum(F.col("l_suppkey") % 10).alias("cr"))
    return used.join(rates, "model", "left").withColumn("usd", token_cost(F.col("i"), F.col("o"), F.col("cw"), F.col("cr"), F.col("rate_in"), F.col("rate_out")))


@query(f"WITH {COST_SQL} SELECT y, m, round(coalesce(sum(usd), 0), 6) AS usd, bool_or(usd IS NULL) AS has_unknown FROM priced GROUP BY y, m")
def month_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by month, and whether some usage has no known rate."""
    return _usage(spark, sf_dir).groupBy("y", "m").agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"), F.bool_or(F.col("usd").isNull()).alias("has_unknown"))


@query(f"WITH {COST_SQL} SELECT model, round(sum(usd), 6) AS usd FROM priced GROUP BY model")
def unknown_rate_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by model: null, not 0, without a rate."""
    return _usage(spark, sf_dir).groupBy("model").agg(F.round(F.sum("usd"), 6).alias("usd"))


@query(f"WITH {COST_SQL}, months AS (SELECT y, m, round(coalesce(sum(usd), 0), 6) AS usd FROM priced GROUP BY y, m) SELECT y, m, budget, (budget > 0 AND usd >= budget) AS blocked FROM months, (VALUES (0e0), (0.001e0), (10e0)) b(budget)")
def budget_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a month's spending reaches a budget; 0 means no limit."""
    spent = month_cost(spark, sf_dir).withColumn("budget", F.explode(F.array(F.lit(0.0), F.lit(0.001), F.lit(10.0))))
    return spent.select("y", "m", "budget", ((F.col("budget") > 0) & (F.col("usd") >= F.col("budget"))).alias("blocked"))


@query("SELECT source, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY source")
def tally_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tally with shares of the whole."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("source", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


BUCKET_SQL = "CASE WHEN x = 0 THEN '0' WHEN x < 20 THEN '1-19' WHEN x < 40 THEN '20-39' WHEN x < 60 THEN '40-59' ELSE '60+' END"


@query(f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM (SELECT CAST(floor(value) AS BIGINT) AS x FROM events WHERE value IS NOT NULL) e GROUP BY bucket")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram in the report's score buckets."""
    x = F.floor("value")
    bucket = F.when(x == 0, "0").when(x < 20, "1-19").when(x < 40, "20-39").when(x < 60, "40-59").otherwise("60+")
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN source IN ('src0', 'src1') THEN 'web' END], lambda x: x IS NOT NULL)) AS reason FROM documents) r GROUP BY reason""")
def reason_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tally of the reasons in arrays."""
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("source").isin("src0", "src1"), "web")))
    return table(spark, sf_dir, "documents").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS n, round(count(text) * 1e0 / count(*), 6) AS has_text, round(count(toxic) * 1e0 / count(*), 6) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have an attribute."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    share = lambda c: F.round(F.count(c) * 1.0 / F.count("*"), 6)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), share("text").alias("has_text"), share("toxic").alias("labelled"))


@query("""SELECT n_signup, n_view, n_click, n_purchase, round(n_view * 1e0 / nullif(n_signup, 0), 6) AS view_rate, round(n_click * 1e0 / nullif(n_view, 0), 6) AS click_rate, round(n_purchase * 1e0 / nullif(n_click, 0), 6) AS purchase_rate,
round(n_none * 1e0 / nullif(n_none, 0), 6) AS none_rate FROM (SELECT count(*) FILTER (event_type = 'signup') n_signup, count(*) FILTER (event_type = 'view') n_view, count(*) FILTER (event_type = 'click') n_click,
count(*) FILTER (event_type = 'purchase') n_purchase, count(*) FILTER (event_type = 'none') n_none FROM events) f""")
def funnel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with a denominator each; null where that is 0."""
    kinds = ("signup", "view", "click", "purchase", "none")
    n = table(spark, sf_dir, "events").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])
    rate = lambda a, b: F.round(F.col(a) * 1.0 / F.nullif(b, F.lit(0)), 6)
    return n.select("n_signup", "n_view", "n_click", "n_purchase", rate("n_view", "n_signup").alias("view_rate"), rate("n_click", "n_view").alias("click_rate"), rate("n_purchase", "n_click").alias("purchase_rate"), rate("n_none", "n_none").alias("none_rate"))


CONTRIBUTION_SQL = "per AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS sources, max(l_linestatus = 'F') AS ok FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {CONTRIBUTION_SQL} SELECT source, count(*) AS involved, count(*) FILTER (ok) AS verified, count(*) FILTER (len(sources) = 1) AS exclusive, count(*) FILTER (len(sources) >= 2) AS multi_source
FROM (SELECT unnest(sources) AS source, sources, ok FROM per) u GROUP BY source""")
def provider_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source contributes: rows it is involved in, verified ones, those it alone has."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("sources"), F.max(F.col("l_linestatus") == "F").alias("ok"))
    rows = per.select(F.explode("sources").alias("source"), F.size("sources").alias("n"), "ok")
    return rows.groupBy("source").agg(F.count("*").alias("involved"), F.count_if("ok").alias("verified"), F.count_if(F.col("n") == 1).alias("exclusive"), F.count_if(F.col("n") >= 2).alias("multi_source"))


@query("""SELECT requests, candidates, registered, round(requests * 1e0 / nullif(candidates, 0), 6) AS per_candidate, round(requests * 3000e0 / nullif(registered, 0), 4) AS for_3000, round(requests * 5e0 / 1000, 6) AS usd
FROM (SELECT count(*) AS requests, count(DISTINCT user_id) AS candidates, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS registered FROM events) e""")
def unit_cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for each candidate and registration, projected, at 5 dollars for 1000."""
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("requests"), F.countDistinct("user_id").alias("candidates"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("registered"))
    return n.select("*", F.round(F.col("requests") * 1.0 / F.nullif("candidates", F.lit(0)), 6).alias("per_candidate"), F.round(F.col("requests") * 3000.0 / F.nullif("registered", F.lit(0)), 4).alias("for_3000"), F.round(F.col("requests") * 5.0 / 1000, 6).alias("usd"))


@query("""SELECT event_type AS provider, count(*) AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS found, bool_or(value > 99) AS skipped, min(CASE WHEN value > 99 THEN user_id END) AS first_user FROM events GROUP BY event_type""")
def provider_stat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counters by provider, merged field by field: sums, OR, first reason."""
    maps = table(spark, sf_dir, "events").select(F.create_map("event_type", F.struct(F.floor("value").alias("found"), (F.col("value") > 99).alias("skipped"), F.when(F.col("value") > 99, F.col("user_id")).alias("reason"))).alias("stats"))
    rows = maps.select(F.explode("stats").alias("provider", "s"))
    return rows.groupBy("provider").agg(F.count("*").alias("requests"), F.sum("s.found").alias("found"), F.bool_or("s.skipped").alias("skipped"), F.min("s.reason").alias("first_user"))


PRIORITY_VALUES = ", ".join(f"('{s}', {p})" for s, p in SOURCE_PRIORITY.items())


@query("""SELECT user_id, event_type, n, rank FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) c) r WHERE rank <= 3""")
def top_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most active users of each type; a top-k report."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).filter("rank <= 3")
