"""Joins and entity resolution: first match by priority, survivors, merges, conflicts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.operators.containment import contained
from firmgraph.operators.discovery import assign_sites
from firmgraph.operators.fold import resolve_in_order
from firmgraph.operators.resolve import placed, register, connected_components, first_match, fuzzy_pairs, keep_first, merge_by_priority
from firmgraph.plans.registry import query, table


@query("SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_groups_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with more than one row."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order")).filter("n > 1")


@query("SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, coalesce(l_returnflag, '') ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem) t WHERE rn = 1")
def keep_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of each key; null parts of a key are equal."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate")
    return keep_first(rows, ["l_suppkey", F.coalesce("l_returnflag", F.lit(""))], ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) t WHERE rn = 1")
def keep_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the highest value of each key, the first of equal ones."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))
    return keep_first(rows, ["conv_id"], [F.desc("n"), "turn"])


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def distinct_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that should have one value and have several: a sign of wrong merges."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).filter("n > 1")


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key."""
    return keep_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def history_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 log rows."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query("SELECT event_id, event_type, pos FROM (SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE -1 END AS pos FROM events) t ORDER BY pos, event_id LIMIT 300")
def custom_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a given order of statuses; unknown ones come first, as index -1."""
    order = F.array(*map(F.lit, ("error", "purchase", "click")))
    pos = F.array_position(order, F.col("event_type")).cast("int") - 1
    return table(spark, sf_dir, "events").select("event_id", "event_type", pos.alias("pos")).orderBy("pos", "event_id").limit(300)


@query("SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer) t ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 500")
def nulls_first_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue by descending score in which rows without a score come first."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return rows.orderBy(F.desc_nulls_first("bal"), "c_custkey").limit(500)


MATCH_SQL = """inc AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 500 END AS corp, c_nationkey AS dom, c_mktsegment AS nam FROM customer),
ex AS (SELECT s_suppkey AS eid, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 500 END AS corp, s_nationkey + 10 AS dom, CASE WHEN s_suppkey % 2 = 1 THEN 'BUILDING' ELSE 'NONE' END AS nam FROM supplier),
hit AS (SELECT id, eid, CASE WHEN i.corp = e.corp THEN 1 WHEN i.dom = e.dom THEN 2 ELSE 3 END AS prio FROM inc i JOIN ex e ON (i.corp = e.corp OR i.dom = e.dom OR i.nam = e.nam)
  WHERE i.corp IS NULL OR e.corp IS NULL OR i.corp = e.corp)"""


def _match_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    incoming = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 500).alias("corp"), F.col("c_nationkey").alias("dom"), F.col("c_mktsegment").alias("nam"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("eid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 500).alias("corp"), (F.col("s_nationkey") + 10).alias("dom"), F.when(F.col("s_suppkey") % 2 == 1, "BUILDING").otherwise("NONE").alias("nam"))
    return incoming, known


@query(f"WITH {MATCH_SQL} SELECT id, eid, prio FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, eid) AS rn FROM hit) t WHERE rn = 1")
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known row that matches by the strongest key; different numbers veto every match."""
    incoming, known = _match_sides(spark, sf_dir)
    return first_match(incoming, known, ["corp", "dom", "nam"], "id", "eid", veto="corp")


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON (c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey % 100) OR c_custkey = s_suppkey""")
def or_join_as_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on one key or another, as a union of equi-joins without common rows, so that no pair is held to be told apart.

    Rows of one id are one row with its set of nations (25 at most); of the nations that a pair shares, it is made at the least one.
    """
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c = c.groupBy("c_custkey").agg(F.collect_set("c_nationkey").alias("cn"))
    s = s.groupBy("s_suppkey").agg(F.collect_set("s_nationkey").alias("sn"))
    left = c.withColumns({"nation": F.explode("cn"), "part": F.col("c_custkey") % 100})
    right = s.withColumns({"nation": F.explode("sn"), "part": F.col("s_suppkey") % 100})
    once = (F.size("cn") == 1) | (F.size("sn") == 1) | (F.array_min(F.array_intersect("cn", "sn")) == F.col("nation"))
    one = left.join(right, ["nation", "part"]).filter(once).select("c_custkey", "s_suppkey")
    return one.unionAll(c.join(s, c.c_custkey == s.s_suppkey).filter(~F.arrays_overlap("cn", "sn")).select("c_custkey", "s_suppkey"))


@query("SELECT s_suppkey, s_nationkey, n - 1 AS others FROM (SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) t WHERE n > 1")
def conflict_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key others hold too, found by a count instead of a self-join."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    counts = supplier.groupBy("s_nationkey").agg(F.count("*").alias("n")).filter("n > 1")
    return supplier.join(counts, "s_nationkey").select("s_suppkey", "s_nationkey", (F.col("n") - 1).alias("others"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")
def semi_in_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is in a grouped subquery."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a child."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT user_id, max_by(event_type, prio) FILTER (event_type <> 'click') AS kind, max_by(value, prio) FILTER (value IS NOT NULL) AS value, count(*) AS observations,
array_to_string(list_sort(list_distinct(list(event_type))), ',') AS sources
FROM (SELECT *, (CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)::BIGINT * 1000000000 - event_id AS prio FROM events) e GROUP BY user_id""")
def survivor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each field of a merged row, the value of the most trusted source that has one."""
    trust = {"purchase": 5, "signup": 4, "view": 3, "click": 2}
    rows = table(spark, sf_dir, "events").withColumn("kind", F.nullif("event_type", F.lit("click")))
    merged = merge_by_priority(rows, ["user_id"], ["kind", "value"], "event_type", trust, [-F.col("event_id")])
    return merged.select("user_id", "kind", "value", "observations", F.array_join("sources", ",").alias("sources"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, avg_price) AS value FROM customer LEFT JOIN (SELECT o_custkey, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming values fill gaps and replace nothing."""
    incoming = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
    known = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("own"))
    return known.join(incoming, "c_custkey", "left").select("c_custkey", F.coalesce("own", "avg_price").alias("value"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
WHERE abs(length(a.p_name) - length(b.p_name)) <= 4 AND (a.p_name = b.p_name OR 1 - levenshtein(a.p_name, b.p_name) * 1e0 / greatest(length(a.p_name), length(b.p_name)) >= 0.88)""")
def blocked_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar names within a block."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_type")
    return fuzzy_pairs(part, ["p_brand", "p_type"], "id", "name", 0.88)


@query()
def entity_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the whole link table, whose chains grow with it; tested against union-find, as recursive SQL walks each chain from every vertex."""
    links = table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b")).distinct()
    return connected_components(links)


@query("""SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def observations_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with equal keys, as one with their number and first position."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    return rows.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first_line"))


@query("""SELECT c_custkey, orders, lines, last_status FROM customer JOIN (SELECT o_custkey, count(*) AS orders, max_by(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON k = c_custkey""")
def detail_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent with the counts of its children, each aggregated before it is joined."""
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    by_order = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    lines = orders.join(by_order, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("lines"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey").join(lines, "c_custkey", "left").select("c_custkey", "orders", "lines", "last_status")


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey % 5 AS block, c_acctbal AS score, c_custkey % 3 AS state FROM customer)
SELECT id, block, first_value(id) OVER (PARTITION BY block ORDER BY state DESC, score DESC, id) AS survivor FROM c""")
def survivor_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a group that others are merged into: by status, score, then age; found by an aggregate, not a sort of the group."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("block"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 3).alias("state"))
    best = rows.groupBy("block").agg(F.max_by("id", F.struct("state", "score", -F.col("id"))).alias("survivor"))
    return rows.join(best, "block").select("id", "block", "survivor")


@query("SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS rank FROM orders GROUP BY o_orderstatus")
def status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses by their number of rows."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "o_orderstatus")))


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as known companies and customers as what came in, with keys that some share: numbers, domains, phones, names with slips, addresses, cities."""
    c = F.col
    some = lambda key, by, modulus, prefix: F.when(key % by != 0, F.concat(F.lit(prefix), (key * 7919 % modulus).cast("string")))
    def shape(rows, kind, key, name, nation, seed):
        keyed = rows.select(F.concat(F.lit(kind), c(key).cast("string")).alias("id"), c(key).alias("k"), c(nation).alias("city"), c(name).alias("raw"))
        slip = F.when(c("k") % 11 == 0, F.concat(F.substring("raw", 1, 15), F.lit("x"))).otherwise(F.substring("raw", 1, 16))
        return keyed.select("id", "k", F.lit(seed).alias("seed"), (F.lit(30) + c("k") % 3 * 30).cast("int").alias("trust"), some(c("k"), 3, 4001, "n").alias("number"), some(c("k"), 2, 997, "d").alias("domain"), some(c("k"), 5, 2003, "p").alias("phone"), F.lower(slip).alias("name"), some(c("k"), 4, 499, "a").alias("address"), c("city").cast("string").alias("city"))
    known = shape(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "s_name", "s_nationkey", True)
    new = shape(table(spark, sf_dir, "customer"), "c", "c_custkey", "c_name", "c_nationkey", False)
    return placed(known.unionAll(new).withColumn("later", ~c("seed")), "later", "k")


@query()
def resolved_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as they come in, each given to the first known or new company that it matches by six levels. (Each row depends on those before it; tested against the loop.)"""
    return resolve_in_order(_firms(spark, sf_dir))


@query()
def registered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers registered among suppliers as known companies, by number, domain, or name and address; different numbers stay apart. (Tested against the loop.)"""
    rows = _firms(spark, sf_dir)
    keys = [F.col("number").alias("corporate_number"), "domain", F.col("name").alias("normalized_name"), F.col("address").alias("address_key")]
    return register(rows.filter("seed").select(F.col("k").alias("company_id"), *keys), rows.filter("NOT seed").select(F.col("k").alias("id"), *keys))


NEEDLES_SQL = """n AS (SELECT 'b' || item_id AS needle_id, substr(text, 9, 8 + CAST(item_id % 90 AS INTEGER)) AS needle FROM benchmark UNION ALL SELECT 'p' || p_partkey, p_name FROM part UNION ALL SELECT 's' || s_suppkey, lower(substr(s_name, 1, CAST(1 + s_suppkey % 4 AS INTEGER))) FROM supplier)"""


@query(f"WITH {NEEDLES_SQL}, d AS (SELECT DISTINCT needle FROM n WHERE needle <> ''), h AS (SELECT needle, doc_id FROM d JOIN documents ON contains(text, needle)) SELECT needle_id, doc_id FROM n JOIN h USING (needle)")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a name and a text that contains it: parts' names, pieces of benchmark items, and some of one to four letters."""
    needles = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("needle_id"), F.expr("substr(text, 9, 8 + CAST(item_id % 90 AS INT))").alias("needle"))
    needles = needles.unionAll(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "p_name"))
    needles = needles.unionAll(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.expr("lower(substr(s_name, 1, CAST(1 + s_suppkey % 4 AS INT)))")))
    return contained(needles, table(spark, sf_dir, "documents").select("doc_id", "text"), "needle_id", "needle", "doc_id", "text")


@query()
def sites_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company for each domain: orders as candidate sites, scored by their price. (Rounds of proposals; tested against the order of scores.)"""
    orders = table(spark, sf_dir, "orders")
    found = orders.select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("d"), (F.col("o_orderkey") * 7919 % 2500).cast("string")).alias("domain"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), F.col("o_orderkey").alias("ord"))
    return assign_sites(found)
