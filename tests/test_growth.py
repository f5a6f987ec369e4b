"""What grows with the tables: results on odd rows, and the work behind them."""

import time

from pyspark.sql import functions as F

from firmgraph.functions import text
from firmgraph.plans import registry


def test_addresses_build_no_pattern_where_no_half_of_a_key_stands(spark, tmp_path):
    """4,000 customers took 11 s while every key was tried as a dozen patterns."""
    spark.range(4000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    registry.QUERIES["firm_addresses"](spark, str(tmp_path)).limit(5).collect()
    began = time.time()
    got = registry.QUERIES["firm_addresses"](spark, str(tmp_path)).agg(F.count_if("shown").alias("shown"), F.count_if("elsewhere").alias("elsewhere"), F.count("*").alias("n")).first()
    assert tuple(got) == (4000, 0, 4000) and time.time() - began < 6


def test_an_address_with_one_other_letter(spark):
    def seen(key, page):
        return spark.range(1).select(text.appears(F.array(F.lit(key)), F.lit(page)).alias("v")).first()["v"]

    key = "東大阪市長田中1-2"
    assert all(seen(key, f"x{key[:i]}?{key[i + 1 :]}y") for i in range(len(key)))
    assert not any(seen(key, f"x{key[:i]}??{key[i + 2 :]}y") for i in range(len(key) - 1))
    assert seen("ab.de(gh)", "ab.dexgh)") and not seen("ab.de(gh)", "abxde(ghx") and not seen("abcdefg", "abcdefx")


def test_page_features_as_written(spark, tmp_path):
    """Titles cut within a reference, other references, unclosed links, pages without title or HTML: as the query's SQL reads them."""
    import duckdb

    html = ["<title> a &amp; b&amp</title><form>", "<title>t = &quot;x&amp;</title><a href='1'>1</a><a href=2>", "<title>x<b></title><!-- <a href= <form -->", "", None, "<a class=c href=1>1</a>"]
    rows = [(i, f"https://h.jp/{i}", h) for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["html_features"](spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(registry.ORACLES["html_features"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall())


def test_pairs_by_one_key_or_another_are_not_held(spark, tmp_path):
    """As many pairs as there are went into a distinct; ids that repeat with other nations still give each pair once."""
    import re

    import duckdb

    rng = __import__("random").Random(6)
    few = lambda n: [(rng.choice([*range(0, 900, 100), *range(1, 7), None]), rng.choice([0, 1, 2, None])) for _ in range(n)]
    for name, key, nation in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        spark.createDataFrame(few(60), f"{key} long, {nation} int").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = registry.QUERIES["or_join_as_union"](spark, str(tmp_path))
    sql = registry.ORACLES["or_join_as_union"]
    for name in ("customer", "supplier"):
        sql = re.sub(rf"(FROM|JOIN) {name}", rf"\1 read_parquet('{tmp_path}/{name}.parquet/*.parquet')", sql)
    assert sorted(tuple(r) for r in found.collect()) == sorted(duckdb.sql(sql).fetchall())
    assert not re.search(r"Aggregate \[c_custkey#\d+L, s_suppkey", found._jdf.queryExecution().optimizedPlan().toString())


def test_rounds_of_components_send_no_table_through_the_driver(spark, monkeypatch):
    from firmgraph.operators import resolve

    plans, save = [], resolve.Saved.save
    monkeypatch.setattr(resolve.Saved, "save", lambda self, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df, name))
    resolve.connected_components(spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")).collect()
    joins = [line for p in plans for line in p.splitlines() if "Join Inner" in line]
    assert len(joins) >= 3 and all("strategy=merge" in line for line in joins)


def test_similar_names_are_compared_once_for_all_their_rows(spark, monkeypatch):
    """Rows of one name were compared with each other, once for each piece of it."""
    from firmgraph.operators import resolve

    monkeypatch.setattr(resolve, "TOGETHER", 4)
    names = ["small widget", "small wodget", "large widget", "x"]
    rows = [(i, i % 2 if i % 9 else None, names[i % 3] if i < 60 else names[3]) for i in range(70)]
    got = [tuple(r) for r in resolve.fuzzy_pairs(spark.createDataFrame(rows, "id int, block int, name string"), ["block"], "id", "name", 0.88).collect()]
    near = lambda x, y: 0 if x == y else 1 if {x, y} == set(names[:2]) else None
    want = [(i, j, near(x, y)) for i, p, x in rows for j, q, y in rows if i < j and p is not None and p == q and near(x, y) is not None]
    assert sorted(got) == sorted(want)
    told = resolve.similar_names(spark.createDataFrame(rows, "id int, block int, name string"), ["block"], "name", 0.88).collect()
    assert sorted((r["block"], r["a"], r["b"]) for r in told) == [(0, *sorted(names[:2])), (1, *sorted(names[:2]))]


def test_names_of_a_frequent_piece_are_not_compared_for_it(spark, monkeypatch):
    """All names that begin with one word met each other where one edit is allowed."""
    from firmgraph.operators import resolve

    names = [f"customer#{i:07d}" for i in range(0, 400, 7)] + ["customer#000000", "customer#00000x0"]
    monkeypatch.setattr(resolve, "similarity", lambda a, b: F.lit(1.0))
    met = resolve.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), [], "name", 0.88).collect()
    assert {(r["a"], r["b"]) for r in met if len(r["a"]) == len(r["b"])} == {(a, b) for a in names for b in names if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1}
    assert all(r["distance"] == 1 for r in met) and len(met) < len(names) * 8


def test_arrays_of_a_key_are_made_in_several_tasks(spark, monkeypatch):
    """The task that joined a key with its number of arrays made all of them."""
    from firmgraph.operators import resolve

    monkeypatch.setattr(resolve, "TOGETHER", 10)
    arrays = resolve.in_arrays(spark.createDataFrame([("s", i) for i in range(400)], "name string, id int"), ["name"], "id")
    got = arrays.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(i for r in got for i in r["ids"]) == list(range(400)) and len({r["task"] for r in got}) > 1


def test_pages_are_read_a_few_at_a_time(spark):
    """Python held the parsed pages of a whole Arrow batch."""
    from firmgraph.operators import crawl

    n = 2 * crawl.AT_ONCE + 3
    rows = [(i, "https://h.jp/", None if i % 5 == 0 else f"<title>t{i}</title><a href='/{i}'>l</a>") for i in range(n)]
    got = crawl.page_features(spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1), parts=("title", "links")).collect()
    assert {r["page_id"]: (r["page"]["title"], [x["url"] for x in r["page"]["links"]]) for r in got} == {i: (f"t{i}", [f"https://h.jp/{i}"]) if i % 5 else (None, []) for i in range(n)}


def test_many_needles_of_one_name_and_ids_that_are_null(spark):
    """All rows of a name met all its texts in one task; no join of the result is by name and row any more."""
    from firmgraph.operators.containment import contained

    needles, texts = [*((i, "s") for i in range(300)), (None, "sup"), (900, "supplier"), (901, "none")], [*((i, "a supplier") for i in range(300)), (None, "sup")]
    found = contained(spark.createDataFrame(needles, "n long, name string"), spark.createDataFrame(texts, "t long, body string"), "n", "name", "t", "body")
    key = lambda p: tuple((x is None, x or 0) for x in p)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(((n, t) for n, name in needles for t, body in texts if name in body), key=key)
    assert "explode(ids_b" in found._jdf.queryExecution().optimizedPlan().toString()
