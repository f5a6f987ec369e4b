"""Queries over whole tables, on small tables that a cut by ids or numbers would show."""

import random

from firmgraph.operators import resolve
from firmgraph.plans import registry


def union_find(edges):
    root = {v: v for e in edges for v in e}

    def top(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {v: top(v) for v in root}


def test_components_of_long_chains_and_a_hot_vertex(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10**6), 900)
    edges = list(zip(ids[:300], ids[1:300])) + [(i, i + 1) for i in range(2 * 10**6, 2 * 10**6 + 200)]
    edges += [(ids[300], v) for v in ids[301:800]] + [(ids[800], ids[801]), (ids[801], ids[800]), (ids[802], ids[802])]
    got = resolve.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["label"] for r in got} == union_find(edges)
    assert len(got) == len(union_find(edges))


def test_component_query_joins_whole_chains(spark, tmp_path):
    keys = [*range(1, 41), *range(60, 77), 90]
    rows = [(k, "1-URGENT") for k in keys] + [(50, "2-HIGH"), (3, "1-URGENT")]
    spark.createDataFrame(rows, "o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["id"]: r["label"] for r in registry.QUERIES["entity_components_all"](spark, str(tmp_path)).collect()}
    assert got == union_find([(k, k + 1) for k in keys])
    assert set(got.values()) == {1, 60, 90}


def test_survivors_and_inserts_take_all_rows(spark, tmp_path):
    customers = [(k, 0, "seg", float(k)) for k in range(1, 701)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k,) for k in range(1, 47)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = registry.QUERIES["survivor_order_all"](spark, str(tmp_path)).collect()
    assert {r["id"] for r in got} == set(range(1, 701)) and {r["survivor"] for r in got} == {698}
    rows = [tuple(r) for r in registry.QUERIES["insert_if_absent_all"](spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted([(k, "seg") for k in range(1, 701)] + [(31 * k, "new") for k in range(1, 47) if 31 * k > 700])


def test_documents_with_several_addresses_are_kept(spark, tmp_path):
    rows = [(0, "Write to B@firm.co or a@firm.co, b@firm.co"), (1, "to c@firm.co"), (2, "none"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["emails_extracted"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["emails"] for r in got} == {0: ["b@firm.co", "a@firm.co"], 1: ["c@firm.co"]}


def test_fuzzy_pairs_match_brute_force(spark):
    import random

    from firmgraph.operators.resolve import fuzzy_pairs

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    for w in list(names[:60]):
        x = list(w)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        names.append("".join(x))
    rows = [(i, i % 2, n) for i, n in enumerate(names)] + [(999, 0, None)]
    df = spark.createDataFrame(rows, "id int, block int, name string")
    for least in (0.6, 0.85):
        got = {(r["a"], r["b"]): r["distance"] for r in fuzzy_pairs(df, ["block"], "id", "name", least).collect()}
        want = {}
        for i, p, x in rows:
            for j, q, y in rows:
                if i < j and p == q and x and y and abs(len(x) - len(y)) <= 4 and 1 - distance(x, y) / max(len(x), len(y)) >= least - 1e-12:
                    want[i, j] = distance(x, y)
        assert got == want
