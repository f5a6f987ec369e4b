"""Resolution in rounds against the loop that it stands for."""

import random

from pyspark.sql import functions as F

from firmgraph.operators import fold, resolve

SCHEMA = "id string, place long, seed boolean, trust int, number string, domain string, phone string, name string, address string, city string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return row[-1]


def alike(a, b):
    return min(len(a), len(b)) >= fold.LETTERS and abs(len(a) - len(b)) <= 4 and 1 - distance(a, b) / max(len(a), len(b)) >= fold.ALIKE - 1e-12


def loop(rows, levels=fold.LEVELS):
    """What a loop over the rows finds."""
    entities, out = [], {}
    names = ("number", "domain", "phone", "name", "address", "city")

    def shown(entity, name):
        best = None
        for trust, values in entity["members"]:
            if values[name] and (best is None or trust > best[0]):
                best = (trust, values[name])
        return best and best[1]

    tests = {
        "corporate_number": lambda v, e: v["number"] and v["number"] == shown(e, "number"),
        "domain": lambda v, e: v["domain"] and v["domain"] == shown(e, "domain"),
        "phone": lambda v, e: v["phone"] and v["phone"] == shown(e, "phone"),
        "name_address": lambda v, e: v["name"] and v["address"] and v["name"] == shown(e, "name") and v["address"] == shown(e, "address"),
        "name_city": lambda v, e: v["name"] and v["city"] and v["name"] == shown(e, "name") and v["city"] == shown(e, "city"),
        "fuzzy_name": lambda v, e: v["name"] and v["city"] and v["city"] == shown(e, "city") and shown(e, "name") and alike(v["name"], shown(e, "name")),
    }
    for id, _, seed, trust, *attributes in sorted(rows, key=lambda r: r[1]):
        v = dict(zip(names, attributes))
        hit = None
        if not seed:
            allowed = [e for e in entities if not (v["number"] and shown(e, "number") and v["number"] != shown(e, "number"))]
            hit = next(((e, k) for k in levels for e in allowed if tests[k](v, e)), None)
        if hit is None:
            hit = ({"id": id, "members": []}, None)
            entities.append(hit[0])
        hit[0]["members"].append((trust, v))
        out[id] = (hit[0]["id"], hit[1])
    return out


def random_rows(n, seed, kinds, sparse=0.5):
    rng = random.Random(seed)
    some = lambda prefix, share=sparse: prefix + str(int(rng.expovariate(1) * kinds) % kinds) if rng.random() < share else rng.choice([None, ""])
    name = lambda: (lambda x: x if rng.random() < 0.7 else x[:-1] + rng.choice("xy"))("company" + str(rng.randrange(kinds)).zfill(4))
    return [(f"r{i}", i, rng.random() < 0.05, rng.choice([30, 60, 80, 100]), some("n", 0.3), some("d"), some("p", 0.3), name(), some("a", 0.3), some("c", 0.6)) for i in range(n)]


def got(spark, rows, levels=fold.LEVELS):
    return {r["id"]: (r["entity"], r["reason"]) for r in fold.resolve_in_order(spark.createDataFrame(rows, SCHEMA), levels).collect()}


def test_equals_the_loop(spark):
    for n, seed, kinds in ((70, 1, 12),):
        rows = random_rows(n, seed, kinds)
        random.Random(seed).shuffle(rows)
        assert got(spark, rows) == loop(rows)


def test_a_hot_domain_of_many_numbers(spark):
    """Nine firms of one domain stay nine, and each row without a number joins the first."""
    row = lambda i, number: (f"r{i}", i, False, 1, number, "hot.jp", None, f"firm{i}", None, None)
    rows = [row(i, f"n{i % 9}" if i % 2 else None) for i in range(50)]
    found = got(spark, rows)
    assert found == loop(rows) and len({e for e, _ in found.values()}) == 9


def test_chains_of_answers_and_empty_tables(spark):
    """Each row is decided by the one before it, which takes a round for each."""
    rows = [(f"r{i}", i, False, 1, None, f"d{(i + 1) // 2}", f"p{i // 2}", f"name{i}", None, None) for i in range(8)]
    assert got(spark, rows) == loop(rows)
    assert got(spark, []) == {}


def test_keys_of_many_rows_are_spread(spark, monkeypatch):
    """Keys of more than HOT rows meet by blocks, others in tasks: the answers are the loop's."""
    spreads = []
    blocks = fold._met_by_blocks
    monkeypatch.setattr(fold, "HOT", 6)
    monkeypatch.setattr(fold, "_met_by_blocks", lambda *a: spreads.append(1) or blocks(*a))
    rows = random_rows(60, 5, 8)
    assert got(spark, rows) == loop(rows) and spreads


def test_rows_with_a_known_number_ask_nothing(spark, monkeypatch):
    """Of rows that share a number, the first one asks by its other keys only, whatever the number of rows and of names like theirs."""
    kept, save = {}, resolve.Saved.save
    monkeypatch.setattr(resolve.Saved, "save", lambda self, df, name: kept.update({name: save(self, df, name)}) or kept[name])
    rows = [(f"r{i}", i, i == 0, 1, "n1", "d", "p", f"company number {i:03d}", "a", "c") for i in range(40)]
    assert got(spark, rows) == loop(rows)
    assert kept["asks"].count() == 0


def test_register_keeps_numbers_apart(spark):
    companies = spark.createDataFrame([("c1", "1", "a.jp", "n", None)], "company_id string, corporate_number string, domain string, normalized_name string, address_key string")
    incoming = spark.createDataFrame([(1, "111", "b.jp", "x", None), (2, "222", "b.jp", "y", None), (3, None, "b.jp", "z", "adr"), (4, None, None, "x", "adr"), (5, "1", None, "q", None)], "id long, corporate_number string, domain string, normalized_name string, address_key string")
    rows = {r["id"]: (r["company_id"], r["reason"], r["status"]) for r in resolve.register(companies, incoming).collect()}
    assert rows == {1: ("1", None, "new"), 2: ("2", None, "new"), 3: ("1", "domain", "duplicate"), 4: ("1", "name_address", "duplicate"), 5: ("c1", "corporate_number", "duplicate")}


def test_places_are_the_order(spark):
    rows = [(x,) for x in random.Random(3).sample(range(10_000), 500)]
    found = resolve.placed(spark.createDataFrame(rows, "k long").repartition(7), "k").collect()
    assert [r["k"] for r in sorted(found, key=lambda r: r["place"])] == sorted(x for x, in rows) and sorted(r["place"] for r in found) == list(range(500))


def test_blocks_make_up_an_interval(spark):
    top = 5000
    cases = [(0, top + 1), (1, 2), (17, 4000), (255, 257), (16, 32), (4095, 4097)]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", fold._blocks_of_interval(F.col("a"), F.col("b"), top).alias("x"))
    for r in df.collect():
        held = sorted(p for s, b in r["x"] for p in range(s * b, s * b + s))
        assert held == list(range(r["a"], r["b"])) and len(r["x"]) < 100


def test_the_queries_over_customers_and_suppliers(spark, tmp_path):
    from firmgraph.plans import registry, resolution

    spark.createDataFrame([(i, f"Customer#{i // 2:09d}", i % 3) for i in range(1, 61)], "c_custkey long, c_name string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, f"Supplier#{i:09d}", i % 3) for i in range(1, 16)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = [tuple(r[c] for c in ("id", "place", "seed", "trust", "number", "domain", "phone", "name", "address", "city")) for r in resolution._firms(spark, str(tmp_path)).collect()]
    assert {r["id"]: (r["entity"], r["reason"]) for r in registry.QUERIES["resolved_in_order"](spark, str(tmp_path)).collect()} == loop(rows)
    flat = [(*r[:3], 2 if r[2] else 1, r[4], r[5], None, r[7], r[8], None) for r in rows]
    want = {int(i[1:]): (e[1:], why) for i, (e, why) in loop(flat, ("corporate_number", "domain", "name_address")).items() if i[0] == "c"}
    assert {r["id"]: (r["company_id"], r["reason"]) for r in registry.QUERIES["registered_customers"](spark, str(tmp_path)).collect()} == want
