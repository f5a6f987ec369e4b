"""Raw observations and sums in an order."""

import json
import random

from pyspark.sql import functions as F

from firmgraph.operators import observations, planning


def test_paths_fall_back_and_unreadable_rows_stay(spark):
    raw = [(1, '{"name": "a", "place": {"city": "x"}, "observed": {"k": 5}, "tags": ["p", "q"]}'), (2, '{"company": {"name": "b"}, "city": "y", "employees": 7}'), (3, '{"title": "c", "observed": {"k": "many"}}'), (4, "{"), (5, None), (6, "[]")]
    df = spark.createDataFrame(raw, "id long, raw string")
    got = {r["id"]: tuple(r)[1:] for r in observations.merged_rows(df, "id", "raw").collect()}
    assert got == {1: ("a", "x", 5, "q", True), 2: ("b", "y", 7, None, True), 3: ("c", None, None, None, True), 4: (None,) * 4 + (False,), 5: (None,) * 4 + (False,), 6: (None,) * 4 + (True,)}
    again = {r["id"]: json.loads(r["json"]) for r in observations.rebuilt(observations.merged_rows(df, "id", "raw"), "id", ["name", "employees"]).collect()}
    assert again[1] == {"name": "a", "employees": 5} and again[3] == {"name": "c"} and again[4] == {}
    assert "observed" in observations.shape(df.filter("id < 4"), "raw")


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(-3, 9)])) for i in range(400)]
    total, want = 0, {}
    for i, c in rows:
        total += c or 0
        want[i] = total
    df = spark.createDataFrame(rows, "i long, c long").repartition(9, F.hash("i"))
    got = {r["i"]: r["running"] for r in planning.running_sums(df, ["i"], "c").collect()}
    assert got == want
    assert {r["i"] for r in planning.within_budget(df, ["i"], "c", 50, used=10).collect()} == {i for i, t in want.items() if t + 10 <= 50}
    assert planning.running_sums(df.limit(0), ["i"], "c").collect() == []
