"""Commits of several tables that appear together or not at all, and what promotion and retraction change."""

import pytest
from pyspark.sql import functions as F

from firmgraph.operators import promotion
from firmgraph.operators.snapshots import Snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_commit_appears_whole_or_not(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "tables"), buckets=8)
    people = lambda x: spark.createDataFrame(x, "company long, name string")
    jobs = lambda x: spark.createDataFrame(x, "company long, state string")
    assert store.manifest() == (0, {})
    assert store.commit({"people": ("company", people([(i, f"p{i}") for i in range(40)] + [(None, "x")]), None), "jobs": ("company", jobs([(i, "new") for i in range(40)]), None)}) == 1
    before = rows(store.read("people")), rows(store.read("jobs"))
    broken = jobs([(i, "done") for i in range(10)]).withColumn("state", F.when(F.col("company") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("state")))
    with pytest.raises(Exception, match="lost"):
        store.commit({"people": ("company", people([(3, "new")]), None), "jobs": ("company", broken, None)})
    assert (rows(store.read("people")), rows(store.read("jobs"))) == before and store.manifest()[0] == 1
    # a parent's children are replaced, one loses all of its own, the others stay
    store.commit({"people": ("company", people([(3, "a"), (3, "b"), (None, "y")]), people([(5, "")]).select("company")), "jobs": ("company", jobs([(3, "done")]), None)})
    assert rows(store.read("people")) == sorted([(i, f"p{i}") for i in range(40) if i not in (3, 5)] + [(3, "a"), (3, "b"), (None, "y")], key=str)
    assert rows(store.read("jobs")) == sorted([(i, "done" if i == 3 else "new") for i in range(40)], key=str)
    old, new = (json_of(store, n) for n in (1, 2))
    untouched = [b for b in old["people"]["buckets"] if old["people"]["buckets"][b] == new["people"]["buckets"].get(b)]
    assert len(untouched) >= 5  # only the buckets of three parents were written anew


def json_of(store, number):
    import json

    with open(f"{store.folder}/manifests/{number:012d}.json") as f:
        return json.load(f)


def test_two_writers_do_not_take_one_number(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "t"), buckets=2)
    store.commit({"a": ("k", spark.createDataFrame([(1,)], "k long"), None)})
    with pytest.raises(RuntimeError, match="another"):
        store._write(1, "{}")


def test_backfill_and_promotion(spark):
    companies = spark.createDataFrame([("c1", None, "a.jp"), ("c2", "9", None)], "company_id string, number string, domain string")
    registered = spark.createDataFrame([(1, "c1", "duplicate"), (2, "c1", "duplicate"), (3, "c2", "duplicate"), (4, "4", "new")], "id long, company_id string, status string")
    incoming = spark.createDataFrame([(1, None, "z.jp"), (2, "7", "y.jp"), (3, "8", "b.jp"), (4, "5", "c.jp")], "id long, number string, domain string")
    assert rows(promotion.backfilled(companies, registered, incoming, ["number", "domain"])) == [("c1", "7", "a.jp"), ("c2", "9", "b.jp")]
    assert {(r["id"], r["company_id"], r["created"]) for r in promotion.promoted(incoming, registered).collect()} == {(1, "c1", False), (2, "c1", False), (3, "c2", False), (4, "4", True)}
    found = spark.createDataFrame([("a", "u", "no"), ("b", "u", "yes"), ("c", None, "yes"), ("d", "u", None), ("b", "u", "yes"), ("e", "u", "yes")], "company_id string, website string, recruiting_signal string")
    known = spark.createDataFrame([("e",)], "company_id string")
    assert rows(promotion.crawls(found, True, known)) == [("b",), ("d",)] and rows(promotion.crawls(found, False, known)) == [("a",), ("b",), ("d",)]
