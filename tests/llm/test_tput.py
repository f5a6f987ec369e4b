"""Ranked search against a brute force over whole texts."""

import math
import random
import re
from collections import Counter

import pytest

from firmgraph.llm import tput

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    return re.findall(tput.TERMS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(split(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            score = 0
            for t in set(split(text)) & bag.keys():
                m = 50 + 50 * sum(bag.values()) * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k):
    return sorted((tuple(r) for r in tput.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k).collect()), key=str)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ähre", "é", "日本。語", "A-B"]
    some = lambda n: " ".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(n))
    docs = [(i, some(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(130)] + [(1200, some(60_000))]  # a third are one text; one is very long
    items = [(i, some(rng.randint(1, 40))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("k", [3, 50])
def test_equals_brute_force(spark, k):
    docs, items = corpus()
    assert got(spark, docs, items, k) == brute(docs, items, k)


def test_a_large_vocabulary_stays_out_of_tasks(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(tput, "VOCABULARY", 10)
    assert got(spark, docs, items, 10) == brute(docs, items, 10)


def test_defined_results(spark):
    docs = [(1, "Fox den"), (1, "Fox den"), (None, "fox DEN"), (2, None), (3, ""), (4, "fox_fox"), (5, "FÖX   x"), (6, "...")]
    items = [(1, "den, FOX fox"), (1, "den, FOX fox"), (2, None), (3, ""), (None, "föx"), (5, "absent")]
    # at most one of the equal documents without an id or with the same one can be told from another by the result
    want = brute(docs, items, 50)
    assert got(spark, docs, items, 50) == want and len(want) > 6
    assert got(spark, [], items, 5) == [] and got(spark, docs, [], 5) == [] and got(spark, [(1, None)], items, 5) == []
    d = spark.createDataFrame([(1, "a b", 7, "t")], "doc_id int, text string, score int, term string")
    i = spark.createDataFrame([(9, "b", 3)], "item_id int, text string, doc_id int")
    assert [tuple(r) for r in tput.ranked(d, i).collect()] == [(9, 1, 1, 287 * (10**9 // 3000))]


def test_lists_are_cut_by_the_threshold(spark):
    """What a frequent term adds is below the threshold, so its list is read for candidates only."""
    docs = [(i, "common " * (1 + i % 3) + (f"rare{i % 40} " * 4 if i % 5 == 0 else "")) for i in range(600)]
    items = [(1, "common rare0 rare5 rare10")]
    assert got(spark, docs, items, 5) == brute(docs, items, 5)
