"""Mixing: exponents, budgets and passes."""

import math
import random
from collections import Counter, defaultdict

from firmgraph.llm import mixing as mx


def rows():
    rng = random.Random(3)
    out, i = [], 0
    for source, n in (("big", 400), ("mid", 120), ("small", 40), (None, 25), ("empty", 5)):
        for _ in range(n):
            out.append((i, source, "" if source == "empty" else "tok " * rng.randint(1, 30), "x"))
            i += 1
    return out


SCHEMA = "doc_id long, source string, text string, epoch string"


def entropy(q):
    return -sum(x * math.log(x) for x in q)


def test_exponent_meets_the_targets(spark):
    counts = [5000, 900, 300, 80]
    totals = spark.createDataFrame([(c,) for c in counts], "tokens long")
    mixed = lambda x: [(c / sum(counts)) ** x / sum((d / sum(counts)) ** x for d in counts) for c in counts]
    x = mx.find_exponent(totals, sum(counts), 0.9, None)
    assert 0 <= entropy(mixed(x)) - 0.9 * math.log(4) < 1e-4
    y = mx.find_exponent(totals, sum(counts), 1.0, 2.0)
    repeats = max(q * sum(counts) / c for q, c in zip(mixed(y), counts))
    assert 2.0 - 1e-4 < repeats <= 2.0 + 1e-6
    assert mx.find_exponent(totals, sum(counts), 0.1, None) == 1.0
    assert mx.find_exponent(totals, 10 * sum(counts), 0.9, 2.0) == 1.0


def test_budgets_are_realised_in_passes(spark):
    data = rows()
    text = {r[0]: len(r[2].split()) for r in data}
    source = {r[0]: r[1] for r in data}
    got = mx.mix(spark.createDataFrame(data, SCHEMA).repartition(3), target_entropy=0.97, max_repeats=6.0, block_tokens=100)
    assert got.columns == ["doc_id", "source", "text", *mx.RESULTS]
    got = got.collect()
    used, own, times = Counter(), Counter(), defaultdict(Counter)
    for d, n in text.items():
        own[source[d]] += n
    for r in got:
        assert r["tokens"] == text[r["doc_id"]] and 0 <= r["slot"] <= 1
        used[r["source"]] += r["tokens"]
        times[r["source"]][r["doc_id"]] += 1
        assert r["epoch"] < 7
    assert "empty" not in used
    total = sum(own.values())
    assert 0.98 * total < sum(used.values()) <= total
    q = [n / sum(used.values()) for n in used.values()]
    assert abs(entropy(q) / math.log(4) - 0.97) < 0.01
    for s, by in times.items():
        assert max(by.values()) - min([*by.values(), 0 if len(by) < sum(1 for d in text if source[d] == s) else 99]) <= 1
    again = mx.mix(spark.createDataFrame(data, SCHEMA).repartition(5), target_entropy=0.97, max_repeats=6.0, block_tokens=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert mx.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mx.mix(spark.createDataFrame([(1, "a", None, "x")], SCHEMA)).count() == 0


def brute_mix(docs, hashes, places, target, most, block_tokens, found):
    """doc_id, epoch of every use, by plain bisection and plain loops; hashes by doc_id, and places by (source, block, pass), as the operator has them.

    The operator's exponent must be as near to the bisected one as its sections are; it then gives the budgets, as a token more or less may decide on a document.
    """
    own = Counter()
    for _, source, text in docs:
        own[source] += len((text or "").split())
    own = {s: n for s, n in own.items() if n}
    total = sum(own.values())
    mixed = lambda x: {s: (n / total) ** x / sum((m / total) ** x for m in own.values()) for s, n in own.items()}
    repeats = lambda x: max(q * total / own[s] for s, q in mixed(x).items())
    x = 1.0
    if entropy(mixed(1.0).values()) < target * math.log(len(own)):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mixed(mid).values()) >= target * math.log(len(own)) else (low, mid)
        x = low
    if repeats(x) > most:
        low, high = x, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if repeats(mid) > most else (low, mid)
        x = high
    assert abs(x - found) < 1e-6
    x = found
    out = []
    for source, n in own.items():
        budget = math.floor(round(mixed(x)[source] * total, 6))
        passes, rest = divmod(budget, n)
        blocks = defaultdict(list)
        for d, s, text in docs:
            if s == source:
                blocks[hashes[d] % -(-n // block_tokens)].append((hashes[d], d, len((text or "").split())))
                out += [(d, e) for e in range(passes)]
        for _, block in sorted((places[source, b, passes], b) for b in blocks):
            size = sum(t for *_, t in blocks[block])
            if rest <= 0:
                break
            used = 0
            for _, d, t in sorted(blocks[block]):
                used += t
                if size <= rest or used <= rest:
                    out.append((d, passes))
            rest -= size
    return sorted(out)


def test_uses_match_brute_force(spark):
    from pyspark.sql import functions as F

    docs = [r[:3] for r in rows()] + [(1000, "big", "tok " * 3000), (1001, "mid", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    hashes = {r["doc_id"]: r["__h"] for r in mx._sized(df, mx.SEED).collect()}
    keys = [(s, b, p) for s in ("big", "mid", "small", None) for b in range(200) for p in range(8)]
    asked = spark.createDataFrame([(i, mx_key(s), b, p) for i, (s, b, p) in enumerate(keys)], "i int, k string, b long, p long")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(mx.SEED), "k", "b", "p"), 11)
    places = {keys[r["i"]]: r["v"] for r in asked.select("i", place.alias("v")).collect()}
    for target, most in ((0.97, 6.0), (1.0, 2.0), (0.5, 4.0)):
        got = mx.mix(df.repartition(3), target_entropy=target, max_repeats=most, block_tokens=100).collect()
        totals = mx._sized(df, mx.SEED).groupBy("__key").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
        found = mx.find_exponent(totals, float(totals.agg(F.sum("tokens")).first()[0]), target, most)
        assert sorted((r["doc_id"], r["epoch"]) for r in got) == brute_mix(docs, hashes, places, target, most, 100, found)


def mx_key(source):
    return "n" if source is None else f"s{source}"
