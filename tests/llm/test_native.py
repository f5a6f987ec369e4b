"""Exact dedup and the licence scan, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from firmgraph.llm.exact_dedup import exact_dedup, fingerprint, group_report
from firmgraph.llm import license_scan as ls
from firmgraph.llm.license_scan import BASE, OWN, license_scan

SCHEMA = "doc_id long, text string, hits string, name int"


def brute_groups(rows):
    by = defaultdict(list)
    for doc_id, text, *_ in rows:
        by[text or ""].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = [i for i in by[text or ""] if i is not None]
        keep = max(ids) if ids else None
        out.append((doc_id, keep, len(by[text or ""]), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    texts = ["", None, "a", "é" * 9, "x" * 64, "x" * 65, "ab" * 500, "ab" * 499 + "ba"]
    texts += ["".join(rng.choice("abü") for _ in range(rng.choice([3, 16, 17, 200]))) for _ in range(40)]
    rows = [(i, rng.choice(texts), "h", 1) for i in range(200)]
    return rows + [(7, "ab" * 500, "h", 1), (7, "ab" * 500, "h", 1), (None, "a", "h", 1), (None, "only", "h", 1)]


def test_groups_match_brute_force(spark):
    rows = sample()
    for size in (8, 16):
        got = group_report(spark.createDataFrame(rows, SCHEMA), block_bytes=size)
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute_groups(rows)


def test_colliding_fingerprints_are_noticed(spark):
    rows = sample()
    seen = []

    def weak(block, seed):
        seen.append(seed)
        return (F.length(block).cast("long"), F.lit(0).cast("long")) if seed < 2 else fingerprint(block, seed)

    got = group_report(spark.createDataFrame(rows, SCHEMA), block_bytes=16, prints=weak)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_groups(rows)
    assert seen == [0, 1, 2]


def test_filter_keeps_one_of_each_text(spark):
    rows = sample()
    kept = exact_dedup(spark.createDataFrame(rows, SCHEMA), block_bytes=16)
    assert kept.columns == ["doc_id", "text", "hits", "name"]
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert len({t for _, t in got}) == len(got) == len({t or "" for _, t, *_ in rows})
    assert {(k, t) for k, t in got} == {(b, t) for (b, t) in {(x[1], (r[1] or "")) for r in rows for x in brute_groups(rows) if x[0] == r[0] and x[4] == hashlib.sha256((r[1] or "").encode()).hexdigest()}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert group_report(empty).count() == 0
    assert exact_dedup(empty).count() == 0
    assert license_scan(empty).count() == 0


def brute_licence(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for t in BASE:
        key = t.key.split()
        at = [i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]
        places += at
        if at:
            labels.add(t.label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_licence_places_match_brute_force(spark):
    rng = random.Random(5)
    bits = ["Apache License", "MIT License.", "CC BY-NC 4.0", "cc", "by", "GNU", "general public license", "gnu General\nPublic LICENSE", "the mit", "license", "ünd", "0", "x" * 50, "version 2.0"]
    texts = [None, "", "MIT License", "mit license mit license", "a " * 5000 + "MIT License " * 300] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    df = spark.createDataFrame([(i % 9 or None, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, hits string, score int")
    got = license_scan(df.coalesce(1)).collect()
    key = lambda r: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert sorted(map(key, got), key=str) == sorted(map(brute_licence, texts), key=str)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert {r["hits"] for r in got} == {"z"}


def test_licence_score_and_own_labels(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "a gnu general public license", "Redistribution and use in source and binary forms, with or without modification, are permitted", "nothing here"]
    got = license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["score"] == 1.0 > got[1]["score"] > got[3]["score"] == 0.0
    assert got[2]["labels"] == "bsd-text" and got[2]["base_labels"] == ""


def split(text):
    return re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_labels(texts):
    """Labels and scores of all texts, by plain loops."""
    import math

    files = [split(t) for t in texts]
    vocabulary = ls.template_words(BASE + OWN)
    idf = {w: math.log((len(files) + 1) / (sum(w in f for f in files) + 1)) for w in vocabulary}
    out = []
    for f in files:
        labels, best = set(), 0.0
        for t in BASE + OWN:
            key, body = t.key.split(), t.words
            rare = [w for w in sorted(set(body), key=lambda w: (-idf[w], w)) if w in f][: ls.RARE]
            near = lambda s, q, slack: any(0 <= s - t.lead + q + d < len(f) and f[s - t.lead + q + d] == body[q] for d in range(-slack, slack + 1))  # noqa: B023, E731
            for s in range(len(f) - len(key) + 1):
                if f[s : s + len(key)] != key:
                    continue
                votes = sum(body[q] in rare and near(s, q, ls.SLACK) for q in range(len(body)))
                total = sum(idf[w] + 0.01 for w in body)
                share = sum(idf[w] + 0.01 for q, w in enumerate(body) if near(s, q, ls.SLACK if t.whole else 0)) / total
                if not t.whole or votes >= min(ls.VOTES, len(body)) and share >= ls.LEAST_SHARE:
                    labels.add(t.label)
                    best = max(best, share)
        out.append((",".join(sorted(labels)), best))
    return out


def test_labels_and_scores_match_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "prose of no licence"]
    for t in [t for t in OWN if t.whole]:
        w = t.words
        texts.append(" ".join(w))
        for changed in (1, 5, len(w) // 2):
            x = list(w)
            for _ in range(changed):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([["altered"], [], ["two", "words"]])
            texts.append("Before it. " + ", ".join(x).upper() + " after " * 40)
    texts += [" ".join(rng.sample(ls.template_words(BASE + OWN), 40)) + " MIT License, CC BY-NC" for _ in range(20)] + ["the of and " * 60_000 + texts[3]]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).orderBy("doc_id").collect()
    want = brute_labels(texts)
    assert [r["labels"] for r in got] == [x for x, _ in want]
    assert all(abs(r["score"] - y) < 1e-5 for r, (_, y) in zip(got, want))


def test_altered_word_of_a_licence_is_tolerated(spark):
    mit = next(t for t in OWN if t.label == "mit-text" and t.whole).words
    texts = [" ".join([*mit[:at], "altered", *mit[at + 1 :]]) for at in (12, 40, 90)]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["labels"] for r in got] == ["mit-text"] * 3
