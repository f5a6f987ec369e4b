"""Near-duplicate classes against all pairs compared in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from firmgraph.llm import near_dedup as nd
from firmgraph.llm.shingles import probability_jaccard, shingle_hashes, weighted


def bag(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_jp(a, b):
    both = a.keys() | b.keys()
    return sum(1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in both) for d in a.keys() & b.keys())


def brute_classes(rows):
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or '') == (rows[j][1] or '') or (bags[i].keys() & bags[j].keys() and brute_jp(bags[i], bags[j]) >= 0.8):
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    return {i: root(i) for i in ids}


def fixture():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = ["", None, "", "...", "one two", "One, two!", "one two three"]
    for n in (40, 120):
        for _ in range(6):
            base = text(n)
            rows.append(" ".join(base))
            for _ in range(5):
                base = list(base)  # a chain: each differs from the last one
                base[rng.randrange(n)] = rng.choice(vocab)
                rows.append(" ".join(base))
    hot = text(80)
    for _ in range(50):
        x = list(hot)
        x[rng.randrange(80)] = rng.choice(vocab)
        rows.append(" ".join(x))
    common = text(30)
    rows += [" ".join(text(25) + common + text(25)) for _ in range(30)]
    rows += [rows[20]] * 10 + [" ".join(text(20)) for _ in range(20)]
    rng.shuffle(rows)
    return [(i + 1, t) for i, t in enumerate(rows)]


def test_classes_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(df).collect()}
    assert got == brute_classes(rows)
    kept = sorted(r["doc_id"] for r in nd.near_dedup(df).collect())
    assert kept == sorted(set(got.values()))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, a int")
    assert nd.near_classes(empty).count() == 0
    df = spark.createDataFrame([(None, "x y", 1), (None, "x y", 2), (3, "x y", 3), (3, "x y", 4)], "doc_id long, text string, class_id int")
    got = [tuple(r) for r in nd.near_classes(df).select("doc_id", "class_id", "kept").collect()]
    assert sorted(got, key=str) == [(3, 3, True)] * 2 + [(None, None, True)] * 2
    assert nd.near_dedup(df).columns == ["doc_id", "text", "class_id"]


def test_texts_of_one_document_are_judged_apart(spark):
    rng = random.Random(3)
    a = [f"a{rng.randrange(10**6)}" for _ in range(60)]
    near = [*a[:30], "changed", *a[31:]]
    b, long = "quite another text with words of its own", " ".join(f"l{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, " ".join(a)), (3, " ".join(a)), (3, b), (4, " ".join(near)), (5, b), (6, long), (7, long + " end"), (None, b)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, (3, b)]], "doc_id long, text string, k1 string")
    kept = sorted(((r["doc_id"], r["text"]) for r in nd.near_dedup(df).collect()), key=str)
    assert kept == sorted([(1, rows[0][1]), (3, b), (3, b), (6, long), (None, b)], key=str)
    got = {(r["doc_id"], r["text_id"]): r for r in nd.near_classes(df).collect()}
    assert got[4, 4]["link_id"] == 1 and 0.8 <= got[4, 4]["similarity"] < 1 and got[4, 4]["class_id"] == 1
    assert got[7, 7]["link_id"] == 6 and got[3, 3]["link_id"] is None and got[5, 3]["class_id"] == 3


def test_links_are_true_and_connect_the_classes(spark):
    rows = fixture()
    bags = {d: bag(t) for d, t in rows}
    for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r["link_id"] is not None:
            assert abs(brute_jp(bags[r["text_id"]], bags[r["link_id"]]) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
        else:
            assert r["text_id"] == r["class_id"]


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, 40).astype(float), rng.integers(0, 4, 40).astype(float)
        ca, cb = (Counter({i: x for i, x in enumerate(v) if x}) for v in (a, b))
        assert abs(probability_jaccard(a, b) - brute_jp(ca, cb)) < 1e-12
    h = rng.integers(1, 2**62, 60).astype(np.uint64)
    w = rng.integers(1, 5, (2, 60)).astype(float)
    w[0, :10] = 0
    m = 20_000
    sig = [nd.prob_minhash(h[x > 0], np.zeros((x > 0).sum(), np.int64), x[x > 0], 1, m)[0] for x in w]
    assert abs((sig[0] == sig[1]).mean() - probability_jaccard(*w)) < 0.015


def test_short_and_empty_sequences():
    h, d = shingle_hashes(np.arange(11), np.array([0, 3, 0, 6, 2]))
    assert list(d) == [1, 3, 3, 4]
    assert len(weighted(h, d)[0]) == 4


def test_dense_groups_around_the_threshold(spark):
    """Stragglers of a group of near-copies and texts with a repeated phrase, of which many pairs lie just below the threshold."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(500)]
    hot = [rng.choice(vocab) for _ in range(100)]
    texts = []
    for k in range(60):
        x = list(hot)
        for _ in range(1 + k % 4):
            x[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(x))
    for k in range(40):
        texts.append(" ".join([rng.choice(vocab) for _ in range(8 + k % 20)] + ["round", "and"] * (40 + k)))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), pivots=1).collect()}
    assert got == brute_classes(rows)
    assert 5 < len(set(got.values())) < 60


def test_the_last_pairs_take_one_round(spark, monkeypatch):
    """Rounds of a few rows took hundreds of shuffles; the result is that of rounds to the end."""
    saved, save = [], nd.Workspace.save
    monkeypatch.setattr(nd.Workspace, "save", lambda self, df, name, *a: saved.append(name) or save(self, df, name, *a))
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lambda: {r["doc_id"]: r["class_id"] for r in nd.near_classes(df).collect()}
    assert classes() == brute_classes(rows)
    assert "pairs2" in saved and "pairs3" not in saved and "left1" not in saved and not any(t.endswith("-ids") for t in saved)
    monkeypatch.setattr(nd, "LAST", 0)
    assert classes() == brute_classes(rows)
    assert "heads3" in saved


def test_components_of_sent_and_of_shuffled_labels_are_the_same(spark):
    from firmgraph.operators.resolve import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i % 7] + [(40, 30), (30, 40), (5, 5), (3, 50)], "a long, b long")
    both = [sorted(map(tuple, connected_components(edges, n).collect())) for n in (0, 100)]
    assert both[0] == both[1] and {b for _, b in both[0]} == {1, 8, 15, 30}
