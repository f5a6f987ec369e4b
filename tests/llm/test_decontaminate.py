"""Decontamination against a scan of all windows in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from firmgraph.llm import decontaminate as dc


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w, k):
    return Counter([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def similarity(a, b):
    both = a.keys() | b.keys()
    return sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both)


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = toks(text)
        for t, item in items:
            x = toks(item)
            if not w or not x:
                continue
            k = min(5, len(x))
            n = min(len(x), len(w))
            best = max(similarity(bag(w[i : i + n], k), bag(x, k)) for i in range(len(w) - n + 1))
            if best >= 0.8:
                out[d, t] = round(best, 9)
    return out


def fixture():
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(300)] + ["the", "of", "and", "in", "to"] * 40
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(12, 60)))) for i in range(30)] + [(40, "Alpha beta"), (41, ""), (42, None), (43, " ".join(["ha"] * 20))]
    items.append((44, items[3][1]))
    docs = [(0, None), (1, ""), (2, "alpha"), (3, "so alpha, BETA it is"), (4, "ha " * 400)]
    for i in range(5, 90):
        w = text(rng.randint(0, 120))
        x = toks(rng.choice(items[:30])[1])
        kind = i % 6
        if kind == 1:
            w[len(w) // 2 : len(w) // 2] = x
        elif kind == 2:
            x[rng.randrange(len(x))] = "changed"
            w += x
        elif kind == 3:
            del x[rng.randrange(len(x))]
            w = x + w
        elif kind == 4:
            w = x[: len(x) // 2] + w
        elif kind == 5:
            w = x[1:-1]
        docs.append((i, ". ".join(w)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, m string")
    got = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == want
    left = dc.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "m"]
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs[:30], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dc.item_blocks(bench, 10))) == 4
    assert dc.contaminated(df, bench.limit(0)).count() == 0
    assert dc.decontaminate(df, bench.limit(0)).count() == 30
    assert dc.contaminated(df.limit(0), bench).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 1 << 60, 20) for _ in range(200)]
    index = dc.Index(list(range(200)), words)
    query = index.prints[rng.integers(0, 200, 500)].copy()
    for i in range(len(query)):
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            query[i] ^= np.uint64(1 << int(b))
    q, t, d = index.within(query)
    far = np.bitwise_count(query[:, None] ^ index.prints[None])
    assert {(int(a), int(b)) for a, b in zip(q, t)} == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= dc.RADIUS))}
    assert (d == far[q, t]).all()


def recall(items, edit, rng, times):
    """The share of windows with similarity of 0.8 or more by brute force that are found, and their number."""
    found = true = 0
    for _ in range(times):
        t = rng.randrange(len(items))
        w = edit(list(items[t]))
        k = min(5, len(items[t]))
        n = min(len(items[t]), len(w))
        if max(similarity(bag(w[i : i + n], k), bag(items[t], k)) for i in range(len(w) - n + 1)) < 0.8:
            continue
        true += 1
        index = dc.Index([t], [np.array(items[t])])
        found += bool(index.find(np.array(w), np.array([len(w)])))
    return found / true, true


def test_recall_of_edited_passages():
    rng = random.Random(7)
    word = lambda: rng.getrandbits(60)
    items = [[word() for _ in range(rng.randint(14, 80))] for _ in range(200)]

    def edit(w):
        kind = rng.randrange(3)
        if kind == 0:  # another last word, or other words at an edge
            n = rng.randint(1, max(1, len(w) // 12))
            w[-n:] = [word() for _ in range(n)]
        elif kind == 1:  # cut short
            w = w[rng.randint(0, len(w) // 10) :]
        else:
            w[rng.randrange(len(w))] = word()
        return [word() for _ in range(30)] + w + [word() for _ in range(30)]

    share, n = recall(items, edit, rng, 1500)
    assert n > 500 and share >= 0.995


def test_long_items_take_linear_work():
    import time

    rng = np.random.default_rng(1)
    item = rng.integers(0, 1 << 60, 20_000)
    doc = np.concatenate([rng.integers(0, 1 << 60, 5000), item[:9000], [1, 2, 3], item[9003:], rng.integers(0, 1 << 60, 5000)])
    index = dc.Index([5], [item])
    began = time.time()
    found = index.find(doc, np.array([len(doc)]))
    assert time.time() - began < 5
    assert [(m["item_id"], m["start_word"], m["n_words"]) for m in found[0]] == [(5, 5000, 20_000)] and found[0][0]["similarity"] > 0.99


def test_repeated_rows_and_long_texts(spark):
    docs, items = fixture()
    passage = items[5][1]
    rows = [(1, passage), (1, passage), (None, passage), (2, "filler word " * 100_000 + passage + " filler word" * 100_000)]
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["start_word"]) for r in got) == [("1", 5, 0), ("1", 5, 0), ("2", 5, 200_000), ("None", 5, 0)]


def test_blocks_follow_one_another(spark):
    """Many small blocks find and reject what one block does, and hand on only what is left."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(30)]
    docs = [(d, " ".join(word() for _ in range(30)) + " " + (items[d][1] + " " + items[(d + 7) % 30][1] if d < 30 else "") + " " + word()) for d in range(45)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect())
    assert whole == sorted({(d, i) for d in range(30) for i in (d, (d + 7) % 30)})
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench, items_per_block=7).collect()) == whole
    assert sorted(r["doc_id"] for r in dc.decontaminate(df, bench, items_per_block=7).collect()) == list(range(30, 45))
