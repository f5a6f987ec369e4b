"""Stupid backoff against counts in dictionaries."""

import math
import random
import re
from collections import Counter

import pytest

from firmgraph.llm import ngram_lm as lm

WORDS = re.compile(r"[^\W_]+")


def brute(rows, corpus=None, order=3, alpha=0.4):
    split = lambda ts: [WORDS.findall((t or "").lower()) for t in ts]
    toks, known = split(t for _, t in rows), split(t for _, t in rows) if corpus is None else split(corpus)
    c = [Counter(tuple(w[i : i + n]) for w in known for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = max(1, sum(map(len, known)))

    def score(gram):
        if len(gram) == 1:
            return max(1, c[0][gram]) / total
        if c[len(gram) - 1][gram]:
            return c[len(gram) - 1][gram] / c[len(gram) - 2][gram[:-1]]
        return alpha * score(gram[1:])

    return [(d, len(w), sum(math.log(score(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))) for (d, _), w in zip(rows, toks)]


def same(got, want):
    got = sorted(((r["doc_id"], r["n_words"], r["log_score"], r["mean_log"]) for r in got), key=str)
    want = sorted(((d, n, round(s, 6)) for d, n, s in want), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want):
        assert abs(a[2] - b[2]) < 2e-5 * max(1, abs(b[2]))
        assert a[3] is None if not a[1] else abs(a[3] - b[2] / b[1]) < 2e-5 * max(1, abs(a[3]))


def corpus():
    rng = random.Random(6)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(i, "one passage that a hundred documents share " * 2 + f"own{i}") for i in range(200, 300)]
    return rows + [(None, "w1 w2 w3"), (7, None), (8, ""), (9, "W1, w2"), (9, "W1, w2"), (10, "the " * 3000), (11, "w1"), (12, "alone"), (13, "w1 w2")]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("heavy", [True, False])
def test_scores_match_brute_force(spark, monkeypatch, order, heavy):
    rows = corpus()
    if heavy:
        monkeypatch.setattr(lm, "SAMPLE", 1)
        monkeypatch.setattr(lm, "HEAVY", 40)
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, rid string, n_words int, words string").repartition(3)
    same(lm.score_documents(docs, order).collect(), brute(rows, order=order))
    assert lm.score_documents(docs.limit(0), order).count() == 0


def test_frequent_ngrams_are_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 1)
    monkeypatch.setattr(lm, "HEAVY", 40)
    work = lm.Workspace(spark, "test")
    context, gram = lm.frequent(lm.told(spark.createDataFrame(corpus(), "doc_id long, text string"), work), 3, work)
    assert 0 < context.count() <= 40 and 0 < gram.count() <= 40


def test_very_long_text(spark):
    rng = random.Random(1)
    rows = [(0, " ".join(rng.choice("abcdefgh") for _ in range(200_000))), (1, "a b c")]
    same(lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


@pytest.mark.parametrize("order", [2, 3])
def test_other_corpus_backs_off(spark, order):
    rows = [*corpus(), (20, "w1 unheard w2 w3 of"), (21, "unheard")]
    known = [t for _, t in corpus()[:100]] + [None, ""]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    same(lm.score_against(frame(rows), frame([(i, t) for i, t in enumerate(known)]), order).collect(), brute(rows, known, order))
    same(lm.score_against(frame(rows), frame([]), order).collect(), brute(rows, [], order))
    assert lm.score_against(frame([]), frame(rows), order).count() == 0


def test_query_counts_ngrams_that_occur_once(spark, tmp_path):
    from firmgraph.llm import queries

    rows = [(0, "a b c d"), (1, "a b c e"), (2, "only here once"), (3, "f g"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["log_score"] for r in queries.QUERIES["op10_lm_scores"](spark, str(tmp_path)).collect()}
    assert all(abs(got[d] - s) < 1e-5 for d, _, s in brute(rows))
    assert abs(got[2] - math.log(1 / 13)) < 1e-5
