"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of a hashed word embedding and a hashed embedding of its first four letters, so that unseen
endings of known stems count. Filters of widths 1, 2 and 3 slide over the words of the whole text; the maximum of each
filter enters a logistic layer. The first two embedding dimensions start from the smoothed log-odds scores of the buckets
in the training rows, the others at random; all parameters are then trained by gradient descent.

Labels come only from rows whose crc32 of the doc_id (as text) is not 0 modulo 5. Of those, remainder 1 calibrates: scores
are mapped to probabilities, and each language gets the threshold with the best F1. A score depends on the text alone.

Documented bounds: the network is fitted on at most MAX_TOXIC toxic and MAX_CLEAN clean rows, the first by a hash of the
doc_id, and of these on the first whole texts with at most MAX_WORDS words of each label in all (as much in each of PARTS parts
of the sample), so that the driver's memory is bounded. All labelled rows of remainder 1 calibrate: their logits are counted by language in bins of 1 / BINS, and a
threshold lies between bins. A language (or null) with fewer than LEAST toxic or LEAST clean rows among all of them gets 0.5.
Scoring reads all rows and whole texts, in steps of about STEP_WORDS words.

Defined results: null and empty texts get the score of a text without words; a null doc_id counts as the empty text in the
remainder, which is 0, so such rows are held out; several labels of one doc_id count as toxic if one is; null labels are
ignored; without toxic labels every score is 0, without clean ones 1; repeated rows get equal
scores; an empty table gives an empty result; of clashing columns, the results replace those of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.llm.common import words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 6
MAX_TOXIC, MAX_CLEAN, MAX_WORDS = 2500, 4000, 2_000_000
BINS, LEAST, PARTS = 256, 10, 32
EPOCHS, BATCH, BATCH_WORDS, STEP_WORDS, PAD = 4, 64, 100_000, 200_000, max(WIDTHS) - 1
SHORT = 1 << 15  # buckets travel as 16-bit numbers from -SHORT
RESULTS = ("score", "predicted")


def with_buckets(docs: DataFrame) -> DataFrame:
    """Adds __words and __stems: the hash buckets, less SHORT, of each word and of its first four letters."""
    bucket = lambda h: (F.pmod(h, F.lit(BUCKETS)) - SHORT).cast("short")
    split = docs.withColumn("__split", words(F.col("text")))
    return split.select(*[F.col(f"`{c}`") for c in docs.columns], F.transform("__split", lambda w: bucket(F.xxhash64(w))).alias("__words"), F.transform("__split", lambda w: bucket(F.xxhash64(F.lit(7), F.substring(w, 1, 4)))).alias("__stems"))


@dataclass
class Flat:
    """Words of several texts after one another, each text followed by PAD empty places."""

    words: np.ndarray
    stems: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(words_values: np.ndarray, stems_values: np.ndarray, lengths: np.ndarray) -> Flat:
        ends = np.cumsum(lengths + PAD + 1)
        starts = ends - (lengths + PAD + 1)
        at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        w = np.full(int(ends[-1]) if len(ends) else 0, BUCKETS, np.int32)
        s = w.copy()
        w[at], s[at] = words_values, stems_values
        w[at] += SHORT
        s[at] += SHORT
        return Flat(w, s, starts, ends - PAD)


@dataclass
class Sample:
    """Labelled texts, as 16-bit buckets of their words after one another."""

    words: np.ndarray
    stems: np.ndarray
    offsets: np.ndarray
    toxic: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Sample:
        """The rows in the order of doc_id; of the same doc_id, in that of their buckets."""
        parts = [rows.column(c).combine_chunks() for c in ("__words", "__stems")]
        words, stems = ((p if isinstance(p, pa.Array) else pa.concat_arrays(p.chunks)).flatten().to_numpy() for p in parts)
        sizes = pa.compute.list_value_length(rows.column("__words")).to_numpy().astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        order = np.lexsort((sizes, rows.column("doc_id").to_numpy()))
        return Sample(words, stems, offsets, rows.column("__toxic").to_numpy().astype(np.float32)[order], order)

    def flat(self, rows: np.ndarray) -> Flat:
        cut = [(self.offsets[i], self.offsets[i + 1]) for i in self.order[rows]]
        take = lambda x: np.concatenate([x[a:b] for a, b in cut])
        return Flat.of(take(self.words), take(self.stems), np.array([b - a for a, b in cut]))

    def batches(self, rows: np.ndarray, most: int, most_words: int) -> Iterator[np.ndarray]:
        """Consecutive rows: at most `most`, with at most `most_words` words in all where there is more than one."""
        sizes = np.diff(self.offsets)[self.order[rows]]
        at = 0
        while at < len(rows):
            fit = int(np.searchsorted(np.cumsum(sizes[at : at + most]), most_words, "right"))
            to = at + max(1, fit)
            yield rows[at:to]
            at = to


class Model:
    """Parameters and the forward pass; `fit` trains them."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.stems = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.filters = {k: rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.filters[k][:, :2] = np.abs(self.filters[k][:, :2]) + 0.3
        self.bias = {k: np.full(FILTERS, -0.5, np.float32) for k in WIDTHS}
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.shift = np.float32(-1.0)
        self.scale = (1.0, 0.0)  # calibration of the logit
        self.constant: float | None = None
        self.thresholds: dict[str | None, float] = {}
        self.words[BUCKETS] = self.stems[BUCKETS] = 0

    def start_from(self, sample: Sample) -> None:
        """Set the first dimensions from how far a bucket's toxic documents exceed their expected number."""
        for table, dim in ((self.words, 0), (self.stems, 1)):
            n, own = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
            for rows in sample.batches(np.arange(len(sample.toxic)), len(sample.toxic), STEP_WORDS):
                flat = sample.flat(rows)
                doc = np.repeat(np.arange(len(rows)), np.diff(np.append(flat.starts, len(flat.words))))
                pairs = np.unique(doc * (BUCKETS + 1) + (flat.stems if dim else flat.words))
                bucket = pairs % (BUCKETS + 1)
                n += np.bincount(bucket, minlength=BUCKETS + 1)
                own += np.bincount(bucket, sample.toxic[rows][pairs // (BUCKETS + 1)], BUCKETS + 1)
            expected = n * sample.toxic.mean()
            table[:, dim] = 3 * np.tanh((own - expected) / np.sqrt(expected + 1) / 5)
            table[:, 1 - dim] = 0
            table[BUCKETS] = 0

    def vectors(self, flat: Flat) -> np.ndarray:
        return self.words[flat.words] + self.stems[flat.stems]

    def maps(self, x: np.ndarray, k: int) -> np.ndarray:
        y = x @ self.filters[k][0]
        for j in range(1, k):
            y[:-j] += (x @ self.filters[k][j])[j:]
        return y

    def pooled(self, flat: Flat) -> np.ndarray:
        """The maxima of all filters by text."""
        x = self.vectors(flat)
        bounds = np.stack([flat.starts, flat.ends], 1).ravel()
        if len(bounds) and bounds[-1] >= len(x):
            bounds = bounds[:-1]
        return np.concatenate([np.maximum.reduceat(self.maps(x, k), bounds, 0)[::2] + self.bias[k] for k in WIDTHS], 1)

    def logits(self, flat: Flat) -> np.ndarray:
        return np.maximum(self.pooled(flat), 0) @ self.out + self.shift

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -60, 60)))

    def scores(self, flat: Flat) -> np.ndarray:
        return self.calibrated(self.logits(flat).astype(np.float64))

    def step(self, flat: Flat, toxic: np.ndarray, rate: float) -> None:
        x = self.vectors(flat)
        best, top = {}, []
        for k in WIDTHS:
            y = self.maps(x, k)
            best[k] = np.stack([s + y[s:e].argmax(0) for s, e in zip(flat.starts, flat.ends)])
            top.append(np.take_along_axis(y, best[k], 0) + self.bias[k])
        z = np.concatenate(top, 1)
        held = np.maximum(z, 0)
        wrong = (1 / (1 + np.exp(-np.clip(held @ self.out + self.shift, -30, 30))) - toxic).astype(np.float32) / len(toxic)
        back = wrong[:, None] * self.out * (z > 0)
        self.out -= rate * (held.T @ wrong)
        self.shift -= rate * wrong.sum()
        for i, k in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            self.bias[k] -= rate * d.sum(0)
            for j in range(k):
                rows = best[k] + j
                moved = d[:, :, None] * self.filters[k][j].T[None]
                self.filters[k][j] -= rate * np.einsum("bf,bfd->df", d, x[rows])
                np.subtract.at(self.words, flat.words[rows], rate * moved)
                np.subtract.at(self.stems, flat.stems[rows], rate * moved)
        self.words[BUCKETS] = self.stems[BUCKETS] = 0


def chunks(w: pa.Array, s: pa.Array, step: int = STEP_WORDS) -> Iterator[Flat]:
    """Consecutive rows of two list columns with about `step` words in all."""
    offsets = w.offsets.to_numpy().astype(np.int64)
    wv, sv = w.values.to_numpy(zero_copy_only=False), s.values.to_numpy(zero_copy_only=False)
    stem_shift = s.offsets[0].as_py() - offsets[0]
    at = 0
    while at < len(w):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        a, b = offsets[at], offsets[to]
        yield Flat.of(wv[a:b], sv[a + stem_shift : b + stem_shift], np.diff(offsets[at : to + 1]))
        at = to


def best_threshold(low: np.ndarray, toxic: np.ndarray, high: np.ndarray | None = None, n: np.ndarray | None = None) -> float:
    """The threshold between bins of n rows, with scores from low to high, that gives the best F1; the middle of the gap, the one nearest 0.5 of equal ones."""
    high, n = low if high is None else high, np.ones(len(low)) if n is None else n
    order = np.argsort(-high, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.cumsum(n[order]) + toxic.sum())
    cuts = (low[order] + np.append(high[order][1:], 0)) / 2
    ends = np.append(high[order][1:] != low[order][:-1], True)
    good = np.flatnonzero(ends & (f1 >= f1[ends].max() - 1e-12))
    return float(cuts[good[np.argmin(np.abs(cuts[good] - 0.5))]])


def calibrate(model: Model, bins: pa.Table) -> None:
    """Map logits to probabilities by a logistic fit; then the thresholds of languages with LEAST rows of each label."""
    bins = bins.sort_by([("lang", "ascending"), ("bin", "ascending")])
    n, toxic, low, high = (bins.column(c).to_numpy().astype(np.float64) for c in ("n", "toxic", "low", "high"))
    if 0 < toxic.sum() < n.sum():
        z = (low + high) / 2
        a, b = 1.0, 0.0
        target = toxic * (toxic.sum() + 1) / (toxic.sum() + 2) + (n - toxic) / (n.sum() - toxic.sum() + 2)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = n * np.maximum(p * (1 - p), 1e-6)
            g = np.array([((n * p - target) * z).sum() + 1e-3 * (a - 1), (n * p - target).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            move = np.linalg.solve(h, g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        model.scale = (max(a, 0.1), b)
        low, high = model.calibrated(low), model.calibrated(high)
        langs = bins.column("lang").to_pylist()
        for lang in set(langs):
            own = np.array([x == lang for x in langs])
            if min(toxic[own].sum(), (n - toxic)[own].sum()) >= LEAST:
                model.thresholds[lang] = best_threshold(low[own], toxic[own], high[own], n[own])


def remainder(name: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, epochs: int = EPOCHS, max_words: int = MAX_WORDS) -> Model:
    """Train on bounded samples of the labelled rows outside the held-out fold, and calibrate on all of remainder 1."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).withColumn("__fold", remainder()).filter("__fold != 0")
    tried = known.filter("__fold = 1").select("doc_id", "__toxic")
    known = known.filter("__fold != 1").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id")
    part = lambda cond, n: known.filter(cond).limit(n)
    sample = part("__toxic = 1", max_toxic).unionAll(part("__toxic = 0", max_clean))
    # a bounded number of rows of two integers each
    rows = with_buckets(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    # windows over parts of the sample
    before = Window.partitionBy("__toxic", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(PARTS))).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("__words"))
    rows = rows.withColumn("__upto", F.sum(F.size("__words").cast("long")).over(before)).filter(F.col("__upto") <= max_words // PARTS)
    train = Sample.of(rows.select("doc_id", "__toxic", "__words", "__stems").toArrow())
    pa.default_memory_pool().release_unused()
    model, toxic = Model(), train.toxic
    if not len(toxic) or toxic.min() == toxic.max():
        model.constant = float(toxic.max()) if len(toxic) else 0.0
        return model
    model.start_from(train)
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        for own in train.batches(rng.permutation(len(toxic)), BATCH, BATCH_WORDS):
            model.step(train.flat(own), toxic[own], 0.3 / (1 + epoch))
    del train
    # scored before the join, which then moves no texts
    logits = _by_text(docs.select("doc_id", "text", "lang").filter(remainder() == 1), model, "logit", Model.logits).select("doc_id", "lang", "logit")
    bins = logits.join(tried, "doc_id").groupBy("lang", F.floor(F.col("logit") * BINS).alias("bin"))
    calibrate(model, bins.agg(F.count("*").alias("n"), F.sum("__toxic").alias("toxic"), F.min("logit").alias("low"), F.max("logit").alias("high")).toArrow())
    return model


def _by_text(docs: DataFrame, model: Model, name: str, of: Callable[[Model, Flat], np.ndarray]) -> DataFrame:
    """docs with a number that the model gives each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(words: pa.Array, stems: pa.Array) -> pa.Array:
        own = shared.value
        if own.constant is not None:
            return pa.array(np.full(len(words), own.constant))
        found = [of(own, flat).astype(np.float64) for flat in chunks(words, stems)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return with_buckets(docs).withColumn(name, run("__words", "__stems")).drop("__words", "__stems")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with score (0 to 1) and predicted (score >= 0.5)."""
    kept = [c for c in docs.columns if c not in RESULTS]
    scored = _by_text(docs.select(*[F.col(f"`{c}`") for c in kept]), model, "score", Model.scores)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def threshold_of(model: Model, lang: str = "lang"):
    """The threshold of a row's language, 0.5 where there was too little to calibrate."""
    out = F.lit(0.5)
    for name, value in sorted(model.thresholds.items(), key=str):
        out = F.when(F.col(lang).eqNullSafe(F.lit(name)), F.lit(value)).otherwise(out)
    return out
