"""Near-duplicate classes by ProbMinHash, banding and verification.

Texts are bags of 5-word shingles weighted by their counts. The shingles of a text arrive in Poisson processes whose rates
are their weights; each arrival picks one of REGISTERS registers, which keeps its earliest shingle. A text is done when no
further arrival can come before the latest register, so most shingles are drawn once or not at all again. Equal registers
estimate the probability Jaccard similarity J_P. Texts that agree in all ROWS registers of one of BANDS bands share a bucket
(at J_P = 0.8 a pair shares no bucket with a probability of 5e-5).

Buckets are not expanded into pairs. A round compares the texts of each bucket with its pivots, which come first in a global
random order, unless both are in one component already; then the components are formed anew, the pivots leave, and buckets
with a single component are done. The first round takes a few bands, which connects large groups of near-copies by few
pairs; the second takes all bands. What is then still left lies in dense buckets of texts that are mostly not similar, such
as those that share a common passage. For these, buckets are formed by their rarest shingles, where similar texts must meet
and a common passage does not count, and rounds go on, with eight times as many pivots each, until no bucket has two
components; the last round compares all that is left, once the buckets hold at most LAST pairs. There a text's place in a bucket tells how much of it is not shared by rarer shingles, which bounds J_P from
above: pivots come by that share, and texts that cannot reach the threshold with any text left in the bucket leave it.
So every pair of a shared bucket is compared, connected already, or too far apart by that bound.
Candidates are first compared by signature, at a bound of five standard deviations below the threshold, and then exactly by
J_P of their whole texts. Classes are the connected components.

Texts with the same words are one text throughout, so copies cost a row each.

Defined results: texts are compared by their lower-cased words (letters and digits); with fewer than five words, the whole
is one shingle; texts without words (null and empty ones too) are near-duplicates of their exact copies only; a very long text
is compared whole like any other; rows with one doc_id and different texts are in the classes of their texts, each by itself;
rows that repeat doc_id and text stay or go together; rows without doc_id are returned with a null class_id and kept; class_id
is the least doc_id of the class, and its row with the least text key among those stays; an empty table gives an empty result;
other columns pass through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.llm.common import Workspace, broadcast_if_small, word_hashes
from firmgraph.llm.shingles import mix, probability_jaccard, shingle_hashes, union_weights, weighted
from firmgraph.operators.resolve import connected_components

ROWS, BANDS, PIVOTS, FIRST_BANDS, SPLIT, LAST = 5, 25, 2, 5, 64, 1 << 16
REGISTERS = ROWS * BANDS
THRESHOLD = 0.8
STEP_WORDS = 200_000


def few(df: DataFrame, row_bytes: int) -> DataFrame:
    """A saved table that meets others without a shuffle if it takes at most 2 MB: the rounds' shuffles have few rows but as many tasks as any."""
    return broadcast_if_small(df, row_bytes, 2 << 20)


def prob_minhash(h: np.ndarray, doc: np.ndarray, w: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n_docs, m): for each, the shingle of the earliest arrival; 0 for texts without shingles."""
    first = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    latest = np.full(n_docs, np.inf)
    t = np.zeros(len(h))
    k = 0
    while len(h):
        k += 1
        z = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        t = t - np.log1p(-((z >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / w
        early = t < latest[doc]
        if not early.all():
            h, doc, w, t, z = h[early], doc[early], w[early], t[early], z[early]
        at = doc * m + ((mix(z) >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = first[at] == t
        held[at[won]] = h[won]
        open_docs = np.unique(doc)
        latest[open_docs] = first.reshape(n_docs, m)[open_docs].max(1)
    return held.reshape(n_docs, m)


def steps(offsets: np.ndarray, step: int = STEP_WORDS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `step` list items in all."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        yield at, to
        at = to


SIGNED = "doc_id long, k1 long, k2 long, bands array<long>, sig binary"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of the words in two halves, and the hashes of the words."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", word_hashes(F.col("text")))
    key = lambda seed: F.when(F.size("words") > 0, F.xxhash64(F.lit(seed), "words")).otherwise(F.xxhash64(F.lit(seed + 2), "text"))
    return hashed.select("doc_id", key(1).alias("k1"), key(2).alias("k2"), "words")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, the key of the words, a hash for each band, and 16 bits of each register."""
    fed = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1).astype(np.uint64))
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            for at, to in steps(offsets):
                lengths = np.diff(offsets[at : to + 1])
                h, doc, count = weighted(*shingle_hashes(values[offsets[at] : offsets[to]], lengths))
                held = prob_minhash(h, doc, count.astype(np.float64), to - at)
                band = np.zeros((to - at, BANDS), np.uint64) + salt
                for j in range(ROWS):
                    band = mix(band * np.uint64(3) + held.reshape(to - at, BANDS, ROWS)[:, :, j])
                full = lengths > 0
                sig = np.ascontiguousarray((held >> np.uint64(20)).astype(np.uint16))
                starts = np.append(0, np.cumsum(np.where(full, BANDS, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(at, to - at) for c in ("doc_id", "k1", "k2")),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(band[full].ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(np.arange(0, (to - at + 1) * 2 * REGISTERS, 2 * REGISTERS, dtype=np.int32)), pa.py_buffer(sig)]),
                    ],
                    ["doc_id", "k1", "k2", "bands", "sig"],
                )

    return fed.mapInArrow(run, SIGNED)


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs(a, b) of which at least that share of registers is equal."""
    both = few(pairs, 16).join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            good = (a == b).mean(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _words_of(ids: DataFrame, docs: DataFrame, texts: DataFrame, work: Workspace, name: str) -> DataFrame:
    """id, words of the texts with these ids, a row for each; ids is a saved table or a broadcast one."""
    wanted = work.save(texts.select("id", "first", "k1", "k2").join(ids, "id", "left_semi"), f"{name}-wanted")
    wanted = broadcast_if_small(wanted, 96)
    found = keyed(docs.join(wanted.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"))
    own = (found.doc_id == wanted["first"]) & (found.k1 == wanted.k1) & (found.k2 == wanted.k2)
    return found.join(wanted, own).select("id", "words").dropDuplicates(["id"])


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, threshold: float, work: Workspace, name: str) -> DataFrame:
    """a, b, similarity of the pairs whose exact J_P over whole texts reaches the threshold."""
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    ids = few(ends, 8)
    if ids is ends:
        ids = broadcast_if_small(work.save(ends.distinct(), f"{name}-ids"), 64)
    # 31 bits a word: a shingle of five still has 155
    bags = _words_of(ids, docs, texts, work, name).select("id", F.transform("words", lambda x: F.pmod(x, F.lit(1 << 31)).cast("int")).alias("words"))
    bags = work.save(bags, f"{name}-bags")
    both = few(pairs, 16).join(bags.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").join(bags.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")

    def bag(words: np.ndarray):
        h, doc = shingle_hashes(words, np.array([len(words)]))
        h, _, n = weighted(h, doc)
        return h, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, mine = [], None, None
            for i in range(batch.num_rows):
                wa, wb = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("wa", "wb"))
                if last is None or len(last) != len(wa) or not np.array_equal(last, wa):
                    last, mine = wa, bag(wa)
                out.append(probability_jaccard(*union_weights(*mine, *bag(wb))))
            found = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), found], ["a", "b", "similarity"]).filter(pa.array(np.array(out) >= threshold - 1e-9, pa.bool_()))

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, similarity double")


def _prefixes(docs: DataFrame, texts: DataFrame, ids: DataFrame, work: Workspace, threshold: float) -> DataFrame:
    """Rows (id, h, own) by which texts with J_P of at least the threshold meet: their rarest shingles, and what `_reach` takes.

    Two such texts share a weight of the threshold at least, which cannot lie outside of both prefixes of one global order.
    At the first shingle that they share, what is before it is not shared. own has the share of weight before it, the number
    of distinct shingles from it on, how many shingles repeat others, and the number of all.
    """
    bags = _words_of(broadcast_if_small(ids, 64), docs, texts, work, "dense")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            own = batch.column("id").to_numpy()
            for at, to in steps(offsets):
                h, doc, n = weighted(*shingle_hashes(values[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1])))
                size, kinds = np.bincount(doc, n, to - at), np.bincount(doc, minlength=to - at)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[at:to][doc], h.view(np.int64), n / size[doc], kinds[doc], size[doc])], ["id", "h", "share", "kinds", "size"])

    rows = work.save(bags.mapInArrow(run, "id long, h long, share double, kinds long, size double"), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = rows.join(often, "h", "left")
    order = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "h")
    before = F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = ranked.withColumns({"before": before, "left": F.col("kinds") - F.row_number().over(order) + 1})
    placed = placed.filter(F.col("df").isNotNull() & (F.col("before") <= 1 - threshold + 1e-6))
    found = work.save(placed.select("id", "h", F.struct("before", "left", (F.col("size") - F.col("kinds")).alias("repeats"), "size").alias("own")), "prefixes")
    work.drop("shingles")
    return found


#: For buckets that tell nothing of what is shared.
ANY = "named_struct('before', 0.0D, 'left', 1L << 40, 'repeats', 0.0D, 'size', 1.0D)"


def _reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether two texts with these values of own can have J_P of the threshold.

    If they share A of the weight of one and B of the other, J_P is at most 1 / (1/A + 1/B - 1), which they reach if they have
    the shared shingles in proportion. A is at most what is not before the bucket's shingle; and the shared shingles are at
    most as many kinds as both have left, of which each counts once, besides the repeats.
    """
    kinds = F.least(a["left"], b["left"])
    share = lambda x: F.least(1 - x["before"], (kinds + x["repeats"]) / x["size"])
    return 1 / share(a) + 1 / share(b) <= 1 + 1 / threshold + 1e-6


def near_links(docs: DataFrame, texts: DataFrame, work: Workspace, threshold: float = THRESHOLD, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The components, id, label, of the links between different texts(id, first, k1, k2, bands, sig), and the verified links that formed them, a, b, similarity."""
    state: dict = {"labels": None, "k": 0, "links": texts.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0), "most": 0}

    def labelled(rows: DataFrame) -> DataFrame:
        if state["labels"] is None:
            return rows.withColumn("label", F.col("id"))
        known = state["labels"].withColumnRenamed("label", "known")
        return rows.join(known, "id", "left").withColumn("label", F.coalesce("known", "id")).drop("known")

    def merged(found: DataFrame, k: int) -> DataFrame:
        """Labels after new links: the components of the components that the links join."""
        ends = work.save(labelled(found.select(F.col("a").alias("id")).unionAll(found.select(F.col("b").alias("id"))).distinct()), f"ends{k}")
        ends = few(ends, 16)
        side = lambda c: ends.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        joined = connected_components(found.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), sent=1 << 16)
        known = ends if state["labels"] is None else state["labels"].unionAll(ends.join(state["labels"], "id", "left_anti"))
        roots = few(joined, 16).select(F.col("id").alias("label"), F.col("label").alias("root"))
        return few(work.save(known.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label")), f"labels{k}"), 16)

    def mixed(rows: DataFrame, name: str) -> DataFrame | None:
        """The rows of buckets that have more than one component, with labels; None if there are none."""
        rows = labelled(rows)
        good = rows.groupBy("h").agg((F.min("label") != F.max("label")).alias("mixed"), F.struct(F.min("own.before").alias("before"), F.max("own.left").alias("left"), F.max("own.repeats").alias("repeats"), F.min("own.size").alias("size")).alias("best"), F.count("*").alias("n")).filter("mixed").select("h", "best", "n")
        good = work.save(good, f"{name}-buckets")
        state["most"] = good.agg(F.sum(F.col("n") * F.col("n").cast("double"))).first()[0]
        if state["most"] is None:
            return None
        # buckets that are still mixed are few: the rows need not meet them by a shuffle in which a dense bucket is one task
        rows = rows.join(broadcast_if_small(good.drop("n"), 96), "h").filter(_reach(F.col("best"), F.col("own"), threshold)).drop("best")
        rows = work.save(rows.withColumn("rank", F.xxhash64("id")), name)
        return rows if rows.limit(1).count() else None

    def met(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """a, b: the pairs of a head and another text of its bucket that have different labels and can be similar."""
        heads = few(heads.select("h", F.col("id").alias("a"), F.col("rank").alias("ra"), F.col("own").alias("own_a"), F.col("label").alias("la")), 96)
        after = F.struct("own_a", "ra", "a") < F.struct("own", "rank", "id")
        found = rows.join(heads, "h").filter((F.col("la") != F.col("label")) & after & _reach(F.col("own_a"), F.col("own"), threshold))
        return found.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))

    def round_(rows: DataFrame, n: int, more: bool = True) -> DataFrame | None:
        """Compare the first n texts of each bucket with those of other components; the others are left, where components still differ, if there are more rounds of these buckets."""
        k = state["k"] = state["k"] + 1
        last = state["most"] <= 2 * LAST
        if not last:
            # the first n of each task's part of a bucket, or where n are many of each part of it, then of the bucket: no task sorts a whole one
            first = lambda df, *by: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("own", "rank", "id"))).filter(F.col("rn") <= n)
            parts = first(rows.withColumn("split", F.pmod(F.xxhash64("id", F.lit(n)), F.lit(SPLIT))), "h", "split") if n > 8 * PIVOTS else rows
            heads = work.save(first(parts, "h").select("h", "id", "rank", "own", "label"), f"heads{k}")
        pairs = work.save(met(rows, rows if last else heads).distinct(), f"pairs{k}")
        if pairs.limit(1).count():
            alike = work.save(_alike(pairs, texts, threshold - 0.18), f"alike{k}")
            if alike.limit(1).count():
                found = work.save(_verified(alike, docs, texts, threshold, work, f"round{k}"), f"links{k}")
                if found.limit(1).count():
                    state["links"] = state["links"].unionAll(found)
                    state["labels"] = merged(found, k)
        for done in (f"pairs{k}", f"alike{k}", f"round{k}-ids", f"round{k}-wanted", f"round{k}-bags"):
            work.drop(done)
        return None if last or not more else mixed(rows.select("h", "id", "own").join(few(heads.select("h", "id"), 16), ["h", "id"], "left_anti"), f"left{k}")

    banded = texts.select("id", F.posexplode("bands").alias("band", "h"), F.expr(ANY).alias("own"))
    first = mixed(banded.filter(F.col("band") < FIRST_BANDS).select("h", "id", "own"), "first")
    if first is not None:
        round_(first, 1, more=False)
    rows = mixed(banded.select("h", "id", "own"), "all")
    if rows is not None:
        rows = round_(rows, pivots)
    if rows is not None:
        rows = mixed(_prefixes(docs, texts, work.save(rows.select("id").distinct(), "dense"), work, threshold), "rarest")
    while rows is not None:
        pivots *= 8
        rows = round_(rows, pivots)
    if state["labels"] is None:
        return texts.select("id", F.col("id").alias("label")).limit(0), state["links"]
    return state["labels"], state["links"]


def _classes(docs: DataFrame, threshold: float, pivots: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2 of the rows with doc_id, and the classes of the texts: k1, k2, text_id, class_id, stays, link_id, similarity."""
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    signed = work.save(signatures(named), "signed")
    texts = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("x"))
    # several texts may have one doc_id, so they are numbered
    texts = work.save(texts.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "first", "x.bands", "x.sig"), "texts")
    labels, links = near_links(named, texts, work, threshold, pivots)
    ends = few(links.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionAll(links.select("b", "a", "similarity")), 24)
    other = texts.select(F.col("id").alias("other"), F.col("first").alias("link_id"))
    best = ends.join(other, "other").groupBy("id").agg(F.max(F.struct("similarity", (-F.col("link_id")).alias("least"))).alias("best"))
    own = texts.select("id", "k1", "k2", "first").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = work.save(own.join(best, "id", "left").select("k1", "k2", "first", "label", (-F.col("best.least")).alias("link_id"), "best.similarity"), "labelled")
    tops = own.groupBy("label").agg(F.min(F.struct("first", "k1", "k2")).alias("top"))
    stays = (F.col("top.k1") == F.col("k1")) & (F.col("top.k2") == F.col("k2"))
    classes = own.join(tops, "label").select("k1", "k2", F.col("first").alias("text_id"), F.col("top.first").alias("class_id"), stays.alias("stays"), "link_id", "similarity")
    return signed.select("doc_id", "k1", "k2"), work.save(classes, "classes")


def _judged(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, ["k1", "k2"]).withColumn("kept", F.col("stays") & (F.col("doc_id") == F.col("class_id")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, class_id, text_id, kept, link_id, similarity.

    text_id is the least doc_id with the same words; link_id is the text_id of another text of the class, the most similar of
    those that this text was compared with, and similarity their J_P (null for texts that are alone).
    """
    work = Workspace(docs.sparkSession, "near")
    found = _judged(*_classes(docs, threshold, pivots, work)).select("doc_id", "class_id", "text_id", "kept", "link_id", "similarity")
    none = lambda kind: F.lit(None).cast(kind)
    lost = docs.filter("doc_id IS NULL").select("doc_id", none("long"), none("long"), F.lit(True), none("long"), none("double"))
    return found.unionAll(lost)


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: one document of each class, with all its columns, and rows without doc_id."""
    work = Workspace(docs.sparkSession, "near-kept")
    judged = _judged(*_classes(docs, threshold, PIVOTS, work)).filter("NOT kept").select("doc_id", "k1", "k2")
    gone = work.save(judged.distinct(), "gone")
    # a doc_id with a text that stays beside one that goes is told apart by its texts' keys
    kept = _judged(*(work.spark.read.parquet(f"{work.path}/{t}") for t in ("signed", "classes"))).filter("kept").select("doc_id")
    both = work.save(gone.join(kept, "doc_id", "left_semi"), "both")
    whole = work.save(gone.select("doc_id").join(both.select("doc_id"), "doc_id", "left_anti").distinct().withColumnRenamed("doc_id", "__gone"), "whole")
    left = docs.join(broadcast_if_small(whole, 64), F.col("doc_id") == F.col("__gone"), "left_anti")
    if not both.limit(1).count():
        return left
    ids = both.select(F.col("doc_id").alias("__both")).distinct()
    some = left.join(ids, F.col("doc_id") == F.col("__both"), "left_semi").select(F.struct("*").alias("__row"), "doc_id", "text")
    key = keyed(some.select(F.struct("__row", "doc_id").alias("doc_id"), "text")).select("doc_id.*", "k1", "k2")
    stay = key.join(both, ["doc_id", "k1", "k2"], "left_anti").select("__row.*")
    return left.join(ids, F.col("doc_id") == F.col("__both"), "left_anti").unionAll(stay)
