"""Ranked lexical search by TPUT: the best documents of term-partitioned posting lists in three phases.

Scores are sums over an item's terms of whole numbers, c = w * ((10^9 tf) div (1000 tf + 20 m)), w being the term's weight by
its document frequency and m the document's length against the mean. So a term's posting has the same c for every item, and the
lists of all terms that items have are one table of (term, c, document), dealt by ranges of them and sorted: a list is as many partitions as it needs, its
head lies in front, and Parquet's statistics skip what is below a threshold.

1. Heads: the k first postings of each list. Their sums by document are lower bounds; the k-th best of an item is tau.
2. Threshold: a document with a score of tau has a posting of at least tau / m in one of the item's m lists. All those are fetched,
   from every list, once for all items, and meet by document; their sums give a higher tau, and a document stays a candidate while what it has and
   what the lists without a posting of its could still add reach it.
3. Look-up: the candidates' postings below the threshold are read from the lists, so that their scores are exact.

A posting is shuffled once by document, not once for each item that has its term: the items' terms and thresholds are sent to the
tasks, in blocks of at most ITEMS items and about PAIRS terms of theirs, each against the lists; sums of a few documents and all items of a block are a matrix.

No document that could be among the k best is lost, ties included. Texts are cut and counted in one pass in Python, a row for each
document and term of it that any item has, with one more for each document's length; N, L and document frequencies are sums over all of them.
Up to VOCABULARY terms are sent to the tasks that cut texts; of a larger benchmark all terms leave these tasks, and a join by shuffle keeps those of items.

Defined results: terms are the runs of digits, letters and all beyond ASCII, only A-Z lower-cased; null and empty texts have none and are no
documents of N; items without terms, or without documents that score above 0, have no rows; repeated documents and items are rows of
their own; ties go by doc_id, null last; rank is unique by item row. A very long text is counted whole; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.llm.common import Workspace, broadcast_if_small
from firmgraph.llm.decontaminate import expand

K = 50
VOCABULARY, ITEMS, PAIRS, CELLS, STEP = 400_000, 2_000, 500_000, 1_000_000, 200_000
#: Delimiters become blanks, A-Z small letters; all else is part of terms.
CUT = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(CUT).split() if text else []


def counted(docs: DataFrame, keep: list[str], known: set[bytes] | None = None) -> DataFrame:
    """keep, n, term, tf: a row for each term of each of docs(keep, text), of those `known` if given, and one with the number of all its terms and no term."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, names, counts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = terms(text)
                held = Counter(found if known is None else [t for t in found if t in known])
                rows += [i] * (len(held) + 1)
                lengths += [len(found)] * (len(held) + 1)
                names += [None, *held]
                counts += [0, *held.values()]
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(lengths, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.int64())], [*keep, "n", "term", "tf"])

    fed = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    return fed.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "n long, term binary, tf long"]))


def lists_of(docs: DataFrame, vocabulary: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The posting lists tid, c, rid of vocabulary(term, tid) over docs(doc_id, text), and the documents rid, doc_id."""
    size = vocabulary.count()
    known = {bytes(r["term"]) for r in vocabulary.select("term").toLocalIterator()} if size <= VOCABULARY else None
    rows = counted(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), ["rid", "doc_id"], known)
    named = rows.join(broadcast_if_small(vocabulary, 64), "term", "left").filter(F.col("term").isNull() | F.col("tid").isNotNull())
    raw = work.save(named.select("rid", F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id"), "n", "tid", "tf"), "counted", batch=1000)
    whole = raw.filter("tid IS NULL")
    n, total = whole.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = raw.filter("tid IS NOT NULL").groupBy("tid").agg(F.count("*").alias("df"))
    weights = work.save(often.select("tid", F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")), "weights")
    m = F.lit(100 - 50).cast("long") + F.expr(f"(50L * n * {n}L) div {max(1, total)}L")
    held = raw.filter("tid IS NOT NULL").join(broadcast_if_small(weights, 32), "tid").withColumn("m", m)
    postings = held.withColumn("c", F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")).filter("c > 0").select("tid", "c", "rid")
    return work.save(postings.repartitionByRange("tid", F.desc("c"), "rid").sortWithinPartitions("tid", F.desc("c"), "rid"), "lists"), whole.select("rid", "doc_id")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """iid, tau: the k-th highest of sums(iid, score), for those that have as many."""
    place = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score")))
    return sums.withColumn("place", place).filter(F.col("place") <= k).groupBy("iid").agg(F.min("score").alias("tau"), F.count("*").alias("n")).filter(F.col("n") == k).select("iid", "tau")


class Items:
    """The terms and thresholds of a block of items."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        """rows: iid, tid, m, least."""
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.iids, first, self.of = np.unique(table[:, 0], return_index=True, return_inverse=True)
        self.m, self.least = table[first, 2], table[first, 3]
        order = np.argsort(table[:, 1], kind="stable")
        self.tids, starts = np.unique(table[order, 1], return_index=True)
        self.starts, self.of = np.append(starts, len(table)), self.of[order]

    def sums(self, doc: np.ndarray, tid: np.ndarray, c: np.ndarray, n: int, fetched: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(n documents, items): the sums of postings that reach the items' thresholds (or of those that do not), and how many they are."""
        at = np.minimum(np.searchsorted(self.tids, tid), max(0, len(self.tids) - 1))
        known = np.flatnonzero(self.tids[at] == tid) if len(self.tids) else np.zeros(0, np.int64)
        pair, i = expand(self.starts[at[known]], self.starts[at[known] + 1])
        item, value = self.of[pair], c[known][i]
        good = (value >= self.least[item]) == fetched
        cell = doc[known][i][good] * len(self.iids) + item[good]
        shape, size = (n, len(self.iids)), n * len(self.iids)
        # whole numbers below 2^53, so doubles are exact
        return np.bincount(cell, value[good], size).astype(np.int64).reshape(shape), np.bincount(cell, minlength=size).reshape(shape)


def _steps(batch: pa.RecordBatch, items: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch(rid, tids, cs), few enough for a matrix: first, last, and the document, term and value of their postings."""
    tids, cs = batch.column("tids"), batch.column("cs")
    offsets = tids.offsets.to_numpy().astype(np.int64)
    t, c = tids.values.to_numpy(zero_copy_only=False), cs.values.to_numpy(zero_copy_only=False)
    at, most = 0, max(1, CELLS // max(1, items))
    while at < batch.num_rows:
        to = min(batch.num_rows, at + most, max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1))
        low, high = offsets[at], offsets[to]
        yield at, to, np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1])), t[low:high], c[low:high]
        at = to


def _best(held: DataFrame, items: Items, k: int, spark) -> DataFrame:
    """iid, score: the k highest sums of each item in each task."""
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        top = np.zeros((0, len(own.iids)), np.int64)
        for batch in batches:
            for at, to, doc, t, c in _steps(batch, len(own.iids)):
                top = np.concatenate([top, own.sums(doc, t, c, to - at)[0]])
                if len(top) > k:
                    top = np.partition(top, len(top) - k, axis=0)[-k:]
        row, item = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(own.iids[item]), pa.array(top[row, item])], ["iid", "score"])

    return held.mapInArrow(run, "iid long, score long")


def _candidates(held: DataFrame, items: Items, tau: dict[int, int], spark) -> DataFrame:
    """iid, rid, score: what has been fetched of the documents that can still reach an item's tau."""
    shared, least = spark.sparkContext.broadcast(items), spark.sparkContext.broadcast(tau)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        wanted = np.array([least.value.get(int(i), 0) for i in own.iids], np.int64)
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for at, to, doc, t, c in _steps(batch, len(own.iids)):
                score, seen = own.sums(doc, t, c, to - at)
                row, item = np.nonzero((seen > 0) & (score + (own.m - seen) * (own.least - 1) >= wanted))
                yield pa.RecordBatch.from_arrays([pa.array(own.iids[item]), pa.array(rids[at:to][row]), pa.array(score[row, item])], ["iid", "rid", "score"])

    return held.mapInArrow(run, "iid long, rid long, score long")


def _rest(held: DataFrame, items: Items, spark) -> DataFrame:
    """iid, rid, score: what postings below the thresholds add to candidates; held(rid, iids, tids, cs)."""
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rids, iids = batch.column("rid").to_numpy(), batch.column("iids")
            offsets, asked = iids.offsets.to_numpy().astype(np.int64), np.searchsorted(own.iids, iids.values.to_numpy(zero_copy_only=False))
            for at, to, doc, t, c in _steps(batch, len(own.iids)):
                score, _ = own.sums(doc, t, c, to - at, fetched=False)
                row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
                item = asked[offsets[at] : offsets[to]]
                yield pa.RecordBatch.from_arrays([pa.array(own.iids[item]), pa.array(rids[at:to][row]), pa.array(score[row, item])], ["iid", "rid", "score"])

    return held.mapInArrow(run, "iid long, rid long, score long")


def _by_document(postings: DataFrame) -> DataFrame:
    """rid, tids, cs: the postings of each document."""
    held = postings.groupBy("rid").agg(F.collect_list(F.struct("tid", "c")).alias("p"))
    return held.select("rid", F.transform("p", lambda x: x["tid"]).alias("tids"), F.transform("p", lambda x: x["c"]).alias("cs"))


def tput(lists: DataFrame, wanted: DataFrame, work: Workspace, k: int = K, items: int = ITEMS, pairs: int = PAIRS) -> DataFrame:
    """iid, rid, score of all documents that may be among the k best of an item; wanted(iid, tid), its terms once each."""
    spark = lists.sparkSession
    place = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("c"), "rid"))
    heads = work.save(lists.withColumn("place", place).filter(F.col("place") <= k).select("tid", "c", "rid"), "heads")
    first = _kth(wanted.join(heads, "tid").groupBy("iid", "rid").agg(F.sum("c").alias("score")), k)
    sizes = wanted.groupBy("iid").agg(F.count("*").alias("m"))
    # whole numbers: what is not fetched is below the quotient, rounded up
    limits = sizes.join(first, "iid", "left").select("iid", "m", F.expr("greatest((coalesce(tau, 0L) + m - 1) div m, 1L)").alias("least"))
    limited = work.save(wanted.join(limits, "iid"), "limited")
    work.drop("heads")
    count, total = limited.agg(F.count_distinct("iid"), F.count("*")).first()
    found = []
    for i in range(blocks := max(1, -(-count // items), -(-total // pairs))):
        own = limited.filter(F.pmod(F.xxhash64("iid"), F.lit(blocks)) == i)
        block = Items([tuple(r) for r in own.select("iid", "tid", "m", "least").toLocalIterator()])
        ranges = broadcast_if_small(work.save(own.groupBy("tid").agg(F.min("least").alias("lowest"), F.max("least").alias("highest")), f"ranges-{i}"), 48)
        held = work.save(_by_document(lists.join(ranges, "tid").filter("c >= lowest")), f"fetched-{i}")
        tau = {r["iid"]: r["tau"] for r in _kth(_best(held, block, k, spark), k).collect()}
        candidates = work.save(_candidates(held, block, tau, spark), f"candidates-{i}", batch=2000)
        asked = candidates.groupBy("rid").agg(F.collect_list("iid").alias("iids"))
        near = lists.join(ranges, "tid").filter("c < highest").join(broadcast_if_small(work.save(candidates.select("rid").distinct(), f"rids-{i}"), 16), "rid", "left_semi")
        rest = _rest(_by_document(near).join(asked, "rid"), block, spark)
        found.append(work.save(candidates.unionAll(rest).groupBy("iid", "rid").agg(F.sum("score").alias("score")), f"exact-{i}", batch=2000))
        for name in ("fetched", "candidates", "rids"):
            work.drop(f"{name}-{i}")
    return reduce(DataFrame.unionAll, found)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each of items(item_id, text)."""
    work = Workspace(docs.sparkSession, "tput")
    told = work.save(counted(items.select(F.monotonically_increasing_id().alias("iid"), "item_id", "text"), ["iid", "item_id"]).filter("term IS NOT NULL").select("iid", "item_id", "term"), "items")
    vocabulary = work.save(told.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    lists, whole = lists_of(docs, vocabulary, work)
    wanted = work.save(told.join(broadcast_if_small(vocabulary, 64), "term").select("iid", "tid"), "wanted")
    found = tput(lists, wanted, work, k)
    # one look at the documents for the ids of what is left, ties with the last place included
    last = broadcast_if_small(work.save(_kth(found.select("iid", "score"), k), "last"), 32)
    found = work.save(found.join(last, "iid", "left").filter(F.col("score") >= F.coalesce("tau", F.lit(1))).select("iid", "rid", "score"), "found")
    held = whole.join(broadcast_if_small(work.save(found.select("rid").distinct(), "found-rows"), 16), "rid", "left_semi")
    place = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid"))
    best = found.join(held, "rid").withColumn("rank", place).filter((F.col("rank") <= k) & (F.col("score") > 0))
    names = told.select("iid", "item_id").distinct()
    return best.join(names, "iid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
