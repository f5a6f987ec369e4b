"""Benchmark decontamination by SimHash windows.

For a benchmark item of L words, windows of L words of a document are fingerprinted: each bit of a 64-bit SimHash is the
majority over the window's words of that bit of the word's hash. A multi-index finds the items within RADIUS bits: the
fingerprint is cut into BLOCKS blocks, and of two fingerprints that differ in at most RADIUS bits one block differs in at
most RADIUS // BLOCKS; a window's blocks are looked up with all values so near, so no item within the radius is missed. For
the items found, the weighted Jaccard similarity of the window's and the item's 5-word shingles (of an item with fewer words,
the whole is its shingle) is computed for all windows between the first and the last one found, by what enters and leaves
from one to the next; the most similar one is reported.

Only windows in places with enough shingles of an item of their size are fingerprinted, and only such pairs are verified; the
others cannot reach the threshold, so nothing is lost by leaving them out, and most documents cost a lookup for each word.
Hits of an item become intervals of starts that are merged before any window is made, so work and memory grow with the words,
not with words times hits. What the radius can lose are windows of at least the threshold that differ in more bits; README has the measured share.

The index is built for blocks of at most ITEMS_PER_BLOCK items and about WORDS_PER_BLOCK words (a longer item has more); a
larger benchmark is used in several blocks, one after the other, each against all documents (in `decontaminate`, against those that are left). A block's size is
bounded in items and words, and a task holds one block's index at a time.

Defined results: texts are compared by their lower-cased words (letters and digits); null and empty texts and items match
nothing; a document shorter than an item is one window; very long texts and items are windows like others; equal items are all
reported, of equally similar windows the one with the nearest fingerprint, then the first; repeated rows, null ids and further
columns make no difference, as every row is looked at alone; of empty tables nothing is reported and nothing removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.llm.common import Workspace, word_hashes
from firmgraph.llm.shingles import SHINGLE, mix, shingle_hashes, weighted

RADIUS, BLOCKS, THRESHOLD = 17, 6, 0.8
ITEMS_PER_BLOCK, WORDS_PER_BLOCK, STEP_WORDS, STEP_WINDOWS = 20_000, 2_000_000, 200_000, 20_000
MATCH = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("hamming", pa.int32()), ("start_word", pa.int64()), ("n_words", pa.int64())])
MATCHES = "array<struct<item_id: bigint, similarity: double, hamming: int, start_word: bigint, n_words: bigint>>"


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers low[i] .. high[i] - 1 of all i in a row, and their i."""
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i], i


def simhash(totals: np.ndarray) -> np.ndarray:
    """Fingerprints from (n, 64) sums of bits as +1 and -1."""
    return np.packbits(totals > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def bits(words: np.ndarray) -> np.ndarray:
    """(n, 64) bits of the word hashes as +1 and -1."""
    return np.unpackbits(mix(words.astype(np.int64).view(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class Index:
    """Fingerprints and shingles of benchmark items."""

    def __init__(self, ids: list, words: list[np.ndarray], radius: int = RADIUS, blocks: int = BLOCKS):
        kept = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words, self.radius = [ids[i] for i in kept], [words[i] for i in kept], radius
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.prints = np.array([simhash(bits(w).sum(0, keepdims=True))[0] for w in self.words], np.uint64)
        self.bags = []
        own, item, width = [], [], []
        for i, w in enumerate(self.words):
            h, _, n = weighted(*shingle_hashes(w, np.array([len(w)])))
            self.bags.append((h, n))
            own.append(h)
            item.append(np.full(len(h), i))
            width.append(np.full(len(h), min(len(w), SHINGLE)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        h, item, width = cat(own, np.uint64), cat(item, np.int64), cat(width, np.int64)
        self.shingles = {}  # by width: sorted hashes and their items
        for k in np.unique(width):
            at = np.flatnonzero(width == k)
            at = at[np.lexsort((item[at], h[at]))]
            self.shingles[int(k)] = (h[at], item[at])
        edges = np.linspace(0, 64, blocks + 1).round().astype(int)
        self.blocks = []  # shift, mask, values that are so near to 0, sorted values, items
        for a, b in zip(edges[:-1], edges[1:]):
            shift, mask = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            value = (self.prints >> shift) & mask
            near = [0]
            for _ in range(radius // blocks):
                near = sorted({x ^ y for x in near for y in [0, *(1 << j for j in range(b - a))]})
            order = np.argsort(value, kind="stable")
            self.blocks.append((shift, mask, np.array(near, np.uint64), value[order], order))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, item, distance) within the radius."""
        n, found = max(1, len(self.prints)), []
        for shift, mask, near, values, items in self.blocks:
            for x in near:
                value = ((prints >> shift) & mask) ^ x
                at, query = expand(np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right"))
                item = items[at]
                good = np.bitwise_count(prints[query] ^ self.prints[item]) <= self.radius
                found.append(query[good] * n + item[good])
        query, item = np.divmod(np.unique(np.concatenate(found)), n)
        return query, item, np.bitwise_count(prints[query] ^ self.prints[item])

    def hits(self, values: np.ndarray, lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of starts, first and last, of windows that hold shingles of an item of their size, with item and row.

        Intervals with fewer hits than shingles that a window must share are left out.
        """
        ends = np.cumsum(lengths)
        found = []
        for k, (hashes, items) in self.shingles.items():
            h, doc = shingle_hashes(values, lengths, k)
            counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - lengths, counts)
            pair, hit = expand(np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right"))
            if not len(hit):
                continue
            item, row, at = items[pair], doc[hit], place[hit]
            size = np.minimum(self.sizes[item], lengths[row])
            last = ends[row] - size
            low = np.clip(at - np.maximum(size - k, 0), ends[row] - lengths[row], last)
            found.append(np.stack([low, np.clip(at, low, last), item, row]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        low, high, item, row = np.concatenate(found, 1)
        order = np.lexsort((low, item, row))
        low, high, item, row = low[order], high[order], item[order], row[order]
        # hits of a pair that overlap are one interval; the running maximum starts anew with each pair
        pair = np.cumsum(np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1])))
        reach = np.maximum.accumulate(high + pair * (len(values) + 2)) - pair * (len(values) + 2)
        new = np.append(True, (pair[1:] != pair[:-1]) | (low[1:] > reach[:-1] + 1))
        at = np.flatnonzero(new)
        low, high, item, row = low[at], np.maximum.reduceat(high, at), item[at], row[at]
        width = np.minimum(self.sizes[item], SHINGLE)
        total = self.sizes[item] - width + 1 + np.maximum(np.minimum(self.sizes[item], lengths[row]) - width + 1, 1)
        good = np.diff(np.append(at, len(new))) >= threshold / (1 + threshold) * total - 1e-9
        return low[good], high[good], item[good], row[good]

    def fingerprints(self, values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """SimHashes of windows that are sorted by start, from sums over the words that they cover."""
        out = np.zeros(len(start), np.uint64)
        for a in range(0, len(start), STEP_WINDOWS):
            s, n = start[a : a + STEP_WINDOWS], size[a : a + STEP_WINDOWS]
            used = np.zeros(int((s + n).max() - s[0]) + 1, np.int32)
            np.add.at(used, s - s[0], 1)
            np.add.at(used, s + n - s[0], -1)
            places = np.flatnonzero(np.cumsum(used)[:-1]) + s[0]
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits(values[places]), 0, dtype=np.int32)])
            low = np.searchsorted(places, s)
            out[a : a + STEP_WINDOWS] = simhash(sums[low + n] - sums[low])
        return out

    def similarities(self, words: np.ndarray, size: int, item: int) -> np.ndarray:
        """Weighted Jaccard similarity of an item and each window of that size of a run of words."""
        width = min(SHINGLE, int(self.sizes[item]))
        h, _ = shingle_hashes(words, np.array([len(words)]), width)
        hashes, weights = self.bags[item]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = np.where(hashes[at] == h, at, -1).tolist()
        own, held, common = weights.tolist(), [0] * len(hashes), 0
        n = max(1, size - width + 1)  # shingles of a window
        total, out = int(weights.sum()) + n, []
        for i, k in enumerate(known):
            if k >= 0:
                common += held[k] < own[k]
                held[k] += 1
            if i >= n and (gone := known[i - n]) >= 0:
                held[gone] -= 1
                common -= held[gone] < own[gone]
            if i >= n - 1:
                out.append(common / (total - common))
        return np.array(out)

    def find(self, values: np.ndarray, lengths: np.ndarray, threshold: float = THRESHOLD) -> dict[int, list[dict]]:
        """By row, the best window of each item that some window matches."""
        low, high, item, row = self.hits(values, lengths, threshold)
        if not len(low):
            return {}
        start, i = expand(low, high + 1)
        # items of one size share their windows
        start, size, own = np.unique(np.stack([start, np.minimum(self.sizes[item[i]], lengths[row[i]]), row[i]]), axis=1)
        query, near, distance = self.within(self.fingerprints(values, start, size))
        n = len(self.prints)
        pair = own[query] * n + near
        good = np.isin(pair, np.unique(row * n + item)) & (size[query] == np.minimum(self.sizes[near], lengths[own[query]]))
        query, distance, pair = query[good], distance[good], pair[good]
        order = np.lexsort((start[query], pair))
        query, distance, pair = query[order], distance[order], pair[order]
        first = np.cumsum(lengths) - lengths
        out: dict[int, list[dict]] = {}
        edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else []
        for a, b in zip(edges, [*edges[1:], len(pair)]):
            r, t = divmod(int(pair[a]), n)
            starts, m = start[query[a:b]], int(size[query[a]])
            score = np.zeros(b - a)
            cut = np.flatnonzero(np.append(True, np.diff(starts) > m))  # runs that are further apart than a window
            for c, d in zip(cut, [*cut[1:], len(starts)]):
                run = self.similarities(values[starts[c] : starts[d - 1] + m], m, t)
                score[c:d] = run[starts[c:d] - starts[c]]
            best = np.lexsort((starts, distance[a:b], -score))[0]
            if score[best] >= threshold:
                out.setdefault(r, []).append({"item_id": self.ids[t], "similarity": float(score[best]), "hamming": int(distance[a + best]), "start_word": int(starts[best] - first[r]), "n_words": m})
        return out


def item_blocks(benchmark: DataFrame, items_per_block: int = ITEMS_PER_BLOCK, words_per_block: int = WORDS_PER_BLOCK) -> Iterator[Index]:
    """Indices over blocks of the benchmark, each of a bounded number of items and words."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).filter(F.size("words") > 0)
    count, total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    n = max(-(-count // items_per_block), -(-total // words_per_block))
    # hashing fills blocks unevenly by a few items only
    for i in range(n):
        got = items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == i).toArrow().combine_chunks()
        rows = sorted(zip(got.column("item_id").to_pylist(), got.column("words").to_pylist()), key=str)
        yield Index([r[0] for r in rows], [np.array(r[1], np.int64) for r in rows])


def matches(text: Column, index: Index, spark, threshold: float = THRESHOLD) -> Column:
    """The items of one block that a text holds."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(MATCHES)
    def look(words: pa.Array) -> pa.Array:
        offsets = words.offsets.to_numpy().astype(np.int64)
        values = words.values.to_numpy(zero_copy_only=False)
        out, at = [], 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_WORDS, "right")) - 1)
            found = shared.value.find(values[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1]), threshold)
            out += [found.get(i, []) for i in range(to - at)]
            at = to
        return pa.array(out, pa.list_(MATCH))

    return look(word_hashes(text))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **blocks: int) -> DataFrame:
    """doc_id and the fields of a match, for each document and item that it holds. What a block finds is saved before the next one is sent out."""
    work, found = Workspace(docs.sparkSession, "contaminated"), []
    for i, index in enumerate(item_blocks(benchmark, **blocks)):
        one = docs.select("doc_id", F.explode(matches(F.col("text"), index, docs.sparkSession, threshold)).alias("m")).select("doc_id", "m.*")
        found.append(work.save(one, f"block-{i}"))
    if not found:
        found.append(docs.select("doc_id", F.explode(F.lit(None).cast(MATCHES)).alias("m")).select("doc_id", "m.*"))
    return reduce(DataFrame.unionAll, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **blocks: int) -> DataFrame:
    """The rows of docs that hold no item. What a block leaves is saved before the next one: a task has one index, and looks up no row that an earlier block has rejected."""
    work, before = Workspace(docs.sparkSession, "decontaminated"), None
    for i, index in enumerate(item_blocks(benchmark, **blocks)):
        if before is not None:
            docs = work.save(docs, f"block-{i}")
            work.drop(f"block-{i - 1}")
        before = index
        docs = docs.filter(F.size(matches(F.col("text"), index, docs.sparkSession, threshold)) == 0)
    return docs
