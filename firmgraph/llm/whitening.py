"""Whitening of vectors by a covariance that is multiplied in tiles.

Entries become whole numbers, x = floor(SCALE c) + SHIFT. The fit list is each distinct x once: n of them with sums S by dimension.

The covariance V of the fit list, divisor n: rows get a number and go in row blocks of ROWS; each row block is cut into column
blocks of TILE dimensions, centred by (n x - S) / n, whose numerator is exact. A column block (row block, columns) is a row of
a table of its own; column blocks of one row block meet by a join on it, each pair i <= j once, and give a product of TILE x TILE entries for
the tile (i, j). Products are summed within each task, a row for each of its tiles, then by tile over all tasks. So no task holds more than
a few blocks and the tiles that it has met, and the shuffle has each vector once and a tile for each task. The tiles of the D x D matrix are put together on the driver, which
decomposes it: its size is told by the dimensions, not by the rows.

Projections are made row by row; the covariance of the whitened fit list is taken by the same tiles.

Defined results: vectors that are null or have null or non-finite entries take no part, nor do those of another length than
most vectors have (of equally many, the longest); empty vectors neither. Copies are whitened alike, and are once in the fit list. Components
whose eigenvalue is no more than 1e-12 of the trace (constant or dependent dimensions, fewer vectors than dimensions) do not exist: they are not returned.
Null and repeated ids stay; an empty table gives an empty result; further columns are not read.
deviation is exact in 64 bits; where it cannot be (n spread beyond 2^63), Spark's overflow error ends the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgraph.llm.common import Workspace
from firmgraph.llm.vectors import fixed_point, lists, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
ROWS, TILE, HELD = 4096, 32, 1024
LEAST = 1e-12


def column_blocks(rows: DataFrame, dims: int, n: int, block: int = ROWS, tile: int = TILE) -> DataFrame:
    """row_block, columns, part: of n rows(id, v), the values of each row block in each column block, one row after the other by id."""
    dealt = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // block)))).alias("row_block"), "v")
    cut = dealt.select("id", "row_block", "v", F.explode(F.sequence(F.lit(0), F.lit((dims - 1) // tile))).alias("columns"))
    pieces = cut.select("id", "row_block", "columns", F.slice("v", F.col("columns") * tile + 1, tile).alias("piece"))
    held = pieces.groupBy("row_block", "columns").agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("rows"))
    return held.select("row_block", "columns", F.flatten(F.transform("rows", lambda r: r["piece"])).alias("part"))


def covariance(rows: DataFrame, dims: int, n: int, work: Workspace, name: str, block: int = ROWS, tile: int = TILE) -> np.ndarray:
    """The sums of products of the columns of n centred rows(id, v), divided by n."""
    blocks = work.save(column_blocks(rows, dims, n, block, tile), f"{name}-columns")
    left, right = blocks.select("row_block", F.col("columns").alias("i"), F.col("part").alias("a")), blocks.select("row_block", F.col("columns").alias("j"), F.col("part").alias("b"))
    pairs = left.join(right, "row_block").filter("i <= j").select("i", "j", "a", "b")
    width = lambda c: min(tile, dims - c * tile)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def told() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].ravel() for k in keys], pa.list_(pa.float64()))], ["i", "j", "tile"])

        for batch in batches:
            for r in range(batch.num_rows):
                i, j = batch.column("i")[r].as_py(), batch.column("j")[r].as_py()
                a, b = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(-1, width(k)) for c, k in (("a", i), ("b", j)))
                product = a.T @ b
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
            if len(sums) > HELD:
                yield told()
                sums.clear()
        if sums:
            yield told()

    parts = work.save(pairs.mapInArrow(multiply, "i int, j int, tile array<double>"), f"{name}-products", batch=8)
    cells = parts.select("i", "j", F.posexplode("tile").alias("at", "value")).groupBy("i", "j", "at").agg(F.sum("value").alias("value"))
    tiles = cells.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("tile"))
    out = np.zeros((dims, dims))
    for r in tiles.toLocalIterator():
        low, left_ = r["i"] * tile, r["j"] * tile
        out[low : low + width(r["i"]), left_ : left_ + width(r["j"])] = np.reshape(r["tile"], (width(r["i"]), width(r["j"])))
    return (np.triu(out) + np.triu(out, 1).T) / n


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many rows(x) there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, np.int64)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + matrix(batch.column("x"), dims).sum(0)
        yield pa.RecordBatch.from_arrays([lists(np.append(n, sums)[None, :])], ["sums"])

    parts = rows.select("x").mapInArrow(run, "sums array<long>").select(F.posexplode("sums").alias("i", "s"))
    found = {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dims)]


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """id, v: the vectors x less their mean."""
    shared = F.array(*[F.lit(int(s)).cast("long") for s in sums])
    return rows.select("id", F.zip_with("x", shared, lambda x, s: (n * x - s).cast("double") / n).alias("v"))


def _projected(rows: DataFrame, vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows(v) with w, the product of v and the matrix `vectors`."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = matrix(batch.column("v"), vectors.shape[0]) @ vectors
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists(w)], [*keep, "w"])

    return rows.select(*keep, "v").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "w array<double>"]))


def whiten(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE, block: int = ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of rows(vec_id, embedding), a row for each vector and component."""
    work = Workspace(rows.sparkSession, "whitening")
    clean = rows.select("vec_id", fixed_point(F.col("embedding"), SCALE, SHIFT).alias("x")).filter("size(x) > 0")
    lengths = clean.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    dims = most["dims"] if most else 1
    clean = clean.filter(F.size("x") == dims)
    fit = work.save(clean.select("x").distinct().select(F.monotonically_increasing_id().alias("id"), "x"), "fit")
    n, sums = column_sums(fit, dims)
    v = covariance(_centred(fit, n, sums), dims, n, work, "covariance", block, tile) if n else np.zeros((dims, dims))
    values, vectors = np.linalg.eigh(v)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST * max(np.trace(v), 1e-300)]
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(dict(rows.dtypes)["vec_id"])
    if not order:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = vectors[:, order] / np.sqrt(values[order])
    whitened_fit = _projected(_centred(fit, n, sums), scaled, ["id"]).select("id", F.col("w").alias("v"))
    identity = covariance(whitened_fit, len(order), n, work, "identity", block, tile)
    error = float(np.abs(identity - np.eye(len(order))).max())
    shared = F.array(*[F.lit(int(s)).cast("long") for s in sums])
    off = F.transform(F.zip_with("x", shared, lambda x, s: n * x - s), lambda d: d * d)
    told = clean.select("vec_id", F.aggregate(off, F.lit(0).cast("long"), lambda a, d: a + d).alias("deviation"), F.zip_with("x", shared, lambda x, s: (n * x - s).cast("double") / n).alias("v"))
    shares = F.array(*[F.lit(float(values[i] / np.trace(v))) for i in order])
    each = _projected(told, scaled, ["vec_id", "deviation"]).select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
