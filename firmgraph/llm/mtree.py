"""Exact top-k by inner product: best-first search of a paged M-tree.

Inner products become distances: with M the greatest norm, x' = (x, sqrt(M^2 - |x|^2)) has norm M, q' = (q, 0), and
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x; so the highest products are the least distances, and the triangle inequality holds.

The tree. Equal vectors are one entry, with the k + 1 smallest ids of theirs, as no further one can be among the k best of any row.
A node is a row of a table: a leaf has at most PAGE entries with their distances to the node's routing vector; an inner
node has routing vectors with covering radii and their distances to the node's own. Nodes of more than PAGE entries are
split from the top: of each, about 2 n / PAGE entries (8 to FAN), told by a hash, become routing vectors, and each
entry goes to the nearest one. Rows travel in bundles with their node's routing vectors, so that a large node is split by many tasks. Every row is in the tree.

The search. Queries, equal ones once, go in blocks of neighbours through the tree. The frontier is a table of (block, node) with
the bound of each query for that node and its distance to the node's routing vector. In each round a block visits its most promising nodes,
four times as many as in the round before; of a node's entries, those whose stored distance to the routing vector already rules them out
for all queries are never computed; children come to the frontier with bounds from radii, entries of leaves to the block's
best k + 1. It ends when no bound reaches its query's last place. Nothing is approximate: bounds have slack for rounding, scores
are whole numbers (exact in doubles below 2^53, else computed as 64-bit integers).

How much is pruned is up to the data: of independent directions in many dimensions little can be, and each query meets most leaves, then as
products of blocks.

Defined results: vectors that are null or hold null or non-finite components take no part, shorter ones count as ending in
zeros; rows with null ids are candidates, after all others of equal score (an id of 2^63 - 1 stands for none), but no
queries; rows that repeat an id are rows of their own, of which a query leaves out one, itself; an empty table, or a query
that is the only row, has no results; further columns are not read. Components are below 2^31, products of norms below 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.llm.common import Workspace, broadcast_if_small
from firmgraph.llm.vectors import fixed_point, lists, matrix, padded

SCALE, K = 256, 5
PAGE, FAN, BUNDLE, BLOCK = 512, 256, 1024, 512
FIRST, STEP = 8, 4
NO_ID = (1 << 63) - 1
EXACT = 1 << 53
#: Of M: what rounding can make of a distance.
SLACK = 1e-6


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of a with those of b, whole numbers."""
    return a.astype(np.float64) @ b.astype(np.float64).T if exact else (a @ b.T)


def distances(dots: np.ndarray, na: np.ndarray, nb: np.ndarray, top: int) -> np.ndarray:
    """Distances of x' and y', out of products and squared norms of x and y."""
    lift = np.sqrt(np.maximum(top - na.astype(np.float64), 0))[:, None] * np.sqrt(np.maximum(top - nb.astype(np.float64), 0))[None, :]
    return np.sqrt(np.maximum(2.0 * top - 2.0 * (dots + lift), 0))


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """x, ids: each vector once, with the k + 1 smallest ids."""
    first = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    return rows.withColumn("rn", first).filter(F.col("rn") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


ENTRY = "array<struct<id: long, x: array<long>, ids: array<long>, dist: double>>"


def _assign(bundles: DataFrame, dims: int, top: int) -> DataFrame:
    """cell, id, x, ids, dist: the entries of bundles(cell, rows, pivots) with the nearest pivot's cell and their distance to it."""
    exact = top < EXACT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, pivots, cell = batch.column("rows")[i].values, batch.column("pivots")[i].values, batch.column("cell")[i].as_py()
                x = matrix(rows.field("x"), dims)
                if pivots is None or not len(pivots):  # no entry was chosen: once more with another hash
                    at, near, names = np.zeros(len(x), int), rows.field("dist").to_numpy(), [cell]
                else:
                    p = matrix(pivots.field("x"), dims)
                    d = distances(products(x, p, exact), squares(x), squares(p), top)
                    at = d.argmin(1)
                    near, names = d[np.arange(len(x)), at], [f"{cell}/{j}" for j in range(len(p))]
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(at)), rows.field("id"), rows.field("x"), rows.field("ids"), pa.array(near)], ["cell", "id", "x", "ids", "dist"])

    return bundles.mapInArrow(run, "cell string, id long, x array<long>, ids array<long>, dist double")


def build(vectors: DataFrame, work: Workspace, dims: int, top: int, page: int = PAGE, fan: int = FAN) -> DataFrame:
    """The nodes of a tree over vectors(x, ids); the root is named r.

    A node: node, leaf, n, child (array<string>), x (array<long>, one after the other), dist, radius (array<double>), ids (array<array<long>>).
    """
    rows = work.save(vectors.select(F.lit("r").alias("cell"), F.monotonically_increasing_id().alias("id"), "x", "ids", F.lit(0.0).alias("dist")), "level-0")
    sizes = work.save(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")), "sizes-0")
    columns = lambda e, child, radius: (F.transform(e, child).alias("child"), F.flatten(F.transform(e, lambda s: s["x"])).alias("x"), F.transform(e, lambda s: s["dist"]).alias("dist"), F.transform(e, radius).alias("radius"), F.transform(e, lambda s: s["ids"]).alias("ids"))
    nodes, level = [], 0
    while True:
        held = rows.join(broadcast_if_small(sizes, 64), "cell")
        packed = held.filter(F.col("n") <= page).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("id", "x", "ids", "dist"))).alias("e"))
        nodes.append(work.save(packed.select(F.col("cell").alias("node"), F.lit(True).alias("leaf"), F.size("e").alias("n"), *columns(F.col("e"), lambda s: F.lit(None).cast("string"), lambda s: F.lit(0.0))), f"leaves-{level}"))
        if not sizes.filter(F.col("n") > page).limit(1).count():
            break
        big = held.filter(F.col("n") > page)
        wanted = F.greatest(F.lit(8.0), F.least(F.lit(float(fan)), 2 * F.col("n") / page))
        chosen = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < (1 << 30) * wanted / F.col("n")
        entry = F.array_sort(F.collect_list(F.struct("id", "x", "ids", "dist")))
        pivots = work.save(big.filter(chosen).groupBy("cell").agg(entry.alias("pivots")), f"pivots-{level}")
        bundles = big.groupBy("cell", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BUNDLE)).alias("part")).agg(F.collect_list(F.struct("id", "x", "ids", "dist")).alias("rows"))
        joined = bundles.join(broadcast_if_small(pivots, fan * dims * 9), "cell", "left").select("cell", "rows", F.coalesce("pivots", F.array().cast(ENTRY)).alias("pivots"))
        rows = work.save(_assign(joined, dims, top), f"level-{level + 1}", batch=4)
        sizes = work.save(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")), f"sizes-{level + 1}")
        # the radius of a child is known now that its entries are
        each = pivots.select("cell", F.posexplode("pivots").alias("j", "p")).withColumn("child", F.concat_ws("/", "cell", "j"))
        met = each.join(broadcast_if_small(sizes, 64), each["child"] == sizes["cell"]).select(each["cell"], "child", "p", "radius")
        inner = met.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("child", F.col("p.x").alias("x"), F.col("p.dist").alias("dist"), "radius", F.array().cast("array<long>").alias("ids")))).alias("e"))
        nodes.append(work.save(inner.select(F.col("cell").alias("node"), F.lit(False).alias("leaf"), F.size("e").alias("n"), *columns(F.col("e"), lambda s: s["child"], lambda s: s["radius"])), f"inner-{level}"))
        work.drop(f"level-{level}")
        level += 1
    return reduce(DataFrame.unionAll, nodes)


def visit(q: np.ndarray, last: np.ndarray, bound: np.ndarray, to_node: np.ndarray, x: np.ndarray, dist: np.ndarray, radius: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What queries q with last places `last` find in a node: indices of queries and of entries that were computed, and their products and bounds.

    bound, to_node: of each query, for the node and to its routing vector. An entry's bound is -inf where it is ruled out.
    """
    active = np.flatnonzero(bound >= last)
    qn = squares(q[active]).astype(np.float64)[:, None]
    slack = SLACK * math.sqrt(top)
    most = lambda low: (qn + top - np.maximum(low - slack, 0) ** 2) / 2 + 1e-9 * top + 1e-3
    known = most(np.abs(to_node[active][:, None] - dist[None, :]) - radius[None, :])
    computed = np.flatnonzero((known >= last[active][:, None]).any(0))
    dots = products(q[active], x[computed], top < EXACT)
    d = np.sqrt(np.maximum(qn + top - 2.0 * dots, 0))
    return active, computed, dots, np.stack([np.minimum(most(d - radius[computed][None, :]), known[:, computed]), d])


def _visits(met: DataFrame, dims: int, top: int, k: int) -> DataFrame:
    """Children and candidates of visits(block, q, last, bound, to_node and a node's columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "i", "score", "vec_id", "node", "bound", "to_node"]
        for batch in batches:
            get = lambda c, i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                block, leaf = batch.column("block")[i].as_py(), batch.column("leaf")[i].as_py()
                q, x, last = get("q", i).reshape(-1, dims), get("x", i).reshape(-1, dims), get("last", i)
                active, computed, dots, (bounds, d) = visit(q, last, get("bound", i), get("to_node", i), x, get("dist", i), get("radius", i), top)
                if not len(active) or not len(computed):
                    continue
                if leaf:
                    least = last[active]
                    if dots.shape[1] > k:
                        least = np.maximum(least, np.partition(dots, dots.shape[1] - k, axis=1)[:, -k])
                    row, col = np.nonzero(dots >= least[:, None])
                    ids = batch.column("ids")[i].values
                    n = np.diff(ids.offsets.to_numpy())
                    first, values = ids.offsets.to_numpy()[:-1], ids.values.to_numpy(zero_copy_only=False)
                    times = n[computed[col]]
                    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[computed[col]], times)
                    m = len(at)
                    cells = [pa.array(np.full(m, block)), pa.array(np.repeat(active[row], times).astype(np.int32)), pa.array(np.repeat(dots[row, col], times).astype(np.int64)), pa.array(values[at])]
                    yield pa.RecordBatch.from_arrays([*cells, *(pa.nulls(m, t) for t in (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names)
                else:
                    good = np.flatnonzero((bounds >= last[active][:, None]).any(0))
                    whole = np.full((2, len(good), len(q)), -np.inf)
                    whole[0][:, active], whole[1][:, active] = bounds[:, good].T, d[:, good].T
                    m = len(good)
                    children = batch.column("child")[i].values.take(pa.array(computed[good]))
                    cells = [pa.array(np.full(m, block)), *(pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64())), children]
                    yield pa.RecordBatch.from_arrays([*cells, lists(whole[0]), lists(whole[1])], names)

    return met.select("block", "q", "last", "bound", "to_node", "leaf", "child", "x", "dist", "radius", "ids").mapInArrow(run, "block long, i int, score long, vec_id long, node string, bound array<double>, to_node array<double>")


def _blocks(queries: DataFrame, root: DataFrame, dims: int, top: int, block: int) -> DataFrame:
    """block, qids, q: blocks of queries(qid, x) of which those with the same nearest routing vector of the root stand together."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, p = matrix(batch.column("qx")[i].values, dims), batch.column("x")[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims)
                dots = products(x, p, top < EXACT)
                yield pa.RecordBatch.from_arrays([batch.column("qids")[i].values, batch.column("qx")[i].values, pa.array(dots.argmax(1) if len(p) else np.zeros(len(x), np.int64))], ["qid", "x", "near"])

    parts = queries.groupBy(F.expr(f"qid div {BUNDLE}").alias("part")).agg(F.collect_list(F.struct("qid", "x")).alias("e"))
    fed = parts.select(F.transform("e", lambda s: s["qid"]).alias("qids"), F.transform("e", lambda s: s["x"]).alias("qx"), F.lit("r").alias("node")).join(F.broadcast(root.select("node", "x")), "node")  # one row
    placed = fed.mapInArrow(nearest, "qid long, x array<long>, near long")
    # a region's queries in a row, cut into blocks; a large region is cut by a hash before
    sizes = placed.groupBy("near").agg(F.count("*").alias("n"))
    cut = placed.join(F.broadcast(sizes), "near").withColumn("part", F.pmod(F.xxhash64("qid"), F.ceil(F.col("n") / block)))
    small = F.col("n") < block // 4
    # regions of few queries share blocks, by their turn
    key = F.when(small, F.expr("near div 8")).otherwise(-1 - F.col("near"))
    return cut.groupBy(key.alias("near"), "part").agg(F.collect_list(F.struct("qid", "x")).alias("e")).select(F.monotonically_increasing_id().alias("block"), F.transform("e", lambda s: s["qid"]).alias("qids"), F.flatten(F.transform("e", lambda s: s["x"])).alias("q"))


def search(nodes: DataFrame, queries: DataFrame, work: Workspace, dims: int, top: int, k: int, block: int = BLOCK) -> DataFrame:
    """qid, score, vec_id: the k best rows of the tree for each of queries(qid, x), all if fewer; of equal scores those with smaller ids."""
    root = work.save(nodes.filter(F.col("node") == "r"), "root")
    blocks = work.save(_blocks(queries, root, dims, top, block), "blocks", batch=16)
    m = F.size("qids")
    same = lambda v: F.array_repeat(F.lit(v), m)
    frontier = work.save(blocks.select("block", F.lit("r").alias("node"), F.lit(0.0).alias("best"), same(float("inf")).alias("bound"), same(0.0).alias("to_node")), "frontier-0")
    best, last = None, blocks.select("block", same(float("-inf")).alias("last"))
    turn, visits = 0, FIRST
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("best"), "node"))
    while frontier.limit(1).count():
        turned = work.save(frontier.withColumn("turn", rank).filter(F.col("turn") <= visits).drop("turn"), f"turn-{turn}")
        needed = nodes.join(broadcast_if_small(work.save(turned.select("node").distinct(), f"nodes-{turn}"), 64), "node", "left_semi")
        met = turned.drop("best").join(needed, "node").join(broadcast_if_small(blocks.join(last, "block").select("block", "q", "last"), block * (dims + 1) * 8), "block")
        found = work.save(_visits(met, dims, top, k), f"found-{turn}", batch=4)
        hits = found.filter(F.col("node").isNull()).select("block", "i", "score", "vec_id")
        place = F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("score"), "vec_id"))
        best = work.save((hits if best is None else best.unionAll(hits)).withColumn("place", place).filter(F.col("place") <= k).drop("place"), f"best-{turn}")
        full = best.groupBy("block", "i").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("last")).filter(F.col("n") == k)
        lasts = full.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", "last"))).alias("lasts"))
        at = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.coalesce(F.try_element_at("lasts", i), F.lit(float("-inf"))))
        last = work.save(blocks.join(lasts, "block", "left").select("block", F.coalesce(at, same(float("-inf"))).alias("last")), f"last-{turn}")
        new = frontier.drop("best").join(turned.select("block", "node"), ["block", "node"], "left_anti").unionAll(found.filter(F.col("node").isNotNull()).select("block", "node", "bound", "to_node"))
        # by how much a query's last place can be beaten; negative where it cannot
        hope = F.array_max(F.zip_with("bound", "last", lambda b, s: F.when(b >= s, b - F.greatest(s, F.lit(-1.0 - top)))))
        frontier = work.save(new.join(last, "block").withColumn("best", hope).filter(F.col("best") >= 0).select("block", "node", "best", "bound", "to_node"), f"frontier-{turn + 1}")
        for name in (f"frontier-{turn}", f"turn-{turn}", f"nodes-{turn}", f"found-{turn}", f"best-{turn - 1}", f"last-{turn - 1}"):
            work.drop(name)
        turn, visits = turn + 1, visits * STEP
    if best is None:
        return queries.select("qid", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("vec_id")).limit(0)
    names = blocks.select("block", F.posexplode("qids").alias("i", "qid"))
    return best.join(names, ["block", "i"]).select("qid", "score", "vec_id")


def top_k(rows: DataFrame, queries: Column, k: int = K, scale: int = SCALE, page: int = PAGE, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each of rows(vec_id, embedding) that `queries` tells, the k others with the highest inner product."""
    spark = rows.sparkSession
    work = Workspace(spark, "mtree")
    clean = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), queries.alias("asks"), fixed_point(F.col("embedding"), scale).alias("x")).filter("x IS NOT NULL")
    dims, top = clean.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v))).first()
    dims, top = dims or 0, top or 0
    if not dims:
        dims = 1
    clean = padded(clean, dims)
    nodes = build(distinct(clean.select("vec_id", "x"), k), work, dims, top, page, fan)
    asked = clean.filter(F.col("asks") & (F.col("vec_id") != NO_ID)).select("vec_id", "x")
    kinds = work.save(asked.select("x").distinct().select(F.monotonically_increasing_id().alias("qid"), "x"), "queries")
    found = work.save(search(nodes, kinds, work, dims, top, k + 1, block), "results")
    answers = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("hits"))
    own = F.struct((-F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)).alias("less"), F.col("vec_id").alias("vec_id"))
    # its own row once; of equal ids with its score any one, as they show the same
    listed = work.save(asked.join(kinds, "x").join(answers, "qid").withColumn("at", F.array_position("hits", own)), "listed")
    others = F.when(F.col("at") > 0, F.filter("hits", lambda h, i: i != F.col("at") - 1)).otherwise(F.col("hits"))
    each = listed.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("i", "h"))
    return each.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.nullif(F.col("h.vec_id"), F.lit(NO_ID)).alias("vec_id"), (-F.col("h.less")).alias("score"))
