"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of UTF-8 bytes. Blocks are sorted by a 128-bit fingerprint, and each
distinct block gets an integer name. Adjacent pairs of names are sorted and named in turn, level by level, until a
document has one name. Two documents have the same (level, name) exactly if their texts have the same bytes:

* names of pairs are given to the pairs themselves, so they cannot collide;
* names of blocks are given to fingerprints, after comparing the bytes: if the smallest and the largest block with a
  fingerprint differ, all blocks are fingerprinted anew with another seed.

Only block fingerprints and names are moved by document; the bytes are moved once, after map-side aggregation, for that
comparison. Groups of copies of any size are handled by aggregates and joins that Spark can split.

Defined results: a null text counts as empty; empty texts are equal to each other; rows that repeat both doc_id and text
stay separate rows of the group report, and one of them stays in the filter; a null doc_id is an ordinary row, which
stays only if no row of its group has a doc_id; an empty table gives an empty result; other columns are never read by the
report and pass through the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.llm.common import Workspace

BLOCK_BYTES = 4096


def fingerprint(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, sha, n (blocks of the text), pos, block."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    n = F.greatest(F.ceil(F.octet_length(F.col("raw")) / block_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    parts = docs.select("doc_id", raw.alias("raw")).withColumn("n", n).select("doc_id", F.sha2("raw", 256).alias("sha"), "n", cut.alias("cut"))
    return parts.select("doc_id", "sha", "n", F.posexplode("cut").alias("pos", "block"))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """An integer name for each row, by the order of the keys within each hash partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_identities(docs: DataFrame, work: Workspace, block_bytes: int = BLOCK_BYTES, prints: Callable = fingerprint) -> DataFrame:
    """doc_id, sha, level, name: one row per distinct (doc_id, text); equal (level, name) means equal text."""
    blocks = _blocks(docs, block_bytes)
    for seed in range(1000):
        h1, h2 = prints(F.col("block"), seed)
        marked = blocks.select("doc_id", "sha", "n", "pos", h1.alias("h1"), h2.alias("h2"), "block")
        compared = marked.groupBy("h1", "h2").agg((F.min("block") != F.max("block")).alias("clash"))
        names = work.save(_numbered(compared, ["h1", "h2"]), f"names0-{seed}")
        if not names.filter("clash").limit(1).count():
            break
    else:
        raise ValueError("no seed names the blocks apart")
    level = 0
    current = marked.drop("block").join(names.drop("clash"), ["h1", "h2"]).select("doc_id", "sha", "pos", "n", "name")
    current = work.save(current.groupBy("doc_id", "sha", "pos").agg(F.first("n").alias("n"), F.first("name").alias("name")), "named0")
    done = []
    while True:
        done.append(current.filter("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = current.filter("n > 1")
        if not rest.limit(1).count():
            break
        level += 1
        half = F.col("pos") % 2
        pairs = rest.groupBy("doc_id", "sha", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.ceil(F.first("n") / 2).cast("int").alias("n"),
            F.max(F.when(half == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = work.save(pairs, f"pairs{level}")
        names = work.save(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), f"names{level}")
        current = work.save(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "pos", "n", "name"), f"named{level}")
    found = done[0]
    for x in done[1:]:
        found = found.unionAll(x)
    return found


def group_report(docs: DataFrame, block_bytes: int = BLOCK_BYTES, prints: Callable = fingerprint) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    work = Workspace(docs.sparkSession, "exact")
    docs = docs.select("doc_id", "text")
    named = block_identities(docs, work, block_bytes, prints)
    heads = docs.select(F.col("doc_id").alias("id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_sha256") == F.col("sha"))
    rows = work.save(heads.join(named, same).select("doc_id", "text_sha256", "level", "name"), "rows")
    groups = work.save(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts that with the largest doc_id, once."""
    work = Workspace(docs.sparkSession, "exact-kept")
    kept = work.save(group_report(docs, block_bytes).filter("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count("*").alias("__n")), "kept")
    own = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)
    found = docs.withColumn("__own", own).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")))
    if kept.filter("__n > 1").limit(1).count():
        found = found.dropDuplicates(["__id", "__sha"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
