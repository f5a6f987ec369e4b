"""Temperature mixing of sources.

Each source's share p of all tokens is raised to an exponent and normalised: q = p^x / sum p^x. Exponent 1 keeps the natural
mix, 0 is uniform. The exponent is the largest whose entropy reaches the target; where a source would then be repeated more
often than the limit, it is raised until none is (to 1 at most: beyond that, no exponent meets the limit). Both are found by
section search: a pass over the table of sources evaluates SECTIONS exponents at once, and the next pass divides the section
that holds the answer.

A source's budget q * B is realised in whole passes over its documents and one partial pass. Documents are dealt to blocks
of about BLOCK_TOKENS tokens by a hash; each pass permutes the blocks by another hash. The partial pass takes blocks in
permuted order until the budget is used up, and of the block at the boundary the documents that still fit.

Nothing is collected but a row of sums for each pass. Prefix sums over the blocks of a source run in two levels, so that no
task holds all blocks of a large one, and documents are joined to blocks only by tables of a checked size, or by a shuffle.

Defined results: tokens are runs of non-space characters; null and empty texts have none and are used as often as their
block; a source without tokens has no budget and is left out; a null source is a source of its own; repeated rows are used
together; without any token the mix is empty; of clashing columns, the results replace those of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.llm.common import Workspace, broadcast_if_small

BLOCK_TOKENS, SECTIONS, PASSES, SEED, PER_GROUP = 1 << 16, 32, 5, 17, 512
TARGET_ENTROPY, MAX_REPEATS = 0.95, 4.0
RESULTS = ("tokens", "epoch", "block", "slot")


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"__key": _key(F.col("source")), "tokens": tokens(F.col("text")), "__h": F.xxhash64(F.lit(seed), "doc_id", "text")})


def _unit(h: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def find_exponent(totals: DataFrame, budget: float, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent for totals(tokens); target_entropy is a share of the logarithm of the number of sources."""
    n, total = totals.agg(F.count("*"), F.sum("tokens")).first()
    p = F.col("tokens") / F.lit(float(total))

    def at(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest number of repeats for each exponent."""
        sums = []
        for x in points:
            w = F.pow(p, F.lit(x))
            sums += [F.sum(w), F.sum(w * F.log(p)), F.max(w / F.col("tokens"))]
        row = totals.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
        return [(math.log(z) - x * e / z, budget * m / z) for x, z, e, m in zip(points, row[0::3], row[1::3], row[2::3])]

    def search(good, low: float, high: float) -> tuple[float, float]:
        """Narrow a section whose low end is good and whose high end is not."""
        for _ in range(PASSES):
            points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            fine = [good(*y) for y in at(points)]
            last = max([i for i, ok in enumerate(fine[:-1]) if ok], default=0)
            low, high = points[last], points[last + 1]
        return low, high

    exponent = 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(n)
        if at([1.0])[0][0] < goal - 1e-12:
            exponent = search(lambda h, _: h >= goal - 1e-12, 0.0, 1.0)[0]
    if max_repeats is not None and at([exponent])[0][1] > max_repeats + 1e-9:
        if at([1.0])[0][1] > max_repeats + 1e-9:
            return 1.0
        exponent = search(lambda _, r: r > max_repeats + 1e-9, exponent, 1.0)[1]
    return exponent


def mixing_plan(sized: DataFrame, work: Workspace, budget: int | None = None, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each source with tokens: __key, source_tokens, weight, budget, passes, rest, n_blocks."""
    totals = work.save(sized.groupBy("__key").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "totals")
    total = totals.agg(F.sum("tokens")).first()[0]
    if total is None:
        return totals.select("__key", F.col("tokens").alias("source_tokens"), F.lit(0.0).alias("weight"), *[F.lit(0).cast("long").alias(c) for c in ("budget", "passes", "rest", "n_blocks")])
    budget = total if budget is None else budget
    x = find_exponent(totals, float(budget), target_entropy, max_repeats)
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x))
    z = totals.agg(F.sum(power)).first()[0]
    weighed = totals.select("__key", F.col("tokens").alias("source_tokens"), (power / F.lit(z)).alias("weight"))
    weighed = weighed.withColumn("budget", F.floor(F.round(F.col("weight") * F.lit(float(budget)), 6)).cast("long"))
    passes = F.expr("budget div source_tokens")
    return work.save(weighed.withColumns({"passes": passes, "rest": F.col("budget") % F.col("source_tokens"), "n_blocks": F.ceil(F.col("source_tokens") / F.lit(block_tokens)).cast("long")}), "plan")


def _partial_pass(sized: DataFrame, plan: DataFrame, work: Workspace, seed: int) -> DataFrame:
    """__key, block, cut: of the blocks that the partial passes take, the largest document hash that still fits."""
    small = broadcast_if_small(plan.select("__key", "n_blocks", "passes", "rest"), 128)
    dealt = sized.join(small, "__key").withColumn("block", F.pmod("__h", F.col("n_blocks")))
    blocks = dealt.groupBy("__key", "block").agg(F.sum("tokens").alias("tokens"), F.first("n_blocks").alias("n_blocks"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    place = F.xxhash64(F.lit(seed), "__key", "block", "passes")
    blocks = blocks.withColumn("place", place).withColumn("group", F.floor(_unit(F.col("place")) * F.ceil(F.col("n_blocks") / PER_GROUP)))
    blocks = work.save(blocks, "blocks")
    groups = blocks.groupBy("__key", "group").agg(F.sum("tokens").alias("own"))
    before = Window.partitionBy("__key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = work.save(groups.select("__key", "group", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base")), "groups")
    within = Window.partitionBy("__key", "group").orderBy(F.shiftrightunsigned("place", 11), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(groups, ["__key", "group"])
    room = F.col("rest") - F.col("base") - F.col("inner")
    placed = work.save(placed.withColumn("room", room).filter("room > 0").select("__key", "block", "room", (F.col("tokens") <= F.col("room")).alias("whole")), "placed")
    edge = dealt.join(broadcast_if_small(placed.filter("NOT whole"), 64), ["__key", "block"])
    upto = Window.partitionBy("__key", "block").orderBy("__h").rangeBetween(Window.unboundedPreceding, 0)
    cuts = edge.withColumn("used", F.sum("tokens").over(upto)).filter("used <= room").groupBy("__key", "block").agg(F.max("__h").alias("cut"))
    return work.save(placed.filter("whole").select("__key", "block", F.lit((1 << 63) - 1).alias("cut")).unionAll(cuts), "cuts")


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as their source's budget has it: the columns of docs, and RESULTS.

    epoch counts a document's uses, block is its block; by slot (0 to 1), the whole mix stands in the order of training:
    every source is spread over it evenly, in the permuted order of its blocks.
    """
    work = Workspace(docs.sparkSession, "mix")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    sized = work.save(_sized(docs.select("doc_id", "source", "text"), seed).select("__key", "tokens", "__h"), "sized")
    plan = mixing_plan(sized, work, budget, target_entropy, max_repeats, block_tokens)
    cuts = _partial_pass(sized, plan, work, seed)
    used = _sized(docs, seed).join(broadcast_if_small(plan, 160), "__key").withColumn("block", F.pmod("__h", F.col("n_blocks")))
    used = used.join(broadcast_if_small(cuts, 96), ["__key", "block"], "left")
    times = F.col("passes") + F.when(F.col("__h") <= F.col("cut"), 1).otherwise(0)
    used = used.withColumn("__times", times).filter("__times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    length = F.when(F.col("epoch") < F.col("passes"), 1.0).otherwise(F.col("rest") / F.col("source_tokens"))
    slot = (F.col("epoch") + _unit(F.xxhash64(F.lit(seed), "__key", "block", "epoch")) * length) * F.col("source_tokens") / F.col("budget")
    return used.withColumn("slot", F.round(slot, 12)).select(*[F.col(f"`{c}`") for c in docs.columns], *RESULTS)
