"""Search plans: terms of topics, shards, and several lists dealt in turn. Plans are small: criteria times a fixed taxonomy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.operators.resolve import Saved, placed


def running_sums(rows: DataFrame, order: list, value: str, into: str = "running") -> DataFrame:
    """rows with the sum of `value` up to each row in an order, without a task that sees all rows.

    Rows are dealt by ranges of the order; a range starts with the sum of those before it (a row for each range), and sums run within ranges.
    The order must tell rows apart. Nulls count as 0.
    """
    saved = Saved(rows.sparkSession, "running")
    parts = saved.save(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    # a row for each range
    sizes = parts.groupBy("__part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    starts = sizes.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(starts), "__part").withColumn(into, F.col("__start") + within).drop("__part", "__start")


def within_budget(rows: DataFrame, order: list, cost: str, budget, used=0) -> DataFrame:
    """The rows that run, in order, until the budget is used up; what was refunded costs nothing again, as its cost is negative or null."""
    return running_sums(rows, order, cost).filter(F.col("running") + used <= budget).drop("running")


def search_terms(words: DataFrame, most: int) -> DataFrame:
    """term, rank, topic: the first distinct terms of each topic of words(topic, word, ord)."""
    terms = words.groupBy("topic", F.concat_ws(" ", "word", "topic").alias("term")).agg(F.min("ord").alias("ord"))
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("ord", "term")))
    return ranked.filter(F.col("rank") <= most).select("term", "rank", "topic")


def shards(cities: DataFrame, kinds: DataFrame, most: int) -> DataFrame:
    """shard, city, kind: each city(city, city_ord) with each kind(kind, kind_ord), row by row, the first `most`. The lists are dimensions of a few rows."""
    pairs = cities.crossJoin(kinds).withColumn("shard", (F.row_number().over(Window.orderBy("city_ord", "kind_ord")) - 1))
    return pairs.filter(F.col("shard") < most).select("shard", "city", "kind")


def interleave(ranked: DataFrame, source: str) -> DataFrame:
    """Rows with id q0, q1, ...: the first of each source, then the second of each, and so on."""
    return placed(ranked, "rank", source).withColumn("id", F.concat(F.lit("q"), F.col("place").cast("string"))).drop("place")


def next_batch(plan: DataFrame, done: DataFrame, cost: str, budget: float) -> DataFrame:
    """The rows of a plan(seq, id, ...) that are not done and fit what the done ones left of a budget, in order."""
    used = plan.join(done.select("id"), "id", "left_semi").agg(F.coalesce(F.sum(cost), F.lit(0.0))).first()[0]
    return within_budget(plan.join(done.select("id"), "id", "left_anti"), ["seq"], cost, budget, used)


def scaled_budget(budget: dict[str, int], requested: int) -> dict[str, int]:
    """A run's limits for a number of wanted companies: several candidates and checks for each, within the given limits."""
    wanted = {"provider_requests": max(12, math.ceil(requested * 0.8)), "candidates": max(40, requested * 4), "verification_requests": max(40, requested * 12)}
    return {**budget, **{k: min(budget[k], n) for k, n in wanted.items()}}


def phase(runs: DataFrame, overshoot: int = 4) -> DataFrame:
    """The next phase of runs(run_id, requested, found, planned, executed, waiting, verified, promoted) and, when done, how they ended."""
    c = F.col
    enough = c("found") >= c("requested") * overshoot
    now = F.when(~enough & (c("executed") < c("planned")), "discovering").when(c("waiting") > 0, "verifying").when(c("promoted") < F.least("verified", "requested"), "promoting").otherwise("done")
    return runs.withColumn("phase", now).withColumn("status", F.when(c("phase") == "done", F.when(c("promoted") >= c("requested"), "completed").otherwise("partially_completed")).otherwise("running"))


def provider_stats(queries: DataFrame, results: DataFrame, budget: float) -> DataFrame:
    """By provider: requests made within the budget, failed ones, results, and how many of them are new.

    queries(seq, id, provider, cost, failed) run in order until the budget is used up; results(id, key) are new where no
    earlier query that ran has found the key. A failed query costs, but stops nothing.
    """
    ran = within_budget(queries, ["seq"], "cost", budget)
    first = results.join(ran.filter("NOT failed").select("id", "seq"), "id").groupBy("key").agg(F.min("seq").alias("seq")).groupBy("seq").agg(F.count("*").alias("fresh"))
    found = results.groupBy("id").agg(F.countDistinct("key").alias("n"))
    rows = ran.join(found, "id", "left").join(first, "seq", "left").withColumns({"n": F.when(F.col("failed"), 0).otherwise(F.coalesce("n", F.lit(0))), "fresh": F.coalesce("fresh", F.lit(0))})
    return rows.groupBy("provider").agg(F.count("*").alias("requests"), F.count_if("failed").alias("failed"), F.sum("n").alias("results"), F.sum("fresh").alias("new"), (F.sum("n") - F.sum("fresh")).alias("duplicates"))
