"""Changes to tables as new snapshots: inserts, replacements, conditional updates, retractions, constraint checks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def insert_absent(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those incoming rows whose key it lacks; of incoming rows with equal keys, one goes in."""
    fresh = incoming.dropDuplicates(keys)
    return table.unionByName(fresh.join(table.select(*keys), same_keys(fresh, table, keys), "left_anti"), allowMissingColumns=True)


def replace_matching(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows, and those of the table whose key does not occur among them."""
    return table.join(incoming.select(*keys).distinct(), same_keys(table, incoming, keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """New values where the condition holds; null conditions do not."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def update_stamped(table: DataFrame, condition: Column, stamp: str, now: Column, **values: Column) -> DataFrame:
    """update_where that also sets a stamp, in those rows of which a value really changes."""
    changed = reduce(lambda a, b: a | b, [~F.col(name).eqNullSafe(value) for name, value in values.items()])
    return update_where(table, condition & changed, **values, **{stamp: now})


def retract(table: DataFrame, condition: Column, columns: Iterable[str]) -> DataFrame:
    """Nulls in the columns where the condition holds."""
    types = dict(table.dtypes)
    return update_where(table, condition, **{c: F.lit(None).cast(types[c]) for c in columns})


def repeated_keys(table: DataFrame, keys: list[str], check: str) -> DataFrame:
    """check, key for each key that occurs more than once, as far as it has no null part."""
    known = table.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return known.select(F.lit(check).alias("check"), F.concat_ws("|", *keys).alias("key"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, check: str) -> DataFrame:
    """check, key for each child key that no parent has."""
    found = child.filter(F.col(child_key).isNotNull()).select(F.col(child_key).alias(parent_key)).join(parent.select(parent_key), parent_key, "left_anti")
    return found.select(F.lit(check).alias("check"), F.col(parent_key).cast("string").alias("key"))


def broken_rules(table: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """check, key for each row and rule that does not hold; a rule that is null holds."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return table.select(F.explode(failed).alias("check"), F.col(key).cast("string").alias("key"))


def missing_columns(table: DataFrame, required: dict[str, str]) -> list[str]:
    """Required columns that a table lacks or has with another type."""
    have = dict(table.dtypes)
    return sorted(c for c, kind in required.items() if have.get(c) != kind)
