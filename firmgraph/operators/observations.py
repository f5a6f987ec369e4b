"""Raw observations as semi-structured values: read by paths with fallbacks, and put together as JSON again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(raw: Column) -> Column:
    """The VARIANT of a JSON text; null if it is none. It is parsed once, however many paths are read."""
    return F.try_parse_json(raw)


def at(value: Column, kind: str, *paths: str, default=None) -> Column:
    """The first of the paths that leads to a value of that kind, else the default; what is of another kind counts as missing."""
    found = [F.try_variant_get(value, p, kind) for p in paths]
    return F.coalesce(*found, *([] if default is None else [F.lit(default)]))


#: Where sources have what a candidate needs, the first place that has it.
PLACES = {
    "name": ("string", "$.name", "$.company.name", "$.title"),
    "city": ("string", "$.place.city", "$.city"),
    "employees": ("long", "$.observed.k", "$.employees"),
    "second_tag": ("string", "$.tags[1]"),
}


def merged_rows(raw: DataFrame, id: str, text: str, places: dict[str, tuple[str, ...]] = PLACES) -> DataFrame:
    """id, the fields of places, readable: raw observations as rows."""
    rows = raw.withColumn("__v", parsed(F.col(text)))
    return rows.select(id, *[at(F.col("__v"), *p).alias(c) for c, p in places.items()], F.col("__v").isNotNull().alias("readable"))


def rebuilt(rows: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """id, json: the fields of a row as one JSON object, nulls left out."""
    return rows.select(id, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def shape(raw: DataFrame, text: str) -> str:
    """The schema that all readable observations have in common, merged map-side."""
    return raw.select(parsed(F.col(text)).alias("v")).agg(F.schema_of_variant_agg("v")).first()[0]
