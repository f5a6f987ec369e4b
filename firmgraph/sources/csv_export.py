"""CSV for spreadsheets: labelled columns, quoting by RFC 4180, CRLF, and a byte-order mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column) -> Column:
    """A value as a CSV cell: empty for null, quoted if it holds a quote, comma or line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lines(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A line for each row."""
    return rows.select(F.concat_ws(",", *[cell(c) for c in columns.values()]).alias("line"))


def export(rows: DataFrame, columns: dict[str, Column], path: str, limit: int = 5000) -> None:
    """Write one file with a header; an export takes at most `limit` rows."""
    body = rows.limit(limit)
    head = rows.sparkSession.range(1).select(F.lit("﻿" + ",".join(columns)).alias("line"), F.lit(0).alias("part"))
    both = head.unionAll(lines(body, columns).withColumn("part", F.lit(1)))
    both.coalesce(1).sortWithinPartitions("part").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
