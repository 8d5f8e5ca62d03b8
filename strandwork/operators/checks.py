"""Errors, finding the first row that breaks a rule, and gapless numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.scratch import written

#: Width of the spans of numbers that are looked at together.
SPAN = 100_000


class DataError(ValueError):
    """The input breaks a rule that the operator relies on."""


def first(df: DataFrame, breaks: Column, *keys: str) -> Row | None:
    """Of the rows that break a rule the first by keys: one aggregate, one row to the driver."""
    rest = [c for c in df.columns if c not in keys]
    found = df.where(breaks).agg(F.min_by(F.struct(*keys, *rest), F.struct(*keys)).alias("row")).first()
    return found["row"]


def span_of(key: str) -> Column:
    return F.floor(F.col(key) / F.lit(SPAN)).cast("bigint")


def carried(spans: DataFrame, values: dict[str, Column]) -> DataFrame:
    """spans, one row for each _span, with each of values over the spans before it. A span stands for thousands of rows,
    so this one ordered pass is over few."""
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    return spans.select("_span", *(v.over(before).alias(name) for name, v in values.items()))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a gapless 0-based number in the order of the whole number `key`, which no two rows share.

    Rows are numbered in spans of the key and moved up by the counts of the spans before. Both come from the data alone,
    so a repeated task gives the same numbers.
    """
    spanned = df.withColumn("_span", span_of(key))
    counts = spanned.groupBy("_span").agg(F.count("*").alias("n"))
    starts = carried(counts, {"_start": F.sum("n")})
    local = spanned.withColumn("_n", F.row_number().over(Window.partitionBy("_span").orderBy(key)))
    return local.join(starts, "_span").withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_n") - 1).drop("_span", "_start", "_n")


def dense(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """df with a gapless 0-based number by any order, without putting all rows into one task: rows are sorted over ranges,
    numbered within their range, and moved up by the counts of the ranges before, of which there are few.

    Range bounds are drawn anew whenever the sort runs, so the ranged rows are written once and counted and read there.
    """
    spark = df.sparkSession
    keyed = df.select("*", F.struct(*order).alias("_order"))
    ranged = keyed.repartitionByRange(F.col("_order")).sortWithinPartitions("_order").drop("_order")
    ranged, _ = written(ranged.withColumn("_place", F.monotonically_increasing_id()))  # task << 33 | row in it
    part = F.shiftright("_place", 33)
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())  # one row a task
    starts, total = [], 0
    for task, n in counts:
        starts.append((task, total - (task << 33)))
        total += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("bigint")).limit(0)
    moved = F.broadcast(spark.createDataFrame(starts, "_part long, _moved long"))
    return ranged.join(moved, part == F.col("_part")).withColumn(name, F.col("_place") + F.col("_moved")).drop("_part", "_moved", "_place")
