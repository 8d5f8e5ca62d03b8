"""The operators on streams. What looks at one row only is the same expression; names need state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.headers import base_id, mate_suffix
from strandwork.operators import rename, sample
from strandwork.operators.mates import FIELDS

#: These take a streaming frame as they are: rows are filtered by their number, or joined to a fixed table of names.
proportion = sample.proportion


def renamed(lines: DataFrame, names: DataFrame, key, rewrite) -> DataFrame:
    """rename.apply() for a stream of lines and a fixed table of names."""
    return rename.apply(lines, names, key, rewrite)


def by_suffix(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both mates of a stream of records by the marker in their header; numbers aren't dense in a stream, so idx stays."""
    mate = mate_suffix(F.col("header"))
    return records.where(mate == 1), records.where(mate == 2)


def without_repeats(records: DataFrame) -> DataFrame:
    """The first record of each name, with a state of one entry a name that never goes."""
    return records.withColumn("id", base_id(F.col("header"))).dropDuplicates(["id"])


def paired(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Pairs of two streams by name. Who has no mate is only known when a stream ends, so orphans are not told here and
    unmatched records stay in state."""
    side = lambda df, k: df.select(base_id(F.col("header")).alias(f"id{k}"), F.col("idx").alias(f"i{k}"), *(F.col(c).alias(f"{c}{k}") for c in FIELDS))
    return side(r1, 1).join(side(r2, 2), F.col("id1") == F.col("id2")).drop("id2").withColumnRenamed("id1", "id")
