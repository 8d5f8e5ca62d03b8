"""Renaming sequences through a table of names: a left join on the key of each line, many lines to one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.headers import fasta_key, fasta_line, gff_key, gff_line, trimmed
from strandwork.operators.checks import DataError, first

#: Names up to which the table is sent to every task.
BROADCAST_NAMES = 1_000_000


def parse_names(lines: DataFrame) -> DataFrame:
    """(old, new) from lines (line_no, value) of new and old name; blank lines are skipped, further columns ignored, and
    of a repeated old name the last counts. A line of one column is an error. # is no comment."""
    parts = lines.select("line_no", F.split(trimmed(F.col("value")), r"(?U)\s+").alias("p"), "value").where(trimmed(F.col("value")) != "")
    if bad := first(parts, F.size("p") < 2, "line_no"):
        raise DataError(f"name file line {bad['line_no']}: expected 2 columns, got: {bad['value']!r}")
    return last_wins(parts.select("line_no", F.col("p")[1].alias("old"), F.col("p")[0].alias("new")))


def last_wins(names: DataFrame) -> DataFrame:
    """(old, new) from (line_no, old, new)."""
    return names.groupBy("old").agg(F.max_by("new", "line_no").alias("new"))


def apply(lines: DataFrame, names: DataFrame, key: Callable[[Column], Column], rewrite: Callable[[Column, Column], Column]) -> DataFrame:
    """lines with value trimmed and rewritten by rewrite(line, new name or null). names: (old, new), one row per old.
    The extension point for other line formats."""
    known = names.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    if known.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        known = F.broadcast(known)
    lines = lines.withColumn("value", trimmed(F.col("value")))
    joined = lines.join(known, key(F.col("value")) == F.col("_old"), "left")
    return joined.withColumn("value", rewrite(F.col("value"), F.col("_new"))).drop("_old", "_new")


def fasta(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Header lines get their new name, or keep the old; descriptions go. Other lines stay."""
    return apply(lines, names, fasta_key, fasta_line)


def gff(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines other than comments get the new name of their first column where there is one."""
    return apply(lines, names, gff_key, gff_line)
