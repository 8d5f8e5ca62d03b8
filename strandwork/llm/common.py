"""What several operators share: reading tables, written scratch tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.scratch import drop, shared_folder, written  # noqa: F401

#: Words are maximal runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def apart(df: DataFrame) -> DataFrame:
    """df with its columns named _c0, _c1 and so on, so that names made on the way clash with none of them."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the smallest node that its edges reach.

    Each round sends every node to the smallest of itself and its neighbours and renames the edges by that; edges that
    shrink to one node go. A path of links shrinks by a factor each round, a clique or star is done after two. All of
    it is joins and minima over the edges that are left, so no node's neighbours ever meet in one place.
    """
    spark = edges.sparkSession
    left = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
    left, path = written(left.where("a < b").distinct())
    names, names_path = None, None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        step, step_path = written(step.select("node", F.least("node", "low").alias("to")))
        new = (
            left.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        new, new_path = written(new)
        if names is None:
            names, next_path = step.select("node", F.col("to").alias("component")), step_path
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            names, next_path = written(
                names.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            )
            drop(spark, step_path, names_path)
        drop(spark, path)
        left, path, names_path = new, new_path, next_path
    drop(spark, path)
    return names if names is not None else edges.sparkSession.createDataFrame([], "node long, component long")
