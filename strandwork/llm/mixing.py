"""Mixing sources to target weights by entropy balancing.

The targets are token totals per source. Inside a source they are shared out over size octaves in proportion, so that a
source keeps its mix of short and long documents. Each such stratum has one token constraint: the rates r of its
documents, at most `most`, should sum to sum(r * size) = target while staying as near to 1 as they can in entropy. The
dual is convex in one number a stratum; its maximiser gives exponentially tilted rates r = min(most, exp(lambda * z)),
z being the size in units of the stratum's mean. All strata take their Newton step together: one aggregate over
(stratum, size) counts a round. Rates become whole copies by carrying each document's rounding error on to the next,
longest first, in groups of bounded size: a source is one group or is dealt out to groups of thousands of its own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandwork.llm.common import WORD, apart, drop, written
from strandwork.llm.workers import begin

#: Rows, about, whose rounding errors are carried on together.
GROUP_ROWS = 4096
#: Newton rounds at most, and the largest miss of a constraint, as a share of its target, at which they end.
ROUNDS, CLOSE = 24, 1e-6


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, weigh `weights`, repeating.

    All tokens are shared out by weight; a target stops at `most` times its source's size and what it leaves goes to
    the others by weight. So there is a level at which target = min(most * source_size, level * weight): with sources
    in the order of most * source_size / weight, those before some point stop and the rest share what is left.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("stop") / F.col("weight"))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    target = F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))
    return ranked.select("source", "source_size", target.alias("target"))


def _octave(size: str = "size"):
    return F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int")


def dual(counts: DataFrame, most: float) -> tuple[DataFrame, str]:
    """(source, octave, mean, lam) solving the dual of each stratum of counts (source, octave, size, n, target, source_size)."""
    spark = counts.sparkSession
    strata = counts.groupBy("source", "octave").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("size") * F.col("n")) * F.first("target") / F.first("source_size")).alias("goal"),
        F.log(F.greatest(F.first("target") / F.first("source_size"), F.lit(1e-12))).alias("lam"),
    )
    strata, path = written(strata)
    for _ in range(ROUNDS):
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.col("lam") * z)
        held = F.col("size") * F.col("n")
        sums = (
            counts.select("source", "octave", "size", "n")
            .join(strata.withColumnRenamed("source", "s").withColumnRenamed("octave", "o"), F.col("source").eqNullSafe(F.col("s")) & (F.col("octave") == F.col("o")))
            .groupBy("source", "octave", "mean", "goal", "lam")
            .agg(F.sum(held * F.least(rate, F.lit(most))).alias("got"), F.sum(F.when(rate < most, held * z * rate).otherwise(0.0)).alias("slope"))
        )
        step = F.when(F.col("slope") > 0, (F.col("goal") - F.col("got")) / F.col("slope")).otherwise(0.0)
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))
        moved, next_path = written(sums.select("source", "octave", "mean", "goal", (F.col("lam") + step).alias("lam"), (F.abs(F.col("goal") - F.col("got")) / F.greatest(F.col("goal"), F.lit(1.0))).alias("miss")))
        worst = moved.agg(F.max("miss")).first()[0]
        drop(spark, path)
        strata, path = moved.drop("miss"), next_path
        if worst is None or worst <= CLOSE:
            break
    return strata.select("source", "octave", "mean", "lam"), path


def round_rates(sizes: np.ndarray, rates: np.ndarray, ties: np.ndarray, most: int) -> np.ndarray:
    """Whole copies, each rate's floor or the number above it, whose tokens follow the rates' running total."""
    copies = np.zeros(len(sizes), np.int64)
    owed = 0.0
    for i in np.lexsort((ties, -sizes)):
        low = np.floor(rates[i] + 1e-9)
        wish = rates[i] + (owed / sizes[i] if sizes[i] else 0.0)
        copies[i] = min(most, low if wish < low + 0.5 else low + (rates[i] > low))
        owed += (rates[i] - copies[i]) * sizes[i]
    return copies


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry_text: bool = True) -> DataFrame:
    """docs with size (words), source_size, target (of its source) and copies (0 to most), without texts if they aren't
    to be carried along.

    Null texts have size 0. A null source is a source of its own, the last. Repeated rows are documents of their own;
    ties go by a hash of the id, so runs agree. Documents without words keep one copy, which takes nothing. An empty
    table stays empty. The names size, source_size, target and copies are replaced if docs has them; other columns keep
    their names and values whatever they are called.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    names = docs.columns
    inner = apart(docs)
    doc_id, source, text = (inner.columns[names.index(c)] for c in (doc_id, source, text))
    mixed = _mix(inner, weights, most, doc_id, source, text, carry_text)
    back = dict(zip(inner.columns, names))
    return mixed.toDF(*[back.get(c, c) for c in mixed.columns])


def _mix(docs: DataFrame, weights: tuple[int, ...], most: int, doc_id: str, source: str, text: str, carry_text: bool) -> DataFrame:
    sized = docs.withColumn("size", word_count(text))
    small, small_path = written(sized.groupBy(F.col(source).alias("source"), "size").agg(F.count("*").alias("n")))
    # Groups by the source's own rows; those without words owe nothing and are dealt out apart.
    n_groups = lambda own: F.greatest(F.lit(1), F.ceil(F.sum(F.when(own, F.col("n"))) / GROUP_ROWS))
    groups = small.groupBy("source").agg(n_groups(F.col("size") > 0).alias("_groups"), n_groups(F.col("size") == 0).alias("_empty_groups"))
    wanted = targets(small.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    goals, goals_path = written(wanted.join(groups.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g"))
    same = F.col("source").eqNullSafe(F.col("s"))
    counts = small.where("size > 0").join(goals.withColumnRenamed("source", "s"), same).drop("s").withColumn("octave", _octave())
    counts, counts_path = written(counts)
    solved, _ = dual(counts, float(most))
    drop(docs.sparkSession, counts_path)
    if not carry_text:
        sized = sized.drop(text)
    rated = (
        sized.withColumn("_octave", _octave())
        .join(goals.withColumnRenamed("source", "_s"), F.col(source).eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .join(solved.withColumnsRenamed({"source": "_s", "octave": "_o"}), F.col(source).eqNullSafe(F.col("_s")) & (F.col("_octave") == F.col("_o")), "left")
        .withColumn("_rate", F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))).otherwise(1.0))
        .withColumn("_tie", F.xxhash64(F.col(doc_id)))
        .withColumn("_group", F.when(F.col("size") > 0, F.pmod("_tie", "_groups")).otherwise(-1 - F.pmod("_tie", "_empty_groups")))
        .withColumn("source_size", F.coalesce("source_size", F.lit(0)))
        .withColumn("target", F.coalesce("target", F.lit(0.0)))
        .drop("_octave", "_s", "_o", "mean", "lam", "_groups", "_empty_groups")
    )
    schema = T.StructType([f for f in rated.schema if f.name not in ("_rate", "_tie", "_group")] + [T.StructField("copies", T.LongType())])

    def copy(part: pd.DataFrame) -> pd.DataFrame:
        begin(None)
        n = round_rates(part["size"].to_numpy(), part["_rate"].to_numpy(), part["_tie"].to_numpy(), most)
        return part.drop(columns=["_rate", "_tie", "_group"]).assign(copies=n)

    return rated.groupBy(source, "_group").applyInPandas(copy, schema)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, whole and with all their columns as they were, each as often as the mix takes it. Nulls, repeated
    rows and empty tables are treated as mix() says."""
    inner = apart(docs)
    own = (inner.columns[docs.columns.index(c)] for c in (doc_id, source, text))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return _mix(inner, weights, most, *own, True).where("copies > 0").withColumn("_copy", copies).select(*inner.columns).toDF(*docs.columns)
