"""Pairing by position: zip, interleave, de-interleave, rescue."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.headers import base_id, mate_suffix, violation
from strandwork.operators.checks import DataError, first, numbered

FIELDS = ("header", "seq", "plus", "qual")
#: Records that tell the layout of a merged file.
PROBE = 4096
#: Why some layouts need a file.
ONCE = "{}, but a pipe can only be read once; name a file, or pass --layout interleaved or by-suffix if the file has it"

log = logging.getLogger("strandwork")


def _side(df: DataFrame, side: int) -> DataFrame:
    return df.select("idx", *(F.col(c).alias(f"{c}{side}") for c in FIELDS if c in df.columns), F.lit(True).alias(f"there{side}"))


def zipped(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """idx, both sides' fields, and status: pair, count_mismatch or id_mismatch."""
    both = _side(r1, 1).join(_side(r2, 2), "idx", "full_outer")
    status = F.when(F.col("there1").isNull() | F.col("there2").isNull(), "count_mismatch")
    status = status.when(base_id(F.col("header1")) != base_id(F.col("header2")), "id_mismatch").otherwise("pair")
    return both.withColumn("status", status).drop("there1", "there2")


def require_mates(r1: DataFrame, r2: DataFrame, check: bool = True) -> None:
    """Raises where two files aren't mates row by row. Counts must agree even unchecked."""
    heads = zipped(r1.select("idx", "header"), r2.select("idx", "header"))
    bad = F.col("status") == "count_mismatch" if not check else F.col("status") != "pair"
    if row := first(heads, bad, "idx"):
        if row["status"] == "id_mismatch":
            raise DataError(
                f"read 1/2 desync at pair #{row['idx']}: IDs {_name(row['header1'])!r} vs {_name(row['header2'])!r} do not match; "
                "files are not properly paired (pass --no-pair-check to override)"
            )
        raise DataError(f"read 1/2 have different numbers of reads (mismatch detected at pair #{row['idx']}); files are not properly paired")


def _name(header: str) -> str:
    """base_id() of one header, for messages."""
    bare = header.removeprefix("@")
    token = (bare.split() or [bare])[0]
    return token[:-2] if token.endswith(("/1", "/2")) else token


def interleave(r1: DataFrame, r2: DataFrame, check: bool = True) -> DataFrame:
    """Records of both sides in turn: idx is 2 * idx + side."""
    require_mates(r1, r2, check)
    return interleaved(r1, r2)


def interleaved(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """interleave() of files known to be mates: no join is needed, each side knows its places."""
    one = r1.select((F.col("idx") * 2).alias("idx"), *FIELDS)
    two = r2.select((F.col("idx") * 2 + 1).alias("idx"), *FIELDS)
    return one.union(two)


def probe(df: DataFrame) -> DataFrame:
    """One row on the first PROBE records: records, all_have_marker, pairs_share_id (of complete adjacent pairs)."""
    head = df.where(F.col("idx") < PROBE)
    pairs = head.groupBy((F.col("idx") / 2).cast("bigint").alias("pair")).agg(
        F.count("*").alias("n"),
        F.bool_and(mate_suffix(F.col("header")).isNotNull()).alias("marked"),
        (F.min(base_id(F.col("header"))) == F.max(base_id(F.col("header")))).alias("same"),
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.bool_and("marked"), F.lit(False)).alias("all_have_marker"),
        F.coalesce(F.bool_and(F.when(F.col("n") == 2, F.col("same"))), F.lit(False)).alias("pairs_share_id"),
    )


def hypotheses(df: DataFrame) -> DataFrame:
    """One row: records, and the first pair at which each layout fails, or null where it holds."""
    n = df.agg(F.count("*").alias("n"))
    ids = df.select("idx", base_id(F.col("header")).alias("id")).crossJoin(F.broadcast(n))  # one row
    near = ids.groupBy((F.col("idx") / 2).cast("bigint").alias("i")).agg((F.min("id") != F.max("id")).alias("bad"))
    half = (F.col("n") / 2).cast("bigint")
    far = ids.groupBy((F.col("idx") % F.greatest(half, F.lit(1))).alias("i")).agg((F.min("id") != F.max("id")).alias("bad"))
    first_bad = lambda d, name: d.agg(F.min(F.when(F.col("bad"), F.col("i"))).alias(name))
    return n.crossJoin(first_bad(near, "interleaved_fails")).crossJoin(first_bad(far, "concat_fails"))


def layout_of(df: DataFrame, rereadable: bool = True) -> str:
    """The layout that the first records show or, failing that, all of them, unless the input is one that callers want
    read once only."""
    seen = probe(df).first()
    if not seen["records"]:
        raise DataError("input is empty, nothing to deinterleave")
    if seen["records"] >= 2 and seen["pairs_share_id"]:
        return "interleaved"
    if seen["all_have_marker"]:
        return "by-suffix"
    if not rereadable:
        raise DataError(ONCE.format("the first records don't tell the layout, so all would have to be looked at first"))
    row = hypotheses(df).first()
    if row["n"] % 2:
        raise DataError(f"input has an odd number of records ({row['n']}); a merged paired-end file must have an even count")
    near, far = row["interleaved_fails"] is None, row["concat_fails"] is None
    if near and far:
        raise DataError("input matches both the interleaved and R1-then-R2-concatenation layouts; name one")
    if not near and not far:
        raise DataError(f"could not determine how R1/R2 were merged: interleaved fails at pair {row['interleaved_fails']}, concatenation at {row['concat_fails']}")
    return "interleaved" if near else "concat"


def split(df: DataFrame, layout: str, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """R1 and R2 of a merged file whose layout is known, each with its own gapless idx. n: its records, for concat."""
    if layout == "interleaved":
        own = lambda side: df.where(F.col("idx") % 2 == side).select((F.col("idx") / 2).cast("bigint").alias("idx"), *FIELDS)
        return own(0), own(1)
    if layout == "concat":
        half = (df.count() if n is None else n) // 2
        return df.where(F.col("idx") < half).select("idx", *FIELDS), df.where(F.col("idx") >= half).select((F.col("idx") - half).alias("idx"), *FIELDS)
    own = lambda mate: numbered(df.where(mate_suffix(F.col("header")) == mate).select(F.col("idx").alias("_at"), *FIELDS), "_at", "idx").select("idx", *FIELDS)
    return own(1), own(2)


def _check_layout(df: DataFrame, layout: str, check: bool) -> None:
    n = df.count()
    if not n:
        raise DataError("input is empty, nothing to deinterleave")
    if layout in ("interleaved", "concat") and n % 2:
        raise DataError(f"input has an odd number of records ({n}); not a valid {'interleaved paired' if layout == 'interleaved' else 'merged paired-end'} file")
    marked = df.select("idx", "header", mate_suffix(F.col("header")).alias("mate"))
    if layout == "interleaved" and check:
        pairs = df.groupBy((F.col("idx") / 2).cast("bigint").alias("i")).agg(F.min_by("header", "idx").alias("a"), F.max_by("header", "idx").alias("b"))
        if row := first(pairs, base_id(F.col("a")) != base_id(F.col("b")), "i"):
            raise DataError(f"not an interleaved file: records #{2 * row['i'] + 1} and #{2 * row['i'] + 2} do not share a read id ({_name(row['a'])!r} vs {_name(row['b'])!r})")
    if layout == "concat":
        half = F.col("idx") >= n // 2
        settled = marked.where("mate is not null").groupBy(half.alias("second")).agg(F.min_by("mate", "idx").alias("settled"))
        firsts = {r["second"]: r["settled"] for r in settled.collect()}
        if check:
            odd = marked.withColumn("settled", F.when(half, F.lit(firsts.get(True))).otherwise(F.lit(firsts.get(False))))
            if row := first(odd, F.col("mate") != F.col("settled"), "idx"):
                side = "second" if row["idx"] >= n // 2 else "first"
                raise DataError(f"not an R1-then-R2 concatenation: record #{row['idx'] + 1} is R{row['mate']} but the {side} half started out as R{row['settled']}")
            if len(firsts) == 2 and firsts[True] == firsts[False]:
                raise DataError(f"not an R1-then-R2 concatenation: both halves are R{firsts[True]}")
        if len(firsts) == 2 and firsts[False] == 2 and firsts[True] == 1:
            log.warning("the halves are swapped: the first holds R2 and the second R1, so out1 gets the R2 reads; --layout by-suffix would go by the headers")
    if layout == "by-suffix":
        if row := first(marked, F.col("mate").isNull(), "idx"):
            raise DataError(f"record #{row['idx'] + 1} carries no /1 or /2 mate marker in its header: {row['header']!r}.")
        counts = marked.agg(F.count_if(F.col("mate") == 1).alias("n1"), F.count_if(F.col("mate") == 2).alias("n2")).first()
        if counts["n1"] != counts["n2"]:
            raise DataError(f"R1 and R2 ended up with different numbers of records ({counts['n1']} vs {counts['n2']})")


def deinterleave(df: DataFrame, layout: str = "auto", check: bool = True, rereadable: bool = True) -> tuple[DataFrame, DataFrame]:
    """R1 and R2 of a merged file. Everything is checked before anything is returned. Where the input isn't rereadable,
    layouts that need its count first are refused."""
    if layout == "concat" and not rereadable:
        raise DataError(ONCE.format("concat needs the number of records first"))
    layout = layout_of(df, rereadable) if layout == "auto" else layout
    _check_layout(df, layout, check)
    return split(df, layout)


def broken(df: DataFrame) -> DataFrame:
    """df with problem: what is wrong with each record, or null. An error column of the source counts too."""
    problem = violation(*(F.col(c) for c in FIELDS))
    return df.withColumn("problem", F.coalesce(F.col("error"), problem) if "error" in df.columns else problem)


def rescue(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records before the first bad one, and one row: rescued, outcome (0 clean, 3 partial, 1 nothing)."""
    judged = broken(df)
    stop = judged.agg(F.min(F.when(F.col("problem").isNotNull(), F.col("idx"))).alias("stop"))
    kept = judged.drop("problem").crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).drop("stop")  # one row
    return kept, _outcome(kept, stop)


def rescue_paired(r1: DataFrame, r2: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs (zipped) before the first bad record, missing mate or, if checked, foreign mate; and their outcome."""
    fine1, fine2 = (broken(r).withColumn("header", F.when(F.col("problem").isNull(), F.col("header"))) for r in (r1, r2))
    pairs = zipped(fine1, fine2)
    bad = F.col("header1").isNull() | F.col("header2").isNull() | (F.col("status") == "count_mismatch")
    if check:
        bad = bad | (F.col("status") == "id_mismatch")
    stop = pairs.agg(F.min(F.when(bad, F.col("idx"))).alias("stop"))
    kept = pairs.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).drop("stop", "status")  # one row
    return kept, _outcome(kept, stop)


def _outcome(kept: DataFrame, stop: DataFrame) -> DataFrame:
    n = kept.agg(F.count("*").alias("rescued")).crossJoin(stop)
    code = F.when(F.col("stop").isNull(), 0).when(F.col("rescued") > 0, 3).otherwise(1)
    return n.select("rescued", code.alias("outcome"))
