"""Reproducible samples: a share of all rows, or exactly n of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.draws import draw, draw_bits, high_product, unsigned_less, wrapping
from strandwork.operators.checks import DataError

#: Rows of a sample up to which their numbers are sent to every task.
BROADCAST_ROWS = 1_000_000


def proportion(df: DataFrame, p: float, seed: int = 42, key: str = "idx") -> DataFrame:
    """Rows whose draw is at most p. A filter on the row's number alone: no shuffle, the same under any partitioning,
    and mates are kept together by sampling each side by itself."""
    if not 0 < p <= 1:
        raise DataError(f"-p/--proportion must be in (0, 1], got {p}")
    with wrapping(df.sparkSession):
        return df.where(draw(seed, F.col(key)) <= p)


def _slots(df: DataFrame, n: int, seed: int, key: str, shift: int, start: int) -> DataFrame:
    with wrapping(df.sparkSession):
        i = F.col(key)
        x = draw_bits(seed, i - n + 1 + shift)
        bound = i + 1
        low = x * bound
        # 2 ** 64 mod bound, from 2 ** 63 - 1, which BIGINT holds
        rest = (F.lit((1 << 63) - 1) % bound * 2 + 2) % bound
        return df.where(i >= max(start, n)).select(i.alias("_i"), high_product(x, bound).alias("_slot"), unsigned_less(low, rest).alias("_again"))


def reservoir(df: DataFrame, n: int, seed: int = 42, key: str = "idx") -> DataFrame:
    """The numbers (key) that a reservoir of n holds after all rows: row i takes slot i while i < n, then the slot of its
    draw if that is under n, and the last to take a slot keeps it. So it is a maximum per slot, with no order to keep.

    A draw that would favour small slots is thrown away, which moves the draws of all later rows on by one. That is so
    rare (about rows ** 2 / 2 ** 65) that the frame is looked through for it once, and again from there if it happens.
    """
    if n <= 0:
        raise DataError("-n/--number must be > 0")
    shift, start, parts = 0, 0, [df.where(F.col(key) < n).select(F.col(key).alias("_i"), F.col(key).alias("_slot"))]
    while True:
        slots = _slots(df, n, seed, key, shift, start)
        again = slots.where("_again").agg(F.min("_i").alias("i")).first()["i"]
        fine = slots if again is None else slots.where(F.col("_i") < again)
        parts.append(fine.where(F.col("_slot") < n).select("_i", "_slot"))
        if again is None:
            break
        shift, start = shift + 1, again
    taken = parts[0]
    for part in parts[1:]:
        taken = taken.union(part)
    return taken.where((F.col("_slot") >= 0) & (F.col("_slot") < n)).groupBy("_slot").agg(F.max("_i").alias(key)).select(key)


def exact(df: DataFrame, n: int, seed: int = 42, key: str = "idx") -> DataFrame:
    """Exactly n rows, all if there are fewer. Give both sides the same n and seed to keep mates together."""
    held = reservoir(df.select(key), n, seed, key)  # at most n rows
    return df.join(F.broadcast(held) if n <= BROADCAST_ROWS else held, key, "left_semi")
