import random

import pytest
from pyspark.sql import functions as F

from strandwork.functions import draws, headers
from strandwork.operators import sample

MASK = (1 << 64) - 1
HEADERS = {
    "@READ_1/1": ("READ_1", 1), "@READ_1/2": ("READ_1", 2), "@READ_1 1:N:0:ATCG": ("READ_1", None), "@SRR17458599.1 1/2": ("SRR17458599.1", 2),
    "@READ/1 length=100": ("READ", 1), "@READ/2\tlength=100": ("READ", 2), "@READ/12": ("READ/12", None), "@READ/1x": ("READ/1x", None),
    "@": ("", None), "@@x/2": ("@x", 2), "@ foo/1 b": ("foo", 1), "@R/1/2": ("R/1", 2), "@A/2 B/1": ("A", 1),
}


def mix(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def test_headers(spark):
    df = spark.createDataFrame([(h,) for h in HEADERS], "h string")
    for r in df.select("h", headers.base_id(F.col("h")).alias("id"), headers.mate_suffix(F.col("h")).alias("mate")).collect():
        assert (r["id"], r["mate"]) == HEADERS[r["h"]], r["h"]


def test_trim_takes_unicode_space_and_leaves_separators(spark):
    df = spark.createDataFrame([("　  a b\x0b\r",), ("\x1cx",)], "v string")
    assert [r[0] for r in df.select(headers.trimmed(F.col("v"))).collect()] == ["a b", "\x1cx"]


@pytest.mark.parametrize("seed", [0, 42, MASK])
def test_draws_are_bit_exact(spark, seed):
    with draws.wrapping(spark):
        df = spark.range(500).select("id", draws.draw_bits(seed, F.col("id")).alias("u"), draws.draw(seed, F.col("id")).alias("d"))
    for r in df.collect():
        u = mix(seed + r["id"] * 0x9E3779B97F4A7C15 & MASK)
        assert r["u"] & MASK == u and r["d"] == (u >> 11) * 2.0**-53


def test_high_product_and_fnv(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(63)) for _ in range(200)]
    with draws.wrapping(spark):
        df = spark.createDataFrame(pairs, "x bigint, b bigint").select("x", "b", draws.high_product(F.col("x"), F.col("b")).alias("h"))
        fnv = spark.createDataFrame([("",), ("a",), ("é/1",)], "s string").select("s", draws.fnv1a(F.col("s")).alias("h"))
    for r in df.collect():
        assert r["h"] & MASK == (r["x"] & MASK) * (r["b"] & MASK) >> 64
    for r in fnv.collect():
        h = 0xCBF29CE484222325
        for b in r["s"].encode():
            h = (h ^ b) * 0x100000001B3 & MASK
        assert r["h"] & MASK == h


def reservoir(total, n, seed):
    held, k = list(range(min(n, total))), 0
    for i in range(n, total):
        while True:
            k += 1
            x = mix(seed + k * 0x9E3779B97F4A7C15 & MASK)
            if (x * (i + 1) & MASK) >= (1 << 64) % (i + 1):
                break
        slot = x * (i + 1) >> 64
        if slot < n:
            held[slot] = i
    return sorted(held)


@pytest.mark.parametrize("total,n,seed", [(5000, 37, 7), (10, 10, 1), (5, 9, 42), (0, 3, 1)])
def test_reservoir_is_the_sequential_one(spark, total, n, seed):
    df = spark.range(total).withColumnRenamed("id", "idx")
    assert sorted(r["idx"] for r in sample.exact(df, n, seed).collect()) == reservoir(total, n, seed)


def test_proportion_does_not_depend_on_partitions(spark):
    df = spark.range(4000).withColumnRenamed("id", "idx")
    one, other = (sorted(r["idx"] for r in sample.proportion(d, 0.3, 9).collect()) for d in (df, df.repartition(7)))
    assert one == other and 0.25 < len(one) / 4000 < 0.35
    with pytest.raises(ValueError):
        sample.proportion(df, 0)
