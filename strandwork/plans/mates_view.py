"""Two mates made from the events table, the same rows in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Side by side with the modulus of the rows that it lacks.
SIDES = {1: 7, 2: 5}


def _record(event_id, side: int, idx) -> list:
    text = event_id.cast("string")
    name = F.concat(F.lit("@RD"), F.lpad(text, 6, "0"), F.lit(" "), text, F.lit(f"/{side}"))
    seq = F.translate(F.md5(text.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return [idx.alias("idx"), name.alias("header"), seq.alias("seq"), F.lit("+").alias("plus"), F.repeat(F.lit("I"), 32).alias("qual")]


def side(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The events whose id the side's modulus doesn't divide. Ids are gapless from 0, so a row's place among those that
    are left is arithmetic, not a sort."""
    m = SIDES[k]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").where(F.col("event_id") % m != 0)
    e = F.col("event_id")
    return events.select(*_record(e, k, e - F.floor(e / m) - 1))


def everyone(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """All events as records of one side, numbered by their id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return events.select(*_record(F.col("event_id"), k, F.col("event_id")))


def _sql_fields(k: int) -> str:
    return f"""'@RD' || lpad(cast(event_id AS VARCHAR), 6, '0') || ' ' || cast(event_id AS VARCHAR) || '/{k}' AS header,
      translate(md5(cast(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, '+' AS plus, repeat('I', 32) AS qual"""


def sql_sides() -> str:
    """WITH entries r1, r2 (idx, header, seq, plus, qual, id), a1, a2 of all events."""
    parts = []
    for k, m in SIDES.items():
        parts.append(f"r{k} AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, {_sql_fields(k)}, 'RD' || lpad(cast(event_id AS VARCHAR), 6, '0') AS id FROM events WHERE event_id % {m} <> 0)")
        parts.append(f"a{k} AS (SELECT event_id AS idx, {_sql_fields(k)}, 'RD' || lpad(cast(event_id AS VARCHAR), 6, '0') AS id FROM events)")
    return ",\n".join(parts)
