"""What Python workers hold between tasks and stages."""

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork.llm import packing, workers
from strandwork.llm.queries import vocabulary


def resident() -> float:
    """MB of this process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_free_memory_goes_back_after_a_task():
    def work(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(batch.column(0).to_pylist())], names=["word"])

    def batches():
        for k in range(3):
            yield pa.record_batch([pa.array([bytes([k, i % 256]) * 100 for i in range(200_000)])], names=["word"])

    def growth(task) -> float:
        workers.release()
        before = resident()
        for _ in task(batches()):
            pass
        del _
        return resident() - before

    assert growth(work) > 30  # what a worker would hold
    assert growth(workers.lean(work)) < 15


def test_a_task_drops_what_other_owners_keep():
    workers.kept("one")["word"] = 1.0
    list(workers.lean(iter, "one")(iter([])))
    assert workers.kept("one") == {"word": 1.0}
    list(workers.lean(iter)(iter([])))
    assert workers.kept("one") == {}


def test_packing_drops_the_words_of_toxicity(spark):
    """Both in the one worker of a task: the worker that has kept words has none after packing's task."""

    def keep(batches):
        import os

        from strandwork.llm import workers

        for batch in batches:
            workers.kept("machine")["word"] = 1.0
            yield pa.record_batch([pa.array([os.getpid()] * len(batch), pa.int64())], names=["pid"])

    def left(batches):
        import os

        from strandwork.llm import workers

        for batch in batches:
            yield pa.record_batch([pa.array([os.getpid()] * len(batch), pa.int64()), pa.array([len(workers._kept)] * len(batch), pa.int64())], names=["pid", "left"])

    rows = spark.range(40).repartition(8)
    kept_by = {r["pid"] for r in rows.mapInArrow(keep, "pid long").collect()}
    docs = rows.select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    for _ in range(20):  # until each of them has had a task of packing
        packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
        held = {r["pid"]: r["left"] for r in rows.mapInArrow(left, "pid long, left long").collect()}
        if not any(held.get(p, 1) for p in kept_by):
            break
    assert not any(held.get(p, 0) for p in kept_by)
