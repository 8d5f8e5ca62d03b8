import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwork.llm.jaccard_join import one_of_each
from strandwork.llm.mixing import mix, mixed_rows
from strandwork.llm.url_filter import judge_urls

CLASHING = ("size", "source_size", "target", "copies", "mean", "lam", "_rows", "_stays", "_hash", "_url", "_copy", "host")


def documents(spark):
    texts = [f"w{i} x{i} y{i} z{i} v{i} u{i % 3}" for i in range(30)] + [None, "", "w1 x1 y1 z1 v1 u1", "w1 x1 y1 z1 v1 u1"]
    rows = [(i, t, ["a", "b", None][i % 3], *[f"{c}-{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    rows.append((None, "lonely words here", "a", *CLASHING))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def test_stages_keep_columns_that_clash(spark):
    docs = documents(spark)
    before = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for out in (one_of_each(docs, 5, 80), mixed_rows(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r) == before[r["doc_id"]] for r in rows)
    kept = [r["doc_id"] for r in one_of_each(docs, 5, 80).collect()]
    assert set(kept) == set(before) - {32, 33}
    mixed = mix(docs).where("doc_id = 3").first()
    assert mixed["mean"] == "mean-3" and mixed["_copy"] == "_copy-3" and mixed["size"] == 6
    assert mixed_rows(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_urls_keep_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "kept"), (2, None, "too")], "page_id long, url string, _url string")
    got = {r["page_id"]: (r["_url"], r["verdict"]) for r in judge_urls(pages, [("block", "com", "/en/")]).collect()}
    assert got == {1: ("kept", "block"), 2: ("too", "allow")}


def test_stages_in_turn(spark, tmp_path, monkeypatch):
    """The order of stages; each takes what its predecessor kept and its decisions take effect."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "mixing", "packing"]
    docs = documents(spark).select("doc_id", "text", "source").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        now = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r["doc_id"] for r in now.collect()}
        if name == "toxicity":  # nothing was labelled toxic, so nothing goes
            assert now.count() == docs.count()
        else:
            assert not ids & {32, 33}
        if name == "jaccard_join":
            assert None in ids
