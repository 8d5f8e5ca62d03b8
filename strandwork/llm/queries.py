"""The registered queries of the operators in this package, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: From this score on a text counts as toxic.
TOXIC = 0.7


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.common import crc_of_id
    from strandwork.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(crc_of_id(), F.lit(3)) == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.vector_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: What a turn of a conversation is called with, when it is written as a call of a tool.
REPLY_SCHEMAS = {
    "reply": {
        "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}, "after": {"type": "string"}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}


@query
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as calls of one tool: each user turn is a call that needs the call of the user turn before the last
    answer, each assistant turn the result of the call in the turn before it; other roles call and answer nothing."""
    from strandwork.llm.tool_calls import link

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    calls = turns.where("role = 'user'").select(name(0).alias("call_id"), F.col("conv_id").alias("session"), "turn", "text", name(2).alias("before"))
    earlier = calls.select(F.col("call_id").alias("before"), F.lit(True).alias("there")).distinct()
    calls = calls.join(earlier, "before", "left").select(
        "call_id",
        "session",
        F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text", F.when(F.col("there"), F.col("before")).alias("after"))).alias("arguments"),
        F.when(F.col("there"), F.array("before")).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select(name(1).alias("call_id"), F.col("text").alias("content"))
    linked = link(calls, results, REPLY_SCHEMAS)
    return linked.withColumn("problems", F.array_join("problems", "; "))


@query
def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.hmm import score

    return score(table(spark, sf_dir, "documents"))


#: (verdict, host, path): fixed values that the query judges urls by.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.url_filter import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, carry_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwork.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op2_jaccard_join"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingles FROM words),
sizes AS (SELECT doc_id, len(shingles) AS n FROM sets),
entries AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM entries x JOIN entries y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN links ON other = a)
SELECT doc_id, n AS n_shingles, least(doc_id, (SELECT min(other) FROM reach WHERE node = doc_id)) AS component_id FROM sizes
"""

ORACLE_SQL["op5_tool_calls"] = """
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations),
results AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(text) AS content FROM turns WHERE role = 'assistant' GROUP BY ALL),
places AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM turns WHERE role = 'user'),
calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM places),
linked AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.conv_id AS session, c.level, c.text, r.content, r.n_results FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT 'call-' || conv_id || '-' || turn AS call_id, session, level::INT AS level,
  CASE WHEN session IS NULL THEN 'orphan_result' WHEN n_results IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  coalesce(n_results, 0) AS n_results, true AS valid, '' AS problems,
  '{"arguments":' || CASE WHEN session IS NULL THEN 'null' ELSE '{' || CASE WHEN level > 0 THEN '"after":"call-' || conv_id || '-' || (turn - 2) || '",' ELSE '' END
    || '"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END || ',"call_id":"call-' || conv_id || '-' || turn || '","name":'
    || CASE WHEN session IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical
FROM linked
"""

ORACLE_SQL["op4_vector_dedup"] = """
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT node, b FROM reach JOIN links ON other = a),
components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN degrees ON a = vec_id JOIN components ON node = vec_id
"""
