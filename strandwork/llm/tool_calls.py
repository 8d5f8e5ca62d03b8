"""Linking tool calls to their results. DataFrame operations only.

Calls and results meet in a hash join on the call's identifier. Calls are put in topological order: by looking twice as far
up its chain in each round where no call needs more than one other, else by rounds that take the calls whose last
missing dependency got its place in the round before. Arguments are parsed as variants and held against their tool's schema. Call and result are written as
canonical JSON: keys in code-point order, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import drop, written

#: What schema_of_variant says of a value of each JSON type.
VARIANT_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$|^DECIMAL\(\d+,0\)$",
    "number": r"^BIGINT$|^DECIMAL|^DOUBLE$|^FLOAT$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT",
    "array": r"^ARRAY",
    "null": r"^VOID$",
}


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) with level: 0 without edges, else one more than the highest level that it needs; null for whatever
    lies on or behind a cycle, or needs what isn't there. edges: (id, needs)."""
    edges, _ = written(edges.select("id", "needs").distinct())
    nodes = nodes.select("id").distinct()
    if edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _chain_levels(nodes, edges)
    return _round_levels(nodes, edges)


def _chain_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels() where nothing needs more than one. Every node looks twice as far up its chain in each round, so a chain
    of n takes log2(n) rounds."""
    spark = nodes.sparkSession
    there = nodes.select(F.col("id").alias("needs"), F.lit(True).alias("there"))
    known = edges.join(there, "needs", "left")
    state = nodes.join(known, "id", "left")
    # at: the node that dist steps lead to; null once the chain has ended. A chain to what isn't there never ends.
    lost = F.col("needs").isNotNull() & F.col("there").isNull()
    state = state.select("id", F.when(lost, F.col("id")).otherwise(F.col("needs")).alias("at"), F.when(F.col("needs").isNull(), 0).otherwise(1).alias("dist"))
    state, path = written(state)
    rounds = max(1, nodes.count()).bit_length()
    for _ in range(rounds):
        if state.where("at is not null").isEmpty():
            break
        further = state.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("dist2"))
        moved = state.where("at is not null").join(further, "at").select("id", F.col("at2").alias("at"), (F.col("dist") + F.col("dist2")).alias("dist"))
        moved, next_path = written(state.where("at is null").select("id", "at", "dist").union(moved))
        drop(spark, path)
        state, path = moved, next_path
    return state.select("id", F.when(F.col("at").isNull(), F.col("dist")).cast("int").alias("level"))


def _round_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    missing = edges.groupBy("id").agg(F.count("*").alias("open"))
    state, path = written(nodes.join(missing, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open")))
    done, done_paths, k = None, [], 0
    while True:
        ready, ready_path = written(state.where("open = 0").select("id", F.lit(k).alias("level")))
        if ready.isEmpty():
            drop(spark, ready_path)
            break
        done_paths.append(ready_path)
        done = ready if done is None else done.union(ready)
        met = edges.join(ready.select(F.col("id").alias("needs")), "needs").groupBy("id").agg(F.count("*").alias("met"))
        left = state.where("open > 0").join(met, "id", "left").select("id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"))
        left, next_path = written(left)
        drop(spark, path)
        state, path, k = left, next_path, k + 1
    if done is None:
        return state.select("id", F.lit(None).cast("int").alias("level"))
    return done.union(state.select("id", F.lit(None).cast("int").alias("level")))


def violations(arguments: Column, schema: dict) -> Column:
    """What is wrong with arguments (a variant) under schema: {"properties": {name: {"type": ...}}, "required": [...],
    "additionalProperties": bool}, as an array of texts."""
    found = [F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("not an object"))]
    for name, rule in sorted(schema.get("properties", {}).items()):
        value = F.try_variant_get(arguments, f"$['{name}']", "variant")
        if kind := rule.get("type"):
            found.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(VARIANT_TYPES[kind]), F.lit(f"{name} is not {kind}")))
    for name in sorted(schema.get("required", [])):
        found.append(F.when(F.try_variant_get(arguments, f"$['{name}']", "variant").isNull(), F.lit(f"{name} is missing")))
    if not schema.get("additionalProperties", True):
        keys = F.json_object_keys(F.to_json(arguments))
        more = F.array_except(keys, F.array(*[F.lit(n) for n in sorted(schema.get("properties", {}))]).cast("array<string>"))
        found.append(F.when(F.size(more) > 0, F.concat(F.lit("not known: "), F.array_join(F.array_sort(more), ","))))
    return F.array_compact(F.array(*found))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result without one.

    calls: (call_id string, session long, name string, arguments string (JSON), needs array<string>: calls whose results
    it uses). results: (call_id string, content string). Returns call_id, session, level (place in topological order;
    null in or behind a cycle and where a needed call isn't there), status (linked, no_result, orphan_result), n_results,
    valid, problems and canonical.

    The smallest content is the result of a call that has several, n_results tells how many. Repeated calls keep their
    rows. A call with a null id links with nothing and has no level. Arguments that are null or no JSON object, and
    tools without a schema, are not valid. Empty tables give no rows; other columns are left out.
    """
    calls = calls.select("call_id", "session", "name", "arguments", "needs")
    edges = calls.where("call_id is not null").select(F.col("call_id").alias("id"), F.explode("needs").alias("needs")).where("needs is not null")
    order = levels(calls.where("call_id is not null").select(F.col("call_id").alias("id")), edges)
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    answers = answers.select(F.col("call_id").alias("r_id"), "content", "n_results", F.lit(True).alias("answered"))
    ordered = calls.join(order, F.col("call_id") == F.col("id"), "left").drop("id").withColumn("called", F.lit(True))
    both = ordered.join(answers, F.col("call_id") == F.col("r_id"), "full_outer")
    parsed = both.withColumn("_arguments", F.try_parse_json("arguments"))
    problems = F.when(~F.coalesce("called", F.lit(False)), F.array().cast("array<string>"))
    for name, schema in sorted(schemas.items()):
        problems = problems.when(F.col("name") == name, violations(F.col("_arguments"), schema))
    problems = problems.otherwise(F.array(F.lit("no schema")))
    status = F.when(F.col("called") & F.col("answered"), "linked").when(F.col("called"), "no_result").otherwise("orphan_result")
    record = F.struct(F.col("_arguments").alias("arguments"), F.coalesce("call_id", "r_id").alias("call_id"), "name", F.col("content").alias("result"))
    return parsed.select(
        F.coalesce("call_id", "r_id").alias("call_id"),
        "session",
        "level",
        status.alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        (F.size(problems) == 0).alias("valid"),
        problems.alias("problems"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("canonical"),
    )
