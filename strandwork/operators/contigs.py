"""Holding files' contig dictionaries against a reference's.

A dictionary is rows (file, ord, name, length): order matters, names may repeat, lengths may be unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.functions.headers import fasta_key, trimmed
from strandwork.operators.checks import carried, span_of


def first_of_each(contigs: DataFrame) -> DataFrame:
    """One row per file and name: the first."""
    return contigs.groupBy("file", "name").agg(F.min("ord").alias("ord"), F.min_by("length", "ord").alias("length"))


def aliases(name: Column) -> Column:
    """Names under which a reference may know a contig, the likeliest first."""
    # The mitochondrion's usual names.
    special = F.when(name.isin("chrM", "chrMT"), F.array(F.lit("MT"), F.lit("M"))).when(name.isin("M", "MT"), F.array(F.lit("chrM"), F.lit("chrMT")))
    plain = F.when(name.startswith("chr"), F.substring(name, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), name))
    return F.concat(F.array(plain), F.coalesce(special, F.array().cast("array<string>")))


def unknown(reference: DataFrame, others: DataFrame) -> DataFrame:
    """(file, ord, name, alias): contigs that the reference lacks, and what it calls them if it knows an alias."""
    own = reference.select("name").distinct()
    lost = others.join(own, "name", "left_anti").select("file", "ord", "name")
    tried = lost.select("file", "ord", "name", F.posexplode(aliases(F.col("name"))).alias("pos", "candidate"))
    hints = tried.join(own.withColumnRenamed("name", "candidate"), "candidate").groupBy("file", "ord", "name").agg(F.min_by("candidate", "pos").alias("alias"))
    return lost.join(hints, ["file", "ord", "name"], "left")


def length_conflicts(reference: DataFrame, others: DataFrame) -> DataFrame:
    """(file, ord, name, here, there): known lengths that differ."""
    own = first_of_each(reference).select("name", F.col("length").alias("there"))
    return others.join(own, "name").where(F.col("length") != F.col("there")).select("file", "ord", "name", F.col("length").alias("here"), "there")


def missing(reference: DataFrame, others: DataFrame) -> DataFrame:
    """(file, name): the reference's contigs that a file doesn't mention. The files, of which there are few, are a list
    beside each name; those that mention it are taken off the list."""
    files = others.agg(F.array_sort(F.collect_set("file")).alias("files"))  # one row
    mentions = others.groupBy("name").agg(F.collect_set("file").alias("there"))
    own = reference.select("name").distinct().join(mentions, "name", "left").crossJoin(F.broadcast(files))
    there = F.coalesce("there", F.array().cast("array<string>"))
    return own.select(F.explode(F.array_except("files", there)).alias("file"), "name")


def order_differs(reference: DataFrame, others: DataFrame) -> DataFrame:
    """(file, differs): whether the shared contigs come in another order. A dictionary is a file's header, so its list of
    names is one value."""
    listed = lambda: F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    theirs = others.join(reference.select("name").distinct(), "name", "left_semi").groupBy("file").agg(listed().alias("theirs"))
    shared = others.select("file", "name").distinct().join(reference.select("ord", "name"), "name")
    ours = shared.groupBy("file").agg(listed().alias("ours"))
    return theirs.join(ours, "file").select("file", (F.col("theirs") != F.col("ours")).alias("differs"))


def summary(contigs: DataFrame) -> DataFrame:
    """(file, contigs, lengths): lengths is -, yes, no or how many of how many."""
    n, known = F.count("name"), F.count("length")
    status = F.when(n == 0, "-").when(known == n, "yes").when(known == 0, "no").otherwise(F.concat(known.cast("string"), F.lit("/"), n.cast("string")))
    return contigs.groupBy("file").agg(n.alias("contigs"), status.alias("lengths"))


def findings(reference: DataFrame, others: DataFrame, require_order: bool = False) -> DataFrame:
    """(file, finding, fatal, n): unknown and length are fatal, order if it is required; missing is told only of files
    without anything fatal."""
    per_file = lambda d, kind: d.groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(kind).alias("finding"), "n")
    found = per_file(unknown(reference, others), "unknown").union(per_file(length_conflicts(reference, others), "length"))
    found = found.union(order_differs(reference, others).where("differs").select("file", F.lit("order"), F.lit(1).cast("bigint")))
    found = found.withColumn("fatal", (F.col("finding") != "order") | F.lit(require_order))
    grave = found.where("fatal").select("file").distinct()
    rest = per_file(missing(reference, others), "missing").join(grave, "file", "left_anti").withColumn("fatal", F.lit(False))
    return found.unionByName(rest).select("file", "finding", "fatal", "n")


def fasta_lengths(lines: DataFrame) -> DataFrame:
    """(ord, name, length) of the sequences in lines (line_no, value): a header opens one, the bytes of the lines up to
    the next are its length; what stands before the first is left out.

    A line's sequence is the number of headers up to it. They are counted in spans of lines and moved up by the counts of
    the spans before, so no window covers the file and the lines are shuffled once.
    """
    marked = lines.select("line_no", trimmed(F.col("value")).alias("value"), span_of("line_no").alias("_span"))
    opens = F.col("value").startswith(">")
    upto = Window.partitionBy("_span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select("_span", "value", F.count_if(opens).over(upto).alias("n"))
    heads = lines.groupBy(span_of("line_no").alias("_span")).agg(F.count_if(trimmed(F.col("value")).startswith(">")).alias("heads"))
    placed = local.join(carried(heads, {"before": F.sum("heads")}), "_span").withColumn("ord", F.col("n") + F.coalesce("before", F.lit(0)) - 1)
    return placed.where("ord >= 0").groupBy("ord").agg(
        F.max(F.when(opens, fasta_key(F.col("value")))).alias("name"),
        F.sum(F.when(opens, 0).otherwise(F.octet_length("value"))).cast("bigint").alias("length"),
    )


def distinct_in_order(names: DataFrame) -> DataFrame:
    """(name, first_line) of (line_no, name)."""
    return names.groupBy("name").agg(F.min("line_no").alias("first_line"))
