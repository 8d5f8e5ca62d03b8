"""Read headers and text lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end; trim() would take spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def base_id(header: Column) -> Column:
    """The read's name: without one leading @, up to white space, without one trailing /1 or /2."""
    bare = F.regexp_replace(header, r"\A@", "")
    token = F.regexp_extract(bare, r"(?U)^\s*(\S*)", 1)
    name = F.when(token == "", bare).otherwise(token)
    return F.regexp_replace(name, r"/[12]\z", "")


def mate_suffix(header: Column) -> Column:
    """1 or 2 where /1, or else /2, stands before ASCII white space or the end; else null."""
    ends = r"([ \t\n\f\r]|\z)"
    return F.when(header.rlike("/1" + ends), 1).when(header.rlike("/2" + ends), 2)


def violation(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """The first thing that is wrong with a record, or null. Lengths are bytes."""
    return (
        F.when(header.isNull() | ~header.startswith("@"), "header does not start with '@'")
        .when(seq.isNull(), "missing sequence line")
        .when(plus.isNull(), "missing '+' line")
        .when(~plus.startswith("+"), "expected '+' line")
        .when(qual.isNull(), "missing quality line")
        .when(F.octet_length(seq) != F.octet_length(qual), "sequence and quality lengths differ")
    )


def footprint(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """Bytes that a record takes while it waits for its mate: its fields, its name a second time, and some for the entry."""
    # Fixed value: bytes for the entry.
    return 2 * F.octet_length(header) + F.octet_length(seq) + F.octet_length(plus) + F.octet_length(qual) + F.lit(128)


def fasta_key(line: Column) -> Column:
    """The old name on a FASTA header line; null on others."""
    return F.when(line.startswith(">"), F.regexp_extract(F.substring(line, 2, 1 << 30), r"(?U)^\s*(\S*)", 1))


def fasta_line(line: Column, new: Column) -> Column:
    return F.when(line.startswith(">"), F.concat(F.lit(">"), F.coalesce(new, fasta_key(line)))).otherwise(line)


def gff_key(line: Column) -> Column:
    """The sequence id of a GFF line; null on comments."""
    return F.when(~line.startswith("#"), F.substring_index(line, "\t", 1))


def gff_line(line: Column, new: Column) -> Column:
    key = F.substring_index(line, "\t", 1)
    rest = F.when(F.length(line) > F.length(key), line.substr(F.length(key) + 2, F.length(line))).otherwise(F.lit(""))
    return F.when(~line.startswith("#") & new.isNotNull(), F.concat(new, F.lit("\t"), rest)).otherwise(line)
