"""Tests of untrusted markup before anything parses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a document that are looked at before it is parsed.
PROLOG = 8192


def has_doctype(text: Column) -> Column:
    """Whether the prolog declares a document type or an entity, in any case."""
    return F.substring(text, 1, PROLOG).rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)")


def sniff(text: Column, marks: dict[str, str]) -> Column:
    """The first format whose mark the prolog holds, ``json`` for an opening brace, else ``unknown``."""
    head = F.lower(F.substring(text, 1, PROLOG))
    out = F.when(F.lit(False), "")
    for name, needle in marks.items():
        out = out.when(head.contains(needle), name)
    return out.when(F.ltrim(text).startswith("{"), "json").otherwise("unknown")


def unknown_tags(df: DataFrame, text: str, known: list[str]) -> DataFrame:
    """(label, n) of the opening tags that are not among the known ones."""
    tags = df.select(F.explode(F.regexp_extract_all(text, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    label = F.lower("tag")
    return tags.where(~label.isin(*known)).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def refusals(files: DataFrame, most_bytes: int = 512 << 20) -> DataFrame:
    """``files`` (path, length, text) with ``refused``: why a document may not be parsed, or null."""
    return files.withColumn("refused", F.when(F.col("length") > most_bytes, "too large").when(has_doctype(F.col("text")), "document type or entity declared"))
