"""IPC-2581 documents read in parallel: one document is split over tasks wherever an element ends.

Spark's text reader splits a file at any separator, so a section is read as records that
end where its elements do.  The order of segments in a polygon stays, as a record's element is kept as
text until a kernel parses it.  What a set of artwork takes from before its record,
its layer and its place in it, is carried over ranges of the records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions.storage import durable, small_side
from ohmgrid.operators import ranges
from ohmgrid.sources import ipc2581

# Elements that are read whole, and those of which attributes are enough.
WHOLE = ("EntryStandard", "EntryUser", "PadStack", "LogicalNet", "Profile")
TOKENS = ("Layer", "StackupLayer", "Component")


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(source, block, at, value): the text between separators, ordered by block and at."""
    text = spark.read.option("lineSep", separator).text(path)
    source = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    return text.select(source.alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _opening(tag: str) -> str:
    return rf"<(?:[\w.-]+:)?{tag}(?=[\s/>])"


def _attribute(token: Column, name: str) -> Column:
    """An attribute's text, null where it is not there."""
    found = F.regexp_extract(token, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    text = F.regexp_replace(found, r"""^[^"']*["']|["']$""", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.when(found != "", text)


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, at, value) of everything that ends with ``>``; comments and values that hold that sign end early."""
    return _records(spark, path, ">")


def headers(marks: DataFrame) -> DataFrame:
    """(source, revision, units, elements, declared, hidden) by one aggregate over tokens: units of CadHeader before any others."""
    value = F.col("value")
    place = F.struct("block", "at")
    own = F.when(value.rlike(_opening("CadHeader")), _attribute(value, "units"))
    any_units = _attribute(value, "units")
    root = F.when(value.rlike(_opening("IPC-2581")), _attribute(value, "revision"))
    first = lambda v: F.min(F.when(v.isNotNull(), F.struct(place.alias("p"), v.alias("v"))))["v"]
    declared = F.upper(value).rlike(r"<!\s*(DOCTYPE|ENTITY)")
    # What would hide the end of an element from the text reader.
    hidden = value.rlike(r"</[\w.-]+\s+$|</?[\w.-]+:[\w.-]+|<!\[CDATA\[|<!--[^<]*<")
    return marks.groupBy("source").agg(
        first(root).alias("revision"), F.coalesce(first(own), first(any_units)).alias("units"), F.sum(F.when(value.rlike(r"<[A-Za-z_]"), 1).otherwise(0)).alias("elements"), F.max(declared).alias("declared"), F.max(hidden).alias("hidden")
    )


def refused(heads: DataFrame, most_elements: int = ipc2581.MOST_ELEMENTS) -> DataFrame:
    """(source, reason) of documents that declare a type or an entity, have too many elements or no root that is known, and of those that the whole-file reader has to read."""
    reason = F.when(F.col("declared"), "declares a type or an entity").when(F.col("elements") > most_elements, "too many elements").when(F.col("hidden"), "prefixed or spaced names, CDATA or markup in comments").when(F.col("revision").isNull(), "no root or no revision")
    return heads.select("source", reason.alias("reason")).where("reason is not null")


def _fragments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the elements in ``body``, numbered on from the record's number."""
    for frame in frames:
        rows = []
        for source, pos, layer, number, body in zip(frame["source"], frame["pos"], frame["layer"], frame["number"], frame["body"], strict=True):
            try:
                root = ElementTree.fromstring(body)
            except ElementTree.ParseError:
                rows.append((source, "corrupt", pos, json.dumps({"text": body[:200]})))
                continue
            if layer is not None:
                root.set("layerRef", layer)
            for k, (section, found) in enumerate(ipc2581.element_rows(root)):
                rows.append((source, section, pos + k, json.dumps(found | {"set": int(number)} if section == "feature" else found)))
        yield pd.DataFrame(rows, columns=["source", "section", "pos", "body"])


def _parsed(records: DataFrame) -> DataFrame:
    """Rows of (source, pos, layer, number, body: one whole element); prefixes of names are dropped, as a fragment does not declare them."""
    plain = F.regexp_replace(F.col("body"), r"<(/?)[\w.-]+:", "<$1")
    # A record has room for as many rows as a set may hold elements.
    return records.select("source", (F.col("pos") * F.lit(1 << 24)).alias("pos"), "layer", "number", plain.alias("body")).mapInPandas(_fragments, ipc2581.ROW)


def scan(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The section tables of all documents at ``path``, as ``ipc2581.sections_of`` has them, and (source, reason) of those refused.

    Limits on size, depth of nesting and names of sections are the whole-file reader's; here declarations
    and the number of elements are checked.  An element that does not parse is a row of section ``corrupt``
    in ``tables["corrupt"]`` instead of a failure.  ``pos`` orders the rows of a section within a document.
    """
    marks = tokens(spark, path)
    heads = durable(headers(marks))
    bad = small_side(durable(refused(heads)))
    keep = lambda df: df.join(bad, "source", "left_anti")
    found = []
    for tag in WHOLE:
        records = keep(_records(spark, path, f"</{tag}>")).where(F.col("value").rlike(_opening(tag)))
        inner = F.regexp_extract("value", rf"(?s).*({_opening(tag)}.*)$", 1)
        found.append(_parsed(records.select("source", F.col("at").alias("pos"), F.lit(None).cast("string").alias("layer"), F.lit(0).alias("number"), F.concat(inner, F.lit(f"</{tag}>")).alias("body"))))
    found.append(_parsed(_sets(keep(_records(spark, path, "</Set>")))))
    rows = durable(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).unionByName(found[4]).unionByName(found[5]))
    tables = ipc2581.body_tables(rows)
    tables["corrupt"] = rows.where("section = 'corrupt'").select("source", "pos", F.get_json_object("body", "$.text").alias("text"))
    single = durable(keep(marks).where(F.col("value").rlike("|".join(_opening(t) for t in TOKENS))).withColumn("value", F.regexp_extract("value", r"(?s)(<[^<]*)$", 1)))
    v = F.col("value")
    number = lambda name: _attribute(v, name).cast("double").alias(name)
    of = lambda tag: single.where(v.rlike(_opening(tag)))
    text = lambda name, out: _attribute(v, name).alias(out)
    pos = F.col("at").alias("pos")
    tables["layer"] = of("Layer").select("source", pos, text("name", "name"), text("layerFunction", "function"), text("side", "side"), text("polarity", "polarity")).where("function is not null")
    tables["stackup"] = of("StackupLayer").select("source", pos, text("layerOrGroupRef", "layer"), number("thickness"), number("sequence"), F.lit(None).cast("string").alias("material"))
    tables["component"] = of("Component").select("source", pos, text("refDes", "refdes"), text("part", "part"), text("layerRef", "layer"))
    tables["header"] = ipc2581.with_revision(keep(heads).select("source", F.lit(0).cast("long").alias("pos"), "revision", "units", "elements", F.lit(None).cast("array<string>").alias("sections"), F.lit(None).cast("string").alias("generator")))
    return tables, bad


def _sets(records: DataFrame) -> DataFrame:
    """(source, pos, layer, number, body) of the sets of artwork, each with its layer and its number in it.

    A record is what lies between the ends of two sets.  Running counts of the layers and sets that have
    begun, carried over ranges of records, say in which layer a set is and how many are before it.
    """
    layer, one = _opening("LayerFeature"), _opening("Set")
    n_layers = F.size(F.split("value", layer)) - 1
    n_sets = F.size(F.split("value", one)) - 1
    last = F.element_at(F.split("value", rf"(?={layer})"), -1)
    counted = records.withColumns({"n_layers": n_layers, "n_sets": n_sets, "begun": F.when(n_layers > 0, last), "inside": F.when(n_layers > 0, F.size(F.split(last, one)) - 1)})
    laid = ranges.numbered(counted, ["source"], [F.col("block").asc(), F.col("at").asc()], "pos", sums={"layers": F.col("n_layers"), "sets": F.col("n_sets")})
    # Sets that have begun before the layer has.
    starts = durable(laid.where("begun is not null").select(F.col("source").alias("of"), F.col("layers").alias("layer_no"), _attribute(F.regexp_extract("begun", "^[^>]*", 0), "layerRef").alias("layer"), (F.col("sets") - F.col("inside")).alias("earlier")))
    met = laid.where("n_sets > 0").join(small_side(starts), (F.col("source") == F.col("of")) & (F.col("layers") == F.col("layer_no")))
    body = F.regexp_extract("value", rf"(?s).*({one}.*)$", 1)
    return met.select("source", "pos", "layer", (F.col("sets") - F.col("earlier") - 1).alias("number"), F.concat(F.lit("<LayerFeature>"), body, F.lit("</Set></LayerFeature>")).alias("body")).where(F.col("layer").isNotNull() & (F.col("body") != "<LayerFeature></Set></LayerFeature>"))
