"""Canonical board documents: reader, tables, diagnostics and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUANTITY = "struct<value:double,unit:string,provenance:string,note:string>"
RING = "array<array<double>>"
OUTLINE = f"struct<exterior:{RING},holes:array<{RING}>>"
BOARD = (
    "struct<id:string,name:string,notes:array<string>,"
    f"stackup:array<struct<id:string,name:string,function:string,index:int,thickness:{QUANTITY},"
    "material:struct<name:string,conductivity_s_per_m:double,temperature_coefficient_per_k:double,reference_temperature_k:double>>>,"
    "nets:array<struct<id:string,name:string>>,"
    f"copper_regions:array<struct<id:string,net_id:string,layer_id:string,outline:{OUTLINE},thickness:{QUANTITY}>>,"
    f"vias:array<struct<id:string,net_id:string,from_layer_id:string,to_layer_id:string,position:array<double>,finished_hole_diameter:{QUANTITY},plating_thickness:{QUANTITY},drill_diameter:{QUANTITY},padstack_name:string>>,"
    f"pads:array<struct<id:string,layer_id:string,position:array<double>,net_id:string,outline:{OUTLINE}>>,"
    "terminals:array<struct<id:string,name:string,net_id:string,pad_ids:array<string>,component_id:string>>,"
    "components:array<struct<id:string,reference_designator:string,terminal_ids:array<string>,part_number:string>>>"
)
TABLES = ("stackup", "nets", "copper_regions", "vias", "pads", "terminals", "components")
#: Largest document that is read.
MOST_BYTES = 64 << 20


def read(spark: SparkSession, path: str, version_key: str, version: int = 1) -> DataFrame:
    """(source_name, source_digest, board) of the documents under ``path``; another version or a larger file is an error.

    Files are read whole by the executors, and the digest is of the bytes.
    """
    files = spark.read.format("binaryFile").load(path)
    body = F.decode("content", "UTF-8")
    large = F.when(F.col("length") > MOST_BYTES, F.raise_error(F.lit("the document is too large")).cast("string")).otherwise(body)
    parsed = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("source_name"), F.sha2("content", 256).alias("source_digest"), large.alias("text"))
    found = F.get_json_object("text", f"$.{version_key}").cast("int")
    checked = F.when(found == version, F.get_json_object("text", "$.board")).otherwise(F.raise_error(F.concat(F.lit("unsupported version: "), F.coalesce(found.cast("string"), F.lit("none")))).cast("string"))
    return parsed.select("source_name", "source_digest", F.from_json(checked, BOARD, {"mode": "FAILFAST"}).alias("board"))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """One table for each list of a board, with board_id and pos, the place in the list."""
    out = {"board": documents.select(F.col("board.id").alias("board_id"), "board.name", "source_name", "source_digest", "board.notes")}
    for name in TABLES:
        each = documents.select(F.col("board.id").alias("board_id"), F.posexplode(f"board.{name}").alias("pos", "r"))
        out[name] = each.select("board_id", "pos", "r.*")
    return out


def diagnostics(parts: dict[str, DataFrame]) -> DataFrame:
    """(board_id, code, n, first): conductive layers without or with assumed thickness, and vias without barrel sizes."""
    conductive = parts["stackup"].where(F.col("function").isin("signal", "plane", "mixed"))
    incomplete = F.col("plating_thickness").isNull() | (F.col("finished_hole_diameter").isNull() & F.col("drill_diameter").isNull())
    found = [
        ("layer.thickness_missing", conductive.where(F.col("thickness").isNull())),
        ("layer.thickness_assumed", conductive.where(F.col("thickness.provenance") == "assumed")),
        ("via.incomplete", parts["vias"].where(incomplete)),
    ]
    rows = None
    for code, df in found:
        coded = df.select("board_id", F.lit(code).alias("code"), "pos", "id")
        rows = coded if rows is None else rows.unionByName(coded)
    return rows.groupBy("board_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "pos").alias("first"))


def points(ring: Column) -> Column:
    """array of struct(x, y) from the pairs of a document."""
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def rings(outline: Column) -> Column:
    """The outline's exterior and then its holes."""
    return F.concat(F.array(points(outline["exterior"])), F.transform(F.coalesce(outline["holes"], F.array().cast(f"array<{RING}>")), points))


def write(documents: DataFrame, path: str, version_key: str, version: int = 1) -> None:
    """Each board as one JSON line of its document; null fields are left out."""
    body = F.to_json("board")
    text = F.concat(F.lit(f'{{"{version_key}":{version},"board":'), body, F.lit("}"))
    documents.select(text.alias("value")).write.text(path)


def collect_boards(parts: dict[str, DataFrame]) -> DataFrame:
    """(board_id, board) from tables: the reverse of ``tables``, lists in the order of ``pos``."""
    out = parts["board"].select("board_id", F.col("board_id").alias("id"), "name", "notes")
    for name in TABLES:
        fields = [c for c in parts[name].columns if c not in ("board_id", "pos")]
        listed = parts[name].groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))).alias("l"))
        out = out.join(listed.select("board_id", F.transform("l", lambda x: x["r"]).alias(name)), "board_id", "left")
    return out.select("board_id", F.struct("id", "name", "notes", *TABLES).alias("board"))
