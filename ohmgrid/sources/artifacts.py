"""Result, checkpoint and document sinks: content-addressed, written once, published whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def put_document(documents: DataFrame, root: str, digest: str) -> str:
    """Writes a document's table under its digest; one that is there already is left as it is."""
    target = f"{root}/boards/{digest}"
    documents.write.mode("ignore").parquet(target)
    return target


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, name: str, manifest: dict) -> str:
    """Writes all tables and the manifest into a working folder, checks the manifest and renames the folder: readers see all or nothing."""
    working, final = f"{root}/{name}.working", f"{root}/{name}"
    if exists(spark, final):
        raise FileExistsError(final)
    for part, df in tables.items():
        df.write.mode("overwrite").parquet(f"{working}/{part}")
    text = json.dumps({**manifest, "tables": sorted(tables)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{working}/manifest")
    back = json.loads(spark.read.text(f"{working}/manifest").first()[0])
    missing = [part for part in back["tables"] if not exists(spark, f"{working}/{part}/_SUCCESS")]
    if missing:
        raise OSError(f"incomplete: {missing}")
    fs, source = _fs(spark, working)
    fs.rename(source, _fs(spark, final)[1])
    return final


def layer_fields(nodes: DataFrame, elements: DataFrame, root: str) -> None:
    """Nodes and elements partitioned by layer, the nodes renumbered from 0 within each."""
    renumbered = nodes.withColumn("local", F.row_number().over(W.partitionBy("study", "layer").orderBy("node")) - 1)
    renumbered.write.partitionBy("layer").parquet(f"{root}/nodes")
    elements.write.partitionBy("layer").parquet(f"{root}/elements")


def save_generation(history: DataFrame, root: str, signature: str, index: int) -> None:
    """One checkpoint of an adaptive run."""
    history.withColumn("signature", F.lit(signature)).write.mode("overwrite").parquet(f"{root}/generation-{index:04d}")


def load_generations(spark: SparkSession, root: str, signature: str, last: int) -> DataFrame | None:
    """The checkpoints up to ``last`` with this signature; unreadable or foreign ones are discarded."""
    out = None
    for index in range(last + 1):
        path = f"{root}/generation-{index:04d}"
        if not exists(spark, f"{path}/_SUCCESS"):
            break
        df = spark.read.parquet(path)
        if "signature" not in df.columns:
            break
        own = df.where(F.col("signature") == signature).drop("signature")
        out = own if out is None else out.unionByName(own)
    return out


def stale(spark: SparkSession, root: str) -> list[str]:
    """Working folders that a crash left behind."""
    fs, p = _fs(spark, root)
    return [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".working")]


def vtk_lines(nodes: DataFrame, elements: DataFrame, fields: list[str]) -> DataFrame:
    """(value) lines of a legacy ASCII VTK file of one study: points, triangles and a cell array for each field."""
    points = nodes.withColumn("local", F.row_number().over(W.partitionBy("study").orderBy("node")) - 1)
    named = elements
    for k in range(3):
        named = named.join(points.select("study", F.col("node").alias(f"n{k}"), F.col("local").alias(f"p{k}")), ["study", f"n{k}"])
    n_points, n_cells = nodes.count(), elements.count()
    head = ["# vtk DataFile Version 3.0", "conduction", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n_points} double"]
    spark = nodes.sparkSession
    text = lambda block, lines: spark.createDataFrame([(block, float(k), line) for k, line in enumerate(lines)], "block int, pos double, value string")
    out = text(0, head).unionByName(points.select(F.lit(1).alias("block"), F.col("local").cast("double").alias("pos"), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.lit("0")).alias("value")))
    out = out.unionByName(text(2, [f"CELLS {n_cells} {4 * n_cells}"]))
    out = out.unionByName(named.select(F.lit(3).alias("block"), F.col("tri").cast("double").alias("pos"), F.concat_ws(" ", F.lit("3"), *[F.col(f"p{k}").cast("string") for k in range(3)]).alias("value")))
    out = out.unionByName(text(4, [f"CELL_TYPES {n_cells}"])).unionByName(named.select(F.lit(5).alias("block"), F.col("tri").cast("double").alias("pos"), F.lit("5").alias("value")))
    for k, name in enumerate(fields):
        title = ([f"CELL_DATA {n_cells}"] if k == 0 else []) + [f"SCALARS {name} double 1", "LOOKUP_TABLE default"]
        out = out.unionByName(text(6 + 2 * k, title)).unionByName(named.select(F.lit(7 + 2 * k).alias("block"), F.col("tri").cast("double").alias("pos"), F.col(name).cast("string").alias("value")))
    return out.orderBy("block", "pos").select("value")
