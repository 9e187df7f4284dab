"""Near-duplicate vectors by random-hyperplane signs, exact cosines and components.

Equal vectors of a label are one class.  Each class has a sign code in several
tables; classes that share label, table and code are compared by their exact
cosine in double precision, in blocks of bounded size.  A pair that meets in
several tables is counted in the first of them alone, which the codes that both
vectors carry tell, so links are counted without ever being listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ohmgrid.llm import blocks
from ohmgrid.llm.common import durable
from ohmgrid.operators.graph import connected_components

COSINE = 0.93
#: Chance that a pair just at the threshold shares a code in some table.
RECALL = 0.998
#: Classes that a code should hold on average if codes were even.
BUCKET = 256
SEED = 20240229


def code_shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a code, tables): codes grow with the logarithm of the classes, tables follow from the recall."""
    signs = min(40, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    meet = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(dims: int, signs: int, tables: int) -> np.ndarray:
    """Normals of all hyperplanes; the same in every task."""
    return np.random.default_rng([SEED, dims, signs, tables]).standard_normal((dims, tables * signs))


def codes(vectors: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """int64[n, tables]: the sign code of each vector in each table."""
    return unpacked(sign_bits(vectors, signs, tables), signs, tables)


def sign_bits(vectors: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """uint8[n, bytes]: the signs of each vector in all tables, packed."""
    return np.packbits(vectors @ planes(vectors.shape[1], signs, tables) > 0, axis=1)


def unpacked(packed: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """int64[n, tables]: codes from packed signs."""
    bits = np.unpackbits(packed, axis=1, count=tables * signs).reshape(len(packed), tables, signs)
    return bits.astype(np.int64) @ (1 << np.arange(signs, dtype=np.int64))


def _matrix(column) -> np.ndarray:
    """Arrow lists of one length as double[n, dims]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(column) -> Iterator[np.ndarray]:
    """Row numbers of each vector length, as only equal lengths can be compared."""
    lengths = column.value_lengths().to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _keyed(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column("vector")):
                own = batch.take(pa.array(rows))
                packed = sign_bits(_matrix(own.column("vector")), signs, tables)
                code = unpacked(packed, signs, tables)
                carried = pa.array([p.tobytes() for p in packed], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, carried, pa.array(np.full(len(rows), t, np.int32)), pa.array(code[:, t].copy())],
                        names=[*own.schema.names, "signs", "part", "code"],
                    )

    return run


def _compare(signs: int, tables: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.whole_runs(batches):
            lengths = table.column("vector").combine_chunks()
            for rows in _by_length(lengths):
                own = table.take(pa.array(rows)) if len(rows) < len(table) else table
                node, many = own.column("node").to_numpy(), own.column("n").to_numpy()
                part, label = own.column("part").to_numpy(), own.column("label").to_numpy()
                x = _matrix(own.column("vector"))
                # Carried, not made anew: a sum near zero may round to the other side in another batch.
                code = unpacked(np.frombuffer(b"".join(own.column("signs").to_pylist()), np.uint8).reshape(len(own), -1), signs, tables)
                # Scaled first, so that neither huge nor tiny components overflow.
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                links, forest = np.zeros(len(node), np.int64), blocks.Forest(len(node))

                def near(i, j, x=x, norm=norm, label=label):
                    return (label[i] == label[j]) & (np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine)

                run_ids, side = own.column("run").to_numpy(), own.column("side").to_numpy()
                for i, j in blocks.pair_steps(run_ids, side, near, most=50_000):
                    first = (code[i] == code[j]).argmax(axis=1) == part[i]
                    i, j = i[first], j[first]
                    np.add.at(links, i, many[j])
                    np.add.at(links, j, many[i])
                    forest.link(i, j)
                out = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[out]), pa.array(node[forest.root[out]]), pa.array(links[out])], names=["u", "v", "links"]
                )

    return run


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Only vectors of one length under one label that is not null are compared.
    Null, empty and zero vectors and those with null or non-finite components link
    with nothing.  Repeated rows are other vectors of their own.  A null key links
    like any other and is never the smallest; a component of null keys alone has a
    null id and is not kept.  An empty table gives no rows.
    """
    values = F.col(f"`{vector}`").cast("array<double>")
    largest = F.array_max(F.transform(values, F.abs))
    sound = (
        F.col(f"`{label}`").isNotNull()
        & (F.size(values) > 0)
        & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
        & (largest > 0)
        & (largest < F.lit(float("inf")))
    )
    rows = vectors.select(
        F.col(f"`{key}`").alias("key"),
        F.when(F.coalesce(sound, F.lit(False)), F.struct(F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))).alias("own"),
    )
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    live = rows.where(F.col("own").isNotNull())
    classes = durable(
        live.groupBy("own").agg(F.min("row").alias("node"), F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    signs, tables = code_shape(classes.count(), cosine, recall)
    flat = classes.select("node", "n", F.col("own.label").alias("label"), F.col("own.vector").alias("vector"))
    wide = StructType([*flat.schema.fields, StructField("signs", BinaryType()), StructField("part", IntegerType()), StructField("code", LongType())])
    keyed = flat.mapInArrow(_keyed(signs, tables), wide)
    keyed = keyed.select("node", "n", "part", "signs", "vector", F.xxhash64("label").alias("label"), F.xxhash64("label", "part", "code").alias("bucket"))
    compared = blocks.runs(keyed, "bucket", "node")
    found = durable(compared.mapInArrow(_compare(signs, tables, cosine), "u long, v long, links long"))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("u", "v")).withColumnRenamed("component", "root")
    of_class = (
        classes.join(parts, "node", "left")
        .join(counts, "node", "left")
        .select("own", "first", "n", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    of_class = durable(of_class)
    ids = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = durable(of_class.join(ids, "root").select("own", "n", "n_links", "component_id"))
    # Copies of one vector may fill a third of the table; their class is dealt into parts.
    out = blocks.dealt_join(live, linked, ["own"], ["row"]).select("key", "n_links", "component_id")
    alone = rows.where(F.col("own").isNull()).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return out.unionAll(alone).select(
        F.col("key").alias(key),
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
