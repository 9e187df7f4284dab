"""Board review: stackups, layers, vias, nets, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Layer functions of the source format and what they are here.
LAYER_FUNCTIONS = {
    "CONDUCTOR": "signal",
    "CONDFILM": "signal",
    "CONDFOIL": "signal",
    "SIGNAL": "signal",
    "PLANE": "plane",
    "MIXED": "mixed",
    "DIELBASE": "dielectric",
    "DIELCORE": "dielectric",
    "DIELPREG": "dielectric",
    "DIELADHV": "dielectric",
    "SOLDERMASK": "solder_mask",
    "SILKSCREEN": "silkscreen",
}
CONDUCTIVE = ("signal", "plane", "mixed")
# Names of nets that are no nets.
PLACEHOLDER_NETS = ("no net", "")


def _over(group: list[str]):
    return W.partitionBy(*group) if group else W.partitionBy()


def layer_tops(layers: DataFrame, board: list[str], index: str, thickness: str) -> DataFrame:
    """Adds ``z_top``, the thickness above each layer; null from the first unknown thickness on. A stackup has tens of layers."""
    above = _over(board).orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    lost = F.coalesce(F.bool_or(F.col(thickness).isNull()).over(above), F.lit(False))
    zero = F.lit(0).cast(layers.schema[thickness].dataType)
    return layers.withColumn("z_top", F.when(~lost, F.coalesce(F.sum(thickness).over(above), zero)))


def layer_midplanes(layers: DataFrame, board: list[str], index: str, thickness: str) -> DataFrame:
    """Adds ``z_mid``; an unknown thickness is an error, as barrels need every one."""
    known = F.coalesce(F.col(thickness), F.raise_error(F.lit("a layer's thickness is unknown")).cast("double"))
    through = _over(board).orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    return layers.withColumn("z_mid", F.sum(known).over(through) - known / 2)


def classify_layers(layers: DataFrame, declared: str, thickness: str, group: list[str], order: str, names: dict[str, str] | None = None) -> DataFrame:
    """Adds ``function`` and ``idx``; unknown functions and layers without body that do not conduct are dropped."""
    names = names or LAYER_FUNCTIONS
    known = layers.withColumn("function", F.coalesce(*[F.when(F.col(declared) == k, v) for k, v in names.items()]))
    body = F.col("function").isin(*CONDUCTIVE) | (F.coalesce(F.col(thickness), F.lit(1.0)) > 0)
    kept = known.where(F.col("function").isNotNull() & body)
    return kept.withColumn("idx", F.row_number().over(_over(group).orderBy(F.col(order).asc_nulls_last())) - 1)


def real_net(name: Column) -> Column:
    """The net's name, or null for a placeholder."""
    return F.when(~F.lower(F.trim(name)).isin(*PLACEHOLDER_NETS), name)


def span_kind(vias: DataFrame, layers: DataFrame) -> DataFrame:
    """``vias`` (from_layer, to_layer) with ``kind``: through, blind, buried or unknown, by the ends that are outermost conductors."""
    outer = layers.where(F.col("function").isin(*CONDUCTIVE)).agg(F.min_by("layer_id", "idx").alias("top"), F.max_by("layer_id", "idx").alias("bottom"))
    met = vias.crossJoin(F.broadcast(outer))
    ends = sum((F.col(c).isin(F.col("top"), F.col("bottom")).cast("int") for c in ("from_layer", "to_layer")), F.lit(0))
    return met.withColumn("kind", F.when(ends == 2, "through").when(ends == 1, "blind").when(ends == 0, "buried").otherwise("unknown")).drop("top", "bottom")


def net_summary(nets: DataFrame, regions: DataFrame, vias: DataFrame, terminals: DataFrame, layers: DataFrame) -> DataFrame:
    """Per net, those without copper too: layers in stack order, counts, area; facts are aggregated before they are joined."""
    named = regions.join(layers.select("layer_id", "idx"), "layer_id")
    on_layers = F.transform(F.array_sort(F.collect_set(F.struct("idx", "layer_id"))), lambda x: x["layer_id"])
    copper = named.groupBy("net_id").agg(on_layers.alias("layers"), F.count(F.lit(1)).alias("region_count"), F.sum("area").alias("area"))
    out = nets.join(copper, "net_id", "left")
    for facts, name in ((vias, "via_count"), (terminals, "terminal_count")):
        out = out.join(facts.groupBy("net_id").agg(F.count(F.lit(1)).alias(name)), "net_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("region_count", "via_count", "terminal_count")]
    none = F.array().cast("array<string>")
    return out.select("net_id", "name", F.coalesce("layers", none).alias("layers"), *counts, F.coalesce("area", F.lit(0.0)).alias("area")).orderBy(F.lower("name"), "net_id")


def via_groups(vias: DataFrame) -> DataFrame:
    """Vias by span and drill with a null drill as a group; the padstack's name if all agree; most frequent first."""
    same = F.count_distinct(F.coalesce("padstack", F.lit("\0"))) == 1
    grouped = vias.groupBy("from_layer", "to_layer", "drill").agg(F.count(F.lit(1)).alias("n"), F.when(same, F.min("padstack")).alias("padstack"), F.min("pos").alias("first"))
    return grouped.orderBy(F.col("n").desc(), "first")


def layer_stats(layers: DataFrame, regions: DataFrame, sources: DataFrame, vias: DataFrame) -> DataFrame:
    """Per conductive layer: source features, regions, area, distinct nets and the vias whose span covers it."""
    from ohmgrid.operators.spatial import covering_counts

    conductive = layers.where(F.col("function").isin(*CONDUCTIVE)).select("layer_id", "idx")
    own = regions.groupBy("layer_id").agg(F.count(F.lit(1)).alias("regions"), F.sum("area").alias("area"), F.count_distinct("net_id").alias("nets"))
    raw = sources.groupBy("layer_id").agg(F.count(F.lit(1)).alias("features"))
    at = layers.select("layer_id", "idx")
    spans = vias.join(at.toDF("from_layer", "i"), "from_layer").join(at.toDF("to_layer", "j"), "to_layer")
    covered = covering_counts(spans, F.col("i"), F.col("j")).select("idx", F.col("n").alias("vias"))
    full = conductive.join(own, "layer_id", "left").join(raw, "layer_id", "left").join(covered, "idx", "left")
    return full.select("layer_id", "idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("features", "regions", "area", "nets", "vias")]).orderBy("idx")


def span_classes(vias: DataFrame, layers: DataFrame) -> DataFrame:
    """(from_row, to_row, n) among the conductive layers' rows; wider spans first, then the upper ones."""
    rows = layers.where(F.col("function").isin(*CONDUCTIVE)).select("layer_id", (F.row_number().over(W.partitionBy().orderBy("idx")) - 1).alias("row"))
    met = vias.join(rows.toDF("from_layer", "i"), "from_layer").join(rows.toDF("to_layer", "j"), "to_layer")
    classes = met.groupBy(F.least("i", "j").alias("from_row"), F.greatest("i", "j").alias("to_row")).agg(F.count(F.lit(1)).alias("n"))
    return classes.orderBy((F.col("to_row") - F.col("from_row")).desc(), "from_row")


def capability(found: Column, of: Column | None = None) -> Column:
    """missing, partial or available, from a count and the count there should be."""
    if of is None:
        return F.when(found == 0, "missing").otherwise("available")
    return F.when(found == of, "available").when(found > 0, "partial").otherwise("missing")


def readiness(needed: list[Column]) -> Column:
    out = F.lit(True)
    for count in needed:
        out = out & (count > 0)
    return F.when(out, "READY").otherwise("NOT_READY")


def diagnostics(parts: dict[str, DataFrame]) -> DataFrame:
    """(code, n, first) of offending rows (pos, subject) by code."""
    out = None
    for code, rows in parts.items():
        coded = rows.select(F.lit(code).alias("code"), F.col("pos").cast("long").alias("pos"), F.col("subject").cast("string").alias("subject"))
        out = coded if out is None else out.unionByName(coded)
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min_by("subject", "pos").alias("first"))


def matching(df: DataFrame, name: str, text: str) -> DataFrame:
    """Rows whose name holds the text, in any case."""
    return df.where(F.contains(F.lower(name), F.lit(text.lower())))


def terminals_by_component(terminals: DataFrame, components: DataFrame) -> DataFrame:
    """(component, terminals, n): sorted terminal names under the component's designator, or under ``component <id>`` where it is unknown; by name."""
    named = terminals.join(components.select("component_id", "refdes"), "component_id", "left")
    shown = F.coalesce("refdes", F.concat(F.lit("component "), F.col("component_id").cast("string")))
    return named.groupBy(shown.alias("component")).agg(F.array_sort(F.collect_list("name")).alias("terminals"), F.count(F.lit(1)).alias("n")).orderBy("component")


def board_list(boards: DataFrame, needed: list[Column]) -> DataFrame:
    """Stored boards with their readiness, the most recent first."""
    return boards.withColumn("readiness", readiness(needed)).orderBy(F.col("stored_at").desc(), "board_id")


def report_lines(layers: DataFrame) -> DataFrame:
    """(idx, line): the stackup of an inspection report, a line of fixed columns for each layer; thickness in micrometres."""
    known = F.format_string("%-4s %-12s %6.1f um", "layer_id", "function", "thickness")
    unknown = F.format_string("%-4s %-12s thickness unknown", "layer_id", "function")
    return layers.select("idx", F.when(F.col("thickness").isNull(), unknown).otherwise(known).alias("line"))
