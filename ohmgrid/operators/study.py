"""Studies: specs, connectivity, terminal results, solvers and the field payload."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.operators.graph import connected_components

# Fixed values: (target, passes, unknowns, confirmations) of the adaptive tiers.
TIERS = {"low": (1e-2, 6, 500_000, 1), "medium": (1e-3, 12, 2_000_000, 2), "high": (3e-4, 16, 8_000_000, 3)}

SPEC = "struct<kind:string,board_id:string,net_id:string,accuracy:string,source_terminal_ids:array<string>,source_terminal_id:string,to_terminal_ids:array<string>,to_terminal_id:string,source_voltage_v:double,loads:array<struct<terminal_ids:array<string>,terminal_id:string,current_a:double>>>"


def _group(plural: Column, single: Column) -> Column:
    """The plural list, else the single id of the older schema, else none."""
    return F.coalesce(plural, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))


def decode_specs(jobs: DataFrame, text: str = "spec_json") -> DataFrame:
    """``jobs`` with ``spec`` decoded; single ids of the older schema become groups of one."""
    raw = F.from_json(text, SPEC)
    loads = F.transform(
        F.coalesce(raw["loads"], F.array().cast("array<struct<terminal_ids:array<string>,terminal_id:string,current_a:double>>")),
        lambda x: F.struct(_group(x["terminal_ids"], x["terminal_id"]).alias("terminal_ids"), x["current_a"].alias("current_a")),
    )
    spec = F.struct(
        *[raw[c].alias(c) for c in ("kind", "board_id", "net_id", "accuracy", "source_voltage_v")],
        _group(raw["source_terminal_ids"], raw["source_terminal_id"]).alias("source_terminal_ids"), _group(raw["to_terminal_ids"], raw["to_terminal_id"]).alias("to_terminal_ids"), loads.alias("loads"),
    )
    return jobs.withColumn("spec", spec)


def encode_specs(jobs: DataFrame, spec: str = "spec") -> DataFrame:
    return jobs.withColumn("spec_json", F.to_json(spec))


def unit_load(spec: Column) -> Column:
    """Loads of a study: those of the spec, or one ampere at the far end of a resistance."""
    far = F.array(F.struct(spec["to_terminal_ids"].alias("terminal_ids"), F.lit(1.0).alias("current_a")))
    return F.when(spec["kind"] == "resistance", far).otherwise(spec["loads"])


def total_load(spec: Column) -> Column:
    return F.aggregate(spec["loads"], F.lit(0.0), lambda s, x: s + x["current_a"])


def signature(digest: Column, spec: Column, solver: str) -> Column:
    """Digest of all that decides the result; the order in which members were picked does not matter."""
    loads = F.array_sort(F.transform(spec["loads"], lambda x: F.struct(F.array_sort(x["terminal_ids"]).alias("ids"), x["current_a"].alias("a"))))
    parts = F.struct(
        digest.alias("board"), spec["kind"].alias("kind"), spec["net_id"].alias("net"), F.array_sort(spec["source_terminal_ids"]).alias("source"), spec["source_voltage_v"].alias("volt"),
        F.array_sort(spec["to_terminal_ids"]).alias("to"), loads.alias("loads"), spec["accuracy"].alias("accuracy"), F.lit(solver).alias("solver"),
    )
    return F.sha2(F.to_json(parts), 256)


def disconnected(links: DataFrame, terminals: DataFrame) -> DataFrame:
    """(study, terminal, first): terminals that do not reach their study's first terminal.

    ``links`` has (study, a, b) of graph nodes such as regions and vias, ``terminals``
    (study, terminal, pos, node).  A terminal without a node reaches nothing.
    """
    keyed = links.select(F.xxhash64("study", "a").alias("u"), F.xxhash64("study", "b").alias("v"))
    parts = connected_components(keyed)
    named = terminals.withColumn("u", F.xxhash64("study", "node")).join(parts.withColumnRenamed("node", "u"), "u", "left")
    placed = named.withColumn("part", F.when(F.col("node").isNotNull(), F.coalesce("component", "u")))
    first = F.first("part").over(W.partitionBy("study").orderBy("pos"))
    name = F.first("terminal").over(W.partitionBy("study").orderBy("pos"))
    return placed.withColumns({"first_part": first, "first": name}).where(~F.coalesce(F.col("part") == F.col("first_part"), F.lit(False))).select("study", "terminal", "first")


def terminal_results(sources: DataFrame, loads: DataFrame) -> DataFrame:
    """(study, terminal, dof, voltage, current): sources first, then loads; loads of one unknown once with their sum, none whose unknown a source has."""
    drawn = loads.groupBy("study", "dof").agg(F.min_by("terminal", "pos").alias("terminal"), F.max("voltage").alias("voltage"), F.sum("current").alias("current"), F.min("pos").alias("pos"))
    rest = drawn.join(sources.select("study", "dof").distinct(), ["study", "dof"], "left_anti")
    columns = ["study", "terminal", "dof", "voltage", "current", "pos"]
    both = sources.select(*columns, F.lit(0).alias("kind")).unionByName(rest.select(*columns, F.lit(1).alias("kind")))
    return both.orderBy("study", "kind", "pos").select("study", "terminal", "dof", "voltage", "current")


def echo_solver(sources: DataFrame, loads: DataFrame) -> DataFrame:
    """A stand-in without physics: boundary conditions as given, loads summed by terminal."""
    given = sources.select("study", "terminal", "voltage", F.lit(0.0).alias("current"))
    drawn = loads.groupBy("study", "terminal").agg(F.sum("current").alias("current")).select("study", "terminal", F.lit(None).cast("double").alias("voltage"), "current")
    return given.unionByName(drawn)


class Registry:
    """Named solvers or importers: a name is given once, and an unavailable one says why."""

    def __init__(self):
        self._known: dict[str, tuple[Callable | None, str]] = {}

    def add(self, name: str, make: Callable | None, why_not: str = "") -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        self._known[name] = (make, why_not)

    def get(self, name: str) -> Callable:
        make, why_not = self._known.get(name, (None, "it is not registered"))
        if make is None:
            raise LookupError(f"{name} is not available: {why_not}")
        return make

    def listing(self) -> list[tuple[str, bool, str]]:
        return sorted((name, make is not None, why_not) for name, (make, why_not) in self._known.items())


def field_payload(nodes: list[tuple[float, float, float]], triangles: list[tuple[int, int, int]]) -> bytes:
    """A layer's field for a viewer: two little-endian counts, then x, y, value of the nodes and corners of the triangles."""
    head = struct.pack("<II", len(nodes), len(triangles))
    return head + struct.pack(f"<{3 * len(nodes)}f", *[v for n in nodes for v in n]) + struct.pack(f"<{3 * len(triangles)}I", *[k for t in triangles for k in t])


def hit(points: DataFrame, inside: DataFrame, layers: DataFrame) -> DataFrame:
    """(p, region): the region drawn last on the topmost visible layer under each point.

    ``inside`` has (p, region, layer, drawn), ``layers`` (layer, rank, visible), rank 0 on top.
    """
    seen = inside.join(layers.where("visible"), "layer")
    best = seen.groupBy("p").agg(F.min_by("region", F.struct("rank", -F.col("drawn"))).alias("region"))
    return points.select("p").join(best, "p", "left")


def assign_cutouts(cutouts: DataFrame, outlines: DataFrame, inside: DataFrame) -> DataFrame:
    """(cutout, outline): the first outline that holds the cutout's point, the very first one if none does."""
    met = cutouts.select("cutout").join(inside.groupBy("cutout").agg(F.min("outline").alias("outline")), "cutout", "left")
    return met.select("cutout", F.coalesce("outline", F.lit(0)).alias("outline"))


def with_policy(asked: DataFrame) -> DataFrame:
    """``asked`` (tier, and any of target, passes, dofs, confirmations) with all four: a field that is given beats the tier's."""
    out = asked
    for k, name in enumerate(("target", "passes", "dofs", "confirmations")):
        of_tier = F.coalesce(*[F.when(F.col("tier") == tier, values[k]) for tier, values in TIERS.items()])
        out = out.withColumn(name, F.coalesce(F.col(name), of_tier) if name in asked.columns else of_tier)
    return out


def members(spec: Column) -> Column:
    """All ids that a spec names, each once: sources, far end and loads."""
    loads = F.flatten(F.transform(spec["loads"], lambda x: x["terminal_ids"]))
    return F.array_distinct(F.concat(spec["source_terminal_ids"], spec["to_terminal_ids"], loads))


def resolve(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, id): what ``asked`` (key, asked, studied) names by id or by name among ``known`` (id, name), null if nothing.

    The studied one wins, then an id before a name, then the smallest id.
    """
    wanted = asked.select(key, "asked", "studied")
    by_id = wanted.join(known.select("id").withColumn("asked", F.col("id")), "asked")
    by_name = wanted.join(known.select("id", F.col("name").alias("asked")), "asked")
    rank = F.struct((~F.coalesce(F.col("id") == F.col("studied"), F.lit(False))).alias("other"), (F.col("id") != F.col("asked")).alias("named"), "id")
    best = by_id.unionByName(by_name).groupBy(key).agg(F.min(rank).alias("best"))
    return wanted.select(key).join(best, key, "left").select(key, F.col("best.id").alias("id"))


def convergence_document(history: DataFrame, run: list[str], order: str) -> DataFrame:
    """(run, document): the passes of each run as one JSON document, in order; a run has tens of passes."""
    row = F.struct(order, *[c for c in history.columns if c not in (*run, order)])
    listed = history.groupBy(*run).agg(F.array_sort(F.collect_list(row)).alias("passes"))
    return listed.select(*run, F.to_json(F.struct(F.lit(1).alias("version"), "passes")).alias("document"))
