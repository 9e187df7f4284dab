"""From boards to voltages, losses, resistances and convergence evidence."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions.storage import durable, shared_folder
from ohmgrid.functions.units import COPPER_CONDUCTIVITY
from ohmgrid.operators import fem, mesh, ordered, weighted
from ohmgrid.plans.boards import Board

PAD = "study string, contact string, layer int, px0 double, py0 double, px1 double, py1 double"


@dataclass
class Problem:
    """Tables of one meshed study."""

    nodes: DataFrame
    elements: DataFrame
    contacts: DataFrame
    segments: DataFrame
    matrix: DataFrame


def bind_pads(spark: SparkSession, board: Board, nodes: DataFrame) -> DataFrame:
    """(study, contact, node) of the nodes inside each pad, its edge included."""
    pads = spark.createDataFrame([(board.study, name, *r) for name, rects in board.pads.items() for r in rects], PAD)
    # A study has few pads.
    met = nodes.join(pads, ["study", "layer"])
    inside = F.col("x").between(F.col("px0") - 1e-9, F.col("px1") + 1e-9) & F.col("y").between(F.col("py0") - 1e-9, F.col("py1") + 1e-9)
    return met.where(inside).select("study", "contact", "node").distinct()


def bind_vias(spark: SparkSession, board: Board, nodes: DataFrame) -> DataFrame:
    """(study, via_id, layer, node, barrel_area): the node of each layer that is nearest to each barrel."""
    if not board.vias:
        return spark.createDataFrame([], "study string, via_id string, layer int, node long, barrel_area double")
    vias = spark.createDataFrame([(board.study, *v) for v in board.vias], "study string, via_id string, px double, py double, barrel_area double")
    met = nodes.join(vias, "study")
    near = F.min(F.struct(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("d"), "node")).alias("best")
    return met.groupBy("study", "via_id", "layer", "barrel_area").agg(near).select("study", "via_id", "layer", F.col("best.node").alias("node"), "barrel_area")


def build(spark: SparkSession, board: Board, size: float, order: str = "p1", lines: DataFrame | None = None) -> Problem:
    """Meshes, assembles and merges the unknowns of pads."""
    nodes, triangles = mesh.grid_mesh(board.rectangles(spark), size, lines)
    nodes, triangles = durable(nodes), durable(triangles)
    if order == "p2":
        nodes, triangles = fem.quadratic_nodes(triangles, nodes)
        nodes = durable(nodes)
    elements = fem.gradients(fem.with_corners(triangles, nodes)).withColumns({"gs": F.lit(COPPER_CONDUCTIVITY * board.thickness), "thickness": F.lit(board.thickness)})
    pads = fem.equipotential(bind_pads(spark, board, nodes))
    layers = spark.createDataFrame([(k, z) for k, z in board.layers.items()], "layer int, z_mid double")
    segments = fem.via_segments(bind_vias(spark, board, nodes), layers, COPPER_CONDUCTIVITY)
    entries = (fem.quadratic_stiffness if order == "p2" else fem.stiffness)(elements).unionByName(fem.lumped(segments))
    pads = durable(pads)
    return Problem(nodes, elements, pads, segments, fem.merge_unknowns(entries, pads))


def excite(problem: Problem, current: float = 1.0, source: str = "source", load: str = "load") -> DataFrame:
    """(study, dof, voltage, current): the source at zero volts, the load drawing ``current``."""
    unknowns = problem.contacts.select("study", "contact", "dof").distinct()
    return unknowns.where(F.col("contact").isin(source, load)).select(
        "study", "dof", F.when(F.col("contact") == source, F.lit(0.0)).alias("voltage"), F.when(F.col("contact") == load, F.lit(-current)).alias("current")
    )


@dataclass
class Result:
    problem: Problem
    solution: DataFrame
    voltages: DataFrame
    fields: DataFrame | None

    def terminals(self, current: float = 1.0) -> DataFrame:
        """(study, contact, voltage, current): source currents as solved, load currents as drawn."""
        unknowns = self.problem.contacts.select("study", "contact", "dof").distinct()
        met = unknowns.join(self.solution, ["study", "dof"])
        return met.select("study", "contact", "voltage", F.when(F.col("contact") == "source", F.col("source_current")).otherwise(F.lit(current)).alias("current"))

    def resistance(self, current: float = 1.0) -> DataFrame:
        """(study, resistance_ohm) between source and load."""
        t = self.terminals(current)
        volts = {c: F.max(F.when(F.col("contact") == c, F.col("voltage"))) for c in ("source", "load")}
        return t.groupBy("study").agg((F.abs(volts["source"] - volts["load"]) / current).alias("resistance_ohm"))

    def conservation(self, current: float = 1.0) -> DataFrame:
        """Totals of current and power at the terminals and in the copper, and their mismatch."""
        t = self.terminals(current)
        losses = self.fields.select("power").unionAll(fem.via_currents(self.problem.segments, self.voltages).select("power"))
        return weighted.conservation(t.where("contact = 'source'"), t.where("contact = 'load'"), losses)


def solve(spark: SparkSession, board: Board, size: float, order: str = "p1", current: float = 1.0, lines: DataFrame | None = None) -> Result:
    """One excitation of one board; fields are derived for linear elements."""
    problem = build(spark, board, size, order, lines)
    solution = durable(fem.solve(problem.matrix, excite(problem, current)))
    voltages = durable(fem.node_voltages(problem.nodes, problem.contacts, solution))
    fields = durable(fem.element_fields(problem.elements, voltages)) if order == "p1" else None
    return Result(problem, solution, voltages, fields)


GENERATION = "index int, dof_count long, element_count long, resistance_ohm double, change double, estimated_error double, imbalance_fraction double, power_mismatch_fraction double, marked_elements long, streak int, status string"


def refined_lines(fields: DataFrame, marked: DataFrame, ratio: float = 2.0, floor: float = 2e-6) -> DataFrame:
    """(study, axis, at): grid lines through the middles of marked elements whose halves would not fall below the floor."""
    own = fields.join(marked.select("study", "tri"), ["study", "tri"])
    box = own.select(
        "study", *[f(f"{a}0", f"{a}1", f"{a}2").alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.least), ("hi", F.greatest))]
    )
    both = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"lo{a}").alias("lo"), F.col(f"hi{a}").alias("hi")) for a in "xy"])
    each = box.select("study", F.explode(both).alias("b")).select("study", "b.*").distinct()
    kept = each.where((F.col("hi") - F.col("lo")) / ratio >= floor)
    return kept.select("study", "axis", ((F.col("lo") + F.col("hi")) / 2).alias("at")).distinct()


def adapt(
    spark: SparkSession, board: Board, size: float, target: float = 1e-2, passes: int = 6, most_dofs: int = 500_000, confirmations: int = 1, theta: tuple[int, int] = (7, 10)
) -> DataFrame:
    """History of an adaptive run (schema ``GENERATION``), one row a pass.

    A pass solves, estimates and marks; marked elements are halved by new grid
    lines, which stay.  The run has converged when resistance and estimate moved
    by no more than the target for ``confirmations`` passes in a row and current
    and power are conserved; a run that meets its budget first is resource limited.
    Lines are kept in the shared folder, so no pass depends on an executor.
    """
    folder = f"{shared_folder(spark)}/adaptive-{uuid.uuid4().hex}"
    lines, rows, streak = None, [], 0
    for index in range(passes):
        result = solve(spark, board, size, lines=lines)
        jumps = durable(fem.flux_jumps(result.fields))
        # Errors are marked as integers of a billionth of the largest.
        top = jumps.agg(F.max("eta")).first()[0] or 1.0
        scaled = jumps.withColumn("level", F.round(F.col("eta") / top * 1_000_000).cast("long"))
        marked = durable(ordered.mark(scaled, ["study"], "level", ["tri"], theta))
        r = result.resistance().first()["resistance_ohm"]
        error = math.sqrt(jumps.agg(F.sum(F.col("eta") * F.col("eta"))).first()[0] or 0.0)
        kept = result.conservation().first()
        dofs, elements = result.solution.count(), result.fields.count()
        previous = rows[-1] if rows else None
        change = abs(r - previous[3]) / abs(previous[3]) if previous and previous[3] else None
        moved = abs(error - previous[5]) / abs(previous[5]) if previous and previous[5] else None
        streak = streak + 1 if change is not None and moved is not None and change <= target and moved <= max(target, 0.25) else 0
        conserved = kept["imbalance_fraction"] <= 1e-6 and kept["power_mismatch_fraction"] <= 1e-6
        status = "CONVERGED" if streak >= confirmations and conserved else "RESOURCE_LIMITED" if dofs >= most_dofs or index == passes - 1 else "RUNNING"
        rows.append((index, dofs, elements, r, change, error, kept["imbalance_fraction"], kept["power_mismatch_fraction"], marked.count(), streak, status))
        if status != "RUNNING":
            break
        new = refined_lines(result.fields, marked)
        (new if lines is None else lines.unionByName(new).distinct()).write.parquet(f"{folder}/{index}")
        lines = spark.read.parquet(f"{folder}/{index}")
    return spark.createDataFrame(rows, GENERATION)
