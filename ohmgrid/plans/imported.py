"""From the tables of imported boards to voltages: any number of studies at once.

Copper of any outline is meshed on a grid through the axis-parallel edges of its
regions, pads and vias; slanted and curved edges are followed by cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmgrid.functions import units as U
from ohmgrid.functions.storage import durable
from ohmgrid.operators import fem, mesh, spatial

#: Coordinates of grid lines are rounded to a nanometre.
DIGITS = 9


@dataclass
class Board:
    """Tables of boards, lengths in metres; ``study`` tells them apart.

    layers: study, layer (from 0), z_mid, thickness, conductivity, tcr, reference_k
    regions: study, region_id, layer, rings (arrays of struct x, y: outline, then holes), thickness (null: the layer's)
    vias: study, via_id, x, y, low, high (layers), finished, drill, plating
    pads: study, contact, layer, rings; pads of one contact are an attachment group
    """

    layers: DataFrame
    regions: DataFrame
    vias: DataFrame
    pads: DataFrame


@dataclass
class Problem:
    """What a mesh and the copper decide; excitations can be solved on it one after another."""

    nodes: DataFrame
    elements: DataFrame
    contacts: DataFrame
    segments: DataFrame
    matrix: DataFrame


def grid_lines(board: Board, edges: DataFrame, pad_edges: DataFrame) -> DataFrame:
    """(study, axis, at): through axis-parallel edges, the ends of copper and the middles of vias."""
    parts = []
    for axis, other in (("x", "y"), ("y", "x")):
        for table in (edges, pad_edges):
            straight = table.where(F.abs(F.col(f"{axis}1") - F.col(f"{axis}2")) <= 1e-9)
            parts.append(straight.select("study", F.lit(axis).alias("axis"), F.col(f"{axis}1").alias("at")))
        ends = edges.groupBy("study").agg(F.min(f"{axis}1").alias("lo"), F.max(f"{axis}1").alias("hi"))
        parts.append(ends.select("study", F.lit(axis).alias("axis"), F.explode(F.array("lo", "hi")).alias("at")))
        parts.append(board.vias.select("study", F.lit(axis).alias("axis"), F.col(axis).alias("at")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("study", "axis", F.round("at", DIGITS).alias("at")).distinct()


def via_contacts(board: Board, nodes: DataFrame, plating: float | None) -> DataFrame:
    """(study, via_id, layer, node, barrel_area): the nodes under each barrel on the layers it spans."""
    made = board.vias.withColumn("barrel", U.barrel(F.col("finished"), F.col("drill"), F.col("plating"), F.lit(plating).cast("double"))).where(F.col("barrel").isNotNull())
    opened = made.withColumn("layer", F.explode(F.sequence(F.least("low", "high"), F.greatest("low", "high"))))
    discs = opened.select("study", "layer", F.struct("via_id", F.col("barrel.area").alias("area")).alias("via"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("barrel.radius").alias("radius"))
    places = nodes.select("study", "layer", F.struct("study", "layer", "node").alias("at"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    found = spatial.nodes_within(discs, places, "via", "at", ["study", "layer"], "radius")
    return found.select("at.study", "via.via_id", "at.layer", "at.node", F.col("via.area").alias("barrel_area"))


def pad_contacts(board: Board, pad_regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(study, contact, node) of the nodes in each pad, its edge included; a contact without any gets the node nearest to it."""
    places = nodes.select("study", "layer", F.struct("study", "layer", "node").alias("at"), F.col("x").alias("px"), F.col("y").alias("py"))
    inside = durable(spatial.points_in_regions(places, pad_regions, "at", "contact", ["study", "layer"], pad=1e-9).select("at.study", "contact", "at.node").distinct())
    middle = pad_regions.select("study", "layer", "contact", F.struct("study", "contact").alias("key"), F.get("edges", F.lit(0))["x1"].alias("px"), F.get("edges", F.lit(0))["y1"].alias("py"))
    bare = middle.join(inside.select("study", "contact").distinct(), ["study", "contact"], "left_anti").dropDuplicates(["study", "contact"])
    if bare.isEmpty():
        return inside
    near = spatial.nearest(bare, nodes.select("study", "layer", "node", F.col("x").alias("nx"), F.col("y").alias("ny")), "key", "node", ["study", "layer"])
    return inside.unionByName(near.select("key.study", "key.contact", "node"))


def build(board: Board, size: float, temperature_k: float | None = None, plating: float | None = None) -> Problem:
    """Meshes every study with elements no wider than ``size`` and assembles its matrix.

    A region's own thickness is used before its layer's, a via's own plating before
    the study's; conductivity follows the temperature where a coefficient is known.
    """
    edges = durable(board.regions.select("study", "layer", "region_id", F.explode(spatial.ring_edges(F.col("rings"))).alias("e")).select("study", "layer", "region_id", "e.*"))
    pad_regions = board.pads.select("study", "layer", "contact", spatial.ring_edges(F.col("rings")).alias("edges"))
    pad_edges = pad_regions.select("study", F.explode("edges").alias("e")).select("study", "e.*")
    grid = durable(mesh.cuts(grid_lines(board, edges, pad_edges), ["study", "axis"], size))
    cells = mesh.ring_cells(edges, grid, 8 * size).join(board.regions.select("study", "region_id", F.col("thickness").alias("own")), ["study", "region_id"])
    # Regions of one net may overlap; a cell is copper once.
    once = cells.groupBy(*mesh.CELL).agg(F.max("own").alias("own"))
    nodes, triangles = mesh.cell_mesh(once, ("own",))
    nodes, triangles = durable(nodes), durable(triangles)
    sigma = U.conductivity_at(F.col("conductivity"), F.col("tcr"), F.col("reference_k"), F.lit(temperature_k).cast("double"))
    layers = board.layers.select("study", "layer", "z_mid", F.col("thickness").alias("of_layer"), sigma.alias("sigma"))
    placed = fem.gradients(fem.with_corners(triangles, nodes)).join(layers, ["study", "layer"])
    depth = F.coalesce("own", "of_layer")
    elements = placed.withColumns({"thickness": depth, "gs": U.sheet_conductance(F.col("sigma"), depth)}).drop("own", "of_layer", "sigma", "z_mid")
    barrels = durable(via_contacts(board, nodes, plating))
    pads = pad_contacts(board, pad_regions, nodes)
    every = pads.unionByName(barrels.select("study", F.concat_ws("@", F.lit("via"), "via_id", "layer").alias("contact"), "node"))
    contacts = durable(fem.equipotential(every))
    hubs = barrels.groupBy("study", "via_id", "layer", "barrel_area").agg(F.min("node").alias("node"))
    # Barrels are of the copper of the uppermost layer that conducts.
    metal = layers.groupBy("study").agg(F.min_by("sigma", "layer").alias("metal"))
    unit = fem.via_segments(hubs, layers, 1.0).join(metal, "study")
    segments = durable(unit.select("study", "via_id", "upper", "lower", (F.col("conductance") * F.col("metal")).alias("conductance")))
    entries = fem.stiffness(elements).unionByName(fem.lumped(segments))
    return Problem(nodes, elements, contacts, segments, durable(fem.merge_unknowns(entries, contacts)))


def solve(problem: Problem, roles: DataFrame) -> DataFrame:
    """(study, contact, voltage, current) of ``roles`` (study, contact, voltage of a source or current of a load): a source's current is what it delivers."""
    unknowns = problem.contacts.select("study", "contact", "dof").distinct()
    asked = roles.join(unknowns, ["study", "contact"])
    given = asked.select("study", "dof", "voltage", (-F.col("current")).alias("current"))
    solution = durable(fem.solve(problem.matrix, given))
    met = asked.select("study", "contact", "dof", F.col("voltage").alias("held"), F.col("current").alias("drawn")).join(solution, ["study", "dof"])
    return met.select("study", "contact", "voltage", F.when(F.col("held").isNotNull(), F.col("source_current")).otherwise(F.col("drawn")).alias("current"))


def resistance(problem: Problem, probes: DataFrame) -> DataFrame:
    """(study, resistance_ohm) between the two contacts of ``probes`` (study, near, far): one ampere drawn at the far one, the near one at zero."""
    roles = probes.select("study", F.explode(F.array(
        F.struct(F.col("near").alias("contact"), F.lit(0.0).alias("voltage"), F.lit(None).cast("double").alias("current")),
        F.struct(F.col("far").alias("contact"), F.lit(None).cast("double").alias("voltage"), F.lit(1.0).alias("current")),
    )).alias("r")).select("study", "r.*")
    return solve(problem, roles).where(F.col("current").isNotNull()).join(probes.select("study", F.col("far").alias("contact")), ["study", "contact"]).select("study", (-F.col("voltage")).alias("resistance_ohm"))
