"""Conduction on triangles: stiffness, assembly, solution, fields and error indicators.

Everything per element is a column expression; only the solution of a component's
linear system is an Arrow kernel.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmgrid.operators.graph import connected_components

DENSE = 1_500
TOLERANCE, MOST_ROUNDS, RESIDUAL_LIMIT = 1e-12, 20_000, 1e-6


def assemble(entries: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(row, col, val, n): coordinate entries with the duplicates summed, by partial aggregation."""
    return entries.groupBy(*(group or []), "row", "col").agg(F.sum("val").alias("val"), F.count(F.lit(1)).alias("n"))


def with_corners(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``triangles`` (study, n0, n1, n2) with x0, y0, ..., y2."""
    out = triangles
    for k in range(3):
        out = out.join(nodes.select("study", F.col("node").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), ["study", f"n{k}"])
    return out


def gradients(corners: DataFrame) -> DataFrame:
    """Adds twice the signed area and the barycentric gradients gx0, gy0, ..., gy2."""
    area2 = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    safe = F.when(F.abs(area2) > 1e-300, area2).otherwise(1e-300)
    out = corners.withColumn("area2", safe)
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        out = out.withColumns({f"gx{k}": (F.col(f"y{i}") - F.col(f"y{j}")) / F.col("area2"), f"gy{k}": (F.col(f"x{j}") - F.col(f"x{i}")) / F.col("area2")})
    return out


def stiffness(elements: DataFrame, gs: str = "gs") -> DataFrame:
    """(study, row, col, val): the nine entries of every linear element, in closed form."""
    area = F.abs("area2") / 2
    entries = [
        F.struct(F.col(f"n{i}").alias("row"), F.col(f"n{j}").alias("col"), (F.col(gs) * area * (F.col(f"gx{i}") * F.col(f"gx{j}") + F.col(f"gy{i}") * F.col(f"gy{j}"))).alias("val"))
        for i in range(3) for j in range(3)
    ]
    return elements.select("study", F.explode(F.array(*entries)).alias("e")).select("study", "e.*")


def quadratic_nodes(triangles: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) with an edge's midpoint as node n3 (of n0-n1), n4 (n1-n2), n5 (n2-n0).

    A midpoint's number follows from its edge's ends, so that both triangles of an
    edge name it alike without numbering all edges in one task.
    """
    def middle(a, b):
        return -(F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(1 << 60)) + 1)

    pairs = (("n0", "n1"), ("n1", "n2"), ("n2", "n0"))
    wide = triangles.withColumns({f"n{k + 3}": middle(a, b) for k, (a, b) in enumerate(pairs)})
    placed = with_corners(wide, nodes)
    mids = F.array(*[
        F.struct(F.col(f"n{k + 3}").alias("node"), ((F.col(f"x{a[1]}") + F.col(f"x{b[1]}")) / 2).alias("x"), ((F.col(f"y{a[1]}") + F.col(f"y{b[1]}")) / 2).alias("y")) for k, (a, b) in enumerate(pairs)
    ])
    extra = placed.select("study", "layer", F.explode(mids).alias("p")).select("study", "layer", "p.*").dropDuplicates(["study", "node"])
    return nodes.select("study", "layer", "node", "x", "y").unionByName(extra), wide


def lifted(triangles: DataFrame, values: DataFrame) -> DataFrame:
    """(study, node, value) at all nodes of quadratic triangles from (study, node, value) at their corners: a middle has the mean of its edge's ends."""
    out = triangles.select("study", *[f"n{k}" for k in range(6)])
    for k in range(3):
        out = out.join(values.select("study", F.col("node").alias(f"n{k}"), F.col("value").alias(f"v{k}")), ["study", f"n{k}"])
    pairs = [(f"n{k}", F.col(f"v{k}")) for k in range(3)] + [(f"n{k + 3}", (F.col(f"v{k}") + F.col(f"v{(k + 1) % 3}")) / 2) for k in range(3)]
    each = out.select("study", F.explode(F.array(*[F.struct(F.col(n).alias("node"), v.alias("value")) for n, v in pairs])).alias("p")).select("study", "p.*")
    return each.groupBy("study", "node").agg(F.max("value").alias("value"))


# Barycentric points of the three-point rule of second degree; each weighs a third.
QUADRATURE = ((2 / 3, 1 / 6, 1 / 6), (1 / 6, 2 / 3, 1 / 6), (1 / 6, 1 / 6, 2 / 3))


def quadratic_stiffness(elements: DataFrame, gs: str = "gs") -> DataFrame:
    """(study, row, col, val): the 36 entries of every quadratic element, exact by the three-point rule."""
    area = F.abs("area2") / 2

    def shape(k: int, at: tuple[float, float, float], axis: str):
        if k < 3:
            return F.col(f"g{axis}{k}") * (4 * at[k] - 1)
        i, j = k - 3, (k - 2) % 3
        return (F.col(f"g{axis}{j}") * at[i] + F.col(f"g{axis}{i}") * at[j]) * 4

    grads = elements.withColumns({f"s{q}{axis}{k}": shape(k, at, axis) for q, at in enumerate(QUADRATURE) for axis in "xy" for k in range(6)})
    entries = []
    for i in range(6):
        for j in range(6):
            total = sum((F.col(f"s{q}x{i}") * F.col(f"s{q}x{j}") + F.col(f"s{q}y{i}") * F.col(f"s{q}y{j}") for q in range(3)), F.lit(0.0))
            entries.append(F.struct(F.col(f"n{i}").alias("row"), F.col(f"n{j}").alias("col"), (F.col(gs) * area / 3 * total).alias("val")))
    return grads.select("study", F.explode(F.array(*entries)).alias("e")).select("study", "e.*")


def lumped(segments: DataFrame) -> DataFrame:
    """(study, row, col, val) of resistors (study, upper, lower, conductance), such as via barrels."""
    u, w, g = F.col("upper"), F.col("lower"), F.col("conductance")
    four = F.array(*[F.struct(a.alias("row"), b.alias("col"), v.alias("val")) for a, b, v in ((u, u, g), (w, w, g), (u, w, -g), (w, u, -g))])
    return segments.select("study", F.explode(four).alias("e")).select("study", "e.*")


def equipotential(contacts: DataFrame) -> DataFrame:
    """(study, contact, node, dof): the nodes of a contact share the smallest node's unknown; contacts that share a node are one."""
    keyed = contacts.select("study", "contact", "node").distinct()
    hubs = keyed.groupBy("study", "contact").agg(F.min("node").alias("hub"))
    stars = keyed.join(hubs, ["study", "contact"])
    if keyed.groupBy("study", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
        # No node is shared: every contact is an unknown of its own.
        return stars.select("study", "contact", "node", F.col("hub").alias("dof"))
    one = stars.withColumns({"u": F.xxhash64("study", "node"), "v": F.xxhash64("study", "hub")})
    parts = connected_components(one.select("u", "v"))
    named = one.join(parts.withColumnRenamed("node", "u"), "u", "left").withColumn("part", F.coalesce("component", "u"))
    roots = named.groupBy("study", "part").agg(F.min("node").alias("dof"))
    return named.join(roots, ["study", "part"]).select("study", "contact", "node", "dof")


def merge_unknowns(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """``entries`` with the nodes of contacts replaced by their unknown, duplicates summed."""
    names = merged.select("study", "node", "dof").distinct()
    row = names.select("study", F.col("node").alias("row"), F.col("dof").alias("rdof"))
    col = names.select("study", F.col("node").alias("col"), F.col("dof").alias("cdof"))
    mapped = entries.join(row, ["study", "row"], "left").join(col, ["study", "col"], "left")
    return assemble(mapped.select("study", F.coalesce("rdof", "row").alias("row"), F.coalesce("cdof", "col").alias("col"), "val"), ["study"])


class NotConverged(RuntimeError):
    """The linear solution missed its tolerance."""


class Disconnected(RuntimeError):
    """A current is injected into copper without a path to any voltage."""


def conjugate_gradients(row: np.ndarray, col: np.ndarray, val: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Jacobi-preconditioned conjugate gradients on a symmetric coordinate matrix; not reaching the tolerance is an error."""
    n = len(rhs)
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    diagonal = np.bincount(row[row == col], val[row == col], n)
    x, r = np.zeros(n), rhs.copy()
    z = r / diagonal
    p, rz, scale = z.copy(), float(r @ z), float(np.linalg.norm(rhs))
    if scale == 0:
        return x
    for _ in range(MOST_ROUNDS):
        q = np.bincount(row, val * p[col], n)
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        if np.linalg.norm(r) <= TOLERANCE * scale:
            return x
        z = r / diagonal
        rz, old = float(r @ z), rz
        p = z + (rz / old) * p
    raise NotConverged(f"residual {np.linalg.norm(r) / scale:.2e} after {MOST_ROUNDS} rounds")


def solve_system(row: np.ndarray, col: np.ndarray, val: np.ndarray, fixed: dict[int, float], injected: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unknowns, potentials, current into each): fixed potentials are eliminated; copper without one stays NaN."""
    unknowns, flat = np.unique(np.concatenate((row, col)), return_inverse=True)
    r, c = flat[: len(row)], flat[len(row) :]
    n = len(unknowns)
    label = np.arange(n)
    while True:  # components by label hooking
        low = np.minimum(label[r], label[c])
        new = label.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = {int(u): k for k, u in enumerate(unknowns)}
    volts, rhs = np.full(n, np.nan), np.zeros(n)
    for u, v in fixed.items():
        if u in at:
            volts[at[u]] = v
    driven = np.isin(label, np.unique(label[~np.isnan(volts)]))
    for u, current in injected.items():
        if current and (u not in at or not driven[at[u]]):
            raise Disconnected("a load lies on copper without a path to any source")
        if u in at:
            rhs[at[u]] += current
    free = driven & np.isnan(volts)
    index = np.cumsum(free) - 1
    known = np.where(np.isnan(volts), 0.0, volts)
    if free.any():
        inner = free[r] & free[c]
        edge = free[r] & ~free[c]
        b = rhs[free] - np.bincount(index[r[edge]], val[edge] * known[c[edge]], int(free.sum()))
        fr, fc, fv = index[r[inner]], index[c[inner]], val[inner]
        if free.sum() <= DENSE:
            dense = np.zeros((int(free.sum()),) * 2)
            np.add.at(dense, (fr, fc), fv)
            x = np.linalg.solve(dense, b)
            x += np.linalg.solve(dense, b - dense @ x)
        else:
            x = conjugate_gradients(fr, fc, fv, b)
        residual = np.linalg.norm(b - np.bincount(fr, fv * x[fc], len(b))) / max(np.linalg.norm(b), 1e-300)
        if not residual <= RESIDUAL_LIMIT:
            raise NotConverged(f"residual {residual:.2e}")
        volts[free] = x
    flux = np.bincount(r, val * np.nan_to_num(volts)[c], n) - rhs
    return unknowns, volts, np.where(driven, flux, 0.0)


def solve(matrix: DataFrame, excitation: DataFrame) -> DataFrame:
    """(study, dof, voltage, source_current): one kernel a study; voltage is null on copper that nothing drives.

    ``matrix`` has (study, row, col, val), ``excitation`` (study, dof, voltage,
    current) with a fixed voltage or an injected current, loads being negative.
    """

    def run(key: tuple, entries: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not given["voltage"].notna().any():
            raise Disconnected("an excitation needs at least one fixed potential")
        held = given[given["voltage"].notna()]
        if (held.groupby("dof")["voltage"].nunique() > 1).any():
            raise ValueError("two sources hold one unknown at different potentials")
        fixed = dict(zip(held["dof"], held["voltage"], strict=True))
        drawn = given[given["current"].notna()].groupby("dof")["current"].sum().to_dict()
        dof, volts, flux = solve_system(entries["row"].to_numpy(), entries["col"].to_numpy(), entries["val"].to_numpy(), fixed, drawn)
        source = np.where(np.isin(dof, list(fixed)), flux, np.nan)
        return pd.DataFrame({"study": key[0], "dof": dof, "voltage": volts, "source_current": source})

    kind = matrix.schema["study"].dataType.simpleString()
    given = excitation.select(F.col("study").alias("of_study"), F.col("dof").alias("at"), "voltage", "current").toDF("of_study", "dof", "voltage", "current")
    solved = matrix.select("study", "row", "col", "val").groupBy("study").cogroup(given.groupBy("of_study")).applyInPandas(
        run, f"study {kind}, dof long, voltage double, source_current double"
    )
    return solved.select("study", "dof", F.nanvl("voltage", F.lit(None)).alias("voltage"), F.nanvl("source_current", F.lit(None)).alias("source_current"))


def solve_distributed(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-10, most_rounds: int = 2_000) -> DataFrame:
    """(dof, x) of one symmetric positive definite system too large for a task, by preconditioned conjugate gradients.

    ``matrix`` has (row, col, val) without fixed unknowns, ``rhs`` (dof, b).  Every
    round is one join of the matrix with the direction, one aggregate and a few
    scalars; the vectors are cut from their lineage each round in the shared folder.
    Missing the tolerance is an error.
    """
    from ohmgrid.functions.storage import durable

    entries = durable(matrix.select("row", "col", "val").repartition("row"))
    diagonal = entries.where("row = col").select(F.col("row").alias("dof"), F.col("val").alias("d"))
    full = diagonal.join(rhs.select("dof", "b"), "dof", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    state = durable(full.select("dof", "d", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("d")).alias("p")))
    norms = state.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz")).first()
    scale, rz = norms["rr"] or 0.0, norms["rz"]
    if not scale:
        return state.select("dof", "x")
    for _ in range(most_rounds):
        product = entries.join(state.select(F.col("dof").alias("col"), "p"), "col").groupBy(F.col("row").alias("dof")).agg(F.sum(F.col("val") * F.col("p")).alias("q"))
        met = durable(state.join(product, "dof"))
        step = rz / met.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = met.select("dof", "d", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        norms = moved.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz")).first()
        if norms["rr"] <= tolerance * tolerance * scale:
            return moved.select("dof", "x")
        turn, rz = norms["rz"] / rz, norms["rz"]
        state = durable(moved.withColumn("p", F.col("r") / F.col("d") + turn * F.col("p")))
    raise NotConverged(f"residual {(norms['rr'] / scale) ** 0.5:.2e} after {most_rounds} rounds")


def node_voltages(nodes: DataFrame, merged: DataFrame, solution: DataFrame) -> DataFrame:
    """(study, node, voltage) of all nodes, those of contacts through their unknown."""
    named = nodes.select("study", "node").join(merged.select("study", "node", "dof").distinct(), ["study", "node"], "left")
    return named.withColumn("dof", F.coalesce("dof", "node")).join(solution.select("study", "dof", "voltage"), ["study", "dof"], "left").select("study", "node", "voltage")


def element_fields(elements: DataFrame, voltages: DataFrame, gs: str = "gs", thickness: str = "thickness") -> DataFrame:
    """``elements`` with area, ex, ey, j_sheet, j_vol and power of linear elements; undriven copper counts as zero volts."""
    out = elements
    for k in range(3):
        out = out.join(voltages.select("study", F.col("node").alias(f"n{k}"), F.coalesce("voltage", F.lit(0.0)).alias(f"v{k}")), ["study", f"n{k}"])
    gx = sum((F.col(f"v{k}") * F.col(f"gx{k}") for k in range(3)), F.lit(0.0))
    gy = sum((F.col(f"v{k}") * F.col(f"gy{k}") for k in range(3)), F.lit(0.0))
    area = F.abs("area2") / 2
    j = F.col(gs) * F.hypot(gx, gy)
    return out.withColumns({
        "area": area, "ex": -gx, "ey": -gy, "j_sheet": j, "j_vol": j / F.greatest(F.col(thickness), F.lit(1e-300)), "power": F.col(gs) * (gx * gx + gy * gy) * area,
    })


def flux_jumps(fields: DataFrame, gs: str = "gs") -> DataFrame:
    """(study, tri, eta): error indicators from the jumps of the normal current across edges.

    Every triangle sends its outward flux to its three edges; the sum over an edge
    is the jump, and on a boundary the current that leaks out.
    """
    turn = F.signum("area2")
    sides = []
    for k in range(3):
        j = (k + 1) % 3
        dx, dy = F.col(f"x{j}") - F.col(f"x{k}"), F.col(f"y{j}") - F.col(f"y{k}")
        length = F.hypot(dx, dy)
        # The gradient is minus the field.
        flux = -F.col(gs) * (F.col("ex") * dy - F.col("ey") * dx) * turn / F.greatest(length, F.lit(1e-300))
        sides.append(F.struct(F.least(f"n{k}", f"n{j}").alias("a"), F.greatest(f"n{k}", f"n{j}").alias("b"), length.alias("length"), flux.alias("flux")))
    each = fields.select("study", "tri", F.explode(F.array(*sides)).alias("s")).select("study", "tri", "s.*")
    jumps = each.groupBy("study", "a", "b").agg(F.sum("flux").alias("jump"), F.max("length").alias("length"))
    met = each.select("study", "tri", "a", "b").join(jumps, ["study", "a", "b"])
    # A linear flux is constant along an edge: its square integrates to length x jump^2.
    return met.groupBy("study", "tri").agg(F.sqrt(F.sum(0.5 * F.col("length") * F.col("length") * F.col("jump") * F.col("jump"))).alias("eta"))


def goal_weighted(jumps: DataFrame) -> DataFrame:
    """(study, tri, eta) of indicators weighted for the terminal resistance.

    The resistance is the energy of a unit current, which is its own adjoint, so the
    weight of an element is its indicator.
    """
    return jumps.select("study", "tri", (F.col("eta") * F.col("eta")).alias("eta"))


def via_currents(segments: DataFrame, voltages: DataFrame) -> DataFrame:
    """(study, via_id, current, power): the segment current of the largest size, positive downwards, and the dissipation of all."""
    u = voltages.select("study", F.col("node").alias("upper"), F.col("voltage").alias("vu"))
    w = voltages.select("study", F.col("node").alias("lower"), F.col("voltage").alias("vl"))
    met = segments.join(u, ["study", "upper"]).join(w, ["study", "lower"]).where(F.col("vu").isNotNull() & F.col("vl").isNotNull())
    met = met.withColumn("i", F.col("conductance") * (F.col("vu") - F.col("vl")))
    drop = F.col("vu") - F.col("vl")
    return met.groupBy("study", "via_id").agg(F.max_by("i", F.abs("i")).alias("current"), F.sum(F.col("conductance") * drop * drop).alias("power"))


def via_segments(contacts: DataFrame, layers: DataFrame, conductivity: float) -> DataFrame:
    """(study, via_id, upper, lower, conductance) between neighbouring connected layers of each via.

    ``contacts`` has (study, via_id, layer, node, barrel_area), ``layers`` (layer, z_mid)
    of one stackup, or (study, layer, z_mid) of many.
    """
    from ohmgrid.operators.ordered import adjacent_pairs

    if "study" in layers.columns:
        placed = contacts.join(layers.select("study", "layer", "z_mid"), ["study", "layer"])
    else:
        placed = contacts.join(layers.select("layer", "z_mid"), "layer")
    pairs = adjacent_pairs(placed, ["study", "via_id"], ["z_mid", "layer"], ["z_mid", "node", "barrel_area"])
    length = F.col("next_z_mid") - F.col("z_mid")
    kept = pairs.where(length > 0)
    return kept.select("study", "via_id", F.col("node").alias("upper"), F.col("next_node").alias("lower"), (F.lit(conductivity) * F.col("barrel_area") / length).alias("conductance"))
