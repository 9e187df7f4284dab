"""IPC-2581 documents: bounded parse, sections as tables, and the board extracted from them.

Files are read whole by the executors.  A parser kernel turns each into rows of
(source, section, pos, json) in document order, because the order of segments and
curves in a polygon matters and Spark's own XML reader groups children by tag.
Everything after that is column expressions.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.functions import quantities as Q
from ohmgrid.functions import rings
from ohmgrid.functions.storage import durable
from ohmgrid.functions.units import unit_scale
from ohmgrid.operators import review, spatial
from ohmgrid.sources import markup

MOST_BYTES, MOST_DEPTH, MOST_ELEMENTS = 512 << 20, 100, 20_000_000
# Revisions that are known, and those that are read.
KNOWN_REVISIONS, READ_REVISIONS = ("A", "B", "C"), ("B",)

STEP = "struct<kind:string,x:double,y:double,cx:double,cy:double,clockwise:boolean>"
SHAPE = f"kind:string,x:double,y:double,rotation:double,mirror:boolean,width:double,height:double,diameter:double,radius:double,rounded:array<boolean>,round:boolean,space:string,ref:string,steps:array<{STEP}>,holes:array<array<{STEP}>>"
SECTIONS = {
    "header": "struct<revision:string,units:string,elements:bigint,sections:array<string>,generator:string>",
    "dictionary": f"struct<within:string,id:string,primitive:int,{SHAPE}>",
    "layer": "struct<name:string,function:string,side:string,polarity:string>",
    "stackup": "struct<layer:string,thickness:double,sequence:double,material:string>",
    "outline": f"struct<cutout:boolean,steps:array<{STEP}>>",
    "hole": "struct<name:string,net:string,diameter:double,plating:string,x:double,y:double,from_layer:string,to_layer:string,padstack:string>",
    "pad": f"struct<net:string,layer:string,component:string,pin:string,tag:string,primitive:int,{SHAPE}>",
    "component": "struct<refdes:string,part:string,layer:string>",
    "pin": "struct<net:string,component:string,pin:string>",
    "feature": f"struct<layer:string,set:int,feature:int,net:string,polarity:string,tag:string,primitive:int,{SHAPE}>",
    "unknown": "struct<label:string>",
}
ROW = "source string, section string, pos long, body string"


class Refused(ValueError):
    """The document may not be parsed."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_bounded(content: bytes, most_bytes: int = MOST_BYTES, most_depth: int = MOST_DEPTH, most_elements: int = MOST_ELEMENTS) -> tuple[ElementTree.Element, int]:
    """(root, number of elements); size, depth, count and declarations are checked while reading."""
    if len(content) > most_bytes:
        raise Refused("the document is too large")
    head = content[: markup.PROLOG].decode("utf-8", "replace").upper().replace(" ", "")
    if "<!DOCTYPE" in head or "<!ENTITY" in head:
        raise Refused("the document declares a type or an entity")
    depth = count = 0
    root = None
    try:
        for event, element in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
            depth += 1 if event == "start" else -1
            count += event == "start"
            root = element if root is None else root
            if depth > most_depth or count > most_elements:
                raise Refused("the document is nested too deeply or has too many elements")
    except ElementTree.ParseError as error:
        raise Refused("the document is not well formed") from error
    return root, count


def _number(e: ElementTree.Element, name: str, default: float | None = None) -> float | None:
    """A finite number; anything else is refused without repeating what the document said."""
    text = e.get(name)
    if text is None:
        return default
    try:
        value = float(text)
    except ValueError:
        value = float("nan")
    if value != value or value in (float("inf"), float("-inf")):
        raise Refused(f"attribute {name} of {_local(e.tag)} is not a number")
    return value


def _child(e: ElementTree.Element, *names: str) -> ElementTree.Element | None:
    return next((c for c in e if _local(c.tag) in names), None)


def _children(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [c for c in e if _local(c.tag) in names]


def _steps(e: ElementTree.Element) -> list[dict]:
    """Begin, segments and curves of a polygon or polyline, in document order."""
    kinds = {"PolyBegin": "begin", "PolyStepSegment": "segment", "PolyStepCurve": "curve"}
    return [
        {"kind": kinds[_local(c.tag)], "x": _number(c, "x"), "y": _number(c, "y"), "cx": _number(c, "centerX"), "cy": _number(c, "centerY"), "clockwise": (c.get("clockwise") or "").lower() == "true"}
        for c in e if _local(c.tag) in kinds
    ]


def _boolean(e: ElementTree.Element, name: str) -> bool:
    return (e.get(name) or "").lower() == "true"


def _primitive(c: ElementTree.Element) -> dict | None:
    """One primitive, or null for an element that is none that is known."""
    kind = _local(c.tag)
    desc = _child(c, "LineDesc")
    line = {} if desc is None else {"width": _number(desc, "lineWidth"), "round": (desc.get("lineEnd") or "ROUND").upper() != "NONE"}
    if kind == "Line":
        return line | {"kind": "path", "steps": [{"kind": k, "x": _number(c, f"{p}X"), "y": _number(c, f"{p}Y")} for k, p in (("begin", "start"), ("segment", "end"))]}
    if kind == "Arc":
        curve = {"kind": "curve", "x": _number(c, "endX"), "y": _number(c, "endY"), "cx": _number(c, "centerX"), "cy": _number(c, "centerY"), "clockwise": _boolean(c, "clockwise")}
        return line | {"kind": "path", "steps": [{"kind": "begin", "x": _number(c, "startX"), "y": _number(c, "startY")}, curve]}
    if kind == "Polyline":
        return line | {"kind": "path", "steps": _steps(c)}
    if kind == "Contour":
        inner = _child(c, "Polygon")
        return {"kind": "polygon", "steps": _steps(inner) if inner is not None else [], "holes": [_steps(h) for h in _children(c, "Cutout")]}
    if kind == "Polygon":
        return {"kind": "polygon", "steps": _steps(c), "holes": []}
    if kind == "Circle":
        return {"kind": "circle", "diameter": _number(c, "diameter")}
    if kind in ("RectCenter", "Oval"):
        return {"kind": "rectangle" if kind == "RectCenter" else "oval", "width": _number(c, "width"), "height": _number(c, "height")}
    if kind == "RectRound":
        corners = ("lowerLeft", "lowerRight", "upperRight", "upperLeft")
        named = any(c.get(n) for n in corners)
        return {"kind": "round_rectangle", "width": _number(c, "width"), "height": _number(c, "height"), "radius": _number(c, "radius", 0.0), "rounded": [not named or _boolean(c, n) for n in corners]}
    if kind in ("StandardPrimitiveRef", "UserPrimitiveRef"):
        return {"kind": "ref", "space": "user" if kind.startswith("User") else "standard", "ref": c.get("id")}
    return None


def _shapes(e: ElementTree.Element) -> tuple[list[dict], list[str]]:
    """The primitives in ``e`` in order, those of a UserSpecial too, with the placement beside them; and the tags of what is not known."""
    place, form = _child(e, "Location"), _child(e, "Xform")
    at = {
        "x": _number(place, "x", 0.0) if place is not None else 0.0, "y": _number(place, "y", 0.0) if place is not None else 0.0,
        "rotation": _number(form, "rotation", 0.0) if form is not None else 0.0, "mirror": form is not None and _boolean(form, "mirror"),
    }
    found, unknown = [], []
    for c in (x for child in e for x in (child if _local(child.tag) == "UserSpecial" else [child])):
        shape = _primitive(c)
        if shape:
            found.append(at | {"tag": _local(c.tag), "primitive": len(found)} | shape)
        elif _local(c.tag) not in _BESIDE:
            unknown.append(_local(c.tag))
    return found, unknown


# What stands beside primitives and is none.
_BESIDE = {"Location", "Xform", "PinRef", "LineDesc", "FillDesc", "Span", "ColorRef", "ColorGroup", "NonstandardAttribute", "SpecRef", "Comment"}


def sections(content: bytes) -> Iterator[tuple[str, dict]]:
    """(section, body) rows of one document, in document order."""
    root, count = parse_bounded(content)
    revision = root.get("revision")
    units = None
    generator = None
    for e in root.iter():
        name = _local(e.tag)
        if name == "CadHeader" and e.get("units"):
            units = e.get("units")
        elif name in ("SoftwarePackage", "HistoryRecord") and not generator:
            generator = next((v for v in (e.get("name"), e.get("software"), e.get("origination")) if v and v.upper() != "UNKNOWN"), None)
    if units is None:
        units = next((e.get("units") for e in root.iter() if e.get("units")), None)
    yield "header", {"revision": revision, "units": units, "elements": count, "sections": sorted({_local(c.tag) for c in root}), "generator": generator}
    yield from element_rows(root)


def element_rows(root: ElementTree.Element) -> Iterator[tuple[str, dict]]:
    """(section, body) of the elements below ``root`` and of itself, in document order."""
    for e in root.iter():
        name = _local(e.tag)
        if name in ("EntryStandard", "EntryUser"):
            shapes, unknown = _shapes(e)
            for shape in shapes:
                yield "dictionary", {"within": "user" if name == "EntryUser" else "standard", "id": e.get("id"), **shape}
            for tag in unknown or ([] if shapes else ["empty"]):
                yield "unknown", {"label": f"{name}/{tag}"}
        elif name == "Layer" and e.get("layerFunction"):
            yield "layer", {"name": e.get("name"), "function": e.get("layerFunction"), "side": e.get("side"), "polarity": e.get("polarity")}
        elif name == "StackupLayer":
            material = [s.get("value") or s.text for s in e.iter() if _local(s.tag) == "Material" and (s.get("value") or s.text)]
            yield "stackup", {"layer": e.get("layerOrGroupRef"), "thickness": _number(e, "thickness"), "sequence": _number(e, "sequence"), "material": material[-1] if material else None}
        elif name == "Profile":
            for c in _children(e, "Polygon", "Cutout"):
                yield "outline", {"cutout": _local(c.tag) == "Cutout", "steps": _steps(c)}
        elif name == "PadStack":
            for c in _children(e, "LayerHole"):
                span = _child(c, "Span")
                yield "hole", {"name": c.get("name"), "net": e.get("net"), "diameter": _number(c, "diameter"), "plating": c.get("platingStatus"), "x": _number(c, "x"), "y": _number(c, "y"), "padstack": e.get("name"),
                               "from_layer": span.get("fromLayer") if span is not None else None, "to_layer": span.get("toLayer") if span is not None else None}
            for c in _children(e, "LayerPad"):
                (shapes, unknown), pin = _shapes(c), _child(c, "PinRef")
                for tag in unknown:
                    yield "unknown", {"label": f"LayerPad/{tag}"}
                for shape in shapes:
                    yield "pad", {"net": e.get("net"), "layer": c.get("layerRef"), "component": pin.get("componentRef") if pin is not None else None, "pin": pin.get("pin") if pin is not None else None, **shape}
        elif name == "Component":
            yield "component", {"refdes": e.get("refDes"), "part": e.get("part"), "layer": e.get("layerRef")}
        elif name == "LogicalNet":
            for c in _children(e, "PinRef"):
                yield "pin", {"net": e.get("name"), "component": c.get("componentRef"), "pin": c.get("pin")}
        elif name == "LayerFeature":
            for s, group in enumerate(_children(e, "Set")):
                for f, c in enumerate(_children(group, "Features")):
                    shapes, unknown = _shapes(c)
                    for shape in shapes:
                        yield "feature", {"layer": e.get("layerRef"), "set": s, "feature": f, "net": group.get("net"), "polarity": group.get("polarity"), **shape}
                    for tag in unknown:
                        yield "unknown", {"label": f"Features/{tag}"}
                for c in _children(group, "Hole"):
                    yield "hole", {"name": c.get("name"), "net": group.get("net"), "diameter": _number(c, "diameter"), "plating": c.get("platingStatus"), "x": _number(c, "x"), "y": _number(c, "y")}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source, section, pos, body) of all documents under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(source, name, pos, json.dumps(body)) for pos, (name, body) in enumerate(sections(bytes(content)))]
                yield pd.DataFrame(rows, columns=["source", "section", "pos", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ROW)


def body_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """A table for each section, with source and pos."""
    return {
        name: rows.where(F.col("section") == name).select("source", "pos", F.from_json("body", kind).alias("r")).select("source", "pos", "r.*")
        for name, kind in SECTIONS.items()
    }


def sections_of(rows: DataFrame) -> dict[str, DataFrame]:
    """A table for each section, with source and pos; the header's units give ``scale``, metres of one unit."""
    out = body_tables(rows)
    return out | {"header": with_revision(out["header"])}


def with_revision(head: DataFrame) -> DataFrame:
    """Headers with the state of their revision and the scale of their units."""
    plain = F.upper(F.regexp_replace(F.trim(F.coalesce("revision", F.lit(""))), "(?i)^(ipc-?2581|rev(ision)?)[-_ ]*", ""))
    state = F.when(plain.isin(*READ_REVISIONS), "supported").when(plain.isin(*KNOWN_REVISIONS), "unsupported").otherwise("unknown")
    return head.withColumns({"revision_state": state, "scale": unit_scale(F.col("units"))})


def _ring(steps: Column, scale: Column) -> Column:
    """The ring or path of steps in metres, curves opened into chords."""
    empty = F.array().cast("array<struct<x:double,y:double>>")

    def add(out, s):
        x, y = s["x"] * scale, s["y"] * scale
        last = F.element_at(out, -1)
        curve = rings.arc(last["x"], last["y"], x, y, s["cx"] * scale, s["cy"] * scale, s["clockwise"])
        more = F.slice(curve, F.lit(2), F.greatest(F.size(curve) - 1, F.lit(0)))
        return F.when((s["kind"] == "curve") & (F.size(out) > 0), F.concat(out, more)).otherwise(F.concat(out, F.array(rings.point(x, y))))

    return F.aggregate(F.coalesce(steps, F.array().cast(f"array<{STEP}>")), empty, add)


def _polygons(scale: Column) -> Column:
    """array of polygons (arrays of rings) that a shape stands for, in metres, before its placement."""
    path = _ring(F.col("steps"), scale)
    holes = F.transform(F.coalesce("holes", F.array().cast(f"array<array<{STEP}>>")), lambda h: _ring(h, scale))
    ring_type = "array<struct<x:double,y:double>>"
    none = F.array().cast(f"array<array<{ring_type}>>")
    strokes = F.transform(rings.stroke(path, F.col("width") * scale, F.coalesce("round", F.lit(True))), lambda r: F.array(r))
    at = F.lit(0.0)
    radius = F.when(F.col("kind") == "oval", F.greatest("width", "height")).otherwise(F.col("radius"))
    rounded = F.coalesce("rounded", F.array(*[F.lit(True)] * 4))
    return (
        F.when(F.col("kind") == "polygon", F.array(F.concat(F.array(path), holes)))
        .when((F.col("kind") == "path") & (F.col("width") > 0), strokes)
        .when(F.col("kind") == "circle", F.array(F.array(rings.circle(at, at, F.col("diameter") * scale))))
        .when(F.col("kind") == "rectangle", F.array(F.array(rings.rectangle(at, at, F.col("width") * scale, F.col("height") * scale))))
        .when(F.col("kind").isin("oval", "round_rectangle"), F.array(F.array(rings.round_rectangle(F.col("width") * scale, F.col("height") * scale, radius * scale, rounded))))
        .otherwise(none)
    )


#: What a primitive is, but for its placement.
FORM = ["kind", "width", "height", "diameter", "radius", "rounded", "round", "space", "ref", "steps", "holes"]


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> int:
    """Rows that a join would have, from the counts of its keys."""
    n, m = (df.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(c)) for df, c in ((left, "n"), (right, "m")))
    return int(n.join(m, on).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0])


def resolved_entries(dictionary: DataFrame, most: int = MOST_ELEMENTS) -> DataFrame:
    """(source, within, id, path, form): every primitive that an entry stands for, through references of any depth.

    Entries reached over fewer than 2, 4, 8, ... references are found by joining what is known with itself, so a
    chain of n takes log n rounds.  A reference to no entry ends in a form of kind ``missing``, and
    one that leads into a cycle in one of kind ``cycle``, both with the ``ref`` that is asked for.  Entries that
    stand for more than ``most`` primitives together, by doubling again and again, are refused.
    ``path`` orders the primitives of an entry.
    """
    key = ["source", "within", "id"]
    rows = durable(dictionary.select(*key, F.array("primitive").alias("path"), F.struct(*FORM).alias("form")))
    names = rows.select("source", F.col("within").alias("to_within"), F.col("id").alias("to_id")).distinct()
    is_ref = F.col("form.kind") == "ref"
    asked = rows.where(is_ref).withColumns({"to_within": F.col("form.space"), "to_id": F.col("form.ref")})
    lost = asked.join(names, ["source", "to_within", "to_id"], "left_anti").select(*key, "path", F.col("form").withField("kind", F.lit("missing")).alias("form"))
    known = durable(rows.where(~is_ref).unionByName(lost))
    open_ = durable(asked.join(names, ["source", "to_within", "to_id"], "left_semi").select(*key, "path", "to_within", "to_id"))
    entries = rows.groupBy("source").agg(F.count_distinct("within", "id").alias("n")).agg(F.max("n")).first()[0] or 0
    hops = 1
    while open_.limit(1).count():
        if hops > entries:
            # Longer than any path without a cycle.
            stuck = open_.select(*key).distinct()
            form = F.struct(*[F.lit("cycle").alias(c) if c == "kind" else F.col("within").alias(c) if c == "space" else F.col("id").alias(c) if c == "ref" else F.lit(None).cast(rows.schema["form"].dataType[c].dataType).alias(c) for c in FORM])
            return known.unionByName(stuck.select(*key, F.array().cast("array<int>").alias("path"), form.alias("form")))
        ends = known.select("source", F.col("within").alias("to_within"), F.col("id").alias("to_id"), F.col("path").alias("more"), "form")
        on = open_.select("source", F.col("within").alias("to_within"), F.col("id").alias("to_id"), F.col("path").alias("more"), F.col("to_within").alias("w"), F.col("to_id").alias("i"))
        at = ["source", "to_within", "to_id"]
        if _met(open_, ends, at) > most or _met(open_, on, at) > most:
            raise Refused("entries of the dictionaries stand for too many primitives")
        known = durable(known.unionByName(open_.join(ends, at).select(*key, F.concat("path", "more").alias("path"), "form")))
        open_ = durable(open_.join(on, at).select(*key, F.concat("path", "more").alias("path"), F.col("w").alias("to_within"), F.col("i").alias("to_id")))
        hops *= 2
    return known


def resolved_shapes(parts: dict[str, DataFrame]) -> DataFrame:
    """Primitives of features and pads with references replaced by what they stand for; kind ``missing`` or ``cycle`` where that is nothing."""
    features = parts["feature"].select("source", "pos", "layer", "net", "polarity", F.format_string("%s/Set[%d]/Features[%d]/%s[%d]", "layer", "set", "feature", "tag", "primitive").alias("source_ref"), "x", "y", "rotation", "mirror", F.struct(*FORM).alias("form"))
    pads = parts["pad"].select("source", "pos", "layer", "net", F.lit("POSITIVE").alias("polarity"), F.format_string("%s/Pad[%d]", "layer", "pos").alias("source_ref"), "x", "y", "rotation", "mirror", F.struct(*FORM).alias("form"))
    shapes = features.unionByName(pads)
    entries = resolved_entries(parts["dictionary"]).select("source", F.col("within").alias("w"), F.col("id").alias("i"), F.col("path").alias("within_path"), F.col("form").alias("entry"))
    own = ["source", "pos", "layer", "net", "polarity", "source_ref", "x", "y", "rotation", "mirror"]
    refs = shapes.where(F.col("form.kind") == "ref").withColumns({"w": F.col("form.space"), "i": F.col("form.ref")})
    met = refs.join(entries, ["source", "w", "i"], "left")
    form = F.coalesce("entry", F.col("form").withField("kind", F.lit("missing")))
    found = met.select(*own, F.coalesce("within_path", F.array().cast("array<int>")).alias("path"), form.alias("form"))
    plain = shapes.where(F.col("form.kind") != "ref").select(*own, F.array().cast("array<int>").alias("path"), "form")
    return plain.unionByName(found).select(*own, "path", "form.*")


def copper(parts: dict[str, DataFrame], shapes: DataFrame | None = None) -> DataFrame:
    """(source, pos, part, layer, net, polarity, source_ref, rings, areas) of features and pads, one row a polygon.

    ``part`` orders the polygons of a feature; ``areas`` are those of the rings, taken before they are placed, so that
    they are as exact far from the origin.  References are followed to any depth; those that lead to nothing or into
    a cycle give no copper and are counted by ``missing_refs``.
    """
    shapes = (resolved_shapes(parts) if shapes is None else shapes).where(~F.col("kind").isin("missing", "cycle"))
    scaled = shapes.join(parts["header"].select("source", "scale"), "source")
    s = F.col("scale")
    each = scaled.select("source", "pos", "path", "layer", "net", "polarity", "source_ref", "x", "y", "rotation", "mirror", "scale", F.posexplode(_polygons(s)).alias("k", "polygon"))
    put = lambda r: rings.tidy(rings.placed(r, F.col("mirror"), F.col("rotation"), F.col("x") * s, F.col("y") * s))
    placed = F.transform("polygon", lambda r: F.struct(put(r).alias("ring"), spatial.ring_area(r).alias("area")))
    sound = F.filter(placed, lambda p: p["ring"].isNotNull())
    rows = each.select("source", "pos", F.concat("path", F.array("k")).alias("part"), "layer", "net", "polarity", "source_ref", sound["ring"].alias("rings"), sound["area"].alias("areas"))
    return rows.where(F.size("rings") > 0)


def missing_refs(parts: dict[str, DataFrame], shapes: DataFrame | None = None) -> DataFrame:
    """(source, ref, reason, n) of references that features and pads lead to and that no dictionary has (``missing``) or that never end (``cycle``)."""
    shapes = resolved_shapes(parts) if shapes is None else shapes
    lost = shapes.where(F.col("kind").isin("missing", "cycle"))
    return lost.groupBy("source", "ref", F.col("kind").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def board_tables(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """layers, nets, regions, vias, terminals, components and missing references of every document, in metres.

    Negative artwork on a conductive layer is refused and counted in ``refused``;
    names that stand for no net become null; plated holes with a known span are vias.
    """
    scale = parts["header"].select("source", "scale")
    stack = parts["stackup"].join(scale, "source").select("source", F.col("layer").alias("name"), (F.col("thickness") * F.col("scale")).alias("thickness"), "sequence", "material")
    listed = parts["layer"].join(stack, ["source", "name"], "left")
    layers = review.classify_layers(listed.withColumnRenamed("function", "declared"), "declared", "thickness", ["source"], "sequence")
    forms = durable(resolved_shapes(parts))
    shapes = durable(copper(parts, forms)).join(layers.select("source", F.col("name").alias("layer"), F.col("function").alias("layer_function")), ["source", "layer"])
    on_copper = shapes.where(F.col("layer_function").isin(*review.CONDUCTIVE))
    negative = F.upper(F.coalesce("polarity", F.lit("POSITIVE"))) == "NEGATIVE"
    number = F.row_number().over(W.partitionBy("source").orderBy("pos", "part"))
    regions = on_copper.where(~negative).select(
        "source", F.format_string("r%05d", number).alias("region_id"), F.col("layer").alias("layer_id"), review.real_net(F.col("net")).alias("net_id"), "source_ref", "rings", "areas"
    )
    refused = on_copper.where(negative).groupBy("source", "layer").agg(F.count(F.lit(1)).alias("n"))
    plated = parts["hole"].where(F.upper("plating").isin("VIA", "PLATED") & F.col("from_layer").isNotNull() & F.col("to_layer").isNotNull())
    known = layers.select("source", "name")
    spanned = plated.join(known.withColumnRenamed("name", "from_layer"), ["source", "from_layer"]).join(known.withColumnRenamed("name", "to_layer"), ["source", "to_layer"])
    s = F.col("scale")
    vias = spanned.join(scale, "source").select(
        "source", "pos", F.coalesce("name", F.concat(F.lit("via"), F.col("pos").cast("string"))).alias("via_id"), review.real_net(F.col("net")).alias("net_id"),
        "from_layer", "to_layer", (F.col("x") * s).alias("x"), (F.col("y") * s).alias("y"), (F.col("diameter") * s).alias("drill"), "padstack",
    )
    declared = parts["pin"].groupBy("source", "component", "pin").agg(F.min_by("net", "pos").alias("declared"))
    drawn = parts["pad"].where(F.col("component").isNotNull()).groupBy("source", "component", "pin").agg(F.min_by(review.real_net(F.col("net")), "pos").alias("drawn"), F.count(F.lit(1)).alias("pads"))
    both = drawn.join(declared, ["source", "component", "pin"], "left")
    terminals = both.select(
        "source", F.concat_ws(".", "component", "pin").alias("name"), F.coalesce("drawn", "declared").alias("net_id"), "component", "pads",
        F.coalesce(F.col("drawn") != F.col("declared"), F.lit(False)).alias("mismatch"),
    ).where(F.col("net_id").isNotNull())
    terminals = Q.unique_slugs(terminals, "name", ["name"], "terminal_id", ["source"])
    components = parts["component"].groupBy("source", "refdes").agg(F.min_by("part", "pos").alias("part"))
    nets = regions.select("source", "net_id").unionAll(vias.select("source", "net_id")).unionAll(terminals.select("source", "net_id")).where(F.col("net_id").isNotNull()).distinct()
    return {"layers": layers, "nets": nets, "regions": regions, "refused": refused, "vias": vias, "terminals": terminals, "components": components, "missing": missing_refs(parts, forms)}

