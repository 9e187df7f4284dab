"""Documents in and out: canonical JSON, IPC-2581, artifacts, streams."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from ohmgrid.operators import jobs, spatial, union
from ohmgrid.sources import artifacts, canonical_json, ipc2581, ipc2581_scan, markup
from ohmgrid.streaming import lifecycle


def q(value, provenance="imported"):
    return {"value": value, "unit": "m", "provenance": provenance, "note": "guess" if provenance == "assumed" else None}


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


BOARD = {
    "id": "b1", "name": "two rails", "notes": ["n"],
    "stackup": [
        {"id": "top", "name": "Top", "function": "signal", "index": 0, "thickness": q(35e-6)},
        {"id": "core", "name": "Core", "function": "dielectric", "index": 1, "thickness": q(1.5e-3)},
        {"id": "bot", "name": "Bottom", "function": "plane", "index": 2, "thickness": q(35e-6, "assumed")},
    ],
    "nets": [{"id": "v", "name": "VCC"}, {"id": "g", "name": "GND"}],
    "copper_regions": [{"id": "r1", "net_id": "v", "layer_id": "top", "outline": {"exterior": box(0, 0, 0.04, 0.008), "holes": [box(0.01, 0.002, 0.002, 0.002)]}}],
    "vias": [{"id": "x1", "net_id": "v", "from_layer_id": "top", "to_layer_id": "bot", "position": [0.001, 0.001], "finished_hole_diameter": q(3e-4), "plating_thickness": q(2e-5)},
             {"id": "x2", "net_id": "v", "from_layer_id": "top", "to_layer_id": "bot", "position": [0.002, 0.001]}],
    "pads": [{"id": "p1", "layer_id": "top", "position": [0.001, 0.001], "net_id": "v"}],
    "terminals": [{"id": "t1", "name": "U1.1", "net_id": "v", "pad_ids": ["p1"], "component_id": "u1"}],
    "components": [{"id": "u1", "reference_designator": "U1", "terminal_ids": ["t1"]}],
}


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"format_version": 1, "board": BOARD}))
    docs = canonical_json.read(spark, f"{tmp_path}/in", "format_version")
    parts = canonical_json.tables(docs)
    assert {k: v.count() for k, v in parts.items()} == {"board": 1, "stackup": 3, "nets": 2, "copper_regions": 1, "vias": 2, "pads": 1, "terminals": 1, "components": 1}
    found = {r["code"]: (r["n"], r["first"]) for r in canonical_json.diagnostics(parts).collect()}
    assert found == {"layer.thickness_assumed": (1, "bot"), "via.incomplete": (1, "x2")}
    regions = parts["copper_regions"].select(F.col("id").alias("region_id"), "layer_id", "net_id", canonical_json.rings(F.col("outline")).alias("rings"))
    assert union.union_regions(regions).first()["area"] == pytest.approx(0.04 * 0.008 - 4e-6)
    canonical_json.write(canonical_json.collect_boards(parts), f"{tmp_path}/out", "format_version")
    again = canonical_json.tables(canonical_json.read(spark, f"{tmp_path}/out/part-*", "format_version"))
    for name in canonical_json.TABLES:
        assert again[name].orderBy("pos").collect() == parts[name].orderBy("pos").collect()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"format_version": 2, "board": BOARD}))
    with pytest.raises(Exception, match="unsupported version"):
        canonical_json.read(spark, f"{tmp_path}/in", "format_version").collect()


XML = """<?xml version="1.0"?><IPC-2581 revision="B" xmlns="http://webstds.ipc.org/2581">
<Content><DictionaryStandard units="MILLIMETER"><EntryStandard id="round"><Circle diameter="2"/></EntryStandard></DictionaryStandard></Content>
<Ecad><CadHeader units="MILLIMETER"/><CadData>
<Layer name="Top" layerFunction="CONDUCTOR"/><Layer name="Core" layerFunction="DIELCORE"/><Layer name="Bot" layerFunction="PLANE"/><Layer name="Silk" layerFunction="SILKSCREEN"/><Layer name="Odd" layerFunction="COMPONENT"/>
<Stackup><StackupGroup><StackupLayer layerOrGroupRef="Bot" thickness="0.035" sequence="3"/><StackupLayer layerOrGroupRef="Top" thickness="0.035" sequence="1"/><StackupLayer layerOrGroupRef="Core" thickness="1.5" sequence="2"/></StackupGroup></Stackup>
<Step><Profile><Polygon><PolyBegin x="0" y="0"/><PolyStepSegment x="50" y="0"/><PolyStepSegment x="50" y="50"/></Polygon></Profile>
<PadStack name="ps" net="VCC"><LayerHole name="h1" diameter="0.3" platingStatus="VIA" x="1" y="1"><Span fromLayer="Top" toLayer="Bot"/></LayerHole><LayerPad layerRef="Top"><Location x="20" y="20"/><StandardPrimitiveRef id="round"/><PinRef componentRef="U1" pin="1"/></LayerPad></PadStack>
<Component refDes="U1" part="P"/><LogicalNet name="GND"><PinRef componentRef="U1" pin="1"/></LogicalNet>
<LayerFeature layerRef="Top"><Set net="VCC"><Features><Contour><Polygon><PolyBegin x="0" y="0"/><PolyStepSegment x="12" y="0"/><PolyStepSegment x="12" y="10"/><PolyStepSegment x="0" y="10"/><PolyStepSegment x="0" y="0"/></Polygon><Cutout><PolyBegin x="2" y="2"/><PolyStepSegment x="6" y="2"/><PolyStepSegment x="6" y="8"/><PolyStepSegment x="2" y="8"/></Cutout></Contour></Features></Set>
<Set net="No Net"><Features><Line startX="0" startY="30" endX="7" endY="30"><LineDesc lineWidth="0.6" lineEnd="ROUND"/></Line></Features><Features><Mystery/></Features></Set>
<Set net="VCC"><Features><Polygon><PolyBegin x="31" y="30"/><PolyStepCurve x="31" y="30" centerX="30" centerY="30" clockwise="false"/></Polygon></Features></Set></LayerFeature>
<LayerFeature layerRef="Bot"><Set net="GND" polarity="NEGATIVE"><Features><Location x="5" y="5"/><RectCenter width="2" height="2"/></Features></Set><Set net="GND"><Features><Xform rotation="90"/><Location x="30" y="0"/><RectCenter width="4" height="1"/></Features></Set></LayerFeature>
</Step></CadData></Ecad></IPC-2581>"""


def test_ipc2581(spark, tmp_path):
    (tmp_path / "b.xml").write_text(XML)
    parts = ipc2581.sections_of(ipc2581.read_rows(spark, f"{tmp_path}/*.xml").cache())
    head = parts["header"].first()
    assert (head["revision_state"], head["scale"], head["units"]) == ("supported", 1e-3, "MILLIMETER")
    board = ipc2581.board_tables(parts)
    assert [(r["name"], r["function"], r["idx"]) for r in board["layers"].orderBy("idx").collect()] == [("Top", "signal", 0), ("Core", "dielectric", 1), ("Bot", "plane", 2), ("Silk", "silkscreen", 3)]
    merged = {(r["layer_id"], r["net_id"], r["region_id"]): r["area"] * 1e6 for r in union.union_regions(board["regions"]).collect()}
    assert merged["Top", "VCC", "n-Top-VCC-000"] == pytest.approx(120 - 24, rel=1e-9)
    circles = sorted(v for (lay, net, _), v in merged.items() if (lay, net) == ("Top", "VCC"))[:2]
    assert circles == [pytest.approx(math.pi, rel=3e-3)] * 2
    assert merged["Top", None, "n-Top-none-000"] == pytest.approx(4.2 + 0.09 * math.pi, rel=3e-3) and merged["Bot", "GND", "n-Bot-GND-000"] == pytest.approx(4.0, rel=1e-9)
    assert [r["n"] for r in board["refused"].collect()] == [1]
    via = board["vias"].first()
    assert (via["from_layer"], via["to_layer"], via["drill"]) == ("Top", "Bot", pytest.approx(3e-4))
    pin = board["terminals"].first()
    assert (pin["name"], pin["net_id"], pin["mismatch"]) == ("U1.1", "VCC", True)
    assert parts["unknown"].first()["label"] == "Features/Mystery" and ipc2581.missing_refs(parts).count() == 0


def board_of(entries, features):
    return f"""<IPC-2581 revision="B"><Content>{entries}</Content><Ecad><CadHeader units="MILLIMETER"/><CadData><Layer name="Top" layerFunction="CONDUCTOR"/><Step>
    <LayerFeature layerRef="Top"><Set net="N">{features}</Set></LayerFeature></Step></CadData></Ecad></IPC-2581>"""


def ref(name, x=0, kind="Standard"):
    return f'<Features><Location x="{x}" y="0"/><{kind}PrimitiveRef id="{name}"/></Features>'


def test_references_of_any_depth(spark, tmp_path):
    chain = "".join(f'<EntryStandard id="c{k}"><StandardPrimitiveRef id="c{k + 1}"/></EntryStandard>' for k in range(11)) + '<EntryStandard id="c11"><RectCenter width="2" height="3"/></EntryStandard>'
    loop = '<EntryStandard id="p"><StandardPrimitiveRef id="q"/></EntryStandard><EntryStandard id="q"><StandardPrimitiveRef id="p"/></EntryStandard><EntryStandard id="into"><StandardPrimitiveRef id="p"/></EntryStandard>'
    lost = '<EntryStandard id="half"><StandardPrimitiveRef id="gone"/></EntryStandard>'
    user = '<DictionaryUser><EntryUser id="c0"><UserSpecial><Circle diameter="1"/><StandardPrimitiveRef id="c7"/><UserPrimitiveRef id="two"/></UserSpecial></EntryUser><EntryUser id="two"><UserSpecial><RectCenter width="1" height="1"/><Oval width="4" height="2"/></UserSpecial></EntryUser></DictionaryUser>'
    (tmp_path / "a.xml").write_text(board_of(f"<DictionaryStandard>{chain}{loop}{lost}</DictionaryStandard>{user}", "".join(ref(n, 10 * k) for k, n in enumerate(["c0", "c5", "c11", "p", "into", "half", "nothing"])) + ref("c0", 90, "User")))
    # The same name in another document is another entry.
    (tmp_path / "b.xml").write_text(board_of('<DictionaryStandard><EntryStandard id="c0"><Circle diameter="4"/></EntryStandard></DictionaryStandard>', ref("c0") + ref("c11")))
    parts = ipc2581.sections_of(ipc2581.read_rows(spark, f"{tmp_path}/*.xml").cache())
    name = F.element_at(F.split("source", "/"), -1).alias("file")
    area = spatial.ring_area(F.get("rings", F.lit(0))) * 1e6
    rows = [(r["file"], r["source_ref"], round(r["area"], 1)) for r in ipc2581.copper(parts).select(name, "source_ref", "pos", "part", area.alias("area")).orderBy("file", "pos", "part").collect()]
    assert rows == [*[("a.xml", f"Top/Set[0]/Features[{k}]/StandardPrimitiveRef[0]", 6.0) for k in range(3)], *[("a.xml", "Top/Set[0]/Features[7]/UserPrimitiveRef[0]", v) for v in (0.8, 6.0, 1.0, round(4 + math.pi, 1))], ("b.xml", "Top/Set[0]/Features[0]/StandardPrimitiveRef[0]", 12.6)]
    lost = {(r["file"], r["ref"], r["reason"]): r["n"] for r in ipc2581.missing_refs(parts).select(name, "ref", "reason", "n").collect()}
    assert lost == {("a.xml", "p", "cycle"): 1, ("a.xml", "into", "cycle"): 1, ("a.xml", "gone", "missing"): 1, ("a.xml", "nothing", "missing"): 1, ("b.xml", "c11", "missing"): 1}


def test_references_that_multiply_are_refused(spark, tmp_path):
    doubling = "".join(f'<EntryUser id="d{k}"><UserSpecial><UserPrimitiveRef id="d{k + 1}"/><UserPrimitiveRef id="d{k + 1}"/></UserSpecial></EntryUser>' for k in range(40)) + '<EntryUser id="d40"><Circle diameter="1"/></EntryUser>'
    (tmp_path / "a.xml").write_text(board_of(f"<DictionaryUser>{doubling}</DictionaryUser>", ref("d0", kind="User")))
    parts = ipc2581.sections_of(ipc2581.read_rows(spark, f"{tmp_path}/*.xml").cache())
    with pytest.raises(ipc2581.Refused, match="too many"):
        ipc2581.resolved_entries(parts["dictionary"])
    short = ipc2581.resolved_entries(parts["dictionary"].where("id rlike 'd(3[5-9]|40)'"))
    assert {r["id"]: r["count"] for r in short.groupBy("id").count().collect()} == {f"d{k}": 2 ** (40 - k) for k in range(35, 41)}


def test_primitives(spark, tmp_path):
    shapes = ['<RectRound width="6" height="4" radius="1"/>', '<RectRound width="6" height="4" radius="1" upperRight="true" lowerLeft="false"/>', '<RectRound width="6" height="4" radius="9"/>', '<Oval width="6" height="4"/>', '<Oval width="4" height="4"/>', '<RectRound width="6" height="4" radius="0"/>',
              '<Circle diameter="2"/><RectCenter width="1" height="1"/><Mystery/>', '<UserSpecial><Circle diameter="2"/><Odd/></UserSpecial>']
    (tmp_path / "a.xml").write_text(board_of("", "".join(f'<Features><Location x="{20 * k}" y="5"/>{s}</Features>' for k, s in enumerate(shapes))))
    parts = ipc2581.sections_of(ipc2581.read_rows(spark, f"{tmp_path}/*.xml").cache())
    area, box = spatial.ring_area(F.get("rings", F.lit(0))) * 1e6, spatial.bounding_box(F.get("rings", F.lit(0)))
    rows = ipc2581.copper(parts).select("source_ref", area.alias("a"), box.alias("b"), "pos").orderBy("pos").collect()
    corner = 1 - math.pi / 4
    assert [r["a"] for r in rows] == [pytest.approx(v, rel=2e-3) for v in (24 - 4 * corner, 24 - corner, 8 + 4 * math.pi, 8 + 4 * math.pi, 4 * math.pi, 24, math.pi, 1, math.pi)]
    assert [r["source_ref"].rpartition("/")[2] for r in rows][6:] == ["Circle[0]", "RectCenter[1]", "Circle[0]"]
    assert rows[0]["b"]["min_x"] == pytest.approx(-3e-3) and rows[0]["b"]["max_y"] == pytest.approx(7e-3)
    assert sorted(r["label"] for r in parts["unknown"].collect()) == ["Features/Mystery", "Features/Odd"]


def plain_rows(df, drop=("pos", "source_ref")):
    name = F.element_at(F.split("source", "/"), -1)
    kept = df.withColumn("source", name).drop(*drop)
    return sorted(json.dumps([str(r[c]) for c in sorted(kept.columns)]) for r in kept.collect())


def test_parallel_scan_equals_the_parser(spark, tmp_path):
    """Small splits, so that every document is read by many tasks; single quotes, empty sets and line breaks in tags."""
    features = "".join(f'<Features><Location x="{k}" y="1"/><Polygon><PolyBegin x="0" y="0"/><PolyStepSegment x="2" y="0"/><PolyStepCurve x="0" y="2" centerX="0" centerY="0" clockwise="false"/><PolyStepSegment x="0" y="1"/></Polygon></Features>' for k in range(40))
    sets = "".join(f'<Set net="N{k}&amp;{k}" polarity="POSITIVE">{ref("round", k)}<Features><Line startX="0" startY="0" endX="{k}" endY="1"><LineDesc lineWidth="1"/></Line></Features><Hole name="h{k}" diameter="1" platingStatus="VIA" x="1" y="1"/></Set>' for k in range(150))
    many = f"""<?xml version="1.0"?><IPC-2581 revision="B"><Content><DictionaryStandard><EntryStandard id="round"><Circle diameter="2"/></EntryStandard></DictionaryStandard></Content><Ecad><CadHeader
      units='INCH'/><CadData><Layer name='Top' layerFunction="CONDUCTOR"/><Layer name="Bot" layerFunction="PLANE"/><Step><Component refDes="U1" part="a &lt; b"><Location x="1" y="2"/></Component>
      <LayerFeature layerRef="Empty"/><LayerFeature layerRef="Top">{sets}<Set net="none"/><Set net="poly">{features}</Set></LayerFeature><LayerFeature layerRef='Bot'><Set net="last">{ref("round")}</Set></LayerFeature></Step></CadData></Ecad></IPC-2581>"""
    for name, text in (("many.xml", many), ("plain.xml", XML)):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert ipc2581_scan.tokens(spark, f"{tmp_path}/*.xml").rdd.getNumPartitions() > 10
        found, bad = ipc2581_scan.scan(spark, f"{tmp_path}/*.xml")
        parsed = ipc2581.sections_of(ipc2581.read_rows(spark, f"{tmp_path}/*.xml").cache())
        for name in ("dictionary", "layer", "stackup", "outline", "hole", "pad", "component", "pin", "feature", "unknown"):
            assert plain_rows(found[name]) == plain_rows(parsed[name]), name
        drop = ("pos", "sections", "generator")
        assert plain_rows(found["header"], drop) == plain_rows(parsed["header"], drop)
        assert bad.count() == 0 and found["corrupt"].count() == 0
        regions = [ipc2581.board_tables(parts)["regions"].select("source", "layer_id", "net_id", "rings") for parts in (found, parsed)]
        assert plain_rows(regions[0]) == plain_rows(regions[1])
        (tmp_path / "bad.xml").write_text('<!DOCTYPE x><IPC-2581 revision="B"><Ecad><CadHeader units="INCH"/></Ecad></IPC-2581>')
        for name, text in (("prefix.xml", '<i:IPC-2581 revision="B"><i:Set></i:Set></i:IPC-2581>'), ("space.xml", board_of("", "").replace("</Set>", "</Set >")), ("comment.xml", board_of("", "<!-- <Set> </Set> -->"))):
            (tmp_path / name).write_text(text)
        (tmp_path / "cut.xml").write_text(board_of("", '<Features><Circle diameter="1"></Features>' + ref("x")))
        found, bad = ipc2581_scan.scan(spark, f"{tmp_path}/*.xml")
        assert sorted(r["reason"][:8] for r in bad.collect()) == ["declares", *["prefixed"] * 3] and found["corrupt"].count() == 1 and found["header"].count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["<!DOCTYPE a><a/>", "<!ENTITY x 'y'><a/>", "<a>" * 200 + "</a>" * 200, "<a>"])
def test_hostile_markup(text):
    with pytest.raises(ipc2581.Refused):
        ipc2581.parse_bounded(text.encode())


def test_refusals(spark):
    files = spark.createDataFrame([("a", 10, "<!doctype x>"), ("b", 1 << 40, "<a/>"), ("c", 4, "<a/>")], "path string, length long, text string")
    assert [r["refused"] for r in markup.refusals(files).orderBy("path").collect()] == ["document type or entity declared", "too large", None]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    root = str(tmp_path)
    done = artifacts.publish(spark, {"t": df}, root, "job-1", {"quality": "CONVERGED"})
    assert spark.read.parquet(f"{done}/t").count() == 1 and not artifacts.exists(spark, f"{root}/job-1.working")
    with pytest.raises(FileExistsError):
        artifacts.publish(spark, {"t": df}, root, "job-1", {})
    artifacts.save_generation(df, f"{root}/cp", "sig", 0)
    artifacts.save_generation(df, f"{root}/cp", "other", 1)
    assert artifacts.load_generations(spark, f"{root}/cp", "sig", 5).count() == 1
    assert artifacts.put_document(df, root, "a" * 64) and artifacts.exists(spark, f"{root}/boards/{'a' * 64}")
    nodes = spark.createDataFrame([("s", 0, 5, 0.0, 0.0), ("s", 0, 6, 1.0, 0.0), ("s", 0, 9, 0.0, 1.0)], "study string, layer int, node long, x double, y double")
    tri = spark.createDataFrame([("s", 0, 1, 5, 6, 9, 2.5)], "study string, layer int, tri long, n0 long, n1 long, n2 long, power double")
    lines = [r["value"] for r in artifacts.vtk_lines(nodes, tri, ["power"]).collect()]
    assert lines[4] == "POINTS 3 double" and "3 0 1 2" in lines and lines[-1] == "2.5"


def test_streamed_fold_equals_batch(spark, tmp_path):
    rows = [(k % 5, k, ("CLAIMED", "RUNNING", "COMPLETED", "CANCELLING")[k // 5 % 4]) for k in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "job_id int, seq long, to string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = {r["job_id"]: (r["state"], r["n_applied"], r["n_refused"]) for r in jobs.fold_states(spark.read.parquet(f"{tmp_path}/in"), "job_id", ["seq"], "to").collect()}
    stream = lifecycle.event_stream(spark, f"{tmp_path}/in", "job_id int, seq long, to string", 10)
    lifecycle.run_available(lifecycle.stream_states(stream), f"{tmp_path}/out", f"{tmp_path}/cp", "update")
    found = {r["job"]: (r["state"], r["n_applied"], r["n_refused"]) for r in lifecycle.latest_states(spark, f"{tmp_path}/out").collect()}
    assert found == batch
