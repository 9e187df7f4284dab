"""Studies, archives and mesh points."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from ohmgrid.operators import mesh, study
from ohmgrid.sources import archives


def test_specs(spark):
    old = '{"kind":"ir_drop","net_id":"v","source_terminal_id":"a","source_voltage_v":1.0,"loads":[{"terminal_id":"b","current_a":2.0}]}'
    new = '{"kind":"ir_drop","net_id":"v","source_terminal_ids":["a"],"source_voltage_v":1.0,"loads":[{"terminal_ids":["b"],"current_a":2.0}]}'
    swapped = [f'{{"kind":"resistance","source_terminal_ids":{ids},"to_terminal_id":"z"}}' for ids in ('["a","b"]', '["b","a"]')]
    jobs = study.decode_specs(spark.createDataFrame([(k, t) for k, t in enumerate([old, new, *swapped])], "k int, spec_json string"))
    rows = jobs.select("k", "spec", study.signature(F.lit("d"), F.col("spec"), "s").alias("sig"), study.unit_load(F.col("spec")).alias("l"), study.total_load(F.col("spec")).alias("t")).orderBy("k").collect()
    assert rows[0]["spec"] == rows[1]["spec"] and rows[0]["sig"] == rows[1]["sig"] and rows[0]["t"] == 2.0
    assert rows[2]["sig"] == rows[3]["sig"] != rows[0]["sig"] and rows[2]["l"][0]["current_a"] == 1.0
    again = study.decode_specs(study.encode_specs(jobs.drop("spec_json")).drop("spec"))
    assert again.orderBy("k").first()["spec"] == rows[0]["spec"]


def test_disconnected_and_results(spark):
    links = spark.createDataFrame([("s", 1, 2), ("s", 3, 4)], "study string, a long, b long")
    terminals = spark.createDataFrame([("s", "t1", 0, 1), ("s", "t2", 1, 2), ("s", "t3", 2, 4), ("s", "t4", 3, None)], "study string, terminal string, pos int, node long")
    assert {(r["terminal"], r["first"]) for r in study.disconnected(links, terminals).collect()} == {("t3", "t1"), ("t4", "t1")}
    schema = "study string, terminal string, dof long, voltage double, current double, pos int"
    sources = spark.createDataFrame([("s", "a", 1, 1.0, 3.0, 0)], schema)
    loads = spark.createDataFrame([("s", "b", 2, 0.5, 1.0, 0), ("s", "c", 2, 0.5, 2.0, 1), ("s", "d", 1, 1.0, 1.0, 2)], schema)
    assert [(r["terminal"], r["current"]) for r in study.terminal_results(sources, loads).collect()] == [("a", 3.0), ("b", 3.0)]
    assert study.echo_solver(sources, loads).count() == 4


def test_registry_and_payload():
    known = study.Registry()
    known.add("fem", dict)
    known.add("amg", None, "a library is missing")
    with pytest.raises(ValueError):
        known.add("fem", list)
    with pytest.raises(LookupError, match="library is missing"):
        known.get("amg")
    assert known.get("fem") is dict and len(study.field_payload([(0, 0, 1)] * 3, [(0, 1, 2)])) == 8 + 36 + 12


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(d__x=b"1", y=b"22"))
    assert sorted((r["name"], bytes(r["content"])) for r in archives.read(spark, str(tmp_path)).collect()) == [("d/x", b"1"), ("y", b"22")]
    with pytest.raises(archives.Refused, match="too much"):
        archives.members(zipped(bomb=b"0" * 1_000_000))
    for name in ("../x", "/x", "c:\\x", "a/../../x"):
        with pytest.raises(archives.Refused):
            archives.safe_name(name)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    with pytest.raises(archives.Refused, match="regular"):
        archives.members(out.getvalue())
    with pytest.raises(archives.Refused):
        archives.members(b"nothing")


def test_mesh_points(spark):
    boxes = spark.createDataFrame([("r", 0.0, 0.0, 4.0, 4.0)], "r string, x0 double, y0 double, x1 double, y1 double")
    lattice = mesh.hex_lattice(boxes, ["r"], 1.0)
    assert lattice.count() == 5 + 4 + 5 + 4 + 5
    kept = spark.createDataFrame([("r", 0.1, 0.0)], "r string, px double, py double")
    assert mesh.merge_points(kept, lattice, ["r"], 0.5).count() == 1 + 23 - 1
    ring = spark.createDataFrame([("q", k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "ring string, k int, x double, y double")
    walked = mesh.ring_walk(ring, ["ring"], "k").orderBy("k").collect()
    assert [r["corner"] for r in walked] == [True, False, True, True, True] and [r["position"] for r in walked] == [0.0, 1.0, 2.0, 4.0, 6.0]
