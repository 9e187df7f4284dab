"""The stored job table, streamed leases and import records."""

from __future__ import annotations

import random
import threading
from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ohmgrid.sources import job_table
from ohmgrid.streaming import leases, lifecycle

JOBS = "job_id string, signature string, state string, priority int, queued_at double, attempt int, claimed_by string, lease_expires_at double"


def queued(spark, *names, extra=""):
    return spark.createDataFrame([(n, f"s{n}", "QUEUED", k % 2, float(k), 0, None, None) for k, n in enumerate(names)], JOBS)


def state(spark, root):
    rows, version = job_table.read(spark, root)
    return {r["job_id"]: r for r in rows.collect()}, version


def test_claims_and_recovery_are_read_back(spark, tmp_path):
    root = f"file://{tmp_path}/jobs"
    assert job_table.read(spark, root) == (None, 0)
    assert job_table.enqueue(spark, root, queued(spark, "a", "b", "c")) == 1
    # An active signature is queued once; a new column is null in older rows.
    assert job_table.enqueue(spark, root, queued(spark, "c", "d").withColumn("note", F.lit("new"))) == 2
    first = job_table.claim(spark, root, "w1", 10.0, 5.0).collect()
    assert [(r["job_id"], r["state"], r["attempt"], r["claimed_by"], r["lease_expires_at"]) for r in first] == [("a", "CLAIMED", 1, "w1", 15.0)]
    assert job_table.claim(spark, root, "w2", 11.0, 50.0).first()["job_id"] == "c"
    rows, version = state(spark, root)
    assert version == 4 and {k: (r["state"], r["note"]) for k, r in rows.items()} == {"a": ("CLAIMED", None), "b": ("QUEUED", None), "c": ("CLAIMED", None), "d": ("QUEUED", "new")}
    job_table.recover(spark, root, 20.0)
    rows, _ = state(spark, root)
    assert (rows["a"]["state"], rows["a"]["claimed_by"], rows["a"]["attempt"]) == ("QUEUED", None, 1) and rows["c"]["state"] == "CLAIMED"
    old, _ = job_table.read(spark, root, at=1)
    assert {r["state"] for r in old.collect()} == {"QUEUED"} and old.count() == 3


def test_of_two_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/jobs"
    job_table.enqueue(spark, root, queued(spark, "a"))
    rows, seen = job_table.read(spark, root)
    job_table.commit(rows.withColumn("state", F.lit("CLAIMED")), root, seen)
    with pytest.raises(job_table.Conflict):
        job_table.commit(rows.withColumn("state", F.lit("FAILED")), root, seen)
    assert state(spark, root)[0]["a"]["state"] == "CLAIMED"
    # Four workers at once take four different jobs.
    job_table.enqueue(spark, root, queued(spark, *"klmn"))
    got, fail = [], []

    def work(name):
        try:
            got.append((name, job_table.claim(spark, root, name, 1.0, 9.0).first()["job_id"]))
        except Exception as error:  # noqa: BLE001
            fail.append(error)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not fail and sorted(j for _, j in got) == list("klmn")
    rows, _ = state(spark, root)
    assert {(rows[j]["claimed_by"], j) for _, j in got} == set(got)


def test_streamed_leases(spark, tmp_path):
    rng = random.Random(2)
    events = []
    for k in range(400):
        events.append((f"j{rng.randrange(12)}", (k + 1) * 3000, k, rng.choice(["CLAIMED", "RUNNING", "RUNNING", "COMPLETED", "CANCELLING", "QUEUED"])))
    stamp = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
    for part in range(4):
        rows = [(j, stamp(at), k, to) for j, at, k, to in events[part * 100 : part * 100 + 100]]
        spark.createDataFrame(rows, "job string, at timestamp, seq long, to string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", stamp(10_000_000), 0, "CLAIMED")], "job string, at timestamp, seq long, to string").write.mode("append").parquet(f"{tmp_path}/in")
    stream = lifecycle.event_stream(spark, f"{tmp_path}/in", "job string, at timestamp, seq long, to string", 1)
    leases.run_leases(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "40 seconds")
    found = defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        found[r["job"]].append((int(r["at"].replace(tzinfo=timezone.utc).timestamp() * 1000), r["state"], r["attempt"], r["cause"]))
    by_job = defaultdict(list)
    for j, at, k, to in events:
        by_job[j].append((at, k, to))
    assert any(c == "lease" for rows in found.values() for *_, c in rows)
    for j, rows in by_job.items():
        assert sorted(found[j]) == sorted(leases.batch_leases(rows, 40_000, 10_000_000)), j


def test_import_records(spark, tmp_path):
    from ohmgrid.sources import import_run, ipc2581

    (tmp_path / "good").mkdir()
    (tmp_path / "bad").mkdir()
    board = '<IPC-2581 revision="B"><Ecad><CadHeader units="INCH"/><CadData><Layer name="Top" layerFunction="CONDUCTOR"/><LayerFeature layerRef="Top"><Set><Features><Circle diameter="1"/><Odd/></Features></Set></LayerFeature></CadData></Ecad></IPC-2581>'
    for k in range(3):
        (tmp_path / "good" / f"{k}.xml").write_text(board)
    (tmp_path / "bad" / "x.xml").write_text("<!DOCTYPE secret>" + board)
    root = f"file://{tmp_path}/runs"
    run = import_run.run_import(spark, f"{tmp_path}/good", root)
    with pytest.raises(Exception, match="declares a type"):
        import_run.run_import(spark, f"{tmp_path}/bad", root)
    found = [(r["event"], r["documents"], r["rows"], r["feature"], r["unknown"], r["error"]) for r in import_run.records(spark, root).orderBy("at").collect()]
    assert found == [("started", *[None] * 5), ("finished", 3, 12, 3, 3, None), ("started", *[None] * 5), ("failed", *[None] * 4, "the document declares a type or an entity")]
    parts = ipc2581.sections_of(import_run.rows_of(spark, root, run))
    assert parts["feature"].count() == 3 and parts["header"].first()["scale"] == 0.0254
