"""Leases as a stream: jobs whose worker falls silent are requeued, failed or cancelled without an event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ohmgrid.operators.jobs import MAX_ATTEMPTS, TRANSITIONS
from ohmgrid.streaming.lifecycle import run_available

HELD = ("CLAIMED", "RUNNING", "CANCELLING")
OUT = "job string, at timestamp, state string, attempt long, cause string"
_STATE = StructType([StructField("state", StringType()), StructField("attempt", LongType()), StructField("lease", LongType())])


def expired_state(state: str, attempt: int, most: int = MAX_ATTEMPTS) -> str:
    """Where a job goes whose lease has run out."""
    return "CANCELLED" if state == "CANCELLING" else "QUEUED" if attempt < most else "FAILED"


class Leases(StatefulProcessor):
    """State of each job: its state, attempts and the end of its lease in milliseconds, with a timer at that end.

    A claim counts an attempt; any event of a held job extends its lease from the event's time.  A
    timer that fires at the end of the lease in force, by the watermark, moves the job on; timers of leases that were extended since do nothing.
    """

    def __init__(self, lease_ms: int, most: int = MAX_ATTEMPTS):
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, attempt, lease = self.job.get() or ("QUEUED", 0, 0)
        timer = lease if state in HELD else None
        for us, _, to in sorted(((r["us"], r["seq"], r["to"]) for r in rows), key=lambda e: e[:2]):
            at = us // 1000
            # Events that come after the end of a lease meet the job where that end has put it.
            if state in HELD and lease < at:
                state = expired_state(state, attempt, self.most)
                yield Row(job=key[0], ms=lease, state=state, attempt=attempt, cause="lease")
            if to in TRANSITIONS[state] or (to == state and state in HELD):
                attempt += to == "CLAIMED" and state == "QUEUED"
                state = to
                if state in HELD:
                    lease = at + self.lease_ms
                yield Row(job=key[0], ms=at, state=state, attempt=attempt, cause="event")
        self.job.update((state, attempt, lease))
        # A held job has one timer, at the end of the lease in force.
        if timer is not None and (state not in HELD or lease != timer):
            self.handle.deleteTimer(timer)
        if state in HELD and lease != timer:
            self.handle.registerTimer(lease)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, attempt, lease = self.job.get()
        if state in HELD and lease <= expiredTimerInfo.getExpiryTimeInMs():
            state = expired_state(state, attempt, self.most)
            self.job.update((state, attempt, lease))
            yield Row(job=key[0], ms=lease, state=state, attempt=attempt, cause="lease")

    def close(self) -> None:
        pass


def stream_leases(events: DataFrame, lease: str = "60 seconds", delay: str = "0 seconds", most: int = MAX_ATTEMPTS) -> DataFrame:
    """Every change of every job's state: (job, at, state, attempt, cause: event or lease).

    ``events`` has (job, at: timestamp, seq, to).  A lease ends once the watermark, ``delay`` behind the latest event of
    any job, has passed it; illegal steps change nothing.  State lives in Spark's RocksDB store, keyed by job.
    """
    number, unit = lease.split()
    lease_ms = int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    shaped = events.select(F.col("job").cast("string").alias("job"), "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), "to").withWatermark("at", delay)
    steps = shaped.groupBy("job").transformWithState(Leases(lease_ms, most), OUT.replace("at timestamp", "ms long"), "Append", "EventTime")
    return steps.select("job", F.timestamp_millis("ms").alias("at"), "state", "attempt", "cause")


def batch_leases(rows: list[tuple[int, int, str]], lease_ms: int, until: int, most: int = MAX_ATTEMPTS) -> list[tuple[int, str, int, str]]:
    """(at, state, attempt, cause) of one job's events (at, seq, to) in milliseconds up to ``until``: the plain form."""
    state, attempt, lease, out = "QUEUED", 0, 0, []
    for at, _, to in [*sorted(rows), (until, 0, "")]:
        if state in HELD and lease < at:
            state = expired_state(state, attempt, most)
            out.append((lease, state, attempt, "lease"))
        if to and (to in TRANSITIONS[state] or (to == state and state in HELD)):
            attempt += to == "CLAIMED" and state == "QUEUED"
            state = to
            lease = at + lease_ms if state in HELD else lease
            out.append((at, state, attempt, "event"))
    return out


def run_leases(events: DataFrame, path: str, checkpoint: str, lease: str, delay: str = "0 seconds") -> None:
    """Writes the changes of a stream of events as Parquet until all that is there has been read; timers need the RocksDB state store, which is set for the run."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_available(stream_leases(events, lease, delay), path, checkpoint)
    finally:
        conf.set(name, before)
