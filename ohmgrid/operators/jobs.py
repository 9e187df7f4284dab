"""Job queue operators: transitions, leases, priorities, folds of lifecycle events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States that each state may move to.
TRANSITIONS = {
    "QUEUED": ("CLAIMED", "CANCELLING", "CANCELLED"),
    "CLAIMED": ("RUNNING", "QUEUED", "CANCELLING", "FAILED"),
    "RUNNING": ("COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLING", "QUEUED"),
    "CANCELLING": ("CANCELLED", "FAILED"),
    "COMPLETED": (),
    "COMPLETED_WITH_WARNINGS": (),
    "FAILED": (),
    "CANCELLED": (),
}
TERMINAL = tuple(s for s, to in TRANSITIONS.items() if not to)
ACTIVE = tuple(s for s, to in TRANSITIONS.items() if to)
# Job states that result qualities stand for.
QUALITY_STATE = {
    "CONVERGED": "COMPLETED",
    "CONVERGED_WITH_MODEL_LIMITATIONS": "COMPLETED_WITH_WARNINGS",
    "RESOURCE_LIMITED": "COMPLETED_WITH_WARNINGS",
    "NOT_CONVERGED": "COMPLETED_WITH_WARNINGS",
    "NUMERICAL_FAILURE": "FAILED",
}
TRUSTED = ("CONVERGED", "CONVERGED_WITH_MODEL_LIMITATIONS")
MAX_ATTEMPTS = 3


def allowed(state: Column, to: Column) -> Column:
    """Whether the table has the transition."""
    out = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            out = F.when(state == source, to.isin(*targets)).otherwise(out)
    return out


def after(state: Column, to: Column) -> Column:
    """State after a guarded update: an illegal step changes nothing."""
    return F.when(allowed(state, to), to).otherwise(state)


def fold_states(events: DataFrame, job: str, order: list[str], to: str, first: str = "QUEUED") -> DataFrame:
    """(job, state, n_applied, n_refused) after all events in order.

    The events of a job are one array; jobs have tens of events, and only the
    target states are kept.
    """
    along = F.array_sort(F.collect_list(F.struct(*order, F.col(to).alias("to"))))
    steps = events.groupBy(job).agg(along.alias("steps"))
    start = F.struct(F.lit(first).alias("s"), F.lit(0).cast("long").alias("ok"), F.lit(0).cast("long").alias("no"))

    def step(a, e):
        legal = allowed(a["s"], e["to"])
        return F.struct(
            F.when(legal, e["to"]).otherwise(a["s"]).alias("s"),
            (a["ok"] + F.when(legal, 1).otherwise(0)).alias("ok"),
            (a["no"] + F.when(legal, 0).otherwise(1)).alias("no"),
        )

    folded = steps.select(job, F.aggregate("steps", start, step).alias("z"))
    return folded.select(job, F.col("z.s").alias("state"), F.col("z.ok").alias("n_applied"), F.col("z.no").alias("n_refused"))


def cancel(state: Column) -> Column:
    """Queued jobs are cancelled at once, claimed and running ones are asked to stop, others stay."""
    return F.when(state == "QUEUED", "CANCELLED").when(state.isin("CLAIMED", "RUNNING"), "CANCELLING").otherwise(state)


def expire(state: Column, lease: Column, attempt: Column, now: Column, most: int = MAX_ATTEMPTS) -> Column:
    """State after lease recovery: expired work is queued again below the cap and fails at it; stopping jobs are cancelled."""
    dead = state.isin("CLAIMED", "RUNNING", "CANCELLING") & (lease < now)
    return F.when(~F.coalesce(dead, F.lit(False)), state).when(state == "CANCELLING", "CANCELLED").when(attempt < most, "QUEUED").otherwise("FAILED")


def claim(jobs: DataFrame, worker: str, now: float, lease_s: float) -> DataFrame:
    """``jobs`` (job_id, state, priority, queued_at, attempt, claimed_by, lease_expires_at) with the next one claimed."""
    chosen = jobs.where(F.col("state") == "QUEUED").orderBy("priority", "queued_at", "job_id").limit(1).select("job_id", F.lit(True).alias("__next"))
    met = jobs.join(F.broadcast(chosen), "job_id", "left")
    own = F.coalesce("__next", F.lit(False))
    return met.withColumns({
        "state": F.when(own, "CLAIMED").otherwise(F.col("state")),
        "attempt": F.col("attempt") + F.when(own, 1).otherwise(0),
        "claimed_by": F.when(own, F.lit(worker)).otherwise(F.col("claimed_by")),
        "lease_expires_at": F.when(own, F.lit(now + lease_s)).otherwise(F.col("lease_expires_at")),
    }).drop("__next")


def release(jobs: DataFrame, job_id: str) -> DataFrame:
    """A claimed job goes back to the queue and the attempt does not count."""
    own = (F.col("job_id") == job_id) & (F.col("state") == "CLAIMED")
    return jobs.withColumns({
        "state": F.when(own, "QUEUED").otherwise(F.col("state")),
        "attempt": F.col("attempt") - F.when(own, 1).otherwise(0),
        "claimed_by": F.when(own, F.lit(None)).otherwise(F.col("claimed_by")),
        "lease_expires_at": F.when(own, F.lit(None)).otherwise(F.col("lease_expires_at")),
    })


def renew(jobs: DataFrame, job_id: str, worker: str, until: float) -> DataFrame:
    """The holder of a lease extends it; anyone else changes nothing."""
    own = (F.col("job_id") == job_id) & (F.col("claimed_by") == worker) & F.col("state").isin("CLAIMED", "RUNNING", "CANCELLING")
    return jobs.withColumn("lease_expires_at", F.when(own, F.lit(until)).otherwise(F.col("lease_expires_at")))


def queue_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` jobs whose signature no active job has, the first of equal ones, appended to ``jobs``."""
    busy = jobs.where(F.col("state").isin(*ACTIVE)).select("signature").distinct()
    fresh = new.join(busy, "signature", "left_anti")
    firsts = fresh.groupBy("signature").agg(F.min_by(F.struct(*[c for c in new.columns if c != "signature"]), F.struct("queued_at", "job_id")).alias("z"))
    return jobs.unionByName(firsts.select("signature", "z.*"), allowMissingColumns=True)


def priority_of(profile: Column) -> Column:
    """0 is served first: previews before standard work before high, verification and reference runs."""
    return F.when(profile == "preview", 0).when(profile == "standard", 1).when(profile == "high", 2).when(profile == "verification", 3).otherwise(4)


def state_of_quality(quality: Column) -> Column:
    out = F.lit("FAILED")
    for name, state in QUALITY_STATE.items():
        out = F.when(quality == name, state).otherwise(out)
    return out


def stream_states(events: DataFrame, job: str = "job_id", to: str = "to") -> DataFrame:
    """Streaming form of the fold: (job, state, n_applied, n_refused) of every job that a batch touches.

    Each job's state is kept by Spark's state store; events are taken in the order
    of ``seq`` within a batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, ok, no = state.get if state.exists else ("QUEUED", 0, 0)
        batch = pd.concat(list(frames))
        for target in batch.sort_values("seq")["to"]:
            if target in TRANSITIONS[now]:
                now, ok = target, ok + 1
            else:
                no += 1
        state.update((now, ok, no))
        yield pd.DataFrame({"job": [key[0]], "state": [now], "n_applied": [ok], "n_refused": [no]})

    kind = events.schema[job].dataType.simpleString()
    shaped = events.select(F.col(job).alias("job"), F.col("seq").cast("long").alias("seq"), F.col(to).alias("to"))
    return shaped.groupBy("job").applyInPandasWithState(
        run, f"job {kind}, state string, n_applied long, n_refused long", "state string, ok long, no long", "update", "NoTimeout"
    )
