"""Queries over the stored job table and over leases as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmgrid.functions.storage import new_folder
from ohmgrid.plans.catalog import _LEGAL, STEP, query, table
from ohmgrid.plans.catalog_board import STATES_SQL, job_table as board_jobs
from ohmgrid.sources import job_table
from ohmgrid.streaming import leases, lifecycle


@query("stored_claims", f"""
    WITH s AS (SELECT *, {STATES_SQL} AS state, CAST(o_orderkey % 3 AS INTEGER) AS attempt FROM orders),
    q AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS INTEGER) AS k FROM s WHERE state = 'QUEUED'),
    c AS (SELECT s.o_orderkey AS job_id, CASE WHEN k <= 2 THEN 'CLAIMED' ELSE state END AS state, attempt + CASE WHEN k <= 2 THEN 1 ELSE 0 END AS attempt, CASE WHEN k <= 2 THEN 'w' || (7 + k) WHEN s.o_orderkey % 5 > 0 THEN 'w1' END AS claimed_by,
                 CASE WHEN k = 1 THEN 160.0 WHEN k = 2 THEN 120.0 ELSE 100.0 END AS lease FROM s LEFT JOIN q USING (o_orderkey))
    SELECT job_id, CASE WHEN state IN ('CLAIMED', 'RUNNING', 'CANCELLING') AND lease < 150 THEN CASE WHEN state = 'CANCELLING' THEN 'CANCELLED' WHEN attempt < 3 THEN 'QUEUED' ELSE 'FAILED' END ELSE state END AS state, CAST(attempt AS INTEGER) AS attempt,
           CASE WHEN state IN ('CLAIMED', 'RUNNING', 'CANCELLING') AND lease < 150 THEN NULL ELSE claimed_by END AS claimed_by, job_id % 2 = 0 AS noted FROM c""")
def stored_claims(spark, d):
    """All orders as jobs of a stored table: two are claimed, leases that have run out are recovered, a later version adds a column; read back by key."""
    root = new_folder(spark, "jobs")
    job_table.commit(board_jobs(spark, d), root, 0)
    job_table.claim(spark, root, "w8", 100.0, 60.0)
    job_table.claim(spark, root, "w9", 100.0, 20.0)
    job_table.recover(spark, root, 150.0)
    job_table.update(spark, root, lambda rows: rows.where("job_id % 2 = 0").withColumn("note", F.lit("even")))
    rows, _ = job_table.read(spark, root)
    return rows.select("job_id", "state", "attempt", "claimed_by", F.col("note").isNotNull().alias("noted"))


HELD = "('CLAIMED', 'RUNNING', 'CANCELLING')"


@query("streamed_leases", f"""
    WITH RECURSIVE e AS (SELECT user_id || ':' || day(ts) // 3 AS job, epoch_ms(ts) AS tm, {STEP} AS t, row_number() OVER (PARTITION BY user_id, day(ts) // 3 ORDER BY ts, event_id) AS k FROM events),
    f(job, k, s, attempt, lease, n_events, n_leases) AS (
      SELECT DISTINCT job, CAST(0 AS BIGINT), 'QUEUED', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e
      UNION ALL
      SELECT job, k, CASE WHEN ok THEN t ELSE s END, attempt + CASE WHEN ok AND t = 'CLAIMED' AND s = 'QUEUED' THEN 1 ELSE 0 END, CASE WHEN ok AND t IN {HELD} THEN tm + 43200000 ELSE lease END,
             n_events + CASE WHEN ok THEN 1 ELSE 0 END, n_leases + CASE WHEN late THEN 1 ELSE 0 END
      FROM (SELECT *, ({_LEGAL}) OR (s = t AND s IN {HELD}) AS ok FROM (
        SELECT job, k, attempt, lease, n_events, n_leases, tm, t, late, CASE WHEN NOT late THEN s WHEN s = 'CANCELLING' THEN 'CANCELLED' WHEN attempt < 3 THEN 'QUEUED' ELSE 'FAILED' END AS s FROM (
          SELECT f.job, e.k, f.attempt, f.lease, f.n_events, f.n_leases, e.tm, e.t, f.s, f.s IN {HELD} AND f.lease < e.tm AS late FROM f JOIN e ON e.job = f.job AND e.k = f.k + 1)))),
    l AS (SELECT *, s IN {HELD} AND lease < (SELECT max(epoch_ms(ts)) FROM events) AS late FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1)
    SELECT job, CASE WHEN NOT late THEN s WHEN s = 'CANCELLING' THEN 'CANCELLED' WHEN attempt < 3 THEN 'QUEUED' ELSE 'FAILED' END AS state, attempt, n_events, n_leases + CASE WHEN late THEN 1 ELSE 0 END AS n_leases
    FROM l WHERE n_events > 0""")
def streamed_leases(spark, d):
    """The lifecycles of users' jobs of three days with leases of twelve hours, as a stream with timers: last states, and how many steps came from events and from leases."""
    # The SQL's names of steps, as Spark reads them too.
    rows = table(spark, d, "events").select(F.concat("user_id", F.lit(":"), F.floor(F.dayofmonth("ts") / 3)).alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.expr(STEP).alias("to"))
    folder = new_folder(spark, "leases")
    rows.write.parquet(f"{folder}/in")
    stream = lifecycle.event_stream(spark, f"{folder}/in", rows.schema, 1_000_000)
    leases.run_leases(stream, f"{folder}/out", f"{folder}/state", "12 hours")
    steps = spark.read.schema(leases.OUT).parquet(f"{folder}/out")
    cause = lambda name: F.count_if(F.col("cause") == name)
    # At one instant a lease ends before an event is taken; a job's last step has the most attempts.
    last = F.max_by(F.struct("state", "attempt"), F.struct("at", F.col("attempt"), F.col("cause") == "event"))
    final = steps.groupBy("job").agg(last.alias("z"), cause("event").alias("n_events"), cause("lease").alias("n_leases"))
    return final.select("job", "z.state", "z.attempt", "n_events", "n_leases")
