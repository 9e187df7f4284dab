"""Registry of named queries and of the SQL that checks them.

The driver's tables stand for board tables by a fixed reading: ``lineitem`` holds
elements or vias (layer ``l_linenumber``, field ``l_extendedprice`` in cents, area
``l_quantity``, error ``l_discount`` in hundredths), ``nation`` layers,
``customer`` nets, ``orders`` jobs, ``events`` lifecycle and generation samples,
``embeddings`` points, ``pages`` untrusted markup and ``documents`` source files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions import quantities as Q
from ohmgrid.functions import units as U
from ohmgrid.operators import graph, jobs, ordered, spatial, validate, weighted
from ohmgrid.sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents():
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def area():
    return F.col("l_quantity").cast("long")


def hundredths():
    return F.round(F.col("l_discount") * 100).cast("long")


# ------------------------------------------------------------------ aggregates
@query("layer_p99_weighted", """
    WITH r AS (
      SELECT l_linenumber AS layer, l_extendedprice AS field,
             sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) AS reached,
             sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_linenumber) AS total
      FROM lineitem)
    SELECT layer, min(field) AS p99 FROM r WHERE reached * 100 >= total * 99 GROUP BY layer""")
def layer_p99_weighted(spark, d):
    elements = table(spark, d, "lineitem").withColumn("layer", F.col("l_linenumber"))
    return weighted.weighted_quantiles(elements, ["layer"], "l_extendedprice", area(), {"p99": (99, 100)})


@query("layer_weighted_mean_peak", """
    SELECT l_linenumber AS layer,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS weighted_sum,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight,
           max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS peak
    FROM lineitem GROUP BY 1""")
def layer_weighted_mean_peak(spark, d):
    elements = table(spark, d, "lineitem").withColumn("layer", F.col("l_linenumber"))
    return weighted.weighted_mean_peak(elements, ["layer"], cents(), area())


@query("net_summary", """
    WITH per_order AS (SELECT l_orderkey, l_linenumber AS layer, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS area FROM lineitem GROUP BY 1, 2),
    regions AS (SELECT o_custkey AS k, string_agg(DISTINCT CAST(layer AS VARCHAR), ',' ORDER BY CAST(layer AS VARCHAR)) AS layers,
                       CAST(sum(n) AS BIGINT) AS region_count, CAST(sum(area) AS BIGINT) AS area
                FROM per_order JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
    vias AS (SELECT o_custkey AS k, count(*) AS via_count FROM orders GROUP BY 1)
    SELECT c_custkey AS net_id, c_name AS name, coalesce(layers, '') AS layers, coalesce(region_count, 0) AS region_count,
           coalesce(via_count, 0) AS via_count, coalesce(area, 0) AS area
    FROM customer LEFT JOIN regions r ON r.k = c_custkey LEFT JOIN vias v ON v.k = c_custkey""")
def net_summary(spark, d):
    """Facts are aggregated before they meet the nets, so no join multiplies another's rows."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.sum(area()).alias("area"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("net_id"))
    regions = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("net_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("layer").cast("string"))), ",").alias("layers"), F.sum("n").alias("region_count"), F.sum("area").alias("area")
    )
    vias = orders.groupBy("net_id").agg(F.count(F.lit(1)).alias("via_count"))
    nets = table(spark, d, "customer").select(F.col("c_custkey").alias("net_id"), F.col("c_name").alias("name"))
    full = nets.join(regions, "net_id", "left").join(vias, "net_id", "left")
    return full.select("net_id", "name", F.coalesce("layers", F.lit("")).alias("layers"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("region_count", "via_count", "area")])


@query("via_groups", """
    SELECT l_returnflag AS from_layer, l_linestatus AS to_layer, l_discount AS drill, count(*) AS n,
           CASE WHEN count(DISTINCT l_tax) = 1 THEN min(l_tax) END AS padstack
    FROM lineitem GROUP BY 1, 2, 3""")
def via_groups(spark, d):
    """Vias by span and drill, a null drill being a group; the padstack only if all agree."""
    vias = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("from_layer"), F.col("l_linestatus").alias("to_layer"), F.col("l_discount").alias("drill"), F.col("l_tax").alias("padstack")
    )
    return vias.groupBy("from_layer", "to_layer", "drill").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.min("padstack") == F.max("padstack"), F.min("padstack")).alias("padstack")
    )


@query("layer_stats", """
    WITH spans AS (SELECT least(l_linenumber, l_suppkey % 25) AS lo, greatest(l_linenumber, l_suppkey % 25) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2),
    own AS (SELECT l_linenumber AS layer, count(*) AS features, count(DISTINCT l_suppkey) AS nets, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS area FROM lineitem GROUP BY 1)
    SELECT n_nationkey AS layer, coalesce(max(features), 0) AS features, coalesce(max(nets), 0) AS nets, coalesce(max(area), 0) AS area,
           CAST(coalesce(sum(s.n), 0) AS BIGINT) AS vias
    FROM nation LEFT JOIN own ON own.layer = n_nationkey LEFT JOIN spans s ON n_nationkey BETWEEN s.lo AND s.hi GROUP BY 1""")
def layer_stats(spark, d):
    items = table(spark, d, "lineitem")
    own = items.groupBy(F.col("l_linenumber").alias("layer")).agg(F.count(F.lit(1)).alias("features"), F.countDistinct("l_suppkey").alias("nets"), F.sum(area()).alias("area"))
    vias = spatial.covering_counts(items, F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 25).select(F.col("idx").alias("layer"), F.col("n").alias("vias"))
    layers = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer"))
    full = layers.join(own, "layer", "left").join(vias, "layer", "left")
    return full.select("layer", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("features", "nets", "area", "vias")])


@query("layer_z", """
    WITH t AS (SELECT n_nationkey AS layer, CASE WHEN n_nationkey <> 13 THEN CAST(n_regionkey + 1 AS BIGINT) END AS thickness FROM nation),
    r AS (SELECT layer, thickness, coalesce(sum(thickness) OVER w, 0) AS above, coalesce(bool_or(thickness IS NULL) OVER w, false) AS lost FROM t
          WINDOW w AS (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT layer, CASE WHEN NOT lost THEN CAST(above AS BIGINT) END AS z_top FROM r""")
def layer_z(spark, d):
    from ohmgrid.operators import review

    layers = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("layer"), F.when(F.col("n_nationkey") != 13, (F.col("n_regionkey") + 1).cast("long")).alias("thickness")
    )
    return review.layer_tops(layers, [], "layer", "thickness").select("layer", "z_top")


@query("weakest_provenance", """
    SELECT c_custkey AS net_id, CASE min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 2 WHEN 'F' THEN 3 END)
           WHEN 0 THEN 'assumed' WHEN 2 THEN 'configured' WHEN 3 THEN 'imported' ELSE 'derived' END AS provenance
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def weakest_provenance(spark, d):
    named = F.when(F.col("o_orderstatus") == "P", "assumed").when(F.col("o_orderstatus") == "O", "configured").when(F.col("o_orderstatus") == "F", "imported")
    per_net = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("net_id")).agg(Q.weakest_provenance(named).alias("provenance"))
    nets = table(spark, d, "customer").select(F.col("c_custkey").alias("net_id"))
    return nets.join(per_net, "net_id", "left").select("net_id", F.coalesce("provenance", F.lit("derived")).alias("provenance"))


@query("wide_histogram_48", """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT CAST(least(47, greatest(0, floor((l_extendedprice - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 48))) AS INTEGER) AS bin, count(*) AS n
    FROM lineitem, b GROUP BY 1""")
def wide_histogram_48(spark, d):
    return weighted.histogram(table(spark, d, "lineitem"), F.col("l_extendedprice"), 48)


@query("auto_range_clip_p995", """
    WITH r AS (
      SELECT l_linenumber AS layer, l_extendedprice AS field,
             sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) AS reached,
             sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_linenumber) AS total FROM lineitem)
    SELECT layer, min(field) AS low, max(field) AS peak, min(field) FILTER (WHERE reached * 1000 >= total * 995) AS high FROM r GROUP BY layer""")
def auto_range_clip_p995(spark, d):
    elements = table(spark, d, "lineitem").withColumn("layer", F.col("l_linenumber"))
    return weighted.auto_range(elements, ["layer"], "l_extendedprice", area())


@query("per_net_result", """
    SELECT o_custkey AS net_id, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS max_v, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS min_v,
           max(CAST(round(l_extendedprice * 100) AS BIGINT)) - min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS drop_v,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS loss
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def per_net_result(spark, d):
    part = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(cents()).alias("hi"), F.min(cents()).alias("lo"), F.sum(area()).alias("w"))
    met = part.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("net_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("net_id").agg(F.max("hi").alias("max_v"), F.min("lo").alias("min_v"), (F.max("hi") - F.min("lo")).alias("drop_v"), F.sum("w").alias("loss"))


@query("assemble_coo", """
    SELECT l_partkey AS row, l_suppkey AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def assemble_coo(spark, d):
    from ohmgrid.operators import fem

    entries = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), area().alias("val"))
    return fem.assemble(entries)


@query("matrix_row_stats", """
    WITH m AS (SELECT l_partkey AS row, l_suppkey AS col, sum(CAST(l_quantity AS BIGINT)) AS val FROM lineitem GROUP BY 1, 2)
    SELECT row, count(*) AS nnz, CAST(sum(CASE WHEN row % 100 = col % 100 THEN val ELSE 0 END) AS BIGINT) AS diagonal, CAST(sum(val) AS BIGINT) AS row_sum FROM m GROUP BY 1""")
def matrix_row_stats(spark, d):
    m = assemble_coo(spark, d)
    on_diagonal = F.when(F.col("row") % 100 == F.col("col") % 100, F.col("val")).otherwise(0)
    return m.groupBy("row").agg(F.count(F.lit(1)).alias("nnz"), F.sum(on_diagonal).alias("diagonal"), F.sum("val").alias("row_sum"))


@query("loglog_slope", """
    SELECT l_linenumber AS layer, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, count(*) AS n
    FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY 1""")
def loglog_slope(spark, d):
    rows = table(spark, d, "lineitem").withColumn("layer", F.col("l_linenumber"))
    found = weighted.log_log_slope(rows, ["layer"], F.col("l_quantity"), F.col("l_extendedprice"))
    return found.select("layer", F.round("slope", 6).alias("slope"), "n")


@query("mesh_quality", """
    WITH r AS (SELECT l_linenumber AS layer, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) - 1 AS k,
                      count(*) OVER (PARTITION BY l_linenumber) - 1 AS m FROM lineitem)
    SELECT layer, min(v) AS least, CAST(max(v) FILTER (WHERE k = m // 20) * (20 - max(m) % 20) + max(v) FILTER (WHERE k = least(m // 20 + 1, m)) * (max(m) % 20) AS BIGINT) AS p05_x20,
           count(*) FILTER (WHERE l_quantity < 5) AS slivers FROM r GROUP BY layer""")
def mesh_quality(spark, d):
    """The interpolated 5th percentile is given times 20, so that it stays an integer."""
    cells = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"), cents().alias("v"), "l_quantity")
    low = weighted.twentieth(cells, ["layer"], "v")
    plain = cells.groupBy("layer").agg(F.min("v").alias("least"), F.count_if(F.col("l_quantity") < 5).alias("slivers"))
    return plain.join(low, "layer").select("layer", "least", "p05_x20", "slivers")


# ------------------------------------------------------------------ ordered operators
@query("doerfler_marking", """
    WITH e AS (SELECT l_linenumber AS layer, CAST(round(l_discount * 100) AS BIGINT) AS err FROM lineitem),
    r AS (SELECT layer, err, CAST(sum(err * err) OVER (PARTITION BY layer ORDER BY err DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - err * err AS before,
                 CAST(sum(err * err) OVER (PARTITION BY layer) AS BIGINT) AS total FROM e),
    m AS (SELECT * FROM r WHERE before * 10 < total * 7 AND err > 0)
    SELECT layer, total, count(*) AS n_marked, min(err) AS threshold, count(*) FILTER (WHERE err = (SELECT min(err) FROM m AS o WHERE o.layer = m.layer)) AS n_at_threshold
    FROM m GROUP BY layer, total""")
def doerfler_marking(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"), hundredths().alias("err"))
    return ordered.doerfler(rows, ["layer"], "err", (7, 10))


@query("marked_rows", """
    WITH e AS (SELECT l_linenumber AS layer, l_orderkey AS k, CAST(round(l_discount * 100) AS BIGINT) AS err FROM lineitem),
    r AS (SELECT *, CAST(sum(err * err) OVER (PARTITION BY layer ORDER BY err DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - err * err AS before,
                 CAST(sum(err * err) OVER (PARTITION BY layer) AS BIGINT) AS total FROM e)
    SELECT layer, k, err FROM r WHERE before * 10 < total * 7 AND err > 0""")
def marked_rows(spark, d):
    """The rows that are marked, those at the threshold by their order."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"), F.col("l_orderkey").alias("k"), hundredths().alias("err"))
    return ordered.mark(rows, ["layer"], "err", ["k"], (7, 10))


EVENT_CHANGE = """
    SELECT event_id, user_id, ts, value, CASE WHEN lag(value) OVER w <> 0 THEN abs(value - lag(value) OVER w) / abs(lag(value) OVER w) END AS change
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query("relative_change", f"SELECT event_id, change FROM ({EVENT_CHANGE})")
def relative_change(spark, d):
    return ordered.with_change(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "change")


@query("longest_streak", f"""
    WITH c AS ({EVENT_CHANGE}), b AS (SELECT *, coalesce(change <= 0.5, false) AS ok FROM c),
    i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b),
    n AS (SELECT user_id, island, count(*) FILTER (WHERE ok) AS n FROM i GROUP BY 1, 2)
    SELECT user_id, max(n) AS longest, arg_max(n, island) AS current FROM n GROUP BY 1""")
def longest_streak(spark, d):
    changed = ordered.with_change(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return ordered.streaks(changed, ["user_id"], ["ts", "event_id"], F.col("change") <= 0.5)


LAST_THREE = """
    WITH k AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
    l AS (SELECT user_id, max(value) FILTER (WHERE k = 1) AS v1, max(value) FILTER (WHERE k = 2) AS v2, max(value) FILTER (WHERE k = 3) AS v3,
                 max(event_id) FILTER (WHERE k = 1) + 1 AS d1, max(event_id) FILTER (WHERE k = 2) + 1 AS d2 FROM k WHERE k <= 3 GROUP BY 1)"""


@query("richardson_guarded", LAST_THREE + """,
    g AS (SELECT *, CASE WHEN (v2 - v3) * (v1 - v2) > 0 AND abs(v1 - v2) < abs(v2 - v3) AND d1 > d2
                         THEN ln(abs((v2 - v3) / (v1 - v2))) / ln(sqrt(CAST(d1 AS DOUBLE) / d2)) END AS rate FROM l)
    SELECT user_id, round(CASE WHEN rate BETWEEN 0.5 AND 6 THEN v1 + (v1 - v2) / (pow(sqrt(CAST(d1 AS DOUBLE) / d2), rate) - 1) END, 6) AS lim,
           round(CASE WHEN rate BETWEEN 0.5 AND 6 THEN rate END, 6) AS rate FROM g""")
def richardson_guarded(spark, d):
    last = ordered.last_values(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_id"])
    found = ordered.richardson(F.col("value_1"), F.col("value_2"), F.col("value_3"), F.col("event_id_1") + 1, F.col("event_id_2") + 1)
    return last.withColumn("z", found).select("user_id", F.round("z.limit", 6).alias("lim"), F.round("z.rate", 6).alias("rate"))


@query("quantity_verdict", LAST_THREE + """
    SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'singular' WHEN v2 <> 0 AND abs(v1 - v2) / abs(v2) <= 0.25 THEN 'converged' ELSE 'moving' END AS verdict FROM l""")
def quantity_verdict(spark, d):
    last = ordered.last_values(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"], 2)
    change = ordered.relative_change(F.col("value_1"), F.col("value_2"))
    return last.select("user_id", ordered.verdict(change, 0.25, F.col("user_id") % 7 == 0).alias("verdict"))


@query("adjacent_pairs", """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, lead(l_linenumber) OVER w AS next_l_linenumber, lead(l_partkey) OVER w AS next_l_partkey
               FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
    SELECT * FROM p WHERE next_l_linenumber IS NOT NULL""")
def adjacent_pairs(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ordered.adjacent_pairs(table(spark, d, "lineitem"), ["l_orderkey"], order, ["l_linenumber", "l_partkey"])


@query("dangling", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) < 2")
def dangling(spark, d):
    return ordered.dangling(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("monotone_series", """
    WITH s AS (SELECT user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, event_type, coalesce(bool_and(value < p), true) AS decreasing, count(*) AS n FROM s GROUP BY 1, 2""")
def monotone_series(spark, d):
    return ordered.monotone(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("claim_next", """
    SELECT o_orderkey AS job_id, o_orderpriority AS priority, o_orderdate AS queued_at FROM orders WHERE o_orderstatus = 'O'
    ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 10""")
def claim_next(spark, d):
    """Ten next jobs: the limit is the operator."""
    queue = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("queued_at"), "o_orderstatus")
    return ordered.claim_next(queue, "o_orderstatus", "O", ["priority", "queued_at", "job_id"], 10).drop("o_orderstatus")


@query("recent_jobs", "SELECT o_orderkey AS job_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_jobs(spark, d):
    """The most recent jobs; the limit is clamped to 1..500."""
    jobs_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))
    return jobs_.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(min(max(50, 1), 500))


@query("latest_by_signature", """
    SELECT o_custkey AS signature, o_orderdate AS created_at, o_orderkey AS job_id, o_orderstatus AS state
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_by_signature(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("signature"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("state"))
    return ordered.latest_by(rows, ["signature"], ["created_at", "job_id"])


@query("active_duplicate_anti", """
    SELECT o_orderkey AS job_id, o_custkey AS signature FROM orders f WHERE o_orderstatus = 'F'
    AND NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = f.o_custkey AND a.o_orderstatus IN ('O', 'P') AND a.o_orderpriority = '1-URGENT')""")
def active_duplicate_anti(spark, d):
    orders = table(spark, d, "orders")
    busy = orders.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") == "1-URGENT")).select("o_custkey").distinct()
    fresh = orders.where(F.col("o_orderstatus") == "F").join(busy, "o_custkey", "left_anti")
    return fresh.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("signature"))


@query("memory_admission", """
    WITH c AS (SELECT o_orderpriority AS lane, o_orderkey AS job_id,
                      CAST(sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS committed
               FROM (SELECT *, floor(o_totalprice) AS p FROM orders) o2, LATERAL (SELECT 1) WHERE o_orderstatus = 'O')
    SELECT lane, job_id, committed, committed <= 50000000 AS admitted FROM c""".replace("CAST(o_totalprice AS BIGINT)", "CAST(p AS BIGINT)"))
def memory_admission(spark, d):
    queue = table(spark, d, "orders").where(F.col("o_orderstatus") == "O").select(
        F.col("o_orderpriority").alias("lane"), F.col("o_orderkey").alias("job_id"), "o_orderdate", F.floor("o_totalprice").cast("long").alias("need")
    )
    return ordered.admitted(queue, ["lane"], ["o_orderdate", "job_id"], F.col("need"), 50_000_000).select("lane", "job_id", "committed", "admitted")


@query("lru_top8", """
    WITH z AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, ts, event_id FROM z WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 8""")
def lru_top8(spark, d):
    """The eight boards touched last; the limit is the operator."""
    return ordered.most_recent(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8)


# ------------------------------------------------------------------ graphs and space
EDGES = "SELECT DISTINCT l_partkey AS u, l_suppkey + 100000000 AS v FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09"
# Min-label rounds by a recursive table: enough for the thinned graph, whose components are shallow.
COMPONENTS = f"""
    WITH RECURSIVE e AS ({EDGES}), dirs AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    reach(node, root) AS (SELECT u, u FROM dirs UNION SELECT b.v, r.root FROM reach r JOIN dirs b ON b.u = r.node),
    c AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"""


def thinned_edges(spark, d):
    strong = table(spark, d, "lineitem").where((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.09))
    return strong.select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 100_000_000).alias("v"))


@query("components", COMPONENTS + " SELECT node, component FROM c")
def components(spark, d):
    return graph.connected_components(thinned_edges(spark, d))


@query("component_dense_ids", COMPONENTS + " SELECT node, component, dense_rank() OVER (ORDER BY component) - 1 AS dof FROM c")
def component_dense_ids(spark, d):
    return graph.dense_ids(graph.connected_components(thinned_edges(spark, d)))


def all_edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 100_000_000).alias("v"))


# One row a node, updated in place, so that all of lineitem can be checked; tests also hold these against union-find.
COMPONENTS_ALL = """
    WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS u, l_suppkey + 100000000 AS v FROM lineitem), dirs AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    c(node, component) USING KEY (node) AS (
      SELECT DISTINCT u, u FROM dirs
      UNION (SELECT DISTINCT ON (a.node) a.node, b.component FROM recurring.c AS a JOIN dirs d ON d.u = a.node JOIN c AS b ON b.node = d.v WHERE b.component < a.component ORDER BY a.node, b.component))"""


@query("components_all", COMPONENTS_ALL + " SELECT node, component FROM c")
def components_all(spark, d):
    """Components of the graph of all of lineitem."""
    return graph.connected_components(all_edges(spark, d))


@query("component_dense_ids_all", COMPONENTS_ALL + " SELECT node, component, dense_rank() OVER (ORDER BY component) - 1 AS dof FROM c")
def component_dense_ids_all(spark, d):
    """The components of all of lineitem, numbered from 0 by their smallest node."""
    return graph.dense_ids(graph.connected_components(all_edges(spark, d)))


POINTS = "SELECT p_partkey AS k, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 9973 AS DOUBLE) AS y, p_size FROM part"


def part_points(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), ((k * 7919) % 10007).cast("double").alias("x"), ((k * 104729) % 9973).cast("double").alias("y"), "p_size")


@query("consolidated_clusters", f"""
    WITH RECURSIVE p AS ({POINTS}), near AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k <> b.k AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60
        AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60),
    reach(k, root) AS (SELECT k, k FROM p UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.k),
    c AS (SELECT k, min(root) AS cluster FROM reach GROUP BY 1)
    SELECT cluster, string_agg(CAST(k AS VARCHAR), '+' ORDER BY k) AS members, count(*) AS n FROM c GROUP BY 1""")
def consolidated_clusters(spark, d):
    points = part_points(spark, d)
    found = spatial.clusters(points, "k", spatial.chained(points, "k", "x", "y", 60.0))
    # A cluster's name lists its members, as many as lie in one place.
    members = F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: k.cast("string")), "+")
    return found.groupBy("cluster").agg(members.alias("members"), F.count(F.lit(1)).alias("n"))


@query("overlap_pairs", f"""
    WITH p AS (SELECT *, p_size AS r, k % 5 AS lo, k % 5 + p_size % 3 AS hi FROM ({POINTS}))
    SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k < b.k AND abs(a.x - b.x) < 100 AND abs(a.y - b.y) < 100
    WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < a.r + b.r AND a.lo <= b.hi AND b.lo <= a.hi""")
def overlap_pairs(spark, d):
    vias = part_points(spark, d).withColumns({"r": F.col("p_size").cast("double"), "lo": F.col("k") % 5, "hi": F.col("k") % 5 + F.col("p_size") % 3})
    return spatial.overlap_pairs(vias, "k", "x", "y", "r", "lo", "hi", 50.0)


@query("knn_size_field", """
    WITH e AS (SELECT vec_id, label, embedding[1] AS x, embedding[2] AS y, CAST(abs(embedding[3]) AS DOUBLE) + CAST(0.01 AS DOUBLE) AS size FROM embeddings),
    q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
    p AS (SELECT q.vec_id, e.size, sqrt((CAST(q.x AS DOUBLE) - e.x) * (CAST(q.x AS DOUBLE) - e.x) + (CAST(q.y AS DOUBLE) - e.y) * (CAST(q.y AS DOUBLE) - e.y)) AS dist, e.vec_id AS other FROM q JOIN e ON e.label = q.label),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS k FROM p)
    SELECT vec_id, round(min(least(size + 0.7 * dist, 1.0)), 9) AS size FROM k WHERE k <= 8 GROUP BY 1""")
def knn_size_field(spark, d):
    """Element size at each hundredth point from its eight nearest seeds of the layer, growing with distance and capped."""
    from ohmgrid.operators import mesh

    points = table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("layer"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"),
        (F.abs(F.get("embedding", F.lit(2))).cast("double") + 0.01).alias("size"),
    )
    asked = points.where(F.col("vec_id") % 100 == 0).select("vec_id", "layer", F.col("x").alias("px"), F.col("y").alias("py"))
    seeds = points.select("layer", F.col("vec_id").alias("seed"), F.col("x").alias("nx"), F.col("y").alias("ny"), "size")
    found = mesh.size_field(asked, seeds, "vec_id", "seed", ["layer"], growth=0.7, largest=1.0, k=8)
    return found.select("vec_id", F.round("size", 9).alias("size"))


@query("nearest_node", """
    WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    p AS (SELECT q.vec_id, e.vec_id AS node, sqrt((q.x - e.x) * (q.x - e.x) + (q.y - e.y) * (q.y - e.y)) AS dist FROM e q JOIN e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT vec_id, arg_min(node, dist) AS node FROM p GROUP BY 1""")
def nearest_node(spark, d):
    points = table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    asked = points.where(F.col("vec_id") % 100 == 0).select("vec_id", "label", F.col("x").alias("px"), F.col("y").alias("py"))
    nodes = points.select("label", F.col("vec_id").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    # The point is a node itself: of the two nearest, the one that it is not.
    found = spatial.nearest_k(asked, nodes, "vec_id", "node", ["label"], 2).where(F.col("vec_id") != F.col("node"))
    return found.groupBy("vec_id").agg(F.min_by("node", "rank").alias("node"))


@query("interval_span_expand", """
    SELECT l_orderkey, l_linenumber, l_suppkey, n_nationkey AS layer, n_name FROM lineitem
    JOIN nation ON n_nationkey BETWEEN least(l_linenumber, l_suppkey % 10) AND greatest(l_linenumber, l_suppkey % 10)""")
def interval_span_expand(spark, d):
    vias = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_linenumber").cast("long").alias("low"), (F.col("l_suppkey") % 10).alias("high"))
    layers = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer"), "n_name")
    return spatial.interval_join(vias, layers, "low", "high", "layer").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("layer").cast("int").alias("layer"), "n_name")


# An L-shaped outline around the middle of (quantity, price) space.
OUTLINE = [(5.0, 20000.0), (45.0, 20000.0), (45.0, 40000.0), (25.0, 60000.0), (25.0, 90000.0), (5.0, 90000.0)]


def _crossing_sql(k: int) -> str:
    (x1, y1), (x2, y2) = OUTLINE[k], OUTLINE[(k + 1) % len(OUTLINE)]
    if y1 == y2:
        return "0"
    return f"CAST((({y2} > y) <> ({y1} > y)) AND x < CAST({x1} AS DOUBLE) + (y - CAST({y1} AS DOUBLE)) * (CAST({x2} AS DOUBLE) - CAST({x1} AS DOUBLE)) / (CAST({y2} AS DOUBLE) - CAST({y1} AS DOUBLE)) AS INTEGER)"


@query("point_in_ring", f"""
    SELECT l_linenumber AS layer, count(*) FILTER (WHERE ({" + ".join(_crossing_sql(k) for k in range(len(OUTLINE)))}) % 2 = 1) AS inside, count(*) AS n
    FROM (SELECT l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1""")
def point_in_ring(spark, d):
    hits = F.lit(0)
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    for (x1, y1), (x2, y2) in zip(OUTLINE, OUTLINE[1:] + OUTLINE[:1], strict=True):
        hits = hits + spatial.crosses(x, y, F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2)).cast("int")
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("layer")).agg(F.count_if(hits % 2 == 1).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("ring_area_bbox", """
    WITH p AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS x, CAST(round(l_extendedprice * 100) AS BIGINT) AS y,
                      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    q AS (SELECT p.*, t.x AS tx, t.y AS ty FROM p JOIN p t ON t.l_orderkey = p.l_orderkey AND t.k = p.k % p.n + 1)
    SELECT l_orderkey, CAST(abs(sum(x * ty - tx * y)) AS BIGINT) AS area2, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM q WHERE n >= 3 GROUP BY 1""")
def ring_area_bbox(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", area().alias("x"), cents().alias("y"))
    rings = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("p")).where(F.size("p") >= 3)
    exact = F.transform("p", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    box = rings.select("l_orderkey", F.round(2 * spatial.ring_area(exact)).cast("long").alias("area2"), spatial.bounding_box(F.col("p")).alias("b"))
    return box.select("l_orderkey", "area2", "b.min_x", "b.max_x", "b.min_y", "b.max_y")


@query("semi_studied", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_studied(spark, d):
    studied = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(studied, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("anti_unknown", "SELECT c_custkey AS net_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unknown(spark, d):
    nets = table(spark, d, "customer").select(F.col("c_custkey").alias("net_id"))
    return nets.join(table(spark, d, "orders").select(F.col("o_custkey").alias("net_id")), "net_id", "left_anti")


@query("source_load_overlap", "SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def source_load_overlap(spark, d):
    items = table(spark, d, "lineitem")
    named = items.select(F.col("l_partkey").alias("member"), "l_returnflag", "l_linestatus")
    return validate.overlaps(named.where(F.col("l_returnflag") == "R"), named.where(F.col("l_linestatus") == "O"), ["member"])


@query("profiles_without_shape", "SELECT DISTINCT o_orderpriority AS profile FROM orders EXCEPT SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 490000")
def profiles_without_shape(spark, d):
    orders = table(spark, d, "orders")
    shaped = orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 490000)).select("o_orderpriority")
    return orders.select(F.col("o_orderpriority").alias("profile")).distinct().exceptAll(shaped.distinct())


# ------------------------------------------------------------------ markup, text, documents
@query("reject_doctype", r"SELECT page_id, regexp_matches(substr(html, 1, 8192), '(?i)<!\s*(DOCTYPE|ENTITY)') AS rejected FROM pages")
def reject_doctype(spark, d):
    return table(spark, d, "pages").select("page_id", markup.has_doctype(F.col("html")).alias("rejected"))


@query("format_sniff", "SELECT page_id, CASE WHEN contains(lower(substr(html, 1, 8192)), '<html') THEN 'html' WHEN starts_with(ltrim(html), '{') THEN 'json' ELSE 'unknown' END AS format FROM pages")
def format_sniff(spark, d):
    return table(spark, d, "pages").select("page_id", markup.sniff(F.col("html"), {"html": "<html"}).alias("format"))


@query("unknown_construct_tally", r"""
    SELECT lower(t) AS label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages)
    WHERE lower(t) NOT IN ('html', 'head', 'body', 'p') GROUP BY 1""")
def unknown_construct_tally(spark, d):
    return markup.unknown_tags(table(spark, d, "pages"), "html", ["html", "head", "body", "p"])


@query("slug_unique", r"""
    WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM part),
    k AS (SELECT p_partkey, CASE WHEN b = '' THEN 'item' ELSE b END AS b FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS k FROM k)
    SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS slug FROM n""")
def slug_unique(spark, d):
    return Q.unique_slugs(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "slug")


@query("unit_scale", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1e-3 WHEN 1 THEN 25.4e-3 WHEN 2 THEN 1e-6 ELSE 25.4e-6 END AS metres FROM lineitem""")
def unit_scale(spark, d):
    unit = F.element_at(F.array(F.lit("millimeter"), F.lit("INCH"), F.lit("micron"), F.lit("mil")), F.col("l_linenumber") % 4 + 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", U.to_metres(F.col("l_quantity"), unit).alias("metres"))


@query("content_digest", "SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS copies, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents")
def content_digest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", Q.content_digest(F.col("text")).alias("digest"))
    return docs.join(docs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")), "digest").select("doc_id", "digest", "copies", "first")


@query("analysis_signature", """
    SELECT l_orderkey, sha256(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) || '|' || CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR)) AS signature FROM lineitem GROUP BY 1""")
def analysis_signature(spark, d):
    """Order-insensitive digest of a group's members and load."""
    members = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.concat(members, F.lit("|"), F.sum(area()).cast("string")), 256).alias("signature"))


@query("spec_upgrade", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), '') AS first_id, CASE WHEN json_extract_string(props, '$.page') IS NULL AND json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END AS n FROM events")
def spec_upgrade(spark, d):
    """Specs of either schema: a plural list wins over a single id, neither is an empty list."""
    spec = F.from_json("props", "page string, k string")
    ids = F.coalesce(F.when(spec["page"].isNotNull(), F.array(spec["page"])), F.when(spec["k"].isNotNull(), F.array(spec["k"])), F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.get(ids, F.lit(0)), F.lit("")).alias("first_id"), F.size(ids).alias("n"))


@query("netlist_mismatch", """
    SELECT o_orderkey AS pin, c_mktsegment AS declared, CASE WHEN o_orderstatus = 'P' THEN 'BUILDING' END AS artwork,
           coalesce(CASE WHEN o_orderstatus = 'P' THEN 'BUILDING' END, c_mktsegment) AS net,
           coalesce(CASE WHEN o_orderstatus = 'P' THEN 'BUILDING' END <> c_mktsegment, false) AS mismatch
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def netlist_mismatch(spark, d):
    """Declared against drawn nets; what is drawn wins."""
    pins = table(spark, d, "orders").select(F.col("o_orderkey").alias("pin"), F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "BUILDING").alias("artwork"))
    nets = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("declared"))
    met = pins.join(nets, "c_custkey", "left")
    return met.select("pin", "declared", "artwork", F.coalesce("artwork", "declared").alias("net"), F.coalesce(F.col("artwork") != F.col("declared"), F.lit(False)).alias("mismatch"))


@query("diagnostics_union", """
    WITH x AS (SELECT 'negative_balance' AS code, c_custkey AS pos, c_name AS subject FROM customer WHERE c_acctbal < 0
               UNION ALL SELECT 'supplier_negative', s_suppkey, s_name FROM supplier WHERE s_acctbal < 0
               UNION ALL SELECT 'small_part', p_partkey, p_name FROM part WHERE p_size <= 2)
    SELECT code, count(*) AS n, min(pos) AS first_pos, arg_min(subject, pos) AS first_subject FROM x GROUP BY 1""")
def diagnostics_union(spark, d):
    parts = [
        table(spark, d, "customer").where("c_acctbal < 0").selectExpr("'negative_balance' AS code", "c_custkey AS pos", "c_name AS subject"),
        table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("'supplier_negative' AS code", "s_suppkey AS pos", "s_name AS subject"),
        table(spark, d, "part").where("p_size <= 2").selectExpr("'small_part' AS code", "p_partkey AS pos", "p_name AS subject"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.min_by("subject", "pos").alias("first_subject"))


@query("validate_checks", """
    SELECT 'unique_orders' AS name, NOT EXISTS (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) AS passed
    UNION ALL SELECT 'known_nets', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 'positive_area', (SELECT bool_and(l_quantity > 0) FROM lineitem)
    UNION ALL SELECT 'unique_lines', NOT EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def validate_checks(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    return validate.report({
        "unique_orders": validate.duplicates(orders, ["o_orderkey"]),
        "known_nets": validate.unknown(orders, "o_custkey", table(spark, d, "customer"), "c_custkey"),
        "positive_area": items.where(~(F.col("l_quantity") > 0)),
        "unique_lines": validate.duplicates(items, ["l_orderkey", "l_linenumber"]),
    })


@query("capability_report", """
    WITH c AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_quantity > 60) AS b, count(*) FILTER (WHERE l_discount > 0.09) AS x, count(*) AS n FROM lineitem)
    SELECT n, CASE WHEN a = 0 THEN 'missing' ELSE 'available' END AS copper, CASE WHEN b = 0 THEN 'missing' ELSE 'available' END AS profile,
           CASE WHEN x = n THEN 'available' WHEN x > 0 THEN 'partial' ELSE 'missing' END AS thickness, CASE WHEN a > 0 AND b > 0 THEN 'READY' ELSE 'NOT_READY' END AS readiness FROM c""")
def capability_report(spark, d):
    from ohmgrid.operators import review

    counts = table(spark, d, "lineitem").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_quantity") > 60).alias("b"), F.count_if(F.col("l_discount") > 0.09).alias("x"), F.count(F.lit(1)).alias("n"))
    return counts.select(
        "n", review.capability(F.col("a")).alias("copper"), review.capability(F.col("b")).alias("profile"),
        review.capability(F.col("x"), F.col("n")).alias("thickness"), review.readiness([F.col("a"), F.col("b")]).alias("readiness"),
    )


@query("layer_classify", """
    WITH m AS (SELECT p_partkey, p_size, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'signal' WHEN 'SMALL' THEN 'plane' WHEN 'MEDIUM' THEN 'dielectric' WHEN 'LARGE' THEN 'solder_mask' WHEN 'ECONOMY' THEN 'mixed' END AS fn FROM part)
    SELECT p_partkey, fn AS function, CAST(row_number() OVER (PARTITION BY fn ORDER BY p_partkey) - 1 AS INTEGER) AS idx
    FROM m WHERE fn IS NOT NULL AND NOT (p_size <= 5 AND fn NOT IN ('signal', 'plane', 'mixed'))""")
def layer_classify(spark, d):
    from ohmgrid.operators import review

    layers = table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("declared"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).otherwise(0.0).alias("thickness"))
    names = {"STANDARD": "signal", "SMALL": "plane", "MEDIUM": "dielectric", "LARGE": "solder_mask", "ECONOMY": "mixed"}
    return review.classify_layers(layers, "declared", "thickness", ["function"], "p_partkey", names).select("p_partkey", "function", "idx")


# ------------------------------------------------------------------ lifecycle and generated boards
@query("lease_expiry", """
    SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1995-01-01' THEN CASE WHEN o_orderkey % 4 < 3 THEN 'QUEUED' ELSE 'FAILED' END
           WHEN o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'COMPLETED' END AS state FROM orders""")
def lease_expiry(spark, d):
    state = F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("COMPLETED")
    expired = jobs.expire(state, F.col("o_orderdate"), F.col("o_orderkey") % 4, F.lit("1995-01-01").cast("timestamp"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), expired.alias("state"))


STEP = "CASE event_type WHEN 'click' THEN 'CLAIMED' WHEN 'view' THEN 'RUNNING' WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'CANCELLING' END"
_LEGAL = """(s = 'QUEUED' AND t IN ('CLAIMED', 'CANCELLING', 'CANCELLED')) OR (s = 'CLAIMED' AND t IN ('RUNNING', 'QUEUED', 'FAILED', 'CANCELLING'))
    OR (s = 'RUNNING' AND t IN ('COMPLETED', 'COMPLETED_WITH_WARNINGS', 'FAILED', 'CANCELLING', 'QUEUED')) OR (s = 'CANCELLING' AND t IN ('CANCELLED', 'FAILED'))"""


@query("transition_guard", f"""
    WITH RECURSIVE e AS (SELECT user_id, {STEP} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f(user_id, k, s, ok, no) AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'QUEUED', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e
      UNION ALL SELECT f.user_id, e.k, CASE WHEN {_LEGAL} THEN t ELSE s END, ok + CASE WHEN {_LEGAL} THEN 1 ELSE 0 END, no + CASE WHEN {_LEGAL} THEN 0 ELSE 1 END
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, arg_max(s, k) AS state, arg_max(ok, k) AS n_applied, arg_max(no, k) AS n_refused FROM f GROUP BY 1""")
def transition_guard(spark, d):
    to = F.expr(STEP)
    return jobs.fold_states(table(spark, d, "events").withColumn("to", to), "user_id", ["ts", "event_id"], "to")


@query("accuracy_profile", """
    WITH p(profile, divisions, across, growth, verify) AS (VALUES ('preview', 180, 8, 0.5, false), ('standard', 300, 10, 0.5, false), ('high', 500, 14, 0.45, false), ('verification', 800, 18, 0.4, true), ('reference', 180, 8, 0.5, false))
    SELECT profile, 0.1 / divisions AS max_element, 0.1 / divisions * 0.01 AS min_element, across, CAST(growth AS DOUBLE) AS growth, verify FROM p""")
def accuracy_profile(spark, d):
    from ohmgrid.operators import mesh

    return mesh.profiles(spark, 0.1)


@query("verification_compare", """
    WITH a AS (SELECT l_returnflag AS quantity, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS base FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1),
    b AS (SELECT l_returnflag AS quantity, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS refined FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
    SELECT quantity, base, refined, CASE WHEN refined <> 0 THEN abs(base - refined) / abs(refined) END AS change, coalesce(abs(base - refined) / abs(refined) <= 0.01, false) AS within FROM a JOIN b USING (quantity)""")
def verification_compare(spark, d):
    from ohmgrid.operators import mesh

    items = table(spark, d, "lineitem")
    one, two = (items.where(F.col("l_linenumber") % 2 == k).groupBy(F.col("l_returnflag").alias("quantity")).agg(F.sum(area()).cast("double").alias("value")) for k in (0, 1))
    return mesh.compare_runs(one, two, 0.01)


# ------------------------------------------------------------------ generated boards
@query("fem_straight_trace", "SELECT 'straight_trace' AS study, CAST(round(20e-3 / (5.8001e7 * 1e-3 * 35e-6) * 1e9) AS BIGINT) AS nano_ohm")
def fem_straight_trace(spark, d):
    """Resistance of a straight trace by mesh, assembly and solution; the check is L / (sigma w t)."""
    from ohmgrid.plans import boards, simulate

    found = simulate.solve(spark, boards.straight_trace(), 0.5e-3).resistance()
    return found.select("study", F.round(F.col("resistance_ohm") * 1e9).cast("long").alias("nano_ohm"))


@query("conservation_report", "SELECT 'ok' AS severity, CAST(1000 AS BIGINT) AS source_ma, CAST(1000 AS BIGINT) AS load_ma, true AS balanced")
def conservation_report(spark, d):
    """Current and power balance of a via stack under one ampere."""
    from ohmgrid.plans import boards, simulate

    c = simulate.solve(spark, boards.via_stack(3), 1e-3).conservation()
    balanced = (F.col("imbalance_fraction") < 1e-9) & (F.col("power_mismatch_fraction") < 1e-8)
    return c.select("severity", F.round(F.col("source_a") * 1000).cast("long").alias("source_ma"), F.round(F.col("load_a") * 1000).cast("long").alias("load_ma"), balanced.alias("balanced"))


@query("adaptive_history")
def adaptive_history(spark, d):
    """Passes of an adaptive run on two planes and a neck."""
    from ohmgrid.plans import boards, simulate

    return simulate.adapt(spark, boards.plane_neck_plane(), 1e-3, passes=3)


# Further queries register themselves.
from ohmgrid.plans import catalog_board, catalog_kernels, catalog_overlay, catalog_queue  # noqa: E402, F401
