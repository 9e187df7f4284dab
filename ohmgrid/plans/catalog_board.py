"""More queries of the registry: review, units, identifiers, studies, queue states and checks.

Each calls one operator of the library on whole tables; its SQL is written from
the operator's description, not from its code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions import quantities as Q
from ohmgrid.functions import units as U
from ohmgrid.operators import graph, jobs, mesh, review, spatial, study, validate, weighted
from ohmgrid.plans.catalog import area, query, table

# ------------------------------------------------------------------ a board out of the driver's tables
FUNCTIONS = ("signal", "plane", "mixed", "dielectric", "solder_mask")


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Nations are layers: layer_id, idx, function, thickness in micrometres, none for one of them."""
    names = F.array(*[F.lit(f) for f in FUNCTIONS])
    return table(spark, d, "nation").select(
        F.concat(F.lit("L"), F.col("n_nationkey")).alias("layer_id"), F.col("n_nationkey").alias("idx"), F.get(names, F.col("n_regionkey")).alias("function"),
        (F.col("n_regionkey") + 1.5).alias("thickness"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Lines are copper of their customer's net on the layer of their number."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("net_id"))
    items = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("L"), F.col("l_linenumber")).alias("layer_id"), area().cast("double").alias("area"))
    return items.join(orders, "l_orderkey").select("net_id", "layer_id", "area")


def vias(spark: SparkSession, d: str) -> DataFrame:
    """Orders are vias between two layers; every fifth has no known drill."""
    k = F.col("o_orderkey")
    layer = lambda n: F.concat(F.lit("L"), (n % 25).cast("string"))
    return table(spark, d, "orders").select(
        k.alias("pos"), F.col("o_custkey").alias("net_id"), layer(k).alias("from_layer"), layer(F.call_function("div", k, F.lit(7))).alias("to_layer"),
        F.when(k % 5 != 0, k % 4).alias("drill"), F.col("o_orderpriority").alias("padstack"),
    )


BOARD_SQL = """
    ly AS (SELECT 'L' || n_nationkey AS layer_id, n_nationkey AS idx, CASE n_regionkey WHEN 0 THEN 'signal' WHEN 1 THEN 'plane' WHEN 2 THEN 'mixed' WHEN 3 THEN 'dielectric' ELSE 'solder_mask' END AS function, n_regionkey + 1.5 AS thickness FROM nation),
    cu AS (SELECT o_custkey AS net_id, 'L' || l_linenumber AS layer_id, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS area FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    vi AS (SELECT o_orderkey AS pos, o_custkey AS net_id, 'L' || o_orderkey % 25 AS from_layer, 'L' || (o_orderkey // 7) % 25 AS to_layer, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS drill, o_orderpriority AS padstack FROM orders)"""


@query("board_net_summary", f"""
    WITH {BOARD_SQL},
    own AS (SELECT net_id, string_agg(layer_id, ',' ORDER BY idx) AS layers FROM (SELECT DISTINCT net_id, layer_id, idx FROM cu JOIN ly USING (layer_id)) GROUP BY 1),
    c AS (SELECT net_id, count(*) AS region_count, sum(area) AS area FROM cu JOIN ly USING (layer_id) GROUP BY 1),
    v AS (SELECT net_id, count(*) AS via_count FROM vi GROUP BY 1),
    t AS (SELECT p_partkey % 500 AS net_id, count(*) AS terminal_count FROM part GROUP BY 1)
    SELECT c_custkey AS net_id, c_name AS name, coalesce(layers, '') AS layers, coalesce(region_count, 0) AS region_count, coalesce(via_count, 0) AS via_count,
           coalesce(terminal_count, 0) AS terminal_count, coalesce(area, 0.0) AS area
    FROM customer LEFT JOIN own ON own.net_id = c_custkey LEFT JOIN c ON c.net_id = c_custkey LEFT JOIN v ON v.net_id = c_custkey LEFT JOIN t ON t.net_id = c_custkey""")
def board_net_summary(spark, d):
    nets = table(spark, d, "customer").select(F.col("c_custkey").alias("net_id"), F.col("c_name").alias("name"))
    terminals = table(spark, d, "part").select((F.col("p_partkey") % 500).alias("net_id"))
    return review.net_summary(nets, regions(spark, d), vias(spark, d), terminals, layers(spark, d)).withColumn("layers", F.array_join("layers", ","))


@query("board_via_groups", f"""
    WITH {BOARD_SQL} SELECT from_layer, to_layer, drill, count(*) AS n, CASE WHEN count(DISTINCT padstack) = 1 THEN min(padstack) END AS padstack, min(pos) AS first FROM vi GROUP BY 1, 2, 3""")
def board_via_groups(spark, d):
    return review.via_groups(vias(spark, d))


@query("board_layer_stats", f"""
    WITH {BOARD_SQL}, c AS (SELECT layer_id, count(*) AS regions, sum(area) AS area, count(DISTINCT net_id) AS nets FROM cu GROUP BY 1),
    f AS (SELECT 'L' || p_size % 25 AS layer_id, count(*) AS features FROM part GROUP BY 1),
    s AS (SELECT least(a.idx, b.idx) AS lo, greatest(a.idx, b.idx) AS hi FROM vi JOIN ly a ON a.layer_id = from_layer JOIN ly b ON b.layer_id = to_layer),
    v AS (SELECT idx, count(*) AS vias FROM s JOIN ly ON idx BETWEEN lo AND hi GROUP BY 1)
    SELECT ly.layer_id, idx, coalesce(features, 0) AS features, coalesce(regions, 0) AS regions, coalesce(area, 0.0) AS area, coalesce(nets, 0) AS nets, coalesce(vias, 0) AS vias
    FROM ly LEFT JOIN c USING (layer_id) LEFT JOIN f USING (layer_id) LEFT JOIN v USING (idx) WHERE function IN ('signal', 'plane', 'mixed')""")
def board_layer_stats(spark, d):
    features = table(spark, d, "part").select(F.concat(F.lit("L"), F.col("p_size") % 25).alias("layer_id"))
    return review.layer_stats(layers(spark, d), regions(spark, d), features, vias(spark, d))


@query("span_classes", f"""
    WITH {BOARD_SQL}, r AS (SELECT layer_id, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS row FROM ly WHERE function IN ('signal', 'plane', 'mixed'))
    SELECT least(a.row, b.row) AS from_row, greatest(a.row, b.row) AS to_row, count(*) AS n FROM vi JOIN r a ON a.layer_id = from_layer JOIN r b ON b.layer_id = to_layer GROUP BY 1, 2""")
def span_classes(spark, d):
    return review.span_classes(vias(spark, d), layers(spark, d))


@query("span_kind", f"""
    WITH {BOARD_SQL}, o AS (SELECT arg_min(layer_id, idx) AS t, arg_max(layer_id, idx) AS b FROM ly WHERE function IN ('signal', 'plane', 'mixed'))
    SELECT pos, CASE CAST(from_layer IN (t, b) AS INTEGER) + CAST(to_layer IN (t, b) AS INTEGER) WHEN 2 THEN 'through' WHEN 1 THEN 'blind' ELSE 'buried' END AS kind FROM vi, o""")
def span_kind(spark, d):
    return review.span_kind(vias(spark, d), layers(spark, d)).select("pos", "kind")


@query("layer_midplanes", f"WITH {BOARD_SQL} SELECT layer_id, sum(thickness) OVER (ORDER BY idx) - thickness / 2 AS z_mid FROM ly")
def layer_midplanes(spark, d):
    return review.layer_midplanes(layers(spark, d), [], "idx", "thickness").select("layer_id", F.col("z_mid").cast("double").alias("z_mid"))


@query("real_net", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END AS net FROM orders")
def real_net(spark, d):
    """Placeholder names are no nets: a blank one, and the usual words in any case."""
    name = F.when(F.col("o_orderkey") % 3 == 0, "  ").when(F.col("o_orderkey") % 3 == 1, "No NET").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", review.real_net(name).alias("net"))


@query("board_diagnostics", """
    WITH x AS (SELECT 'negative_balance' AS code, c_custkey AS pos, c_name AS subject FROM customer WHERE c_acctbal < 0
               UNION ALL SELECT 'supplier_negative', s_suppkey, s_name FROM supplier WHERE s_acctbal < 0
               UNION ALL SELECT 'small_part', p_partkey, p_name FROM part WHERE p_size <= 2)
    SELECT code, count(*) AS n, arg_min(subject, pos) AS first FROM x GROUP BY 1""")
def board_diagnostics(spark, d):
    return review.diagnostics({
        "negative_balance": table(spark, d, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS pos", "c_name AS subject"),
        "supplier_negative": table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey AS pos", "s_name AS subject"),
        "small_part": table(spark, d, "part").where("p_size <= 2").selectExpr("p_partkey AS pos", "p_name AS subject"),
    })


@query("net_list_filtered", "SELECT c_custkey AS net_id, c_name AS name FROM customer WHERE contains(lower(c_name), 'er#00000001')")
def net_list_filtered(spark, d):
    nets = table(spark, d, "customer").select(F.col("c_custkey").alias("net_id"), F.col("c_name").alias("name"))
    return review.matching(nets, "name", "ER#00000001")


@query("terminals_by_component", """
    SELECT coalesce(s_name, 'component ' || (p_partkey % 60)) AS component, string_agg(p_name || '.' || p_partkey, ',' ORDER BY p_name || '.' || p_partkey) AS terminals, count(*) AS n
    FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 60 AND s_suppkey % 2 = 0 WHERE contains(lower(p_name), 'ring') GROUP BY 1""")
def terminals_by_component(spark, d):
    """A component's terminals are one row of a list, as many as it has pins."""
    terminals = table(spark, d, "part").select(F.concat_ws(".", "p_name", "p_partkey").alias("name"), (F.col("p_partkey") % 60).alias("component_id"))
    components = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("component_id"), F.col("s_name").alias("refdes"))
    found = review.terminals_by_component(review.matching(terminals, "name", "RING"), components)
    return found.select("component", F.array_join("terminals", ",").alias("terminals"), "n")


@query("board_list", "SELECT o_orderkey AS board_id, o_orderdate AS stored_at, CASE WHEN o_totalprice > 100000 THEN 'READY' ELSE 'NOT_READY' END AS readiness FROM orders")
def board_list(spark, d):
    boards = table(spark, d, "orders").select(F.col("o_orderkey").alias("board_id"), F.col("o_orderdate").alias("stored_at"), (F.col("o_totalprice") > 100000).cast("int").alias("regions"))
    return review.board_list(boards, [F.col("regions")]).select("board_id", "stored_at", "readiness")


@query("reference_voltage", "SELECT l_linenumber AS layer, max(l_extendedprice) FILTER (WHERE l_quantity > 1) AS reference FROM lineitem GROUP BY 1")
def reference_voltage(spark, d):
    """The largest finite potential; undriven copper has none, or one that is no number."""
    v = F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).when(F.col("l_linenumber") % 2 == 0, float("nan")).otherwise(float("inf"))
    return weighted.reference_voltage(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"), v.alias("voltage")), ["layer"], "voltage")


# ------------------------------------------------------------------ units and materials
@query("unit_conversions", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 1000, 6) AS mm, round(l_quantity * 1e6, 3) AS um, round(l_quantity / 25.4e-6, 3) AS mil, round(l_quantity / 34.8e-6, 3) AS oz,
           l_quantity + 273.15 AS kelvin, l_quantity - 273.15 AS celsius, round(l_extendedprice * 1e-6, 9) AS a_mm2, round(1 / l_quantity, 9) AS resistivity FROM lineitem""")
def unit_conversions(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(U.millimetres(q), 6).alias("mm"), F.round(U.micrometres(q), 3).alias("um"), F.round(U.mils(q), 3).alias("mil"), F.round(U.ounces(q), 3).alias("oz"),
        U.celsius_to_kelvin(q).alias("kelvin"), U.kelvin_to_celsius(q).alias("celsius"), F.round(U.amps_per_mm2(p), 9).alias("a_mm2"), F.round(U.resistivity(q), 9).alias("resistivity"),
    )


@query("conductivity_at_temperature", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE l_extendedprice / (1 + l_tax / 10 * (l_quantity + 293.15 - 293.15)) END, 6) AS sigma,
           round(l_extendedprice * l_quantity, 4) AS sheet FROM lineitem""")
def conductivity_at_temperature(spark, d):
    tcr = F.when(F.col("l_returnflag") != "A", F.col("l_tax") / 10)
    sigma = U.conductivity_at(F.col("l_extendedprice"), tcr, F.lit(293.15), F.col("l_quantity") + 293.15)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(sigma, 6).alias("sigma"), F.round(U.sheet_conductance(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("sheet")
    )


@query("barrel_sections", """
    WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS finished, CASE WHEN l_linenumber % 3 <> 1 THEN l_quantity / 4 END AS drill,
                      CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag = 'N' THEN 2.0 END AS own FROM lineitem),
    t AS (SELECT *, coalesce(own, 1.5) AS t FROM b),
    i AS (SELECT *, coalesce(finished / 2, drill / 2 - t) AS inner_r FROM t),
    s AS (SELECT *, finished IS NULL AND inner_r <= 0 AS solid FROM i)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN solid THEN drill / 2 ELSE inner_r + t END, 9) AS radius,
           round(pi() * CASE WHEN solid THEN drill / 2 * drill / 2 ELSE (inner_r + t) * (inner_r + t) - inner_r * inner_r END, 6) AS area, own IS NULL AS assumed FROM s""")
def barrel_sections(spark, d):
    finished = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    drill = F.when(F.col("l_linenumber") % 3 != 1, F.col("l_quantity") / 4)
    own = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0)
    made = table(spark, d, "lineitem").withColumn("b", U.barrel(finished, drill, own, F.lit(1.5)))
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("b.radius", 9).alias("radius"), F.round("b.area", 6).alias("area"), "b.assumed")


@query("annulus_area", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pi() * (l_quantity / 2 + 1) * (l_quantity / 2 + 1) - pi() * l_quantity * l_quantity / 4, 6) AS area FROM lineitem")
def annulus_area(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(U.barrel_area(F.col("l_quantity"), F.lit(1.0)), 6).alias("area"))


@query("engineering_formats", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN printf('%d B', p_size) WHEN p_partkey % 3 = 1 THEN printf('%.1f KiB', p_size * 1024 / 1024.0) ELSE printf('%.1f MiB', p_size * 1048576 / 1048576.0) END AS bytes,
           CASE WHEN p_partkey % 2 = 0 THEN printf('%.3f kA', CAST(p_size AS DOUBLE)) ELSE printf('%.3f mA', CAST(p_size AS DOUBLE)) END AS amps FROM part""")
def engineering_formats(spark, d):
    """Values of known size, so that the prefix is plain: up to 50 of a unit each."""
    k, n = F.col("p_partkey"), F.col("p_size")
    size = n * F.when(k % 3 == 0, F.lit(1)).when(k % 3 == 1, F.lit(1024)).otherwise(F.lit(1048576))
    amps = n * F.when(k % 2 == 0, F.lit(1000.0)).otherwise(F.lit(0.001))
    return table(spark, d, "part").select("p_partkey", U.format_bytes(size).alias("bytes"), U.format_engineering(amps, "A").alias("amps"))


# ------------------------------------------------------------------ identifiers and quantities
FAMILIES = "CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN split_part(p_name, ' ', 2) || ' 2' WHEN 2 THEN upper(split_part(p_name, ' ', 2)) WHEN 3 THEN '  ** ' ELSE split_part(p_name, ' ', 2) || '-3' END"


@query("slug_families", f"""
    WITH RECURSIVE b AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim({FAMILIES})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part WHERE p_partkey < 300),
    n AS (SELECT p_partkey, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS s, row_number() OVER (ORDER BY p_partkey) AS i FROM b),
    r(i, p_partkey, slug, used) AS (
      SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', CAST([] AS VARCHAR[])
      UNION ALL SELECT x.i, x.p_partkey, x.slug, list_append(x.used, x.slug) FROM (
        SELECT n.i, n.p_partkey, r.used, list_filter(list_transform(range(1, len(r.used) + 2), lambda k: CASE WHEN k = 1 THEN n.s ELSE n.s || '-' || k END), lambda c: NOT list_contains(r.used, c))[1] AS slug
        FROM r JOIN n ON n.i = r.i + 1) x)
    SELECT p_partkey, slug FROM r WHERE i > 0""")
def slug_families(spark, d):
    """Names that end in numbers can take the suffix of others; the first three hundred parts are a board of their own, as every board numbers its names by itself."""
    second = F.split("p_name", " ")[1]
    name = F.when(F.col("p_partkey") % 5 == 0, second).when(F.col("p_partkey") % 5 == 1, F.concat(second, F.lit(" 2"))).when(F.col("p_partkey") % 5 == 2, F.upper(second)).when(F.col("p_partkey") % 5 == 3, "  ** ").otherwise(F.concat(second, F.lit("-3")))
    named = table(spark, d, "part").withColumns({"own": name, "board": F.call_function("div", F.col("p_partkey"), F.lit(300))})
    found = Q.unique_slugs(named.select("p_partkey", "own", "board"), "own", ["p_partkey"], within=["board"])
    return found.where("board = 0").select("p_partkey", "slug")


@query("upload_labels", r"""
    WITH c AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM pages)
    SELECT page_id, substr(CASE WHEN s = '' THEN 'unnamed' ELSE s END, 1, 48) AS label FROM c""")
def upload_labels(spark, d):
    return table(spark, d, "pages").select("page_id", Q.safe_label(F.col("url")).alias("label"))


@query("log_redaction", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '***redacted***' ELSE event_type END AS secret, event_type AS plain FROM events")
def log_redaction(spark, d):
    key = F.when(F.col("event_type") == "click", "API_Key_2").when(F.col("event_type") == "view", "userPassword").otherwise("apikey")
    rows = table(spark, d, "events").select("event_id", "event_type", key.alias("k"), Q.redacted(F.create_map(key, F.col("event_type"), F.lit("stage"), F.col("event_type"))).alias("m"))
    return rows.select("event_id", F.element_at("m", F.col("k")).alias("secret"), F.element_at("m", F.lit("stage")).alias("plain"))


@query("job_ids", r"""
    SELECT o_orderkey, 'job-' || substr(sha256(o_custkey || ':' || o_totalprice), 1, 16) AS job_id, true AS valid, o_orderkey % 2 = 0 AS other_valid FROM orders""")
def job_ids(spark, d):
    made = Q.job_id(F.col("o_custkey").cast("string"), F.col("o_totalprice"))
    other = F.when(F.col("o_orderkey") % 2 == 0, F.lit("job-0123456789abcdef")).otherwise(F.lit("../job-0123456789abcdef"))
    return table(spark, d, "orders").select("o_orderkey", made.alias("job_id"), Q.valid_job_id(made).alias("valid"), Q.valid_job_id(other).alias("other_valid"))


@query("quantity_faults", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'not finite' WHEN l_linenumber = 2 THEN 'unknown provenance' WHEN l_linenumber = 3 AND l_returnflag <> 'A' THEN 'assumed without a note' END AS fault,
           l_linenumber = 3 AS assumed, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS in_metres FROM lineitem""")
def quantity_faults(spark, d):
    source = F.when(F.col("l_linenumber") == 2, "guessed").when(F.col("l_linenumber") == 3, "assumed").otherwise("imported")
    q = Q.quantity(F.when(F.col("l_linenumber") != 1, F.col("l_quantity")), "m", source, F.when(F.col("l_returnflag") == "A", "default"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Q.quantity_fault(q).alias("fault"), Q.is_assumed(q).alias("assumed"), Q.in_unit(q, "m").alias("in_metres"))


# ------------------------------------------------------------------ studies
def specs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as job specs: even ones in the newer schema, odd ones in the older, every third a resistance."""
    k = F.col("o_orderkey")
    ids = lambda tag: F.array(F.concat(F.lit(tag), (k % 7).cast("string")), F.concat(F.lit(tag), (k % 3).cast("string")))
    shared = [F.when(k % 3 == 0, "resistance").otherwise("ir_drop").alias("kind"), F.lit("b").alias("board_id"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("net_id"), F.lit("standard").alias("accuracy"), F.lit(1.5).alias("source_voltage_v")]
    load = F.array(F.struct(ids("l").alias("terminal_ids"), (k % 11 + 0.5).alias("current_a")), F.struct(F.array(F.lit("x")).alias("terminal_ids"), F.lit(0.25).alias("current_a")))
    old_load = F.array(F.struct(F.concat(F.lit("l"), (k % 7).cast("string")).alias("terminal_id"), (k % 11 + 0.5).alias("current_a")))
    newer = F.to_json(F.struct(*shared, ids("s").alias("source_terminal_ids"), ids("t").alias("to_terminal_ids"), load.alias("loads")))
    older = F.to_json(F.struct(*shared, F.concat(F.lit("s"), (k % 7).cast("string")).alias("source_terminal_id"), old_load.alias("loads")))
    return table(spark, d, "orders").select(k.alias("job"), F.when(k % 2 == 0, newer).otherwise(older).alias("spec_json"))


@query("specs_decoded", """
    SELECT o_orderkey AS job, CASE WHEN o_orderkey % 3 = 0 THEN 'resistance' ELSE 'ir_drop' END AS kind,
           CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey % 7 || ',s' || o_orderkey % 3 ELSE 's' || o_orderkey % 7 END AS sources,
           CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey % 7 || ',t' || o_orderkey % 3 ELSE '' END AS far,
           CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_loads,
           CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 11 + 0.75 ELSE o_orderkey % 11 + 0.5 END AS DOUBLE) AS total,
           CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey % 7 ELSE '' END ELSE 'l' || o_orderkey % 7 END AS first_load FROM orders""")
def specs_decoded(spark, d):
    s = F.col("spec")
    loads = study.unit_load(s)
    return study.decode_specs(specs(spark, d)).select(
        "job", "spec.kind", F.array_join(s["source_terminal_ids"], ",").alias("sources"), F.array_join(s["to_terminal_ids"], ",").alias("far"), F.size(loads).alias("n_loads"),
        study.total_load(s).alias("total"), F.coalesce(F.get(F.get(loads, F.lit(0))["terminal_ids"], F.lit(0)), F.lit("")).alias("first_load"),
    )


@query("specs_encoded_again", "SELECT o_orderkey AS job, true AS same FROM orders")
def specs_encoded_again(spark, d):
    """What is decoded, encoded and decoded again is what it was."""
    once = study.decode_specs(specs(spark, d))
    again = study.decode_specs(study.encode_specs(once).select("job", F.col("spec").alias("before"), "spec_json"))
    return again.select("job", (F.col("spec") == F.col("before")).alias("same"))


@query("study_signature", """
    WITH s AS (SELECT o_orderkey AS job, least('s' || o_orderkey % 7, 's' || o_orderkey % 3) AS a, greatest('s' || o_orderkey % 7, 's' || o_orderkey % 3) AS b,
                      least('l' || o_orderkey % 7, 'l' || o_orderkey % 3) AS la, greatest('l' || o_orderkey % 7, 'l' || o_orderkey % 3) AS lb,
                      least('t' || o_orderkey % 7, 't' || o_orderkey % 3) AS ta, greatest('t' || o_orderkey % 7, 't' || o_orderkey % 3) AS tb, o_orderkey % 11 AS k, o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
    SELECT job, sha256('{"board":"d1","kind":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'resistance' ELSE 'ir_drop' END || '","net":"n' || o_custkey || '","source":["' || a || '","' || b || '"],"volt":1.5,"to":["' || ta || '","' || tb
           || '"],"loads":[{"ids":["' || la || '","' || lb || '"],"a":' || k || '.5},{"ids":["x"],"a":0.25}],"accuracy":"standard","solver":"fem"}') AS signature FROM s""")
def study_signature(spark, d):
    """Signatures of the newer specs; members are sorted before they are hashed."""
    newer = study.decode_specs(specs(spark, d)).where("job % 2 = 0")
    return newer.select("job", study.signature(F.lit("d1"), F.col("spec"), "fem").alias("signature"))


@query("study_connectivity", """
    WITH l AS (SELECT DISTINCT l_linenumber AS study, l_partkey % 400 AS a, 1000 + l_suppkey % 50 AS b FROM lineitem WHERE l_partkey % 400 < 100),
    c AS (SELECT study, b, a FROM l), first AS (SELECT study, 0 AS node FROM (SELECT DISTINCT l_linenumber AS study FROM lineitem)),
    t AS (SELECT s.study, k AS pos, 't' || k AS terminal, CASE WHEN k % 10 <> 9 THEN k * 7 END AS node FROM first s, range(20) g(k))
    SELECT t.study, t.terminal, 't0' AS first FROM t WHERE t.node IS NULL OR t.node > 99""")
def study_connectivity(spark, d):
    """Nodes below 100 of every study are linked through fifty hubs; terminals beyond them, or without a node, do not reach the first one."""
    items = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("study"), (F.col("l_partkey") % 400).alias("a"), "l_suppkey")
    chain = items.where("a < 100").select("study", "a", (F.lit(1000) + F.col("l_suppkey") % 50).alias("b"))
    ring = items.select("study").distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(98)))).select("study", F.col("a").cast("long").alias("a"), (F.col("a") + 1).cast("long").alias("b"))
    ends = items.select("study").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    terminals = ends.select("study", F.concat(F.lit("t"), F.col("k")).alias("terminal"), F.col("k").alias("pos"), F.when(F.col("k") % 10 != 9, F.col("k").cast("long") * 7).alias("node"))
    return study.disconnected(chain.unionByName(ring), terminals)


@query("terminal_results", """
    WITH s AS (SELECT o_orderkey % 20 AS study, o_orderkey AS pos, o_custkey % 50 AS dof, o_totalprice AS voltage FROM orders WHERE o_orderstatus = 'P'),
    l AS (SELECT o_orderkey % 20 AS study, o_orderkey AS pos, o_custkey AS dof, o_totalprice AS voltage, o_orderkey % 9 AS current FROM orders WHERE o_orderstatus = 'F'),
    d AS (SELECT study, dof, min(pos) AS pos, max(voltage) AS voltage, sum(current) AS current FROM l GROUP BY 1, 2)
    SELECT study, 't' || pos AS terminal, dof, voltage, CAST(1 AS DOUBLE) AS current FROM s
    UNION ALL SELECT study, 't' || pos, dof, voltage, CAST(current AS DOUBLE) FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.study = d.study AND s.dof = d.dof)""")
def terminal_results(spark, d):
    o = table(spark, d, "orders")
    cols = lambda dof, current: [(F.col("o_orderkey") % 20).alias("study"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("terminal"), dof.alias("dof"), F.col("o_totalprice").alias("voltage"), current.cast("double").alias("current"), F.col("o_orderkey").alias("pos")]
    sources = o.where("o_orderstatus = 'P'").select(*cols(F.col("o_custkey") % 50, F.lit(1)))
    loads = o.where("o_orderstatus = 'F'").select(*cols(F.col("o_custkey"), F.col("o_orderkey") % 9))
    return study.terminal_results(sources, loads)


@query("echo_solver", """
    SELECT o_orderkey % 20 AS study, 't' || o_orderkey AS terminal, o_totalprice AS voltage, CAST(0 AS DOUBLE) AS current FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey % 20, 'u' || o_custkey, NULL, CAST(sum(o_orderkey % 9) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def echo_solver(spark, d):
    o = table(spark, d, "orders")
    sources = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 20).alias("study"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("terminal"), F.col("o_totalprice").alias("voltage"))
    loads = o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 20).alias("study"), F.concat(F.lit("u"), F.col("o_custkey")).alias("terminal"), (F.col("o_orderkey") % 9).cast("double").alias("current"))
    return study.echo_solver(sources, loads)


@query("hit_test", """
    WITH h AS (SELECT l_orderkey AS p, l_partkey AS region, l_linenumber AS layer, l_suppkey * 100000 + l_partkey AS drawn FROM lineitem WHERE l_linenumber % 3 <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY layer DESC, drawn DESC, region) AS k FROM h)
    SELECT o_orderkey AS p, region FROM orders LEFT JOIN k ON k.p = o_orderkey AND k = 1""")
def hit_test(spark, d):
    """The lower the number the deeper the layer; every third is hidden."""
    inside = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_partkey").alias("region"), F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("drawn"))
    ranks = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer"), (-F.col("n_nationkey")).alias("rank"), (F.col("n_nationkey") % 3 != 0).alias("visible"))
    return study.hit(table(spark, d, "orders").select(F.col("o_orderkey").alias("p")), inside, ranks)


@query("cutout_assignment", "SELECT c_custkey AS cutout, coalesce(min(o_orderkey), 0) AS outline FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def cutout_assignment(spark, d):
    cutouts = table(spark, d, "customer").select(F.col("c_custkey").alias("cutout"))
    inside = table(spark, d, "orders").select(F.col("o_custkey").alias("cutout"), F.col("o_orderkey").alias("outline"))
    return study.assign_cutouts(cutouts, inside, inside)


@query("resolved_nets", """
    WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE c_mktsegment END AS asked, o_custkey % 5 AS studied FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS name, c_custkey FROM customer WHERE c_custkey < 300),
    m AS (SELECT o_orderkey, id, row_number() OVER (PARTITION BY o_orderkey ORDER BY (c_custkey <> studied), (id <> asked), id) AS k FROM a JOIN n ON n.id = a.asked OR n.name = a.asked)
    SELECT a.o_orderkey, m.id FROM a LEFT JOIN m ON m.o_orderkey = a.o_orderkey AND k = 1""")
def resolved_nets(spark, d):
    """Nets asked for by id or by name; the studied one wins, then an id, then the smallest."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    asked = table(spark, d, "orders").join(customers, "o_custkey").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("c_mktsegment")).alias("asked"), (F.col("o_custkey") % 5).cast("string").alias("studied")
    )
    nets = table(spark, d, "customer").where("c_custkey < 300").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("name"))
    return study.resolve(asked, nets, "o_orderkey")


@query("policy_overrides", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 0.5 ELSE CASE o_orderkey % 3 WHEN 0 THEN 1e-2 WHEN 1 THEN 1e-3 ELSE 3e-4 END END AS target,
           CASE WHEN o_orderkey % 5 = 1 THEN 3 ELSE CASE o_orderkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 16 END END AS passes,
           CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS confirmations FROM orders""")
def policy_overrides(spark, d):
    """An explicit field beats the tier's."""
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(
        "o_orderkey", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int")).alias("tier"), F.when(k % 4 == 1, 0.5).alias("target"), F.when(k % 5 == 1, 3).alias("passes")
    )
    return study.with_policy(asked).select("o_orderkey", "target", "passes", "confirmations")


@query("draft_members", """
    SELECT o_orderkey AS job, CASE WHEN o_orderkey % 2 = 0 THEN list_distinct(['s' || o_orderkey % 7, 's' || o_orderkey % 3, 't' || o_orderkey % 7, 't' || o_orderkey % 3, 'l' || o_orderkey % 7, 'l' || o_orderkey % 3, 'x']).len()
                                   ELSE list_distinct(['s' || o_orderkey % 7, 'l' || o_orderkey % 7]).len() END AS n FROM orders""")
def draft_members(spark, d):
    return study.decode_specs(specs(spark, d)).select("job", F.size(study.members(F.col("spec"))).cast("long").alias("n"))


@query("inspection_report", f"""
    WITH {BOARD_SQL} SELECT idx, printf('%-4s %-12s %6.1f um', layer_id, function, thickness) AS line FROM ly""")
def inspection_report(spark, d):
    return review.report_lines(layers(spark, d)).select("idx", "line")


@query("convergence_document", """
    SELECT user_id AS job, count(*) AS passes, true AS ordered FROM events GROUP BY 1""")
def convergence_document(spark, d):
    """One JSON document a run, its passes in order; the passes of a run are few."""
    history = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("index"), F.col("value").alias("resistance_ohm"))
    documents = study.convergence_document(history, ["job"], "index")
    passes = F.from_json("document", "struct<passes:array<struct<index:long>>>")["passes"]
    along = F.transform(passes, lambda p: p["index"])
    return documents.select("job", F.size(passes).cast("long").alias("passes"), (F.array_sort(along) == along).alias("ordered"))


# ------------------------------------------------------------------ checks
@query("unknown_references", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def unknown_references(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return validate.unknown(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", known, "c_custkey").select("o_orderkey")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return validate.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("disordered_stackups", """
    WITH p AS (SELECT o_custkey AS board, o_orderkey % 1000 AS idx, lag(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
    SELECT board, idx FROM p WHERE idx <= before""")
def disordered_stackups(spark, d):
    stack = table(spark, d, "orders").select(F.col("o_custkey").alias("board"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 1000).alias("idx"))
    return validate.disordered(stack, ["board"], "idx")


@query("role_overlap", "SELECT DISTINCT l_partkey AS member, l_suppkey AS board FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def role_overlap(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("board"), "l_returnflag", "l_linestatus")
    return validate.overlaps(items.where("l_returnflag = 'R'"), items.where("l_linestatus = 'O'"), ["member", "board"])


@query("draft_faults", """
    SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'no source' WHEN 1 THEN 'voltage is not finite' WHEN 2 THEN 'an IR drop needs a load' WHEN 3 THEN 'a resistance has no loads' WHEN 4 THEN 'a resistance needs a far end'
        WHEN 5 THEN 'current is not positive' WHEN 6 THEN 'source and load overlap' WHEN 7 THEN 'a load is named twice' WHEN 8 THEN 'a policy needs the reference profile' WHEN 9 THEN 'the reference profile needs a policy'
        WHEN 10 THEN 'too many passes' WHEN 11 THEN 'target is out of bounds' END AS fault FROM orders""")
def draft_faults(spark, d):
    """Drafts with one fault each, and one kind without any."""
    k = (F.col("o_orderkey") % 13).cast("int")
    none, pad = F.array().cast("array<string>"), lambda *ids: F.array(*[F.lit(i) for i in ids])
    resistance = k.isin(3, 4)
    one = lambda ids, amps: F.array(F.struct(ids.alias("ids"), amps.alias("current")))
    load_ids = F.when(k == 6, pad("a", "c")).when(k == 7, pad("b", "b")).otherwise(pad("b"))
    amps = F.when(k == 5, F.lit(-1.0)).otherwise(F.lit(1.0))
    policy = F.struct(F.when(k == 10, 900).otherwise(6).alias("passes"), F.lit(1000).alias("dofs"), F.when(k == 11, 0.9).otherwise(0.01).alias("target"))
    drafts = table(spark, d, "orders").select(
        "o_orderkey", F.when(resistance, "resistance").otherwise("ir_drop").alias("kind"), F.when(k.isin(9, 10, 11), "reference").otherwise("standard").alias("accuracy"), F.when(k == 0, none).otherwise(pad("a")).alias("source_ids"),
        F.when(k == 3, pad("z")).otherwise(none).alias("to_ids"), F.when((k == 2) | (k == 4), one(none, F.lit(1.0))).otherwise(one(load_ids, amps)).alias("loads"),
        F.when(k == 1, float("nan")).otherwise(1.0).alias("voltage"), F.when(k.isin(8, 10, 11), policy).alias("policy"),
    )
    return validate.draft_faults(drafts, {"passes": 20, "dofs": 8_000_000}).select("o_orderkey", "fault")


@query("terminal_conservation", """
    WITH s AS (SELECT CAST(sum(l_quantity) AS DOUBLE) AS a, sum(l_quantity * l_linenumber) AS w FROM lineitem WHERE l_returnflag = 'A'),
    l AS (SELECT sum(l_quantity) AS a, sum(l_quantity * 2) AS w FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT CAST(sum(l_linenumber) AS DOUBLE) AS w FROM lineitem WHERE l_returnflag = 'N')
    SELECT s.a AS source_a, l.a AS load_a, s.w - l.w AS terminal_w, p.w AS dissipated_w, round(abs(s.a - l.a) / greatest(s.a, l.a), 9) AS imbalance,
           round(abs(s.w - l.w - p.w) / greatest(abs(s.w - l.w), p.w), 9) AS mismatch, 'error' AS severity FROM s, l, p""")
def terminal_conservation(spark, d):
    items = table(spark, d, "lineitem")
    pick = lambda flag, volts: items.where(F.col("l_returnflag") == flag).select(volts.cast("double").alias("voltage"), F.col("l_quantity").alias("current"))
    power = items.where("l_returnflag = 'N'").select(F.col("l_linenumber").cast("double").alias("power"))
    found = weighted.conservation(pick("A", F.col("l_linenumber")), pick("R", F.lit(2)), power)
    return found.select("source_a", "load_a", "terminal_w", "dissipated_w", F.round("imbalance_fraction", 9).alias("imbalance"), F.round("power_mismatch_fraction", 9).alias("mismatch"), "severity")


# ------------------------------------------------------------------ queue states
def job_table(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in ("QUEUED", "CLAIMED", "RUNNING", "CANCELLING", "COMPLETED")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), state.alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("queued_at"), (F.col("o_orderkey") % 3).cast("int").alias("attempt"),
        F.when(F.col("o_orderkey") % 5 > 0, "w1").alias("claimed_by"), F.lit(100.0).alias("lease_expires_at"), F.col("o_custkey").alias("signature"),
    )


STATES_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'CLAIMED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'CANCELLING' ELSE 'COMPLETED' END"


@query("transitions_allowed", """
    WITH t(a, b) AS (VALUES ('QUEUED', 'CLAIMED'), ('QUEUED', 'CANCELLING'), ('QUEUED', 'CANCELLED'), ('CLAIMED', 'RUNNING'), ('CLAIMED', 'QUEUED'), ('CLAIMED', 'FAILED'), ('CLAIMED', 'CANCELLING'),
        ('RUNNING', 'COMPLETED'), ('RUNNING', 'COMPLETED_WITH_WARNINGS'), ('RUNNING', 'FAILED'), ('RUNNING', 'CANCELLING'), ('RUNNING', 'QUEUED'), ('CANCELLING', 'CANCELLED'), ('CANCELLING', 'FAILED')),
    s(x) AS (VALUES ('QUEUED'), ('CLAIMED'), ('RUNNING'), ('COMPLETED'), ('COMPLETED_WITH_WARNINGS'), ('FAILED'), ('CANCELLING'), ('CANCELLED')),
    n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k FROM s)
    SELECT o_orderkey, EXISTS (SELECT 1 FROM t WHERE a = f.x AND b = g.x) AS allowed, CASE WHEN EXISTS (SELECT 1 FROM t WHERE a = f.x AND b = g.x) THEN g.x ELSE f.x END AS state
    FROM orders JOIN n f ON f.k = o_orderkey % 8 JOIN n g ON g.k = o_custkey % 8""")
def transitions_allowed(spark, d):
    """Every pair of states; an illegal step changes nothing."""
    names = F.array(*[F.lit(s) for s in ("CANCELLED", "CANCELLING", "CLAIMED", "COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "QUEUED", "RUNNING")])
    state, to = F.get(names, (F.col("o_orderkey") % 8).cast("int")), F.get(names, (F.col("o_custkey") % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(jobs.allowed(state, to), F.lit(False)).alias("allowed"), jobs.after(state, to).alias("state"))


@query("cancelled_jobs", f"SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'CANCELLING' WHEN 2 THEN 'CANCELLING' ELSE {STATES_SQL} END AS state FROM orders")
def cancelled_jobs(spark, d):
    return job_table(spark, d).select("job_id", jobs.cancel(F.col("state")).alias("state"))


@query("claimed_job", f"""
    WITH q AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1)
    SELECT o_orderkey AS job_id, CASE WHEN o_orderkey IN (FROM q) THEN 'CLAIMED' ELSE {STATES_SQL} END AS state, CAST(o_orderkey % 3 + CASE WHEN o_orderkey IN (FROM q) THEN 1 ELSE 0 END AS INTEGER) AS attempt,
           CASE WHEN o_orderkey IN (FROM q) THEN 'w9' WHEN o_orderkey % 5 > 0 THEN 'w1' END AS claimed_by, CAST(CASE WHEN o_orderkey IN (FROM q) THEN 160 ELSE 100 END AS DOUBLE) AS lease_expires_at FROM orders""")
def claimed_job(spark, d):
    return jobs.claim(job_table(spark, d), "w9", 100.0, 60.0).select("job_id", "state", "attempt", "claimed_by", F.col("lease_expires_at").cast("double").alias("lease_expires_at"))


@query("released_and_renewed", f"""
    SELECT o_orderkey AS job_id, CASE WHEN o_orderkey = 6 THEN 'QUEUED' ELSE {STATES_SQL} END AS state, CAST(o_orderkey % 3 - CASE WHEN o_orderkey = 6 THEN 1 ELSE 0 END AS INTEGER) AS attempt,
           CAST(CASE WHEN o_orderkey = 6 THEN NULL WHEN o_orderkey = 12 THEN 500 ELSE 100 END AS DOUBLE) AS lease_expires_at FROM orders""")
def released_and_renewed(spark, d):
    """A release of a claimed job, a renewal by its holder, and one by another worker that changes nothing."""
    out = jobs.release(job_table(spark, d), 6)
    out = jobs.renew(jobs.renew(out, 12, "w1", 500.0), 7, "w2", 900.0)
    return out.select("job_id", "state", "attempt", F.col("lease_expires_at").cast("double").alias("lease_expires_at"))


@query("queued_once", """
    WITH busy AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 < 4),
    new AS (SELECT p_partkey AS job_id, p_partkey % 3000 AS signature, row_number() OVER (PARTITION BY p_partkey % 3000 ORDER BY p_partkey) AS k FROM part)
    SELECT count(*) AS n_new, CAST(sum(job_id) AS BIGINT) AS ids FROM new WHERE k = 1 AND signature NOT IN (FROM busy)""")
def queued_once(spark, d):
    """New jobs whose signature no active job has, the first of equal ones."""
    old = job_table(spark, d)
    new = table(spark, d, "part").select(
        F.col("p_partkey").alias("job_id"), F.lit("QUEUED").alias("state"), F.lit("a").alias("priority"), F.lit("2024-01-01").cast("timestamp").alias("queued_at"), F.lit(0).alias("attempt"),
        F.lit(None).cast("string").alias("claimed_by"), F.lit(None).cast("double").alias("lease_expires_at"), (F.col("p_partkey") % 3000).alias("signature"),
    )
    added = jobs.queue_jobs(old, new).where("priority = 'a'")
    return added.agg(F.count(F.lit(1)).alias("n_new"), F.sum("job_id").alias("ids"))


@query("priorities_and_qualities", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS priority,
           CASE o_orderkey % 6 WHEN 0 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'FAILED' ELSE 'COMPLETED_WITH_WARNINGS' END AS state FROM orders""")
def priorities_and_qualities(spark, d):
    k = F.col("o_orderkey")
    profile = F.get(F.array(*[F.lit(p) for p in ("preview", "standard", "high", "verification", "reference")]), (k % 5).cast("int"))
    quality = F.get(F.array(*[F.lit(q) for q in ("CONVERGED", "CONVERGED_WITH_MODEL_LIMITATIONS", "RESOURCE_LIMITED", "NOT_CONVERGED", "NUMERICAL_FAILURE", "unheard of")]), (k % 6).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", jobs.priority_of(profile).alias("priority"), jobs.state_of_quality(quality).alias("state"))


# ------------------------------------------------------------------ graphs, sizing
@query("same_component", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 10 = l_suppkey % 10 AS connected FROM lineitem""")
def same_component(spark, d):
    """Numbers of one last digit are chained; a pair is connected if both ends have it."""
    chain = spark.range(10_000).select(F.col("id").alias("u"), (F.col("id") + 10).alias("v"))
    parts = graph.connected_components(chain)
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 10_000).alias("a"), (F.col("l_suppkey") % 10_000).alias("b"))
    return graph.same_component(parts, pairs, "a", "b").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "connected")


@query("default_sizing", """
    SELECT p_partkey, round(sqrt(CAST(p_size AS DOUBLE) * p_size + 1600) / 80, 9) AS max_element, round(sqrt(CAST(p_size AS DOUBLE) * p_size + 1600) / 8000, 9) AS min_element, 4 AS across, CAST(0.7 AS DOUBLE) AS growth,
           round(sqrt(CAST(p_size AS DOUBLE) * p_size + 1600) / 80 / sqrt(2), 9) AS refined FROM part""")
def default_sizing(spark, d):
    box = F.struct(F.lit(0.0).alias("min_x"), F.lit(10.0).alias("min_y"), F.col("p_size").cast("double").alias("max_x"), F.lit(50.0).alias("max_y"))
    sized = table(spark, d, "part").select("p_partkey", mesh.default_sizing(box).alias("z")).select("p_partkey", "z.*")
    finer = mesh.refine_sizes(sized).select("p_partkey", F.round("max_element", 9).alias("refined"))
    return sized.join(finer, "p_partkey").select("p_partkey", F.round("max_element", 9).alias("max_element"), F.round("min_element", 9).alias("min_element"), "across", "growth", "refined")


@query("run_estimates", """
    SELECT o_orderkey, o_orderkey * 40 AS dofs, o_orderkey * 200000 AS memory_bytes, CASE WHEN o_orderkey * 40 <= 25000 THEN 'interactive' WHEN o_orderkey * 40 <= 120000 THEN 'standard' WHEN o_orderkey * 40 <= 300000 THEN 'heavy' ELSE 'extreme' END AS compute_class,
           CAST(ceil(o_totalprice / (4 * sqrt(3) / 2)) AS BIGINT) AS lattice FROM orders""")
def run_estimates(spark, d):
    made = table(spark, d, "orders").select("o_orderkey", mesh.estimate(F.col("o_orderkey") * 40).alias("z"), mesh.lattice_count(F.col("o_totalprice"), F.lit(2.0)).alias("lattice"))
    return made.select("o_orderkey", "z.*", "lattice")


@query("committed_memory", "SELECT o_orderpriority AS lane, CAST(sum(o_orderkey * 5000) AS BIGINT) AS committed FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def committed_memory(spark, d):
    running = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("lane"), mesh.estimate(F.col("o_orderkey"))["memory_bytes"].alias("need"))
    return running.groupBy("lane").agg(F.sum("need").alias("committed"))


@query("via_consolidation", """
    WITH v AS (SELECT p_partkey AS no, 'v' || p_partkey AS id, p_partkey % 2 AS net, p_partkey % 3 AS lo, p_partkey % 3 + 1 AS hi, (p_partkey * 7 % 600) AS x, (p_partkey * 7 % 20) AS y FROM part),
    g AS (SELECT x, y, net, lo, hi, min(no) AS no, string_agg(id, '+' ORDER BY no) AS ids, count(*) AS n FROM v GROUP BY 1, 2, 3, 4, 5)
    SELECT CASE WHEN n = 1 THEN ids ELSE 'merged:' || ids END AS via_id, CAST(net AS BIGINT) AS net_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM g""")
def via_consolidation(spark, d):
    """Vias in one place with one net and one span are one; a merged via's name lists its members."""
    k = F.col("p_partkey")
    layer = lambda n: F.concat(F.lit("L"), n.cast("string"))
    placed = table(spark, d, "part").select(
        k.alias("via_no"), F.concat(F.lit("v"), k).alias("via_id"), (k % 2).alias("net_id"), layer(k % 3).alias("from_layer"), layer(k % 3 + 1).alias("to_layer"),
        (k * 7 % 600).cast("double").alias("x"), (k * 7 % 20).cast("double").alias("y"), F.lit(0.1).alias("drill"), F.lit(0.2).alias("radius"),
    )
    merged, _, _ = spatial.consolidate_vias(placed, layers(spark, d).select("layer_id", "idx"))
    return merged.select("via_id", "net_id", "x", "y")


@query("via_conflicts", """
    WITH v AS (SELECT p_partkey AS no, p_partkey % 2 AS net, p_partkey % 3 AS lo, (p_partkey * 7 % 600) AS x, (p_partkey * 7 % 20) AS y FROM part)
    SELECT a.no AS a, b.no AS b FROM v a JOIN v b ON a.x = b.x AND a.y = b.y AND a.no < b.no WHERE a.net <> b.net OR a.lo <> b.lo""")
def via_conflicts(spark, d):
    k = F.col("p_partkey")
    layer = lambda n: F.concat(F.lit("L"), n.cast("string"))
    placed = table(spark, d, "part").select(
        k.alias("via_no"), F.concat(F.lit("v"), k).alias("via_id"), (k % 2).alias("net_id"), layer(k % 3).alias("from_layer"), layer(k % 3 + 1).alias("to_layer"),
        (k * 7 % 600).cast("double").alias("x"), (k * 7 % 20).cast("double").alias("y"), F.lit(None).cast("double").alias("drill"), F.lit(None).cast("double").alias("radius"),
    )
    return spatial.consolidate_vias(placed, layers(spark, d).select("layer_id", "idx"))[1]
