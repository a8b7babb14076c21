"""Spatial, temporal and attribute joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.operators import joins, timegrid
from rivulet.plans.timechunks import micros

from .base import EDGES, NODES, PIXELS, SLOTS, edges, grid, nodes, pixels, query, r6, readings, s6


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def rain_gauges(t):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("gauge"), (F.lit(50) + F.pmod(k * 41, F.lit(223)) * 0.01).alias("lat"), (F.lit(-9) + F.pmod(k * 59, F.lit(211)) * 0.01).alias("lon"),
        (F.lit(500000.0) + F.pmod(k * 6007, F.lit(60017))).alias("easting"), (F.lit(560000.0) + F.pmod(k * 99991, F.lit(50023))).alias("northing"))


GAUGES = """gauges AS (SELECT c_custkey AS gauge, 50 + ((c_custkey * 41) % 223) * 0.01::DOUBLE AS lat, -9 + ((c_custkey * 59) % 211) * 0.01::DOUBLE AS lon,
  500000.0::DOUBLE + (c_custkey * 6007) % 60017 AS easting, 560000.0::DOUBLE + (c_custkey * 99991) % 50023 AS northing FROM customer)"""


def _hav(a, b):
    return f"2 * 6371 * asin(sqrt(least(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2), 1)))"


@query(
    "j1_nearest_rain_gauge",
    f"""WITH {NODES}, {GAUGES}, d AS (SELECT n.node, g.gauge, round({_hav('n', 'g')}, 6) AS dist FROM nodes n CROSS JOIN gauges g)
SELECT node, arg_min(gauge, {{'d': dist, 'g': gauge}}) AS gauge, round(min(dist), 3) AS dist FROM d GROUP BY 1""",
)
def nearest_rain_gauge(t):
    out = joins.nearest_on_globe(nodes(t).select("node", "lat", "lon"), rain_gauges(t), "gauge")
    return out.select("node", "gauge", F.round("dist", 3).alias("dist"))


@query(
    "j2_nearest_cell",
    f"""WITH {NODES}, {GAUGES}, d AS (SELECT n.node, g.gauge AS cell_id, round(pow(n.lat - g.lat, 2) + pow(n.lon - g.lon, 2), 9) AS d2 FROM nodes n CROSS JOIN gauges g)
SELECT node, arg_min(cell_id, {{'d': d2, 'g': cell_id}}) AS cell_id, {s6('min(d2)')} AS dist FROM d GROUP BY 1""",
)
def nearest_cell(t):
    cells = rain_gauges(t).select(F.col("gauge").alias("cell_id"), "lat", "lon")
    d2 = F.round((F.col("lat") - F.col("_r_lat")) ** 2 + (F.col("lon") - F.col("_r_lon")) ** 2, 9)
    out = joins.nearest_planar(nodes(t).select("node", "lat", "lon"), cells, ("lat", "lon"), "cell_id", dist=d2)
    return out.select("node", "cell_id", r6("dist").alias("dist"))


@query(
    "j3_k_nearest",
    f"""WITH {NODES}, d AS (SELECT a.node AS src, b.node AS dst, sqrt(pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2)) AS dist FROM nodes a JOIN nodes b ON a.node <> b.node),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM d), t AS (SELECT src, dst, dist FROM k WHERE r <= 4)
SELECT src, dst, {s6('any_value(dist)')} AS dist FROM (SELECT src, dst, dist FROM t UNION ALL SELECT dst, src, dist FROM t) GROUP BY 1, 2""",
)
def k_nearest(t):
    knn = joins.k_nearest(nodes(t), 4).select("src", "dst", "dist")
    return _round(joins.both_directions(knn), "dist")


@query(
    "j4_pixel_nearest_node",
    f"""WITH {PIXELS}, s AS (SELECT s_suppkey AS node, 500000.0::DOUBLE + (s_suppkey * 7919) % 3840 AS e, 600000.0::DOUBLE - (s_suppkey * 104729) % 3600 AS n FROM supplier),
d AS (SELECT p."row", p.col, s.node, sqrt(pow(500000.0::DOUBLE + p.col * 30 - s.e, 2) + pow(600000.0::DOUBLE - p."row" * 30 - s.n, 2)) AS dist FROM pixels p JOIN s ON sqrt(pow(500000.0::DOUBLE + p.col * 30 - s.e, 2) + pow(600000.0::DOUBLE - p."row" * 30 - s.n, 2)) <= 300)
SELECT "row", col, arg_min(node, {{'d': dist, 'n': node}}) AS node, {s6('min(dist)')} AS dist FROM d GROUP BY 1, 2""",
)
def pixel_nearest_node(t):
    k = F.col("s_suppkey")
    n = t.supplier.select(k.alias("node"), (F.lit(500000.0) + F.pmod(k * 7919, F.lit(3840))).alias("x"), (F.lit(600000.0) - F.pmod(k * 104729, F.lit(3600))).alias("y"))
    p = pixels(t).select("row", "col", (F.lit(500000.0) + F.col("col") * 30).alias("x"), (F.lit(600000.0) - F.col("row") * 30).alias("y"))
    return _round(joins.nearest_within(p, n, ("x", "y"), "node", 300.0, ("row", "col")), "dist")


@query(
    "j5_section_gauge",
    f"""WITH {NODES}, {GAUGES}, d AS (SELECT g.gauge AS section_id, n.node AS ref, sqrt(pow(n.easting - g.easting, 2) + pow(n.northing - g.northing, 2)) AS dist FROM gauges g CROSS JOIN nodes n),
b AS (SELECT section_id, arg_min(ref, {{'d': dist, 'r': ref}}) AS ref, min(dist) AS dist FROM d GROUP BY 1)
SELECT ref, arg_min(section_id, {{'d': dist, 's': section_id}}) AS section_id, {s6('min(dist)')} AS dist FROM b WHERE dist <= 500 GROUP BY 1""",
)
def section_gauge(t):
    sections = rain_gauges(t).select(F.col("gauge").alias("section_id"), "easting", "northing")
    refs = nodes(t).select(F.col("node").alias("ref"), "easting", "northing")
    near = joins.nearest_planar(sections, refs, ("easting", "northing"), "ref").where("dist <= 500")
    return _round(joins.closest_section(near), "dist")


@query(
    "j6_match_sections",
    f"""WITH {NODES}, {GAUGES}, s AS (SELECT gauge AS section_id, easting, northing, CASE WHEN gauge % 3 = 0 THEN '00' || (gauge % 400) ELSE 'none' END AS code FROM gauges),
a AS (SELECT s.section_id, n.node AS ref FROM s JOIN nodes n ON ltrim(trim(s.code), '0') = ltrim(CAST(n.node AS VARCHAR), '0')),
d AS (SELECT s.section_id, n.node AS ref, sqrt(pow(n.easting - s.easting, 2) + pow(n.northing - s.northing, 2)) AS dist FROM s CROSS JOIN nodes n WHERE s.section_id NOT IN (SELECT section_id FROM a)),
b AS (SELECT section_id, arg_min(ref, {{'d': dist, 'r': ref}}) AS ref, min(dist) AS dist FROM d GROUP BY 1)
SELECT section_id, ref, 'reference' AS matched_by FROM a UNION ALL SELECT section_id, CASE WHEN dist < 5000 THEN ref END, CASE WHEN dist < 5000 THEN 'distance' END FROM b""",
)
def match_sections(t):
    s = rain_gauges(t).select(F.col("gauge").alias("section_id"), "easting", "northing", F.when(F.pmod("gauge", F.lit(3)) == 0, F.concat(F.lit("00"), F.pmod("gauge", F.lit(400)))).otherwise("none").alias("code"))
    refs = nodes(t).select(F.col("node").alias("ref"), "easting", "northing")
    return joins.match_sections(s, refs, "code").select("section_id", "ref", "matched_by")


HOLES = f"""{PIXELS}, px AS (SELECT tag % 3 AS event_id, "row", col, CASE WHEN tag % 4 = 0 THEN NULL ELSE sigma0 END AS v FROM pixels),
nd AS (SELECT s_suppkey AS node, (s_suppkey * 31) % 130 AS "row", (s_suppkey * 17) % 128 AS col FROM supplier)"""


def _holes(t):
    px = pixels(t).select(F.pmod("tag", F.lit(3)).alias("event_id"), "row", "col", F.when(F.pmod("tag", F.lit(4)) != 0, F.col("sigma0")).alias("v"))
    k = F.col("s_suppkey")
    nd = t.supplier.select(k.alias("node"), F.pmod(k * 31, F.lit(130)).alias("row"), F.pmod(k * 17, F.lit(128)).alias("col"))
    return px, nd


@query(
    "j7_sample_raster",
    f"""WITH {HOLES}, h AS (SELECT nd.node, max(v) FILTER (WHERE px."row" = nd."row" AND px.col = nd.col) AS own, median(v) AS patch FROM nd LEFT JOIN px ON abs(px."row" - nd."row") <= 1 AND abs(px.col - nd.col) <= 1 GROUP BY 1)
SELECT node, {s6('coalesce(own, patch, (SELECT median(v) FROM px))')} AS v, CASE WHEN own IS NOT NULL THEN 'pixel' WHEN patch IS NOT NULL THEN 'patch' ELSE 'raster' END AS source FROM h""",
)
def sample_raster(t):
    px, nd = _holes(t)
    return _round(joins.sample_raster(nd, px, "node", "v"), "v")


@query(
    "j26_sample_matrix",
    f"""WITH {HOLES}, e AS (SELECT event_id, median(v) AS m FROM px GROUP BY 1),
h AS (SELECT e.event_id, nd.node, any_value(e.m) AS m, max(v) FILTER (WHERE px."row" = nd."row" AND px.col = nd.col) AS own, median(v) AS patch FROM e CROSS JOIN nd JOIN px ON px.event_id = e.event_id AND abs(px."row" - nd."row") <= 1 AND abs(px.col - nd.col) <= 1 GROUP BY 1, 2)
SELECT event_id, node, {s6('coalesce(own, patch, m)')} AS v, CASE WHEN own IS NOT NULL THEN 'pixel' WHEN patch IS NOT NULL THEN 'patch' ELSE 'raster' END AS source, 3::BIGINT AS n_events, true AS enough FROM h""",
)
def sample_matrix(t):
    px, nd = _holes(t)
    return _round(joins.sample_matrix(joins.sample_raster(nd, px, "node", "v", by=("event_id",))), "v")


@query(
    "j8_candidate_pairs",
    f"""WITH {NODES}, {EDGES}, d AS (SELECT a.node AS i, b.node AS j, sqrt(pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2)) / 1000 AS km FROM nodes a JOIN nodes b ON a.node < b.node)
SELECT i, j, {s6('km')} AS dist_km FROM d WHERE km <= 8 AND NOT EXISTS (SELECT 1 FROM edges e WHERE least(e.src, e.dst) = i AND greatest(e.src, e.dst) = j)""",
)
def candidate_pairs(t):
    return _round(joins.candidate_pairs(nodes(t), edges(t), 8.0), "dist_km").select("i", "j", "dist_km")


CORR = f"""{PIXELS}, nd AS (SELECT s_suppkey AS node, 500000.0::DOUBLE + (s_suppkey * 7919) % 3840 AS e, 600000.0::DOUBLE - (s_suppkey * 104729) % 3500 AS n FROM supplier),
pr AS (SELECT a.node AS i, b.node AS j, a.e AS e1, a.n AS n1, b.e AS e2, b.n AS n2, sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2)) / 1000 AS km FROM nd a JOIN nd b ON a.node < b.node WHERE sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2)) <= 600),
sm AS (SELECT i, j, km, k, e1 + (0.15::DOUBLE + k * (0.70::DOUBLE / 59)) * (e2 - e1) AS e, n1 + (0.15::DOUBLE + k * (0.70::DOUBLE / 59)) * (n2 - n1) AS n FROM pr, generate_series(0, 59) g(k)),
hit AS (SELECT i, j, km, k, hand, elev FROM sm JOIN pixels ON "row" = CAST(round_even((n - 600000) / -30, 0) AS BIGINT) AND col = CAST(round_even((e - 500000) / 30, 0) AS BIGINT)),
co AS (SELECT i, j, km, min(hand) AS min_hand, arg_min(elev, {{'h': hand, 'k': k}}) AS z FROM hit GROUP BY 1, 2, 3)"""


def _corridors(t):
    k = F.col("s_suppkey")
    nd = t.supplier.select(k.alias("node"), (F.lit(500000.0) + F.pmod(k * 7919, F.lit(3840))).alias("easting"), (F.lit(600000.0) - F.pmod(k * 104729, F.lit(3500))).alias("northing"))
    none = edges(t).where("false")
    once = nd.distinct().groupBy("node").count().where("count > 1").isEmpty()  # a node at two places could give a pair in two blocks
    return joins.corridor_minimum(joins.candidate_pairs(nd, none, 0.6, keep_blocks=True), pixels(t), (500000.0, 600000.0), (30.0, -30.0), reach=600.0, once=once)


@query("j9_corridor_minimum", f"WITH {CORR} SELECT i, j, {s6('km')} AS dist_km, {s6('min_hand')} AS min_hand, {s6('z')} AS z_saddle FROM co")
def corridor_minimum(t):
    return _round(_corridors(t), "dist_km", "min_hand", "z_saddle")


@query("j10_overland_edges", f"WITH {CORR}, ok AS (SELECT * FROM co WHERE min_hand >= 0.3), b AS (SELECT i AS src, j AS dst, min_hand, km, z FROM ok UNION ALL SELECT j, i, min_hand, km, z FROM ok) SELECT src, dst, {s6('min_hand')} AS hand_threshold, {s6('km')} AS overland_dist_km, {s6('z')} AS z_saddle_m FROM b")
def overland_edges(t):
    return _round(joins.overland_edges(_corridors(t), 0.3), "hand_threshold", "overland_dist_km", "z_saddle_m")


@query(
    "j11_event_of_timestep",
    """WITH ev AS (SELECT o_orderkey AS event_id, o_orderkey AS event_order, o_orderdate - INTERVAL 3 DAY AS s, o_orderdate + INTERVAL 3 DAY + INTERVAL 1425 MINUTE AS e FROM orders),
st AS (SELECT DISTINCT l_shipdate AS ts FROM lineitem), m AS (SELECT st.ts, max(event_id) AS event_id FROM st JOIN ev ON st.ts BETWEEN s AND e GROUP BY 1)
SELECT st.ts, event_id FROM st LEFT JOIN m USING (ts)""",
)
def event_of_timestep(t):
    ev = t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("event_order"), F.expr("o_orderdate - interval 3 days").alias("event_start"), F.expr("o_orderdate + interval 3 days + interval 1425 minutes").alias("event_end"))
    return joins.event_of_timestep(t.lineitem.select(F.col("l_shipdate").alias("ts")).distinct(), ev)


PRODUCTS = """products AS (SELECT l_orderkey * 10 + l_linenumber AS product_id, CAST(min(l_shipdate) AS DATE) AS date, CAST((l_orderkey * 7 + l_linenumber) % 5 AS BIGINT) AS orbit_rel, max(l_extendedprice) / 100 AS size_mb FROM lineitem GROUP BY l_orderkey, l_linenumber),
peaks AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS peak_date FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1),
near0 AS (SELECT product_id, arg_min({'event_id': event_id, 'peak_date': peak_date}, {'d': abs(date_diff('day', peak_date, date)), 'e': event_id}) AS b, min(abs(date_diff('day', peak_date, date))) AS days_from_peak, any_value(date) AS date, any_value(orbit_rel) AS orbit_rel, any_value(size_mb) AS size_mb
  FROM products JOIN peaks ON abs(date_diff('day', peak_date, date)) <= 2 GROUP BY 1),
flood AS (SELECT product_id, b.event_id AS event_id, b.peak_date AS peak_date, date, orbit_rel, size_mb, CAST(days_from_peak AS INTEGER) AS days_from_peak FROM near0),
best AS (SELECT *, year(date) - CASE WHEN month(date) < 9 THEN 1 ELSE 0 END AS ref_year FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY days_from_peak, product_id) AS r FROM flood) WHERE r = 1),
refs AS (SELECT b.event_id, p.product_id, p.date, p.orbit_rel, CAST(b.ref_year AS INTEGER) AS ref_year, p.size_mb FROM products p JOIN best b ON b.orbit_rel = p.orbit_rel AND year(p.date) = b.ref_year WHERE month(p.date) BETWEEN 6 AND 8
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT peak_date FROM flood) f WHERE abs(date_diff('day', f.peak_date, p.date)) <= 3))"""


def _products(t):
    p = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("d"), F.max("l_extendedprice").alias("x"))
    p = p.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product_id"), F.to_date("d").alias("date"), F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(5)).cast("long").alias("orbit_rel"), (F.col("x") / 100).alias("size_mb"))
    # the yearly maximum of each priority over the whole table
    top = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("top")
    peaks = t.orders.groupBy("o_orderpriority", F.year("o_orderdate")).agg(top).select(F.col("top.o_orderkey").alias("event_id"), F.to_date("top.o_orderdate").alias("peak_date"))
    return p, joins.products_near_peaks(p, peaks)


@query("j12_products_near_peaks", f"WITH {PRODUCTS} SELECT product_id, event_id, peak_date, date, orbit_rel, {s6('size_mb')} AS size_mb, days_from_peak FROM flood")
def products_near_peaks(t):
    return _round(_products(t)[1], "size_mb")


@query("j13_dry_references", f"WITH {PRODUCTS} SELECT event_id, product_id, date, orbit_rel, ref_year, {s6('size_mb')} AS size_mb FROM refs")
def dry_references(t):
    p, flood = _products(t)
    return _round(joins.dry_references(p, flood, exclude_days=3), "size_mb")


MANIFEST = f"""{PRODUCTS}, man AS (SELECT event_id, product_id, date, orbit_rel, size_mb, 'flood' AS role FROM best UNION ALL
SELECT event_id, product_id, date, orbit_rel, size_mb, 'reference' FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY date, product_id) AS r FROM refs) WHERE r <= 3)"""


@query("j27_scene_manifest", f"WITH {MANIFEST} SELECT event_id, product_id, date, orbit_rel, {s6('size_mb')} AS size_mb, role FROM man")
def scene_manifest(t):
    p, flood = _products(t)
    out = joins.scene_manifest(flood, joins.dry_references(p, flood, exclude_days=3))
    return _round(out, "size_mb").select("event_id", "product_id", "date", "orbit_rel", "size_mb", "role")


@query("j27_manifest_size", f"WITH {MANIFEST} SELECT role, count(*) AS n, {s6('sum(size_mb)')} AS total_mb FROM man GROUP BY 1")
def manifest_size(t):
    p, flood = _products(t)
    man = joins.scene_manifest(flood, joins.dry_references(p, flood, exclude_days=3))
    return _round(man.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("size_mb").alias("total_mb")), "total_mb")


@query(
    "k61_product_summary",
    f"""WITH {PRODUCTS} SELECT event_id, count(*) AS n_products, {s6('sum(size_mb)')} AS total_mb, string_agg(DISTINCT CAST(orbit_rel AS VARCHAR), ',' ORDER BY CAST(orbit_rel AS VARCHAR)) AS orbits,
  arg_min(product_id, {{'d': days_from_peak, 'p': product_id}}) AS nearest_product, min(days_from_peak) AS nearest_days FROM flood GROUP BY 1""",
)
def product_summary(t):
    flood = _products(t)[1]
    out = flood.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_products"), F.sum("size_mb").alias("total_mb"), F.array_join(F.sort_array(F.collect_set(F.col("orbit_rel").cast("string"))), ",").alias("orbits"),
        F.min(F.struct("days_from_peak", "product_id")).alias("_b"))
    return _round(out.select("event_id", "n_products", "total_mb", "orbits", F.col("_b.product_id").alias("nearest_product"), F.col("_b.days_from_peak").alias("nearest_days")), "total_mb")


@query(
    "j14_calibrated_pixels",
    f"""WITH {PIXELS}, lut AS (SELECT s_suppkey AS pos, 300 + s_acctbal / 100 AS v, lead(300 + s_acctbal / 100) OVER (ORDER BY s_suppkey) AS nx, count(*) OVER () - 1 AS last FROM supplier),
c AS (SELECT DISTINCT col FROM pixels), x AS (SELECT col, col * last / 127.0::DOUBLE AS pp FROM c, (SELECT any_value(last) AS last FROM lut)),
l AS (SELECT x.col, lut.v + CASE WHEN pp - floor(pp) > 0 THEN (pp - floor(pp)) * (nx - v) ELSE 0 END AS lut FROM x JOIN lut ON lut.pos = CAST(floor(pp) AS BIGINT))
SELECT "row", p.col, {s6('lut')} AS lut, CASE WHEN tag % 50 > 0 THEN {s6('10 * log10((tag % 50) * (tag % 50) / (lut * lut))')} END AS sigma0 FROM pixels p JOIN l ON l.col = p.col""",
)
def calibrated_pixels(t):
    lut = t.supplier.select(F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") / 100 + 300).alias("lut"))
    p = pixels(t).select("row", "col", F.pmod("tag", F.lit(50)).cast("double").alias("dn"))
    cols = joins.interpolate_lut(p.select("col").distinct(), lut, 128)
    out = p.join(cols, "col").withColumn("sigma0", X.calibrated_db(F.col("dn"), F.col("lut")))
    return _round(out, "lut", "sigma0").select("row", "col", "lut", "sigma0")


ALERTS = f"""{SLOTS}, pred AS (SELECT series_id AS node, ts, value * 0.9::DOUBLE AS pred FROM slots),
al AS (SELECT event_id AS alert_id, event_type AS gauge_ref, ts AS alert_ts, 95.0::DOUBLE AS bankfull FROM events QUALIFY value > 1.5::DOUBLE * avg(value) OVER (PARTITION BY event_type)),
v AS (SELECT a.*, max(p.pred) AS max_pred FROM al a LEFT JOIN pred p ON p.node = a.gauge_ref AND p.ts BETWEEN time_bucket(INTERVAL 15 MINUTE, a.alert_ts + INTERVAL 450 SECOND) - INTERVAL 2 HOUR AND time_bucket(INTERVAL 15 MINUTE, a.alert_ts + INTERVAL 450 SECOND) + INTERVAL 2 HOUR GROUP BY ALL),
ve AS (SELECT *, CASE WHEN max_pred > bankfull THEN 'TP' ELSE 'FN' END AS status FROM v)"""


def _alerts(t):
    pred = timegrid.resample(readings(t)).select(F.col("series_id").alias("node"), "ts", (F.col("value") * 0.9).alias("pred"))
    mean = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    alerts = t.events.join(mean, "event_type").where(F.col("value") > 1.5 * F.col("mean")).select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("gauge_ref"), F.col("ts").alias("alert_ts"))
    thr = t.events.select(F.col("event_type").alias("gauge_ref"), F.lit(95.0).alias("bankfull")).distinct()
    return joins.verify_alerts(alerts, pred, thr), pred, thr


@query("j15_verify_alerts", f"WITH {ALERTS} SELECT gauge_ref, alert_id, alert_ts, bankfull, {s6('max_pred')} AS max_pred, status FROM ve")
def verify_alerts(t):
    return _round(_alerts(t)[0], "max_pred")


@query(
    "j15_alert_scores",
    f"""WITH {ALERTS}, fp AS (SELECT node, CAST(ts AS DATE) AS d, count(*) AS n FROM pred WHERE pred > 95 AND NOT EXISTS (SELECT 1 FROM al WHERE al.gauge_ref = pred.node AND CAST(al.alert_ts AS DATE) = CAST(pred.ts AS DATE)) GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (WHERE status = 'TP') AS tp, count(*) FILTER (WHERE status = 'FN') AS fn, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM fp) AS fp_steps, (SELECT count(*) FROM fp) AS fp_days FROM ve)
SELECT *, {s6('tp / (tp + fp_steps)')} AS precision, {s6('tp / (tp + fp_days)')} AS precision_days, {s6('tp / (tp + fn)')} AS recall, {s6('2 * (tp / (tp + fp_steps)) * (tp / (tp + fn)) / (tp / (tp + fp_steps) + tp / (tp + fn))')} AS f1 FROM c""",
)
def alert_scores(t):
    v, pred, thr = _alerts(t)
    return _round(joins.alert_scores(v, pred, thr), "precision", "precision_days", "recall", "f1")


@query(
    "j23_append_features",
    f"""WITH {SLOTS}, sm AS (SELECT series_id, ts, avg(value) / 400 AS sm FROM readings_q GROUP BY 1, 2), fin AS (SELECT g.series_id, g.ts, sm.sm FROM grid g LEFT JOIN sm USING (series_id, ts))
SELECT series_id, ts, {s6('sm')} AS sm, sm IS NOT NULL AS appended FROM fin""".replace("readings_q", "(SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, value FROM readings WHERE quality_code < 50)"),
)
def append_features(t):
    extra = timegrid.resample(readings(t).where("quality_code < 50")).select("series_id", "ts", (F.col("value") / 400).alias("sm"))
    return _round(joins.append_features(grid(t).select("series_id", "ts"), extra, ("series_id", "ts")), "sm")


@query(
    "j24_node_soil_moisture",
    f"""WITH {NODES}, {GAUGES}, near AS (SELECT node, arg_min(gauge, {{'d': d2, 'g': gauge}}) AS cell FROM (SELECT n.node, g.gauge, round(pow(n.lat - g.lat, 2) + pow(n.lon - g.lon, 2), 9) AS d2 FROM nodes n CROSS JOIN gauges g) GROUP BY 1),
src AS (SELECT o_custkey AS cell, o_orderdate AS ts, avg(o_totalprice) / 1000000 AS v FROM orders GROUP BY 1, 2), ax AS (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) + INTERVAL 12 HOUR AS ts),
m AS (SELECT n.node, a.ts, arg_min(s.v, {{'d': abs(epoch_us(s.ts) - epoch_us(a.ts)), 'l': -epoch_us(s.ts)}}) AS v FROM near n CROSS JOIN ax a LEFT JOIN src s ON s.cell = n.cell AND s.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts + INTERVAL 24 HOUR GROUP BY 1, 2)
SELECT node, ts, {s6('v')} AS swvl1 FROM m""",
)
def node_soil_moisture(t):
    """Each node reads its nearest cell, aligned to the time steps within a tolerance of a day."""
    cells = rain_gauges(t).select(F.col("gauge").alias("cell_id"), "lat", "lon")
    d2 = F.round((F.col("lat") - F.col("_r_lat")) ** 2 + (F.col("lon") - F.col("_r_lon")) ** 2, 9)
    near = joins.nearest_planar(nodes(t).select("node", "lat", "lon"), cells, ("lat", "lon"), "cell_id", dist=d2).select("node", "cell_id")
    src = t.orders.groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderdate").alias("ts")).agg((F.avg("o_totalprice") / 1000000).alias("value"))
    used = near.select("cell_id").distinct()
    lo, hi = (t.orders.agg(micros(f("o_orderdate"))).scalar() for f in (F.min, F.max))
    targets = timegrid.slot_axis(used, lo, hi, "1 day").withColumn("ts", F.expr("ts + interval 12 hours"))
    aligned = timegrid.align_nearest(targets, src.join(used, "cell_id", "left_semi"), 24 * 3_600_000_000, ("cell_id",))
    return near.join(aligned, "cell_id").select("node", "ts", r6("value").alias("swvl1"))


@query("j25_threshold_lookup", f"WITH {NODES} SELECT node, {s6('coalesce(b, 0.5)')} AS bankfull FROM nodes LEFT JOIN (SELECT l_suppkey AS node, max(l_discount) * 20 AS b FROM lineitem GROUP BY 1) USING (node)")
def threshold_lookup(t):
    thr = t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg((F.max("l_discount") * 20).alias("bankfull"))
    return _round(joins.threshold_lookup(nodes(t).select("node"), thr, "node"), "bankfull")

