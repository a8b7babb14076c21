"""River network: scalar expressions, edge tables, gates, distances, reachability and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.operators import graph, joins, timegrid

from .base import EDGES, NODES, SLOTS, edges, nodes, query, r6, readings, s6


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# -------------------------------------------------------- scalar expressions
PAIRS = f"{NODES}, {EDGES}, pr AS (SELECT e.src, e.dst, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS lp, a.easting AS ea, a.northing AS na, b.easting AS eb, b.northing AS nb FROM edges e JOIN nodes a ON a.node = e.src JOIN nodes b ON b.node = e.dst)"


@query(
    "b1_b3_distances",
    f"""WITH {PAIRS} SELECT src, dst, {s6('2 * 6371 * asin(sqrt(least(pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin((radians(lp) - radians(lo)) / 2), 2), 1)))')} AS haversine_km,
  {s6('sqrt(pow(ea - eb, 2) + pow(na - nb, 2)) / 1000')} AS planar_km, {s6('sqrt(pow((lb - la) * 111, 2) + pow((lp - lo) * 111 * cos(radians(la)), 2))')} AS equirect_km FROM pr""",
)
def distances(t):
    e = graph._ends(edges(t).select("src", "dst"), nodes(t), ("lat", "lon", "easting", "northing"))
    c = F.col
    return e.select(
        "src", "dst", r6(X.haversine_km(c("s_lat"), c("s_lon"), c("d_lat"), c("d_lon"))).alias("haversine_km"),
        r6(X.planar_km(c("s_easting"), c("s_northing"), c("d_easting"), c("d_northing"))).alias("planar_km"),
        r6(X.equirectangular_km(c("s_lat"), c("s_lon"), c("d_lat"), c("d_lon"))).alias("equirect_km"))


@query(
    "b4_b7_node_features",
    f"""WITH {NODES}, v AS (SELECT *, (node % 23) - 8 AS q, datum + (node % 19) * 0.3::DOUBLE - 1 AS lvl FROM nodes)
SELECT node, {s6('sign(q) * ln(1 + abs(q))')} AS signed_log, {s6('least(greatest((lvl - datum) / CASE WHEN p90 - datum > 0.01 THEN p90 - datum ELSE 1 END, -2), 5)')} AS norm_pos, greatest(CAST(q AS DOUBLE), 0) AS rain, {s6('ln(1 + area_km2)')} AS log_area FROM v""",
)
def node_features(t):
    v = nodes(t).withColumn("q", (F.pmod("node", F.lit(23)) - 8).cast("double")).withColumn("lvl", F.col("datum") + F.pmod("node", F.lit(19)) * 0.3 - 1)
    return v.select(
        "node", r6(X.signed_log1p(F.col("q"))).alias("signed_log"), r6(X.normalised_position(F.col("lvl"), F.col("datum"), F.col("p90"))).alias("norm_pos"),
        X.clip(F.col("q"), 0.0).alias("rain"), r6(X.log_area(F.col("area_km2"))).alias("log_area"))


@query(
    "b16_b17_crs_and_status",
    f"""WITH {NODES}, v AS (SELECT node, CASE node % 4 WHEN 0 THEN lon WHEN 1 THEN easting WHEN 2 THEN easting - 350000 ELSE -5000000 END AS e, CASE node % 4 WHEN 0 THEN lat WHEN 1 THEN northing WHEN 2 THEN northing - 500000 ELSE 1 END AS n, CASE WHEN node % 6 > 0 THEN (node % 6) * 0.09::DOUBLE END AS st FROM nodes)
SELECT node, CASE WHEN e BETWEEN -10 AND 2 AND n BETWEEN 49 AND 62 THEN 'EPSG:4326' WHEN e BETWEEN 480000 AND 620000 AND n BETWEEN 530000 AND 960000 THEN 'EPSG:2157' WHEN e BETWEEN 50000 AND 380000 AND n BETWEEN 10000 AND 460000 THEN 'EPSG:29902'
  WHEN e BETWEEN -200000 AND 700000 AND n BETWEEN 0 AND 1300000 THEN 'EPSG:27700' END AS crs, CASE WHEN coalesce(st, 0) > 0.3 THEN 'high' WHEN coalesce(st, 0) > 0.1 THEN 'moderate' ELSE 'normal' END AS status FROM v""",
)
def crs_and_status(t):
    m = F.pmod("node", F.lit(4))
    v = nodes(t).select(
        "node", F.when(m == 0, F.col("lon")).when(m == 1, F.col("easting")).when(m == 2, F.col("easting") - 350000).otherwise(-5000000.0).alias("e"),
        F.when(m == 0, F.col("lat")).when(m == 1, F.col("northing")).when(m == 2, F.col("northing") - 500000).otherwise(1.0).alias("n"),
        F.when(F.pmod("node", F.lit(6)) > 0, F.pmod("node", F.lit(6)) * 0.09).alias("st"))
    return v.select("node", X.coordinate_system(F.col("e"), F.col("n")).alias("crs"), X.gauge_status(F.col("st")).alias("status"))


@query("b19_travel_time", f"WITH {EDGES} SELECT src, dst, {s6('CASE WHEN v > 0 THEN dist_km * 1000 / (5.0::DOUBLE / 3 * v) / 3600 END')} AS travel_time_h FROM edges LEFT JOIN (SELECT src AS s, velocity AS v FROM edges WHERE src % 8 <> 0) ON s = src")
def travel_time(t):
    e = edges(t)
    v = e.where(F.pmod("src", F.lit(8)) != 0).select(F.col("src").alias("node"), "velocity")
    return _round(graph.travel_times(e.select("src", "dst", "dist_km"), v), "travel_time_h").select("src", "dst", "travel_time_h")


@query(
    "b20_concentration_time",
    f"""WITH {NODES}, {EDGES}, u AS (SELECT dst, max(elev_drop) AS up FROM edges GROUP BY 1), a AS (SELECT node, 1500 * sqrt(greatest(area_km2, 0.01)) AS l, greatest(p90 - datum, 0.5, coalesce(up, 0)) AS h FROM nodes LEFT JOIN u ON dst = node)
SELECT node, {s6('least(greatest(0.0195 * pow(l, 0.77) * pow(greatest(h / l, 0.0002), -0.385) / 60, 0.25), 8)')} AS tc_hours FROM a""",
)
def concentration_time(t):
    return _round(graph.concentration_time(nodes(t), edges(t), divisor=60.0), "tc_hours")


@query(
    "b21_kinematic_lag",
    f"""WITH {NODES}, {EDGES}, a AS (SELECT src, dst, (dist_km - 1) * 1000 AS d, elev_drop, greatest(p90 - datum, 0.3) AS depth FROM edges JOIN nodes ON node = dst), b AS (SELECT *, greatest(pow(depth * 0.6::DOUBLE, 2.0::DOUBLE / 3) * sqrt(greatest(elev_drop / nullif(d, 0), 0.0001)) / 0.035, 0.1) AS v FROM a)
SELECT src, dst, CASE WHEN d < 100 THEN 1 ELSE greatest(CAST(round_even(d / (v * (5.0::DOUBLE / 3)) / 900, 0) AS INTEGER), 1) END AS kinematic_lag FROM b""",
)
def kinematic_lag(t):
    return graph.kinematic_lag(edges(t).withColumn("dist_km", F.col("dist_km") - 1).where("dist_km >= 0").withColumn("dist_km", F.greatest("dist_km", F.lit(1e-9))), nodes(t))


STATE = f"""{SLOTS}, state AS (SELECT user_id % 10 AS node, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS discharge, avg(value) / 60 AS norm_stage, least(avg(value) / 80, 1) AS sat FROM readings GROUP BY 1, 2)"""


def network_state(t):
    """Hourly state of the first ten gauges of the network, one per residue of the user id."""
    g = timegrid.resample(readings(t).withColumn("node", F.pmod("user_id", F.lit(10))), "1 hour", keys=("node",))
    return g.select("node", "ts", F.col("value").alias("discharge"), (F.col("value") / 60).alias("norm_stage"), F.least(F.col("value") / 80, F.lit(1.0)).alias("sat"))


QREF = "(SELECT greatest(avg(discharge), 0.01) FROM state)"
COND = f"cond AS (SELECT e.src, e.dst, s.ts, 1 / (1 + exp(-(1.5::DOUBLE * (s.discharge / ({QREF} + 1e-8) - 1)))) AS c FROM edges e JOIN state s ON s.node = e.src)"


def _river_gate(t):
    s = network_state(t)
    return graph.conductance_gate(edges(t).select("src", "dst"), s, s.agg(F.greatest(F.avg("discharge"), F.lit(0.01))).scalar(), scale=1.5)


@query("b22_conductance_gate", f"WITH {STATE}, {EDGES}, {COND} SELECT src, dst, ts, {s6('c')} AS conductance, {s6('ln(c + 1e-6)')} AS log_conductance FROM cond")
def conductance_gate(t):
    return _round(_river_gate(t), "conductance", "log_conductance")


LEVELS = f"{STATE}, {NODES}, {EDGES}, levels AS (SELECT s.node, s.ts, n.datum + s.norm_stage * greatest(n.p90 - n.datum, 0.01) AS level FROM state s JOIN nodes n USING (node))"
OVER = "over_e AS (SELECT src, dst, 1.0::DOUBLE + src % 5 AS z FROM edges)"
BACK = "back_e AS (SELECT dst AS src, src AS dst, 2.0::DOUBLE + dst % 3 AS ref FROM edges WHERE src % 3 = 0)"


def _levels(t):
    n = nodes(t).withColumn("stage_range", F.greatest(F.col("p90") - F.col("datum"), F.lit(0.01)))
    return graph.water_level(network_state(t), n)


def _overland_gate(t):
    return graph.stage_gate(edges(t).select("src", "dst", (F.lit(1.0) + F.pmod("src", F.lit(5))).alias("z_saddle_m")), _levels(t))


def _backwater_gate(t):
    b = edges(t).where(F.pmod("src", F.lit(3)) == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.lit(2.0) + F.pmod("dst", F.lit(3))).alias("gate_reference"))
    return graph.backwater_gate(b, _levels(t))


@query("b23_stage_gate", f"WITH {LEVELS}, {OVER} SELECT e.src, e.dst, a.ts, {s6('1 / (1 + exp(-(2 * (greatest(a.level, b.level) - z))))')} AS activation FROM over_e e JOIN levels a ON a.node = e.src JOIN levels b ON b.node = e.dst AND b.ts = a.ts")
def stage_gate(t):
    return _round(_overland_gate(t), "activation").select("src", "dst", "ts", "activation")


@query("b24_saturation_gate", f"WITH {STATE} SELECT ts, {s6('avg(sat)')} AS mean_saturation, {s6('1 / (1 + exp(-(10 * (avg(sat) - 0.6))))')} AS activation FROM state GROUP BY 1")
def saturation_gate(t):
    return _round(graph.saturation_gate(network_state(t), "sat", threshold=0.6), "mean_saturation", "activation")


@query("b25_backwater_gate", f"WITH {LEVELS}, {BACK} SELECT e.src, e.dst, l.ts, {s6('1 / (1 + exp(-(2 * (l.level - ref))))')} AS activation FROM back_e e JOIN levels l ON l.node = e.src")
def backwater_gate(t):
    return _round(_backwater_gate(t), "activation").select("src", "dst", "ts", "activation")


@query(
    "b32_edge_states",
    f"""WITH {LEVELS}, {COND}, {OVER}, {BACK}, u AS (SELECT src, dst, ts, 'river' AS edge_class, ln(c + 1e-6) AS lc, 1.0::DOUBLE AS act FROM cond
UNION ALL SELECT e.src, e.dst, a.ts, 'overland', NULL, 1 / (1 + exp(-(2 * (greatest(a.level, b.level) - z)))) FROM over_e e JOIN levels a ON a.node = e.src JOIN levels b ON b.node = e.dst AND b.ts = a.ts
UNION ALL SELECT e.src, e.dst, l.ts, 'backwater', NULL, 1 / (1 + exp(-(2 * (l.level - ref)))) FROM back_e e JOIN levels l ON l.node = e.src)
SELECT src, dst, ts, edge_class, {s6('lc')} AS log_conductance, {s6('act')} AS activation FROM u""",
)
def edge_states(t):
    return _round(graph.edge_states(_river_gate(t), _overland_gate(t), _backwater_gate(t)), "log_conductance", "activation")


@query(
    "b26_saturation_ratio",
    f"""WITH {STATE}, w AS (SELECT node, ts, discharge / 120 AS a, discharge / 200 AS b FROM state), l AS (SELECT node, ts, unnest(['swvl1', 'swvl3']) AS layer, unnest([a, b]) AS vwc FROM w)
SELECT node, ts, layer, {s6('vwc')} AS vwc, {s6("least(greatest(vwc / CASE layer WHEN 'swvl1' THEN 0.472 ELSE 0.452 END, 0), 1)")} AS sat_ratio FROM l""",
)
def saturation_ratio(t):
    w = network_state(t).select("node", "ts", (F.col("discharge") / 120).alias("swvl1"), (F.col("discharge") / 200).alias("swvl3"))
    long = w.unpivot(["node", "ts"], ["swvl1", "swvl3"], "layer", "vwc")
    return long.select("node", "ts", "layer", r6("vwc").alias("vwc"), r6(X.saturation_ratio(F.col("vwc"), F.col("layer"))).alias("sat_ratio"))


@query("b27_outside_box", f"WITH {NODES} SELECT node, easting, northing FROM nodes WHERE NOT (easting BETWEEN 505000 AND 550000 AND northing BETWEEN 565000 AND 600000)")
def outside_box(t):
    from rivulet.operators import pixels

    return pixels.outside_box(nodes(t).select("node", "easting", "northing"), "easting", "northing", (505000.0, 565000.0, 550000.0, 600000.0))


@query(
    "b28_b29_pixel_coordinates",
    f"""WITH {NODES} SELECT node, CAST(least(greatest(round_even((easting - 500000) / 30, 0), 0), 1799) AS BIGINT) AS col, CAST(least(greatest(round_even((northing - 610000) / -30, 0), 0), 1499) AS BIGINT) AS "row",
  {s6('2 * (easting - 500000) / 60000 - 1')} AS x_norm, {s6('-(2 * (northing - 560000) / 50000 - 1)')} AS y_norm FROM nodes""",
)
def pixel_coordinates(t):
    e, n = F.col("easting"), F.col("northing")
    return nodes(t).select(
        "node", X.pixel_index(e, 500000.0, 30.0, 1800).alias("col"), X.pixel_index(n, 610000.0, -30.0, 1500).alias("row"),
        r6(X.raster_coordinate(e, F.lit(500000.0), F.lit(560000.0))).alias("x_norm"), r6(X.raster_coordinate(n, F.lit(560000.0), F.lit(610000.0), inverted=True)).alias("y_norm"))


@query(
    "b30_datum_and_range",
    f"""WITH {NODES}, o AS (SELECT node, datum + 2 AS elev FROM nodes WHERE is_reservoir), j AS (SELECT n.node, coalesce(elev, datum) AS d, CASE WHEN elev IS NOT NULL THEN 1.5::DOUBLE ELSE p90 - datum - 0.5 END AS r FROM nodes n LEFT JOIN o USING (node))
SELECT node, d AS datum, {s6('CASE WHEN r > 0.01 THEN r ELSE 1 END')} AS stage_range FROM j""",
)
def datum_and_range(t):
    n = nodes(t)
    o = n.where("is_reservoir").select("node", (F.col("datum") + 2).alias("elev"))
    return _round(graph.datum_and_range(n.withColumn("p90", F.col("p90") - 0.5), o), "stage_range")


# ---------------------------------------------------------------- edge tables
@query("j18_river_edges", f"WITH {NODES}, {EDGES}, k AS (SELECT node FROM nodes WHERE node % 10 <> 7) SELECT src, dst, greatest(dist_km - 1, 0.1) AS dist_km FROM edges WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def river_edges(t):
    e = edges(t).select("src", "dst", (F.col("dist_km") - 1).alias("dist_km"))
    return graph.river_edges(e, nodes(t).where(F.pmod("node", F.lit(10)) != 7))


@query(
    "j18_unknown_edges",
    f"WITH {NODES}, {EDGES}, k AS (SELECT node FROM nodes WHERE node % 10 <> 7) SELECT src, dst, 'src' AS unknown_end FROM edges WHERE src NOT IN (SELECT node FROM k) UNION ALL SELECT src, dst, 'dst' FROM edges WHERE dst NOT IN (SELECT node FROM k)",
)
def unknown_edges(t):
    return graph.unknown_edges(edges(t).select("src", "dst"), nodes(t).where(F.pmod("node", F.lit(10)) != 7))


@query(
    "j17_backwater_edges",
    f"""WITH {NODES}, {EDGES}, nn AS (SELECT *, CASE node % 4 WHEN 0 THEN 'Old Bridge' WHEN 1 THEN 'Mill Br' WHEN 2 THEN 'Brook' ELSE 'Weir' END AS nm FROM nodes),
up AS (SELECT dst AS bridge, arg_min({{'s': src, 'd': dist_km, 'e': elev_drop}}, src) AS u FROM edges GROUP BY 1)
SELECT node AS src, u.s AS dst, nm AS bridge_name, u.d AS dist_km, {s6('1 / (1 + u.s % 4)')} AS area_ratio, {s6('-u.e')} AS elev_drop, 1.0::DOUBLE AS same_tributary, {s6('p90')} AS gate_reference
FROM nn JOIN up ON bridge = node WHERE nm IN ('Old Bridge', 'Mill Br') AND EXISTS (SELECT 1 FROM edges e WHERE e.src = node AND e.dst <> u.s)""",
)
def backwater_edges(t):
    m = F.pmod("node", F.lit(4))
    n = nodes(t).withColumn("name", F.when(m == 0, "Old Bridge").when(m == 1, "Mill Br").when(m == 2, "Brook").otherwise("Weir"))
    e = edges(t).select("src", "dst", "dist_km", "elev_drop", F.col("src").alias("edge_order"), (F.lit(1.0) + F.pmod("src", F.lit(4))).alias("area_ratio"), F.lit(1.0).alias("same_tributary"))
    return _round(graph.backwater_edges(n, e), "area_ratio", "elev_drop", "gate_reference")


TRIB = f"""{NODES}, w AS (SELECT node AS src, lead(node) OVER (PARTITION BY water_body ORDER BY area_km2, node) AS dst, 'intra' AS edge_type FROM nodes),
lst AS (SELECT water_body, arg_max(node, {{'a': area_km2, 'n': node}}) AS src FROM nodes GROUP BY 1),
trib AS (SELECT * FROM w WHERE dst IS NOT NULL UNION ALL SELECT l.src, n_nationkey * 2 AS dst, 'confluence' FROM lst l JOIN nation ON l.water_body = 'water_' || n_nationkey WHERE n_nationkey * 2 IN (SELECT node FROM nodes))"""


def _tributaries(t):
    conf = t.nation.select(F.concat(F.lit("water_"), F.col("n_nationkey")).alias("water_body"), (F.col("n_nationkey") * 2).cast("long").alias("dst"))
    return graph.tributary_edges(nodes(t), conf)


@query("j19_tributary_edges", f"WITH {TRIB} SELECT * FROM trib")
def tributary_edges(t):
    return _tributaries(t)


@query(
    "j20_edge_attributes",
    f"""WITH {TRIB}, j AS (SELECT t.src, t.dst, t.edge_type, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS lp, a.area_km2 AS aa, b.area_km2 AS ab, a.datum AS da, b.datum AS db, abs(b.area_km2 - a.area_km2) / 20 AS along FROM trib t JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst),
h AS (SELECT *, 2 * 6371 * asin(sqrt(least(pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin((radians(lp) - radians(lo)) / 2), 2), 1))) AS line FROM j)
SELECT src, dst, edge_type, {s6("greatest(CASE WHEN edge_type = 'intra' AND along >= line * 0.5 THEN along ELSE line END, 0.1)")} AS dist_km, {s6('(ab + 1) / (aa + 1)')} AS area_ratio, {s6('da - db')} AS elev_drop, CASE WHEN edge_type = 'intra' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS same_tributary FROM h""",
)
def edge_attributes(t):
    n = nodes(t).withColumn("river_cum_km", F.col("area_km2") / 20)
    return _round(graph.edge_attributes(_tributaries(t), n), "dist_km", "area_ratio", "elev_drop")


@query("j21_reservoir_mask", f"WITH {NODES}, {EDGES} SELECT e.src, e.dst, {s6('CASE WHEN a.is_reservoir OR b.is_reservoir THEN 0 ELSE elev_drop END')} AS elev_drop FROM edges e JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst")
def reservoir_mask(t):
    return _round(graph.mask_reservoir_drop(edges(t).select("src", "dst", "elev_drop"), nodes(t)), "elev_drop")


NET = f"""{NODES}, {EDGES}, kd AS (SELECT a.node AS src, b.node AS dst, sqrt(pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2)) / 1000 AS d FROM nodes a JOIN nodes b ON a.node <> b.node),
knn AS (SELECT src, dst, d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM kd) WHERE r <= 4), ov AS (SELECT src, (src * 3 + 1) % (SELECT count(*) FROM nodes) AS dst, 9.5::DOUBLE AS d FROM edges WHERE src % 6 = 0),
al AS (SELECT src, dst, d, 0 AS k FROM ov UNION ALL SELECT src, dst, d, 1 FROM knn UNION ALL SELECT src, dst, dist_km, 2 FROM edges), al2 AS (SELECT * FROM al UNION ALL SELECT dst, src, d, k FROM al),
b AS (SELECT src, dst, min({{'k': k, 'd': d}}) FILTER (WHERE k < 2) AS base, min(d) FILTER (WHERE k = 2) AS rv FROM al2 WHERE src <> dst GROUP BY 1, 2),
net AS (SELECT src, dst, CASE WHEN base IS NULL OR rv < base.d THEN rv ELSE base.d END AS dist_km, CASE WHEN base IS NULL OR rv < base.d THEN 'river' WHEN base.k = 0 THEN 'overland' ELSE 'neighbour' END AS edge_class FROM b)"""


def _network(t):
    n = nodes(t)
    size = n.agg(F.count(F.lit(1))).scalar()
    over = edges(t).where(F.pmod("src", F.lit(6)) == 0).withColumn("_n", size).select("src", F.pmod(F.col("src") * 3 + 1, F.col("_n")).alias("dst"), F.lit(9.5).alias("dist_km"))
    knn = joins.k_nearest(n, 4).select("src", "dst", (F.col("dist") / 1000).alias("dist_km"))
    return graph.network_edges(over, knn, edges(t).select("src", "dst", "dist_km"))


@query("g2_network_edges", f"WITH {NET} SELECT src, dst, {s6('dist_km')} AS dist_km, edge_class FROM net")
def network_edges(t):
    return _round(_network(t), "dist_km")


BIDIR = f"""{NODES}, {EDGES}, bi AS (SELECT src, dst, dist_km FROM edges WHERE src <> dst UNION ALL SELECT dst, src, dist_km FROM edges WHERE src <> dst)"""
DIST = f"""WITH RECURSIVE {BIDIR}, walk(src, dst, d) AS (SELECT src, dst, dist_km FROM bi WHERE dist_km <= 25 UNION SELECT w.src, b.dst, w.d + b.dist_km FROM walk w JOIN bi b ON b.src = w.dst WHERE w.d + b.dist_km <= 25 AND b.dst <> w.src),
sp AS (SELECT src, dst, min(d) AS dist_km FROM walk GROUP BY 1, 2)"""


def _distances(t, cutoff=25.0):
    e = edges(t).select("src", "dst", "dist_km")
    return graph.shortest_distances(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_km")), cutoff)


@query("g1_shortest_distances", f"{DIST} SELECT * FROM sp")
def shortest_distances(t):
    return _distances(t)


@query(
    "j22_edge_features",
    f"""{DIST} SELECT s.src, s.dst, s.dist_km, {s6('a.datum - b.datum')} AS elev_diff_m, {s6('a.p90 - b.p90')} AS hand_diff_m FROM sp s JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE dist_km <= 18""",
)
def edge_features(t):
    n = nodes(t).select("node", F.col("datum").alias("elev"), F.col("p90").alias("hand"))
    return _round(graph.edge_features(_distances(t), n, 18.0), "elev_diff_m", "hand_diff_m")


COMP = f"""WITH RECURSIVE {NODES}, ce AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey >= 1), bi AS (SELECT src, dst FROM ce WHERE src <> dst UNION SELECT dst, src FROM ce WHERE src <> dst),
rc(node, at) AS (SELECT node, node FROM nodes UNION SELECT r.node, b.dst FROM rc r JOIN bi b ON b.src = r.at)"""


def _broken_edges(t):
    return edges(t).where(F.pmod("src", F.lit(5)) != 0).select("src", "dst")


@query("g3_components", f"{COMP} SELECT node, min(at) AS component FROM rc GROUP BY 1".replace("(node, at)", "(node, pos)").replace("min(at)", "min(pos)").replace("r.at", "r.pos"))
def components(t):
    return graph.connected_components(_broken_edges(t), nodes(t))


@query("g3_isolated_nodes", f"WITH {NODES}, {EDGES}, ce AS (SELECT e.src, e.dst FROM edges e JOIN supplier ON s_suppkey = e.src WHERE s_acctbal >= 0) SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM ce UNION SELECT dst FROM ce)")
def isolated_nodes(t):
    """Nodes that no edge touches, an edge being there while the account of its upper end is not overdrawn."""
    there = t.supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("src"))
    return graph.isolated_nodes(edges(t).join(there, "src", "left_semi"), nodes(t)).select("node")


REACH = f"""WITH RECURSIVE {NODES}, {EDGES}, en AS (SELECT src, dst, CASE WHEN src % 3 = 0 THEN NULL ELSE src % 4 END AS lag FROM edges),
walk(source, src, dst, hop, lag_steps, gain) AS (SELECT src, src, dst, 1, coalesce(lag, 2), 0.75::DOUBLE FROM en WHERE src <> dst
UNION ALL SELECT w.source, e.src, e.dst, w.hop + 1, w.lag_steps + coalesce(e.lag, 2), w.gain * 0.75::DOUBLE FROM walk w JOIN en e ON e.src = w.dst AND e.dst <> e.src WHERE w.hop < 1000)"""


def _reach(t):
    e = edges(t).select("src", "dst", F.col("src").alias("edge_order"), F.when(F.pmod("src", F.lit(3)) != 0, F.pmod("src", F.lit(4))).alias("lag"))
    return graph.downstream_edges(nodes(t), e, max_hops=None, lag="lag")


@query("g4_downstream_edges", f"{REACH} SELECT source, src, dst, hop, lag_steps, gain FROM walk")
def downstream_edges(t):
    return _reach(t)


@query("g5_criticality", f"{REACH} SELECT node, count(DISTINCT dst) AS n_downstream FROM nodes LEFT JOIN walk ON source = node GROUP BY 1")
def criticality(t):
    return graph.criticality(nodes(t), _reach(t))


@query("g6_headwaters", f"WITH {NODES} SELECT node, {s6('area_km2')} AS area_km2 FROM nodes WHERE NOT is_tidal AND NOT is_reservoir ORDER BY nodes.area_km2, node LIMIT 6")
def headwaters(t):
    return _round(graph.headwaters(nodes(t)).select("node", "area_km2"), "area_km2")


@query("g6_downstream_nodes", f"{REACH} SELECT node, {s6('area_km2')} AS area_km2 FROM nodes WHERE NOT is_reservoir AND node IN (SELECT dst FROM walk) ORDER BY nodes.area_km2 DESC, node LIMIT 5")
def downstream_nodes(t):
    return _round(graph.downstream_nodes(nodes(t), 5, _reach(t)).select("node", "area_km2"), "area_km2")


@query(
    "g7_route_signal",
    f"""{REACH}, sig AS (SELECT user_id % 100 AS node, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT w.dst AS node, s.ts + w.lag_steps * INTERVAL 15 MINUTE AS ts, sum(s.v * w.gain) AS routed FROM sig s JOIN walk w ON w.source = s.node GROUP BY 1, 2)
SELECT node, ts, {s6('routed')} AS routed FROM m""",
)
def route_signal(t):
    sig = timegrid.resample(t.events.select(F.pmod("user_id", F.lit(100)).alias("node"), "ts", "value"), how="sum", keys=("node",))
    return _round(graph.route_signal(sig, _reach(t)), "routed")


@query(
    "g8_unit_response",
    f"""WITH {SLOTS}, rain AS (SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(value) AS v FROM readings GROUP BY 1, 2),
pm AS (SELECT series_id, 0.01::DOUBLE * length(series_id) AS pr, 0.5::DOUBLE + length(series_id) * 1.5::DOUBLE AS tc FROM series), k AS (SELECT *, greatest(CAST(round_even(0.6::DOUBLE * tc * 4, 0) AS INTEGER), 1) AS rise, greatest(CAST(round_even(2.67::DOUBLE * tc * 4, 0) AS INTEGER), 2) AS base FROM pm),
u AS (SELECT series_id, i, pr * CASE WHEN i < rise THEN i / rise ELSE (base - i) / (base - rise) END AS h FROM k, generate_series(0, 400) g(i) WHERE i < greatest(rise, base))
SELECT r.series_id, r.ts + u.i * INTERVAL 15 MINUTE AS ts, {s6('sum(r.v * u.h)')} AS response FROM rain r JOIN u USING (series_id) WHERE r.v <> 0 GROUP BY 1, 2""",
)
def unit_response(t):
    rain = timegrid.resample(readings(t), how="sum")
    n = F.length("series_id")
    params = readings(t).select("series_id").distinct().select("series_id", (F.lit(0.01) * n).alias("peak_rate"), (F.lit(0.5) + n * 1.5).alias("tc_hours"))
    return _round(graph.unit_response(rain, params), "response")

