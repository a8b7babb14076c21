"""Flow routing, inundation, SAR masks and map scores over the raster of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import joins, pixels as px, quality
from rivulet.plans.fixpoint import cut

from .base import FLOOD_LABELS, NODES, PIXELS, flood_labels, nodes, pixels, query, r6, s6


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


FLOW = f"""{PIXELS}, nb AS (SELECT p."row" AS r, p.col AS c, o.dr, o.dc, (p.elev - q.elev) / o.d AS slope, o.o FROM pixels p, (VALUES (-1, -1, 1.4142::DOUBLE, 0), (-1, 0, 1.0, 1), (-1, 1, 1.4142, 2), (0, -1, 1.0, 3), (0, 1, 1.0, 4), (1, -1, 1.4142, 5), (1, 0, 1.0, 6), (1, 1, 1.4142, 7)) o(dr, dc, d, o)
  JOIN pixels q ON q."row" = p."row" + o.dr AND q.col = p.col + o.dc), b AS (SELECT r, c, arg_min({{'dr': dr, 'dc': dc}}, {{'s': -slope, 'o': o}}) AS w, max(slope) AS slope FROM nb WHERE slope > 0 GROUP BY 1, 2),
flow AS (SELECT p."row" AS r, p.col AS c, w.dr AS dr, w.dc AS dc, slope FROM pixels p LEFT JOIN b ON b.r = p."row" AND b.c = p.col),
down(r0, c0, r, c) AS (SELECT r, c, r, c FROM flow UNION ALL SELECT d.r0, d.c0, d.r + f.dr, d.c + f.dc FROM down d JOIN flow f ON f.r = d.r AND f.c = d.c WHERE f.dr IS NOT NULL),
acc AS (SELECT r, c, count(*) AS accumulation FROM down GROUP BY 1, 2),
streams AS (SELECT * FROM acc WHERE accumulation >= CASE WHEN (SELECT max(accumulation) FROM acc) >= LIMIT_CELLS THEN LIMIT_CELLS ELSE 0.9::DOUBLE * (SELECT max(accumulation) FROM acc) END)"""


def _flow(t):
    return px.flow_direction(pixels(t).select("row", "col", "elev"))


def _acc(t):
    return px.flow_accumulation(_flow(t))


def _sql(body, limit=60):
    return f"WITH RECURSIVE {FLOW.replace('LIMIT_CELLS', str(limit))} {body}"


@query("g9_flow_direction", _sql(f'SELECT r AS "row", c AS col, dr, dc, {s6("slope")} AS slope FROM flow'))
def flow_direction(t):
    return _round(_flow(t), "slope")


@query("g10_flow_accumulation", _sql('SELECT r AS "row", c AS col, accumulation FROM acc'))
def flow_accumulation(t):
    return _acc(t)


@query("g12_stream_cells", _sql('SELECT r AS "row", c AS col, accumulation FROM streams'))
def stream_cells(t):
    return px.stream_cells(_acc(t), 60)


@query("g12_stream_fallback", _sql('SELECT r AS "row", c AS col, accumulation FROM streams', 10**7))
def stream_fallback(t):
    return px.stream_cells(_acc(t), 10**7)


@query(
    "g11_hand",
    _sql(f"""SELECT p."row", p.col, CASE WHEN s.elev IS NOT NULL THEN {s6('greatest(p.elev - s.elev, 0)')} END AS hand FROM pixels p LEFT JOIN (SELECT d.r0, d.c0, max(q.elev) AS elev FROM down d JOIN streams s ON s.r = d.r AND s.c = d.c JOIN pixels q ON q."row" = d.r AND q.col = d.c GROUP BY 1, 2) s ON s.r0 = p."row" AND s.c0 = p.col"""),
)
def hand(t):
    """The first stream cell on a descending path is the highest one on it."""
    flow = cut(_flow(t))
    return _round(px.height_above_drainage(pixels(t), flow, px.stream_cells(px.flow_accumulation(flow), 60)), "hand")


SPOTS = """spots AS (SELECT s_suppkey AS node, (s_suppkey * 31) % 130 AS r, (s_suppkey * 17) % 128 AS c FROM supplier)"""


def _spots(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("node"), F.pmod(k * 31, F.lit(130)).alias("row"), F.pmod(k * 17, F.lit(128)).alias("col"))


@query(
    "g13_catchments",
    _sql(f"""SELECT f.r AS "row", f.c AS col, coalesce(m.node, n.node) AS node, CASE WHEN m.node IS NOT NULL THEN 'flow' WHEN n.node IS NOT NULL THEN 'nearest' END AS assigned_by FROM flow f
LEFT JOIN (SELECT r0, c0, arg_max(node, {{'z': z, 'n': -node}}) AS node FROM (SELECT d.r0, d.c0, s.node, p.elev AS z FROM down d JOIN spots s ON s.r = d.r AND s.c = d.c JOIN pixels p ON p."row" = d.r AND p.col = d.c) GROUP BY 1, 2) m ON m.r0 = f.r AND m.c0 = f.c
LEFT JOIN (SELECT p."row" AS r, p.col AS c, arg_min(s.node, {{'d': sqrt(pow(CAST(p."row" - s.r AS DOUBLE), 2) + pow(CAST(p.col - s.c AS DOUBLE), 2)), 'n': s.node}}) AS node FROM pixels p JOIN spots s ON sqrt(pow(CAST(p."row" - s.r AS DOUBLE), 2) + pow(CAST(p.col - s.c AS DOUBLE), 2)) <= 12 GROUP BY 1, 2) n ON n.r = f.r AND n.c = f.c""").replace("down(r0", SPOTS + ", down(r0"),
)
def catchments(t):
    flow = cut(_flow(t))
    s = _spots(t).withColumns({"y": F.col("row").cast("double"), "x": F.col("col").cast("double")})
    pts = flow.select("row", "col", F.col("row").cast("double").alias("y"), F.col("col").cast("double").alias("x"))
    near = joins.nearest_within(pts, s.select("node", "y", "x"), ("y", "x"), "node", 12.0, ("row", "col"))
    return px.catchments(flow, s, near)


# -------------------------------------------------------------- inundation
STG = """stg AS (SELECT user_id % 10 AS node, time_bucket(INTERVAL 6 HOUR, ts) AS ts, CAST(date_part('day', min(ts)) AS INTEGER) AS event_id, max(value) / 60 AS obs, avg(value) / 30 AS pred, 1.5::DOUBLE AS bankfull FROM events GROUP BY 1, 2)"""


def _stages(t):
    q = 6 * 3_600_000_000
    from rivulet.plans.timechunks import fdiv, from_micros, micros

    e = t.events.select(F.pmod("user_id", F.lit(10)).alias("node"), from_micros(fdiv(micros("ts"), q) * q).alias("ts"), F.col("ts").alias("_at"), "value")
    return e.groupBy("node", "ts").agg(F.dayofmonth(F.min("_at")).alias("event_id"), (F.max("value") / 60).alias("obs"), (F.avg("value") / 30).alias("pred"), F.lit(1.5).alias("bankfull"))


def _node_pixels(t):
    return pixels(t).select("row", "col", F.pmod("tag", F.lit(10)).alias("node"), "hand")


@query("g14_inundation", f"""WITH {PIXELS}, {STG} SELECT DISTINCT s.ts, p."row", p.col FROM stg s JOIN pixels p ON p.tag % 10 = s.node WHERE s.obs >= 4.5 AND p.hand <= s.obs""")
def inundation(t):
    st = _stages(t).select("node", "ts", F.col("obs").alias("stage"), F.lit(4.5).alias("bankfull"))
    return px.inundation(_node_pixels(t), st)


@query("g14_inundation_fixed", f"""WITH {PIXELS}, {STG} SELECT DISTINCT s.ts, p."row", p.col FROM stg s JOIN pixels p ON p.tag % 10 = s.node WHERE s.obs >= 4.5 AND p.hand <= 1.0""")
def inundation_fixed(t):
    st = _stages(t).select("node", "ts", F.col("obs").alias("stage"), F.lit(4.5).alias("bankfull"))
    return px.inundation(_node_pixels(t), st, fixed_hand=1.0)


@query("g14_inundation_spans", f"""WITH {PIXELS}, {STG}, w AS (SELECT DISTINCT s.ts, p."row", p.col FROM stg s JOIN pixels p ON p.tag % 10 = s.node WHERE s.obs >= 4.5 AND p.hand <= s.obs),
i AS (SELECT *, ts - row_number() OVER (PARTITION BY "row", col ORDER BY ts) * INTERVAL 6 HOUR AS g FROM w) SELECT "row", col, min(ts) AS wet_from, max(ts) AS wet_to FROM i GROUP BY "row", col, g""")
def inundation_spans(t):
    st = _stages(t).select("node", "ts", F.col("obs").alias("stage"), F.lit(4.5).alias("bankfull"))
    return px.inundation_spans(_node_pixels(t), st, 6 * 3_600_000_000)


@query(
    "g19_inundated_area",
    f"""WITH {PIXELS}, {STG}, k AS (SELECT DISTINCT event_id, ts FROM stg), h AS (SELECT tag % 10 AS node, hand FROM pixels),
a AS (SELECT s.event_id, s.ts, count(*) FILTER (WHERE s.pred >= bankfull AND hand <= s.pred) AS np, count(*) FILTER (WHERE s.obs >= bankfull AND hand <= s.obs) AS no FROM k JOIN stg s USING (event_id, ts) JOIN h USING (node) GROUP BY 1, 2)
SELECT event_id, ts, {s6('coalesce(np, 0) * 0.0009')} AS area_pred_km2, {s6('coalesce(no, 0) * 0.0009')} AS area_obs_km2 FROM k LEFT JOIN a USING (event_id, ts)""",
)
def inundated_area(t):
    st = _stages(t)
    return _round(px.inundated_area(_node_pixels(t), st, 0.0009), "area_pred_km2", "area_obs_km2")


@query(
    "g15_flood_probability",
    f"""WITH {PIXELS}, s AS (SELECT s_suppkey AS node, 0.5::DOUBLE + (s_suppkey % 5) * 0.2::DOUBLE AS tau, s_acctbal / 3000 AS stage FROM supplier), c AS (SELECT p.*, s.tau, s.stage FROM pixels p JOIN s ON s.node = p.tag % 20 UNION ALL SELECT p.*, s.tau, s.stage FROM pixels p JOIN s ON s.node = 20 + p.tag % 7)
SELECT "row", col, {s6('least(sum(1 / (1 + exp(-(tau * stage - hand) / 2))) / (count(*) + 1e-8), 1)')} AS flood_prob FROM c GROUP BY 1, 2""",
)
def flood_probability(t):
    s = t.supplier.select(F.col("s_suppkey").alias("node"), (F.pmod("s_suppkey", F.lit(5)) * 0.2 + 0.5).alias("tau"), (F.col("s_acctbal") / 3000).alias("stage"))
    p = pixels(t)
    cover = p.select("row", "col", "hand", F.explode(F.array(F.pmod("tag", F.lit(20)), F.pmod("tag", F.lit(7)) + 20)).alias("node"))
    return _round(px.flood_probability(cover, s), "flood_prob")


# --------------------------------------------------------------- SAR masks
@query(
    "g16_sar_change_mask",
    f"""WITH {PIXELS}, m AS (SELECT median(sigma0) - median(sigma0_ref) AS off FROM pixels WHERE sigma0 <> 0 AND sigma0_ref <> 0)
SELECT "row", col, {s6('sigma0 - sigma0_ref - off')} AS change FROM pixels, m WHERE sigma0 <> 0 AND sigma0_ref <> 0 AND (sigma0 - sigma0_ref - off < -3 OR sigma0 < -15)""",
)
def sar_change_mask(t):
    return _round(px.sar_change_mask(pixels(t)).select("row", "col", "change"), "change")


BLOCKS = f"""{PIXELS}, mask AS (SELECT "row" AS r, col AS c FROM pixels WHERE ("row" // 12 + col // 10) % 2 = 0 AND tag % 60 <> 0 OR tag % 4 = 0)"""


def _mask(t):
    return pixels(t).where("((floor(row / 12) + floor(col / 10)) % 2 = 0 and tag % 60 <> 0) or tag % 4 = 0").select("row", "col")


OPEN = f"""{BLOCKS}, er AS (SELECT m.r, m.c FROM mask m JOIN mask n ON n.r BETWEEN m.r - 2 AND m.r + 2 AND n.c BETWEEN m.c - 2 AND m.c + 2 GROUP BY 1, 2 HAVING count(*) = 25),
op AS (SELECT DISTINCT r + i AS r, c + j AS c FROM er, generate_series(-2, 2) a(i), generate_series(-2, 2) b(j))"""


@query("g17_opening", f'WITH {OPEN} SELECT r AS "row", c AS col FROM op')
def opening(t):
    return px.opening(_mask(t))


PATCH = f"""WITH RECURSIVE {OPEN}, cl AS (SELECT r, c, r * 100000 + c AS id FROM op), ed AS (SELECT a.id AS a, b.id AS b FROM cl a JOIN cl b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
fill(id, seed) AS (SELECT id, id FROM cl UNION SELECT e.b, f.seed FROM fill f JOIN ed e ON e.a = f.id),
sz AS (SELECT id, count(*) AS patch_size FROM fill GROUP BY 1)"""


@query("g18_drop_small_patches", f'{PATCH} SELECT r AS "row", c AS col, patch_size FROM cl JOIN sz USING (id) WHERE patch_size >= 100')
def drop_small_patches(t):
    return px.drop_small_patches(px.opening(_mask(t)), 100)


DARK = PATCH.replace("\"row\" // 12 + col // 10) % 2 = 0 AND tag % 60 <> 0 OR tag % 4 = 0)", "\"row\" // 12 + col // 10) % 2 = 0 AND tag % 60 <> 0)")


@query("g16_sar_flood_mask", f'{DARK} SELECT r AS "row", c AS col, patch_size FROM cl JOIN sz USING (id) JOIN pixels p ON p."row" = r AND p.col = c WHERE patch_size >= 50 AND hand <= 5')
def sar_flood_mask(t):
    p = pixels(t)
    dark = F.expr("(floor(row / 12) + floor(col / 10)) % 2 = 0 and tag % 60 <> 0")
    return px.sar_flood_mask(p.withColumn("sigma0", F.when(dark, F.lit(-22.0)).otherwise(F.lit(-8.0))).withColumn("sigma0_ref", F.lit(-9.0)), max_hand=5.0)


# ------------------------------------------------------------------ scores
CONF = "count(*) FILTER (WHERE pred AND obs) AS tp, count(*) FILTER (WHERE pred AND NOT obs) AS fp, count(*) FILTER (WHERE NOT pred AND obs) AS fn, count(*) FILTER (WHERE NOT pred AND NOT obs) AS tn"
MAPS = f"""{s6('tp / (tp + fp + fn)')} AS csi, {s6('tp / (tp + fn)')} AS hit_rate, {s6('fp / (tp + fp)')} AS far, {s6('(tp + fp) / (tp + fn)')} AS bias, {s6('2 * tp / (2 * tp + fp + fn)')} AS f1, {s6('(tp + fp) * 0.0009')} AS pred_km2, {s6('(tp + fn) * 0.0009')} AS obs_km2"""
RATIOS = ("csi", "hit_rate", "far", "bias", "f1", "pred_km2", "obs_km2")


@query("k56_map_scores", f"WITH {FLOOD_LABELS}, c AS (SELECT {CONF} FROM labels2 WHERE mask) SELECT *, {MAPS} FROM c")
def map_scores(t):
    return _round(px.map_scores(flood_labels(t), 0.0009, mask="mask"), *RATIOS)


@query("k56_joined_maps", f"WITH {FLOOD_LABELS}, c AS (SELECT {CONF} FROM labels2 WHERE pred OR obs) SELECT *, {MAPS} FROM c")
def joined_maps(t):
    f = flood_labels(t)
    return _round(px.map_scores(px.join_maps(f.where("pred"), f.where("obs")), 0.0009), *RATIOS)


@query(
    "k57_probability_scores",
    f"WITH {FLOOD_LABELS}, c AS (SELECT count(*) FILTER (WHERE prob >= 0.5 AND obs) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND NOT obs) AS fp, count(*) FILTER (WHERE NOT prob >= 0.5 AND obs) AS fn FROM labels2) SELECT *, {s6('tp / (tp + fp + fn + 1e-8)')} AS csi, {s6('tp / (tp + fp + 1e-8)')} AS precision, {s6('tp / (tp + fn + 1e-8)')} AS recall FROM c",
)
def probability_scores(t):
    return _round(px.probability_scores(flood_labels(t)), "csi", "precision", "recall")


LEVELS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
SWEEP = f"""{FLOOD_LABELS}, sw AS (SELECT threshold, hand <= threshold AS pred, (tag + "row") % 3 = 0 AS obs FROM pixels, (VALUES {', '.join(f'({x}::DOUBLE)' for x in LEVELS)}) v(threshold)), c AS (SELECT threshold, {CONF} FROM sw GROUP BY 1)"""


def _sweep(t):
    p = pixels(t).select("hand", (F.pmod(F.col("tag") + F.col("row"), F.lit(3)) == 0).alias("obs"))
    return px.threshold_sweep(p, LEVELS, 0.0009)


@query("k58_threshold_sweep", f"WITH {SWEEP} SELECT *, {MAPS} FROM c")
def threshold_sweep(t):
    return _round(_sweep(t), *RATIOS)


@query("k58_best_threshold", f"WITH {SWEEP} SELECT threshold, {s6('tp / (tp + fp + fn)')} AS csi FROM c ORDER BY tp / (tp + fp + fn) DESC, threshold LIMIT 1")
def best_threshold(t):
    return _round(px.best_threshold(_sweep(t)), "csi")


@query("k59_design_extent", f"""WITH {FLOOD_LABELS}, c AS (SELECT count(*) AS n_pred, count(*) FILTER (WHERE col < 100) AS n_inside FROM labels2 WHERE pred) SELECT *, {s6('n_inside / n_pred')} AS share_inside, CASE WHEN n_inside / n_pred >= 0.8 THEN 'plausible' ELSE 'check' END AS verdict FROM c""")
def design_extent(t):
    f = flood_labels(t)
    return _round(px.design_extent_check(f.where("pred").select("row", "col"), f.where("col < 100").select("row", "col")), "share_inside")


# ---------------------------------------------------------------- products
@query(
    "k50_raster_qc",
    f"""WITH {PIXELS}, b AS (SELECT tag % 3 AS band, CASE WHEN tag % 13 > 0 THEN sigma0 END AS v FROM pixels)
SELECT band, {s6('avg(v)')} AS mean, {s6('stddev_pop(v)')} AS std, {s6('count(v) / count(*)')} AS valid_frac, {s6('count(*) FILTER (WHERE v < -16) / count(v)')} AS dark_frac, {s6('quantile_cont(v, 0.05)')} AS p5, {s6('quantile_cont(v, 0.95)')} AS p95 FROM b GROUP BY 1""",
)
def raster_qc(t):
    b = pixels(t).select(F.pmod("tag", F.lit(3)).alias("band"), F.when(F.pmod("tag", F.lit(13)) > 0, F.col("sigma0")).alias("v"))
    return _round(px.raster_qc(b, "v", ("band",)), "mean", "std", "valid_frac", "dark_frac", "p5", "p95")


@query("k51_envelope", f"WITH {NODES} SELECT floor((min(easting) - 5000) / 100) * 100 AS x_min, floor((min(northing) - 5000) / 100) * 100 AS y_min, ceil((max(easting) + 5000) / 100) * 100 AS x_max, ceil((max(northing) + 5000) / 100) * 100 AS y_max FROM nodes")
def envelope(t):
    return px.envelope(nodes(t), "easting", "northing")


@query(
    "b31_footprint_overlap",
    f"""WITH {NODES}, b AS (SELECT water_body, min(lon) AS x_min, max(lon) AS x_max, min(lat) AS y_min, max(lat) AS y_max FROM nodes GROUP BY 1)
SELECT water_body, {s6('x_min')} AS x_min, {s6('x_max')} AS x_max, {s6('y_min')} AS y_min, {s6('y_max')} AS y_max, x_min < -8.4 AND x_max > -8.805 AND y_min < 50.805 AND y_max > 50.305 AS overlaps FROM b""",
)
def footprint_overlap(t):
    return _round(px.footprint_overlap(nodes(t), "water_body", (-8.805, 50.305, -8.4, 50.805)), "x_min", "x_max", "y_min", "y_max")


IMAGES = """images AS (SELECT l_orderkey // 128 AS "row", l_orderkey % 128 AS col, l_linenumber AS image, l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 1000 - 60 END AS v FROM lineitem)"""


def _images(t):
    return t.lineitem.select(
        F.floor(F.col("l_orderkey") / 128).alias("row"), F.pmod("l_orderkey", F.lit(128)).alias("col"), F.col("l_linenumber").alias("image"), "l_returnflag",
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / 1000 - 60).alias("v"))


@query("k52_median_composite", f'WITH {IMAGES} SELECT "row", col, {s6("median(v)")} AS composite, count(v) AS n_images FROM images GROUP BY 1, 2')
def median_composite(t):
    return _round(px.median_composite(_images(t), "v"), "composite")


EVMAP = "em AS (SELECT DISTINCT l_returnflag AS event, l_linenumber AS image FROM lineitem WHERE (l_returnflag = 'A' AND l_linenumber <= 3) OR (l_returnflag = 'R' AND l_linenumber >= 3))"


def _event_images(t):
    li = t.lineitem
    em = li.where("(l_returnflag = 'A' and l_linenumber <= 3) or (l_returnflag = 'R' and l_linenumber >= 3)").select(F.col("l_returnflag").alias("event"), F.col("l_linenumber").alias("image")).distinct()
    return px.median_composite(_images(t).join(em, "image"), "v", ("event",))


@query("k53_event_composite", f'WITH {IMAGES}, {EVMAP} SELECT event, "row", col, {s6("median(v)")} AS composite, count(v) AS n_images FROM images JOIN em USING (image) GROUP BY 1, 2, 3')
def event_composite(t):
    return _round(_event_images(t), "composite")


@query("k52_composite_coverage", f'WITH {IMAGES}, {EVMAP}, c AS (SELECT event, "row", col, median(v) AS m FROM images JOIN em USING (image) GROUP BY 1, 2, 3) SELECT event, {s6("avg(CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * 100")} AS coverage_pct, count(*) AS n_pixels FROM c GROUP BY 1')
def composite_coverage(t):
    return _round(px.composite_coverage(_event_images(t), ("event",)), "coverage_pct")


@query(
    "c23_raster_checks",
    f"""WITH {PIXELS}, r AS (SELECT 'bands' AS rule, CAST(count(DISTINCT tag % 2) AS DOUBLE) AS value, count(DISTINCT tag % 2) = 2 AS ok FROM pixels UNION ALL SELECT 'nulls', CAST(count(*) FILTER (WHERE sigma0 IS NULL) AS DOUBLE), count(*) FILTER (WHERE sigma0 IS NULL) = 0 FROM pixels
UNION ALL SELECT 'min_db', min(sigma0), min(sigma0) >= -15 FROM pixels UNION ALL SELECT 'max_db', max(sigma0), max(sigma0) <= 10 FROM pixels)
SELECT rule, {s6('value')} AS value, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status FROM r""",
)
def raster_checks(t):
    p = pixels(t).withColumn("band", F.pmod("tag", F.lit(2)))
    rules = {
        "bands": (F.count_distinct("band"), F.col("bands") == 2), "nulls": (F.count_if(F.col("sigma0").isNull()), F.col("nulls") == 0),
        "min_db": (F.min("sigma0"), F.col("min_db") >= -15), "max_db": (F.max("sigma0"), F.col("max_db") <= 10)}
    return _round(quality.check_rules(p, rules), "value")

