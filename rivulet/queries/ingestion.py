"""Sources, catalogues, text rules and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.functions import labels as L
from rivulet.operators import catalogue, profiles
from rivulet.sources import ingest, sinks
from rivulet.streaming import follow

from .base import FORECAST, READINGS, SLOTS, forecast, grid, query, r6, readings, s6


def _round(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# ------------------------------------------------------------ reading files
def reading_lines(t):
    """One text line per event: every 41st timestamp is broken, some values are no numbers, some codes are missing."""
    e = t.events
    ts = F.when(F.pmod("event_id", F.lit(41)) == 0, "not-a-time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    val = F.when(F.pmod("event_id", F.lit(17)) == 0, "---").otherwise(F.col("value").cast("string"))
    code = F.when(F.pmod("event_id", F.lit(13)) == 0, "").otherwise(F.get_json_object("props", "$.k"))
    return e.select(F.concat_ws(";", ts, val, code, F.lit("x")).alias("value"), F.concat(F.lit("/raw/level_"), F.col("event_type"), F.lit(".csv")).alias("path"), "event_type")


PARSED = """SELECT event_type AS series_id, 'KIND' AS kind, date_trunc('milliseconds', ts) AS ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS quality_code FROM events WHERE event_id % 41 <> 0"""


@query("a1_parse_level_lines", PARSED.replace("KIND", "level"))
def parse_level_lines(t):
    return ingest.parse_readings(reading_lines(t), "level")


def _written(t, name):
    """The reading lines as text files, one folder per station, below the shared scratch folder."""
    path = ingest.shared_scratch(t.spark, name)
    lines = reading_lines(t)
    head = t.events.select("event_type").distinct().select(F.concat(F.lit("#station;"), F.col("event_type")).alias("value"), "event_type")
    lines.select("value", "event_type").unionByName(head).write.partitionBy("event_type").text(path)
    return ingest.read_lines(t.spark, path), F.regexp_extract("path", r"event_type=([^/]+)/", 1)


@query("a2_discharge_files", PARSED.replace("KIND", "discharge"))
def discharge_files(t):
    lines, station = _written(t, "discharge")
    return ingest.parse_readings(lines, "discharge", station)


@query("a3_rain_files", PARSED.replace("KIND", "rainfall"))
def rain_files(t):
    lines, station = _written(t, "rain")
    return ingest.parse_readings(lines, "rainfall", station)


@query("a2_followed_files", PARSED.replace("KIND", "discharge"))
def followed_files(t):
    """The discharge files again, followed as a stream in two catch-ups: the files of half the stations come after the first."""
    root = ingest.shared_scratch(t.spark, "followed")
    lines = reading_lines(t)
    first = F.col("event_type") < "m"
    for part in (first, ~first):
        lines.where(part).select("value", "event_type").write.mode("append").partitionBy("event_type").text(f"{root}/files")
        stream = follow.reading_stream(t.spark, f"{root}/files", "discharge", F.regexp_extract("path", r"event_type=([^/]+)/", 1), late="10000 days")
        follow.catch_up(stream, f"{root}/table", f"{root}/progress")
    return t.spark.read.parquet(f"{root}/table").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("a1_header_lines", "SELECT DISTINCT event_type AS series_id, 'station' AS key, event_type AS val FROM events")
def header_lines(t):
    lines, station = _written(t, "header")
    return ingest.parse_header(lines, station)


@query(
    "a8_load_series",
    f"""WITH {READINGS}, m AS (SELECT user_id, date_trunc('minute', ts) AS ts, CASE WHEN quality_code IN (1, 32, 101) THEN NULL ELSE value - 5 END AS value, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY seq) AS rn FROM readings),
c AS (SELECT user_id AS series_id, ts, CASE WHEN value >= 0 THEN value END AS value FROM m WHERE rn = 1) SELECT series_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, {s6('avg(value)')} AS value FROM c GROUP BY 1, 2""",
)
def load_series(t):
    r = readings(t).select(F.col("user_id").alias("series_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), (F.col("value") - 5).alias("value"), "quality_code", "seq")
    return _round(ingest.load_series(r, "level", freq="1 hour", bad=(1, 32, 101)), "value")


@query("a5_skip_existing", "SELECT DISTINCT c_custkey AS ref FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def skip_existing(t):
    return ingest.skip_existing(t.customer.select(F.col("c_custkey").alias("ref")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("series_id")))


@query("a6_station_subset", "SELECT s_suppkey AS ref, s_suppkey % 13 = 5 AS is_tidal FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.08) AND s_nationkey NOT IN (3, 4) AND s_suppkey % 13 <> 5")
def station_subset(t):
    st = t.supplier.select(F.col("s_suppkey").alias("ref"), (F.pmod("s_suppkey", F.lit(13)) == 5).alias("is_tidal"))
    wanted = t.lineitem.where("l_quantity > 49.5 and l_discount > 0.08").select(F.col("l_suppkey").alias("ref"))
    out = t.supplier.where("s_nationkey in (3, 4)").select(F.col("s_suppkey").alias("ref"))
    return ingest.station_subset(st, wanted, out, skip_tidal=True)


TREE = f"""{FORECAST}, r AS (SELECT model, seed, horizon, count(*) AS n, sum(target) AS total FROM forecast GROUP BY 1, 2, 3),
pn AS (SELECT model, seed, horizon, node, count(*) AS n_valid FROM forecast WHERE seed = 0 OR horizon = 4 GROUP BY ALL)"""


def _tree(t):
    """A record per run as JSON and a table per run as CSV in one model/seed/horizon tree; some runs lack the table."""
    root = ingest.shared_scratch(t.spark, "results")
    keys = ("model", "seed", "horizon")
    runs = forecast(t).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("total"))
    runs.write.mode("append").partitionBy(*keys).json(root)
    per_node = forecast(t).where("seed = 0 or horizon = 4").groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n_valid"))
    per_node.write.mode("append").partitionBy(*keys).option("header", "true").csv(root)
    return ingest.load_tree(t.spark, root, ("*.json", "n long, total double"), ("*.csv", "node long, n_valid long"))


@query(
    "a9_result_tree",
    f"""WITH {TREE} SELECT model, seed, horizon, n, {s6('total')} AS total, n_nodes, n_valid FROM r
JOIN (SELECT model, seed, horizon, count(*) AS n_nodes, CAST(sum(n_valid) AS BIGINT) AS n_valid FROM pn GROUP BY 1, 2, 3) USING (model, seed, horizon)""",
)
def result_tree(t):
    """Complete runs of a tree written and read back: the record and what the node table adds up to."""
    metrics, nodes, _ = _tree(t)
    per_run = nodes.groupBy("model", "seed", "horizon").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_valid").alias("n_valid"))
    return _round(ingest.load_results(metrics, per_run), "total").select("model", "seed", "horizon", "n", "total", "n_nodes", "n_valid")


@query("a9_incomplete_runs", f"WITH {TREE} SELECT DISTINCT model, seed, horizon, true AS has_metrics, false AS has_nodes FROM r WHERE (model, seed, horizon) NOT IN (SELECT (model, seed, horizon) FROM pn)")
def incomplete_runs(t):
    return _tree(t)[2]


@query("a11_wide_export", f"WITH {SLOTS} SELECT ts, " + ", ".join(f"{s6(f'max(value) FILTER (WHERE series_id = {chr(39)}{n}{chr(39)})')} AS {n}" for n in ("click", "error", "purchase", "signup", "view")) + " FROM grid GROUP BY 1")
def wide_export(t):
    names = ("click", "error", "purchase", "signup", "view")
    return _round(sinks.wide_format(grid(t), names), *names)


@query("a13_coverage_record", f'WITH {SLOTS} SELECT series_id, count(*) AS n_steps, min(ts) AS start, max(ts) AS "end", {s6("count(value) / count(*)")} AS coverage FROM grid GROUP BY 1')
def coverage_record(t):
    return _round(sinks.coverage_record(grid(t)), "coverage")


FEATURES = ("stage_anomaly", "normalized_stage", "dh_dt", "discharge_m3s", "rainfall_mm", "swvl1_raw")


@query(
    "a13_provenance_record",
    f"""WITH {SLOTS} SELECT min(ts) AS start_date, max(ts) AS end_date, '15min' AS timestep, count(DISTINCT ts) AS n_timesteps, count(DISTINCT series_id) AS n_nodes, {len(FEATURES)} AS n_features, 4 AS horizon_steps, true AS soil_moisture_active,
  'swvl1,swvl2' AS sm_layers, '7D' AS rolling_window, 8 AS gap_fill_steps, '{','.join(FEATURES)}' AS dynamic_features, 'nearest_neighbour' AS rainfall_assignment_method FROM grid""",
)
def provenance_record(t):
    out = sinks.provenance_record(grid(t), FEATURES, "15min", 4, "7D", 8, ("swvl1", "swvl2"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("sm_layers", "dynamic_features")})


# -------------------------------------------------------------- block files
@query(
    "a14_station_blocks",
    """SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS block_no, CAST(conv_id * 100 + turn AS VARCHAR) AS ref, role AS name, CAST(length(text) AS VARCHAR) AS size FROM conversations""",
)
def station_blocks(t):
    """Every turn of a conversation written as a block of Key<TAB>Value lines, dash lines between them."""
    c = t.conversations
    body = F.concat_ws("\n", F.concat(F.lit("Station Number\t"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")), F.concat(F.lit("Station Name\t"), F.col("role")), F.concat(F.lit("Catchment size\t"), F.length("text").cast("string")), F.lit("-" * 20))
    files = c.groupBy(F.col("conv_id").alias("doc")).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"])).alias("text"))
    blocks = ingest.split_blocks(files, r"(?m)^-{5,}\s*$")
    return ingest.parse_station_blocks(blocks, {"Station Number": "ref", "Station Name": "name", "Catchment size": "size"})


@query("a14_block_files", "SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS ref, role AS name, CAST(length(text) AS VARCHAR) AS size FROM conversations")
def block_files(t):
    """The same blocks as text files that are read back in splits: every record once, wherever a split falls."""
    path, separator = ingest.shared_scratch(t.spark, "stations"), "\n" + "-" * 20 + "\n"
    body = F.concat_ws("\n", F.concat(F.lit("Station Number\t"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")), F.concat(F.lit("Station Name\t"), F.col("role")), F.concat(F.lit("Catchment size\t"), F.length("text").cast("string")))
    sinks.write_blocks(t.conversations.select(body.alias("block")), path, separator)
    blocks = ingest.read_blocks(t.spark, path, separator).select("block")
    return ingest.parse_station_blocks(blocks, {"Station Number": "ref", "Station Name": "name", "Catchment size": "size"})


SECT = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS i FROM lineitem)"""


def _ordered_lines(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return t.lineitem.withColumn("i", F.row_number().over(w) - 1)


def section_files(t):
    """One section file per order: a SECTION block whose points are the order's lines; every ninth line is too short."""
    li = _ordered_lines(t)
    star = F.when(F.col("l_returnflag") == "A", "*").otherwise("")
    point = F.concat_ws(" ", F.col("i").cast("string"), F.col("l_quantity").cast("string"), F.concat(F.lit("0.035"), star), F.lit("0"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    point = F.when(F.pmod("l_partkey", F.lit(9)) == 0, "1 2 3").otherwise(point)
    files = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("i", point.alias("p")))).alias("pts"))
    head = F.concat_ws("\n", F.lit("header"), F.lit("SECTION"), F.concat(F.lit("xs_"), F.col("l_orderkey")), F.when(F.pmod("l_orderkey", F.lit(50)) == 0, "broken").otherwise((F.col("l_orderkey") * 10).cast("string")), F.size("pts").cast("string"))
    return files.select(F.col("l_orderkey").alias("path"), F.concat_ws("\n", head, F.array_join(F.transform("pts", lambda x: x["p"]), "\n")).alias("text"))


def section_blocks(t):
    return ingest.split_blocks(section_files(t), r"(?m)^\s*SECTION\s*\n").where("block_no > 0")


POINTS = f"""{SECT}, pt AS (SELECT l_orderkey AS path, 'xs_' || l_orderkey AS section, l_orderkey * 10.0::DOUBLE AS chainage, CAST(i AS INTEGER) AS i, l_quantity AS level, l_returnflag = 'A' AS panel_boundary, CAST(l_partkey AS DOUBLE) AS coord_e, CAST(l_suppkey AS DOUBLE) AS coord_n FROM li WHERE l_partkey % 9 <> 0 AND l_orderkey % 50 <> 0)"""


@query("a15_section_points", f"WITH {POINTS} SELECT * FROM pt")
def section_points(t):
    return ingest.parse_sections(section_blocks(t)).select("path", "section", "chainage", "i", "level", "panel_boundary", "coord_e", "coord_n")


@query("a15_section_files", f"WITH {POINTS} SELECT section, chainage, i, level, panel_boundary, coord_e, coord_n FROM pt")
def section_points_of_files(t):
    """The sections as text files, SECTION lines between them, read back in splits."""
    path, separator = ingest.shared_scratch(t.spark, "sections"), "\nSECTION\n"
    sinks.write_blocks(section_blocks(t), path, separator)
    return ingest.parse_sections(ingest.read_blocks(t.spark, path, separator)).select("section", "chainage", "i", "level", "panel_boundary", "coord_e", "coord_n")


@query(
    "e19_bankfull_markers",
    f"""WITH {POINTS}, th AS (SELECT path, arg_min(i, {{'l': level, 'i': i}}) AS ti, min(level) AS thalweg, count(*) AS n_points FROM pt GROUP BY 1),
b AS (SELECT th.path, any_value(thalweg) AS thalweg, arg_max(level, i) FILTER (WHERE panel_boundary AND i < ti) AS left_bank, arg_min(level, i) FILTER (WHERE panel_boundary AND i > ti) AS right_bank, any_value(n_points) AS n_points FROM pt JOIN th ON th.path = pt.path GROUP BY 1)
SELECT *, least(left_bank, right_bank) AS bankfull, least(left_bank, right_bank) - thalweg AS depth FROM b""",
)
def bankfull_markers(t):
    return profiles.bankfull_from_markers(ingest.parse_sections(section_blocks(t)), ("path",))


# ----------------------------------------------------------------- profiles
@query(
    "e16_tributary_chainage",
    f"SELECT s_suppkey, s_nationkey, {s6('coalesce(sum(abs(s_acctbal) / 100) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS cum_start_km FROM supplier",
)
def tributary_chainage(t):
    s = t.supplier.select("s_suppkey", "s_nationkey", (F.abs("s_acctbal") / 100).alias("length_km"))
    return _round(profiles.tributary_chainage(s, "s_nationkey", "s_suppkey"), "cum_start_km").select("s_suppkey", "s_nationkey", "cum_start_km")


@query(
    "e17_vertex_chainage",
    f"""WITH {SECT}, v AS (SELECT l_orderkey, i, l_linenumber // 4 AS part, l_quantity AS x, l_discount * 100 AS y FROM li), d AS (SELECT *, CASE WHEN lag(part) OVER w = part THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) ELSE 0 END AS d FROM v WINDOW w AS (PARTITION BY l_orderkey ORDER BY part, i))
SELECT l_orderkey, i, {s6('sum(d) OVER (PARTITION BY l_orderkey ORDER BY part, i ROWS UNBOUNDED PRECEDING)')} AS chainage FROM d""",
)
def vertex_chainage(t):
    v = _ordered_lines(t).select("l_orderkey", F.col("i").cast("long").alias("i"), F.floor(F.col("l_linenumber") / 4).alias("part"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return _round(profiles.vertex_chainage(v, "l_orderkey"), "chainage").select("l_orderkey", "i", "chainage")


@query(
    "e18_estimate_bankfull",
    f"""WITH p0 AS (SELECT l_suppkey AS s, CAST(dayofyear(l_shipdate) AS DOUBLE) AS ch, avg(l_extendedprice) / 4000 AS z FROM lineitem GROUP BY 1, 2), st AS (SELECT s, count(*) AS raw, median(z) AS m, stddev_pop(z) AS sd FROM p0 GROUP BY 1),
k AS (SELECT p0.s, ch, z, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p0.s) AS n, abs((lead(z) OVER w - z) / CASE WHEN lead(ch) OVER w - ch = 0 THEN 1e-6 ELSE lead(ch) OVER w - ch END) AS sl, lead(z) OVER w AS nz FROM p0 JOIN st USING (s) WHERE abs(z - m) < 3 * sd WINDOW w AS (PARTITION BY p0.s ORDER BY ch)),
g AS (SELECT *, CASE WHEN sl IS NOT NULL THEN (coalesce(lag(sl) OVER w, 0) + sl + coalesce(lead(sl) OVER w, 0)) / 3 END AS sm FROM k WINDOW w AS (PARTITION BY s ORDER BY i)), q AS (SELECT *, lag(sm) OVER w AS pm, lead(sm) OVER w AS nm, first_value(i) OVER (PARTITION BY s ORDER BY z, i) AS ti FROM g WINDOW w AS (PARTITION BY s ORDER BY i)),
a AS (SELECT s, min(z) AS thalweg, max(n) AS n, arg_max(z, i) FILTER (WHERE i <= ti AND i >= 1 AND i < n - 2 AND sm > 0.05 AND pm < 0.03) AS bl, arg_min(nz, i) FILTER (WHERE i >= ti AND i < n - 2 AND sm > 0.05 AND nm < 0.03) AS br, min(i) FILTER (WHERE i >= ti AND i < n - 2 AND sm > 0.05 AND nm < 0.03) AS ri,
  count(*) FILTER (WHERE ti = 0 OR i < ti) AS nl, quantile_cont(z, 0.9) FILTER (WHERE ti = 0 OR i < ti) AS pl, count(*) FILTER (WHERE i >= ti) AS nr, quantile_cont(z, 0.9) FILTER (WHERE i >= ti) AS pr FROM q GROUP BY 1),
r AS (SELECT st.s, raw, a.*, CASE WHEN ri > 0 THEN br END AS br2, CASE WHEN nl > 2 THEN pl END AS pl2, CASE WHEN nr > 2 THEN pr END AS pr2 FROM st LEFT JOIN a ON a.s = st.s),
f AS (SELECT *, CASE WHEN raw < 3 THEN 'insufficient_points' WHEN coalesce(n, 0) < 3 THEN 'outlier_filtered_too_short' WHEN n >= 6 AND coalesce(bl, br2) IS NOT NULL THEN 'break_in_slope' WHEN coalesce(pl2, pr2) IS NOT NULL THEN 'percentile_90_fallback' END AS method FROM r)
SELECT s AS l_suppkey, CASE WHEN n >= 3 THEN {s6('thalweg')} END AS thalweg, {s6("CASE method WHEN 'break_in_slope' THEN bl WHEN 'percentile_90_fallback' THEN pl2 END")} AS left_bank, {s6("CASE method WHEN 'break_in_slope' THEN br2 WHEN 'percentile_90_fallback' THEN pr2 END")} AS right_bank,
  {s6("CASE method WHEN 'break_in_slope' THEN least(bl, br2) WHEN 'percentile_90_fallback' THEN least(pl2, pr2) END")} AS bankfull, method FROM f""",
)
def estimate_bankfull(t):
    p = t.lineitem.groupBy("l_suppkey", F.dayofyear("l_shipdate").cast("double").alias("chainage")).agg((F.avg("l_extendedprice") / 4000).alias("elev"))
    return _round(profiles.estimate_bankfull(p, ("l_suppkey",)), "thalweg", "left_bank", "right_bank", "bankfull")


# -------------------------------------------------------------------- names
def scene_names(t):
    k = F.col("o_orderkey")
    start = F.date_format("o_orderdate", "yyyyMMdd'T'061530")
    hexa = F.lpad(F.upper(F.hex(F.col("o_custkey") * 7 + 1048576)), 6, "0")
    name = F.concat_ws("_", F.concat(F.lit("S1"), F.when(F.pmod(k, F.lit(2)) == 0, "A").otherwise("B")), F.lit("IW"), F.when(F.pmod(k, F.lit(5)) == 0, "SLC").otherwise("GRDH"), F.lit("1SDV"), start, F.lit("end"), hexa, F.when(F.pmod(k, F.lit(7)) == 0, "COG").otherwise("0AB1"), F.lit("9F"))
    return t.orders.select("o_orderkey", F.when(F.pmod(k, F.lit(11)) == 0, "S1A_short_name.SAFE").otherwise(F.concat(name, F.lit(".SAFE"))).alias("name"))


SCENES = """sn AS (SELECT o_orderkey, o_orderdate, 'S1' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS sat, lpad(upper(hex(o_custkey * 7 + 1048576)), 6, '0') AS hx, o_orderkey % 11 <> 0 AS ok,
  CASE WHEN o_orderkey % 11 = 0 THEN 'S1A_short_name' ELSE 'S1' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || '_IW_' || CASE WHEN o_orderkey % 5 = 0 THEN 'SLC' ELSE 'GRDH' END || '_1SDV_' || strftime(o_orderdate, '%Y%m%d') || 'T061530_end_' || lpad(upper(hex(o_custkey * 7 + 1048576)), 6, '0') || '_' || CASE WHEN o_orderkey % 7 = 0 THEN 'COG' ELSE '0AB1' END || '_9F' END AS stem FROM orders)"""


@query("a16_scene_parts", f"WITH {SCENES} SELECT o_orderkey, ok AS valid, CASE WHEN ok THEN stem END AS scene_id, CASE WHEN ok THEN sat END AS satellite, CASE WHEN ok THEN hx END AS orbit, CASE WHEN ok THEN date_trunc('day', o_orderdate) + INTERVAL 22530 SECOND END AS start_time FROM sn")
def scene_parts(t):
    return ingest.scene_parts(scene_names(t)).drop("name")


@query("a17_file_class", f"WITH {SCENES} SELECT o_orderkey, CASE WHEN contains(upper(stem), '_COG') THEN 'COG' WHEN contains(upper(stem), 'SLC_') THEN 'SLC' ELSE 'GRD' END AS file_class FROM sn")
def file_class(t):
    return scene_names(t).select("o_orderkey", ingest.file_class(F.col("name")).alias("file_class"))


REGISTRY = f"""WITH {SCENES}, rw AS (SELECT 'event_' || strftime(o_orderdate, '%Y%m%d') || '_' || right(hx, 4) AS event_id, CAST(o_orderdate AS DATE) AS acquisition_date, stem AS scene_id, sat AS satellite, hx AS orbit, o_orderkey % 3 <> 0 AS fresh FROM sn WHERE ok),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY fresh DESC, scene_id DESC) AS r FROM rw)
SELECT event_id, acquisition_date, CAST(acquisition_date AS TIMESTAMP) - INTERVAL 3 DAY AS event_start, CAST(acquisition_date AS TIMESTAMP) + INTERVAL 3 DAY + INTERVAL 1425 MINUTE AS event_end, scene_id, satellite, orbit FROM b WHERE r = 1"""


@query("a18_registry_upsert", REGISTRY)
def registry_upsert(t):
    sc = ingest.scene_parts(scene_names(t)).where("valid")
    old, new = sc.where("o_orderkey % 3 = 0"), sc.where("o_orderkey % 3 <> 0")
    return ingest.upsert(ingest.registry_rows(old), ingest.registry_rows(new))


@query("a18_registry_files", REGISTRY)
def registry_files(t):
    """The registry as a table in monthly partitions, of which the upsert rewrites those that get a fresh row."""
    sc = ingest.scene_parts(scene_names(t)).where("valid")
    rows = lambda fresh: ingest.registry_rows(sc.where(fresh)).withColumn("month", F.year("acquisition_date") * 100 + F.month("acquisition_date"))
    path = ingest.shared_scratch(t.spark, "registry")
    sinks.write_partitioned(ingest.upsert(rows("false"), rows("o_orderkey % 3 = 0")), path, ["month"])
    ingest.upsert_partitions(t.spark, path, rows("o_orderkey % 3 <> 0"), ["month"])
    return t.spark.read.parquet(path).drop("month")


@query(
    "a19_clean_sheet",
    r"""SELECT doc_id, nullif(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '') AS text, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang FROM documents""",
)
def clean_sheet(t):
    d = t.documents.select("doc_id", F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"), F.when(F.col("lang") == "de", " NaN ").otherwise(F.col("lang")).alias("lang"))
    return ingest.clean_sheet(d)


@query("a20_latest_datum", "SELECT l_suppkey AS ref, arg_max(l_quantity, {'d': l_shipdate, 'o': l_orderkey, 'l': l_linenumber, 'q': l_quantity}) AS datum FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def latest_datum(t):
    h = t.lineitem.select(F.col("l_suppkey").alias("ref"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("position"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("datum"))
    return ingest.latest_datum(h)


@query("json_threshold_map", "SELECT CAST(s_suppkey AS VARCHAR) AS series_id, s_acctbal AS bankfull FROM supplier")
def threshold_map(t):
    entry = F.map_from_arrays(F.array(F.col("s_suppkey").cast("string")), F.array("s_acctbal"))
    nested = F.to_json(F.struct(entry.alias("thresholds")))
    raw = t.supplier.select(F.when(F.pmod("s_suppkey", F.lit(2)) == 0, nested).otherwise(F.to_json(entry)).alias("json"))
    return ingest.threshold_map(raw)


@query("d8_merge_tables", "SELECT event_id, ts, value, CASE WHEN date_part('day', ts) > 10 THEN user_id END AS user_id FROM events")
def merge_tables(t):
    e = t.events.select("event_id", "ts", "value", "user_id")
    day = F.dayofmonth("ts")
    return ingest.merge_tables([e.where(day <= 10).drop("user_id"), e.where((day > 10) & (day <= 20)), e.where(day > 20)])


STACK = "SELECT e.user_id AS ref, e.ts, CASE WHEN e.value > 2 THEN e.value END AS value, s.s_suppkey AS node FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id"


def _stack(t):
    rows = t.events.select(F.col("user_id").alias("ref"), "ts", F.when(F.col("value") > 2, F.col("value")).alias("value"))
    return ingest.stack_node_files(rows, t.supplier.select(F.col("s_suppkey").alias("ref"), F.col("s_suppkey").alias("node")), ("value",))


@query("d9_stack_node_files", f"SELECT * FROM ({STACK}) WHERE node IS NOT NULL AND value IS NOT NULL")
def stack_node_files(t):
    return _stack(t)[0]


@query("d9_rejected_rows", f"SELECT ref, value FROM ({STACK}) WHERE node IS NULL OR value IS NULL")
def rejected_rows(t):
    return _stack(t)[1]


@query("b18_calibrated_db", f"SELECT o_orderkey, CASE WHEN o_custkey % 50 > 0 THEN {s6('20 * log10(o_custkey % 50) - 83')} END AS sigma0 FROM orders")
def calibrated_db(t):
    dn = F.pmod("o_custkey", F.lit(50)).cast("double")
    return t.orders.select("o_orderkey", r6(X.calibrated_db(dn, F.lit(None).cast("double"))).alias("sigma0"))


# --------------------------------------------------------------- text rules
@query(
    "b8_b9_numbers_and_names",
    """SELECT p_partkey, p_retailprice AS area_km2, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS graph_size, split_part(p_brand, '#', 1) AS base, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS segment FROM part""",
)
def numbers_and_names(t):
    base, seg = X.base_and_segment(F.replace("p_brand", F.lit("#"), F.lit("_")))
    size = F.when(F.pmod("p_size", F.lit(5)) == 0, "Dynamic").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(", 7")))
    out = t.part.select("p_partkey", X.number_in_text(F.concat(F.col("p_retailprice").cast("string"), F.lit(" km²"))).alias("area_km2"), L.graph_size(size).cast("int").alias("graph_size"), base.alias("base"), seg.alias("segment"))
    return out


@query(
    "b10_b11_names_and_horizons",
    """SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS plain, lower(p_name) AS spaced, CASE WHEN p_partkey % 2 = 0 THEN p_size * 15 / 60.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS hours FROM part""",
)
def names_and_horizons(t):
    raw = F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" (best run)"))
    hz = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" hr")))
    return t.part.select("p_partkey", X.normal_model_name(raw).alias("plain"), X.normal_model_name(raw, dashes=True).alias("spaced"), X.horizon_hours(hz).alias("hours"))


# texts that exercise the rules, picked by part key
SPATIAL = ("GraphSAGE + GAT", "GN block", "MLP", "MLP with GCN", "SageFormer", "Gaussian RBF", "multi-head GAT", "GNN", "ChebNet")
TEMPORAL = ("Muskingum", "AR", "FEDformer", "TCN", "CNN-LSTM", "GRU", "LSTM", "SVM", "none")
NODE = ("Guage", "raster cell", "River reach", "junction", "drainage point", "census tract", "token", "lake")
EDGE = ("Dynamic attention", "knowledge graph", "correlation", "flow direction", "adjacency", "topographic", "weighted", "inter-series", "connectivity", "distance", "none")
TYPES = ("Type I", "Type II", "Data-Learned (static)", "dynamic graph (physics-driven)", "Unclear")


def _pick(texts):
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (F.pmod("p_partkey", F.lit(len(texts))) + 1).cast("int"))


def _case(texts, out):
    return f"CASE p_partkey % {len(texts)} " + " ".join(f"WHEN {i} THEN " + (f"'{o}'" if o is not None else "NULL") for i, o in enumerate(out)) + " END"


@query(
    "b13_labels",
    "SELECT p_partkey, " + _case(SPATIAL, ("GraphSAGE", "GN block", "MLP", "GCN", "SageFormer", "Dense / Gaussian RBF", "GAT", "GNN", "ChebNet")) + " AS spatial, "
    + _case(TEMPORAL, ("Muskingum-Cunge", "AR rollout", "Transformer", "TCN / T-GCN", "CNN", "GRU", "LSTM", "ELM, SVM, MLP", "Other")) + " AS temporal, "
    + _case(NODE, ("Gauge station", "Mesh / raster cell", "River reach", "River junction", "Drainage intersection", "Census tract", "Dynamic token", "Other")) + " AS node_type, "
    + _case(EDGE, ("Attention-learned", "Knowledge graph", "Statistical correlation", "Physical flow direction", "Spatial adjacency", "Physics-routed", "Adaptive / hybrid", "Inter-series dependency", "Physical connectivity", "Physical flow direction", "Other")) + " AS edge_type, "
    + _case(TYPES, ("Physics Loss Constraint", "Physical Topology", "Data-Learned (static)", "Real-Time Physical Observation", "Unclear")) + " AS constraint_type FROM part",
)
def labels(t):
    return t.part.select(
        "p_partkey", L.spatial_label(_pick(SPATIAL)).alias("spatial"), L.temporal_label(_pick(TEMPORAL)).alias("temporal"), L.node_label(_pick(NODE)).alias("node_type"),
        L.edge_label(_pick(EDGE)).alias("edge_type"), L.type_label(_pick(TYPES)).alias("constraint_type"))


def _sql_rule(text, rules, default="NULL"):
    """The rules in SQL, evaluated on the text."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{pattern}') THEN '{label}'" for pattern, label in rules) + f" ELSE {default} END"


@query(
    "b13_document_labels",
    f"SELECT doc_id, {_sql_rule('text', L.TEMPORAL_RULES, chr(39) + 'Other' + chr(39))} AS temporal, {_sql_rule('lower(text)', L.NODE_RULES, chr(39) + 'Other' + chr(39))} AS node_type, {_sql_rule('lower(text)', L.EDGE_RULES, chr(39) + 'Other' + chr(39))} AS edge_type FROM documents",
)
def document_labels(t):
    """The rules on the whole texts of all documents."""
    text = F.col("text")
    return t.documents.select("doc_id", L.temporal_label(text).alias("temporal"), L.node_label(text).alias("node_type"), L.edge_label(text).alias("edge_type"))


#: A sheet of rules: words that tell a language, in this order.
LANGUAGES = (("(^| )(the|and|of)( |$)", "English"), ("(^| )(und|der|die)( |$)", "German"), ("(^| )(le|la|des)( |$)", "French"), ("(^| )(para|los|las)( |$)", "Spanish"))


@query("b13_rule_table", f"SELECT doc_id, {_sql_rule('text', LANGUAGES, chr(39) + 'unknown' + chr(39))} AS language FROM documents")
def labels_by_table(t):
    """Rules that are rows of a table."""
    return L.label_by_table(t.documents.select("doc_id", "text"), L.rule_table(t.spark, LANGUAGES), "text", "language", "unknown").select("doc_id", "language")


#: What the words of a part's name stand for on the sheet.
FIRST = {"blue": "Type II", "cold": "Type I soft", "red": "Type III", "new": "Type II process", "large": "Type I", "hot": "Physics-emulator runs", "old": "nan", "small": "Data-driven static"}
SECOND = {"gizmo": "Learned-Dynamic graph", "ring": "Physics-driven input", "rod": "Data-driven dynamic", "anvil": "Knowledge-static", "gear": "Learned static", "widget": "Type II", "bolt": "none", "plate": "Type I"}


def _cells(t):
    """Every part's name as the text of a sheet cell."""
    word = lambda i, names: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.get(F.split("p_name", " "), F.lit(i)))
    return F.concat(word(0, FIRST), F.lit(" + "), word(1, SECOND))


def _sql_word(i, names):
    return f"CASE split_part(p_name, ' ', {i}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_ANY = {group: f"list_has_any(c, [{', '.join(chr(39) + n + chr(39) for n in names)}])" for group, names in L.PATTERN_GROUPS.items()}
_FAMILY = "CASE " + " ".join("WHEN " + " AND ".join([*[_ANY[g] for g in needed], *[f"NOT {_ANY[g]}" for g in excluded]]) + f" THEN '{family}'" for needed, excluded, family in L.PATTERN_RULES) + " ELSE 'Other' END"
CELLS = f"""cell AS (SELECT p_partkey, {_sql_word(1, FIRST)} || ' + ' || {_sql_word(2, SECOND)} AS text FROM part),
part_c AS (SELECT p_partkey, list_filter(list_transform(string_split(text, '+'), lambda x: {_sql_rule('lower(trim(x))', L.COMPONENT_RULES)}), lambda x: x IS NOT NULL) AS k FROM cell),
comp AS (SELECT p_partkey, CASE WHEN len(k) > 0 THEN k ELSE ['{L.NO_COMPONENT}'] END AS c FROM part_c)"""


@query("b14_b15_part_components", f"WITH {CELLS} SELECT p_partkey, array_to_string(c, '|') AS components, {_FAMILY} AS pattern FROM comp")
def part_components(t):
    c = t.part.select("p_partkey", L.constraint_components(_cells(t)).alias("c"))
    return c.select("p_partkey", F.array_join("c", "|").alias("components"), L.constraint_pattern(F.col("c")).alias("pattern"))


@query("k60_part_label_counts", f"WITH {CELLS} SELECT label, count(*) AS n FROM (SELECT unnest(c) AS label FROM comp) GROUP BY 1")
def part_label_counts(t):
    return catalogue.label_counts(t.part, L.constraint_components(_cells(t)))


COMPOUND = ("Type I", "Type II + Learned-Dynamic", "Type II + Type I soft", "Learned graph structure", "Type II + Learned static + Physics-driven", "Type II process + Type III", "nan", "Data-driven static", "Type II")
COMPS = ("Physics Loss Constraint", "Physical Topology (structural prior)|Data-Learned (dynamic)", "Physical Topology (structural prior)|Physics Loss Constraint", "Data-Learned (static)", "Physical Topology (structural prior)|Data-Learned (static)|Real-Time Physical Observation",
         "Governing Equation (architecture)|Physics Model as Input Feature", "No Constraint", "Statistical Correlation (static)", "Physical Topology (structural prior)")
PATTERNS = ("Loss Penalty", "Topology + Learned", "Topology + Loss Penalty", "Fully Data-Learned", "Topology + Learned + Dynamic", "Topology + Dynamic", "Other", "Other", "Topology Only")


@query("b14_b15_constraint_components", f"SELECT p_partkey, {_case(COMPOUND, COMPS)} AS components, {_case(COMPOUND, PATTERNS)} AS pattern FROM part")
def constraint_components(t):
    c = t.part.select("p_partkey", L.constraint_components(_pick(COMPOUND)).alias("c"))
    return c.select("p_partkey", F.array_join("c", "|").alias("components"), L.constraint_pattern(F.col("c")).alias("pattern"))


# ---------------------------------------------------------------- catalogue
@query("k60_category_counts", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n <= greatest(1, (SELECT count(*) FROM part) * 0.04::DOUBLE) THEN 'Other' ELSE p_brand END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def category_counts(t):
    return catalogue.category_counts(t.part, "p_brand", share=0.04)


@query("k60_crosstab", "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1")
def crosstab(t):
    return catalogue.crosstab(t.documents, "source", "lang", ("de", "en", "es", "fr"))


@query("k60_label_counts", f"SELECT label, count(*) AS n FROM (SELECT unnest(string_split({_case(COMPOUND, COMPS)}, '|')) AS label FROM part) GROUP BY 1")
def label_counts(t):
    return catalogue.label_counts(t.part, L.constraint_components(_pick(COMPOUND)))


@query(
    "k60_yearly_trend",
    """WITH y AS (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders))) AS year),
c AS (SELECT year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1)
SELECT CAST(year AS INTEGER) AS year, 'finished' AS grp, coalesce(finished, 0) AS n FROM y LEFT JOIN c USING (year) UNION ALL SELECT CAST(year AS INTEGER), 'urgent', coalesce(urgent, 0) FROM y LEFT JOIN c USING (year)""",
)
def yearly_trend(t):
    o = t.orders.withColumn("y", F.year("o_orderdate"))
    return catalogue.yearly_trend(o, "y", {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority").startswith("1")})

