"""Spatial, temporal and attribute joins of stations, sections, products and pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.plans.fixpoint import cut
from rivulet.plans.intervals import interval_join
from rivulet.plans.nearest import PARTS, CellTree, blocks_of, near_any, nearest, pairs_within, unit_sphere
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.timechunks import STEP, from_micros, micros


# ---------------------------------------------------------------- nearest
def nearest_on_globe(points: DataFrame, refs: DataFrame, ref_id: str, order: str | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Nearest reference by great-circle distance; equal distances (to a millimetre) go to the first in order."""
    ax, rx = ["_x", "_y", "_z"], ["_rx", "_ry", "_rz"]
    p = points.withColumns(dict(zip(ax, unit_sphere(F.col(lat), F.col(lon)))))
    r = refs.select(ref_id, *({order} - {ref_id, None}), *[c.alias(n) for c, n in zip(unit_sphere(F.col(lat), F.col(lon)), rx)])
    chord = F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(ax, rx)))
    km = F.round(2 * X.EARTH_RADIUS_KM * F.asin(F.least(chord / 2, F.lit(1.0))), 6)
    return nearest(p, r, ax, rx, ref_id, order or ref_id, km).drop(*ax)


def nearest_planar(points: DataFrame, refs: DataFrame, axes: Sequence[str], ref_id: str, order: str | None = None, dist: Column | None = None) -> DataFrame:
    """Nearest reference in a plane (projected metres or degrees); ties go to the first in order."""
    rx = [f"_r_{a}" for a in axes]
    r = refs.select(ref_id, *({order} - {ref_id, None}), *[F.col(a).alias(b) for a, b in zip(axes, rx)])
    d = dist if dist is not None else F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(axes, rx)))
    return nearest(points, r, list(axes), rx, ref_id, order or ref_id, d)


def nearest_within(points: DataFrame, refs: DataFrame, axes: Sequence[str], ref_id: str, radius: float, keys: Sequence[str]) -> DataFrame:
    """Nearest reference no farther than `radius` of each key's points; others are dropped.

    Points whose cell touches no cell of a reference go first; the nearest reference of the rest is found however many lie around them.
    """
    rx = [f"_r_{a}" for a in axes]
    r = refs.select(ref_id, *[F.col(a).alias(b) for a, b in zip(axes, rx)])
    pairs = nearest_planar(near_any(points, r, list(axes), rx, radius), refs, axes, ref_id).where(F.col("dist") <= radius)
    best = pairs.groupBy(*keys).agg(F.min(F.struct("dist", ref_id)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{ref_id}").alias(ref_id), F.col("_b.dist").alias("dist"))


def k_nearest(nodes: DataFrame, k: int, node: str = "node", axes: Sequence[str] = ("easting", "northing")) -> DataFrame:
    """k nearest other nodes of each node: (src, dst, dist, rank), the smaller node first on a tie; fewer where there are fewer nodes.

    Nodes at the same place share one search.
    """
    rx = [f"_r_{a}" for a in axes]
    base = cut(nodes.select(F.col(node).alias("src"), *axes).where(" and ".join(f"{a} is not null" for a in axes)))
    refs = base.select(F.col("src").alias("dst"), *[F.col(a).alias(b) for a, b in zip(axes, rx)])
    if base.isEmpty():
        return refs.select(F.col("dst").alias("src"), "dst", F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    d = F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(axes, rx)))
    found = CellTree(refs, rx).candidates(base.select(*axes).distinct(), axes, k + 1)  # a node is its own nearest
    pairs = base.join(found, list(axes)).where("src <> dst").withColumn("dist", d)
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.select("src", "dst", "dist", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def both_directions(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges plus their reverses; an existing edge wins over an added reverse."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    back = edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest).withColumn("_o", F.lit(1))
    both = edges.withColumn("_o", F.lit(0)).unionByName(back)
    best = both.groupBy(src, dst).agg(F.min_by(F.struct(*rest), "_o").alias("_r"))
    return best.select(src, dst, *[F.col(f"_r.{c}").alias(c) for c in rest])


def match_sections(sections: DataFrame, gauges: DataFrame, text: str, axes: Sequence[str] = ("easting", "northing"), gauge: str = "ref", max_m: float = 5000.0) -> DataFrame:
    """Attribute match on the reference (leading zeros ignored), else the nearest gauge closer than `max_m`."""
    clean = lambda c: F.ltrim(F.trim(c.cast("string")), F.lit("0"))
    by_text = gauges.groupBy(clean(F.col(gauge)).alias("_key")).agg(F.min(gauge).alias("_match"))
    out = sections.withColumn("_key", clean(F.col(text))).join(by_text, "_key", "left").drop("_key")
    rest = nearest_planar(out.where(F.col("_match").isNull()), gauges, axes, gauge)
    rest = rest.withColumn(gauge, F.when(F.col("dist") < max_m, F.col(gauge))).withColumn("matched_by", F.when(F.col(gauge).isNotNull(), "distance")).drop("dist", "_match")
    hit = out.where(F.col("_match").isNotNull()).withColumnRenamed("_match", gauge).withColumn("matched_by", F.lit("reference"))
    return hit.unionByName(rest)


def closest_section(assigned: DataFrame, gauge: str = "ref", section: str = "section_id") -> DataFrame:
    return assigned.groupBy(gauge).agg(F.min(F.struct("dist", section)).alias("_b")).select(gauge, F.col(f"_b.{section}").alias(section), F.col("_b.dist").alias("dist"))


# ------------------------------------------------------------ raster joins
def sample_raster(nodes: DataFrame, pixels: DataFrame, node: str, value: str, by: Sequence[str] = (), row: str = "row", col: str = "col") -> DataFrame:
    """Pixel value of each node, else the median of its 3x3 neighbourhood, else the raster's median.

    `nodes` carries row and col. With `by` (an event or image id in `pixels`) every node is
    sampled in every image that has a pixel, valid or not, in its neighbourhood.
    """
    by = list(by)
    offs = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    spots = nodes.select(node, row, col).withColumn("_o", F.explode(offs)).select(
        node, (F.col(row) + F.col("_o.dr")).alias(row), (F.col(col) + F.col("_o.dc")).alias(col), ((F.col("_o.dr") == 0) & (F.col("_o.dc") == 0)).alias("_centre"))
    hits = pixels.select(*by, row, col, F.col(value).alias("_v")).join(spots, [row, col])
    local = hits.groupBy(*by, node).agg(F.max(F.when(F.col("_centre"), F.col("_v"))).alias("_own"), F.percentile("_v", 0.5).alias("_patch"))
    overall = exact_quantiles(pixels, by, value, {"_all": 0.5})
    if by:
        out = local.join(overall, by, "left")
    else:
        out = nodes.select(node).join(local, node, "left").withColumn("_all", overall.select("_all").scalar())
    how = F.when(F.col("_own").isNotNull(), "pixel").when(F.col("_patch").isNotNull(), "patch").otherwise("raster")
    return out.select(*by, node, F.coalesce("_own", "_patch", "_all").alias(value), how.alias("source"))


def candidate_pairs(nodes: DataFrame, edges: DataFrame, max_km: float, node: str = "node", axes: Sequence[str] = ("easting", "northing"), keep_blocks: bool = False) -> DataFrame:
    """Unordered node pairs within `max_km` that no edge joins yet; pairs meet through shared grid cells only.

    `keep_blocks` leaves the columns of the block in which a pair met; `corridor_minimum` then moves no pair.
    """
    rx = [f"_r_{a}" for a in axes]
    known = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    pairs = pairs_within(nodes.select(F.col(node).alias("i"), *axes), list(axes), rx, max_km * 1000.0, known)
    apart = [(F.col(a) - F.col(b)).cast("double") for a, b in zip(axes, rx)]
    near = pairs.withColumn("dist_km", F.sqrt(sum(d * d for d in apart)) / 1000).where(F.col("dist_km") <= max_km)
    blocks = blocks_of(len(axes)) if keep_blocks else []
    turned = F.col("i") > F.col("j")
    first = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(f"{n}1") for a, b, n in zip(axes, rx, "en")]
    second = [F.when(turned, F.col(a)).otherwise(F.col(b)).alias(f"{n}2") for a, b, n in zip(axes, rx, "en")]
    return near.select(*blocks, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist_km", *first, *second)


def corridor_minimum(pairs: DataFrame, pixels: DataFrame, origin: tuple[float, float], size: tuple[float, float], samples: int = 60, hand: str = "hand", elev: str = "elev", reach: float | None = None, once: bool = False) -> DataFrame:
    """Lowest HAND on the middle 70% of the line between two nodes and the elevation there (first sample on a tie).

    With `reach`, the widest distance of the pairs in metres, `pairs` come with the blocks of `candidate_pairs`. Each block gets the pixels that its
    lines can touch, and samples are taken there, so neither pairs nor samples are moved. `once`: no (i, j) lies in two blocks.
    Without `reach` each sample meets its pixel by a join.
    """
    known = pixels.where(F.col(hand).isNotNull())
    if reach is None:
        t = F.lit(0.15) + F.col("_k") * F.lit(0.70 / (samples - 1))
        pts = pairs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_t", t)
        e = F.col("e1") + F.col("_t") * (F.col("e2") - F.col("e1"))
        n = F.col("n1") + F.col("_t") * (F.col("n2") - F.col("n1"))
        pts = pts.select("i", "j", "dist_km", "_k", F.rint((n - origin[1]) / size[1]).cast("long").alias("row"), F.rint((e - origin[0]) / size[0]).cast("long").alias("col"))
        hits = pts.join(known.select("row", "col", hand, elev), ["row", "col"])
        best = hits.groupBy("i", "j", "dist_km").agg(F.min(F.struct(F.col(hand).alias("h"), F.col("_k").alias("k"), F.col(elev).alias("z"))).alias("_b"))
        return best.select("i", "j", "dist_km", F.col("_b.h").alias("min_hand"), F.col("_b.z").alias("z_saddle"))

    keys = blocks_of(2)
    blocks = cut(pairs.select(*keys).distinct())
    cell = reach / PARTS
    at = {"_c0": F.col("col") * F.lit(size[0]) + origin[0], "_c1": F.col("row") * F.lit(size[1]) + origin[1]}
    margin = {"_c0": reach + abs(size[0]), "_c1": reach + abs(size[1])}
    bound = lambda k, side: F.floor((at[k] + side * margin[k]) / cell)
    # a pixel's own coarse cell first: most pixels may lie far from all lines
    coarse = {k: 2 * margin[k] for k in at}
    around = blocks.select(*[F.explode(F.sequence(F.floor(F.col(k) * cell / coarse[k]) - 1, F.floor((F.col(k) + 1) * cell / coarse[k]) + 1)).alias(f"_w{k}") if k == "_c0" else k for k in at])
    around = around.select("_w_c0", F.explode(F.sequence(F.floor(F.col("_c1") * cell / coarse["_c1"]) - 1, F.floor((F.col("_c1") + 1) * cell / coarse["_c1"]) + 1)).alias("_w_c1")).distinct()
    px = known.select("row", "col", F.col(hand).cast("double").alias("h"), F.col(elev).cast("double").alias("z"))
    px = px.select("*", *[F.floor(at[k] / coarse[k]).alias(f"_w{k}") for k in at]).join(around, ["_w_c0", "_w_c1"], "left_semi")
    px = px.groupBy("row", "col").agg(F.min(F.struct("h", "z")).alias("_b")).select("row", "col", "_b.h", "_b.z")
    px = px.withColumn("_c0", F.explode(F.sequence(bound("_c0", -1), bound("_c0", 1)))).withColumn("_c1", F.explode(F.sequence(bound("_c1", -1), bound("_c1", 1))))
    px = px.join(blocks, ["_c0", "_c1"]).select(*keys, "row", "col", "h", "z")
    types = dict(pairs.dtypes)

    def lowest(lines: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        lines = lines.drop_duplicates(["i", "j", "dist_km", "e1", "n1", "e2", "n2"])
        best, z, first = np.full(len(lines), np.inf), np.full(len(lines), np.nan), np.zeros(len(lines), np.int32)
        hit = np.zeros(len(lines), bool)
        if len(near) and len(lines):
            r, c = near["row"].to_numpy(), near["col"].to_numpy()
            r0, c0 = r.min(), c.min()
            high, wide = int(r.max() - r0 + 1), int(c.max() - c0 + 1)
            there, h, level = np.zeros(high * wide, bool), np.full(high * wide, np.inf), np.full(high * wide, np.nan)
            spot = (r - r0) * wide + (c - c0)
            there[spot], h[spot], level[spot] = True, near["h"].to_numpy(), near["z"].to_numpy()
            e1, n1, e2, n2 = (lines[x].to_numpy() for x in ("e1", "n1", "e2", "n2"))
            for k in range(samples):
                t = 0.15 + k * (0.70 / (samples - 1))
                row = np.rint((n1 + t * (n2 - n1) - origin[1]) / size[1]).astype(np.int64) - r0
                col = np.rint((e1 + t * (e2 - e1) - origin[0]) / size[0]).astype(np.int64) - c0
                inside = (row >= 0) & (row < high) & (col >= 0) & (col < wide)
                flat = np.where(inside, row * wide + col, 0)
                inside &= there[flat]
                lower = inside & (~hit | (h[flat] < best))
                best[lower], z[lower], first[lower] = h[flat[lower]], level[flat[lower]], k
                hit |= inside
        return pd.DataFrame({"i": lines["i"], "j": lines["j"], "dist_km": lines["dist_km"], "min_hand": best, "k": first, "z_saddle": z})[hit]

    out = pairs.groupBy(*keys).cogroup(px.groupBy(*keys)).applyInPandas(lowest, f"i {types['i']}, j {types['j']}, dist_km double, min_hand double, k int, z_saddle double")
    if once:
        return out.drop("k")
    best = out.groupBy("i", "j", "dist_km").agg(F.min(F.struct("min_hand", "k", "z_saddle")).alias("_b"))
    return best.select("i", "j", "dist_km", "_b.min_hand", "_b.z_saddle")


def overland_edges(corridors: DataFrame, min_hand: float = 0.5) -> DataFrame:
    """Accepted corridors as edges in both directions."""
    ok = corridors.where((F.col("min_hand") >= min_hand) & F.col("z_saddle").isNotNull())
    ends = F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"))))
    return ok.withColumn("_e", ends).select("_e.src", "_e.dst", F.col("min_hand").alias("hand_threshold"), F.col("dist_km").alias("overland_dist_km"), F.col("z_saddle").alias("z_saddle_m"))


def interpolate_lut(columns: DataFrame, lut: DataFrame, width: int | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Lookup values stretched to the image width by linear interpolation: one value per column.

    `lut` has (keys, pos, lut) with pos counted from 0; `columns` has (keys, col).
    """
    keys = list(keys)
    wl = Window.partitionBy(*keys).orderBy("pos")
    n = lut.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_last"))
    seg = lut.withColumn("_next", F.lead("lut").over(wl)).select(*keys, F.col("pos").alias("_pos"), "lut", "_next")
    at = F.coalesce(F.try_divide(F.col("col") * F.col("_last"), F.lit(width) - 1 if isinstance(width, int) else width - 1), F.lit(0.0))
    pts = columns.join(n, keys) if keys else columns.withColumn("_last", n.select("_last").scalar())
    pts = pts.withColumn("_at", at).withColumn("_pos", F.floor("_at"))
    frac = F.col("_at") - F.col("_pos")
    out = pts.join(seg, [*keys, "_pos"])
    return out.withColumn("lut", F.col("lut") + F.when(frac > 0, frac * (F.col("_next") - F.col("lut"))).otherwise(0.0)).drop("_last", "_at", "_pos", "_next")


# --------------------------------------------------------- temporal joins
def event_of_timestep(steps: DataFrame, events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event whose window holds the time step; where several do, the one registered last."""
    hits = interval_join(steps.select(ts).distinct(), events.select("event_id", "event_order", "event_start", "event_end"), ts, "event_start", "event_end")
    best = hits.groupBy(ts).agg(F.max_by("event_id", "event_order").alias("event_id"))
    return steps.join(best, ts, "left")


def products_near_peaks(products: DataFrame, peaks: DataFrame, days: int = 2) -> DataFrame:
    """Products within `days` of a peak date, each once, with its nearest peak (first listed on a tie)."""
    win = peaks.select("event_id", "peak_date", F.date_sub("peak_date", days).cast("timestamp_ntz").alias("_from"), F.date_add("peak_date", days).cast("timestamp_ntz").alias("_to"))
    hits = interval_join(products.withColumn("_at", F.col("date").cast("timestamp_ntz")), win, "_at", "_from", "_to")
    gap = F.abs(F.datediff("date", "peak_date"))
    best = hits.withColumn("days_from_peak", gap).groupBy("product_id").agg(
        F.min(F.struct("days_from_peak", "event_id", "peak_date", "date", "orbit_rel", "size_mb")).alias("_b"))
    return best.select("product_id", *[f"_b.{c}" for c in ("event_id", "peak_date", "date", "orbit_rel", "size_mb", "days_from_peak")])


def dry_references(products: DataFrame, flood: DataFrame, exclude_days: int = 10, months: tuple[int, int] = (6, 8)) -> DataFrame:
    """Same-orbit products of the dry season before each event, away from every flood peak.

    The season is that of the flood's year if it falls in September or later, else of the year before.
    """
    best = flood.groupBy("event_id").agg(F.min(F.struct("days_from_peak", "product_id", "date", "orbit_rel")).alias("_b"))
    want = best.select("event_id", F.col("_b.orbit_rel").alias("orbit_rel"), (F.year("_b.date") - (F.month("_b.date") < 9).cast("int")).alias("ref_year"))
    dry = products.where(F.month("date").between(*months)).withColumn("ref_year", F.year("date"))
    cand = dry.join(want, ["orbit_rel", "ref_year"])
    peaks = flood.select(F.col("peak_date").alias("_peak")).distinct().select(
        F.date_sub("_peak", exclude_days).cast("timestamp_ntz").alias("_from"), F.date_add("_peak", exclude_days).cast("timestamp_ntz").alias("_to"))
    away = interval_join(cand.withColumn("_at", F.col("date").cast("timestamp_ntz")), peaks, "_at", "_from", "_to", how="left_anti")
    return away.select("event_id", "product_id", "date", "orbit_rel", "ref_year", "size_mb")


def scene_manifest(flood: DataFrame, refs: DataFrame, n_refs: int = 3) -> DataFrame:
    """Nearest product per event and up to `n_refs` references per event, with their role."""
    rank = lambda *o: F.row_number().over(Window.partitionBy("event_id").orderBy(*o))
    top = flood.withColumn("_r", rank("days_from_peak", "product_id")).where("_r = 1").drop("_r").withColumn("role", F.lit("flood"))
    ref = refs.withColumn("_r", rank("date", "product_id")).where(F.col("_r") <= n_refs).drop("_r").withColumn("role", F.lit("reference"))
    return top.unionByName(ref, allowMissingColumns=True)


def verify_alerts(alerts: DataFrame, pred: DataFrame, thresholds: DataFrame, gauge: str = "gauge_ref", ts: str = "ts", steps: int = 8) -> DataFrame:
    """Each alert with the highest prediction within +-`steps` steps at its gauge and its verdict."""
    reach = steps * STEP
    near = F.floor((micros("alert_ts") + STEP // 2) / STEP).cast("long") * STEP
    win = alerts.join(thresholds, gauge).withColumn("_from", from_micros(near - reach)).withColumn("_to", from_micros(near + reach))
    hits = interval_join(pred.select(F.col("node").alias(gauge), ts, "pred"), win.select("alert_id", gauge, "_from", "_to"), ts, "_from", "_to", on=[gauge])
    top = hits.groupBy("alert_id").agg(F.max("pred").alias("max_pred"))
    out = alerts.join(thresholds, gauge).join(top, "alert_id", "left")
    return out.withColumn("status", F.when(F.col("max_pred") > F.col("bankfull"), "TP").otherwise("FN"))


def alert_scores(verified: DataFrame, pred: DataFrame, thresholds: DataFrame, gauge: str = "gauge_ref", ts: str = "ts") -> DataFrame:
    """TP and FN per alert; false alarms per time step and per (gauge, day) without an alert; precision both ways."""
    over = pred.select(F.col("node").alias(gauge), ts, "pred").join(thresholds, gauge).where(F.col("pred") > F.col("bankfull"))
    days = verified.select(gauge, F.to_date("alert_ts").alias("_day")).distinct()
    fp = over.withColumn("_day", F.to_date(ts)).join(days, [gauge, "_day"], "left_anti")
    per_day = fp.groupBy(gauge, "_day").agg(F.count(F.lit(1)).alias("n"))
    fps = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fp_steps"), F.count(F.lit(1)).alias("fp_days"))
    out = verified.agg(F.count_if(F.col("status") == "TP").alias("tp"), F.count_if(F.col("status") == "FN").alias("fn"))
    out = out.withColumn("fp_steps", fps.select("fp_steps").scalar()).withColumn("fp_days", fps.select("fp_days").scalar())
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp_steps"))).withColumn("precision_days", ratio(F.col("tp"), F.col("tp") + F.col("fp_days")))
    out = out.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def append_features(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of feature columns on (node, time), with a flag where the other table has no row."""
    return base.join(extra.withColumn("_hit", F.lit(True)), list(keys), "left").withColumn("appended", F.coalesce("_hit", F.lit(False))).drop("_hit")


def threshold_lookup(nodes: DataFrame, thresholds: DataFrame, key: str, value: str = "bankfull", default: float = 0.5) -> DataFrame:
    return nodes.join(thresholds.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def sample_matrix(samples: DataFrame, event: str = "event_id", min_events: int = 3) -> DataFrame:
    """Samples of all images with the number of images; fewer than two give an empty result."""
    n = samples.agg(F.count_distinct(event)).scalar()
    return samples.withColumn("n_events", n).withColumn("enough", F.col("n_events") >= min_events).where(F.col("n_events") >= 2)
