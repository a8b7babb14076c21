"""Raster tables: flow routing, HAND, inundation, SAR flood masks and map scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.graph import connected_components
from rivulet.operators.quality import merge_intervals
from rivulet.plans.fixpoint import cut
from rivulet.plans.quantiles import exact_quantiles
from rivulet.plans.timechunks import from_micros, micros, over_axis

# fixed values: neighbour order and distances of the eight flow directions
D8 = ((-1, -1, 1.4142), (-1, 0, 1.0), (-1, 1, 1.4142), (0, -1, 1.0), (0, 1, 1.0), (1, -1, 1.4142), (1, 0, 1.0), (1, 1, 1.4142))


def cell_id(row: Column | str = "row", col: Column | str = "col") -> Column:
    """One long per pixel: row in the upper, column in the lower half."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return F.shiftleft(r.cast("long"), 32).bitwiseOR(c.cast("long"))


def _row_col(cell: Column) -> list[Column]:
    return [F.shiftright(cell, 32).alias("row"), cell.bitwiseAND(F.lit(0xFFFFFFFF)).alias("col")]


# ------------------------------------------------------------------- flow
def flow_direction(dem: DataFrame, elev: str = "elev") -> DataFrame:
    """Steepest descent among eight neighbours, the first in order on a tie; cells without a lower neighbour have none.

    Every cell offers its elevation to its neighbours; the best offer is a mergeable minimum.
    """
    known = dem.where(F.col(elev).isNotNull()).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col(elev).alias("_z"))
    # seen from the receiving cell, the offering neighbour lies at (dr, dc)
    offs = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(d).alias("dist"), F.lit(i).alias("o")) for i, (dr, dc, d) in enumerate(D8)])
    offers = known.withColumn("_o", F.explode(offs)).select(
        (F.col("row") - F.col("_o.dr")).alias("row"), (F.col("col") - F.col("_o.dc")).alias("col"), F.col("_z").alias("_nz"), F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc"), F.col("_o.dist").alias("dist"), F.col("_o.o").alias("o"))
    pairs = offers.join(known, ["row", "col"]).withColumn("slope", (F.col("_z") - F.col("_nz")) / F.col("dist")).where("slope > 0")
    best = pairs.groupBy("row", "col").agg(F.min(F.struct((-F.col("slope")).alias("s"), F.col("o"), F.col("dr"), F.col("dc"))).alias("_b"))
    out = known.join(best, ["row", "col"], "left")
    return out.select("row", "col", F.col("_b.dr").alias("dr"), F.col("_b.dc").alias("dc"), (-F.col("_b.s")).alias("slope"))


def _pointers(flow: DataFrame) -> DataFrame:
    """(cell, next): the cell a cell drains to, null at the end of a path."""
    nxt = F.when(F.col("dr").isNotNull(), cell_id(F.col("row") + F.col("dr"), F.col("col") + F.col("dc")))
    return flow.select(cell_id().alias("cell"), nxt.alias("next"))


def flow_accumulation(flow: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Number of cells draining through each cell, itself included, by doubling the jump length each round."""
    state = cut(_pointers(flow).withColumn("acc", F.lit(1).cast("long")))
    for _ in range(max_rounds):
        moving = state.where(F.col("next").isNotNull())
        if moving.isEmpty():
            return state.select(*_row_col(F.col("cell")), F.col("acc").alias("accumulation"))
        arrived = moving.groupBy(F.col("next").alias("cell")).agg(F.sum("acc").alias("_in"))
        ahead = state.select(F.col("cell").alias("next"), F.col("next").alias("_next2"))
        jumped = moving.join(ahead, "next").select("cell", "_next2")
        state = cut(state.join(arrived, "cell", "left").join(jumped, "cell", "left").select("cell", F.col("_next2").alias("next"), (F.col("acc") + F.coalesce("_in", F.lit(0))).alias("acc")))
    raise RuntimeError("flow paths longer than 2^max_rounds or cyclic")


def stream_cells(accumulation: DataFrame, threshold: int = 500) -> DataFrame:
    """Cells with enough accumulation; where none has, those above nine tenths of the maximum."""
    top = accumulation.agg(F.max("accumulation")).scalar()
    out = accumulation.withColumn("_top", top)
    return out.where(F.col("accumulation") >= F.when(F.col("_top") >= threshold, F.lit(float(threshold))).otherwise(F.col("_top") * 0.9)).drop("_top")


def first_on_path(flow: DataFrame, marks: DataFrame, max_rounds: int = 40) -> DataFrame:
    """First marked cell on each cell's flow path (itself included): (cell, mark cell); cells that reach none are left out.

    Pointers jump to their pointer's pointer, stopping at marked cells; resolved
    cells leave the loop, so the rounds are logarithmic in the longest path.
    """
    m = marks.select(cell_id().alias("cell")).distinct().withColumn("_m", F.lit(True))
    ptr = _pointers(flow).join(m, "cell", "left")
    state = cut(ptr.select("cell", F.when(F.col("_m"), F.col("cell")).otherwise(F.col("next")).alias("next"), F.coalesce("_m", F.lit(False)).alias("done")).where("next is not null"))
    for _ in range(max_rounds):
        todo = state.where(~F.col("done"))
        if todo.isEmpty():
            return state.select("cell", F.col("next").alias("mark"))
        ahead = state.select(F.col("cell").alias("next"), F.col("next").alias("_n2"), F.col("done").alias("_d2"))
        # a pointer to a cell that dropped out (a path end without a mark) drops out as well
        moved = todo.join(ahead, "next").select("cell", F.col("_n2").alias("next"), F.col("_d2").alias("done"))
        state = cut(state.where("done").unionByName(moved), compact=True)
    raise RuntimeError("flow paths longer than 2^max_rounds or cyclic")


def height_above_drainage(dem: DataFrame, flow: DataFrame, streams: DataFrame, elev: str = "elev") -> DataFrame:
    """Elevation above the first stream cell on the flow path, at least 0; null off the network."""
    z = dem.select(cell_id().alias("cell"), F.col(elev).alias("_z"))
    to = first_on_path(flow, streams)
    hit = to.join(z, "cell").join(z.select(F.col("cell").alias("mark"), F.col("_z").alias("_sz")), "mark")
    out = z.join(hit.select("cell", F.greatest(F.col("_z") - F.col("_sz"), F.lit(0.0)).alias("hand")), "cell", "left")
    return out.select(*_row_col(F.col("cell")), "hand")


def catchments(flow: DataFrame, gauges: DataFrame, fallback: DataFrame, node: str = "node") -> DataFrame:
    """Gauge each pixel drains to; pixels that reach none take the nearest gauge from `fallback` (row, col, node)."""
    g = gauges.groupBy(cell_id().alias("mark")).agg(F.min(node).alias("_node"))
    to = first_on_path(flow, gauges.select("row", "col")).join(g, "mark").select("cell", "_node")
    near = fallback.select(cell_id().alias("cell"), F.col(node).alias("_near"))
    out = flow.select("row", "col", cell_id().alias("cell")).join(to, "cell", "left").join(near, "cell", "left")
    return out.select("row", "col", F.coalesce("_node", "_near").alias(node), F.when(F.col("_node").isNotNull(), "flow").when(F.col("_near").isNotNull(), "nearest").alias("assigned_by"))


# -------------------------------------------------------------- inundation
def inundation(pixels: DataFrame, stages: DataFrame, fixed_hand: float | None = None) -> DataFrame:
    """Wet pixels: the node's stage reaches its threshold and HAND is at most the stage (or a fixed height).

    `pixels` has (row, col, node, hand), `stages` (node, ts, stage, bankfull). A pixel under several nodes is wet once.
    """
    on = stages.where(F.col("stage") >= F.col("bankfull"))
    height = F.col("stage") if fixed_hand is None else F.lit(fixed_hand)
    places = pixels.where(F.col("hand").isNotNull()).select("row", "col", "node", "hand")
    # duplicates can only come from pixels under several nodes or listed twice, so only those are compared over all times
    shared = places.groupBy("row", "col").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    lying = places.join(shared, ["row", "col"])
    wet = lying.join(on.groupBy("node", "ts").agg(F.max(height).alias("_height")), "node").where(F.col("hand") <= F.col("_height"))
    alone = wet.where(~F.col("_shared")).select("ts", "row", "col")
    return alone.unionByName(wet.where("_shared").select("ts", "row", "col").distinct())


def inundation_spans(pixels: DataFrame, stages: DataFrame, step: int, band: float = 0.25) -> DataFrame:
    """(row, col, wet_from, wet_to): the longest stretches of steps at which a pixel is wet, without forming pixel x time.

    A height becomes wet at the step whose stage reaches it while the stage before did not, and dry likewise; so the starts of a height are
    the stage rises that it lies in, and its ends the falls. Heights of a node are joined to rises and falls through height bands, and the k-th start goes
    with the k-th end. Pixels take the stretches of their height. A step is `step` microseconds; where one is missing, a stretch ends.
    Pixels under several nodes, or listed twice, are wet as long as one of them is. `pixels` and `stages` are as in `inundation`.
    """
    wet = stages.where(F.col("stage") >= F.col("bankfull")).groupBy("node", micros("ts").alias("at")).agg(F.max("stage").cast("double").alias("level"))
    wet = cut(wet)
    for name, away in (("before", step), ("after", -step)):
        wet = wet.join(wet.select("node", (F.col("at") + away).alias("at"), F.col("level").alias(name)), ["node", "at"], "left")
    places = pixels.where(F.col("hand").isNotNull()).select("row", "col", "node", F.col("hand").cast("double").alias("hand"))
    heights = places.select("node", "hand").distinct().withColumn("_band", F.floor(F.col("hand") / band))
    lowest = heights.agg(F.min("hand")).scalar()

    def crossings(other: str, name: str) -> DataFrame:
        """Steps at which a height lies above the stage beside and not above the own one."""
        low = F.greatest(F.coalesce(F.col(other), lowest), lowest)
        spans = wet.where(F.coalesce(F.col(other) < F.col("level"), F.lit(True)) & (F.col("level") >= lowest))
        spans = spans.withColumn("_band", F.explode(F.sequence(F.floor(low / band), F.floor(F.col("level") / band)))).withColumnRenamed(other, "_other")
        hit = heights.join(spans, ["node", "_band"]).where((F.col("hand") <= F.col("level")) & (F.col("_other").isNull() | (F.col("hand") > F.col("_other"))))
        w = Window.partitionBy("node", "hand").orderBy("at")
        return hit.select("node", "hand", F.col("at").alias(name), F.row_number().over(w).alias("k"))

    runs = crossings("before", "wet_from").join(crossings("after", "wet_to"), ["node", "hand", "k"]).drop("k")
    found = places.join(runs, ["node", "hand"])
    copies = places.groupBy("row", "col").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    found = found.join(copies, ["row", "col"])
    alone = found.where(~F.col("_shared")).select("row", "col", from_micros("wet_from").alias("wet_from"), from_micros("wet_to").alias("wet_to"))
    shared = found.where("_shared").select(F.struct("row", "col").alias("place"), from_micros("wet_from").alias("wet_from"), from_micros(F.col("wet_to") + step).alias("wet_to"))
    union = merge_intervals(shared, "place", "wet_from", "wet_to")
    return alone.unionByName(union.select("place.row", "place.col", "wet_from", from_micros(micros("wet_to") - step).alias("wet_to")))


def inundated_area(pixels: DataFrame, stages: DataFrame, cell_km2: float, columns: Sequence[str] = ("pred", "obs"), band: float = 0.25) -> DataFrame:
    """Wet area per (event, ts) for several stage columns, without forming pixel x time.

    Per node the pixels become a table of HAND value and count; a stage row
    sorted into it reads off how many pixels lie at or below.
    `stages` has (event_id, ts, node, bankfull) and the stage columns; pixels belong to one node.
    """
    counts = pixels.where(F.col("hand").isNotNull()).groupBy("node", F.col("hand").cast("double").alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    asks = stages.select("event_id", "ts", "node", F.explode(F.array(*[
        F.struct(F.lit(c).alias("side"), F.when(F.col(c) >= F.col("bankfull"), F.col(c)).cast("double").alias("h")) for c in columns])).alias("_a")).where("_a.h is not null")
    both = counts.select("node", "_h", "_c", F.lit(0).alias("_kind"), F.lit(None).cast(stages.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(stages.schema["ts"].dataType).alias("ts"), F.lit(None).cast("string").alias("side"))
    both = both.unionByName(asks.select("node", F.col("_a.h").alias("_h"), F.lit(0).cast("long").alias("_c"), F.lit(1).alias("_kind"), "event_id", "ts", F.col("_a.side").alias("side")))
    # pixels per height band first, then the order inside a band only: no node is one task's work
    both = both.withColumn("_band", F.floor(F.col("_h") / band))
    below = Window.partitionBy("node").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = both.groupBy("node", "_band").agg(F.sum("_c").alias("_n")).select("node", "_band", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_lower"))
    w = Window.partitionBy("node", "_band").orderBy("_h", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_n", F.sum("_c").over(w)).where("_kind = 1").join(bands, ["node", "_band"]).withColumn("_n", F.col("_n") + F.col("_lower"))
    frames = stages.select("event_id", "ts").distinct()
    area = hit.groupBy("event_id", "ts").agg(*[(F.sum(F.when(F.col("side") == c, F.col("_n"))) * cell_km2).alias(f"area_{c}_km2") for c in columns])
    return frames.join(area, ["event_id", "ts"], "left").fillna(0.0, [f"area_{c}_km2" for c in columns])


def subsample_frames(frames: DataFrame, event: str = "event_id", ts: str = "ts", max_frames: int | None = None) -> DataFrame:
    """Time steps of each event, all of them or `max_frames` spread evenly from the first on; an event is a bounded number of steps."""
    if max_frames is None:
        return frames
    w = Window.partitionBy(event)
    out = frames.withColumn("_i", F.row_number().over(w.orderBy(ts)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    place = F.floor(F.col("_i") * max_frames / F.col("_n"))
    before = F.floor((F.col("_i") - 1) * max_frames / F.col("_n"))
    return out.where((F.col("_i") == 0) | (place > before)).drop("_i", "_n")


def flood_probability(pixels: DataFrame, stages: DataFrame, temperature: float = 2.0) -> DataFrame:
    """Mean over covering nodes of sigmoid((tau stage - hand) / temperature), within 0..1. `stages` has (node, tau, stage)."""
    p = pixels.join(stages.where(F.col("stage").isNotNull()), "node")
    prob = 1 / (1 + F.exp(-(F.col("tau") * F.col("stage") - F.col("hand")) / temperature))
    return p.groupBy("row", "col").agg(F.least(F.sum(prob) / (F.count(F.lit(1)) + F.lit(1e-8)), F.lit(1.0)).alias("flood_prob"))


# --------------------------------------------------------------- SAR masks
def sar_change_mask(pixels: DataFrame, flood: str = "sigma0", ref: str = "sigma0_ref", change_db: float = -3.0, water_db: float = -15.0) -> DataFrame:
    """Pixels much darker than the reference after removing the median offset, or dark as open water."""
    f, r = F.col(flood), F.col(ref)
    ok = pixels.where(f.isNotNull() & r.isNotNull() & (f != 0) & (r != 0))
    bands = ok.select(F.explode(F.array(F.struct(F.lit(1).alias("sign"), f.cast("double").alias("v")), F.struct(F.lit(-1).alias("sign"), r.cast("double").alias("v")))).alias("_x")).select("_x.*")
    offset = exact_quantiles(bands, ["sign"], "v", {"m": 0.5}).agg(F.sum(F.col("sign") * F.col("m"))).scalar()  # both medians from one pass
    out = ok.withColumn("_off", offset).withColumn("change", (f - r) - F.col("_off"))
    return out.where((F.col("change") < change_db) | (f < water_db)).drop("_off")


def opening(mask: DataFrame, radius: int = 2) -> DataFrame:
    """Morphological opening by a square of side 2 radius + 1 (radius 2 = two passes of a 3x3 element).

    The square is separable: rows first, then columns, each a bounded window.
    Pixels outside the raster count as dry.
    """
    full = 2 * radius + 1
    m = mask.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    count = lambda w: {"_n": F.count(F.lit(1)).over(w.rangeBetween(-radius, radius))}
    along = over_axis(m, ["row"], "col", count, radius, radius).where(F.col("_n") == full).drop("_n")
    core = over_axis(along, ["col"], "row", count, radius, radius).where(F.col("_n") == full).drop("_n")
    offs = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    wide = core.withColumn("_o", offs).select("row", (F.col("col") + F.col("_o")).alias("col")).distinct()
    return wide.withColumn("_o", offs).select((F.col("row") + F.col("_o")).alias("row"), "col").distinct()


def drop_small_patches(mask: DataFrame, min_pixels: int = 50, tile: int = 1024) -> DataFrame:
    """Keep 4-connected patches of at least `min_pixels`.

    Pixels of a row that touch form a run inside a tile of columns, so a row of any length is many tasks; runs are joined below
    each other and over the tiles' borders. Components are found among the runs, which are far fewer than the pixels.
    """
    m = mask.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct().withColumn("_tile", F.floor(F.col("col") / tile))
    island = F.col("col") - F.row_number().over(Window.partitionBy("row", "_tile").orderBy("col"))
    runs = m.withColumn("_g", island).withColumn("_start", F.min("col").over(Window.partitionBy("row", "_tile", "_g")))
    pix = cut(runs.select("row", "col", cell_id("row", "_start").alias("run")))
    below = pix.select((F.col("row") - 1).alias("row"), "col", F.col("run").alias("dst"))
    beside = pix.where(F.pmod("col", F.lit(tile)) == 0).select("row", (F.col("col") - 1).alias("col"), F.col("run").alias("dst"))
    touching = pix.withColumnRenamed("run", "src").join(below.unionByName(beside), ["row", "col"]).select("src", "dst").distinct()
    size = pix.groupBy("run").agg(F.count(F.lit(1)).alias("_len"))
    comp = cut(connected_components(touching, size.select("run"), "run"))
    patch = size.join(comp, "run").groupBy("component").agg(F.sum("_len").alias("patch_size")).where(F.col("patch_size") >= min_pixels)
    keep = comp.join(patch, "component").select("run", "patch_size")
    return pix.join(keep, "run").select("row", "col", "patch_size")


def sar_flood_mask(pixels: DataFrame, max_hand: float = 5.0, min_pixels: int = 50, radius: int = 2, change_db: float = -3.0, water_db: float = -15.0) -> DataFrame:
    """Change mask, opened, without small patches, on the floodplain only."""
    raw = sar_change_mask(pixels, change_db=change_db, water_db=water_db)
    kept = drop_small_patches(opening(raw, radius), min_pixels)
    plain = pixels.where(F.col("hand") <= max_hand).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    return kept.join(plain, ["row", "col"], "left_semi")


# ------------------------------------------------------------------ scores
def map_scores(flags: DataFrame, cell_km2: float, by: Sequence[str] = (), pred: str = "pred", obs: str = "obs", mask: str | None = None) -> DataFrame:
    """Contingency scores of two wet maps; each ratio is 0 where its denominator is 0."""
    d = flags.where(F.col(mask)) if mask else flags
    p, o = F.coalesce(F.col(pred), F.lit(False)), F.coalesce(F.col(obs), F.lit(False))
    agg = d.groupBy(*by).agg(F.count_if(p & o).alias("tp"), F.count_if(p & ~o).alias("fp"), F.count_if(~p & o).alias("fn"), F.count_if(~p & ~o).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return agg.withColumns({
        "csi": ratio(tp, tp + fp + fn), "hit_rate": ratio(tp, tp + fn), "far": ratio(fp, tp + fp), "bias": ratio(tp + fp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "pred_km2": (tp + fp) * cell_km2, "obs_km2": (tp + fn) * cell_km2})


def join_maps(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """Wet pixel lists of two maps as one flag table."""
    p = pred.select("row", "col").distinct().withColumn("pred", F.lit(True))
    o = obs.select("row", "col").distinct().withColumn("obs", F.lit(True))
    return p.join(o, ["row", "col"], "full_outer").fillna(False, ["pred", "obs"])


def probability_scores(flags: DataFrame, prob: str = "prob", obs: str = "obs", cut_at: float = 0.5) -> DataFrame:
    """CSI, precision and recall of a probability map, guarded denominators."""
    p, o = F.col(prob) >= cut_at, F.col(obs)
    agg = flags.agg(F.count_if(p & o).alias("tp"), F.count_if(p & ~o).alias("fp"), F.count_if(~p & o).alias("fn"))
    tp, fp, fn, g = F.col("tp"), F.col("fp"), F.col("fn"), F.lit(1e-8)
    return agg.withColumns({"csi": tp / (tp + fp + fn + g), "precision": tp / (tp + fp + g), "recall": tp / (tp + fn + g)})


def threshold_sweep(pixels: DataFrame, thresholds: Sequence[float], cell_km2: float, hand: str = "hand", obs: str = "obs") -> DataFrame:
    """Map scores for several HAND thresholds; the thresholds unfold inside one aggregate's input."""
    swept = pixels.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))).withColumn("pred", F.col(hand) <= F.col("threshold"))
    return map_scores(swept, cell_km2, ["threshold"], obs=obs)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold of the highest CSI, the first on a tie."""
    return sweep.agg(F.min(F.struct((-F.col("csi")).alias("c"), F.col("threshold").alias("t"))).alias("_b")).select(F.col("_b.t").alias("threshold"), (-F.col("_b.c")).alias("csi"))


def design_extent_check(pred: DataFrame, extent: DataFrame, min_share: float = 0.8) -> DataFrame:
    """Share of the predicted wet pixels that lie inside a design extent."""
    inside = pred.join(extent.select("row", "col").distinct().withColumn("_in", F.lit(True)), ["row", "col"], "left")
    agg = inside.agg(F.count(F.lit(1)).alias("n_pred"), F.count("_in").alias("n_inside"))
    share = F.when(F.col("n_pred") > 0, F.col("n_inside") / F.col("n_pred")).otherwise(0.0)
    return agg.withColumn("share_inside", share).withColumn("verdict", F.when(share >= min_share, "plausible").otherwise("check"))


# ---------------------------------------------------------------- products
def raster_qc(pixels: DataFrame, value: str, by: Sequence[str] = (), dark_db: float = -16.0) -> DataFrame:
    """Moments, 5th and 95th percentile, valid share and dark share per raster or band."""
    by = list(by)
    v = F.col(value)
    agg = pixels.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.count(v) / F.count(F.lit(1))).alias("valid_frac"), F.try_divide(F.count_if(v < dark_db), F.count(v)).alias("dark_frac"))
    q = exact_quantiles(pixels, by, value, {"p5": 0.05, "p95": 0.95})
    if by:
        return agg.join(q, by)
    return agg.withColumn("p5", q.select("p5").scalar()).withColumn("p95", q.select("p95").scalar())


def median_composite(images: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pixel-wise median over images, nulls skipped; a pixel holds one value per image, so the group is small."""
    return images.groupBy(*by, "row", "col").agg(F.percentile(value, 0.5).alias("composite"), F.count(value).alias("n_images"))


def composite_coverage(composite: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return composite.groupBy(*by).agg((F.avg(F.col("composite").isNotNull().cast("double")) * 100).alias("coverage_pct"), F.count(F.lit(1)).alias("n_pixels"))


def envelope(points: DataFrame, x: str, y: str, buffer: float = 5000.0, grid: float = 100.0) -> DataFrame:
    """Bounding box with a buffer, rounded outwards."""
    return points.agg(
        (F.floor((F.min(x) - buffer) / grid) * grid).cast("double").alias("x_min"), (F.floor((F.min(y) - buffer) / grid) * grid).cast("double").alias("y_min"),
        (F.ceil((F.max(x) + buffer) / grid) * grid).cast("double").alias("x_max"), (F.ceil((F.max(y) + buffer) / grid) * grid).cast("double").alias("y_max"))


def footprint_overlap(points: DataFrame, scene: str, box: tuple[float, float, float, float], x: str = "lon", y: str = "lat") -> DataFrame:
    """Does the box of a scene's control points strictly overlap the given box on all four sides?"""
    x0, y0, x1, y1 = box
    b = points.groupBy(scene).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
    return b.withColumn("overlaps", (F.col("x_min") < x1) & (F.col("x_max") > x0) & (F.col("y_min") < y1) & (F.col("y_max") > y0))


def outside_box(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = box
    return points.where(~(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)))
