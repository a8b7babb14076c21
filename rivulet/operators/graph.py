"""River network: edge tables, gates, distances, components, reachability and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import expr as X
from rivulet.plans.fixpoint import cut
from rivulet.plans.timechunks import STEP, from_micros, micros

# fixed values: text that marks a bridge in a gauge name
BRIDGE_PATTERN = r"(?i)bridge|br$|br\s"


def _ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], node: str = "node") -> DataFrame:
    """Edge table with the given node columns of both ends as s_<col> and d_<col>."""
    s = nodes.select(F.col(node).alias("src"), *[F.col(c).alias(f"s_{c}") for c in columns])
    d = nodes.select(F.col(node).alias("dst"), *[F.col(c).alias(f"d_{c}") for c in columns])
    return edges.join(s, "src").join(d, "dst")


# ------------------------------------------------------------- edge tables
def river_edges(edges: DataFrame, nodes: DataFrame, node: str = "node", min_km: float = 0.1) -> DataFrame:
    """Edges whose ends are both known, with a floor on the distance."""
    known = nodes.select(F.col(node).alias("_n"))
    ok = edges.join(known, F.col("src") == F.col("_n"), "left_semi").join(known, F.col("dst") == F.col("_n"), "left_semi")
    return ok.withColumn("dist_km", F.greatest("dist_km", F.lit(min_km)))


def unknown_edges(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with an end that is not a node: the reject table of `river_edges`."""
    known = nodes.select(F.col(node).alias("_n"))
    no_src = edges.join(known, F.col("src") == F.col("_n"), "left_anti").withColumn("unknown_end", F.lit("src"))
    no_dst = edges.join(known, F.col("dst") == F.col("_n"), "left_anti").withColumn("unknown_end", F.lit("dst"))
    return no_src.unionByName(no_dst)


def tributary_edges(stations: DataFrame, confluences: DataFrame) -> DataFrame:
    """Consecutive stations by area within each water body, and the last one to its confluence station.

    `confluences` maps water_body -> dst; areas tie by node.
    """
    w = Window.partitionBy("water_body").orderBy("area_km2", "node")
    intra = stations.select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), F.lit("intra").alias("edge_type")).where("dst is not null")
    last = stations.groupBy("water_body").agg(F.max(F.struct("area_km2", "node")).alias("_m")).select("water_body", F.col("_m.node").alias("src"))
    known = stations.select(F.col("node").alias("_n"))
    conf = last.join(confluences, "water_body").join(known, F.col("dst") == F.col("_n"), "left_semi").select("src", "dst", F.lit("confluence").alias("edge_type"))
    return intra.unionByName(conf)


def edge_attributes(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """River distance (straight line where it is implausibly short), area ratio, datum drop and class."""
    e = _ends(edges, stations, ("lat", "lon", "area_km2", "datum", "river_cum_km"))
    line = X.haversine_km(F.col("s_lat"), F.col("s_lon"), F.col("d_lat"), F.col("d_lon"))
    along = F.abs(F.col("d_river_cum_km") - F.col("s_river_cum_km"))
    intra = F.col("edge_type") == "intra"
    dist = F.when(intra & (along >= line * 0.5), along).otherwise(line)
    return e.select(
        "src", "dst", "edge_type", F.greatest(dist, F.lit(0.1)).alias("dist_km"), ((F.col("d_area_km2") + 1) / (F.col("s_area_km2") + 1)).alias("area_ratio"),
        (F.col("s_datum") - F.col("d_datum")).alias("elev_drop"), F.when(intra, 1.0).otherwise(0.5).alias("same_tributary"))


def mask_reservoir_drop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elevation drop is meaningless next to a reservoir: 0 if either end is one."""
    e = _ends(edges, nodes, ("is_reservoir",))
    return e.withColumn("elev_drop", F.when(F.col("s_is_reservoir") | F.col("d_is_reservoir"), 0.0).otherwise(F.col("elev_drop"))).drop("s_is_reservoir", "d_is_reservoir")


def backwater_edges(nodes: DataFrame, edges: DataFrame, order: str = "edge_order", pattern: str = BRIDGE_PATTERN) -> DataFrame:
    """Reversed edge from every bridge gauge to its first upstream neighbour, if it also drains somewhere else."""
    bridges = nodes.where(F.col("name").rlike(pattern)).select(F.col("node").alias("bridge"), F.col("name").alias("bridge_name"), F.col("p90").alias("gate_reference"))
    rest = ["dist_km", "area_ratio", "elev_drop", "same_tributary"]
    up = edges.groupBy(F.col("dst").alias("bridge")).agg(F.min(F.struct(order, F.col("src").alias("up"), *rest)).alias("_u")).select("bridge", "_u.*")
    onward = edges.select(F.col("src").alias("bridge"), F.col("dst").alias("_down"))
    hit = bridges.join(up, "bridge").alias("b").join(onward.alias("o"), (F.col("b.bridge") == F.col("o.bridge")) & (F.col("o._down") != F.col("b.up")), "left_semi")
    ratio = F.when(F.col("area_ratio") != 0, 1 / F.col("area_ratio")).otherwise(1.0)
    return hit.select(F.col("bridge").alias("src"), F.col("up").alias("dst"), "bridge_name", "dist_km", ratio.alias("area_ratio"), (-F.col("elev_drop")).alias("elev_drop"), "same_tributary", "gate_reference")


def network_edges(overland: DataFrame, knn: DataFrame, river: DataFrame) -> DataFrame:
    """Both-way network: overland edges, neighbours where nothing joins the pair, river edges where shorter.

    Each input has (src, dst, dist_km).
    """
    tagged = [df.select("src", "dst", "dist_km", F.lit(rank).alias("rank")) for rank, df in enumerate((overland, knn, river))]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    both = both.select("src", "dst", "dist_km", "rank").unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_km", "rank"))
    best = both.where("src <> dst").groupBy("src", "dst").agg(
        F.min(F.when(F.col("rank") < 2, F.struct("rank", "dist_km"))).alias("_base"), F.min(F.when(F.col("rank") == 2, F.col("dist_km"))).alias("_river"))
    use_river = F.col("_base").isNull() | (F.col("_river") < F.col("_base.dist_km"))
    return best.select("src", "dst", F.when(use_river, F.col("_river")).otherwise(F.col("_base.dist_km")).alias("dist_km"),
                       F.when(use_river, "river").when(F.col("_base.rank") == 0, "overland").otherwise("neighbour").alias("edge_class"))


# ------------------------------------------------------------------- gates
def travel_times(pairs: DataFrame, velocity: DataFrame, celerity: float = 5 / 3) -> DataFrame:
    """Hours a flood wave needs, from the source node's velocity; null where unreachable."""
    v = velocity.select(F.col("node").alias("src"), "velocity")
    return pairs.join(v, "src", "left").withColumn("travel_time_h", X.travel_time_h(F.col("dist_km"), F.col("velocity"), celerity)).drop("velocity")


def concentration_time(nodes: DataFrame, edges: DataFrame, divisor: float = 3600.0) -> DataFrame:
    """Concentration time in hours from channel length and slope, within 0.25 .. 8."""
    up = edges.groupBy(F.col("dst").alias("node")).agg(F.max("elev_drop").alias("_up"))
    length = 1500.0 * F.sqrt(F.greatest("area_km2", F.lit(0.01)))
    head = F.greatest(F.col("p90") - F.col("datum"), F.lit(0.5), F.coalesce("_up", F.lit(0.0)))
    slope = F.greatest(F.col("_head") / F.col("_len"), F.lit(0.0002))
    out = nodes.join(up, "node", "left").withColumn("_len", length).withColumn("_head", head).withColumn("_slope", slope)
    tc = 0.0195 * F.pow("_len", F.lit(0.77)) * F.pow("_slope", F.lit(-0.385)) / divisor
    return out.select("node", X.clip(tc, 0.25, 8.0).alias("tc_hours"))


def kinematic_lag(edges: DataFrame, nodes: DataFrame, manning: float = 0.035, step_minutes: int = 15) -> DataFrame:
    """Flood-wave lag of each edge in steps (at least 1); edges under 100 m take one step."""
    depth = nodes.select(F.col("node").alias("dst"), F.greatest(F.col("p90") - F.col("datum"), F.lit(0.3)).alias("_depth"))
    e = edges.join(depth, "dst", "left").withColumn("_depth", F.coalesce("_depth", F.lit(1.0)))
    dist = F.col("dist_km") * 1000
    slope = F.greatest(F.try_divide(F.col("elev_drop"), dist), F.lit(0.0001))
    speed = F.greatest(F.pow(F.col("_depth") * 0.6, F.lit(2 / 3)) * F.sqrt(slope) / manning, F.lit(0.1))
    steps = F.greatest(F.rint(dist / (speed * (5 / 3)) / (step_minutes * 60)).cast("int"), F.lit(1))
    return e.select("src", "dst", F.when(dist < 100, 1).otherwise(steps).alias("kinematic_lag"))


def conductance_gate(edges: DataFrame, state: DataFrame, q_ref: Column, scale: float = 1.0) -> DataFrame:
    """Conductance sigmoid(k (Q / Qref - 1)) of the upstream node's discharge, and its logarithm."""
    q = state.select(F.col("node").alias("src"), "ts", "discharge")
    gate = X.sigmoid(F.lit(scale) * (F.col("discharge") / (F.col("_q") + 1e-8) - 1))
    out = edges.join(q, "src").withColumn("_q", q_ref).withColumn("conductance", gate)
    return out.withColumn("log_conductance", F.log(F.col("conductance") + 1e-6)).drop("_q", "discharge")


def water_level(state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Absolute water surface: datum + normalised position x stage range."""
    return state.join(nodes.select("node", "datum", "stage_range"), "node").select("node", "ts", (F.col("datum") + F.col("norm_stage") * F.col("stage_range")).alias("level"))


def stage_gate(overland: DataFrame, levels: DataFrame, sharpness: float = 2.0) -> DataFrame:
    """Activation of overland edges: sigmoid(a (higher water surface - saddle))."""
    s = levels.select(F.col("node").alias("src"), "ts", F.col("level").alias("_s"))
    d = levels.select(F.col("node").alias("dst"), "ts", F.col("level").alias("_d"))
    out = overland.join(s, "src").join(d, ["dst", "ts"])
    return out.withColumn("activation", X.sigmoid(F.lit(sharpness) * (F.greatest("_s", "_d") - F.col("z_saddle_m")))).drop("_s", "_d")


def saturation_gate(state: DataFrame, saturation: str, sharpness: float = 10.0, threshold: float = 0.8) -> DataFrame:
    """One gate per time step from the network's mean saturation; it applies to every overland edge."""
    return state.groupBy("ts").agg(F.avg(saturation).alias("mean_saturation")).withColumn("activation", X.sigmoid(F.lit(sharpness) * (F.col("mean_saturation") - threshold)))


def backwater_gate(backwater: DataFrame, levels: DataFrame, sharpness: float = 2.0) -> DataFrame:
    """Activation of backwater edges: sigmoid(a (bridge water surface - reference))."""
    lv = levels.select(F.col("node").alias("src"), "ts", F.col("level").alias("_l"))
    return backwater.join(lv, "src").withColumn("activation", X.sigmoid(F.lit(sharpness) * (F.col("_l") - F.col("gate_reference")))).drop("_l")


def edge_states(river: DataFrame, overland: DataFrame, backwater: DataFrame) -> DataFrame:
    """All edge classes per time step: river edges carry log conductance and are open, the others their gate."""
    r = river.select("src", "dst", "ts", F.lit("river").alias("edge_class"), "log_conductance", F.lit(1.0).alias("activation"))
    none = F.lit(None).cast("double").alias("log_conductance")
    parts = [df.select("src", "dst", "ts", F.lit(c).alias("edge_class"), none, "activation") for df, c in ((overland, "overland"), (backwater, "backwater"))]
    return r.unionByName(parts[0]).unionByName(parts[1])


def datum_and_range(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Listed nodes take their terrain elevation as datum and a range of 1.5; ranges of 0.01 or less become 1."""
    o = overrides.select("node", F.col("elev").alias("_elev"))
    out = nodes.join(o, "node", "left")
    rng = F.when(F.col("_elev").isNotNull(), 1.5).otherwise(F.col("p90") - F.col("datum"))
    return out.select("node", F.coalesce("_elev", "datum").alias("datum"), F.when(rng > 0.01, rng).otherwise(1.0).alias("stage_range"))


# ------------------------------------------------------- iterative operators
def shortest_distances(edges: DataFrame, max_dist: float) -> DataFrame:
    """Shortest distance of every ordered pair within `max_dist` (src <> dst).

    Paths double: a round joins the pairs improved in the round before with all known pairs, on either
    side, so the number of rounds is logarithmic in the number of edges of a path, and pairs that
    settled early meet only those that still change.
    """
    known = cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("dist_km").alias("d")).where(F.col("d") <= max_dist))
    fresh = known
    while True:
        ahead = fresh.select("src", F.col("dst").alias("mid"), "d").join(known.select(F.col("src").alias("mid"), "dst", F.col("d").alias("_d")), "mid")
        behind = known.select("src", F.col("dst").alias("mid"), "d").join(fresh.select(F.col("src").alias("mid"), "dst", F.col("d").alias("_d")), "mid")
        longer = ahead.unionByName(behind).select("src", "dst", (F.col("d") + F.col("_d")).alias("d"))
        longer = longer.where((F.col("src") != F.col("dst")) & (F.col("d") <= max_dist)).groupBy("src", "dst").agg(F.min("d").alias("d"))
        old = known.select("src", "dst", F.col("d").alias("_old"))
        # sums in another order may differ in the last digit; that is no improvement
        merged = cut(old.join(longer, ["src", "dst"], "full").select("src", "dst", "_old", "d", (F.coalesce(F.col("d") < F.col("_old") - 1e-9, F.col("_old").isNull())).alias("_better")), compact=True)
        fresh = merged.where("_better").select("src", "dst", "d")
        known = merged.select("src", "dst", F.when(F.col("_better"), F.col("d")).otherwise(F.col("_old")).alias("d"))
        if fresh.isEmpty():
            return known.withColumnRenamed("d", "dist_km")


def edge_features(distances: DataFrame, nodes: DataFrame, max_km: float = 80.0) -> DataFrame:
    """Pairs i <> j within `max_km` with elevation and HAND differences."""
    e = _ends(distances.where((F.col("src") != F.col("dst")) & (F.col("dist_km") <= max_km)), nodes, ("elev", "hand"))
    return e.select("src", "dst", "dist_km", (F.col("s_elev") - F.col("d_elev")).alias("elev_diff_m"), (F.col("s_hand") - F.col("d_hand")).alias("hand_diff_m"))


def connected_components(edges: DataFrame, nodes: DataFrame, node: str = "node", max_rounds: int = 100) -> DataFrame:
    """Smallest node of each node's component, by alternating star contractions.

    Every round links neighbours to the smallest node around them, which shortens
    chains geometrically; minima combine map-side, so a hub is not a bottleneck.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    state = cut(pairs)
    mark = None
    for _ in range(max_rounds):
        # large star: bigger neighbours of u point to the smallest of u and its neighbours
        both = state.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(state.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        large = cut(large)
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").select(F.least("lo", "m").alias("a"), F.greatest("lo", "m").alias("b")).where("a <> b")
        state = cut(moved.select(F.col("a").alias("lo"), F.col("b").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct())
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components still merging; raise max_rounds")
    label = state.groupBy(F.col("hi").alias(node)).agg(F.min("lo").alias("_c"))
    return nodes.select(node).join(label, node, "left").select(node, F.coalesce("_c", node).alias("component"))


def isolated_nodes(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    touched = edges.select(F.col("src").alias(node)).unionByName(edges.select(F.col("dst").alias(node)))
    return nodes.join(touched, node, "left_anti")


def downstream_edges(sources: DataFrame, edges: DataFrame, max_hops: int | None = None, order: str = "edge_order", lag: str | None = None, default_lag: int = 2, gain: float = 0.75) -> DataFrame:
    """Breadth-first edges from every source at once: hop, edge, cumulative lag and gain along the tree.

    A node reached by several edges in the same hop belongs to the one met first in queue order: the order of the paths' edges, an edge being
    ordered by its number, then its ends. `max_hops=None`, the default, follows every path to its end.

    Paths double, so the rounds are logarithmic in the longest path. The state holds all pairs of nodes up to a number of hops, each with its
    place in the queue of its first node at that hop. A round joins the pairs at exactly that number with all pairs; a prefix of a first path is a first
    path, so the places of both halves order the new pairs as the whole paths would.
    """
    lag_col = F.coalesce(F.col(lag), F.lit(default_lag)) if lag else F.lit(default_lag)
    one = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct(F.col(order).alias("o"), "src", "dst", lag_col.cast("long").alias("l"))).alias("_e"))
    place = F.row_number().over(Window.partitionBy("u", "hop").orderBy("at"))
    known = one.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("hop"), F.struct("_e.o", "dst").alias("at"), F.col("src").alias("via"), F.col("_e.l").alias("lag_steps"))
    known = cut(known.withColumn("place", place).drop("at"))
    far = 1
    while max_hops is None or far < max_hops:
        ends = known.where(F.col("hop") == far).select("u", F.col("v").alias("mid"), F.col("place").alias("_p"), F.col("lag_steps").alias("_l"))
        if ends.isEmpty():
            break
        longer = ends.join(known.withColumnRenamed("u", "mid"), "mid").where("u <> v").select(
            "u", "v", (F.col("hop") + far).alias("hop"), F.struct("_p", "place").alias("at"), "via", (F.col("_l") + F.col("lag_steps")).alias("lag_steps"))
        fresh = longer.join(known.select("u", "v"), ["u", "v"], "left_anti")
        won = fresh.groupBy("u", "v").agg(F.min(F.struct("hop", "at", "via", "lag_steps")).alias("_w")).select("u", "v", "_w.*")
        known = cut(known.unionByName(won.withColumn("place", place).drop("at")), compact=True)
        far *= 2
    if max_hops is not None:
        known = known.where(F.col("hop") <= max_hops)
    damped = F.aggregate(F.sequence(F.lit(1), F.col("hop")), F.lit(1.0), lambda g, _: g * gain)
    reached = known.join(sources.select(F.col("node").alias("u")).distinct(), "u")
    return reached.select(F.col("u").alias("source"), F.col("via").alias("src"), F.col("v").alias("dst"), "hop", "lag_steps", damped.alias("gain"))


def criticality(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """Number of nodes downstream of each node; sort by it, descending, for the most critical first."""
    n = reach.groupBy(F.col("source").alias("node")).agg(F.count_distinct("dst").alias("n_downstream"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("n_downstream", F.lit(0)).alias("n_downstream"))


def headwaters(nodes: DataFrame, n: int = 6) -> DataFrame:
    return nodes.where(~F.col("is_tidal") & ~F.col("is_reservoir")).orderBy("area_km2", "node").limit(n)


def downstream_nodes(nodes: DataFrame, n: int = 5, reachable: DataFrame | None = None) -> DataFrame:
    """Largest catchments without reservoirs, optionally only nodes that some source reaches."""
    pick = nodes.where(~F.col("is_reservoir"))
    if reachable is not None:
        pick = pick.join(reachable.select(F.col("dst").alias("node")), "node", "left_semi")
    return pick.orderBy(F.desc("area_km2"), "node").limit(n)


def route_signal(signal: DataFrame, reach: DataFrame, ts: str = "ts", value: str = "value", step: int = STEP) -> DataFrame:
    """Sum over sources of the signal delayed by the path's lag and damped by its gain."""
    moved = signal.select(F.col("node").alias("source"), micros(ts).alias("_us"), F.col(value).alias("_v")).join(reach.select("source", "dst", "lag_steps", "gain"), "source")
    at = F.col("_us") + F.col("lag_steps") * step
    return moved.groupBy(F.col("dst").alias("node"), from_micros(at).alias(ts)).agg(F.sum(F.col("_v") * F.col("gain")).alias("routed"))


def unit_response(rain: DataFrame, params: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value", step: int = STEP) -> DataFrame:
    """Rain totals convolved with a triangular response: rise over 0.6 tc, back to zero at 2.67 tc.

    `params` gives peak_rate and tc_hours per series. Each rain row unfolds into its whole response.
    """
    rise = F.greatest(F.rint(0.6 * F.col("tc_hours") * 4).cast("int"), F.lit(1))
    base = F.greatest(F.rint(2.67 * F.col("tc_hours") * 4).cast("int"), F.lit(2))
    r = rain.where(F.col(value) != 0).join(params, list(keys)).withColumn("_rise", rise).withColumn("_base", base)
    r = r.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest("_rise", "_base") - 1)))
    shape = F.when(F.col("_k") < F.col("_rise"), F.col("_k") / F.col("_rise")).otherwise((F.col("_base") - F.col("_k")) / (F.col("_base") - F.col("_rise")))
    at = micros(ts) + F.col("_k").cast("long") * step
    return r.groupBy(*keys, from_micros(at).alias(ts)).agg(F.sum(F.col(value) * F.col("peak_rate") * shape).alias("response"))

