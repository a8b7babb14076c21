"""Cross-section profiles and tributary chainage. A profile is a few hundred points, so windows run per section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.quality import drop_profile_outliers


def tributary_chainage(segments: DataFrame, base: str = "base_name", seg: str = "seg_num", length: str = "length_km") -> DataFrame:
    """River kilometres upstream of each segment: exclusive running sum per tributary."""
    w = Window.partitionBy(base).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("cum_start_km", F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def vertex_chainage(vertices: DataFrame, section: str = "section_id", part: str = "part", order: str = "i", x: str = "x", y: str = "y") -> DataFrame:
    """Running length over ordered vertices; parts of a section follow each other, the gap between them does not count."""
    w = Window.partitionBy(section).orderBy(part, order)
    same = F.lag(part).over(w) == F.col(part)
    step = F.when(same, F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2)).otherwise(0.0)
    return vertices.withColumn("_d", step).withColumn("chainage", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def bankfull_from_markers(points: DataFrame, keys: Sequence[str], order: str = "i", level: str = "level", marker: str = "panel_boundary") -> DataFrame:
    """Bankfull = lower of the last marked point left and the first one right of the lowest point."""
    named = points.where(" and ".join(f"`{k}` is not null" for k in keys))
    # the lowest point by a window and not by a join: the points are made and dealt out once
    d = named.withColumn("_t", F.min(F.struct(level, order)).over(Window.partitionBy(*keys)))
    left, right = F.col(marker) & (F.col(order) < F.col(f"_t.{order}")), F.col(marker) & (F.col(order) > F.col(f"_t.{order}"))
    out = d.groupBy(*keys).agg(
        F.min(level).alias("thalweg"), F.max_by(F.when(left, F.col(level)), F.when(left, F.col(order))).alias("left_bank"), F.min_by(F.when(right, F.col(level)), F.when(right, F.col(order))).alias("right_bank"), F.count(F.lit(1)).alias("n_points"))
    return out.withColumn("bankfull", F.least("left_bank", "right_bank")).withColumn("depth", F.col("bankfull") - F.col("thalweg"))


def estimate_bankfull(profile: DataFrame, keys: Sequence[str], chainage: str = "chainage", elev: str = "elev", banks: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Bankfull per section: given banks, else the breaks in slope around the lowest point, else 90th percentiles per side.

    Points farther than 3 deviations from the median are removed first; sections with
    fewer than 3 points left are reported without a value. `banks` holds bank_left, bank_right.
    """
    keys = list(keys)
    tie = [order] if order else []
    known = profile.where(F.col(elev).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_raw"))
    kept = drop_profile_outliers(known.select(*keys, chainage, elev, *tie), keys, elev)
    w = Window.partitionBy(*keys).orderBy(chainage, *tie)
    c = kept.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    dx, dz = F.lead(chainage).over(w) - F.col(chainage), F.lead(elev).over(w) - F.col(elev)
    # slope k belongs to the segment k .. k+1; the last point has none
    c = c.withColumn("_slope", F.abs(dz / F.when(dx == 0, 1e-6).otherwise(dx))).withColumn("_next_elev", F.lead(elev).over(w))
    near = lambda k: F.coalesce((F.lag if k < 0 else F.lead)("_slope").over(w), F.lit(0.0))
    c = c.withColumn("s", F.when(F.col("_slope").isNotNull(), (near(-1) + F.col("_slope") + near(1)) / 3))
    c = c.withColumn("_s_prev", F.lag("s").over(w)).withColumn("_s_next", F.lead("s").over(w))
    thal = c.groupBy(*keys).agg(F.min(F.struct(F.col(elev).alias("z"), "i")).alias("_t"))
    c = c.join(thal, keys)
    ti, m = F.col("_t.i"), F.col("n") - 1
    steep = F.col("s") > 0.05
    left = (F.col("i") <= ti) & (F.col("i") >= 1) & (F.col("i") < m - 1) & steep & (F.col("_s_prev") < 0.03)
    right = (F.col("i") >= ti) & (F.col("i") < m - 1) & steep & (F.col("_s_next") < 0.03)
    on_left = F.when(ti > 0, F.col("i") < ti).otherwise(F.lit(True))
    on_right = F.when(ti < F.col("n"), F.col("i") >= ti).otherwise(F.lit(True))
    side = lambda cond: (F.count(F.when(cond, F.col(elev))), F.percentile(F.when(cond, F.col(elev)), 0.9))
    (nl, pl), (nr, pr) = side(on_left), side(on_right)
    agg = c.groupBy(*keys).agg(
        F.min(elev).alias("thalweg"), F.max("n").alias("n_points"), F.max_by(F.when(left, F.col(elev)), F.when(left, F.col("i"))).alias("_bl"),
        F.min_by(F.when(right, F.col("_next_elev")), F.when(right, F.col("i"))).alias("_br"), F.min(F.when(right, F.col("i"))).alias("_ri"),
        nl.alias("_nl"), pl.alias("_pl"), nr.alias("_nr"), pr.alias("_pr"))
    # a break at the very first point counts as not found
    br = F.when(F.col("_ri") > 0, F.col("_br"))
    pl_, pr_ = F.when(F.col("_nl") > 2, F.col("_pl")), F.when(F.col("_nr") > 2, F.col("_pr"))
    out = sizes.join(agg, keys, "left")
    if banks is not None:
        out = out.join(banks, keys, "left")
    else:
        out = out.withColumn("bank_left", F.lit(None).cast("double")).withColumn("bank_right", F.lit(None).cast("double"))
    ok = (F.col("_raw") >= 3) & (F.coalesce("n_points", F.lit(0)) >= 3)
    given = F.coalesce("bank_left", "bank_right").isNotNull()
    slope = (F.col("n_points") >= 6) & F.coalesce("_bl", br).isNotNull()
    pick = lambda a, b, d: F.when(~ok, None).when(given, a).when(slope, b).otherwise(d)
    lb, rb = pick(F.col("bank_left"), F.col("_bl"), pl_), pick(F.col("bank_right"), br, pr_)
    method = F.when(F.col("_raw") < 3, "insufficient_points").when(~ok, "outlier_filtered_too_short").when(given, "explicit_bank_attribute").when(slope, "break_in_slope").when(F.coalesce(pl_, pr_).isNotNull(), "percentile_90_fallback")
    return out.select(*keys, F.when(ok, F.col("thalweg")).alias("thalweg"), lb.alias("left_bank"), rb.alias("right_bank"), F.least(lb, rb).alias("bankfull"), method.alias("method"))
