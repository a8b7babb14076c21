"""Nearest-neighbour and radius joins by grid cells, exact at any distance, without a cross join.

Most nearest neighbours are found in the touching cells of an even grid. The others go down a tree of cells that is as deep as the references are dense. Only crowded cells are split, so a crowd of
references costs depth where it is and nothing elsewhere. Each point carries the few cells that can still hold a hit; a level opens them and drops those
that lie farther away than what is known to be near enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut

EARTH_RADIUS_KM = 6371.0

#: Cells along each axis of a split cell, most references of a leaf, deepest level.
FAN, LEAF, DEEPEST = 4, 16, 22
#: Cells to a radius, most points and references of a block of a radius join, and most references around a cell that are compared at once.
PARTS, BLOCK, AROUND = 2, (512, 2048), 256
#: Rows of a part before they are copied to blocks, pairs that a task of a radius join compares, most rows that go to every task, most tasks.
SPREAD, COMPARED, FEW, TASKS = 2000, 1 << 22, 100_000, 20_000
#: Slack of distances: relative, and absolute in squared units, for rounding of coordinates and of the ranking distance.
SLACK, ABSOLUTE = 1e-6, 2e-9


def unit_sphere(lat: Column, lon: Column) -> list[Column]:
    """Cartesian coordinates on the unit sphere; chord length orders like great-circle distance."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def cell_of(axes: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(size)).alias(f"_c{i}") for i, a in enumerate(axes)]


def neighbour_cells(axes: Sequence[str], size: float, reach: int = 1, half: bool = False) -> Column:
    """All cells at most `reach` cells away from the cell of a point on each axis, as an array to explode; with `half` one of each two opposite ones."""
    cells = cell_of(axes, size)
    return F.array(
        *[
            F.struct(*[(c + F.lit(d)).alias(f"_c{i}") for i, (c, d) in enumerate(zip(cells, offs))])
            for offs in product(range(-reach, reach + 1), repeat=len(cells))
            if not half or offs <= (0,) * len(cells)
        ]
    )


def blocks_of(n_axes: int) -> list[str]:
    """Columns that name the block in which `within_radius` brings a pair together."""
    return [*[f"_c{i}" for i in range(n_axes)], "_gx", "_gy"]


def within_radius(points: DataFrame, refs: DataFrame, axes: Sequence[str], ref_axes: Sequence[str], radius: float, keep_blocks: bool = False) -> DataFrame:
    """Pairs that lie within PARTS cells of size radius / PARTS: a superset of the pairs within it, each pair once.

    In crowded cells points are dealt over the columns and references over the rows of a grid, so a block has about BLOCK rows of each
    side at most, however many lie at one place. `keep_blocks` leaves the columns that name the block.
    """
    size = radius / PARTS
    home = _spread(points).select("*", *cell_of(axes, size))
    away = _spread(refs).withColumn("_cell", F.explode(neighbour_cells(ref_axes, size, PARTS))).select("*", "_cell.*").drop("_cell")
    pairs = _met(home, away, points.columns, refs.columns, len(axes))
    return pairs if keep_blocks else pairs.drop(*blocks_of(len(axes)))


def pairs_within(places: DataFrame, axes: Sequence[str], ref_axes: Sequence[str], radius: float, known: DataFrame) -> DataFrame:
    """Pairs of rows of `places` (i, axes) with different i and not in `known` (i, j): a superset of those within `radius`, with the columns of their block.

    Each pair comes once, in either order, as (i, axes, j, ref_axes): of two cells only one opens to the other. Pairs in `known` are left out in their block,
    so no pair is moved.
    """
    size = radius / PARTS
    places = _spread(places.select("i", *axes).where(_finite(axes)))
    refs = places.select(F.col("i").alias("j"), *[F.col(a).alias(b) for a, b in zip(axes, ref_axes)])
    home = places.select("*", *cell_of(axes, size))
    away = refs.withColumn("_cell", F.explode(neighbour_cells(ref_axes, size, PARTS, half=True))).select("*", "_cell.*").drop("_cell")
    own = reduce(and_, [c == F.col(f"_c{k}") for k, c in enumerate(F.floor(F.col(b) / F.lit(size)) for b in ref_axes)])
    away = away.withColumn("_own", own)
    ends = known.unionByName(known.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    pairs = _met(home, away, places.columns, refs.columns, len(axes), ends)
    return pairs.where((F.col("i") < F.col("j")) | (~F.col("_own") & (F.col("i") > F.col("j")))).drop("_own")


def _spread(df: DataFrame) -> DataFrame:
    """The rows in parts of about SPREAD: a small file of many places would be one task, and each row is copied to several blocks."""
    df = cut(df)
    return df.repartition(min(df.count() // SPREAD + 1, TASKS))


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that goes to every task if it has few rows and is merged if not, whatever Spark takes its size to be."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _met(home: DataFrame, away: DataFrame, point: Sequence[str], ref: Sequence[str], n_axes: int, ends: DataFrame | None = None) -> DataFrame:
    """Rows of `home` with those of `away` in the same cell, by blocks; `point` and `ref` are the columns that deal them. Pairs (i, j) in `ends` are left out.

    The number of tasks grows with the pairs to compare, not with the bytes of the rows, which are few.
    """
    cells, keys = [f"_c{i}" for i in range(n_axes)], blocks_of(n_axes)
    many, held = (df.groupBy(*cells).agg(F.count(F.lit(1)).alias(n)) for df, n in ((home, "_p"), (away, "_r")))
    lines = {n: F.ceil(F.col(n) / most).cast("int") for n, most in zip(("_p", "_r"), BLOCK)}
    grid = cut(many.join(held.hint("merge"), cells).select(*cells, lines["_p"].alias("_columns"), lines["_r"].alias("_rows"), (F.col("_p") * F.col("_r")).alias("_pairs")))
    size = grid.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("_pairs"), F.lit(0)).alias("pairs")).first()
    tasks = min(size.pairs // COMPARED + 1, TASKS)
    grid = _beside(grid.drop("_pairs"), size.cells)
    any_of = lambda columns, n: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = away.join(grid, cells).withColumn("_gy", any_of(ref, "_rows")).drop("_rows")
    left = home.join(grid, cells).withColumn("_gx", any_of(point, "_columns")).withColumn("_gy", each("_rows")).drop("_columns", "_rows")
    if ends is not None:
        there = ends.join(home.select("i", *cells).distinct(), "i")
        met = there.join(right.select("j", *cells, "_gy").hint("merge"), ["j", *cells])
        barred = cut(met.groupBy(*cells, "i", "_gy").agg(F.collect_set("j").alias("_barred")))
        rows = barred.agg(F.coalesce(F.sum(F.size("_barred")), F.lit(0))).first()[0]
        left = left.join(_beside(barred, rows), [*cells, "i", "_gy"], "left")
    right = right.withColumn("_gx", each("_columns")).drop("_columns")
    if tasks > 1:  # Spark takes its usual number if that is larger; for fewer pairs than one task's it may merge small parts
        left, right = (df.repartition(tasks, *keys) for df in (left, right))
    pairs = left.join(right.hint("merge"), keys)
    if ends is not None:
        pairs = pairs.where(F.col("_barred").isNull() | ~F.array_contains("_barred", F.col("j"))).drop("_barred")
    return pairs


def near_any(points: DataFrame, refs: DataFrame, axes: Sequence[str], ref_axes: Sequence[str], radius: float) -> DataFrame:
    """The points whose cell of size `radius` touches the cell of a reference: none within the radius of one is missing."""
    keys = [f"_c{i}" for i in range(len(axes))]
    taken = refs.select(*cell_of(ref_axes, radius)).distinct()
    around = taken.select(F.explode(F.array(*[F.struct(*[(F.col(k) + d).alias(k) for k, d in zip(keys, offs)]) for offs in product((-1, 0, 1), repeat=len(keys))])).alias("_cell")).select("_cell.*")
    return points.select("*", *cell_of(axes, radius)).join(around.distinct(), keys, "left_semi").drop(*keys)


class CellTree:
    """Cells of references: `nodes` (_level, _c0.., _n, _leaf) below the root, `leaves` (_level, _c0.., the references' columns).

    A cell of level l has 1 / FAN ** l of the extent on each axis; its parent's number is its own over FAN. References at one place
    are one row each; a cell of the deepest level is a leaf whatever it holds.
    """

    def __init__(self, refs: DataFrame, axes: Sequence[str], leaf: int = LEAF):
        self.axes, self.keys = list(axes), [f"_c{i}" for i in range(len(axes))]
        ends = refs.agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        self.low = [ends[f"lo{i}"] for i in range(len(axes))]
        self.extent = max((ends[f"hi{i}"] - ends[f"lo{i}"] for i in range(len(axes))), default=0.0) * (1 + 1e-9) or 1.0
        active, self.nodes, self.leaves = refs, None, None
        for level in range(1, DEEPEST + 1):
            size = self.extent / FAN**level
            cells = [F.floor((F.col(a) - F.lit(lo)) / F.lit(size)).cast("long").alias(k) for a, lo, k in zip(self.axes, self.low, self.keys)]
            placed = active.select(*refs.columns, *cells)
            full = F.col("_n") <= (F.lit(leaf) if level < DEEPEST else F.lit(1 << 62))
            counts = cut(placed.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).select(F.lit(level).alias("_level"), *self.keys, "_n", full.alias("_leaf")))
            placed = cut(placed.join(counts, self.keys).select("_level", *self.keys, "_leaf", *refs.columns))
            here = placed.where("_leaf").drop("_leaf")
            self.nodes = counts if self.nodes is None else self.nodes.unionByName(counts)
            self.leaves = here if self.leaves is None else self.leaves.unionByName(here)
            active = placed.where("not _leaf").select(*refs.columns)
            self.depth = level
            if active.isEmpty():
                break

    def box(self, level: Column, axes: Sequence[str], cell: Sequence[Column]) -> tuple[Column, Column]:
        """Squared distances from a point to the nearest and the farthest place of a cell."""
        size = F.lit(self.extent) / F.pow(F.lit(float(FAN)), level)
        near, far = F.lit(0.0), F.lit(0.0)
        for a, lo, c in zip(axes, self.low, cell):
            below, above = F.lit(lo) + c * size - F.col(a), F.col(a) - F.lit(lo) - (c + 1) * size
            near = near + F.pow(F.greatest(below, above, F.lit(0.0)), F.lit(2.0))
            far = far + F.pow(F.greatest(-below, -above), F.lit(2.0))
        return near, far

    def candidates(self, places: DataFrame, axes: Sequence[str], k: int = 1) -> DataFrame:
        """Each place with the references of all cells that can hold one of its k nearest. `places` are distinct."""
        axes = list(axes)
        roots = self.nodes.where("_level = 1").collect()  # FAN cells on each axis at most
        cells = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("_level", *self.keys, "_n", "_leaf")]) for r in roots])
        frontier = self._pruned(places.select(*axes, F.explode(cells).alias("_cell")).select(*axes, "_cell.*"), axes, k)
        for level in range(1, self.depth):
            children = self.nodes.where(F.col("_level") == level + 1).withColumnsRenamed({c: f"_k{c}" for c in self.keys})
            parent = reduce(and_, [F.floor(F.col(f"_k{c}") / FAN) == F.col(c) for c in self.keys])
            opened = frontier.where(~F.col("_leaf")).drop("_n", "_leaf", "_level").join(children, parent)
            opened = opened.select(*axes, "_level", *[F.col(f"_k{c}").alias(c) for c in self.keys], "_n", "_leaf")
            frontier = self._pruned(frontier.where("_leaf").unionByName(opened), axes, k)
        return frontier.select(*axes, "_level", *self.keys).join(self.leaves, ["_level", *self.keys]).drop("_level", *self.keys)

    def _pruned(self, frontier: DataFrame, axes: list[str], k: int) -> DataFrame:
        """Without the cells that lie beyond the distance within which k references are certain."""
        near, far = self.box(F.col("_level"), axes, [F.col(c) for c in self.keys])
        rows = frontier.withColumn("_near", near).withColumn("_far", far)
        place = Window.partitionBy(*axes)
        upto = F.sum("_n").over(place.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_enough", F.when(upto >= k, F.col("_far")))
        reach = F.coalesce(F.min("_enough").over(place), F.lit(float("inf"))) * (1 + SLACK) + ABSOLUTE
        return cut(rows.withColumn("_reach", reach).where("_near <= _reach").drop("_near", "_far", "_enough", "_reach"))


def _finite(axes: Sequence[str]) -> Column:
    return reduce(and_, [F.col(a).isNotNull() & (F.abs(F.col(a)) < float("inf")) & ~F.isnan(F.col(a).cast("double")) for a in axes])


def _by_grid(places: DataFrame, spots: DataFrame, axes: Sequence[str], ref_axes: Sequence[str], dist: Column) -> tuple[DataFrame, DataFrame]:
    """Best reference of the places for which the touching cells of an even grid settle it, and the places for which they do not.

    A cell is as wide as two references need on average. It settles a place whose best lies nearer than a cell's width, so nothing outside the
    touching cells can be as near. Cells with more than AROUND references around them settle nothing, so a crowd is never compared here.
    """
    ends = spots.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}{i}") for i, a in enumerate(ref_axes) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    extent = max(ends[f"hi{i}"] - ends[f"lo{i}"] for i in range(len(ref_axes)))
    size = float(extent) / max(1, round((ends["n"] / 2) ** (1 / min(2, len(ref_axes))))) or 1.0  # references on a sphere lie on a surface
    keys = [f"_c{i}" for i in range(len(axes))]
    around = spots.withColumn("_cell", F.explode(neighbour_cells(ref_axes, size))).select("*", "_cell.*").drop("_cell")
    few = around.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= AROUND).drop("_n")
    met = places.select("*", *cell_of(axes, size)).join(around.join(few, keys, "left_semi"), keys)
    d2 = sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(axes, ref_axes))
    best = met.groupBy(*axes).agg(F.min(F.struct(dist.alias("d"), F.col("_r"))).alias("_best"), F.min(d2).alias("_d2"))
    sure = F.col("_d2") * (1 + SLACK) + ABSOLUTE <= (0.99 * size) ** 2  # rounding may put a place beside its cell
    hit = cut(best.where(sure).select(*axes, "_best"))
    return hit, cut(places.join(hit.select(*axes), list(axes), "left_anti"))


def nearest(points: DataFrame, refs: DataFrame, axes: Sequence[str], ref_axes: Sequence[str], ref_id: str, ref_order: str, dist: Column) -> DataFrame:
    """Nearest reference of each point: `points` plus `ref_id` and `dist`; null where a coordinate is missing or there is no reference.

    Points and references are first reduced to distinct places, so a crowded place costs one search. Ties go to the
    smallest `ref_order`. `dist` may use the axes and `ref_axes`; the axes must be such that
    Euclidean distance in them bounds the ranking (chord length for the globe).
    """
    places = cut(points.select(*axes).where(_finite(axes)).distinct())
    spots = refs.where(_finite(ref_axes)).groupBy(*ref_axes).agg(F.min(F.struct(F.col(ref_order).alias("o"), F.col(ref_id).alias("id"))).alias("_r"))
    spots = cut(spots)
    if spots.isEmpty():
        return points.withColumn(ref_id, F.lit(None).cast(refs.schema[ref_id].dataType)).withColumn("dist", F.lit(None).cast("double"))
    hit, rest = _by_grid(places, spots, axes, ref_axes, dist)
    if not rest.isEmpty():
        found = CellTree(spots, ref_axes).candidates(rest, axes)
        hit = hit.unionByName(found.groupBy(*axes).agg(F.min(F.struct(dist.alias("d"), F.col("_r"))).alias("_best")))
    return points.join(hit.select(*axes, F.col("_best._r.id").alias(ref_id), F.col("_best.d").alias("dist")), list(axes), "left")
