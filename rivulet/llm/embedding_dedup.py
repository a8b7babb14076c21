"""Near duplicates of embeddings by p-stable hashing: quantised Gaussian projections in several tables, then exact cosines."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.pairs import candidates, crowd_links, settle, units
from rivulet.plans.fixpoint import cut

#: Least projections per table, width of a quantum, recall to reach at the threshold, rows of a label up to which the least projections do.
PROJECTIONS, QUANTUM, RECALL, ROWS, SEED = 16, 2.0, 0.9895, 8_192, 4


def together(cosine: float, quantum: float = QUANTUM) -> float:
    """Probability that one quantised projection of two unit vectors with this cosine agrees: 0.85 at 0.93, 0.49 at 0."""
    c = math.sqrt(max(0.0, 2 - 2 * cosine)) / quantum
    if c == 0:
        return 1.0
    tail = 0.5 * math.erfc(1 / c / math.sqrt(2))
    return 1 - 2 * tail - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))


def expected_recall(cosine: float, projections: int, tables: int, quantum: float = QUANTUM) -> float:
    """Share of pairs with this cosine that meet in a bucket."""
    return 1 - (1 - together(cosine, quantum) ** projections) ** tables


def hash_sizes(rows: int, threshold: float, quantum: float = QUANTUM, recall: float = RECALL) -> tuple[int, int]:
    """Projections and tables for so many rows in the largest label.

    Beyond ROWS, each doubling of the rows adds as many projections as halve the chance that unrelated vectors meet in a table, so
    their candidates per vector and table do not grow; the tables follow from the recall at the threshold.
    """
    projections = PROJECTIONS + math.ceil(max(0.0, math.log(max(rows, 1) / ROWS)) / -math.log(together(0.0, quantum)))
    meet = together(threshold, quantum) ** projections
    return projections, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet))) if meet < 1 else 1


@functools.lru_cache(maxsize=8)
def _projections(size: int, projections: int, tables: int, quantum: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    n = projections * tables
    mix = rng.integers(1, 1 << 62, size=(tables, projections), dtype=np.int64) | 1
    return rng.standard_normal((size, n)), rng.uniform(0, quantum, n), mix


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bring column v of usable vectors to length 1 as column u; scaled by the largest component first, so no square overflows."""
    for batch in batches:
        ends = batch.column("v").offsets.to_numpy().astype(np.int64)
        starts, sizes = ends[:-1] - ends[0], np.diff(ends)
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        if len(flat):
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), sizes)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes)
        u = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(flat, pa.float64()))
        keep = [c for c in batch.schema.names if c != "v"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], u], names=[*keep, "u"])


def link_vectors(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", recall: float = RECALL, quantum: float = QUANTUM) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors of equal size with equal, not null labels are linked if their cosine is at least `threshold`.
    Vectors that are null, empty or zero or hold a null, NaN or infinite component link with nothing, and so do those
    with a null label. Equal vectors are one class with a count, whatever their number, and link with each other.
    Rows that repeat a vec_id are vectors of their own; a null vec_id never is the smallest. An empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    usable_row = usable(F.col("v")) & F.col("label").isNotNull()
    tagged = rows.select("vec_id", F.when(usable_row, F.md5(F.concat_ws(",", F.length(F.col("label").cast("string")).cast("string"), F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))))).alias("same"), "label", "v")
    classes = tagged.where("same is not null").groupBy("same").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    schema = T.StructType([*[f for f in classes.schema.fields if f.name != "v"], T.StructField("u", T.ArrayType(T.DoubleType()))])
    classes = cut(classes.mapInArrow(unit_vectors, schema).withColumn("id", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", F.size("u")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    projections, tables = hash_sizes(largest, threshold, quantum, recall)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("u").offsets.to_numpy())
            flat = batch.column("u").flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            ids, group = batch.column("id").to_numpy(), batch.column("group").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = flat[starts[at][:, None] + np.arange(size)]
                a, b, mix = _projections(int(size), projections, tables, quantum)
                cells = np.floor((x @ a + b) / quantum).astype(np.int64).reshape(len(at), tables, projections)
                with np.errstate(over="ignore"):
                    keys = (cells * mix).sum(axis=2)
                    keys = (keys ^ (keys >> 29)) * np.int64(-4658895280553007687) + group[at][:, None] + np.arange(tables) * np.int64(7046029254386353131)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at], tables))], names=["key", "id"])

    members = classes.select("id", "u", F.xxhash64(F.col("label").cast("string"), F.size("u")).alias("group")).mapInArrow(hash_rows, "key long, id long")
    found, crowds = candidates(members)
    left, right = (classes.select(F.col("id").alias(x), F.col("u").alias(f"u{x}"), F.col("label").alias(f"l{x}")) for x in ("i", "j"))
    cosine = F.aggregate(F.zip_with("ui", "uj", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    alike = (F.col("li") == F.col("lj")) & (F.size("ui") == F.size("uj"))
    near = cut(found.join(left, "i").join(right, "j").where(alike & (cosine >= threshold)).select("i", "j"))

    def linked(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = rows["u"].map(len).to_numpy()
        out = np.zeros((len(a), len(b)), dtype=bool)
        for n in np.unique(size):
            p, q = np.flatnonzero(size[a] == n), np.flatnonzero(size[b] == n)
            if len(p) and len(q):
                out[np.ix_(p, q)] = np.stack(rows["u"].to_numpy()[a[p]]) @ np.stack(rows["u"].to_numpy()[b[q]]).T >= threshold
        return out & (rows["label"].to_numpy()[a][:, None] == rows["label"].to_numpy()[b][None, :])

    crowd = cut(crowd_links(units(crowds).join(classes.select("id", "u", F.col("label").cast("string").alias("label"), "copies"), "id"), linked))
    settled = settle(classes, near, crowd)
    state = classes.select("id", "same", "copies", "least").join(settled, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = state.groupBy("component").agg(F.min("least").alias("component_id"))
    state = cut(state.join(least, "component").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    none = tagged.where("same is null").select("vec_id", "same", *[F.lit(None).cast("long").alias(c) for c in ("n_links", "component_id")])  # these would all meet in one task
    out = tagged.where("same is not null").select("vec_id", "same").join(state, "same").unionByName(none)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
