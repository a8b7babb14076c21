"""Candidate pairs from buckets of any size, and links between the members of very large buckets.

A bucket of up to `limit` members gives its pairs. Larger buckets that share members are one crowd; a crowd is cut into
blocks, and every two blocks meet in one task that holds at most two blocks, counts the links and gives one
row per member, not per pair. No pair is lost and none is met twice, whatever the number of buckets that hold it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import components
from rivulet.plans.fixpoint import cut

#: Members of a bucket that are paired row by row; members of a block of a crowd.
LIMIT, BLOCK = 48, 256


def candidates(members: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """From (key, id), ids distinct within a key: pairs (i, j) with i < j, and crowds (id, crowd, size).

    Pairs inside one crowd are left to it.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(members.join(sizes, "key"))
    large = shared.where(F.col("n") > limit)
    heads = large.groupBy("key").agg(F.min("id").alias("head"))
    edges = cut(large.join(heads, "key").select("id", "head").distinct())
    small = shared.where(F.col("n") <= limit).select("key", "id")
    if edges.isEmpty():
        crowds = edges.select("id", F.col("head").alias("crowd"), F.lit(0).cast("long").alias("size"))
        small = small.withColumn("crowd", F.lit(None).cast("long"))
    else:
        own = components(edges, "id", "head").select(F.col("node").alias("id"), F.col("component").alias("crowd"))
        crowds = cut(own.join(own.groupBy("crowd").agg(F.count("*").alias("size")), "crowd").select("id", "crowd", "size"))
        small = small.join(crowds.select("id", "crowd"), "id", "left")
    left, right = (small.select("key", F.col("id").alias(x), F.col("crowd").alias(f"{x}_crowd")) for x in ("i", "j"))
    apart = F.col("i_crowd").isNull() | F.col("j_crowd").isNull() | (F.col("i_crowd") != F.col("j_crowd"))
    pairs = left.join(right, "key").where((F.col("i") < F.col("j")) & apart).select("i", "j").distinct()
    return cut(pairs), crowds


def units(crowds: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each member once per unit, a unit being two blocks of a crowd: (crowd, lo, hi, id, side)."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = crowds.withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("crowd", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "id", "side")


def crowd_links(members: DataFrame, linked: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Per unit and member: (id, links, root).

    `members` is `units` with the columns that `linked` needs and `copies`; `linked` gives the boolean matrix of two sets of
    row numbers. links counts linked rows with their copies; root is the smallest id of the
    member's component inside the unit.
    """

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        side, same = rows["side"].to_numpy(), rows["lo"].iloc[0] == rows["hi"].iloc[0]
        a = np.arange(len(rows)) if same else np.flatnonzero(side == rows["lo"].iloc[0])
        b = a if same else np.flatnonzero(side == rows["hi"].iloc[0])
        copies, ids = rows["copies"].to_numpy(), rows["id"].to_numpy()
        links, root = np.zeros(len(rows), dtype=np.int64), ids.copy()
        if len(a) and len(b):
            near = linked(rows, a, b)
            if same:
                np.fill_diagonal(near, False)
                links[a] = near @ copies[b]
            else:
                links[a], links[b] = near @ copies[b], near.T @ copies[a]
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            while len(i):  # smallest id spreads along links
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                if (before == root).all():
                    break
        return pd.DataFrame({"id": ids, "links": links, "root": root})

    return members.groupBy("crowd", "lo", "hi").applyInPandas(unit, "id long, links long, root long")


def settle(classes: DataFrame, pairs: DataFrame, crowd: DataFrame) -> DataFrame:
    """Links and component of each class: (id, links, component); classes without a link are left out.

    `classes` has (id, copies); `pairs` verified (i, j); `crowd` rows of `crowd_links`.
    """
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    found = both.join(classes.select(F.col("id").alias("j"), "copies"), "j").select(F.col("i").alias("id"), F.col("copies").alias("links"))
    links = found.unionByName(crowd.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    edges = pairs.select("i", "j").unionByName(crowd.select(F.col("id").alias("i"), F.col("root").alias("j")))
    parts = components(edges, "i", "j").select(F.col("node").alias("id"), "component")
    return links.where("links > 0").join(parts, "id")
