"""Sharding by rendezvous hashing: every record picks the shard with the best weighted draw for its key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import number_within, text_of


def draw(key: Column, shard: Column) -> Column:
    """Uniform draw in (0, 1) from key and shard: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", key, shard.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard whose exponential race -ln(draw) / weight ends first; equal times go to the smaller shard.

    A shard's time depends on the key and on itself only, so a further shard
    takes exactly the records that it wins, and no record moves between others.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("give at least one shard, with weights above 0")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())])
    times = F.transform(shards, lambda s: F.struct((-F.ln(draw(key, s["shard"])) / s["weight"]).alias("time"), s["shard"].alias("shard")))
    return F.array_min(times)["shard"]


def assign_shards(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """Add the shard of each record. A null key counts as the empty key; equal keys, and so repeated rows, share a shard.

    An existing column of the name `shard` is replaced; all others pass unchanged. An empty table gives no rows.
    """
    return docs.withColumn(shard, rendezvous(F.coalesce(F.col(key).cast("string"), F.lit("")), weights))


def shard_table(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Placement of every row: size, text checksum, shard, slot in the shard, and the shard after one more is added.

    Equal weights. Size is the UTF-8 length (null text: none) plus 8; the checksum of a
    null text is that of the empty one. Slots follow key, checksum and size;
    rows equal in all three are interchangeable. An empty table gives no rows.
    Only five narrow columns are shuffled.
    """
    rows = docs.select(docs[key].alias("doc_id"), (F.octet_length(text_of(docs, text)) + F.lit(8)).cast("long").alias("size"), F.crc32(text_of(docs, text).cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows, {s: 1.0 for s in range(shards)})
    rows = assign_shards(rows, {s: 1.0 for s in range(shards + 1)}, shard="grown_shard")
    rows = number_within(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

