"""Similarity join of documents on word n-grams: banded MinHash in place of an LSH forest, then exact Jaccard similarity.

A forest would sort documents by full-depth prefixes and shorten them until the recall is reached. Here the
length at which the expected share of pairs at the threshold that meet in some tree reaches the target recall is computed once,
and signatures are built to that length only: a tree is one band with one key, and all pairs that share a key are verified.
Documents that share a longer prefix share the key too, so no pair of the forest at that length is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import hand_back_memory, text_of
from rivulet.llm.pairs import candidates, crowd_links, settle, units
from rivulet.plans.fixpoint import cut

#: Words of an n-gram, least similarity, trees, full depth of a tree, recall to reach at the threshold.
WORDS, THRESHOLD, TREES, DEPTH, RECALL, SEED = 5, 0.8, 32, 10, 0.9999, 9

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold meet in some tree with the wanted probability."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, a word being a run without ASCII white space of the lower-cased text."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    space = np.concatenate([[True], _IS_SPACE[data], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(1 << max(10, int(len(data)).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the n-grams in order, repeats included; a shorter text with a word is one n-gram."""
    w = word_hashes(text)
    n = min(words, len(w))
    if not n:
        return w
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k]
    return _mix(out + np.uint64(n))


@functools.lru_cache(maxsize=2)
def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(grams: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of the n-grams."""
    flip, times = _hash_family(n)
    low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(grams), 1024):
        x = (low[at : at + 1024] ^ flip[:, None]) * times[:, None]
        x ^= x >> np.uint32(15)
        x += high[at : at + 1024]
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def tree_keys(best: np.ndarray, trees: int, length: int) -> np.ndarray:
    """One 64-bit key per tree for the prefix of the given length."""
    rows = best.reshape(trees, length).astype(np.uint64)
    key = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(length):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


def link_documents(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_links, component_id, kept, same.

    Documents are linked if the Jaccard similarity of their n-gram sets is at least `threshold`; equal texts
    are one class with a count and link with each other. component_id is the smallest doc_id reachable by links. kept is true for one
    row of each group, the first with that id. `same` is the MD5 of the text, which names its class. Texts without a word, and null texts, link
    with nothing and are kept. Rows that repeat a doc_id are documents of their own; a null doc_id never is the smallest. An empty table gives no rows.
    """
    length = prefix_length(threshold, trees, recall=recall)
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    source = source.withColumn("same", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.md5(F.col("text").cast("binary"))))

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = zip(batch.column("text").to_pylist(), batch.column("same").to_pylist()), {None: None}
            for t, same in texts:
                if same not in known:
                    known[same] = tree_keys(signature(shingles(t, words), trees * length), trees, length)
            keys = [known[same] for same in batch.column("same").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "keys"])
        hand_back_memory()

    rows = cut(source.mapInArrow(hash_texts, "doc_id long, same string, keys array<long>").withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = rows.where("same is not null").groupBy("same").agg(F.count("*").alias("copies"), first.alias("first"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    found, crowds = candidates(classes.select(F.explode(F.array_distinct("keys")).alias("key"), "id"))

    wanted = crowds.select("id").unionByName(found.select(F.col("i").alias("id"))).unionByName(found.select(F.col("j").alias("id"))).distinct()
    wanted = classes.join(wanted, "id").select("id", F.col("same").alias("class_"), F.col("first.doc_id").alias("doc_"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("same") == F.col("class_"))).select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingles(t, words)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(grams, pa.binary())], names=["id", "grams"])
        hand_back_memory()

    grams = cut(texts.mapInArrow(sets, "id long, grams binary").dropDuplicates(["id"]))
    left, right = (grams.select(F.col("id").alias(x), F.col("grams").alias(f"{x}_grams")) for x in ("i", "j"))
    least = threshold - 1e-9  # sizes in bytes: a set below this share of the other cannot reach the threshold
    close = F.least(F.length("i_grams"), F.length("j_grams")) >= least * F.greatest(F.length("i_grams"), F.length("j_grams"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("i_grams").to_pylist(), batch.column("j_grams").to_pylist()):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= least * (len(a) + len(b) - both))
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("i"), kept.column("j")], names=["i", "j"])

    near = cut(found.join(left, "i").join(right, "j").where(close).select("i", "j", "i_grams", "j_grams").mapInArrow(verify, "i long, j long"))

    def linked(part: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = [np.frombuffer(g, dtype=np.uint64) for g in part["grams"]]
        return similar(own, a, b, least)

    crowd = cut(crowd_links(units(crowds).join(grams, "id").join(classes.select("id", "copies"), "id"), linked))
    settled = settle(classes.select("id", "copies"), near, crowd)
    state = classes.select("id", "same", "copies", "first").join(settled, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = state.groupBy("component").agg(F.min("first").alias("head"))
    state = cut(state.join(heads, "component").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("head.doc_id").alias("head_id"), F.col("head.row").alias("head_row")))
    rows = rows.select("doc_id", "same", "row")
    none = rows.where("same is null").select("*", *[F.lit(None).cast(t).alias(c) for c, t in state.dtypes if c != "same"])  # these would all meet in one task
    out = rows.where("same is not null").join(state, "same").unionByName(none)
    return out.select(
        "doc_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("row") == F.col("head_row"), F.lit(True)).alias("kept"), "same",
    )


def similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: float, columns: int = 4096) -> np.ndarray:
    """Whether sets a and sets b reach the similarity, by products of membership blocks over the n-grams that both sides hold."""
    shared = np.intersect1d(np.unique(np.concatenate([sets[i] for i in a])), np.unique(np.concatenate([sets[i] for i in b])), assume_unique=True)
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    places = {int(i): np.flatnonzero(np.isin(shared, sets[i], assume_unique=True)) for i in {*a.tolist(), *b.tolist()}}
    for at in range(0, len(shared), columns):
        width = min(columns, len(shared) - at)
        block = {}
        for name, side in (("a", a), ("b", b)):
            block[name] = np.zeros((len(side), width), dtype=np.float32)
            for row, i in enumerate(side.tolist()):
                p = places[i]
                block[name][row, p[np.searchsorted(p, at) : np.searchsorted(p, at + width)] - at] = 1
        both += block["a"] @ block["b"].T
    size = np.array([len(s) for s in sets], dtype=np.float64)
    return both >= least * (size[a][:, None] + size[b][None, :] - both)


def join_table(docs: DataFrame) -> DataFrame:
    """Class and links of every document."""
    return link_documents(docs).select("doc_id", "n_links", "component_id", "kept")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents without those that are not the first of their group; all columns stay.

    Of rows that repeat both id and text of a kept row one stays: the first by its other columns, in their order.
    """
    rows = link_documents(docs, doc_id=doc_id, text=text, **parameters)
    each = F.struct("doc_id", "same").alias("each")  # grouped apart from the class, which may hold a third of all rows
    dropped = cut(rows.groupBy(each).agg(F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count("*").alias("n")).where("kept < n").select("each.*", "kept", "n"))
    same = F.when(text_of(docs, text).rlike(r"[^\x20\x09-\x0D]"), F.md5(text_of(docs, text).cast("binary")))
    key = F.col("k__.doc_id").eqNullSafe(docs[doc_id].cast("long")) & F.col("k__.same").eqNullSafe(same)
    gone = dropped.where("kept = 0").alias("k__")
    left = docs.join(gone, key, "left_anti")
    again = dropped.where("kept > 0").alias("k__")
    if again.isEmpty():
        return left
    repeated = left.join(again, key, "left_semi").groupBy(doc_id, text).agg(F.min(F.struct(*[c for c in docs.columns if c not in (doc_id, text)] or [F.lit(0).alias("none")])).alias("rest__"))
    repeated = repeated.select(*[F.col(c) if c in (doc_id, text) else F.col(f"rest__.`{c}`").alias(c) for c in docs.columns])
    return left.join(again, key, "left_anti").unionByName(repeated)
