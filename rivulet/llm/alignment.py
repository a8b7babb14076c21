"""Alignment of two tokenisers: which tokens of one cover the bytes of which tokens of the other.

All work on tokens is on Arrow arrays. The ids of a batch are one flat list with the document of each; the byte end of a token is a cumulative sum of
lengths, restarted at each document. A hash join of both tokenisers' (document, end) finds the places where both end a token; these cut the
document into groups. A second hash join, on the group, pairs the tokens, and `group_by` counts. Spark adds up the counts of the batches.

The corpus-wide counts come back to the documents in two ways that together hold every pair: the most frequent pairs, of which there are at most
FREQUENT, go to every task; all others meet the documents in a join that no single pair can dominate, as a rare pair stands in few documents.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import hand_back_memory, text_of
from rivulet.llm.tokens import Codec, json_codec
from rivulet.plans.fixpoint import cut, shared_root

#: Pairs whose counts every task gets (16 bytes each, 4 MB); the others are joined. Bytes of text that are aligned at once.
FREQUENT, CHUNK = 1 << 18, 1 << 20

_PAIR = np.int64(1 << 31)

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pieces:
    """A SentencePiece model with the bytes of each of its ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.token = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def piece_codec(path: str) -> Pieces:
    """Built once per worker."""
    return Pieces(path)


def _flat(ids: list, token: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """The ids as a list array, and the bytes of each document's tokens joined."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.concatenate([np.asarray(i, dtype=np.int32) for i in ids]) if ends[-1] else np.zeros(0, dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return lists, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), token.take(lists.values)), b"")


def _ends(lists: pa.ListArray, length: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per token its document and the byte at which it ends: the running sum of lengths less the sum before its document."""
    parent = pc.list_parent_indices(lists)
    running = pc.cumulative_sum(length.take(pc.list_flatten(lists)))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(lists.offsets[:-1])
    return parent, pc.subtract(running, before.take(parent))


def _groups(parent: pa.Array, end: pa.Array, cuts: np.ndarray, span: int) -> np.ndarray:
    """Number of the group of each token: how many cuts lie before the place where it ends."""
    at = parent.to_numpy().astype(np.int64) * span + end.to_numpy()
    return np.searchsorted(cuts, at)


def _texts_of_groups(lists: pa.ListArray, group: np.ndarray, n_groups: int, digits: pa.Array) -> pa.Array:
    """The ids of each group, in decimal and joined by commas."""
    ends = np.searchsorted(group, np.arange(n_groups + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), digits.take(pc.list_flatten(lists))), ",")


def _distinct(group: np.ndarray, ids: pa.Array, name: str) -> pa.Table:
    """The ids of each group once, with how often they stand in it."""
    table = pa.table({"g": pa.array(group), name: ids}).group_by(["g", name], use_threads=False).aggregate([([], "count_all")])
    return table.rename_columns(["g", name, f"n_{name}"])


class Aligner:
    """Aligns batches of texts; built once per task."""

    def __init__(self, a: Codec, b: Pieces):
        self.a, self.b = a, b
        self.token_a, self.token_b = pa.array(a.token, pa.binary()), pa.array(b.token, pa.binary())
        self.length_a, self.length_b = (pc.binary_length(t).cast(pa.int64()) for t in (self.token_a, self.token_b))
        self.digits = pa.array([str(i) for i in range(max(len(a.token), len(b.token)))])

    def batch(self, texts: list[str]) -> dict[str, pa.Array]:
        """Per document the counts, the digest and its linked pairs of ids with their numbers of links."""
        spaced = pa.array([(" " + t).encode() for t in texts], pa.binary())
        lists_a, bytes_a = _flat([self.a.encode(" " + t) if t else [] for t in texts], self.token_a)
        lists_b, bytes_b = _flat([i if t else [] for t, i in zip(texts, self.b.encode(texts))], self.token_b)
        same = pc.and_(pc.equal(bytes_a, spaced), pc.equal(bytes_b, spaced))  # never for an empty text, which has no tokens
        if not pc.all(same).as_py():
            kept = pa.array(np.flatnonzero(same.to_numpy(zero_copy_only=False)))
            lists_a, lists_b = (self._only(x, kept, len(texts)) for x in (lists_a, lists_b))
        n = len(texts)
        (parent_a, end_a), (parent_b, end_b) = _ends(lists_a, self.length_a), _ends(lists_b, self.length_b)
        span = max(pc.max(pc.binary_length(spaced)).as_py() or 0, 1) + 1
        keys = [pa.table({"doc": p, "end": e}) for p, e in ((parent_a, end_a), (parent_b, end_b))]
        shared = keys[0].join(keys[1], ["doc", "end"], join_type="inner", use_threads=False)
        cuts = np.sort(shared["doc"].to_numpy().astype(np.int64) * span + shared["end"].to_numpy())
        group_a, group_b = _groups(parent_a, end_a, cuts, span), _groups(parent_b, end_b, cuts, span)
        of_group = cuts // span

        left, right = _distinct(group_a, pc.list_flatten(lists_a), "a"), _distinct(group_b, pc.list_flatten(lists_b), "b")
        links = left.join(right, "g", join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), pa.scalar(int(_PAIR))), links["b"].cast(pa.int64()))
        doc = pa.array(of_group[links["g"].to_numpy()])
        table = pa.table({"doc": doc, "pair": pair, "links": pc.multiply(links["n_a"], links["n_b"])}).group_by(["doc", "pair"], use_threads=False).aggregate([("links", "sum")])
        table = table.take(pc.sort_indices(table, [("doc", "ascending"), ("pair", "ascending")])).combine_chunks()

        at = np.searchsorted(table["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
        pairs, times = (pa.ListArray.from_arrays(pa.array(at), table[c].combine_chunks()) for c in ("pair", "links_sum"))
        joined = pc.binary_join_element_wise(_texts_of_groups(lists_a, group_a, len(cuts), self.digits), _texts_of_groups(lists_b, group_b, len(cuts), self.digits), "|")
        first = np.searchsorted(of_group, np.arange(n + 1)).astype(np.int32)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(first), joined), ";")
        return {
            "n_a": pc.list_value_length(lists_a).cast(pa.int64()), "n_b": pc.list_value_length(lists_b).cast(pa.int64()), "n_groups": pa.array(np.diff(first), pa.int64()),
            "n_links": pa.array([sum_ or 0 for sum_ in _sums(times, n)], pa.int64()), "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in whole.to_pylist()]),
            "pairs": pairs, "times": times,
        }

    @staticmethod
    def _only(lists: pa.ListArray, kept: pa.Array, n: int) -> pa.ListArray:
        """The lists of the kept documents; the others become empty."""
        sizes = np.zeros(n, dtype=np.int32)
        chosen = lists.take(kept)
        sizes[kept.to_numpy()] = pc.list_value_length(chosen).to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pc.list_flatten(chosen))


def _sums(lists: pa.ListArray, n: int) -> list[int]:
    """Sum of each list."""
    values = np.concatenate([[0], np.cumsum(pc.list_flatten(lists).to_numpy())])
    ends = lists.offsets.to_numpy()
    return (values[ends[1:]] - values[ends[:-1]])[:n].tolist()


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters; a longer text is one of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: columns of repeating numbers take a fraction of a checkpoint's room."""
    path = f"{shared_root(df.sparkSession)}/alignment-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align(docs: DataFrame, vocabulary: str, pattern: str, pieces: str, frequent: int = FREQUENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text by a byte-level vocabulary, B the text by a SentencePiece model, both whole and without special tokens. A
    group is a smallest run of bytes at whose end both have a token end; a link is an A and a B token occurrence of one group. The count of an id pair is the
    number of documents that hold it linked. n_best: links whose count is the highest of their A id, ties included; count_sum: counts over all links.

    Texts that are null or empty, or that either tokeniser does not give back byte by byte (it drops or changes characters), have zeros and an empty digest and add to no count.
    Every row is a document of its own, also if doc_id or text repeat or doc_id is null. An empty table gives no rows. Other columns are not
    read, whatever their names. A very long text is aligned alone, in memory proportional to its length.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(json_codec(vocabulary, pattern), piece_codec(pieces))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _chunks(texts):
                out = aligner.batch(texts[start:end])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:end], *out.values()], names=["doc_id", *out])
        del aligner
        hand_back_memory()

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    aligned = written(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"pair": pc.list_flatten(batch.column("pairs"))}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            yield from table.rename_columns(["pair", "docs"]).combine_chunks().to_batches()

    counts = cut(aligned.select("pairs").mapInArrow(count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    a = F.shiftright("pair", 31)
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    ranked = cut(counts.withColumn("a", a).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    top = ranked.orderBy(F.desc("docs"), "pair").limit(frequent).orderBy("pair").toArrow()
    known = [top[c].to_numpy() for c in ("pair", "docs", "best")]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs_of, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, n = pc.list_flatten(pairs).to_numpy(), pc.list_flatten(times).to_numpy()
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            count_ = np.where(hit, n * (docs_of[at] if len(pair) else 0), 0)
            best_ = np.where(hit & (best[at] if len(pair) else False), n, 0)
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            sums = []
            for v in (best_, count_):
                total = np.concatenate([[0], np.cumsum(v)])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            left = np.concatenate([[0], np.cumsum(~hit)]).astype(np.int32)[ends]
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~hit])) for v in (flat, n)]
            keep = ["doc_id", *COUNTS, "groups_sha256", "row"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *sums, *rest], names=[*keep, "n_best", "count_sum", "pairs", "times"])

    known_part = aligned.mapInArrow(add_up, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    known_part = written(known_part, "known")
    rare = known_part.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(ranked, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("docs")).alias("rare_sum"))
    out = known_part.drop("pairs", "times").join(rare, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *COUNTS, (F.col("n_best") + F.coalesce("rare_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("rare_sum", zero)).alias("count_sum"), "groups_sha256")
