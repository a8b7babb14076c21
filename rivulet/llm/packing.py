"""Packing by power-of-two decomposition: a document's tokens are cut into pieces whose lengths are powers of two.

Each piece is a sequence of its own, and sequences of equal length share a bucket: a
batch drawn from one bucket needs no padding, and no sequence holds two documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import hand_back_memory
from rivulet.llm.tokens import json_codec

#: Token after each document.
END_ID = 1


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens: as many of the longest as fit, then the binary digits of the rest, large first."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


FIELDS = (
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
)


def pack(docs: DataFrame, path: str, pattern: str, longest: int = 2048, text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the document's other columns, then start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    A document's tokens are those of its whole text, as the tokeniser of the JSON file `path` gives
    them, then END_ID; a null text is empty, so every document has at least one piece.
    `length` is also the bucket. `offset` is 0, as each piece is a sequence. Sequence
    ids are unique. Columns named like the new ones are replaced, and the text is dropped.
    `with_ids=False` leaves ids null for callers that need the layout only. Nothing is shuffled.
    Repeated rows are packed each for itself; an empty table gives no rows. A text of any length is cut whole, in memory
    proportional to it.
    """
    new = {f.name for f in FIELDS} | {"sequence_id", "offset"}
    keep = [c for c in docs.columns if c.lower() not in new and c != text]
    source = docs.select(*keep, docs[text])

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = json_codec(path, pattern)
        for batch in batches:
            row, start, length, crc, total, parts = [], [], [], [], [], []
            for at, t in enumerate(batch.column(len(keep)).to_pylist()):
                ids = np.append(codec.encode_with_special(t or ""), np.array([END_ID], dtype="<u4"))
                sizes = piece_lengths(len(ids), longest)
                begin = 0
                for size in sizes:
                    start.append(begin)
                    crc.append(zlib.crc32(ids[begin : begin + size].tobytes()))
                    begin += size
                row += [at] * len(sizes)
                length += sizes
                total += [len(ids)] * len(sizes)
                if with_ids:
                    parts.append(ids.astype(np.int32))
            rows = pa.array(row, pa.int64())
            kept = [batch.column(k).take(rows) for k in range(len(keep))]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                ids_column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
            else:
                ids_column = pa.nulls(len(row), pa.list_(pa.int32()))
            columns = [*kept, *[pa.array(x, pa.int64()) for x in (start, length, crc, total)], ids_column]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[f.name for f in FIELDS]])
        hand_back_memory()

    rows = source.mapInArrow(cut_pieces, T.StructType([*source.schema.fields[: len(keep)], *FIELDS]))
    return rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Write sequences as Parquet, one folder per length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)


def piece_table(docs: DataFrame, path: str, pattern: str, longest: int = 2048) -> DataFrame:
    """The layout of all documents: which tokens lie in which sequence."""
    key: Column = docs["doc_id"]
    out = pack(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")), path, pattern, longest, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
