"""Byte-level BPE as a monoid: encodings of neighbours join by re-encoding a window at the seam.

A text is halved until the pieces are short; the pieces are encoded; then neighbours are joined up
the tree. What makes a join exact: the pattern looks at no character before a match, so whatever starts at a
true match boundary is matched alike with or without what precedes it; and the place between a character that is not
white space and one that is white space is a boundary in every context, beyond which nothing before it looks. So the
window grows to both sides of the seam until it ends at two such places, and all tokens outside it are final.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import WHITE_SPACE, with_columns_by

#: Characters of a leaf of the tree; of one whose encoding only serves other operators.
LEAF, COARSE_LEAF = 256, 8_192
_WHITE = frozenset(WHITE_SPACE)


class Codec:
    """Encoder and decoder of one vocabulary of byte-level BPE ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None, leaf: int = LEAF):
        self.special, self.leaf = dict(special or {}), leaf
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()], default=-1) + 1
        self.token: list[bytes] = [b""] * size
        for piece, i in ranks.items():
            self.token[i] = piece
        for piece, i in self.special.items():
            self.token[i] = piece.encode()
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)

    # ------------------------------------------------------------ leaves
    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    # ------------------------------------------------------------ tree
    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers, without special tokens."""
        if len(text) <= self.leaf:
            return self._leaf(text)
        mid = len(text) // 2
        return self._join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def _join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Encoding of left + right from the encodings of both.

        The window grows from the seam to the next certain boundary on either side, in a run
        without white space as far as the ends of the halves; tokens outside are kept.
        """
        i, j = _certain_before(left), _certain_after(right)
        keep_a = self._tokens_upto(a, len(left[:i].encode()))
        keep_b = self._tokens_upto(b, len(right[:j].encode()))
        return np.concatenate([a[:keep_a], self._leaf(left[i:] + right[:j]), b[keep_b:]])

    def _tokens_upto(self, ids: np.ndarray, size: int) -> int:
        """How many tokens make up the first `size` bytes; these end at a token boundary."""
        ends = np.cumsum(self.length[ids])
        n = int(np.searchsorted(ends, size, side="left")) + 1 if size else 0
        if n and ends[n - 1] != size:
            raise AssertionError("a certain boundary lies inside a token")
        return n

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def encode_with_special(self, text: str) -> np.ndarray:
        """Like `encode`, but strings of special tokens become their ids."""
        for piece, i in self.special.items():
            if piece in text:
                parts = text.split(piece)
                rows = [self.encode_with_special(parts[0])]
                for p in parts[1:]:
                    rows += [np.array([i], dtype="<u4"), self.encode_with_special(p)]
                return np.concatenate(rows)
        return self.encode(text)


def _certain_before(left: str) -> int:
    """The last certain boundary inside `left`, or its start."""
    for i in range(len(left) - 1, 0, -1):
        if left[i] in _WHITE and left[i - 1] not in _WHITE:
            return i
    return 0


def _certain_after(right: str) -> int:
    """The first certain boundary inside `right`, or its end."""
    for j in range(1, len(right)):
        if right[j] in _WHITE and right[j - 1] not in _WHITE:
            return j
    return len(right)


def _byte_of_character() -> dict[str, int]:
    """The alphabet of JSON vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def rank_codec(path: str, pattern: str, leaf: int = LEAF) -> Codec:
    """Codec of a file of base64 tokens and ranks; built once per worker."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern, leaf=leaf)


@functools.lru_cache(maxsize=2)
def json_codec(path: str, pattern: str, leaf: int = COARSE_LEAF) -> Codec:
    """Codec of a tokeniser's JSON file of byte-level BPE whose ids follow the order of its merges; built once per worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if spec.get("pre_tokenizer") else []
    if model["type"] != "BPE" or spec.get("normalizer") or [s["type"] for s in steps] != ["ByteLevel"] or steps[0].get("add_prefix_space"):
        raise ValueError(f"{path} is not plain byte-level BPE")
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"the ids of {path} do not follow its merges")
    byte = _byte_of_character()
    return Codec({bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}, pattern, special=added, leaf=leaf)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Add `ids` (array of int) and `decoded` (binary, decoded from the ids) to every row.

    Whole texts; null counts as empty and gives no ids. Other columns pass unchanged, columns named like the new ones are replaced.
    """

    def make():
        codec = rank_codec(path, pattern, leaf)

        def run(texts: list[str | None]) -> list[list]:
            ids = [codec.encode(t or "") for t in texts]
            return [[i.astype(np.int32) for i in ids], [codec.decode(i) for i in ids]]

        return run

    return with_columns_by(docs, [text], make, (T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())))


DIGESTS = (T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()))


def token_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Per document: number of ids and digests of the ids and of the bytes decoded from them.

    Whole texts of any length, null as empty; both have no ids and the digests of nothing. Repeated rows and ids stay, a null doc_id too; an
    empty table gives no rows. Columns other than doc_id and text are not read.
    """

    def make():
        codec = rank_codec(path, pattern)

        def run(texts: list[str | None]) -> list[list]:
            out: list[list] = [[], [], []]
            for t in texts:
                ids = codec.encode(t or "")
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out[2].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return out

        return run

    return with_columns_by(docs.select("doc_id", F.col(text).cast("string").alias("text")), ["text"], make, DIGESTS).drop("text")
