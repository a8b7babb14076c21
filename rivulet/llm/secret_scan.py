"""Secret scan: fixed patterns, and candidate strings whose sliding windows have a high Shannon entropy."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import with_columns_by

#: Patterns, shortest accepted value and the group that is measured, by kind and in this order. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 or more; shorter runs hold no match
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as matching is greedy
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN = 8

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least entropy in bits of a window of 20 characters, by the class of characters that the candidate, or the run in it, is made of.
LEAST_BITS = {"hex": 3.0, "upper": 3.4, "lower": 3.5, "plain": 3.6, "mixed": 3.8}
RUN = re.compile(r"[A-Za-z0-9]{20,}")  # a stretch of a candidate between the separators _ - = / +
_HEX, _UPPER, _LOWER = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[A-Z0-9]+"), re.compile(r"[a-z0-9]+")
#: Candidates that are no secrets: words, also joined by separators; numbers; UUIDs; paths of words. Fixed values.
ALLOW = (
    re.compile(r"[A-Za-z]?[a-z]*(?:[/_=+-]+[A-Za-z]?[a-z]*)*"),
    re.compile(r"[A-Z]+(?:[/_=+-]+[A-Z]+)*"),
    re.compile(r"[0-9/_=+-]+"),
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[/_=+-]*[A-Za-z]+[0-9]{0,4}(?:[/_=+-]+(?:[A-Za-z]*[a-z]{2,}[0-9]{0,4}|[0-9]{1,4}))*[/_=+-]*"),
)
#: Pairs of letters that are common in words of English, German, French and Spanish. Fixed values.
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ie ei un ge sc da ue qu la el no do os ad ci nc ss tr us ns ta ly wh ai au eu pa em".split()
)
#: Least share of common pairs in a long run of letters that is taken for a word: one in nine of random pairs is common.
WORDLIKE, LONG_RUN = 0.27, re.compile(r"[A-Za-z]{12,}")
_STRETCH = re.compile(r"[A-Za-z0-9+/]+")  # what one token of common encodings is made of
_STEP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # a character comes in before the oldest goes out


def high_entropy(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows with at least so many bits per character.

    The window slides by one character: one count falls, one rises, and the sum of
    c log c changes by two terms.
    """
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _STEP[n + 1] - _STEP[n]
        counts[c] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total -= _STEP[n] - _STEP[n - 1]
            counts[old] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i - window + 1, i + 1])
    return [(a, b) for a, b in spans]


def class_of(candidate: str) -> str:
    for name, pattern in (("hex", _HEX), ("upper", _UPPER), ("lower", _LOWER)):
        if pattern.fullmatch(candidate):
            return name
    return "plain" if candidate.isalnum() else "mixed"  # a run between separators, or a candidate with some inside


def wordlike(letters: str) -> bool:
    """Whether enough neighbouring letters are pairs that words have; random letters of 20 and more are not in 19 of 20 cases."""
    low = letters.lower()
    return sum(low[i : i + 2] in PAIRS for i in range(len(low) - 1)) >= WORDLIKE * (len(low) - 1)


def _allowed(word: str) -> bool:
    """Whether the form is that of words, numbers, paths or a UUID, and every long run of letters reads like words."""
    return (word.isalpha() or any(p.fullmatch(word) for p in ALLOW)) and all(wordlike(m) for m in LONG_RUN.findall(word))


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """Merged spans of high entropy: of the candidate as a whole, and of each run between its separators by the run's own class.

    A token glued to a name (session_id=<hex>) is so held to the limit that it has when it stands alone. Once a window
    fires, the whole run that it lies in is covered, so no part of a secret stays; a word beside it is covered only if windows hold half of it.
    An allowed candidate has allowed runs only.
    """
    if _allowed(candidate):
        return []
    spans = high_entropy(candidate, LEAST_BITS[class_of(candidate)])
    for m in RUN.finditer(candidate):
        if len(m[0]) < len(candidate) and not _allowed(m[0]):
            spans += [(m.start() + a, m.start() + b) for a, b in high_entropy(m[0], LEAST_BITS[class_of(m[0])])]
    if spans:
        for m in _STRETCH.finditer(candidate):
            held = max((min(b, m.end()) - max(a, m.start()) for a, b in spans), default=0)
            if held > 0 and (2 * held >= len(m[0]) or not _allowed(m[0])):
                spans.append(m.span())
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All secrets as (kind, start, end) in code points, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        found += [("entropy", m.start() + a, m.start() + b) for a, b in entropy_spans(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """Put one mark in place of every stretch that spans cover."""
    parts, at, upto = [], 0, -1
    for _, a, b in spans:
        if a >= upto:
            parts += [text[at:a], mark]
        upto = max(upto, b)
        at = upto
    return "".join([*parts, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = (
    T.StructField("secret_spans", T.StringType()), T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("redacted", T.StringType()),
)


def _scan_batch(texts: list[str | None]) -> list[list]:
    rows = []
    for t in texts:
        spans = find_spans(t or "")
        base = [s for s in spans if s[0] != "entropy"]
        kinds = [s[0] for s in base]
        rows.append((_joined(spans), kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), redact(t or "", spans)))
    return [list(c) for c in zip(*rows)] or [[] for _ in FIELDS]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `secret_spans`, `n_assign`, `n_access`, `n_hex`, `base_sha256` and `redacted` to every row.

    Whole texts are scanned; a null text counts as empty and has no spans. All other columns, whatever
    their names, pass unchanged; columns of the result replace columns of the same name. An empty
    table gives no rows. Nothing is shuffled.
    """
    return with_columns_by(docs, [text], lambda: _scan_batch, FIELDS)


def scan_table(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per document."""
    return scan(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("secret_spans").alias("spans"))
