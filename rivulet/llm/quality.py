"""Quality rules: statistics of each document, hard limits, and an isolation forest on the statistics.

The forest is fitted on a bounded sample of labelled documents; its threshold is calibrated on all
labelled ones. Fitting needs a few thousand short vectors on the driver; counting and scoring are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import with_columns_by
from rivulet.plans.fixpoint import cut

#: ASCII white space separates words; these characters are symbols. Fixed values.
SPACE, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that the forest uses.
MORE = ("n_lines", "n_upper", "n_punct", "n_distinct")
#: The statistics that the forest splits: all free of a document's length.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "punct", "variety")
#: Parts of the statistics, each with a forest and a threshold of its own: a habit that good documents
#: share (repeated lines, say) then costs only that part's threshold, and the other parts stay sharp.
PARTS = {"symbols": ("symbols",), "shape": ("word_length", "upper", "punct"), "repetition": ("dup_lines", "repeats", "variety")}
#: A good document lost weighs as much as the same share of so many bad ones kept.
GOOD_WEIGHT = 20.0
#: Rows of the labelled sample, trees, rows per tree: bounds of the fit.
SAMPLE, TREES, PER_TREE, SEED = 4_096, 128, 256, 5


def covered_by_repeats(ids: np.ndarray, kinds: int, window: int = 3) -> int:
    """Positions inside windows of three that occur twice or more."""
    n = len(ids)
    if n <= window:
        return 0
    code = ids[: n - window + 1].astype(np.int64)
    for k in range(1, window):
        if kinds >= 1 << 20:  # keep codes within 64 bits
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * kinds + ids[k : n - window + 1 + k]
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    again = times[inverse] >= 2
    if not again.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= again
    return int(covered.sum())


def count_text(text: str) -> tuple[int, ...]:
    """COUNTS and MORE of one text. Code points throughout."""
    data = text.encode()
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    letters = np.frombuffer(data, dtype=np.uint8)
    upper = int(np.count_nonzero((letters >= 65) & (letters <= 90)))
    punct = sum(map(text.count, "!?.,;:"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), covered_by_repeats(ids, max(1, len(seen))), len(lines), upper, punct, len(seen)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add COUNTS and MORE to every row; a null text counts as empty. Columns of these names are replaced, others pass."""

    def run(texts: list[str | None]) -> list[list]:
        rows = [count_text(t or "") for t in texts]
        return [list(c) for c in zip(*rows)] or [[] for _ in (*COUNTS, *MORE)]

    return with_columns_by(docs, [text], lambda: run, [T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)])


def base_failed():
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from rows of COUNTS and MORE."""
    words, chars, symbols, dup, repeats, lines, upper, punct, distinct = counts.T.astype(float)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([chars / w, symbols / c, dup / np.maximum(lines, 1), repeats / w, upper / c, punct / w, np.log(np.maximum(distinct, 1)) / np.log(w + 1)], axis=1)


def expected_path(n: float | np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation trees as flat arrays: feature (-1 at leaves), split value, left child (right is the next), path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** (-mean path / expected path) of each row: near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, self.left[node] + (x[every, np.maximum(f, 0)] > self.split[node]), node)
            total += self.path[node]
        return 2.0 ** (-total / max(1, len(self.roots)) / max(self.norm, 1e-9))


def grow(sample: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED) -> Forest:
    """Random trees, each on a random part of the sample; a node splits one feature that varies, at a uniform place in its range."""
    rng = np.random.default_rng(seed)
    per_tree = min(per_tree, len(sample))
    deepest = int(np.ceil(np.log2(max(2, per_tree))))
    nodes: list[list[float]] = []
    roots = []

    def build(at: int, rows: np.ndarray, depth: int) -> None:
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        varies = np.flatnonzero(high > low) if len(rows) > 1 and depth < deepest else []
        if not len(varies):
            nodes[at] = [-1, 0.0, 0, depth + float(expected_path(len(rows)))]
            return
        f = int(rng.choice(varies))
        value = rng.uniform(low[f], high[f])
        first = len(nodes)
        nodes.extend([[], []])
        nodes[at] = [f, value, first, 0.0]
        above = rows[:, f] > value
        build(first, rows[~above], depth + 1)
        build(first + 1, rows[above], depth + 1)

    for _ in range(trees if per_tree else 0):
        roots.append(len(nodes))
        nodes.append([])
        build(roots[-1], sample[rng.choice(len(sample), per_tree, replace=False)], 0)
    table = np.array(nodes, dtype=float).reshape(-1, 4)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3], np.array(roots, dtype=int), float(expected_path(per_tree)))


def _part(x: np.ndarray, part: str) -> np.ndarray:
    return x[:, [FEATURES.index(f) for f in PARTS[part]]]


def with_counts_and_scores(docs: DataFrame, forests: dict[str, Forest], text: str = "text") -> DataFrame:
    """COUNTS, MORE and the anomaly columns of every row in one pass."""
    names = [*COUNTS, *MORE]

    def make():
        def run(texts: list[str | None]) -> list[list]:
            counts = np.array([count_text(t or "") for t in texts], dtype=np.int64).reshape(-1, len(names))
            x = features(counts)
            return [*counts.T.tolist(), *[forest.score(_part(x, part)).tolist() for part, forest in forests.items()]]

        return run

    fields = [T.StructField(c, T.LongType()) for c in names] + [T.StructField(f"anomaly_{part}", T.DoubleType()) for part in forests]
    return with_columns_by(docs, [text], make, fields)


def _scores(rows: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """Add one column anomaly_<part> per forest."""
    columns = [*COUNTS, *MORE]

    def make():
        def run(*counts: Sequence[int]) -> list[list]:
            x = features(np.array(counts, dtype=np.int64).reshape(len(columns), -1).T)
            return [forest.score(_part(x, part)).tolist() for part, forest in forests.items()]

        return run

    return with_columns_by(rows, columns, make, [T.StructField(f"anomaly_{part}", T.DoubleType()) for part in forests])


def thresholds_from(scored: DataFrame, parts: Sequence[str], step: float = 0.002, good_weight: float = GOOD_WEIGHT) -> dict[str, float]:
    """For each part the score above which documents go, from all labelled rows: most bad documents caught for the good ones lost.

    `scored` has quality and the anomaly columns. The part that gains most is settled first; the
    next ones only count what it leaves, so no part takes good documents for bad ones that are caught already. Scores are
    counted in bins of `step`, so at most 1 / step rows a part reach the driver. The threshold lies in the middle of the
    gap above the best bin. A part that gains nothing, or has no rows of both kinds, has the threshold infinity.
    """
    out: dict[str, float] = {}
    while len(out) < len(parts):
        open_parts = [p for p in parts if p not in out]
        left = scored
        for p, limit in out.items():
            left = left.where(F.col(f"anomaly_{p}") <= F.lit(limit))
        long = left.select("quality", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.floor(F.col(f"anomaly_{p}") / step).alias("bin")) for p in open_parts])).alias("x"))
        bins = long.groupBy("x.part", "x.bin").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad")).toPandas()
        best_part, best_gain, best_limit = None, 0.0, float("inf")
        for part, rows in bins.groupby("part"):
            rows = rows.sort_values("bin")
            good, bad, at = rows["good"].to_numpy(), rows["bad"].to_numpy(), rows["bin"].to_numpy()
            if good.sum() and bad.sum() and len(rows) > 1:
                gain = ((1 - bad.cumsum() / bad.sum()) - good_weight * (1 - good.cumsum() / good.sum()))[:-1]
                best = int(gain.argmax())
                if gain[best] > best_gain:
                    best_part, best_gain, best_limit = part, gain[best], float((at[best] + 1 + at[best + 1]) / 2 * step)
        if best_part is None:
            return out | dict.fromkeys(open_parts, float("inf"))
        out[best_part] = best_limit
    return out


def fit(counted: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> tuple[dict[str, Forest], dict[str, float]]:
    """Forest and threshold of each part, from counted documents with their key and labels."""
    known = labels.where("quality is not null").groupBy(key).agg(F.max("quality").alias("quality"))
    labelled = cut(counted.where(~base_failed()).join(known, key).select(F.col(key).alias("key"), "quality", *COUNTS, *MORE))
    rows = labelled.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(sample).select(*COUNTS, *MORE).toPandas().to_numpy(dtype=np.int64)
    x = features(rows.reshape(-1, len(COUNTS) + len(MORE)))
    forests = {part: grow(_part(x, part)) for part in PARTS}
    return forests, thresholds_from(cut(_scores(labelled, forests)), list(PARTS))


def _verdict(limits: dict[str, float]) -> Column:
    kept = ~F.col("base_failed")
    for part, limit in limits.items():
        kept &= F.col(f"anomaly_{part}") <= F.lit(limit)
    return kept


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Add COUNTS, base_failed, the anomaly of each part, and kept to every row.

    `labels` has the key and `quality` (1 good, 0 bad, null unknown). The forests are fitted on at most `sample` labelled rows that
    pass the limits, picked by a hash of the key; the thresholds come from all such rows. Without labelled rows of both kinds only the
    limits decide. Null and empty texts fail the limits. Columns named like the new ones are replaced; a repeated
    document counts as often as it occurs. Texts are read twice, once for the labelled rows; scoring shuffles nothing.
    """
    forests, limits = fit(with_counts(docs.select(F.col(key), F.col(text)), text).drop(text), labels, key, sample)
    out = with_counts_and_scores(docs, forests, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", _verdict(limits)).drop(*MORE)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document. Texts are read once: fit and verdict both start from the written counts."""
    counted = cut(with_counts(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text").drop("text"))
    forests, limits = fit(counted, labels)
    out = _scores(counted, forests).withColumn("base_failed", base_failed()).withColumn("kept", _verdict(limits))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", *[f"anomaly_{p}" for p in PARTS])
