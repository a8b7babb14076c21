"""Whitening of embeddings; the components come from FEAST contour integration.

Three passes over the vectors gather sums, the covariance and the covariance of the result, each as one partial table per task
that Spark adds up. Between them only the covariance is handled, whose size depends on the dimension alone. Its spectrum is cut into
slices by inertia counts; every slice is a Spark task that integrates the resolvent around it and extracts its components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components kept; vectors of more dimensions are refused, which bounds what reaches the driver and the tasks (128 MB).
COMPONENTS, MAX_DIMENSION = 32, 4096
#: Grid of the fixed-point vectors: x = floor(SCALE * c) + SHIFT. An entry beyond +-LARGEST is held there, so that sums stay exact.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
#: Eigenvalues of a slice, shifts tried between two cuts, quadrature nodes of a half circle, rounds of the subspace iteration.
SLICE, SHIFTS, NODES, ROUNDS, SEED = 8, 8, 8, 12, 13
#: Relative to the trace: narrowest slice that is cut further, residual of a settled component, least variance of a component.
NARROWEST, SETTLED, NOTHING = 1e-6, 1e-13, 1e-13

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- the matrix
def negative_pivots(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix: signs of D in P A P' = L D L', with pivots of one or two rows."""
    a = a.copy()
    negative = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), len(a))
        if diagonal[p] == 0 and off[r, s] == 0:
            break
        if diagonal[p] >= 0.64 * off[r, s]:
            negative += int(a[p, p] < 0)
            keep = np.delete(np.arange(len(a)), p)
            column = a[keep, p]
            a = a[np.ix_(keep, keep)] - np.outer(column, column / a[p, p])
        else:  # a block of two with a negative determinant has one eigenvalue of each sign
            negative += 1
            keep = np.delete(np.arange(len(a)), [r, s])
            block, columns = a[np.ix_([r, s], [r, s])], a[np.ix_(keep, [r, s])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return negative


def contour_components(v: np.ndarray, low: float, high: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high] and their vectors as columns.

    The resolvent is integrated over a circle around the slice by Gauss-Legendre nodes of its upper half, each a complex shifted solve;
    that filters a random block towards the wanted space, from which Rayleigh-Ritz extracts the pairs. Repeated until they are as many as
    counted and settled; nothing is returned if they do not get there, as with a circle far wider than the pairs in it.
    """
    size = len(v)
    width = min(size, count + count // 2 + 8)
    at, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - at)
    middle, radius = (low + high) / 2, (high - low) / 2
    block = np.random.default_rng(SEED).standard_normal((size, width))
    last = np.inf
    for _ in range(ROUNDS):
        filtered = np.zeros((size, width))
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            filtered += weight / 2 * (turn * np.linalg.solve((middle + turn) * np.eye(size) - v, block.astype(complex))).real
        basis, _ = np.linalg.qr(filtered)
        inner = basis.T @ v @ basis
        ritz, turn_to = np.linalg.eigh((inner + inner.T) / 2)
        block = basis @ turn_to
        inside = (ritz > low) & (ritz <= high)
        values, vectors = ritz[inside], block[:, inside]
        residual = np.abs(v @ vectors - vectors * values).max(initial=0) if len(values) == count else np.inf
        if residual <= SETTLED * scale and residual >= last / 2:  # settled, and another round gains no digit
            return values, vectors
        last = residual
    return np.zeros(0), np.zeros((size, 0))


def _in_tasks(spark: SparkSession, rows: list[tuple], schema: str, fn: Callable[[pd.DataFrame], pd.DataFrame], out: str) -> list:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    return spark.createDataFrame(rows, schema).mapInPandas(run, out).collect()


def _counts(spark: SparkSession, v: np.ndarray, shifts: list[float]) -> dict[float, int]:
    """Eigenvalues above each shift; a shift's inertia count is a row of its own."""

    def above(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shift": part["shift"], "above": [len(v) - negative_pivots(v - s * np.eye(len(v))) for s in part["shift"]]})

    return {r["shift"]: r["above"] for r in _in_tasks(spark, [(s,) for s in shifts], "shift double", above, "shift double, above int")}


def _inside(low: float, high: float, attempt: int) -> list[float]:
    return [float(low + (high - low) * (k + 0.37 * attempt / 7) / (SHIFTS + 1)) for k in range(1, SHIFTS + 1)]


def spectrum_slices(spark: SparkSession, v: np.ndarray, scale: float, wanted: int, attempt: int = 0) -> list[tuple[float, float, int]]:
    """Slices (low, high, eigenvalues) from the top down to at least `wanted`, each of at most SLICE eigenvalues where shifts can tell them apart.

    Each round tries several shifts in every slice that holds too many.
    """
    cuts = {1.01 * scale: 0, -0.01 * scale: len(v)}
    while True:
        order = sorted(cuts, reverse=True)
        wide = [(b, a) for a, b in zip(order, order[1:]) if cuts[b] - cuts[a] > SLICE and cuts[a] < wanted and a - b > NARROWEST * scale]
        if not wide:
            break
        cuts |= _counts(spark, v, [s for low, high in wide for s in _inside(low, high, attempt)])
    out, high = [], order[0]
    for a, b in zip(order[1:], [*order[2:], None]):
        if cuts[a] == 0:
            high = a
        elif b is None or cuts[b] - cuts[high] > SLICE or cuts[a] >= wanted:
            if cuts[a] > cuts[high]:
                out.append((a, high, cuts[a] - cuts[high]))
            high = a
            if cuts[a] >= wanted:
                break
    return out


def leading_components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as columns.

    Every slice must yield as many settled pairs as its inertia counts say. One that does not is cut further; one too narrow for that
    has a cut on an eigenvalue, and all is done again with other cuts.
    """
    scale = float(np.trace(v))
    if scale <= 0:
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]

    def extract(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for low, high, count in zip(part["low"], part["high"], part["count"]):
            values, vectors = contour_components(v, low, high, count, scale)
            rows += [(low, float(e), vectors[:, i].tolist()) for i, e in enumerate(values)]
        return pd.DataFrame(rows, columns=["low", "value", "vector"])

    for attempt in range(5):
        pending, found, stuck = spectrum_slices(spark, v, scale, wanted, attempt), [], False
        while pending and not stuck:
            pairs = _in_tasks(spark, pending, "low double, high double, count int", extract, "low double, value double, vector array<double>")
            found += [r["vector"] for r in pairs]
            settled = {r["low"] for r in pairs}
            rest = [x for x in pending if x[0] not in settled]
            stuck = any(high - low <= NARROWEST * scale for low, high, _ in rest)
            counts = _counts(spark, v, [s for low, high, _ in rest for s in [low, high, *_inside(low, high, attempt)]]) if rest and not stuck else {}
            pending = []
            for low, high, _ in rest if counts else []:
                ends = [high, *reversed(_inside(low, high, attempt)), low]
                pending += [(b, a, counts[b] - counts[a]) for a, b in zip(ends, ends[1:]) if counts[b] > counts[a]]
        if not stuck and len(found) >= wanted:
            break
    else:
        raise RuntimeError("the slices do not hold the components that the inertia counts promise")
    basis, _ = np.linalg.qr(np.array(found).T)  # vectors of different slices, made orthogonal to the last digit
    inner = basis.T @ v @ basis
    values, turn_to = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")[:wanted]
    return np.maximum(values[order], 0), (basis @ turn_to)[:, order]


# ---------------------------------------------------------------- the vectors
def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, size)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they suffice, else in Python's integers."""
    largest = max(abs(s) for s in sums) + n * int(np.abs(x).max(initial=0))
    if largest < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(deviation: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null where it does not fit 64 bits."""
    largest = int(np.abs(deviation).max(initial=0))
    if deviation.dtype != object and largest * largest * max(deviation.shape[1], 1) < 1 << 62:
        return (deviation * deviation).sum(axis=1).tolist()
    exact = [sum(int(y) ** 2 for y in row) for row in deviation]
    return [s if s < 1 << 63 else None for s in exact]


def _added_up(rows: DataFrame, size: int, width: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the matrix products z' z of make(x), width by width; one partial matrix per task, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = make(_matrix(batch, size))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    cells = rows.select("x").mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for part in cells.toArrow().to_batches():
        out[part.column("i").to_numpy(), part.column("j").to_numpy()] = part.column("v").to_numpy()
    return (out + out.T) / 2


def fixed_point_rows(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable vectors: not null, not empty, without null or non-finite entries."""
    c = F.transform(F.col(embedding), lambda y: y.cast("double"))
    x = F.transform("c", lambda y: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(y * SCALE).cast("long"))) + F.lit(SHIFT).cast("long"))
    fine = F.forall("c", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c"))
    return rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are dropped; so are those of another length than the commonest
    (of equally common lengths the longest). All others are fitted, whitened and returned, repeated rows and repeated or null vec_ids each for itself.
    Components without variance (there are such if vectors are fewer than dimensions, or all equal) have explained 0
    and a null whitened; without any variance identity_error is null. deviation is null where it exceeds 64 bits. Entries beyond 2 ** 34 count as that. Fewer
    dimensions than components give fewer components; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = fixed_point_rows(vectors, vec_id, embedding)
    commonest = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if commonest is None:
        return spark.createDataFrame([], SCHEMA)
    size, n = commonest["size"], commonest["count"]
    if size > MAX_DIMENSION:
        raise ValueError(f"vectors of {size} dimensions; the covariance is handled up to {MAX_DIMENSION}")
    rows = rows.where(F.size("x") == size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            total = [a + b for a, b in zip(total, _matrix(batch, size).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "s"])

    sums = {r["i"]: int(r["s"]) for r in rows.select("x").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    sums = [sums[i] for i in range(size)]
    centred = lambda x: (_deviations(x, n, sums) / n).astype(np.float64)
    covariance = _added_up(rows, size, size, centred) / n
    count = min(components, size)
    values, axes = leading_components(spark, covariance, count)
    total = float(np.trace(covariance))
    real = int((values > NOTHING * total).sum()) if total > 0 else 0
    project = axes[:, :real] / np.sqrt(values[:real])
    explained = [float(e / total) if k < real else 0.0 for k, e in enumerate(values)]
    identity_error = float(np.abs(_added_up(rows, size, real, lambda x: centred(x) @ project) / n - np.eye(real)).max()) if real else None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _deviations(_matrix(batch, size), n, sums)
            m = len(d)
            white = np.full((m, count), np.nan)
            white[:, :real] = (d / n).astype(np.float64) @ project
            each = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n, dtype=np.int64)),
                    pa.array(_squares(d), pa.int64()).take(pa.array(each)), pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(explained, m), pa.float64()),
                    pa.array([identity_error] * (m * count), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(spread, SCHEMA)
