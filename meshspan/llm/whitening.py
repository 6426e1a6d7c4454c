"""Whitening of embeddings by a tall-skinny QR.

Entries become whole numbers, so sums are exact and rows are centred without
rounding away small differences.  Every task factors its centred rows into one
upper triangle; triangles are stacked and factored again, a fixed number at a
time, until one is left.  Its singular values and right vectors are the square
roots of the eigenvalues and the eigenvectors of the covariance, which is never
formed.  A second pass over the fit list measures how far the whitened rows'
covariance is from the identity.

What the driver sees is bounded by the dimension: the sums, the last triangle,
and one small matrix.  Equal vectors are one row of the fit list, however many
rows hold them, and are brought together by grouping, which meets in the tasks
before it shuffles.

Defined results: a vector that is null, or holds a null or a number that isn't
finite, has no rows.  The dimension is the commonest length of the rest (the
longer of equally common ones); vectors of another length, empty ones too, have
no rows.  Whole numbers are held within 2**53 either way, so that they are exact
as doubles.  Components whose deviation is nothing but rounding (constant
dimensions, fewer distinct vectors than dimensions, one vector) are left out;
equal eigenvalues keep the order of the decomposition, and the sign makes each
vector's largest entry positive.  ``deviation`` is null where a long can't hold
it.  Repeated rows and ids give equal rows; a null id stays; only the two named
columns are read, so others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

SCALE, SHIFT = 64, 1_000_000  # fixed: entry c becomes floor(64 c) + 1,000,000
BOUND = 1 << 53
FAN_IN = 16  # triangles that one task stacks
ROWS = 4096  # rows factored at a time
NOISE = 1e-11  # of the largest singular value; what is below is rounding


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of the rows whose vector is whole and finite."""
    c = F.col("c").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(c, lambda v: (F.greatest(F.least(F.floor(v * float(SCALE)), F.lit(BOUND)), F.lit(-BOUND)) + SHIFT).cast("long"))
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("c")).filter(F.col("c").isNotNull()).filter(finite).select("id", whole.alias("x"))


def dimension(vectors: DataFrame) -> int:
    """The commonest length; 0 without rows."""
    top = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def _matrix(batch, d: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, as Python integers."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            high += (x >> 32).sum(axis=0)  # halves can't overflow within a task
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "high": pa.array(high), "low": pa.array(low)})

    parts = fit.mapInArrow(run, "dim int, n long, high long, low long").groupBy("dim")
    wide = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    got = sorted(parts.agg(F.sum("n").alias("n"), *wide).collect())
    return got[0].n, [(int(r.high) << 32) + int(r.low) for r in got]


class Centre:
    """Subtracts the mean: whole part first, which is exact, then the fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.fraction = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 for each row, exactly."""
        moved = x - self.whole
        top = float(self.n) * (float(np.abs(moved).max(initial=0)) + 1)
        if top * top * x.shape[1] < 2.0**62:
            return ((self.n * moved - self.rest) ** 2).sum(axis=1).tolist()
        rest = self.rest.tolist()
        out = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in moved.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def _triangle(blocks, d: int) -> np.ndarray:
    """R of the blocks stacked on each other; never holds more than one block and one triangle."""
    r = np.zeros((0, d))
    for block in blocks:
        for i in range(0, len(block), ROWS):
            r = np.linalg.qr(np.vstack([r, block[i : i + ROWS]]), mode="r")
    return r


def tsqr(fit: DataFrame, centre: Centre, d: int) -> np.ndarray:
    """The last triangle: R with R'R = Y'Y for the centred rows Y."""

    def row(at: int, r: np.ndarray):
        return pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def leaf(batches):
        from pyspark import TaskContext

        r = _triangle((centre(_matrix(b, d)) for b in batches), d)
        if len(r):
            yield row(TaskContext.get().partitionId(), r)

    def merge(key, table):
        r = _triangle((np.array(v.as_py()).reshape(-1, d) for v in table.column("r")), d)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    level = stored(fit.mapInArrow(leaf, "at long, r array<double>"), "triangles")
    while level.count() > 1:  # task numbers shrink by FAN_IN a round, so rounds are few whatever the number of tasks
        level = stored(level.select(F.floor(F.col("at") / FAN_IN).cast("long").alias("at"), "r").groupBy("at").applyInArrow(merge, "at long, r array<double>"), "triangles")
    return np.array(level.first().r).reshape(-1, d)


class Model:
    """Directions, their eigenvalues (falling) and what they explain."""

    def __init__(self, r: np.ndarray, n: int, k: int):
        _, s, right = np.linalg.svd(r / np.sqrt(n))
        real = s > s.max(initial=0) * NOISE
        k = min(k, int(real.sum()))
        self.values = s[:k] ** 2
        v = right[:k]
        self.vectors = (v * np.sign(v[np.arange(k), np.abs(v).argmax(axis=1)])[:, None]).T
        self.explained = self.values / (s**2).sum()

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def identity_error(fit: DataFrame, centre: Centre, model: Model, d: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = model.vectors.shape[1]

    def run(batches):
        n, mean, cross = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whiten(centre(_matrix(batch, d)))
            m, mu = len(w), w.mean(axis=0)
            gap = mu - mean
            w -= mu
            cross += w.T @ w + np.outer(gap, gap) * (n * m / (n + m))
            n, mean = n + m, mean + gap * (m / (n + m))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "cross": [cross.ravel().tolist()]})

    parts = stored(fit.mapInArrow(run, "n long, mean array<double>, cross array<double>"), "moments")
    total = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)]).first()
    mean = [total[f"m{i}"] / total.n for i in range(k)]
    gap = [F.col("mean")[i] - F.lit(mean[i]) for i in range(k)]
    cross = [F.sum(F.col("cross")[i * k + j] + F.col("n") * gap[i] * gap[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    got = parts.agg(*cross).first()
    return max(abs(got[f"c{i}_{j}"] / total.n - (i == j)) for i in range(k) for j in range(i, k))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row a vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    key = rows.schema[id_col].dataType
    schema = f"`{id_col}` {key.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = whole_vectors(rows, id_col, vector_col)
    d = dimension(vectors)
    spark = rows.sparkSession
    if not d:
        return spark.createDataFrame([], schema)
    vectors = vectors.filter(F.size("x") == d)
    fit = stored(vectors.select("x").distinct(), "vectors")
    n, sums = exact_sums(fit, d)
    centre = Centre(n, sums)
    model = Model(tsqr(fit, centre, d), n, components)
    k = model.vectors.shape[1]
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, centre, model, d)

    def run(batches):
        for batch in batches:
            x = _matrix(batch, d)
            m = len(x)
            if not m:
                continue
            w = model.whiten(centre(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
