"""Whitening of embeddings by merging singular value decompositions up a tree.

Each part of a partition is centred on its own mean, exactly, and kept as a count, sums, all its singular values and
vectors. A merge stacks the two sets of scaled vectors and a row that corrects the means, sqrt(a b / (a + b)) times
their difference, and decomposes again: no dimension is cut off. Spark merges FAN parts a task, level by level, so
that a task holds FAN matrices of dimension squared; the last one alone, of bounded size, comes to the driver.

Vectors are taken on the grid floor(64 c) + 1,000,000 as whole numbers, so that sums and centring are exact.

Defined results: null vectors and those with null or non-finite entries, or entries beyond 2^40 on the grid, have no
result. Neither have vectors of another length than most (ties: the longer), nor an empty table. Directions without
variance (a table of equal vectors, fewer vectors than dimensions) can't be scaled: `whitened` is null there and
`explained` 0. Repeated vectors and ids count as often as they stand. A deviation beyond 64 bits is null. Other columns
are kept, and one named like a result (`whitened`, `deviation`) is replaced. More than MOST dimensions are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SCALE, SHIFT = 64, 1_000_000  # of the grid
WIDEST = 1 << 40  # on the grid
COMPONENTS = 32
MOST = 2048  # dimensions; a matrix of them takes 32 MB
FAN = 8  # parts merged in a task
BLOCK = 8192  # vectors decomposed at once
NO_VARIANCE = 1e-12  # of the greatest singular value, times dimensions
_PART = "part bigint, n bigint, sums array<string>, low array<double>, high array<double>, rows binary"


@dataclass
class Part:
    """n vectors with exact sums; rows^T rows is the sum of the products of what is left after centring."""

    n: int
    sums: list[int]
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Part:
        """x: whole numbers, a vector a row."""
        sums = x.sum(0)
        return Part(len(x), [int(s) for s in sums], x.min(0).astype(float), x.max(0).astype(float), _compact(centred(x, len(x), [int(s) for s in sums])))

    def merged(self, other: Part) -> Part:
        n, both = self.n + other.n, self.n * other.n
        gap = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums)]) / both  # of the means
        row = np.sqrt(self.n * (other.n / n)) * gap
        return Part(
            n, [a + b for a, b in zip(self.sums, other.sums)], np.minimum(self.low, other.low), np.maximum(self.high, other.high),
            _compact(np.vstack([self.rows, other.rows, row])),
        )


def _compact(rows: np.ndarray) -> np.ndarray:
    """Singular vectors times their values: at most as many rows as dimensions, all of them kept."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, each entry rounded once or twice: whole means are taken off first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - (s // n) * n) / n for s in sums])
    return (x - whole) - rest


def on_grid(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry as a double; null where the vector is to be left out."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > WIDEST // SCALE))
    return F.when(~bad & (F.size(v) > 0), F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _parts_of(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, wait, rows = None, [], 0

        def fold() -> None:
            nonlocal part, wait, rows
            new = Part.of(np.concatenate(wait))
            part, wait, rows = new if part is None else part.merged(new), [], 0

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                wait.append(_matrix(b.column(0).slice(at, BLOCK)))
                rows += len(wait[-1])
                if rows >= max(BLOCK, 4 * width):
                    fold()
        if wait:
            fold()
        if part is not None:
            yield _to_batch(TaskContext.get().partitionId(), part)

    return run


def _to_batch(number: int, p: Part) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
    row = [number, p.n, [str(s) for s in p.sums], p.low.tolist(), p.high.tolist(), p.rows.astype("<f8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["part", "n", "sums", "low", "high", "rows"])


def _part(row: dict) -> Part:
    width = len(row["sums"])
    return Part(row["n"], [int(s) for s in row["sums"]], np.array(row["low"]), np.array(row["high"]), np.frombuffer(row["rows"], "<f8").reshape(-1, width))


def _merge(table: pa.Table) -> pa.Table:
    found = None
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        found = _part(row) if found is None else found.merged(_part(row))
        number = row["part"] // FAN
    return pa.Table.from_batches([_to_batch(number, found)])


def tree(parts: DataFrame, count: int) -> Part | None:
    """The parts, numbered below `count`, merged FAN at a time."""
    row = _levels(parts, count, _merge, _PART).first()
    return _part(row.asDict()) if row is not None else None


def _levels(parts: DataFrame, count: int, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row at most; `count` parts or fewer, so that each task of a level has FAN rows."""
    parts = parts.withColumn("part", F.col("part") % count)
    while True:
        parts, count = parts.groupBy(F.floor(F.col("part") / FAN).alias("_cx_part")).applyInArrow(merge, schema), -(-count // FAN)
        if count == 1:
            return parts


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # a component a row
    values: np.ndarray  # the components' variances, 0 where there is none
    share: np.ndarray  # of all variance
    reach: float  # greatest distance of an entry from its mean


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The leading components of all vectors; None without vectors. Reads the table twice, once for the lengths alone."""
    x = vectors.select(on_grid(F.col(f"`{vec_col}`")).alias("x")).where("x IS NOT NULL")
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    width = common["d"]
    if width > MOST:
        raise ValueError(f"{width} dimensions are more than {MOST}")
    own = x.where(F.size("x") == width)
    top = tree(own.mapInArrow(_parts_of(width), _PART), own.rdd.getNumPartitions())
    _, s, v = np.linalg.svd(top.rows, full_matrices=True)
    k = min(components, width)
    var = np.zeros(max(k, len(s)))
    var[: len(s)] = np.where(s > NO_VARIANCE * width * s[0], s, 0.0) ** 2 / top.n
    mean = np.array([a / top.n for a in top.sums])
    reach = float(np.maximum(top.high - mean, mean - top.low).max()) + 1
    return Model(top.n, top.sums, v[:k], var[:k], var[:k] / var.sum() if var.sum() > 0 else var[:k], reach)


def _deviation(x: np.ndarray, m: Model) -> list[int | None]:
    """sum over dimensions of (n x - sums)^2, exact."""
    whole = np.array([s // m.n for s in m.sums], np.int64)
    rest = [s - (s // m.n) * m.n for s in m.sums]
    if (m.n * (m.reach + 1)) ** 2 * x.shape[1] < 1 << 62:
        gap = (x - whole) * m.n - np.array(rest, np.int64)
        return (gap * gap).sum(1).tolist()
    rows = ((x - whole).astype(object) * m.n - np.array(rest, object)) ** 2
    return [s if s < 1 << 63 else None for s in rows.sum(1).tolist()]


def transform(vectors: DataFrame, model: Model | None, vec_col: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """`carry` (default: all columns) of each row that has a result, plus deviation long and whitened array<double>,
    an entry for each component."""
    cols = [c for c in (vectors.columns if carry is None else carry) if c not in ("whitened", "deviation")]
    width = len(model.sums) if model else 0
    x = on_grid(F.col(f"`{vec_col}`"))
    src = vectors.withColumn("_cx_x", x).where((F.size("_cx_x") == width) & F.col("_cx_x").isNotNull() if model else F.lit(False))
    flat = np.zeros(0) if model is None else model.values == 0
    scale = None if model is None else model.vectors.T / np.sqrt(np.where(flat, 1.0, model.values))

    def make():
        def fn(a: pa.Array) -> list[pa.Array]:
            x = _matrix(a)
            w = centred(x, model.n, model.sums) @ scale
            values = pa.array(w.ravel(), mask=np.tile(flat, len(w)))
            return [pa.array(_deviation(x, model), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), values)]

        return fn

    return map_arrow(src, F.col("_cx_x"), cols, [("deviation", "bigint"), ("whitened", "array<double>")], make, BLOCK * max(1, width))


def identity_error(vectors: DataFrame, model: Model | None, vec_col: str = "embedding") -> float | None:
    """The largest entry by which the covariance of the whitened vectors differs from the identity, over the components
    with variance: measured in another pass, by a tree of centred products."""
    if model is None or not model.values.any():
        return None
    k = int((model.values > 0).sum())
    white = transform(vectors, model, vec_col, carry=[])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = _matrix(b.column("whitened"))[:, :k]
                own = w.mean(0)
                gap, total = own - mean, n + len(w)
                m2 += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * (len(w) / total))
                mean, n = mean + gap * (len(w) / total), total
        if n:
            yield _moments(TaskContext.get().partitionId(), n, mean, m2)

    def merge(t: pa.Table) -> pa.Table:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for r in sorted(t.to_pylist(), key=lambda r: r["part"]):
            gap, total = np.array(r["mean"]) - mean, n + r["n"]
            m2 += np.array(r["m2"]).reshape(k, k) + np.outer(gap, gap) * (n * (r["n"] / total))
            mean, n, number = mean + gap * (r["n"] / total), total, r["part"] // FAN
        return pa.Table.from_batches([_moments(number, n, mean, m2)])

    schema = "part bigint, n bigint, mean array<double>, m2 array<double>"
    row = _levels(white.mapInArrow(products, schema), white.rdd.getNumPartitions(), merge, schema).first()
    return float(np.abs(np.array(row["m2"]).reshape(k, k) / row["n"] - np.eye(k)).max())


def _moments(number: int, n: int, mean: np.ndarray, m2: np.ndarray) -> pa.RecordBatch:
    row = [pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(row, names=["part", "n", "mean", "m2"])
