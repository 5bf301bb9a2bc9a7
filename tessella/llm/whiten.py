"""Whitening of embeddings, its moments merged by Chan's formula.

Every partition computes the count, the local mean and the scatter centred on
that mean; ``treeReduce`` merges two partitions at a time on executors, so the
driver receives one triple of fixed size. The driver takes the eigenvectors of
the covariance (``eigh``); a second pass measures the covariance of the
whitened vectors and compares it with the identity.

Vectors enter as whole numbers, ``floor(scale * c) + OFFSET``, and every
distinct one counts once: the vector that a third of all rows share is combined
before the shuffle. Sums of them are exact; scatters are centred before they
are multiplied.

Defined cases: vectors that are null or hold null or non-finite entries take no
part; of vectors of several lengths only those of the commonest take part (of
equally common ones the longest), and empty ones never; rows that repeat an id
or have none are rows of their own; components without variance (below 1e-12 of
the greatest) have a null ``whitened``, and a table whose vectors are all equal
has explained zero; entries beyond 2**40 are clipped there; a ``deviation``
beyond a long is null; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

OFFSET = 1_000_000
SCALE = 64.0
MOST = 2.0**40
COMPONENTS = 16
BLOCK = 4_096
LEAST_SHARE = 1e-12

#: (count, exact sums, greatest absolute entry, mean, centred scatter)
Triple = tuple[int, list[int], int, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """n, exact sums S, the eigenvalues of the covariance, and its unit eigenvectors as columns, greatest first."""

    n: int
    sums: tuple[int, ...]
    most: int
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None


def whole_numbers(vector: str = "embedding", scale: float = SCALE):
    """The vector as an array of longs."""
    return F.transform(F.col(vector), lambda c: F.floor(F.greatest(F.least(c.cast("double") * F.lit(scale), F.lit(MOST)), F.lit(-MOST))) + F.lit(OFFSET).cast("long"))


def usable(vector: str = "embedding"):
    """True for vectors all of whose entries are finite numbers."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def quantised(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: float = SCALE) -> DataFrame:
    """(key, x) for the rows that take part."""
    fit = rows.where(usable(vector)).select(F.col(key).alias("vec_id"), whole_numbers(vector, scale).alias("x"))
    sizes = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return fit.where(F.size("x") == (sizes["size"] if sizes else 0))


def local_moments(points: np.ndarray, block: int = BLOCK) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred scatter of the rows of a matrix, block by block."""
    total = (0, np.zeros(points.shape[1]), np.zeros((points.shape[1],) * 2))
    for at in range(0, len(points), block):
        part = points[at : at + block]
        mean = part.mean(axis=0)
        centred = part - mean
        total = chan_merge(total, (len(part), mean, centred.T @ centred))
    return total


def chan_merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of two sets of rows together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _merge(a: Triple, b: Triple) -> Triple:
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, mean, scatter = chan_merge((a[0], *a[3:]), (b[0], *b[3:]))
    return n, [s + t for s, t in zip(a[1], b[1])], max(a[2], b[2]), mean, scatter


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums by column without overflow: of the low 20 bits and of the rest."""
    return [(int(h) << 20) + int(low) for h, low in zip((x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0))]


def moments(fit: DataFrame, size: int) -> Triple:
    """The merged triple of column ``x`` (longs)."""
    nothing: Triple = (0, [0] * size, 0, np.zeros(size), np.zeros((size, size)))

    def add(total: Triple, x: np.ndarray) -> Triple:
        # The offset is taken off as a whole number, so that means keep all their digits.
        n, mean, scatter = local_moments((x - OFFSET).astype(np.float64))
        return _merge(total, (n, _exact_sums(x), int(np.abs(x).max()), mean, scatter))

    return _tree(fit, size, add, _merge, nothing)


def moments_of(fit: DataFrame, size: int, project: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Merged count, mean and scatter of ``project(x)``, which has ``width`` columns."""
    nothing = (0, np.zeros(width), np.zeros((width, width)))
    return _tree(fit, size, lambda total, x: chan_merge(total, local_moments(project(x))), chan_merge, nothing)


def _tree(fit: DataFrame, size: int, add: Callable, merge: Callable, nothing):
    """``add`` folds the batches of a partition, ``merge`` the partitions, two by two on executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = nothing
        for batch in batches:
            if batch.num_rows:
                total = add(total, _matrix(batch.column(0), size))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = fit.select("x").mapInArrow(partial, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return parts.treeReduce(merge) if parts.getNumPartitions() else nothing


def projector(model: Whitening, components: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whole-number vectors to whitened ones; NaN for components without variance."""
    n, sums, wide = model.n, list(model.sums), 2 * model.n * max(1, model.most) >= 2**62
    e = model.values[:components]
    usable_values = np.where(e > LEAST_SHARE * max(model.values.max(initial=0.0), 0.0), e, np.nan)
    directions = model.vectors[:, :components] / np.sqrt(usable_values)

    def project(x: np.ndarray) -> np.ndarray:
        return (gaps(x, n, sums, wide) / n).astype(np.float64) @ directions

    return project


def gaps(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n * x - S, exactly: in longs, or where these are too short in Python's integers."""
    kind = object if wide else np.int64
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def deviations(gap: np.ndarray, wide: bool) -> list[int | None]:
    """Sums of squares by row, exactly; None beyond a long."""
    if not wide and gap.size and int(np.abs(gap).max()) ** 2 * gap.shape[1] < 2**63:
        return (gap * gap).sum(axis=1).tolist()
    sums = [sum(int(v) * int(v) for v in row) for row in gap]
    return [s if s < 2**63 else None for s in sums]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of column ``x``, each distinct vector once; None without any vector. ``fit`` should be a written table."""
    first = fit.select(F.size("x").alias("size")).first()
    if first is None:
        return None
    size = first["size"]
    n, sums, most, _, scatter = moments(fit, size)
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    model = Whitening(n, tuple(sums), most, float(np.trace(scatter) / n), values, np.ascontiguousarray(vectors))
    # Second pass: the covariance of the whitened vectors themselves.
    project = projector(model, min(components, size))
    kept = ~np.isnan(project(np.full((1, size), OFFSET, dtype=np.int64))[0])
    error = 0.0
    if kept.any():
        again = moments_of(fit, size, lambda x: project(x)[:, kept], int(kept.sum()))
        error = float(np.abs(again[2] / again[0] - np.eye(int(kept.sum()))).max())
    return Whitening(model.n, model.sums, model.most, model.trace, model.values, model.vectors, error)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that takes part and component up to ``components``."""
    schema = f"vec_id {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = quantised(rows, vector, key, scale)
    fit = materialize(named.select("x").distinct(), "vectors")
    model = fit_whitening(fit, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, size, sums = model.n, len(model.sums), list(model.sums)
    width, wide = min(components, size), 2 * n * max(1, model.most) >= 2**62
    project, error = projector(model, width), model.identity_error
    share = (model.values[:width] / model.trace if model.trace > 0 else np.zeros(width)).tolist()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch.column(1), size)
                rows_of = np.repeat(np.arange(len(x)), width)
                own = pa.array(deviations(gaps(x, n, sums, wide), wide), pa.int64())
                columns = [
                    batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows_of), n)),
                    own.take(pa.array(rows_of)), pa.array(project(x).ravel(), from_pandas=True), pa.array(np.tile(share, len(x))), pa.array(np.full(len(rows_of), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return named.select("vec_id", "x").mapInArrow(emit, schema)
