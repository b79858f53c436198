"""Whitening of embeddings with refined eigenvectors.

Vectors become whole numbers, so their sums and, after centring, the sums of their products are
exact while they stay under 2**53: the covariance does not depend on the order in which tasks
are added. Its eigenvectors are found in single precision and corrected by the Ogita-Aishima
iteration: each step takes the defect of orthogonality and of diagonality in extended precision
and multiplies the vectors by a correction of second order. Where eigenvalues lie closer
together than the step can resolve, the covariance is projected on the vectors of the cluster,
shifted by its mean and solved anew, which gives the differences their full precision back.

Spark holds the vectors; the driver sees tables of dimension x dimension only. Each pass is one
scan, and its partial results (one matrix per task) are added in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.memory import give_back

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Partial results that one task adds up.
FAN_IN = 16
#: Values of a batch that are worked on at once.
CELLS = 1 << 20
MAX_STEPS = 40


@dataclass(frozen=True)
class Whitener:
    """What `fit` learns: n vectors with sums `sums`, the eigenvalues `values` (falling) and the
    unit eigenvectors in the columns of `vectors`, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def usable_rows(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """_id and _vec (doubles) of the rows that take part, and their dimension.

    That is the most frequent length of a usable vector (of equally frequent ones the greatest);
    vectors of any other length take no part, nor do empty ones. 0 if there is none."""
    vector = F.col(f"`{vector_col}`")
    rows = table.select(F.col(f"`{id_col}`").alias("_id"), vector.cast("array<double>").alias("_vec"))
    rows = rows.filter(usable(F.col("_vec")) & (F.size("_vec") > 0))
    length = F.size("_vec").alias("length")
    most = rows.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    width = most["length"] if most else 0
    return rows.filter(F.size("_vec") == width), width


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of every entry, as long; entries too large for that saturate."""
    edge = float(1 << 52)
    return np.clip(np.floor(vectors * SCALE), -edge, edge).astype(np.int64) + SHIFT


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in parts of at most CELLS values, with their vectors as a matrix."""
    rows = max(1, CELLS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, width)


def _add_up(rows: DataFrame, width: int, length: int, own: Callable, add: Callable) -> np.ndarray | None:
    """`own` of every task's vectors (an array of `length` values), added up by `add` in a tree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, matrix in _matrices(batches, 0, width):
            part = own(matrix)
            total = part if total is None else add(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
        give_back()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = np.frombuffer(data, kind).copy()
                total = part if total is None else add(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    kind = own(np.zeros((1, width))).dtype
    parts = rows.select("_vec").mapInArrow(each, "part binary")
    tasks = rows.sparkSession.sparkContext.defaultParallelism * FAN_IN
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks, F.xxhash64("part")).mapInArrow(join, "part binary")
    found = parts.repartition(1).mapInArrow(join, "part binary").first()
    return None if found is None else np.frombuffer(found["part"], kind)[:length].copy()


def count_and_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and S: how many vectors, and the sum of every dimension, exactly."""
    low = (1 << 31) - 1

    def own(matrix: np.ndarray) -> np.ndarray:
        x = whole(matrix)  # in two halves: their sums fit a long for over 2**30 vectors of any size
        return np.concatenate([[len(x)], (x >> 31).sum(axis=0), (x & low).sum(axis=0)]).astype(np.int64)

    total = _add_up(rows, width, 2 * width + 1, own, np.add)
    if total is None:
        return 0, [0] * width
    high, rest = total[1 : width + 1].tolist(), total[width + 1 :].tolist()
    return int(total[0]), [(h << 31) + r for h, r in zip(high, rest)]


def covariance(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the whole-number vectors, in extended precision.

    Vectors are centred by the whole number nearest to the mean before they are multiplied, and
    the remainder of under one half is corrected afterwards."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)

    def own(matrix: np.ndarray) -> np.ndarray:
        z = (whole(matrix) - centre).astype(np.float64)
        return (z.T @ z).ravel()

    products = _add_up(rows, width, width * width, own, np.add).reshape(width, width).astype(np.longdouble)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=np.longdouble) / n
    v = products / n - np.outer(rest, rest)
    return (v + v.T) / 2


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of eigenvalues that chains of gaps up to `width` hold together, two or more each."""
    order = np.argsort(-values)
    groups = np.split(order, np.flatnonzero(-np.diff(values[order]) > width) + 1)
    return [g for g in groups if len(g) > 1]


def refine_step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: better eigenvectors, eigenvalues, how close values may lie
    together before the step cannot tell them apart, and the defect of `x` as it was."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # norms by the largest row sum, which bounds the spectral norm from above
    unclear = 2 * (np.abs(off).sum(axis=1).max() + np.abs(a).sum(axis=1).max() * np.abs(r).sum(axis=1).max())
    gaps = values[None, :] - values[:, None]
    far = np.abs(gaps) > unclear
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gaps, 1), r / 2)
    return x + x @ e, values, float(unclear), float(max(np.abs(r).max(), np.abs(off).max()))


def _solve_cluster(a: np.ndarray, x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The vectors of one cluster turned to eigenvectors of the covariance on their span: the
    shifted, scaled remainder is small, so single differences count in it again."""
    basis, _ = np.linalg.qr(x[:, places].astype(np.float64))
    basis = basis.astype(a.dtype)
    basis = basis @ (1.5 * np.eye(len(places), dtype=a.dtype) - 0.5 * (basis.T @ basis))
    inner = basis.T @ (a @ basis)
    inner = inner - np.eye(len(places), dtype=a.dtype) * (np.trace(inner) / len(places))
    size = np.abs(inner).max()
    if size == 0:
        return basis
    _, turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))
    return basis @ turn[:, ::-1].astype(a.dtype)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix: single
    precision first, then steps of higher precision until they change nothing."""
    a = a.astype(np.longdouble)
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x.astype(np.longdouble)
    best, least, idle = x, np.inf, 0
    for _ in range(MAX_STEPS):
        after, values, unclear, defect = refine_step(a, x)
        if defect < least:
            best, least, idle = x, defect, 0
        else:
            idle += 1
        if defect <= np.finfo(a.dtype).eps * len(a) or idle == 3:
            break
        for places in _clusters(values, unclear):
            after[:, places] = _solve_cluster(a, after, places)
        x = after
    x = best @ (1.5 * np.eye(len(a), dtype=a.dtype) - 0.5 * (best.T @ best))  # orthonormal, clusters too
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def fit(rows: DataFrame, width: int) -> Whitener | None:
    """A whitener over all `rows` (see `usable_rows`); None without rows."""
    n, sums = count_and_sums(rows, width)
    if not n:
        return None
    v = covariance(rows, width, n, sums)
    values, vectors = eigen(v)
    return Whitener(n, sums, values, vectors, float(np.trace(v)))


def kept_components(model: Whitener, components: int) -> np.ndarray:
    """1 / sqrt(eigenvalue) of the first components; 0 for directions without variance."""
    values = model.values[:components]
    floor = len(model.values) * np.finfo(np.float64).eps * max(float(model.values[0]), 0.0)
    return np.where(values > floor, 1 / np.sqrt(np.where(values > floor, values, 1)), 0.0)


def _offsets(model: Whitener) -> Callable[[np.ndarray], np.ndarray]:
    """A function from whole-number vectors to n * x - S: long where that fits, else objects."""
    centre = [s // model.n for s in model.sums]
    rest = [s - model.n * c for s, c in zip(model.sums, centre)]
    near, small = np.array(centre, dtype=np.int64), np.array(rest, dtype=np.int64)

    def run(x: np.ndarray) -> np.ndarray:
        z = x - near
        if np.abs(z).max(initial=0) < (1 << 62) // model.n - 1:
            return z * model.n - small
        return z.astype(object) * model.n - small.astype(object)

    return run


def _deviations(d: np.ndarray) -> list[int | None]:
    """The exact sums of squares per row; None where a long cannot hold them."""
    about = (d.astype(np.float64) ** 2).sum(axis=1)
    if d.dtype != object and about.max(initial=0) < float(1 << 62):
        return (d * d).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in d.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def project(rows: DataFrame, width: int, model: Whitener, components: int) -> DataFrame:
    """_id, deviation and whitened (an array, one entry per component) of every row."""
    count = min(components, width)
    turn = model.vectors[:, :count] * kept_components(model, count)
    offsets = _offsets(model)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in _matrices(batches, 1, width):
            d = offsets(whole(matrix))
            flat = ((d.astype(np.float64) / model.n) @ turn).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, count), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(_deviations(d), pa.int64()), lists], names=["_id", "deviation", "whitened"]
            )
        give_back()

    return rows.select("_id", "_vec").mapInArrow(run, f"_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, width: int, model: Whitener, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, by a
    scan of its own. Every batch is centred by its own mean, and batches are put together by
    their counts, means and centred products."""
    count = min(components, width)
    turn = model.vectors[:, :count] * kept_components(model, count)
    offsets = _offsets(model)

    def own(matrix: np.ndarray) -> np.ndarray:
        y = (offsets(whole(matrix)).astype(np.float64) / model.n) @ turn
        mean = y.mean(axis=0)
        return np.concatenate([[float(len(y))], mean, ((y - mean).T @ (y - mean)).ravel()])

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        step = b[1 : count + 1] - a[1 : count + 1]
        products = a[count + 1 :] + b[count + 1 :] + (np.outer(step, step) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], a[1 : count + 1] + step * (b[0] / n), products])

    total = _add_up(rows, width, 1 + count + count * count, own, add)
    cov = total[count + 1 :].reshape(count, count) / total[0]
    return float(np.abs(cov - np.eye(count)).max())


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and component (up to `components`, or the dimension): id,
    component, n, deviation, whitened, explained and identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are
    vectors of another length than most. Null and repeated ids are ids like others, and every
    row counts in the fit. A direction without variance whitens to 0, and counts with an error
    of 1 in identity_error; explained is 0 if no direction has any. A deviation that a long
    cannot hold is null. Other columns are not read. An empty table gives no rows.
    """
    rows, width = usable_rows(table, id_col, vector_col)
    kind = rows.schema["_id"].dataType.simpleString()
    model = fit(rows, width) if width else None
    if model is None:
        columns = (
            f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double"
        )
        return table.sparkSession.createDataFrame([], columns)
    error = identity_error(rows, width, model, components)
    share = model.values[: min(components, width)] / model.trace if model.trace > 0 else np.zeros(min(components, width))
    explained = F.array(*[F.lit(float(s)) for s in share])
    each = project(rows, width, model, components).select(
        F.col("_id").alias(id_col), "deviation", F.posexplode("whitened").alias("_at", "whitened")
    )
    return each.select(
        F.col(f"`{id_col}`"), (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(explained, F.col("_at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
