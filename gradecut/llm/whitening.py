"""Embedding whitening with eigenvectors refined from single to double precision and beyond.

Entries become integers x = floor(64 * c) + 1000000. The fit list holds each distinct x vector once;
it is written to the shared folder, so that a vector that a third of the rows share counts and costs
once. Sums and the centred products of the list are taken by Spark: every task turns its batches
into one width-by-width matrix, and the tasks' matrices are added by row. What reaches the driver is
one such matrix, whose size depends on the vectors' width alone.

The driver's eigenvectors start in float32 and are corrected by Ogita and Aishima's iteration:
with R = I - X'X and S = X'AX the next X is X + XE, where E follows from R, S and the gaps of the
approximate eigenvalues, four matrix products a step, taken in extended precision. Where gaps are
no larger than the error bound (clustered eigenvalues) E says nothing about directions inside the
cluster: there the cluster's own small matrix, shifted by its mean and scaled up, is solved by itself and
the cluster's columns are rotated, before the iteration goes on. Convergence is quadratic.

Rows whose vector is null or holds a null or non-finite entry are dropped. Shorter vectors count as
filled up with zeros, so every vector has the longest one's width. Repeated rows and rows with a null
id each get their results; their vectors are in the fit list once. Directions without variance
(eigenvalue under ``FLAT`` of the largest) have no whitened value and no row: one distinct vector, or
an empty table, gives an empty result. Entries beyond 2 ** 52 and deviations beyond 64 bits raise an
error. Other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, cut_lineage

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
FLAT = 1e-12
PATIENCE = 4
MOST_STEPS = 40


def shifted(embedding: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of every entry as bigint; null if the vector takes no part."""
    sound = F.forall(
        embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    entry = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset)
    return F.when(sound, F.transform(embedding, entry))


def matrix_of(vectors: pa.Array, width: int, fill: int) -> np.ndarray:
    """A column of integer lists as rows of ``width``, shorter ones filled up."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def row_sums(df: DataFrame, batches_to_rows, width: int) -> np.ndarray:
    """Sum of the matrices that ``batches_to_rows`` makes of each task's batches.

    Each task hands on its one matrix by rows; rows of one number meet in one task, which adds
    as many as there were tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = batches_to_rows(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"]
            )

    def add(rows: pa.Table) -> pa.Table:
        parts = rows["part"].combine_chunks()
        total = parts.flatten().to_numpy().reshape(len(parts), -1).sum(axis=0)
        return pa.table({"i": rows["i"][:1], "part": pa.array([total], pa.list_(pa.float64()))})

    kind = "i int, part array<double>"
    found = df.mapInArrow(run, kind).groupBy("i").applyInArrow(add, kind).collect()
    return np.array([r["part"] for r in sorted(found, key=lambda r: r["i"])], np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Fit:
    """The list's size and sums, eigenvalues and unit eigenvectors (columns), and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part subtracted in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, divided by the roots of the eigenvalues."""
        return (self.centre(x) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) ** 2, exact in 64 bits."""
        sums = np.array(self.sums, object)
        if x.size and self.n * max(1, int(np.abs(x).max())) < 2**62 and max(map(abs, self.sums)) < 2**62:
            off = self.n * x - sums.astype(np.int64)
            if int(np.abs(off).max()) ** 2 * x.shape[1] < 2**63:
                return (off * off).sum(axis=1)
        off = self.n * x.astype(object) - sums
        exact = (off * off).sum(axis=1)
        if len(exact) and max(exact) >= 2**63:
            raise OverflowError("a deviation does not fit into 64 bits")
        return exact.astype(np.int64)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of eigenvalues, split where neighbours are further apart than ``gap``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return np.split(order, cuts)


def refine(a: np.ndarray, x: np.ndarray, kind=np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric ``a``, from approximate eigenvectors ``x``.

    The defect is what misses to orthogonality and to a diagonal. Steps go on until it is a rounding
    error or ``PATIENCE`` steps in a row have not lessened it; the least one's vectors are returned.
    """
    a, x = a.astype(kind), x.astype(kind)
    size = len(a)
    eye = np.eye(size, dtype=kind)
    norm = np.sqrt((a * a).sum())
    best, idle = None, 0
    for _ in range(MOST_STEPS):
        if idle == PATIENCE:
            break
        r = eye - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2  # else small gaps make rounding errors of orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        near = np.abs(values[:, None] - values[None, :]) <= bound
        apart = off.copy()
        np.fill_diagonal(apart, 0)
        defect = np.abs(r).max(initial=0) + np.abs(apart).max(initial=0) / (norm or 1)
        idle += 1
        if best is None or defect < best[0]:
            idle = 0 if best is None or defect < best[0] / 2 else idle
            best = (defect, values, x)
        if defect <= 4 * np.finfo(kind).eps:
            break
        gaps = np.where(near, kind(1), values[None, :] - values[:, None])
        e = np.where(near, r / 2, (s + values[None, :] * r) / gaps)
        x = x + x @ e
        for group in clusters(values, bound):
            if 1 < len(group) < size:
                x[:, group] = _rotated(a, x[:, group], values[group].mean(), norm)
    return best[1], best[2]


def _rotated(a: np.ndarray, basis: np.ndarray, centre, norm) -> np.ndarray:
    """The basis of a cluster's space, turned to the eigenvectors inside it.

    The cluster's matrix is shifted by its mean and scaled to its own size, so that gaps far below
    the whole matrix's rounding in single precision are plain ones here.
    """
    kind = a.dtype.type
    small = basis.T @ (a - centre * np.eye(len(a), dtype=kind)) @ basis
    small = (small + small.T) / 2
    scale = np.abs(small).max()
    if scale <= 8 * len(a) * np.finfo(kind).eps * norm:
        return basis  # equal up to rounding: any basis of the space will do
    _, turn = np.linalg.eigh((small / scale).astype(np.float64))
    return basis @ turn.astype(kind)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors: float32 ones refined in extended precision."""
    scale = np.abs(covariance).max(initial=0)
    if not scale > 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    even = covariance / scale
    _, start = np.linalg.eigh(even.astype(np.float32))
    values, vectors = refine(even, start)
    order = np.argsort(-values)
    vectors = vectors[:, order]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    return (values[order] * scale).astype(np.float64), vectors.astype(np.float64)


def fit(each: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The model of the fit list ``each`` (x, all distinct); None where no direction has variance."""
    n, width = each.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not width:
        return None
    fill = OFFSET
    place = each.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("rows")
    )
    by_place = {r["i"]: int(r["s"]) + fill * (n - r["rows"]) for r in place.collect()}
    sums = tuple(by_place[i] for i in range(width))
    blank = Fit(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = blank.centre(matrix_of(batch.column("x"), width, fill))
        return z.T @ z

    covariance = row_sums(each.select("x"), products, width) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance)
    kept = values[:components] > FLAT * values[0] if values[0] > 0 else np.zeros(0, bool)
    if not kept.any():
        return None
    return Fit(n, sums, values[:components][kept], vectors[:, :components][:, kept], float(np.trace(covariance)))


def identity_error(each: DataFrame, model: Fit) -> float:
    """Largest entry of the list's whitened covariance minus the identity, measured over the list."""
    width, many = len(model.sums), len(model.values)

    def totals(batch: pa.RecordBatch) -> np.ndarray:
        return model.whiten(matrix_of(batch.column("x"), width, OFFSET)).sum(axis=0)[None, :]

    mean = row_sums(each.select("x"), totals, many)[0] / model.n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = model.whiten(matrix_of(batch.column("x"), width, OFFSET)) - mean
        return w.T @ w

    covariance = row_sums(each.select("x"), products, many) / model.n
    return float(np.abs(covariance - np.eye(many)).max())


def _project(x: Column, model: Fit) -> Column:
    """Deviation and whitened values of each vector."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            rows = matrix_of(batch, len(model.sums), OFFSET)
            out = model.whiten(rows)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
            return pa.StructArray.from_arrays([pa.array(model.deviations(rows)), whitened], ["deviation", "whitened"])

        return apply

    return arrow_column(make, "deviation bigint, whitened array<double>")(x)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every sound row."""
    rows = embeddings.select("vec_id", shifted(F.col("embedding")).alias("x")).filter(F.col("x").isNotNull())
    each = cut_lineage(rows.select("x").distinct())
    model = fit(each, components)
    kind = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], kind.format(rows.schema["vec_id"].dataType.simpleString()))
    error = identity_error(each, model)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    found = rows.select("vec_id", _project(F.col("x"), model).alias("m"))
    found = found.select("vec_id", "m.deviation", F.posexplode("m.whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
