"""PCA whitening of embeddings: MLlib's computeSVD on centred distributed rows, total variance from exact deviations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Singular values below this share of the largest are noise of double precision: such components cannot be scaled to 1.
LEAST_SHARE = 1e-5

_SUMS = pa.schema([("n", pa.int64()), ("place", pa.int64()), ("total", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length, without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, and by place the exact sum, the least and the largest entry: one set of rows a task."""
    n, totals = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            part = np.stack([x.sum(axis=0), x.min(axis=0), x.max(axis=0)])
            totals = part if totals is None else np.stack([totals[0] + part[0], np.minimum(totals[1], part[1]), np.maximum(totals[2], part[2])])
            n += batch.num_rows
    if n:
        d = totals.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, n)), pa.array(np.arange(d)), *map(pa.array, totals)], schema=_SUMS)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, fits: bool) -> tuple[np.ndarray, list[int]]:
    """Rows less their mean, and the exact sum of (n * x - S)^2 of each row. ``fits``: all of it does in 64 bits."""
    d = n * x - sums if fits else n * x.astype(object) - sums.astype(object)
    return (d.astype(float) / n), (d * d).sum(axis=1).tolist()


_WHITE = "vec_id long, deviation decimal(38,0), whitened array<double>"


def _projector(n: int, sums: np.ndarray, fits: bool, axes: np.ndarray, scale: np.ndarray):
    """Each row's exact deviation and its projections on the axes, scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred, exact = _deviations(_matrix(batch.column(1)), n, sums, fits)
            y = np.ascontiguousarray(centred @ axes / scale)
            cuts = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            deviation = pa.array(exact, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(cuts, pa.array(y.ravel()))], names=["vec_id", "deviation", "whitened"])

    return run


def _centred_products(centre: np.ndarray):
    """Sums of products of rows less ``centre``: (i, j, s), one set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0)) - centre
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that can be used: all entries there, finite and so that x fits in a long, and as many of them as most rows have."""
    c = F.col(vector_col)
    fine = F.forall(c, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < 2.0**52))
    usable = vectors.where(c.isNotNull() & (F.size(c) > 0) & F.coalesce(fine, F.lit(False)))
    sizes = usable.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE) + SHIFT)
    return usable.where(F.size(c) == (sizes["d"] if sizes else -1)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every vector that can be used.

    Entries become x = floor(1024 * entry) + 100000, whole numbers, so counts and sums are exact. The vectors are
    fitted to all of themselves:

    1. n and the sums S of each place: a few rows a task.
    2. The rows (n * x - S) / n are a RowMatrix of the JVM; ``computeSVD`` sums their products by a tree over the
       executors and splits the d x d result on the driver. All d singular values are asked for, which MLlib answers by
       LAPACK to double precision; eigenvalues of the covariance, divisor n, are their squares over n.
    3. Each row's ``deviation``, sum of (n * x - S)^2, is exact (in more than 64 bits where it must). Their sum over
       n^3 is the covariance's trace, of which ``explained`` has the eigenvalues' shares. ``whitened`` has the row less
       its mean along each axis over the eigenvalue's root.
    4. ``identity_error`` is the largest absolute entry of the whitened rows' covariance less the identity: the mean is
       taken first, then products of rows less it.

    Axes come by falling eigenvalue, at most ``components`` of them, either sign. An axis whose singular value is below
    1e-5 of the largest is left out, as is every axis where all vectors are equal: nothing can be scaled to 1 there, and
    ``whitened`` and ``explained`` are as short. The driver holds d x d numbers for vectors of d entries; no task holds
    more than a batch and that.

    Vectors that are null, empty or hold null or non-finite entries (or such of 2^52 or more) are dropped, as are those
    of another length than most (where that ties, the longest stay). Repeated rows count each. Null ids are carried.
    Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "white")
    rows = whole_vectors(vectors, id_col, vector_col)
    sums = rows.select("x").mapInArrow(_summed, "n long, place long, total long, least long, most long")
    sums = sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    fit = sums.orderBy("place").collect()
    n, d = (fit[0]["n"], len(fit)) if fit else (0, 0)
    total = [int(r["total"]) for r in fit]
    widest = max((max(abs(n * r["least"] - s), abs(n * r["most"] - s)) for r, s in zip(fit, total, strict=True)), default=0)
    fits = max([n * max(abs(r["least"]), abs(r["most"])) for r in fit], default=0) < 2**62 and d * widest**2 < 2**62
    s = np.array(total, np.int64 if fits else object)

    axes, values = np.empty((d, 0)), np.empty(0)
    if widest:
        mean = F.array(*[F.lit(float(t)) for t in total]) if fits and max(map(abs, total)) < 2**53 else None
        centred = F.zip_with("x", mean, lambda a, t: (a * F.lit(n) - t) / n) if mean is not None else F.zip_with("x", F.array(*[F.lit(t).cast("decimal(38,0)") for t in map(str, total)]), lambda a, t: ((a.cast("decimal(38,0)") * n - t) / n).cast("double"))
        matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row"))
        svd = matrix.computeSVD(d, computeU=False, rCond=LEAST_SHARE)
        values = svd.s.toArray()[:components] ** 2 / n
        axes = svd.V.toArray()[:, : len(values)]
    white = ws.stage(rows.mapInArrow(_projector(n, s, fits, axes, np.sqrt(values)), _WHITE), "white")
    k = len(values)
    known = white.agg(F.sum("deviation").alias("d"), *[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first() if n else None
    trace = float(int(known["d"])) / n**3 if n else 0.0
    error = None
    if k:
        products = white.select("whitened").mapInArrow(_centred_products(np.array([known[f"m{i}"] for i in range(k)])), "i long, j long, s double")
        off = F.abs(F.col("s") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
        error = products.groupBy("i", "j").agg(F.sum("s").alias("s")).agg(F.max(off)).first()[0]
    explained = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
