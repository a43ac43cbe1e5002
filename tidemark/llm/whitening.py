"""Embedding whitening from an exact covariance: integer scatter, its characteristic polynomial
by modular Hessenberg forms and remainders, isolated real roots, null spaces by inverse iteration."""

from __future__ import annotations

from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charpoly import GUARD_BITS, bound_bits, charpoly_mod, eigenvectors, primes, remaindered, top_roots
from .kernels import tidy
from .shared import drop_tables, write_table

#: Scaled entries beyond this are set to it; keeps sums of squares within 38 digits.
LARGEST = 1 << 50
#: Vectors that a Python worker handles at a time.
VECTOR_ROWS = 4_000
_EXACT = Context(prec=60)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + offset of vectors without null or non-finite entries."""
    c, whole = F.col(vector_col), F.lit(float(LARGEST))
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform(c, lambda e: F.greatest(F.least(F.floor(e.cast("double") * scale), whole), -whole).cast("long") + offset)
    return vectors.where(c.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int, offset: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - offset


def _products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows in exact integers: doubles where no sum leaves their 53 bits."""
    top = int(np.abs(rows).max(initial=0))
    if top * top * max(len(rows), 1) < 1 << 53:
        real = rows.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    if len(rows) > 1 and top < 1 << 26:
        half = len(rows) // 2
        return _products(rows[:half]) + _products(rows[half:])
    exact = rows.astype(object)
    return exact.T @ exact


def scatter(fit: DataFrame, d: int, offset: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums of x, and n * sum(x x') - sums sums' of the distinct vectors: exact integers,
    added up in tasks and then by entry; the d * d entries go to the driver."""

    def partial(batches):
        n, sums, total = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            rows = _matrix(batch.column(0), d, offset)
            n += len(rows)
            sums += rows.astype(object).sum(0)
            total += _products(rows)
        if n:
            upper = np.triu_indices(d)
            values = [n, *sums, *total[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["at", "value"])

    added = fit.mapInArrow(tidy(partial), "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    values = [int(r.value) for r in added.orderBy("at").collect()]
    if not values:
        return 0, [0] * d, np.zeros((d, d), object)
    n, about = values[0], values[1 : d + 1]
    full = np.zeros((d, d), object)
    full[np.triu_indices(d)] = values[d + 1 :]
    full = full + np.triu(full, 1).T
    centred = n * full - np.outer(np.array(about, object), np.array(about, object))
    return n, [s + n * offset for s in about], centred


def spectrum(spark, matrix: np.ndarray, count: int) -> list[tuple[int, np.ndarray]]:
    """The largest positive eigenvalues of an integer scatter matrix, times 2**GUARD_BITS, each
    with a unit eigenvector: in falling order, ``count`` at most.

    Primes, and then roots, are dealt to tasks; the driver holds one polynomial.
    """
    d = len(matrix)
    divisor = int(np.gcd.reduce(matrix.reshape(-1))) if d else 0
    if not divisor:
        return []
    matrix = matrix // divisor
    chosen = primes(bound_bits(matrix))

    def polynomials(batches):
        for batch in batches:
            found = [charpoly_mod(matrix, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "coefficients"])

    tasks = max(1, min(len(chosen), spark.sparkContext.defaultParallelism))
    deal = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks)
    poly = remaindered([(r.p, list(r.coefficients)) for r in deal.mapInArrow(polynomials, "p long, coefficients array<long>").collect()])
    roots = list(top_roots(poly, count, GUARD_BITS))

    def vectors(batches):
        for batch in batches:
            for number, root, times in zip(*(c.to_pylist() for c in batch.columns)):
                found = eigenvectors(matrix, int(root), times, GUARD_BITS)
                rows = [(number, i, v.tolist()) for i, v in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["number", "i", "v"])

    rows = [(i, str(root), times) for i, (root, times) in enumerate(roots)]
    deal = spark.createDataFrame(rows, "number int, root string, times int").repartition(max(1, min(len(rows), tasks)))
    found = deal.mapInArrow(vectors, "number int, i int, v array<double>").collect() if rows else []
    return [(roots[r.number][0] * divisor, np.array(r.v)) for r in sorted(found, key=lambda r: (r.number, r.i))][:count]


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, eigenvalue.

    Entries are floor(scale * entry) + offset; the fit list is each distinct vector once, so
    copies weigh nothing, however many. n is its length and deviation the exact sum over the
    dimensions of (n * x - sum)**2 as decimal(38,0), null where that is too small. Components are
    unit eigenvectors of the fit list's covariance (divisor n), numbered from 1 by falling
    eigenvalue, the entry of largest size positive; equal eigenvalues give an orthonormal basis of
    their space, the same one for all rows. explained is the eigenvalue's share of the trace,
    identity_error the largest entry of the measured covariance of whitened over the fit list
    minus the identity.

    Vectors that are null or hold a null, NaN or infinite entry have no rows; nor have those of
    another length than most have (ties: the longer). A direction without variance is no
    component: with one distinct vector, or none, the result is empty. Scaled entries beyond
    2**50 count as that. Repeated rows and null ids are kept; other columns are not read.
    """
    spark = vectors.sparkSession
    x = quantised(vectors, id_col, vector_col, scale, offset)
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    x = x.where(F.size("x") == d)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, eigenvalue double"
    if not d:
        return spark.createDataFrame([], schema)
    fit = write_table(x.select("x").distinct(), "fit", VECTOR_ROWS)
    n, sums, centred = scatter(fit, d, offset)
    found = spectrum(spark, centred, components)
    if not found:
        drop_tables(fit)
        return spark.createDataFrame([], schema)
    about = [s - n * offset for s in sums]
    # matrix = n * n * covariance, so its eigenvalues are n * n as large
    values = [e / (1 << GUARD_BITS) for e, _ in found]
    basis = np.array([v if v[np.abs(v).argmax()] > 0 else -v for _, v in found])
    project = (basis / np.sqrt(np.array(values))[:, None]).T
    k, trace = len(values), sum(int(centred[i, i]) for i in range(d))
    wide = max(map(abs, about)) + n * LARGEST >= 1 << 62

    def scaled(rows):
        """n * x - sum, exact, and as doubles."""
        if wide and int(np.abs(rows).max(initial=0)) * n + max(map(abs, about)) >= 1 << 62:
            exact = rows.astype(object) * n - np.array(about, object)
            return exact, exact.astype(np.float64)
        exact = rows * n - np.array(about, np.int64)
        return exact, exact.astype(np.float64)

    def moments(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = scaled(_matrix(batch.column(0), d, offset))[1] @ project
            total += w.sum(0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*total, *square.reshape(-1)], pa.float64())], ["at", "value"])

    sums_of = np.array([r.value for r in fit.mapInArrow(tidy(moments), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()])
    mean, second = sums_of[:k] / n, sums_of[k:].reshape(k, k) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    drop_tables(fit)
    share = np.array([v / trace for v in values])
    eigen = np.array([v / (n * n) for v in values])

    def rows_of(batches):
        for batch in batches:
            exact, real = scaled(_matrix(batch.column(1), d, offset))
            w, m = real @ project, len(exact)
            top = int(np.abs(real).max(initial=0)) + 1
            squares = (exact * exact).sum(1) if top * top * d < 1 << 62 else (exact.astype(object) ** 2).sum(1)
            sizes = [_EXACT.create_decimal(int(v)) if int(v) < 10**38 else None for v in squares]
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(sizes, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(w.reshape(-1)), pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)), pa.array(np.tile(eigen, m)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    return x.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(tidy(rows_of), schema)
