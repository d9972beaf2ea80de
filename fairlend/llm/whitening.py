"""Operator 13: whitening of embeddings along exactly determined principal components.

Entries become whole numbers, so that counts, sums and products of the fit list
are exact: each task adds up the products of its rows, Spark adds the tasks'
sums, and the integer scatter matrix ``n * sum(x x') - S S'`` (n^2 times the
covariance) is width x width numbers.  Its characteristic polynomial is found
modulo as many 31-bit primes as its coefficients need, a task per few primes,
and put together by Chinese remaindering, a group per coefficient.  Each
component's eigenvalue is isolated by exact counts of real roots and its
vector found by inverse iteration in long decimals, a task per component.
Rows are then projected in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fairlend.llm import charpoly
from fairlend.llm.tables import stored
from fairlend.llm.text import in_batches

#: Entries are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries from here on have no whole number that a double tells from the next.
LIMIT = float(1 << 53) / SCALE
#: Bits of a limb of an entry, and rows multiplied at once: a limb's products, added up, fit a double's 53 bits.
LIMB, ROWS = 20, 4096
#: Primes that a task takes.
PRIMES = 8


def usable(vector: str) -> Column:
    """Whether all entries are numbers below ``LIMIT`` in size (null, NaN and infinities are not)."""
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False))),
                                      F.lit(False))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of ``d`` entries as whole numbers without the offset."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d)


def products(x: np.ndarray) -> np.ndarray:
    """x'x, exact, as Python integers."""
    limbs, rest = [], x
    while True:
        small = np.abs(rest).max(initial=0) < 1 << LIMB
        limbs.append((rest if small else rest & ((1 << LIMB) - 1)).astype(np.float64))
        if small:
            break
        rest = rest >> LIMB
    out = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, xx = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = matrix_of(batch.column(0), d)
            for a in range(0, len(x), ROWS):
                part = x[a:a + ROWS]
                n, s, xx = n + len(part), s + part.astype(object).sum(axis=0), xx + products(part)
        if not n:
            return
        i, j = np.triu_indices(d)
        yield pa.record_batch({
            "i": pa.array(np.concatenate([[-2], np.full(d, -1), i]), pa.int32()),
            "j": pa.array(np.concatenate([[0], np.arange(d), j]), pa.int32()),
            "value": pa.array([Decimal(n), *map(Decimal, s), *map(Decimal, xx[i, j])], pa.decimal128(38, 0))})
    return run


@dataclass
class Scatter:
    """The fit list's number of rows, sums without the offset, and integer scatter matrix (n^2 times the covariance)."""
    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(self.matrix[k][k] for k in range(len(self.matrix)))


def scatter(vectors: DataFrame, d: int) -> Scatter:
    """Sums over the one column of ``vectors``; (d + 1)(d + 2) / 2 numbers reach the driver, whatever the rows."""
    parts = in_batches(vectors, _sums(d), "i int, j int, value decimal(38,0)")
    n, sums, xx = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if i == -2:
            n = int(value)
        elif i == -1:
            sums[j] = int(value)
        else:
            xx[i][j] = xx[j][i] = int(value)
    return Scatter(n, sums, [[n * xx[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)])


def _residues(matrix: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                m = np.array([[x % p for x in row] for row in matrix], np.int64)
                c = charpoly.charpoly_mod(m, p)
                yield pa.record_batch({"k": pa.array(np.arange(len(c)), pa.int32()),
                                       "p": pa.array(np.full(len(c), p), pa.int64()), "r": pa.array(c, pa.int64())})
    return run


def _coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.record_batch({"k": pa.array([r["k"] for r in rows], pa.int32()), "value": pa.array(
            [str(charpoly.remaindered([x["p"] for x in r["held"]], [x["r"] for x in r["held"]])) for r in rows],
            pa.string())})


def polynomial(spark, fit: Scatter) -> list[int]:
    """The scatter matrix's characteristic polynomial, lowest coefficient first."""
    d = len(fit.matrix)
    primes = charpoly.primes_for(charpoly.coefficient_bits(fit.trace, d))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES))
    residues = rows.mapInArrow(_residues(fit.matrix), "k int, p long, r long")
    held = residues.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "r"))).alias("held"))
    found = held.mapInArrow(_coefficients, "k int, value string").collect()
    return [int(value) for _, value in sorted(found)]


def _components(fit: Scatter, poly: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine, top = charpoly.scaled(poly, charpoly.PLACES), fit.trace << charpoly.PLACES
        for batch in batches:
            for k in batch.column(0).to_pylist():
                high, first, many = charpoly.isolate(fine, k, top)
                if high <= 1:  # no variance left
                    continue
                vectors = charpoly.null_space(fit.matrix, high, charpoly.PLACES, many)
                yield pa.record_batch({"k": pa.array([k], pa.int32()), "root": pa.array([str(high)], pa.string()),
                                       "vector": pa.array([vectors[k - first]], pa.list_(pa.float64()))})
    return run


@dataclass
class Component:
    """A unit vector, its eigenvalue's part of the covariance's trace, and its standard deviation."""
    vector: list[float]
    explained: float
    deviation: float


def components(spark, fit: Scatter, most: int) -> list[Component]:
    """The covariance's first ``most`` components by falling eigenvalue, those with one above 0 only.

    Equal eigenvalues share an orthonormal basis of their space; the largest
    entry of a vector is positive.
    """
    if fit.n == 0 or fit.trace == 0:
        return []
    poly, d = polynomial(spark, fit), len(fit.matrix)
    wanted = min(most, d)
    rows = spark.range(wanted).select(F.col("id").cast("int").alias("k")).repartition(wanted, "k")
    found = sorted(rows.mapInArrow(_components(fit, poly), "k int, root string, vector array<double>").collect())
    out = []
    for _, root, vector in found:
        value = Fraction(int(root), 1 << charpoly.PLACES)  # n^2 times the covariance's
        with localcontext() as ctx:
            ctx.prec = 60
            root = (Decimal(value.numerator) / Decimal(value.denominator)).sqrt() / fit.n
        out.append(Component(list(vector), float(value / fit.trace), float(root)))
    return out


def _projected(fit: Scatter, found: list[Component], d: int, keys: int):
    weights = np.array([c.vector for c in found]).reshape(-1, d).T / (np.array([c.deviation for c in found]) * fit.n)
    sums = np.array(fit.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = matrix_of(part.column(keys), d).astype(object) * fit.n - sums
                white = y.astype(np.float64) @ weights
                yield pa.record_batch([
                    *part.columns[:keys], pa.array(map(Decimal, (y * y).sum(axis=1)), pa.decimal128(38, 0)),
                    pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), len(found)).cast(pa.list_(pa.float64()))
                    if len(part) else pa.array([], pa.list_(pa.float64()))],
                    names=[*batch.schema.names[:keys], "deviation", "whitened"])
    return run


def width_of(vectors: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the larger of several; 0 without vectors."""
    best = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return best.d if best else 0


@dataclass
class Whitened:
    """``rows``: keys, deviation, whitened (an array by component); the components; and the fit list's statistics."""
    rows: DataFrame
    components: list[Component]
    fit: Scatter


def whiten(rows: DataFrame, keys: list[str], vector: str, most: int = 8) -> Whitened:
    """Rows of usable vectors, whitened along the first ``most`` components of all of them.

    Left out are vectors that are null, hold a null, NaN, infinity or an entry
    of 2^43 or more in size, or have another length than most.  ``deviation``
    is the exact sum of ``(n * x - S) ** 2``.  Equal rows stay as often as they
    are there.
    """
    kept = rows.select(*keys, F.col(vector).cast("array<double>").alias("_vector")).where(usable("_vector"))
    d = width_of(kept, "_vector")
    kept = kept.where(F.size("_vector") == d)
    fit = scatter(kept.select("_vector"), d) if d else Scatter(0, [], [])
    found = components(rows.sparkSession, fit, most) if d else []
    types = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, deviation decimal(38,0), whitened array<double>"
    if not found:
        return Whitened(rows.sparkSession.createDataFrame([], schema), [], fit)
    return Whitened(in_batches(kept, _projected(fit, found, d, len(keys)), schema), found, fit)


def identity_error(white: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred first) of ``whitened`` minus the identity."""
    w = [F.col("whitened")[k] for k in range(count)]
    means = white.agg(*(F.avg(x).alias(f"m{k}") for k, x in enumerate(w))).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    cov = white.agg(*(F.avg((w[i] - means[i]) * (w[j] - means[j])) for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whitening_report(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    ``vectors``: (vec_id, vector); other columns are ignored.  Every vector that
    :func:`whiten` keeps has as many rows as there are components with a
    variance, ``most`` at most; where no vector is left, or all are equal, there
    are no rows.  Null and repeated ids stay.  ``deviation`` is exact; one that
    no long holds fails the query rather than wrap.
    """
    out = whiten(vectors, ["vec_id"], "vector", most)
    names = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if not out.components:
        empty = out.rows.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
                                F.col("deviation").cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
                                F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
        return empty.select(*names)
    rows = stored(out.rows, "whitened")
    error = identity_error(rows, len(out.components))
    explained = F.array(*(F.lit(c.explained) for c in out.components))
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(out.fit.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
