"""Whitening of embeddings: exact covariances from variances of dimensions and of sums of two dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import fresh

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 512
LIMB = 26
LIMB_BOUND = 1 << 50  # larger centred values are squared as Python integers
LEAST_SHARE = 1e-12
LONG_MAX = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Rows whose vector is there, not empty, and has finite entries only."""
    v = F.col(f"`{vector}`").cast("array<double>")
    wrong = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~wrong, F.lit(False))


def whole_entries(vector: str) -> Column:
    """floor(64 c) + 1000000 of each entry; beyond the range of a long, its nearest end."""
    bound = float(2**62)
    return F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c * SCALE))) + F.lit(SHIFT))


class Centre:
    """Row count n and sums S of each dimension; gives n x - S exactly."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        self.base = [s // n for s in sums]
        self.rest = [s - n * b for s, b in zip(sums, self.base)]  # n x - S = n (x - base) - rest
        widest = max(max(n * (h - b), n * (b - v)) + n for b, v, h in zip(self.base, low, high))
        self.small = 2 * widest < LIMB_BOUND  # a sum of two dimensions too

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S of a (rows x dimensions) matrix: longs where all such values are small, else Python integers."""
        if self.small:
            return self.n * (x - np.array(self.base, np.int64)) - np.array(self.rest, np.int64)
        x = x.astype(object)
        return self.n * (x - np.array(self.base, object)) - np.array(self.rest, object)


def square_sums(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns. Values are cut at LIMB bits, so that sums over BLOCK rows fit a long."""
    if d.dtype == object:
        return [int(s) for s in (d * d).sum(axis=0)]
    low, high = d & ((1 << LIMB) - 1), d >> LIMB
    parts = [np.einsum("ij,ij->j", a, b) for a, b in ((high, high), (high, low), (low, low))]
    return [(int(hh) << 2 * LIMB) + (int(hl) << LIMB + 1) + int(ll) for hh, hl, ll in zip(*parts)]


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The vectors of one-column batches as matrices of at most BLOCK rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.column(0).slice(start, BLOCK)
            yield piece.flatten().to_numpy().reshape(len(piece), width)


# Sums are sent as decimal digits in three limbs of 60 bits, so that Spark adds them without loss.
_PART = 60
LIMBS = [f"l{i}" for i in range(3)]


def _limbs(total: int) -> list[int]:
    """``total`` as low, middle and high part; the high one has the sign and no bound but that of a long."""
    return [total & ((1 << _PART) - 1), (total >> _PART) & ((1 << _PART) - 1), total >> 2 * _PART]


def pair_square_sums(x: DataFrame, centre: Centre) -> dict[tuple[int, int], int]:
    """Over all rows, the exact sum of squares of each centred dimension (a, a) and of each sum of two (a, b)."""
    width, sent = len(centre.sums), x.sparkSession.sparkContext.broadcast(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for block in matrices(batches, width):
            d = sent.value.deviations(block)
            for a in range(width):
                both = d[:, a:] + d[:, a : a + 1]
                both[:, 0] = d[:, a]
                new = square_sums(both)
                totals[a] = [s + t for s, t in zip(totals[a], new)] if a in totals else new
        for a, sums in totals.items():
            parts = list(zip(*[_limbs(s) for s in sums]))
            columns = [pa.array([a] * len(sums), pa.int32()), pa.array(range(a, width), pa.int32()), *[pa.array(p, pa.int64()) for p in parts]]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *LIMBS])

    made = x.mapInArrow(add, "a int, b int, " + ", ".join(f"{c} bigint" for c in LIMBS))
    sums = made.groupBy("a", "b").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in LIMBS])
    # One row for each pair of dimensions, however many vectors there are.
    return {(r["a"], r["b"]): sum(int(r[c]) << _PART * i for i, c in enumerate(LIMBS)) for r in sums.collect()}


def covariance(n: int, squares: dict[tuple[int, int], int], width: int) -> np.ndarray:
    """Covariances by polarisation, 2 cov(a, b) = var(a + b) - var(a) - var(b), each rounded once."""
    out = np.empty((width, width))
    for (a, b), s in squares.items():
        cross = s if a == b else Fraction(s - squares[a, a] - squares[b, b], 2)
        out[a, b] = out[b, a] = float(Fraction(cross) / n**3)
    return out


class Whitening:
    """Unit eigenvectors by falling eigenvalue, scaled by 1/sqrt; the largest entry of each is positive."""

    def __init__(self, centre: Centre, v: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        kept = values > max(float(np.trace(v)), 0.0) * LEAST_SHARE
        self.values, self.vectors = values[kept], vectors[:, kept]
        self.vectors *= np.sign(self.vectors[np.abs(self.vectors).argmax(axis=0), np.arange(self.vectors.shape[1])])
        self.trace = float(np.trace(v))
        self.centre = centre

    def project(self, d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) / self.centre.n) @ self.vectors / np.sqrt(self.values)


def identity_error(x: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows.

    Each block is centred on its own mean before multiplying; a task joins its blocks, and one row per task
    is joined here by count and mean.
    """
    width, sent = len(whitening.centre.sums), x.sparkSession.sparkContext.broadcast(whitening)
    size = len(whitening.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in matrices(batches, width):
            z = sent.value.project(sent.value.centre.deviations(block))
            mean = z.mean(axis=0)
            own = (len(z), mean, (z - mean).T @ (z - mean))
            total = own if total is None else joined(total, own)
        if total is not None:
            n, mean, products = total
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([products.tobytes()])], names=["n", "mean", "products"])

    def joined(one, two):
        (n, mean, products), (m, other, more) = one, two
        gap = other - mean
        return n + m, mean + gap * (m / (n + m)), products + more + np.outer(gap, gap) * (n * m / (n + m))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, mean, products in zip(*[c.to_pylist() for c in batch.columns]):
                own = (n, np.frombuffer(mean), np.frombuffer(products).reshape(size, size))
                total = own if total is None else joined(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tobytes()]), pa.array([total[2].tobytes()])], names=["n", "mean", "products"])

    schema = "n bigint, mean binary, products binary"
    # A few KB from each task; one last task joins them.
    n, _, products = x.mapInArrow(moments, schema).repartition(1).mapInArrow(merge, schema).first()
    return float(np.abs(np.frombuffer(products).reshape(size, size) / n - np.eye(size)).max())


RESULT = "struct<n:bigint,deviation:decimal(38,0),values:array<double>,explained:array<double>,identity_error:double>"


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The usable rows of ``vectors`` with a struct column ``whitened``: n, deviation, values, explained, identity_error.

    Entries become whole numbers x = floor(64 c) + 1000000. Over all usable rows: counts and sums of each
    dimension; then the exact sum of squares of n x - S for each dimension and for each sum of two
    dimensions, from which differences of variances give every cross-covariance (polarisation). Sums are
    integers throughout, so neither order nor partitioning changes a bit of them. The matrix (dimensions
    squared) is decomposed on the driver. ``values`` are the first ``components`` whitened coordinates,
    ``explained`` the shares of the trace, ``deviation`` the exact squared length of n x - S (null where 38 digits do not
    hold it), ``identity_error`` one measured value for all rows.

    Rows whose vector is null or empty, or holds a null or non-finite entry, go. Where lengths differ, the most common
    length stays (of equally common ones the longest) and other rows go. Components with an eigenvalue
    below 10^-12 of the trace are not given: one row, or equal rows only, have no components, and
    ``identity_error`` is then null. Repeated rows count as often as they occur. Entries so large that x leaves the range of a long
    are held at its ends. Empty tables give no rows. A column called ``whitened`` stays; the new one is then ``whitened_1``.
    """
    out = fresh(vectors, "whitened")
    good = vectors.where(usable(vector))
    x = good.select(whole_entries(vector).alias("x"))
    lengths = x.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    none = F.lit(None).cast(RESULT)
    if lengths is None:
        return good.withColumn(out, none)
    width, n = lengths["w"], lengths["count"]
    x = x.where(F.size("x") == width)
    bounds = x.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    rows = sorted(bounds.collect(), key=lambda r: r["dim"])  # one row for each dimension
    centre = Centre(n, *[[int(r[c]) for r in rows] for c in ("s", "low", "high")])
    whitening = Whitening(centre, covariance(n, pair_square_sums(x, centre), width), components)
    error = identity_error(x, whitening) if len(whitening.values) else None
    sent = vectors.sparkSession.sparkContext.broadcast(whitening)
    pair = pa.struct([("deviation", pa.decimal128(38, 0)), ("values", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<deviation:decimal(38,0),values:array<double>>")
    def project(column: pa.Array) -> pa.Array:
        lengths, coordinates = [], []
        for start in range(0, len(column), BLOCK):
            piece = column.slice(start, BLOCK)
            d = sent.value.centre.deviations(piece.flatten().to_numpy().reshape(len(piece), width))
            lengths += square_sums(np.ascontiguousarray(d.T))
            coordinates.append(sent.value.project(d))
        z = np.concatenate(coordinates) if coordinates else np.empty((0, 0))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
        digits = pa.array([s if s < 10**38 else None for s in lengths], pa.decimal128(38, 0))
        return pa.StructArray.from_arrays([digits, values], fields=list(pair))

    made = good.where(F.size(F.col(f"`{vector}`")) == width).withColumn(out, project.asNondeterministic()(whole_entries(vector)))
    got = F.col(f"`{out}`")
    shares = F.array(*[F.lit(float(e / whitening.trace)) for e in whitening.values]).cast("array<double>")
    result = F.struct(
        F.lit(n).cast("bigint").alias("n"), got["deviation"].alias("deviation"), got["values"].alias("values"),
        shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
    return made.withColumn(out, result)
