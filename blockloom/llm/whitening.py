"""Whitening of vectors whose distinct values are fitted and whitened once, weighted by how often they occur.

Entries become whole numbers, so that equal vectors can be told exactly: c is floor(SCALE * c) + SHIFT. A
vector's numbers are packed into a binary key as narrow as they allow (their shift left out, a byte each for
entries within +-2); rows are counted by key, pre-aggregated before the shuffle, and the table of distinct
vectors with their counts is written. The fit reads that table: exact sums first, then the weighted centred
product of each task's vectors (BLAS), then the eigenvectors of the covariance, the only step of the driver
(d x d numbers). Each distinct vector is whitened once; rows join it by key. Vectors that hold more than a
ten-thousandth of all rows are at most 10,000, so they are broadcast, and no key of the join is hot.

Defined results: rows whose vector is null, empty, or has null or non-finite entries are left out. Where
lengths differ, the length that most rows have counts (of equally frequent ones the greater); other rows are
left out as well. Entries beyond +-2^53 / SCALE are taken as those bounds. Components whose eigenvalue is not
above the rounding error of the largest are left out, so equal vectors only, or a single one, give no rows.
A deviation beyond a 64-bit number is null. Null and repeated ids are rows like others; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A vector is hot if it has this many rows and a 1 / HOT_SHARE of all; there can't be more than HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 1000, 10_000
#: Tasks whose partial sums and products meet at most.
FIT_TASKS = 1024
_WIDTHS = {1: np.dtype("i1"), 2: np.dtype("<i2"), 8: np.dtype("<i8")}
_BOUND = float(1 << 53)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers (without their shift) as a key: a byte for the width, then the numbers."""
    top = max(abs(int(x.min())), abs(int(x.max())))
    width = 1 if top < 128 else 2 if top < 32_768 else 8
    return bytes([width]) + x.astype(_WIDTHS[width]).tobytes()


def unpack(keys: list[bytes]) -> np.ndarray:
    """The whole numbers of keys of one length of vector, a row each."""
    return np.array([np.frombuffer(k, _WIDTHS[k[0]], offset=1) for k in keys], np.int64)


def keyed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, key of the rows whose vectors count."""
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = slim.select("vec_id", F.lit(b"").alias("key")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat, ends = v.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.float64)))]).astype(np.int64)
            c = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
            finite = np.isfinite(c)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(np.clip(np.where(finite, c, 0) * SCALE, -_BOUND, _BOUND)).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~finite)])
            good = np.flatnonzero((np.diff(ends) > 0) & (bad[ends[1:]] == bad[ends[:-1]]))
            keys = [pack(x[ends[k] : ends[k + 1]]) for k in good]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(keys, pa.binary())], names=["vec_id", "key"])

    return slim.mapInArrow(work, schema)


@dataclass
class Fit:
    """What whitening needs: number and sums of the fit list, eigenvectors (columns) and eigenvalues, both cut to the components."""

    n: int
    sums: list[int]  # without the shift
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S) ** 2), exact; None beyond 64 bits."""
        most = max(abs(self.n * int(e) - s) for row in (x.min(0), x.max(0)) for e, s in zip(row, self.sums))
        if len(self.sums) * most**2 < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(e) - s) ** 2 for e, s in zip(row, self.sums)) for row in x]
        return [d if d < 1 << 63 else None for d in exact]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """key, n of keyed rows, written; of vectors of the most frequent length only."""
    counted = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    width = F.ascii(F.substring(F.col("key"), 1, 1).cast("string"))
    counted = counted.withColumn("d", F.expr("octet_length(key) - 1") / width)
    lengths = counted.groupBy("d").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    return counted.where(F.col("d") == (lengths["d"] if lengths else 0)).drop("d")


def _partials(distinct: DataFrame, schema: str, work) -> DataFrame:
    """What each task's vectors give together: work(x, n) for each batch, added up; a row for each entry of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(unpack(batch.column(0).to_pylist()), np.asarray(batch.column(1)))
                total = part if total is None else total + part
        if total is not None:
            at = np.indices(total.shape).reshape(total.ndim, -1)
            values = [Decimal(v) for v in total.tolist()] if total.dtype == object else total.reshape(-1)
            kind = pa.decimal128(38, 0) if total.dtype == object else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[-1], pa.int32()), pa.array(values, kind)], names=["i", "j", "v"])

    few = distinct.coalesce(FIT_TASKS).mapInArrow(run, schema)
    return few.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _matrix(distinct: DataFrame, work, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    for r in _partials(distinct, "i int, j int, v double", work).collect():  # d * d numbers
        out[(r["i"], r["j"])[: len(shape)]] = r["v"]
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS, weights: str = "count") -> Fit | None:
    """Eigenvectors of the covariance of the vectors, each weighted by its count or by one; None without vectors."""
    if weights not in ("count", "one"):
        raise ValueError("weights are count or one")
    if weights == "one":
        distinct = distinct.withColumn("n", F.lit(1).cast("long"))
    sums = _partials(distinct, "i int, j int, v decimal(38,0)", _exact_sums).orderBy("i").collect()
    if not sums:
        return None
    n, sums = int(sums[0]["v"]), [int(r["v"]) for r in sums[1:]]
    d, mean = len(sums), np.array([float(Fraction(s, n)) for s in sums])

    def product(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred * weight[:, None]).T @ centred

    v = _matrix(distinct, product, (d, d)) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = min(components, int((values > values[0] * d * np.finfo(float).eps).sum()) if values[0] > 0 else 0)
    vectors = vectors[:, :held] * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)[:held]
    return Fit(n, sums, vectors, values[:held], float(np.trace(v)))


def _exact_sums(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights' sum, then the weighted sums, in whole numbers of any size."""
    total = int(weight.sum())
    if max(1, int(np.abs(x).max())) * total < 1 << 62:
        return np.array([total, *(x * weight[:, None]).sum(0).tolist()], object)
    return np.array([total, *(x.astype(object) * weight.astype(object)[:, None]).sum(0)], object)


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened vectors' weighted covariance less the identity, centred before multiplying."""
    k = len(model.values)
    mean = _matrix(distinct, lambda x, n: (model.whiten(x) * n[:, None]).sum(0), (k,)) / model.n

    def product(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        y = model.whiten(x) - mean
        return (y * n[:, None]).T @ y

    return float(np.abs(_matrix(distinct, product, (k, k)) / model.n - np.eye(k)).max())


def whitened(distinct: DataFrame, model: Fit) -> DataFrame:
    """key, n, deviation, whitened of each distinct vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column(0).to_pylist())
                y = model.whiten(x)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.deviations(x), pa.int64()), rows], names=["key", "n", "deviation", "whitened"])

    return distinct.select("key", "n").mapInArrow(work, "key binary, n long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Fit | None, float]:
    """vec_id, deviation, whitened (an entry for each component) of each row that counts; the fit; the identity error."""
    rows = keyed(vectors, id_col, vector_col)
    distinct = distinct_vectors(rows)
    model = fit(distinct, components, weights)
    if model is None or not len(model.values):
        empty = rows.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return empty, model, 0.0
    error = identity_error(distinct if weights == "count" else distinct.withColumn("n", F.lit(1).cast("long")), model)
    least = max(HOT_ROWS, int(distinct.agg(F.sum("n")).first()[0]) // HOT_SHARE)
    hot, rest = (whitened(distinct.where(c), model).drop("n") for c in (F.col("n") >= least, F.col("n") < least))
    if distinct.where(F.col("n") >= least).isEmpty():
        return rows.join(rest, "key").drop("key"), model, error
    hot_keys = F.broadcast(distinct.where(F.col("n") >= least).select("key"))
    joined = rows.join(F.broadcast(hot), "key").unionByName(rows.join(hot_keys, "key", "left_anti").join(rest, "key"))
    return joined.drop("key"), model, error


def listed(rows: DataFrame, model: Fit | None, error: float) -> DataFrame:
    """A row for each vector and component, with what the fit says of it."""
    shares = F.array(*[F.lit(e) for e in model.explained]) if model and len(model.values) else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
