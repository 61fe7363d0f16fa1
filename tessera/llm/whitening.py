"""Whitening of embeddings by matrix-free block subspace iteration.

A row counts if its vector is not null and all entries are finite numbers; other
rows are dropped. Entries become whole numbers x = floor(256 * c). The fit list
holds each distinct x-vector once, so copies don't weigh. No covariance matrix is
ever formed: each pass over the fit list computes (X - mean)' ((X - mean) Q) for
a block Q, every task adding up one d x b matrix. The driver keeps d x b numbers:
it makes the block orthonormal by QR, adds it to the subspace of the passes
before (whose images are known, so no pass is repeated) and takes Ritz pairs of
it; their residuals are the next block. It ends when the residuals of all k
components have reached rounding level.

Vectors shorter than the longest are filled up with zeros. No rows, or k larger
than the dimensions, give fewer components; a component without variance has null
``whitened`` and doesn't count in the identity error. A deviation beyond the range
of a long is null. Repeated and null ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import bound_batches, give_back, make_room
from .common import materialize

SCALE = 256
COMPONENTS = 4
BLOCK = 16
#: Columns of the subspace before it is cut down to its best block.
MAX_BASIS = 160
MAX_PASSES = 200


@dataclass(frozen=True)
class Whitener:
    """A fitted whitening: components are columns, by falling variance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.variances]


def quantized(df: DataFrame, vector: str, out: str = "wh_x") -> DataFrame:
    """Valid rows of ``df`` with their vector as whole numbers, all of one length."""
    v = F.col(vector)
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    rows = df.where(v.isNotNull() & F.forall(v, fine))
    width = rows.agg(F.max(F.size(v)), F.min(F.size(v))).first()
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    if width[0] != width[1]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(int(width[0])) - F.size(v)))
    return rows.withColumn(out, x)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length, without a copy of each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(fit: DataFrame, width: int, work) -> np.ndarray:
    """Sum over all rows of ``work(matrix of rows)``, a (rows of result, width) array; tasks sum first, then a shuffle by row."""
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("part", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows and len(batch.column(0).flatten()):
                part = work(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["pos", "part"])
        give_back()

    parts = fit.select("wh_x").mapInArrow(run, schema)
    rows = parts.groupBy("pos").agg(*[F.sum(F.col("part")[j]).alias(f"c{j}") for j in range(width)]).orderBy("pos").collect()
    return np.array([r[1:] for r in rows])


def _exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""
    schema = "pos long, part decimal(38,0), n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 0), np.int64)
            if not x.size:
                continue
            wide = max(abs(int(x.min())), abs(int(x.max()))) >= 2**40
            part = [int(s) for s in (x.astype(object) if wide else x).sum(axis=0)]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if total is not None:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * len(total), pa.int64())], names=["pos", "part", "n"])

    rows = fit.select("wh_x").mapInArrow(run, schema).groupBy("pos").agg(F.sum("part").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``block`` made orthonormal, and to ``basis``; directions that the basis holds already are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit_whitener(fit: DataFrame, k: int = COMPONENTS, block: int = BLOCK, max_basis: int = MAX_BASIS, seed: int = 0) -> Whitener:
    """Components of the distinct vectors ``fit(wh_x)`` by block subspace iteration."""
    n, sums = _exact_sums(fit)
    d = len(sums)
    if not d:
        return Whitener(n, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    mean = np.array([s / n for s in sums])
    k = min(k, d)

    def image(q: np.ndarray) -> np.ndarray:
        def work(x):
            c = x - mean
            return c.T @ (c @ q)

        return _summed(fit, q.shape[1], work) / n

    trace = float(_summed(fit, 1, lambda x: np.array([[((x - mean) ** 2).sum()]]))[0, 0]) / n
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    fresh = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, max(block, 2 * k)))), basis)
    last, passes = np.inf, 0
    while True:
        basis, images, passes = np.hstack([basis, fresh]), np.hstack([images, image(fresh)]), passes + 1
        small = basis.T @ images
        values, ritz = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, ritz = values[order], ritz[:, order]
        vectors, mapped = basis @ ritz, images @ ritz
        rest = mapped - vectors * values
        worst = float(np.linalg.norm(rest[:, :k], axis=0).max()) / max(trace, 1e-300)
        rounding = 4 * d * np.finfo(float).eps
        if trace == 0 or worst <= rounding or basis.shape[1] >= d and worst <= 1e-9 or worst <= 1e-10 and worst > last / 2:
            break
        if passes >= MAX_PASSES:
            raise RuntimeError("residuals did not settle")
        last = worst
        if basis.shape[1] + block > max_basis:  # go on from the best Ritz pairs
            basis, images = vectors[:, : 2 * block], mapped[:, : 2 * block]
        fresh = _orthonormal(rest[:, :block], basis)
        if not fresh.shape[1]:  # the subspace maps into itself without holding all: look beside it
            fresh = _orthonormal(np.random.default_rng(seed + passes).standard_normal((d, min(block, d - basis.shape[1]))), basis)
    vectors, values = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0), np.maximum(values[:k], 0.0)
    live = values > max(trace, 0.0) * 1e-14
    values = np.where(live, values, 0.0)
    error = 0.0
    if live.any():
        w = vectors[:, live] / np.sqrt(values[live])

        def gram(x):
            y = (x - mean) @ w
            return y.T @ y

        error = float(np.abs(_summed(fit, int(live.sum()), gram) / n - np.eye(int(live.sum()))).max())
    return Whitener(n, tuple(sums), vectors, values, trace, error, passes)


def whiten(rows: DataFrame, model: Whitener) -> DataFrame:
    """``rows`` (with wh_x) with wh_whitened, an array over the components (null without variance), and wh_deviation."""
    bound_batches(rows.sparkSession)
    n, sums, mean = model.n, model.sums, model.mean
    live = model.variances > 0
    scaled = np.where(live, model.vectors / np.sqrt(np.where(live, model.variances, 1.0)), np.nan)
    exact = np.array(sums, dtype=object)
    top = max((abs(s) for s in sums), default=0)
    added = [T.StructField("wh_whitened", T.ArrayType(T.DoubleType())), T.StructField("wh_deviation", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *added])

    def deviations(x: np.ndarray) -> list[int | None]:
        if n * max(abs(int(x.min())), abs(int(x.max()))) + top < 2**62:
            gap = n * x - np.array(sums, np.int64)
            if (gap.astype(float) ** 2).sum(axis=1).max() < 2.0**62:
                return (gap**2).sum(axis=1).tolist()
        out = ((n * x.astype(object) - exact) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("wh_x"))) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
            if x.size:
                y = (x - mean) @ scaled
                values = [[None if v != v else v for v in row] for row in y.tolist()]
                far = deviations(x)
            else:
                values, far = [[]] * batch.num_rows, [0] * batch.num_rows
            arrays = [*batch.columns, pa.array(values, pa.list_(pa.float64())), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "wh_whitened", "wh_deviation"])
        give_back()

    return rows.mapInArrow(run, schema)


def whiten_embeddings(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitener]:
    """Valid rows of ``df`` with wh_x, wh_whitened and wh_deviation, and the fitted model; columns of such names are kept as ``<name>_in``."""
    df = make_room(df, ["wh_x", "wh_whitened", "wh_deviation"])
    rows = quantized(df, vector)
    model = fit_whitener(materialize(rows.select("wh_x").distinct(), "whiten-fit"), k)
    return whiten(rows, model), model


def whitening_table(embeddings: DataFrame) -> DataFrame:
    out, model = whiten_embeddings(embeddings.select("vec_id", "embedding"))
    share = F.array(*[F.lit(s).cast("double") for s in model.explained()]) if len(model.variances) else F.array().cast("array<double>")
    out = out.select("vec_id", F.posexplode("wh_whitened").alias("pos", "whitened"), F.col("wh_deviation").alias("deviation"))
    return out.select(
        "vec_id",
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("pos")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
