"""Exact nearest neighbours by dot product, in blocks of queries against batches of rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import store
from .lexical import top_k

BLOCK = 4096
#: Scores of queries times rows that a task holds at a time.
TILE = 1 << 20
#: Blocks that one task of ``neighbours`` reads against each of its own.
PART = 64
NEAR_DUPLICATE = 0.95


def dot(a: Column, b: Column) -> Column:
    """In double precision, for pairs that are rows already."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first ``k`` of each query by falling score, then unit."""
    order = np.lexsort((rows[2], -rows[1], rows[0]))
    at = rows[0][order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    return [x[order][nth < k] for x in rows]


def _tiles(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, vectors) of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            unit = part.column(0).to_numpy()
            yield unit, part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(unit), -1)


def similar_pairs(top: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """(query_id, unit_a, unit_b, cosine) of pairs in one query's short list (query_id, rank, unit_id, embedding) that are as similar as ``threshold``."""
    a, b = (top.select("query_id", F.col("unit_id").alias(f"unit_{n}"), F.col("rank").alias(f"_r{n}"), F.col("embedding").alias(f"_e{n}")) for n in "ab")
    pairs = a.join(b, "query_id").where("_ra < _rb").withColumn("cosine", dot(F.col("_ea"), F.col("_eb")))
    return pairs.where(F.col("cosine") >= threshold).select("query_id", "unit_a", "unit_b", "cosine")


def nearest(spark: SparkSession, queries: DataFrame, rows: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    """(query_id, unit_id, score, rank) for queries (query_id, embedding) and rows (unit_id, embedding).

    Queries are read block by block (a block is bounded), and a task scores ``TILE`` pairs
    at a time; it keeps k rows per query, so what is shuffled is k times queries times tasks at most.
    """
    blocks = queries.count() // BLOCK + 1
    out = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toArrow()
        ids = part.column(0).to_numpy()
        if not len(ids):
            continue
        matrix = np.array(part.column(1).to_pylist(), np.float64)
        held = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, held=held):
            q, m = held.value
            best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query's place, score, unit
            least = np.full(len(q), -np.inf)  # what a row has to reach to be among a query's best
            for unit, vectors in _tiles(batches, max(TILE // len(q), 1)):
                scores = np.round(m @ vectors.T, 9)
                floor = np.maximum(least, np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]) if len(unit) > k + 1 else least
                at, col = np.nonzero(scores >= floor[:, None])
                if len(at):
                    best = _best([np.r_[best[0], at], np.r_[best[1], scores[at, col]], np.r_[best[2], unit[col]]], k + 1)
                    last = np.cumsum(np.bincount(best[0], minlength=len(q)))
                    full = np.diff(last, prepend=0) > k
                    least[full] = best[1][last[full] - 1]
            keep = np.ones(len(best[0]), bool) if include_self else best[2] != q[best[0]]
            yield pa.RecordBatch.from_arrays([pa.array(q[best[0][keep]]), pa.array(best[2][keep]), pa.array(best[1][keep])], names=["query_id", "unit_id", "score"])

        found = rows.select("unit_id", "embedding").mapInArrow(run, "query_id long, unit_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, unit_id long, score double")
    return top_k(out, k)


def _packed(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Rows (unit_id, embedding) as blocks (units, vectors) of at most ``BLOCK`` rows; a null vector becomes one of NaN."""
    units, vectors, held = [], [], 0

    def block() -> pa.RecordBatch:
        lengths = {len(v) for v in vectors if v is not None}
        if len(lengths) > 1:
            raise ValueError("vectors differ in length")
        blank = np.full(max(lengths, default=0), np.nan, kind)
        matrix = np.array([blank if v is None else v for v in vectors], kind)
        return pa.RecordBatch.from_arrays([pa.array([np.array(units, np.int64).tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["units", "vectors"])

    for batch in batches:
        for unit, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            units.append(unit)
            vectors.append(vector.values.to_numpy(zero_copy_only=False) if vector.is_valid else None)
            held += 1
            if held == BLOCK:
                yield block()
                units, vectors, held = [], [], 0
    if held:
        yield block()


class _Nearest:
    """The ``k`` best rows of each query of a block among the blocks that it is shown, itself left out, by score at nine decimals, then unit.

    Pairs are scored in single precision first; what may reach a query's best is scored again in double
    precision, or all of a tile where that is much. A missing score (of a null vector) comes last.
    """

    def __init__(self, units: np.ndarray, vectors: np.ndarray, k: int):
        self.units, self.wide, self.k = units, vectors.astype(np.float64), k
        self.narrow = vectors.astype(np.float32)
        self.norm = np.sqrt((self.wide**2).sum(1))
        self.best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]  # query's place, rounded score, unit, score
        self.found, self.waiting = [], 0  # what is still to be merged into these
        self.least = np.full(len(units), -np.inf)  # the last of a query's best, once there are k
        self.last = np.full(len(units), np.iinfo(np.int64).max)
        self.width = 64  # few at first, as all of them are kept

    def show(self, units: np.ndarray, vectors: np.ndarray) -> None:
        if not vectors.shape[1]:  # null vectors only
            vectors = np.full((len(units), self.wide.shape[1]), np.nan)
        elif not self.wide.shape[1]:
            self.wide = self.narrow = np.full((len(self.units), vectors.shape[1]), np.nan)
            self.norm = self.wide[:, 0]
        at, most = 0, max(2 * TILE // len(self.units), 64)
        while at < len(units):
            self._tile(units[at : at + self.width], vectors[at : at + self.width])
            at, self.width = at + self.width, min(self.width * 4, most)

    def _tile(self, units: np.ndarray, vectors: np.ndarray) -> None:
        wide = vectors.astype(np.float64)
        bound = self.norm * np.sqrt((wide**2).sum(1)).max(initial=0)
        few = None
        if np.isfinite(self.least).all() and bound.max(initial=0) < 1e30:  # not so with NaN
            margin = (wide.shape[1] + 8) * 2.0**-23 * bound + 1e-8
            few = self._reaching(vectors.astype(np.float32), np.nextafter((self.least - margin).astype(np.float32), np.float32(-np.inf)))
        if few is not None and len(few) * 16 <= len(self.units) * len(units):
            at, col = np.divmod(few, len(units))
            score = np.einsum("ij,ij->i", self.wide[at], wide[col])
        else:
            scores = self.wide @ wide.T
            scores[np.isnan(scores)] = -np.inf
            shared = np.flatnonzero(np.isin(self.units, units))
            rounded = np.round(scores, 9)
            rounded[shared] = np.where(self.units[shared][:, None] == units, -np.inf, rounded[shared])
            fits = (rounded > self.least[:, None]) | ((rounded == self.least[:, None]) & (units < self.last[:, None]))
            if len(units) > self.k:
                fits &= rounded >= np.partition(rounded, -self.k, axis=1)[:, -self.k][:, None]
            at, col = np.nonzero(fits)
            score = scores[at, col]
        value = np.round(score, 9)
        keep = (self.units[at] != units[col]) & ((value > self.least[at]) | ((value == self.least[at]) & (units[col] < self.last[at])))
        self.found.append((at[keep], value[keep], units[col[keep]], score[keep]))
        self.waiting += np.count_nonzero(keep)
        if few is None or self.waiting > len(self.units) * self.k // 4:
            self._merge()

    def _reaching(self, narrow: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the scores that reach ``least``, a few queries at a time so that their scores stay in the cache."""
        out = []
        for begin in range(0, len(least), 1024):
            hit = (self.narrow[begin : begin + 1024] @ narrow.T >= least[begin : begin + 1024, None]).ravel()
            if hit.size % 8:
                out.append(np.flatnonzero(hit) + begin * len(narrow))
            else:  # nearly all are missed: eight are looked at together
                words = np.flatnonzero(hit.view(np.uint64))
                word, byte = np.nonzero(hit.reshape(-1, 8)[words])
                out.append(words[word] * 8 + byte + begin * len(narrow))
        return np.concatenate(out)

    def _merge(self) -> None:
        found = [np.concatenate(x) for x in zip(self.best, *self.found, strict=True)]
        self.found, self.waiting = [], 0
        order = np.lexsort((found[2], -found[1], found[0]))
        place = found[0][order]
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        nth = np.arange(len(place)) - np.repeat(begin, np.diff(np.r_[begin, len(place)]))
        self.best = [x[order][nth < self.k] for x in found]
        last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        self.least[self.best[0][last]], self.last[self.best[0][last]] = self.best[1][last], self.best[2][last]

    def rows(self) -> pa.RecordBatch:
        self._merge()
        place, _, unit, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.units[place]), pa.array(unit), pa.array(score, mask=np.isneginf(score))], names=["query_id", "unit_id", "score"])


def neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, score, rank) of the ``k`` nearest others of every row (unit_id, embedding), exactly: the work is quadratic in the rows.

    Rows are packed into blocks and each block meets each other, in tasks that hold ``PART`` blocks at most beside
    some pairs of blocks and the best of one; nothing passes through the driver. What is shuffled behind that is k rows
    for each row and ``PART`` blocks.
    """
    spark = rows.sparkSession
    kind = np.dtype(np.float32 if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else np.float64)
    rows = rows.where("unit_id is not null").select(F.col("unit_id").cast("long").alias("unit_id"), "embedding")
    n = -(-rows.count() // BLOCK)
    packed = rows.repartition(max(n, 1), "unit_id").mapInArrow(lambda batches: _packed(batches, kind), "units binary, vectors binary")
    blocks = store.written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda units, vectors: (u := np.frombuffer(units.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), kind).reshape(len(u), -1))
        name, mine = None, None
        for batch in batches:
            for block, units, vectors, other_units, other_vectors in zip(*batch.columns, strict=True):
                if name != block.as_py():
                    if mine:
                        yield mine.rows()
                    name, mine = block.as_py(), _Nearest(*read(units, vectors), k)
                mine.show(*read(other_units, other_vectors))
        if mine:
            yield mine.rows()

    others = blocks.select(F.col("units").alias("other_units"), F.col("vectors").alias("other_vectors")).coalesce(max(-(-n // PART), 1))
    met = blocks.select("block", "units", "vectors").hint("shuffle_replicate_nl").crossJoin(others)
    return top_k(met.mapInArrow(run, "query_id long, unit_id long, score double"), k)
