"""Line dedup with a sharded minimal perfect hash.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased. Distinct key hashes are counted over documents (a document counts
once, however many rows have its id; rows without an id do not count). The keys of
two documents or more are put in a minimal perfect hash index: per shard, levels
of bit arrays give every key its own slot, and two compact arrays hold a 64-bit
fingerprint and a saturating count for each slot. Documents probe the arrays;
lines are not joined.

Hash and fingerprint come from two different seeds, so a foreign line would have
to agree in the shard, the slot and 64 independent bits.

The shards of the most frequent keys, ``max_index_bytes`` at most, are sent to all
tasks. Where there are more keys, the hashes (not the lines) that these shards do
not answer are dealt out by shard, and each of the other shards is probed where
its hashes come together; as frequent keys are answered before, no shard meets a
key that holds a large share of all lines.

Null text counts as one empty line, as does empty text. Keys shorter than
``min_chars`` stay. Input columns of added
names (``ld_*``) are kept as ``<name>_in``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import make_room
from .common import ascii_lower, materialize

MIN_DOCS = 10
MIN_CHARS = 1
KEYS_PER_SHARD = 200_000
MAX_INDEX_BYTES = 64 << 20
KEY_BYTES = 12  # fingerprint, count and about 2.7 bytes of bit arrays and ranks
_LEVELS = 40
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def line_key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((_MIX[0] * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: per level one bit array, slots by rank."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        self.ranks, base = [], 0
        for b in bits:
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(b), dtype=np.int64)])
            self.ranks.append(counts + base)
            base += int(counts[-1])
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, bits, level = np.unique(keys.astype(np.uint64)), [], [], 0
        while len(keys):
            if level == _LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, -(-len(keys) * 2 // 64) * 64)
            slot = (_mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            sizes.append(size)
            bits.append(words)
            keys = keys[~alone[slot]]
            level += 1
        return cls(sizes, bits)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were not put in, any slot for the others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            slot = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = slot >> 6, (slot & 63).astype(np.uint64)
            value = self.bits[level][word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = self.ranks[level][word[hit]] + np.bitwise_count(below[hit])
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + b"".join(b.tobytes() for b in self.bits)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, bits = np.frombuffer(data, np.int64, n, 8).tolist(), 8 * (n + 1), []
        for size in sizes:
            bits.append(np.frombuffer(data, np.uint64, size // 64, at))
            at += size // 8
        return cls(sizes, bits)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, prints = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["f"].to_numpy(np.int64)
    index = PerfectHash.build(keys)
    slots = index.lookup(keys)
    fingerprints, counts = np.zeros(index.n, np.int64), np.zeros(index.n, np.uint8)
    fingerprints[slots] = prints
    counts[slots] = np.minimum(pdf["n"].to_numpy(np.int64), 255)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "mph": [index.dump()], "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()]})


def _with_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = docs.withColumn("ld_lines", lines)
    out = out.withColumn("ld_keys", F.transform("ld_lines", line_key))
    long_enough = lambda k, v: F.when(F.length(k) >= min_chars, v)
    out = out.withColumn("ld_h", F.transform("ld_keys", lambda k: long_enough(k, F.xxhash64(k))))
    return out.withColumn("ld_f", F.transform("ld_keys", lambda k: long_enough(k, F.xxhash64(F.lit("fingerprint"), k)))).drop("ld_keys")


def line_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, f, n): hash, fingerprint and document count of the line keys found in two documents or more."""
    keyed = _with_keys(docs.select(F.col(doc_id).alias("ld_id"), text), text, min_chars)
    pairs = F.array_distinct(F.filter(F.arrays_zip("ld_h", "ld_f"), lambda x: x["ld_h"].isNotNull()))
    each = keyed.where(F.col("ld_id").isNotNull()).select("ld_id", F.explode(pairs).alias("x")).select("ld_id", F.col("x.ld_h").alias("h"), F.col("x.ld_f").alias("f"))
    return each.groupBy("h", "f").agg(F.count_distinct("ld_id").alias("n")).where(F.col("n") >= 2)


def _index(counts: DataFrame, shards: int) -> DataFrame:
    """One row (shard, mph, fingerprints, counts) per shard."""
    dealt = counts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(_build_shard, "shard int, mph binary, fingerprints binary, counts binary")


class _Shard:
    def __init__(self, mph: bytes, fingerprints: bytes, counts: bytes):
        self.hash, self.prints, self.counts = PerfectHash.load(mph), np.frombuffer(fingerprints, np.int64), np.frombuffer(counts, np.uint8)

    def number(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Documents of each key as far as the array counts them, 0 for a key that is not in the index."""
        slot = self.hash.lookup(h.view(np.uint64))
        out = np.zeros(len(h), np.uint8)
        known = slot >= 0
        out[known] = np.where(self.prints[slot[known]] == f[known], self.counts[slot[known]], 0)
        return out


def _least_frequency(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` keys have it or more."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    held = 0
    lowest = None
    for row in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r["b"]):
        held += row["c"]
        if held > most:
            break
        lowest = row["n"]
    return lowest if lowest is not None else 1 << 62


def _probe_apart(flat: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """(ld_row, at) of the lines (ld_row, at, h, f) that the index counts ``least`` times or more; each shard and its lines meet in one task."""
    nothing = {c: F.lit(None).cast("long").alias(c) for c in ("ld_row", "at", "h", "f")}
    arrays = {c: F.lit(None).cast("binary").alias(c) for c in ("mph", "fingerprints", "counts")}
    first = index.select("shard", F.lit(0).alias("turn"), *nothing.values(), *arrays)
    rest = flat.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("turn"), "ld_row", F.col("at").cast("long").alias("at"), "h", "f", *arrays.values())
    dealt = first.union(rest).repartition("shard").sortWithinPartitions("shard", "turn")

    def run(batches):
        name, found = None, None
        for batch in batches:
            shard, turn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begin = np.r_[0, np.flatnonzero((np.diff(shard) != 0) | (turn[1:] == 0)) + 1, len(shard)] if len(shard) else [0]
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                if turn[a] == 0:
                    name, found = shard[a], _Shard(*(batch.column(k)[int(a)].as_py() for k in (6, 7, 8)))
                    a += 1
                if a < b and shard[a] == name:
                    part = batch.slice(int(a), int(b - a))
                    hit = pa.array(found.number(part.column(4).to_numpy(), part.column(5).to_numpy()) >= least)
                    yield pa.RecordBatch.from_arrays([part.column(2).filter(hit), part.column(3).filter(hit)], names=["ld_row", "at"])

    return dealt.mapInArrow(run, "ld_row long, at long")


def drop_repeated_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, max_index_bytes: int = MAX_INDEX_BYTES, keys_per_shard: int = KEYS_PER_SHARD, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` cleaned, and ld_n_lines, ld_n_dropped. ``min_docs`` from 2 to 255."""
    if not 2 <= min_docs <= 255:
        raise ValueError("min_docs must be between 2 and 255")
    docs = make_room(docs, ["ld_n_lines", "ld_n_dropped"])
    spark = docs.sparkSession
    counts = materialize(line_counts(docs, text, doc_id, min_chars), "lines")
    n_keys, most = counts.count(), max_index_bytes // KEY_BYTES
    keyed = _with_keys(docs, text, min_chars)
    frequent, rest = (counts, None) if n_keys <= most else (counts.where(F.col("n") >= (limit := _least_frequency(counts, most))), counts.where(F.col("n") < limit))
    shards = max(1, -(-min(n_keys, most) // keys_per_shard))
    held = spark.sparkContext.broadcast([(r["shard"], bytes(r["mph"]), bytes(r["fingerprints"]), bytes(r["counts"])) for r in _index(frequent, shards).toLocalIterator()])  # max_index_bytes at most
    loaded: dict = {}

    @F.pandas_udf("array<boolean>")
    def probe(hashes: pd.Series, prints: pd.Series) -> pd.Series:
        if not loaded:
            loaded.update({s: _Shard(*arrays) for s, *arrays in held.value})
            loaded.setdefault(-1, None)
        sizes = [len(x) for x in hashes]
        flat_h, flat_f = (np.concatenate([np.asarray(x, np.int64) for x in each]) if sizes else np.zeros(0, np.int64) for each in (hashes, prints))
        drop = np.zeros(len(flat_h), bool)
        shard = flat_h % shards
        for s, found in loaded.items():
            if found is not None:
                at = np.flatnonzero(shard == s)
                drop[at] = found.number(flat_h[at], flat_f[at]) >= min_docs
        ends = np.cumsum(sizes)
        return pd.Series([drop[e - n : e] for n, e in zip(sizes, ends, strict=True)])

    zero = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(0).cast("long")))
    marked = keyed.withColumn("ld_drop", probe(zero("ld_h"), zero("ld_f")))
    # a short key reads as 0; whatever the index says of 0, it stays
    marked = marked.withColumn("ld_drop", F.zip_with("ld_h", "ld_drop", lambda h, d: h.isNotNull() & d))
    if rest is not None:
        numbered = materialize(marked.withColumn("ld_row", F.monotonically_increasing_id()), "numbered")
        flat = numbered.select("ld_row", F.posexplode(F.arrays_zip("ld_h", "ld_f", "ld_drop")).alias("at", "x")).where("x.ld_h is not null and not x.ld_drop")
        shards = max(1, -(-(n_keys - min(n_keys, most)) // keys_per_shard))
        found = _probe_apart(flat.select("ld_row", "at", F.col("x.ld_h").alias("h"), F.col("x.ld_f").alias("f")), _index(rest, shards), shards, min_docs)
        gone = found.groupBy("ld_row").agg(F.collect_set("at").alias("ld_gone"))
        marked = numbered.join(gone, "ld_row", "left")
        marked = marked.withColumn("ld_drop", F.transform("ld_drop", lambda d, i: d | F.coalesce(F.array_contains("ld_gone", i.cast("long")), F.lit(False)))).drop("ld_row", "ld_gone")
    keep = F.filter("ld_lines", lambda x, i: ~F.coalesce(F.get("ld_drop", i), F.lit(False)))
    out = marked.withColumn("ld_n_lines", F.size("ld_lines").cast("long"))
    out = out.withColumn("ld_n_dropped", F.size(F.filter("ld_drop", lambda d: d)).cast("long"))
    return out.withColumn(text, F.array_join(keep, "\n")).drop("ld_lines", "ld_h", "ld_f", "ld_drop")


def line_table(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
