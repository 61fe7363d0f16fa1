"""LM scoring by context-tree weighting, beside a word-frequency score.

Model: bytes are taken apart into eight binary decisions. For every context of up
to ``DEPTH`` bytes and every decision node Krichevsky-Trofimov estimates are mixed
over all depths with context-tree weights. The counts are those of all training
texts and no context is left out, so the tree grows with the corpus; it is never
in one place. Texts lie in blocks. Each block's distinct (DEPTH + 1)-grams, sorted
and packed, go to shards of whole subtrees of ``TOP`` + 1 bytes: shards sum the
training counts of all blocks and weigh their subtrees; the sums for the top of the
tree, which the alphabet bounds, are weighed once and go to all tasks. Then each
shard answers each block's grams with their log probabilities, and the block's
texts are scored beside the answers. A text's score is the log10 probability of its
bytes and its end; ``bits_per_byte`` is the code length.

Base: the sum over words (A-Z lower-cased) and one end of
log10((c + 0.1) / (N + 0.1 (V + 1))). The most frequent words (at most ``HEAD``)
go to all tasks; the words of a text beyond those are joined to their counts.

Null counts as empty. Without training texts all estimates are one half and the
base is 0. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import append_columns, give_back
from .common import hash_remainder, materialize
from .context_tree import DEPTH, climb, descend, gram_array, gram_nodes
from .shingles import mix64

TOP = 2
HEAD = 200_000
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
SHARD_TEXT_BYTES = 8 << 20
MIN_SHARDS, MAX_SHARDS = 32, 4096
MAX_HELD_WORDS = 500_000
_END_WORD = b""  # no word is empty


def _summed(gram: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        gram = np.sort(gram)
    else:
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[starts], np.diff(np.r_[starts, len(gram)]) if n is None else np.add.reduceat(n, starts)


def _pack(values: np.ndarray) -> bytes:
    """Bytes ordered by significance, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack_grams(gram: np.ndarray) -> bytes:
    return _pack(np.diff(gram, prepend=0))


def _unpack_grams(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, np.int64))


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _block_grams(texts: DataFrame, depth: int, shards: int) -> DataFrame:
    """(shard, block, size, grams, counts) of (block, learn, text): the distinct runs of depth + 1 bytes of each block and how often learned texts hold them.

    Texts begin with zero bytes. A block that two tasks read may name a gram twice.
    """
    shift = 8 * (depth - TOP)

    def run(batches):
        held, size, sums, at = [[], []], 0, [], None

        def take():
            nonlocal held, size, sums
            for learned in (0, 1):
                if held[learned]:
                    gram, n = _summed(gram_array(held[learned], depth)[0])
                    sums.append((gram, n * learned))
            held, size = [[], []], 0
            if len(sums) > 1:
                sums = [_summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))]

        def flush():
            nonlocal sums
            take()
            for gram, n in sums:
                shard = (mix64((gram >> shift).astype(np.uint64)) % np.uint64(shards)).astype(np.uint16)
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order])) + 1
                parts = np.split(order, cut)
                yield _rows({
                    "shard": ([int(shard[x[0]]) for x in parts], pa.int32()), "block": ([at] * len(parts), pa.int64()), "size": ([len(x) for x in parts], pa.int32()),
                    "grams": ([_pack_grams(gram[x]) for x in parts], pa.binary()), "counts": ([_pack(n[x].astype(np.uint32)) for x in parts], pa.binary()),
                })
            sums = []

        for batch in batches:
            for block, learn, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if block != at:
                    yield from flush()
                    at = block
                held[bool(learn)].append((text or "").encode())
                size += len(held[bool(learn)][-1])
                if size > SLICE_BYTES:
                    take()
        yield from flush()
        give_back()

    return texts.mapInArrow(run, "shard int, block long, size int, grams binary, counts binary")


def _shard_totals(blocks: DataFrame) -> DataFrame:
    """(shard, size, grams, counts): one row per shard, summed over the blocks one after another."""

    def run(batches):
        at, held, rows = None, [], 0

        def merge():
            nonlocal held, rows
            held, rows = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0

        def close():
            merge()
            gram, n = held[0]
            return _rows({"shard": ([at], pa.int32()), "size": ([len(gram)], pa.int32()), "grams": ([_pack_grams(gram)], pa.binary()), "counts": ([_pack(n.astype(np.int64))], pa.binary())})

        for batch in batches:
            for shard, size, grams, counts in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if shard != at:
                    if held:
                        yield close()
                    at, held, rows = shard, [], 0
                held.append((_unpack_grams(grams, size), _unpack(counts, size, np.uint32).astype(np.int64)))
                rows += size
                if rows > 2 * len(held[0][0]) and len(held) > 2:
                    merge()
        if held:
            yield close()
        give_back()

    dealt = blocks.select("shard", "size", "grams", "counts").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, size int, grams binary, counts binary")


def _each_shard(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            shard, size, grams, counts = (batch.column(c)[k].as_py() for c in range(4))
            yield shard, _unpack_grams(grams, size), _unpack(counts, size, np.int64).astype(np.float64)


def _weighed(totals: DataFrame, depth: int) -> DataFrame:
    """(shard, size, grams, logs): log10 probability of each gram's last byte after the others."""

    def up(batches):
        for _, gram, n in _each_shard(batches):
            for bits in range(8):
                node, zeros, ones, _ = gram_nodes(gram, n, bits)
                _, node, zeros, ones, child = climb(node, zeros, ones, None, bits, depth - TOP)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), bits, np.int32)), *map(pa.array, (node, zeros, ones, child))], names=["bits", "node", "zeros", "ones", "child"])

    sums = totals.mapInArrow(up, "bits int, node long, zeros double, ones double, child double")
    sums = sums.groupBy("bits", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "child")]).toArrow()  # at most 255 nodes for each two bytes
    bit, *columns = (sums.column(k).to_numpy() for k in range(5))
    top = []
    for bits in range(8):
        node, zeros, ones, child = (c[bit == bits] for c in columns)
        order = np.argsort(node)
        layers, above, *_ = climb(node[order], zeros[order], ones[order], child[order], bits, TOP + 1)
        top.append((node[order], *descend(layers, np.zeros(len(above)), np.ones(len(above)))))
    held = totals.sparkSession.sparkContext.broadcast(top)

    def down(batches):
        for shard, gram, n in _each_shard(batches):
            logs = np.zeros(len(gram))
            for bits, (known, alpha, beta) in enumerate(held.value):
                node, zeros, ones, at = gram_nodes(gram, n, bits)
                layers, node, *_ = climb(node, zeros, ones, None, bits, depth - TOP)
                place = np.searchsorted(known, node)
                one = np.clip(descend(layers, alpha[place], beta[place])[0], 1e-12, 1 - 1e-12)[at]
                logs += np.log10(np.where((gram >> (7 - bits)) & 1, one, 1 - one))
            yield _rows({"shard": ([shard], pa.int32()), "size": ([len(gram)], pa.int32()), "grams": ([_pack_grams(gram)], pa.binary()), "logs": ([_pack(logs.astype(np.float32))], pa.binary())})
        give_back()

    return totals.mapInArrow(down, "shard int, size int, grams binary, logs binary")


def _answers(blocks: DataFrame, weighed: DataFrame) -> DataFrame:
    """(block, size, grams, logs): the grams of each block with their logs; a shard's table comes first, the blocks' questions stream by."""

    def run(batches):
        gram = log = None
        for batch in batches:
            out: list[tuple] = []
            for block, size, grams, logs in zip(*[batch.column(k).to_pylist() for k in range(1, 5)], strict=True):
                asked = _unpack_grams(grams, size)
                if block < 0:
                    gram, log = asked, _unpack(logs, size, np.float32)
                else:
                    out.append((block, size, grams, _pack(log[np.searchsorted(gram, asked)])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield _rows({c: (v, k) for (c, k), v in zip((("block", pa.int64()), ("size", pa.int32()), ("grams", pa.binary()), ("logs", pa.binary())), columns, strict=True)})
        give_back()

    first = weighed.select("shard", F.lit(-1).cast("long").alias("block"), "size", "grams", "logs")
    asked = blocks.select("shard", "block", "size", "grams", F.lit(None).cast("binary").alias("logs"))
    dealt = first.union(asked).repartition("shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "block long, size int, grams binary, logs binary")


def _score_block(_, texts: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's texts with the logs of all its grams."""
    parts = list(zip(*[answers.column(c).to_pylist() for c in ("size", "grams", "logs")], strict=True))
    del answers
    index = pd.Index(np.concatenate([_unpack_grams(g, n) for n, g, _ in parts]))
    log = np.concatenate([_unpack(x, n, np.float32) for n, _, x in parts]).astype(np.float64)
    if not index.is_unique:
        once = ~index.duplicated()
        index, log = index[once], log[once]
    values, scores, held, size = texts.column("text"), [], [], 0
    for k in range(len(values)):
        held.append((values[k].as_py() or "").encode())
        size += len(held[-1])
        if size > SLICE_BYTES or k + 1 == len(values):
            asked, sizes = gram_array(held, DEPTH)
            scores.append(np.add.reduceat(log[index.get_indexer(asked)], np.cumsum(sizes) - sizes))
            held, size = [], 0
    return pa.table({"lm_row": texts.column("lm_row"), "lm_score": np.concatenate(scores)})


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end is the empty word."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update((text or "").encode().lower().split())
            held[_END_WORD] += batch.num_rows
            if len(held) > MAX_HELD_WORDS:
                yield flush()
                held = Counter()
        if held:
            yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words of at least some count, ``most`` at most; the count is found from a histogram of magnitudes."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = sorted(((r["b"], r["c"]) for r in counts.groupBy(size.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)
    lowest, held = None, 0
    for b, c in steps:
        if held + c > most:
            break
        lowest, held = b, held + c
    if lowest is None:
        return {}
    rows = counts.where(size >= lowest).select("word", "n").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def score_texts(docs: DataFrame, learn: Column, text: str = "text", head: int = HEAD) -> DataFrame:
    """``docs`` with lm_n_tokens, lm_n_known, lm_train_tokens, lm_base, lm_score and lm_bits_per_byte; the model learns from the rows where ``learn`` holds."""
    spark = docs.sparkSession
    docs = docs.withColumn("lm_learn", F.coalesce(learn, F.lit(False)))
    counts = materialize(_word_counts(docs.where("lm_learn").select(text)), "words")
    n_all, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = n_all + 0.1 * (vocabulary + 1)
    frequent = _head(counts, head)
    held = spark.sparkContext.broadcast(frequent)  # bounded

    def make():
        logs = {w: math.log10((c + 0.1) / floor) for w, c in held.value.items()}
        task = TaskContext.get()
        row = [(task.partitionId() if task else 0) << 36]
        block = [row[0], 0]  # its first row, its bytes

        def work(texts):
            ids, tokens, seen, base, blocks, sizes, rare, times = [], [], [], [], [], [], [], []
            for value in texts.to_pylist():
                data = (value or "").encode()
                row[0] += 1
                ids.append(row[0])
                words = data.lower().split()
                words.append(_END_WORD)
                tokens.append(len(words))
                parts = [logs.get(w) for w in words]
                left = Counter(w for w, p in zip(words, parts, strict=True) if p is None) if None in parts else {}
                n_left = sum(left.values()) if left else 0
                seen.append(len(words) - n_left)
                base.append(math.fsum(p for p in parts if p is not None))
                rare.append(list(left))
                times.append(list(left.values()) if left else [])
                sizes.append(len(data))
                if block[1] > BLOCK_BYTES:
                    block[:] = row[0], 0
                block[1] += len(data)
                blocks.append(block[0])
            return [ids, tokens, seen, base, blocks, sizes, rare, times]

        return work

    long, double = T.LongType(), T.DoubleType()
    added = T.StructType([T.StructField("lm_row", long), T.StructField("lm_n_tokens", long), T.StructField("lm_seen", long), T.StructField("lm_part", double), T.StructField("lm_block", long), T.StructField("lm_bytes", long), T.StructField("lm_rare", T.ArrayType(T.BinaryType())), T.StructField("lm_times", T.ArrayType(long))])
    scored = materialize(append_columns(docs, [text], added, make), "scored", "zstd")  # holds the texts
    total = scored.agg(F.coalesce(F.sum("lm_bytes"), F.lit(0))).first()[0]
    shards = int(min(MAX_SHARDS, max(MIN_SHARDS, total // SHARD_TEXT_BYTES)))
    grams = materialize(_block_grams(scored.select("lm_block", "lm_learn", text), DEPTH, shards), "grams")
    totals = materialize(_shard_totals(grams), "totals")
    answers = _answers(grams, _weighed(totals, DEPTH)).withColumnRenamed("block", "lm_block")
    blocks = scored.select("lm_block", "lm_row", F.col(text).alias("text")).groupBy("lm_block")
    scores = blocks.cogroup(answers.groupBy("lm_block")).applyInArrow(_score_block, "lm_row long, lm_score double")
    rare = scored.select("lm_row", F.explode(F.arrays_zip("lm_rare", "lm_times")).alias("x")).select("lm_row", F.col("x.lm_rare").alias("word"), F.col("x.lm_times").alias("times"))
    rare = rare.join(counts, "word", "left").select("lm_row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    rest = rare.groupBy("lm_row").agg(F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / F.lit(float(floor)))).alias("lm_rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("lm_more"))
    out = scored.drop("lm_rare", "lm_times", "lm_block", "lm_learn").join(scores, "lm_row").join(rest, "lm_row", "left")
    out = out.withColumn("lm_base", F.col("lm_part") + F.coalesce("lm_rest", F.lit(0.0)))
    out = out.withColumn("lm_n_known", F.col("lm_seen") + F.coalesce("lm_more", F.lit(0)))
    out = out.withColumn("lm_train_tokens", F.lit(int(n_all)).cast("long"))
    out = out.withColumn("lm_bits_per_byte", -F.col("lm_score") / F.lit(math.log10(2)) / F.greatest(F.col("lm_bytes"), F.lit(1)))
    return out.drop("lm_row", "lm_seen", "lm_part", "lm_rest", "lm_more", "lm_bytes")


def score_table(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    held_out = hash_remainder(F.col("doc_id"), 10) == 0
    out = score_texts(slim.withColumn("held_out", held_out), ~held_out)
    return out.select("doc_id", "held_out", F.col("lm_n_tokens").alias("n_tokens"), F.col("lm_n_known").alias("n_known"), F.col("lm_train_tokens").alias("train_tokens"), F.col("lm_base").alias("base_score"), F.col("lm_score").alias("score"), F.col("lm_bits_per_byte").alias("bits_per_byte"))
