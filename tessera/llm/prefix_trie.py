"""Prefix trie of conversations by LCP-aware external mergesort.

A turn is known by the 16-byte MD5 of its role and text, a conversation by the run
of its turns' digests. Tasks sort bounded batches of conversations into runs; each
row of a run carries the number of leading turns that it shares with the row before
it. The runs are written, dealt out by ranges of (digests, id), so that copies of
one conversation spread over tasks too, and merged in every range by a loser tree
that compares two heads only beyond the turns they are known to share. The merged
stream keeps the path of the current conversation open; what is left behind is a
finished node.

Nodes on the first or the last path of a range may go on in another range. Only
those (two paths a range, whatever the rows) are emitted in parts and summed; their
subtrees are rolled up per first turn. Ids that end at such a node arrive as sorted
chunks, and its hash is fed chunk by chunk, in one task per node, as SHA-256 has no
parallel form; memory stays at one chunk.

Turns come in the order of ``turn``, null first; equal numbers go by their digest.
Null role or text is empty text. Rows without a conversation id belong to no
conversation. Repeated rows are turns of their own. No rows give no nodes, not even
the root. One conversation, like one document, has to fit a task.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import bound_batches, give_back
from .common import materialize

#: Bytes of a turn's digest.
DIGEST = 16
#: A run is sorted once it has so many rows or bytes.
RUN_ROWS, RUN_BYTES = 16_384, 8 << 20
#: Bytes of digests, lengths and ids that one merging task holds.
RANGE_BYTES = 24 << 20
#: Ids in a chunk of a node that several ranges share.
CHUNK_IDS = 4_096
#: Parts of shared nodes up to which they are sent to all tasks.
BROADCAST_PARTS = 100_000

#: The first h turns come from the block's first conversation.
BLOCK, HEADS = 100, 6

_RUNS = "run long, seq long, lcp int, conv_id long, keys binary, chars array<int>"
_NODES = "kind string, pid binary, parent_pid binary, top binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars int, ends_sha256 string, first_id long, chunk string"


def borrowed_turns(conv_id: int) -> int:
    """How many leading turns a conversation takes from the first one of its block."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turn_rows(conversations: DataFrame, rebuild: bool) -> DataFrame:
    """(block, conv_id, turn, key, chars), dealt out by block and in order within it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).alias("chars"))
    rows = rows.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK if rebuild else F.col("conv_id"))
    own = F.col("conv_id") != F.col("block")
    return rows.repartition("block").sortWithinPartitions("block", own, "conv_id", F.col("turn").asc_nulls_first(), "key").select("block", "conv_id", "key", "chars")


def _conversations(batches: Iterator[pa.RecordBatch], rebuild: bool) -> Iterator[tuple[bytes, int, array]]:
    """(digests, id, lengths) of every conversation from ordered turns."""
    cid = block = None
    keys, chars = bytearray(), array("i")
    head_of, head_keys, head_chars = None, b"", array("i")

    def done():
        nonlocal head_of, head_keys, head_chars
        own_keys, own_chars = bytes(keys), chars[:]
        if not rebuild:
            return own_keys, cid, own_chars
        if head_of != block:  # the block's first conversation comes first, if it is there
            head_of = block
            here = cid == block
            head_keys, head_chars = (own_keys[: DIGEST * HEADS], own_chars[:HEADS]) if here else (b"", array("i"))
        h = borrowed_turns(cid)
        return head_keys[: DIGEST * h] + own_keys[DIGEST * h :], cid, head_chars[:h] + own_chars[h:]

    for batch in batches:
        ids = batch.column(1).to_numpy()
        blocks = batch.column(0).to_numpy()
        lens = batch.column(3).to_numpy()
        digests = b"".join(batch.column(2).to_pylist())
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for a, b in zip(edges, edges[1:]):
            if cid != ids[a]:
                if cid is not None:
                    yield done()
                cid, block = int(ids[a]), int(blocks[a])
                keys, chars = bytearray(), array("i")
            keys += digests[DIGEST * a : DIGEST * b]
            chars.extend(lens[a:b].tolist())
    if cid is not None:
        yield done()


def shared_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """Leading turns that two conversations share; the first ``start`` are known to be shared."""
    most = min(len(a), len(b)) // DIGEST
    while start < most and a[start * DIGEST : start * DIGEST + DIGEST] == b[start * DIGEST : start * DIGEST + DIGEST]:
        start += 1
    return start


def sorted_runs(turns: DataFrame, rebuild: bool, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows of sorted runs: run, place, turns shared with the row before, conversation."""
    bound_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush():
            held.sort(key=lambda x: x[:2])
            lcps = [0] + [shared_turns(a[0], b[0]) for a, b in zip(held, held[1:])]
            for at in range(0, len(held), 1024):
                part = held[at : at + 1024]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + made] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(lcps[at : at + n], pa.int32()),
                        pa.array([x[1] for x in part], pa.int64()), pa.array([x[0] for x in part], pa.binary()), pa.array([x[2].tolist() for x in part], pa.list_(pa.int32())),
                    ],
                    names=["run", "seq", "lcp", "conv_id", "keys", "chars"],
                )

        for row in _conversations(batches, rebuild):
            held.append(row)
            size += len(row[0]) + 4 * len(row[2])
            if len(held) >= run_rows or size >= RUN_BYTES:
                yield from flush()
                made, held, size = made + 1, [], 0
        if held:
            yield from flush()
        give_back()

    return turns.mapInArrow(run, _RUNS)


class Run:
    """A sorted run as flat arrays with a place in it."""

    def __init__(self) -> None:
        self.keys, self.ids, self.lcps, self.chars, self.at = [], array("q"), array("i"), [], 0

    def add(self, lcp: int, cid: int, keys: bytes, chars) -> None:
        self.lcps.append(lcp if self.ids else 0)
        self.ids.append(cid)
        self.keys.append(keys)
        self.chars.append(chars)


def merge_runs(runs: list[Run]) -> Iterator[tuple[bytes, int, object, int]]:
    """(digests, id, lengths, turns shared with the one before) of all runs, in order, by a loser tree.

    Each head's ``shared`` counts the leading turns it shares with the row that beat
    it last. Of two heads beaten by the same row the one that shares more is the
    smaller, without a look at their turns; only equal counts are compared, and from
    there on.
    """
    k = len(runs)
    shared = [0] * k
    live = [bool(r.ids) for r in runs]

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's count becomes what it shares with the winner."""
        if not live[b] or not live[a]:
            return (a, b) if live[a] else (b, a)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = runs[a], runs[b]
        p, q = x.keys[x.at], y.keys[y.at]
        n = shared_turns(p, q, shared[a])
        first = (p[n * DIGEST : n * DIGEST + DIGEST], x.ids[x.at]) <= (q[n * DIGEST : n * DIGEST + DIGEST], y.ids[y.at])
        won, lost = (a, b) if first else (b, a)
        shared[lost] = n
        return won, lost

    if not k:
        return
    lost, won = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        won[node], lost[node] = match(won[2 * node], won[2 * node + 1])
    best = won[1] if k > 1 else 0
    while live[best]:
        r = runs[best]
        yield r.keys[r.at], r.ids[r.at], r.chars[r.at], shared[best]
        r.keys[r.at] = r.chars[r.at] = None
        r.at += 1
        live[best] = r.at < len(r.ids)
        if live[best]:
            shared[best] = r.lcps[r.at]
        node = (best + k) // 2
        while node:
            best, lost[node] = match(best, lost[node])
            node //= 2


def node_id(prefix: bytes) -> bytes:
    return hashlib.md5(prefix).digest()


class Frame:
    """An open node of the current path."""

    __slots__ = ("depth", "chars", "edge", "n", "first", "children", "leaves", "saved", "ends", "below")

    def __init__(self, depth: int, chars: int, edge: bool) -> None:
        self.depth, self.chars, self.edge = depth, chars, edge
        self.n, self.first, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.below = array("q"), []


def _ids_text(ids) -> str:
    return ",".join(map(str, ids))


def trie_rows(stream: Iterator[tuple[bytes, int, object, int]]) -> Iterator[tuple]:
    """Rows of ``_NODES`` from the merged stream.

    ``node`` rows are finished; those below a node of an edge path lack the parent's
    id and have its pid. ``part`` rows are parts of nodes of an edge path, without the
    shares of children that are parts themselves. ``ends`` rows hold their ids.
    """
    path: list[Frame] = []
    keys = b""

    def close(frame: Frame, keys: bytes) -> Iterator[tuple]:
        if not frame.edge:
            for row in frame.below:
                yield ("node", None, None, None, row[0], row[1], frame.first, *row[2:6], None, row[6], None, None)
            saved = frame.saved + (frame.n - 1) * frame.chars
            up = path[-1]
            up.below.append((frame.depth, frame.first, frame.n, frame.children, frame.leaves or 1, saved, hashlib.sha256(_ids_text(frame.ends).encode()).hexdigest()))
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + (frame.leaves or 1), up.saved + saved
        else:
            d = frame.depth
            pid = node_id(keys[: DIGEST * d])
            for row in frame.below:
                yield ("node", None, pid, None, row[0], row[1], None, *row[2:6], None, row[6], None, None)
            for at in range(0, len(frame.ends), CHUNK_IDS):
                part = frame.ends[at : at + CHUNK_IDS]
                yield ("ends", pid, None, None, d, None, None, None, None, None, None, None, None, part[0], _ids_text(part))
            parent, top = (node_id(keys[: DIGEST * (d - 1)]), node_id(keys[:DIGEST])) if d else (None, None)
            yield ("part", pid, parent, top, d, frame.first, None, frame.n, frame.children, frame.leaves, frame.saved, frame.chars, None, None, None)
        if path:
            up = path[-1]
            up.n += frame.n
            up.first = frame.first if up.first is None else min(up.first, frame.first)

    for new, cid, chars, same in stream:
        depth = len(new) // DIGEST
        while len(path) > same + 1:
            yield from close(path.pop(), keys)
        first = not path
        if first:
            path.append(Frame(0, 0, True))
        for d in range(len(path), depth + 1):
            path.append(Frame(d, int(chars[d - 1]), first))
        keys, top = new, path[-1]
        top.n += 1
        top.first = cid if top.first is None else min(top.first, cid)
        top.ends.append(cid)
    for frame in path:
        frame.edge = True
    while path:
        yield from close(path.pop(), keys)


def _merged(ranges: DataFrame) -> DataFrame:
    """``_NODES`` rows of each partition of run rows, which come run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, Run] = {}
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            chars = columns[5].flatten().to_numpy()
            edges = np.concatenate([[0], np.cumsum(columns[5].value_lengths().to_numpy())])
            for j, (r, lcp, cid, keys) in enumerate(zip(columns[0].to_pylist(), columns[2].to_pylist(), columns[3].to_pylist(), columns[4].to_pylist(), strict=True)):
                runs.setdefault(r, Run()).add(lcp, cid, keys, chars[edges[j] : edges[j + 1]])
        held = []
        names = ranges_schema.names
        for row in trie_rows(merge_runs(list(runs.values()))):
            held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=ranges_schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=ranges_schema)
        runs.clear()
        give_back()

    ranges_schema = _arrow_schema(_NODES)
    return ranges.mapInArrow(run, _NODES)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _shared_nodes(parts: DataFrame) -> DataFrame:
    """Nodes of the edge paths: parts summed, then each subtree rolled up per first turn."""
    nodes = parts.groupBy("pid").agg(
        F.first("parent_pid").alias("parent_pid"), F.first("top").alias("top"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("chars").alias("chars"),
    )

    def roll_up(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("depth", ascending=False).to_dict("records")
        more: dict[bytes, list[int]] = defaultdict(lambda: [0, 0, 0])
        for r in rows:
            children, leaves, saved = more.pop(bytes(r["pid"]), (0, 0, 0))
            r["n_children"] += children
            r["n_leaves"] = r["n_leaves"] + leaves or 1
            r["saved_tokens"] += saved + (r["n_convs"] - 1) * r["chars"]
            up = more[bytes(r["parent_pid"])]
            up[0], up[1], up[2] = up[0] + 1, up[1] + r["n_leaves"], up[2] + r["saved_tokens"]
        return pd.DataFrame(rows, columns=pdf.columns)

    inner = nodes.where("depth > 0").groupBy("top").applyInPandas(roll_up, nodes.schema)
    tops = inner.where("depth = 1").agg(F.count("*").alias("c"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("l"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("s"))
    root = nodes.where("depth = 0").crossJoin(F.broadcast(tops))  # one row each
    root = root.withColumn("n_children", F.col("n_children") + F.col("c")).withColumn("n_leaves", F.greatest(F.col("n_leaves") + F.col("l"), F.lit(1))).withColumn("saved_tokens", F.col("saved_tokens") + F.col("s"))
    return inner.union(root.select(*inner.columns))


def _ends(chunks: DataFrame) -> DataFrame:
    """(pid, ends_sha256) of shared nodes: chunks are hashed in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sha, out = None, None, []
        for batch in batches:
            for p, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != pid:
                    if pid is not None:
                        out.append((pid, sha.hexdigest()))
                    pid, sha = p, hashlib.sha256(chunk.encode())
                else:
                    sha.update(b"," + chunk.encode())
        if pid is not None:
            out.append((pid, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["pid", "ends_sha256"])

    return chunks.repartition("pid").sortWithinPartitions("pid", "first_id").select("pid", "chunk").mapInArrow(run, "pid binary, ends_sha256 string")


NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, rebuild: bool = False, range_bytes: int = RANGE_BYTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """All nodes of the trie of ``conversations(conv_id, turn, role, text)``.

    ``rebuild`` lets each conversation take its first turns from its block's first one.
    """
    runs = materialize(sorted_runs(turn_rows(conversations, rebuild), rebuild, run_rows), "trie-runs")
    size = runs.agg(F.coalesce(F.sum(F.length("keys") * 2 + 64), F.lit(0))).first()[0]
    tasks = max(int(size // range_bytes) + 1, min(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // (1 << 20)) + 1))
    ranges = runs.repartitionByRange(tasks, "keys", "conv_id").sortWithinPartitions("run", "seq")
    made = materialize(_merged(ranges), "trie-nodes")
    shared = materialize(_shared_nodes(made.where("kind = 'part'")), "trie-shared")
    small = shared.count() <= BROADCAST_PARTS
    up = shared.select(F.col("pid").alias("parent_pid"), F.col("conv_id").alias("up_id"))
    up = F.broadcast(up) if small else up
    done = made.where("kind = 'node' and parent_pid is null")
    below = made.where("kind = 'node' and parent_pid is not null").drop("parent_conv_id").join(up, "parent_pid", "left").withColumnRenamed("up_id", "parent_conv_id")
    ended = _ends(made.where("kind = 'ends'").select("pid", "first_id", "chunk"))
    edge = shared.join(ended, "pid", "left").join(up, "parent_pid", "left").withColumnRenamed("up_id", "parent_conv_id")
    edge = edge.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return done.select(*NODE_COLUMNS).union(below.select(*NODE_COLUMNS)).union(edge.select(*NODE_COLUMNS))


def trie_table(conversations: DataFrame) -> DataFrame:
    out = prefix_trie(conversations.select("conv_id", "turn", "role", "text"), rebuild=True)
    return out.withColumn("depth", F.col("depth").cast("long"))
