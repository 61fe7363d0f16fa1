"""Suffix-array dedup: cut every byte that lies in a string of ``length`` bytes which starts anywhere else too.

Suffix arrays over all text would be several times its size, so text that cannot
repeat is left out first, without losing a repeat:

1. Every window of ``length`` bytes has an anchor: the place in it whose next
   ``GRAM`` bytes hash lowest (the leftmost of ties). Equal windows have equal
   anchors at equal offsets, so only windows whose anchor hash occurs more than
   once can repeat. Neighbouring windows share anchors: an anchor stands for one
   range of window starts.
2. Ranges with equal bytes are counted and one of each is fetched from the texts.
   The ranges of one anchor form a group, and groups are dealt out by anchor. A
   range that occurs more than once repeats as a whole. Of the others only the
   windows go on whose common part with up to ``WIDTH`` - 1 neighbours stands in
   another range of the group too; a group of one range has nothing to compare.
3. What goes on is packed into shards of ``SHARD_BYTES``. In a shard the suffix
   array is made by recursive induced sorting, and permuted common prefixes,
   carried in text order, tell which windows repeat.
4. A group of more than ``GROUP_BYTES``, such as a frequent phrase in ever new
   surroundings, is in no one place: its windows are counted by their hashes.
5. Window runs become byte spans of their texts, and the spans are cut out.

The plan is the same at every size. Texts are known by two 64-bit hashes, so copies
share their spans. Null and empty texts have no bytes; texts shorter than
``length`` stay whole and are dealt out by their rows, as no span can be theirs. Spans that overlap or touch are one run. Cuts are made in
bytes and may part a character. Input columns of added names
(``sd_*``) are kept as ``<name>_in``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import append_columns, give_back, make_room
from .common import materialize, release
from .shingles import mix64
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 200
GRAM = 40
WIDTH = 41
SHARD_BYTES = 3 << 20
GROUP_BYTES = 1 << 20
SLICE_BYTES = 1 << 20
LONG_BYTES = 1 << 26  # longer texts are read in pieces that overlap by a window less one byte
_POSITION_BITS = 28

_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place, by doubling."""
    h, span = mix64(_BYTE[data]), 1
    while span < width:
        step = min(span, width - span)
        h = h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ np.uint64(0x2545F4914F6CDD1D))
        h ^= h >> np.uint64(31)
        span += step
    return mix64(h)


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest key in each window of ``width``; the leftmost of ties in the upper bits."""
    n = len(keys)
    marked = (keys & ~np.uint64((1 << _POSITION_BITS) - 1)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = marked
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (low & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    forward = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_STEP))]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BACK))]))
    return np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * forward[:n])]), back


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, range hash, first start, last start, anchor place), places within the text."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= length).any():
        return none, none, none, none, none, none
    gram = gram_hashes(data, GRAM)
    low = sliding_argmin(gram, length - GRAM + 1)
    n_starts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), n_starts)
    start = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n_starts)[:-1]]), n_starts) + offset[text]
    place = low[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    text, lo, hi, place = text[first], start[first], start[last], place[first]
    total, back = _prefix_sums(data)
    print_ = mix64((total[hi + length] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64) * np.uint64(3) + ((place - lo).astype(np.uint64) << np.uint64(20)))
    base = offset[text]
    return text, gram[place].view(np.int64), print_.view(np.int64), lo - base, hi - base, place - base


def _slices(values: list[str | None], length: int):
    """Texts of about ``SLICE_BYTES`` together: (rows, offsets in their texts, bytes)."""
    rows, offsets, held, size = [], [], [], 0
    for i, value in enumerate(values):
        data = (value or "").encode()
        for at in range(0, max(1, len(data) - length + 1), LONG_BYTES):
            part = data[at : at + LONG_BYTES + length - 1]
            if held and size + len(part) > SLICE_BYTES:
                yield np.array(rows), np.array(offsets), held
                rows, offsets, held, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield np.array(rows), np.array(offsets), held


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(h, r, t, u, lo, hi, at) for all anchors of ``texts`` (t, u, body)."""

    def run(batches):
        for batch in batches:
            keys, others = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for rows, offsets, part in _slices(batch.column(2).to_pylist(), length):
                text, h, r, lo, hi, at = anchors(part, length)
                more = offsets[text]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(r), pa.array(keys[rows[text]]), pa.array(others[rows[text]]), pa.array((lo + more).astype(np.int32)), pa.array((hi + more).astype(np.int32)), pa.array((at - lo).astype(np.int32))], names=["h", "r", "t", "u", "lo", "hi", "at"])
        give_back()

    return texts.mapInArrow(run, "h long, r long, t long, u long, lo int, hi int, at int")


def _pieces(bodies: DataFrame, length: int) -> DataFrame:
    """(h, r, n, large, at, seg): the bytes of each wanted range; a range may come from copies in several tasks.

    ``bodies`` is (t, u, body, want): want holds (h, r, n, large, lo, hi, at).
    """
    kinds = {"h": pa.int64(), "r": pa.int64(), "n": pa.int64(), "large": pa.bool_(), "at": pa.int32(), "seg": pa.binary()}

    def run(batches):
        last = None
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in kinds}
            for t, u, body, want in zip(*[batch.column(k) for k in range(4)], strict=True):
                if (t.as_py(), u.as_py()) == last:
                    continue  # a copy: the join has sorted them together
                last = t.as_py(), u.as_py()
                data = body.as_py().encode()
                for w in want.as_py():
                    for c in ("h", "r", "n", "large", "at"):
                        rows[c].append(w[c])
                    rows["seg"].append(data[w["lo"] : w["hi"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in kinds.items()], names=list(kinds))
        give_back()

    return bodies.mapInArrow(run, "h long, r long, n long, large boolean, at int, seg binary")


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment a mask over its windows: which stand in another segment, or there again.

    All windows of ``segments`` are different places of the texts.
    """
    gap = b"\0" * 8
    text = np.frombuffer(b"".join(s + gap for s in segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    offset = np.concatenate([[0], np.cumsum(sizes + 8)])[:-1]
    letters = np.concatenate([text.astype(np.uint16) + np.uint16(2), np.zeros(1, np.uint16)])
    letters[np.repeat(offset + sizes, 8) + np.tile(np.arange(8), len(segments))] = 1
    mark = np.zeros(len(letters) + 1, np.int8)
    mark[offset] = 1
    mark[offset + sizes - length + 1] -= 1
    is_start = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    order = suffix_array(letters)
    prefix = permuted_common_prefixes(letters, order, length)
    # the common prefix of two starts is the least of those between them in suffix order
    at = np.flatnonzero(is_start[order])
    least = np.minimum.reduceat(prefix[order], at[:-1] + 1)[: len(at) - 1] if len(at) > 1 else np.zeros(0, np.int64)
    same, found = least >= length, order[at]
    repeats = np.zeros(len(letters), bool)
    repeats[found[1:][same]] = True
    repeats[found[:-1][same]] = True
    return [repeats[o : o + n - length + 1] for o, n in zip(offset, sizes, strict=True)]


def _alike(group: list[tuple], length: int) -> list[tuple[tuple, int, int]]:
    """(range, first window, last window) of what may repeat in a group of ranges (h, r, n, at, seg).

    Windows whose distance to the anchor lies in one class of ``WIDTH`` share a
    part; a window can only repeat if that part stands in another range as well.
    """
    if len(group) < 2 or all(x[2] > 1 for x in group):
        return []
    seen: dict[tuple[int, bytes], int] = {}
    parts = []
    for x in group:
        at, seg = x[3], x[4]
        first, last = at - (len(seg) - length), at  # distances of the last and the first window
        own = []
        for c in range(first // WIDTH, last // WIDTH + 1):
            near, far = c * WIDTH, c * WIDTH + WIDTH - 1
            key = (c, seg[at - near : at - min(far, length - GRAM) + length])
            seen[key] = seen.get(key, 0) + 1
            own.append((at - min(far, last), at - max(near, first), key))
        parts.append(own)
    out: list[tuple[tuple, int, int]] = []
    for x, own in zip(group, parts, strict=True):
        run = None
        for a, b, key in reversed(own):  # in the order of the windows
            if seen[key] > 1:
                run = (run[0], b) if run else (a, b)
            elif run:
                out.append((x, *run))
                run = None
        if run:
            out.append((x, *run))
    return out


def _sorted_shards(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated window runs (h, r, x, y), relative to the range, of the ``pieces`` (h, r, n, at, seg), which are sorted by h and r."""

    def run(batches):
        rows: list[tuple] = []
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def end_group():
            nonlocal size
            rows.extend((x[0], x[1], 0, len(x[4]) - length) for x in group if x[2] > 1)
            found = _alike(group, length)
            held.extend(found)
            size += sum(b - a + length + 8 for _, a, b in found)
            group.clear()

        def close():
            nonlocal size
            if held:
                masks = repeated_windows([x[4][a : b + length] for x, a, b in held], length)
                for (x, a, _), mask in zip(held, masks, strict=True):
                    if x[2] == 1:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
                        rows.extend((x[0], x[1], a + y, a + z - 1) for y, z in zip(edge[::2], edge[1::2], strict=True))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "r", "x", "y"])
            rows.clear()
            held.clear()
            size = 0
            return batch

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if group and group[-1][:2] == row[:2]:
                    continue  # the same range from another copy
                if group and group[-1][0] != row[0]:
                    end_group()
                    if size > SHARD_BYTES or len(rows) > 100_000:
                        yield close()
                group.append(row)
        end_group()
        yield close()
        give_back()

    return pieces.mapInArrow(run, "h long, r long, x int, y int")


def _window_hashes(pieces: DataFrame, length: int) -> DataFrame:
    """(k, j, h, r, n, x): two hashes of every window of the ``pieces`` (h, r, n, seg)."""

    def run(batches):
        for batch in batches:
            for h, r, n, seg in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                data = np.frombuffer(seg, np.uint8)
                k = gram_hashes(data, length)
                j = gram_hashes(data[::-1], length)[::-1]
                m = len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.ascontiguousarray(j).view(np.int64)), pa.array(np.full(m, h)), pa.array(np.full(m, r)), pa.array(np.full(m, n)), pa.array(np.arange(m, dtype=np.int32))], names=["k", "j", "h", "r", "n", "x"])
        give_back()

    return pieces.mapInArrow(run, "k long, j long, h long, r long, n long, x int")


def text_hashes(body: Column) -> list[Column]:
    """Two hashes that know a text."""
    return [F.xxhash64(body).alias("t"), F.xxhash64(F.lit(0x5EED), body).alias("u")]


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(t, u, sd_starts): a text's hashes and its byte spans to cut, for the texts that have any."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*text_hashes(body), body.alias("body")).where(F.octet_length("body") >= length)
    rows = materialize(_anchor_rows(texts, length), "anchors")
    known = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "known")
    # Both sides of each join below are tables and its result is written at once, so Spark can split a frequent key.
    found = materialize(rows.join(known, "h"), "found")
    release(rows, known)
    ranges = materialize(found.groupBy("h", "r").agg(F.count("*").alias("n"), F.min(F.struct("t", "u", "lo", "hi", "at")).alias("x")).select("h", "r", "n", "x.*"), "ranges")
    size = F.sum(F.col("hi") - F.col("lo") + length)
    large = ranges.groupBy("h").agg(size.alias("size")).where(F.col("size") > GROUP_BYTES).select("h", F.lit(True).alias("large"))
    any_large = large.limit(1).count() > 0
    marked = ranges.join(large, "h", "left") if any_large else ranges.withColumn("large", F.lit(False))
    item = F.struct("h", "r", "n", F.coalesce("large", F.lit(False)).alias("large"), "lo", "hi", "at")
    want = materialize(marked.groupBy("t", "u").agg(F.collect_list(item).alias("want")), "want")
    # A merge join keeps one text at a time; a hash table of one side could not spill.
    pieces = materialize(_pieces(texts.join(want.hint("merge"), ["t", "u"]).select("t", "u", "body", "want"), length), "pieces")
    release(ranges, want)
    shards = pieces.where("not large").select("h", "r", "n", "at", "seg").repartition("h").sortWithinPartitions("h", "r")
    runs = _sorted_shards(shards, length)
    if any_large:
        windows = materialize(_window_hashes(pieces.where("large").select("h", "r", "n", "seg"), length), "windows")
        twice = windows.groupBy("k", "j").agg(F.max("n").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1")).where("n > 1 or r0 <> r1").select("k", "j")
        runs = runs.union(windows.join(materialize(twice, "twice"), ["k", "j"]).select("h", "r", "x", F.col("x").alias("y")))
    runs = materialize(runs, "runs")
    release(pieces)
    spans = found.join(runs, ["h", "r"]).select("t", "u", (F.col("lo") + F.col("x")).alias("lo"), (F.col("lo") + F.col("y")).alias("hi"))
    spans = spans.groupBy("t", "u", "lo").agg(F.max("hi").alias("hi"))
    spans = materialize(spans.groupBy("t", "u").agg(F.array_sort(F.collect_list(F.struct("lo", (F.col("hi") + length).alias("end")))).alias("sd_starts")), "spans")
    release(found, runs)
    return spans


def _merge(starts: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in starts or ():
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["lo"], s["end"]])
    return out


def cut_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with sd_n_bytes, sd_spans (byte ranges that go) and sd_kept (the remaining bytes)."""
    docs = make_room(docs, ["sd_t", "sd_u", "sd_starts", "sd_n_bytes", "sd_spans", "sd_kept"])
    spans = repeated_spans(docs, text, length)
    body = F.coalesce(F.col(text), F.lit(""))
    t, u = text_hashes(body)
    long = F.octet_length(body) >= length
    keyed = docs.withColumn("sd_t", F.when(long, t).otherwise(F.xxhash64(*docs.columns))).withColumn("sd_u", F.when(long, u))
    joined = keyed.join(spans.withColumnsRenamed({"t": "sd_t", "u": "sd_u"}), ["sd_t", "sd_u"], "left").drop("sd_t", "sd_u")

    def make():
        def work(texts, starts):
            sizes, all_spans, kept = [], [], []
            for body, found in zip(texts.to_pylist(), starts.to_pylist(), strict=True):
                data, spans, at, parts = (body or "").encode(), _merge(found), 0, []
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                sizes.append(len(data))
                all_spans.append(spans)
                kept.append(b"".join([*parts, data[at:]]))
            return [sizes, all_spans, kept]

        return work

    added = T.StructType([T.StructField("sd_n_bytes", T.LongType()), T.StructField("sd_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("sd_kept", T.BinaryType())])
    return append_columns(joined, [text, "sd_starts"], added, make).drop("sd_starts")


def repeat_table(docs: DataFrame) -> DataFrame:
    out = cut_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("sd_n_bytes").alias("n_bytes"), (F.col("sd_n_bytes") - F.octet_length("sd_kept")).alias("n_removed"), F.size("sd_spans").cast("long").alias("n_spans"), F.sha2("sd_kept", 256).alias("kept_sha256"))
