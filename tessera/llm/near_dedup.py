"""MinHash near-dedup with SuperMinHash signatures, banding, exact verification and union-find grouping.

1. Every text becomes its set of word shingles. Texts with equal sets form one
   class, kept under its smallest id; only classes go on.
2. A SuperMinHash signature assigns every shingle a random permutation of the
   signature's places; at rank r each shingle offers r plus a fraction to the
   place that its permutation has there. Ranks are worked off in order for all
   shingles at once, and a text stops as soon as no later rank can change it.
3. Places are cut into bands; classes that share a band are joined to clusters
   by distributed components (candidates only, nothing is decided here).
4. Ordinary clusters are verified whole, each in one task: an inverted index of
   full shingle sets counts intersections, and union-find skips pairs that are
   already in one group.
5. A cluster above ``CLUSTER_SHINGLES`` is not gathered. Its classes are compared
   with hubs of their bands by joins first; what then stands apart from the
   cluster's largest group is compared with all its members, in slices and blocks
   of ``BLOCK_SHINGLES`` each, so that no task holds more of either side.
6. Components of the verified links give every row its group.

Links of 0.8 similarity share no band with a chance below 1e-7.

Null and empty texts have no shingles and stay alone. Rows with one id are one
document: what any of them links to is linked. Rows with a null id stay alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import append_columns
from .common import connected_components, materialize, release
from .shingles import mix64, shingle_sets, slices

PLACES = 128
BAND = 4
PERCENT = 80
CLUSTER_SHINGLES = 400_000
BLOCK_SHINGLES = 1_000_000
BROADCAST_IDS = 2_000_000


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """(texts, places) of uint64; the rank is in the top byte, the fraction below it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    if not sizes.sum():
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    order = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
    at = np.arange(len(element))
    for rank in range(places):
        noise = mix64(element + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & 0xFFFFFFFFFFFFFFFF))
        swap = rank + ((noise & np.uint64(0xFFFFFF)) % np.uint64(places - rank)).astype(np.int64)
        place = order[at, swap]
        order[at, swap] = order[:, rank]
        np.minimum.at(flat, owner * places + place, (np.uint64(rank) << np.uint64(56)) | (noise >> np.uint64(8)))
        worst = out.max(1)
        open_ = worst >= np.uint64((rank + 1) << 56) if rank < 255 else np.zeros(len(sets), bool)
        stay = open_[owner]
        if not stay.any():
            break
        if not stay.all():
            element, owner, order = element[stay], owner[stay], order[stay]
            at = np.arange(len(element))
    return out


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    n, places = signature.shape
    grouped = signature.reshape(n, places // band, band)
    key = np.broadcast_to(np.arange(places // band, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (n, places // band)).copy()
    for k in range(band):
        key = mix64(key * np.uint64(5) + grouped[:, :, k])
    return key.view(np.int64)


def _described(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``docs`` with nd_n (set size), nd_class (128-bit hash of the set) and nd_bands."""

    def make():
        def work(texts):
            counts, classes, bands = [], [], []
            for _, part in slices(texts.to_pylist()):
                sets = shingle_sets(part, width)
                keys = band_keys(superminhash(sets))
                for s, k in zip(sets, keys, strict=True):
                    counts.append(len(s))
                    classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(k)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            n = PLACES // BAND
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))
            return [counts, classes, lists]

        return work

    added = T.StructType([T.StructField("nd_n", T.LongType()), T.StructField("nd_class", T.BinaryType()), T.StructField("nd_bands", T.ArrayType(T.LongType()))])
    return append_columns(docs, [text], added, make)


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(node, nd_set): the full sets as bytes of sorted 64-bit hashes."""

    def make():
        def work(texts):
            return [[s.tobytes() for _, part in slices(texts.to_pylist()) for s in shingle_sets(part, width)]]

        return work

    return append_columns(docs, [text], T.StructType([T.StructField("nd_set", T.BinaryType())]), make).drop(text)


def _linked(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links among ``sets``."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if _linked(np.array([common]), len(sets[0]), np.array([len(sets[1])]), percent)[0] else []
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    begin = np.flatnonzero(fresh)
    length = np.diff(np.concatenate([begin, [len(flat)]]))
    forest, out, left = _Forest(n), [], n - 1
    for i in range(n):
        at = np.searchsorted(flat[begin], sets[i])
        b, c = begin[at], length[at]
        places = np.repeat(b - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        common = np.bincount(owner[places], minlength=n)
        common[: i + 1] = 0
        near = np.flatnonzero((common > 0) & _linked(common, len(sets[i]), sizes, percent))
        for j in near.tolist():
            if forest.join(i, j):
                out.append((i, j))
                left -= 1
        if not left:
            break
    return out


def _verify_clusters(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside clusters; ``members`` is (cluster, node, nd_set), sorted by cluster within partitions."""

    def run(batches):
        name, nodes, sets = None, [], []
        left, right = [], []

        def close():
            if len(sets) > 1:
                for i, j in _links_within(sets, percent):
                    left.append(nodes[i])
                    right.append(nodes[j])

        for batch in batches:
            for cluster, node, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if cluster != name:
                    close()
                    name, nodes, sets = cluster, [], []
                nodes.append(node)
                sets.append(np.frombuffer(data, np.uint64))
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("node").alias("a"), F.col("nd_set").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("nd_set").alias("sb"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verify_blocks(apart: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between the members of each block and the outsiders of each slice, one per outsider and group of members."""

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        nodes = left.column("node").to_numpy()
        groups = left.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in left.column("nd_set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        length, values = np.diff(np.concatenate([begin, [len(flat)]])), flat[begin]
        a, b = [], []
        for node, group, data in zip(right.column("node").to_pylist(), right.column("component").to_pylist(), right.column("nd_set").to_pylist(), strict=True):
            own = np.frombuffer(data, np.uint64)
            at = np.searchsorted(values, own)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own)]
            c = length[at]
            places = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum()) if len(at) else np.zeros(0, np.int64)
            common = np.bincount(owner[places], minlength=len(sets))
            near = np.flatnonzero(_linked(common, len(own), sizes, percent) & (groups != group))
            for j in near[np.unique(groups[near], return_index=True)[1]].tolist() if len(near) else []:
                a.append(node)
                b.append(int(nodes[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("cluster", "block", "slice").cogroup(apart.groupBy("cluster", "block", "slice")).applyInArrow(run, "a long, b long")


def _large_cluster_links(bands: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside clusters that are too large for one task. ``large`` is (node, cluster, nd_n, cluster_n)."""
    own = bands.join(large.select("node"), "node", "left_semi")
    # A hub per band key: a member chosen by hash, so a node meets other hubs in other bands.
    hubs = own.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), F.col("node").alias("n"))).alias("x")).select("key", F.col("x.n").alias("b"))
    # Where both sides of a join are tables, Spark can split a frequent key.
    pairs = materialize(own, "own-bands").join(materialize(hubs, "hubs"), "key").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n")).where("n >= 2").select("a", "b")
    pairs = materialize(pairs, "hub-pairs")
    # pairs that share one band only are met again below, in the blocks
    links = materialize(_verify_pairs(pairs, sets, percent), "hub-links")
    groups = connected_components(links, "hub-groups")
    placed = large.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    weight = placed.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = weight.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    size = F.ceil(F.col("cluster_n") / BLOCK_SHINGLES).cast("int")
    placed = materialize(materialize(placed, "grouped").join(materialize(main, "main"), "cluster").withColumn("blocks", size), "placed")
    outside = placed.where("component <> main").groupBy("cluster").agg(F.ceil(F.sum("nd_n") / BLOCK_SHINGLES).cast("int").alias("slices"))
    placed = materialize(placed.join(materialize(outside, "slices"), "cluster"), "outside")  # clusters without outsiders are done
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.withColumn("block", dealt(1, "blocks")).withColumn("slice", each("slices")).select("cluster", "block", "slice", "node", "component").join(sets, "node")
    apart = placed.where("component <> main").withColumn("slice", dealt(2, "slices")).withColumn("block", each("blocks")).select("cluster", "block", "slice", "node", "component").join(sets, "node")
    # fresh column ids, as both sides come from one table
    return links.union(_verify_blocks(apart.toDF(*apart.columns), members, percent))


def find_groups(docs: DataFrame, text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, nd_n (set size), nd_component (smallest id of the group)."""
    seen = materialize(_described(docs.select("doc_id", text), text, width).drop(text), "signatures")
    classes = seen.where(F.col("nd_class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("nd_class")
    classes = materialize(classes.agg(F.min("doc_id").alias("node"), F.first("nd_n").alias("nd_n"), F.first("nd_bands").alias("nd_bands")), "classes")
    bands = classes.select("node", F.explode("nd_bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("key", "hub")
    bands = materialize(bands.join(shared, "key"), "bands")
    clusters = connected_components(bands.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), "clusters")
    clusters = clusters.withColumnRenamed("component", "cluster")
    sized = clusters.join(classes.groupBy("node").agg(F.max("nd_n").alias("nd_n")), "node")
    total = sized.groupBy("cluster").agg(F.sum("nd_n").alias("cluster_n"))
    sized = materialize(sized.join(total, "cluster"), "sized")
    # Full sets of the texts in clusters only; where their ids are few the texts need not be shuffled.
    firsts = classes.select(F.col("node").alias("doc_id"), F.col("nd_class").alias("need")).join(sized.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    n_ids = firsts.count()
    wanted = docs.select("doc_id", text)
    ids = firsts.select("doc_id").distinct()
    wanted = wanted.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = _sets(wanted.withColumnRenamed("doc_id", "node"), text, width)
    sets = materialize(sets.where(F.length("nd_set") > 0), "sets")
    small = sized.where(F.col("cluster_n") <= CLUSTER_SHINGLES).select("node", "cluster").join(sets, "node")
    small = small.repartition("cluster").sortWithinPartitions("cluster").select("cluster", "node", "nd_set")
    links = _verify_clusters(small, percent)
    large = sized.where(F.col("cluster_n") > CLUSTER_SHINGLES)
    if large.limit(1).count():
        links = links.union(_large_cluster_links(bands.select("node", "key"), large, sets, percent))
    # an id with several texts links their classes
    twin = seen.where(F.col("nd_class").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "nd_class").join(classes.select("nd_class", "node"), "nd_class")
    own = materialize(twin.select("doc_id", "node").distinct(), "own")
    links = links.union(own.where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = materialize(links.where("a <> b").distinct(), "links")
    release(bands, sized, sets)
    groups = connected_components(links, "groups")
    release(links)
    mapped = own.groupBy("doc_id").agg(F.min("node").alias("node")).join(groups, "node", "left")
    mapped = mapped.select("doc_id", F.coalesce("component", "node").alias("nd_component"))
    out = seen.select("doc_id", "nd_n").join(mapped, "doc_id", "left")
    return out.withColumn("nd_component", F.coalesce("nd_component", "doc_id"))


def near_duplicate_table(docs: DataFrame, width: int = 4) -> DataFrame:
    out = find_groups(docs.select("doc_id", "text"), width=width)
    return out.select("doc_id", F.col("nd_n").alias("n_shingles"), F.col("nd_component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("nd_component")).alias("kept"))


def keep_one_per_group(docs: DataFrame, text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id; rows with one id stay or go together."""
    found = find_groups(docs, text, width, percent)
    gone = materialize(found.where(F.col("doc_id") != F.col("nd_component")).select("doc_id").distinct(), "gone")
    # ids only, and only while they are few; otherwise both sides are shuffled
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
