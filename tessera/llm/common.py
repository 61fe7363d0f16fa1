"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_map import bound_batches

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: Separator classes, as Java and RE2 read them.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(col, _UPPER, _LOWER)


def words_of(col: Column, separators: str) -> Column:
    """Array of the non-empty pieces between separators; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), separators), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    A plain reference inside another lambda could be inlined by the optimizer
    and then evaluated once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else (tests) one of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors; they are removed when the driver ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_remove_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` whose readers have all been written."""
    for table in tables:
        _remove(table.sparkSession, table.tessera_path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        _remove(spark, path)


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


#: A node with more links than this, and than 1/50,000 of all links, is a hub: there are 100,000 hubs at most.
HUB_LINKS = 1_000
MAX_HUBS = 100_000


def _with_lowest(links: DataFrame, lowest: DataFrame, n_links: int) -> DataFrame:
    """``links(a, b)`` with the ``m`` of their ``a`` from ``lowest(a, m, n)``, n being the number of links of a.

    The links of a hub stay where they are, as its row goes to all tasks; the others are joined by shuffle.
    """
    least = max(HUB_LINKS, 2 * n_links // MAX_HUBS)
    hubs = F.broadcast(lowest.where(F.col("n") > least).select("a", "m"))  # the degrees sum to 2 * n_links, so MAX_HUBS rows at most, or 2 * n_links / HUB_LINKS
    others = links.join(hubs, "a", "left_anti").join(lowest.where(F.col("n") <= least).select("a", "m"), "a")
    return links.join(hubs, "a").union(others)


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star rewiring. Each round is two grouped
    minima (combined on the map side) and joins in which the links of a hub are
    not gathered; each round is written to the shared folder, so lineage stays
    short. Links never reach the driver, which only sees one checksum a round.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = (cur.count(),)
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = _with_lowest(both.where("b > a"), low, last[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.union(cur).where("a > b").distinct(), name)
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_lowest(large, lower, last[0])
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = materialize(small.where("a > b").distinct(), name)
        release(cur, large)
        cur, sums = nxt, tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == last:
            break
        last = sums
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
