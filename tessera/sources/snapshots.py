"""Tables in key-hash buckets with snapshots: a change rewrites the buckets it touches, and readers see one snapshot.

A table's folder holds ``data/<version>/bucket=<k>`` and pointers. A pointer is a small
file for each generation, put there by a rename that refuses a generation that
exists; so of two writers that start from one generation one fails, and a
reader holds either the old or the new list of buckets. Only this list, as long as
there are buckets, passes through the driver. Old files stay for their readers
until ``vacuum``.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StaleGeneration(ValueError):
    """Another writer has moved the pointer meanwhile."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, else (local runs) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def generation(spark: SparkSession, path: str, name: str = "current") -> int:
    """The newest generation of a pointer, 0 if there is none."""
    found = [n for n in _names(spark, f"{path}/pointers") if n.startswith(f"{name}.")]
    return int(found[-1].rsplit(".", 1)[1]) if found else 0


def resolve(spark: SparkSession, path: str, name: str = "current", at: int | None = None) -> dict:
    """What a pointer holds, now or at a generation."""
    at = generation(spark, path, name) if at is None else at
    target, fs = _fs(spark, f"{path}/pointers/{name}.{at:012d}")
    if not at or not fs.exists(target):
        raise ValueError(f"no pointer is named {name} at {path}")
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def point(spark: SparkSession, path: str, held: dict, expected: int, name: str = "current") -> int:
    """Move a pointer from generation ``expected`` to the next one; refused if it isn't at ``expected`` any more."""
    if generation(spark, path, name) != expected:
        raise StaleGeneration(f"{name} is at generation {generation(spark, path, name)}, not {expected}")
    jvm = spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
    out.close()
    place, _ = _fs(spark, f"{path}/pointers/{name}.{expected + 1:012d}")
    fs.mkdirs(place.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, options)
    except Exception as refused:
        raise StaleGeneration(f"{name} was moved to generation {expected + 1} by another writer") from refused
    return expected + 1


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, keys: list[str], n: int) -> str:
    version = uuid.uuid4().hex
    rows.withColumn("bucket", _bucket(keys, n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{version}")
    return version


def _held(spark: SparkSession, path: str, version: str) -> dict[str, str]:
    return {n.split("=")[1]: version for n in _names(spark, f"{path}/data/{version}") if n.startswith("bucket=")}


def create_table(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> int:
    """Write ``rows`` in buckets by the hash of ``keys`` as the table's first snapshot."""
    spark = rows.sparkSession
    version = _write(rows, path, keys, buckets)
    return point(spark, path, {"keys": keys, "n": buckets, "schema": rows.schema.json(), "buckets": _held(spark, path, version)}, 0)


def _rows(spark: SparkSession, path: str, held: dict, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(held["schema"]))
    folders = [f"{path}/data/{v}/bucket={k}" for k, v in sorted(held["buckets"].items()) if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The rows of one snapshot, the newest unless a generation is given."""
    return _rows(spark, path, resolve(spark, path, at=at))


def read_key(spark: SparkSession, path: str, values: dict) -> DataFrame:
    """Rows of one key: only its bucket is read."""
    held = resolve(spark, path)
    schema = StructType.fromJson(json.loads(held["schema"]))
    one = spark.range(1).select(*[F.lit(values[k]).cast(schema[k].dataType).alias(k) for k in held["keys"]])
    own = one.select(_bucket(held["keys"], held["n"])).first()[0]
    return _rows(spark, path, held, [own]).join(F.broadcast(one), held["keys"], "left_semi")  # one row


def change_table(path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, expected: int | None = None) -> int:
    """Replace the rows of the keys in ``upserts`` and drop those of the keys in ``deletes``; returns the new generation.

    Only buckets that hold one of the keys are read and written again. ``expected`` is
    the generation that the change was made for.
    """
    spark = (upserts if upserts is not None else deletes).sparkSession
    at = generation(spark, path) if expected is None else expected
    held = resolve(spark, path, at=at)
    keys, n = held["keys"], held["n"]
    parts = [x.select(*keys) for x in (upserts, deletes) if x is not None]
    gone = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    touched = [r[0] for r in gone.select(_bucket(keys, n).alias("b")).distinct().collect()]  # as many as there are buckets at most
    old = _rows(spark, path, held, touched)
    new = old.join(gone.distinct(), keys, "left_anti")
    if upserts is not None:
        new = new.unionByName(upserts.select(*old.columns))
    version = _write(new, path, keys, n)
    buckets = {k: v for k, v in held["buckets"].items() if int(k) not in touched} | _held(spark, path, version)
    return point(spark, path, held | {"buckets": buckets}, at)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove bucket folders that none of the newest ``keep`` snapshots holds; returns how many went."""
    newest = generation(spark, path)
    held = {(v, k) for at in range(max(1, newest - keep + 1), newest + 1) for k, v in resolve(spark, path, at=at)["buckets"].items()}
    gone = 0
    for version in _names(spark, f"{path}/data"):
        for name in _names(spark, f"{path}/data/{version}"):
            if name.startswith("bucket=") and (version, name.split("=")[1]) not in held:
                target, fs = _fs(spark, f"{path}/data/{version}/{name}")
                gone += bool(fs.delete(target, True))
    return gone
