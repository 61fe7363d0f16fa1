"""Index tables: compile and write, availability, scans with checks, rebuilds, updates, named pointers, run records."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import markdown, units as checks
from . import snapshots
from .tables import fingerprint

#: Columns of a unit that a payload may lack, with their types.
OPTIONAL = {"heading_path": "array<string>", "structural_segments": "array<string>", "previous_chunk_id": "string", "next_chunk_id": "string", "packing_version": "string"}
REQUIRED = ("chunk_id", "document_id", "document_version", "retrieval_text", "reading_order_ordinal")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def index_available(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/units") and exists(spark, f"{path}/manifest")


def compile_units(docs: DataFrame, limit: int = markdown.UNIT_TOKENS, text: str = "text", name: Column | None = None) -> DataFrame:
    """Documents to retrieval units with their texts and the units before and after."""
    packed = markdown.pack_units(markdown.split_blocks(markdown.markdown_blocks(docs, text, name), limit), limit)
    out = markdown.unit_texts(packed, docs, text).withColumn("retrieval_start", F.coalesce("overlap_start", "core_start"))
    return checks.attach_neighbours(out)


def compile_and_write(docs: DataFrame, path: str, text: str = "text", name: Column | None = None) -> DataFrame:
    """Compile documents to linked units and write them beside a manifest with count, fingerprint and time; returns the manifest."""
    units = compile_units(docs, text=text, name=name)
    units.write.mode("overwrite").parquet(f"{path}/units")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{path}/units")
    fingerprint(written, "unit_id").withColumn("created_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The units of an index; fails if they are not those that its manifest was written for."""
    units = spark.read.parquet(f"{path}/units")
    want, got = spark.read.json(f"{path}/manifest").first(), fingerprint(units, "unit_id").first()
    if want is None or (want["n"], want["fingerprint"]) != (got["n"], got["fingerprint"]):
        raise ValueError(f"the units at {path} are not those of its manifest")
    return units


def payload_to_unit(points: DataFrame) -> DataFrame:
    """Points as units: required columns as they are, optional ones filled where the table lacks them."""
    have = set(points.columns)
    lists = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    filled = [F.coalesce(F.col(c), lists(k)).alias(c) if c in have else lists(k).alias(c) for c, k in OPTIONAL.items()]
    return points.select(*[c for c in points.columns if c not in OPTIONAL], *filled)


def payload_errors(points: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(rule, key): points that lack a field, ids that stand twice, documents of several versions."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    missing = points.where(lacking).select(F.lit("missing_field").alias("rule"), F.col("chunk_id").alias("key"))
    twice = points.groupBy("chunk_id").count().where("count > 1").select(F.lit("duplicate_chunk").alias("rule"), F.col("chunk_id").alias("key"))
    versions = points.groupBy("document_id").agg(F.count_distinct("document_version").alias("n")).where("n > 1").select(F.lit("conflicting_versions").alias("rule"), F.col("document_id").alias("key"))
    return missing.unionByName(twice).unionByName(versions)


def scan_points(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """All points of a table; fails if there are none or one breaks a rule."""
    points = spark.read.parquet(path)
    if points.isEmpty():
        raise ValueError(f"no points at {path}")
    broken = payload_errors(points, required).first()
    if broken is not None:
        raise ValueError(f"{broken['rule']}: {broken['key']}")
    return points


def full_rebuild(units: DataFrame, path: str) -> int:
    """Write the table anew and return how many rows it has; fails if that is not how many were given."""
    want = units.count()
    units.write.mode("overwrite").parquet(path)
    got = units.sparkSession.read.parquet(path).count()
    if got != want:
        raise ValueError(f"{got} rows were written of {want}")
    return got


def units_of_document(points: DataFrame, document_id: str, version: str | None = None) -> DataFrame:
    mine = points.where(F.col("document_id") == document_id)
    return mine if version is None else mine.where(F.col("document_version") == version)


def update_document(points: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the documents in ``new`` are replaced by those of ``new``."""
    return points.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new.select(*points.columns))


def point_alias(spark: SparkSession, root: str, name: str, path: str, expected: int | None = None) -> int:
    """Let a name under ``root`` stand for the table at a path, which must be there; returns the name's generation.

    The name is a file, so every session resolves it. It is moved in one step, and only from the generation ``expected``.
    """
    if not exists(spark, path):
        raise ValueError(f"no table at {path}")
    return snapshots.point(spark, root, {"path": path}, snapshots.generation(spark, root, name) if expected is None else expected, name)


def resolve_alias(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table a name stands for; never another one."""
    return spark.read.parquet(snapshots.resolve(spark, root, name)["path"])


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """One run's record as JSON in a folder of its run."""
    if not record.get("run_id"):
        raise ValueError("a record needs a run_id")
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run_id={record['run_id']}")


def read_record(spark: SparkSession, path: str, run_id: str, topic: str) -> dict:
    """Exactly the record of a run on a topic."""
    where = f"{path}/run_id={run_id}"
    if not exists(spark, where):
        raise ValueError(f"no record of run {run_id}")
    record = json.loads(spark.read.text(where).first()["value"])
    if record.get("run_id") != run_id or record.get("topic") != topic:
        raise ValueError("the record is of another run or topic")
    return record


#: Codes of ``accept_index`` in the order in which they are checked; the first that applies is the answer.
ACCEPTANCE = ("no_manifest", "bad_config", "no_units", "bad_count", "missing_field", "broken_topology", "bad_fingerprint")


def accept_index(spark: SparkSession, path: str, config: dict, required: tuple[str, ...] = ("unit_id", "doc_id", "retrieval_text")) -> tuple[DataFrame | None, str | None]:
    """The units of an index with no code, or no units with the first code of ``ACCEPTANCE`` that applies.

    The manifest must hold each item of ``config``. One pass over the units takes all
    other measures: count, fields that are null, the fingerprint, and sums of hashes of forward and backward
    links, which are equal if every link leads back.
    """
    if not index_available(spark, path):
        return None, "no_manifest"
    manifest = spark.read.json(f"{path}/manifest").first()
    if manifest is None or {"n", "fingerprint"} - set(manifest.asDict()):
        return None, "no_manifest"
    if any(manifest.asDict().get(k) != v for k, v in config.items()):
        return None, "bad_config"
    units = spark.read.parquet(f"{path}/units")
    lacking = [c for c in required if c not in units.columns]
    record = F.sha2(F.to_json(F.struct(*sorted(units.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(record, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"part{k}") for k in range(5)]
    null = F.lit(bool(lacking))
    for c in required:
        if c not in lacking:
            null = null | F.col(c).isNull()
    linked = {"unit_id", "previous_id", "next_id"} <= set(units.columns)
    edge = lambda a, b: F.coalesce(F.sum(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.xxhash64(a, b).cast("decimal(38,0)"))), F.lit(0)).cast("string")
    links = [edge("unit_id", "next_id").alias("ahead"), edge("previous_id", "unit_id").alias("back")] if linked else [F.lit("").alias("ahead"), F.lit("").alias("back")]
    seen = Observation(f"acceptance-{uuid.uuid4().hex}")
    key = F.count("unit_id") if "unit_id" in units.columns else F.lit(0)
    units.observe(seen, F.count(F.lit(1)).alias("n"), key.alias("keys"), F.count_if(null).alias("null"), *parts, *links).write.format("noop").mode("overwrite").save()
    got = seen.get
    print_ = hashlib.sha256(":".join([str(got["keys"]), *[got[f"part{k}"] or "" for k in range(5) if got[f"part{k}"] is not None]]).encode()).hexdigest()
    tests = ((got["n"] == 0, "no_units"), (got["n"] != manifest["n"], "bad_count"), (got["null"] > 0, "missing_field"), (got["ahead"] != got["back"], "broken_topology"), (print_ != manifest["fingerprint"], "bad_fingerprint"))
    code = next((code for broken, code in tests if broken), None)
    return (None, code) if code else (units, None)
