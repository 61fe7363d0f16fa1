"""Declared schemas and readers. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SCHEMA = (
    "chunk_id string, document_id string, document_version_id string, source_path string, reading_order_ordinal int, "
    "previous_chunk_id string, next_chunk_id string, content string, content_token_count int, "
    "source_spans array<struct<source_char_start:int, source_char_end:int, role:string>>"
)
WEB_SCHEMA = "title string, url string, content string, score double"
CLAIM_SCHEMA = (
    "claim_text string, anchor_quote string, section string, claim_type string, material string, materiality_reason_code string, "
    "materiality_rationale string, satisfies_req_ids array<string>, specificity string, requires_citation boolean"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_corpus(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(path, content) of whole text files, stripped, in any depth; blank files go."""
    glob = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    files = files.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^\s+|\s+\z", "").alias("content"))
    return files.where(F.col("content") != "")


def unsupported_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """Paths that ``text_corpus`` leaves out; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(~F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))


def units_jsonl(spark: SparkSession, path: str, schema: str = UNIT_SCHEMA) -> DataFrame:
    """Retrieval units, one JSON object a line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_units(units: DataFrame, path: str) -> None:
    """Units as JSON lines beside a one-row manifest with count and fingerprint."""
    units.write.mode("overwrite").json(f"{path}/units")
    fingerprint(units).write.mode("overwrite").json(f"{path}/manifest")


def fingerprint(units: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(n, fingerprint): order-free digest of canonical records; changes with any value of any row."""
    fields = sorted(units.columns)
    record = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(record, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(5)]
    return units.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count(key).cast("string"), *parts), 256).alias("fingerprint"))


def check_index(units: DataFrame) -> DataFrame:
    """One row per broken rule of a unit table; none if it can be served."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("reading_order_ordinal", "chunk_id")
    linked = units.withColumn("want_prev", F.lag("chunk_id").over(order)).withColumn("want_next", F.lead("chunk_id").over(order))
    bad_links = linked.where(~F.col("previous_chunk_id").eqNullSafe(F.col("want_prev")) | ~F.col("next_chunk_id").eqNullSafe(F.col("want_next"))).select(F.lit("neighbour").alias("rule"), F.col("chunk_id").alias("key"))
    twice = units.groupBy("chunk_id").count().where("count > 1").select(F.lit("duplicate_chunk").alias("rule"), F.col("chunk_id").alias("key"))
    versions = units.groupBy("document_id").agg(F.count_distinct("document_version_id").alias("n")).where("n <> 1").select(F.lit("version").alias("rule"), F.col("document_id").alias("key"))
    return bad_links.unionByName(twice).unionByName(versions)


def web_results(rows: DataFrame) -> DataFrame:
    """Rows of the web-result schema with missing columns filled with null."""
    have = dict(rows.dtypes)
    wanted = [f.split(" ") for f in WEB_SCHEMA.split(", ")]
    return rows.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in wanted])
