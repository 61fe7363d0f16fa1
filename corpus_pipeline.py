"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Empty tables, null texts and extra columns of
any name pass through all stages. The last stage adds size, source_size, target,
copies and taken; where documents have a column of such a name, the added one is
called ``mx_<name>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.decontaminate import find_contamination
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.near_dedup import keep_one_per_group
from tessera.llm.source_mix import mix_sources
from tessera.llm.toxicity import score_toxicity, train, training_texts

NEAR_WIDTH = 5
TOXIC_FROM = 0.5


#: Columns that stages read or change; others are hidden from the operators, which add columns of their own.
READ = ("doc_id", "text", "source", "n_chars")
MIXED = {"mx_size": "size", "mx_source_size": "source_size", "mx_target": "target", "mx_copies": "copies", "mx_taken": "taken"}


def _hiding(stage):
    """The stage sees extra columns under names that no operator uses and gives them back."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        hidden = docs.toDF(*[n if n in READ else f"cp_{k}" for k, n in enumerate(names)])
        out = stage(spark, hidden, sf_dir)
        added = [c for c in out.columns if c not in hidden.columns]
        taken = {n.lower() for n in names}
        free = {}
        for c in added:
            new = MIXED.get(c, c)
            while new.lower() in taken:
                new = f"mx_{new}"
            taken.add(new.lower())
            free[c] = new
        return out.select(*hidden.columns, *added).toDF(*names, *free.values())

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_hiding
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_toxicity(docs, train(*training_texts(docs, labels)))
    return scored.where(F.col("tx_score") < TOXIC_FROM).select(*docs.columns)


@_hiding
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many documents are cut; null texts stay null, n_chars follows the text."""
    marked = docs.withColumn("cp_null", F.col("text").isNull())
    out = drop_repeated_lines(marked).withColumn("text", F.when(~F.col("cp_null"), F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("ld_n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_hiding
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one_per_group(docs, width=NEAR_WIDTH).select(*docs.columns)


@_hiding
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_contamination(docs, benchmark).where(F.col("dc_n_hit") == 0).select(*docs.columns)


@_hiding
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often each is taken."""
    out = mix_sources(docs).where(F.col("mx_copies") > 0)
    return out.select(*docs.columns, *MIXED)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: The toxicity model and the near-duplicate groups are not SQL; tests/llm/test_pipeline.py works every stage out by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
