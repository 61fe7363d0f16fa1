"""Keyed tables: upsert, delete, journal and cache as plans over immutable DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` must be total."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def delete_where(base: DataFrame, predicate: Column) -> DataFrame:
    return base.where(~F.coalesce(predicate, F.lit(False)))


def delete_counts(base: DataFrame, predicate: Column) -> DataFrame:
    hit = F.coalesce(predicate, F.lit(False))
    return base.agg(F.count("*").alias("before"), F.count_if(~hit).alias("after"), F.count_if(hit).alias("deleted"))


def reserve_once(journal: DataFrame, requests: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Requests that may be entered: the first of each key that the journal does not hold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = requests.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.join(journal.select(*keys).distinct(), keys, "left_anti")


def answer_reserved(journal: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """One transition, reserved to responded; rows in any other state stay."""
    told = answers.select(*keys).distinct().withColumn("_told", F.lit(True))
    out = journal.join(told, keys, "left")
    return out.withColumn("state", F.when((F.col("state") == "reserved") & F.col("_told"), "responded").otherwise(F.col("state"))).drop("_told")


def cache_key(query: Column, n: Column) -> Column:
    return F.md5(F.concat(query, F.lit(": "), n.cast("string")).cast("binary"))


def fresh(stored: Column, now: Column, days: int = 7) -> Column:
    """Age in whole days not above ``days``."""
    return F.floor((now.cast("double") - stored.cast("double")) / 86400) <= days


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, worked out once, written to a new shared folder and read from there."""
    from .snapshots import scratch

    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
