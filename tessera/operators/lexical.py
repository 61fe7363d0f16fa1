"""Inverted index and BM25 as tables: postings, document lengths, document frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


#: Words of queries are sent to all tasks up to so many, and shuffled beyond.
BROADCAST_TERMS = 1_000_000


@dataclass(frozen=True)
class LexicalIndex:
    split: DataFrame  # unit_id, len, t: a unit's words, which stand in one row
    terms: DataFrame  # term, df, cf


def build_index(units: DataFrame, unit_id: str = "unit_id", text: str = "text") -> LexicalIndex:
    """Units without tokens count as units of length 0.

    A unit's words are sorted in its row, so that one grouping by word, combined on
    the map side, gives both how often a word stands and in how many units.
    """
    split = units.select(F.col(unit_id).alias("unit_id"), tokens(F.col(text)).alias("t")).select("unit_id", F.size("t").cast("long").alias("len"), "t")
    first = lambda s: F.transform(s, lambda w, i: F.struct(w.alias("term"), (F.when(i == 0, True).otherwise(F.get(s, i - 1) != w)).cast("int").alias("first")))
    each = split.select(F.explode(let(F.array_sort("t"), first)).alias("x")).select("x.*")
    return LexicalIndex(split, each.groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf")))


def _word_counts(split: DataFrame, asked: DataFrame) -> DataFrame:
    """(unit_id, len, term, tf) of the words that stand in ``asked``, dealt out by unit, so that what follows by unit is not shuffled again.

    The outer form keeps the optimizer from writing the array's expression into a filter below, where all texts would be split again.
    """
    words = split.select("unit_id", "len", F.explode_outer("t").alias("term")).join(asked, "term", "left_semi")
    return words.repartition("unit_id").groupBy("unit_id", "len", "term").agg(F.count("*").alias("tf"))


def bm25_scores(index: LexicalIndex, queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, unit_id, score); repeated query words count again, unknown words add nothing, zero scores go.

    idf is ln(N - df + 0.5) - ln(df + 0.5), negatives replaced by EPSILON times the mean over all terms. One pass over the
    units gives document frequencies, N and the mean length, which are written down; a second one scores, and words that no
    query has are left out where the unit's row is, before anything is shuffled.
    """
    from ..sources.snapshots import scratch

    spark = queries.sparkSession
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    few = wanted.count() <= BROADCAST_TERMS
    first = F.coalesce("nth", F.lit(0)) == 0
    words = index.split.select("len", F.posexplode_outer(F.array_distinct("t")).alias("nth", "term"))
    path = scratch(spark, "terms")
    words.groupBy("term").agg(F.count("*").alias("df"), F.count_if(first).alias("units"), F.sum(F.when(first, F.col("len")).otherwise(0)).alias("lens")).write.parquet(path)
    stats = spark.read.schema("term string, df long, units long, lens long").parquet(path)  # a unit without words has a row of no term
    n, average = stats.agg(F.sum("units"), F.sum("lens") / F.sum("units")).first()
    raw = stats.where("term is not null").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    weights = raw.select("term", F.when(F.col("raw") < 0, EPSILON * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))
    asked = wanted.join(weights, "term")
    terms = asked.select("term").distinct()
    hit = _word_counts(index.split, F.broadcast(terms) if few else terms).join(F.broadcast(asked) if few else asked, "term")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return hit.groupBy("query_id", "unit_id").agg(F.sum(F.col("qtf") * part).alias("score")).where("score <> 0")


def top_k(scores: DataFrame, k: int, query_id: str = "query_id", unit_id: str = "unit_id", score: Column | None = None) -> DataFrame:
    """Rank from 1 by score, then id. Scores are compared at nine decimals, so equal texts tie in any summation order."""
    value = F.round(score if score is not None else F.col("score"), 9)
    order = Window.partitionBy(query_id).orderBy(value.desc(), F.col(unit_id))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
