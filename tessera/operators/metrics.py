"""Retrieval metrics over ranked lists: (query_id, rank, source) against qrels (query_id, source, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked rows with grade (0 if not relevant) and whether the source is met for the first time."""
    first = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")) == 1
    return ranked.withColumn("first", first).join(qrels.select("query_id", "source", "grade"), ["query_id", "source"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def metrics_at(ranked: DataFrame, qrels: DataFrame, k: int, mrr_k: int = 10) -> DataFrame:
    """One row per query of ``qrels``: hit, recall (distinct sources), precision (slots over k), mrr, ndcg, unique and duplicate sources."""
    rows = judged(ranked, qrels)
    gain = F.when(F.col("first") & (F.col("grade") > 0), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    inside = F.col("rank") <= k
    found = rows.groupBy("query_id").agg(
        F.sum(F.when(inside & (F.col("grade") > 0), 1).otherwise(0)).alias("slots"),
        F.count_distinct(F.when(inside & (F.col("grade") > 0), F.col("source"))).alias("found"),
        F.min(F.when((F.col("rank") <= mrr_k) & (F.col("grade") > 0), F.col("rank"))).alias("first_rank"),
        F.sum(F.when(inside, gain).otherwise(0.0)).alias("dcg"),
        F.count_distinct(F.when(inside, F.col("source"))).alias("unique_sources"),
        F.count_if(inside).alias("n_slots"),
    )
    wanted = qrels.where("grade > 0").groupBy("query_id").agg(F.count_distinct("source").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    out = wanted.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "query_id",
        (zero("found") > 0).alias("hit"),
        F.round(zero("found") / F.col("n_relevant"), 8).alias("recall"),
        F.round(zero("slots") / F.lit(float(k)), 8).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 8).alias("mrr"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal), 8).alias("ndcg"),
        zero("unique_sources").alias("unique_sources"),
        (zero("n_slots") - zero("unique_sources")).alias("duplicate_slots"),
    )


def graded_ndcg(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(2^grade - 1) / log2(rank + 1) against the ideal order of grades."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    got = judged(ranked, qrels).where((F.col("rank") <= k) & F.col("first")).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "source")
    best = qrels.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0)), 8).alias("ndcg"))


def classify(deltas: list[Column]) -> Column:
    """Any loss makes REGRESSED, else any gain IMPROVED, else SAME."""
    worst, best = F.least(*deltas) if len(deltas) > 1 else deltas[0], F.greatest(*deltas) if len(deltas) > 1 else deltas[0]
    return F.when(worst < 0, "REGRESSED").when(best > 0, "IMPROVED").otherwise("SAME")


def occupancy(ranked: DataFrame, k: int) -> DataFrame:
    """Per query: distinct sources, repeated slots and the largest share of one source among the first k."""
    by = ranked.where(F.col("rank") <= k).groupBy("query_id", "source").agg(F.count("*").alias("n"))
    out = by.groupBy("query_id").agg(F.count("*").alias("n_sources"), (F.sum("n") - F.count("*")).alias("repeated"), F.max("n").alias("top"), F.sum("n").alias("slots"))
    return out.select("query_id", "n_sources", "repeated", F.round(F.col("top") / F.col("slots"), 6).alias("max_share"))


def span_recall(covered: DataFrame, empty_gold: float = 0.0) -> DataFrame:
    """(query_id, recall) from (query_id, span_id, covered); ``empty_gold`` is the value of a query without spans."""
    n = F.count("span_id")
    return covered.groupBy("query_id").agg(F.round(F.when(n > 0, F.count_if(F.col("covered")) / n).otherwise(F.lit(empty_gold)), 8).alias("recall"))


def lost_and_gained(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one side has; a query that lost anything is LOST, else GAINED or SAME."""
    left = before.select(*keys).distinct().withColumn("_b", F.lit(1))
    right = after.select(*keys).distinct().withColumn("_a", F.lit(1))
    both = left.join(right, keys, "full_outer")
    out = both.groupBy(keys[0]).agg(F.count_if(F.col("_a").isNull()).alias("lost"), F.count_if(F.col("_b").isNull()).alias("gained"))
    return out.withColumn("change", F.when(F.col("lost") > 0, "LOST").when(F.col("gained") > 0, "GAINED").otherwise("SAME"))


def distribution(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """min, median (averaged), p50 (upper), p95 (nearest rank), max, mean and total."""
    v = F.col(value)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(
        F.count(v).alias("n"),
        F.min(v).alias("low"),
        F.median(v).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.max(v).alias("high"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.sum(v), 6).alias("total"),
    )


def nearest_rank(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Least, middle, 95th and greatest value by nearest rank, and how many there are."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return rows.groupBy(*keys).agg(p(0.5).alias("p50"), F.min(value).alias("low"), F.max(value).alias("high"), p(0.95).alias("p95"), F.count("*").alias("units"))
