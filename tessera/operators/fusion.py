"""Reciprocal rank fusion, seeds, neighbours, dedup and packing under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
CANDIDATES = 20
SEEDS = 5
TOKEN_BUDGET = 2000
#: What is searched for beside a topic.
QUERY_TEMPLATES = ("explained technical", "failure modes limitations production", "implementation Python example")
MIN_SOURCES, MIN_MEAN_SCORE = 3, 0.5


def rrf(dense: DataFrame, lexical: DataFrame, k: int = SEEDS, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, unit_id, rrf_score, dense_rank, bm25_rank, rank); ranks start at 1, the formula counts from 0."""
    one = lambda df, c: df.where(F.col("rank") <= candidates).select("query_id", "unit_id", F.lit(c).alias("channel"), "rank")
    both = one(dense, "dense").unionByName(one(lexical, "bm25"))
    fused = both.groupBy("query_id", "unit_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank") - 1)).alias("rrf_score"),
        F.min(F.when(F.col("channel") == "dense", F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("channel") == "bm25", F.col("rank"))).alias("bm25_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "unit_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rrf_score", F.round("rrf_score", 8))


def candidate_pool(dense: DataFrame, lexical: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """Union of both channels with each one's rank and score."""
    one = lambda df, c: df.where(F.col("rank") <= candidates).select("query_id", "unit_id", F.col("rank").alias(f"{c}_rank"), F.col("score").alias(f"{c}_score"))
    return one(dense, "dense").join(one(lexical, "bm25"), ["query_id", "unit_id"], "full_outer")


def with_neighbours(units: DataFrame, document: str = "document", start: str = "start", unit_id: str = "unit_id") -> DataFrame:
    """Units with reading order and the ids before and after, never across documents."""
    order = Window.partitionBy(document).orderBy(start, unit_id)
    return units.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("prev_id", F.lag(unit_id).over(order)).withColumn("next_id", F.lead(unit_id).over(order))


def expand(seeds: DataFrame, linked: DataFrame) -> DataFrame:
    """(query_id, seed_rank, pos, relation, unit_id): the unit before, the seed and the unit after."""
    link = linked.select("unit_id", "prev_id", "next_id")
    grouped = seeds.select("query_id", F.col("rank").alias("seed_rank"), "unit_id").join(link, "unit_id")
    members = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("PREVIOUS").alias("relation"), F.col("prev_id").alias("unit_id")),
        F.struct(F.lit(1).alias("pos"), F.lit("SEED").alias("relation"), F.col("unit_id").alias("unit_id")),
        F.struct(F.lit(2).alias("pos"), F.lit("NEXT").alias("relation"), F.col("next_id").alias("unit_id")),
    )
    flat = grouped.select("query_id", "seed_rank", F.explode(members).alias("m")).select("query_id", "seed_rank", "m.*")
    return flat.where(F.col("unit_id").isNotNull())


def first_seen(expanded: DataFrame) -> DataFrame:
    """One row per query and unit, the first in group order; a later seed that was a neighbour before stays a neighbour."""
    order = Window.partitionBy("query_id", "unit_id").orderBy("seed_rank", "pos")
    counted = expanded.withColumn("_r", F.row_number().over(order)).withColumn("seen", F.count("*").over(Window.partitionBy("query_id", "unit_id")))
    return counted.where("_r = 1").drop("_r")


def pack(rows: DataFrame, budget: int = TOKEN_BUDGET, seed_first: bool = True, extra_order: tuple[str, ...] = (), fail_over_budget: bool = True) -> DataFrame:
    """``rows`` (query_id, seed_rank, pos, relation, unit_id, tokens) with ``packed`` and ``packed_order``.

    Seeds come first, then neighbours by group; a row that does not fit is
    skipped and later ones are still tried. The fold runs over one query's rows
    (a few per seed) with built-in functions. A query whose seeds alone exceed
    the budget fails, or, if it is not to fail, packs nothing and is marked ``over_budget``.
    """
    first = F.when(F.col("relation") == "SEED", 0).otherwise(1) if seed_first else F.lit(0)
    order = F.struct(first.alias("o"), "seed_rank", *extra_order, "pos", "unit_id", F.col("tokens").cast("long").alias("tokens"), "relation")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, row: Column) -> Column:
        fits = acc["used"] + row["tokens"] <= budget
        used = F.when(fits, acc["used"] + row["tokens"]).otherwise(acc["used"])
        kept = F.when(fits, F.array_append(acc["kept"], row["unit_id"].cast("bigint"))).otherwise(acc["kept"])
        return F.struct(used.alias("used"), kept.alias("kept"))

    folded = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    folded = folded.withColumn("fold", F.aggregate("rows", start, step))
    if seed_first:
        seeds = F.aggregate(F.filter("rows", lambda r: r["relation"] == "SEED"), F.lit(0).cast("long"), lambda a, r: a + r["tokens"])
        folded = folded.withColumn("over", seeds > budget)
        none = F.raise_error(F.lit("seeds exceed the token budget")) if fail_over_budget else start
        folded = folded.withColumn("fold", F.when(~F.col("over"), F.col("fold")).otherwise(none))
    else:
        folded = folded.withColumn("over", F.lit(False))
    flat = folded.select("query_id", "fold", F.col("over").alias("over_budget"), F.explode("rows").alias("r")).select("query_id", "over_budget", "r.seed_rank", "r.pos", "r.relation", "r.unit_id", "r.tokens", F.array_position("fold.kept", F.col("r.unit_id").cast("bigint")).alias("at"))
    return flat.withColumn("packed", F.col("at") > 0).withColumn("packed_order", F.when(F.col("at") > 0, F.col("at") - 1)).drop("at")


def seeds_kept(packed: DataFrame) -> DataFrame:
    """Violations of the rule that surviving seeds are packed."""
    return packed.where((F.col("relation") == "SEED") & ~F.col("packed"))


def clip_groups(rows: DataFrame, limit: int, keys: tuple[str, ...] = ("query_id", "seed_rank"), order: tuple[str, ...] = ("pos", "unit_id"), text: str = "text") -> DataFrame:
    """Cumulative character budget per group: each text gets what is left, and goes once nothing is."""
    before = F.sum(F.length(text)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = F.lit(limit) - F.coalesce(before, F.lit(0))
    return rows.withColumn("_left", left).where("_left > 0").withColumn("clipped", F.substr(F.col(text), F.lit(1), F.col("_left"))).drop("_left")


def seed_runs(packed: DataFrame) -> DataFrame:
    """Consecutive rows of one seed rank as groups (a rank may come twice): gaps and islands over packed order."""
    order = Window.partitionBy("query_id").orderBy("packed_order")
    new = (~F.lag("seed_rank").over(order).eqNullSafe(F.col("seed_rank"))).cast("int")
    return packed.where("packed").withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).drop("_new")


def needs_refresh(sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, action): too few sources, or too low a mean score, ask for a new search."""
    few = (F.col("n") < MIN_SOURCES) | (F.coalesce(F.col("_mean"), F.lit(0.0)) < MIN_MEAN_SCORE)
    return sources.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("_mean")).select(*keys, "n", F.when(few, "refresh").otherwise("keep").alias("action"))
