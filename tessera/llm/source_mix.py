"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Each source gets a target (weights shared over all words, capped at a multiple
of the source's own words and reshared). Complete epochs are taken first; the
rest is a weighted sample without replacement: every document draws an
exponential key divided by its quality weight and the documents with the
smallest keys are taken while their sizes fit the budget. What is left goes to
the largest later document that fits, or to the next in order if that comes
nearer to the budget.

The prefix sum never sorts a whole source in one task: keys are cut into ranges,
the sizes of the ranges are summed first, and only the one range in which the
budget ends is sorted. The draw is a hash of the id, so reruns agree.

Null text has size 0 and is never needed. A null source is a source of its own,
last in order. Rows with equal ids, null ones included, draw equal keys; ties are
ordered by size, then text hash, then row, so that each is taken by itself. An
empty table gives an empty result. Input columns of added names (``mx_*``) are kept
as ``<name>_in``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_map import make_room
from .common import SPACE_WORD, materialize

WEIGHT_CYCLE = (1, 2, 3)
MAX_REPEATS = 3
RANGES = 4096
#: Tables of one row per source are sent to all tasks up to so many rows, and shuffled beyond.
BROADCAST_SOURCES = 500_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.1 and 1: the share of characters that are not symbols or digits, less for very short texts."""
    length = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    odd = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9#*$%&|<>{}\[\]=_~^\\/@]"))
    return F.greatest(F.lit(0.1), (1 - odd / length) * F.least(F.lit(1.0), size / F.lit(20.0)))


def uniform_draw(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1), from a hash of the id that any SQL engine has."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, cycle=WEIGHT_CYCLE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    With sources in the order of cap over weight, those before some place are
    capped and the others share what is left by weight; the place is the first
    whose share stays within its own cap. The windows run over one row per source.
    """
    at = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(at) - 1) % len(cycle)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(c) for c in cycle]), nth + 1)).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = weighed.withColumn("level", (total - before).cast("double") / rest).withColumn("r", F.row_number().over(order))
    fitting = F.when(F.col("w") * F.col("level") <= F.col("cap"), F.col("r"))
    level = F.min_by("level", fitting).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * level, F.col("cap").cast("double")))
    return placed.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def mix_sources(docs: DataFrame, cycle=WEIGHT_CYCLE, max_repeats: float = MAX_REPEATS, seed: int = 7, weight=None, keep_text: bool = True) -> DataFrame:
    """``docs`` with mx_size, mx_source_size, mx_target, mx_copies and mx_taken.

    Texts are read once: sizes and keys are written beside the other columns, and
    the three passes that follow read those.
    """
    docs = make_room(docs, ["mx_size", "mx_source_size", "mx_target", "mx_copies", "mx_taken"])
    text = F.col("text")
    base = docs.withColumn("mx_size", word_count(text)).withColumn("mx_hash", F.xxhash64(text)).withColumn("mx_row", F.monotonically_increasing_id())
    w = weight if weight is not None else quality_weight(text, F.col("mx_size"))
    base = base.withColumn("mx_key", -F.log(uniform_draw(F.col("doc_id"), seed)) / w)
    # Equal-sized ranges of key / (1 + key), which lies in [0, 1).
    base = base.withColumn("mx_range", F.floor(F.col("mx_key") / (1 + F.col("mx_key")) * RANGES).cast("int"))
    base = materialize(base if keep_text else base.drop("text"), "keys")
    slim = base.select("source", "mx_range", "mx_size")
    ranges = slim.groupBy("source", "mx_range").agg(F.sum("mx_size").alias("mx_range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("mx_range_size").alias("source_size"))
    goal = source_targets(sizes, cycle, max_repeats).select(F.col("source").alias("mx_source"), F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target"))
    goal = goal.withColumn("mx_epochs", F.coalesce(F.floor(F.col("mx_target") / F.nullif(F.col("mx_source_size"), F.lit(0))), F.lit(0)).cast("long"))
    goal = goal.withColumn("mx_rest", F.col("mx_target") - F.col("mx_epochs") * F.col("mx_source_size"))
    goal = materialize(goal, "goal")  # one row per source
    few = F.broadcast if goal.count() <= BROADCAST_SOURCES else (lambda table: table)
    goal = few(goal)
    before = Window.partitionBy("source").orderBy("mx_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.withColumn("mx_before", F.coalesce(F.sum("mx_range_size").over(before), F.lit(0)))
    ends = ends.join(goal, F.col("source").eqNullSafe(F.col("mx_source")))
    ends = ends.where((F.col("mx_before") <= F.col("mx_rest")) & (F.col("mx_before") + F.col("mx_range_size") > F.col("mx_rest")))
    ends = ends.groupBy("mx_source").agg(F.min("mx_range").alias("mx_end"), F.min_by("mx_before", "mx_range").alias("mx_end_before"))
    plan = goal.join(ends.withColumnRenamed("mx_source", "mx_s"), F.col("mx_source").eqNullSafe(F.col("mx_s")), "left").drop("mx_s")
    plan = plan.select("mx_source", "mx_source_size", "mx_target", "mx_epochs", "mx_rest", "mx_end", "mx_end_before")
    # Only the range in which a source's budget ends has to be put in order; its last taken row is the cut.
    ties = ["doc_id", "mx_size", "mx_hash", "mx_row"]
    order = F.struct("mx_key", *ties)
    edge = base.select("source", "mx_range", "mx_key", *ties).join(few(plan.drop("mx_source_size", "mx_target")), F.col("source").eqNullSafe(F.col("mx_source")) & (F.col("mx_range") == F.col("mx_end")))
    inside = Window.partitionBy("mx_source").orderBy("mx_key", *ties).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("mx_run", F.col("mx_end_before") + F.sum("mx_size").over(inside))
    best = F.struct("mx_size", (-F.col("mx_key")).alias("k"), "doc_id", "mx_hash", "mx_row")
    fits = F.col("mx_run") <= F.col("mx_rest")
    cuts = edge.groupBy("mx_source").agg(
        F.max(F.when(fits, order)).alias("mx_cut"), F.max(F.when(fits, F.col("mx_run"))).alias("mx_cut_run"),
        F.min_by(best, F.when(~fits, order)).alias("mx_next"), F.min(F.when(~fits, F.col("mx_run") - F.col("mx_rest"))).alias("mx_over"),
    ).withColumnRenamed("mx_source", "mx_s")
    plan = plan.join(few(cuts), F.col("mx_source").eqNullSafe(F.col("mx_s")), "left").drop("mx_s")
    plan = plan.withColumn("mx_left", F.col("mx_rest") - F.coalesce("mx_cut_run", "mx_end_before")).drop("mx_end_before", "mx_cut_run")
    # The next document in order is taken if it overshoots by less than the largest later one that fits leaves open.
    early = F.col("mx_end").isNull() | (F.col("mx_range") < F.col("mx_end"))
    last = (F.col("mx_range") == F.col("mx_end")) & F.coalesce(order <= F.col("mx_cut"), F.lit(False))
    later = base.select("source", "mx_range", "mx_key", *ties).join(few(plan.select("mx_source", "mx_end", "mx_cut", "mx_left")), F.col("source").eqNullSafe(F.col("mx_source")))
    fill = later.where(~(early | last) & (F.col("mx_size") > 0) & (F.col("mx_size") <= F.col("mx_left"))).groupBy("mx_source").agg(F.max(best).alias("mx_fill")).withColumnRenamed("mx_source", "mx_s")
    plan = plan.join(few(fill), F.col("mx_source").eqNullSafe(F.col("mx_s")), "left").drop("mx_s")
    closer = F.col("mx_over") < F.col("mx_left") - F.coalesce(F.col("mx_fill.mx_size"), F.lit(0))
    plan = plan.withColumn("mx_fill", F.when(closer, F.col("mx_next")).otherwise(F.col("mx_fill"))).drop("mx_left", "mx_next", "mx_over")
    out = base.join(few(plan), F.col("source").eqNullSafe(F.col("mx_source"))).drop("mx_source")  # one row per source
    filled = F.coalesce(best == F.col("mx_fill"), F.lit(False))
    out = out.withColumn("mx_more", (F.col("mx_rest") > 0) & (early | last | filled))
    out = out.withColumn("mx_copies", F.least(F.lit(int(max_repeats)), F.col("mx_epochs") + F.col("mx_more").cast("long")).cast("long"))
    out = out.withColumn("mx_taken", F.col("mx_copies") * F.col("mx_size"))
    return out.drop("mx_key", "mx_range", "mx_hash", "mx_row", "mx_epochs", "mx_rest", "mx_end", "mx_cut", "mx_fill", "mx_more")


def mix_table(docs: DataFrame) -> DataFrame:
    out = mix_sources(docs.select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"))
