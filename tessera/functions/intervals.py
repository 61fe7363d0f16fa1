"""Half-open integer intervals as sorted islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], start: str = "s", end: str = "e", touch: bool = True) -> DataFrame:
    """Merged intervals per key: (keys, s, e, n). ``touch``: whether [1,2) and [2,3) become one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | ((F.col(start) > reach) if touch else (F.col(start) >= reach))
    marked = rows.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("n")).drop("_island")


def overlap_chars(rows: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """(keys, total, covered, overlap): summed length, union length and their difference."""
    total = rows.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("total"))
    union = islands(rows, keys, start, end, touch=False).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    return total.join(union, keys).withColumn("overlap", F.col("total") - F.col("covered"))


def covered_spans(spans: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (keys, span_id, gs, ge) with ``covered``: whether the union of ``rows`` (keys, s, e) holds the span whole.

    Islands don't overlap, so only the last one that starts at or before a span can
    hold it: one ordered pass over islands and spans of a key.
    """
    ends = islands(rows, keys).select(*keys, F.col("s").alias("_at"), F.lit(0).alias("_turn"), F.col("e").alias("_e"), *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("span_id", "gs", "ge")])
    asked = spans.select(*keys, F.col("gs").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(ends.schema["_e"].dataType).alias("_e"), "span_id", "gs", "ge")
    order = Window.partitionBy(*keys).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(asked).withColumn("_reach", F.last("_e", ignorenulls=True).over(order)).where("_turn = 1")
    hit = both.where("_reach >= ge").select(*keys, "span_id").distinct().withColumn("_hit", F.lit(True))
    return spans.join(hit, [*keys, "span_id"], "left").withColumn("covered", F.coalesce("_hit", F.lit(False))).drop("_hit")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of ``left`` (keys, a_id, s, e) and ``right`` (keys, b_id, s, e) that share a place: (keys, a_id, b_id, a_s, a_e, b_s, b_e, relation).

    The axis of a key is cut into bins as wide as an interval on average, so that
    there are about as many pieces as intervals; pieces meet by (key, bin), which
    also deals out a key that holds most rows, and a pair counts only in the bin of
    its later start. Empty intervals share no place. ``relation`` is same, nested or overlap.
    """
    solid = F.col("s") < F.col("e")
    sizes = left.where(solid).select(F.col("e") - F.col("s")).union(right.where(solid).select(F.col("e") - F.col("s"))).toDF("n")
    width = int(sizes.agg(F.coalesce(F.ceil(F.avg("n")), F.lit(1))).first()[0])
    cut = lambda rows: rows.where(solid).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    a = cut(left).select(*keys, "_bin", "a_id", F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = cut(right).select(*keys, "_bin", "b_id", F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    met = a.join(b, [*keys, "_bin"]).where((F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("_bin") == F.floor(F.greatest("a_s", "b_s") / width)))
    inside = (F.col("a_s") >= F.col("b_s")) & (F.col("a_e") <= F.col("b_e")) | (F.col("b_s") >= F.col("a_s")) & (F.col("b_e") <= F.col("a_e"))
    same = (F.col("a_s") == F.col("b_s")) & (F.col("a_e") == F.col("b_e"))
    return met.drop("_bin").withColumn("relation", F.when(same, "same").when(inside, "nested").otherwise("overlap"))
