"""Recursive comparison of nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(json: Column) -> Column:
    """How deep objects and arrays that are not empty stand in each other in a JSON text."""
    plain = F.regexp_replace(F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"[^"]*"', "")
    signs = F.regexp_replace(F.replace(F.replace(plain, F.lit("{}"), F.lit("")), F.lit("[]"), F.lit("")), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, sign: Column) -> Column:
        now = a["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.split(signs, ""), start, step, lambda a: a["most"])


def leaves(rows: DataFrame, keys: list[str], value: str = "v", most: int = 64) -> DataFrame:
    """(keys, path, kind, value) of every leaf of a VARIANT column; an empty object or array is a leaf.

    The values are written down once and their levels counted; then each level is exploded in turn, in one pass, which
    a leaf goes through as it is. As many levels as ``most`` fail. Kinds are object, array, null, boolean, number and string; values
    are JSON. A null column has no leaves.
    """
    from ..sources.snapshots import scratch

    spark = rows.sparkSession
    home = scratch(spark, "leaves")
    rows.where(F.col(value).isNotNull()).select(*keys, F.lit("$").alias("path"), F.col(value).alias("_v")).write.parquet(home)
    cur = spark.read.parquet(home)
    levels = cur.agg(F.max(_levels(F.to_json("_v")))).first()[0] or 0
    if levels >= most:
        raise ValueError(f"values are nested deeper than {most}")
    for _ in range(levels):
        each = cur.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()).select("pos", "key", F.col("value").alias("_w")))
        step = F.when(F.col("pos").isNull(), "").when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        cur = each.select(*keys, F.concat("path", step).alias("path"), F.when(F.col("pos").isNull(), F.col("_v")).otherwise(F.col("_w")).alias("_v"))
    shape = F.schema_of_variant("_v")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string").otherwise("number")
    return cur.select(*keys, "path", kind.alias("kind"), F.to_json("_v").alias("value"))


def nested_diff(first: DataFrame, second: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, path, change, kind_1, value_1, kind_2, value_2) of all places at which two runs differ.

    A missing place (``only_1``, ``only_2``) is not a null one; a place of another kind
    is ``kind``, of another value ``value``. Array elements are compared by place.
    """
    a, b = (leaves(x, keys, value).select(*keys, "path", F.col("kind").alias(f"kind_{n}"), F.col("value").alias(f"value_{n}")) for n, x in ((1, first), (2, second)))
    both = a.join(b, [*keys, "path"], "full_outer")
    change = (
        F.when(F.col("kind_2").isNull(), "only_1").when(F.col("kind_1").isNull(), "only_2").when(F.col("kind_1") != F.col("kind_2"), "kind").when(F.col("value_1") != F.col("value_2"), "value")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())
