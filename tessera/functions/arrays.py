"""Array expressions: running sums and maxima, places of matches, greedy bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _scan(values: Column, join) -> Column:
    """Running ``join`` over an array by doubling: as many passes as its size has binary digits."""

    def step(done: Column, shift: Column) -> Column:
        return F.transform(done, lambda x, i: F.when(i >= shift, join(x, F.get(done, i - shift))).otherwise(x))

    shifts = lambda a: F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(a))) - 1), lambda s: F.pow(F.lit(2), s).cast("int"))
    return let(values, lambda a: F.aggregate(shifts(a), a, step))


def running_sum(values: Column) -> Column:
    return _scan(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return _scan(values, lambda a, b: F.greatest(a, b))


def places(text: Column, pattern: str) -> Column:
    """(start, end) of all matches in code points from 0, leftmost first and without overlaps."""
    kind = "array<struct<start:int,end:int>>"

    def located(hits: Column) -> Column:
        sizes = F.transform(hits, F.length)

        def build(gaps: Column) -> Column:
            moved = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.slice(F.concat(F.array(F.lit(0)), sizes), F.lit(1), F.size(hits)), lambda g, h: g + h)
            return F.zip_with(running_sum(moved), sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))

        return F.when(F.size(hits) > 0, let(F.transform(F.split(text, pattern, -1), F.length), build).cast(kind)).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def greedy_bins(sizes: Column, budget: Column, opening: Column | None = None) -> Column:
    """(first, last, size) of bins filled from the left: an element joins the bin while their sum is within ``budget``.

    ``opening`` adds a size to a bin for the element that opens it. An element beyond
    the budget has a bin of its own. One pass; only closed bins are copied.
    """
    kind = "struct<out:array<struct<first:int,last:int,size:int>>,first:int,size:int,n:int>"
    empty = F.struct(F.array().cast("array<struct<first:int,last:int,size:int>>").alias("out"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).alias("n")).cast(kind)
    close = lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), (a["n"] - 1).alias("last"), a["size"].alias("size"))))

    def filled(at) -> Column:
        def step(a: Column, x: Column) -> Column:
            joins = (a["n"] > 0) & (a["size"] + x <= budget)
            same = F.struct(a["out"].alias("out"), a["first"].alias("first"), (a["size"] + x).cast("int").alias("size"), (a["n"] + 1).alias("n"))
            fresh = F.struct(F.when(a["n"] > 0, close(a)).otherwise(a["out"]).alias("out"), a["n"].alias("first"), (x + at(a["n"])).cast("int").alias("size"), (a["n"] + 1).alias("n"))
            return F.when(joins, same).otherwise(fresh)

        return F.aggregate(sizes, empty, step, lambda a: F.when(a["n"] > 0, close(a)).otherwise(a["out"]))

    # Within the fold the openings would be worked out again for each bin.
    return filled(lambda i: F.lit(0)) if opening is None else let(opening, lambda o: filled(lambda i: F.coalesce(F.get(o, i), F.lit(0))))
