"""Checks of compiled units and blocks, packing of adjacent children, and fixed windows with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import places
from .markdown import UNIT_TOKENS, WORD


def attach_neighbours(units: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("retrieval_start", "unit_id")
    return units.withColumn("previous_id", F.lag("unit_id").over(order)).withColumn("next_id", F.lead("unit_id").over(order))


def neighbour_errors(linked: DataFrame) -> DataFrame:
    """(unit_id, error): links to nowhere, across documents, or that do not lead back."""
    other = linked.select(F.col("unit_id").alias("_o"), F.col("doc_id").alias("_doc"), F.col("previous_id").alias("_p"), F.col("next_id").alias("_n"))
    found = None
    for edge, back in (("previous_id", "_n"), ("next_id", "_p")):
        both = linked.where(F.col(edge).isNotNull()).join(other, F.col(edge) == F.col("_o"), "left")
        why = F.when(F.col("_o").isNull(), "unknown_neighbour").when(F.col("_doc") != F.col("doc_id"), "crosses_documents").when(~F.col(back).eqNullSafe(F.col("unit_id")), "no_back_link")
        one = both.select("unit_id", why.alias("error")).where("error is not null")
        found = one if found is None else found.unionByName(one)
    return found


def unit_errors(units: DataFrame, docs: DataFrame, children: DataFrame, limit: int = UNIT_TOKENS, text: str = "text") -> DataFrame:
    """(doc_id, error): cores that leave a gap or overlap, overlaps that reach before the document or behind the core, repeated ids, children lost or held twice, units too long.

    ``units`` is (doc_id, unit_id, retrieval_start, core_start, core_end, children, n_tokens); ``children`` is (doc_id, chunk_index).
    """
    order = Window.partitionBy("doc_id").orderBy("core_start", "core_end", "unit_id")
    size = docs.select("doc_id", F.length(F.coalesce(F.col(text), F.lit(""))).alias("_len"))
    seams = units.withColumn("_from", F.coalesce(F.lag("core_end").over(order), F.lit(0))).withColumn("_last", F.lead("unit_id").over(order).isNull()).join(size, "doc_id")
    place = F.array_compact(
        F.array(
            F.when(F.col("core_start") > F.col("_from"), F.lit("gap")), F.when(F.col("core_start") < F.col("_from"), F.lit("overlapping_cores")), F.when(F.col("_last") & (F.col("core_end") != F.col("_len")), F.lit("gap_at_end")),
            F.when((F.col("retrieval_start") < 0) | (F.col("retrieval_start") > F.col("core_start")), F.lit("overlap_without_owner")), F.when(F.col("n_tokens") > limit, F.lit("too_long")),
        )
    )
    found = seams.withColumn("_e", place).select("doc_id", F.explode("_e").alias("error"))
    twice = units.groupBy("doc_id", "unit_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("repeated_id").alias("error"))
    held = units.select("doc_id", F.explode("children").alias("chunk_index")).groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n"))
    both = children.where("chunk_index is not null").select("doc_id", "chunk_index", F.lit(True).alias("_there")).join(held, ["doc_id", "chunk_index"], "full_outer")
    member = both.select("doc_id", F.when(F.col("n").isNull(), "child_lost").when(F.col("_there").isNull(), "unknown_child").when(F.col("n") > 1, "child_twice").alias("error")).where("error is not null")
    return found.unionByName(twice).unionByName(member)


def block_errors(blocks: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ordinal, error) of blocks: order, overlaps, text that no block has, parents that are no earlier heading, siblings out of order.

    The blocks of a document meet its text as one row, so no block carries a text.
    """
    order, sibling = Window.partitionBy("doc_id").orderBy("ordinal"), Window.partitionBy("doc_id", "parent").orderBy("ordinal")
    before, after = F.lag("ordinal").over(sibling), F.lead("ordinal").over(sibling)
    rows = blocks.select(
        "doc_id", "ordinal", "block_type", "parent", "start", "end", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("from"), F.lead("ordinal").over(order).isNull().alias("last"),
        (F.col("ordinal") != F.row_number().over(order) - 1).alias("moved"), (~F.col("previous").eqNullSafe(before) | ~F.col("next").eqNullSafe(after)).alias("parted"),
    )
    held = rows.groupBy("doc_id").agg(
        F.collect_list(F.struct("ordinal", "parent", "start", "end", "from", "last", "moved", "parted")).alias("_b"), F.collect_set(F.when(F.col("block_type") == "heading", F.col("ordinal"))).alias("_h")
    )
    out = held.join(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")), "doc_id")
    solid = lambda a, b: F.substr("_t", a + 1, F.greatest(b - a, F.lit(0))).rlike(r"[^\x20\x09-\x0D]")

    def why(b: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(b["moved"], F.lit("ordinal")), F.when(b["start"] < b["from"], F.lit("overlap")), F.when(solid(b["from"], b["start"]), F.lit("uncovered_text")), F.when(b["last"] & solid(b["end"], F.length("_t")), F.lit("uncovered_tail")),
                F.when(b["parent"].isNotNull() & (~F.array_contains("_h", b["parent"]) | (b["parent"] >= b["ordinal"])), F.lit("parent")), F.when(b["parted"], F.lit("sibling")),
            )
        )

    found = F.flatten(F.transform("_b", lambda b: F.transform(why(b), lambda e: F.struct(b["ordinal"].alias("ordinal"), e.alias("error")))))
    # The outer form keeps the optimizer from writing the array's expression into a filter below.
    return out.select("doc_id", F.explode_outer(found).alias("_e")).where(F.col("_e").isNotNull()).select("doc_id", "_e.ordinal", "_e.error")


def pack_adjacent(children: DataFrame, limit: int = UNIT_TOKENS) -> DataFrame:
    """Neighbouring children of one parent and heading path, both of a packable kind, of the same or the next block, with white space only between: (doc_id, run, unit, first, last, n, n_tokens).

    ``children`` is (doc_id, chunk_index, ordinal, parent, path, packable, touches, n_tokens); ``touches`` says that only
    white space stands before it. Runs are islands; within one, units are filled greedily. Sizes add up, as with a counter of words.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = lambda c: F.lag(c).over(order)
    joined = F.col("touches") & F.col("packable") & before("packable") & before("parent").eqNullSafe(F.col("parent")) & before("path").eqNullSafe(F.col("path")) & (F.col("ordinal") - before("ordinal")).isin(0, 1)
    marked = children.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(order))
    rows = marked.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "n_tokens"))).alias("rows"))
    kind = "array<struct<first:int,last:int,n:int,n_tokens:int>>"

    def fold(acc, row):
        last = F.element_at(acc, -1)
        grown = F.struct(last["first"].alias("first"), row["chunk_index"].alias("last"), (last["n"] + 1).alias("n"), (last["n_tokens"] + row["n_tokens"]).alias("n_tokens"))
        fresh = F.struct(row["chunk_index"].alias("first"), row["chunk_index"].alias("last"), F.lit(1).alias("n"), row["n_tokens"].alias("n_tokens"))
        fits = last["n_tokens"] + row["n_tokens"] <= limit
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    head = F.col("rows")[0]
    start = F.array(F.struct(head["chunk_index"].alias("first"), head["chunk_index"].alias("last"), F.lit(1).alias("n"), head["n_tokens"].alias("n_tokens"))).cast(kind)
    packed = rows.withColumn("u", F.aggregate(F.slice("rows", 2, F.size("rows")), start, fold))
    return packed.select("doc_id", "run", F.posexplode("u").alias("unit", "x")).select("doc_id", "run", "unit", "x.*")


def legacy_chunks(docs: DataFrame, width: int = 400, stride: int = 350, limit: int = 254, text: str = "text") -> DataFrame:
    """Fixed word windows with their places: (doc_id, chunk_index, n_tokens, start, end, beyond, beyond_share, tail_start).

    ``beyond`` counts the words that an encoder of ``limit`` words does not see; ``tail_start`` is where they begin.
    """
    split = docs.select("doc_id", places(F.col(text), WORD).alias("p")).where(F.size("p") > 0)
    starts = split.select("doc_id", "p", F.posexplode(F.sequence(F.lit(0), F.size("p") - 1, F.lit(stride))).alias("chunk_index", "s"))
    n = F.least(F.lit(width), F.size("p") - F.col("s"))
    out = starts.withColumn("n_tokens", n).withColumn("beyond", F.greatest(F.col("n_tokens") - limit, F.lit(0)))
    at = lambda i: F.element_at("p", (i + 1).cast("int"))
    return out.select(
        "doc_id", "chunk_index", "n_tokens", at(F.col("s"))["start"].alias("start"), at(F.col("s") + F.col("n_tokens") - 1)["end"].alias("end"), "beyond", F.round(F.col("beyond") / F.col("n_tokens"), 8).alias("beyond_share"),
        F.when(F.col("beyond") > 0, at(F.col("s") + limit)["start"]).alias("tail_start"),
    )


def rebased_interval(start, end, strip_start, strip_end):
    """A source interval within the stripped text, or null if nothing is left."""
    a, b = F.greatest(start, strip_start) - strip_start, F.least(end, strip_end) - strip_start
    return F.when(a < b, F.struct(a.alias("s"), b.alias("e")))
