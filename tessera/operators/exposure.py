"""What evidence each layer of retrieval exposes: coverage, attribution of misses, gates, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import covered_spans, islands

CANDIDATE_K, FINAL_K, SHOWN_K = 20, 10, 5
CONCEPT_PASS = 2 / 3
#: Floors of the packed evidence recall.
MACRO_FLOOR, ANSWERABLE_FLOOR = 0.875, 0.8333


def concept_coverage(ranked: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """(query_id, k, found, required, coverage, passed): concepts (query_id, concept) that stand, in any case, in the joined texts of the first ``k``.

    ``ranked`` is (query_id, rank, text). A concept may run over two neighbouring texts.
    """
    parts = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))
    shown = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.lower(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("shown"))
    found = F.count_if(F.coalesce(F.contains("shown", F.lower("concept")), F.lit(False)))
    out = concepts.join(shown, "query_id", "left").groupBy("query_id").agg(found.alias("found"), F.count("*").alias("required"))
    share = F.col("found") / F.col("required")
    return out.select("query_id", F.lit(k).alias("k"), "found", "required", F.round(share, 3).alias("coverage"), (share >= CONCEPT_PASS).alias("passed"))


def retrieval_report(per_query: DataFrame) -> DataFrame:
    """Macro means by k over (query_id, k, in_domain, hit, recall, ndcg, unique_sources, duplicate_slots); relevance counts for queries in the domain only."""
    mean = lambda c: F.round(F.avg(F.when(F.col("in_domain"), F.col(c).cast("double"))), 3).alias(c)
    return per_query.groupBy("k").agg(
        F.count("*").alias("queries"), F.count_if("in_domain").alias("in_domain_queries"), mean("hit"), mean("recall"), mean("ndcg"),
        F.round(F.avg("unique_sources"), 3).alias("unique_sources"), F.round(F.avg("duplicate_slots"), 3).alias("duplicate_slots"),
    )


def missed_sources(gold: DataFrame, dense: DataFrame, bm25: DataFrame, hybrid: DataFrame, tails: DataFrame) -> DataFrame:
    """Relevant sources that the shown list lacks, with each channel's best rank and the layers that lost them.

    ``gold`` is (query_id, source, grade, gating); the lists are (query_id, source, rank); ``tails`` holds the
    queries whose evidence stands in truncated tails.
    """
    best = lambda rows, name: rows.groupBy("query_id", "source").agg(F.min("rank").alias(name))
    out = gold
    for rows, name in ((dense, "dense_best_rank"), (bm25, "bm25_best_rank"), (hybrid, "hybrid_best_rank")):
        out = out.join(best(rows, name), ["query_id", "source"], "left")
    out = out.where(F.coalesce(F.col("hybrid_best_rank") > SHOWN_K, F.lit(True)))
    out = out.join(tails.select("query_id").distinct().withColumn("_tail", F.lit(True)), "query_id", "left")
    near = lambda c: F.coalesce(F.col(c) <= CANDIDATE_K, F.lit(False))
    far = lambda c: F.coalesce(F.col(c) > CANDIDATE_K, F.lit(False))
    cut = F.coalesce("_tail", F.lit(False)) & ~near("dense_best_rank")
    layers = F.array_compact(
        F.array(
            F.when(far("dense_best_rank") | far("bm25_best_rank"), F.lit("candidate-K failure")),
            F.when(~near("dense_best_rank"), F.lit("embedding semantic failure")),
            F.when(cut, F.lit("embedding truncation")),
            F.when(~F.col("gating"), F.lit("evaluator ambiguity")),
            F.when(near("dense_best_rank") | near("bm25_best_rank"), F.lit("fusion/ranking failure")),
            F.when(~near("bm25_best_rank"), F.lit("lexical/BM25 failure")),
        )
    )
    return out.select(
        "query_id", "source", "grade", "dense_best_rank", "bm25_best_rank", "hybrid_best_rank", F.array_join(layers, "; ").alias("layers"),
        F.when(cut, "plausible").otherwise("demonstrated").alias("confidence"), (F.col("grade") == 2).alias("critical"),
    )


def covered_at(spans: DataFrame, rows: DataFrame, k: int, name: str) -> DataFrame:
    """``spans`` (query_id, source, span_id, gs, ge, ...) with ``name``: covered by the union of the first ``k`` rows (query_id, rank, source, s, e)."""
    slim = spans.select("query_id", "source", "span_id", "gs", "ge")
    hit = covered_spans(slim, rows.where(F.col("rank") <= k).select("query_id", "source", "s", "e"), ["query_id", "source"])
    return spans.join(hit.select("query_id", "source", "span_id", F.col("covered").alias(name)), ["query_id", "source", "span_id"])


def missed_spans(spans: DataFrame, dense: DataFrame, bm25: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Gold spans that the shown list does not cover and the layers that lost them. ``spans`` also has grade, ambiguous and tail."""
    out = covered_at(spans, hybrid, SHOWN_K, "shown")
    for rows, k, name in ((dense, CANDIDATE_K, "in_dense"), (bm25, CANDIDATE_K, "in_bm25"), (hybrid, FINAL_K, "in_final")):
        out = covered_at(out, rows, k, name)
    ranked = F.col("in_dense") | F.col("in_bm25")
    layers = F.array_compact(
        F.array(
            F.when(~ranked, F.lit("candidate-K failure")), F.when(~ranked, F.lit("embedding semantic failure")), F.when(F.col("tail"), F.lit("embedding truncation")),
            F.when(F.col("ambiguous"), F.lit("evaluator ambiguity")), F.when(F.col("in_final"), F.lit("final-K ranking failure")), F.when(ranked, F.lit("fusion/ranking failure")),
            F.when(~ranked, F.lit("lexical/BM25 failure")),
        )
    )
    return out.where(~F.col("shown")).select("query_id", "source", "span_id", "in_dense", "in_bm25", "in_final", F.array_join(layers, "; ").alias("layers"), (F.col("grade") == 2).alias("critical"))


def layer_metrics(layer: DataFrame, spans: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query of one layer (query_id, rank, unit_id, source, s, e, tokens): coverage, sources, units, intervals, tokens, occupancy.

    Queries that the layer shows nothing for count as zeros; without gold spans the recall is 0.
    """
    per = layer.groupBy("query_id", "source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_distinct("s", "e").alias("intervals"))
    shape = per.groupBy("query_id").agg(
        F.sum("n").alias("units"), F.sum("intervals").alias("unique_intervals"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_sources"), F.max("n").alias("most_of_one"),
        F.round(F.max("n") / F.sum("n"), 8).alias("max_share"),
    )
    covered = covered_spans(spans.select("query_id", "source", "span_id", "gs", "ge"), layer.select("query_id", "source", "s", "e"), ["query_id", "source"])
    seen = covered.join(per.select("query_id", "source", F.lit(True).alias("_there")), ["query_id", "source"], "left")
    found = seen.groupBy("query_id").agg(
        F.round(F.count_if("covered") / F.count("*"), 8).alias("span_recall"), F.round(F.count_distinct(F.when(F.col("_there"), F.col("source"))) / F.count_distinct("source"), 8).alias("source_recall")
    )
    zero = {c: 0 for c in ("units", "unique_intervals", "tokens", "n_sources", "most_of_one", "max_share", "span_recall", "source_recall")}
    return queries.select("query_id").join(shape, "query_id", "left").join(found, "query_id", "left").fillna(zero)


def evidence_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per query the covered spans lost and gained between two layers; any loss is a regression."""
    a, b = before.select(*keys, "span").distinct().withColumn("_b", F.lit(1)), after.select(*keys, "span").distinct().withColumn("_a", F.lit(1))
    both = a.join(b, [*keys, "span"], "full_outer").groupBy(*keys).agg(F.count_if(F.col("_a").isNull()).alias("lost"), F.count_if(F.col("_b").isNull()).alias("gained"))
    return both.withColumn("change", F.when(F.col("lost") > 0, "EVIDENCE REGRESSED").when(F.col("gained") > 0, "EVIDENCE IMPROVED").otherwise("EVIDENCE SAME"))


def evidence_gates(scores: DataFrame, parity_failures: int = 0, provenance_ok: bool = True, macro_floor: float = MACRO_FLOOR, answerable_floor: float = ANSWERABLE_FLOOR) -> DataFrame:
    """(gate, query_id) of failed gates over scores (query_id, answerability, packed_recall, shown_recall, lost_grade2)."""
    bearing = scores.where(F.col("answerability").isin("ANSWERABLE", "PARTIAL"))
    own = F.array_compact(
        F.array(
            F.when((F.col("answerability") == "PARTIAL") & (F.col("packed_recall") != 1.0), F.lit("partial_available_recall_below_one")),
            F.when(F.col("packed_recall") < F.col("shown_recall"), F.lit("packed_below_retrieved_recall")),
            F.when(F.col("lost_grade2") > 0, F.lit("critical_grade2_lost_at_packed")),
        )
    )
    per = bearing.select(F.explode(own).alias("gate"), "query_id")
    answerable = F.when(F.col("answerability") == "ANSWERABLE", F.col("packed_recall"))
    means = bearing.agg(F.round(F.coalesce(F.avg("packed_recall"), F.lit(0.0)), 8).alias("macro"), F.round(F.avg(answerable), 8).alias("answerable"))
    whole = F.array_compact(
        F.array(
            F.when(F.lit(parity_failures > 0), F.lit("backend_identity_mismatch")), F.when(F.lit(not provenance_ok), F.lit("provenance_mismatch")),
            F.when(F.col("macro") < macro_floor, F.lit("macro_packed_below_floor")), F.when(F.col("answerable") < answerable_floor, F.lit("answerable_macro_below_floor")),
        )
    )
    return per.unionByName(means.select(F.explode(whole).alias("gate"), F.lit(None).cast(scores.schema["query_id"].dataType).alias("query_id")))


def hard_negative_exposure(labels: DataFrame, layers: DataFrame) -> DataFrame:
    """Rows of layers (query_id, layer, rank, source, unit_id) that match a label (query_id, label, source, unit_id); a null in a label matches anything."""
    want = labels.select("query_id", "label", F.col("source").alias("_source"), F.col("unit_id").alias("_unit"))
    same = lambda a, b: F.col(a).isNull() | F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return layers.join(want, "query_id").where(same("_source", "source") & same("_unit", "unit_id")).select("query_id", "label", "layer", "rank", "source", "unit_id")


def source_concentration(ranked: DataFrame) -> DataFrame:
    """Per query the largest share of one source among the ranked rows, and the sources that reach it."""
    per = ranked.groupBy("query_id", "source").agg(F.count("*").alias("n"))
    top = per.groupBy("query_id").agg(F.count("*").alias("unique_sources"), F.max("n").alias("max_count"), F.round(F.max("n") / F.sum("n"), 8).alias("max_share"))
    dominant = per.join(top, "query_id").where("n = max_count").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("dominant"))
    return top.join(dominant, "query_id")


def absent_diagnostics(queries: DataFrame, dense: DataFrame, bm25: DataFrame, hybrid: DataFrame, packed: DataFrame) -> DataFrame:
    """Top scores and counts of queries that have no evidence; null where a channel has no rows."""
    first = lambda rows, c, name: rows.where("rank = 1").select("query_id", F.round(c, 8).alias(name))
    counts = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    out = queries.select("query_id")
    parts = [first(dense, "score", "dense_top1_similarity"), dense.groupBy("query_id").agg(F.round(F.max("score"), 8).alias("max_dense_similarity")), first(bm25, "score", "bm25_top_score"), first(hybrid, "rrf_score", "hybrid_top1_rrf"), counts(hybrid, "retrieved"), counts(packed, "packed")]
    for part in parts:
        out = out.join(part, "query_id", "left")
    return out.withColumn("dense_top1_distance", F.round(1.0 - F.col("dense_top1_similarity"), 8)).fillna({"retrieved": 0, "packed": 0})


def order_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, rank, left_id, right_id) of the places at which two ranked lists (query_id, rank, unit_id) differ."""
    a, b = (x.select("query_id", "rank", F.col("unit_id").alias(n)) for x, n in ((left, "left_id"), (right, "right_id")))
    return a.join(b, ["query_id", "rank"], "full_outer").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def execution_diff(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, execution_1, execution_2) of two runs flattened to (keys, path, value) that differ."""
    a, b = (x.select(*keys, "path", F.col("value").alias(n)) for x, n in ((first, "execution_1"), (second, "execution_2")))
    return a.join(b, [*keys, "path"], "full_outer").where(~F.col("execution_1").eqNullSafe(F.col("execution_2")))


def tail_exposure(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, span_id, exposure): whether a gold span lies whole, partly or not at all in a truncated tail.

    ``chunks`` is (source, tail_start or null, e), ``spans`` (query_id, source, span_id, gs, ge).
    """
    tails = chunks.where(F.col("tail_start").isNotNull()).select("source", "tail_start", "e")
    meets = (F.greatest("gs", "tail_start") < F.least("ge", "e")) & F.col("tail_start").isNotNull()
    whole = meets & (F.col("tail_start") <= F.col("gs")) & (F.col("ge") <= F.col("e"))
    out = spans.join(tails, "source", "left").groupBy("query_id", "span_id").agg(F.coalesce(F.bool_or(whole), F.lit(False)).alias("w"), F.coalesce(F.bool_or(meets), F.lit(False)).alias("p"))
    return out.select("query_id", "span_id", F.when(F.col("w"), "whole").when(F.col("p"), "partial").otherwise("none").alias("exposure"))


def clipped_intervals(units: DataFrame, limit: int) -> DataFrame:
    """(unit_id, s, e): the spans of units (unit_id, text, start, end, spans array of s, e) that stand in the first ``limit`` characters of the text.

    The text is a prefix of title and breadcrumb followed by the source slice [start, end).
    """
    prefix = F.length("text") - (F.col("end") - F.col("start"))
    reach = F.when(F.length("text") <= limit, F.col("end")).otherwise(F.least(F.col("end"), F.col("start") + F.greatest(F.lit(limit) - prefix, F.lit(0))))
    cut = units.withColumn("_reach", reach).select("unit_id", "_reach", F.explode("spans").alias("x"))
    return cut.select("unit_id", F.col("x.s").alias("s"), F.least(F.col("x.e"), F.col("_reach")).alias("e")).where("s < e")


def span_structure(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """How pieces (span_id, s, e) lie over each span (span_id, gs, ge): number of islands, uncovered characters, fewest pieces that cover it (null if none do).

    The fewest are counted by always taking the piece that reaches furthest from where the cover ends: an ordered fold over one span's pieces.
    """
    inside = spans.join(pieces, "span_id").select("span_id", "gs", "ge", F.greatest("s", "gs").alias("s"), F.least("e", "ge").alias("e")).where("s < e")
    union = islands(inside, ["span_id"]).groupBy("span_id").agg(F.count("*").alias("islands"), F.sum(F.col("e") - F.col("s")).alias("covered"))
    rows = inside.groupBy("span_id", "gs", "ge").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("rows"))
    state = "struct<reach:bigint,best:bigint,n:bigint,gap:boolean>"

    def fold(a: Column, x: Column) -> Column:
        # a piece that starts behind the cover's end ends the choice of the next piece
        step = x["s"] > a["reach"]
        reach, n = F.when(step, a["best"]).otherwise(a["reach"]), a["n"] + step.cast("long")
        gap = a["gap"] | (x["s"] > reach)
        return F.struct(reach.alias("reach"), F.greatest(a["best"], x["e"]).alias("best"), n.alias("n"), gap.alias("gap")).cast(state)

    start = F.struct(F.col("gs").alias("reach"), F.col("gs").alias("best"), F.lit(0).alias("n"), F.lit(False).alias("gap")).cast(state)
    done = lambda a: F.when(~a["gap"], F.struct(a["best"].alias("best"), (a["n"] + (a["best"] > a["reach"]).cast("long")).alias("n")))
    folded = rows.withColumn("f", F.aggregate("rows", start, fold, done)).select("span_id", F.when(F.col("f.best") >= F.col("ge"), F.col("f.n")).alias("min_cover"))
    out = spans.join(union, "span_id", "left").join(folded, "span_id", "left")
    return out.select("span_id", F.coalesce("islands", F.lit(0)).alias("islands"), (F.col("ge") - F.col("gs") - F.coalesce("covered", F.lit(0))).alias("uncovered"), "min_cover")


def text_agreement(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, canonical, outcome): matched, missing (gold only) or extra, by canonical text; copies count once."""
    a, b = gold.select(*keys, "canonical").distinct().withColumn("_g", F.lit(1)), found.select(*keys, "canonical").distinct().withColumn("_f", F.lit(1))
    kind = F.when(F.col("_g").isNull(), "extra").when(F.col("_f").isNull(), "missing").otherwise("matched")
    return a.join(b, [*keys, "canonical"], "full_outer").select(*keys, "canonical", kind.alias("outcome"))


def shared_terms(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Split claims: (keys, whole) texts that hold two or more other texts of their group, with the number held.

    Texts are joined on their longest word first, so that only pairs that can contain each other are compared.
    """
    words = F.split("text", " ")
    longest = F.element_at(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1)
    inner = claims.select(*keys, F.col("text").alias("inner"), longest.alias("w"))
    outer = claims.select(*keys, F.col("text").alias("whole"), F.explode(F.array_distinct(words)).alias("w"))
    held = outer.join(inner, [*keys, "w"]).where("`inner` <> whole").where(F.contains(F.concat(F.lit(" "), F.col("whole"), F.lit(" ")), F.concat(F.lit(" "), F.col("inner"), F.lit(" "))))
    return held.groupBy(*keys, "whole").agg(F.count_distinct("inner").alias("n")).where("n >= 2")


def attribution(report: DataFrame, web: DataFrame, kb: DataFrame, keys: list[str]) -> DataFrame:
    """(.., source_kind, source_ref): none without a URL; web by exact normalised URL; kb by the first file, in order, whose name holds the URL or stands in it; else unresolved.

    ``report`` has (keys, row_id, source_url, norm_url), ``web`` (keys, norm_url), ``kb`` (keys, place, source). A run's
    files are few; names are compared within the run only.
    """
    name = lambda c: F.lower(F.trim(F.col(c)))
    hit = web.select(*keys, F.col("norm_url")).where("norm_url is not null").distinct().withColumn("_web", F.lit(True))
    files = kb.groupBy(*keys, "source").agg(F.min("place").alias("place"))
    near = report.where("source_url <> ''").select(*keys, "row_id", name("source_url").alias("u")).join(files, keys).where(F.contains("u", name("source")) | F.contains(name("source"), "u"))
    first = near.groupBy(*keys, "row_id").agg(F.min_by("source", F.struct("place", "source")).alias("file"))
    out = report.join(hit, [*keys, "norm_url"], "left").join(first, [*keys, "row_id"], "left")
    bare = F.coalesce(F.col("source_url"), F.lit("")) == ""
    kind = F.when(bare, "none").when(F.col("_web"), "web").when(F.col("file").isNotNull(), "kb").otherwise("unresolved")
    ref = F.when(bare, None).when(F.col("_web"), F.col("norm_url")).when(F.col("file").isNotNull(), F.concat(F.lit("kb:"), F.col("file")))
    return out.select(*keys, "row_id", kind.alias("source_kind"), ref.alias("source_ref"))


def corpus_effect(units: DataFrame, base: DataFrame) -> DataFrame:
    """Sizes of two unit tables (text, tokens) and their ratios; tokens above the 254 that an encoder reads are clipped."""
    size = lambda t, p: t.agg(F.count("*").alias(f"{p}_units"), F.sum(F.octet_length("text")).alias(f"{p}_bytes"), F.sum("tokens").alias(f"{p}_tokens"), F.sum(F.greatest(F.col("tokens") - 254, F.lit(0))).alias(f"{p}_clipped"))
    both = size(units, "new").crossJoin(size(base, "old"))  # one row each
    return both.withColumn("unit_ratio", F.round(F.col("new_units") / F.nullif("old_units", F.lit(0)), 6)).withColumn("token_ratio", F.round(F.col("new_tokens") / F.nullif("old_tokens", F.lit(0)), 6))
