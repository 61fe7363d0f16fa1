"""The retrieval pipeline end to end, its text forms, and what is checked or shown around it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.store import written
from . import dense, fusion, lexical

#: Fixed values of the packed-evidence contract and the older one beside it.
CONTRACT, LEGACY = "packed_evidence_v1", "legacy_kb_v1"
SEEDS = 5
WEB_ITEMS, WEB_CHARS, KB_ITEMS, KB_CHARS = 5, 1500, 5, 2000
LEGACY_SEEDS, LEGACY_CHARS = 3, 2000
PAIR_BATCH, PAIR_TOKENS = 8, 512
REFLECTION_FLOOR = 7


def seeds_with_distance(fused: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Fused rows (query_id, unit_id, rank, rrf_score) with ``distance``: one less the dot product, at four decimals; null without a vector."""
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    v = vectors.select("unit_id", F.col("embedding").alias("_v"))
    return fused.join(q, "query_id", "left").join(v, "unit_id", "left").withColumn("distance", F.round(1 - dense.dot(F.col("_q"), F.col("_v")), 4) + 0.0).drop("_q", "_v")


def fused_or_dense(dense_rows: DataFrame, lexical_rows: DataFrame, k: int = SEEDS) -> DataFrame:
    """Fused ranks; a query that the words find nothing for has its dense ranks alone. A query without either has no rows."""
    fused = fusion.rrf(dense_rows, lexical_rows, k)
    return fused.withColumn("mode", F.when(F.max("bm25_rank").over(Window.partitionBy("query_id")).isNull(), "dense_only").otherwise("hybrid"))


def serialized_groups(packed: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, run, seed_rank, seed_unit, n, text_sha256) of consecutive rows of one seed; texts are joined by an empty line.

    ``packed`` has (query_id, packed, packed_order, seed_rank, unit_id, relation); ``units`` (unit_id, text).
    """
    rows = fusion.seed_runs(packed).join(units.select("unit_id", F.coalesce("text", F.lit("")).alias("text")), "unit_id")
    ordered = F.array_sort(F.collect_list(F.struct("packed_order", "unit_id", "text")))
    out = rows.groupBy("query_id", "run", "seed_rank").agg(ordered.alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["text"]), "\n\n")
    return out.select("query_id", "run", "seed_rank", F.col("r")[0]["unit_id"].alias("first_unit"), F.size("r").alias("n"), F.sha2(joined, 256).alias("text_sha256"))


def legacy_groups(packed: DataFrame, units: DataFrame, k: int = LEGACY_SEEDS, limit: int = LEGACY_CHARS) -> DataFrame:
    """The older form: the first ``k`` seeds, each run clipped to ``limit`` characters together; (query_id, run, unit_id, shown, clipped)."""
    rows = fusion.seed_runs(packed).where(F.col("seed_rank") <= k).join(units.select("unit_id", F.coalesce("text", F.lit("")).alias("text")), "unit_id")
    out = fusion.clip_groups(rows, limit, ("query_id", "run"), ("packed_order",)).withColumnRenamed("clipped", "body")
    return out.select("query_id", "run", "unit_id", F.length("body").alias("shown"), (F.length("body") < F.length("text")).alias("clipped"))


def kb_results(packed: DataFrame, units: DataFrame, seeds: DataFrame) -> DataFrame:
    """Packed rows in order with their seed's distance and score, text digest and the contract's name.

    A rank that no seed has gets distance 0 and no score.
    """
    meta = seeds.select("query_id", F.col("rank").alias("seed_rank"), "distance", "rrf_score")
    rows = packed.where("packed").join(units.select("unit_id", "source", F.coalesce("text", F.lit("")).alias("text")), "unit_id").join(meta, ["query_id", "seed_rank"], "left")
    return rows.select(
        "query_id", "packed_order", "unit_id", "source", "seed_rank", "relation", F.coalesce("distance", F.lit(0.0)).alias("distance"), "rrf_score", "text", F.sha2("text", 256).alias("text_sha256"), F.lit(CONTRACT).alias("contract")
    )


def packed_fingerprint(results: DataFrame) -> DataFrame:
    """(query_id, fingerprint) over units, relations and text digests in packed order."""
    rows = F.array_sort(F.collect_list(F.struct("packed_order", "seed_rank", "relation", "unit_id", "text_sha256")))
    return results.groupBy("query_id").agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"))


def is_qualified(results: DataFrame) -> DataFrame:
    """(query_id, qualified): whether the first row is of the packed-evidence contract."""
    return results.groupBy("query_id").agg((F.min_by("contract", "packed_order") == CONTRACT).alias("qualified"))


def retrieve(spark: SparkSession, queries: DataFrame, units: DataFrame, vectors: DataFrame, query_vectors: DataFrame, n_seeds: int = SEEDS, budget: int = fusion.TOKEN_BUDGET) -> DataFrame:
    """Packed evidence of all queries in one plan: rank by words and vectors, fuse, expand, dedupe, pack, flatten.

    ``queries`` is (query_id, text), ``units`` (unit_id, text, source), the vectors (unit_id | query_id, embedding). A
    query whose seeds exceed the budget has no rows.
    """
    if n_seeds != SEEDS:
        raise ValueError(f"the contract takes {SEEDS} seeds")
    found = lexical.top_k(lexical.bm25_scores(lexical.build_index(units), queries), fusion.CANDIDATES)
    near = dense.nearest(spark, query_vectors, vectors, fusion.CANDIDATES)
    seeds = written(seeds_with_distance(fusion.rrf(near, found, n_seeds), query_vectors, vectors), "seeds")
    linked = fusion.with_neighbours(units, document="source", start="unit_id")
    sizes = units.select("unit_id", F.size(tokens(F.col("text"))).alias("tokens"))
    packed = fusion.pack(fusion.first_seen(fusion.expand(seeds, linked)).join(sizes, "unit_id"), budget, fail_over_budget=False)
    return kb_results(packed, units, seeds)


BACKENDS: dict[str, Callable] = {"local": retrieve}


def dispatch(name: str) -> Callable:
    """A backend by its exact name; there is no default."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; one of {sorted(BACKENDS)}")
    return BACKENDS[name]


def _joined(rows: DataFrame, order: str, line: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, line.alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def web_context(web: DataFrame) -> DataFrame:
    """The first web sources (query_id, place, url, content) with clipped contents."""
    head = web.where(F.col("place") < WEB_ITEMS)
    return _joined(head, "place", F.concat(F.lit("[WEB] "), "url", F.lit("\n"), F.substring("content", 1, WEB_CHARS)))


def kb_context(results: DataFrame) -> DataFrame:
    """Packed results whole, each under a header."""
    header = F.concat(F.lit("[KB seed_rank="), F.col("seed_rank").cast("string"), F.lit(" relation="), "relation", F.lit("] "), "source")
    return _joined(results, "packed_order", F.concat(header, F.lit("\n"), "text"))


def legacy_kb_context(results: DataFrame) -> DataFrame:
    head = results.where(F.col("packed_order") < KB_ITEMS)
    return _joined(head, "packed_order", F.concat(F.lit("[KB] "), "source", F.lit("\n"), F.substring("text", 1, KB_CHARS)))


def source_context(queries: DataFrame, web: DataFrame, results: DataFrame) -> DataFrame:
    """Web context, then the packed one or, for results of another contract, the older one."""
    good = is_qualified(results)
    whole = kb_context(results).join(good.where("qualified").select("query_id"), "query_id", "left_semi")
    old = legacy_kb_context(results).join(good.where("not qualified").select("query_id"), "query_id", "left_semi")
    kb = whole.unionByName(old).withColumnRenamed("context", "_kb")
    out = queries.select("query_id").join(web_context(web).withColumnRenamed("context", "_web"), "query_id", "left").join(kb, "query_id", "left")
    body = F.array_join(F.array_compact(F.array(F.nullif("_web", F.lit("")), F.nullif("_kb", F.lit("")))), "\n\n")
    return out.select("query_id", F.coalesce(F.nullif(body, F.lit("")), F.lit("No sources available.")).alias("context"))


def pair_scores(pairs: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], count: Callable[[str], int], batch: int = PAIR_BATCH, most: int = PAIR_TOKENS) -> DataFrame:
    """``pairs`` (query_id, unit_id, query, text) with the scorer's value, in batches; a pair above ``most`` tokens fails."""

    def run(batches):
        for pdf in batches:
            texts = list(zip(pdf["query"], pdf["text"], strict=True))
            for a, b in texts:
                if count(a) + count(b) > most:
                    raise ValueError(f"a pair has more than {most} tokens")
            values = [v for at in range(0, len(texts), batch) for v in score(texts[at : at + batch])]
            yield pd.DataFrame({"query_id": pdf["query_id"], "unit_id": pdf["unit_id"], "score": values})

    return pairs.select("query_id", "unit_id", "query", "text").mapInPandas(run, "query_id long, unit_id long, score double")


def reranked(scores: DataFrame, k: int) -> DataFrame:
    """Ranks by falling score, then id."""
    return lexical.top_k(scores, k)


def clip_violations(shown: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, unit_id, error): packed rows that are not shown, shown rows that are not packed, and rows whose text was clipped.

    ``shown`` is (query_id, unit_id, text_sha256), ``packed`` likewise.
    """
    a, b = packed.select("query_id", "unit_id", F.col("text_sha256").alias("_p")), shown.select("query_id", "unit_id", F.col("text_sha256").alias("_s"))
    why = F.when(F.col("_s").isNull(), "dropped").when(F.col("_p").isNull(), "not_packed").when(F.col("_p") != F.col("_s"), "clipped")
    return a.join(b, ["query_id", "unit_id"], "full_outer").select("query_id", "unit_id", why.alias("error")).where("error is not null")


def exposure_arms(sources: DataFrame, windows: DataFrame, prefixes: dict[str, int]) -> DataFrame:
    """Which gold windows (source_id, window_id, s, e) of sources (source_id, kind, length) each arm shows: A a prefix by kind, B the whole text, C the merged gold windows."""
    from ..functions.intervals import islands

    limit = F.lit(None).cast("int")
    for kind, n in prefixes.items():
        limit = F.when(F.col("kind") == kind, F.lit(n)).otherwise(limit)
    w = windows.join(sources, "source_id", "left")
    inside = F.coalesce((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("length")), F.lit(False))
    merged = islands(windows.join(sources, "source_id").where(inside), ["source_id"]).groupBy("source_id").agg(F.sum(F.col("e") - F.col("s")).alias("gold_chars"))
    return w.join(merged, "source_id", "left").select(
        "source_id", "window_id", F.coalesce(F.col("e") <= F.least("length", limit), F.lit(False)).alias("in_prefix"), inside.alias("in_whole"), inside.alias("in_gold"), F.coalesce("gold_chars", F.lit(0)).alias("gold_chars")
    )


def requirement_visibility(shown: DataFrame, arm: str) -> DataFrame:
    """Per requirement (requirement, window columns of ``exposure_arms``): whether any and whether all of its windows are shown."""
    return shown.groupBy("requirement").agg(F.bool_or(arm).alias("any_visible"), F.bool_and(arm).alias("all_visible"), F.count("*").alias("windows"))


def gate_eligible(state: DataFrame) -> DataFrame:
    """(run_id, verified, reflected, eligible): the conjunctions that let a draft reach its reader.

    Verification: not ended, cost below the gate, draft valid, inventory current, identity equal, all three policies.
    Reflection: of the same draft, by a judge that was called and understood, with a whole score from the floor to 10.
    """
    c = F.col
    sure = lambda x: F.coalesce(x, F.lit(False))
    verified = sure(c("terminal_status").isNull() & (c("cost_usd") < 0.10) & c("draft_valid") & c("inventory_current") & (c("verification_identity") == c("identity")) & c("semantic_ok") & c("material_ok") & c("citation_ok"))
    reflected = sure((c("reflection_identity") == c("identity")) & (c("origin") == "judge") & c("provider_called") & (c("parse_status") == "ok") & c("score").between(REFLECTION_FLOOR, 10))
    return state.select("run_id", verified.alias("verified"), reflected.alias("reflected"), (verified & reflected).alias("eligible"))


def runtime_acceptance(status: Column, n: Column, uvr: Column, limit: float = 0.15) -> Column:
    """'accepted' or the first reason against."""
    return F.when(~status.eqNullSafe(F.lit("completed")), "status_not_completed").when(F.coalesce(n, F.lit(0)) == 0, "empty_report").when(uvr.isNull(), "uvr_undefined").when(uvr > limit, "uvr_above_threshold").otherwise("accepted")


def total_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """(tokens, basis): the provider's total, else the sum of both parts; basis ``invalid`` or ``incomplete`` without either."""
    given = total.isNotNull()
    parts = (prompt >= 0) & (completion >= 0)
    basis = F.when(given & (total >= 0), "provider").when(given, "invalid").when(F.coalesce(parts, F.lit(False)), "component_sum").otherwise("incomplete")
    return F.struct(F.when(basis == "provider", total).when(basis == "component_sum", prompt + completion).alias("tokens"), basis.alias("basis"))


def cost_preflight(cells: DataFrame, rate_in: float, rate_out: float, ceiling: float) -> DataFrame:
    """Upper cost of planned calls (cell, chars, max_tokens): a character counts as a token; with whether the sum stays below the ceiling."""
    one = F.col("chars") * rate_in / 1e6 + F.col("max_tokens") * rate_out / 1e6
    return cells.agg(F.count("*").alias("cells"), F.round(F.sum(one), 8).alias("upper_usd"), (F.sum(one) <= ceiling).alias("allowed"))


def review_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, and the unverified claims in order, each cut to 200 characters."""
    open_ = F.array_sort(F.collect_list(F.when(F.col("status") == "unverified", F.struct("place", F.substring(F.coalesce("claim", F.lit("")), 1, 200).alias("t")))))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return report.groupBy(*keys).agg(n("verified"), n("weak"), n("unverified"), F.array_join(F.transform(open_, lambda x: x["t"]), "\n").alias("open_claims"))


def blocker_feedback(obligations: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered lines of the blocking obligations (claim, status, kinds) of a run."""
    rows = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), "status", F.lit("] "), F.coalesce("claim", F.lit("")), F.lit(" ("), F.array_join("kinds", ", "), F.lit(")")).alias("t"))))
    numbered = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"]))
    return obligations.where("blocking").groupBy(*keys).agg(F.array_join(numbered, "\n").alias("feedback"))


def structural_check(description: Column, draft: Column) -> Column:
    """Whether a described passage stands in the draft; null without a description."""
    wanted = F.trim(F.coalesce(description, F.lit("")))
    return F.when(wanted != "", F.contains(F.coalesce(draft, F.lit("")), wanted))


def bibliography(cited: DataFrame, web: DataFrame, kb: DataFrame, runs: DataFrame, most: int = 3) -> DataFrame:
    """(run_id, number, kind, label): cited sources in first-seen order; without any, the best web sources, and without those the first kb ones.

    ``cited`` is (run_id, place, kind, label), ``web`` (run_id, url, score), ``kb`` (run_id, place, source).
    """
    first = cited.groupBy("run_id", "kind", "label").agg(F.min("place").alias("place"))
    own = first.select("run_id", "kind", "label", F.row_number().over(Window.partitionBy("run_id").orderBy("place", "kind", "label")).alias("number"))
    bare = runs.select("run_id").distinct().join(own.select("run_id"), "run_id", "left_anti")
    best = web.groupBy("run_id", "url").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score")).join(bare, "run_id")
    best = best.select("run_id", F.lit("web").alias("kind"), F.col("url").alias("label"), F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "url")).alias("number")).where(F.col("number") <= most)
    left = bare.join(best.select("run_id"), "run_id", "left_anti")
    files = kb.groupBy("run_id", "source").agg(F.min("place").alias("place")).join(left, "run_id")
    files = files.select("run_id", F.lit("kb").alias("kind"), F.col("source").alias("label"), F.row_number().over(Window.partitionBy("run_id").orderBy("place", "source")).alias("number")).where(F.col("number") <= most)
    return own.unionByName(best).unionByName(files)


def line_span(text: Column, first: Column, last: Column) -> Column:
    """(start, end) in characters of lines ``first`` to ``last`` (from 1), without the line end of the last; null where there are no such lines."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, 1, F.greatest(first - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.length(x) + 1)
    inside = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")
    good = (first >= 1) & (last >= first) & (last <= F.size(lines))
    return F.when(good, F.struct(before.alias("start"), (before + F.length(F.regexp_replace(inside, r"[\r\n]+\z", ""))).alias("end")))


def numbered_roster(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """claim-001, claim-002, ... with each claim's text and its whole length as span."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, F.format_string("claim-%03d", nth).alias("claim_id"), F.col(text).alias("claim_text"), F.lit(0).alias("start"), F.length(text).alias("end"))


def ingest_report(files: DataFrame, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(path, status) of files (path, content): ok, unsupported or empty, in order of path."""
    known = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes)
    return files.select("path", F.when(~known, "unsupported").when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty").otherwise("ok").alias("status"))


def merged_materiality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One materiality per canonical text: true before unknown before false."""
    rank = F.when(F.col("material") == "true", 2).when(F.col("material") == "unknown", 1).otherwise(0)
    top = rows.groupBy(*keys, "canonical").agg(F.max(rank).alias("m"))
    return top.select(*keys, "canonical", F.when(F.col("m") == 2, "true").when(F.col("m") == 1, "unknown").otherwise("false").alias("material"))
