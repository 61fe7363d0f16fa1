"""Material-content and citation policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import places
from ..functions.text import occurrences

MARKER = r"\[((?:WEB|KB)-\d{3}|E\d+)\]"


def requirement_states(requirements: DataFrame, links: DataFrame) -> DataFrame:
    """(req_id, state): SATISFIED, MISSING, UNKNOWN or UNRESOLVED.

    ``requirements`` has (req_id, structural: boolean or null); ``links`` has
    (req_id, claim_id, material, resolved). Precedence: met structurally, no
    links, a link of unknown materiality, an unresolved link, not met
    structurally, met.
    """
    by = links.groupBy("req_id").agg(F.count("*").alias("n"), F.bool_or(F.col("material") == "unknown").alias("unknown"), F.bool_or(~F.col("resolved")).alias("open"))
    out = requirements.join(by, "req_id", "left")
    state = (
        F.when(F.coalesce(F.col("structural"), F.lit(False)), "SATISFIED")
        .when(F.coalesce(F.col("n"), F.lit(0)) == 0, "MISSING")
        .when(F.col("unknown"), "UNKNOWN")
        .when(F.col("open"), "UNRESOLVED")
        .when(~F.coalesce(F.col("structural"), F.lit(True)), "MISSING")
        .otherwise("SATISFIED")
    )
    return out.select("req_id", state.alias("state"))


def material_decision(states: DataFrame, attempts: Column, limit: int = 2) -> DataFrame:
    counts = states.agg(F.count_if(F.col("state") == "UNKNOWN").alias("unknown"), F.count_if(F.col("state").isin("MISSING", "UNRESOLVED")).alias("open"))
    decision = F.when((F.col("unknown") == 0) & (F.col("open") == 0), "pass").when(F.col("unknown") > 0, "review").when(attempts < limit, "revise").otherwise("exhausted")
    return counts.withColumn("decision", decision)


def citation_plan(claims: DataFrame) -> DataFrame:
    """Groups of claims with one (doc_id, start, end): ordered ids, required evidence in first-seen order."""
    ordered = F.array_sort(F.collect_list(F.struct("claim_id", "evidence_ids")))
    return claims.groupBy("doc_id", "start", "end").agg(ordered.alias("g")).select(
        "doc_id", "start", "end",
        F.array_distinct(F.transform("g", lambda x: x["claim_id"])).alias("claim_ids"),
        F.array_distinct(F.flatten(F.transform("g", lambda x: x["evidence_ids"]))).alias("evidence_ids"),
    )


def placement_conflicts(groups: DataFrame) -> DataFrame:
    """Pairs of groups of one document that overlap without being equal.

    Found by neighbours in start order: a group conflicts if it starts before the
    furthest end so far; the partner that reaches furthest is named.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    far = F.max(F.struct("end", "start")).over(order)
    return groups.withColumn("far", far).where(F.col("start") < F.col("far.end")).select("doc_id", "start", "end", F.col("far.start").alias("with_start"), F.col("far.end").alias("with_end"))


def markers(texts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, evidence_id, place): every citation marker with its offset in code points."""
    found = F.zip_with(places(F.col(text), MARKER), F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda p, name: F.struct(name.alias("evidence_id"), p["start"].alias("place")))
    return texts.where(F.col(text).isNotNull()).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")


def citation_coverage(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Required slots of each group against the markers right behind it (from its start to one past its end)."""
    slots = groups.select("doc_id", "start", "end", F.explode("evidence_ids").alias("evidence_id"))
    near = slots.join(found, ["doc_id", "evidence_id"]).where((F.col("place") >= F.col("start")) & (F.col("place") <= F.col("end") + 1))
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "evidence_id", "place").orderBy("start", "end"))).where("_r = 1")
    covered = first.select("doc_id", "start", "end", "evidence_id").distinct().withColumn("_c", F.lit(1))
    out = slots.join(covered, ["doc_id", "start", "end", "evidence_id"], "left").groupBy("doc_id").agg(F.count("*").alias("required"), F.count("_c").alias("covered"))
    return out.withColumn("missing", F.col("required") - F.col("covered")).withColumn("coverage", F.round(F.col("covered") / F.col("required"), 6))


def insert_markers(text: Column, places: Column) -> Column:
    """Insert (place, marker) structs, the highest offset first, so that earlier offsets stay right."""
    ordered = F.reverse(F.array_sort(places))
    return F.aggregate(ordered, text, lambda t, p: F.concat(F.substr(t, F.lit(1), p["place"]), p["marker"], F.substr(t, p["place"] + 1)))


def bibliography(cited: DataFrame) -> DataFrame:
    """(doc_id, evidence_id, number): evidence numbered by first place."""
    first = cited.groupBy("doc_id", "evidence_id").agg(F.min("place").alias("place"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "evidence_id"))).drop("place")


def integrity_failure(runs: DataFrame, claims: DataFrame, report: DataFrame) -> DataFrame:
    """(run_id, reason): why the inputs cannot certify the current draft, the first that holds; null if nothing does.

    ``runs`` is (run_id, has_inventory, inventory_sha, draft), ``claims`` (run_id, claim_id, validity), ``report`` (run_id, claim_id).
    """

    def roster(rows: DataFrame, name: str) -> DataFrame:
        blank = F.coalesce("claim_id", F.lit("")) == ""
        return rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.coalesce("claim_id", F.lit("")))).alias(name), F.bool_or(blank).alias(f"{name}_blank"))

    anchors = claims.groupBy("run_id").agg(F.bool_or(F.col("validity").isin("ANCHOR_FAILED", "ANCHOR_AMBIGUOUS")).alias("open"))
    out = runs.join(anchors, "run_id", "left").join(roster(claims, "want"), "run_id", "left").join(roster(report, "got"), "run_id", "left")
    none = F.array().cast("array<string>")
    want, got = F.coalesce("want", none), F.coalesce("got", none)
    blank = F.coalesce("want_blank", F.lit(False)) | F.coalesce("got_blank", F.lit(False))
    reason = (
        F.when(~F.col("has_inventory"), "missing_inventory").when(~F.col("inventory_sha").eqNullSafe(F.sha2(F.coalesce("draft", F.lit("")), 256)), "stale_inventory_draft_sha").when(F.coalesce("open", F.lit(False)), "unresolved_anchor")
        .when(blank | (F.size(F.array_distinct(want)) < F.size(want)) | (want != got), "grounding_roster_mismatch")
    )
    return out.select("run_id", reason.alias("reason"))


def material_resolution(claims: DataFrame, report: DataFrame) -> DataFrame:
    """(run_id, claim_id, resolution) of material claims against their report rows (run_id, claim_id, status, validity, blocked)."""
    rows = report.select("run_id", "claim_id", "status", F.col("validity").alias("_v"), "blocked", F.lit(True).alias("_row"))
    out = claims.where("material = 'true'").select("run_id", "claim_id").join(rows, ["run_id", "claim_id"], "left")
    why = (
        F.when(F.col("_row").isNull(), "missing_semantic_disposition").when(F.upper(F.coalesce("_v", F.lit("VALID"))) != "VALID", "invalid_analysis_validity")
        .when(~F.col("status").eqNullSafe(F.lit("verified")), F.concat(F.lit("semantic_status_"), F.coalesce("status", F.lit("None")))).when(F.coalesce("blocked", F.lit(False)), "unresolved_applicable_blocker").otherwise("resolved")
    )
    return out.select("run_id", "claim_id", why.alias("resolution"))


def requirement_outcomes(requirements: DataFrame, links: DataFrame, claims: DataFrame, resolution: DataFrame) -> DataFrame:
    """(run_id, req_id, state, reason) of mandatory requirements.

    ``requirements`` is (run_id, req_id, structural: true, false or null where no check of the draft exists), ``links`` (run_id, claim_id, req_id).
    """
    linked = links.join(claims.select("run_id", "claim_id", "material"), ["run_id", "claim_id"]).join(resolution, ["run_id", "claim_id"], "left")
    by = linked.groupBy("run_id", "req_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("material") == "unknown").alias("unknown"), F.bool_or((F.col("material") == "true") & (F.coalesce("resolution", F.lit("")) != "resolved")).alias("open")
    )
    out = requirements.join(by, ["run_id", "req_id"], "left")
    checked, met = F.col("structural").isNotNull(), F.coalesce("structural", F.lit(False))
    state = F.coalesce(
        F.when(met, F.lit("SATISFIED:structural_check_passed")),
        F.when(F.col("n").isNull(), F.when(checked, F.lit("MISSING:structural_check_failed")).otherwise(F.lit("MISSING:no_linked_current_claims"))),
        F.when(F.col("unknown"), F.lit("UNKNOWN:linked_unknown_materiality_claim")),
        F.when(F.col("open"), F.lit("UNRESOLVED:supported_by_unresolved_material_claim")),
        F.when(checked, F.lit("MISSING:structural_check_failed")),
        F.lit("UNKNOWN:semantic_coverage_unqualified"),
    )
    return out.select("run_id", "req_id", F.substring_index(state, ":", 1).alias("state"), F.substring_index(state, ":", -1).alias("reason"))


def material_result(runs: DataFrame, claims: DataFrame, resolution: DataFrame, outcomes: DataFrame, max_iterations: int = 2) -> DataFrame:
    """One row per run (run_id, iterations): rate, counts, reason codes, safety state and decision."""
    c = claims.groupBy("run_id").agg(F.count_if(F.col("material") == "unknown").alias("unknown_material"), F.count_if(F.col("claim_type") == "factual").alias("factual"))
    r = resolution.groupBy("run_id").agg(
        F.count("*").alias("material"), F.count_if(F.col("resolution") == "resolved").alias("resolved"), F.count_if(F.col("resolution") != "resolved").alias("unresolved"), F.count_if(F.col("resolution") == "invalid_analysis_validity").alias("invalid")
    )
    q = outcomes.groupBy("run_id").agg(*[F.count_if(F.col("state") == s).alias(f"req_{s.lower()}") for s in ("UNKNOWN", "MISSING", "UNRESOLVED", "SATISFIED")])
    out = runs.join(c, "run_id", "left").join(r, "run_id", "left").join(q, "run_id", "left")
    out = out.fillna(0, [x for x in out.columns if x not in ("run_id", "iterations")])
    n = F.col
    reasons = F.array_compact(
        F.array(
            F.when(n("unknown_material") > 0, F.lit("unknown_materiality")), F.when(n("req_unknown") > 0, F.lit("unknown_mandatory_requirement")), F.when(n("invalid") > 0, F.lit("invalid_material_claim")),
            F.when(n("unresolved") > 0, F.lit("unresolved_material_claim")), F.when(n("req_missing") > 0, F.lit("missing_mandatory_requirement")), F.when(n("req_unresolved") > 0, F.lit("unresolved_mandatory_requirement")),
        )
    )
    state = F.when(F.size("reasons") == 0, "pass").when((n("unknown_material") > 0) | (n("req_unknown") > 0) | (n("invalid") > 0), "unknown_materiality").when(n("iterations") >= max_iterations, "exhausted").otherwise("repairable")
    decision = F.when(n("state") == "pass", "pass").when(n("state") == "repairable", "revision").otherwise("hitl")
    out = out.withColumn("reasons", reasons).withColumn("state", state)
    return out.select(
        "run_id", F.round(n("resolved") / F.nullif("material", F.lit(0)), 6).alias("verified_rate"), "factual", "material", "resolved", "unresolved", F.array_join("reasons", ",").alias("reason_codes"), "state", decision.alias("decision")
    )


def applicable_groups(claims: DataFrame, report: DataFrame, support: DataFrame) -> DataFrame:
    """Anchor groups (run_id, start, end, claim_ids, required): claims that are material, valid and verified at one occurrence, and their evidence, first seen first.

    ``claims`` is (run_id, ordinal, claim_id, material, occurrences: array of start, end), ``support`` (run_id, claim_id, place, evidence_id).
    """
    good = report.where((F.upper(F.coalesce("validity", F.lit("VALID"))) == "VALID") & (F.col("status") == "verified")).select("run_id", "claim_id")
    kept = claims.where("material = 'true'").join(good, ["run_id", "claim_id"], "left_semi")
    own = support.groupBy("run_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))).alias("e"))
    flat = kept.join(own, ["run_id", "claim_id"], "left").select("run_id", "ordinal", "claim_id", F.coalesce(F.transform("e", lambda x: x["evidence_id"]), F.array().cast("array<string>")).alias("e"), F.explode("occurrences").alias("o"))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "claim_id", "e")))
    grouped = flat.where(F.col("o.end") > F.col("o.start")).groupBy("run_id", F.col("o.start").alias("start"), F.col("o.end").alias("end")).agg(rows.alias("g"))
    return grouped.select("run_id", "start", "end", F.array_distinct(F.transform("g", lambda x: x["claim_id"])).alias("claim_ids"), F.array_distinct(F.flatten(F.transform("g", lambda x: x["e"]))).alias("required"))


def plan_staleness(plans: DataFrame, current: DataFrame) -> DataFrame:
    """(run_id, reason) of supplied plans (run_id, draft_sha, claim_roster, grounding_roster, groups digest) against the current ones; an empty roster is not compared."""
    now = current.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("draft_sha", "claim_roster", "grounding_roster", "groups")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    found = F.array_compact(
        F.array(
            F.when(differs("draft_sha"), F.lit("stale_citation_plan_draft_sha")), F.when(filled("claim_roster") & differs("claim_roster"), F.lit("stale_citation_plan_claim_roster")),
            F.when(filled("grounding_roster") & differs("grounding_roster"), F.lit("stale_citation_plan_grounding_roster")), F.when(differs("groups"), F.lit("stale_citation_plan_support")),
        )
    )
    return plans.join(now, "run_id").select("run_id", F.explode(found).alias("reason"))


def evidence_registry(provided: DataFrame, web: DataFrame, kb: DataFrame, support: DataFrame, limit: int = 5) -> DataFrame:
    """(run_id, evidence_id, kind): what is given, then the first web and kb results by number, then what only a support span names."""
    number = lambda rows, kind: rows.where(F.col("place") <= limit).select("run_id", F.format_string(f"{kind.upper()}-%03d", "place").alias("evidence_id"), F.lit(kind).alias("kind"))
    parts = [provided.select("run_id", "evidence_id", "kind"), number(web, "web"), number(kb, "kb"), support.select("run_id", "evidence_id", F.lit("unknown").alias("kind"))]
    every = None
    for n, part in enumerate(parts):
        part = part.withColumn("_n", F.lit(n))
        every = part if every is None else every.unionByName(part)
    return every.where("coalesce(evidence_id, '') <> ''").groupBy("run_id", "evidence_id").agg(F.min_by("kind", "_n").alias("kind"))


def citation_result(runs: DataFrame, groups: DataFrame, cites: DataFrame, registry: DataFrame, overlay: DataFrame) -> DataFrame:
    """One row per run: counts of missing, extra, misplaced and dangling citations, coverage, state and reasons.

    ``groups`` come from ``applicable_groups``; ``cites`` (run_id, place, evidence_id) are the draft's own markers;
    ``overlay`` (run_id, start, end, evidence_ids) replaces what is rendered wherever a run has one. A marker belongs to
    the first group that it stands in or right behind. Groups that cross or share one end make the placement ambiguous,
    as does a marker at a group inside another. A draft's groups are compared within the draft.
    """
    g = groups.select("run_id", "start", "end", "required")
    a, b = g.select("run_id", F.col("start").alias("s1"), F.col("end").alias("e1")), g.select("run_id", F.col("start").alias("s2"), F.col("end").alias("e2"))
    meet = a.join(b, "run_id").where("(s1 < s2 or (s1 = s2 and e1 < e2)) and s1 < e2 and s2 < e1")
    inside = (F.col("s1") < F.col("s2")) & (F.col("e2") < F.col("e1"))
    crossing = meet.where(~inside).select("run_id").distinct().withColumn("why", F.lit("overlapping_nonidentical_anchors"))
    inner = meet.where(inside).select("run_id", "s2", "e2").distinct().join(cites, "run_id").where("place >= s2 and place <= e2 + 1").select("run_id").distinct()
    inner = inner.join(crossing, "run_id", "left_anti").withColumn("why", F.lit("ambiguous_nested_model_citation"))
    failed = crossing.unionByName(inner)

    placed = cites.join(g.select("run_id", "start", "end"), "run_id").where("place >= start and place <= end + 1")
    placed = placed.withColumn("_r", F.row_number().over(Window.partitionBy("run_id", "place", "evidence_id").orderBy("start", "end"))).where("_r = 1").drop("_r")
    loose = cites.join(placed.select("run_id", "place", "evidence_id"), ["run_id", "place", "evidence_id"], "left_anti")
    here = placed.groupBy("run_id", "start", "end").agg(F.array_sort(F.collect_set("evidence_id")).alias("model"))
    none = F.array().cast("array<string>")
    laid = overlay.select("run_id").distinct().withColumn("_laid", F.lit(True))
    out = g.join(here, ["run_id", "start", "end"], "left").join(overlay.withColumnRenamed("evidence_ids", "over"), ["run_id", "start", "end"], "left").join(laid, "run_id", "left")
    attached = F.when(F.col("_laid"), F.coalesce("over", none)).otherwise(F.col("required"))
    out = out.withColumn("rendered", F.array_distinct(F.concat(attached, F.coalesce("model", none))))
    out = out.withColumn("missing", F.array_except("required", "rendered")).withColumn("extra", F.array_except("rendered", "required"))
    per = out.groupBy("run_id").agg(
        F.count("*").alias("n_groups"), F.sum(F.when(F.size("required") == 0, 1).otherwise(F.size("missing"))).alias("missing"), F.sum(F.size("extra")).alias("extra"),
        F.count_if((F.size("required") > 0) & (F.size("rendered") == 0)).alias("misplaced"), F.sum(F.size("required")).alias("slots"), F.sum(F.size(F.array_intersect("required", "rendered"))).alias("covered"),
        F.array_distinct(F.flatten(F.collect_list("required"))).alias("all_required"), F.array_distinct(F.flatten(F.collect_list("missing"))).alias("all_missing"),
    )
    known = per.select("run_id", "all_required", "all_missing")
    stray = loose.join(known, "run_id", "left").groupBy("run_id").agg(
        F.count_if(~F.coalesce(F.array_contains("all_required", F.col("evidence_id")), F.lit(False))).alias("stray_extra"), F.count_if(F.coalesce(F.array_contains("all_missing", F.col("evidence_id")), F.lit(False))).alias("stray_misplaced")
    )
    shown = out.select("run_id", F.explode("rendered").alias("evidence_id")).unionByName(loose.select("run_id", "evidence_id")).distinct()
    dangling = shown.join(registry.select("run_id", "evidence_id"), ["run_id", "evidence_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("dangling"))
    total = runs.select("run_id").join(per.drop("all_required", "all_missing"), "run_id", "left").join(stray, "run_id", "left").join(dangling, "run_id", "left").fillna(0).join(failed, "run_id", "left")
    total = total.withColumn("extra", F.col("extra") + F.col("stray_extra")).withColumn("misplaced", F.col("misplaced") + F.col("stray_misplaced"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("missing") > 0, F.lit("missing_required_citation")), F.when(F.col("extra") > 0, F.lit("unsupported_extra_citation")), F.when(F.col("misplaced") > 0, F.lit("citation_placement_failure")),
            F.when(F.col("dangling") > 0, F.lit("dangling_citation")),
        )
    )
    open_ = F.col("why").isNull()
    state = F.when(~open_, "placement_integrity_failure").when(F.size(reasons) == 0, "citation_policy_pass").otherwise("citation_hitl_required")
    counts = [F.when(open_, F.col(c)).otherwise(1 if c == "misplaced" else 0).cast("long").alias(c) for c in ("missing", "extra", "misplaced", "dangling")]
    return total.select("run_id", "n_groups", *counts, F.when(open_, F.round(F.col("covered") / F.nullif("slots", F.lit(0)), 6)).alias("coverage"), state.alias("state"), F.when(open_, F.array_join(reasons, ",")).otherwise(F.col("why")).alias("reason_codes"))


def cluster_html(groups: DataFrame, numbers: DataFrame) -> DataFrame:
    """(run_id, start, end, html): each group's evidence as one cluster of numbered links; ``numbers`` is (run_id, evidence_id, number)."""
    flat = groups.select("run_id", "start", "end", F.explode("required").alias("evidence_id")).join(numbers, ["run_id", "evidence_id"])
    link = F.concat(F.lit('<a href="#ref-'), F.col("number").cast("string"), F.lit('">'), F.col("number").cast("string"), F.lit("</a>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("number", link.alias("a")))), lambda x: x["a"])
    return flat.groupBy("run_id", "start", "end").agg(F.concat(F.lit("<sup>["), F.array_join(rows, ", "), F.lit("]</sup>")).alias("html"))


def nth_occurrence(text: Column, quote: Column, place: Column) -> Column:
    """Which occurrence of ``quote`` in ``text`` the one at ``place`` (from 0) is, from 0; overlapping ones count."""
    return F.size(F.filter(occurrences(text, quote), lambda i: i < place))
