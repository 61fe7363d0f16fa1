"""Quotes and spans of analyzer observations: binding, validation, adjudication, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKER_KINDS = ("contradiction", "limitation")
SPAN_FIELDS = ("evidence_id", "start", "end")


def bind_quotes(quotes: DataFrame, manifest: DataFrame) -> DataFrame:
    """``quotes`` (.., evidence_id, quote) with ``status`` and, where the quote stands exactly once in its evidence, ``start`` and ``end``.

    Exact text only; overlapping places count. ``manifest`` is (evidence_id, source_text).
    """
    held = manifest.select("evidence_id", F.col("source_text").alias("_t"))
    out = quotes.join(held, "evidence_id", "left").withColumn("_first", F.expr("coalesce(locate(quote, _t), 0)"))
    out = out.withColumn("_again", F.expr("case when _first > 0 then locate(quote, _t, _first + 1) else 0 end"))
    status = (
        F.when(F.coalesce("quote", F.lit("")) == "", "empty_quote").when(F.coalesce("evidence_id", F.lit("")) == "", "invalid_evidence_id").when(F.col("_t").isNull(), "invalid_evidence_id")
        .when(F.col("_first") == 0, "quote_not_found").when(F.col("_again") > 0, "ambiguous_quote").otherwise("bound")
    )
    one = status == "bound"
    out = out.withColumn("status", status).withColumn("start", F.when(one, F.col("_first") - 1)).withColumn("end", F.when(one, F.col("_first") - 1 + F.length("quote")))
    return out.drop("_t", "_first", "_again")


def bound_observations(bound: DataFrame, key: str = "claim_id") -> DataFrame:
    """One row per observation: its first quote that does not bind, in the order of (role, index), or its spans. ``bound`` also has role and index."""
    bad = F.when(F.col("status") != "bound", F.struct("role", "index", "status", "evidence_id"))
    spans = F.array_sort(F.collect_list(F.struct("role", "index", "evidence_id", "start", "end")))
    out = bound.groupBy(key).agg(F.min(bad).alias("bad"), spans.alias("spans"))
    return out.select(key, F.col("bad.status").alias("failure"), F.col("bad.evidence_id").alias("failed_evidence"), F.when(F.col("bad").isNull(), F.col("spans")).alias("spans"))


def span_codes(spans: DataFrame, manifest: DataFrame, request_id: str) -> DataFrame:
    """``spans`` (.., span: JSON text) with the first thing wrong with each, else null.

    ``manifest`` is (evidence_id, request_id, source_text, source_sha256, visible).
    Types are those of the JSON values: a number in a string, or true, is no offset.
    """
    value = lambda f: F.expr(f"variant_get(_v, '$.{f}', 'string')")
    kind = lambda f: F.expr(f"schema_of_variant(variant_get(_v, '$.{f}', 'variant'))")
    out = spans.withColumn("_v", F.expr("try_parse_json(span)")).withColumn("_keys", F.json_object_keys("span"))
    out = out.withColumn("_id", F.when(kind("evidence_id") == "STRING", value("evidence_id"))).withColumn("_s", F.when(kind("start") == "BIGINT", value("start").cast("long"))).withColumn("_e", F.when(kind("end") == "BIGINT", value("end").cast("long")))
    held = manifest.select(F.col("evidence_id").alias("_id"), F.col("request_id").alias("_request"), F.col("source_text").alias("_text"), F.col("source_sha256").alias("_sha"), F.col("visible").alias("_visible"))
    out = out.join(held, "_id", "left")
    code = (
        F.when(F.col("_keys").isNull(), "malformed_span")
        .when(F.exists("_keys", lambda k: ~k.isin(*SPAN_FIELDS)), "unknown_span_field")
        .when(F.size(F.array_intersect("_keys", F.array(*map(F.lit, SPAN_FIELDS)))) < len(SPAN_FIELDS), "missing_span_field")
        .when(F.col("_id").isNull(), "invalid_evidence_id_type")
        .when(F.col("_s").isNull(), "invalid_start_type")
        .when(F.col("_e").isNull(), "invalid_end_type")
        .when(F.col("_text").isNull(), "unknown_evidence_id")
        .when(F.col("_request") != request_id, "cross_request_evidence_reference")
        .when((F.coalesce("_sha", F.lit("")) != "") & (F.sha2("_text", 256) != F.col("_sha")), "stale_evidence_hash")
        .when(~F.coalesce("_visible", F.lit(True)), "invisible_evidence")
        .when(F.col("_s") < 0, "negative_span_start")
        .when(F.col("_e") <= F.col("_s"), "zero_or_negative_length_span")
        .when(F.col("_e") > F.length("_text"), "out_of_bounds_span")
    )
    return out.withColumn("code", code).drop(*[c for c in out.columns if c.startswith("_")])


def blocker_code(kind: Column, explanation: Column, valid_spans: Column) -> Column:
    """The first thing wrong with a blocker, else null. A contradiction needs a valid span, a limitation none."""
    return F.when(~F.coalesce(kind.isin(*BLOCKER_KINDS), F.lit(False)), "unknown_kind").when(F.coalesce(F.trim(explanation), F.lit("")) == "", "missing_explanation").when((kind == "contradiction") & (valid_spans == 0), "contradiction_requires_evidence_span")


def adjudicate(claims: DataFrame, observations: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per roster claim, and one with a null claim_id per request for what concerns no claim of the roster.

    ``observations`` has (request, claim_id, signature, n_support, full_entailment, kinds: blocker kinds, vetoed, errors).
    A second row for a claim makes it INVALID: a duplicate if it says the same, else a conflict.
    """
    o = observations.groupBy(key, "claim_id").agg(
        F.count("*").alias("n"), F.count_distinct("signature").alias("said"), F.flatten(F.collect_list("errors")).alias("own"), F.min(F.struct("signature", "n_support", "full_entailment", "kinds", "vetoed")).alias("o")
    )
    roster = claims.groupBy(key, "claim_id").agg(F.count("*").alias("listed"))
    both = roster.withColumn("_c", F.lit(True)).join(o, [key, "claim_id"], "full_outer")
    support, entailed, kinds, veto = F.col("o.n_support") > 0, F.col("o.full_entailment"), F.col("o.kinds"), F.col("o.vetoed")
    twice = F.when(F.col("n") > 1, F.when(F.col("said") > 1, F.array(F.lit("conflicting_duplicate_claim_row"))).otherwise(F.array(F.lit("duplicate_claim_row")))).otherwise(F.array().cast("array<string>"))
    wrong = F.when(F.col("n").isNull(), F.array(F.concat(F.lit("missing_claim_row:"), F.col("claim_id")))).otherwise(F.concat(F.array_sort(F.array_distinct("own")), twice))
    codes = F.array_compact(
        F.array(
            F.when(support, F.lit("MEANINGFUL_SUPPORT_PRESENT")).otherwise(F.lit("NO_MEANINGFUL_SUPPORT")), F.when(entailed, F.lit("FULL_ENTAILMENT_CLAIMED")),
            F.when(F.array_contains(kinds, "contradiction"), F.lit("BLOCKER_CONTRADICTION")), F.when(F.array_contains(kinds, "limitation"), F.lit("BLOCKER_LIMITATION")), F.when(veto, F.lit("DETERMINISTIC_FACT_VETO")),
        )
    )
    clean = F.size("wrong") == 0
    hollow = ~support & entailed
    stop = (F.size(kinds) > 0) | veto
    status = F.when(clean & ~hollow, F.when(~support, "unverified").when(entailed & ~stop, "verified").otherwise("weak"))
    rows = both.where("_c").withColumn("wrong", wrong).select(
        key, "claim_id", F.when(clean & ~hollow, "VALID").otherwise("INVALID").alias("validity"), status.alias("status"),
        F.when(clean & hollow, "no_support_with_full_entailment_true").otherwise(F.array_join("wrong", ",")).alias("invalid_reasons"), F.when(clean, F.array_join(codes, ",")).otherwise("").alias("reason_codes"),
    )
    foreign = both.where("_c is null").groupBy(key).agg(F.array_sort(F.collect_list(F.concat(F.lit("extra_claim_row:"), F.col("claim_id")))).alias("extra"))
    double = roster.where("listed > 1").select(key).distinct().withColumn("extra", F.array(F.lit("duplicate_claim_in_roster")))
    whole = foreign.unionByName(double).groupBy(key).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("extra"))), ",").alias("invalid_reasons"))
    return rows.unionByName(whole.select(key, F.lit(None).cast("string").alias("claim_id"), F.lit("INVALID").alias("validity"), F.lit(None).cast("string").alias("status"), "invalid_reasons", F.lit("").alias("reason_codes")))


def overall_validity(adjudicated: DataFrame, key: str = "request_id") -> DataFrame:
    return adjudicated.groupBy(key).agg(F.when(F.bool_and(F.col("validity") == "VALID"), "VALID").otherwise("INVALID").alias("validity"))


def grounding_rows(adjudicated: DataFrame, support: DataFrame, manifest: DataFrame, key: str = "request_id") -> DataFrame:
    """Report rows: status (unverified where none was given), where the first support span comes from, and the text of all support spans.

    ``support`` is (request, claim_id, place, evidence_id, start, end); ``manifest`` has (evidence_id, kind, url, source, source_text).
    """
    body = F.coalesce(F.substr("source_text", F.col("start") + 1, F.col("end") - F.col("start")), F.lit(""))
    # Cut before the aggregate, which would sort and spill the whole text with each span.
    spans = support.join(manifest.select("evidence_id", "kind", "url", "source", "source_text"), "evidence_id", "left").select(key, "claim_id", "place", "kind", "url", "source", body.alias("text"))
    first = F.min(F.struct("place", "kind", "url", "source"))
    per = spans.groupBy(key, "claim_id").agg(first.alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("texts"))
    out = adjudicated.where("claim_id is not null").join(per, [key, "claim_id"], "left")
    web, kb = F.col("first.kind") == "web", F.col("first.kind") == "kb"
    return out.select(
        key, "claim_id", F.coalesce("status", F.lit("unverified")).alias("status"), "validity", F.when(web, "web").when(kb, "kb").otherwise("none").alias("source_kind"),
        F.when(web, F.col("first.url")).alias("source_url"), F.when(web, F.col("first.url")).when(kb, F.concat(F.lit("kb:"), F.col("first.source"))).alias("source_ref"),
        F.array_join(F.coalesce("texts", F.array().cast("array<string>")), "|").alias("support_text"),
    )


def normalized_requirements(raw: DataFrame) -> DataFrame:
    """Requirements with an id, a description and a known mandatory mark; malformed ones go."""
    return raw.where((F.trim(F.coalesce("req_id", F.lit(""))) != "") & F.col("description").isNotNull() & F.col("mandatory").isNotNull())


def in_draft_order(report: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """``report`` rows with ``nth``, their place by the claims' order in the draft; rows of unknown claims come last in their own order (``place``)."""
    first = claims.groupBy(*keys, "claim_id").agg(F.min("ordinal").alias("_o"))
    out = report.join(first, [*keys, "claim_id"], "left")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_o").asc_nulls_last(), "place")) - 1).drop("_o")


def signoff(bundle: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a receipt signs each bundle (keys, claim_id, evidence_id, text) as it is now.

    The digest is over the rows in order of claim and evidence; a bundle with a row
    that lacks text, or with a row twice, has none.
    """
    rows = F.array_sort(F.collect_list(F.concat_ws("\x1f", "claim_id", "evidence_id", "text")))
    bad = F.bool_or(F.col("text").isNull() | (F.col("text") == "")) | (F.count_distinct("claim_id", "evidence_id") < F.count("*"))
    now = bundle.groupBy(*keys).agg(F.when(~bad, F.sha2(F.array_join(rows, "\x1e"), 256)).alias("digest"))
    out = now.join(receipts.select(*keys, F.col("digest").alias("signed")), keys, "left")
    state = F.when(F.col("digest").isNull(), "invalid_bundle").when(F.col("signed").isNull(), "unsigned").when(F.col("signed") != F.col("digest"), "stale").otherwise("signed")
    return out.select(*keys, state.alias("state"))
