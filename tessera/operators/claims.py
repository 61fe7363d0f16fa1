"""Claims and evidence: inventory, manifest, adjudication, obligations, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UVR_LIMIT = 0.15
WEIGHTS = {"strongly_verified": 1.0, "verified": 1.0, "weak": 0.75, "unverified": 0.0}
MATERIAL_ORDER = ("false", "unknown", "true")


def material_rank(material: Column) -> Column:
    return F.when(material == "true", 2).when(material == "unknown", 1).otherwise(0)


def requires_citation(claim_type: Column, material: Column, given: Column) -> Column:
    return F.when((claim_type == "factual") & (material != "false"), True).when((claim_type == "definition") & (material == "true"), True).otherwise(given)


def build_inventory(rows: DataFrame) -> DataFrame:
    """One row per claim id from rows (claim_id, pos, section, claim_type, material, reason, starts, ambiguous, req_ids, requires_citation).

    Section and type come from the first row; starts are united; materiality
    escalates true > unknown > false; one ambiguous row makes the claim
    ambiguous, otherwise validity follows the number of united starts.
    """
    first = lambda c: F.min_by(c, "pos")
    reason = F.when(F.coalesce(F.col("reason"), F.lit("")) != "", F.col("pos"))
    # Rows that agree in what is collected below count as one, so a sentence that stands everywhere stays small.
    alike = rows.groupBy("claim_id", "starts", "req_ids").agg(
        first("section").alias("section"), first("claim_type").alias("claim_type"), F.max(material_rank(F.col("material"))).alias("m"), F.min_by("reason", reason).alias("reason"), F.min(reason).alias("_reason_pos"),
        F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("requires_citation").alias("requires_citation"), F.count("*").alias("n"), F.min("pos").alias("pos"),
    )
    merged = alike.groupBy("claim_id").agg(
        first("section").alias("section"),
        first("claim_type").alias("claim_type"),
        F.max("m").alias("m"),
        F.min_by("reason", "_reason_pos").alias("reason"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("starts"),
        F.bool_or("ambiguous").alias("ambiguous"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "req_ids"))), lambda x: x["req_ids"]))).alias("req_ids"),
        F.bool_or("requires_citation").alias("given"),
        F.sum("n").alias("n_rows"),
    )
    n = F.size("starts")
    merged = merged.withColumn("material", F.when(F.col("m") == 2, "true").when(F.col("m") == 1, "unknown").otherwise("false"))
    merged = merged.withColumn("validity", F.when(F.col("ambiguous"), "ANCHOR_AMBIGUOUS").when(n == 0, "ANCHOR_FAILED").when(n == 1, "bound").otherwise("bound_multiple"))
    return merged.withColumn("requires_citation", requires_citation(F.col("claim_type"), F.col("material"), F.col("given"))).drop("m", "ambiguous", "given")


def inventory_counts(inventory: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Counts by type (zeros appear), materiality and anchor validity as (kind, name, n)."""
    named = lambda kind, col, names: [F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("name"), F.count_if(F.col(col) == v).alias("n")) for v in names]
    cells = named("type", "claim_type", types) + named("material", "material", MATERIAL_ORDER) + named("anchor", "validity", ("bound", "bound_multiple", "ANCHOR_FAILED", "ANCHOR_AMBIGUOUS"))
    return inventory.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def critical_failures(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("validity").isin("ANCHOR_FAILED", "ANCHOR_AMBIGUOUS"))


def roster(inventory: DataFrame) -> DataFrame:
    """Claims that bind, with their first place."""
    return inventory.where(F.size("starts") > 0).select("claim_id", F.element_at("starts", 1).alias("start"))


def evidence_manifest(web: DataFrame, kb: DataFrame, most_web: int = 5, most_kb: int | None = 5) -> DataFrame:
    """WEB-001.., KB-001..: the first rows of each kind by rank, with a digest of their text."""

    def numbered(rows: DataFrame, kind: str, most: int | None) -> DataFrame:
        r = rows.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "source_id")))
        r = r if most is None else r.where(F.col("n") <= most)
        return r.select("request_id", F.format_string(kind + "-%03d", "n").alias("evidence_id"), F.lit(kind).alias("kind"), "source_id", "source_text", F.sha2("source_text", 256).alias("source_sha256"))

    return numbered(web, "WEB", most_web).unionByName(numbered(kb, "KB", most_kb))


def broken_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.sha2("source_text", 256) != F.col("source_sha256"))


def claim_status(support: Column, entailed: Column, blocked: Column, vetoed: Column | None = None) -> Column:
    """verified, weak, unverified or INVALID."""
    stop = blocked if vetoed is None else blocked | vetoed
    return F.when(~support & entailed, "INVALID").when(~support, "unverified").when(entailed & ~stop, "verified").otherwise("weak")


def reason_codes(support: Column, entailed: Column, blocked: Column) -> Column:
    """What kept the claim from being verified, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(~support & entailed, F.lit("entailment_without_support")),
            F.when(~support, F.lit("no_support")),
            F.when(support & ~entailed, F.lit("partial_entailment")),
            F.when(blocked, F.lit("blocker_present")),
        )
    )


def span_error(start: Column, end: Column, length: Column) -> Column:
    """First broken bound of a half-open span, else null."""
    return F.when(start.isNull() | end.isNull(), "missing_offset").when(start < 0, "negative_start").when(end <= start, "empty_span").when(end > length, "past_end")


def adjudicate(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per roster claim and per foreign observation: claim_id, validity, status, reasons.

    ``observations`` has (claim_id, support, entailed, blocked). Missing and
    duplicate observations make a claim INVALID; observations of unknown claims
    are listed as extra.
    """
    seen = observations.groupBy("claim_id").agg(F.count("*").alias("n"), F.first("support").alias("support"), F.first("entailed").alias("entailed"), F.first("blocked").alias("blocked"))
    both = claims.select("claim_id").distinct().withColumn("_c", F.lit(True)).join(seen.withColumn("_o", F.lit(True)), "claim_id", "full_outer")
    status = claim_status(F.col("support"), F.col("entailed"), F.col("blocked"))
    errors = F.array_compact(
        F.array(
            F.when(F.col("_o").isNull(), F.lit("missing_observation")),
            F.when(F.col("_c").isNull(), F.lit("extra_observation")),
            F.when(F.col("n") > 1, F.lit("duplicate_observation")),
            F.when(F.col("_o") & (status == "INVALID"), F.lit("entailment_without_support")),
        )
    )
    out = both.withColumn("errors", errors)
    valid = F.size("errors") == 0
    return out.select("claim_id", F.when(valid, "VALID").otherwise("INVALID").alias("validity"), F.when(valid, status).alias("status"), F.array_join("errors", ",").alias("reasons"))


def rollup(report: DataFrame, keys: list[str]) -> DataFrame:
    """Status counts, unverified rate (null without rows) and the weighted grounding score."""
    s = F.col("status")
    score = F.lit(None).cast("double")
    for name, w in WEIGHTS.items():
        score = F.when(s == name, F.lit(w)).otherwise(score)
    n = F.count("*")
    return report.groupBy(*keys).agg(
        n.alias("n"),
        F.count_if(s == "verified").alias("n_verified"),
        F.count_if(s == "weak").alias("n_weak"),
        F.count_if(s == "unverified").alias("n_unverified"),
        F.round(F.count_if(s == "unverified") / n, 3).alias("uvr"),
        F.round(F.avg(F.coalesce(score, F.lit(0.0))), 3).alias("grounding"),
    )


def accepted(uvr: Column, *conditions: Column, limit: float = UVR_LIMIT) -> Column:
    """All conditions hold and the rate is known and within the limit."""
    ok = F.coalesce(uvr <= limit, F.lit(False))
    for c in conditions:
        ok = ok & F.coalesce(c, F.lit(False))
    return ok


def obligations(report: DataFrame) -> DataFrame:
    """Weak or unverified claims that need work; a weak one without blocker is left out."""
    weak = F.col("status") == "weak"
    todo = report.where(((F.col("status") == "unverified") | (weak & F.col("blocked"))))
    return todo.withColumn("blocking", F.coalesce(F.col("blocked"), F.lit(False)) & (F.coalesce(F.upper("validity"), F.lit("")) != "INVALID"))


def citation_url_source(report: DataFrame, web: DataFrame) -> DataFrame:
    """Where a row's source comes from: an exact web URL, a knowledge-base file, nothing, or unresolved."""
    out = report.join(web.select(F.col("url").alias("source_url"), F.lit(True).alias("_w")).distinct(), "source_url", "left")
    kind = F.when(F.coalesce(F.col("source_url"), F.lit("")) == "", "none").when(F.col("_w"), "web").when(F.col("kb_file").isNotNull(), "kb").otherwise("unresolved")
    return out.withColumn("source_kind", kind).drop("_w")
