"""Evidence rows: identities of units and intervals, hydration, matching of model rows to candidates, run folds, metric bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT = ("document_id", "document_version", "source_path", "source_sha256")
COST_LIMIT, ATTEMPTS = 0.10, 2


def same_document(left: str, right: str) -> Column:
    """Whether two structs agree in all that identifies a document."""
    out = F.lit(True)
    for c in DOCUMENT:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def interval_key(path: Column, spans: Column) -> Column:
    """One text for a path and its spans (start, end, role) in their order."""
    return F.concat_ws("|", path, F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["role"])), ";"))


def content_interval(spans: Column) -> Column:
    """(s, e) over spans that are all content and touch each other, else null."""
    good = (F.size(spans) > 0) & F.forall(spans, lambda s: s["role"] == "content")
    touching = F.size(F.filter(spans, lambda s, i: (i > 0) & (F.get(spans, i - 1)["end"] != s["start"]))) == 0
    return F.when(good & touching, F.struct(F.get(spans, F.lit(0))["start"].alias("s"), F.element_at(spans, -1)["end"].alias("e")))


def h1_only(segments: Column) -> Column:
    """Whether all segments (kind, level) but seams are first-level headings, and there is one."""
    solid = F.filter(segments, lambda s: s["kind"] != "seam")
    return (F.size(solid) > 0) & F.forall(solid, lambda s: (s["kind"] == "heading") & (s["level"] == 1))


def strip_columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.drop(*names)


def duplicate_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, interval, units): intervals that several units of one list have, which is an error."""
    return rows.groupBy(*keys, "interval").agg(F.count_distinct("unit_id").alias("units")).where("units > 1")


def hydrated(rows: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit's interval, and (row key, error) of rows that name no unit or one twice in a list (query_id)."""
    known = units.select("unit_id", "s", "e")
    out = rows.join(known, "unit_id", "left")
    n = F.count("*").over(Window.partitionBy("query_id", "unit_id"))
    why = F.when(F.col("s").isNull(), "unknown_unit").when(F.col("_n") > 1, "unit_twice")
    errors = out.withColumn("_n", n).select("query_id", "rank", why.alias("error")).where("error is not null")
    return out.where("s is not null"), errors


def metric_bundle(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), mrr_k: int = 10) -> DataFrame:
    """Long rows (query_id, metric, value): hit, source recall and precision at each k, and the reciprocal rank."""
    rel = ranked.join(gold.select("query_id", "source").distinct().withColumn("_g", F.lit(1)), ["query_id", "source"], "left")
    total = gold.groupBy("query_id").agg(F.count_distinct("source").alias("_n"))
    parts = []
    for k in ks:
        inside = (F.col("rank") <= k) & F.col("_g").isNotNull()
        parts += [
            F.max(F.when(inside, 1.0).otherwise(0.0)).alias(f"hit@{k}"), F.count_distinct(F.when(inside, F.col("source"))).alias(f"found@{k}"), (F.count_if(inside) / F.lit(float(k))).alias(f"precision@{k}")
        ]
    first = F.min(F.when((F.col("rank") <= mrr_k) & F.col("_g").isNotNull(), F.col("rank")))
    out = total.join(rel.groupBy("query_id").agg(*parts, F.coalesce(1.0 / first, F.lit(0.0)).alias(f"mrr@{mrr_k}")), "query_id", "left").fillna(0)
    cells = [F.struct(F.lit(c).alias("metric"), F.round(F.col(f"`{c}`"), 8).alias("value")) for k in ks for c in (f"hit@{k}", f"precision@{k}")]
    cells += [F.struct(F.lit(f"source_recall@{k}").alias("metric"), F.round(F.col(f"`found@{k}`") / F.col("_n"), 8).alias("value")) for k in ks]
    cells += [F.struct(F.lit(f"mrr@{mrr_k}").alias("metric"), F.round(F.col(f"`mrr@{mrr_k}`"), 8).alias("value"))]
    return out.select("query_id", F.explode(F.array(*cells)).alias("x")).select("query_id", "x.*")


def matched_rows(candidates: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidate_id, row_id, outcome): a candidate and a model row match if their canonical text stands once on each side."""
    c = candidates.groupBy(*keys, "canonical").agg(F.count("*").alias("_c"), F.min("candidate_id").alias("candidate_id"))
    r = rows.groupBy(*keys, "canonical").agg(F.count("*").alias("_r"), F.min("row_id").alias("row_id"))
    both = c.join(r, [*keys, "canonical"], "full_outer")
    outcome = F.when(F.col("_c").isNull(), "unknown_row").when(F.col("_r").isNull(), "missing_row").when((F.col("_c") > 1) | (F.col("_r") > 1), "ambiguous").otherwise("matched")
    return both.select(*keys, "canonical", "candidate_id", "row_id", outcome.alias("outcome"))


def propagated_status(atoms: DataFrame, rows: DataFrame) -> DataFrame:
    """Atoms (.., prediction_id) with the status of the row that their prediction names; unverified without one."""
    return atoms.join(rows.select(F.col("row_id").alias("prediction_id"), F.col("status").alias("predicted_status")), "prediction_id", "left").withColumn("predicted_status", F.coalesce("predicted_status", F.lit("unverified")))


def isolation_errors(cells: DataFrame, fixed: list[str]) -> DataFrame:
    """(pair, column): paired cells (pair, arm, ..) that differ in a column that only their context may change, and pairs without two arms."""
    n = cells.groupBy("pair").agg(F.count_distinct("arm").alias("arms"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in fixed])
    found = F.array_compact(F.array(F.when(F.col("arms") != 2, F.lit("arm")), *[F.when(F.col(c) > 1, F.lit(c)) for c in fixed]))
    return n.select("pair", F.explode(found).alias("column"))


def materiality_gates(cases: DataFrame) -> DataFrame:
    """One verdict over cases (invalid, failed): INVALID before FAIL before PASS; none without cases."""
    return cases.agg(F.when(F.bool_or("invalid"), "INVALID").when(F.bool_or("failed"), "FAIL").when(F.count("*") > 0, "PASS").alias("verdict"))


def line_evidence(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Line spans (doc_id, span_id, first, last, quote) as places in the stripped text, with whether the quote stands there.

    Null places where there are no such lines, or where they lie outside of the stripped text.
    """
    from .retrieval import line_span

    lead = F.length(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0))
    body = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    out = spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("_x", line_span(F.col("text"), F.col("first"), F.col("last"))).withColumn("_lead", lead).withColumn("_body", body)
    s, e = F.col("_x.start") - F.col("_lead"), F.col("_x.end") - F.col("_lead")
    good = (s >= 0) & (e <= F.length("_body")) & (s < e)
    stands = F.substr("_body", s + 1, e - s) == F.col("quote")
    return out.select("doc_id", "span_id", F.when(good, s).alias("s"), F.when(good, e).alias("e"), F.coalesce(good & stands, F.lit(False)).alias("quote_ok"))


def run_outcomes(events: DataFrame, run: str, order: list[str], kind: str, cost: str, cost_limit: float = COST_LIMIT, attempts: int = ATTEMPTS) -> DataFrame:
    """Where each run ends: (run, n_steps, outcome, spent): at the step that brings its cost to the limit, at the last failed attempt, or when it is published, whichever comes first; later steps don't count.

    Kinds: ``fail`` uses up an attempt, ``publish`` ends the run well; others are steps.
    """
    at = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("_n", F.count("*").over(at)).withColumn("_spent", F.sum(cost).over(at)).withColumn("_fails", F.count_if(F.col(kind) == "fail").over(at))
    why = F.when(F.col("_spent") >= cost_limit, "resource_exhausted").when((F.col(kind) == "fail") & (F.col("_fails") >= attempts), "terminal_quality_exhausted").when(F.col(kind) == "publish", "published")
    e = e.withColumn("_why", why)
    end = F.when(F.col("_why").isNotNull(), F.col("_n"))
    return e.groupBy(run).agg(F.coalesce(F.min(end), F.max("_n")).alias("n_steps"), F.coalesce(F.min_by("_why", end), F.lit("running")).alias("outcome"), F.coalesce(F.min_by("_spent", end), F.max("_spent")).alias("spent"))
