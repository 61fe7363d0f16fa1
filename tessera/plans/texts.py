"""Registered queries of text expressions and of operators that other queries only use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.arrays import places
from ..operators import claims, evidence, fusion, policy
from ..sources import store
from ..sources.tables import table
from .catalog import _EXPANDED, _expanded, register

@register("WITH c AS (SELECT conv_id AS doc_id, role || turn % 3 AS evidence_id, min(turn) AS place FROM conversations GROUP BY ALL) SELECT doc_id, evidence_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, evidence_id) AS number FROM c")
def evidence_numbers(spark, d):
    cited = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("evidence_id"), F.col("turn").alias("place"))
    return policy.bibliography(cited)


@register("SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'Title ' || page_id END, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1)) AS label FROM pages")
def url_labels(spark, d):
    n = F.col("page_id")
    title = F.when(n % 3 == 0, F.concat(F.lit(" Title "), n.cast("string"), F.lit(" "))).when(n % 3 == 1, "  ")
    return table(spark, d, "pages").select("page_id", urls.label(title, F.col("url")).alias("label"))


@register("SELECT doc_id, 'ca:unit:' || sha256('{\"lang\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END || ',\"n\":' || doc_id || ',\"source\":\"' || source || '\"}') AS id FROM documents")
def content_ids(spark, d):
    """Identity over canonical JSON with fields in name order."""
    return table(spark, d, "documents").select("doc_id", text.identity("unit", F.struct("lang", F.col("doc_id").alias("n"), "source")).alias("id"))


@register(
    """WITH n AS (SELECT doc_id, strpos(text, 'th') - 1 AS first, (length(text) - length(replace(text, 'th', ''))) // 2 AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS claim_id, CASE WHEN n > 0 THEN first END AS start, n = 0 OR n > 1 AND doc_id % 2 = 1 AS critical FROM n"""
)
def claim_rosters(spark, d):
    """A claim of two letters bound to every place in its text; several places are ambiguous in odd documents."""
    starts = F.transform(places(F.col("text"), "th"), lambda x: x["start"])
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("claim_id"), starts.alias("starts"))
    n = F.size("starts")
    validity = F.when(n == 0, "ANCHOR_FAILED").when(n == 1, "bound").when(F.col("claim_id") % 2 == 1, "ANCHOR_AMBIGUOUS").otherwise("bound_multiple")
    inventory = docs.withColumn("validity", validity)
    critical = claims.critical_failures(inventory).select("claim_id", F.lit(True).alias("critical"))
    return inventory.select("claim_id").join(claims.roster(inventory), "claim_id", "left").join(critical, "claim_id", "left").withColumn("critical", F.coalesce("critical", F.lit(False)))


@register("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def broken_manifests(spark, d):
    """Rows whose digest is not that of their text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source_text"))
    return claims.broken_manifest(docs.withColumn("source_sha256", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text")), 256))).select("doc_id")


@register("SELECT user_id, event_type, CASE WHEN max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) = 1 AND user_id % 4 <> 0 THEN 'responded' WHEN user_id % 4 = 0 THEN 'failed' ELSE 'reserved' END AS state FROM events GROUP BY user_id, event_type")
def journal_answers(spark, d):
    """Reserved entries that are answered become responded; others keep their state."""
    e = table(spark, d, "events")
    journal = e.select("user_id", "event_type").distinct().withColumn("state", F.when(F.col("user_id") % 4 == 0, "failed").otherwise("reserved"))
    return store.answer_reserved(journal, e.where("event_id % 3 = 0"), ["user_id", "event_type"])


@register("SELECT doc_id % 5 AS query_id, source AS interval, count(DISTINCT doc_id) AS units FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id) > 1")
def duplicate_intervals(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 5).alias("query_id"), F.col("source").alias("interval"), F.col("doc_id").alias("unit_id"))
    return evidence.duplicate_intervals(rows, ["query_id"])


@register(
    f"""WITH RECURSIVE {_EXPANDED}, ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, pos, unit_id) AS i FROM sized),
fold AS (SELECT query_id, i, unit_id, tokens, tokens <= 900 AS packed, CASE WHEN tokens <= 900 THEN tokens ELSE 0 END AS used FROM ordered WHERE i = 1
  UNION ALL SELECT o.query_id, o.i, o.unit_id, o.tokens, f.used + o.tokens <= 900, CASE WHEN f.used + o.tokens <= 900 THEN f.used + o.tokens ELSE f.used END FROM fold f JOIN ordered o ON o.query_id = f.query_id AND o.i = f.i + 1)
SELECT query_id, unit_id, packed FROM fold"""
)
def frozen_order_pack(spark, d):
    """Packed in the order in which rows were found, seeds and neighbours alike; rows that don't fit are skipped."""
    return fusion.pack(_expanded(spark, d), 900, seed_first=False).select("query_id", "unit_id", "packed")


@register("SELECT 0 AS violations")
def kept_seeds(spark, d):
    """Seeds that survive the dedup are packed wherever a query's seeds stay within the budget."""
    return fusion.seeds_kept(fusion.pack(_expanded(spark, d), fail_over_budget=False).where("not over_budget")).agg(F.count("*").alias("violations"))
