"""Registered queries of requirement rows, draft order, occurrence numbers and canonical texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import binding, policy
from ..sources.tables import table
from .catalog import register

@register("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS req_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS description, nullif(doc_id % 3 = 0, doc_id % 11 = 0) AS mandatory FROM documents) SELECT doc_id, req_id, description, mandatory FROM r WHERE trim(req_id) <> '' AND description IS NOT NULL AND mandatory IS NOT NULL")
def normalized_requirements(spark, d):
    n = F.col("doc_id")
    raw = table(spark, d, "documents").select("doc_id", F.when(n % 7 == 0, " ").otherwise(F.col("source")).alias("req_id"), F.when(n % 5 != 0, F.col("lang")).alias("description"), F.nullif(n % 3 == 0, n % 11 == 0).alias("mandatory"))
    return binding.normalized_requirements(raw)


@register("WITH c AS (SELECT source, doc_id // 2 AS claim_id, min(doc_id) AS o FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL) SELECT d.source, doc_id AS place, doc_id // 2 AS claim_id, row_number() OVER (PARTITION BY d.source ORDER BY o NULLS LAST, doc_id) - 1 AS nth FROM documents d LEFT JOIN c ON c.source = d.source AND c.claim_id = doc_id // 2")
def rows_in_draft_order(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("place"), F.floor(F.col("doc_id") / 2).alias("claim_id"))
    return binding.in_draft_order(docs, docs.where("place % 3 <> 0").select("source", "claim_id", F.col("place").alias("ordinal")), ["source"])


@register(
    """WITH m AS (SELECT doc_id, text, strpos(substr(text, 11), substr(text, 3, 2)) AS p, substr(text, 3, 2) AS q FROM documents WHERE length(text) >= 20)
SELECT doc_id, p + 9 AS place, len(list_filter(range(1, p + 10), lambda i: substr(text, i, 2) = q)) AS nth FROM m WHERE p > 0"""
)
def nth_occurrences(spark, d):
    """Where the third and fourth characters stand again behind the tenth, and the how-manieth place that is."""
    t = table(spark, d, "documents").where(F.length("text") >= 20).withColumn("q", F.substring("text", 3, 2)).withColumn("place", F.expr("locate(q, text, 11) - 1")).where("place >= 0")
    return t.select("doc_id", "place", policy.nth_occurrence(F.col("text"), F.col("q"), F.col("place")).alias("nth"))


@register("SELECT doc_id, length(regexp_replace(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '^ | $', '', 'g')) AS chars, 'clm-' || left(sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x20\\x09-\\x0D]+', ' ', 'g'))), 16) AS claim_id FROM documents")
def canonical_texts(spark, d):
    canon = text.canonical(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", canon.alias("c")).select("doc_id", F.length("c").alias("chars"), text.claim_id(F.col("c")).alias("claim_id"))
