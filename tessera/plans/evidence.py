"""Registered queries of the evidence operators and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..functions.arrays import running_sum
from ..operators import evidence
from ..sources.tables import table
from .catalog import _FUSED, _TOK, _fused, _units, register
from .exposure import _GOLD, _TEN, _gold, _ten

_ROWS = "WITH l AS (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)"


def _split(spark, d):
    return table(spark, d, "documents").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))


@register(
    f"""{_ROWS}, p AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e, max(i) OVER (PARTITION BY doc_id) AS m FROM l),
s AS (SELECT *, e - length(t) - 1 AS s, CASE WHEN i = m AND doc_id % 4 = 0 THEN 'context_after' ELSE 'content' END AS role FROM p WHERE trim(t) <> ''),
g AS (SELECT doc_id, string_agg(s || ':' || e || ':' || role, ';' ORDER BY i) AS spans, min(s) AS s, max(e) AS e, bool_and(role = 'content') AND sum(e - s) = max(e) - min(s) AS whole FROM s GROUP BY doc_id)
SELECT doc_id AS id, CASE WHEN whole THEN g.s END AS s, CASE WHEN whole THEN g.e END AS e, source || '.md|' || coalesce(spans, '') AS key FROM documents LEFT JOIN g USING (doc_id)"""
)
def content_intervals(spark, d):
    """Lines with their ends as spans of a text; blank ones leave a gap, and the last of every fourth text is context."""
    docs = _split(spark, d).withColumn("ends", running_sum(F.transform("lines", lambda t: F.length(t) + 1)))
    last = F.size("lines") - 1
    role = lambda i: F.when((i == last) & (F.col("doc_id") % 4 == 0), "context_after").otherwise("content")
    at = F.transform("lines", lambda t, i: F.struct((F.get("ends", i) - F.length(t) - 1).alias("start"), F.get("ends", i).alias("end"), role(i).alias("role"), (F.trim(t) != "").alias("said")))
    spans = docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".md")).alias("path"), F.transform(F.filter(at, lambda x: x["said"]), lambda x: x.dropFields("said")).alias("spans"))
    return spans.select("id", evidence.content_interval(F.col("spans")).alias("i"), evidence.interval_key(F.col("path"), F.col("spans")).alias("key")).select("id", "i.s", "i.e", "key")


@register("WITH h AS (SELECT *, md5(coalesce(text, '')) AS h FROM documents), f AS (SELECT h, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang, min(doc_id) % 2 AS odd FROM h GROUP BY h) SELECT doc_id AS id, h.source IS NOT DISTINCT FROM f.source AND h.lang IS NOT DISTINCT FROM f.lang AND doc_id % 2 = odd AS same FROM h JOIN f USING (h)")
def same_documents(spark, d):
    """Every document against the first one of the same text."""
    docs = table(spark, d, "documents").withColumn("h", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    name = F.struct(F.col("source").alias("document_id"), F.col("lang").alias("document_version"), F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")).alias("source_path"), F.col("h").alias("source_sha256"))
    docs = docs.select("doc_id", "h", name.alias("a"))
    first = docs.groupBy("h").agg(F.min_by("a", "doc_id").alias("b"))
    return docs.join(first, "h").select(F.col("doc_id").alias("id"), evidence.same_document("a", "b").alias("same"))


@register(f"{_ROWS}, k AS (SELECT doc_id, (i - 1) // 2 AS unit, CASE WHEN trim(t) = '' THEN 0 WHEN length(t) < 40 THEN 1 WHEN length(t) < 60 THEN 2 ELSE 3 END AS k FROM l) SELECT doc_id AS id, unit, bool_or(k = 1) AND max(k) < 2 AS h1 FROM k GROUP BY ALL")
def h1_only_units(spark, d):
    """Units of two lines: short lines as headings of the first or second level, blank ones as seams."""
    kind = lambda t: F.when(F.trim(t) == "", "seam").when(F.length(t) < 60, "heading").otherwise("paragraph")
    segments = lambda part: F.transform(part, lambda t: F.struct(kind(t).alias("kind"), F.when(F.length(t) < 40, 1).otherwise(2).alias("level")))
    docs = _split(spark, d)
    units = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 2).cast("int")), lambda j: segments(F.slice("lines", 2 * j + 1, F.lit(2))))
    return docs.select(F.col("doc_id").alias("id"), F.posexplode(units).alias("unit", "segments")).select("id", "unit", evidence.h1_only(F.col("segments")).alias("h1"))


@register(f"WITH {_FUSED}, h AS (SELECT query_id, rank, unit_id FROM fused UNION ALL SELECT query_id, 9, unit_id FROM fused WHERE rank = 1 AND query_id % 2 = 0 UNION ALL SELECT query_id, 10, -1 FROM fused WHERE rank = 1) SELECT query_id, rank, CASE WHEN d.doc_id IS NULL THEN 'unknown_unit' ELSE 'unit_twice' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY query_id, unit_id) AS n FROM h) LEFT JOIN documents d ON d.doc_id = unit_id WHERE d.doc_id IS NULL OR n > 1")
def hydration_errors(spark, d):
    rows = _fused(spark, d).select("query_id", "rank", "unit_id")
    one = rows.where("rank = 1")
    rows = rows.unionByName(one.where("query_id % 2 = 0").withColumn("rank", F.lit(9))).unionByName(one.withColumn("rank", F.lit(10)).withColumn("unit_id", F.lit(-1).cast("long")))
    units = _units(spark, d).select("unit_id", (F.col("unit_id") * 10).alias("s"), (F.col("unit_id") * 10 + 25).alias("e"))
    return evidence.hydrated(rows, units)[1]


_AT = "(VALUES (1), (3), (5), (10)) v(k)"


@register(
    f"""WITH {_TEN}, {_GOLD}, h AS (SELECT query_id, rank, source FROM fused JOIN documents ON doc_id = unit_id), j AS (SELECT h.*, g.source IS NOT NULL AS rel FROM h LEFT JOIN gold g ON g.query_id = h.query_id AND g.source = h.source),
m AS (SELECT q.item_id AS query_id, k, count(*) FILTER (rel) AS slots, count(DISTINCT source) FILTER (rel) AS found, min(rank) FILTER (rel) AS first FROM benchmark q CROSS JOIN {_AT} LEFT JOIN j ON j.query_id = q.item_id AND rank <= k GROUP BY ALL)
SELECT query_id, 'hit@' || k AS metric, (slots > 0)::INT::DOUBLE AS value FROM m UNION ALL SELECT query_id, 'precision@' || k, round(slots / k, 8) FROM m UNION ALL SELECT query_id, 'source_recall@' || k, round(found / 2, 8) FROM m UNION ALL SELECT query_id, 'mrr@10', round(coalesce(1.0 / first, 0), 8) FROM m WHERE k = 10"""
)
def metric_bundle(spark, d):
    ranked = _ten(spark, d).join(_units(spark, d).select("unit_id", "source"), "unit_id").select("query_id", "rank", "source")
    return evidence.metric_bundle(ranked, _gold(spark, d))


@register("WITH c AS (SELECT lang, text AS canonical, count(*) AS c, min(doc_id) AS candidate_id FROM documents WHERE doc_id % 3 <> 1 AND text IS NOT NULL GROUP BY ALL), r AS (SELECT lang, text AS canonical, count(*) AS r, min(doc_id) AS row_id FROM documents WHERE doc_id % 3 <> 2 AND text IS NOT NULL GROUP BY ALL) SELECT coalesce(c.lang, r.lang) AS lang, candidate_id, row_id, CASE WHEN c IS NULL THEN 'unknown_row' WHEN r IS NULL THEN 'missing_row' WHEN c > 1 OR r > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM c FULL JOIN r ON c.lang = r.lang AND c.canonical = r.canonical")
def matched_rows(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.col("text").alias("canonical"))
    return evidence.matched_rows(docs.where("doc_id % 3 <> 1").withColumnRenamed("doc_id", "candidate_id"), docs.where("doc_id % 3 <> 2").withColumnRenamed("doc_id", "row_id"), ["lang"]).drop("canonical")


@register("SELECT d.doc_id AS atom_id, d.doc_id + 1 AS prediction_id, CASE WHEN quality IS NULL THEN 'unverified' WHEN quality = 0 THEN 'weak' ELSE 'verified' END AS predicted_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id + 1")
def propagated_statuses(spark, d):
    atoms = table(spark, d, "documents").select(F.col("doc_id").alias("atom_id"), (F.col("doc_id") + 1).alias("prediction_id"))
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 0, "weak").otherwise("verified").alias("status"))
    return evidence.propagated_status(atoms, rows)


@register(
    """WITH c AS (SELECT doc_id // 2 AS pair, count(DISTINCT doc_id % 2) AS arms, count(DISTINCT coalesce(lang, '')) AS models, count(DISTINCT coalesce(length(text), 0) % 2) AS temperatures FROM documents WHERE doc_id % 9 <> 4 GROUP BY ALL)
SELECT pair, 'arm' AS "column" FROM c WHERE arms <> 2 UNION ALL SELECT pair, 'model' FROM c WHERE models > 1 UNION ALL SELECT pair, 'temperature' FROM c WHERE temperatures > 1"""
)
def isolation_errors(spark, d):
    """Neighbouring documents as the two arms of a pair."""
    n = F.col("doc_id")
    cells = table(spark, d, "documents").where(n % 9 != 4).select(F.floor(n / 2).alias("pair"), F.when(n % 2 == 0, "A").otherwise("B").alias("arm"), F.col("lang").alias("model"), (F.coalesce(F.length("text"), F.lit(0)) % 2 / 10).alias("temperature"), F.col("text").alias("context"))
    return evidence.isolation_errors(cells, ["model", "temperature"])


@register("SELECT source, CASE WHEN bool_or(doc_id % 400 = 399) THEN 'INVALID' WHEN bool_or(doc_id % 37 = 5) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM documents WHERE source IN ('src1', 'src19') GROUP BY source")
def gate_verdicts(spark, d):
    out = None
    for source in ("src1", "src19"):
        rows = table(spark, d, "documents").where(F.col("source") == source).select((F.col("doc_id") % 400 == 399).alias("invalid"), (F.col("doc_id") % 37 == 5).alias("failed"))
        one = evidence.materiality_gates(rows).select(F.lit(source).alias("source"), "verdict").where("verdict is not null")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, 1 + doc_id % 3 AS a, 1 + doc_id % 3 + doc_id % 2 AS b FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, length(text) - length(regexp_replace(text, '^[\x20\x09-\x0D]+', '')) AS lead, regexp_replace(regexp_replace(text, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS body, array_to_string(ls[a:b], chr(10)) AS said, length(array_to_string(ls[1:a - 1] || [''], chr(10))) AS start FROM l),
q AS (SELECT *, start - lead AS s, start + length(regexp_replace(said, '[\r\n]+$', '')) - lead AS e, CASE WHEN doc_id % 5 = 0 THEN 'x' || said ELSE said END AS quote FROM p), g AS (SELECT *, b <= len(ls) AND s >= 0 AND e <= length(body) AND s < e AS good FROM q)
SELECT doc_id, 'q' AS span_id, CASE WHEN good THEN s END AS s, CASE WHEN good THEN e END AS e, good AND substr(body, s + 1, e - s) = quote AS quote_ok FROM g"""
)
def line_evidence(spark, d):
    """One or two of the first lines of every text, quoted rightly or, of every fifth text, wrongly."""
    n, docs = F.col("doc_id"), table(spark, d, "documents").where("text is not null")
    first, last = (1 + n % 3).cast("int"), (1 + n % 3 + n % 2).cast("int")
    said = F.array_join(F.slice(F.split("text", "\n", -1), first, last - first + 1), "\n")
    spans = docs.select("doc_id", F.lit("q").alias("span_id"), first.alias("first"), last.alias("last"), F.when(n % 5 == 0, F.concat(F.lit("x"), said)).otherwise(said).alias("quote"))
    return evidence.line_evidence(docs, spans)


@register(
    """WITH e AS (SELECT user_id, row_number() OVER w AS n, sum(value / 2000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, CASE WHEN round(spent, 9) >= 0.1 THEN 'resource_exhausted' WHEN event_type = 'error' AND fails >= 2 THEN 'terminal_quality_exhausted' WHEN event_type = 'purchase' THEN 'published' END AS why FROM e)
SELECT user_id, coalesce(min(n) FILTER (why IS NOT NULL), max(n)) AS n_steps, coalesce(arg_min(why, n) FILTER (why IS NOT NULL), 'running') AS outcome, round(coalesce(arg_min(spent, n) FILTER (why IS NOT NULL), max(spent)), 6) AS spent FROM t GROUP BY user_id"""
)
def run_outcomes(spark, d):
    """Errors as failed attempts, purchases as publication, a two-thousandth of the value as cost."""
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "publish").otherwise("step")
    e = table(spark, d, "events").withColumn("kind", kind).withColumn("cost", (F.col("value") / 2000).cast("decimal(18,9)"))
    return evidence.run_outcomes(e, "user_id", ["ts", "event_id"], "kind", "cost").withColumn("spent", F.round(F.col("spent").cast("double"), 6))


@register(f"SELECT doc_id, len({_TOK}) AS n FROM documents")
def registered_counter(spark, d):
    """Counted with a tokenizer taken from the registry."""
    registry.register("tokenizer", "words", _words)
    return table(spark, d, "documents").select("doc_id", registry.token_counter("words")("text").alias("n"))


def _words(text: str) -> int:
    return len(text.split())


@register("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def sql_functions(spark, d):
    """The library's functions by their SQL names; all ids of one name are equal."""
    registry.for_sql(spark)
    table(spark, d, "conversations").createOrReplaceTempView("tessera_turns")
    return spark.sql("SELECT conv_id, count(*) AS n FROM tessera_turns GROUP BY conv_id HAVING count(DISTINCT tessera_uuid5(concat('c', conv_id))) = 1")
