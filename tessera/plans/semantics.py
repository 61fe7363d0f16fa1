"""Registered queries of JSON answers, URL rules, claim metrics and index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext, urls
from ..operators import semantics
from ..sources import index
from ..sources.tables import table
from .catalog import _TOK, register

_J = """r AS (SELECT event_id, event_type, user_id, props, '[' || props || ', ' || event_id || ']' AS list FROM events)"""


@register(f"WITH {_J} SELECT event_id, CASE WHEN event_id % 9 < 3 THEN props || '|' || event_id WHEN event_id % 9 = 6 THEN '' WHEN event_id % 9 = 7 THEN '\"' || event_type || '\"' END AS items FROM r")
def json_arrays(spark, d):
    """Arrays of an event's properties and id: plain, fenced, within prose, cut off, empty, behind a fence, or none."""
    n, lit = F.col("event_id"), F.lit
    whole = F.concat(lit("["), "props", lit(", "), n.cast("string"), lit("]"))
    forms = [
        whole, F.concat(lit("```json\n"), whole, lit("\n```")), F.concat(lit("Here: "), whole, lit(" as asked.")), F.col("props"), F.concat(lit("["), n.cast("string"), lit(", 2")), lit(""),
        lit("[]"), F.concat(lit('```\n["'), "event_type", lit('"]\n``` trailing')), lit(None).cast("string"),
    ]
    raw = table(spark, d, "events").select("event_id", F.get(F.array(*forms), (n % 9).cast("int")).alias("raw"))
    return raw.select("event_id", F.array_join(jsontext.json_array("raw"), "|").alias("items"))


#: How a right observation is spoiled, and the error behind its number; a repeated key is met while reading.
_SPOILT = [
    ("", "", None), ('"claim_id":"', '"claim_id":null,"_":"', "_unknown_field"), (',"blockers":[]', "", "_missing_blockers"), ('"full_entailment":true', '"full_entailment":"yes"', "_invalid_full_entailment"), ('"full_entailment":true', '"full_entailment":null', "_null_full_entailment"),
    ('"blockers":[]', '"blockers":[],"claim_id":"d"', None), ('"quote":"', '"quote":1,"_q":"', "_support_quotes_0_unknown_field"), ('"support_quotes":[', '"support_quotes":[{"evidence_id":"E","quote":""},', "_support_quotes_0_empty_quote"), ('"evidence_id":"E', '"evidence_id":7,"_e":"', "_support_quotes_0_unknown_field"),
    ('"support_quotes":[{', '"support_quotes":[[],{', "_support_quotes_0_not_object"),
]
_WRAPPED = [("", ""), ("```", "```"), ("", " thanks"), ("[", "]"), ("{", ""), ("", ""), ("", "")]


@register(
    "SELECT event_id, CASE WHEN event_id % 7 = 1 THEN 'markdown_fence_rejected' WHEN event_id % 7 = 4 THEN 'malformed_json' WHEN event_id % 10 = 5 THEN 'duplicate_json_keys' WHEN event_id % 7 = 2 THEN 'trailing_prose' WHEN event_id % 7 = 3 THEN 'top_level_not_object' "
    + " ".join(f"WHEN event_id % 10 = {n} THEN 'observation_' || event_id % 3 || '{e}'" for n, (_, _, e) in enumerate(_SPOILT) if e) + " END AS error FROM events"
)
def answer_errors(spark, d):
    """Answers of up to three observations made of events, the last one, the whole or both spoiled."""
    n, lit = F.col("event_id"), F.lit
    good = F.concat(lit('{"claim_id":"c'), n.cast("string"), lit('","support_quotes":[{"evidence_id":"E'), F.col("user_id").cast("string"), lit('","quote":"'), "event_type", lit('"}],"full_entailment":true,"blockers":[]}'))
    last = good
    for k, (old, new, _) in enumerate(_SPOILT):
        last = last if not old else F.when(n % 10 == k, F.replace(good, lit(old), lit(new))).otherwise(last)
    answer = F.concat(lit('{"observations":['), F.array_join(F.concat(F.array_repeat(good, (n % 3).cast("int")), F.array(last)), ","), lit("]}"))
    wrap = lambda side: F.get(F.array(*[lit(w[side]) for w in _WRAPPED]), (n % 7).cast("int"))
    return table(spark, d, "events").select("event_id", jsontext.strict_answer_error(F.concat(wrap(0), answer, wrap(1))).alias("error"))


_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "tags"],
    "properties": {
        "id": {"$ref": "#/$defs/name"}, "n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "string", "minLength": 5}},
        "kind": {"enum": ["a", "b"]}, "version": {"const": 2}, "pair": {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False}, "note": {"anyOf": [{"type": "null"}, {"type": "string"}]},
    },
    "$defs": {"name": {"type": "string", "pattern": "[a-z]+"}},
}


@register(
    """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'not json' WHEN event_id % 11 = 0 THEN '$ additionalProperties' WHEN event_id % 13 = 0 THEN '$ required' WHEN user_id % 7 = 0 THEN '$.id pattern' WHEN user_id % 5 = 2 THEN '$.kind enum' WHEN event_id % 29 = 0 THEN '$.n type'
  WHEN floor(value) % 6 = 0 THEN '$.n minimum' WHEN event_id % 19 = 1 THEN '$.note anyOf' WHEN event_id % 17 = 0 THEN '$.pair maxItems' WHEN event_id % 17 = 1 THEN '$.pair[0] type' WHEN event_id % 4 = 0 THEN '$.tags minItems' WHEN event_id % 4 = 3 THEN '$.tags maxItems'
  WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN '$.tags uniqueItems' WHEN event_type = 'view' THEN '$.tags[0] minLength' WHEN event_id % 31 = 0 THEN '$.version const' END AS error FROM events"""
)
def schema_errors(spark, d):
    """Packs made of events; several rules may be broken, and the first in the order of names counts."""
    n, lit = F.col("event_id"), F.lit
    quoted = lambda c: F.concat(lit('"'), c, lit('"'))
    tags = F.get(F.array(F.array().cast("array<string>"), F.array("event_type"), F.array(F.col("event_type"), F.when(n % 3 == 0, F.col("event_type")).otherwise("another")), F.array_repeat("event_type", 3)), (n % 4).cast("int"))
    fields = [
        F.concat(lit('"id":'), quoted(F.when(F.col("user_id") % 7 == 0, F.upper("event_type")).otherwise(F.col("event_type")))), F.when(n % 13 != 0, F.concat(lit('"tags":['), F.array_join(F.transform(tags, quoted), ","), lit("]"))),
        F.concat(lit('"n":'), F.when(n % 29 == 0, "true").otherwise((F.floor("value") % 6).cast("string"))), F.concat(lit('"kind":'), F.when(F.col("user_id") % 5 == 2, '"c"').otherwise('"b"')), F.when(n % 11 == 0, lit('"z":1')),
        F.concat(lit('"note":'), F.when(n % 19 == 1, "1").when(n % 2 == 0, "null").otherwise('"said"')), F.concat(lit('"pair":'), F.when(n % 17 == 0, '[1,"x",2]').when(n % 17 == 1, '["x",1]').otherwise('[1,"x"]')), F.concat(lit('"version":'), F.when(n % 31 == 0, "3").otherwise("2")),
    ]
    raw = F.concat(F.when(n % 23 == 0, "").otherwise("{"), F.array_join(F.array_compact(F.array(*fields)), ","), lit("}"))
    return table(spark, d, "events").select("event_id", jsontext.schema_check(raw, _SCHEMA).alias("error"))


def _forms() -> dict:
    return {
        "upper": F.concat(F.lit("HTTPS://"), F.upper("host"), F.lit(":443"), F.col("rest"), F.lit("#f")), "port": F.concat(F.lit("https://"), F.col("host"), F.lit(":8443/")), "user": F.concat(F.lit("https://u@"), F.col("host"), F.lit("/")),
        "escape": F.concat(F.lit("https://"), F.col("host"), F.lit("/%zz")), "local": F.concat(F.lit("https://"), F.col("host"), F.lit(".local/")), "number": F.concat(F.lit("https://"), F.col("n").cast("string"), F.lit("/x")),
        "hexadecimal": F.concat(F.lit("https://0x"), F.hex("n")), "short": F.concat(F.lit("https://"), F.concat_ws(".", F.shiftright("n", 24).cast("string"), (F.col("n") % 16777216).cast("string"))),
        "six": F.concat(F.lit("https://[2001:4860:0:0:0:0:"), F.hex(F.shiftright("n", 16)), F.lit(":"), F.hex(F.col("n") % 65536), F.lit("]/")),
    }


_CLOSED = " OR ".join(f"n BETWEEN {urls._address(a)} AND {urls._address(b)}" for a, b in urls._CLOSED_V4)


@register(
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS rest, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT AS n FROM pages),
v AS (SELECT *, CASE WHEN NOT ({_CLOSED}) THEN 'https://' || (n >> 24) || '.' || (n >> 16) % 256 || '.' || (n >> 8) % 256 || '.' || n % 256 END AS four, lower(to_hex(n >> 16)) AS a, lower(to_hex(n % 65536)) AS b FROM p)
SELECT page_id, 'upper' AS form, 'https://' || lower(host) || CASE WHEN rest = '' THEN '/' ELSE rest END AS norm_url FROM v UNION ALL SELECT page_id, unnest(['port', 'user', 'escape', 'local']), NULL FROM v
UNION ALL SELECT page_id, 'number', four || '/x' FROM v UNION ALL SELECT page_id, unnest(['hexadecimal', 'short']), four || '/' FROM v
UNION ALL SELECT page_id, 'six', 'https://[2001:4860::' || CASE WHEN n = 0 THEN '' WHEN n < 65536 THEN b ELSE a || ':' || b END || ']/' FROM v"""
)
def citation_urls(spark, d):
    """Every page's address in other notations, and its host as numbers in all forms that browsers read."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+(.*)$", 1).alias("rest"), F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long").alias("n"))
    forms = pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("url")) for k, v in _forms().items()])).alias("f"))
    return forms.select("page_id", "f.form", urls.normalize(F.col("f.url")).alias("norm_url"))


_GOLDS = """g AS (SELECT doc_id, source AS fixture, lang <> 'es' AS material, CASE WHEN quality = 0 THEN 'unverified' WHEN toxic = 1 THEN 'weak' ELSE 'verified' END AS gold_status, length(coalesce(text, '')) AS n,
  CASE WHEN doc_id % 7 <> 3 THEN doc_id END AS candidate_id, CASE WHEN length(coalesce(text, '')) % 4 = 0 THEN 'weak' ELSE 'verified' END AS predicted, CASE doc_id % 10 WHEN 0 THEN 'compound' WHEN 1 THEN 'fragment' ELSE 'exact' END AS role FROM labels JOIN documents USING (doc_id))"""
_OPEN = """u AS (SELECT fixture, doc_id AS gold_id, gold_status, candidate_id, CASE WHEN candidate_id IS NOT NULL THEN predicted END AS predicted_status, candidate_id IS NOT NULL AND role = 'exact' AS recalled,
  NOT (candidate_id IS NOT NULL AND role = 'exact' AND gold_status = 'verified' AND predicted = 'verified' AND doc_id % 11 <> 4 AND doc_id % 13 <> 5 AND n > 40 AND doc_id % 9 <> 2) AS unresolved FROM g WHERE material)"""


def _golds(spark, d):
    n, size = F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))
    status = F.when(F.col("quality") == 0, "unverified").when(F.col("toxic") == 1, "weak").otherwise("verified")
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    role = F.when(n % 10 == 0, "compound").when(n % 10 == 1, "fragment").otherwise("exact")
    return rows.select("doc_id", F.col("source").alias("fixture"), (F.col("lang") != "es").alias("material"), status.alias("gold_status"), size.alias("n"), F.when(size % 4 == 0, "weak").otherwise("verified").alias("predicted_status"), role.alias("role"), "text")


def _unresolved(spark, d):
    """Labelled documents as golds, found as candidates but for some; bindings that are not there, name another candidate, or are invalid."""
    g, n = _golds(spark, d).withColumn("gold_id", F.col("doc_id")), F.col("doc_id")
    bound = F.when(n % 13 == 5, n + 1).otherwise(n)
    return semantics.unresolved_gold(
        g.select("fixture", "gold_id", "material", "gold_status"), g.where(n % 7 != 3).select("fixture", "gold_id", n.alias("candidate_id")), g.select("fixture", n.alias("candidate_id"), "role", "predicted_status"),
        g.where(n % 11 != 4).select("fixture", "gold_id", bound.alias("candidate_id"), (F.col("n") > 40).alias("valid"), (n % 9 != 2).alias("fully_entailed")),
    )


@register(f"WITH {_GOLDS}, {_OPEN} SELECT * FROM u")
def unresolved_golds(spark, d):
    return _unresolved(spark, d)


@register(
    f"""WITH {_GOLDS}, {_OPEN}, c AS (SELECT fixture, count(*) AS material_golds, count(*) FILTER (recalled) AS r, count(*) FILTER (unresolved) AS o, count(*) FILTER (gold_status <> 'verified') AS neg, count(*) FILTER (gold_status <> 'verified' AND predicted_status = 'verified') AS f FROM u GROUP BY fixture)
SELECT fixture, material_golds, round(r / material_golds, 8) AS material_claim_recall, round(o / material_golds, 8) AS material_unresolved_rate, round(f / nullif(neg, 0), 8) AS material_false_verification_rate, o = 0 AS semantic_pass FROM c"""
)
def gold_metrics(spark, d):
    return semantics.gold_metrics(_unresolved(spark, d), ["fixture"])


_FINAL = f"""{_GOLDS}, a AS (SELECT *, material AND NOT coalesce(gold_status = 'verified' AND doc_id % 17 > 1 AND predicted = 'verified' AND doc_id % 13 <> 5 AND n > 40 AND doc_id % 9 <> 2 AND doc_id % 8 <> 6, false) AS unresolved FROM g)"""


def _atoms(spark, d):
    n, name = F.col("doc_id"), lambda n: F.concat(F.lit("a"), n.cast("string"))
    return _golds(spark, d).select(
        "fixture", name(n).alias("atom_id"), "material", F.col("gold_status").alias("label"), F.when(n % 17 == 0, "").when(n % 17 != 1, F.concat(F.lit("p"), n.cast("string"))).alias("prediction_id"), "predicted_status",
        name(F.when(n % 13 == 5, n + 1).otherwise(n)).alias("bound_to"), (F.col("n") > 40).alias("valid"), F.when(n % 9 != 2, F.lit(True)).alias("fully_entailed"), F.when(n % 8 == 6, "").otherwise(F.col("fixture")).alias("evidence_id"),
    )


@register(f"WITH {_FINAL} SELECT fixture, 'a' || doc_id AS atom_id, unresolved FROM a")
def final_unresolved(spark, d):
    """Labelled documents as final claims, of whose bindings parts are missing or wrong."""
    return semantics.final_unresolved(_atoms(spark, d)).select("fixture", "atom_id", "unresolved")


@register(
    f"""WITH {_FINAL}, x AS (SELECT fixture, round(count(*) FILTER (unresolved) / nullif(count(*) FILTER (material), 0), 8) AS final_unresolved_rate FROM a GROUP BY fixture),
c AS (SELECT fixture, round(count(*) FILTER (material AND gold_status <> 'verified' AND predicted = 'verified') / nullif(count(*) FILTER (material AND gold_status <> 'verified'), 0), 8) AS false_verification_rate FROM g WHERE n % 5 <> 0 GROUP BY fixture)
SELECT coalesce(x.fixture, c.fixture) AS fixture, final_unresolved_rate, false_verification_rate FROM x FULL JOIN c ON x.fixture = c.fixture"""
)
def final_metrics(spark, d):
    cases = _golds(spark, d).where("n % 5 <> 0").select("fixture", "material", F.col("gold_status").alias("label"), "predicted_status")
    return semantics.final_metrics(_atoms(spark, d), cases, ["fixture"])


@register("WITH r AS (SELECT source, CASE WHEN quality = 0 THEN 'unverified' ELSE 'verified' END AS status FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) FILTER (status = 'unverified') AS numerator, count(*) AS denominator, count(*) FILTER (status = 'unverified') / count(*) AS value FROM r GROUP BY source")
def unverified_rates(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("status", F.when(F.col("quality") == 0, "unverified").otherwise("verified"))
    return semantics.unverified_rate(rows, ["source"])


@register(
    f"""WITH {_GOLDS}, t AS (SELECT g.*, md5(coalesce(text, '')) AS h, doc_id % 3 <> 1 AS found, doc_id % 3 <> 2 AS wanted, n > 100 AS factual FROM g JOIN documents USING (doc_id)),
c AS (SELECT fixture AS run, count(*) FILTER (wanted) AS w, count(*) FILTER (found) AS f, count(*) FILTER (found AND wanted) AS tp, count(*) FILTER (wanted AND material) AS m, count(*) FILTER (wanted AND found AND material) AS mm, count(*) FILTER (wanted AND factual) AS k, count(*) FILTER (wanted AND found AND factual) AS mk,
  count(DISTINCT h) FILTER (found) AS u, count(*) FILTER (found AND role = 'compound') AS joined, count(*) FILTER (found AND role = 'fragment') AS fragments FROM t GROUP BY fixture HAVING bool_or(found OR wanted))
SELECT run, round(mm / nullif(m, 0), 8) AS material_recall, round(mk / nullif(k, 0), 8) AS factual_recall, tp, round((f - u) / nullif(f, 0), 8) AS duplicate_rate, round((f - joined) / nullif(f, 0), 8) AS atomicity, fragments, round(tp / nullif(f, 0), 8) AS precision, round(2 * tp / nullif(f + w, 0), 8) AS f1 FROM c"""
)
def extraction_metrics(spark, d):
    """Labelled documents by source: two of three found, two of three wanted."""
    g, n = _golds(spark, d).withColumnRenamed("fixture", "run"), F.col("doc_id")
    found = g.where(n % 3 != 1).select("run", n.alias("candidate_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("canonical"), "role")
    wanted = g.where(n % 3 != 2).select("run", n.alias("gold_id"), "material", (F.col("n") > 100).alias("factual"))
    return semantics.extraction_metrics(found, wanted, g.where(n % 3 == 0).select("run", n.alias("candidate_id"), n.alias("gold_id")), ["run"])


@register("WITH a AS (SELECT DISTINCT source, text FROM documents WHERE doc_id % 3 <> 1 AND text IS NOT NULL), b AS (SELECT DISTINCT source, text FROM documents WHERE doc_id % 3 <> 2 AND text IS NOT NULL), j AS (SELECT coalesce(a.source, b.source) AS source, a.text AS f, b.text AS w FROM a FULL JOIN b ON a.source = b.source AND a.text = b.text) SELECT source, count(*) FILTER (f IS NOT NULL AND w IS NOT NULL) AS tp, count(*) FILTER (f IS NULL) AS fn, count(*) FILTER (w IS NULL) AS fp, round(count(*) FILTER (f IS NOT NULL AND w IS NOT NULL) / nullif(count(w), 0), 8) AS recall FROM j GROUP BY source")
def extraction_cases(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.col("text").alias("canonical"), F.lit(True).alias("material"))
    return semantics.extraction_case(docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 <> 2"), ["source"])


# ---------------------------------------------------------------- index tables

_POINTS = "p AS (SELECT doc_id, 'u' || doc_id AS chunk_id, source AS document_id, CASE WHEN doc_id % 97 = 0 THEN 'v2' ELSE 'v1' END AS document_version, nullif(text, '') AS retrieval_text, doc_id AS reading_order_ordinal FROM documents)"


def _points(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.lit("u"), n.cast("string")).alias("chunk_id"), F.col("source").alias("document_id"), F.when(n % 97 == 0, "v2").otherwise("v1").alias("document_version"), F.nullif("text", F.lit("")).alias("retrieval_text"), n.alias("reading_order_ordinal")
    )


@register(f"WITH {_POINTS} SELECT chunk_id, document_id, document_version, coalesce(retrieval_text, '') AS retrieval_text, reading_order_ordinal, 0 AS n_headings, '' AS packing_version FROM p")
def payload_units(spark, d):
    """Payload rows as units, missing columns filled."""
    out = index.payload_to_unit(_points(spark, d))
    return out.select("chunk_id", "document_id", "document_version", F.coalesce("retrieval_text", F.lit("")).alias("retrieval_text"), "reading_order_ordinal", F.size("heading_path").alias("n_headings"), F.coalesce("packing_version", F.lit("")).alias("packing_version"))


@register(f"WITH {_POINTS} SELECT 'missing_field' AS rule, chunk_id AS key FROM p WHERE retrieval_text IS NULL UNION ALL SELECT 'conflicting_versions', document_id FROM p GROUP BY document_id HAVING count(DISTINCT document_version) > 1")
def payload_errors(spark, d):
    return index.payload_errors(_points(spark, d), ("chunk_id", "document_id", "document_version", "retrieval_text"))


@register(f"WITH {_POINTS} SELECT chunk_id, document_version FROM p WHERE document_id = 'src3' AND document_version = 'v1'")
def units_of_document(spark, d):
    return index.units_of_document(_points(spark, d), "src3", "v1").select("chunk_id", "document_version")


@register(f"WITH {_POINTS} SELECT count(*) AS before, count(*) FILTER (NOT (document_id = 'src3' AND document_version = 'v1')) AS after, count(*) FILTER (document_id = 'src3' AND document_version = 'v1') AS deleted FROM p")
def deleted_version(spark, d):
    from ..sources import store

    return store.delete_counts(_points(spark, d), (F.col("document_id") == "src3") & (F.col("document_version") == "v1"))


@register(f"WITH {_POINTS}, n AS (SELECT chunk_id, document_id, 'v3' AS document_version FROM p WHERE document_id = 'src4' AND reading_order_ordinal % 2 = 0) SELECT document_id, document_version, count(*) AS n FROM (SELECT document_id, document_version FROM p WHERE document_id <> 'src4' UNION ALL SELECT document_id, document_version FROM n) GROUP BY ALL")
def updated_document(spark, d):
    points = _points(spark, d)
    new = points.where("document_id = 'src4' and reading_order_ordinal % 2 = 0").withColumn("document_version", F.lit("v3"))
    return index.update_document(points, new).groupBy("document_id", "document_version").agg(F.count("*").alias("n"))


@register(f"SELECT quantile_disc(n, 0.5) AS p50, min(n) AS low, max(n) AS high, quantile_disc(n, 0.95) AS p95, count(*) AS units FROM (SELECT len({_TOK}) AS n FROM documents)")
def context_stats(spark, d):
    from ..functions import text
    from ..operators import metrics

    docs = table(spark, d, "documents").select(F.size(text.tokens(F.col("text"))).alias("n"))
    return metrics.nearest_rank(docs, "n")
