"""Registered queries of the retrieval pipeline, its text forms and the rules around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, retrieval
from ..sources import store
from ..sources.tables import table
from .catalog import _BM25, _DENSE_ITEMS, _EXPANDED, _FUSED, _TOK, _bm25, _dense_items, _expanded, _fused, _items, _units, register

_PACK = f"""{_EXPANDED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (relation <> 'SEED'), seed_rank, pos, unit_id) AS i FROM sized),
fold AS (
  SELECT query_id, i, unit_id, seed_rank, relation, tokens, tokens <= 2000 AS packed, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.query_id, o.i, o.unit_id, o.seed_rank, o.relation, o.tokens, f.used + o.tokens <= 2000, CASE WHEN f.used + o.tokens <= 2000 THEN f.used + o.tokens ELSE f.used END
  FROM fold f JOIN ordered o ON o.query_id = f.query_id AND o.i = f.i + 1),
total AS (SELECT query_id, sum(tokens) FILTER (relation = 'SEED') > 2000 AS over FROM sized GROUP BY query_id),
pk AS (SELECT f.query_id, unit_id, seed_rank, relation, row_number() OVER (PARTITION BY f.query_id ORDER BY i) - 1 AS packed_order FROM fold f JOIN total USING (query_id) WHERE packed AND NOT coalesce(over, false))"""


def _query_vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.join(_items(spark, d).select("query_id"), "query_id", "left_semi")


def _unit_vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    return vectors.join(_units(spark, d).select("unit_id"), "unit_id", "left_semi")


def _packed(spark, d, fused=None):
    return fusion.pack(_expanded(spark, d, fused), fail_over_budget=False)


_DOT = "(round(1 - list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) + 0.0)"


@register(f"WITH {_FUSED} SELECT f.query_id, f.unit_id, f.rank, round(rrf, 8) AS rrf_score, {_DOT} AS distance FROM fused f LEFT JOIN embeddings q ON q.vec_id = f.query_id LEFT JOIN embeddings v ON v.vec_id = f.unit_id")
def seed_distances(spark, d):
    return retrieval.seeds_with_distance(_fused(spark, d), _query_vectors(spark, d), _unit_vectors(spark, d)).select("query_id", "unit_id", "rank", "rrf_score", "distance")


@register(
    f"""WITH {_BM25}, {_DENSE_ITEMS}, b AS (SELECT * FROM bm25 WHERE query_id % 3 <> 0),
u AS (SELECT query_id, unit_id, sum(1.0 / (59 + rank)) AS rrf, max(c) AS lex FROM (SELECT query_id, unit_id, rank, 0 AS c FROM dense UNION ALL SELECT query_id, unit_id, rank, 1 FROM b) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, unit_id) AS rank FROM u QUALIFY rank <= 5)
SELECT query_id, unit_id, rank, CASE WHEN max(lex) OVER (PARTITION BY query_id) = 0 THEN 'dense_only' ELSE 'hybrid' END AS mode FROM f"""
)
def hybrid_fallback(spark, d):
    """Items divisible by three find nothing by words."""
    return retrieval.fused_or_dense(_dense_items(spark, d), _bm25(spark, d).where("query_id % 3 <> 0")).select("query_id", "unit_id", "rank", "mode")


@register(
    f"""WITH RECURSIVE {_PACK} SELECT query_id, packed_order, unit_id, source, pk.seed_rank, relation, coalesce((SELECT {_DOT} FROM fused f LEFT JOIN embeddings q ON q.vec_id = f.query_id LEFT JOIN embeddings v ON v.vec_id = f.unit_id WHERE f.query_id = pk.query_id AND f.rank = pk.seed_rank), 0) AS distance,
  (SELECT round(rrf, 8) FROM fused f WHERE f.query_id = pk.query_id AND f.rank = pk.seed_rank) AS rrf_score, sha256(coalesce(text, '')) AS text_sha256 FROM pk JOIN documents ON doc_id = unit_id"""
)
def retrieve(spark, d):
    """The whole pipeline from queries to packed evidence."""
    out = retrieval.dispatch("local")(spark, _items(spark, d), _units(spark, d), _unit_vectors(spark, d), _query_vectors(spark, d))
    return out.select("query_id", "packed_order", "unit_id", "source", "seed_rank", "relation", "distance", "rrf_score", "text_sha256")


@register(
    f"""WITH RECURSIVE {_PACK}, r AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY packed_order) AS run FROM (SELECT *, CASE WHEN lag(seed_rank) OVER (PARTITION BY query_id ORDER BY packed_order) IS DISTINCT FROM seed_rank THEN 1 ELSE 0 END AS new FROM pk))
SELECT query_id, run, any_value(seed_rank) AS seed_rank, arg_min(unit_id, packed_order) AS first_unit, count(*) AS n, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY packed_order)) AS text_sha256 FROM r JOIN documents ON doc_id = unit_id GROUP BY query_id, run"""
)
def serialized_groups(spark, d):
    return retrieval.serialized_groups(_packed(spark, d), _units(spark, d))


@register(
    f"""WITH RECURSIVE {_PACK}, r AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY packed_order) AS run FROM (SELECT *, CASE WHEN lag(seed_rank) OVER (PARTITION BY query_id ORDER BY packed_order) IS DISTINCT FROM seed_rank THEN 1 ELSE 0 END AS new FROM pk)),
t AS (SELECT query_id, run, unit_id, length(coalesce(text, '')) AS n, 2000 - coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id, run ORDER BY packed_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM r JOIN documents ON doc_id = unit_id WHERE seed_rank <= 3)
SELECT query_id, run, unit_id, least(n, rest)::BIGINT AS shown, n > rest AS clipped FROM t WHERE rest > 0"""
)
def legacy_groups(spark, d):
    return retrieval.legacy_groups(_packed(spark, d), _units(spark, d))


_CONTEXT = f"""{_PACK}, kbt AS (SELECT query_id, string_agg('[KB seed_rank=' || seed_rank || ' relation=' || relation || '] ' || source || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY packed_order) AS t FROM pk JOIN documents ON doc_id = unit_id GROUP BY query_id),
web AS (SELECT page_id % 40 AS query_id, page_id // 40 AS place, url, html FROM pages), wt AS (SELECT query_id, string_agg('[WEB] ' || url || chr(10) || left(html, 1500), chr(10) || chr(10) ORDER BY place) AS t FROM web WHERE place < 5 GROUP BY query_id)"""


@register(f"WITH RECURSIVE {_CONTEXT} SELECT item_id AS query_id, md5(coalesce(CASE WHEN w.t IS NOT NULL AND k.t IS NOT NULL THEN w.t || chr(10) || chr(10) || k.t ELSE coalesce(w.t, k.t) END, 'No sources available.')) AS context_md5 FROM benchmark LEFT JOIN wt w ON w.query_id = item_id LEFT JOIN kbt k ON k.query_id = item_id")
def source_contexts(spark, d):
    """Pages dealt out to items as web sources, and the packed evidence."""
    n = F.col("page_id")
    web = table(spark, d, "pages").select((n % 40).alias("query_id"), F.floor(n / 40).alias("place"), "url", F.col("html").alias("content"))
    seeds = retrieval.seeds_with_distance(_fused(spark, d), _query_vectors(spark, d), _unit_vectors(spark, d))
    results = retrieval.kb_results(_packed(spark, d), _units(spark, d), seeds)
    return retrieval.source_context(_items(spark, d), web, results).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@register(
    f"""WITH RECURSIVE {_PACK}, k AS (SELECT query_id, packed_order, query_id % 2 = 1 AS old, CASE WHEN query_id % 2 = 1 THEN '[KB] ' || source || chr(10) || left(coalesce(text, ''), 2000) ELSE '[KB seed_rank=' || seed_rank || ' relation=' || relation || '] ' || source || chr(10) || coalesce(text, '') END AS t FROM pk JOIN documents ON doc_id = unit_id),
c AS (SELECT query_id, any_value(old) AS old, string_agg(t, chr(10) || chr(10) ORDER BY packed_order) AS t FROM k WHERE NOT old OR packed_order < 5 GROUP BY query_id) SELECT item_id AS query_id, NOT old AS qualified, length(coalesce(t, 'No sources available.')) AS length FROM benchmark LEFT JOIN c ON query_id = item_id"""
)
def legacy_contexts(spark, d):
    """Packed evidence, that of odd queries under the older contract."""
    fused = _fused(spark, d)
    seeds = retrieval.seeds_with_distance(fused, _query_vectors(spark, d), _unit_vectors(spark, d))
    # A few rows a query, used three times below.
    results = store.written(retrieval.kb_results(_packed(spark, d, fused), _units(spark, d), seeds), "results")
    results = results.withColumn("contract", F.when(F.col("query_id") % 2 == 1, "legacy_kb_v1").otherwise(F.col("contract")))
    none = table(spark, d, "pages").where("false").select(F.col("page_id").alias("query_id"), F.lit(0).alias("place"), "url", F.col("html").alias("content"))
    out = retrieval.source_context(_items(spark, d), none, results).join(retrieval.is_qualified(results), "query_id", "left")
    return out.select("query_id", "qualified", F.length("context").alias("length"))


@register(f"WITH {_BM25} SELECT query_id, unit_id, r AS rank FROM (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY unit_id % 7 DESC, unit_id) AS r FROM bm25) WHERE r <= 10")
def reranked(spark, d):
    """A stand-in scorer over each query's candidates, in batches."""
    pairs = _bm25(spark, d).select("query_id", "unit_id", F.lit("q").alias("query"), (F.col("unit_id") % 7).cast("string").alias("text"))
    scores = retrieval.pair_scores(pairs, lambda batch: [float(b) for _, b in batch], lambda t: len(t.split()))
    return retrieval.reranked(scores, 10).select("query_id", "unit_id", "rank")


@register("SELECT doc_id % 10 AS query_id, doc_id AS unit_id, CASE WHEN doc_id % 9 = 0 THEN 'dropped' WHEN doc_id % 7 = 0 THEN 'not_packed' ELSE 'clipped' END AS error FROM documents WHERE doc_id % 9 = 0 AND doc_id % 7 <> 0 OR doc_id % 7 = 0 AND doc_id % 9 <> 0 OR doc_id % 7 <> 0 AND doc_id % 9 <> 0 AND doc_id % 5 = 0")
def clip_violations(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select((n % 10).alias("query_id"), n.alias("unit_id"), "doc_id")
    packed = rows.where("doc_id % 7 <> 0").withColumn("text_sha256", F.lit("x"))
    shown = rows.where("doc_id % 9 <> 0").withColumn("text_sha256", F.when(n % 5 == 0, "y").otherwise("x"))
    return retrieval.clip_violations(shown, packed)


_SHOWN = """src AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN 1500 ELSE 2000 END AS shown, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT CASE WHEN source_id % 97 = 5 THEN -1 - source_id ELSE source_id END AS source_id, source_id * 4 + k AS window_id, n * k // 4 AS s, n * k // 4 + n // 3 + k AS e FROM src, (VALUES (0), (1), (2), (3)) v(k)),
x AS (SELECT w.*, n IS NOT NULL AND s < e AND e <= n AS inside, coalesce(e <= least(n, shown), false) AS first FROM w LEFT JOIN src USING (source_id)),
m AS (SELECT source_id, sum(greatest(e - greatest(s, before), 0))::BIGINT AS gold_chars FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE inside) GROUP BY source_id)"""


def _arms(spark, d):
    """Four windows to a text, which overlap; some end behind it, some name no source."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select(n, F.length(F.coalesce("text", F.lit(""))).alias("n"))
    sources = docs.select(n.alias("source_id"), F.when(n % 2 == 0, "web").otherwise("kb").alias("kind"), F.col("n").alias("length"))
    k = docs.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).withColumn("s", F.floor(F.col("n") * F.col("k") / 4))
    windows = k.select(F.when(n % 97 == 5, -1 - n).otherwise(n).alias("source_id"), (n * 4 + F.col("k")).alias("window_id"), "s", (F.col("s") + F.floor(F.col("n") / 3) + F.col("k")).alias("e"))
    return retrieval.exposure_arms(sources, windows, {"web": 1500, "kb": 2000})


@register(f"WITH {_SHOWN} SELECT source_id, window_id, first AS in_prefix, inside AS in_whole, inside AS in_gold, coalesce(gold_chars, 0) AS gold_chars FROM x LEFT JOIN m USING (source_id)")
def exposure_arms(spark, d):
    return _arms(spark, d)


@register(f"WITH {_SHOWN} SELECT window_id // 8 * 4 + window_id % 4 AS requirement, bool_or(first) AS any_visible, bool_and(first) AS all_visible, count(*) AS windows FROM x GROUP BY ALL")
def requirement_visibility(spark, d):
    return retrieval.requirement_visibility(_arms(spark, d).withColumn("requirement", F.floor(F.col("window_id") / 8) * 4 + F.col("window_id") % 4), "in_prefix")


@register(
    """WITH s AS (SELECT doc_id AS run_id, length(coalesce(text, '')) AS n, quality, toxic, doc_id AS k FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT run_id, coalesce(toxic, 0) = 0 AND n < 10000 AND coalesce(quality, 0) = 1 AND k % 11 <> 0 AND k % 13 <> 0 AND n > 20 AND k % 7 <> 0 AND k % 17 <> 0 AS verified, k % 19 <> 0 AND k % 3 <> 2 AND k % 5 <> 4 AND k % 23 <> 0 AND n % 12 BETWEEN 7 AND 10 AND k % 29 <> 0 AS reflected FROM s)
SELECT *, verified AND reflected AS eligible FROM g"""
)
def gate_eligibility(spark, d):
    """Documents as drafts: toxic ones have ended, those of quality are valid, a character costs a hundred-thousandth, the length gives the score."""
    k, n = F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))
    name = lambda bad: F.when(k % bad == 0, "old").otherwise(F.md5(k.cast("string").cast("binary")))
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return retrieval.gate_eligible(rows.select(
        k.alias("run_id"), F.when(F.col("toxic") == 1, "done").alias("terminal_status"), (n / 100000).alias("cost_usd"), (F.col("quality") == 1).alias("draft_valid"), (k % 11 != 0).alias("inventory_current"), F.md5(k.cast("string").cast("binary")).alias("identity"),
        name(13).alias("verification_identity"), (n > 20).alias("semantic_ok"), (k % 7 != 0).alias("material_ok"), (k % 17 != 0).alias("citation_ok"), name(19).alias("reflection_identity"), F.when(k % 3 == 2, "fallback").otherwise("judge").alias("origin"),
        (k % 5 != 4).alias("provider_called"), F.when(k % 23 != 0, "ok").alias("parse_status"), F.when(k % 29 != 0, n % 12).alias("score"),
    ))


@register("WITH r AS (SELECT user_id, CASE WHEN user_id % 6 = 0 THEN 'parse_failed' WHEN user_id % 6 = 1 THEN NULL ELSE 'completed' END AS status, count(*) - 90 AS n0, count(*) FILTER (event_type = 'error') / count(*) AS u FROM events GROUP BY user_id), s AS (SELECT user_id, status, greatest(n0, 0) AS n, CASE WHEN user_id % 7 <> 0 THEN round(u, 9) END AS u FROM r) SELECT user_id, CASE WHEN status IS DISTINCT FROM 'completed' THEN 'status_not_completed' WHEN n = 0 THEN 'empty_report' WHEN u IS NULL THEN 'uvr_undefined' WHEN u > 0.15 THEN 'uvr_above_threshold' ELSE 'accepted' END AS reason FROM s")
def runtime_acceptance(spark, d):
    u = F.col("user_id")
    r = table(spark, d, "events").groupBy("user_id").agg(F.greatest(F.count("*") - 90, F.lit(0)).alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 9).alias("u"))
    status = F.when(u % 6 == 0, "parse_failed").when(u % 6 != 1, "completed")
    return r.select("user_id", retrieval.runtime_acceptance(status, F.col("n"), F.when(u % 7 != 0, F.col("u"))).alias("reason"))


@register(
    """WITH c AS (SELECT conv_id AS id, sum(length(coalesce(text, ''))) FILTER (role = 'user') AS p, sum(length(coalesce(text, ''))) FILTER (role = 'assistant') AS c FROM conversations GROUP BY conv_id), t AS (SELECT *, CASE id % 3 WHEN 1 THEN p WHEN 2 THEN p - 500 END AS t FROM c)
SELECT id, CASE WHEN t >= 0 THEN t WHEN t IS NULL THEN p + c END::BIGINT AS tokens, CASE WHEN t < 0 THEN 'invalid' WHEN t >= 0 THEN 'provider' WHEN p + c IS NULL THEN 'incomplete' ELSE 'component_sum' END AS basis FROM t"""
)
def token_totals(spark, d):
    """Characters of a conversation's user and assistant as parts; some totals are missing or below zero."""
    size = lambda role: F.sum(F.when(F.col("role") == role, F.length(F.coalesce("text", F.lit("")))))
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(size("user").alias("p"), size("assistant").alias("c"))
    total = F.when(F.col("id") % 3 == 1, F.col("p")).when(F.col("id") % 3 == 2, F.col("p") - 500)
    return t.select("id", retrieval.total_tokens(total, F.col("p"), F.col("c")).alias("x")).select("id", "x.*")


@register("SELECT count(*) AS cells, round(sum(length(coalesce(text, '')) * 0.27 / 1000000 + 500 * 1.10 / 1000000), 8) AS upper_usd, sum(length(coalesce(text, '')) * 0.27 / 1000000 + 500 * 1.10 / 1000000) <= 1.0 AS allowed FROM documents")
def cost_preflight(spark, d):
    cells = table(spark, d, "documents").select(F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.lit(500).alias("max_tokens"))
    return retrieval.cost_preflight(cells, 0.27, 1.10, 1.0)


_RV = "r AS (SELECT doc_id, source, left(text, 300) AS claim, CASE WHEN quality = 0 THEN 'unverified' WHEN toxic = 1 THEN 'weak' ELSE 'verified' END AS status FROM labels JOIN documents USING (doc_id))"


def _reviewed(spark, d):
    status = F.when(F.col("quality") == 0, "unverified").when(F.col("toxic") == 1, "weak").otherwise("verified")
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("claim")), "doc_id").withColumn("status", status).withColumn("place", F.col("doc_id"))


@register(f"WITH {_RV} SELECT source, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'weak') AS weak, count(*) FILTER (status = 'unverified') AS unverified, md5(coalesce(string_agg(left(coalesce(claim, ''), 200), chr(10) ORDER BY doc_id) FILTER (status = 'unverified'), '')) AS open_md5 FROM r GROUP BY source")
def review_summary(spark, d):
    out = retrieval.review_summary(_reviewed(spark, d), ["source"])
    return out.select("source", "verified", "weak", "unverified", F.md5(F.col("open_claims").cast("binary")).alias("open_md5"))


@register("WITH o AS (SELECT source, doc_id, '[weak] ' || lang || ' (contradiction, limitation)' AS t FROM labels JOIN documents USING (doc_id) WHERE toxic = 1), n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) || '. ' || t AS t FROM o) SELECT source, string_agg(t, chr(10) ORDER BY doc_id) AS feedback FROM n GROUP BY source")
def blocker_feedback(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("claim")), "doc_id")
    rows = rows.select("source", F.col("doc_id").alias("place"), "claim", F.lit("weak").alias("status"), F.array(F.lit("contradiction"), F.lit("limitation")).alias("kinds"), (F.col("toxic") == 1).alias("blocking"))
    return retrieval.blocker_feedback(rows, ["source"])


@register("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN contains(coalesce(text, ''), CASE doc_id % 4 WHEN 1 THEN 'the' WHEN 2 THEN lang ELSE 'zzzz' END) END AS stands FROM documents")
def structural_checks(spark, d):
    n = F.col("doc_id")
    wanted = F.when(n % 4 == 0, " ").when(n % 4 == 1, "the").when(n % 4 == 2, F.col("lang")).otherwise("zzzz")
    return table(spark, d, "documents").select("doc_id", retrieval.structural_check(wanted, F.col("text")).alias("stands"))


@register(
    """WITH own AS (SELECT user_id, kind, label, row_number() OVER (PARTITION BY user_id ORDER BY place, kind, label) AS number FROM (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'kb' ELSE 'web' END AS kind, 'k' || event_id % 7 AS label, min(event_id) AS place FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0 GROUP BY ALL)),
web AS (SELECT user_id, 'web' AS kind, label, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, label) AS number FROM (SELECT user_id, props AS label, max(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END) AS score FROM events WHERE event_type = 'click' AND user_id % 3 <> 2 GROUP BY ALL) WHERE user_id NOT IN (SELECT user_id FROM own)),
kb AS (SELECT user_id, 'kb' AS kind, label, row_number() OVER (PARTITION BY user_id ORDER BY place, label) AS number FROM (SELECT user_id, 'f' || event_id % 9 AS label, min(event_id) AS place FROM events WHERE event_type = 'view' GROUP BY ALL) WHERE user_id NOT IN (SELECT user_id FROM own UNION ALL SELECT user_id FROM web))
SELECT user_id AS run_id, number, kind, label FROM own UNION ALL SELECT user_id, number, kind, label FROM web WHERE number <= 3 UNION ALL SELECT user_id, number, kind, label FROM kb WHERE number <= 3"""
)
def bibliographies(spark, d):
    """Users as runs: every third cites what it purchased, of the others one half found pages by clicks, the rest have views alone."""
    n, run, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    e = table(spark, d, "events").withColumn("run_id", run)
    cited = e.where((kind == "purchase") & (run % 3 == 0)).select("run_id", n.alias("place"), F.when(n % 2 == 0, "kb").otherwise("web").alias("kind"), F.concat(F.lit("k"), (n % 7).cast("string")).alias("label"))
    web = e.where((kind == "click") & (run % 3 != 2)).select("run_id", F.col("props").alias("url"), F.when(n % 5 != 0, F.col("value")).alias("score"))
    return retrieval.bibliography(cited, web, e.where(kind == "view").select("run_id", n.alias("place"), F.concat(F.lit("f"), (n % 9).cast("string")).alias("source")), e.select("run_id"))


@register("WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), s AS (SELECT *, 2 AS a, 3 AS b FROM l) SELECT doc_id, CASE WHEN len(ls) >= 3 THEN length(ls[1]) + 1 END AS start, CASE WHEN len(ls) >= 3 THEN length(ls[1]) + 1 + length(regexp_replace(ls[2] || chr(10) || ls[3], '[\\r\\n]+$', '')) END AS \"end\" FROM s")
def line_spans(spark, d):
    """Second and third line of every text."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", retrieval.line_span(F.col("text"), F.lit(2), F.lit(3)).alias("x")).select("doc_id", "x.start", "x.end")


@register("SELECT conv_id, printf('claim-%03d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS claim_id, 0 AS start, length(text) AS \"end\" FROM conversations")
def numbered_rosters(spark, d):
    return retrieval.numbered_roster(table(spark, d, "conversations"), "conv_id", "turn", "text").drop("claim_text")


@register("SELECT source || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.md' END AS path, CASE WHEN doc_id % 5 = 2 THEN 'unsupported' WHEN trim(coalesce(text, '')) = '' OR doc_id % 11 = 0 THEN 'empty' ELSE 'ok' END AS status FROM documents")
def ingest_reports(spark, d):
    n = F.col("doc_id")
    suffix = F.when(n % 5 == 0, ".MD").when(n % 5 == 1, ".txt").when(n % 5 == 2, ".pdf").otherwise(".md")
    return retrieval.ingest_report(table(spark, d, "documents").select(F.concat("source", F.lit("/"), n.cast("string"), suffix).alias("path"), F.when(n % 11 != 0, F.col("text")).alias("content")))


@register(f"SELECT lang, t AS canonical, CASE max(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'true' WHEN 1 THEN 'unknown' ELSE 'false' END AS material FROM (SELECT doc_id, lang, unnest(list_slice({_TOK}, 1, 2)) AS t FROM documents) GROUP BY ALL")
def merged_materiality(spark, d):
    from ..functions import text

    words = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.slice(text.tokens(F.col("text")), 1, 2)).alias("canonical"))
    n = F.col("doc_id") % 3
    return retrieval.merged_materiality(words.withColumn("material", F.when(n == 0, "true").when(n == 1, "unknown").otherwise("false")), ["lang"])
