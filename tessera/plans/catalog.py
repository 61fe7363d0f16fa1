"""Registered queries over the supplied tables, each beside the SQL that gives the same rows.

Conventions where tables share no key: a benchmark item is a query; the vector
with its number is its query vector; a document's vector is the one with its
number; a document's place in its source follows doc_id; labels stand for
verdicts (quality 1 and toxic 0: verified, both 1: weak, quality 0: unverified).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals, text, urls
from ..operators import chunking, claims, dense, evaluation, fusion, lexical, metrics, policy
from ..sources import store
from ..sources.tables import table
from ..streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


# ---------------------------------------------------------------- text and chunks

_TOK = rf"list_filter(string_split_regex(lower(coalesce(text, '')), '{text.ANY_SPACES}'), lambda w: w <> '')"
_POSTINGS = f"""
toks AS (SELECT doc_id, {_TOK} AS t FROM documents),
postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
lens AS (SELECT doc_id, len(t) AS dl FROM toks),
terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM postings GROUP BY term)"""
_BM25 = f"""{_POSTINGS},
raw AS (SELECT term, ln((SELECT count(*) FROM lens) - df + 0.5) - ln(df + 0.5) AS r FROM terms),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id AS unit_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens)))) AS score
  FROM q JOIN idf USING (term) JOIN postings USING (term) JOIN lens USING (doc_id) GROUP BY ALL HAVING score <> 0),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM scored QUALIFY rank <= 20)"""
_DENSE = """
vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
dense_all AS (SELECT q.vec_id AS query_id, d.vec_id AS unit_id, list_inner_product(q.v, d.v) AS score FROM vec q, vec d WHERE {where}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM dense_all QUALIFY rank <= {k})"""
_DENSE_ITEMS = _DENSE.format(where="q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id IN (SELECT doc_id FROM documents)", k=20)
_DENSE_SELF = _DENSE.format(where="q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id", k=10)
_DENSE_WHOLE = _DENSE.format(where="q.vec_id <> d.vec_id", k=10)
_FUSED = f"""{_BM25}, {_DENSE_ITEMS},
fused_all AS (SELECT query_id, unit_id, sum(1.0 / (59 + rank)) AS rrf, min(rank) FILTER (channel = 'dense') AS dense_rank, min(rank) FILTER (channel = 'bm25') AS bm25_rank
  FROM (SELECT query_id, unit_id, rank, 'dense' AS channel FROM dense UNION ALL SELECT query_id, unit_id, rank, 'bm25' FROM bm25) GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, unit_id) AS rank FROM fused_all QUALIFY rank <= 5)"""
_LINKED = """
linked AS (SELECT doc_id AS unit_id, source, text, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""
_EXPANDED = f"""{_FUSED}, {_LINKED},
members AS (
  SELECT query_id, rank AS seed_rank, 0 AS pos, 'PREVIOUS' AS relation, prev_id AS unit_id FROM fused JOIN linked USING (unit_id) WHERE prev_id IS NOT NULL
  UNION ALL SELECT query_id, rank, 1, 'SEED', unit_id FROM fused JOIN linked USING (unit_id)
  UNION ALL SELECT query_id, rank, 2, 'NEXT', next_id FROM fused JOIN linked USING (unit_id) WHERE next_id IS NOT NULL),
firsts AS (SELECT *, count(*) OVER (PARTITION BY query_id, unit_id) AS seen, row_number() OVER (PARTITION BY query_id, unit_id ORDER BY seed_rank, pos) AS r FROM members QUALIFY r = 1),
sized AS (SELECT f.*, len({_TOK}) AS tokens, d.text FROM firsts f JOIN documents d ON d.doc_id = f.unit_id)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text", "source")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_k(lexical.bm25_scores(lexical.build_index(_units(spark, d)), _items(spark, d)), 20)


def _dense_items(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    docs = vectors.join(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id")), "unit_id", "left_semi")
    items = vectors.withColumnRenamed("unit_id", "query_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    return dense.nearest(spark, items, docs, 20)


def _dense_self(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    return dense.nearest(spark, vectors.where("unit_id % 20 = 0").withColumnRenamed("unit_id", "query_id"), vectors, k, include_self=False)


def _dense_whole(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return dense.neighbours(table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding"), k)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Written down, as plans use it several times; it has a few rows a query."""
    return store.written(fusion.rrf(_dense_items(spark, d), _bm25(spark, d)), "fused")


def _expanded(spark: SparkSession, d: str, fused: DataFrame | None = None) -> DataFrame:
    linked = fusion.with_neighbours(_units(spark, d), document="source", start="unit_id")
    flat = fusion.first_seen(fusion.expand(_fused(spark, d) if fused is None else fused, linked))
    sizes = _units(spark, d).select("unit_id", F.size(text.tokens(F.col("text"))).alias("tokens"), "text")
    return flat.join(sizes, "unit_id")


@register(f"WITH {_POSTINGS} SELECT term, df, cf FROM terms")
def term_df(spark, d):
    return lexical.build_index(_units(spark, d)).terms


@register(
    f"""WITH toks AS (SELECT doc_id, {_TOK} AS t FROM documents),
cuts AS (SELECT doc_id, k AS chunk_index, list_slice(t, k * 350 + 1, k * 350 + 400) AS c FROM toks, LATERAL (SELECT unnest(range(0, (len(t) + 349) // 350)) AS k) WHERE len(t) > 0)
SELECT doc_id, chunk_index, len(c) AS n_tokens, md5(array_to_string(c, ' ')) AS chunk_md5 FROM cuts"""
)
def chunk_fixed_window(spark, d):
    out = chunking.fixed_windows(table(spark, d, "documents"))
    return out.select("doc_id", "chunk_index", "n_tokens", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@register(
    """WITH t AS (SELECT doc_id, text, unnest(range(0, length(text) + 1, 1000)) AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, place, strlen(left(text, place)) AS byte, len(regexp_extract_all(left(text, place), '\\r\\n|\\r|\\n')) + 1 AS line FROM t"""
)
def source_offsets(spark, d):
    """Byte and line of every thousandth character."""
    places = F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(1000)))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", places.alias("place"))
    return rows.select("doc_id", "place", text.byte_offset(F.col("text"), F.col("place")).alias("byte"), text.line_number(F.col("text"), F.col("place")).alias("line"))


# ---------------------------------------------------------------- ranking and packing


@register(f"WITH {_BM25} SELECT query_id, unit_id, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {_DENSE_WHOLE} SELECT query_id, unit_id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, d):
    """Ten nearest of every vector."""
    return _dense_whole(spark, d).select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {_FUSED} SELECT query_id, unit_id, round(rrf, 8) AS rrf_score, dense_rank, bm25_rank, rank FROM fused")
def rrf_fuse(spark, d):
    return _fused(spark, d)


@register(f"WITH {_FUSED} SELECT query_id, unit_id, source, rank FROM fused JOIN documents ON doc_id = unit_id")
def hybrid_top5(spark, d):
    return _fused(spark, d).join(_units(spark, d).select("unit_id", "source"), "unit_id").select("query_id", "unit_id", "source", "rank")


@register(
    f"""WITH {_BM25}, {_DENSE_ITEMS} SELECT query_id, unit_id, d.rank AS dense_rank, round(d.score, 6) AS dense_score, b.rank AS bm25_rank, round(b.score, 6) AS bm25_score
FROM dense d FULL JOIN bm25 b USING (query_id, unit_id)"""
)
def rerank_pool(spark, d):
    pool = fusion.candidate_pool(_dense_items(spark, d), _bm25(spark, d))
    return pool.withColumn("dense_score", F.round("dense_score", 6)).withColumn("bm25_score", F.round("bm25_score", 6))


@register(f"WITH {_EXPANDED} SELECT query_id, seed_rank, pos, relation, unit_id, seen FROM sized")
def neighbor_expand(spark, d):
    return _expanded(spark, d).select("query_id", "seed_rank", "pos", "relation", "unit_id", "seen")


@register(
    f"""WITH RECURSIVE {_EXPANDED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (relation <> 'SEED'), seed_rank, pos, unit_id) AS i FROM sized),
fold AS (
  SELECT query_id, i, unit_id, seed_rank, pos, relation, tokens, tokens <= 2000 AS packed, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.query_id, o.i, o.unit_id, o.seed_rank, o.pos, o.relation, o.tokens, f.used + o.tokens <= 2000, CASE WHEN f.used + o.tokens <= 2000 THEN f.used + o.tokens ELSE f.used END
  FROM fold f JOIN ordered o ON o.query_id = f.query_id AND o.i = f.i + 1),
total AS (SELECT query_id, sum(tokens) FILTER (relation = 'SEED') > 2000 AS over FROM sized GROUP BY query_id)
SELECT query_id, unit_id, seed_rank, relation, coalesce(over, false) AS over_budget, packed AND NOT coalesce(over, false) AS packed, CASE WHEN packed AND NOT coalesce(over, false) THEN count(*) FILTER (packed) OVER (PARTITION BY query_id ORDER BY i) - 1 END AS packed_order FROM fold JOIN total USING (query_id)"""
)
def seed_first_pack(spark, d):
    """Whole documents as units; a query whose seeds exceed the budget packs nothing and says so."""
    return fusion.pack(_expanded(spark, d), fail_over_budget=False).select("query_id", "unit_id", "seed_rank", "relation", "over_budget", "packed", "packed_order")


@register(
    f"""WITH {_EXPANDED},
left_over AS (SELECT *, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY query_id, seed_rank ORDER BY pos, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM sized)
SELECT query_id, seed_rank, unit_id, least(length(text), rest)::BIGINT AS shown FROM left_over WHERE rest > 0"""
)
def clip_seed_group(spark, d):
    out = fusion.clip_groups(_expanded(spark, d), 1500)
    return out.select("query_id", "seed_rank", "unit_id", F.length("clipped").cast("long").alias("shown"))


@register(f"WITH {_EXPANDED} SELECT query_id, count(*) AS units, count(*) FILTER (relation = 'SEED') AS seeds, sum(seen) - count(*) AS dropped FROM sized GROUP BY query_id")
def surviving_seeds(spark, d):
    return _expanded(spark, d).groupBy("query_id").agg(F.count("*").alias("units"), F.count_if(F.col("relation") == "SEED").alias("seeds"), (F.sum("seen") - F.count("*")).alias("dropped"))


# ---------------------------------------------------------------- metrics


def _by_label(spark, d):
    """Ranked neighbours with the number of their vector as source; relevant are vectors of the query's label."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    ranked = _dense_whole(spark, d).select("query_id", "rank", F.col("unit_id").alias("source"))
    mine = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    by = ranked.join(vectors.select(F.col("vec_id").alias("source"), "label"), "source").join(mine, "query_id")
    n = vectors.groupBy(F.col("label").alias("want")).agg((F.count("*") - 1).alias("n_relevant"))
    return by.withColumn("grade", (F.col("label") == F.col("want")).cast("int")).join(n, "want")


_RANKED = f"""{_DENSE_WHOLE},
ranked AS (SELECT query_id, rank, unit_id, (d.label = q.label)::INT AS grade, d.label, (SELECT count(*) - 1 FROM vec x WHERE x.label = q.label) AS n_relevant
  FROM dense JOIN vec d ON d.vec_id = unit_id JOIN vec q ON q.vec_id = query_id)"""


@register(
    f"""WITH {_RANKED}
SELECT query_id, (sum(grade) > 0) AS hit, round(sum(grade) / any_value(n_relevant), 6) AS recall, round(sum(grade) / 10.0, 6) AS precision,
  round(coalesce(1.0 / min(rank) FILTER (grade = 1), 0), 6) AS mrr FROM ranked WHERE n_relevant > 0 GROUP BY query_id"""
)
def ir_metrics(spark, d):
    by = _by_label(spark, d).where("n_relevant > 0").groupBy("query_id")
    return by.agg(
        (F.sum("grade") > 0).alias("hit"), F.round(F.sum("grade") / F.first("n_relevant"), 6).alias("recall"), F.round(F.sum("grade") / F.lit(10.0), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("grade") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
    )


@register(
    f"""WITH {_FUSED}, hits AS (SELECT query_id, rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS first FROM fused JOIN documents ON doc_id = unit_id),
gold AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source FROM benchmark UNION SELECT item_id, 'src' || ((item_id + 7) % 20) FROM benchmark),
j AS (SELECT h.*, g.source IS NOT NULL AS rel FROM hits h LEFT JOIN gold g ON g.query_id = h.query_id AND g.source = h.source),
m AS (SELECT query_id, count(*) FILTER (rel) AS slots, count(DISTINCT source) FILTER (rel) AS found, min(rank) FILTER (rel) AS r, sum(CASE WHEN rel AND first THEN 1.0 / log2(rank + 1.0) ELSE 0 END) AS dcg,
  count(DISTINCT source) AS u, count(*) AS n FROM j GROUP BY query_id)
SELECT g.query_id, coalesce(found, 0) > 0 AS hit, round(coalesce(found, 0) / 2.0, 6) AS recall, round(coalesce(slots, 0) / 5.0, 6) AS precision, round(coalesce(1.0 / r, 0), 6) AS mrr,
  round(least(1.0, coalesce(dcg, 0) / (1.0 + 1.0 / log2(3.0))), 6) AS ndcg, coalesce(u, 0) AS unique_sources, coalesce(n - u, 0) AS duplicate_slots
FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN m USING (query_id)"""
)
def ndcg_binary(spark, d):
    """Metrics of the fused list against two sources per item (item mod 20, and seven further), an invented relevance."""
    ranked = hybrid_top5(spark, d).select("query_id", "rank", "source")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    gold = items.select("query_id", F.explode(F.array(F.col("query_id") % 20, (F.col("query_id") + 7) % 20)).alias("s")).select("query_id", F.concat(F.lit("src"), F.col("s").cast("string")).alias("source"), F.lit(1).alias("grade")).distinct()
    out = metrics.metrics_at(ranked, gold, 5)
    return out.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")], "unique_sources", "duplicate_slots")


@register(
    f"""WITH {_FUSED}, hits AS (SELECT query_id, source, count(*) AS n FROM fused JOIN documents ON doc_id = unit_id GROUP BY ALL)
SELECT query_id, count(*) AS n_sources, (sum(n) - count(*))::BIGINT AS repeated, round(max(n) / sum(n), 6) AS max_share FROM hits GROUP BY query_id"""
)
def source_occupancy(spark, d):
    return metrics.occupancy(hybrid_top5(spark, d), 5)


@register(
    f"""WITH {_RANKED}, m AS (SELECT query_id, sum(grade) FILTER (rank <= 5) / 5.0 AS p5, sum(grade) / 10.0 AS p10 FROM ranked GROUP BY query_id)
SELECT query_id, round(p10 - p5, 6) AS delta, CASE WHEN p10 < p5 THEN 'REGRESSED' WHEN p10 > p5 THEN 'IMPROVED' ELSE 'SAME' END AS class FROM m"""
)
def ab_classification(spark, d):
    """Precision at 10 against precision at 5."""
    m = _by_label(spark, d).groupBy("query_id").agg((F.sum(F.when(F.col("rank") <= 5, F.col("grade")).otherwise(0)) / 5.0).alias("p5"), (F.sum("grade") / 10.0).alias("p10"))
    delta = F.round(F.col("p10") - F.col("p5"), 8)
    return m.select("query_id", F.round(delta, 6).alias("delta"), metrics.classify([delta]).alias("class"))


@register(
    f"""WITH t AS (SELECT lang, len({_TOK}) AS n FROM documents)
SELECT lang, count(*) AS n, min(n) AS low, median(n) AS median, quantile_disc(n, 0.95) AS p95, max(n) AS high, round(avg(n), 6) AS mean, sum(n)::BIGINT AS total FROM t GROUP BY lang"""
)
def token_percentiles(spark, d):
    docs = table(spark, d, "documents").select("lang", F.size(text.tokens(F.col("text"))).alias("n_tokens"))
    return metrics.distribution(docs, "n_tokens", ("lang",))


@register("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    """Grouped by digest, so texts are not shuffled."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register(
    f"""WITH {_DENSE_SELF}, p AS (SELECT a.query_id, a.unit_id AS unit_a, b.unit_id AS unit_b, list_inner_product(x.v, y.v) AS c FROM dense a JOIN dense b ON a.query_id = b.query_id AND a.rank < b.rank JOIN vec x ON x.vec_id = a.unit_id JOIN vec y ON y.vec_id = b.unit_id)
SELECT query_id, unit_a, unit_b, round(c, 6) AS cosine FROM p WHERE c >= 0.25"""
)
def near_dup_pairs(spark, d):
    """Similar pairs within each query's ten nearest; the tables hold no vectors as close as the default of 0.95."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")
    top = _dense_self(spark, d).select("query_id", "rank", "unit_id").join(vectors, "unit_id")
    return dense.similar_pairs(top, 0.25).withColumn("cosine", F.round("cosine", 6))


# ---------------------------------------------------------------- intervals

_IV = "iv AS (SELECT user_id, (floor(epoch(ts))::BIGINT // 60) AS s, (floor(epoch(ts))::BIGINT // 60) + 1 + (event_id % 240) AS e FROM events)"


def _intervals(spark, d):
    minute = F.floor(F.unix_timestamp("ts") / 60)
    return table(spark, d, "events").select("user_id", minute.alias("s"), (minute + 1 + F.col("event_id") % 240).alias("e"))


@register(
    f"""WITH {_IV}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, i"""
)
def window_merge(spark, d):
    return intervals.islands(_intervals(spark, d), ["user_id"])


@register(
    f"""WITH {_IV}, u AS (SELECT user_id, count(DISTINCT x) AS covered FROM (SELECT user_id, unnest(range(s, e)) AS x FROM iv) GROUP BY user_id)
SELECT user_id, sum(e - s)::BIGINT AS total, covered, (sum(e - s) - covered)::BIGINT AS overlap FROM iv JOIN u USING (user_id) GROUP BY user_id, covered"""
)
def interval_coverage(spark, d):
    return intervals.overlap_chars(_intervals(spark, d), ["user_id"])


# ---------------------------------------------------------------- web


@register("SELECT min(page_id) AS page_id, url, count(*) AS n FROM pages GROUP BY url")
def web_dedup_first(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@register(
    """WITH p AS (SELECT page_id, url, regexp_matches(url, '^[hH][tT][tT][pP][sS]://([A-Za-z0-9.-]+)(:443)?(/[^?#]*)?(\\?[^#]*)?(#.*)?$') AS ok,
  lower(regexp_extract(url, '^[hH][tT][tT][pP][sS]://([A-Za-z0-9.-]+)(:443)?(/[^?#]*)?(\\?[^#]*)?(#.*)?$', 1)) AS host,
  regexp_extract(url, '^[hH][tT][tT][pP][sS]://([A-Za-z0-9.-]+)(:443)?(/[^?#]*)?(\\?[^#]*)?(#.*)?$', 3) AS path,
  regexp_extract(url, '^[hH][tT][tT][pP][sS]://([A-Za-z0-9.-]+)(:443)?(/[^?#]*)?(\\?[^#]*)?(#.*)?$', 4) AS query FROM pages)
SELECT page_id, CASE WHEN ok AND length(url) <= 2048 AND NOT regexp_matches(url, '[\\x00-\\x20\\x7F\\\\]') AND NOT (regexp_matches(url, '%([^0-9A-Fa-f]|$)') OR regexp_matches(url, '%[0-9A-Fa-f]([^0-9A-Fa-f]|$)'))
  AND regexp_matches(host, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$') THEN 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS norm_url FROM p"""
)
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm_url"))


@register("SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def pages_by_host(spark, d):
    return table(spark, d, "pages").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


# ---------------------------------------------------------------- claims

_SENT = r"regexp_replace(trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g')), '[.!?]+$', '')"
_CLAIMS = f"""
parts AS (SELECT doc_id, lang, source, unnest(string_split_regex(text, '[.!?][\\x20\\x09-\\x0D]+')) AS s, generate_subscripts(string_split_regex(text, '[.!?][\\x20\\x09-\\x0D]+'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id * 10000000 + i AS pos, doc_id, lang, source, {_SENT} AS claim_text FROM parts),
claims AS (SELECT *, 'clm-' || left(sha256(claim_text), 16) AS claim_id FROM c WHERE claim_text <> '')"""


def _claims(spark, d):
    """Sentences of documents as claims."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    parts = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", r"[.!?][\x20\x09-\x0D]+")).alias("i", "s"))
    body = F.regexp_replace(text.collapse(F.col("s")), r"[.!?]+$", "")
    out = parts.select((F.col("doc_id") * 10000000 + F.col("i")).alias("pos"), "doc_id", "lang", "source", body.alias("claim_text")).where("claim_text <> ''")
    return out.withColumn("claim_id", text.claim_id(F.col("claim_text")))


_MATERIAL = "CASE WHEN pos % 7 = 0 THEN 'true' WHEN pos % 3 = 0 THEN 'unknown' ELSE 'false' END"
_TYPE = "CASE WHEN lang IN ('en', 'de') THEN 'factual' ELSE 'definition' END"
_MERGED = f"""{_CLAIMS},
merged AS (SELECT claim_id, count(*) AS n_rows, arg_min(source, pos) AS section, arg_min({_TYPE}, pos) AS claim_type,
  max(CASE {_MATERIAL} WHEN 'true' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) AS m FROM claims GROUP BY claim_id)"""


def _inventory(spark, d):
    pos = F.col("pos")
    rows = _claims(spark, d).select(
        "claim_id", "pos", F.col("source").alias("section"), F.when(F.col("lang").isin("en", "de"), "factual").otherwise("definition").alias("claim_type"),
        F.when(pos % 7 == 0, "true").when(pos % 3 == 0, "unknown").otherwise("false").alias("material"), F.lit("").alias("reason"),
        F.array(F.lit(0)).alias("starts"), F.lit(False).alias("ambiguous"), F.array().cast("array<string>").alias("req_ids"), F.lit(False).alias("requires_citation"),
    )
    return claims.build_inventory(rows)


@register(
    f"""WITH {_MERGED} SELECT claim_id, n_rows, section, claim_type, CASE m WHEN 2 THEN 'true' WHEN 1 THEN 'unknown' ELSE 'false' END AS material,
  CASE WHEN claim_type = 'factual' AND m > 0 THEN true WHEN claim_type = 'definition' AND m = 2 THEN true ELSE false END AS requires_citation FROM merged"""
)
def claim_merge(spark, d):
    return _inventory(spark, d).select("claim_id", "n_rows", "section", "claim_type", "material", "requires_citation")


@register(f"WITH {_MERGED} SELECT 'type' AS kind, t AS name, count(*) FILTER (claim_type = t) AS n FROM merged, (VALUES ('factual'), ('definition'), ('opinion')) v(t) GROUP BY t UNION ALL SELECT 'material', t, count(*) FILTER (m = k) FROM merged, (VALUES ('false', 0), ('unknown', 1), ('true', 2)) v(t, k) GROUP BY t UNION ALL SELECT 'anchor', t, CASE WHEN t = 'bound' THEN (SELECT count(*) FROM merged) ELSE 0 END FROM (VALUES ('bound'), ('bound_multiple'), ('ANCHOR_FAILED'), ('ANCHOR_AMBIGUOUS')) v(t)")
def inventory_counts(spark, d):
    return claims.inventory_counts(_inventory(spark, d), ("factual", "definition", "opinion"))


@register(
    """WITH q AS (SELECT doc_id, text, left(text, 6) AS quote FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, quote, len(list_filter(range(1, length(text) - length(quote) + 2), lambda i: substr(text, i, length(quote)) = quote)) AS n FROM q WHERE length(quote) > 0)
SELECT doc_id, n, CASE WHEN n = 0 THEN 'ANCHOR_FAILED' WHEN n = 1 THEN 'bound' ELSE 'ANCHOR_AMBIGUOUS' END AS validity, CASE WHEN n > 1 THEN 'ambiguous_quote' WHEN n = 0 THEN 'quote_not_found' END AS reason FROM o"""
)
def occurrence_bind(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", F.substring("text", 1, 6).alias("quote")).where("quote <> ''")
    # a literal pattern counted with overlap: built-in, linear in the text; an end mark inside the quote is written apart
    pattern = F.concat(F.lit(r"(?=\Q"), F.replace(F.col("quote"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    n = F.regexp_count("text", pattern).cast("long")
    return docs.withColumn("n", n).select("doc_id", "n", text.anchor_validity(F.col("n"), F.lit(False)).alias("validity"), text.bind_quote(F.col("n"), F.col("quote")).alias("reason"))


_VERDICT = "CASE WHEN quality = 0 THEN 'unverified' WHEN toxic = 1 THEN 'weak' ELSE 'verified' END"


def _report(spark, d):
    verdict = F.when(F.col("quality") == 0, "unverified").when(F.col("toxic") == 1, "weak").otherwise("verified")
    return table(spark, d, "labels").withColumn("status", verdict).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")


@register(
    f"""WITH r AS (SELECT source, {_VERDICT} AS status FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS n, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'weak') AS n_weak, count(*) FILTER (status = 'unverified') AS n_unverified,
  round(count(*) FILTER (status = 'unverified') / count(*), 3) AS uvr, round(avg(CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'weak' THEN 0.75::DOUBLE ELSE 0::DOUBLE END), 3) AS grounding FROM r GROUP BY source"""
)
def grounding_rollup(spark, d):
    return claims.rollup(_report(spark, d), ["source"])


@register(
    f"""WITH r AS (SELECT source, {_VERDICT} AS status FROM labels JOIN documents USING (doc_id)), u AS (SELECT source, round(count(*) FILTER (status = 'unverified') / count(*), 3) AS uvr, count(*) AS n FROM r GROUP BY source)
SELECT source, uvr, uvr <= 0.15 AND n >= 5 AS accepted FROM u"""
)
def uvr_gate(spark, d):
    out = claims.rollup(_report(spark, d), ["source"])
    return out.select("source", "uvr", claims.accepted(F.col("uvr"), F.col("n") >= 5).alias("accepted"))


@register(
    """WITH x AS (SELECT doc_id, quality = 1 AS s, doc_id % 3 <> 0 AS e, toxic = 1 AS b FROM labels)
SELECT s AS support, e AS entailed, b AS blocked, CASE WHEN NOT s AND e THEN 'INVALID' WHEN NOT s THEN 'unverified' WHEN e AND NOT b THEN 'verified' ELSE 'weak' END AS status,
  array_to_string(list_filter([CASE WHEN NOT s AND e THEN 'entailment_without_support' END, CASE WHEN NOT s THEN 'no_support' END, CASE WHEN s AND NOT e THEN 'partial_entailment' END, CASE WHEN b THEN 'blocker_present' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n
FROM x GROUP BY ALL"""
)
def status_truth_table(spark, d):
    """Statuses and reasons of all labelled documents, counted."""
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("support"), (F.col("doc_id") % 3 != 0).alias("entailed"), (F.col("toxic") == 1).alias("blocked"))
    c = F.col("support"), F.col("entailed"), F.col("blocked")
    return rows.select("*", claims.claim_status(*c).alias("status"), F.array_join(claims.reason_codes(*c), ",").alias("reasons")).groupBy("support", "entailed", "blocked", "status", "reasons").agg(F.count("*").alias("n"))


@register(
    """WITH obs AS (SELECT doc_id AS claim_id, quality = 1 AS support, quality = 1 AND toxic = 0 AS entailed, toxic = 1 AS blocked FROM labels WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, quality = 1, quality = 1 AND toxic = 0, toxic = 1 FROM labels WHERE doc_id % 13 = 0),
roster AS (SELECT doc_id AS claim_id FROM labels WHERE doc_id % 17 <> 0),
o AS (SELECT claim_id, count(*) AS n, any_value(support) AS s, any_value(entailed) AS e, any_value(blocked) AS b FROM obs GROUP BY claim_id),
j AS (SELECT coalesce(r.claim_id, o.claim_id) AS claim_id, r.claim_id AS rc, o.claim_id AS oc, n, s, e, b FROM roster r FULL JOIN o ON r.claim_id = o.claim_id),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN oc IS NULL THEN 'missing_observation' END, CASE WHEN rc IS NULL THEN 'extra_observation' END, CASE WHEN n > 1 THEN 'duplicate_observation' END], lambda v: v IS NOT NULL), ',') AS reasons FROM j)
SELECT claim_id, CASE WHEN reasons = '' THEN 'VALID' ELSE 'INVALID' END AS validity, CASE WHEN reasons = '' THEN CASE WHEN NOT s THEN 'unverified' WHEN e AND NOT b THEN 'verified' ELSE 'weak' END END AS status, reasons FROM x"""
)
def adjudication(spark, d):
    labels = table(spark, d, "labels")
    seen = labels.select(F.col("doc_id").alias("claim_id"), (F.col("quality") == 1).alias("support"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("entailed"), (F.col("toxic") == 1).alias("blocked"))
    observations = seen.where("claim_id % 11 <> 0").unionByName(seen.where("claim_id % 13 = 0"))
    return claims.adjudicate(labels.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("claim_id")), observations)


@register(f"SELECT doc_id, {_VERDICT} AS status, toxic = 1 AS blocking FROM labels WHERE quality = 0 OR toxic = 1")
def obligations(spark, d):
    report = _report(spark, d).withColumn("blocked", F.col("toxic") == 1).withColumn("validity", F.lit("VALID"))
    return claims.obligations(report).select("doc_id", "status", "blocking")


@register(
    """WITH web AS (SELECT p.page_id % 40 AS request_id, p.page_id AS source_id, url AS source_text FROM pages p),
w AS (SELECT request_id, source_id, source_text, row_number() OVER (PARTITION BY request_id ORDER BY source_id) AS n FROM web QUALIFY n <= 5),
k AS (SELECT doc_id % 40 AS request_id, doc_id AS source_id, text AS source_text, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY length(text) DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL QUALIFY n <= 5)
SELECT request_id, 'WEB-' || lpad(n::VARCHAR, 3, '0') AS evidence_id, source_id, sha256(source_text) AS source_sha256 FROM w UNION ALL SELECT request_id, 'KB-' || lpad(n::VARCHAR, 3, '0'), source_id, sha256(source_text) FROM k"""
)
def evidence_manifest(spark, d):
    web = table(spark, d, "pages").select((F.col("page_id") % 40).alias("request_id"), F.col("page_id").alias("rank"), F.col("page_id").alias("source_id"), F.col("url").alias("source_text"))
    kb = table(spark, d, "documents").where(F.col("text").isNotNull()).select((F.col("doc_id") % 40).alias("request_id"), (-F.length("text")).alias("rank"), F.col("doc_id").alias("source_id"), F.col("text").alias("source_text"))
    return claims.evidence_manifest(web, kb).select("request_id", "evidence_id", "source_id", "source_sha256")


# ---------------------------------------------------------------- policies


@register(
    """WITH links AS (SELECT doc_id % 30 AS req_id, quality = 1 AS resolved, CASE WHEN toxic = 1 AND doc_id % 5 = 0 THEN 'unknown' ELSE 'true' END AS material FROM labels),
req AS (SELECT range AS req_id, CASE range % 4 WHEN 0 THEN true WHEN 1 THEN false END AS structural FROM range(0, 40)),
b AS (SELECT req_id, count(*) AS n, bool_or(material = 'unknown') AS u, bool_or(NOT resolved) AS o FROM links GROUP BY req_id)
SELECT req_id, CASE WHEN structural THEN 'SATISFIED' WHEN n IS NULL THEN 'MISSING' WHEN u THEN 'UNKNOWN' WHEN o THEN 'UNRESOLVED' WHEN NOT coalesce(structural, true) THEN 'MISSING' ELSE 'SATISFIED' END AS state FROM req LEFT JOIN b USING (req_id)"""
)
def material_policy(spark, d):
    links = table(spark, d, "labels").select((F.col("doc_id") % 30).alias("req_id"), F.col("doc_id").alias("claim_id"), (F.col("quality") == 1).alias("resolved"), F.when((F.col("toxic") == 1) & (F.col("doc_id") % 5 == 0), "unknown").otherwise("true").alias("material"))
    req = spark.range(40).select(F.col("id").alias("req_id"), F.when(F.col("id") % 4 == 0, True).when(F.col("id") % 4 == 1, False).alias("structural"))
    return policy.requirement_states(req, links)


_PLAN = """base AS (SELECT l_orderkey AS doc_id, (l_linenumber - 1) // 2 * 10 AS start, (l_linenumber - 1) // 2 * 10 + 10 + l_suppkey % 2 * 5 AS "end", l_linenumber AS claim_id, ['KB-' || lpad((l_partkey % 9)::VARCHAR, 3, '0')] AS evidence_ids FROM lineitem),
plan AS (SELECT doc_id, start, "end", list_sort(list_distinct(list(claim_id))) AS claim_ids, list(evidence_ids[1] ORDER BY claim_id, evidence_ids) AS ev FROM base GROUP BY ALL)"""


def _plan(spark, d):
    slot = F.floor((F.col("l_linenumber") - 1) / 2) * 10
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), slot.alias("start"), (slot + 10 + F.col("l_suppkey") % 2 * 5).alias("end"), F.col("l_linenumber").alias("claim_id"),
        F.array(F.concat(F.lit("KB-"), F.lpad((F.col("l_partkey") % 9).cast("string"), 3, "0"))).alias("evidence_ids"),
    )
    return policy.citation_plan(rows)


@register(f"""WITH {_PLAN} SELECT doc_id, start, "end", len(claim_ids) AS n_claims, len(list_distinct(ev)) AS n_evidence FROM plan""")
def citation_plan(spark, d):
    return _plan(spark, d).select("doc_id", "start", "end", F.size("claim_ids").cast("long").alias("n_claims"), F.size("evidence_ids").cast("long").alias("n_evidence"))


@register(
    f"""WITH {_PLAN}, p AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM plan)
SELECT doc_id, start, "end", reach AS with_end FROM p WHERE start < reach"""
)
def citation_conflicts(spark, d):
    return policy.placement_conflicts(_plan(spark, d)).select("doc_id", "start", "end", "with_end")


# ---------------------------------------------------------------- evaluation and roll-ups


@register("SELECT g.v AS gold, p.v AS predicted, (SELECT count(*) FROM labels WHERE quality = g.v AND toxic = p.v) AS n FROM (VALUES (0), (1), (2)) g(v), (VALUES (0), (1), (2)) p(v)")
def confusion_matrix(spark, d):
    return evaluation.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1, 2])


@register(
    """WITH runs AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) AS uvr, sum(value) / 1000 AS cost, epoch(max(ts)) - epoch(min(ts)) AS wall_s, count(*) >= 5 AS valid FROM events GROUP BY user_id)
SELECT count(*) AS n, count(*) FILTER (valid) AS n_valid, round(avg(cost) FILTER (valid), 3) AS mean_cost, round(avg(uvr) FILTER (valid), 3) AS mean_uvr, round(avg(wall_s), 1) AS mean_wall_s, count(*) FILTER (valid AND uvr <= 0.15) AS n_pass FROM runs"""
)
def benchmark_rollup(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("uvr"), (F.sum("value") / 1000).alias("cost"),
        (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("wall_s"), (F.count("*") >= 5).alias("valid"),
    )
    return evaluation.run_rollup(runs).withColumn("mean_cost", F.round("mean_cost", 3))


@register("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def latency_summary(spark, d):
    out = metrics.distribution(table(spark, d, "events"), "value", ("event_type",))
    return out.select("event_type", "n", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), F.round("total", 3).alias("total"))


@register("SELECT user_id, event_type, (props::JSON ->> '$.k')::INT AS k, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE user_id % 4 <> 0 GROUP BY ALL")
def journal_unique(spark, d):
    """First request of each key that the journal (users divisible by four) does not hold."""
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    held = rows.where("user_id % 4 = 0")
    return store.reserve_once(held, rows, ["user_id", "event_type", "k"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "k", "event_id")


@register("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY ALL")
def latest_upsert(spark, d):
    rows = table(spark, d, "events")
    return store.latest_per_key(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@register("SELECT count(*) AS before, count(*) FILTER (source <> 'src3') AS after, count(*) FILTER (source = 'src3') AS deleted FROM documents")
def delete_document(spark, d):
    return store.delete_counts(table(spark, d, "documents"), F.col("source") == "src3")


@register("SELECT event_id, md5(event_type || ': ' || user_id::VARCHAR) AS key, floor((epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 86400) <= 7 AS fresh FROM events")
def cache_ttl(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", store.cache_key(F.col("event_type"), F.col("user_id")).alias("key"), store.fresh(F.col("ts").cast("timestamp"), now).alias("fresh"))


@register(
    """SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = 'click') AS attempts, arg_max(event_type, (ts, event_id)) AS last_step FROM events GROUP BY user_id"""
)
def run_state(spark, d):
    renamed = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") == "click", "verify").otherwise(F.col("event_type")))
    out = evaluation.episode_state(renamed, "user_id", "ts", "event_type")
    return out.withColumn("last_step", F.when(F.col("last_step") == "verify", "click").otherwise(F.col("last_step")))


@register(
    """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= 1800 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e) SELECT user_id, min(floor(epoch(ts))::BIGINT) AS started, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, i"""
)
def event_sessions(spark, d):
    """Spark-native addition: sessions closed by half an hour without events."""
    out = stream.sessions(table(spark, d, "events"))
    return out.select("user_id", F.unix_timestamp("started").alias("started"), "n", F.round("value", 4).alias("value"))


@register("SELECT (floor(epoch(ts))::BIGINT // 3600) * 3600 AS started, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    """Spark-native addition: hourly windows."""
    out = stream.tumbling(table(spark, d, "events"))
    return out.select(F.unix_timestamp("started").alias("started"), "event_type", "n", F.round("value", 4).alias("value"))


@register(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
SELECT 'c' || conv_id AS case_id, printf('%04d', n) AS "left", printf('%04d', n + 1) AS "right" FROM t JOIN (SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id) USING (conv_id) WHERE n % 2 = 0 AND n + 1 < size"""
)
def claim_matching(spark, d):
    """Largest matching of even to odd turns of a conversation, each turn with those beside it: the pairs from the first turn on."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    t = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("case_id"), n.alias("n"))
    even, odd = t.where("n % 2 = 0").withColumnRenamed("n", "a"), t.where("n % 2 = 1").withColumnRenamed("n", "b")
    name = lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
    beside = even.withColumn("b", F.explode(F.array(F.col("a") - 1, F.col("a") + 1))).join(odd, ["case_id", "b"])
    return evaluation.largest_matching(beside.select("case_id", name("a").alias("left"), name("b").alias("right")))


@register(None)
def conversation_fuzzy_dedup(spark, d):
    """Order-dependent fuzzy dedup of the sentences of each conversation; no SQL has the ratio, so tests hold it against the sequential rule."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]+\s*")).alias("n", "claim"))
    claims_ = said.select("conv_id", (F.col("turn") * 100000 + F.col("n")).alias("place"), "claim")
    return evaluation.fuzzy_dedup(claims_, ["conv_id"], "place", "claim").select("conv_id", "place")


# ---------------------------------------------------------------- further operators


@register(
    f"""WITH {_FUSED}, hits AS (SELECT query_id, rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS first FROM fused JOIN documents ON doc_id = unit_id),
gold AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, 2 AS grade FROM benchmark UNION ALL SELECT item_id, 'src' || ((item_id + 7) % 20), 1 FROM benchmark),
got AS (SELECT query_id, sum((power(2.0, grade) - 1) / log2(rank + 1.0)) AS dcg FROM hits JOIN gold USING (query_id, source) WHERE first GROUP BY query_id)
SELECT item_id AS query_id, round(coalesce(dcg / (3.0 + 1.0 / log2(3.0)), 0), 6) AS ndcg FROM benchmark LEFT JOIN got ON got.query_id = item_id"""
)
def ndcg_graded(spark, d):
    """Grade 2 for one invented source per item, 1 for another."""
    ranked = hybrid_top5(spark, d).select("query_id", "rank", "source")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    pairs = F.array(F.struct((F.col("query_id") % 20).alias("s"), F.lit(2).alias("grade")), F.struct(((F.col("query_id") + 7) % 20).alias("s"), F.lit(1).alias("grade")))
    gold = items.select("query_id", F.explode(pairs).alias("p")).select("query_id", F.concat(F.lit("src"), F.col("p.s").cast("string")).alias("source"), F.col("p.grade").alias("grade"))
    return metrics.graded_ndcg(ranked, gold, 5).withColumn("ndcg", F.round("ndcg", 6))


@register(
    f"""WITH {_BM25}, {_DENSE_ITEMS}, b AS (SELECT query_id, unit_id FROM bm25 WHERE rank <= 5), a AS (SELECT query_id, unit_id FROM dense WHERE rank <= 5),
j AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, b.unit_id AS ub, a.unit_id AS ua FROM b FULL JOIN a ON a.query_id = b.query_id AND a.unit_id = b.unit_id)
SELECT query_id, count(*) FILTER (ua IS NULL) AS lost, count(*) FILTER (ub IS NULL) AS gained, CASE WHEN count(*) FILTER (ua IS NULL) > 0 THEN 'LOST' WHEN count(*) FILTER (ub IS NULL) > 0 THEN 'GAINED' ELSE 'SAME' END AS change FROM j GROUP BY query_id"""
)
def lost_and_gained(spark, d):
    """Units of the lexical top five that the dense top five lacks, and the reverse."""
    return metrics.lost_and_gained(_bm25(spark, d).where("rank <= 5"), _dense_items(spark, d).where("rank <= 5"), ["query_id", "unit_id"])


@register(
    f"""WITH {_IV}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m),
u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i),
p AS (SELECT user_id, floor(epoch(ts))::BIGINT // 60 + 30 AS gs, floor(epoch(ts))::BIGINT // 60 + 90 AS ge, event_id AS span_id FROM events WHERE event_type = 'purchase'),
c AS (SELECT p.user_id, p.span_id, bool_or(u.s IS NOT NULL) AS covered FROM p LEFT JOIN u ON u.user_id = p.user_id AND u.s <= gs AND u.e >= ge GROUP BY ALL)
SELECT user_id AS query_id, round(count(*) FILTER (covered) / count(*), 6) AS recall FROM c GROUP BY user_id"""
)
def span_recall(spark, d):
    """Hour-long spans half an hour after purchases, held by the union of a user's intervals."""
    minute = F.floor(F.unix_timestamp("ts") / 60)
    spans = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), (minute + 30).alias("gs"), (minute + 90).alias("ge"))
    covered = intervals.covered_spans(spans, _intervals(spark, d), ["user_id"]).withColumnRenamed("user_id", "query_id")
    return metrics.span_recall(covered).withColumn("recall", F.round("recall", 6))


@register(
    """SELECT event_type AS kind, count(*) AS n, count(*) FILTER (100 + event_id % 2000 <= CASE event_type WHEN 'click' THEN 1500 WHEN 'view' THEN 2000 END) AS n_visible FROM events GROUP BY event_type"""
)
def prefix_visibility(spark, d):
    """Windows shown by prefixes of 1500 and 2000 characters, by kind of source."""
    windows = table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 2000).alias("s"), (100 + F.col("event_id") % 2000).alias("e"))
    seen = evaluation.visible_in_prefix(windows, {"click": 1500, "view": 2000})
    return seen.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("visible").alias("n_visible"))


@register("SELECT item_id, k AS position, CASE k WHEN 0 THEN text || ' explained technical' WHEN 1 THEN text || ' failure modes limitations production' ELSE text || ' implementation Python example' END AS query FROM benchmark, (VALUES (0), (1), (2)) v(k)")
def query_expansion(spark, d):
    """Three fixed templates over the whole topic."""
    made = F.array(*[F.concat("text", F.lit(f" {t}")) for t in fusion.QUERY_TEMPLATES])
    return table(spark, d, "benchmark").select("item_id", F.posexplode(made).alias("position", "query"))


@register("SELECT user_id, event_id, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 10")
def web_topk(spark, d):
    """Ten best rows by score per request, ties in input order."""
    return lexical.top_k(table(spark, d, "events"), 10, "user_id", "event_id", F.col("value")).select("user_id", "event_id", F.round("value", 6).alias("value"), "rank")


@register("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, CASE WHEN count(*) < 3 OR avg(value / 40) < 0.5 THEN 'refresh' ELSE 'keep' END AS action FROM events WHERE event_type = 'view' GROUP BY user_id")
def source_refresh(spark, d):
    """Fewer than three sources, or a mean score below one half, ask for a new search; a fortieth of an event's value is its score."""
    views = table(spark, d, "events").where("event_type = 'view'").withColumn("score", F.col("value") / 40)
    return fusion.needs_refresh(views, ["user_id"]).join(views.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")), "user_id").select("user_id", "n", "mean", "action")


@register("SELECT conv_id, turn, left(regexp_replace(regexp_replace(regexp_replace(lower(text), '&', 'and', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM conversations WHERE text IS NOT NULL")
def slugs(spark, d):
    return table(spark, d, "conversations").where(F.col("text").isNotNull()).select("conv_id", "turn", text.slug(F.col("text")).alias("slug"))


@register(
    """WITH g AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g"""
)
def precision_recall(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    counts = table(spark, d, "labels").agg(F.count_if((q == 1) & (t == 1)).alias("tp"), F.count_if((q == 0) & (t == 1)).alias("fp"), F.count_if((q == 1) & (t == 0)).alias("fn"))
    out = evaluation.precision_recall(counts)
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("SELECT conv_id, round((sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) * 0.27::DOUBLE + sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) * 1.1::DOUBLE) / 1e6, 8) AS cost FROM conversations GROUP BY conv_id")
def token_cost(spark, d):
    size = F.length("text")
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", size).otherwise(0)).alias("prompt"), F.sum(F.when(F.col("role") != "user", size).otherwise(0)).alias("completion"))
    return by.select("conv_id", F.round(evaluation.token_cost(), 8).alias("cost"))


@register("SELECT count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS missing, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS extra FROM labels l LEFT JOIN documents d USING (doc_id)")
def roster_equality(spark, d):
    """Both sides of a roster comparison; equal rosters have no missing and no extra ids."""
    roster = table(spark, d, "labels").select("doc_id", F.lit(1).alias("l"))
    both = roster.join(table(spark, d, "documents").select("doc_id", F.lit(1).alias("r")), "doc_id", "full_outer")
    return both.agg(F.count("l").alias("n"), F.count_if(F.col("l").isNotNull() & F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))


@register(
    """SELECT doc_id, substr(text, greatest(p - 180, 0) + 1, least(p + 20 + 180, length(text)) - greatest(p - 180, 0)) AS context FROM (SELECT doc_id, text, length(text) // 2 AS p FROM documents)"""
)
def context_windows(spark, d):
    docs = table(spark, d, "documents").withColumn("p", F.floor(F.length("text") / 2).cast("int"))
    return docs.select("doc_id", text.context_window(F.col("text"), F.col("p"), F.col("p") + 20).alias("context"))
