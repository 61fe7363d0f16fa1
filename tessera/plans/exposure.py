"""Registered queries of the exposure operators.

A document stands in its source from doc_id * 10 to doc_id * 10 + 25, so neighbours
overlap. An item's gold spans lie around the documents of its own number and of
three further; grade is item mod 3, gating items are those not divisible by five.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import exposure, fusion
from ..sources import store
from ..sources.tables import table
from .catalog import _BM25, _DENSE_ITEMS, _FUSED, _LINKED, _TOK, _bm25, _dense_items, _items, _units, register

_TEN = _FUSED.replace("QUALIFY rank <= 5)", "QUALIFY rank <= 10)")
_GOLD = """gold AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, 2 AS grade, item_id % 5 <> 0 AS gating FROM benchmark UNION ALL SELECT item_id, 'src' || ((item_id + 7) % 20), 1, item_id % 5 <> 0 FROM benchmark)"""
_SPANS = """spans AS (SELECT item_id AS query_id, d.source, k AS span_id, item_id * 10 + 3 + k * 30 AS gs, item_id * 10 + 12 + k * 30 AS ge, item_id % 3 AS grade, item_id % 5 = 0 AS ambiguous, item_id % 4 = 0 AS tail
  FROM benchmark, (VALUES (0), (1)) v(k), documents d WHERE d.doc_id = item_id + k * 3)"""
_PLACED = "u AS (SELECT doc_id AS unit_id, source, doc_id * 10 AS s, doc_id * 10 + 25 AS e, text FROM documents)"


def _ten(spark, d, near=None, found=None):
    return fusion.rrf(_dense_items(spark, d) if near is None else near, _bm25(spark, d) if found is None else found, k=10)


def _placed(spark, d):
    return _units(spark, d).withColumn("s", F.col("unit_id") * 10).withColumn("e", F.col("s") + 25)


def _gold(spark, d):
    q = F.col("query_id")
    pairs = F.array(F.struct((q % 20).alias("s"), F.lit(2).alias("grade")), F.struct(((q + 7) % 20).alias("s"), F.lit(1).alias("grade")))
    return _items(spark, d).select("query_id", F.explode(pairs).alias("p")).select("query_id", F.concat(F.lit("src"), F.col("p.s").cast("string")).alias("source"), "p.grade", (q % 5 != 0).alias("gating"))


def _spans(spark, d):
    q, k = F.col("query_id"), F.col("span_id")
    out = _items(spark, d).select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("span_id"))
    out = out.join(_units(spark, d).select((F.col("unit_id")).alias("at"), "source"), F.col("at") == q + k * 3).drop("at")
    return out.withColumn("gs", q * 10 + 3 + k * 30).withColumn("ge", q * 10 + 12 + k * 30).withColumn("grade", q % 3).withColumn("ambiguous", q % 5 == 0).withColumn("tail", q % 4 == 0)


_CONCEPTS = f"""c AS (SELECT DISTINCT item_id AS query_id, unnest(list_slice({_TOK}, 1, 4)) AS concept FROM benchmark)"""


@register(
    f"""WITH {_FUSED}, {_CONCEPTS}, shown AS (SELECT query_id, k, lower(string_agg(text, ' ' ORDER BY rank)) AS t FROM fused JOIN documents ON doc_id = unit_id, (VALUES (1), (3), (5)) v(k) WHERE rank <= k GROUP BY ALL),
m AS (SELECT c.query_id, v.k, count(*) FILTER (contains(coalesce(t, ''), concept)) AS found, count(*) AS required FROM c CROSS JOIN (VALUES (1), (3), (5)) v(k) LEFT JOIN shown s ON s.query_id = c.query_id AND s.k = v.k GROUP BY ALL)
SELECT query_id, k, found, required, round(found / required, 3) AS coverage, found / required >= 2.0::DOUBLE / 3 AS passed FROM m"""
)
def concept_coverage(spark, d):
    """The first four words of an item as its concepts."""
    ranked = fusion.rrf(_dense_items(spark, d), _bm25(spark, d)).join(_units(spark, d), "unit_id").select("query_id", "rank", "text")
    concepts = _items(spark, d).select("query_id", F.explode(F.array_distinct(F.slice(text.tokens(F.col("text")), 1, 4))).alias("concept"))
    out = [exposure.concept_coverage(ranked, concepts, k) for k in (1, 3, 5)]
    return out[0].unionByName(out[1]).unionByName(out[2])


_PER_QUERY = f"""{_FUSED}, {_GOLD}, h AS (SELECT query_id, rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS first FROM fused JOIN documents ON doc_id = unit_id),
j AS (SELECT h.*, g.source IS NOT NULL AS rel FROM h LEFT JOIN gold g ON g.query_id = h.query_id AND g.source = h.source),
pq AS (SELECT q.query_id, k, q.query_id % 6 <> 0 AS in_domain, coalesce(count(DISTINCT source) FILTER (rel), 0) AS found, coalesce(sum(CASE WHEN rel AND first THEN 1.0 / log2(rank + 1.0) END), 0) AS dcg,
  count(DISTINCT source) AS unique_sources, count(source) - count(DISTINCT source) AS duplicate_slots
  FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN (VALUES (1), (3), (5)) v(k) LEFT JOIN j ON j.query_id = q.query_id AND j.rank <= k GROUP BY ALL),
pm AS (SELECT *, (found > 0)::INT AS hit, found / 2.0 AS recall, least(1.0, dcg / CASE WHEN k = 1 THEN 1.0 ELSE 1.0 + 1.0 / log2(3.0) END) AS ndcg FROM pq)"""


def _per_query(spark, d):
    from ..operators import metrics

    ranked = fusion.rrf(_dense_items(spark, d), _bm25(spark, d)).join(_units(spark, d).select("unit_id", "source"), "unit_id").select("query_id", "rank", "source")
    gold = _gold(spark, d).select("query_id", "source", F.lit(1).alias("grade"))
    out = None
    for k in (1, 3, 5):
        one = metrics.metrics_at(ranked, gold, k).select("query_id", F.lit(k).alias("k"), F.col("hit").cast("int").alias("hit"), "recall", "ndcg", "unique_sources", "duplicate_slots")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("in_domain", F.col("query_id") % 6 != 0)


@register(
    f"""WITH {_PER_QUERY} SELECT k, count(*) AS queries, count(*) FILTER (in_domain) AS in_domain_queries, round(avg(hit) FILTER (in_domain), 3) AS hit, round(avg(recall) FILTER (in_domain), 3) AS recall, round(avg(ndcg) FILTER (in_domain), 3) AS ndcg,
  round(avg(unique_sources), 3) AS unique_sources, round(avg(duplicate_slots), 3) AS duplicate_slots FROM pm GROUP BY k"""
)
def retrieval_report(spark, d):
    """Items divisible by six count as out of the domain."""
    return exposure.retrieval_report(_per_query(spark, d))


@register(f"WITH {_PER_QUERY} SELECT query_id FROM pm WHERE k = 3 AND in_domain AND hit = 0")
def missed_at_three(spark, d):
    return _per_query(spark, d).where("k = 3 and in_domain and hit = 0").select("query_id")


@register(f"WITH {_GOLD} SELECT source, count(*) AS queries, sum(grade)::BIGINT AS grades FROM gold WHERE gating GROUP BY source")
def gating_queries(spark, d):
    return _gold(spark, d).where("gating").groupBy("source").agg(F.count("*").alias("queries"), F.sum("grade").alias("grades"))


_BEST = "SELECT query_id, source, min(rank) AS r FROM {0} JOIN documents ON doc_id = unit_id GROUP BY ALL"


@register(
    f"""WITH {_TEN}, {_GOLD}, bd AS ({_BEST.format('dense')}), bb AS ({_BEST.format('bm25')}), bh AS ({_BEST.format('fused')}),
m AS (SELECT g.*, bd.r AS dr, bb.r AS br, bh.r AS hr, g.query_id % 4 = 0 AND bd.r IS NULL AS cut FROM gold g LEFT JOIN bd USING (query_id, source) LEFT JOIN bb USING (query_id, source) LEFT JOIN bh USING (query_id, source) WHERE bh.r IS NULL OR bh.r > 5)
SELECT query_id, source, grade, dr AS dense_best_rank, br AS bm25_best_rank, hr AS hybrid_best_rank,
  array_to_string(list_filter([CASE WHEN dr IS NULL THEN 'embedding semantic failure' END, CASE WHEN cut THEN 'embedding truncation' END, CASE WHEN NOT gating THEN 'evaluator ambiguity' END,
    CASE WHEN dr IS NOT NULL OR br IS NOT NULL THEN 'fusion/ranking failure' END, CASE WHEN br IS NULL THEN 'lexical/BM25 failure' END], lambda x: x IS NOT NULL), '; ') AS layers,
  CASE WHEN cut THEN 'plausible' ELSE 'demonstrated' END AS confidence, grade = 2 AS critical FROM m"""
)
def missed_sources(spark, d):
    """Lists hold twenty candidates, so a rank beyond twenty is a missing one here."""
    sources = _units(spark, d).select("unit_id", "source")
    lists = [x.join(sources, "unit_id").select("query_id", "source", "rank") for x in (_dense_items(spark, d), _bm25(spark, d), _ten(spark, d))]
    return exposure.missed_sources(_gold(spark, d), *lists, _items(spark, d).where("query_id % 4 = 0"))


_UNION = """{0}c AS (SELECT x.query_id, x.source, x.span_id, bool_and(EXISTS (SELECT 1 FROM {1} r JOIN u USING (unit_id) WHERE r.query_id = x.query_id AND u.source = x.source AND r.rank <= {2} AND u.s <= p AND p < u.e)) AS ok
  FROM spans x, LATERAL (SELECT unnest(range(gs, ge)) AS p) GROUP BY ALL)"""


@register(
    f"""WITH {_TEN}, {_PLACED}, {_SPANS}, {_UNION.format('a', 'dense', 20)}, {_UNION.format('b', 'bm25', 20)}, {_UNION.format('f', 'fused', 10)}, {_UNION.format('t', 'fused', 5)},
m AS (SELECT x.*, ac.ok AS in_dense, bc.ok AS in_bm25, fc.ok AS in_final, tc.ok AS shown FROM spans x JOIN ac USING (query_id, source, span_id) JOIN bc USING (query_id, source, span_id) JOIN fc USING (query_id, source, span_id) JOIN tc USING (query_id, source, span_id))
SELECT query_id, source, span_id, in_dense, in_bm25, in_final, array_to_string(list_filter([CASE WHEN NOT (in_dense OR in_bm25) THEN 'candidate-K failure' END, CASE WHEN NOT (in_dense OR in_bm25) THEN 'embedding semantic failure' END,
  CASE WHEN tail THEN 'embedding truncation' END, CASE WHEN ambiguous THEN 'evaluator ambiguity' END, CASE WHEN in_final THEN 'final-K ranking failure' END, CASE WHEN in_dense OR in_bm25 THEN 'fusion/ranking failure' END,
  CASE WHEN NOT (in_dense OR in_bm25) THEN 'lexical/BM25 failure' END], lambda x: x IS NOT NULL), '; ') AS layers, grade = 2 AS critical FROM m WHERE NOT shown"""
)
def missed_spans(spark, d):
    """Covered character by character in SQL, by islands here."""
    placed = _placed(spark, d).select("unit_id", "source", "s", "e")
    # Twenty rows a query each, used twice below.
    near, found = store.written(_dense_items(spark, d), "near"), store.written(_bm25(spark, d), "found")
    lists = [x.join(placed, "unit_id").select("query_id", "rank", "source", "s", "e") for x in (near, found, _ten(spark, d, near, found))]
    return exposure.missed_spans(_spans(spark, d), *lists)


_LAYERS = f"""{_TEN}, {_LINKED}, {_PLACED}, {_SPANS},
layer AS (SELECT 'retrieved' AS layer, query_id, unit_id FROM fused WHERE rank <= 5
  UNION SELECT 'expanded', query_id, unit_id FROM fused WHERE rank <= 5 UNION SELECT 'expanded', query_id, prev_id FROM fused JOIN linked USING (unit_id) WHERE rank <= 5 AND prev_id IS NOT NULL
  UNION SELECT 'expanded', query_id, next_id FROM fused JOIN linked USING (unit_id) WHERE rank <= 5 AND next_id IS NOT NULL),
placed AS (SELECT layer, query_id, unit_id, u.source, s, e, len({_TOK}) AS tokens FROM layer JOIN u USING (unit_id)),
per AS (SELECT layer, query_id, source, count(*) AS n, sum(tokens) AS tokens, count(DISTINCT s) AS iv FROM placed GROUP BY ALL),
shape AS (SELECT layer, query_id, sum(n)::BIGINT AS units, sum(iv)::BIGINT AS unique_intervals, sum(tokens)::BIGINT AS tokens, count(*) AS n_sources, max(n) AS most_of_one, round(max(n) / sum(n), 8) AS max_share FROM per GROUP BY ALL),
lc AS (SELECT l.layer, x.query_id, x.source, x.span_id, bool_and(EXISTS (SELECT 1 FROM placed r WHERE r.layer = l.layer AND r.query_id = x.query_id AND r.source = x.source AND r.s <= p AND p < r.e)) AS ok
  FROM spans x, (VALUES ('retrieved'), ('expanded')) l(layer), LATERAL (SELECT unnest(range(gs, ge)) AS p) GROUP BY ALL),
found AS (SELECT lc.layer, lc.query_id, round(count(*) FILTER (ok) / count(*), 8) AS span_recall, round(count(DISTINCT CASE WHEN per.n IS NOT NULL THEN lc.source END) / count(DISTINCT lc.source), 8) AS source_recall
  FROM lc LEFT JOIN per ON per.layer = lc.layer AND per.query_id = lc.query_id AND per.source = lc.source GROUP BY ALL)"""


def _layers(spark, d):
    placed = _placed(spark, d).select("unit_id", "source", "s", "e", F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"))
    seeds = fusion.rrf(_dense_items(spark, d), _bm25(spark, d))
    linked = fusion.with_neighbours(_units(spark, d), document="source", start="unit_id")
    expanded = fusion.first_seen(fusion.expand(seeds, linked)).select("query_id", "unit_id", F.col("seed_rank").alias("rank"))
    return {n: x.select("query_id", "rank", "unit_id").join(placed, "unit_id") for n, x in (("retrieved", seeds), ("expanded", expanded))}


@register(
    f"""WITH {_LAYERS} SELECT l.layer, q.item_id AS query_id, coalesce(units, 0) AS units, coalesce(unique_intervals, 0) AS unique_intervals, coalesce(tokens, 0) AS tokens, coalesce(n_sources, 0) AS n_sources,
  coalesce(most_of_one, 0) AS most_of_one, coalesce(max_share, 0) AS max_share, coalesce(span_recall, 0) AS span_recall, coalesce(source_recall, 0) AS source_recall
FROM benchmark q CROSS JOIN (VALUES ('retrieved'), ('expanded')) l(layer) LEFT JOIN shape s ON s.layer = l.layer AND s.query_id = q.item_id LEFT JOIN found f ON f.layer = l.layer AND f.query_id = q.item_id"""
)
def exposure_layers(spark, d):
    out = [exposure.layer_metrics(x, _spans(spark, d), _items(spark, d)).withColumn("layer", F.lit(n)) for n, x in _layers(spark, d).items()]
    return out[0].unionByName(out[1])


@register(
    f"""WITH {_LAYERS}, a AS (SELECT * FROM lc WHERE layer = 'retrieved' AND ok), b AS (SELECT * FROM lc WHERE layer = 'expanded' AND ok),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.ok AS x, b.ok AS y FROM a FULL JOIN b ON a.query_id = b.query_id AND a.source = b.source AND a.span_id = b.span_id)
SELECT query_id, count(*) FILTER (y IS NULL) AS lost, count(*) FILTER (x IS NULL) AS gained, CASE WHEN count(*) FILTER (y IS NULL) > 0 THEN 'EVIDENCE REGRESSED' WHEN count(*) FILTER (x IS NULL) > 0 THEN 'EVIDENCE IMPROVED' ELSE 'EVIDENCE SAME' END AS change FROM j GROUP BY query_id"""
)
def evidence_change(spark, d):
    """From the retrieved to the expanded layer."""
    spans = _spans(spark, d).select("query_id", "source", "span_id", "gs", "ge")

    def covered(layer):
        hit = exposure.covered_spans(spans, layer.select("query_id", "source", "s", "e"), ["query_id", "source"]).where("covered")
        return hit.select("query_id", F.concat_ws("::", "source", F.col("span_id").cast("string")).alias("span"))

    layers = _layers(spark, d)
    return exposure.evidence_change(covered(layers["retrieved"]), covered(layers["expanded"]), ["query_id"])


@register(
    f"""WITH {_TEN}, {_GOLD}, h AS (SELECT query_id, rank, source FROM fused JOIN documents ON doc_id = unit_id), f AS (SELECT g.query_id, g.source, min(rank) AS place FROM gold g LEFT JOIN h ON h.query_id = g.query_id AND h.source = g.source GROUP BY ALL),
t AS (SELECT query_id, query_id % 3 AS kind, count(place) / 2 AS shown, count(*) FILTER (WHERE place <= 5) / 2 AS packed, count(place) - count(*) FILTER (WHERE place <= 5) AS lost FROM f GROUP BY query_id), b AS (SELECT * FROM t WHERE kind < 2)
SELECT 'partial_available_recall_below_one' AS gate, query_id FROM b WHERE kind = 1 AND packed <> 1 UNION ALL SELECT 'packed_below_retrieved_recall', query_id FROM b WHERE packed < shown
UNION ALL SELECT 'critical_grade2_lost_at_packed', query_id FROM b WHERE lost > 0 UNION ALL SELECT 'backend_identity_mismatch', NULL
UNION ALL SELECT 'macro_packed_below_floor', NULL FROM b HAVING avg(packed) < 0.875 UNION ALL SELECT 'answerable_macro_below_floor', NULL FROM b WHERE kind = 0 HAVING avg(packed) < 0.8333"""
)
def evidence_gates(spark, d):
    """Gold sources among the first ten as retrieved, among the first five as packed; a third of the items has no answer."""
    ranked = _ten(spark, d).join(_units(spark, d).select("unit_id", "source"), "unit_id")
    first = ranked.groupBy("query_id", "source").agg(F.min("rank").alias("at"))
    found = _gold(spark, d).join(first, ["query_id", "source"], "left").groupBy("query_id").agg(F.count("at").alias("ten"), F.count_if(F.col("at") <= 5).alias("five"))
    kind = F.when(F.col("query_id") % 3 == 0, "ANSWERABLE").when(F.col("query_id") % 3 == 1, "PARTIAL").otherwise("ABSENT")
    scores = found.select("query_id", kind.alias("answerability"), (F.col("five") / 2).alias("packed_recall"), (F.col("ten") / 2).alias("shown_recall"), (F.col("ten") - F.col("five")).alias("lost_grade2"))
    return exposure.evidence_gates(scores, parity_failures=1)


@register(
    f"""WITH {_TEN}, h AS (SELECT query_id, rank, unit_id, source FROM fused JOIN documents ON doc_id = unit_id),
l AS (SELECT item_id AS query_id, 0 AS label, 'src' || (item_id % 20) AS source, NULL::BIGINT AS unit_id FROM benchmark UNION ALL SELECT item_id, 1, NULL, item_id FROM benchmark)
SELECT query_id, label, 'retrieved' AS layer, rank, h.source, h.unit_id FROM h JOIN l USING (query_id) WHERE (l.source IS NULL OR l.source = h.source) AND (l.unit_id IS NULL OR l.unit_id = h.unit_id)"""
)
def hard_negatives(spark, d):
    ranked = _ten(spark, d).join(_units(spark, d).select("unit_id", "source"), "unit_id").withColumn("layer", F.lit("retrieved"))
    q = F.col("query_id")
    by_source = _items(spark, d).select("query_id", F.lit(0).alias("label"), F.concat(F.lit("src"), (q % 20).cast("string")).alias("source"), F.lit(None).cast("long").alias("unit_id"))
    by_unit = _items(spark, d).select("query_id", F.lit(1).alias("label"), F.lit(None).cast("string").alias("source"), q.alias("unit_id"))
    return exposure.hard_negative_exposure(by_source.unionByName(by_unit), ranked)


@register(
    f"""WITH {_TEN}, c AS (SELECT query_id, source, count(*) AS n FROM fused JOIN documents ON doc_id = unit_id GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY query_id) AS top FROM c)
SELECT query_id, count(*) AS unique_sources, any_value(top) AS max_count, round(any_value(top) / sum(n), 8) AS max_share, string_agg(source, ',' ORDER BY source) FILTER (n = top) AS dominant FROM m GROUP BY query_id"""
)
def source_concentration(spark, d):
    return exposure.source_concentration(_ten(spark, d).join(_units(spark, d).select("unit_id", "source"), "unit_id"))


@register(
    f"""WITH {_TEN} SELECT item_id AS query_id, round(max(d.score) FILTER (d.rank = 1), 6) AS dense_top1_similarity, round(max(d.score), 6) AS max_dense_similarity,
  round((SELECT max(b.score) FROM bm25 b WHERE b.query_id = item_id AND b.rank = 1), 6) AS bm25_top_score, round((SELECT max(rrf) FROM fused f WHERE f.query_id = item_id AND f.rank = 1), 6) AS hybrid_top1_rrf,
  (SELECT count(*) FROM fused f WHERE f.query_id = item_id) AS retrieved, (SELECT count(*) FROM fused f WHERE f.query_id = item_id AND f.rank <= 5) AS packed, round(1 - max(d.score) FILTER (d.rank = 1), 6) AS dense_top1_distance
FROM benchmark LEFT JOIN dense d ON d.query_id = item_id WHERE item_id % 6 = 0 GROUP BY item_id"""
)
def absent_diagnostics(spark, d):
    """Items divisible by six stand for queries without evidence; the five seeds for what is packed."""
    q = _items(spark, d).where("query_id % 6 = 0")
    ten = _ten(spark, d)
    out = exposure.absent_diagnostics(q, _dense_items(spark, d), _bm25(spark, d), ten, ten.where("rank <= 5"))
    return out.select("query_id", "retrieved", "packed", *[F.round(c, 6).alias(c) for c in ("dense_top1_similarity", "max_dense_similarity", "bm25_top_score", "hybrid_top1_rrf", "dense_top1_distance")])


@register(f"WITH {_BM25}, {_DENSE_ITEMS}, a AS (SELECT * FROM dense WHERE rank <= 10), b AS (SELECT * FROM bm25 WHERE rank <= 10) SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.rank, b.rank) AS rank, a.unit_id AS left_id, b.unit_id AS right_id FROM a FULL JOIN b ON a.query_id = b.query_id AND a.rank = b.rank WHERE a.unit_id IS DISTINCT FROM b.unit_id")
def order_parity(spark, d):
    return exposure.order_parity(_dense_items(spark, d).where("rank <= 10"), _bm25(spark, d).where("rank <= 10"))


@register("""WITH a AS (SELECT user_id, event_type AS path, round(sum(value), 2)::VARCHAR AS v FROM events WHERE event_id % 7 <> 0 GROUP BY ALL), b AS (SELECT user_id, event_type AS path, round(sum(value), 2)::VARCHAR AS v FROM events WHERE event_id % 11 <> 0 OR user_id % 2 = 0 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.path, b.path) AS path, a.v::DOUBLE AS execution_1, b.v::DOUBLE AS execution_2 FROM a FULL JOIN b ON a.user_id = b.user_id AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def execution_diff(spark, d):
    def run(keep):
        return table(spark, d, "events").where(keep).groupBy("user_id", F.col("event_type").alias("path")).agg(F.round(F.sum("value"), 2).alias("value"))

    return exposure.execution_diff(run("event_id % 7 <> 0"), run("event_id % 11 <> 0 or user_id % 2 = 0"), ["user_id"])


@register(
    """WITH c AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN doc_id * 10 + 15 END AS tail_start, doc_id * 10 + 25 AS e FROM documents), s AS (SELECT item_id AS query_id, d.source, k AS span_id, item_id * 10 + 10 + k * 7 AS gs, item_id * 10 + 16 + k * 7 AS ge FROM benchmark, (VALUES (0), (1)) v(k), documents d WHERE d.doc_id = item_id)
SELECT query_id, span_id, CASE WHEN bool_or(tail_start <= gs AND ge <= e) THEN 'whole' WHEN bool_or(greatest(gs, tail_start) < least(ge, e) AND tail_start IS NOT NULL) THEN 'partial' ELSE 'none' END AS exposure FROM s JOIN c USING (source) GROUP BY ALL"""
)
def tail_exposure(spark, d):
    chunks = _placed(spark, d).select("source", F.when(F.col("unit_id") % 3 == 0, F.col("s") + 15).alias("tail_start"), "e")
    q, k = F.col("query_id"), F.col("span_id")
    spans = _items(spark, d).select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("span_id")).join(_units(spark, d).select(F.col("unit_id").alias("query_id"), "source"), "query_id")
    return exposure.tail_exposure(chunks, spans.withColumn("gs", q * 10 + 10 + k * 7).withColumn("ge", q * 10 + 16 + k * 7))


@register(
    """WITH u AS (SELECT doc_id AS unit_id, source || chr(10) || chr(10) || text AS t, length(text) AS n, length(source) + 2 AS p FROM documents WHERE text IS NOT NULL AND text <> ''),
x AS (SELECT unit_id, unnest([0, n // 2]) AS s, unnest([n // 2, n]) AS e, CASE WHEN length(t) <= 200 THEN n ELSE least(n, greatest(200 - p, 0)) END AS reach FROM u)
SELECT unit_id, s, least(e, reach) AS e FROM x WHERE s < least(e, reach)"""
)
def clipped_intervals(spark, d):
    """Both halves of a text that is shown as 200 characters behind its source's name."""
    docs = _units(spark, d).where("text is not null and text <> ''")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), n.alias("e")))
    units = docs.select("unit_id", F.concat("source", F.lit("\n\n"), "text").alias("text"), F.lit(0).alias("start"), n.alias("end"), spans.alias("spans"))
    return exposure.clipped_intervals(units, 200)


_PIECES = "sp AS (SELECT user_id AS span_id, 0 AS gs, 60 + (user_id % 5) * 10 AS ge FROM (SELECT DISTINCT user_id FROM events)), pc AS (SELECT DISTINCT user_id AS span_id, (event_id * 7) % 80 AS s, (event_id * 7) % 80 + 5 + event_id % 23 AS e FROM events WHERE event_id % 4 = 0)"


@register(
    f"""WITH RECURSIVE {_PIECES}, c AS (SELECT span_id, p, EXISTS (SELECT 1 FROM pc WHERE pc.span_id = sp.span_id AND s <= p AND p < e) AS ok FROM sp, LATERAL (SELECT unnest(range(gs, ge)) AS p)),
isl AS (SELECT span_id, count(*) AS islands FROM (SELECT span_id, s, max(e) OVER (PARTITION BY span_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT span_id, greatest(s, gs) AS s, least(e, ge) AS e FROM pc JOIN sp USING (span_id) WHERE greatest(s, gs) < least(e, ge))) WHERE reach IS NULL OR s > reach GROUP BY span_id),
g AS (SELECT span_id, ge, gs AS reach, 0 AS n FROM sp UNION ALL SELECT g.span_id, any_value(g.ge), max(pc.e), any_value(g.n) + 1 FROM g JOIN pc ON pc.span_id = g.span_id AND pc.s <= g.reach AND pc.e > g.reach WHERE g.reach < g.ge GROUP BY g.span_id)
SELECT sp.span_id, coalesce(islands, 0) AS islands, (SELECT count(*) FILTER (NOT ok) FROM c WHERE c.span_id = sp.span_id) AS uncovered, (SELECT min(n) FROM g WHERE g.span_id = sp.span_id AND g.reach >= g.ge) AS min_cover FROM sp LEFT JOIN isl USING (span_id)"""
)
def span_structure(spark, d):
    e = table(spark, d, "events")
    spans = e.select(F.col("user_id").alias("span_id")).distinct().select("span_id", F.lit(0).cast("long").alias("gs"), (60 + (F.col("span_id") % 5) * 10).alias("ge"))
    s = (F.col("event_id") * 7) % 80
    pieces = e.where("event_id % 4 = 0").select(F.col("user_id").alias("span_id"), s.alias("s"), (s + 5 + F.col("event_id") % 23).alias("e")).distinct()
    return exposure.span_structure(spans, pieces)


@register("SELECT source, count(DISTINCT (doc_id // 3, doc_id % 2)) AS unique_intervals FROM documents GROUP BY source")
def unique_intervals(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct(F.struct(F.floor(n / 3), n % 2)).alias("unique_intervals"))


_CANON = r"trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'))"


@register(
    rf"""WITH s AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, source, {_CANON} AS canonical FROM s WHERE {_CANON} <> ''),
a AS (SELECT DISTINCT source, canonical FROM c WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source, canonical FROM c WHERE doc_id % 2 = 1)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'extra' WHEN b.source IS NULL THEN 'missing' ELSE 'matched' END AS outcome, count(*) AS n FROM a FULL JOIN b ON a.source = b.source AND a.canonical = b.canonical GROUP BY ALL"""
)
def text_agreement(spark, d):
    """Lines of even documents against those of odd ones, by source."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("s"))
    c = lines.select("doc_id", "source", text.collapse(F.col("s")).alias("canonical")).where("canonical <> ''")
    out = exposure.text_agreement(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"), ["source"])
    return out.groupBy("source", "outcome").agg(F.count("*").alias("n"))


@register(
    f"""WITH w AS (SELECT conv_id AS run, {_TOK} AS ws FROM conversations), t AS (SELECT DISTINCT run, text FROM (SELECT run, unnest([array_to_string(ws[1:12], ' '), array_to_string(ws[2:4], ' '), array_to_string(ws[6:9], ' '), array_to_string(ws[11:14], ' ')]) AS text FROM w) WHERE text <> '')
SELECT o.run, o.text AS whole, count(DISTINCT i.text) AS n FROM t o JOIN t i ON o.run = i.run AND o.text <> i.text AND contains(' ' || o.text || ' ', ' ' || i.text || ' ') GROUP BY ALL HAVING count(DISTINCT i.text) >= 2"""
)
def split_claims(spark, d):
    """The first twelve words of every turn as a claim, and parts of the turn as others."""
    part = lambda at, n: F.array_join(F.slice("ws", at, n), " ")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), text.tokens(F.col("text")).alias("ws"))
    claims = turns.select("run", F.explode(F.array(part(1, 12), part(2, 3), part(6, 4), part(11, 4))).alias("text")).where("text <> ''").distinct()
    return exposure.shared_terms(claims, ["run"])


@register(
    """WITH r AS (SELECT page_id AS row_id, page_id % 20 AS run, CASE page_id % 5 WHEN 1 THEN '' WHEN 2 THEN url WHEN 3 THEN 'kb/F' || page_id % 12 || '.md#2' WHEN 4 THEN 'https://nowhere/' || page_id END AS u, page_id % 5 = 2 AND page_id % 7 <> 0 AS fetched, url FROM pages),
k AS (SELECT doc_id % 20 AS run, 'f' || length(coalesce(text, '')) % 12 || '.md' AS source, min(doc_id) AS place FROM documents GROUP BY ALL),
m AS (SELECT r.run, row_id, arg_min(source, (place, source)) AS file FROM r JOIN k ON r.run = k.run AND (contains(lower(trim(u)), source) OR contains(source, lower(trim(u)))) WHERE u <> '' GROUP BY ALL),
h AS (SELECT DISTINCT run, url FROM r WHERE fetched), j AS (SELECT r.run, r.row_id, u, file, h.url AS hit FROM r LEFT JOIN m ON m.run = r.run AND m.row_id = r.row_id LEFT JOIN h ON h.run = r.run AND h.url = u)
SELECT run, row_id, CASE WHEN coalesce(u, '') = '' THEN 'none' WHEN hit IS NOT NULL THEN 'web' WHEN file IS NOT NULL THEN 'kb' ELSE 'unresolved' END AS source_kind, CASE WHEN coalesce(u, '') <> '' THEN coalesce(hit, 'kb:' || file) END AS source_ref FROM j"""
)
def claim_attribution(spark, d):
    """Exact URLs first, then file names by substring either way: pages as report rows, some of them fetched, and files named by the length of documents."""
    n, text_of = F.col("page_id"), lambda c: c.cast("string")
    pages = table(spark, d, "pages").withColumn("run", n % 20)
    named = F.when(n % 5 == 1, "").when(n % 5 == 2, F.col("url")).when(n % 5 == 3, F.concat(F.lit("kb/F"), text_of(n % 12), F.lit(".md#2"))).when(n % 5 == 4, F.concat(F.lit("https://nowhere/"), text_of(n)))
    report = pages.select("run", n.alias("row_id"), named.alias("source_url"), F.when(n % 5 == 2, F.col("url")).alias("norm_url"))
    web = pages.where((n % 5 == 2) & (n % 7 != 0)).select("run", F.col("url").alias("norm_url"))
    kb = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("run"), F.col("doc_id").alias("place"), F.concat(F.lit("f"), text_of(F.length(F.coalesce("text", F.lit(""))) % 12), F.lit(".md")).alias("source"))
    return exposure.attribution(report, web, kb, ["run"])


@register(
    f"""WITH t AS (SELECT doc_id, text, len({_TOK}) AS n FROM documents WHERE text IS NOT NULL), a AS (SELECT count(*) AS new_units, sum(strlen(text))::BIGINT AS new_bytes, sum(n)::BIGINT AS new_tokens, sum(greatest(n - 254, 0))::BIGINT AS new_clipped FROM t WHERE doc_id % 3 = 0),
b AS (SELECT count(*) AS old_units, sum(strlen(text))::BIGINT AS old_bytes, sum(n)::BIGINT AS old_tokens, sum(greatest(n - 254, 0))::BIGINT AS old_clipped FROM t WHERE doc_id % 3 <> 0)
SELECT *, round(new_units / old_units, 6) AS unit_ratio, round(new_tokens / old_tokens, 6) AS token_ratio FROM a, b"""
)
def corpus_effect(spark, d):
    t = _units(spark, d).where("text is not null").select("unit_id", "text", F.size(text.tokens(F.col("text"))).alias("tokens"))
    return exposure.corpus_effect(t.where("unit_id % 3 = 0"), t.where("unit_id % 3 <> 0"))
