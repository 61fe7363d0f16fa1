"""Registered queries of overlap joins, nested comparison, tables that change, vetoes and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import intervals, registry, vocabulary
from ..functions.arrays import places
from ..operators import chunking, claims, nested
from ..sources import index, snapshots
from ..sources.tables import fingerprint, table
from .catalog import register


@register(
    r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS x, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS i FROM documents),
lp AS (SELECT doc_id, i, sum(length(x)) OVER w AS e, sum(length(x)) OVER w - length(x) AS s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)), q AS (SELECT doc_id, i - 1 AS b_id, s, coalesce(lead(e, 2) OVER w, last_value(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS e FROM lp WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.]*\.|[^.]+')) AS x, generate_subscripts(regexp_extract_all(text, '[^.]*\.|[^.]+'), 1) AS i FROM documents), a AS (SELECT doc_id, i - 1 AS a_id, sum(length(x)) OVER w - length(x) AS s, sum(length(x)) OVER w AS e FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT a.doc_id, a_id, b_id, a.s AS a_s, a.e AS a_e, q.s AS b_s, q.e AS b_e, CASE WHEN a.s = q.s AND a.e = q.e THEN 'same' WHEN (a.s >= q.s AND a.e <= q.e) OR (q.s >= a.s AND q.e <= a.e) THEN 'nested' ELSE 'overlap' END AS relation
FROM a JOIN q ON a.doc_id = q.doc_id AND a.s < q.e AND q.s < a.e"""
)
def occurrence_pairs(spark, d):
    """All overlapping and nested pairs of sentences and quotes of three lines."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    a = docs.select("doc_id", F.posexplode(places(F.col("text"), r"[^.]*\.|[^.]+")).alias("a_id", "p")).select("doc_id", "a_id", "p.start", "p.end").toDF("doc_id", "a_id", "s", "e")
    lines = docs.select("doc_id", places(F.col("text"), r"[^\n]*\n|[^\n]+").alias("l"))
    quotes = F.transform("l", lambda x, i: F.struct(x["start"].alias("s"), F.coalesce(F.get("l", i + 2), F.try_element_at("l", F.lit(-1)))["end"].alias("e")))
    b = lines.select("doc_id", F.posexplode(quotes).alias("b_id", "q")).select("doc_id", "b_id", "q.s", "q.e")
    return intervals.overlap_pairs(a, b, ["doc_id"])


def _run_json(second: bool) -> str:
    """SQL of both engines: a run of twenty events as a nested document."""
    step = "'{{{{\"id\":' || event_id || ',\"type\":\"' || {kind} || '\"' || {note} || '}}}}'"
    kind = "CASE WHEN event_id % 11 = 0 THEN upper(event_type) ELSE event_type END" if second else "event_type"
    note = "CASE WHEN event_id % 5 = 0 AND event_id % 10 <> 0 THEN ',\"note\":null' ELSE '' END" if second else "CASE WHEN event_id % 5 = 0 THEN ',\"note\":null' ELSE '' END"
    return step.format(kind=kind, note=note)


_LIST = {False: "array_join(transform(array_sort(collect_list(struct(event_id, j))), x -> x.j), ',')", True: "string_agg(j, ',' ORDER BY event_id)"}


def _runs(second: bool, duck: bool) -> str:
    n = "CASE WHEN run_id % 3 = 0 THEN '\"' || count(*) || '\"' ELSE '' || count(*) END" if second else "'' || count(*)"
    tags = "CASE WHEN run_id % 4 = 0 THEN '[\"x\"]' ELSE '[]' END" if second else "'[]'"
    keep = "WHERE event_id % 7 <> 0" if second else ""
    run = "event_id // 20" if duck else "event_id div 20"
    return f"""SELECT run_id, '{{{{"run":' || run_id || ',"steps":[' || {_LIST[duck]} || '],"n":' || {n} || ',"meta":{{{{"tags":' || {tags} || ',"ok":' || CASE WHEN run_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}}}}}}}' AS js
FROM (SELECT {run} AS run_id, event_id, {_run_json(second)} AS j FROM {{events}} {keep}) GROUP BY run_id"""


_TREE = """SELECT run_id, fullkey AS path, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN lower(type) WHEN type = 'NULL' THEN 'null' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, value::VARCHAR AS value
  FROM {t}, json_tree(js::JSON) WHERE type NOT IN ('OBJECT', 'ARRAY') OR value::VARCHAR IN ('{{}}', '[]')"""


@register(
    f"""WITH r1 AS ({_runs(False, True).format(events='events')}), r2 AS ({_runs(True, True).format(events='events')}), a AS ({_TREE.format(t='r1')}), b AS ({_TREE.format(t='r2')}),
f AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.path, b.path) AS path, a.kind AS kind_1, a.value AS value_1, b.kind AS kind_2, b.value AS value_2 FROM a FULL JOIN b ON a.run_id = b.run_id AND a.path = b.path)
SELECT *, CASE WHEN kind_2 IS NULL THEN 'only_1' WHEN kind_1 IS NULL THEN 'only_2' WHEN kind_1 <> kind_2 THEN 'kind' ELSE 'value' END AS change FROM f WHERE kind_1 IS DISTINCT FROM kind_2 OR value_1 IS DISTINCT FROM value_2"""
)
def nested_diff(spark, d):
    """Two executions of runs of twenty events, nested: steps lost, kinds changed, null against missing, empty against filled."""
    events = table(spark, d, "events")
    run = lambda second: spark.sql(_runs(second, False).format(events="tessera_run_events")).select("run_id", F.parse_json("js").alias("v"))
    events.createOrReplaceTempView("tessera_run_events")
    return nested.nested_diff(run(False), run(True), ["run_id"])


@register("SELECT doc_id, source, CASE WHEN doc_id % 100 = 7 THEN -1 ELSE n_chars END AS n_chars, count(*) OVER () AS total FROM documents WHERE doc_id % 100 <> 8 UNION ALL SELECT -1 - doc_id, 'new', 0, (SELECT count(*) FROM documents WHERE doc_id % 100 <> 8) FROM documents WHERE doc_id % 100 = 9")
def bucketed_changes(spark, d):
    """Documents as a table of snapshots: one in a hundred replaced, one deleted, one added; ``total`` is counted in the snapshot before the last change."""
    path = snapshots.scratch(spark, "buckets")
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    snapshots.create_table(docs, path, ["doc_id"])
    snapshots.change_table(path, docs.where("doc_id % 100 = 7").withColumn("n_chars", F.lit(-1).cast(docs.schema["n_chars"].dataType)), docs.where("doc_id % 100 = 8"))
    before = snapshots.read_table(spark, path)
    snapshots.change_table(path, docs.where("doc_id % 100 = 9").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new").alias("source"), F.lit(0).cast(docs.schema["n_chars"].dataType).alias("n_chars")))
    return snapshots.read_table(spark, path).crossJoin(F.broadcast(before.agg(F.count("*").alias("total"))))  # one row


@register("SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY source")
def serving_name(spark, d):
    """A name moved from one table to another, resolved by another session."""
    root, docs = snapshots.scratch(spark, "serving"), table(spark, d, "documents").select("doc_id", "source")
    for k in range(2):
        docs.where(F.col("doc_id") % 2 == k).write.parquet(f"{root}/table-{k}")
        index.point_alias(spark, root, "docs", f"{root}/table-{k}", expected=k)
    path = snapshots.resolve(spark.newSession(), root, "docs")["path"]
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


def _short(row):
    return row("n_chars") < 200


def _barred(row):
    return row("source").isin("src3", "src7")


@register(
    """WITH o AS (SELECT l.doc_id, quality = 1 AS s, quality = 1 AND l.doc_id % 3 <> 0 AS e, toxic = 1 AS b, coalesce(n_chars < 200, false) OR coalesce(source IN ('src3', 'src7'), false) AS v FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT doc_id, v AS vetoed, CASE WHEN NOT s AND e THEN 'INVALID' WHEN NOT s THEN 'unverified' WHEN e AND NOT (b OR v) THEN 'verified' ELSE 'weak' END AS status FROM o"""
)
def vetoed_statuses(spark, d):
    """Statuses of labelled documents where short texts and two sources are vetoed."""
    registry.register("veto", "short text", _short)
    registry.register("veto", "barred source", _barred)
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    veto = registry.vetoes(names=("short text", "barred source"))
    support, entailed = F.col("quality") == 1, (F.col("quality") == 1) & (F.col("doc_id") % 3 != 0)
    return labels.select("doc_id", veto.alias("vetoed"), claims.claim_status(support, entailed, F.col("toxic") == 1, veto).alias("status"))


@register(
    """WITH e AS (SELECT user_id, event_id % 500 AS s, event_id % 500 + user_id % 7 + 1 AS e FROM events), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM e),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, k"""
)
def sql_table_function(spark, d):
    """Intervals of each user merged by a table function that SQL calls with a partitioned, ordered table."""
    registry.for_sql(spark)
    table(spark, d, "events").selectExpr("user_id", "event_id % 500 AS s", "event_id % 500 + user_id % 7 + 1 AS e").createOrReplaceTempView("tessera_intervals")
    return spark.sql("SELECT * FROM tessera_merge_intervals(TABLE(tessera_intervals) PARTITION BY user_id ORDER BY (s, e), 'user_id')")


@register("SELECT event_type, round(mad(value), 6) AS spread FROM events GROUP BY event_type")
def sql_aggregate_function(spark, d):
    """The library's aggregate in the text of a query."""
    registry.for_sql(spark)
    table(spark, d, "events").createOrReplaceTempView("tessera_events")
    return spark.sql("SELECT event_type, round(tessera_spread(value), 6) AS spread FROM tessera_events GROUP BY event_type")


@register(
    """WITH n AS (SELECT count(*) AS n FROM conversations) SELECT * FROM (VALUES ('none', NULL), ('manifest', 'no_manifest'), ('config', 'bad_config'), ('rows', 'bad_count'), ('field', 'missing_field'), ('topology', 'broken_topology'), ('value', 'bad_fingerprint')) v(damage, code), n"""
)
def index_acceptance(spark, d):
    """An index over all turns, and the same damaged in one way each: the first code that the acceptance chain gives."""
    turn, conv = F.col("turn"), F.col("conv_id")
    name = lambda n: F.concat_ws(":", conv.cast("string"), n.cast("string"))
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    units = table(spark, d, "conversations").select(conv.alias("doc_id"), name(turn).alias("unit_id"), F.col("text").alias("retrieval_text"), F.when(turn > 0, name(turn - 1)).alias("previous_id"), F.when(turn < last, name(turn + 1)).alias("next_id"))
    lowest = units.agg(F.min("unit_id")).first()[0]
    hit = F.col("unit_id") == lowest
    damaged = {
        "none": units, "manifest": units, "config": units, "rows": units.where(~hit), "field": units.withColumn("retrieval_text", F.when(~hit, F.col("retrieval_text"))),
        "topology": units.withColumn("next_id", F.when(hit, F.lit("nowhere")).otherwise(F.col("next_id"))), "value": units.withColumn("retrieval_text", F.when(hit, F.concat("retrieval_text", F.lit("!"))).otherwise(F.col("retrieval_text"))),
    }
    home, n, found = snapshots.scratch(spark, "acceptance"), units.count(), []
    manifest = fingerprint(units, "unit_id").withColumn("counter", F.lit("words"))
    for damage, rows in damaged.items():
        rows.write.parquet(f"{home}/{damage}/units")
        if damage != "manifest":
            manifest.write.json(f"{home}/{damage}/manifest")
        held, code = index.accept_index(spark, f"{home}/{damage}", {"counter": "letters" if damage == "config" else "words"})
        found.append((damage, code, n if held is None else held.count()))
    return spark.createDataFrame(found, "damage string, code string, n long")


@register(None)
def vocabulary_windows(spark, d):
    """Windows of 400 tokens of a real vocabulary, 350 apart, with their places; tests hold them against the vocabulary's library."""
    import public_tokenizers

    places_ = vocabulary.token_places(public_tokenizers.path("word_bpe_49k.json"))
    counted = table(spark, d, "documents").select("doc_id", "text", places_(F.col("text")).alias("tokens"))
    return chunking.token_windows(counted)
