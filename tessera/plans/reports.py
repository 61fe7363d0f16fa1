"""Registered queries of the report and run-record operators.

A report row is a labelled document: its source is the run, doc_id mod 4 the
iteration and the kind of its source, doc_id mod 3 its specificity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources.tables import table
from .catalog import _VERDICT, _report, register

_R = f"""r AS (SELECT doc_id, source, lang, {_VERDICT} AS status, CASE WHEN doc_id % 3 = 0 THEN 'substantive' ELSE 'trivial' END AS specificity, (doc_id % 101) / 100.0 AS confidence,
  CASE doc_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'kb' WHEN 2 THEN 'none' ELSE 'unresolved' END AS source_kind, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'https://host/' || doc_id END AS source_url,
  doc_id % 4 AS iteration FROM labels JOIN documents USING (doc_id))"""


def _rows(spark, d):
    n = F.col("doc_id")
    out = _report(spark, d).withColumn("specificity", F.when(n % 3 == 0, "substantive").otherwise("trivial")).withColumn("confidence", (n % 101) / 100.0)
    out = out.withColumn("source_kind", F.element_at(F.array(*[F.lit(k) for k in reports.SOURCE_KINDS]), (n % 4 + 1).cast("int"))).withColumn("iteration", n % 4)
    return out.withColumn("source_url", F.when(n % 5 == 0, None).when(n % 5 == 1, "").otherwise(F.concat(F.lit("https://host/"), n.cast("string"))))


@register(
    f"""WITH {_R} SELECT source, count(*) FILTER (status = 'unverified' AND coalesce(source_url, '') = '') AS unverified_no_source, count(*) FILTER (status = 'unverified' AND coalesce(source_url, '') <> '') AS unverified_has_source,
  count(*) FILTER (status = 'weak') AS weak_count, round(coalesce(avg(confidence) FILTER (status = 'verified'), 0), 3) AS mean_confidence_verified, round(coalesce(avg(confidence) FILTER (status = 'unverified'), 0), 3) AS mean_confidence_unverified FROM r GROUP BY source"""
)
def grounding_breakdown(spark, d):
    return reports.grounding_breakdown(_rows(spark, d), ["source"])


@register(
    f"""WITH {_R} SELECT source, count(*) FILTER (specificity = 'substantive' AND status = 'verified') AS sv, count(*) FILTER (specificity = 'substantive') AS s, count(*) FILTER (status = 'verified') AS v, count(*) AS n,
  round(count(*) FILTER (status = 'verified') / count(*), 3) AS verified_fraction, round(count(*) FILTER (status = 'unverified') / count(*), 3) AS unverified_fraction FROM r GROUP BY source"""
)
def grounded_depth(spark, d):
    return reports.grounded_depth(_rows(spark, d), ["source"])


@register(f"WITH {_R} SELECT source, " + ", ".join(f"count(*) FILTER (source_kind = '{k}') AS n_{k}" for k in reports.SOURCE_KINDS) + " FROM r GROUP BY source")
def attribution_counts(spark, d):
    return reports.attribution_counts(_rows(spark, d), ["source"])


@register(f"WITH {_R} SELECT source, count(*) FILTER (status = 'verified') || ' verified, ' || count(*) FILTER (status = 'weak') || ' weak, ' || count(*) FILTER (status = 'unverified') || ' unverified out of ' || count(*) || ' total claims.' AS summary FROM r GROUP BY source")
def grounding_summary(spark, d):
    return reports.grounding_summary(_rows(spark, d), ["source"])


_ITERATIONS = f"""{_R}, it AS (SELECT source, iteration, count(*) FILTER (specificity = 'substantive' AND status = 'verified') AS sv, count(*) FILTER (status = 'unverified') AS u, count(*) AS n,
  round(count(*) FILTER (status = 'unverified') / count(*), 3) AS uvr FROM r GROUP BY ALL)"""


@register(f"WITH {_ITERATIONS} SELECT *, round(uvr - lag(uvr) OVER (PARTITION BY source ORDER BY iteration), 3) AS delta_uvr FROM it")
def iteration_deltas(spark, d):
    return reports.iteration_metrics(_rows(spark, d), "source", "iteration")


@register(
    f"""WITH {_ITERATIONS}, per AS (SELECT length(source) % 2 AS arm, source, arg_min(uvr, iteration) AS f, arg_max(uvr, iteration) AS l, arg_max(sv, iteration) AS sv FROM it GROUP BY ALL)
SELECT arm, count(*) AS runs, round(avg(f), 4) AS first_uvr, round(avg(l), 4) AS last_uvr, round(avg(sv), 4) AS mean_sv FROM per GROUP BY arm"""
)
def experiment_cells(spark, d):
    """Two arms by the length of the run's name, an invented split."""
    its = reports.iteration_metrics(_rows(spark, d), "source", "iteration").withColumn("arm", F.length("source") % 2)
    return reports.experiment_cells(its, ["arm"], "source", "iteration")


_LINES = """v AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS pr, CASE WHEN o_orderstatus = 'P' THEN 'parse_failed' WHEN o_orderpriority = '1-URGENT' THEN 'skipped' ELSE 'completed' END AS verification_status,
  count(*) FILTER (l_returnflag = 'N' AND l_quantity > 25) AS verified, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 25) AS weak, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS unverified,
  count(l_orderkey) AS n, count(*) FILTER (l_tax >= 0.08) AS taxed, count(*) FILTER (l_discount >= 0.1) AS reduced, count(*) FILTER (l_linestatus = 'F') AS done, o_orderstatus AS os FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _lines(spark, d):
    """Orders as runs, their large lines as claims: the return flag is the verdict."""
    claim = lambda flag: F.count_if((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 25))
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        claim("N").alias("verified"), claim("A").alias("weak"), claim("R").alias("unverified"), F.count("*").alias("n"),
        F.count_if(F.col("l_tax") >= 0.08).alias("taxed"), F.count_if(F.col("l_discount") >= 0.1).alias("reduced"), F.count_if(F.col("l_linestatus") == "F").alias("done"),
    )
    status = F.when(F.col("o_orderstatus") == "P", "parse_failed").when(F.col("o_orderpriority") == "1-URGENT", "skipped").otherwise("completed")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("os"), status.alias("verification_status"))
    return runs.join(per, "id", "left").fillna(0)


@register(
    f"""WITH {_LINES}, t AS (SELECT id AS run, verification_status AS status, verified + weak + unverified AS total, unverified, pr = '5-LOW' AS allow_zero FROM v)
SELECT run, CASE WHEN status <> 'completed' THEN 'verification_incomplete' WHEN total > 0 THEN 'scorable' WHEN allow_zero THEN 'allowed_zero_claims' ELSE 'unscorable_incomplete' END AS evaluation_status,
  CASE WHEN status = 'completed' AND total > 0 THEN unverified / total END AS uvr,
  CASE WHEN status <> 'completed' THEN 'verification_status=' || status WHEN total = 0 AND NOT allow_zero THEN 'zero verdicts without allow_zero_claims' END AS validation_error FROM t"""
)
def verification_outcome(spark, d):
    total = F.col("verified") + F.col("weak") + F.col("unverified")
    out = _lines(spark, d).select(F.col("id").alias("run"), reports.verification_outcome(F.col("verification_status"), total, F.col("unverified"), F.col("pr") == "5-LOW").alias("o"))
    return out.select("run", "o.*")


_RUNS = """runs AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 17 = 0 THEN 'telemetry mismatch' END AS validation_error, o_orderkey % 23 <> 0 AS has_telemetry,
  o_totalprice / 1000000 AS cost_usd, (o_orderkey % 100) / 100.0 AS grounding, 1 + o_orderkey % 10 AS reflection, o_custkey % 300 AS wall_time_s, o_orderkey % 4 AS html_errors, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 40) / 100.0 END AS uvr FROM orders)"""


def _runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"), F.when(k % 17 == 0, "telemetry mismatch").alias("validation_error"), (k % 23 != 0).alias("has_telemetry"),
        (F.col("o_totalprice") / 1000000).alias("cost_usd"), ((k % 100) / 100.0).alias("grounding"), (1 + k % 10).alias("reflection"), (F.col("o_custkey") % 300).alias("wall_time_s"), (k % 4).alias("html_errors"),
        F.when(k % 9 != 0, (k % 40) / 100.0).alias("uvr"),
    )


_OK = "status = 'success' AND validation_error IS NULL AND has_telemetry"


@register(
    f"""WITH {_RUNS}, g AS (SELECT *, {_OK} AS ok FROM runs)
SELECT count(*) AS total_runs, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND uvr IS NULL) AS unscorable, round(avg(cost_usd) FILTER (ok), 5) AS mean_cost_usd,
  round(avg(grounding) FILTER (ok), 3) AS mean_grounding, round(avg(reflection) FILTER (ok), 1) AS mean_reflection, round(avg(wall_time_s), 1) AS mean_wall_time_s, round(avg(html_errors) FILTER (ok), 1) AS mean_html_errors,
  round(avg(uvr) FILTER (ok), 3) AS mean_unverified_rate, count(*) FILTER (ok AND grounding < {reports.GROUNDING_FLOOR}) AS runs_below_grounding_floor FROM g"""
)
def benchmark_metrics(spark, d):
    """Orders as benchmark runs."""
    return reports.benchmark_metrics(_runs(spark, d))


@register(
    f"""WITH {_RUNS} SELECT id, printf('topic %02d: ', id) || coalesce(validation_error, 'CLI failed') AS failure FROM runs WHERE status <> 'success' OR validation_error IS NOT NULL
UNION ALL SELECT id, printf('topic %02d UVR %.2f > 0.15', id, uvr) FROM runs WHERE uvr > 0.15"""
)
def smoke_failures(spark, d):
    return reports.smoke_failures(_runs(spark, d))


@register(
    f"""WITH {_LINES}, t AS (SELECT id, CASE WHEN id % 19 = 0 THEN '' WHEN id % 7 = 0 THEN 'r' || (id - 1) ELSE 'r' || id END AS run_id, os = 'P' AS bad, CASE WHEN id % 17 = 0 THEN 'telemetry mismatch' END AS validation_error, id % 29 = 0 AS exits, id % 23 <> 0 AS has_telemetry,
  verification_status, verified, weak, unverified, verified + weak + unverified AS total, unverified / nullif(verified + weak + unverified, 0) AS rate FROM v), u AS (SELECT *, CASE WHEN id % 31 <> 0 THEN CASE WHEN id % 5 = 0 THEN floor(rate * 10) / 10 ELSE rate END END AS uvr FROM t),
f AS (SELECT id, CASE WHEN exits THEN 'subprocess exit code 2' WHEN bad OR validation_error IS NOT NULL THEN coalesce(validation_error, 'CLI failed') WHEN NOT has_telemetry THEN 'telemetry unavailable'
  WHEN total = 0 THEN 'unscorable zero-verdict telemetry claim total' WHEN verification_status <> 'completed' THEN 'verification_status=' || verification_status WHEN uvr IS NULL THEN 'UVR out of range'
  WHEN uvr > 0.15 THEN printf('UVR %.2f > 0.15', round(uvr, 2)) WHEN uvr <> rate THEN 'UVR contradicts claim counts' END AS f FROM u)
SELECT id, printf('topic %02d: ', id) || f AS failure FROM f WHERE f IS NOT NULL
UNION ALL SELECT id, CASE WHEN run_id = '' THEN 'run ID missing' ELSE 'run ID repeated' END FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS c FROM t) WHERE run_id = '' OR c > 1"""
)
def release_failures(spark, d):
    k, rate = F.col("id"), F.col("unverified") / F.nullif(F.col("verified") + F.col("weak") + F.col("unverified"), F.lit(0))
    runs = _lines(spark, d).select(
        "id", F.when(k % 19 == 0, "").when(k % 7 == 0, F.concat(F.lit("r"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("run_id"),
        F.when(F.col("os") == "P", "failed").otherwise("success").alias("status"), F.when(k % 17 == 0, "telemetry mismatch").alias("validation_error"), F.when(k % 29 == 0, 2).otherwise(0).alias("exit_code"), (k % 23 != 0).alias("has_telemetry"),
        "verification_status", "verified", "weak", "unverified", F.when(k % 31 != 0, F.when(k % 5 == 0, F.floor(rate * 10) / 10).otherwise(rate)).alias("uvr"),
    )
    return reports.release_failures(runs)


@register(
    f"""WITH {_LINES} SELECT id AS run, CASE WHEN cust % 13 = 0 OR n > 3 AND done = 0 THEN 'missing_fields' WHEN id % 41 = 0 OR n - 2 * reduced < 0 THEN 'web_sources_count_invalid' WHEN n = 0 THEN CASE WHEN pr = '2-HIGH' THEN 'chunk_index_missing' END
  WHEN weak > 1 THEN 'attribution_does_not_sum' WHEN taxed > 0 THEN 'source_kind_missing' WHEN pr = '2-HIGH' THEN 'chunk_index_missing' END AS error FROM v"""
)
def telemetry_errors(spark, d):
    """Records of orders: lines as report rows; one is lost from the attribution where several are weak."""
    t, c = _lines(spark, d), F.col
    missing = F.array_compact(F.array(F.when(c("cust") % 13 == 0, "attribution"), F.when((c("n") > 3) & (c("done") == 0), "status")))
    web = F.when(c("id") % 41 != 0, c("n") - 2 * c("reduced"))
    return t.select(c("id").alias("run"), reports.telemetry_error(missing, web, c("n") - (c("weak") > 1).cast("long"), c("n"), c("taxed"), (c("pr") == "2-HIGH").cast("long")).alias("error"))


@register(
    """WITH q AS (SELECT o_orderkey AS k, 'run-' || o_orderkey AS run_id, o_orderpriority AS topic FROM orders), h AS (SELECT run_id AS file_id, CASE WHEN k % 11 = 0 THEN 'run-' || (k + 1) ELSE run_id END AS run_id, CASE WHEN k % 13 = 0 THEN '2-HIGH' ELSE topic END AS topic FROM q WHERE k % 7 <> 0)
SELECT q.run_id, q.topic, CASE WHEN h.file_id IS NULL THEN 'telemetry_missing' WHEN h.run_id <> q.run_id THEN 'run_id_mismatch' WHEN h.topic <> q.topic THEN 'topic_mismatch' ELSE 'ok' END AS result FROM q LEFT JOIN h ON h.file_id = q.run_id"""
)
def telemetry_exact_read(spark, d):
    """Orders as requests; some files are not there or hold another run or topic."""
    k, name = F.col("o_orderkey"), lambda k: F.concat(F.lit("run-"), k.cast("string"))
    orders = table(spark, d, "orders")
    held = orders.where(k % 7 != 0).select(name(k).alias("file_id"), F.when(k % 11 == 0, name(k + 1)).otherwise(name(k)).alias("run_id"), F.when(k % 13 == 0, "2-HIGH").otherwise(F.col("o_orderpriority")).alias("topic"))
    return reports.exact_record(orders.select(name(k).alias("run_id"), F.col("o_orderpriority").alias("topic")), held)


_TOPICS = "tp AS (SELECT doc_id AS place, nullif(doc_id % 90 - 1, 7) AS id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE lang || doc_id % 200 END AS topic, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source || '-' || doc_id % 77 END AS slug FROM documents)"


def _topics(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("place"), F.nullif(n % 90 - 1, F.lit(7)).alias("id"), F.when(n % 13 == 0, " ").otherwise(F.concat("lang", (n % 200).cast("string"))).alias("topic"),
        F.when(n % 29 != 0, F.concat("source", F.lit("-"), (n % 77).cast("string"))).alias("slug"),
    )


@register(
    f"""WITH {_TOPICS}, s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS ri, row_number() OVER (PARTITION BY topic ORDER BY place) AS rt, row_number() OVER (PARTITION BY slug ORDER BY place) AS rs FROM tp)
SELECT place, CASE WHEN coalesce(id, 0) <= 0 THEN 'id must be a positive integer' ELSE 'duplicate id' END AS failure FROM s WHERE coalesce(id, 0) <= 0 OR ri > 1
UNION ALL SELECT place, CASE WHEN trim(topic) = '' THEN 'topic must be nonempty' ELSE 'duplicate topic' END FROM s WHERE trim(topic) = '' OR rt > 1
UNION ALL SELECT place, CASE WHEN slug IS NULL THEN 'slug must be nonempty' ELSE 'duplicate slug' END FROM s WHERE slug IS NULL OR rs > 1"""
)
def manifest_errors(spark, d):
    return reports.manifest_errors(_topics(spark, d))


@register(f"WITH {_TOPICS}, want AS (SELECT place, (place % 90) - 1 + (place % 40 = 0)::INT AS id FROM tp WHERE place % 50 <> 3) SELECT coalesce(tp.place, want.place) AS place, tp.id AS got, want.id AS want FROM tp FULL JOIN want ON tp.place = want.place WHERE tp.id IS DISTINCT FROM want.id")
def manifest_order(spark, d):
    topics = _topics(spark, d)
    want = topics.where("place % 50 <> 3").select("place", ((F.col("place") % 90) - 1 + (F.col("place") % 40 == 0).cast("int")).alias("id"))
    return reports.manifest_order(topics, want)


@register(f"WITH {_TOPICS} SELECT * FROM (SELECT place, id, topic, slug, 'limit' AS way FROM tp ORDER BY place LIMIT 5) UNION ALL SELECT place, id, topic, slug, 'id' FROM tp WHERE id = 11")
def smoke_topics(spark, d):
    """The limit is the feature: the first topics of the manifest."""
    topics = _topics(spark, d)
    return reports.smoke_topics(topics, limit=5).withColumn("way", F.lit("limit")).unionByName(reports.smoke_topics(topics, topic_id=11).withColumn("way", F.lit("id")))


@register(
    """WITH s AS (SELECT event_id, user_id, sum(value / 1000) OVER w AS spent, coalesce(sum(value / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, round(spent, 6) AS spent, round(spent, 9) >= 0.1 AND round(before, 9) < 0.1 AS stops, round(before, 9) < 0.1 AS runs FROM s"""
)
def cost_gate_steps(spark, d):
    """The step at which a run's summed cost reaches 0.10."""
    steps = table(spark, d, "events").withColumn("cost", (F.col("value") / 1000).cast("decimal(18,9)"))
    return reports.cost_gate(steps, "user_id", ["ts", "event_id"], "cost", 0.1).select("event_id", F.round(F.col("spent").cast("double"), 6).alias("spent"), "stops", "runs")


@register(
    """WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, arg_max(props, (ts, event_id)) AS props, sum(value::DECIMAL(18, 2))::DOUBLE AS v, count(*) AS n, max(event_id) AS top FROM events GROUP BY user_id)
SELECT user_id AS run_id, CASE last WHEN 'error' THEN 'execution_failed' WHEN 'purchase' THEN 'published' ELSE 'running' END AS state, CASE WHEN top % 3 = 0 THEN '' ELSE props END AS message, CASE WHEN top % 4 = 0 THEN 0 ELSE n END AS total_tokens, round(CASE WHEN top % 5 = 0 THEN 0 ELSE v / 1000 END, 5) AS cost_usd FROM e"""
)
def run_headlines(spark, d):
    """Users as runs: the last event is the state, its properties the message."""
    at = F.struct("ts", "event_id")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("event_type", at).alias("last"), F.max_by("props", at).alias("props"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"), F.count("*").alias("n"), F.max("event_id").alias("top"))
    top = F.col("top")
    status = F.when(F.col("last") == "error", "execution_failed").when(F.col("last") == "purchase", "published")
    runs = e.select("run_id", status.alias("terminal_status"), F.when(top % 3 == 0, "  ").otherwise(F.col("props")).alias("message"), F.when(top % 4 != 0, F.col("n")).alias("total_tokens"), F.when(top % 5 != 0, F.col("v") / 1000).alias("cost_usd"))
    return reports.headline(runs)


@register(
    f"""WITH {_LINES}, s AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'other run' WHEN n = 0 AND verification_status = 'parse_failed' AND cust % 3 = 0 THEN 'ambiguous' WHEN verification_status = 'parse_failed' THEN 'unread' WHEN verification_status <> 'completed' THEN 'skipped' WHEN taxed > 1 OR reduced > 2 THEN 'stale' WHEN pr = '4-NOT SPECIFIED' THEN 'blocked'
  WHEN weak > 2 THEN 'citations' WHEN unverified > 2 THEN 'semantic' WHEN pr IN ('2-HIGH', '3-MEDIUM') THEN 'material' ELSE 'none' END AS rule FROM v)
SELECT id AS run_id, CASE WHEN rule IN ('blocked', 'citations', 'material') THEN 'policy_blocked' WHEN rule = 'semantic' THEN 'terminal_quality_exhausted' ELSE 'execution_failed' END AS outcome, rule IN ('unread', 'semantic', 'material') AS repairable FROM s"""
)
def terminal_outcomes(spark, d):
    """Orders as runs: a failed inventory is a failed order without lines, an old one has two taxed lines; the priority is the state of the material claims."""
    t, c = _lines(spark, d), F.col
    state = F.when(c("pr") == "1-URGENT", "pass").when(c("pr") == "2-HIGH", "repairable").when(c("pr") == "3-MEDIUM", "exhausted").when(c("pr") == "4-NOT SPECIFIED", "unknown_materiality").otherwise("no_inventory")
    failed = (c("verification_status") == "parse_failed") & (c("n") == 0)
    return reports.terminal_outcome(t.select(
        c("id").alias("run_id"), (c("id") % 17 != 0).alias("identity_matches"), (c("cust") % 3 == 0).alias("ambiguous_anchor"), F.when(failed, "inventory_failed").otherwise(c("verification_status")).alias("verification_status"),
        (c("taxed") <= 1).alias("inventory_current"), (c("reduced") <= 2).alias("anchors_ok"), state.alias("material_state"), (c("weak") <= 2).alias("citations_ok"), (c("unverified") <= 2).alias("semantic_ok"),
    ))


LIMITS = {"drafts": 2, "content_feedbacks": 2, "layout_revisions": 2}


@register("WITH c AS (SELECT user_id AS run_id, count(*) FILTER (event_type = 'error') % 4 AS drafts, count(*) FILTER (event_type = 'click') % 4 AS content_feedbacks, count(*) FILTER (event_type = 'view') % 4 AS layout_revisions FROM events GROUP BY user_id) " + " UNION ALL ".join(f"SELECT run_id, '{k}' AS kind, {k} AS used, {n} AS \"limit\", {k} < {n} AS allowed FROM c" for k, n in LIMITS.items()))
def attempt_limits(spark, d):
    n = lambda kind: (F.count_if(F.col("event_type") == kind) % 4)
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(n("error").alias("drafts"), n("click").alias("content_feedbacks"), n("view").alias("layout_revisions"))
    return reports.attempts_left(runs, LIMITS)


_TRACE = """t AS (SELECT user_id AS run_id, row_number() OVER w - 1 + (row_number() OVER w > 5 AND user_id % 3 = 0)::INT AS iteration, event_type || event_id AS payload, sha256(event_type || event_id) AS digest0, event_id, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT run_id, iteration, payload, CASE WHEN event_id % 11 = 0 THEN sha256(payload || 'x') ELSE digest0 END AS digest, event_id FROM t), v AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN lag(digest) OVER (PARTITION BY run_id ORDER BY iteration) END AS previous FROM u)"""


@register(
    f"""WITH {_TRACE}, w AS (SELECT *, iteration - coalesce(lag(iteration) OVER o, -1) AS gap, lag(digest) OVER o AS before FROM v WINDOW o AS (PARTITION BY run_id ORDER BY iteration, digest))
SELECT run_id, iteration, 'iteration_gap' AS error FROM w WHERE gap > 1 UNION ALL SELECT run_id, iteration, 'iteration_repeated' FROM w WHERE gap = 0
UNION ALL SELECT run_id, iteration, 'digest_mismatch' FROM w WHERE sha256(payload) <> digest UNION ALL SELECT run_id, iteration, 'link_mismatch' FROM w WHERE previous IS DISTINCT FROM before"""
)
def trace_errors(spark, d):
    """Events as trace entries, some with a wrong digest, a gap or a lost link."""
    from pyspark.sql import Window

    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nth = F.row_number().over(at)
    t = table(spark, d, "events").withColumn("iteration", nth - 1 + ((nth > 5) & (F.col("user_id") % 3 == 0)).cast("int"))
    t = t.select(F.col("user_id").alias("run_id"), "iteration", F.concat("event_type", F.col("event_id").cast("string")).alias("payload"), "event_id")
    t = t.withColumn("digest", F.sha2(F.when(F.col("event_id") % 11 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")), 256))
    t = t.withColumn("previous", F.when(F.col("event_id") % 13 != 0, F.lag("digest").over(Window.partitionBy("run_id").orderBy("iteration"))))
    return reports.trace_errors(t)
