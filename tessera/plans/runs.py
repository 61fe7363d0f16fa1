"""Registered queries of binding, adjudication and policies over the supplied documents: a document is a run, its lines are claims where they stand, labels weigh on the verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import running_sum
from ..operators import binding, policy
from ..sources import snapshots
from ..sources.tables import table
from .catalog import register

_CLAIMS = r"""k AS (SELECT d.doc_id, text, coalesce(quality, 0) + 2 * coalesce(toxic, 0) AS w FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE text IS NOT NULL),
l AS (SELECT doc_id AS run_id, w, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM k),
c AS (SELECT *, ordinal::VARCHAR AS claim_id, length(line) + w AS v, (sum(length(line) + 1) OVER (PARTITION BY run_id ORDER BY ordinal) - length(line) - 1)::BIGINT AS s, CASE length(line) % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'unknown' ELSE 'true' END AS material,
  CASE WHEN length(line) % 3 = 0 THEN 'opinion' ELSE 'factual' END AS claim_type, CASE WHEN length(line) < 40 THEN 'ANCHOR_FAILED' ELSE 'bound' END AS validity FROM l),
r AS (SELECT run_id, claim_id, CASE v % 4 WHEN 0 THEN 'weak' WHEN 1 THEN 'unverified' ELSE 'verified' END AS status, CASE (run_id + ordinal) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'invalid' ELSE 'VALID' END AS valid, (run_id + 2 * ordinal) % 9 = 0 AS blocked FROM c WHERE (run_id + ordinal) % 13 <> 0)"""


def _placed_lines(text):
    """(line, s) of every line of a text."""
    parts = F.split(text, "\n")
    ends = running_sum(F.transform(parts, lambda x: F.length(x) + 1))
    return F.zip_with(ends, parts, lambda e, x: F.struct(x.alias("line"), (e - F.length(x) - 1).alias("s")))


def _claims(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").join(labels, "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("run_id"), "text", (F.coalesce("quality", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("w"), F.posexplode(_placed_lines("text")).alias("ordinal", "p"))
    n = F.length("p.line")
    return rows.select(
        "run_id", "text", "ordinal", F.col("ordinal").cast("string").alias("claim_id"), F.col("p.line").alias("line"), F.col("p.s").alias("s"), (n + F.col("w")).alias("v"),
        F.when(n % 5 == 0, "false").when(n % 5 == 1, "unknown").otherwise("true").alias("material"), F.when(n % 3 == 0, "opinion").otherwise("factual").alias("claim_type"), F.when(n < 40, "ANCHOR_FAILED").otherwise("bound").alias("validity"),
    )


def _report(claims):
    v, place = F.col("v") % 4, (F.col("run_id") + F.col("ordinal")) % 5
    return claims.where((F.col("run_id") + F.col("ordinal")) % 13 != 0).select(
        "run_id", "claim_id", F.when(v == 0, "weak").when(v == 1, "unverified").otherwise("verified").alias("status"), F.when(place == 1, "invalid").when(place != 0, "VALID").alias("validity"),
        ((F.col("run_id") + 2 * F.col("ordinal")) % 9 == 0).alias("blocked"),
    )


# ---------------------------------------------------------------- material policy


@register(
    f"""WITH {_CLAIMS}, x AS (SELECT c.run_id, bool_or(validity <> 'bound') AS open, bool_or(r.run_id IS NULL) AS off FROM c LEFT JOIN r ON r.run_id = c.run_id AND r.claim_id = c.claim_id GROUP BY c.run_id)
SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'missing_inventory' WHEN run_id % 7 = 0 THEN 'stale_inventory_draft_sha' WHEN open THEN 'unresolved_anchor' WHEN off THEN 'grounding_roster_mismatch' END AS reason FROM x"""
)
def integrity_failures(spark, d):
    claims = _claims(spark, d)
    docs = table(spark, d, "documents").where("text is not null")
    run = F.col("doc_id")
    runs = docs.select(run.alias("run_id"), (run % 11 != 0).alias("has_inventory"), F.when(run % 7 == 0, "0").otherwise(F.sha2("text", 256)).alias("inventory_sha"), F.col("text").alias("draft"))
    return policy.integrity_failure(runs, claims, _report(claims))


_RESOLVED = """m AS (SELECT c.run_id, c.claim_id, CASE WHEN r.run_id IS NULL THEN 'missing_semantic_disposition' WHEN upper(coalesce(valid, 'VALID')) <> 'VALID' THEN 'invalid_analysis_validity' WHEN status <> 'verified' THEN 'semantic_status_' || status
  WHEN blocked THEN 'unresolved_applicable_blocker' ELSE 'resolved' END AS resolution FROM c LEFT JOIN r ON r.run_id = c.run_id AND r.claim_id = c.claim_id WHERE material = 'true')"""


@register(f"WITH {_CLAIMS}, {_RESOLVED} SELECT * FROM m")
def material_resolution(spark, d):
    claims = _claims(spark, d)
    return policy.material_resolution(claims, _report(claims))


_OUTCOMES = f"""{_CLAIMS}, {_RESOLVED},
q AS (SELECT doc_id AS run_id, j AS n, 'q' || j AS req_id, CASE (doc_id + j) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS structural FROM k, (VALUES (0), (1), (2)) v(j)),
ln AS (SELECT c.run_id, 'q' || (ordinal % 4) AS req_id, material, resolution FROM c LEFT JOIN m ON m.run_id = c.run_id AND m.claim_id = c.claim_id WHERE ordinal % 5 <> 4 AND (c.run_id + ordinal) % 3 = 0),
a AS (SELECT run_id, req_id, count(*) AS n, count(*) FILTER (material = 'unknown') AS unknown, count(*) FILTER (material = 'true' AND resolution <> 'resolved') AS open FROM ln GROUP BY ALL),
oc AS (SELECT q.run_id, q.req_id, CASE WHEN structural THEN 'SATISFIED' WHEN a.n IS NULL THEN 'MISSING' WHEN unknown > 0 THEN 'UNKNOWN' WHEN open > 0 THEN 'UNRESOLVED' WHEN structural IS NOT NULL THEN 'MISSING' ELSE 'UNKNOWN' END AS state,
  CASE WHEN structural THEN 'structural_check_passed' WHEN a.n IS NULL AND structural IS NULL THEN 'no_linked_current_claims' WHEN a.n IS NULL THEN 'structural_check_failed' WHEN unknown > 0 THEN 'linked_unknown_materiality_claim' WHEN open > 0 THEN 'supported_by_unresolved_material_claim'
  WHEN structural IS NOT NULL THEN 'structural_check_failed' ELSE 'semantic_coverage_unqualified' END AS reason FROM q LEFT JOIN a ON a.run_id = q.run_id AND a.req_id = q.req_id)"""


def _outcomes(claims, runs):
    numbered = runs.select("run_id", F.explode(F.array(*map(F.lit, range(3)))).alias("j"))
    check = (F.col("run_id") + F.col("j")) % 3
    requirements = numbered.select("run_id", F.concat(F.lit("q"), F.col("j").cast("string")).alias("req_id"), F.when(check == 0, True).when(check == 1, False).alias("structural"))
    links = claims.where((F.col("ordinal") % 5 != 4) & ((F.col("run_id") + F.col("ordinal")) % 3 == 0)).select("run_id", "claim_id", F.concat(F.lit("q"), (F.col("ordinal") % 4).cast("string")).alias("req_id"))
    return policy.requirement_outcomes(requirements, links, claims, policy.material_resolution(claims, _report(claims)))


def _runs(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("run_id"), (F.col("doc_id") % 4).cast("int").alias("iterations"))


@register(f"WITH {_OUTCOMES} SELECT * FROM oc")
def requirement_outcomes(spark, d):
    return _outcomes(_claims(spark, d), _runs(spark, d))


@register(
    f"""WITH {_OUTCOMES}, cc AS (SELECT run_id, count(*) FILTER (material = 'unknown') AS um, count(*) FILTER (claim_type = 'factual') AS factual FROM c GROUP BY run_id),
mm AS (SELECT run_id, count(*) AS material, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution <> 'resolved') AS unresolved, count(*) FILTER (resolution = 'invalid_analysis_validity') AS invalid FROM m GROUP BY run_id),
qq AS (SELECT run_id, count(*) FILTER (state = 'UNKNOWN') AS qu, count(*) FILTER (state = 'MISSING') AS qm, count(*) FILTER (state = 'UNRESOLVED') AS qr FROM oc GROUP BY run_id),
j AS (SELECT cc.*, coalesce(material, 0) AS material, coalesce(resolved, 0) AS resolved, coalesce(unresolved, 0) AS unresolved, coalesce(invalid, 0) AS invalid, qu, qm, qr, cc.run_id % 4 AS iterations FROM cc LEFT JOIN mm USING (run_id) LEFT JOIN qq USING (run_id)),
s AS (SELECT *, list_filter([CASE WHEN um > 0 THEN 'unknown_materiality' END, CASE WHEN qu > 0 THEN 'unknown_mandatory_requirement' END, CASE WHEN invalid > 0 THEN 'invalid_material_claim' END, CASE WHEN unresolved > 0 THEN 'unresolved_material_claim' END,
  CASE WHEN qm > 0 THEN 'missing_mandatory_requirement' END, CASE WHEN qr > 0 THEN 'unresolved_mandatory_requirement' END], lambda x: x IS NOT NULL) AS rs FROM j),
z AS (SELECT *, CASE WHEN len(rs) = 0 THEN 'pass' WHEN um + qu + invalid > 0 THEN 'unknown_materiality' WHEN iterations >= 2 THEN 'exhausted' ELSE 'repairable' END AS state FROM s)
SELECT run_id, round(resolved / nullif(material, 0), 6) AS verified_rate, factual, material, resolved, unresolved, array_to_string(rs, ',') AS reason_codes, state, CASE state WHEN 'pass' THEN 'pass' WHEN 'repairable' THEN 'revision' ELSE 'hitl' END AS decision FROM z"""
)
def material_results(spark, d):
    claims, runs = _claims(spark, d), _runs(spark, d)
    return policy.material_result(runs, claims, policy.material_resolution(claims, _report(claims)), _outcomes(claims, runs))


# ---------------------------------------------------------------- citation policy


def _kept(df, name):
    """``df`` written to the shared folder and read again."""
    path = snapshots.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lines as anchors; in some runs a part of a line inside it, or one that crosses into the next line.
_GROUPS = rf"""{_CLAIMS},
oc AS (SELECT run_id, ordinal, claim_id, claim_id AS base, material, s, s + length(line) AS e FROM c WHERE length(line) > 0 UNION ALL SELECT run_id, ordinal + 1000000, 'n' || claim_id, claim_id, material, s + 5, s + 20 FROM c WHERE length(line) >= 40 AND run_id % 3 = 0 AND ordinal % 4 = 1
  UNION ALL SELECT run_id, ordinal + 2000000, 'x' || claim_id, claim_id, material, s + 10, s + length(line) + 5 FROM c WHERE length(line) >= 40 AND run_id % 10 = 1 AND ordinal = 2),
ok AS (SELECT oc.* FROM oc JOIN r ON r.run_id = oc.run_id AND r.claim_id = oc.base WHERE material = 'true' AND status = 'verified' AND upper(coalesce(valid, 'VALID')) = 'VALID'),
ev AS (SELECT run_id, claim_id, 0 AS place, 'E' || (ordinal % 3 + 1) AS evidence_id FROM oc UNION ALL SELECT run_id, claim_id, 1, 'WEB-00' || (ordinal % 4 + 1) FROM oc WHERE ordinal % 2 = 0),
fl AS (SELECT ok.run_id, s, e, ordinal, ok.claim_id, place, evidence_id FROM ok JOIN ev ON ev.run_id = ok.run_id AND ev.claim_id = ok.claim_id),
ff AS (SELECT run_id, s, e, evidence_id, min(ordinal * 10 + place) AS o FROM fl GROUP BY ALL), rq AS (SELECT run_id, s, e, list(evidence_id ORDER BY o) AS required FROM ff GROUP BY ALL),
g AS (SELECT rq.*, ids FROM rq JOIN (SELECT run_id, s, e, list(claim_id ORDER BY ordinal) AS ids FROM ok GROUP BY ALL) USING (run_id, s, e))"""


def _anchors(claims):
    n, run, i = F.length("line"), F.col("run_id"), F.col("ordinal")
    keep = ["run_id", "ordinal", "claim_id", "base", "material", "occurrences"]
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    base = claims.withColumn("base", F.col("claim_id"))
    lines = base.where(n > 0).withColumn("occurrences", span(F.col("s"), F.col("s") + n))
    inner = base.where((n >= 40) & (run % 3 == 0) & (i % 4 == 1)).withColumn("ordinal", i + 1000000).withColumn("claim_id", F.concat(F.lit("n"), "claim_id")).withColumn("occurrences", span(F.col("s") + 5, F.col("s") + 20))
    across = base.where((n >= 40) & (run % 10 == 1) & (i == 2)).withColumn("ordinal", i + 2000000).withColumn("claim_id", F.concat(F.lit("x"), "claim_id")).withColumn("occurrences", span(F.col("s") + 10, F.col("s") + n + 5))
    return lines.select(*keep).union(inner.select(*keep)).union(across.select(*keep))


def _support(anchors):
    i = F.col("ordinal")
    one = anchors.select("run_id", "claim_id", F.lit(0).alias("place"), F.concat(F.lit("E"), (i % 3 + 1).cast("string")).alias("evidence_id"))
    return one.union(anchors.where(i % 2 == 0).select("run_id", "claim_id", F.lit(1), F.concat(F.lit("WEB-00"), (i % 4 + 1).cast("string"))))


def _groups(spark, d):
    claims = _claims(spark, d)
    anchors = _anchors(claims)
    report = _report(claims).withColumnRenamed("claim_id", "base").join(anchors.select("run_id", "base", "claim_id"), ["run_id", "base"])
    return policy.applicable_groups(anchors, report, _support(anchors)), anchors


@register(f"""WITH {_GROUPS} SELECT run_id, s AS start, e AS "end", array_to_string(ids, ',') AS claim_ids, array_to_string(required, ',') AS required FROM g""")
def citation_groups(spark, d):
    return _groups(spark, d)[0].withColumn("claim_ids", F.array_join("claim_ids", ",")).withColumn("required", F.array_join("required", ","))


_REGISTRY = f"""{_GROUPS}, rg AS (SELECT run_id, evidence_id, min_by(kind, n) AS kind FROM (SELECT doc_id AS run_id, e AS evidence_id, 'given' AS kind, 0 AS n FROM k, (VALUES ('E1'), ('WEB-002')) v(e) WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 'WEB-00' || p, 'web', 1 FROM k, range(1, 9) t(p) WHERE p <= doc_id % 8 AND p <= 5 UNION ALL SELECT doc_id, 'KB-00' || p, 'kb', 2 FROM k, range(1, 9) t(p) WHERE p <= doc_id % 3 UNION ALL SELECT run_id, evidence_id, 'unknown', 3 FROM ev WHERE run_id % 2 = 0) GROUP BY ALL)"""


def _registry(spark, d, anchors):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("run_id"))
    given = docs.where("run_id % 5 <> 0").select("run_id", F.explode(F.array(F.lit("E1"), F.lit("WEB-002"))).alias("evidence_id"), F.lit("given").alias("kind"))
    places = lambda n: docs.where(n > 0).select("run_id", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("place"))
    return policy.evidence_registry(given, places(F.col("run_id") % 8), places(F.col("run_id") % 3), _support(anchors).where("run_id % 2 = 0"))


@register(f"WITH {_REGISTRY} SELECT * FROM rg")
def evidence_registry(spark, d):
    return _registry(spark, d, _anchors(_claims(spark, d)))


@register(
    f"""WITH {_REGISTRY},
ci AS (SELECT run_id, s + length(line) AS place, 'E' || (ordinal % 3 + 1) AS evidence_id FROM c WHERE ordinal % 3 = 0 UNION ALL SELECT run_id, s + length(line), 'KB-007' FROM c WHERE ordinal % 7 = 3 UNION ALL SELECT run_id, 10000000 + ordinal, 'E' || (ordinal % 3 + 1) FROM c WHERE ordinal % 5 = 4 UNION ALL SELECT run_id, 20000000, 'E99' FROM c WHERE run_id % 6 = 0 AND ordinal = 0),
pr AS (SELECT a.run_id, a.s, b.s AS s2, b.e AS e2, a.s < b.s AND b.e < a.e AS inside FROM g a JOIN g b ON a.run_id = b.run_id AND (a.s < b.s OR (a.s = b.s AND a.e < b.e)) AND a.s < b.e AND b.s < a.e),
cr AS (SELECT DISTINCT run_id FROM pr WHERE NOT inside), ne AS (SELECT DISTINCT pr.run_id FROM pr JOIN ci ON ci.run_id = pr.run_id AND place BETWEEN s2 AND e2 + 1 WHERE inside AND pr.run_id NOT IN (SELECT run_id FROM cr)),
why AS (SELECT run_id, 'overlapping_nonidentical_anchors' AS why FROM cr UNION ALL SELECT run_id, 'ambiguous_nested_model_citation' FROM ne),
pl AS (SELECT ci.run_id, place, evidence_id, min(s * 100000000 + e) AS o FROM ci JOIN g ON g.run_id = ci.run_id AND place BETWEEN s AND e + 1 GROUP BY ALL),
lo AS (SELECT ci.* FROM ci ANTI JOIN pl ON pl.run_id = ci.run_id AND pl.place = ci.place AND pl.evidence_id = ci.evidence_id),
mo AS (SELECT run_id, o // 100000000 AS s, o % 100000000 AS e, list(DISTINCT evidence_id) AS model FROM pl GROUP BY ALL),
ov AS (SELECT run_id, s, s + length(line) AS e, 'E' || (ordinal % 3 + 1) AS x FROM c WHERE run_id % 8 = 3 AND ordinal % 2 = 0 AND length(line) > 0), la AS (SELECT DISTINCT run_id FROM ov),
rd AS (SELECT g.*, list_distinct(list_concat(CASE WHEN la.run_id IS NULL THEN required WHEN ov.x IS NULL THEN [] ELSE [ov.x] END, coalesce(model, []))) AS rendered FROM g LEFT JOIN la ON la.run_id = g.run_id LEFT JOIN ov ON ov.run_id = g.run_id AND ov.s = g.s AND ov.e = g.e LEFT JOIN mo ON mo.run_id = g.run_id AND mo.s = g.s AND mo.e = g.e),
f AS (SELECT *, list_filter(required, lambda x: NOT list_contains(rendered, x)) AS missing, list_filter(rendered, lambda x: NOT list_contains(required, x)) AS extra FROM rd),
p AS (SELECT run_id, count(*) AS n_groups, sum(CASE WHEN len(required) = 0 THEN 1 ELSE len(missing) END) AS missing, sum(len(extra)) AS extra, count(*) FILTER (len(required) > 0 AND len(rendered) = 0) AS misplaced, sum(len(required)) AS slots, sum(len(required) - len(missing)) AS covered FROM f GROUP BY run_id),
rqa AS (SELECT DISTINCT run_id, unnest(required) AS x FROM f), msa AS (SELECT DISTINCT run_id, unnest(missing) AS x FROM f),
st AS (SELECT lo.run_id, count(*) FILTER (rqa.x IS NULL) AS se, count(*) FILTER (msa.x IS NOT NULL) AS sm FROM lo LEFT JOIN rqa ON rqa.run_id = lo.run_id AND rqa.x = evidence_id LEFT JOIN msa ON msa.run_id = lo.run_id AND msa.x = evidence_id GROUP BY lo.run_id),
sh AS (SELECT run_id, unnest(rendered) AS x FROM f UNION SELECT run_id, evidence_id FROM lo), dg AS (SELECT sh.run_id, count(*) AS dangling FROM sh ANTI JOIN rg ON rg.run_id = sh.run_id AND rg.evidence_id = sh.x GROUP BY sh.run_id),
t AS (SELECT k.doc_id AS run_id, coalesce(n_groups, 0) AS n_groups, coalesce(missing, 0) AS missing, coalesce(extra, 0) + coalesce(se, 0) AS extra, coalesce(misplaced, 0) + coalesce(sm, 0) AS misplaced, coalesce(dangling, 0) AS dangling, coalesce(covered, 0) AS covered, coalesce(slots, 0) AS slots, why
  FROM k LEFT JOIN p ON p.run_id = doc_id LEFT JOIN st ON st.run_id = doc_id LEFT JOIN dg ON dg.run_id = doc_id LEFT JOIN why ON why.run_id = doc_id)
SELECT run_id, n_groups, CASE WHEN why IS NULL THEN missing ELSE 0 END AS missing, CASE WHEN why IS NULL THEN extra ELSE 0 END AS extra, CASE WHEN why IS NULL THEN misplaced ELSE 1 END AS misplaced, CASE WHEN why IS NULL THEN dangling ELSE 0 END AS dangling,
  CASE WHEN why IS NULL THEN round(covered / nullif(slots, 0), 6) END AS coverage, CASE WHEN why IS NOT NULL THEN 'placement_integrity_failure' WHEN missing + extra + misplaced + dangling = 0 THEN 'citation_policy_pass' ELSE 'citation_hitl_required' END AS state,
  coalesce(why, array_to_string(list_filter([CASE WHEN missing > 0 THEN 'missing_required_citation' END, CASE WHEN extra > 0 THEN 'unsupported_extra_citation' END, CASE WHEN misplaced > 0 THEN 'citation_placement_failure' END, CASE WHEN dangling > 0 THEN 'dangling_citation' END], lambda x: x IS NOT NULL), ',')) AS reason_codes FROM t"""
)
def citation_results(spark, d):
    groups, anchors = _groups(spark, d)
    c, i = _claims(spark, d), F.col("ordinal")
    own = F.concat(F.lit("E"), (i % 3 + 1).cast("string")).alias("evidence_id")
    behind = (F.col("s") + F.length("line")).alias("place")
    cites = (
        c.where(i % 3 == 0).select("run_id", behind, own).union(c.where(i % 7 == 3).select("run_id", behind, F.lit("KB-007"))).union(c.where(i % 5 == 4).select("run_id", i + 10000000, own))
        .union(c.where((F.col("run_id") % 6 == 0) & (i == 0)).select("run_id", F.lit(20000000), F.lit("E99")))
    )
    overlay = c.where((F.col("run_id") % 8 == 3) & (i % 2 == 0) & (F.length("line") > 0)).select("run_id", F.col("s").alias("start"), (F.col("s") + F.length("line")).alias("end"), F.array(own).alias("evidence_ids"))
    # Each of these is read several times; they are worked out once.
    return policy.citation_result(_runs(spark, d), _kept(groups, "groups"), _kept(cites, "cites"), _kept(_registry(spark, d, anchors), "registry"), _kept(overlay, "overlay"))


@register(
    f"""WITH {_GROUPS}, nu AS (SELECT run_id, evidence_id, dense_rank() OVER (PARTITION BY run_id ORDER BY evidence_id) AS n FROM (SELECT DISTINCT run_id, evidence_id FROM ev WHERE evidence_id <> 'E2')),
x AS (SELECT run_id, s, e, unnest(required) AS evidence_id FROM g) SELECT x.run_id, s AS start, e AS "end", '<sup>[' || string_agg('<a href="#ref-' || n || '">' || n || '</a>', ', ' ORDER BY n) || ']</sup>' AS html FROM x JOIN nu ON nu.run_id = x.run_id AND nu.evidence_id = x.evidence_id GROUP BY ALL"""
)
def citation_clusters(spark, d):
    groups, anchors = _groups(spark, d)
    cited = _support(anchors).where("evidence_id <> 'E2'").select("run_id", "evidence_id").distinct()
    numbers = cited.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("evidence_id")))
    return policy.cluster_html(groups, numbers)


# ---------------------------------------------------------------- adjudication

_ADJ = f"""{_CLAIMS},
ro AS (SELECT run_id, claim_id, CASE WHEN run_id % 17 = 3 AND ordinal = 0 THEN 2 ELSE 1 END AS listed FROM c),
o AS (SELECT run_id, claim_id, v, CASE WHEN (run_id + ordinal) % 12 = 5 THEN 2 ELSE 1 END AS n, CASE WHEN run_id % 2 = 1 THEN 2 ELSE 1 END AS said FROM c WHERE (run_id + ordinal) % 13 <> 0),
j AS (SELECT ro.run_id, ro.claim_id, v % 3 > 0 AS sup, v % 2 = 1 AS ent, v % 7 AS kd, v % 11 = 0 AS vet, CASE WHEN o.n IS NULL THEN ['missing_claim_row:' || ro.claim_id] ELSE list_concat(CASE WHEN v % 23 = 0 THEN ['bad_span'] ELSE [] END, CASE WHEN n = 1 THEN [] WHEN said = 2 THEN ['conflicting_duplicate_claim_row'] ELSE ['duplicate_claim_row'] END) END AS wrong
  FROM ro LEFT JOIN o ON o.run_id = ro.run_id AND o.claim_id = ro.claim_id),
ad AS (SELECT run_id, claim_id, CASE WHEN len(wrong) = 0 AND NOT (ent AND NOT sup) THEN 'VALID' ELSE 'INVALID' END AS validity, CASE WHEN len(wrong) = 0 AND NOT (ent AND NOT sup) THEN CASE WHEN NOT sup THEN 'unverified' WHEN ent AND kd > 1 AND NOT vet THEN 'verified' ELSE 'weak' END END AS status,
  CASE WHEN len(wrong) = 0 AND ent AND NOT sup THEN 'no_support_with_full_entailment_true' ELSE array_to_string(wrong, ',') END AS invalid_reasons, CASE WHEN len(wrong) > 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN sup THEN 'MEANINGFUL_SUPPORT_PRESENT' ELSE 'NO_MEANINGFUL_SUPPORT' END,
  CASE WHEN ent THEN 'FULL_ENTAILMENT_CLAIMED' END, CASE WHEN kd = 0 THEN 'BLOCKER_CONTRADICTION' END, CASE WHEN kd = 1 THEN 'BLOCKER_LIMITATION' END, CASE WHEN vet THEN 'DETERMINISTIC_FACT_VETO' END], lambda x: x IS NOT NULL), ',') END AS reason_codes FROM j
  UNION ALL SELECT run_id, NULL, 'INVALID', NULL, string_agg(x, ',' ORDER BY x), '' FROM (SELECT doc_id AS run_id, 'extra_claim_row:zz' AS x FROM k WHERE doc_id % 19 = 4 UNION ALL SELECT DISTINCT run_id, 'duplicate_claim_in_roster' FROM ro WHERE listed = 2) GROUP BY run_id)"""


def _adjudicated(spark, d):
    c = _claims(spark, d)
    run, i, v = F.col("run_id"), F.col("ordinal"), F.col("v")
    roster = c.select(run.alias("request_id"), "claim_id").union(c.where((run % 17 == 3) & (i == 0)).select(run, "claim_id"))
    kinds = F.when(v % 7 == 0, F.array(F.lit("contradiction"))).when(v % 7 == 1, F.array(F.lit("limitation"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(v % 23 == 0, F.array(F.lit("bad_span"))).otherwise(F.array().cast("array<string>"))
    fields = ["signature", (v % 3).cast("int").alias("n_support"), (v % 2 == 1).alias("full_entailment"), kinds.alias("kinds"), (v % 11 == 0).alias("vetoed"), errors.alias("errors")]
    seen = c.where((run + i) % 13 != 0)
    more = seen.where((run + i) % 12 == 5).withColumn("signature", F.when(run % 2 == 1, "s2").otherwise("s1"))
    extra = c.where((run % 19 == 4) & (i == 0)).withColumn("claim_id", F.lit("zz")).withColumn("signature", F.lit("s1"))
    rows = seen.withColumn("signature", F.lit("s1")).unionByName(more).unionByName(extra)
    return binding.adjudicate(roster, rows.select(run.alias("request_id"), "claim_id", *fields)), c


@register(f"WITH {_ADJ} SELECT run_id AS request_id, * EXCLUDE (run_id) FROM ad")
def adjudication_rows(spark, d):
    return _adjudicated(spark, d)[0]


@register(f"WITH {_ADJ} SELECT run_id AS request_id, CASE WHEN bool_and(validity = 'VALID') THEN 'VALID' ELSE 'INVALID' END AS validity FROM ad GROUP BY run_id")
def adjudication_validity(spark, d):
    return binding.overall_validity(_adjudicated(spark, d)[0])


@register(
    f"""WITH {_ADJ}, x AS (SELECT run_id, claim_id, v, substr(text, s + 1, 10) AS t1 FROM c WHERE v % 3 > 0)
SELECT ad.run_id AS request_id, ad.claim_id, coalesce(status, 'unverified') AS status, validity, CASE WHEN v IS NULL OR ad.run_id % 3 = 2 THEN 'none' WHEN ad.run_id % 3 = 0 THEN 'web' ELSE 'kb' END AS source_kind, CASE WHEN v IS NOT NULL AND ad.run_id % 3 = 0 THEN 'https://h/' || ad.run_id END AS source_url,
  CASE WHEN v IS NULL THEN NULL WHEN ad.run_id % 3 = 0 THEN 'https://h/' || ad.run_id WHEN ad.run_id % 3 = 1 THEN 'kb:' || d.source END AS source_ref, CASE WHEN v IS NULL THEN '' ELSE t1 || CASE WHEN v % 3 = 2 THEN '|' || coalesce(substr(y.text, 1, 5), '') ELSE '' END END AS support_text
FROM ad LEFT JOIN x ON x.run_id = ad.run_id AND x.claim_id = ad.claim_id JOIN documents d ON d.doc_id = ad.run_id LEFT JOIN documents y ON y.doc_id = ad.run_id + 1 WHERE ad.claim_id IS NOT NULL"""
)
def grounding_rows(spark, d):
    judged, c = _adjudicated(spark, d)
    name = lambda x: F.concat(F.lit("D"), x.cast("string"))
    run = F.col("run_id")
    first = c.where("v % 3 > 0").select(run.alias("request_id"), "claim_id", F.lit(0).alias("place"), name(run).alias("evidence_id"), F.col("s").alias("start"), (F.col("s") + 10).alias("end"))
    second = c.where("v % 3 = 2").select(run, "claim_id", F.lit(1), name(run + 1), F.lit(0), F.lit(5))
    n = F.col("doc_id")
    manifest = table(spark, d, "documents").select(name(n).alias("evidence_id"), F.when(n % 3 == 0, "web").when(n % 3 == 1, "kb").otherwise("note").alias("kind"), F.concat(F.lit("https://h/"), n.cast("string")).alias("url"), "source", F.col("text").alias("source_text"))
    return binding.grounding_rows(judged, first.union(second), manifest)


# ---------------------------------------------------------------- quotes and spans


_QUOTED = f"""{_CLAIMS}, qt AS (SELECT run_id, claim_id, ordinal, j, CASE j WHEN 0 THEN 'support' ELSE 'blocker_0' END AS role, CASE WHEN (run_id + ordinal) % 31 = 0 THEN 'gone' ELSE run_id::VARCHAR END AS evidence_id,
  CASE WHEN j = 1 THEN 'no such words' WHEN ordinal % 9 = 8 THEN '' ELSE substr(line, 1, CASE WHEN ordinal % 4 = 0 THEN 3 ELSE 25 END) END AS quote FROM c, (VALUES (0), (1)) v(j) WHERE j = 0 OR ordinal % 10 = 2),
qb AS (SELECT qt.*, text IS NULL AS lost, CASE WHEN strpos(text, quote) = 0 THEN 0 WHEN strpos(substr(text, strpos(text, quote) + 1), quote) > 0 THEN 2 ELSE 1 END AS n, strpos(text, quote) AS p FROM qt LEFT JOIN k ON k.doc_id::VARCHAR = qt.evidence_id),
qs AS (SELECT *, CASE WHEN quote = '' THEN 'empty_quote' WHEN lost THEN 'invalid_evidence_id' WHEN n = 0 THEN 'quote_not_found' WHEN n > 1 THEN 'ambiguous_quote' ELSE 'bound' END AS status FROM qb)"""


def _quotes(spark, d):
    c = _claims(spark, d)
    run, i = F.col("run_id"), F.col("ordinal")
    own = F.when(i % 9 == 8, "").otherwise(F.when(i % 4 == 0, F.substring("line", 1, 3)).otherwise(F.substring("line", 1, 25)))
    rows = c.withColumn("evidence_id", F.when((run + i) % 31 == 0, "gone").otherwise(run.cast("string")))
    key = F.concat_ws(":", run.cast("string"), "claim_id").alias("claim_id")
    quotes = rows.select(key, F.lit("support").alias("role"), F.lit(0).alias("index"), "evidence_id", own.alias("quote")).union(rows.where(i % 10 == 2).select(key, F.lit("blocker_0"), F.lit(0), "evidence_id", F.lit("no such words")))
    manifest = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("evidence_id"), F.col("text").alias("source_text"))
    return binding.bind_quotes(quotes, manifest)


@register(f"""WITH {_QUOTED} SELECT run_id || ':' || claim_id AS claim_id, role, 0 AS index, evidence_id, quote, status, CASE WHEN status = 'bound' THEN p - 1 END AS start, CASE WHEN status = 'bound' THEN p - 1 + length(quote) END AS "end" FROM qs""")
def quote_spans(spark, d):
    return _quotes(spark, d)


@register(f"""WITH {_QUOTED} SELECT run_id || ':' || claim_id AS claim_id, min_by(status, role) FILTER (status <> 'bound') AS failure, min_by(evidence_id, role) FILTER (status <> 'bound') AS failed_evidence, CASE WHEN bool_and(status = 'bound') THEN count(*) END AS n_spans FROM qs GROUP BY 1""")
def quote_observations(spark, d):
    """One quote that does not bind fails its whole observation."""
    out = binding.bound_observations(_quotes(spark, d))
    return out.select("claim_id", "failure", "failed_evidence", F.when(F.col("spans").isNotNull(), F.size("spans")).alias("n_spans"))


@register(
    """WITH d AS (SELECT doc_id, substr(CASE WHEN doc_id % 13 = 0 THEN 'no such' ELSE text END, 11, 3) AS quote, text FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, quote, unnest(string_split(text, '')) AS a, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM d),
w AS (SELECT doc_id, quote, i, substr(a || coalesce(lead(a, 1) OVER v, '') || coalesce(lead(a, 2) OVER v, ''), 1, length(quote)) AS s FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)), o AS (SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS starts FROM w WHERE quote <> '' AND s = quote GROUP BY doc_id)
SELECT d.doc_id, coalesce(starts, '') AS starts FROM d LEFT JOIN o USING (doc_id)"""
)
def exact_occurrences(spark, d):
    """Every place of three letters of each document in it, overlapping ones too."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.substring(F.when(F.col("doc_id") % 13 == 0, "no such").otherwise(F.col("text")), 11, 3).alias("quote"))
    return docs.select("doc_id", F.array_join(F.transform(text.occurrences(F.col("text"), F.col("quote")), lambda i: i.cast("string")), ",").alias("starts"))


_MARKED = """m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: w || CASE WHEN i % 50 = 7 THEN ' [E' || (i % 9 + 1) || ']' WHEN i % 70 = 9 THEN '[WEB-00' || (i % 8 + 1) || '][E]' ELSE '' END), ' ') AS t FROM documents WHERE text IS NOT NULL)"""


@register(
    rf"""WITH {_MARKED}, p AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s).*?\[(?:(?:WEB|KB)-\d{{3}}|E\d+)\]')) AS x, generate_subscripts(regexp_extract_all(t, '(?s).*?\[(?:(?:WEB|KB)-\d{{3}}|E\d+)\]'), 1) AS i FROM m),
e AS (SELECT *, regexp_extract(x, '\[((?:WEB|KB)-\d{{3}}|E\d+)\]$', 1) AS evidence_id, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM p) SELECT doc_id, evidence_id, (z - length(evidence_id) - 2)::BIGINT AS place FROM e"""
)
def citation_markers(spark, d):
    """Markers in documents that carry some."""
    docs = table(spark, d, "documents").where("text is not null")
    word = lambda w, i: F.concat(w, F.when((i + 1) % 50 == 7, F.concat(F.lit(" [E"), ((i + 1) % 9 + 1).cast("string"), F.lit("]"))).when((i + 1) % 70 == 9, F.concat(F.lit("[WEB-00"), ((i + 1) % 8 + 1).cast("string"), F.lit("][E]"))).otherwise(""))
    return policy.markers(docs.select("doc_id", F.array_join(F.transform(F.split("text", " "), word), " ").alias("text")))


@register(
    f"""WITH {_CLAIMS}, x AS (SELECT run_id, any_value(text) AS text, string_agg(CASE WHEN length(line) > 0 THEN line || '[' || ordinal || ']' ELSE line END, chr(10) ORDER BY ordinal) AS marked FROM c GROUP BY run_id) SELECT run_id, md5(marked) AS marked_md5, length(marked) AS chars FROM x"""
)
def inserted_markers(spark, d):
    """A marker behind every line that isn't empty, put in at its place in the text; a text and its places stand in one row."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("run_id"), "text")
    at = lambda p, i: F.struct((p["s"] + F.length(p["line"])).alias("place"), F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("marker"), F.length(p["line"]).alias("n"))
    spots = F.filter(F.transform(_placed_lines("text"), at), lambda x: x["n"] > 0)
    marked = docs.select("run_id", policy.insert_markers(F.col("text"), spots).alias("t"))
    return marked.select("run_id", F.md5(F.col("t").cast("binary")).alias("marked_md5"), F.length("t").alias("chars"))


@register(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[#*_`>\[\]]', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(p) <= 220 THEN p ELSE regexp_replace(substr(p, 1, 220), '\s+\S*$', '') || '…' END AS excerpt FROM t"""
)
def excerpts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@register(
    """WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'limitation' WHEN 2 THEN 'doubt' END AS kind, CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS x, turn % 2 AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN kind IS NULL OR kind = 'doubt' THEN 'unknown_kind' WHEN trim(coalesce(x, '')) = '' THEN 'missing_explanation' WHEN kind = 'contradiction' AND n = 0 THEN 'contradiction_requires_evidence_span' END AS code FROM t"""
)
def blocker_codes(spark, d):
    turn, case = F.col("turn"), (F.col("conv_id") + F.col("turn")) % 4
    kind = F.when(case == 0, "contradiction").when(case == 1, "limitation").when(case == 2, "doubt")
    return table(spark, d, "conversations").select("conv_id", "turn", binding.blocker_code(kind, F.when(turn % 3 == 0, "  ").otherwise(F.col("text")), turn % 2).alias("code"))


_FORMS = (
    '{"evidence_id":"%","start":0,"end":5}', '["x"]', '{"evidence_id":"%","start":0,"end":5,"note":1}', '{"evidence_id":"%","start":0}', '{"evidence_id":7,"start":0,"end":5}', '{"evidence_id":"%","start":"0","end":5}', '{"evidence_id":"%","start":0,"end":5.5}',
    '{"evidence_id":"E-9","start":0,"end":5}', '{"evidence_id":"%","start":-1,"end":5}', '{"evidence_id":"%","start":5,"end":5}', '{"evidence_id":"%","start":0,"end":10000000}', "not json", '{"evidence_id":"%","start":0,"end":1}',
)


@register(
    """WITH d AS (SELECT doc_id, doc_id % 13 AS f, text FROM documents) SELECT doc_id, CASE WHEN f IN (1, 11) THEN 'malformed_span' WHEN f = 2 THEN 'unknown_span_field' WHEN f = 3 THEN 'missing_span_field' WHEN f = 4 THEN 'invalid_evidence_id_type' WHEN f = 5 THEN 'invalid_start_type' WHEN f = 6 THEN 'invalid_end_type'
  WHEN f = 7 OR text IS NULL THEN 'unknown_evidence_id' WHEN doc_id % 10 = 0 THEN 'cross_request_evidence_reference' WHEN doc_id % 17 = 0 THEN 'stale_evidence_hash' WHEN doc_id % 19 = 0 THEN 'invisible_evidence' WHEN f = 8 THEN 'negative_span_start' WHEN f = 9 THEN 'zero_or_negative_length_span'
  WHEN f = 10 OR length(text) < CASE f WHEN 12 THEN 1 ELSE 5 END THEN 'out_of_bounds_span' END AS code FROM d"""
)
def span_codes(spark, d):
    """Spans over all documents as evidence, malformed in every way, and evidence of another request, stale or hidden."""
    n = F.col("doc_id")
    name = F.concat(F.lit("E"), n.cast("string"))
    form = F.lit(None).cast("string")
    for k, shape in enumerate(_FORMS):
        form = F.when(n % len(_FORMS) == k, F.replace(F.lit(shape), F.lit("%"), name)).otherwise(form)
    docs = table(spark, d, "documents")
    manifest = docs.select(name.alias("evidence_id"), F.when(n % 10 == 0, "r2").otherwise("r1").alias("request_id"), F.col("text").alias("source_text"), F.when(n % 17 == 0, "00").alias("source_sha256"), (n % 19 != 0).alias("visible"))
    return binding.span_codes(docs.select("doc_id", form.alias("span")), manifest, "r1").select("doc_id", "code")


@register(
    """WITH r AS (SELECT conv_id AS run_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'invalid_bundle' WHEN run_id % 4 = 2 THEN 'unsigned' WHEN run_id % 4 = 1 THEN 'stale' ELSE 'signed' END AS state FROM r"""
)
def signoff_states(spark, d):
    """Turns as the evidence of their conversation; receipts for what it is now, for something else, or none; texts that are missing."""
    run = F.col("run_id")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").cast("string").alias("claim_id"), F.col("role").alias("evidence_id"), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), "").otherwise(F.concat_ws(" ", F.lit("said:"), "text")).alias("text"))
    whole = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat_ws("\x1f", "claim_id", "evidence_id", "text"))).alias("all"))
    receipts = whole.where(run % 4 != 2).select("run_id", F.when(run % 4 == 1, "0").otherwise(F.sha2(F.array_join("all", "\x1e"), 256)).alias("digest"))
    return binding.signoff(rows, receipts, ["run_id"])


@register(
    """WITH d AS (SELECT doc_id AS run_id, doc_id % 6 AS f FROM documents), x AS (SELECT run_id, unnest(CASE f WHEN 1 THEN ['stale_citation_plan_draft_sha'] WHEN 2 THEN ['stale_citation_plan_claim_roster'] WHEN 4 THEN ['stale_citation_plan_grounding_roster', 'stale_citation_plan_support'] WHEN 5 THEN ['stale_citation_plan_draft_sha', 'stale_citation_plan_support'] ELSE [] END) AS reason, f FROM d) SELECT run_id, reason FROM x"""
)
def plan_staleness(spark, d):
    """Plans made for each document, of which some are for another draft, roster or support; an empty roster is not compared."""
    n = F.col("doc_id")
    f, sha, roster = n % 6, F.sha2(F.coalesce("text", F.lit("")), 256), F.array(F.col("source"), F.col("lang"))
    other, none = F.array(F.lit("x")), F.array().cast("array<string>")
    docs = table(spark, d, "documents")
    now = docs.select(n.alias("run_id"), sha.alias("draft_sha"), roster.alias("claim_roster"), roster.alias("grounding_roster"), F.lit("g").alias("groups"))
    plans = docs.select(n.alias("run_id"), F.when(f.isin(1, 5), "old").otherwise(sha).alias("draft_sha"), F.when(f == 2, other).when(f == 3, none).otherwise(roster).alias("claim_roster"), F.when(f == 4, other).when(f == 3, none).otherwise(roster).alias("grounding_roster"), F.when(f >= 4, "h").otherwise("g").alias("groups"))
    return policy.plan_staleness(plans, now)
