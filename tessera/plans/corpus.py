"""Registered queries of the corpus compiler, over Markdown that is made of the supplied documents: each line becomes a block of a kind that its document and place choose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import places
from ..functions.text import let
from ..operators import markdown, units
from ..sources.tables import table
from .catalog import register

LIMIT = 40

_WORDS = r"regexp_extract_all(l, '[^ ]+')"
_PARTS = [
    f"'## ' || array_to_string({_WORDS}[1:3], ' ')", f"'- ' || array_to_string({_WORDS}[1:6], ' ') || chr(10) || '- ' || array_to_string({_WORDS}[7:], ' ')", "'> ' || l",
    f"'```' || chr(10) || l || chr(10) || coalesce({_WORDS}[1], 'x') || chr(10) || '```'", f"'| ' || coalesce({_WORDS}[1], 'x') || ' | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || array_to_string({_WORDS}[1:30], ' ') || ' | 2 |' || chr(10) || '| 3 | 4 |'",
    "'---'", f"'### ' || coalesce({_WORDS}[1], 'x')", "l", f"coalesce({_WORDS}[1], 'x') || chr(10) || '==='",
]


def _markdown(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")

    def part(line, i):
        one = F.coalesce(F.nullif(F.regexp_extract(line, "[^ ]+", 0), F.lit("")), F.lit("x"))
        words = lambda f: let(F.filter(F.split(line, " "), lambda x: x != ""), f)
        some = lambda w, a, n=None: F.array_join(F.slice(w, a, n) if n else F.slice(w, F.lit(a), F.greatest(F.size(w), F.lit(1))), " ")
        forms = [
            words(lambda w: F.concat(F.lit("## "), some(w, 1, 3))), words(lambda w: F.concat(F.lit("- "), some(w, 1, 6), F.lit("\n- "), some(w, 7))), F.concat(F.lit("> "), line), F.concat(F.lit("```\n"), line, F.lit("\n"), one, F.lit("\n```")),
            words(lambda w: F.concat(F.lit("| "), one, F.lit(" | b |\n|---|---|\n| "), some(w, 1, 30), F.lit(" | 2 |\n| 3 | 4 |"))), F.lit("---"), F.concat(F.lit("### "), one), line, F.concat(one, F.lit("\n===")),
        ]

        def formed(form):
            out = F.when(form == 0, forms[0])
            for k, f in enumerate(forms[1:], 1):
                out = out.when(form == k, f)
            return out

        return let((F.col("doc_id") + i) % 9, formed)

    head = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"))).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform(F.split("text", "\n"), part), "\n\n")).alias("text"))


_MARKDOWN = f"""md AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN '# Doc ' || doc_id || chr(10) || chr(10) ELSE '' END ||
  array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE (doc_id + i - 1) % 9 {' '.join(f'WHEN {k} THEN {p}' for k, p in enumerate(_PARTS))} END), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL)"""

_RULER = r"'^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$'"
#: Lines with window functions: class, fences by parity, marked lines, blocks, heading intervals.
_BLOCKS = rf"""{_MARKDOWN},
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
l1 AS (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1)::BIGINT AS s, CASE WHEN regexp_matches(t, '^[ \t]*$') THEN 'blank' WHEN regexp_matches(t, '^ {{0,3}}(```|~~~)') THEN 'fence' WHEN regexp_matches(t, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN 'heading'
  WHEN regexp_matches(t, '^ {{0,3}}((-[ \t]*){{3,}}|(_[ \t]*){{3,}}|(\*[ \t]*){{3,}})$') THEN 'rule' WHEN regexp_matches(t, '^ {{0,3}}>') THEN 'quote' WHEN regexp_matches(t, '^ {{0,3}}([-*+]|[0-9]{{1,9}}[.)])[ \t]') THEN 'item' WHEN regexp_matches(t, '^( {{4}}|\t)') THEN 'indent' ELSE 'text' END AS c FROM l0),
l2 AS (SELECT *, count(*) FILTER (c = 'fence') OVER (PARTITION BY doc_id ORDER BY i) AS f FROM l1),
l3 AS (SELECT doc_id, t, i, s, CASE WHEN c = 'fence' THEN CASE WHEN f % 2 = 1 THEN 'open' ELSE 'in' END WHEN f % 2 = 1 THEN 'in' ELSE c END AS c FROM l2),
l4 AS (SELECT *, coalesce(i - lag(i) OVER w > 1, true) AS gap, lag(c) OVER w AS p, row_number() OVER w AS k FROM l3 WHERE c <> 'blank' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l5 AS (SELECT * REPLACE (CASE WHEN NOT gap AND p = 'text' AND c IN ('text', 'rule') AND regexp_matches(t, '^ {{0,3}}(=+|-+)[ \t]*$') THEN 'under' ELSE c END AS c) FROM l4),
l6 AS (SELECT *, lag(c) OVER w AS b, coalesce(NOT lead(gap) OVER w AND contains(lead(t) OVER w, '|') AND regexp_matches(lead(t) OVER w, {_RULER}), false) AND contains(t, '|') AS tbl FROM l5 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
l7 AS (SELECT *, (gap AND c <> 'in') OR coalesce(b IN ('heading', 'rule', 'under') OR (b IN ('open', 'in') AND c <> 'in'), false) AS hard FROM l6),
l8 AS (SELECT *, CASE c WHEN 'open' THEN 'fenced_code' WHEN 'in' THEN NULL WHEN 'heading' THEN 'heading' WHEN 'rule' THEN 'thematic_break' WHEN 'quote' THEN 'blockquote' WHEN 'item' THEN 'list' WHEN 'under' THEN 'under'
  ELSE CASE WHEN hard AND c = 'indent' THEN 'code' WHEN hard THEN CASE WHEN tbl THEN 'table' WHEN regexp_matches(t, '^ {{0,3}}<[A-Za-z/!?]') THEN 'html' ELSE 'paragraph' END WHEN b = 'indent' AND c <> 'indent' THEN 'late' END END AS m FROM l7),
m1 AS (SELECT doc_id, k, gap, CASE WHEN m = 'late' THEN CASE WHEN lag(m) OVER w = 'code' THEN 'paragraph' END WHEN m = 'under' THEN CASE WHEN lag(m) OVER w IN ('list', 'blockquote', 'html', 'table') AND regexp_matches(t, '^ {{0,3}}(-[ \t]*){{3,}}$') THEN 'thematic_break' END ELSE m END AS m FROM l8 WHERE m IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
m2 AS (SELECT *, lag(m) OVER (PARTITION BY doc_id ORDER BY k) AS q FROM m1 WHERE m IS NOT NULL),
m3 AS (SELECT doc_id, k, m, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ordinal, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS z FROM m2 WHERE NOT coalesce(m = q AND (m = 'list' OR (m = 'blockquote' AND NOT gap)), false)),
b0 AS (SELECT doc_id, ordinal, any_value(m) AS m, min(s) AS start, max(s + length(t)) AS "end", min(i) AS line, arg_min(t, k) AS t1, arg_max(c, k) AS c9, arg_max(t, k) AS t9 FROM (SELECT l8.*, m3.ordinal, m3.m AS mm FROM l8 JOIN m3 ON m3.doc_id = l8.doc_id AND l8.k >= m3.k AND (l8.k < m3.z OR m3.z IS NULL)) GROUP BY doc_id, ordinal),
b1 AS (SELECT b0.* EXCLUDE (m), CASE WHEN m3.m = 'paragraph' AND c9 = 'under' THEN 'heading' ELSE m3.m END AS kind, CASE WHEN m3.m = 'heading' THEN length(regexp_extract(t1, '(#+)', 1)) WHEN m3.m = 'paragraph' AND c9 = 'under' THEN CASE WHEN contains(t9, '=') THEN 1 ELSE 2 END ELSE 0 END AS level,
  CASE WHEN m3.m = 'heading' THEN trim(regexp_replace(regexp_replace(t1, '^ {{0,3}}#{{1,6}}([ \t]+|$)', ''), '(^|[ \t]+)#+[ \t]*$', '')) WHEN m3.m = 'paragraph' AND c9 = 'under' THEN trim(t1) END AS label FROM b0 JOIN m3 USING (doc_id, ordinal)),
h AS (SELECT g.doc_id, g.ordinal, g.label, g.level, min(x.ordinal) AS until FROM b1 g LEFT JOIN b1 x ON x.doc_id = g.doc_id AND x.ordinal > g.ordinal AND x.kind = 'heading' AND x.level <= g.level WHERE g.kind = 'heading' GROUP BY ALL),
pa AS (SELECT b.doc_id, b.ordinal, list(h.label ORDER BY h.ordinal) AS path, max(h.ordinal) FILTER (h.ordinal < b.ordinal) AS parent FROM b1 b JOIN h ON h.doc_id = b.doc_id AND h.ordinal <= b.ordinal AND (b.ordinal < h.until OR h.until IS NULL) GROUP BY ALL),
ti AS (SELECT doc_id, arg_min(label, ordinal) AS title FROM h WHERE level = 1 GROUP BY doc_id),
b AS (SELECT b1.doc_id, b1.ordinal, kind, start, "end", line, level, coalesce(path, []) AS path, parent, coalesce(title, b1.doc_id::VARCHAR) AS title, substr(text, start + 1, "end" - start) AS content FROM b1 JOIN md ON md.doc_id = b1.doc_id LEFT JOIN pa ON pa.doc_id = b1.doc_id AND pa.ordinal = b1.ordinal LEFT JOIN ti ON ti.doc_id = b1.doc_id)""".replace("{{", "{").replace("}}", "}")  # fmt: skip


@register(
    f"""WITH {_BLOCKS} SELECT doc_id, ordinal, kind, start, "end", line, level, array_to_string(path, ' > ') AS heading_path, parent, title,
  lag(ordinal) OVER w AS previous, lead(ordinal) OVER w AS next, md5(content) AS content_md5 FROM b WINDOW w AS (PARTITION BY doc_id, parent ORDER BY ordinal)"""
)
def markdown_tree(spark, d):
    """Blocks with their places, heading paths, parents and siblings."""
    out = markdown.siblings(markdown.markdown_blocks(_markdown(spark, d)))
    return out.withColumn("heading_path", F.array_join("heading_path", " > ")).withColumn("content_md5", F.md5(F.col("content").cast("binary"))).drop("content")


@register(f"WITH {_BLOCKS} SELECT kind AS block_type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM b GROUP BY kind")
def markdown_block_types(spark, d):
    return markdown.markdown_blocks(_markdown(spark, d)).groupBy(F.col("kind").alias("block_type")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


_N = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"
_CHILDREN = rf"""{_BLOCKS},
z AS (SELECT *, {_N.format('content')} AS own, {_N.format('title')} + {_N.format("array_to_string(path, ' > ')")} AS head FROM b),
big AS (SELECT * FROM z WHERE own + head > {LIMIT}),
lines AS (SELECT doc_id, ordinal, kind, content, unnest(regexp_extract_all(content, '[^\n]*\n|[^\n]+')) AS piece, generate_subscripts(regexp_extract_all(content, '[^\n]*\n|[^\n]+'), 1) AS j FROM big WHERE kind IN ('fenced_code', 'table', 'list')),
runs AS (SELECT *, CASE WHEN kind <> 'list' THEN j ELSE 1 + sum(CASE WHEN j > 1 AND regexp_matches(piece, '^ {{0,3}}([-*+]|[0-9]{{1,9}}[.)])[ \t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ordinal ORDER BY j) END AS u FROM lines),
pieces AS (SELECT doc_id, ordinal, kind, u::BIGINT AS u, string_agg(piece, '' ORDER BY j) AS piece FROM runs GROUP BY ALL
  UNION ALL SELECT doc_id, ordinal, kind, generate_subscripts(regexp_extract_all(content, '(?s).*?[.!?]\s+|.+'), 1), unnest(regexp_extract_all(content, '(?s).*?[.!?]\s+|.+')) FROM big WHERE kind = 'paragraph'),
cnt AS (SELECT *, count(*) OVER w AS nu, last_value(piece) OVER (w ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM pieces WINDOW w AS (PARTITION BY doc_id, ordinal)),
role AS (SELECT *, CASE WHEN (kind = 'fenced_code' AND u = 1) OR (kind = 'table' AND nu > 1 AND u <= 2) THEN 'before' WHEN kind = 'fenced_code' AND nu > 1 AND u = nu AND regexp_matches(tail, '^ {{0,3}}(`{{3,}}|~{{3,}})[ \t]*$') THEN 'after' ELSE 'unit' END AS r,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, ordinal ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM cnt),
fix AS (SELECT doc_id, ordinal, coalesce(string_agg(piece, '' ORDER BY u) FILTER (r = 'before'), '') AS before, coalesce(string_agg(piece, '' ORDER BY u) FILTER (r = 'after'), '') AS after FROM role GROUP BY ALL),
room AS (SELECT big.*, coalesce(before, '') AS before, coalesce(after, '') AS after, {LIMIT} - head - {_N.format("coalesce(before, '')")} - {_N.format("coalesce(after, '')")} AS room FROM big LEFT JOIN fix USING (doc_id, ordinal)),
un AS (SELECT role.doc_id, role.ordinal, u, a, piece, room, role.kind, {_N.format('piece')} AS n FROM role JOIN room ON room.doc_id = role.doc_id AND room.ordinal = role.ordinal WHERE r = 'unit' AND room > 0),
w AS (SELECT doc_id, ordinal, u, a, room, unnest(regexp_extract_all(piece, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')) AS word, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*'), 1) AS j, length(regexp_extract(piece, '^[\x20\x09-\x0D]*')) AS lead FROM un WHERE kind = 'paragraph' AND n > room),
ww AS (SELECT doc_id, ordinal, u, (j - 1) // room AS v, a, lead, sum(length(word)) AS len, count(*) AS n FROM w GROUP BY ALL),
sub AS (SELECT doc_id, ordinal, u, v, a + CASE WHEN v = 0 THEN 0 ELSE lead + sum(len) OVER (PARTITION BY doc_id, ordinal, u ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS a, n, len + CASE WHEN v = 0 THEN lead ELSE 0 END AS len FROM ww
  UNION ALL SELECT doc_id, ordinal, u, 0, a, n, length(piece) FROM un WHERE NOT (kind = 'paragraph' AND n > room)),
seq AS (SELECT sub.*, room.room, row_number() OVER (PARTITION BY sub.doc_id, sub.ordinal ORDER BY u, v) AS j FROM sub JOIN room ON room.doc_id = sub.doc_id AND room.ordinal = sub.ordinal),
fill AS (SELECT doc_id, ordinal, j, n AS held, 0 AS part FROM seq WHERE j = 1 UNION ALL SELECT s.doc_id, s.ordinal, s.j, CASE WHEN f.held + s.n <= s.room THEN f.held + s.n ELSE s.n END, f.part + CASE WHEN f.held + s.n <= s.room THEN 0 ELSE 1 END FROM fill f JOIN seq s ON s.doc_id = f.doc_id AND s.ordinal = f.ordinal AND s.j = f.j + 1),
parts AS (SELECT doc_id, ordinal, part, min(a)::BIGINT AS a, max(a + len)::BIGINT AS e, sum(n)::BIGINT AS n FROM fill JOIN seq USING (doc_id, ordinal, j) GROUP BY ALL),
ch AS (SELECT z.doc_id, z.ordinal, 0 AS part, z.start, z."end", 'intact' AS policy, z.own + z.head AS n_tokens, NULL::VARCHAR AS before, NULL::VARCHAR AS after, CASE WHEN z.own + z.head > {LIMIT} THEN 'indivisible' END AS overflow, z.own AS own_tokens FROM z LEFT JOIN (SELECT DISTINCT doc_id, ordinal FROM parts) q ON q.doc_id = z.doc_id AND q.ordinal = z.ordinal WHERE z.own + z.head <= {LIMIT} OR q.doc_id IS NULL
  UNION ALL SELECT p.doc_id, p.ordinal, p.part, r.start + p.a, r.start + p.e, r.kind || '-parts', p.n + {LIMIT} - r.room, r.before, r.after, CASE WHEN p.n > r.room THEN 'part too long' END, p.n + CASE WHEN p.part = 0 THEN {_N.format('r.before')} ELSE 0 END + CASE WHEN p.part = max(p.part) OVER (PARTITION BY p.doc_id, p.ordinal) THEN {_N.format('r.after')} ELSE 0 END FROM parts p JOIN room r ON r.doc_id = p.doc_id AND r.ordinal = p.ordinal)""".replace("{{", "{").replace("}}", "}")  # fmt: skip


@register(f'WITH RECURSIVE {_CHILDREN} SELECT doc_id, ordinal, part, start, "end", policy, n_tokens, before, after, overflow FROM ch')
def markdown_children(spark, d):
    """Blocks split up to forty words at items, fence lines, rows, sentences or words, with repeated fence marks and table heads; what cannot be split is marked."""
    out = markdown.split_blocks(markdown.markdown_blocks(_markdown(spark, d)), LIMIT)
    return out.select("doc_id", "ordinal", "part", "start", "end", "policy", "n_tokens", "before", "after", "overflow")


_PACKED = rf"""{_CHILDREN},
c0 AS (SELECT ch.*, b.kind, b.title, b.start + length(b.content) AS bend, b.start AS bstart, list_filter(CASE WHEN b.kind = 'heading' THEN b.path[1:len(b.path) - 1] ELSE b.path END, lambda x: x <> b.title) AS crumb, b.kind NOT IN ('paragraph', 'list', 'heading') OR (b.kind = 'heading' AND b.level = 1) AS bar,
  row_number() OVER (PARTITION BY ch.doc_id ORDER BY ch.ordinal, part) - 1 AS k, part = max(part) OVER (PARTITION BY ch.doc_id, ch.ordinal) AS final FROM ch JOIN b ON b.doc_id = ch.doc_id AND b.ordinal = ch.ordinal),
c1 AS (SELECT *, {_N.format('title')} + {_N.format("array_to_string(crumb, ' > ')")} AS over, sum(own_tokens) OVER (PARTITION BY doc_id ORDER BY k) AS through, coalesce(max(CASE WHEN bar THEN k END) OVER (PARTITION BY doc_id ORDER BY k), -1) AS wall FROM c0),
pk AS (SELECT doc_id, k, 0 AS unit, CASE WHEN bar THEN {LIMIT + 1} ELSE own_tokens END + over AS held FROM c1 WHERE k = 0 UNION ALL SELECT c.doc_id, c.k, CASE WHEN NOT c.bar AND p.held + c.own_tokens <= {LIMIT} THEN p.unit ELSE p.unit + 1 END,
  CASE WHEN NOT c.bar AND p.held + c.own_tokens <= {LIMIT} THEN p.held + c.own_tokens ELSE CASE WHEN c.bar THEN {LIMIT + 1} ELSE c.own_tokens END + c.over END FROM pk p JOIN c1 c ON c.doc_id = p.doc_id AND c.k = p.k + 1),
u0 AS (SELECT doc_id, unit, min(k) AS f, max(k) AS l FROM pk GROUP BY ALL),
u1 AS (SELECT u0.*, a.bar, a.crumb, a.over, z.through, a.through - a.own_tokens AS before, a.title, z.through - a.through + a.own_tokens + a.over AS core_tokens, CASE WHEN a.part = 0 THEN a.bstart ELSE a.start END AS core_start, CASE WHEN z.final THEN z.bend ELSE z."end" END AS core_end FROM u0 JOIN c1 a ON a.doc_id = u0.doc_id AND a.k = f JOIN c1 z ON z.doc_id = u0.doc_id AND z.k = l),
op AS (SELECT u.doc_id, u.unit, c.k, CASE WHEN c.kind = 'heading' AND u.through - ({LIMIT} - c.over) > c.through - c.own_tokens THEN c.through ELSE greatest(c.through - c.own_tokens, u.through - ({LIMIT} - c.over)) END AS w FROM u1 u JOIN c1 c ON c.doc_id = u.doc_id AND c.k < u.f AND c.k > (SELECT wall FROM c1 x WHERE x.doc_id = u.doc_id AND x.k = u.f) AND c.k >= u.f - {LIMIT} WHERE NOT u.bar AND u.core_tokens <= {LIMIT}),
ov AS (SELECT doc_id, unit, arg_min(k, (w, k)) AS k, min(w) AS w FROM op JOIN c1 USING (doc_id, k) WHERE w < c1.through GROUP BY ALL),
un2 AS (SELECT u.doc_id, u.unit, u.core_start, u.core_end, u.bar AS barrier, coalesce(s.crumb, u.crumb) AS crumb, u.core_tokens, coalesce(u.through - o.w + s.over, u.core_tokens) AS n_tokens, coalesce(u.before - o.w, 0) AS overlap_words,
  s.start + length(regexp_extract(substr(t.text, s.start + 1, s."end" - s.start), '^[\x20\x09-\x0D]*')) + coalesce(list_sum(list_transform(regexp_extract_all(substr(t.text, s.start + 1, s."end" - s.start), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')[1:(o.w - s.through + s.own_tokens)::INT], lambda x: length(x))), 0)::BIGINT AS overlap_start
  FROM u1 u LEFT JOIN ov o USING (doc_id, unit) LEFT JOIN c1 s ON s.doc_id = o.doc_id AND s.k = o.k LEFT JOIN md t ON t.doc_id = u.doc_id)"""


@register(f"WITH RECURSIVE {_PACKED} SELECT doc_id, unit, core_start, core_end, barrier, array_to_string(crumb, ' > ') AS breadcrumb, core_tokens, n_tokens, overlap_words, overlap_start FROM un2")
def packed_units(spark, d):
    """Units of up to forty words between barriers, with the words to their left that still fit."""
    out = markdown.pack_units(markdown.split_blocks(markdown.markdown_blocks(_markdown(spark, d)), LIMIT), LIMIT)
    return out.select("doc_id", "unit", "core_start", "core_end", "barrier", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "core_tokens", "n_tokens", "overlap_words", "overlap_start")


@register(f"""WITH RECURSIVE {_PACKED} SELECT md.doc_id, {_N.format('md.text')} AS words, {_N.format('md.text')} AS core_words, count(*) FILTER (n_tokens > {LIMIT}) AS too_long, count(unit) AS units, coalesce(sum(overlap_words), 0)::BIGINT AS overlap_words FROM md LEFT JOIN un2 USING (doc_id) GROUP BY md.doc_id, md.text""")
def corpus_invariants(spark, d):
    """Every word of a document stands in one core once; units beyond the limit are those that can't be split."""
    docs = _markdown(spark, d)
    packed = markdown.pack_units(markdown.split_blocks(markdown.markdown_blocks(docs), LIMIT), LIMIT)
    core = F.substr("text", F.col("core_start") + 1, F.col("core_end") - F.col("core_start"))
    # A text is counted once, not once with each of its units.
    held = docs.withColumn("words", markdown.token_count(F.col("text"))).join(packed, "doc_id", "left").groupBy("doc_id").agg(
        F.first("words").alias("words"), F.coalesce(F.sum(F.when(F.col("unit").isNotNull(), markdown.token_count(core))), F.lit(0)).alias("core_words"), F.count_if(F.col("n_tokens") > LIMIT).alias("too_long"),
        F.count("unit").alias("units"), F.coalesce(F.sum("overlap_words"), F.lit(0)).alias("overlap_words"),
    )
    return held


_LINE = r"[^\n]*\n|[^\n]+"


def _line_units(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    rows = docs.withColumn("p", places(F.col("text"), _LINE)).select("doc_id", F.size("p").alias("n"), F.posexplode("p").alias("u", "x"))
    case, second, last = F.col("doc_id") % 9, F.col("u") == 1, F.col("u") == F.col("n") - 1
    hit = lambda k: (case == k) & second
    start = F.col("x.start") + F.when(hit(1), 1).when(hit(2), -1).otherwise(0)
    out = rows.select(
        "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.when(hit(4), 0).otherwise(F.col("u")).cast("string")).alias("unit_id"), F.when(hit(3), start + 1).otherwise(start).alias("retrieval_start"), start.alias("core_start"),
        F.when((case == 0) & last, F.col("x.end") - 1).otherwise(F.col("x.end")).alias("core_end"), F.when(hit(5), F.array().cast("array<int>")).when(hit(6), F.array("u", F.lit(0))).when(hit(7), F.array("u", F.lit(10**6))).otherwise(F.array("u")).alias("children"),
        F.when(hit(8), 10**6).otherwise(1).alias("n_tokens"),
    )
    return docs, rows.select("doc_id", F.col("u").alias("chunk_index")), out


@register(
    """WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'gap_at_end' WHEN 1 THEN 'gap' WHEN 2 THEN 'overlapping_cores' WHEN 3 THEN 'overlap_without_owner'
  WHEN 4 THEN 'repeated_id' WHEN 5 THEN 'child_lost' WHEN 6 THEN 'child_twice' WHEN 7 THEN 'unknown_child' ELSE 'too_long' END AS error FROM n WHERE n > CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 1 END"""
)
def unit_errors(spark, d):
    """Lines of the documents as units, damaged in one way each."""
    docs, children, rows = _line_units(spark, d)
    return units.unit_errors(rows, docs, children, limit=10**5)


@register(
    f"""WITH {_BLOCKS}, sib AS (SELECT b.*, lag(ordinal) OVER w AS previous, lead(ordinal) OVER w AS next, max(ordinal) OVER (PARTITION BY doc_id) AS top FROM b WINDOW w AS (PARTITION BY doc_id, parent ORDER BY ordinal)),
e AS (SELECT doc_id, ordinal, CASE WHEN doc_id % 4 = 1 AND ordinal = 1 THEN 'overlap' WHEN doc_id % 4 = 2 AND ordinal = 2 AND previous IS NOT NULL THEN 'sibling' WHEN doc_id % 4 = 3 AND ordinal = top AND NOT regexp_matches(right(content, 1), '[\\x20\\x09-\\x0D]') THEN 'uncovered_tail' END AS error FROM sib)
SELECT * FROM e WHERE error IS NOT NULL"""
)
def block_errors(spark, d):
    """Blocks that begin too early, have lost the block before, or end too early."""
    docs = _markdown(spark, d)
    blocks, case = markdown.siblings(markdown.markdown_blocks(docs)), F.col("doc_id") % 4
    bad = blocks.withColumn("top", F.max("ordinal").over(Window.partitionBy("doc_id"))).select(
        "doc_id", "ordinal", F.col("kind").alias("block_type"), (F.col("start") - F.when((case == 1) & (F.col("ordinal") == 1), 3).otherwise(0)).alias("start"), (F.col("end") - F.when((case == 3) & (F.col("ordinal") == F.col("top")), 1).otherwise(0)).alias("end"), "parent",
        F.when((case != 2) | (F.col("ordinal") != 2), F.col("previous")).alias("previous"), "next",
    )
    return units.block_errors(bad, docs)


@register(
    """WITH t AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations), k AS (SELECT conv_id FROM t WHERE turn = 0)
SELECT id AS unit_id, 'no_back_link' AS error FROM t WHERE conv_id % 4 = 1 AND turn = 1 UNION ALL SELECT t.id, CASE WHEN k.conv_id IS NULL THEN 'unknown_neighbour' ELSE 'crosses_documents' END FROM t LEFT JOIN k ON k.conv_id = t.conv_id + 1 WHERE t.conv_id % 4 = 2 AND turn = top
UNION ALL SELECT id, 'unknown_neighbour' FROM t WHERE conv_id % 4 = 3 AND turn = 1 UNION ALL SELECT id, 'no_back_link' FROM t WHERE conv_id % 4 = 3 AND turn = 0 AND top > 0"""
)
def neighbour_errors(spark, d):
    """Turns linked within their conversation; a forward link lost, one into the next conversation, a backward link to nowhere."""
    t = table(spark, d, "conversations").select("conv_id", "turn")
    t = t.withColumn("top", F.max("turn").over(Window.partitionBy("conv_id"))).withColumn("case", F.col("conv_id") % 4)
    name = lambda c, n: F.concat_ws(":", c.cast("string"), n.cast("string"))
    conv, turn = F.col("conv_id"), F.col("turn")
    before = F.when((F.col("case") == 3) & (turn == 1), "gone").when(turn > 0, name(conv, turn - 1))
    after = F.when((F.col("case") == 1) & (turn == 0), None).when((F.col("case") == 2) & (turn == F.col("top")), name(conv + 1, F.lit(0))).when(turn < F.col("top"), name(conv, turn + 1))
    return units.neighbour_errors(t.select(conv.alias("doc_id"), name(conv, turn).alias("unit_id"), before.alias("previous_id"), after.alias("next_id")))


@register(
    rf"""WITH RECURSIVE t AS (SELECT conv_id AS doc_id, turn::INT AS k, turn + turn // 3 AS o, turn // 4 AS p, length(text) % 5 <> 0 AS ok, {_N.format('text')} AS n FROM conversations),
m AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w AND lag(p) OVER w = p AND o - lag(o) OVER w IN (0, 1) THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY k) AS j FROM r),
f AS (SELECT doc_id, run, j, n AS held, 0 AS unit FROM q WHERE j = 1 UNION ALL SELECT q.doc_id, q.run, q.j, CASE WHEN f.held + q.n <= 120 THEN f.held + q.n ELSE q.n END, CASE WHEN f.held + q.n <= 120 THEN f.unit ELSE f.unit + 1 END FROM f JOIN q ON q.doc_id = f.doc_id AND q.run = f.run AND q.j = f.j + 1)
SELECT doc_id, run, unit, min(k) AS first, max(k) AS last, count(*) AS n, sum(n) AS n_tokens FROM f JOIN q USING (doc_id, run, j) GROUP BY ALL"""
)
def adjacent_units(spark, d):
    """Turns packed with their neighbours; broken by parent, kind, order and budget."""
    turn = F.col("turn").cast("int")
    t = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), turn.alias("chunk_index"), (turn + F.floor(turn / 3)).alias("ordinal"), F.floor(turn / 4).alias("parent"), F.lit("").alias("path"), (F.length("text") % 5 != 0).alias("packable"), (turn > 0).alias("touches"), markdown.token_count(F.col("text")).alias("n_tokens")
    )
    return units.pack_adjacent(t, 120)


_W = r"'[^\x20\x09-\x0D]+'"


@register(
    rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, {_W}) AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS g, regexp_matches(text, '^[\x20\x09-\x0D]') AS lead FROM t),
c AS (SELECT *, unnest(range(0, (len(w) + 349) // 350)) AS k FROM p WHERE len(w) > 0), n AS (SELECT *, k * 350 AS s, least(400, len(w) - k * 350) AS n FROM c),
q AS (SELECT doc_id, k, n, w, g, lead, s, s + n - 1 AS z, s + 254 AS y FROM n)
SELECT doc_id, k AS chunk_index, n AS n_tokens, (coalesce(list_sum(list_transform(w[1:s], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:s + lead::INT], lambda x: length(x))), 0))::BIGINT AS start,
  (coalesce(list_sum(list_transform(w[1:z + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:z + lead::INT], lambda x: length(x))), 0))::BIGINT AS "end", greatest(n - 254, 0) AS beyond, round(greatest(n - 254, 0) / n, 8) AS beyond_share,
  CASE WHEN n > 254 THEN (coalesce(list_sum(list_transform(w[1:y], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:y + lead::INT], lambda x: length(x))), 0))::BIGINT END AS tail_start FROM q"""
)
def legacy_chunks(spark, d):
    return units.legacy_chunks(table(spark, d, "documents").where("text is not null"))


@register(
    r"""WITH t AS (SELECT doc_id, repeat(' ', (doc_id % 7)::INT) || text || repeat(chr(10), (doc_id % 3)::INT) AS text FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS i FROM t),
p AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(regexp_extract(text, '^\s*')) AS a, length(regexp_replace(text, '\s+$', '')) AS z FROM l),
c AS (SELECT doc_id, i - 1 AS line, (greatest(e - length(line), a) - a)::BIGINT AS s, (least(e, z) - a)::BIGINT AS e FROM p) SELECT doc_id, line, CASE WHEN s < e THEN s END AS s, CASE WHEN s < e THEN e END AS e FROM c"""
)
def rebased_intervals(spark, d):
    """Lines of texts with blanks around them, as places in the stripped text."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.expr("repeat(' ', cast(doc_id % 7 AS int))"), F.col("text"), F.expr("repeat('\n', cast(doc_id % 3 AS int))")).alias("text"))
    low, high = F.length(F.regexp_extract("text", r"^\s*", 0)), F.length(F.regexp_replace("text", r"\s+$", ""))
    lines = docs.select(n, low.alias("a"), high.alias("z"), F.posexplode(places(F.col("text"), _LINE)).alias("line", "p"))
    return lines.select("doc_id", "line", units.rebased_interval(F.col("p.start"), F.col("p.end"), F.col("a"), F.col("z")).alias("i")).select("doc_id", "line", "i.s", "i.e")


@register(
    rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ws FROM t),
u AS (SELECT doc_id, length(regexp_extract(text, '^[\x20\x09-\x0D]*')) AS lead, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w), c AS (SELECT *, lead + sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS s FROM u),
a AS (SELECT doc_id, count(*) AS n, sum(s * i)::BIGINT AS starts, sum((s + length(regexp_extract(x, '^[^\x20\x09-\x0D]+'))) * i)::BIGINT AS ends FROM c GROUP BY doc_id) SELECT t.doc_id, coalesce(n, 0) AS n, starts, ends FROM t LEFT JOIN a USING (doc_id)"""
)
def token_places(spark, d):
    """Places of all words of all documents, weighted by their order."""
    p = table(spark, d, "documents").select("doc_id", places(F.coalesce("text", F.lit("")), markdown.WORD).alias("p"))
    total = lambda f: F.when(F.size("p") > 0, F.aggregate(F.transform("p", lambda x, i: x[f].cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x))
    return p.select("doc_id", F.size("p").alias("n"), total("start").alias("starts"), total("end").alias("ends"))
