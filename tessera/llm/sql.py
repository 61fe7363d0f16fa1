"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, MIN_AGREEMENT, rare_index
from .quality_rules import RULES, STOP_WORDS, SYMBOLS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"


def _license() -> str:
    index = rare_index()
    words = ", ".join(f"({k}, '{w}', {p}, {idf!r}::DOUBLE)" for k, (_, _, ws) in enumerate(index) for w, p, idf in ws)
    rules = ", ".join(f"({k}, '{label}', {sum(i for _, _, i in ws)!r}::DOUBLE)" for k, (label, _, ws) in enumerate(index))
    phrases = ", ".join(f"({k}, ' {p} ')" for k, (_, ps, _) in enumerate(index) for p in ps)
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i FROM pos WHERE " + " AND ".join(f"w[i + {k + 1}] = '{part}'" for k, part in enumerate(phrase.split())) for phrase, label in BASE_PHRASES
    )
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
n AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS norm FROM d),
pos AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d WHERE list_contains(w, 'license')),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM base GROUP BY doc_id),
idx(k, word, p, idf) AS (VALUES {words}), tpl(k, label, total) AS (VALUES {rules}), ph(k, phrase) AS (VALUES {phrases}),
hits AS (SELECT doc_id, k, i - p AS start, sum(idf) AS mass FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d) JOIN idx USING (word) GROUP BY ALL),
ready AS (SELECT doc_id, k FROM n, ph GROUP BY doc_id, k HAVING bool_and(contains(norm, phrase))),
share AS (SELECT doc_id, label, round(least(1.0, max(mass) / any_value(total)), 6) AS share FROM hits JOIN ready USING (doc_id, k) JOIN tpl USING (k) GROUP BY doc_id, k, label),
m AS (SELECT doc_id, list(DISTINCT label) FILTER (share >= {MIN_AGREEMENT}) AS ls, max(share) AS score FROM share GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.ls, []) || coalesce(m.ls, []))), ',') AS labels, greatest(coalesce(m.score, 0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


def _quality() -> str:
    value = {
        "mean_word_length": "(word_chars / nullif(n_words, 0))", "symbol_ratio": "(n_symbols / nullif(n_words, 0))",
        "stop_word_ratio": "(n_stop / nullif(n_words, 0))", "dup_line_ratio": "(n_dup_lines / nullif(n_lines, 0))",
    }
    tests = []
    for rule in RULES:
        v = f"coalesce({value[rule.name]}, 0)"
        tests += [f"{v} >= {rule.low}"] if rule.low is not None else []
        tests += [f"{v} <= {rule.high}"] if rule.high is not None else []
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f"""


_CONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS m FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k FROM n, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN win USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, m)) AS j) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

# Bytes as pairs of hexadecimal digits.
_SUFFIXES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM d, LATERAL (SELECT unnest(range(0, n - 199)) AS s) WHERE n >= 200),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
mark AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM rep),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM mark) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q, b FROM runs),
kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) || substr(any_value(x), 2 * max(b) + 1) AS x, count(*) AS n_spans FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, d.n - length(coalesce(kept.x, d.x)) // 2 AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, greatest(length(coalesce(text, '')), 1) AS chars,
  len(regexp_extract_all(coalesce(text, ''), '[0-9#*$%&|<>{{}}\\[\\]=_~^\\\\/@]')) AS odd, ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.1::DOUBLE, (1 - odd::DOUBLE / chars) * least(1.0::DOUBLE, size / 20.0::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS r FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
lv AS (SELECT arg_min(level, r) AS level FROM l WHERE weight * level <= 3 * source_size),
g AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * coalesce((SELECT level FROM lv), 1e300)) AS target FROM s),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM g),
run AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER w AS run, row_number() OVER w AS r FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
  WINDOW w AS (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, max(CASE WHEN run <= rest THEN r END) OVER (PARTITION BY source) AS cut, rest - coalesce(max(CASE WHEN run <= rest THEN run END) OVER (PARTITION BY source), 0) AS over FROM run),
p AS (SELECT source, arg_max(CASE WHEN size > 0 AND size <= over THEN r END, (size, -key, doc_id)) FILTER (size > 0 AND size <= over) AS fill, max(CASE WHEN size > 0 AND size <= over THEN size END) AS filled,
  min(r) FILTER (run > rest) AS nxt, min(run - rest) FILTER (run > rest) AS too_much, any_value(over) AS over FROM c WHERE r > coalesce(cut, 0) GROUP BY source),
z AS (SELECT source, CASE WHEN too_much < over - coalesce(filled, 0) THEN nxt ELSE fill END AS fill FROM p)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * least(3, epochs + CASE WHEN rest > 0 AND (r <= coalesce(cut, 0) OR r = fill) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN z ON c.source IS NOT DISTINCT FROM z.source"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UP}', '{_LOW}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

# crc32 of the decimal id, bit by bit; nodes are known by the list of their turns' digests.
_TRIE = """WITH t AS (SELECT conv_id, coalesce(text, '') AS x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, length(x) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
  lambda a, v: list_reduce(list_prepend(xor(a, v), range(8)), lambda p, q: xor(p // 2, 3988292384 * (p % 2)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, k, chars, i FROM c JOIN o ON o.conv_id = c.b AND o.i <= c.h UNION ALL SELECT c.conv_id, k, chars, i FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
w AS (SELECT conv_id, list(k ORDER BY i) AS ks, list(chars ORDER BY i) AS cs FROM r GROUP BY conv_id),
f AS (SELECT c.conv_id, coalesce(ks, []) AS ks, coalesce(cs, []) AS cs FROM c LEFT JOIN w USING (conv_id)),
p AS (SELECT conv_id, d, ks[1:d] AS path, coalesce(cs[d], 0) AS chars, d = len(ks) AS ended FROM f, LATERAL (SELECT unnest(range(0, len(ks) + 1)) AS d)),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM p GROUP BY path),
up AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN up USING (path)),
s AS (SELECT path[1:j] AS path, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM m, LATERAL (SELECT unnest(range(0, depth + 1)) AS j) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n q ON m.depth > 0 AND q.path = m.path[1:m.depth - 1]"""

SQL: dict[str, str] = {
    "op3_license_scan": _license(),
    "op4_quality_rules": _quality(),
    "op7_decontaminate": _CONTAMINATION,
    "op8_suffix_dedup": _SUFFIXES,
    "op9_source_mix": _MIX,
    "op10_line_dedup": _LINES,
    "op13_prefix_trie": _TRIE,
}
