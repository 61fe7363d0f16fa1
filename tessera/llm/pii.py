"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find emails, IPv4 addresses, card numbers and phone numbers. Beside them
high-recall generators propose spans of the same kinds, which may overlap each other
and the base: written-out emails ("a (at) b dot org"), bracketed addresses, cards
and phones inside longer runs of digits. Boosted trees score a proposal by its form
(digits, checksum, octets, separators, country mark) and its surroundings
(neighbouring signs, words before it).

Labels come from the base rules themselves: a proposal that is a valid base span is
positive; one that is a base match with a failed check, that cuts across a valid
span, or that is a piece of a longer identifier is negative; others, such as a card
in a run of two, have no label and are what the trees decide. All labelled
proposals of all documents count: they are grouped by feature values, and only those
groups reach the driver, at most as many as there are combinations of values. Documents
whose crc32(doc_id as text) mod 5 is 0 don't train the trees; on them the threshold
of each kind is calibrated to a precision of 0.95.

A proposal is added if it reaches its kind's threshold, doesn't touch a base span
and overlaps no better one. Null text is empty. Documents are scored row by row, so
repeated ids are repeated results. Without documents, or positives of a kind in
either fold, nothing is added to the base.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import make_room
from .boosting import Split, compiled, fit_trees, margins, threshold
from .common import hash_remainder, let, materialize

KINDS = ("email", "ip", "card", "phone")

#: Base patterns; a match begins behind the last one or at the start of a run, which is where the leftmost match begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"\x20?(?:\[at\]|\(at\)|\{at\}|<at>|@)\x20?"
_DOT = r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\x20?|\.)"
#: Last labels that make plain "at" and "dot" an address.
_TOP = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us"
GENERATORS = (
    ("email", rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+{_AT}[\p{{L}}\p{{N}}-]{{1,63}}+(?:{_DOT}[\p{{L}}\p{{N}}-]{{1,63}}+){{1,8}}+"),
    ("email", rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+\x20at\x20[\p{{L}}\p{{N}}-]{{1,63}}+(?:\x20dot\x20[\p{{L}}\p{{N}}-]{{1,63}}){{0,4}}\x20dot\x20(?:{_TOP})(?![\p{{L}}\p{{N}}-])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9.]?[0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+|00)[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9])"),
)

#: Words before a span that speak for a kind, or against all.
CUES = (
    (1, r"(?i)\b(?:e-?mail|mail|contact|correo|courriel)\W*$"),
    (2, r"(?i)\b(?:phone|tel|telefon|telephone|tel[eé]fono|mobile|call|fax)\W*$"),
    (3, r"(?i)\b(?:card|visa|mastercard|karte|carte|tarjeta|credit)\W*$"),
    (4, r"(?i)\b(?:ip|host|server|address|addr|from)\W*$"),
    (5, r"(?i)(?:\b(?:token|key|secret|hash|sha|id|uuid|isbn|order|no|nr|version|build)\b\W*|[\"'=][0-9a-fA-F]*)$"),
)
BEFORE, AFTER = 32, 4
PRECISION = 0.95
FOLDS = 5
FEATURES = ("kind", "digits", "luhn", "octets", "plus", "paren", "seps", "left", "right", "cue", "top")


def prefix_sums(numbers: Column) -> Column:
    """Running sums of an array, by doubling: as many steps as its size has binary digits."""

    def step(sums: Column, s: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), s).cast("int"), F.size(sums))
        return F.zip_with(sums, F.slice(F.concat(F.array_repeat(F.lit(0), shift), sums), F.lit(1), F.size(sums)), lambda a, b: a + b)

    return let(numbers, lambda a: F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(a)))), a, step))


def places(text: Column, pattern: str, context: bool = False) -> Column:
    """All matches as structs (start, end, hit), places in code points; with ``context`` also what stands around them."""
    fields = "start int, end int, hit string" + ", before string, after string" * context

    def located(hits: Column) -> Column:
        def build(gaps: Column) -> Column:
            moved = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.slice(F.concat(F.array(F.lit("")), hits), F.lit(1), F.size(hits)), lambda g, h: F.length(g) + F.length(h))
            around = lambda i: [F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after")] if context else []
            return let(prefix_sums(moved), lambda starts: F.transform(hits, lambda h, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(h)).alias("end"), h.alias("hit"), *around(i))))

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), build)).otherwise(F.array().cast(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The checksum of card numbers over a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_OCTETS = rf"^{_OCTET}(?:\D+{_OCTET}){{3}}$"


def passes(kind: str, hit: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return hit.rlike(_OCTETS)
    if kind == "card":
        return let(digits_of(hit), lambda d: F.when(F.length(d).between(16, 19), passes_luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits_of(hit)).between(8, 15)
    return F.lit(True)


def _near(sign: Column) -> Column:
    """Class of a neighbouring sign."""
    return (
        F.when((sign == "") | sign.rlike(r"^\s"), 0).when(sign.rlike(r"^\p{L}"), 3).when(sign.rlike(r"^[0-9]"), 4).when(sign.rlike(r"^[=/#@_\\~^]"), 2).otherwise(1)
    )


def _described(kind: str, c: Column) -> Column:
    """A proposal with its features."""
    hit = c["hit"]

    def described(digits: Column) -> Column:
        n = F.length(digits)
        seps = F.length(F.regexp_replace(hit, r"[\p{L}\p{N}]", ""))
        cue = F.lit(0)
        for code, words in reversed(CUES):
            cue = F.when(c["before"].rlike(words), code).otherwise(cue)
        yes = lambda x: F.when(x, 1).otherwise(0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            F.when(n < 7, 0).when(n < 8, 1).when(n < 10, 2).when(n < 13, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6).alias("digits"),
            (yes(passes_luhn(digits) & n.between(13, 19)) if kind == "card" else F.lit(0)).alias("luhn"),
            (yes(hit.rlike(_OCTETS)) if kind == "ip" else F.lit(0)).alias("octets"),
            yes(hit.rlike(r"^(?:\+|00)")).alias("plus"), yes(hit.rlike(r"\([0-9]")).alias("paren"), F.least(seps, F.lit(4)).alias("seps"),
            _near(F.right(c["before"], F.lit(1))).alias("left"), _near(F.left(c["after"], F.lit(1))).alias("right"), cue.alias("cue"),
            (yes(hit.rlike(r"(?i)(?:\.|dot\W*)[a-z]{2,24}$")) if kind == "email" else F.lit(0)).alias("top"),
        )

    return let(digits_of(hit), described)


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pd_base, pd_failed (kind, start, end) and pd_found, the proposals with their features."""
    docs = make_room(docs, ["pd_base", "pd_failed", "pd_found", "pd_text", *[f"pd_{k}" for k in KINDS]])
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("pd_text", body)
    checked = lambda k: lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), passes(k, m["hit"]).alias("ok"))
    out = out.select("*", *[F.transform(places(F.col("pd_text"), BASE[k]), checked(k)).alias(f"pd_{k}") for k in KINDS])
    span = lambda k: lambda m: F.struct(F.lit(KINDS.index(k)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    of = lambda ok: lambda m: m["ok"] == ok
    sides = [F.concat(*[F.transform(F.filter(f"pd_{k}", of(ok)), span(k)) for k in KINDS]) for ok in (True, False)]
    described = lambda kind: lambda c: _described(kind, c)
    found = F.concat(*[F.transform(places(F.col("pd_text"), pattern, True), described(kind)) for kind, pattern in GENERATORS])
    return out.select(*docs.columns, sides[0].alias("pd_base"), sides[1].alias("pd_failed"), F.array_distinct(found).alias("pd_found"))


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _same(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])


def label_of(c: Column, base: Column, failed: Column) -> Column:
    """1, 0 or null: what the base rules say of a proposal."""
    return (
        F.when(F.exists(base, lambda b: _same(b, c)), 1)
        .when(F.exists(failed, lambda b: _same(b, c)) | F.exists(base, lambda b: _touch(b, c)), 0)
        .when(F.exists(failed, lambda b: (b["kind"] == c["kind"]) & _touch(b, c)), F.lit(None).cast("int"))
        .when((c["left"] >= 3) | (c["right"] >= 3), 0)
    )


@dataclass(frozen=True)
class PiiModel:
    trees: list[Split | float]
    #: Least margin of each kind.
    least: tuple[float, ...]
    #: Labelled proposals of the fold that the trees haven't seen: positive and negative, above the threshold and below.
    held_out: dict[str, tuple[int, int, int, int]]


def train_pii(proposed: DataFrame, doc_id: str = "doc_id", precision: float = PRECISION) -> PiiModel:
    """Trees and thresholds from all labelled proposals, grouped by their features."""
    labelled = proposed.select((hash_remainder(F.col(doc_id), FOLDS) == 0).alias("held"), F.explode(F.transform("pd_found", lambda c: F.struct(*[c[f].alias(f) for f in FEATURES], label_of(c, F.col("pd_base"), F.col("pd_failed")).alias("label")))).alias("c"))
    groups = labelled.where("c.label is not null").groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.sum("c.label").alias("p"), F.sum(1 - F.col("c.label")).alias("n")).orderBy("held", *FEATURES).collect()
    names = list(FEATURES)

    def arrays(rows):
        return np.array([[r[f] for f in names] for r in rows], dtype=int).reshape(-1, len(names)), np.array([r["p"] for r in rows], float), np.array([r["n"] for r in rows], float)

    x, p, n = arrays([r for r in groups if not r["held"]])
    trees = fit_trees(names, x, p, n)
    x, p, n = arrays([r for r in groups if r["held"]])
    margin, least, held = margins(trees, names, x), [], {}
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        least.append(threshold(margin[own], p[own], n[own], precision) if trees else float("inf"))
        above = margin[own] >= least[-1]
        held[kind] = tuple(int(v) for v in (p[own][above].sum(), n[own][above].sum(), p[own][~above].sum(), n[own][~above].sum()))
    return PiiModel(trees, tuple(least), held)


def select_spans(proposed: DataFrame, model: PiiModel) -> DataFrame:
    """``proposed`` with pd_spans (kind, start, end, score, base) in the order of kinds and starts instead of the proposals."""
    fields = lambda c, score, base: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score.alias("score"), F.lit(base).alias("base"))
    least = F.array(*[F.lit(float(v)) for v in model.least])
    scored = F.transform(F.filter("pd_found", lambda c: ~F.exists("pd_base", lambda b: _touch(b, c))), lambda c: fields(c, compiled(model.trees, lambda f: c[f]), False))
    fine = F.filter(scored, lambda c: c["score"] >= F.get(least, c["kind"]))
    rank = lambda c: F.struct(-c["score"], c["start"] - c["end"], c["start"], c["kind"])  # noqa: E731  the better, longer, earlier one first
    best = let(F.array_distinct(fine), lambda cs: F.filter(cs, lambda c: ~F.exists(cs, lambda o: _touch(o, c) & (rank(o) < rank(c)))))
    kept = F.transform(F.col("pd_base"), lambda b: fields(b, F.lit(1.0), True))
    others = [c for c in proposed.columns if c not in ("pd_found", "pd_failed", "pd_base")]
    out = proposed.select(*others, "pd_base", best.alias("pd_best"))
    return out.select(*others, "pd_base", F.array_sort(F.concat(kept, F.transform("pd_best", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (F.lit(1.0) / (1 + F.exp(-c["score"]))).alias("score"), c["base"].alias("base"))))).alias("pd_spans"))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with pd_base and pd_spans; input columns of these names are kept as ``<name>_in``."""
    proposed = materialize(propose(docs, text), "pii-proposed")
    return select_spans(proposed, train_pii(proposed, doc_id))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier, then the longer one counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform("pd_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    add = lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.array(F.substr(body, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("out"), (-s["back"]).alias("at"))).otherwise(a)
    done = F.aggregate(ordered, start, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(body, a["at"] + 1)))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), done))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_table(docs: DataFrame) -> DataFrame:
    proposed = materialize(propose(docs.select("doc_id", "text")).drop("text"), "pii-proposed")
    out = select_spans(proposed, train_pii(proposed))
    of = lambda k: lambda b: b["kind"] == k
    counts = [F.size(F.filter("pd_base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(span_text(F.col("pd_base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("pd_spans")).alias("spans"))
