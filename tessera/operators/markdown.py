"""Markdown documents to blocks, children and retrieval units, in array expressions within each row: nothing is shuffled.

The subset: ATX and setext headings, fences (closed by the same sign, as long or
longer), quotes with lazy lines, lists (which a blank line ends unless another item
follows, and a line of = below a lazy line), pipe tables and HTML at a block's start, indented code, thematic breaks,
paragraphs. A line is classed by itself; blocks begin at marked lines, and a marked
line is judged by the marked line before it only. A block ends before its last line
end. Null text has no blocks.

Sizes are numbers of words unless another counter column function is given; it has
to add up over parts that meet at white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import greedy_bins, running_max, running_sum
from ..functions.text import identity, let, token_count

UNIT_TOKENS = 254
EOL = r"\r\n|\r|\n"
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, the first one also with that before it.
_SPACED = r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Blocks that stand alone; so do headings of level 1.
BARRIERS = ("code", "fenced_code", "table", "blockquote", "html", "thematic_break")

_FENCE = r"^ {0,3}(`{3,}|~{3,})"
_ITEM = r"^ {0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]"
_RULER = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
#: Class of a line by itself; the first that fits.
_CLASSES = (
    ("blank", r"^[ \t\f\x0B]*$"), ("fence", _FENCE), ("heading", r"^ {0,3}#{1,6}(?:[ \t]|$)"), ("rule", r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$"),
    ("quote", r"^ {0,3}>"), ("item", _ITEM), ("indent", r"^(?: {4}|\t)"),
)
#: What a line of one of these classes begins with.
_MARKED = r"^(?: {0,3}[`~#_*>+0-9-]| {4}|\t|[ \t\f\x0B]*$)"
_UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t]*$"


def _lines(text: Column) -> Column:
    """(s, e, t, z, c): place of each line without its end, the line, its end, its class."""

    def built(parts: Column) -> Column:
        ended = F.slice(F.zip_with(parts, F.regexp_extract_all(text, F.lit(EOL), F.lit(0)), lambda t, z: F.struct(t.alias("t"), F.coalesce(z, F.lit("")).alias("z"))), F.lit(1), F.size(parts))

        def classed(t: Column) -> Column:
            c = F.when(t == "", "blank").when(~t.rlike(_MARKED), "text")
            for name, pattern in _CLASSES:
                c = c.when(t.rlike(pattern), name)
            return c.otherwise("text")

        def placed(lines: Column) -> Column:
            ends = running_sum(F.transform(lines, lambda x: F.length(x["t"]) + F.length(x["z"])))
            line = lambda x, end: F.struct((end - F.length(x["z"]) - F.length(x["t"])).alias("s"), (end - F.length(x["z"])).alias("e"), x["t"].alias("t"), x["z"].alias("z"), classed(x["t"]).alias("c"))
            return F.zip_with(lines, ends, line)

        return let(ended, placed)

    parts = F.split(text, EOL, -1)
    return let(let(parts, lambda p: F.when(F.try_element_at(p, F.lit(-1)) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)), built)


def _fenced(lines: Column) -> Column:
    """The classes of ``lines``, with open for a line that opens a fence and in for the lines up to its close."""
    sign = lambda x: F.regexp_extract(x["t"], _FENCE, 1)

    def state(a: Column, x: Column) -> Column:
        own = sign(x)
        closes = (a["sign"] != "") & F.startswith(own, a["sign"]) & x["t"].rlike(_FENCE + r"[ \t]*$")
        now = F.when(a["sign"] == "", own).when(closes, "").otherwise(a["sign"])
        return F.struct(F.concat(a["out"], F.array(F.when(a["sign"] == "", 1).when(closes, 3).otherwise(2))).alias("out"), now.alias("sign"))

    roles = F.aggregate(F.filter(lines, lambda x: x["c"] == "fence"), F.struct(F.array().cast("array<int>").alias("out"), F.lit("").alias("sign")), state, lambda a: a["out"])

    def marked(r: Column, count: Column) -> Column:
        role = lambda x, last: F.when(x["c"] == "fence", F.when(last == 1, "open").otherwise("in")).when(last.isin(1, 2), "in").otherwise(x["c"])
        return F.zip_with(lines, count, lambda x, n: role(x, F.get(r, n - 1)))

    count = running_sum(F.transform(lines, lambda x: F.when(x["c"] == "fence", 1).otherwise(0)))
    return F.when(F.exists(lines, lambda x: x["c"] == "fence"), let(roles, lambda r: let(count, lambda n: marked(r, n)))).otherwise(F.transform(lines, lambda x: x["c"]))


def _solid(lines: Column) -> Column:
    """(i, c, gap) of the lines that are not blank: place among all lines, class with setext underlines marked, whether a blank line stands before.

    The lines themselves stay where they are: what a lambda hands on is copied.
    """
    kept = F.filter(F.transform(_fenced(lines), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"] != "blank")

    def marked(k: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before = F.get(k, j - 1)
            gap = (j == 0) | (before["i"] < x["i"] - 1)
            c = F.when(x["c"].isin("text", "rule") & ~gap & (before["c"] == "text") & F.get(lines, x["i"])["t"].rlike(_UNDERLINE), "under").otherwise(x["c"])
            return F.struct(x["i"].alias("i"), c.alias("c"), gap.alias("gap"))

        return F.transform(k, one)

    return let(kept, marked)


def _markers(lines: Column, solid: Column) -> Column:
    """(k, c, gap) of the solid lines that begin a block.

    Text behind an indented line (late) begins one only behind code, and a line that could underline a heading (under) only outside a paragraph.
    """
    text_of = lambda x: F.get(lines, x["i"])["t"]

    def one(x: Column, k: Column) -> Column:
        before, after, t = F.coalesce(F.get(solid, k - 1)["c"], F.lit("")), F.get(solid, k + 1), text_of(x)
        hard = x["gap"] & (x["c"] != "in") | before.isin("heading", "rule", "under") | (before.isin("open", "in") & (x["c"] != "in"))
        table = F.contains(t, F.lit("|")) & F.coalesce(~after["gap"] & F.contains(text_of(after), F.lit("|")) & text_of(after).rlike(_RULER), F.lit(False))
        plain = F.when(table, "table").when(t.rlike(r"^ {0,3}<[A-Za-z/!?]"), "html").otherwise("paragraph")
        c = (
            F.when(x["c"] == "open", "fenced_code").when(x["c"] == "in", None).when(x["c"] == "heading", "heading").when(x["c"] == "rule", "thematic_break").when(x["c"] == "quote", "blockquote")
            .when(x["c"] == "item", "list").when(x["c"] == "under", "under").when(hard, F.when(x["c"] == "indent", "code").otherwise(plain)).when((before == "indent") & (x["c"] != "indent"), "late")
        )
        return F.struct(k.alias("k"), c.alias("c"), x["gap"].alias("gap"))

    marked = F.filter(F.transform(solid, one), lambda m: m["c"].isNotNull())
    rule = lambda x: text_of(F.get(solid, x["k"])).rlike(_CLASSES[3][1])

    def settle(x: Column, before: Column) -> Column:
        c = F.when(x["c"] == "late", F.when(before == "code", "paragraph")).when(x["c"] == "under", F.when(before.isin("list", "blockquote", "html", "table") & rule(x), "thematic_break")).otherwise(x["c"])
        return F.struct(x["k"].alias("k"), c.alias("c"), x["gap"].alias("gap"))

    unsettled = lambda m: F.exists(m, lambda x: x["c"].isin("late", "under"))
    settled = let(marked, lambda m: F.when(unsettled(m), F.filter(F.transform(m, lambda x, j: settle(x, F.get(m, j - 1)["c"])), lambda x: x["c"].isNotNull())).otherwise(m))

    def begins(m: Column) -> Column:
        def goes_on(x: Column, j: Column) -> Column:
            before = F.coalesce(F.get(m, j - 1)["c"], F.lit(""))
            return x["c"].isin("list", "blockquote") & (x["c"] == before) & ((x["c"] == "list") | ~x["gap"])

        return F.filter(m, lambda x, j: ~goes_on(x, j))

    return let(settled, begins)


def heading_label(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^ {0,3}#{1,6}(?:[ \t]+|$)", ""), r"(?:^|[ \t]+)#+[ \t]*$", ""))


def _blocks(text: Column) -> Column:
    """(kind, start, end, line, level, label, content) of a document's blocks; a content is put together from its lines, as cutting it out would read the text up to it."""

    def built(lines: Column, solid: Column) -> Column:
        def one(b: Column, after: Column) -> Column:
            begin, close = F.get(solid, b["k"]), F.get(solid, F.coalesce(after["k"], F.size(solid)) - 1)
            first, last = F.get(lines, begin["i"]), F.get(lines, close["i"])
            under = (b["c"] == "paragraph") & (close["c"] == "under")
            level = F.when(b["c"] == "heading", F.length(F.regexp_extract(first["t"], "(#+)", 1))).when(under, F.when(F.contains(last["t"], F.lit("=")), 1).otherwise(2)).otherwise(0)
            label = F.when(b["c"] == "heading", heading_label(first["t"])).when(under, F.trim(first["t"]))
            above = F.transform(F.slice(lines, begin["i"] + 1, close["i"] - begin["i"]), lambda x: F.concat(x["t"], x["z"]))
            content = F.when(begin["i"] == close["i"], first["t"]).otherwise(F.concat(F.array_join(above, ""), last["t"]))
            return F.struct(
                F.when(under, "heading").otherwise(b["c"]).alias("kind"), first["s"].alias("start"), last["e"].alias("end"), (begin["i"] + 1).alias("line"), level.alias("level"), label.alias("label"), content.alias("content"),
            )

        return let(_markers(lines, solid), lambda m: F.transform(m, lambda b, j: one(b, F.get(m, j + 1))))

    # The lines are used in many places of what follows, and each would work them out again.
    return let(_lines(text), lambda lines: let(_solid(lines), lambda solid: built(lines, solid)))


def _paths(headings: Column) -> Column:
    """For each heading the headings above it and itself, outermost first: those before it that no later heading of their level or a lower one has ended."""
    kind = "array<struct<ordinal:int,level:int,label:string>>"

    def step(a: Column, h: Column) -> Column:
        return let(F.concat(F.filter(a["open"], lambda x: x["level"] < h["level"]), F.array(h)), lambda path: F.struct(F.concat(a["out"], F.array(path)).alias("out"), path.alias("open")))

    return F.aggregate(headings, F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(kind).alias("open")), step, lambda a: a["out"])


def _exploded(rows: DataFrame, array: str, place: str, name: str) -> DataFrame:
    """One row an element. The outer form keeps the optimizer from writing the array's expression into a filter below, where each use of a column would be spelled out again."""
    return rows.select("*", F.posexplode_outer(array).alias(place, name)).where(F.col(place).isNotNull())


def markdown_blocks(docs: DataFrame, text: str = "text", name: Column | None = None) -> DataFrame:
    """One row a block: (doc_id, ordinal, kind, start, end, line, level, heading_path, parent, title, content).

    The path holds a heading's own label too; ``parent`` is the ordinal of the heading
    above. The title is the first heading of level 1, else ``name`` (the id).
    """
    name = F.col("doc_id").cast("string") if name is None else name
    out = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"), name.alias("_n"))
    out = out.select("doc_id", "_n", _blocks(F.col("_t")).alias("_b"))
    heading = lambda b, i: F.when(b["kind"] == "heading", F.struct(i.alias("ordinal"), b["level"].alias("level"), b["label"].alias("label")))
    out = out.withColumn("_h", F.filter(F.transform("_b", heading), lambda h: h.isNotNull()))
    out = out.withColumn("_p", F.concat(F.array(F.array().cast("array<struct<ordinal:int,level:int,label:string>>")), _paths(F.col("_h"))))
    out = out.withColumn("title", F.coalesce(F.get(F.filter("_h", lambda h: h["level"] == 1), F.lit(0))["label"], F.col("_n")))

    def section(path: Column, i: Column) -> Column:
        """The blocks from a heading to the next; those before all headings have an empty path."""
        begin, until = F.coalesce(F.try_element_at(path, F.lit(-1))["ordinal"], F.lit(0)), F.coalesce(F.get(F.col("_h"), i)["ordinal"], F.size("_b"))

        def one(b: Column, j: Column, labels: Column) -> Column:
            above = F.when(b["kind"] == "heading", F.get(path, F.size(path) - 2)).otherwise(F.get(path, F.size(path) - 1))
            return F.struct((begin + j).alias("ordinal"), *[b[c].alias(c) for c in ("kind", "start", "end", "line", "level")], labels.alias("heading_path"), above["ordinal"].alias("parent"), b["content"].alias("content"))

        return let(F.transform(path, lambda x: x["label"]), lambda labels: F.transform(F.slice("_b", begin + 1, until - begin), lambda b, j: one(b, j, labels)))

    # A row carries its own block only, not what its document has beside it.
    rows = _exploded(out.select("doc_id", "title", F.flatten(F.transform("_p", section)).alias("_x")), "_x", "_at", "b")
    return rows.select("doc_id", *[F.col(f"b.{c}").alias(c) for c in ("ordinal", "kind", "start", "end", "line", "level", "heading_path", "parent")], "title", F.col("b.content").alias("content"))


def siblings(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the ordinals before and after under one parent."""
    order = Window.partitionBy("doc_id", "parent").orderBy("ordinal")
    return blocks.withColumn("previous", F.lag("ordinal").over(order)).withColumn("next", F.lead("ordinal").over(order))


def is_barrier(kind: Column, level: Column) -> Column:
    return kind.isin(*BARRIERS) | (kind == "heading") & (level == 1)


def path_size(title: Column, path: Column, count: Callable[[Column], Column] = token_count) -> Column:
    """What the title and the heading path add to a part's size when it is written out."""
    return count(title) + count(F.array_join(path, " > "))


def _runs_of(pieces: Column, room: Column, begin: Column) -> Column:
    """(first, last, a, b, size) of runs of (t, n) that follow each other, filled up to ``room``; a and b are places, counted from ``begin``."""
    bins = greedy_bins(F.transform(pieces, lambda p: p["n"]), room)
    return let(running_sum(F.transform(pieces, lambda p: F.length(p["t"]))), lambda ends: F.transform(bins, lambda b: F.struct(
        b["first"].alias("first"), b["last"].alias("last"), (begin + F.coalesce(F.get(ends, b["first"] - 1), F.lit(0))).alias("a"), (begin + F.get(ends, b["last"])).alias("b"), b["size"].alias("size"),
    )))


def split_blocks(blocks: DataFrame, limit: int = UNIT_TOKENS, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Children: (doc_id, ordinal, part, kind, level, heading_path, title, start, end, policy, n_tokens, before, after, overflow, core_start, core_end, content, own_tokens).

    A block within the limit is one child. A longer one is split at list items, fence
    lines, table rows or sentences, and a sentence beyond the limit at words; parts are
    filled greedily. A fence's markers and a table's head are repeated: ``before`` and
    ``after`` hold them, and the block's first and last part have them in their core. What cannot be split is a child with its reason in ``overflow``.
    """
    kind, body, none = F.col("kind"), F.col("content"), F.array().cast("array<string>")
    sized = blocks.withColumn("_own", count(body)).withColumn("_head", path_size(F.col("title"), F.col("heading_path"), count)).withColumn("_big", F.col("_own") + F.col("_head") > limit)
    # The pieces are texts that follow each other: cutting each out of the block would read the block up to it.
    pieces = (
        F.when(kind == "list", F.filter(F.split(body, f"(?m)(?={_ITEM})", -1), lambda p: p != "")).when(kind.isin("fenced_code", "table"), F.regexp_extract_all(body, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)))
        .when(kind == "paragraph", F.regexp_extract_all(body, F.lit(r"(?s).*?[.!?]\s+|.+"), F.lit(0))).otherwise(none)
    )
    sized = sized.withColumn("_u", F.when(F.col("_big"), pieces).otherwise(none))
    n = F.size("_u")
    closed = (kind == "fenced_code") & (n > 1) & F.try_element_at(F.col("_u"), F.lit(-1)).rlike(r"^ {0,3}(?:`{3,}|~{3,})[ \t]*$")
    front = F.when(kind == "fenced_code", 1).when((kind == "table") & (n > 1), 2).otherwise(0)
    sized = sized.withColumn("_front", front).withColumn("_back", F.when(closed, 1).otherwise(0))
    text_of = lambda u: F.when(F.col("_big"), F.array_join(u, ""))
    sized = sized.withColumn("before", text_of(F.slice("_u", F.lit(1), F.col("_front")))).withColumn("after", text_of(F.slice("_u", n - F.col("_back") + 1, F.col("_back"))))
    sized = sized.withColumn("_room", F.when(F.col("_big"), F.lit(limit) - F.col("_head") - count(F.col("before")) - count(F.col("after"))))
    counted = lambda t: F.struct(t.alias("t"), count(t).alias("n"))
    runs = lambda t: let(F.regexp_extract_all(t, F.lit(_SPACED), F.lit(0)), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.col("_room")), lambda i: counted(F.array_join(F.slice(w, i + 1, F.col("_room")), "")))).otherwise(F.array(counted(t))))
    units = F.transform(F.slice("_u", F.col("_front") + 1, F.greatest(n - F.col("_front") - F.col("_back"), F.lit(0))), counted)
    units = F.when(kind == "paragraph", F.flatten(F.transform(units, lambda u: F.when(u["n"] > F.col("_room"), runs(u["t"])).otherwise(F.array(u))))).otherwise(units)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.length(body).alias("b"), F.col("_own").alias("size"), body.alias("content")))
    filled = lambda u: let(_runs_of(u, F.col("_room"), F.length("before")), lambda b: F.transform(b, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["size"].alias("size"), F.array_join(F.transform(F.slice(u, x["first"] + 1, x["last"] - x["first"] + 1), lambda p: p["t"]), "").alias("content"))))
    hopeless = F.col("_big") & ((n <= F.col("_front") + F.col("_back")) | (F.col("_room") <= 0))
    rows = sized.withColumn("_no", hopeless).withColumn("_x", F.when(~F.col("_big") | F.col("_no"), whole).otherwise(let(units, filled)))
    kept = [*["doc_id", "ordinal", "kind", "level", "heading_path", "title", "start", "end", "before", "after"], "_own", "_head", "_big", "_no", "_room"]
    rows = _exploded(rows.select(*kept, (F.size("_x") - 1).alias("_last"), "_x"), "_x", "part", "x")
    split_up = F.col("_big") & ~F.col("_no")
    too_long = F.when(F.col("_no"), "indivisible").when(split_up & (F.col("x.size") > F.col("_room")), "part too long")
    return rows.select(
        "doc_id", "ordinal", "part", "kind", "level", "heading_path", "title", (F.col("start") + F.col("x.a")).alias("start"), (F.col("start") + F.col("x.b")).alias("end"),
        F.when(split_up, F.concat(kind, F.lit("-parts"))).otherwise("intact").alias("policy"), (F.col("x.size") + F.lit(limit) - F.when(split_up, F.col("_room")).otherwise(F.lit(limit) - F.col("_head"))).alias("n_tokens"),
        F.when(split_up, F.col("before")).alias("before"), F.when(split_up, F.col("after")).alias("after"), too_long.alias("overflow"),
        F.when(F.col("part") == 0, F.col("start")).otherwise(F.col("start") + F.col("x.a")).alias("core_start"), F.when(F.col("part") == F.col("_last"), F.col("end")).otherwise(F.col("start") + F.col("x.b")).alias("core_end"),
        F.col("x.content").alias("content"), (F.col("x.size") + F.when(split_up & (F.col("part") == 0), count(F.col("before"))).otherwise(0) + F.when(split_up & (F.col("part") == F.col("_last")), count(F.col("after"))).otherwise(0)).alias("own_tokens"),
    )


def pack_units(children: DataFrame, limit: int = UNIT_TOKENS, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Retrieval units: (doc_id, unit, unit_id, first, last, core_start, core_end, barrier, breadcrumb, core_tokens, n_tokens, overlap_start, overlap_words, title).

    One document's children in one row. Between barriers they are filled greedily;
    a barrier's parts are units of their own. A unit that has room carries as many
    words to its left as fit, back to the barrier before it, with the breadcrumb
    of the place where they begin; they never begin inside a heading. The breadcrumb is
    the heading path without the title and without a heading that the unit begins with.
    """
    crumb = F.filter(F.when(F.col("kind") == "heading", F.slice("heading_path", F.lit(1), F.size("heading_path") - 1)).otherwise(F.col("heading_path")), lambda x: x != F.col("title"))
    rows = children.withColumn("_crumb", crumb).withColumn("_head", path_size(F.col("title"), crumb, count)).withColumn("_bar", is_barrier(F.col("kind"), F.col("level")))
    # No overlap begins in a barrier, so its text isn't sent.
    rows = rows.withColumn("_text", F.when(~F.col("_bar"), F.col("content")))
    fields = F.struct("ordinal", "part", "start", "core_start", "core_end", "own_tokens", "_crumb", "_head", "_bar", "kind", "_text")
    docs = rows.groupBy("doc_id").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(fields)).alias("c"))
    # A barrier costs more than any budget, so the fold closes the bin before and behind it.
    cost = F.transform("c", lambda x: F.when(x["_bar"], limit + 1).otherwise(x["own_tokens"]))
    docs = docs.withColumn("bins", greedy_bins(cost, F.lit(limit), F.transform("c", lambda x: x["_head"])))
    docs = docs.withColumn("words", running_sum(F.transform("c", lambda x: x["own_tokens"]))).withColumn("wall", running_max(F.transform("c", lambda x, i: F.when(x["_bar"], i).otherwise(-1))))
    child, through = lambda i: F.get("c", i), lambda i: F.get("words", i)
    since = lambda i: through(i) - child(i)["own_tokens"]  # noqa: E731  words before child i

    def packed(b: Column) -> Column:
        first, last, head, tail = b["first"], b["last"], child(b["first"]), child(b["last"])
        core_tokens = F.when(head["_bar"], head["own_tokens"] + head["_head"]).otherwise(b["size"])

        def reach(i: Column) -> Column:
            """Where an overlap that begins in child i may begin: its place among the document's words."""
            x = child(i)
            begin = F.greatest(since(i), through(last) - (limit - x["_head"]))
            begin = F.when((x["kind"] == "heading") & (begin > since(i)), through(i)).otherwise(begin)
            return F.struct(begin.alias("w"), i.alias("i"), (begin < through(i)).alias("ok"))

        def with_overlap(o: Column) -> Column:
            source, at = child(o["i"]), o["w"] - since(o["i"])
            lead = F.coalesce(source, head)
            return F.struct(
                F.struct(head["ordinal"].alias("ordinal"), head["part"].alias("part")).alias("first"), F.struct(tail["ordinal"].alias("ordinal"), tail["part"].alias("part")).alias("last"), head["core_start"].alias("core_start"), tail["core_end"].alias("core_end"),
                head["_bar"].alias("barrier"), lead["_crumb"].alias("breadcrumb"), core_tokens.alias("core_tokens"), F.when(o.isNull(), core_tokens).otherwise(through(last) - o["w"] + lead["_head"]).alias("n_tokens"),
                F.when(o.isNotNull(), source["start"] + _word_start(source["_text"], at)).alias("overlap_start"), F.when(o.isNotNull(), since(first) - o["w"]).otherwise(0).alias("overlap_words"),
            )

        low = F.greatest(F.coalesce(F.get("wall", first), F.lit(-1)) + 1, first - limit)
        roomy = ~head["_bar"] & (core_tokens <= limit) & (low < first)
        return let(F.when(roomy, F.array_min(F.filter(F.transform(F.sequence(low, first - 1), reach), lambda r: r["ok"]))), with_overlap)

    # A row carries its own unit only, not the children of its document.
    units = _exploded(docs.select("doc_id", "title", F.transform("bins", packed).alias("_x")), "_x", "unit", "u")
    core = F.struct("doc_id", F.coalesce("u.overlap_start", "u.core_start").alias("from"), F.col("u.core_start").alias("start"))
    return units.select("doc_id", "unit", identity("unit", core).alias("unit_id"), *[F.col(f"u.{c}").alias(c) for c in ("first", "last", "core_start", "core_end", "barrier", "breadcrumb", "core_tokens", "n_tokens", "overlap_start", "overlap_words")], "title")


def _word_start(text: Column, n: Column) -> Column:
    """Where word ``n`` of a text begins, counted from 0; null if there is none."""
    lead = F.length(F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0))
    return F.when(n == 0, F.when(lead < F.length(text), lead)).otherwise(let(F.regexp_extract_all(text, F.lit(_SPACED), F.lit(0)), lambda w: F.when(n < F.size(w), F.length(F.array_join(F.slice(w, F.lit(1), n), "")))))


def unit_texts(units: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``units`` with what is indexed: title, breadcrumb and the text from the overlap to the core's end."""
    begin = F.coalesce("overlap_start", "core_start")
    body = F.substr("_t", begin + 1, F.col("core_end") - begin)
    out = units.join(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")), "doc_id")
    return out.withColumn("retrieval_text", F.concat("title", F.lit("\n"), F.array_join("breadcrumb", " > "), F.lit("\n\n"), body)).drop("_t")
