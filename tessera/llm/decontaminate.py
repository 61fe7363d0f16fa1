"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton accepts every run of words of every benchmark item. Documents are
streamed through it; after each word the state and the length of the longest
match that ends there are known. A match of ``window`` words (or of a whole item
that is shorter) is a hit, and the item set of the state tells which items it
belongs to. Runs of hit words are spans; they are cut out, and a document whose
hit share exceeds ``max_coverage`` is marked for removal as a whole.

Benchmark texts are read in shards of bounded size, so the automaton that is
sent out is bounded too; each shard is one pass over the documents.

Null and empty texts have no words and are clean. Items without words never
match. Repeated items count once per id. A null item id stands for no id: its
windows hit, but it is not listed.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import append_columns
from .common import materialize

WINDOW = 10
MAX_COVERAGE = 0.5
SHARD_BYTES = 4 << 20
_MANY = -(1 << 31)  # no token

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_list(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and all non-ASCII characters."""
    return _WORD.findall((text or "").encode().lower())


class SuffixAutomaton:
    """Generalised over items; a separator of its own follows each item, so no match crosses two."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, owner = [-1], [0], [-1]
        self.names = [name for name, _ in items]
        last = 0
        for k, (_, words) in enumerate(items):
            for token in [self.vocab.setdefault(w, len(self.vocab)) for w in words] + [-1 - k]:
                last = self._extend(last, token, k, owner)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        found: dict[int, set[int]] = {}
        for state in reversed(order):
            if self.length[state] < window:
                break
            own = found.setdefault(state, set())
            if owner[state] >= 0:
                own.add(owner[state])
            parent = self.link[state]
            if self.length[parent] >= window:
                found.setdefault(parent, set()).update(own)
        # base: the state of the last ``window`` words alone; nearly all of those belong to one item, held in a flat array
        self.base = array("i", [-1]) * len(self.length)
        for state in order:
            if self.length[state] >= window:
                parent = self.link[state]
                self.base[state] = self.base[parent] if self.length[parent] >= window else state
        self.item_at = array("i", [-1]) * len(self.length)
        self.items_at: dict[int, frozenset[int]] = {}
        for state in set(self.base) - {-1}:
            if len(found[state]) == 1:
                (self.item_at[state],) = found[state]
            else:
                self.items_at[state] = frozenset(found[state])
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][self.vocab[w]]
                self.short.setdefault(state, []).append((len(words), k))
        self.near_short = [-1] * len(self.length)
        for state in order:
            self.near_short[state] = state if state in self.short else self.near_short[self.link[state]]
        self._pack()

    def _pack(self) -> None:
        """Most states have one transition: flat arrays hold it, and only the others keep a table."""
        self.only_token = array("i", [next(iter(t)) if len(t) == 1 else _MANY for t in self.next])
        self.only_next = array("i", [next(iter(t.values())) if len(t) == 1 else -1 for t in self.next])
        self.many = {state: t for state, t in enumerate(self.next) if len(t) > 1}
        del self.next
        self.link, self.length, self.near_short = (array("i", x) for x in (self.link, self.length, self.near_short))

    def _extend(self, last: int, token: int, item: int, owner: list[int]) -> int:
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        owner.append(item)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][token]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                copy = len(self.length)
                self.next.append(dict(self.next[target]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[target])
                owner.append(-1)
                while at >= 0 and self.next[at].get(token) == target:
                    self.next[at][token] = copy
                    at = self.link[at]
                self.link[target] = self.link[new] = copy
        return new

    def stream(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Maximal runs [start, end) of hit words, and the numbers of the items they come from."""
        vocab, link, length, near, base = self.vocab.get, self.link, self.length, self.near_short, self.base
        only_token, only_next, many, none = self.only_token, self.only_next, self.many, {}
        window, state, size, runs, items = self.window, 0, 0, [], set()
        for i, word in enumerate(words):
            token = vocab(word)
            if token is None:
                state = size = 0
                continue
            while True:
                to = only_next[state] if only_token[state] == token else many.get(state, none).get(token)
                if to is not None or not state:
                    break
                state = link[state]
                size = length[state]
            if to is None:
                state = size = 0
                continue
            state, size, reach = to, size + 1, 0
            if size >= window:
                reach = window
                # the state of the last ``window`` words alone
                item = self.item_at[base[state]]
                if item >= 0:
                    items.add(item)
                else:
                    items |= self.items_at[base[state]]
            at = near[state]
            while at > 0:
                for n, item in self.short[at]:
                    if n <= size:
                        reach = max(reach, n)
                        items.add(item)
                at = near[link[at]]
            if reach:
                start = i + 1 - reach
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append([start, i + 1])
        return runs, items


_SPAN = T.ArrayType(T.ArrayType(T.IntegerType()))
_ADDED = T.StructType([T.StructField("dc_n_words", T.LongType()), T.StructField("dc_runs", _SPAN), T.StructField("dc_items", T.ArrayType(T.StringType())), T.StructField("dc_text", T.StringType())])


def _join_runs(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(text: str, runs: list[list[int]]) -> str:
    """``text`` without the characters from the first to the last word of each run."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.lower())]
    kept, at = [], 0
    for start, end in runs:
        kept.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with dc_n_words, dc_n_hit, dc_runs (word ranges), dc_items (ids) and dc_text (without the runs; null if there are none)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    out = docs
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = sorted({(r["item_id"] is None, r["item_id"] or "", r["text"]) for r in part.toLocalIterator()})
        machine = SuffixAutomaton([(None if none else name, word_list(body)) for none, name, body in rows], window)
        held = spark.sparkContext.broadcast(machine)  # at most one shard of the benchmark
        if shard:
            out = out.drop("dc_n_words", "dc_text")
        out = append_columns(out, [text] + (["dc_runs", "dc_items"] if shard else []), _ADDED, _matcher(held))
        if shard + 1 < shards:
            out = materialize(out, "benchmark")
    return out.withColumn("dc_n_hit", F.aggregate("dc_runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]))


def _matcher(held):
    def make():
        machine = held.value

        def work(texts, *before):
            old_runs, old_items = [c.to_pylist() for c in before] if before else (None, None)
            counts, spans, names, cleaned = [], [], [], []
            for i, value in enumerate(texts.to_pylist()):
                words = word_list(value)
                runs, items = machine.stream(words)
                ids = {machine.names[k] for k in items} - {None}
                if old_runs is not None:
                    runs, ids = _join_runs(runs + old_runs[i]), ids | set(old_items[i])
                counts.append(len(words))
                spans.append(runs)
                names.append(sorted(ids))
                cleaned.append(_cut(value, runs) if runs else None)
            return [counts, spans, names, cleaned]

        return work

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with hit spans cut from ``text``; documents whose hit share exceeds ``max_coverage`` go."""
    out = find_contamination(docs, benchmark, text, window)
    out = out.where(F.col("dc_n_hit") <= F.col("dc_n_words") * F.lit(float(max_coverage)))
    return out.withColumn(text, F.coalesce("dc_text", text)).drop("dc_n_words", "dc_runs", "dc_items", "dc_text", "dc_n_hit")


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find_contamination(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        F.col("dc_n_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("dc_n_hit") > 0).alias("contaminated"),
    )
