"""Token counts by a compiled finite-state transducer for byte-level BPE.

The transducer reads characters. Its state says which kind of pre-token is open
(letters, digits, other signs, a run of white space, an apostrophe that may begin a
contraction) and where the bytes of that pre-token have led: the set of
vocabulary-trie nodes that are still open, each with the token before it and the
number of tokens up to there. Reading a character leads to one next state, and the
transition is annotated with the change in the number of tokens that the text read
so far has (it may fall when tokens merge). Which of the tokens that end at a byte
is the right one follows from the merges: two neighbours stand if, when the merges
that made them are undone from the last one on, no earlier merge would have joined
the pieces that meet between them. States and transitions are compiled when they are
first met and shared by all later texts of the worker; transitions over a whole
word are the composition of those over its characters and are kept as well.

A text is cut into chunks, and each chunk becomes a map from the state before it to
the state behind it and the tokens added. From the first character of white space
that follows one of another kind all states agree, so a map is a function of the
start state up to that place (its head) and constant beyond. Maps are composed
pairwise in a tree (an associative scan): where the first map has such a place, its
end state is put into the second one; where it has none, the heads are joined. The
map of the whole text is applied to the initial state.

Null and empty texts have no tokens. A text without white space is one map that is
all head. An input column of an added name (``tk_*``) is kept as ``<name>_in``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow_map import append_columns

CHUNK_CHARS = 4096
LIMIT = 1024
MAX_STATES = 300_000
MAX_WORDS = 300_000
MAX_WORD_CHARS = 32

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies, which the transitions below follow.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START, LETTERS, DIGITS, OTHER, SPACE, APOSTROPHE, HALF = range(7)
_ONE, _TWO = "stmd", {"r": "e", "v": "e", "l": "l"}  # what follows an apostrophe in the contractions of the pattern


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stays, the rest is moved up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class State(dict):
    """Transitions by character or word: (next state, change in the number of tokens).

    kind: the open pre-token's; nodes: where its bytes have led; pending: a character that may still go elsewhere.
    """

    __slots__ = ("at", "epoch", "kind", "machine", "nodes", "older", "pending")

    def __init__(self, machine: BpeTransducer, kind: int, at: int, pending: str):
        self.machine, self.kind, self.pending, self.older = machine, kind, pending, None
        self.at, self.epoch, self.nodes = at, machine.epoch, machine.byte_states[at]

    def place(self) -> int:
        if self.epoch != self.machine.epoch:  # the table of places was begun anew since
            self.at, self.epoch = self.machine.place(self.nodes), self.machine.epoch
        return self.at

    def __missing__(self, symbol: str) -> tuple[State, int]:
        machine = self.machine
        if len(symbol) > 1:
            if self.older is not None and (known := self.older.get(symbol)) is not None:
                return machine.keep(self, symbol, known)
            return machine.keep(self, symbol, machine.compile_word(self, symbol))
        if LETTERS <= self.kind <= OTHER and self.kind != machine.kind(symbol):
            out = self[symbol] = machine.opened("", symbol)  # the same from all states of another kind
            return out
        out = self[symbol] = machine.transition(self, symbol)
        return out


@dataclass(frozen=True)
class ChunkMap:
    """head: what is read from the start state on; behind it, if there is a place where all states agree, ``rest`` tokens follow and ``end`` is reached."""

    head: str
    rest: int
    end: State | None


class BpeTransducer:
    def __init__(self, spec: str):
        data = json.loads(spec)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space or normalizer is compiled")
        for token in data.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("added tokens that strip their surroundings are not compiled")
        special = sorted((t["content"] for t in data.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.symbols = re.compile(r"\w+\W|\w+|\W").findall  # a word with the sign behind it ends in one of few states
        self.sync = regex.compile(r"(?<=\S)\s").search
        self.kinds: dict[str, int] = {}
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        # joins: rank of the merge of two tokens; made: rank of the merge that makes a token (-1: none) and the two it is made of
        self.joins: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, i, i) for i in self.bytes_of}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, both = self.id_of[raw(a)], self.id_of[raw(b)], self.id_of[raw(a) + raw(b)]
            self.joins.setdefault((left, right), r)
            if self.made[both][0] < 0:
                self.made[both] = r, left, right
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for token, i in self.id_of.items():
            at = 0
            for byte in token:
                if byte not in self.child[at]:
                    self.child[at][byte] = len(self.child)
                    self.child.append({})
                    self.token_at.append(None)
                at = self.child[at][byte]
            self.token_at[at] = i
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states, which keeps their table bounded; those that are still held go on working."""
        self.epoch = getattr(self, "epoch", 0) + 1
        self.bytes_id: dict[tuple, int] = {((0, -1, 0),): 0}
        self.byte_states: list[tuple] = [((0, -1, 0),)]
        self.steps: dict[int, int] = {}  # place and byte to next place and change in tokens, packed: one look-up a byte
        self.states: dict[tuple, State] = {}
        self.fresh: dict[str, tuple[State, int]] = {}
        self.words = 0
        self.initial = self.state(START)

    def state(self, kind: int, at: int = 0, pending: str = "") -> State:
        key = (kind, at, pending)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, kind, at, pending)
        return found

    def neighbours(self, before: int, token: int) -> bool:
        """Whether the merges leave ``token`` standing after ``before`` (-1: at the start).

        Merges of one rank run from left to right, so one that joins the pieces
        between two tokens also comes before an equal one within the right token.
        """
        left, right, limit, joins, made = before, token, 1 << 60, self.joins, self.made
        if left < 0:
            return True
        while True:
            if joins.get((left, right), limit) < limit:
                return False
            (a, _, inner), (b, outer, _) = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = inner, a
            else:
                right, limit = outer, b + 1

    def byte_step(self, at: int, byte: int) -> int:
        open_, found = [], None
        for node, before, count in self.byte_states[at]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            open_.append((node, before, count))
            token = self.token_at[node]
            if found is None and token is not None and self.neighbours(before, token):
                found = (token, count + 1)
        if found is None:
            raise ValueError(f"no token ends at byte {byte}")
        token, delta = found
        nxt = tuple((node, before, count - delta) for node, before, count in open_ if self.child[node]) + ((0, token, 0),)
        out = self.steps[at << 8 | byte] = self.place(nxt) << 8 | delta + 128  # a token of the vocabulary replaces far fewer than 128
        return out

    def place(self, nodes: tuple) -> int:
        found = self.bytes_id.get(nodes)
        if found is None:
            found = self.bytes_id[nodes] = len(self.byte_states)
            self.byte_states.append(nodes)
        return found

    def read(self, at: int, text: str) -> tuple[int, int]:
        """Place and change in tokens when the bytes of ``text`` follow in the same pre-token."""
        data, get, total = text.encode(), self.steps.get, 0
        for byte in data:
            found = get(at << 8 | byte)
            if found is None:
                found = self.byte_step(at, byte)
            at = found >> 8
            total += found & 255
        return at, total - 128 * len(data)

    def kind(self, c: str) -> int:
        found = self.kinds.get(c)
        if found is None:
            found = self.kinds[c] = SPACE if regex.match(r"\s", c) else LETTERS if regex.match(r"\p{L}", c) else DIGITS if regex.match(r"\p{N}", c) else OTHER
        return found

    def compile_word(self, state: State, word: str) -> tuple[State, int]:
        """The composition of the transitions over a word's characters and the sign behind it; letters are read at once."""
        end, total = state[word[0]]
        body, sign = (word[1:], "") if self.kind(word[-1]) == LETTERS else (word[1:-1], word[-1])
        if end.kind == LETTERS and (not body or body.isalpha() and (body.isascii() or all(self.kind(c) == LETTERS for c in body))):
            place, delta = self.read(end.place(), body)
            total += delta
            if sign and self.kind(sign) != DIGITS:
                end, delta = self.opened("", sign)
                total += delta
            else:
                end = self.state(LETTERS, place)
                for c in sign:
                    end, delta = end[c]
                    total += delta
        else:
            for c in word[1:]:
                end, delta = end[c]
                total += delta
        return end, total

    def keep(self, state: State, word: str, found: tuple[State, int]) -> tuple[State, int]:
        if len(word) <= MAX_WORD_CHARS:
            if self.words >= MAX_WORDS:
                self.age_words()
            self.words += 1
            state[word] = found
        return found

    def age_words(self) -> None:
        """Words that are not met again while as many others are kept will be forgotten."""
        for state in self.states.values():
            words = {w: x for w, x in state.items() if len(w) > 1}
            state.older = words or None
            for w in words:
                del state[w]
        self.words = 0

    def opened(self, before: str, c: str) -> tuple[State, int]:
        """A new pre-token: ``before`` is a blank or nothing."""
        found = self.fresh.get(before + c)
        if found is None:
            kind = self.kind(c)
            at, total = self.read(0, before + c)
            state = self.state(SPACE, 0, c) if kind == SPACE else self.state(APOSTROPHE if c == "'" and not before else kind, at)
            found = self.fresh[before + c] = state, total
        return found

    def transition(self, state: State, c: str) -> tuple[State, int]:
        kind, pending, at = state.kind, state.pending, state.place()
        new = self.kind(c)
        if kind == SPACE:  # at: the run without its last character, which is pending
            whole, last = self.read(at, pending)
            if new == SPACE:
                return self.state(SPACE, whole, c), self.read(whole, c)[1]
            if pending == " ":
                end, total = self.opened(" ", c)
                return end, total - last
            end, total = self.opened("", c)
            return end, total + self.read(0, pending)[1] - last
        if kind == APOSTROPHE and c in _ONE:
            return self.state(START), self.read(0, "'" + c)[1] - self.read(0, "'")[1]
        if kind == APOSTROPHE and c in _TWO:
            place, total = self.read(0, c)
            return self.state(HALF, place, c), total
        if kind == HALF and c == _TWO[pending]:
            return self.state(START), self.read(0, "'" + pending + c)[1] - self.read(0, "'")[1] - self.read(0, pending)[1]
        kind = {APOSTROPHE: OTHER, HALF: LETTERS}.get(kind, kind)
        if kind == new and kind != START:
            place, total = self.read(at, c)
            return self.state(kind, place), total
        return self.opened("", c)

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for symbol in self.symbols(text):
            state, delta = state[symbol]
            total += delta
        return state, total

    def chunk_map(self, chunk: str) -> ChunkMap:
        found = self.sync(chunk)
        if found is None:
            return ChunkMap(chunk, 0, None)
        at = found.end()
        end, rest = self.run(self.state(SPACE, 0, chunk[at - 1]), chunk[at:])
        return ChunkMap(chunk[:at], rest, end)

    def apply(self, chunk: ChunkMap, start: State) -> tuple[State, int]:
        end, count = self.run(start, chunk.head)
        return (end, count) if chunk.end is None else (chunk.end, count + chunk.rest)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """``b`` after ``a``."""
        if a.end is None:
            return ChunkMap(a.head + b.head, b.rest, b.end)
        end, count = self.apply(b, a.end)
        return ChunkMap(a.head, a.rest + count, end)

    def piece_count(self, text: str) -> int:
        maps = [self.chunk_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)]
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.apply(maps[0], self.initial)[1] if maps else 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.byte_states) > MAX_STATES:
            self.reset()
        if self.special is None:
            return self.piece_count(text)
        pieces = self.special.split(text)
        return sum(map(self.piece_count, pieces)) + len(pieces) - 1


_COMPILED: dict[int, BpeTransducer] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` with tk_n_tokens and tk_n_bytes (UTF-8)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB

    def make():
        key = hash(tokenizer_path)
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = BpeTransducer(held.value)
        machine = _COMPILED[key]

        def work(texts):
            values = texts.to_pylist()
            return [[machine.count(t) for t in values], [len((t or "").encode()) for t in values]]

        return work

    return append_columns(docs, [text], T.StructType([T.StructField("tk_n_tokens", T.LongType()), T.StructField("tk_n_bytes", T.LongType())]), make)


def token_table(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    from pyspark.sql import functions as F

    out = count_tokens(docs.select("doc_id", "text"), tokenizer_path)
    return out.select("doc_id", F.col("tk_n_bytes").alias("n_bytes"), F.col("tk_n_tokens").alias("n_tokens"), (F.col("tk_n_tokens") > limit).alias("over_limit"))
