"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

A text is a bag of units: words without surrounding punctuation, and runs of
single characters ("i d i o t") taken as one unit; a unit with signs inside
("i.d.i.o.t") is also read without them. The gap-weighted subsequence
kernel of a unit with a landmark still finds the landmark's letters in order when
others stand between them. Kernel values with all landmarks, whitened by the
landmarks' own kernel matrix, are the features of a linear SVM.

Labels are given per text, and one insult makes a text toxic, so a text's value
is the largest value of its units. Landmarks are pieces of units that stand in
many toxic and hardly any clean texts; the units that hold one are fitted against
the hardest units of clean texts, which are picked anew in each round. A logistic curve turns values into 0 to 1.

Null and empty texts have no units and get the lowest value. Units longer than
the kernel's width are read in overlapping pieces, whole texts included. Without
labels of both kinds all scores are 0. Repeated label rows count as toxic if one is;
of rows with one id the smallest text is learned from. An input column ``tx_score``
is kept as ``tx_score_in``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import append_columns, make_room
from .common import hash_remainder
from .string_kernel import OVERLAP, PIECE, encode, sparse_kernel, subsequence_kernel

#: The classifier is fitted on at most this many labelled texts of each class (smallest id hashes), none longer than MAX_CHARS.
MAX_TEXTS = 900
MAX_CHARS = 40_000
MAX_LANDMARKS = 28
CLEAN_LANDMARKS = 8
MIN_LANDMARK, MAX_LANDMARK = 5, 12
ROUNDS = 4
VARIANTS = 20
KNOWN_UNITS = 200_000

_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_INSIDE = re.compile(r"[\W_]+")
_EDGE = ".,;:!?()[]{}\"'|<>…-_*"


def units(text: str | None) -> set[str]:
    low = (text or "").lower()
    words = low.split()
    found = {w.strip(_EDGE) for w in words}
    found |= {m.replace(" ", "").replace("\t", "") for m in _SPELLED.findall(low)}
    found |= {_INSIDE.sub("", w) for w in found if not w.isalnum()}
    found.discard("")
    return found


def pieces(unit: str) -> list[str]:
    marked = f"<{unit}>"
    if len(marked) <= PIECE:
        return [marked]
    return [marked[i : i + PIECE] for i in range(0, len(marked) - OVERLAP, OVERLAP)]


class KernelSvm:
    def __init__(self, landmarks: list[str]):
        self.codes = encode(landmarks, max(map(len, landmarks)))
        gram = subsequence_kernel(self.codes, self.codes).astype(np.float64)
        self.scale = np.sqrt(np.diag(gram))
        gram /= self.scale[:, None] * self.scale[None, :]
        values, vectors = np.linalg.eigh(gram)
        values = np.maximum(values, 1e-6)
        self.whiten = vectors / np.sqrt(values) @ vectors.T
        self.direction = np.zeros(len(landmarks))
        self.bias, self.slope, self.shift = -1.0, 1.0, 0.0

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Kernel values with the landmarks, on the landmarks' scale."""
        out = np.zeros((len(strings), len(self.codes)), np.float32)
        order = np.argsort([len(s) for s in strings], kind="stable")
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            chosen = [strings[i] for i in part]
            out[part] = sparse_kernel(encode(chosen, len(chosen[-1])), self.codes) / self.scale
        return out

    def fit(self, positive: np.ndarray, weight: np.ndarray, negative: np.ndarray, penalty: float = 1e-4, steps: int = 60) -> None:
        """Squared hinge loss by Newton steps; both classes weigh the same, ``weight`` divides the positive half."""
        x = np.vstack([positive, negative]).astype(np.float64) @ self.whiten
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        c = np.r_[0.5 * weight / weight.sum(), np.full(len(negative), 0.5 / max(1, len(negative)))]
        w = np.zeros(x.shape[1])
        ridge = penalty * np.eye(x.shape[1])
        ridge[-1, -1] = 1e-8
        for _ in range(steps):
            active = y * (x @ w) < 1
            xa = x[active] * c[active, None]
            new = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
            done = np.allclose(new, w, atol=1e-9)
            w = new
            if done:
                break
        self.direction, self.bias = self.whiten @ w[:-1], float(w[-1])

    def values(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.direction + self.bias

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.shift), -40, 40)))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Pieces of toxic texts' units that tell the classes apart, each explaining units that those before it left."""

    def parts(unit: str, sizes=range(MIN_LANDMARK, MAX_LANDMARK + 1)) -> set[str]:
        m = f"<{unit}>"
        return {m[i : i + n] for n in sizes for i in range(len(m) - n + 1)}

    worth: set[str] = set()
    for n in range(MIN_LANDMARK, MAX_LANDMARK + 1):  # one length at a time, as most pieces stand in one text only
        in_toxic = Counter(p for b in toxic for p in set().union(*(parts(u, (n,)) for u in b)))
        worth |= {p for p, c in in_toxic.items() if c >= 3}
    in_clean: Counter = Counter()
    for b in clean:
        in_clean.update(worth & set().union(*map(parts, b)))
    limit = 0.002 * len(clean)
    # so many texts that no piece is likely to fall into toxic texts alone by chance
    least = max(3.0, 0.02 * len(toxic), 14.5 / np.log((len(toxic) + len(clean)) / len(toxic)))
    worth = {p for p in worth if in_clean[p] <= limit}
    left = [[u for u in (parts(u) & worth for u in b) if u] for b in toxic]
    chosen: list[str] = []
    while len(chosen) < MAX_LANDMARKS:
        count = Counter(p for b in left for p in set().union(*b))
        best = min(count, key=lambda p: (-count[p] / (1 + in_clean[p]), -len(p), p), default=None)
        if best is None or count[best] < least:
            break
        chosen.append(best)
        left = [[u for u in b if best not in u] for b in left]
    return chosen


def train(toxic_texts: list[str], clean_texts: list[str]) -> KernelSvm | None:
    toxic, clean = [units(t) for t in toxic_texts], [units(t) for t in clean_texts]
    toxic = sorted({frozenset(b) for b in toxic if b}, key=sorted)  # copies count once
    if not toxic or not clean:
        return None
    landmarks = choose_landmarks(toxic, clean)
    if not landmarks:
        return None
    clean_units = sorted(set().union(*clean))
    strings = sorted({p for u in clean_units for p in pieces(u)} | {p for b in toxic for u in b for p in pieces(u)})
    at = {s: i for i, s in enumerate(strings)}
    bags = [np.array(sorted({at[p] for u in b for p in pieces(u)})) for b in toxic]
    clean_bags = [np.array(sorted({at[p] for u in b for p in pieces(u)}), np.int64) for b in clean]
    negative = np.array(sorted({at[p] for u in clean_units for p in pieces(u)}))
    model = KernelSvm(landmarks)
    kernel = model.kernel(strings)
    in_toxic = np.unique(np.concatenate(bags))
    # Units that hold a landmark whole stand for their texts; each landmark's units share one weight.
    share = kernel[in_toxic] / model.scale
    stands = in_toxic[share.max(1) >= 0.999]
    if not len(stands):
        return None
    group = share.argmax(1)[share.max(1) >= 0.999]
    weight = 1.0 / np.bincount(group, minlength=len(landmarks))[group]
    # The same units with a foreign character inside are to be found too.
    gapped, of = [], []
    for g in range(len(landmarks)):
        for i in stands[group == g][:VARIANTS]:
            inner = strings[i][1:-1]
            made = [f"<{inner[:k]}\x01{inner[k:]}>" for k in range(1, len(inner))]
            gapped += [m for m in made if len(m) <= PIECE]
            of += [g] * (len(gapped) - len(of))
    weight = np.r_[weight, 0.5 / np.bincount(of, minlength=len(landmarks))[of]] if of else weight
    gapped_kernel = model.kernel(gapped)
    value = kernel.max(1)
    for stage in range(2):
        for _ in range(ROUNDS):
            hard = negative[np.argsort(-value[negative], kind="stable")[:20_000]]
            model.fit(np.vstack([kernel[stands], gapped_kernel]), weight, kernel[hard])
            value = model.values(kernel)
        if stage == 0:
            # clean strings that come closest serve as landmarks too
            near = [strings[i] for i in negative[np.argsort(-value[negative], kind="stable")[:CLEAN_LANDMARKS]]]
            beside = KernelSvm(near)
            kernel = np.hstack([kernel, beside.kernel(strings)])
            gapped_kernel = np.hstack([gapped_kernel, beside.kernel(gapped)])
            model = KernelSvm([*landmarks, *near])
    explained = set(stands.tolist())
    top = np.array([value[b].max() for b in bags if explained & set(b.tolist())])
    low = np.array([value[b].max() if len(b) else model.bias for b in clean_bags])
    # The curve crosses one half where the fewest texts fall on the wrong side, in the middle of the widest such gap.
    cuts = np.unique(np.r_[top, low])
    middle = (cuts[1:] + cuts[:-1]) / 2
    wrong = np.searchsorted(np.sort(top), middle) / len(top) + (len(low) - np.searchsorted(np.sort(low), middle)) / len(low)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    at = best[np.argmax((cuts[1:] - cuts[:-1])[best])]
    model.shift = float(0.7 * cuts[at] + 0.3 * cuts[at + 1])
    model.slope = float(6 / max(0.1, cuts[at + 1] - cuts[at]))
    return model


def training_texts(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = MAX_TEXTS) -> tuple[list[str], list[str]]:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(hash_remainder(F.col("doc_id"), 5) != 0)
    out = []
    for kind in (1, 0):
        ids = marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")
        found = docs.select("doc_id", F.col(text).alias("tx_text")).where(F.length("tx_text").between(1, MAX_CHARS))
        found = found.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("tx_text").alias("tx_text"))  # at most ``limit`` ids
        out.append(sorted(r["tx_text"] for r in found.toLocalIterator()))
    return out[0], out[1]


def score_toxicity(docs: DataFrame, model: KernelSvm | None, text: str = "text") -> DataFrame:
    """``docs`` with tx_score."""
    if model is None:
        return make_room(docs, ["tx_score"]).withColumn("tx_score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few landmarks

    def make():
        machine = held.value
        known: dict[str, float] = {}

        def work(texts):
            scores, floor = [], float(machine.bias)
            values = texts.to_pylist()
            for start in range(0, len(values), 256):
                bags = [units(t) for t in values[start : start + 256]]
                new = sorted({u for b in bags for u in b if u not in known})
                if len(known) + len(new) > KNOWN_UNITS:
                    known.clear()
                    new = sorted(set().union(*bags))
                split = [pieces(u) for u in new]
                flat = sorted({p for ps in split for p in ps})
                for at in range(0, len(flat), 65536):
                    part = flat[at : at + 65536]
                    got = machine.values(machine.kernel(part))
                    if at == 0 and len(part) == len(flat):
                        piece = dict(zip(part, got.tolist(), strict=True))
                    else:
                        piece = (piece if at else {}) | dict(zip(part, got.tolist(), strict=True))
                for u, ps in zip(new, split, strict=True):
                    known[u] = max(piece[p] for p in ps)
                scores += [max(map(known.__getitem__, b), default=floor) for b in bags]
            return [machine.probability(np.array(scores, np.float64)).tolist()]

        return work

    return append_columns(docs, [text], T.StructType([T.StructField("tx_score", T.DoubleType())]), make)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    out = score_toxicity(slim, train(*training_texts(slim, labels)))
    return out.select("doc_id", (hash_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= 0.5).cast("int").alias("predicted"))
