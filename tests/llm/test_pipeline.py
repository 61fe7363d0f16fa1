"""Every stage of the pipeline against a brute-force version, one after another and as a whole."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.string_kernel import encode, subsequence_kernel
from tessera.llm.toxicity import pieces, train, units

from test_llm import ALNUM, WORD, brute_groups, low

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, MX_Taken int, tx_score string"
ADDED = ["mx_size", "source_size", "target", "copies", "taken"]


def make_rows():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("aeioubcdmnrst"), rng.integers(3, 9))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words, n))
    bench = [text(25), text(6), None, ""]
    texts = []
    for i in range(260):
        t = f"{text(30)}\nshared header line\n{text(12)}" if i % 9 == 0 else text(int(rng.integers(5, 60)))
        if i % 4 == 1:
            t = f"{t} {'grobnik' if i % 8 == 1 else 'zwaffel'} {text(8)}"
        if i % 31 == 0:
            t = f"{text(9)} {bench[0]} {text(9)}"
        texts.append(t)
    long = text(90)
    texts += [long, long, long + " extra", long.upper(), None, "", " \n ", "one", "ONE", text(9000), f"{text(4)} {bench[1]}"]
    sources = ["a", "b", None, "c"]
    rows = [(i, t, "en", sources[int(rng.integers(0, 4))], len(t) if t is not None else None, "S", i, "x") for i, t in enumerate(texts)]
    labels = [(i, int(i % 4 == 1 and i % 31 > 0)) for i in range(0, 260)]
    return rows, labels, [(k, t) for k, t in enumerate(bench)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels, bench = make_rows()
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def toxic_ids(rows, labels):
    learn = {i: t for i, t, *_ in rows if t and zlib.crc32(str(i).encode()) % 5}
    marks = dict(labels)
    model = train(sorted(t for i, t in learn.items() if marks.get(i) == 1), sorted(t for i, t in learn.items() if marks.get(i) == 0))

    def value(unit):
        k = [subsequence_kernel(encode([p], len(p)), model.codes)[0] / model.scale for p in pieces(unit)]
        return max(float(x @ model.direction) + model.bias for x in k)

    known = {u: value(u) for _, t, *_ in rows for u in units(t)}
    score = lambda t: 1 / (1 + math.exp(-max(-40, min(40, model.slope * (max((known[u] for u in units(t)), default=model.bias) - model.shift)))))
    return {i for i, t, *_ in rows if score(t) >= 0.5}


def without_repeated_lines(rows):
    key = lambda x: low(x.strip(" \t\n\r\x0b\x0c"))
    n = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, lang, source, chars, *rest in rows:
        kept = [x for x in (t or "").split("\n") if not (key(x) and n[key(x)] >= 10)]
        cut = len(kept) < len((t or "").split("\n"))
        out.append((i, "\n".join(kept) if t is not None else None, lang, source, len("\n".join(kept)) if cut else chars, *rest))
    return out


def without_copies(rows):
    group = brute_groups([(i, t) for i, t, *_ in rows], 5)
    return [r for r in rows if group[r[0]] == r[0]]


def without_benchmark(rows, bench):
    windows = set()
    for _, t in bench:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    clean = lambda w: not any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))
    return [r for r in rows if clean(ALNUM.findall(low(r[1])))]


def mixed(rows):
    """{doc_id: (size, source_size, target, copies, taken)}, all documents."""
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        left, shares = sum(own.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / shares > 3 * own[s]}
        if not over:
            target |= {s: left * weight[s] / shares for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in over}
        open_ -= over
    out = {}
    for s in sources:
        epochs = int(target[s] // own[s]) if own[s] else 0
        rest = target[s] - epochs * own[s]
        keyed = []
        for i, t, *_ in [r for r in rows if r[3] == s]:
            odd, chars = len(re.findall(r"[0-9#*$%&|<>{}\[\]=_~^\\/@]", t or "")), max(1, len(t or ""))
            u = (int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            keyed.append((-math.log(u) / max(0.1, (1 - odd / chars) * min(1.0, size[i] / 20)), i))
        keyed.sort()
        run, more = 0, set()
        for k, (_, i) in enumerate(keyed):
            if run + size[i] > rest:
                fits = [(size[j], -key, j) for key, j in keyed[k:] if 0 < size[j] <= rest - run]
                best = max(fits, default=None)
                if run + size[i] - rest < rest - run - (best[0] if best else 0):
                    more.add(i)
                elif best:
                    more.add(best[2])
                break
            run += size[i]
            more.add(i)
        for _, i in keyed:
            copies = min(3, epochs + (i in more and rest > 0))
            out[i] = (size[i], own[s], target[s], copies, copies * size[i])
    return out


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_stage_and_the_whole(spark, sf_dir):
    rows, labels, bench = make_rows()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(pipeline.STAGES)
    gone = toxic_ids(rows, labels)
    assert {i for i, x in labels if x} <= gone and len(gone) < len(rows) / 2
    steps = [("toxicity", lambda r: [x for x in r if x[0] not in gone]), ("line_dedup", without_repeated_lines), ("near_dedup", without_copies), ("decontaminate", lambda r: without_benchmark(r, bench))]
    for name, brute in steps:
        want = brute(rows)
        assert want != rows, name
        got = stages[name](spark, docs, sf_dir)
        assert got.columns == docs.columns and as_set(got) == sorted(want, key=repr), name
        rows, docs = want, spark.createDataFrame(want, SCHEMA)
    want = mixed(rows)
    last = pipeline.run(spark, sf_dir)
    assert last.columns == [*docs.columns, *ADDED]
    got = {r["doc_id"]: (r["mx_size"], r["source_size"], pytest.approx(r["target"]), r["copies"], r["taken"]) for r in last.collect()}
    assert got == {i: x for i, x in want.items() if x[3] > 0}
    assert {tuple(r)[: len(docs.columns)] for r in last.collect()} == {r for r in rows if want[r[0]][3] > 0}


def test_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
