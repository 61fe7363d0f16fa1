"""Personal data, whitening and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, prefix_trie, whitening
from tessera.llm.boosting import Split, fit_trees, margins, threshold

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def card(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def personal_rows():
    rng = random.Random(4)
    pieces = [
        lambda: f"{rng.choice('abc')}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)), lambda: card(rng), lambda: str(rng.randint(10**15, 10**16)),
        lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: f'token = "{hashlib.md5(str(rng.random()).encode()).hexdigest()}"', lambda: "a@b.c_d@e.f", lambda: "1.2.3.4.5.6.7.8", lambda: "+12 + 3", lambda: "é😀 word",
        lambda: " ".join(re.findall("....", card(rng))), lambda: "x@y", lambda: "007.08.9.010", lambda: "+1" + "2" * 20,
    ]
    docs = [(i, " ".join(f"w{'o' * rng.randint(1, 4)}" if rng.random() < 0.6 else rng.choice(pieces)() for _ in range(30))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "9" * 5000), (303, "1 2 " * 3000), (304, "a" * 3000 + "@b.c"), (305, docs[0][1]), (0, docs[0][1]), (None, "no id m.1@x.example.com"), (306, f"z {card(rng)} {card(rng)} z"), (307, "call +1 (826) 555-4081 190.137.223.204 now")]
    docs += [(308, "write to jo.doe (at) mail7.example.com today"), (310, "jo at mail dot example dot com"), (309, "plain words at home dot all clean 12 34")]
    return docs


PERSONAL = personal_rows()


def personal_frame(spark, rows):
    return spark.createDataFrame([(i, t, k, "x", float(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, pd_base int, pd_text string, kind double").repartition(3)


def test_pii_base_is_as_defined_and_stays(spark):
    rows = pii.pii_table(personal_frame(spark, PERSONAL)).collect()
    assert len(rows) == len(PERSONAL)
    want = {i: base_spans(t) for i, t in PERSONAL}
    added = {}
    for r in rows:
        base = want[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == s[0] for s in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert {joined([s]) for s in base} <= set(r["spans"].split(","))
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [(pii.KINDS.index(k), int(a)) for k, a, b in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, b in spans)
        added[r["doc_id"]] = {tuple(s) for s in spans} - {(k, str(a), str(b)) for k, a, b in base}
    assert added[306] == {("card", "2", "18"), ("card", "19", "35")} and added[307] == {("phone", "5", "22")} and added[308] == {("email", "9", "38")} and added[310] == {("email", "0", "30")}
    assert not added[309] and not added[302] and not added[300] and not added[301]


def test_pii_scores_are_the_trees(spark):
    """Selected spans again from the trees walked in Python over the proposals."""
    proposed = pii.propose(personal_frame(spark, PERSONAL[:200] + PERSONAL[300:]).select("doc_id", "text")).persist()
    model = pii.train_pii(proposed)
    assert model.trees and sum(v[0] for v in model.held_out.values()) > 20 and sum(v[1] for v in model.held_out.values()) <= 0.05 * sum(v[0] for v in model.held_out.values())
    names = list(pii.FEATURES)
    for r in pii.select_spans(proposed.withColumn("found", F.col("pd_found")), model).collect():
        found = r["found"]
        touch = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
        scored = [(c, float(margins(model.trees, names, np.array([[c[f] for f in names]]))[0])) for c in found if not any(touch(c, b) for b in r["pd_base"])]
        fine = [(c, m) for c, m in scored if m >= model.least[c["kind"]]]
        rank = lambda c, m: (-m, c["start"] - c["end"], c["start"], c["kind"])
        best = {(c["kind"], c["start"], c["end"]) for c, m in fine if not any(touch(o, c) and rank(o, n) < rank(c, m) for o, n in fine)}
        assert {(s["kind"], s["start"], s["end"]) for s in r["pd_spans"] if not s["base"]} == best
    proposed.unpersist()


def test_pii_redaction_empty_tables_and_clashing_names(spark):
    found = pii.find_personal_data(personal_frame(spark, PERSONAL))
    assert {"pd_base_in", "pd_text_in"} <= set(found.columns)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(found).select("doc_id", "text").collect()}
    assert texts[307] == "call [PHONE] [IP] now" and texts[300] is None and texts[309] == PERSONAL[-1][1]
    assert pii.pii_table(personal_frame(spark, PERSONAL).limit(0)).count() == 0
    only = pii.pii_table(personal_frame(spark, [(1, "a@b.cd"), (2, None)])).orderBy("doc_id").collect()
    assert [r["spans"] for r in only] == ["email:0:6", ""]


def test_boosting_learns_and_calibrates():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    p, n = np.array([10.0 if a > 1 and b > 0 else 0.0 for a, b in x]), np.array([0.0 if a > 1 and b > 0 else 10.0 for a, b in x])
    trees = fit_trees(["a", "b"], x, p, n)
    m = margins(trees, ["a", "b"], x)
    assert ((m > 0) == (p > 0)).all() and isinstance(trees[0], Split)
    assert 0 <= threshold(m, p, n, 0.95) <= m[p > 0].min() and threshold(m, p * 0, n, 0.95) == float("inf") and fit_trees(["a", "b"], x, p * 0, n * 0) == []


def vector_rows():
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 12)) * np.linspace(2, 0.5, 12)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7]) for i in range(200)] + [(3, vectors[3]), (None, vectors[4])]
    return rows, [(2000, None), (2001, [None, *vectors[0][1:]]), (2002, [float("nan"), *vectors[0][1:]]), (2003, [float("inf"), *vectors[0][1:]])]


def test_whitening_against_dense_algebra(spark):
    rows, bad = vector_rows()
    df = spark.createDataFrame([(i, v, k, 1.0) for k, (i, v) in enumerate(rows + bad)], "vec_id long, embedding array<double>, wh_x int, n double").repartition(5)
    got = whitening.whitening_table(df).collect()
    assert len(got) == 4 * len(rows)
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    far = {}
    for (i, _), y in zip(rows, x, strict=True):
        far.setdefault(i, (y, int(((n * y - s) ** 2).sum())))
    signs = {}
    for r in got:
        y, d = far[r["vec_id"]]
        k = r["component"] - 1
        want = (y - s / n) @ u[:, k] / np.sqrt(e[k])
        sign = signs.setdefault(k, 1 if abs(want - r["whitened"]) < abs(want + r["whitened"]) else -1)
        assert (r["n"], r["deviation"]) == (n, d) and abs(sign * want - r["whitened"]) < 1e-9
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("block", [2, 5])
def test_whitening_small_blocks_and_restarts(spark, block):
    rows, _ = vector_rows()
    fit = whitening.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding").select("wh_x").distinct().persist()
    model = whitening.fit_whitener(fit, 3, block=block, max_basis=8)
    whole = whitening.fit_whitener(fit, 3)
    assert np.allclose(model.variances, whole.variances, rtol=1e-9) and np.allclose(np.abs((model.vectors * whole.vectors).sum(axis=0)), 1, atol=1e-8)
    fit.unpersist()


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    table = lambda rows: whitening.whitening_table(spark.createDataFrame(rows, schema)).collect()
    assert table([]) == [] and table([(1, None)]) == [] and table([(1, [])]) == []
    one = table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    ragged = table([(1, [1.0]), (2, [1.0, 2.0]), (3, [0.5, 1.0])])
    assert {r["component"] for r in ragged} == {1, 2} and {r["n"] for r in ragged} == {3}
    huge = table([(1, [1e12, 0.0]), (2, [-1e12, 1.0])])
    assert {r["deviation"] for r in huge} == {None} and all(abs(abs(r["whitened"]) - 1) < 1e-6 for r in huge if r["component"] == 1)


def conversation_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 130), 200, 205, 303, 399, -150, -100, 1000]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", "", None, "long text " * 3])))
    rows += [(c, t, "user", x) for c in range(400, 460) for t, x in enumerate("abc")]
    rows += [(5, None, "user", "first"), (5, None, "user", "again"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "x")]
    return rows


def brute_trie(rows, rebuild):
    key = lambda r, t: hashlib.md5(f"{len(r or '')}:{r or ''}{t or ''}".encode()).hexdigest()
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, key(r, x), x or ""))
    turns = {c: [(k, x) for _, _, k, x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        b = c - int(np.fmod(c, 100))
        full[c] = turns.get(b, [])[:h] + own[h:]
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(k for k, _ in seq[:d]), []).append((c, len(seq) == d, len(seq[d - 1][1]) if d else 0))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):
        ms = members[p]
        leaves, saved = 0, (len(ms) - 1) * ms[0][2]
        for q in kids.get(p, []):
            a, b = walk(q)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = sorted(c for c, end, _ in ms if end)
        up = min(c for c, _, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _, _ in ms), len(p), up, len(ms), len(kids.get(p, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rebuild", "range_bytes", "run_rows"), [(True, 1 << 20, 16), (True, 2000, 3), (False, 500, 1), (False, 1 << 20, 1000)])
def test_trie_by_brute_force(spark, rebuild, range_bytes, run_rows):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, depth string, block int").repartition(4)
    got = prefix_trie.prefix_trie(df, rebuild, range_bytes, run_rows).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows, rebuild)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie_table(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.trie_table(spark.createDataFrame([(None, 0, "u", "x")], schema)).count() == 0
    for rows in ([(1, 0, "u", "x")], [(7, i, "u", f"t{i}") for i in range(300)] + [(8, i, "u", f"t{i}") for i in range(299)]):
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows, False)


def test_loser_tree_counts_shared_turns():
    rng = random.Random(1)
    turn = lambda: rng.choice([b"a", b"b", b"c"]) * 16
    rows = sorted((b"".join(turn() for _ in range(rng.randint(0, 6))), i) for i in range(300))
    for k in (1, 2, 3, 7):
        runs = []
        for j in range(k):
            own, run = rows[j::k], prefix_trie.Run()
            for a, b in zip([None, *own], own):
                run.add(prefix_trie.shared_turns(a[0], b[0]) if a else 0, b[1], b[0], None)
            runs.append(run)
        merged = [(x, i, n) for x, i, _, n in prefix_trie.merge_runs([*runs, prefix_trie.Run()])]
        assert [m[:2] for m in merged] == rows
        assert [m[2] for m in merged] == [0] + [prefix_trie.shared_turns(a[0], b[0]) for a, b in zip(rows, rows[1:])]
    assert list(prefix_trie.merge_runs([])) == []
