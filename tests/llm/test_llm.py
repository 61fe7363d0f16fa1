"""The training-data operators against brute force, on edge rows and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup, suffix_dedup, token_count
from tessera.llm import suffix_array as suffix_array_module
from tessera.llm.context_tree import ContextTree, byte_logs
from tessera.llm.decontaminate import SuffixAutomaton, contamination_table, decontaminate, find_contamination, word_list
from tessera.llm.license_scan import license_table
from tessera.llm.line_dedup import PerfectHash, drop_repeated_lines, line_table
from tessera.llm.lm_score import score_table
from tessera.llm.near_dedup import band_keys, keep_one_per_group, near_duplicate_table, superminhash
from tessera.llm.quality_rules import quality_table
from tessera.llm.shingles import shingle_sets
from tessera.llm.source_mix import mix_sources, mix_table, source_targets
from tessera.llm.string_kernel import common_subsequence_lengths, encode, sparse_kernel, subsequence_kernel
from tessera.llm.suffix_array import permuted_common_prefixes, suffix_array
from tessera.llm.suffix_dedup import repeat_table
from tessera.llm.token_count import token_table
from tessera.llm.toxicity import score_toxicity, toxicity_table, train

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, h long, t string, cluster int, n int, word string, rank int, score double, size int, mark string"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sample():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    base, passage, line = text(120), text(60), "Common  LINE of text"
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, base), (4, base), (5, base + " x y"), (6, "One"), (7, "one"), (8, text(20000)), (9, "a" * 700), (10, "a" * 650)]
    for i in range(11, 41):
        docs.append((i, f"{text(40)}.\n{passage if i % 3 == 0 else text(50)}\n {line}\t\n{text(30)}\n#*$ {text(9)}" + (f"\n{text(9)}" if i % 2 else "")))
    docs += [(41, docs[20][1]), (42, base.replace(" ", "  ")), (43, "Released under the MIT License. mit license apache license"), (44, "the GNU General Public License, Apache License v2"), (3, base)]
    docs += [(45, "😀 İstanbul ÄÖ\r\nÄÖ\r\n" * 30), (46, None), (47, "w " * 40), (48, "café <|endoftext|> it's 12 34!!  \n\n x"), (None, "no id at all"), (None, base)]
    return docs


DOCS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS)


def frame(spark, rows):
    full = [(i, t, "en", ["a", "b", None][k % 3], len(t or ""), k, "k", k, "t", k, k, "w", k, 0.5, k, "m") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def table(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)


def by_row(fn, rows=DOCS):
    return sorted([(i, *fn(i, t)) for i, t in rows], key=repr)


EMPTY = [
    lambda s, d: license_table(d), lambda s, d: quality_table(d), lambda s, d: mix_table(d), lambda s, d: line_table(d), lambda s, d: near_duplicate_table(d), lambda s, d: repeat_table(d),
    lambda s, d: score_table(d), lambda s, d: token_table(d, tokenizer()), lambda s, d: contamination_table(d, items(s)), lambda s, d: toxicity_table(d, labels(s, [])),
]


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def items(spark, rows=((1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),)):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_empty_tables(spark, k):
    assert EMPTY[k](spark, frame(spark, [])).count() == 0


# ------------------------------------------------------------------ native operators


def test_license_scan(docs):
    def want(_, t):
        w, starts, found = ALNUM.findall(low(t)), [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            places = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            starts += places
            found |= {label} if places else set()
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))

    out = license_table(docs)
    assert table(out, "n_words", "n_base", "first_word", "last_word", "base_labels") == by_row(want)
    for r in out.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality_rules(docs):
    def want(_, t):
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)

    out = quality_table(docs)
    assert table(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == by_row(want)
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())


def test_mix_targets_and_reruns(spark, docs):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got["b"] == 30.0 and got["c"] == 0.0 and got["a"] == 300.0 and got[None] == pytest.approx(780.0)
    out = mix_table(docs)
    assert table(out, "size") == by_row(lambda _, t: (len(WORD.findall(t or "")),))
    assert table(out, "taken") == table(mix_table(docs.repartition(1)), "taken")
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out.collect())
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(5 + id % 40 as int))").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0)).alias("source"))
    for r in mix_table(many).join(many, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r["t"] == pytest.approx(r["g"], rel=0.02)
    assert set(docs.columns) < set(mix_sources(docs).columns)


@pytest.mark.parametrize("ids", ["null", "cast(id % 2 as int)"])
def test_rows_of_one_id_are_taken_by_themselves(spark, ids):
    rows = spark.range(2000).select(F.expr(ids).cast("long").alias("doc_id"), F.lit("w w w w w w w w w w").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"))
    for r in mix_table(rows).groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 10


def test_license_votes_stay_linear(spark):
    import time

    text = "mit license cc by nc 4 0 " * 16_000
    began = time.time()
    row = license_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row["n_base"] == 16_000 and row["base_labels"] == "mit" and time.time() - began < 8


def test_license_labels_against_plain_counting(spark):
    from tessera.llm.license_scan import MIN_AGREEMENT, RARE_WORDS, TEMPLATES, gate_words, rare_index

    assert "with" not in gate_words(rare_index(), [])
    split = [t.split() for _, t, _ in TEMPLATES]
    idf = {w: math.log((1 + len(split)) / sum(w in t for t in split)) for t in split for w in t}

    def want(_, text):
        words = ALNUM.findall(low(text))
        norm, found = f" {' '.join(words)} ", set()
        for (label, _, phrases), t in zip(TEMPLATES, split, strict=True):
            rare = sorted(set(t), key=lambda w: (-idf[w], t.index(w)))[:RARE_WORDS]
            if all(f" {p} " in norm for p in phrases):
                mass = max((sum(idf[w] for w in rare if 0 <= s + t.index(w) < len(words) and words[s + t.index(w)] == w) for s in range(-len(t), len(words))), default=0)
                found |= {label} if mass / sum(idf[w] for w in rare) >= MIN_AGREEMENT else set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            found |= {label} if f" {phrase} " in norm else set()
        return (",".join(sorted(found)),)

    rows = [(k, f"Some text; {t}. More {' '.join(p)}") for k, (_, t, p) in enumerate(TEMPLATES)] + [(50 + k, " ".join(w for i, w in enumerate(t) if i % 3)) for k, t in enumerate(split)]
    rows += [(90, "with or without fee"), (91, "free of charge, permission is hereby granted"), (92, None), (93, "this list of conditions; Redistributions of source code")]
    got = table(license_table(frame(spark, rows)), "labels")
    assert got == by_row(want, rows) and {"bsd", "isc", "mpl", "cc-by"} <= {x for r in got for x in r[1].split(",")}


# ------------------------------------------------------------------ lines


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.int64)).view(np.uint64)
    index = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(index.lookup(keys).tolist()) == list(range(len(keys))) and index.n == len(keys)
    assert len(PerfectHash.build(np.zeros(0, np.uint64)).lookup(keys)) == len(keys)


@pytest.mark.parametrize(("most", "shard"), [(1 << 20, 200_000), (60, 3), (0, 2)])
def test_line_dedup(docs, most, shard):
    out = drop_repeated_lines(docs, max_index_bytes=most, keys_per_shard=shard)
    out = out.select("doc_id", "ld_n_lines", "ld_n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("d"), "mark", "h")
    assert table(out, "ld_n_lines", "ld_n_dropped", "d") == by_row(brute_lines(DOCS))
    assert sum(r["ld_n_dropped"] for r in out.collect()) >= 30


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\r\x0b\x0c"))
    ids = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            ids[key(x)] |= {i} - {None}

    def want(_, t):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(ids[key(x)]) >= 10)]
        return len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()

    return want


def test_a_document_counts_once_for_a_line(spark):
    rows = [(1, f"shared\nown {k}") for k in range(12)] + [(None, "shared")] * 12 + [(k, "other\nshared") for k in range(2, 10)]
    assert table(line_table(frame(spark, rows)), "n_lines", "n_dropped", "kept_sha256") == by_row(brute_lines(rows), rows)
    rows += [(10, " SHARED ")]
    got = table(line_table(frame(spark, rows)), "n_lines", "n_dropped", "kept_sha256")
    assert got == by_row(brute_lines(rows), rows) and sum(r[2] for r in got) == 33


def test_columns_of_added_names_are_kept(docs):
    def kept(out, name):
        assert {r[f"{name}_in"] for r in out.collect()} == {7}

    kept(drop_repeated_lines(docs.withColumn("LD_N_LINES", F.lit(7))), "LD_N_LINES")
    kept(mix_sources(docs.withColumn("mx_size", F.lit(7))), "mx_size")
    kept(find_contamination(docs.withColumn("dc_runs", F.lit(7)), items(docs.sparkSession)), "dc_runs")
    kept(score_toxicity(docs.withColumn("tx_score", F.lit(7)), None), "tx_score")
    kept(suffix_dedup.cut_repeats(docs.where("doc_id < 5").withColumn("sd_kept", F.lit(7))), "sd_kept")


# ------------------------------------------------------------------ near duplicates


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    s = superminhash([a, b, a[:1], np.zeros(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12
    assert (band_keys(s)[0] == band_keys(s)[1]).any() and not (s[2] == np.iinfo(np.uint64).max).any()


def brute_groups(rows, width, percent=80):
    sets, parent = defaultdict(list), {}
    for i, t in rows:
        w = WORD.findall(low(t))
        s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        if i is not None:
            sets[i].append(s)
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for x, (i, s) in enumerate(flat):
        for j, u in flat[:x]:
            if 100 * len(s & u) >= percent * len(s | u):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize(("cluster", "block"), [(400_000, 1_000_000), (50, 200), (50, 10**6)])
def test_near_dedup(spark, monkeypatch, cluster, block):
    monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", cluster)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 10**6, 150).astype(str).tolist()
    rows = list(DOCS)
    for i in range(100, 190):  # a family of copies that are changed more and more
        copy = list(base)
        for p in rng.choice(len(copy), int(rng.integers(0, 9)), replace=False):
            copy[p] = str(rng.integers(10**6, 10**7))
        rows.append((i, " ".join(copy)))
    want = brute_groups(rows, 4)
    got = near_duplicate_table(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None
    assert len(set(want.values())) < len(want) - 20


def test_one_of_each_group_stays(docs):
    want = brute_groups(DOCS, 5)
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, _ in DOCS if i is not None and want[i] == i)


def test_shingles_of_short_and_shared():
    a, b, c, d = shingle_sets([b"x y z", b"x y z w", b"", b"q x y z w"], 4)
    assert len(a) == 1 and len(c) == 0 and len(set(b.tolist()) & set(d.tolist())) == 1 and a[0] not in b


# ------------------------------------------------------------------ benchmark


def test_decontamination(spark, docs):
    passage = DOCS[15][1].split("\n")[1]
    bench = [(1, passage), (2, DOCS[3][1]), (3, "One"), (4, ""), (5, None), (1, "café it s"), (6, "a b c " * 9), (7, passage)]
    windows = defaultdict(set)
    for k, t in bench:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(k)

    def want(_, t):
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= x
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)

    columns = "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert table(contamination_table(docs, items(spark, bench)), *columns) == by_row(want)
    sharded = find_contamination(docs, items(spark, bench), shard_bytes=300)
    assert table(sharded, "dc_n_words", "dc_n_hit") == by_row(lambda i, t: want(i, t)[:2])
    clean = decontaminate(docs, items(spark, bench))
    assert clean.columns == docs.columns
    assert contamination_table(clean, items(spark, bench[:2])).where("contaminated").count() == 0


def test_automaton_does_not_cross_items():
    machine = SuffixAutomaton([("a", word_list("p q")), ("b", word_list("r s t"))], 2)
    assert machine.stream(word_list("p q r s")) == ([[0, 4]], {0, 1})
    assert machine.stream(word_list("q r"))[0] == []


# ------------------------------------------------------------------ suffixes


@pytest.mark.parametrize("letters", [2, 1024])
def test_suffix_array(monkeypatch, letters):
    monkeypatch.setattr(suffix_array_module, "MAX_LETTERS", letters)
    rng = np.random.default_rng(3)
    for k in range(150):
        s = np.concatenate([np.tile(rng.integers(1, 2 + rng.integers(0, 4), rng.integers(0, 50)), 1 + k % 4), [0]])
        order, each = suffix_array(s), s.tolist()
        assert order.tolist() == sorted(range(len(s)), key=lambda i: each[i:])
        prefixes = permuted_common_prefixes(s.astype(np.uint16), order, 20)
        for x, y in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            n = next(n for n in range(len(s)) if each[x + n] != each[y + n])
            assert prefixes[x] == min(n, 20)


def brute_spans(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        spans = []
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "group", "long"), [(3 << 20, 1 << 20, 1 << 26), (2000, 1 << 20, 500), (2000, 600, 1 << 26)])
def test_suffix_dedup(spark, monkeypatch, shard, group, long):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup, "LONG_BYTES", long)
    rows = [r for r in DOCS if r[0] != 8]
    part = DOCS[8][1][:900]
    rows += [(200 + i, DOCS[8][1][2000 + 300 * i : 2300 + 300 * i] + part[i * 7 : 250 + i * 40] + DOCS[8][1][9000 + 99 * i : 9150 + 99 * i]) for i in range(12)] + [(300, part + "\n" + part), (301, "ab" * 400)]
    got = repeat_table(frame(spark, rows))
    assert table(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_spans(rows, 200)


# ------------------------------------------------------------------ tokens


def test_token_counts(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "CHUNK_CHARS", 64)
    machine = Tokenizer.from_file(tokenizer())
    want = by_row(lambda _, t: (len((t or "").encode()), (n := len(machine.encode(t or "", add_special_tokens=False).ids)), n > 1024))
    assert table(token_table(docs, tokenizer()), "n_bytes", "n_tokens", "over_limit") == want


def test_chunk_maps_compose(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "CHUNK_CHARS", 7)
    machine, library = token_count.BpeTransducer(open(tokenizer(), encoding="utf-8").read()), Tokenizer.from_file(tokenizer())
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(list("ab e'st\n\t 12!?é漢😀<|>"), rng.integers(0, 60)))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    monkeypatch.setattr(token_count, "MAX_WORDS", 9)  # states are forgotten again and again
    for text in ("it's we're 'they''ll 'd'r'v !'s 's\n't\t've  'm", "don'ts 'S I'LL '", "a  b   c \n d\n\n", " \u00a0x\u2003\u2003y", "'", "''s", "r'e l'l 'l", "1'2's", "\r\n\r\n x"):
        for k in range(len(text)):
            assert machine.count(text[k:]) == len(library.encode(text[k:], add_special_tokens=False).ids), text[k:]
    long = "x1é" * 20000
    assert machine.count(long) == len(library.encode(long, add_special_tokens=False).ids)


# ------------------------------------------------------------------ language model


def test_base_score_and_bits(docs):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = Counter()
    for i, t in DOCS:
        if not held(i):
            c.update([*WORD.findall(low(t)), None])
    n, v = sum(c.values()), len(c)

    def want(i, t):
        w = [*WORD.findall(low(t)), None]
        return held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)

    out = score_table(docs)
    assert table(out.withColumn("base_score", F.round("base_score", 5)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == by_row(want)
    assert all(r["score"] < 0 for r in out.collect())


def test_rare_words_are_joined(docs):
    from tessera.llm.lm_score import score_texts

    slim = docs.select("doc_id", "text")
    a = score_texts(slim, F.lit(True), head=3).withColumn("b", F.round("lm_base", 6))
    b = score_texts(slim, F.lit(True)).withColumn("b", F.round("lm_base", 6))
    assert table(a, "b", "lm_n_known") == table(b, "b", "lm_n_known")


def test_tree_is_a_distribution_and_matches_the_recursion():
    """Depth 1 against weights worked out from scalar recursion."""
    text = b"abracadabra" * 3
    counts = {(-1, text[0]): 1}
    levels = [(np.zeros(1, np.int64), np.zeros((1, 256)))]
    for a, b in zip(b"\0" + text, text, strict=False):
        counts[(a, b)] = counts.get((a, b), 0) + 1
        levels[0][1][0, b] += 1
    kept = [ord("a"), ord("b")]
    deep = np.zeros((2, 256))
    for a, b in zip(b"\0" + text, text, strict=False):
        if a in kept:
            deep[kept.index(a), b] += 1
    tree = ContextTree.weigh([levels[0], (np.array(kept), deep)])
    assert np.allclose((10.0**tree.logs).sum(1), 1, atol=1e-4)

    def kt(z, o):
        p = 1.0
        for k in range(int(z)):
            p *= (k + 0.5) / (k + 1)
        for k in range(int(o)):
            p *= (k + 0.5) / (z + k + 1)
        return p

    one = np.zeros((1, 255))
    for node in range(255):
        level = (node + 1).bit_length() - 1
        prefix = node - (1 << level) + 1
        take = lambda c, bit: c[[x for x in range(256) if x >> (8 - level) == prefix and (x >> (7 - level)) & 1 == bit]].sum()  # noqa: B023, E731
        root = levels[0][1][0]
        rest = root - deep.sum(0)
        split = kt(take(rest, 0), take(rest, 1)) * kt(take(deep[0], 0), take(deep[0], 1)) * kt(take(deep[1], 0), take(deep[1], 1))
        own = kt(take(root, 0), take(root, 1))
        w = own / (own + split)
        est = lambda c: (take(c, 1) + 0.5) / (take(c, 0) + take(c, 1) + 1)  # noqa: B023, E731
        one[0, node] = w * est(root) + (1 - w) * est(deep[0])
    assert np.allclose(byte_logs(one)[0], tree.logs[tree.first[1]], atol=1e-4)


def test_rare_contexts_stay_in_the_tree(spark, monkeypatch):
    """Scores against a tree in one place that holds every context; a context met once in 90,000 bytes counts."""
    import random

    from tessera.llm import lm_score
    from tessera.llm.context_tree import DEPTH, gram_array

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 9_000)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg ", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(150)] + ["xylophon quartz"]
    assert sum(map(len, texts)) > 1 << 16
    gram, _ = gram_array([t.encode() for t in texts], DEPTH)
    levels = []
    for d in range(DEPTH + 1):
        near_last = np.zeros(len(gram), np.int64)
        for k in range(d):
            near_last |= ((gram >> (8 * (DEPTH - k))) & 255) << (8 * k)
        keys, place = np.unique(near_last, return_inverse=True)
        counts = np.zeros((len(keys), 256))
        np.add.at(counts, (place, gram & 255), 1)
        levels.append((keys, counts))
    asked = [*texts, "xylophon quarz", "never seen", "", None]
    want = ContextTree.weigh(levels).log_probabilities([(t or "").encode() for t in asked])
    docs = spark.createDataFrame([*enumerate(asked), *[(-1, t) for t in texts]], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["lm_score"] for r in lm_score.score_texts(docs, F.col("doc_id") < 0).where("doc_id >= 0").collect()}
    assert len(got) == len(asked) and np.allclose([got[i] for i in range(len(asked))], want, rtol=1e-4, atol=1e-3)


# ------------------------------------------------------------------ toxicity


def test_kernel_against_enumeration():
    from itertools import combinations

    def features(s, p, lam):
        out = defaultdict(float)
        for c in combinations(range(len(s)), p):
            out["".join(s[i] for i in c)] += lam ** (c[-1] - c[0] + 1)
        return out

    words = ["idiot", "id.iot", "banana", "ab"]
    k = subsequence_kernel(encode(words, 8), encode(words, 6), 3, 0.6)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            fa, fb = features(a, 3, 0.6), features(b, 3, 0.6)
            assert k[i, j] == pytest.approx(sum(v * fb.get(x, 0) for x, v in fa.items()), abs=1e-5)


def test_sparse_kernel_leaves_nothing_out():
    rng = np.random.default_rng(9)
    left, right = (["".join(rng.choice(list("abcdefghö"), rng.integers(1, 13))) for _ in range(n)] for n in (700, 30))
    a, b = encode(left, 12), encode(right, 12)
    whole = subsequence_kernel(a, b)
    assert np.allclose(sparse_kernel(a, b), whole, rtol=1e-4, atol=1e-6) and (whole == 0).any() and (whole > 0).any()

    def common(s, t):
        row = [0] * (len(t) + 1)
        for x in s:
            row = [0] + [0] * len(t) if not row else row
            new = [0]
            for k, y in enumerate(t):
                new.append(max(new[-1], row[k + 1], row[k] + (x == y)))
            row = new
        return row[-1]

    lengths = common_subsequence_lengths(a, b)
    assert all(lengths[i, j] == common(left[i], right[j]) for i in range(0, 700, 9) for j in range(30))


def test_toxicity_finds_gapped_words(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeioubcdmnrst"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words, 40))
    clean, toxic = [text() for _ in range(200)], [f"{text()} {'grobnik' if i % 2 else 'Zwaffel!'} {text()}" for i in range(120)]
    model = train(toxic, clean)
    rows = [(1, text()), (2, f"{text()} grobnik"), (3, f"you g r o b n i k you {text()}"), (4, f"{text()} zwa.ffel {text()}"), (5, ""), (6, None), (7, f"{text()} " + "y" * 100 + "grobnik" + "y" * 100), (8, "grobbnik")]
    got = {r["doc_id"]: r["tx_score"] for r in score_toxicity(frame(spark, rows), model).collect()}
    assert got[1] < 0.5 and got[2] >= 0.5 and got[3] >= 0.5 and got[4] >= 0.5 and got[5] < 0.5 and got[6] == got[5] and got[8] >= 0.5
    assert all(0 <= s <= 1 for s in got.values())
    assert train([], clean) is None and train(toxic, []) is None


def test_toxicity_learns_only_from_its_folds(spark):
    rows = [(i, f"word{i} fine text here" + (" grobnik" if i % 3 == 0 else "")) for i in range(300)]
    out = toxicity_table(frame(spark, rows), labels(spark, [(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (0, 0)]))
    got = out.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)


# ------------------------------------------------------------------ scores worked out from the definitions


def test_scores_of_the_tree_from_the_definition(spark):
    """All depths, every node of the bytes' decomposition, in plain recursion over dictionaries."""
    from functools import lru_cache

    from tessera.llm.context_tree import DEPTH, END
    from tessera.llm.lm_score import score_texts

    rng = np.random.default_rng(12)
    training = ["abracadabra alakazam", "", "abra abra é", "".join(rng.choice(list("ab c"), 60))]
    seen: dict = defaultdict(lambda: [0, 0])
    below: dict = defaultdict(set)

    def steps(text):
        data = bytes(DEPTH) + text.encode() + bytes([END])
        for at in range(DEPTH, len(data)):
            context = data[at - DEPTH : at][::-1]  # nearest byte first
            for bit in range(8):
                yield context, (bit, data[at] >> (8 - bit)), (data[at] >> (7 - bit)) & 1

    for text in training:
        for context, node, one in steps(text):
            for d in range(DEPTH + 1):
                seen[context[:d], node][one] += 1
                if d:
                    below[context[: d - 1], node].add(context[:d])

    def estimate(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighed(context, node):
        own = estimate(*seen[context, node])
        if len(context) == DEPTH:
            return own
        return np.logaddexp(own, sum(weighed(c, node) for c in below[context, node])) - math.log(2)

    def probability(context, node, d=0):
        z, o = seen[context[:d], node] if (context[:d], node) in seen else (0, 0)
        here = (o + 0.5) / (z + o + 1)
        if d == DEPTH:
            return here
        share = 0.5 if z + o == 0 else math.exp(estimate(z, o) - math.log(2) - weighed(context[:d], node))
        return share * here + (1 - share) * probability(context, node, d + 1)

    asked = [*training, "abrakadabra", "zebra é", "\x7f"]
    want = [sum(math.log10(p if one else 1 - p) for c, n, one in steps(t) for p in [probability(c, n)]) for t in asked]
    rows = [(i, t) for i, t in enumerate(asked)] + [(-1, t) for t in training]
    got = {r["doc_id"]: r["lm_score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), F.col("doc_id") < 0).where("doc_id >= 0").collect()}
    assert np.allclose([got[i] for i in range(len(asked))], want, rtol=2e-5, atol=2e-4)


def test_toxicity_scores_from_single_kernels(spark):
    """The scored table against one kernel value at a time, without pruning or batches."""
    from tessera.llm.toxicity import pieces, training_texts, units

    rng = np.random.default_rng(16)
    words = ["".join(rng.choice(list("aeioubcdmnrst"), rng.integers(3, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" grobnik" if i % 3 == 0 else "")) for i in range(150)] + [(500, None), (501, ""), (502, "g.r.o.b.n.i.k"), (503, "x" * 60 + "grobnik")]
    marks = labels(spark, [(i, int(i % 3 == 0)) for i in range(150)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train(*training_texts(docs, marks))

    def value(unit):
        return max(float((subsequence_kernel(encode([p], len(p)), model.codes)[0] / model.scale) @ model.direction) + model.bias for p in pieces(unit))

    known = {u: value(u) for _, t in rows for u in units(t)}
    want = {i: 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * (max((known[u] for u in units(t)), default=model.bias) - model.shift))))) for i, t in rows}
    for r in toxicity_table(docs, marks).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-4) and r["predicted"] == int(want[r["doc_id"]] >= 0.5)


# ------------------------------------------------------------------ components


def test_components_with_a_hub(spark, monkeypatch):
    """One node with 100,000 links, a long chain, a ring and a pair, dealt out in any order."""
    from tessera.llm import common

    star = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(7_000_000).cast("long").alias("b"))
    extra = [(200_000 + i, 200_001 + i) for i in range(60)] + [(300_000, 300_001), (300_001, 300_002), (300_002, 300_000), (5, 5), (400_001, 400_000), (400_000, 400_001)]
    edges = star.union(spark.createDataFrame(extra, "a long, b long"))
    got = common.connected_components(edges)
    assert got.where("node = 7000000 or node between 1 and 100000").select("component").distinct().collect() == [(1,)]
    assert got.count() == got.select("node").distinct().count() == 100_001 + 61 + 3 + 2
    rest = {r["node"]: r["component"] for r in got.where("node between 200000 and 500000").collect()}
    assert rest == {**{200_000 + i: 200_000 for i in range(61)}, **{300_000 + i: 300_000 for i in range(3)}, 400_000: 400_000, 400_001: 400_000}
    monkeypatch.setattr(common, "HUB_LINKS", 2)  # nearly all nodes are hubs
    small = [(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 90, (70, 2))]
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in small:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(small, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in small if e[0] != e[1] for x in e}}
