"""Hand-computed cases, order invariance and edge rows of the retrieval and claim operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, intervals, text, urls
from tessera.operators import chunking, claims, dense, evaluation, fusion, lexical, markdown, metrics, policy
from tessera.sources import store, tables
from tessera.streaming import events


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens_and_canonical(spark):
    df = spark.createDataFrame([(1, " A\tb  c "), (2, ""), (3, None)], "id int, t string")
    got = {r[0]: r[1] for r in df.select("id", text.tokens(F.col("t"))).collect()}
    assert got == {1: ["a", "b", "c"], 2: [], 3: []}
    one = spark.createDataFrame([("é  x",)], "t string").select(text.canonical(F.col("t"))).first()[0]
    assert one == "é x"


def test_occurrences_overlap_and_count_code_points(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("a😀b😀", "😀"), ("abc", "x"), ("abc", "")], "t string, q string")
    got = [r[0] for r in df.select(text.occurrences(F.col("t"), F.col("q"))).collect()]
    assert got == [[0, 1, 2], [1, 3], [], []]


def test_slug_excerpt_ratio(spark):
    r = spark.range(1).select(text.slug(F.lit("R&D: The  Plan!")), text.excerpt(F.lit("# one two three"), 8), text.ratio(F.lit(1), F.lit(0), "none")).first()
    assert r[0] == "randd-the-plan" and r[1] == "one two…" or r[1] == "one…"
    assert r[2]["value"] is None and r[2]["undefined"] and r[2]["reason"] == "none"


URLS = [
    ("https://Example.COM", "https://example.com/"), ("https://a.b:443/x?q=1#f", "https://a.b/x?q=1"), ("http://a.b/", None), ("https://u@a.b/", None), ("https://a.b:8443/", None), ("https://a.b/%zz", None), ("https://a.b/%41", "https://a.b/%41"),
    ("https://127.0.0.1/", None), ("https://2130706433/", None), ("https://0x7f.1/", None), ("https://09.1.1.1/", None), ("https://010.8.8.8/", "https://8.8.8.8/"), ("https://8.8.8.8/x", "https://8.8.8.8/x"), ("https://10.0.0.1/", None), ("https://192.168.1.1/", None),
    ("https://[::1]/", None), ("https://[2606:4700::1111]/", "https://[2606:4700::1111]/"), ("https://localhost/", None), ("https://x.localhost/", None), ("https://printer.local/", None), ("https://bücher.example/a", "https://xn--bcher-kva.example/a"),
    ("https://-a.example/", None), ("https://a_b.example/", None), ("https://" + "a" * 64 + ".example/", None), ("https://" + "a" * 63 + ".example/", "https://" + "a" * 63 + ".example/"), ("https://a.example\\x", None), ("https://a.example/a b", "https://a.example/a b"),
    ("https://a.example/\ttab", None), (" https://a.example/ ", "https://a.example/"), ("", None), (None, None), ("https://", None), ("HTTPS://A.example./", "https://a.example/"), ("https://1.2.3.4.5/", None), ("https://a.1/", None), ("https://example.com:99999/", None), ("https://224.0.0.1/", None),
    ("https://0x/x", None), ("https://0x.0x./x", None), ("https://09./x", None), ("https://example.com:abc/x", None), ("https://example.com:+443/x", None), ("https://[::ffff:8.8.8.8]/", "https://[::ffff:808:808]/"), ("https://[::ffff:10.0.0.1]/", None),
    ("https://[2001:db8::1]/", None), ("https://[fe80::1]/", None), ("https://[2606:0:0:1:0:0:0:1]/", "https://[2606:0:0:1::1]/"), ("https://[1:2:3:4:5:6:7:8]/", "https://[1:2:3:4:5:6:7:8]/"), ("https://[2606::1::2]/", None), ("https://[ff02::1]/", None),
    ("https://134744072/x", "https://8.8.8.8/x"), ("https://exa_mple.com/x", None), ("https://example..com/x", None), ("https://" + ".".join(["a" * 63] * 4) + "/x", None), ("https://a.b/?", "https://a.b/"), ("https://a.b?q", "https://a.b/?q"), ("https://a.b:/x", "https://a.b/x"),
]


def test_url_normal_form(spark):
    rows = spark.createDataFrame(list(enumerate(u for u, _ in URLS)), "i int, u string").select("i", urls.normalize(F.col("u")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: want for i, (_, want) in enumerate(URLS)}


def test_public_hosts(spark):
    hosts = ["example.com", "localhost", "127.0.0.1", "0x7f.1", "10.1", "8.8.8.8", "017700000001", None, "a.local"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(urls.is_public_host("h")).collect()]
    assert got == [True, False, False, False, False, True, False, False, False]


def test_bm25_hand_computed(spark):
    import math

    units = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d"), (4, None)], "unit_id long, text string")
    queries = spark.createDataFrame([(7, "b b x")], "query_id long, text string")
    got = lexical.bm25_scores(lexical.build_index(units), queries).collect()
    idf, avg = math.log(4 - 1 + 0.5) - math.log(1.5), 6 / 4
    want = 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))
    assert [(r["query_id"], r["unit_id"]) for r in got] == [(7, 1)] and got[0]["score"] == pytest.approx(want)


def test_dense_order_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "unit_id long, embedding array<float>")
    got = rows(dense.nearest(spark, v.where("unit_id = 1").withColumnRenamed("unit_id", "query_id"), v, 2), "query_id", "unit_id", "rank")
    assert got == [(1, 1, 1), (1, 3, 2)]


def test_rrf_counts_from_zero(spark):
    d = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.5, 2)], "query_id long, unit_id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 9.0, 1)], "query_id long, unit_id long, score double, rank int")
    got = rows(fusion.rrf(d, b), "unit_id", "rrf_score", "rank")
    assert got == [(10, round(1 / 60, 8), 2), (11, round(1 / 61 + 1 / 60, 8), 1)]


def test_pack_skips_and_goes_on(spark):
    data = [(1, 1, 1, "SEED", 100, 900), (1, 2, 0, "PREVIOUS", 101, 1500), (1, 3, 2, "NEXT", 102, 200), (1, 3, 1, "SEED", 103, 10)]
    schema = "query_id long, seed_rank int, pos int, relation string, unit_id long, tokens int"
    for order in itertools.permutations(data):
        got = rows(fusion.pack(spark.createDataFrame(list(order), schema)), "unit_id", "packed", "packed_order")
        assert got == [(100, True, 0), (101, False, None), (102, True, 2), (103, True, 1)]
        break
    with pytest.raises(Exception, match="budget"):
        fusion.pack(spark.createDataFrame(data, schema), budget=905).collect()


def test_neighbours_stay_in_their_document(spark):
    units = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "b", 0)], "unit_id long, document string, start int")
    seeds = spark.createDataFrame([(9, 2, 1), (9, 1, 2)], "query_id long, unit_id long, rank int")
    got = rows(fusion.first_seen(fusion.expand(seeds, fusion.with_neighbours(units))), "unit_id", "relation", "seen")
    assert got == [(1, "PREVIOUS", 2), (2, "SEED", 2)]


def test_metrics_table(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "c"), (2, 1, "a"), (2, 2, "x"), (2, 3, "b")], "query_id long, rank int, source string")
    qrels = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 1), (3, "z", 1)], "query_id long, source string, grade int")
    got = {r["query_id"]: r for r in metrics.metrics_at(ranked, qrels, 3).collect()}
    assert (got[1]["mrr"], round(got[1]["ndcg"], 3)) == (0.5, 0.631)
    assert (got[2]["mrr"], round(got[2]["ndcg"], 3)) == (1.0, 0.920)
    assert not got[3]["hit"] and got[3]["recall"] == 0.0


def test_classify_prefers_loss(spark):
    df = spark.createDataFrame([(0.1, -0.1), (0.0, 0.2), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(metrics.classify([F.col("a"), F.col("b")])).collect()] == ["REGRESSED", "IMPROVED", "SAME"]


def test_islands_touching(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 6), (1, 5, 6)], "k int, s int, e int")
    assert rows(intervals.islands(df, ["k"]), "s", "e", "n") == [(0, 3, 2), (5, 6, 2)]
    assert len(rows(intervals.islands(df, ["k"], touch=False), "s")) == 3
    assert rows(intervals.overlap_chars(df, ["k"]), "total", "covered", "overlap") == [(5, 4, 1)]
    spans = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 2, 6)], "k int, span_id int, gs int, ge int")
    assert rows(intervals.covered_spans(spans, df, ["k"]), "span_id", "covered") == [(1, True), (2, False)]


def test_fixed_windows_trailing_overlap(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(360)))), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(chunking.fixed_windows(docs), "doc_id", "chunk_index", "n_tokens") == [(1, 0, 360), (1, 1, 10)]


MARKDOWN = "# T\nintro line\n\n## A ##\n- x\n  y\n- z\n\n```py\n# no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSet\n===\n> q\n\n---\n    code\n"


def test_markdown_blocks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "~~~\n```\n\n~~~ x\n~~~~\n- a\n\n- b\nlazy\n---\n\n    c\n\nt\n    u\nv\n")], "doc_id long, text string")
    blocks = markdown.siblings(markdown.markdown_blocks(docs)).orderBy("doc_id", "ordinal").collect()
    first = [r for r in blocks if r["doc_id"] == 1]
    kinds = [("heading", 1), ("paragraph", 0), ("heading", 2), ("list", 0), ("fenced_code", 0), ("table", 0), ("heading", 1), ("blockquote", 0), ("thematic_break", 0), ("code", 0)]
    assert [(r["kind"], r["level"]) for r in first] == kinds
    assert all(MARKDOWN[r["start"] : r["end"]] == r["content"] and r["title"] == "T" for r in first)
    assert first[1]["heading_path"] == ["T"] and first[3]["heading_path"] == ["T", "A"] and first[7]["heading_path"] == ["Set"]
    assert [r["parent"] for r in first] == [None, 0, 0, 2, 2, 2, None, 6, 6, 6] and first[3]["next"] == 4 and first[4]["previous"] == 3 and first[1]["next"] == 2
    assert [(r["kind"], r["line"]) for r in blocks if r["doc_id"] == 3] == [("fenced_code", 1), ("list", 6), ("thematic_break", 10), ("code", 12), ("paragraph", 14)]


def test_arrays(spark):
    bins = arrays.greedy_bins(F.array(*[F.lit(x) for x in (3, 4, 9, 1, 1, 5)]), F.lit(7))
    none = arrays.greedy_bins(F.array().cast("array<int>"), F.lit(7))
    r = spark.range(1).select(arrays.running_sum(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5)])), arrays.running_max(F.array(*[F.lit(x) for x in (-1, 2, 1, 4, 0)])), arrays.places(F.lit("😀ab  c"), r"\S+"), bins, none, arrays.places(F.lit(""), "x")).first()
    assert r[0] == [1, 3, 6, 10, 15] and r[1] == [-1, 2, 2, 4, 4]
    assert [tuple(x) for x in r[2]] == [(0, 3), (5, 6)] and [tuple(x) for x in r[3]] == [(0, 1, 7), (2, 2, 9), (3, 5, 7)] and r[4] == [] and r[5] == []


@pytest.mark.parametrize(
    ("support", "entailed", "blocked", "want"),
    [(1, 1, 0, "verified"), (1, 1, 1, "weak"), (1, 0, 0, "weak"), (1, 0, 1, "weak"), (0, 1, 0, "INVALID"), (0, 1, 1, "INVALID"), (0, 0, 0, "unverified"), (0, 0, 1, "unverified")],
)
def test_truth_table(spark, support, entailed, blocked, want):
    got = spark.range(1).select(claims.claim_status(F.lit(bool(support)), F.lit(bool(entailed)), F.lit(bool(blocked)))).first()[0]
    assert got == want


def test_inventory_merge_does_not_depend_on_order(spark):
    schema = "claim_id string, pos int, section string, claim_type string, material string, reason string, starts array<int>, ambiguous boolean, req_ids array<string>, requires_citation boolean"
    data = [("c", 1, "s1", "factual", "false", "", [], False, ["r2"], False), ("c", 2, "s2", "definition", "unknown", "why", [4, 2], False, ["r1", "r2"], False), ("d", 3, "s", "definition", "true", None, [1], True, [], False)]
    for order in (data, data[::-1]):
        got = {r["claim_id"]: r for r in claims.build_inventory(spark.createDataFrame(order, schema)).collect()}
        assert (got["c"]["section"], got["c"]["material"], got["c"]["reason"], got["c"]["starts"], got["c"]["req_ids"], got["c"]["validity"]) == ("s1", "unknown", "why", [2, 4], ["r2", "r1"], "bound_multiple")
        assert got["c"]["requires_citation"] and got["d"]["validity"] == "ANCHOR_AMBIGUOUS" and got["d"]["requires_citation"]


def test_uvr_null_fails_the_gate(spark):
    df = spark.createDataFrame([(0.15,), (0.16,), (None,)], "u double")
    assert [r[0] for r in df.select(claims.accepted(F.col("u"))).collect()] == [True, False, False]


def test_markers_coverage_and_insert(spark):
    docs = spark.createDataFrame([(1, "ab [KB-001] c [E2]"), (2, None)], "doc_id long, text string")
    found = policy.markers(docs)
    assert rows(found, "doc_id", "evidence_id", "place") == [(1, "E2", 14), (1, "KB-001", 3)]
    groups = spark.createDataFrame([(1, 0, 2, ["KB-001", "WEB-001"])], "doc_id long, start int, `end` int, evidence_ids array<string>")
    assert rows(policy.citation_coverage(groups, found), "required", "covered", "coverage") == [(2, 1, 0.5)]
    places = F.array(F.struct(F.lit(1).alias("place"), F.lit("[1]").alias("marker")), F.struct(F.lit(2).alias("place"), F.lit("[2]").alias("marker")))
    assert spark.range(1).select(policy.insert_markers(F.lit("abc"), places)).first()[0] == "a[1]b[2]c"


def test_matching_is_largest():
    edges = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "y"), ("c", "z")]
    for order in itertools.permutations(edges):
        assert len(evaluation.match_pairs(list(order))) == 3
    assert evaluation.match_pairs([]) == []


def test_confusion_keeps_zeros_and_empty(spark):
    df = spark.createDataFrame([], "g int, p int")
    assert rows(evaluation.confusion(df, "g", "p", [0, 1]), "n") == [(0,)] * 4


def test_journal_and_upsert(spark):
    held = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6)], "k string, v int")
    assert rows(store.reserve_once(held, new, ["k"], [F.col("v")]), "k", "v") == [("b", 6)]
    assert rows(store.upsert(held, new.where("v = 5"), ["k"]), "k", "v") == [("a", 5)]


def test_files_and_fingerprint(spark, tmp_path):
    (tmp_path / "a.md").write_text(" x \n")
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.pdf").write_text("no")
    assert [r["content"] for r in tables.text_corpus(spark, str(tmp_path)).collect()] == ["x"]
    assert tables.unsupported_files(spark, str(tmp_path)).count() == 1
    a = spark.createDataFrame([("1", "x"), ("2", None)], "chunk_id string, t string")
    b = spark.createDataFrame([("2", None), ("1", "x")], "chunk_id string, t string")
    assert tables.fingerprint(a).first() == tables.fingerprint(b).first() != tables.fingerprint(a.where("chunk_id = '1'")).first()


def test_stream_gives_the_batch_rows(spark, tmp_path):
    data = [(i, f"2024-01-01 0{i % 3}:00:00", i % 2, "click", 1.0, "{}") for i in range(9)]
    batch = spark.createDataFrame(data, "event_id long, t string, user_id long, event_type string, value double, props string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props")
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.first_of_key(events.event_stream(spark, str(tmp_path / "in")), ["event_id"])
    events.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_id") == [(i,) for i in range(9)]
    assert sum(r[0] for r in rows(events.tumbling(batch), "n")) == 9


def test_streamed_runs_end_as_batch_runs(spark, tmp_path):
    import random

    from tessera.operators import evidence

    rng = random.Random(4)
    schema = "run_id long, ts long, step_id long, kind string, cost double"
    data = [(rng.randrange(12), t, t, rng.choice(["step", "step", "step", "fail", "publish"] if t > 60 else ["step", "fail"]), rng.choice([0.004, 0.011])) for t in range(150)]
    for part in range(3):  # in order of arrival
        spark.createDataFrame(data[part * 50 : part * 50 + 50], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={part}"))
    want = evidence.run_outcomes(spark.createDataFrame(data, schema), "run_id", ["ts", "step_id"], "kind", "cost").where("outcome <> 'running'")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    events.append_stream(events.run_ends(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.withColumn("spent", F.round("spent", 6)), "run_id", "n_steps", "outcome", "spent") == rows(want.withColumn("spent", F.round("spent", 6)), "run_id", "n_steps", "outcome", "spent")
    assert got.count() > 6
