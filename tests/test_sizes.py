"""What is held at a time, and what is shuffled, stays bounded; results are those of plain rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import registry, vocabulary
from tessera.operators import dense


def test_vocabulary_is_given_a_bounded_number_of_characters():
    class Encoded:
        def __init__(self, text):
            self.offsets = [(i, i + 1) for i in range(len(text))]

    given = []

    def encode(run):
        given.append(sum(map(len, run)))
        return [Encoded(t) for t in run]

    texts = ["ab" * 20_000, "", None, "c"] * 12
    got = vocabulary._placed(encode, pa.array(texts)).to_pylist()
    assert max(given) <= vocabulary.AT_ONCE and len(given) > 1
    assert got == [[{"start": i, "end": i + 1} for i in range(len(t or ""))] for t in texts]


def test_registered_counter_is_given_few_rows(spark):
    registry.register("tokenizer", "pieces", lambda t: len(t.split()))
    count = registry.token_counter("pieces")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    rows = spark.createDataFrame([("a b c",), ("",), (None,)], "t string").select(count("t").alias("n")).collect()
    assert [r["n"] for r in rows] == [3, 0, 0]


def test_nearest_scores_tiles_and_keeps_ties_by_id(spark):
    vectors = np.array([[i % 7, i % 3, 1] for i in range(400)], float)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["unit_id", "embedding"])
    tiles = list(dense._tiles([batch, batch.slice(0, 0)], 33))
    assert max(len(u) for u, _ in tiles) == 33 and np.array_equal(np.concatenate([v for _, v in tiles]), vectors)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "unit_id long, embedding array<double>")
    got = dense.nearest(spark, rows.where("unit_id % 20 = 0").withColumnRenamed("unit_id", "query_id"), rows, 9, include_self=False).collect()
    scores = np.round(vectors @ vectors.T, 9)
    for q in range(0, 400, 20):
        want = [u for u in sorted(range(400), key=lambda u: (-scores[q, u], u)) if u != q][:9]
        assert [r["unit_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _dir(spark, tmp_path, **tables):
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_inserted_markers_shuffle_nothing(spark, tmp_path):
    from hashlib import md5

    from tessera.plans import runs

    texts = ["a\n\nbc", "", None, "\nüx\n"]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = runs.inserted_markers(spark, _dir(spark, tmp_path, documents=_documents(spark, texts), labels=labels))
    assert "Aggregate" not in _plan(out) and "Join" not in _plan(out)
    marked = {i: "\n".join(x + f"[{k}]" if x else x for k, x in enumerate(t.split("\n"))) for i, t in enumerate(texts) if t is not None}
    assert {r["run_id"]: (r["marked_md5"], r["chars"]) for r in out.collect()} == {i: (md5(t.encode()).hexdigest(), len(t)) for i, t in marked.items()}


def test_block_errors_carry_no_text_in_windows(spark):
    from tessera.operators import units

    kind = "doc_id long, ordinal int, block_type string, start int, end int, parent int, previous int, next int"
    good = [(1, 0, "heading", 0, 4, None, None, None), (1, 1, "paragraph", 5, 8, 0, None, 2), (1, 2, "paragraph", 9, 12, 0, 1, None)]
    bad = [(2, 0, "paragraph", 0, 3, None, None, 1), (2, 1, "paragraph", 2, 8, None, None, None), (2, 3, "paragraph", 10, 11, 1, None, None)]
    docs = spark.createDataFrame([(1, "# ab\ncde\nfgh"), (2, "abc de f x yz"), (3, None)], "doc_id long, text string")
    out = units.block_errors(spark.createDataFrame(good + bad, kind), docs)
    assert not any("_t#" in x or "text#" in x for x in _plan(out).splitlines() if "Window [" in x)
    assert sorted(map(tuple, out.collect())) == [(2, 1, "overlap"), (2, 1, "sibling"), (2, 3, "ordinal"), (2, 3, "parent"), (2, 3, "uncovered_tail"), (2, 3, "uncovered_text")]


def test_ranking_reads_document_frequencies_once(spark):
    from tessera.operators import lexical

    units = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, ""), (4, None)], "unit_id long, text string")
    scores = lexical.bm25_scores(lexical.build_index(units), spark.createDataFrame([(7, "b z")], "query_id long, text string"))
    assert "array_distinct" not in _plan(scores)
    assert [(r["query_id"], r["unit_id"]) for r in scores.collect()] == [(7, 1)]


def test_grounding_rows_cut_texts_before_they_are_grouped(spark):
    from tessera.operators import binding

    judged = spark.createDataFrame([(1, "a", "VALID", "weak"), (1, "b", "INVALID", None), (2, "a", "VALID", "verified"), (2, None, "INVALID", None)], "request_id long, claim_id string, validity string, status string")
    support = spark.createDataFrame([(1, "a", 1, "E2", 0, 2), (1, "a", 0, "E1", 2, 5), (1, "b", 0, "gone", 0, 3), (2, "a", 0, "E2", 1, 9)], "request_id long, claim_id string, place int, evidence_id string, start int, end int")
    manifest = spark.createDataFrame([("E1", "web", "u1", "s1", "abcdef"), ("E2", "kb", "u2", "s2", "xyz"), ("E3", "kb", "u3", "s3", None)], "evidence_id string, kind string, url string, source string, source_text string")
    out = binding.grounding_rows(judged, support, manifest)
    assert not any("source_text#" in x for x in _plan(out).splitlines() if "Aggregate [" in x)
    got = {(r["request_id"], r["claim_id"]): (r["status"], r["source_kind"], r["source_url"], r["source_ref"], r["support_text"]) for r in out.collect()}
    assert got == {(1, "a"): ("weak", "web", "u1", "u1", "cde|xy"), (1, "b"): ("unverified", "none", None, None, ""), (2, "a"): ("verified", "kb", None, "kb:s2", "yz")}


def test_leaves_work_the_values_out_once(spark):
    from tessera.operators import nested

    rows = [(1, r'{"a\"[{":["]\\",{"x":[[]],"y":{"z":null}}],"b":{}}'), (2, "[[[[[7]]]]]"), (3, '"[{"'), (4, None), (5, '{"k":""}')]
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "id int, x string").mapInArrow(told, "id int, x string").select("id", F.parse_json("x").alias("v"))
    out = nested.leaves(df, ["id"])
    assert "Union" not in _plan(out)
    got = sorted((r["id"], r["kind"], r["value"]) for r in out.collect())
    assert seen.value == len(rows)
    assert got == [(1, "array", "[]"), (1, "null", "null"), (1, "object", "{}"), (1, "string", r'"]\\"'), (2, "number", "7"), (3, "string", '"[{"'), (5, "string", '""')]
    assert [r["path"] for r in out.where("id = 2").collect()] == ["$[0][0][0][0][0]"]
    assert nested.leaves(df, ["id"], most=6).count() == 7
    try:
        nested.leaves(df, ["id"], most=5)
        raise AssertionError("five levels are too deep")
    except ValueError:
        pass


def test_lines_of_a_document_are_worked_out_once(spark):
    from tessera.operators import markdown

    out = markdown.markdown_blocks(spark.createDataFrame([(1, "# a\n\n```\nx\n```\n- b\n")], "doc_id long, text string"))
    assert _plan(out).count(f"split(_t#{_plan(out).split('split(_t#')[1].split(',')[0]}, {markdown.EOL}") == 1
    assert [(r["kind"], r["content"]) for r in out.orderBy("ordinal").collect()] == [("heading", "# a"), ("fenced_code", "```\nx\n```"), ("list", "- b")]


def test_corpus_invariants_count_a_text_once(spark, tmp_path):
    from tessera.plans import corpus

    out = corpus.corpus_invariants(spark, _dir(spark, tmp_path, documents=_documents(spark, ["a b\nc d e", None, "", "x " * 100])))
    lines = [x for x in _plan(out).splitlines() if "Aggregate [doc_id" in x and "core_words" in x]
    assert len(lines) == 1 and "first(words#" in lines[0]
    got = {r["doc_id"]: (r["words"], r["core_words"]) for r in out.collect()}
    assert set(got) == {0, 2, 3} and all(a == b for a, b in got.values()) and got[3][0] > 100


def test_blocks_parts_and_units_carry_no_document_with_each_row(spark):
    import re

    from tessera.operators import markdown

    long = " ".join(f"word{i} is here." for i in range(120))
    docs = spark.createDataFrame([(1, f"# a\n\n{long}\n\n## b\n\n- x\n- y\n\n> q"), (2, ""), (3, None)], "doc_id long, text string")
    out = markdown.pack_units(markdown.split_blocks(markdown.markdown_blocks(docs), 40), 40)
    carried = re.findall(r"Generate posexplode\([^)]*\), \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert len(carried) == 3
    for held in carried:
        assert not {"_t", "_b", "_u", "content", "c", "words"} & {re.sub(r"#.*", "", x).strip() for x in held.split(",")}
    rows = out.orderBy("unit").collect()
    text = docs.where("doc_id = 1").first()["text"]
    assert {r["doc_id"] for r in rows} == {1} and sum(r["core_tokens"] > 40 for r in rows) == 0
    held = [text[r["core_start"] : r["core_end"]] for r in rows]
    assert " ".join(" ".join(held).split()) == " ".join(text.split())
    assert all(text[r["overlap_start"] - 1].isspace() and len(text[r["overlap_start"] : r["core_start"]].split()) == r["overlap_words"] for r in rows if r["overlap_start"])
    assert any(r["overlap_start"] for r in rows)


def test_neighbours_of_every_row_are_those_of_the_plain_rule(spark, monkeypatch):
    random = np.random.default_rng(5)
    vectors = random.standard_normal((700, 8)).round(2).astype(np.float32)
    vectors[100:400] = vectors[7]  # copies tie by id
    ids = random.permutation(5000)[:700] - 900
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)] + [(None, vectors[0].tolist()), (-5000, None), (9000, None)], "unit_id long, embedding array<float>")
    monkeypatch.setattr(dense, "BLOCK", 150)
    out = dense.neighbours(rows, 9)
    scores = {(int(i), int(j)): s for i, line in zip(ids, np.round(vectors.astype(float) @ vectors.astype(float).T, 9), strict=True) for j, s in zip(ids, line, strict=True)}
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["unit_id"])
        if {r["query_id"], r["unit_id"]} & {-5000, 9000}:  # null vectors have no score
            assert r["score"] is None
        else:
            assert abs(r["score"] - scores[r["query_id"], r["unit_id"]]) < 1e-8
    known = sorted(map(int, ids))
    assert set(got) == {*known, -5000, 9000}
    for q in known:
        assert got[q] == [u for u in sorted(known, key=lambda u: (-scores[q, u], u)) if u != q][:9]
    assert got[9000] == [-5000, *known[:8]] and got[-5000] == known[:9]


def test_dense_topk_asks_with_every_vector(spark, tmp_path):
    from tessera.plans import catalog

    rows = [(i, [float(i % 5), 1.0], i % 2) for i in range(43)]
    out = catalog.dense_topk(spark, _dir(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).collect()
    assert {r["query_id"] for r in out} == set(range(43)) and len(out) == 430
    assert [r["unit_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 9] == [4, 14, 19, 24, 29, 34, 39, 3, 8, 13]


def test_ab_classification_has_every_vector(spark, tmp_path):
    from tessera.plans import catalog

    rows = [(i, [float(i % 5), 1.0], i % 5 // 4) for i in range(45)]
    out = catalog.ab_classification(spark, _dir(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).collect()
    # a vector of label 1 has eight copies, then two of label 0; all that a vector of label 0 finds first are of label 1
    assert {r["query_id"]: (r["delta"], r["class"]) for r in out if r["query_id"] % 5 == 4} == {i: (-0.2, "REGRESSED") for i in range(4, 45, 5)}
    assert {r["query_id"] for r in out} == set(range(45))


def test_ir_metrics_have_every_vector(spark, tmp_path):
    from tessera.plans import catalog

    rows = [(i, [float(i % 5), 1.0], i % 5 // 4) for i in range(45)] + [(45, [9.0, 1.0], 7)]
    out = catalog.ir_metrics(spark, _dir(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).collect()
    # 45 is nearest to all others but to 0, 5, ..., whose scores are all alike; no other has its label
    got = {r["query_id"]: (r["hit"], r["recall"], r["precision"], r["mrr"]) for r in out}
    assert set(got) == set(range(45))
    assert {got[i] for i in range(4, 45, 5)} == {(True, 1.0, 0.8, 0.5)} and {got[i] for i in range(1, 45, 5)} == {(False, 0.0, 0.0, 0.0)}
    assert got[0] == (True, round(8 / 35, 6), 0.8, 1.0)  # 1 to 10 without 4 and 9
