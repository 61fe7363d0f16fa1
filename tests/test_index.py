"""Index tables, run records and the corpus compiler."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, markdown
from tessera.sources import index

TEXT = "# A title\n\nSome words here. And more of them.\n\n## Part\n\n1. one\n2. two\n\n~~~\ncode\n~~~\n\nlast\n"


def test_compile_write_load(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT), (2, "plain text only"), (3, None)], "doc_id long, text string")
    path = str(tmp_path / "index")
    assert not index.index_available(spark, path)
    manifest = index.compile_and_write(docs, path).first()
    assert index.index_available(spark, path) and manifest["n"] == index.load_index(spark, path).count()
    spark.read.parquet(f"{path}/units").limit(1).write.mode("append").parquet(f"{path}/units")
    with pytest.raises(ValueError, match="manifest"):
        index.load_index(spark, path)


def test_scan_rebuild_alias_records(spark, tmp_path):
    points = spark.createDataFrame([("a", "d", "v", "t", 0), ("b", "d", "v", "t", 1)], "chunk_id string, document_id string, document_version string, retrieval_text string, reading_order_ordinal int")
    path = str(tmp_path / "points")
    assert index.full_rebuild(points, path) == 2 and index.scan_points(spark, path).count() == 2
    root = str(tmp_path / "serving")
    assert index.point_alias(spark, root, "points", path) == 1
    assert index.resolve_alias(spark.newSession(), root, "points").count() == 2
    with pytest.raises(ValueError, match="named"):
        index.resolve_alias(spark, root, "no_such_points")
    with pytest.raises(ValueError, match="no table"):
        index.point_alias(spark, root, "x", path + "-gone")
    assert index.point_alias(spark, root, "points", path, expected=1) == 2
    with pytest.raises(ValueError, match="generation"):
        index.point_alias(spark, root, "points", path, expected=1)
    index.full_rebuild(points.limit(0), path + "-empty")
    with pytest.raises(ValueError, match="no points"):
        index.scan_points(spark, path + "-empty")
    index.full_rebuild(points.withColumn("document_version", F.col("chunk_id")), path + "-bad")
    with pytest.raises(ValueError, match="conflicting_versions"):
        index.scan_points(spark, path + "-bad")
    index.write_record(spark, str(tmp_path / "runs"), {"run_id": "r1", "topic": "t", "n": 1})
    assert index.read_record(spark, str(tmp_path / "runs"), "r1", "t")["n"] == 1
    for run, topic in (("r1", "u"), ("r2", "t")):
        with pytest.raises(ValueError, match="record"):
            index.read_record(spark, str(tmp_path / "runs"), run, topic)
    with pytest.raises(ValueError, match="run_id"):
        index.write_record(spark, str(tmp_path / "runs"), {})


@pytest.mark.parametrize("limit", [6, 9, 14, 254])
def test_units_cover_every_word_once(spark, limit):
    texts = [TEXT, TEXT * 3, "", "\n\n", "word " * 60, "```\na b\nc d\ne f\ng h\n", "- a b c\n- d e f\n- g h i j k l m\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    children = markdown.split_blocks(markdown.markdown_blocks(docs), limit)
    assert all(r["n_tokens"] <= limit or r["overflow"] for r in children.collect())
    for r in children.where("overflow is null").collect():
        written = f"{r['title']} {' > '.join(r['heading_path'])} {r['before'] or ''} {r['content']} {r['after'] or ''}"
        assert len(written.split()) == r["n_tokens"]
    units = {}
    for r in markdown.unit_texts(markdown.pack_units(children, limit), docs).orderBy("doc_id", "unit").collect():
        units.setdefault(r["doc_id"], []).append(r)
        assert len(r["retrieval_text"].split()) == r["n_tokens"] and (r["n_tokens"] <= limit or r["overlap_words"] == 0)
    for n, text in enumerate(texts):
        got = [w for r in units.get(n, []) for w in text[r["core_start"] : r["core_end"]].split()]
        assert got == (text or "").split()
        assert all(a["core_end"] <= b["core_start"] for a, b in zip(units.get(n, []), units.get(n, [])[1:]))


def test_overlap_goes_as_far_as_fits(spark):
    """Against a search over all words: the first place from which title, breadcrumb and text fit, outside headings."""
    text = "intro one two\n\n## S one\n\na b c. d e.\n\n## T\n\nf g h i j k\n\nl m\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for limit in (11, 14):
        units = markdown.pack_units(markdown.split_blocks(markdown.markdown_blocks(docs), limit), limit).orderBy("unit").collect()
        assert any(u["overlap_words"] for u in units)
        for u in units:
            if u["overlap_start"] is not None:
                assert text[u["overlap_start"] : u["core_start"]].split() and len(text[u["overlap_start"] : u["core_start"]].split()) == u["overlap_words"]
                line = text.rfind("\n", 0, u["overlap_start"]) + 1
                assert not text[line:].startswith("#") or line == u["overlap_start"]


def test_pack_fails_where_seeds_exceed_the_budget(spark):
    rows = spark.createDataFrame([(1, 1, 1, "SEED", 7, 30), (1, 2, 1, "SEED", 8, 30), (2, 1, 1, "SEED", 9, 30), (2, 1, 2, "NEXT", 10, 40)], "query_id int, seed_rank int, pos int, relation string, unit_id long, tokens int")
    with pytest.raises(Exception, match="seeds exceed"):
        fusion.pack(rows, 50).collect()
    got = {(r["query_id"], r["unit_id"]): (r["over_budget"], r["packed"]) for r in fusion.pack(rows, 50, fail_over_budget=False).collect()}
    assert got == {(1, 7): (True, False), (1, 8): (True, False), (2, 9): (False, True), (2, 10): (False, False)}


def test_registered_counters(spark):
    from tessera.functions import registry

    tokenizers = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tiktoken")
    count = registry.ranks_counter(tokenizers.path("byte_bpe_50k.tiktoken"))
    registry.register("tokenizer", "bytes_50k", count)
    registry.register("tokenizer", "bytes_50k", count)
    with pytest.raises(ValueError, match="another"):
        registry.register("tokenizer", "bytes_50k", len)
    with pytest.raises(ValueError, match="no encoder"):
        registry.resolve("encoder", "bytes_50k")
    texts = ["Hello  world, it's 12 é", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(registry.token_counter("bytes_50k")("t")).collect()]
    assert got == [count(t or "") for t in texts] and got[0] == 8 and got[1] == 0
    registry.register("veto", "never", lambda row: row("id") == 3)
    got = spark.createDataFrame([(3,), (4,), (None,)], "id int").select(registry.vetoes(names=("never",)), registry.vetoes(names=("other",))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False)]


def test_rules_that_refuse(spark):
    from tessera.operators import reports, retrieval

    topics = spark.createDataFrame([(0, 1), (1, 2)], "place int, id int")
    for arguments in ({}, {"topic_id": 1, "limit": 1}, {"topic_id": 0}, {"limit": 0}, {"limit": 21}):
        with pytest.raises(ValueError):
            reports.smoke_topics(topics, **arguments)
    with pytest.raises(ValueError, match="backend"):
        retrieval.dispatch("remote")
    with pytest.raises(ValueError, match="seeds"):
        retrieval.retrieve(spark, topics, topics, topics, topics, n_seeds=4)
    pairs = spark.createDataFrame([(1, 2, "a b", "c " * 20)], "query_id long, unit_id long, query string, text string")
    with pytest.raises(Exception, match="more than 9 tokens"):
        retrieval.pair_scores(pairs, lambda b: [0.0] * len(b), lambda t: len(t.split()), most=9).collect()
