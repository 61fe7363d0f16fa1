"""Overlap joins, nested comparison, tables of snapshots, acceptance, fuzzy dedup, token places against brute force."""

import glob
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import intervals, registry, vocabulary
from tessera.operators import chunking, evaluation, nested
from tessera.sources import index, snapshots


def test_overlap_pairs_by_brute_force(spark):
    rng = random.Random(2)
    some = lambda n: [(rng.choice([1, 1, 1, 2, None]), i, s, s + rng.choice([0, 1, 3, 10, 400])) for i in range(n) for s in [rng.randint(-50, 300)]]
    a, b = some(150), some(150)
    got = intervals.overlap_pairs(spark.createDataFrame(a, "k int, a_id int, s int, e int"), spark.createDataFrame(b, "k int, b_id int, s int, e int"), ["k"]).collect()
    want = {(k, i, j): "same" if (s, e) == (t, f) else "nested" if (s >= t and e <= f) or (t >= s and f <= e) else "overlap" for k, i, s, e in a for m, j, t, f in b if k is not None and k == m and s < e and t < f and s < f and t < e}
    assert len(got) == len(want) and {(r["k"], r["a_id"], r["b_id"]): r["relation"] for r in got} == want
    empty = spark.createDataFrame([], "k int, a_id int, s int, e int")
    assert intervals.overlap_pairs(empty, empty.withColumnRenamed("a_id", "b_id"), ["k"]).count() == 0


def test_nested_diff(spark):
    rows = [(1, '{"a":{"b":[1,2,{"c":null}]},"d":[],"e":true}', '{"a":{"b":[1,"2",{}]},"d":[0],"f":1.5}'), (2, "[]", "{}"), (3, '"x"', '"x"'), (4, None, "1")]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    one, two = (df.select("id", F.parse_json(c).alias("v")) for c in ("x", "y"))
    got = {(r["id"], r["path"]): (r["change"], r["kind_1"], r["value_1"], r["kind_2"], r["value_2"]) for r in nested.nested_diff(one, two, ["id"]).collect()}
    assert got == {
        (1, "$.a.b[1]"): ("kind", "number", "2", "string", '"2"'), (1, "$.a.b[2].c"): ("only_1", "null", "null", None, None), (1, "$.a.b[2]"): ("only_2", None, None, "object", "{}"),
        (1, "$.d"): ("only_1", "array", "[]", None, None), (1, "$.d[0]"): ("only_2", None, None, "number", "0"), (1, "$.e"): ("only_1", "boolean", "true", None, None), (1, "$.f"): ("only_2", None, None, "number", "1.5"),
        (2, "$"): ("kind", "array", "[]", "object", "{}"), (4, "$"): ("only_2", None, None, "number", "1"),
    }


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/*/bucket=*/*.parquet")}


def test_changes_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(400)] + [(None, "no key")], "id long, v string")
    assert snapshots.create_table(rows, path, ["id"], 16) == 1
    before, old = files(path), snapshots.read_table(spark, path)
    assert snapshots.change_table(path, spark.createDataFrame([(5, "new"), (1000, "more")], "id long, v string"), spark.createDataFrame([(7,)], "id long")) == 2
    assert before.items() <= files(path).items() and len(files(path)) - len(before) <= 3
    assert old.count() == 401 and old.where("id = 5").first()["v"] == "v5"
    now = {r["id"]: r["v"] for r in snapshots.read_table(spark, path).collect()}
    assert len(now) == 401 and now[5] == "new" and now[1000] == "more" and 7 not in now and now[None] == "no key"
    assert [r["v"] for r in snapshots.read_key(spark, path, {"id": 5}).collect()] == ["new"] and snapshots.read_key(spark, path, {"id": 7}).count() == 0
    with pytest.raises(snapshots.StaleGeneration):
        snapshots.change_table(path, spark.createDataFrame([(6, "late")], "id long, v string"), expected=1)
    assert snapshots.read_table(spark, path, at=1).count() == 401 and snapshots.generation(spark, path) == 2
    assert snapshots.vacuum(spark, path) >= 1 and snapshots.read_table(spark, path).where("id = 5").first()["v"] == "new"
    empty = str(tmp_path / "empty")
    snapshots.create_table(rows.limit(0), empty, ["id"])
    assert snapshots.read_table(spark, empty).count() == 0
    snapshots.change_table(empty, rows.limit(3))
    assert snapshots.read_table(spark, empty).count() == 3


def test_a_pointer_is_moved_by_one_of_two_writers(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.point(spark, root, {"x": 1}, 0, "n") == 1
    with pytest.raises(snapshots.StaleGeneration):
        snapshots.point(spark, root, {"x": 2}, 0, "n")
    assert snapshots.resolve(spark.newSession(), root, "n") == {"x": 1}
    with pytest.raises(ValueError, match="named"):
        snapshots.resolve(spark, root, "other")


def sequential(rows, threshold=0.85):
    kept, texts = [], []
    for k, t in sorted(rows):
        low = (t or "").strip().lower()
        if low and all(SequenceMatcher(None, low, x).ratio() < threshold for x in texts):
            kept.append(k)
            texts.append(low)
    return kept


def test_fuzzy_dedup_is_the_sequential_rule(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def edit(t):
        t = list(t)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(t)

    said = [(g, i, rng.choice([edit(rng.choice(base)), edit(rng.choice(base)), rng.choice(base).upper() + " ", "", None, "a", "ab", "aab"])) for g in (1, 2) for i in range(250)]
    got = evaluation.fuzzy_dedup(spark.createDataFrame(said, "g int, place int, t string"), ["g"], "place", "t").collect()
    for g in (1, 2):
        assert sorted(r["place"] for r in got if r["g"] == g) == sequential([(i, t) for h, i, t in said if h == g])
    few = spark.createDataFrame([(1, 0, "The cat sat on the mat"), (1, 1, "the cat sat on the mat!"), (1, 2, ""), (1, 3, None)], "g int, place int, t string")
    assert [r["place"] for r in evaluation.fuzzy_dedup(few, ["g"], "place", "t").collect()] == [0]
    assert evaluation.fuzzy_dedup(few.limit(0), ["g"], "place", "t").count() == 0


def test_fuzzy_dedup_of_sliced_groups_is_the_sequential_rule(spark, monkeypatch):
    short = spark.createDataFrame([(1, 0, "thre"), (1, 1, "the"), (2, 5, "the"), (2, 4, "x")], "g int, place int, t string")
    assert sorted((r["g"], r["place"]) for r in evaluation.fuzzy_dedup(short, ["g"], "place", "t").collect()) == [(1, 0), (2, 4), (2, 5)]
    monkeypatch.setattr(evaluation, "SLICE_TEXTS", 16)
    rng = random.Random(8)
    said = [(g, i, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) * rng.randint(1, 2)) for g, n in ((1, 150), (2, 12), (3, 60)) for i in range(n)]
    rows = spark.createDataFrame(said, "g int, place int, t string").repartition(3)
    got = evaluation.fuzzy_dedup(rows, ["g"], "place", "t").collect()
    for g in (1, 2, 3):
        assert sorted(r["place"] for r in got if r["g"] == g) == sequential([(i, t) for h, i, t in said if h == g])
    plan = evaluation.fuzzy_dedup(rows, ["g"], "place", "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_token_places_are_those_of_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    texts = ["Hello  world, it's 12 é😀!", "", None, "a" * 300, "über  straße\n\tx " * 200]
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    counted = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", vocabulary.token_places(path)(F.col("text")))
    rows = counted.withColumn("n", vocabulary.tokens_within(F.col("tokens"), F.lit(0), F.lit(5))).collect()
    for r in rows:
        want = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).offsets
        assert [tuple(p) for p in r["tokens"]] == want and r["n"] == sum(a < 5 for a, _ in want)
    places = {r["doc_id"]: r["tokens"] for r in rows}
    windows = chunking.token_windows(counted, 100, 90).collect()
    assert {(w["doc_id"], w["chunk_index"]) for w in windows} == {(i, k) for i, p in places.items() for k in range(-(-len(p) // 90))}
    for w in windows:
        own = places[w["doc_id"]][w["chunk_index"] * 90 :][:100]
        assert (w["n_tokens"], w["start"], w["end"]) == (len(own), own[0]["start"], own[-1]["end"]) and w["chunk"] == texts[w["doc_id"]][w["start"] : w["end"]]


def test_sql_names(spark):
    assert {"tessera_merge_intervals", "tessera_spread"} <= set(registry.for_sql(spark))
    spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 6), (2, 0, 1), (2, None, 4)], "k int, s long, e long").createOrReplaceTempView("t_iv")
    got = spark.sql("SELECT * FROM tessera_merge_intervals(TABLE(t_iv) PARTITION BY k ORDER BY (s, e), 'k')").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 3, 2), (1, 5, 6, 1), (2, 0, 1, 1)]
    with pytest.raises(Exception, match="columns s and e"):
        spark.sql("SELECT * FROM tessera_merge_intervals(TABLE(SELECT 1 AS x), 'x')").collect()


def test_acceptance_of_a_compiled_index(spark, tmp_path):
    path = str(tmp_path / "i")
    assert index.accept_index(spark, path, {}) == (None, "no_manifest")
    manifest = index.compile_and_write(spark.createDataFrame([(1, "# A\n\none two. three\n\n## B\n\n- x\n- y\n"), (2, "plain")], "doc_id long, text string"), path).first()
    units, code = index.accept_index(spark, path, {"n": manifest["n"]})
    assert code is None and units.count() == manifest["n"] and index.accept_index(spark, path, {"n": -1})[1] == "bad_config"
    spark.read.parquet(f"{path}/units").limit(1).write.mode("append").parquet(f"{path}/units")
    assert index.accept_index(spark, path, {})[1] == "bad_count"
