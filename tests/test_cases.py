"""Operators on rows written down by hand: decision tables and cases that the supplied tables don't hold."""

import itertools
import random

import pytest

from tessera.functions import jsontext
from tessera.operators import dense, evaluation, exposure, reports, retrieval, semantics


def rows(spark, schema, values):
    return spark.createDataFrame(values, schema)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "raw, items",
    [
        ('[{"a": 1}, 2]', ['{"a": 1}', "2"]), ('```json\n["x"]\n```', ['"x"']), ("Here: [1, 2] as asked.", ["1", "2"]), ('{"a": 1}', None), ("no array", None), ("[1, 2", None), ("", None), (None, None), ("[]", []), ("```\n[true]\n``` trailing", ["true"]),
    ],
)
def test_array_items(raw, items):
    assert jsontext.array_items(raw) == items


@pytest.mark.parametrize(
    "raw, error",
    [
        (" ", "empty_response"), (None, "empty_response"), ('```{"observations":[]}```', "markdown_fence_rejected"), ('{"observations":[],"observations":[]}', "duplicate_json_keys"), ('{"observations":[]} thanks', "trailing_prose"), ('{"observations":[', "malformed_json"),
        ("[]", "top_level_not_object"), ('{"observations":[],"note":1}', "unknown_top_level_field"), ("{}", "missing_observations"), ('{"observations":{}}', "observations_not_array"), ('{"observations":[null]}', "observation_0_null"),
        ('{"observations":[3]}', "observation_0_not_object"), ('{"observations":[]}', None),
    ],
)
def test_answer_error(raw, error):
    assert jsontext.answer_error(raw) == error


@pytest.mark.parametrize("value, node, error", [("x", {"$ref": "#/$defs/no"}, "$ $ref"), (True, {"type": "integer"}, "$ type"), (0, {"minimum": 1}, "$ minimum"), ([1, 1], {"uniqueItems": True}, "$ uniqueItems"), ([1, True], {"uniqueItems": True}, None), (None, {"anyOf": [{"type": "null"}]}, None), ([[2]], {"items": {"items": {"const": 1}}}, "$[0][0] const")])
def test_schema_error(value, node, error):
    assert jsontext.schema_error(value, node, node) == error


def test_terminal_outcome(spark):
    names = "run_id int, identity_matches boolean, ambiguous_anchor boolean, verification_status string, inventory_current boolean, anchors_ok boolean, material_state string, citations_ok boolean, semantic_ok boolean"
    good = (True, False, "completed", True, True, "pass", True, True)
    cases = [
        ({}, "execution_failed", False), ({0: False}, "execution_failed", False), ({1: True, 2: "inventory_failed"}, "execution_failed", False), ({2: "inventory_failed"}, "execution_failed", True), ({2: "parse_failed"}, "execution_failed", True), ({2: "skipped"}, "execution_failed", False),
        ({3: False}, "execution_failed", False), ({4: False}, "execution_failed", False), ({5: "unknown_materiality"}, "policy_blocked", False), ({5: "repairable", 6: False}, "policy_blocked", False), ({5: "repairable", 7: False}, "terminal_quality_exhausted", True), ({5: "exhausted"}, "policy_blocked", True),
    ]
    states = [(i, *[change.get(n, v) for n, v in enumerate(good)]) for i, (change, _, _) in enumerate(cases)]
    assert found(reports.terminal_outcome(rows(spark, names, states))) == sorted([(i, o, r) for i, (_, o, r) in enumerate(cases)], key=repr)


def test_attribution_by_name_in_order(spark):
    report = [("a", 1, None, None), ("a", 2, "", None), ("a", 3, "https://h/x", "https://h/x"), ("a", 4, "Intro.md", None), ("a", 5, "kb/intro.md#2", None), ("a", 6, "https://no/where", "https://no/where"), ("b", 1, "intro.md", None), ("b", 2, "notes", None)]
    out = exposure.attribution(
        rows(spark, "run string, row_id int, source_url string, norm_url string", report), rows(spark, "run string, norm_url string", [("a", "https://h/x"), ("a", None), ("b", "https://b/")]),
        rows(spark, "run string, place int, source string", [("a", 0, "other.md"), ("a", 1, "intro.md"), ("b", 0, "notes-2.md"), ("b", 1, "notes-1.md")]), ["run"],
    )
    assert [r[2:] for r in found(out)] == [("none", None), ("none", None), ("web", "https://h/x"), ("kb", "kb:intro.md"), ("kb", "kb:intro.md"), ("unresolved", None), ("unresolved", None), ("kb", "kb:notes-2.md")]


def test_total_tokens(spark):
    t = rows(spark, "id int, total int, prompt int, completion int", [(1, 10, 3, 4), (2, None, 3, 4), (3, -1, 3, 4), (4, None, None, 4), (5, 0, None, None), (6, None, -3, 4)])
    out = t.select("id", retrieval.total_tokens(t.total, t.prompt, t.completion).alias("x")).select("id", "x.*")
    assert found(out) == [(1, 10, "provider"), (2, 7, "component_sum"), (3, None, "invalid"), (4, None, "incomplete"), (5, 0, "provider"), (6, None, "incomplete")]


def test_similar_pairs(spark):
    top = rows(spark, "query_id int, rank int, unit_id int, embedding array<double>", [(1, 1, 1, [1.0, 0.0]), (1, 2, 2, [0.99, 0.14]), (1, 3, 3, [0.0, 1.0]), (2, 1, 6, [0.6, 0.8]), (2, 2, 7, [0.6, 0.8]), (2, 3, 8, [0.8, 0.6])])
    assert [r[:3] for r in found(dense.similar_pairs(top))] == [(1, 1, 2), (2, 6, 7), (2, 6, 8), (2, 7, 8)]


def test_extraction_without_one_side(spark):
    out = semantics.extraction_metrics(
        rows(spark, "run string, candidate_id string, canonical string, role string", [("s", "c1", "x", "exact")]), rows(spark, "run string, gold_id string, material boolean, factual boolean", [("t", "g1", True, False)]),
        rows(spark, "run string, candidate_id string, gold_id string", []), ["run"],
    )
    assert found(out.select("run", "material_recall", "factual_recall", "tp", "duplicate_rate", "precision", "f1")) == [("s", None, None, 0, 0.0, 0.0, 0.0), ("t", 0.0, None, 0, None, None, 0.0)]


def test_release_rates_out_of_range(spark):
    names = "id int, run_id string, status string, validation_error string, exit_code int, has_telemetry boolean, verification_status string, verified int, weak int, unverified int, uvr double"
    runs = [(1, "a", "success", None, 0, True, "completed", 9, 0, 1, 1.5), (2, "b", "success", None, 0, True, "completed", 9, 0, 1, 0.05), (3, None, "success", None, 0, True, "completed", 9, 0, 1, 0.1)]
    assert found(reports.release_failures(rows(spark, names, runs))) == [(1, "topic 01: UVR out of range"), (2, "topic 02: UVR contradicts claim counts"), (3, "run ID missing")]


def largest(edges):
    """By trying all ways."""
    edges = sorted(set(edges))
    for n in range(len(edges), 0, -1):
        for pick in itertools.combinations(edges, n):
            if len({a for a, _ in pick}) == n and len({b for _, b in pick}) == n:
                return n
    return 0


def test_matching_is_largest():
    r = random.Random(3)
    for _ in range(150):
        edges = [(f"a{r.randrange(4)}", f"b{r.randrange(4)}") for _ in range(r.randrange(1, 9))]
        pairs = evaluation.match_pairs(edges)
        assert set(pairs) <= set(edges) and len(pairs) == largest(edges)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        assert pairs == evaluation.match_pairs(list(reversed(edges)))
