"""Replay fixtures: records with their lines, every broken rule, defaults, sources."""

import json

from changelens.sources import fixtures

GOOD = {"case_id": "a", "repository": {"path": "/r", "base_commit": "case1/base", "answer_commit": "0af"}}


def with_(**more):
    return {**GOOD, **more}


def test_lines_and_rules(spark):
    repo = lambda **r: {**GOOD["repository"], **r}
    lines = [
        json.dumps(GOOD), "", "{broken", "[1]",
        json.dumps(with_(case_id="b", repository=repo(path_env="ROOT"))),
        json.dumps(with_(case_id="c", repository=repo(path=None, path_env="lower"), execution={"golden_command": "bash -c x", "timeout_seconds": 0})),
        json.dumps(with_(case_id="d", repository=repo(base_commit="-x", answer_commit="a b"), schema_version="9")),
        json.dumps(with_(case_id="e")), json.dumps(with_(case_id="e", execution={"golden_command": "pytest -q"})), json.dumps({"case_id": " "}),
    ]
    good, faults = fixtures.load(spark.createDataFrame([("f.jsonl", "\n".join(lines))], "file string, text string"))
    got = {}
    for r in faults.collect():
        got.setdefault(r.line, set()).add(r.rule)
    assert got == {
        3: {"not JSON"}, 4: {"not a record"}, 5: {"path_or_env"}, 6: {"path_env", "golden_command", "timeout"}, 7: {"base_commit", "answer_commit", "schema_version"},
        8: {"duplicate"}, 9: {"duplicate"}, 10: {"case_id", "path_or_env", "base_commit", "answer_commit"},
    }
    row = good.collect()
    assert [(r.line, r.case_id, r.schema_version, r.repository.source_type, r.execution.timeout_seconds) for r in row] == [(1, "a", "1", "local_git", 1800)]


def test_yaml_and_environment(spark):
    case = "case_id: {0}\n{1}repository: {{path_env: {2}, base_commit: x, answer_commit: y}}\n"
    files = [
        ("one.yaml", case.format("one", "", "ROOT")),
        ("many.yml", "cases:\n- " + case.format("two", "  ", "GONE") + "- " + case.format("three", "  ", "ROOT")),
        ("bad.yaml", "a: [1\nb: }"), ("none.yaml", "7"), ("evil.yaml", "!!python/object/apply:os.system ['true']"), ("empty.jsonl", ""),
    ]
    good, faults = fixtures.load(spark.createDataFrame(files, "file string, text string"))
    assert {(r.file, r.line, r.case_id) for r in good.collect()} == {("one.yaml", 1, "one"), ("many.yml", 2, "two"), ("many.yml", 4, "three")}
    assert {(r.file, r.rule) for r in faults.collect()} == {("bad.yaml", "not YAML"), ("none.yaml", "no cases"), ("evil.yaml", "not YAML")}
    there, gone = fixtures.resolved(good, {"ROOT": "/srv"})
    assert {(r.case_id, r.root) for r in there.collect()} == {("one", "/srv"), ("three", "/srv")} and [tuple(r) for r in gone.collect()] == [("two", "GONE")]
