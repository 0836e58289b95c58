"""Violations as a table: repeated runs, failures, reading, streaming."""

import json

import pytest

from graphwarden import Document, NodeTable, PropertyGraph, RelTable, compile_shapes, exit_code, validate
from graphwarden.cli import main
from graphwarden.errors import SourceError
from graphwarden.report import sarif
from graphwarden.sink import store, stream, violations

from test_rules import HEAD

SHAPES = 'ex:S sh:targetClass ex:Lamp ; sh:property [ sh:path ex:watts ; sh:maxInclusive 60 ; sh:severity sh:Warning ] ; sh:property [ sh:path ex:maker ; sh:minCount 1 ; sh:message "who made \\"{$this}\\"?" ] ; sh:property [ sh:path ex:litBy ; sh:maxCount 0 ] ; sh:property [ sh:path ex:watts ; w:name "whole" ; sh:datatype xsd:int ] .'


def lamps(spark, rows):
    table = spark.createDataFrame(rows, "id string, watts int, maker string")
    return PropertyGraph([NodeTable("Lamp", table)], [RelTable("LIT_BY", "Lamp", "Lamp", spark.createDataFrame([(rows[0][0], rows[0][0])], "src string, dst string"))])


ROWS = [(f"l{i:03}", i, None if i % 9 == 0 else "Ö & co") for i in range(100)]


@pytest.fixture(scope="module")
def compiled(spark):
    return compile_shapes([Document("s.ttl", HEAD + SHAPES)], lamps(spark, ROWS).snapshot())


def facts(data):
    """A report without times, its violations in one order."""
    data = json.loads(json.dumps(data))
    del data["summary"]["durationMs"]
    for r in data["rules"]:
        r.pop("durationMs"), r.pop("sample")
        r["violations"].sort(key=lambda v: json.dumps(v, sort_keys=True))
    return data


def test_stored_like_listed(spark, compiled, tmp_path):
    graph, folder = lamps(spark, ROWS), str(tmp_path / "run")
    report = store(graph, compiled, folder, limit=3, workers=2)
    listed = validate(graph, compiled, limit=None)
    assert {r.rule_id: (r.status, r.violation_count) for r in report.rules} == {r.rule_id: (r.status, r.violation_count) for r in listed.rules}
    assert max(len(r.violations) for r in report.rules) == 3 and exit_code(report) == 1
    out = []
    stream(spark, compiled, folder, "json", out.append)
    assert facts(json.loads("".join(out))) == facts(listed.to_dict()) and len(out) > 50
    out = []
    stream(spark, compiled, folder, "sarif", out.append)
    got, want = json.loads("".join(out)), sarif(listed)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got["runs"][0].pop("results"), key=key) == sorted(want["runs"][0].pop("results"), key=key) and got == want
    with pytest.raises(ValueError):
        stream(spark, compiled, folder, "junit", out.append)


def test_repeated_runs_leave_the_same_table(spark, compiled, tmp_path):
    folder = str(tmp_path / "run")
    rows = lambda: sorted(map(str, violations(spark, folder).collect()))
    store(lamps(spark, ROWS), compiled, folder)
    first = rows()
    store(lamps(spark, ROWS), compiled, folder)
    assert rows() == first and len(first) == 39 + 12 + 1
    store(lamps(spark, [(i, min(w, 60), "x") for i, w, _ in ROWS]), compiled, folder)  # two rules are kept now
    assert len(rows()) == 1
    assert len([p for p in (tmp_path / "run" / "violations").iterdir() if p.name.startswith("rule=")]) == 1


def test_failures_and_unfinished_runs(spark, compiled, tmp_path):
    folder = str(tmp_path / "run")
    with pytest.raises(SourceError, match="no run"):
        violations(spark, folder)
    store(lamps(spark, ROWS), compiled, folder)
    broken = PropertyGraph([NodeTable("Lamp", spark.range(3).selectExpr("cast(id as string) AS id", "cast(raise_error('worn out') as int) AS watts", "'x' AS maker"))], lamps(spark, ROWS).rels)
    report = store(broken, compiled, folder)
    assert {r.status for r in report.rules} == {"error", "failed", "guaranteed-by-schema"} or {r.status for r in report.rules} == {"error", "passed", "guaranteed-by-schema"}
    assert all("worn out" in r.status_reason for r in report.rules if r.status == "error") and exit_code(report) in (1, 3)
    assert {r.rule_id for r in violations(spark, folder).collect()} <= {r.rule_id for r in report.rules if r.status == "failed"}
    (tmp_path / "run" / "run.json").write_text('{"finished": false}')
    (tmp_path / "run" / ".run.json.crc").unlink(missing_ok=True)
    with pytest.raises(SourceError, match="not ended"):
        violations(spark, folder)


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(ROWS, "id string, watts int, maker string").write.parquet(f"{tmp_path}/lamps")
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"label": "Lamp", "path": "lamps"}]}))
    (tmp_path / "s.ttl").write_text(HEAD + SHAPES.replace("ex:litBy", "ex:watts"))
    call = ["validate", str(tmp_path / "s.ttl"), "--graph", str(tmp_path / "graph.json"), "--store", str(tmp_path / "run")]
    assert main([*call, "--format", "json", "-o", str(tmp_path / "out.json")]) == 1
    data = json.loads((tmp_path / "out.json").read_text())
    assert sum(len(r["violations"]) for r in data["rules"]) == data["summary"]["violations"] == 39 + 12 + 100
    assert main(call) == 1 and "violated: 3" in capsys.readouterr().out
