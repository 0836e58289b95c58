"""Parsing, loading, naming, errors, manifests, reports and the command line."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphwarden import CompileError, Document, ManifestError, NodeTable, Options, PropertyGraph, Snapshot, SourceError, cli, compile_shapes, exit_code, load_graph, load_manifest, render, validate
from graphwarden.functions.xsdregex import translate
from graphwarden.plans.lower import upper_snake
from graphwarden.sources.shapes import load
from graphwarden.sources.turtle import XSD, Blank, Iri, Literal, parse

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.org/> . @prefix w: <urn:graphwarden:annotation#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def build(text, schema=None, **options):
    return compile_shapes([Document("s.ttl", HEAD + text)], schema, Options(**options))


def problems(text, schema=None, **options):
    with pytest.raises(CompileError) as error:
        build(text, schema, **options)
    return str(error.value)


# -- documents
def test_turtle():
    p = parse(
        '''@prefix ex: <http://e/> . # note
PREFIX a: <http://a#>
@base <http://b/c> .
ex:s a ex:T ; ex:p 1, -2.5, 1e3, true, "x\\n\\u00e9"@en-GB, """long "q"
line""", '4'^^<http://www.w3.org/2001/XMLSchema#byte> ;
  ex:q [ ex:r ( 1 [] ex:x.y ) ], _:n, <rel>, a:b%20c\\,d ; .
[] ex:p ex:o .
[ ex:k "v" ] .''',
        "f.ttl",
    )
    o = [t.o for t in p.triples]
    assert Literal("1", XSD + "integer") in o and Literal("-2.5", XSD + "decimal") in o and Literal("1e3", XSD + "double") in o and Literal("true", XSD + "boolean") in o
    assert Literal("4", XSD + "byte") in o and Iri("http://b/rel") in o and Iri("http://a#b%20c,d") in o and Iri("http://e/x.y") in o
    assert any(isinstance(x, Literal) and x.value == "x\né" and x.language == "en-gb" for x in o) and any(isinstance(x, Literal) and x.value == 'long "q"\nline' for x in o)
    assert next(t.line for t in p.triples if isinstance(t.o, Literal) and t.o.value == "v") == 8
    assert sum(isinstance(x, Blank) for x in o) >= 3


def test_trig_and_ntriples():
    trig = parse("@prefix e: <http://e/> . { e:a e:b e:c } GRAPH e:g { e:d e:e e:f . e:g e:h e:i } e:g2 { e:x e:y e:z }", "f.trig", "trig")
    assert len(trig.triples) == 4
    assert parse('<http://a> <http://b> "c\\"d" .\n_:x <http://b> _:y .', "f.nt", "nt").triples[1].line == 2


@pytest.mark.parametrize("text", ["ex:a ex:b ex:c .", "@prefix e: <http://e/> . e:a e:b", "@prefix e: <http://e/> . e:a e:b 'x .", "<a> <b> \"\\q\" .", "<a> <b> ( 1 .", "€"])
def test_syntax_errors_name_the_place(text):
    with pytest.raises(CompileError, match=r"f\.ttl:1: "):
        parse(text, "f.ttl")


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
def test_literals_round_trip(text):
    quoted = "".join(f"\\U{ord(c):08x}" if c in "\"\\\n\r" or ord(c) < 32 else c for c in text)
    assert parse(f'<http://a> <http://b> "{quoted}" .', "f.nt", "nt").triples[0].o == Literal(text)


def test_files_imports_and_prefixes(tmp_path):
    (tmp_path / "b.ttl").write_text("@prefix x: <http://first/> . x:a x:b x:c .")
    (tmp_path / "a.ttl").write_text(f"@prefix x: <http://zero/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . <http://o> owl:imports <{(tmp_path / 'c.ttl').as_uri()}>, <{(tmp_path / 'a.ttl').as_uri()}> .")
    (tmp_path / "c.ttl").write_text("<http://q> <http://r> 5 .")
    g = load(["b.ttl", "a.ttl", "./a.ttl"], str(tmp_path))
    assert [i["path"] for i in g.inputs] == ["a.ttl", "b.ttl", "c.ttl"] and g.inputs[2]["role"] == "import"
    assert g.prefixes["x"] == "http://zero/" and len(g.triples) == 4
    with pytest.raises(CompileError):
        load(["missing.ttl"], str(tmp_path))
    (tmp_path / "r.ttl").write_text("@prefix owl: <http://www.w3.org/2002/07/owl#> . <http://o> owl:imports <https://h/x.ttl> .")
    with pytest.raises(CompileError):
        load(["r.ttl"], str(tmp_path))
    assert len(load(["r.ttl"], str(tmp_path), lambda url: "<http://q> <http://r> 5 .").triples) == 2


# -- names
def test_rule_ids_and_names():
    c = build('ex:S sh:targetClass ex:A ; w:name "Main" ; sh:property [ sh:path ([ sh:inversePath ex:aB ] [ sh:oneOrMorePath ex:c ]) ; sh:minCount 1 ] ; sh:property [ sh:path ex:p ; w:name "Own" ; sh:minCount 1 ; sh:maxCount 2 ] .')
    assert {r.rule_id: r.name for r in c.rules} == {"ex:S/^ex:aB/ex:c+/sh:minCount": "Main.inv_aB.c_plus.minCount", "ex:S/ex:p/sh:minCount": "Own.minCount", "ex:S/ex:p/sh:maxCount": "Own.maxCount"}
    assert c.rule("Own.maxCount").cost == "scan" and c.rules[0].cost == "unbounded-path" and c.rules[0].depth_cap == 10
    c = build("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:class ex:B ] ; sh:property [ sh:path ex:p ; sh:class ex:C ] .")
    assert all("~" in r.rule_id and r.rule_id.split("~")[1] == r.name.split("~")[1] for r in c.rules) and len({r.rule_id for r in c.rules}) == 2
    assert "duplicate" in problems("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:minCount 1 ] ; sh:property [ sh:path ex:p ; sh:minCount 1 ] .")
    assert [upper_snake(x) for x in ("worksFor", "hasURLLink", "a1B", "x-y")] == ["WORKS_FOR", "HAS_URLLINK", "A1_B", "X_Y"]


def test_order_of_statements_does_not_matter():
    body = [
        "ex:S sh:targetClass ex:A, ex:B .", "ex:S sh:property ex:p1 .", "ex:S sh:property ex:p2 .", "ex:p1 sh:path ex:x .", "ex:p1 sh:minCount 1 .", "ex:p1 sh:in (1 2) .",
        "ex:p2 sh:path ex:y .", "ex:p2 sh:class ex:C .", "ex:C2 rdfs:subClassOf ex:C .", "ex:S sh:or ([ sh:path ex:z ; sh:minCount 1 ] [ sh:path ex:x ; sh:maxCount 0 ]) .",
    ]
    want, rng = None, random.Random(1)
    for _ in range(8):
        rng.shuffle(body)
        got = [(r.rule_id, r.name, r.fingerprint, r.status) for r in build("\n".join(body)).rules]
        want = want or got
        assert got == want


def test_moving_shapes_keeps_fingerprints():
    text = "ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:node [ sh:path ex:q ; sh:minCount 1 ] ] ."
    a, b = build(text), build("\n\n\n" + text)
    assert [r.fingerprint for r in a.rules] == [r.fingerprint for r in b.rules] and a.rules[0].line + 3 == b.rules[0].line


# -- rejections
@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("ex:S sh:targetNode ex:n ; sh:closed true .", "targetNode"), ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:uniqueLang true ] .", "language"),
        ("ex:S sh:targetClass ex:A ; sh:sparql [] .", "SPARQL"), ("ex:S sh:targetClass ex:A ; sh:node ex:S .", "recursive"),
        ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:datatype <http://www.w3.org/1999/02/22-rdf-syntax-ns#langString> ] .", "langString"),
        ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:datatype ex:odd ] .", "datatype"), ("ex:S sh:targetClass ex:A ; sh:property [ sh:path [ sh:zeroOrMorePath (ex:a ex:b) ] ; sh:minCount 1 ] .", "repetition"),
        ('ex:a w:property "a" . ex:S sh:targetClass ex:A ; sh:property [ sh:path (ex:a ex:b) ; sh:minCount 1 ] .', "property `a`"),
        ('ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; w:property "x" ; w:direction "in" ; sh:minCount 1 ] .', "combined"), ('ex:S sh:targetClass ex:A ; w:colour "x" .', "unknown annotation"),
        ('ex:S sh:targetClass ex:A ; w:direction "in" .', "doesn't belong"), ('ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; w:direction "up" ] .', "invalid value"),
        ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:class ex:B ; sh:in (ex:b) ] .", "node key"), ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:closed true ] .", "closed"),
        ("ex:B rdfs:subClassOf ex:C . ex:C rdfs:subClassOf ex:B . ex:S sh:targetClass ex:B .", "subClassOf"), ('ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:pattern "[a" ] .', "unterminated"),
        ('ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:pattern "a" ; sh:flags "z" ] .', "flag"), ('ex:S w:targetRelationship "R" ; sh:property [ sh:path (ex:a ex:b) ; sh:minCount 1 ] .', "single property"),
        ('ex:S w:targetRelationship "R" ; sh:targetClass ex:A ; sh:property [ sh:path ex:a ; sh:minCount 1 ] .', "mixed"), ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:minCount -1 ] .", "non-negative"),
        ('ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:minInclusive "x"@en ] .', "language"), ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:in ex:notalist ] .", "list"),
        ("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:node [ sh:path ex:q ; sh:minCount 1 ] ; w:property \"p\" ] .", "property values"),
    ],
)
def test_rejected(text, part):
    message = problems(text)
    assert part in message and message.startswith("s.ttl:2")


def test_lenient_strict_and_labels():
    c = build("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:uniqueLang true ; sh:minCount 1 ] . ex:R sh:targetClass ex:A ; sh:node ex:R .", lenient=True)
    assert {r.constraint: r.status for r in c.rules} == {"sh:uniqueLang": "unsupported", "sh:minCount": "compiled", "sh:node": "unsupported"}
    assert "convention" in problems("ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:minCount 1 ] .", strict=True)
    assert build('ex:A w:label "A" . ex:p w:property "p" . ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:minCount 1 ] .', strict=True).rules
    text = "ex:B rdfs:subClassOf ex:A . ex:S sh:targetClass ex:A ; sh:property [ sh:path ex:p ; sh:minCount 1 ] ."
    assert build(text).rules[0].focus[0].labels == ("A", "B") and build(text, inherited_labels=True).rules[0].focus[0].labels == ("A",)
    own = compile_shapes([Document("s.ttl", HEAD + '@prefix o: <http://own#> . ex:S sh:targetClass ex:A ; o:label "Z" ; sh:property [ sh:path ex:p ; sh:minCount 1 ] .')], None, Options(annotations="http://own#"))
    assert own.rules[0].focus[0].labels == ("Z",)


@pytest.mark.parametrize(("pattern", "flags", "want"), [("a.b", "q", r"a\.b"), ("a b[ c]", "x", "ab[ c]"), ("x", "im", "(?imu)x"), ("[a-z-[aeiou]]", "", "[[a-z]&&[^aeiou]]"), ("[&~]", "", r"[\&\~]"), (r"\d\p{Lu}", "", r"\d\p{Lu}")])
def test_regex(pattern, flags, want):
    assert translate(pattern, flags) == want


@pytest.mark.parametrize("pattern", ["a(b", "a)b", "a(?=b)", "(?<x>a)", "*a", "a**", "a++", "a{2,1}", "a{x}", "(|+)", r"(a\2)", r"\1(a)", r"\q", "a}", "a]", "^*"])
def test_bad_patterns_are_compile_errors(pattern):
    with pytest.raises(CompileError):
        translate(pattern)


@pytest.mark.parametrize("pattern", ["", "a|", "(a)(b)\\2", "(?:ab)+?", "a{2}b{1,}c{0,3}", "[*+?]", r"\p{Lu}\$", "x*y+z?"])
def test_good_patterns_stay(spark, pattern):
    from graphwarden.functions.xsdregex import compiled_pattern

    assert compiled_pattern(pattern) == pattern


def test_places_and_names_of_blank_shapes_do_not_count():
    parts = [f"sh:property [ sh:path ex:q ; sh:node [ sh:property {x} ; sh:property {y} ] ]" for x, y in (("[ sh:path ex:a ; sh:minCount 1 ]", "[ sh:path ex:b ; sh:minCount 1 ]"), ("[ sh:path ex:b ; sh:minCount 1 ]", "[ sh:path ex:a ; sh:minCount 1 ]"))]
    a, b = (build(f"ex:S sh:targetClass ex:A ; {p} .") for p in parts)
    assert [(r.rule_id, r.fingerprint) for r in a.rules] == [(r.rule_id, r.fingerprint) for r in b.rules]
    named = build("ex:S sh:targetClass ex:A ; sh:property _:one . _:one sh:path ex:p ; sh:minCount 1 ; sh:node _:two . _:two sh:property _:z , _:y . _:z sh:path ex:a ; sh:minCount 1 . _:y sh:path ex:b ; sh:maxCount 2 .")
    other = build("ex:S sh:targetClass ex:A ; sh:property _:a . _:y sh:path ex:a ; sh:minCount 1 . _:z sh:path ex:b ; sh:maxCount 2 . _:a sh:path ex:p ; sh:node _:b ; sh:minCount 1 . _:b sh:property _:y , _:z .")
    assert [r.fingerprint for r in named.rules] == [r.fingerprint for r in other.rules]


def test_scope_of_variables():
    from graphwarden.plans.ir import Bool, Closed, Count, Pair, Rel, Source, Test, and_, not_, scope_faults

    hop, prop = Source(Rel(("R",))), Source(None, ("p",))
    assert not scope_faults(and_((Count(hop, Count(prop, Test("length"), True, 1), True, 1), Closed((), ()), Pair(prop, hop, "disjoint"))), True)
    for bad in (Test("label"), Closed((), ()), Pair(prop, prop, "equals"), Count(hop, Bool(True), True, 1)):
        assert scope_faults(bad, False) and scope_faults(Count(prop, not_(bad), True, 1), True)


# -- snapshots and graphs
def test_snapshot():
    text = '{"nodeTypes": [{"name": "A", "properties": [{"name": "id", "type": "string"}, {"name": "l", "type": "list<int64>"}]}], "relTypes": [{"name": "R", "endpoints": [{"from": "A", "to": "A"}], "properties": []}]}'
    s = Snapshot.from_json(text)
    assert s.nodes["A"] == {"id": "STRING", "l": "LIST<INT64>"} and Snapshot.from_json(s.to_json()).digest() == s.digest()
    for bad in (text.replace("relTypes", "rels"), text.replace('"string"', '"str"'), text.replace('"to": "A"', '"to": "B"'), "{", text.replace('[{"from": "A", "to": "A"}]', "[]")):
        with pytest.raises(CompileError):
            Snapshot.from_json(bad)


def test_graph_errors(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(SourceError):
        NodeTable("A", df, "key")
    with pytest.raises(SourceError):
        PropertyGraph([NodeTable("A", df), NodeTable("A", df)])
    with pytest.raises(SourceError):
        load_graph(spark, {"nodes": [{"label": "A", "path": "/nowhere"}]})


def test_database(spark, tmp_path):
    from graphwarden import ClosedError, Database

    spark.createDataFrame([("a", 1), ("b", -1)], "id string, n int").write.parquet(str(tmp_path / "t.parquet"))
    shapes = [Document("s.ttl", HEAD + "ex:S sh:targetClass ex:Pet ; sh:property [ sh:path ex:n ; sh:minInclusive 0 ] .")]
    with Database.open(spark, {"nodes": [{"label": "Pet", "path": "t.parquet"}]}, str(tmp_path)) as db:
        assert db.schema().nodes["Pet"] == {"id": "STRING", "n": "INT32"}
        assert db.validate(shapes).rules[0].violation_count == db.validate(db.compile(shapes)).rules[0].violation_count == 1
    assert db.closed
    for call in (db.schema, lambda: db.validate(shapes)):
        with pytest.raises(ClosedError):
            call()


# -- runs
@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    spark.createDataFrame([("a", -1, "x"), ("b", 5, None), ("c", 7, "y")], "id string, age int, name string").write.parquet(str(d / "pets.parquet"))
    (d / "graph.json").write_text(json.dumps({"nodes": [{"label": "Pet", "path": "pets.parquet"}]}))
    (d / "s.ttl").write_text(HEAD + "ex:S sh:targetClass ex:Pet ; sh:property [ sh:path ex:age ; sh:minInclusive 0 ; sh:severity sh:Warning ] ; sh:property [ sh:path ex:name ; sh:minLength 1 ; sh:maxLength 9 ] .")
    return d


def test_reports(spark, files):
    graph = load_graph(spark, str(files / "graph.json"))
    report = validate(graph, compile_shapes([str(files / "s.ttl")], graph.snapshot()))
    assert (report.conforms, report.complete, exit_code(report), exit_code(report, "warning")) == (False, True, 0, 1)
    s = report.summary()
    assert (s["rules"], s["passed"], s["failed"], s["violations"]) == (3, 2, 1, 1)
    data = json.loads(render(report, "json"))
    assert data["rules"][0]["violations"][0]["focus"] == {"label": "Pet", "key": None, "keyValue": "a", "elementId": "a"} and data["summary"]["failed"] == 1
    text = render(report, "table").splitlines()
    assert text[0].startswith("graphwarden: 3 rules, 1 violations") and "== violated: 1" in text and "== kept: 2" in text
    assert any(x.startswith("S.age.minInclusive <Warning, 1 x> ") for x in text) and "    Pet a - ex:S violates sh:minInclusive on ex:age [-1]" in text
    suites = ET.fromstring(render(report, "junit"))
    assert [(s.get("name"), s.get("tests"), s.get("failures"), s.get("errors")) for s in suites] == [("ex:S", "3", "1", "0")]
    assert suites.find(".//failure").get("type") == "Warning" and "Pet a" in suites.find(".//failure").text
    sarif = json.loads(render(report, "sarif"))["runs"][0]
    assert sarif["results"][0]["level"] == "warning" and len(sarif["tool"]["driver"]["rules"]) == 3
    place = sarif["results"][0]["locations"][0]
    assert place["logicalLocations"][0]["fullyQualifiedName"] == "Pet/a" and place["physicalLocation"]["region"]["startLine"] == report.rules[0].line
    with pytest.raises(ValueError):
        render(report, "html")


def test_errors_and_timeouts_spoil_only_their_rules(spark, monkeypatch):
    graph = PropertyGraph([NodeTable("Pet", spark.range(3).selectExpr("cast(id as string) id", "raise_error('bad row') as age", "'x' as name"))])
    compiled = build("ex:S sh:targetClass ex:Pet ; sh:property [ sh:path ex:age ; sh:minCount 1 ] . ex:T sh:targetSubjectsOf ex:name ; sh:property [ sh:path ex:name ; sh:minLength 2 ] .", graph.snapshot())
    report = validate(graph, compiled)
    assert [r.status for r in report.rules] == ["error", "failed"] and not report.complete and exit_code(report) == 1
    assert "bad row" in report.rules[0].status_reason
    suites = ET.fromstring(render(report, "junit"))
    assert "bad row" in suites.find(".//error").get("message") and "could not run: 1" in render(report, "table")
    run = json.loads(render(report, "sarif"))["runs"][0]
    assert not run["invocations"][0]["executionSuccessful"] and len(run["invocations"][0]["toolExecutionNotifications"]) == 1
    slow = PropertyGraph([NodeTable("Pet", spark.range(2, numPartitions=1).selectExpr("cast(id as string) id", "reflect('java.lang.Thread', 'sleep', id * 0 + 20000L) as age"))])
    report = validate(slow, build("ex:S sh:targetClass ex:Pet ; sh:property [ sh:path ex:age ; sh:minLength 9 ] .", slow.snapshot()), timeout=1.0)
    assert report.rules[0].status == "timeout" and exit_code(report) == 3


def test_limits(spark, files):
    graph = PropertyGraph([NodeTable("Pet", spark.range(50).selectExpr("cast(id as string) id", "cast(-id as int) age"))])
    compiled = build("ex:S sh:targetClass ex:Pet ; sh:property [ sh:path ex:age ; sh:minInclusive 1 ] .", graph.snapshot())
    report = validate(graph, compiled, limit=7, sample_size=2)
    r = report.rules[0]
    assert (r.violation_count, len(r.violations), len(r.sample)) == (50, 7, 2)
    assert len(validate(graph, compiled, limit=None).rules[0].violations) == 50


def test_manifest(spark, files):
    graph = load_graph(spark, str(files / "graph.json"))
    compiled = compile_shapes([str(files / "s.ttl")], graph.snapshot())
    again = load_manifest(compiled.to_json(), graph.snapshot())
    assert [r.fingerprint for r in again.rules] == [r.fingerprint for r in compiled.rules]
    for bad in ("{", compiled.to_json().replace('"schemaVersion": 1', '"schemaVersion": 2'), compiled.to_json().replace('"dialect": "spark"', '"dialect": "other"'), compiled.to_json().replace(compiled.rules[0].fingerprint, "0" * 16)):
        with pytest.raises(ManifestError):
            load_manifest(bad, graph.snapshot())
    assert set(compiled.manifest()["rules"][0]) == {"name", "ruleId", "fingerprint", "shape", "path", "constraint", "severity", "status", "statusReason", "costClass", "pathDepthCap", "source", "message"}


def test_command_line(files, capsys):
    s, g = str(files / "s.ttl"), str(files / "graph.json")
    assert cli.main(["compile", s, "-o", str(files / "m.json")]) == 0
    assert cli.main(["schema", "--graph", g]) == 0 and '"INT32"' in capsys.readouterr().out
    assert cli.main(["validate", s, "--graph", g, "--fail-on", "warning", "--format", "json"]) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["violations"] == 1
    assert cli.main(["validate", s, "--graph", g]) == 0 and "== violated: 1" in capsys.readouterr().out
    assert cli.main(["validate", s, "--graph", g, "--verbose", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["rules"][0]["violations"][0]["properties"] == {"id": "a", "age": -1, "name": "x"}
    assert cli.main(["plan", s, "--graph", g]) == 0
    text = capsys.readouterr().out
    assert text.count("-- ruleId: ") == 3 and text.count("Scan parquet") == 2  # one scan, named twice by the plan's listing
    (files / "bad.ttl").write_text("ex:a")
    assert cli.main(["compile", str(files / "bad.ttl")]) == 1 and cli.main(["validate", str(files / "bad.ttl"), "--graph", g]) == 2
    assert cli.main(["validate", "--graph", g]) == 2 and cli.main(["validate", s, "--graph", str(files / "none.json")]) == 2
