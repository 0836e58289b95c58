"""Struct, map and list columns as properties: presence, fields by their way, refusals."""

import pytest
from pyspark.sql import functions as F

from graphwarden import CompileError, Document, NodeTable, Options, PropertyGraph, RelTable, compile_shapes
from graphwarden.functions import nested
from graphwarden.sources.schema import Snapshot

from test_rules import HEAD, found, run, shape

DDL = """id string, hull struct<length:double, maker:struct<name:string, year:int>>, tags map<string,int>, legs array<struct<port:string, days:int, crew:array<string>>>,
 odd map<int,string>, grid array<array<int>>, `hull.length` int, nothing void, `a.b` struct<c:int>"""


@pytest.fixture(scope="module")
def boats(spark):
    rows = [
        ("gull", (12.5, ("Ahti", 1961)), {"masts": 2, "sails": 5}, [("Oslo", 3, ["Ida"]), ("Bergen", 9, ["Ida", "Per"])], {1: "x"}, [[1], [1]], 7, None, (1,)),
        ("tern", (8.0, None), {"sails": None}, [("Oslo", 1, None), ("Oslo", 1, None)], None, [], None, None, None),
        ("auk", None, None, None, None, None, None, None, (None,)),
        ("skua", (None, ("Baltic", None)), {}, [], {2: "y"}, [[2], None, [3]], 3, None, (4,)),
    ]
    df = spark.createDataFrame([r[:7] + r[8:] for r in rows], DDL.replace(" nothing void,", "")).withColumn("nothing", F.lit(None))
    return PropertyGraph([NodeTable("Item", df)])


CASES = {
    "struct present": ("sh:path ex:hull ; sh:minCount 1", {"ex:S/ex:hull/sh:minCount": ["auk"]}),
    "map present": ("sh:path ex:tags ; sh:minCount 1", {"ex:S/ex:tags/sh:minCount": ["auk"]}),
    "structs in a list are counted once": ("sh:path ex:legs ; sh:maxCount 1 ; sh:minCount 1", {"ex:S/ex:legs/sh:maxCount": ["gull"], "ex:S/ex:legs/sh:minCount": ["auk", "skua"]}),
    "field": ("sh:path (ex:hull ex:maker ex:year) ; sh:minInclusive 1970", {"ex:S/ex:hull/ex:maker/ex:year/sh:minInclusive": ["gull"]}),
    "field is missing": ("sh:path (ex:hull ex:maker ex:name) ; sh:minCount 1", {"ex:S/ex:hull/ex:maker/ex:name/sh:minCount": ["auk", "tern"]}),
    "inner struct": ("sh:path (ex:hull ex:maker) ; sh:minCount 1", {"ex:S/ex:hull/ex:maker/sh:minCount": ["auk", "tern"]}),
    "map key": ("sh:path (ex:tags ex:sails) ; sh:minCount 1 ; sh:maxInclusive 4", {"ex:S/ex:tags/ex:sails/sh:minCount": ["auk", "skua", "tern"], "ex:S/ex:tags/ex:sails/sh:maxInclusive": ["gull"]}),
    "field of listed structs": ("sh:path (ex:legs ex:port) ; sh:in (\"Oslo\") ; sh:maxCount 1", {"ex:S/ex:legs/ex:port/sh:in": ["gull"], "ex:S/ex:legs/ex:port/sh:maxCount": ["gull"]}),
    "lists of listed structs": ('sh:path (ex:legs ex:crew) ; sh:hasValue "Per"', {"ex:S/ex:legs/ex:crew/sh:hasValue": ["auk", "skua", "tern"]}),
    "annotated": ('sh:path ex:year ; w:property "hull.maker.year" ; sh:minCount 1 ; sh:datatype xsd:short', {"ex:S/ex:year/sh:minCount": ["auk", "skua", "tern"]}),
    "a column with a dot comes first": ('sh:path ex:l ; w:property "hull.length" ; sh:minInclusive 5', {"ex:S/ex:l/sh:minInclusive": ["skua"]}),
    "field of a column with a dot": ('sh:path ex:c ; w:property "a.b.c" ; sh:minCount 1', {"ex:S/ex:c/sh:minCount": ["auk", "tern"]}),
    "maps of other keys": ("sh:path ex:odd ; sh:minCount 1", {"ex:S/ex:odd/sh:minCount": ["auk", "tern"]}),
    "lists of lists": ("sh:path ex:grid ; sh:minCount 2", {"ex:S/ex:grid/sh:minCount": ["auk", "gull", "tern"]}),
    "void": ("sh:path ex:nothing ; sh:minCount 1 ; sh:pattern \"x\" ; sh:minLength 1", {"ex:S/ex:nothing/sh:minCount": ["auk", "gull", "skua", "tern"]}),
    "kind": ("sh:path ex:hull ; sh:nodeKind sh:IRI", {"ex:S/ex:hull/sh:nodeKind": ["gull", "skua", "tern"]}),
    "equals": ("sh:path ex:hull ; sh:equals ex:tags", {"ex:S/ex:hull/sh:equals": ["gull", "skua", "tern"]}),
    "disjoint": ("sh:path ex:hull ; sh:disjoint ex:hull", {"ex:S/ex:hull/sh:disjoint": ["gull", "skua", "tern"]}),
}


@pytest.mark.parametrize("name", CASES)
def test_nested_columns(boats, name):
    body, want = CASES[name]
    assert found(run(boats, shape(f"sh:property [ {body} ]"))) == want


TESTS = ["sh:datatype xsd:string", "sh:minInclusive 1", "sh:maxLength 3", 'sh:pattern "x"', "sh:in (1)", "sh:hasValue 1", "sh:lessThan ex:tags"]


@pytest.mark.parametrize("path", ["hull", "tags", "legs", "odd"])
@pytest.mark.parametrize("test", TESTS)
def test_typed_tests_are_refused(boats, path, test):
    text = HEAD + shape(f"sh:property [ sh:path ex:{path} ; {test} ]")
    with pytest.raises(CompileError, match=f"`{path}` of Item, which holds (structs|maps)"):
        compile_shapes([Document("s.ttl", text)], boats.snapshot())
    lenient = compile_shapes([Document("s.ttl", text)], boats.snapshot(), Options(lenient=True))
    assert [r.status for r in lenient.rules] == ["unsupported"]


@pytest.mark.parametrize("test", TESTS)
def test_without_a_schema_nothing_fails(boats, test):
    """Compiled without the schema, typed tests of whole structs are violations, never errors."""
    from graphwarden import validate

    for path in ("hull", "tags", "legs", "odd", "grid"):
        report = validate(boats, compile_shapes([Document("s.ttl", HEAD + shape(f"sh:property [ sh:path ex:{path} ; {test} ]"))]))
        assert [r.status for r in report.rules] == ["failed"], (path, report.rules[0].status_reason)


def test_violations_show_json_of_sorted_maps(spark):
    df = spark.createDataFrame([("a", {"y": {"q": 2, "b": 1}, "x": None})], "id string, m map<string,map<string,int>>")
    df = df.unionAll(df.select(F.lit("b"), F.create_map(F.lit("x"), F.lit(None).cast("map<string,int>"), F.lit("y"), F.create_map(F.lit("b"), F.lit(1), F.lit("q"), F.lit(2)))))
    report = run(PropertyGraph([NodeTable("Item", df)]), shape("sh:property [ sh:path ex:m ; sh:nodeKind sh:IRI ]"))
    values = {v["value"] for v in report.rules[0].violations}
    assert len(values) == 1 and values.pop().index('"b"') > 0


def test_closed_counts_fields_as_named(spark):
    df = spark.createDataFrame([("a", (1, 2), None), ("b", None, {"k": 1})], "id string, s struct<x:int,y:int>, m map<string,int>")
    text = shape("sh:closed true ; sh:property [ sh:path (ex:s ex:x) ] ; sh:property [ sh:path ex:s ] ")
    assert found(run(PropertyGraph([NodeTable("Item", df)]), text)) == {"ex:S/sh:closed": ["b"]}


def test_structs_on_relationships(spark):
    graph = PropertyGraph([NodeTable("Item", spark.createDataFrame([("a",), ("b",)], "id string"))], [RelTable("LINKS", "Item", "Item", spark.createDataFrame([("a", "b", (5,), {"k": 1}), ("b", "a", None, None)], "src string, dst string, at struct<x:int>, m map<string,int>"))])
    text = 'ex:S w:targetRelationship "LINKS" ; sh:property [ sh:path ex:at ; sh:minCount 1 ] ; sh:property [ sh:path ex:x ; w:property "at.x" ; sh:maxInclusive 4 ] ; sh:property [ sh:path ex:k ; w:property "m.k" ; sh:minCount 1 ] .'
    assert found(run(graph, text)) == {"ex:S/ex:at/sh:minCount": ["b->a"], "ex:S/ex:x/sh:maxInclusive": ["a->b"], "ex:S/ex:k/sh:minCount": ["b->a"]}


def test_struct_fields_at_the_end_of_a_path(spark):
    homes = spark.createDataFrame([("h", (7,)), ("i", None)], "id string, at struct<zip:int>")
    graph = PropertyGraph([NodeTable("Item", spark.createDataFrame([("a",), ("b",)], "id string")), NodeTable("Home", homes)], [RelTable("IN", "Item", "Home", spark.createDataFrame([("a", "h"), ("b", "i")], "src string, dst string"))])
    assert found(run(graph, shape("sh:property [ sh:path (ex:in ex:at ex:zip) ; sh:minCount 1 ; sh:minInclusive 8 ]"))) == {"ex:S/ex:in/ex:at/ex:zip/sh:minCount": ["b"], "ex:S/ex:in/ex:at/ex:zip/sh:minInclusive": ["a"]}


def test_types_of_columns(boats):
    p = boats.nodes[0].properties
    assert {k: p[k] for k in ("hull", "hull.maker", "hull.maker.year", "tags", "legs", "legs.days", "legs.crew", "odd", "grid", "hull.length", "nothing")} == {
        "hull": "STRUCT", "hull.maker": "STRUCT", "hull.maker.year": "INT32", "tags": "MAP<INT32>", "legs": "LIST<STRUCT>", "legs.days": "LIST<INT32>", "legs.crew": "LIST<STRING>", "odd": "MAP", "grid": "LIST<LIST<INT32>>", "hull.length": "INT32", "nothing": "STRING",
    }
    assert "tags.any key" in p and p["tags.x.y"] == "INT32" and "hull.nope" not in p and p.get("odd.1") is None
    with pytest.raises(KeyError):
        p["nope"]
    again = Snapshot.from_json(boats.snapshot().to_json())
    assert again.nodes["Item"].get("tags.sails") == "INT32" and again.nodes["Item"]["hull"] == "STRUCT" and again.digest() == boats.snapshot().digest()
    assert nested.find(boats.nodes[0].df.schema, "hull.maker.nope") is None
