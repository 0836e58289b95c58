"""Rules over small graphs: expected (rule, focus, details) of every constraint, target and path form."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphwarden.runner import focus_name
from graphwarden import CompileError, Document, NodeTable, Options, PropertyGraph, RelTable, compile_shapes, exit_code, validate

HEAD = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.org/> . @prefix w: <urn:graphwarden:annotation#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
"""


def nodes(spark, label, columns, rows):
    return NodeTable(label, spark.createDataFrame(rows, "id string" + (f", {columns}" if columns else "")))


def rel(spark, kind, start, end, rows, columns="src string, dst string"):
    return RelTable(kind, start, end, spark.createDataFrame(rows, columns))


def run(graph, shapes, options=None, **more):
    compiled = compile_shapes([Document("shapes.ttl", HEAD + shapes)], graph.snapshot(), options or Options())
    report = validate(graph, compiled, **more)
    assert not [r.status_reason for r in report.rules if r.status == "error"]
    return report


def found(report):
    """{rule id: sorted focus keys}."""
    out = {}
    for r in report.rules:
        if r.violations:
            out[r.rule_id] = sorted({focus_name(v["focus"])[1] for v in r.violations})
    return out


SHAFT = "sh:targetClass ex:Shaft"


def shape(body, target="sh:targetClass ex:Item"):
    return f"ex:S {target} ; {body} ."


PROPERTY_CASES = {
    "counts": (
        # repeats count once, nulls in lists don't count
        "founder string, chimes array<string>", [("dawn", None, ["low", "low"]), ("noon", "Ruiz", []), ("dusk", "Ruiz", ["mid", "low", "high", "mid"]), ("watch", None, None), ("knell", "Okoro", [None, None]), ("peal", "Okoro", ["do", "re", "mi", "fa", "do"])],
        "sh:property [ sh:path ex:founder ; sh:minCount 1 ] ; sh:property [ sh:path ex:chimes ; sh:minCount 2 ; sh:maxCount 3 ]",
        {"ex:S/ex:founder/sh:minCount": ["dawn", "watch"], "ex:S/ex:chimes/sh:minCount": ["dawn", "knell", "noon", "watch"], "ex:S/ex:chimes/sh:maxCount": ["peal"]},
    ),
    "ranges": (
        "metres int, slope double, climbed date", [("alp", 4478, 35.5, date(1865, 7, 14)), ("fell", 978, 12.0, None), ("dome", 8000, 61.25, date(1953, 5, 29)), ("cone", None, float("nan"), date(2001, 9, 1))],
        'sh:property [ sh:path ex:metres ; sh:minExclusive 978 ; sh:maxInclusive 7999 ] ; sh:property [ sh:path ex:slope ; sh:minInclusive 12.5 ; sh:maxExclusive 61.25 ] ; sh:property [ sh:path ex:climbed ; sh:minInclusive "1865-07-15"^^xsd:date ; sh:maxExclusive "2001-09-01"^^xsd:date ]',
        {
            "ex:S/ex:metres/sh:minExclusive": ["fell"], "ex:S/ex:metres/sh:maxInclusive": ["dome"], "ex:S/ex:slope/sh:minInclusive": ["cone", "fell"], "ex:S/ex:slope/sh:maxExclusive": ["cone", "dome"],
            "ex:S/ex:climbed/sh:minInclusive": ["alp"], "ex:S/ex:climbed/sh:maxExclusive": ["cone"],
        },
    ),
    "wrong types": (
        # a bound of another type is a violation, never a cast; integers have a text of their own
        "depth double, frozen boolean, sonar int, sounded timestamp_ntz, vessel string", [("lake", 9.5, False, 70, datetime(2011, 5, 2, 6), "Petrel"), ("fjord", None, None, 8, None, None), ("pond", 0.5, True, None, None, "Grebe")],
        'sh:property [ sh:path ex:depth ; sh:maxLength 9 ] ; sh:property [ sh:path ex:frozen ; sh:maxExclusive 3 ] ; sh:property [ sh:path ex:sonar ; sh:maxLength 1 ; sh:pattern "8" ] ; sh:property [ sh:path ex:sounded ; sh:maxInclusive "2030-01-01"^^xsd:date ] ; sh:property [ sh:path ex:vessel ; sh:lessThan ex:sonar ]',
        {
            "ex:S/ex:depth/sh:maxLength": ["lake", "pond"], "ex:S/ex:frozen/sh:maxExclusive": ["lake", "pond"], "ex:S/ex:sonar/sh:maxLength": ["lake"], "ex:S/ex:sonar/sh:pattern": ["lake"],
            "ex:S/ex:sounded/sh:maxInclusive": ["lake"], "ex:S/ex:vessel/sh:lessThan": ["lake"],
        },
    ),
    "strings": (
        "title string, plate string", [("blue", "Löwe", "No. 7"), ("red", "Schwan", "no. 12"), ("pair", "鳥🦢", "No. 300"), ("void", "", None), ("torn", "Elch", "No. 7\nNo. 8")],
        r'sh:property [ sh:path ex:title ; sh:minLength 3 ; sh:maxLength 5 ] ; sh:property [ sh:path ex:plate ; sh:pattern "^No\\. [0-9]{1,2}$" ]',
        {"ex:S/ex:title/sh:minLength": ["pair", "void"], "ex:S/ex:title/sh:maxLength": ["red"], "ex:S/ex:plate/sh:pattern": ["pair", "red", "torn"]},
    ),
    "pattern flags": (
        "p string, q string, r string, s string", [("a", "very URGENT", "a.c", "b\nx", "ééx"), ("b", "calm", "abc", "x", "e1")],
        r'sh:property [ sh:path ex:p ; sh:pattern "urgent" ; sh:flags "i" ] ; sh:property [ sh:path ex:q ; sh:pattern "a.c" ; sh:flags "q" ] ; sh:property [ sh:path ex:r ; sh:pattern "^b$" ; sh:flags "m" ] ; sh:property [ sh:path ex:s ; sh:pattern "^[\\i-[a-m]][\\c-[1]]+$" ]',
        {"ex:S/ex:p/sh:pattern": ["b"], "ex:S/ex:q/sh:pattern": ["b"], "ex:S/ex:r/sh:pattern": ["b"], "ex:S/ex:s/sh:pattern": ["b"]},
    ),
    "back references and categories": ("k string", [("a", "aa"), ("b", "ab"), ("c", "BB")], r'sh:property [ sh:path ex:k ; sh:pattern "^(\\p{Ll})\\1$" ]', {"ex:S/ex:k/sh:pattern": ["b", "c"]}),
    "membership": (
        "weave string, shafts int, dyes array<string>, wood string", [("tall", "twill", 8, ["woad", "madder"], "Ash"), ("low", "felt", 5, ["weld"], "Oak"), ("stored", None, None, None, None), ("lent", "plain", 4, ["woad"], "Elm")],
        'sh:property [ sh:path ex:weave ; sh:in ("twill" "plain" "satin") ] ; sh:property [ sh:path ex:shafts ; sh:in (4 8) ] ; sh:property [ sh:path ex:dyes ; sh:hasValue "madder" ] ; sh:property [ sh:path ex:wood ; sh:in (ex:Ash ex:Elm) ]',
        {"ex:S/ex:weave/sh:in": ["low"], "ex:S/ex:shafts/sh:in": ["low"], "ex:S/ex:dyes/sh:hasValue": ["lent", "low", "stored"], "ex:S/ex:wood/sh:in": ["low"]},
    ),
    "pairs": (
        "sown array<string>, reaped array<string>, fallow string, rented string, opens date, closes date, least float, most double",
        [
            ("north", ["rye", "oat"], ["oat", "rye", "rye"], "2019", "2020", date(2020, 3, 1), date(2020, 3, 1), 4.0, 4.0),
            ("east", ["rye"], ["rye", "flax"], None, "2019", date(2020, 3, 2), date(2020, 3, 1), 3.0, 7.5),
            ("south", [], None, "2018", "2018", None, date(2020, 3, 1), 9.0, 8.75),
        ],
        "sh:property [ sh:path ex:sown ; sh:equals ex:reaped ] ; sh:property [ sh:path ex:fallow ; sh:disjoint ex:rented ] ; sh:property [ sh:path ex:opens ; sh:lessThan ex:closes ] ; sh:property [ sh:path ex:least ; sh:lessThanOrEquals ex:most ]",
        {"ex:S/ex:sown/sh:equals": ["east"], "ex:S/ex:fallow/sh:disjoint": ["south"], "ex:S/ex:opens/sh:lessThan": ["east", "north"], "ex:S/ex:least/sh:lessThanOrEquals": ["south"]},
    ),
    "datatype": (
        "n bigint, m smallint, t string", [("a", 5, 3, "x"), ("b", 300, -3, "y")],
        "sh:property [ sh:path ex:n ; sh:datatype xsd:byte ] ; sh:property [ sh:path ex:m ; sh:datatype xsd:nonNegativeInteger ]", {"ex:S/ex:n/sh:datatype": ["b"], "ex:S/ex:m/sh:datatype": ["b"]},
    ),
    "logic": (
        "gears int, sail double, crew array<string>", [("kayak", None, None, ["Ida"]), ("bike", 21, None, ["Ida", "Ole"]), ("yacht", 3, 40.0, ["Ole", "Eva", "Ida"]), ("raft", None, 6.0, None)],
        "sh:or ( [ sh:path ex:gears ; sh:minInclusive 10 ] [ sh:path ex:crew ; sh:maxCount 1 ] ) ; sh:xone ( [ sh:path ex:gears ; sh:maxCount 0 ] [ sh:path ex:sail ; sh:maxCount 0 ] ) ; "
        'sh:not [ sh:path ex:crew ; sh:hasValue "Eva" ] ; sh:and ( [ sh:path ex:crew ; sh:minCount 1 ] [ sh:path ex:sail ; sh:maxExclusive 40 ] )',
        # gears of no value are all at least ten; xone holds where exactly one of gears and sail is absent
        {"ex:S/sh:or": ["yacht"], "ex:S/sh:xone": ["kayak", "yacht"], "ex:S/sh:not": ["yacht"], "ex:S/sh:and": ["raft", "yacht"]},
    ),
    "logic on values": ("n int", [("a", 5), ("b", 15), ("c", 25)], "sh:property [ sh:path ex:n ; sh:or ( [ sh:maxInclusive 10 ] [ sh:minInclusive 20 ] ) ; sh:not [ sh:in (25) ] ]", {"ex:S/ex:n/sh:or": ["b"], "ex:S/ex:n/sh:not": ["c"]}),
    "metadata": (
        "heat int, glaze string", [("k1", 1200, None), ("k2", None, "ash"), ("k3", 900, None)],
        "sh:property [ sh:path ex:heat ; sh:maxExclusive 1000 ; sh:severity sh:Info ] ; sh:property [ sh:path ex:glaze ; sh:minCount 1 ; sh:deactivated true ]", {"ex:S/ex:heat/sh:maxExclusive": ["k1"]},
    ),
    "alternatives": ("a string, b int", [("x", "u", 1), ("y", None, 2), ("z", None, None)], "sh:property [ sh:path [ sh:alternativePath (ex:a ex:b) ] ; sh:minCount 1 ; sh:maxCount 1 ]", {"ex:S/ex:a|ex:b/sh:minCount": ["z"], "ex:S/ex:a|ex:b/sh:maxCount": ["x"]}),
    "node kind": ("name string", [("a", "x"), ("b", None)], 'sh:property [ sh:path ex:name ; w:property "name" ; sh:nodeKind sh:IRI ] ; sh:property [ sh:path ex:name ; w:name "Lit" ; sh:nodeKind sh:Literal ]', None),
    "scalar list": ("tags array<int>", [("a", [1, 2]), ("b", None)], 'sh:property [ sh:path ex:tags ; w:collection "scalar" ; sh:minCount 1 ; sh:maxCount 1 ]', {"ex:S/ex:tags/sh:minCount": ["b"]}),
}


@pytest.mark.parametrize("name", PROPERTY_CASES)
def test_properties(spark, name):
    columns, rows, body, want = PROPERTY_CASES[name]
    report = run(PropertyGraph([nodes(spark, "Item", columns, rows)]), shape(body))
    if want is not None:
        assert found(report) == want
    else:
        assert {tuple(v["focus"]["keyValue"] for v in r.violations) for r in report.rules} == {("a",), ()}


def test_untyped_values(spark):
    df = spark.createDataFrame([("a", "5"), ("b", '"abc"'), ("c", "true"), ("d", "2.5"), ("e", "[1, \"x\"]"), ("f", None), ("g", "null"), ("h", '"30"')], "id string, j string")
    df = df.select("id", F.expr("try_parse_json(j)").alias("v"))
    report = run(PropertyGraph([NodeTable("Item", df)]), shape("sh:property [ sh:path ex:v ; sh:datatype xsd:integer ; sh:minInclusive 3 ; sh:minLength 2 ; sh:maxCount 1 ; sh:minCount 1 ]"))
    assert found(report) == {
        "ex:S/ex:v/sh:datatype": ["b", "c", "d", "e", "h"], "ex:S/ex:v/sh:minInclusive": ["b", "c", "d", "e", "h"], "ex:S/ex:v/sh:minLength": ["a", "c", "d", "e"],
        "ex:S/ex:v/sh:maxCount": ["e"], "ex:S/ex:v/sh:minCount": ["f", "g"],
    }


@pytest.fixture(scope="module")
def mine(spark):
    """Shafts of a mine: what they open to, where their air and water go."""
    return PropertyGraph(
        [
            nodes(spark, "Shaft", "foreman string, opened string, note string", [("ada", "Ines", None, "old"), ("bea", None, "1911", None), ("cyd", None, None, "flooded"), ("dot", "Per", "1930", None), ("eve", None, None, None)]),
            nodes(spark, "Gallery", "seam string, tools array<string>", [("g1", "B-7", ["pick"]), ("g2", "upper", None), ("g3", None, ["drill", "lamp", "pick"])]),
            nodes(spark, "Sump", "seam string", [("w1", "K-1")]),
            nodes(spark, "Fan", "", [("f1",)]),
        ],
        [
            rel(spark, "OPENS_TO", "Shaft", "Gallery", [("ada", "g1"), ("ada", "g1"), ("bea", "g2"), ("bea", "g3"), ("dot", "g3")]),
            rel(spark, "OPENS_TO", "Shaft", "Sump", [("cyd", "w1")]),
            rel(spark, "VENTS", "Shaft", "Shaft", [("ada", "bea"), ("bea", "dot"), ("dot", "bea"), ("eve", "eve")]),
            rel(spark, "VENTS", "Shaft", "Fan", [("cyd", "f1"), ("bea", "f1")]),
            rel(spark, "FEEDS", "Shaft", "Shaft", [("ada", "cyd"), ("cyd", "ada"), ("cyd", "bea"), ("dot", "dot")]),
            RelTable("PUMPS", "Shaft", "Shaft", spark.createDataFrame([("ada", "cyd", 40), ("cyd", "dot", 900), ("cyd", "dot", 900), ("eve", "ada", None)], "src string, dst string, litres int")),
        ],
    )


SEAMS = r'ex:G sh:property [ sh:path ex:seam ; sh:minCount 1 ; sh:pattern "^[A-Z]-[0-9]$" ] ; sh:property [ sh:path ex:tools ; sh:maxCount 2 ] .'
PATH_CASES = {
    "class": ("ex:Sump rdfs:subClassOf ex:Gallery .", "sh:property [ sh:path ex:opensTo ; sh:class ex:Gallery ]", {}),
    "class without subclasses": ("", "sh:property [ sh:path ex:opensTo ; sh:class ex:Gallery ]", {"ex:S/ex:opensTo/sh:class": ["cyd"]}),
    "distinct count": ("", "sh:property [ sh:path ex:opensTo ; sh:maxCount 1 ; sh:minCount 1 ]", {"ex:S/ex:opensTo/sh:maxCount": ["bea"], "ex:S/ex:opensTo/sh:minCount": ["eve"]}),
    "sequence": ("", r'sh:property [ sh:path (ex:opensTo ex:seam) ; sh:minCount 1 ; sh:pattern "^[A-Z]-[0-9]$" ]', {"ex:S/ex:opensTo/ex:seam/sh:minCount": ["dot", "eve"], "ex:S/ex:opensTo/ex:seam/sh:pattern": ["bea"]}),
    "sequence of lists": ("", "sh:property [ sh:path (ex:opensTo ex:tools) ; sh:maxCount 2 ]", {"ex:S/ex:opensTo/ex:tools/sh:maxCount": ["bea", "dot"]}),
    "inverse": ("", "sh:property [ sh:path [ sh:inversePath ex:feeds ] ; sh:minCount 1 ]", {"ex:S/^ex:feeds/sh:minCount": ["eve"]}),
    "inverse sequence": ("", "sh:property [ sh:path [ sh:inversePath (ex:vents ex:feeds) ] ; sh:minCount 1 ]", {"ex:S/^(ex:vents/ex:feeds)/sh:minCount": ["ada", "bea", "cyd", "eve"]}),
    "alternative": ("", "sh:property [ sh:path [ sh:alternativePath (ex:vents [ sh:inversePath ex:feeds ]) ] ; sh:maxCount 2 ]", {"ex:S/ex:vents|^ex:feeds/sh:maxCount": ["bea"]}),
    "plus": ("", "sh:property [ sh:path [ sh:oneOrMorePath ex:vents ] ; sh:class ex:Shaft ; sh:maxCount 2 ]", {"ex:S/ex:vents+/sh:class": ["ada", "bea", "cyd", "dot"], "ex:S/ex:vents+/sh:maxCount": ["ada", "bea", "dot"]}),
    "star": ("", "sh:property [ sh:path [ sh:zeroOrMorePath ex:vents ] ; sh:minCount 2 ]", {"ex:S/ex:vents*/sh:minCount": ["eve"]}),
    "optional": ("", "sh:property [ sh:path [ sh:zeroOrOnePath ex:feeds ] ; sh:minCount 2 ]", {"ex:S/ex:feeds?/sh:minCount": ["bea", "dot", "eve"]}),
    "node": (SEAMS, "sh:property [ sh:path ex:opensTo ; sh:node ex:G ]", {"ex:S/ex:opensTo/sh:node": ["bea", "dot"]}),
    "nested hops": ("ex:N sh:property [ sh:path ex:vents ; sh:minCount 1 ; sh:class ex:Shaft ] .", "sh:property [ sh:path ex:feeds ; sh:node ex:N ]", {"ex:S/ex:feeds/sh:node": ["ada", "cyd"]}),
    "not over hops": ("", "sh:not [ sh:path ex:opensTo ; sh:class ex:Gallery ]", {"ex:S/sh:not": ["ada", "bea", "dot", "eve"]}),
    "qualified": ("", "sh:property [ sh:path ex:vents ; sh:qualifiedValueShape [ sh:class ex:Fan ] ; sh:qualifiedMinCount 1 ; sh:qualifiedMaxCount 0 ]", {"ex:S/ex:vents/sh:qualifiedMinCount": ["ada", "dot", "eve"], "ex:S/ex:vents/sh:qualifiedMaxCount": ["bea", "cyd"]}),
    "equal nodes": ("", "sh:property [ sh:path ex:feeds ; sh:equals ex:pumps ]", {"ex:S/ex:feeds/sh:equals": ["cyd", "dot", "eve"]}),
    "disjoint nodes": ("", "sh:property [ sh:path ex:feeds ; sh:disjoint ex:pumps ]", {"ex:S/ex:feeds/sh:disjoint": ["ada"]}),
    "closed": ("", "sh:closed true ; sh:ignoredProperties (ex:opened rdf:type) ; sh:property [ sh:path ex:foreman ] ; sh:property [ sh:path ex:opensTo ] ; sh:property [ sh:path ex:vents ] ; sh:property [ sh:path ex:feeds ]", {"ex:S/sh:closed": ["ada", "cyd", "eve"]}),
    "property nested in property": ("", "sh:property [ sh:path ex:opensTo ; sh:property [ sh:path ex:seam ; sh:minCount 1 ] ]", {"ex:S/ex:opensTo/sh:property": ["bea", "dot"]}),
    "key of nodes": ("", "sh:property [ sh:path ex:feeds ; sh:in (ex:ada ex:cyd) ] ; sh:property [ sh:path ex:vents ; sh:hasValue ex:bea ]", {"ex:S/ex:feeds/sh:in": ["cyd", "dot"], "ex:S/ex:vents/sh:hasValue": ["bea", "cyd", "eve"]}),
}


@pytest.mark.parametrize("name", PATH_CASES)
def test_paths(mine, name):
    before, body, want = PATH_CASES[name]
    assert found(run(mine, before + "\n" + shape(body, SHAFT), Options(node_key="id"))) == want


LED = "sh:property [ sh:path ex:foreman ; sh:minCount 1 ]"
TARGETS = {
    "implicit": (f"ex:Shaft a rdfs:Class ; {LED} .", {"ex:Shaft/ex:foreman/sh:minCount": ["bea", "cyd", "eve"]}),
    "subjects": (f"ex:S sh:targetSubjectsOf ex:feeds ; {LED} .", {"ex:S/ex:foreman/sh:minCount": ["cyd"]}),
    "subjects of property": (f"ex:S sh:targetSubjectsOf ex:opened ; {LED} .", {"ex:S/ex:foreman/sh:minCount": ["bea"]}),
    "objects": ("ex:S sh:targetObjectsOf ex:opensTo ; sh:property [ sh:path ex:seam ; sh:minCount 1 ] .", {"ex:S/ex:seam/sh:minCount": ["g3"]}),
    "union": (f"ex:S sh:targetClass ex:Fan ; sh:targetObjectsOf ex:feeds ; {LED} .", {"ex:S/ex:foreman/sh:minCount": ["bea", "cyd", "f1"]}),
    "relationships": ('ex:S w:targetRelationship "PUMPS" ; sh:property [ sh:path ex:litres ; sh:maxExclusive 500 ; sh:minCount 1 ] .', {"ex:S/ex:litres/sh:maxExclusive": ["cyd->dot"], "ex:S/ex:litres/sh:minCount": ["eve->ada"]}),
    "label annotation": ('ex:S sh:targetClass ex:Pit ; w:label "Shaft" ; sh:property [ sh:path ex:boss ; w:property "foreman" ; sh:minCount 1 ] .', {"ex:S/ex:boss/sh:minCount": ["bea", "cyd", "eve"]}),
    "direction annotation": ('ex:fedBy w:relationship "FEEDS" ; w:direction "in" . ex:S sh:targetClass ex:Shaft ; sh:property [ sh:path ex:fedBy ; sh:minCount 1 ] .', {"ex:S/ex:fedBy/sh:minCount": ["eve"]}),
    "property shape": ("ex:S sh:targetClass ex:Shaft ; sh:path ex:foreman ; sh:minCount 1 .", {"ex:S/ex:foreman/sh:minCount": ["bea", "cyd", "eve"]}),
}


@pytest.mark.parametrize("name", TARGETS)
def test_targets(mine, name):
    text, want = TARGETS[name]
    report = run(mine, text)
    assert found(report) == want
    if name == "relationships":  # each relationship is a focus of its own
        assert next(r for r in report.rules if r.constraint == "sh:maxExclusive").violation_count == 2


def test_details_and_messages(mine):
    report = run(mine, SEAMS + "\n" + shape('sh:property [ sh:path ex:opensTo ; sh:node ex:G ; sh:message "{$this} leads to {?value}, a poor place" ]', SHAFT))
    rows = {(v["focus"]["keyValue"], v["value"]["keyValue"]): v for v in report.rules[0].violations}
    assert set(rows) == {("bea", "g2"), ("bea", "g3"), ("dot", "g3")}
    assert rows["bea", "g2"]["details"] == ["ex:G/ex:seam/sh:pattern"] and sorted(rows["dot", "g3"]["details"]) == ["ex:G/ex:seam/sh:minCount", "ex:G/ex:tools/sh:maxCount"]
    assert rows["dot", "g3"]["message"] == "dot leads to g3, a poor place" and rows["dot", "g3"]["value"] == {"label": "Gallery", "keyValue": "g3", "elementId": "g3"}
    report = run(mine, shape("sh:or ( [ sh:path ex:opened ; sh:minCount 1 ] [ sh:path ex:note ; sh:minCount 1 ] )", SHAFT))
    assert report.rules[0].violations[0]["details"] == ["ex:S/sh:or[0]/ex:opened/sh:minCount", "ex:S/sh:or[1]/ex:note/sh:minCount"]
    assert report.rules[0].violations[0]["message"] == "ex:S violates sh:or"


def test_qualified_disjoint(spark):
    """Sibling shapes take away the parcels that they claim too: fragile and heavy ones count for neither."""
    parcels = spark.createDataFrame([("lamp", True, 2), ("anvil", False, 60), ("piano", True, 300), ("vase", True, 1), ("brick", False, 3), ("safe", False, 90)], "id string, fragile boolean, kg int")
    loads = {"van": ["lamp", "anvil", "piano"], "cart": ["piano", "brick"], "truck": ["anvil", "safe", "vase"], "sled": ["brick"]}
    graph = PropertyGraph([nodes(spark, "Vehicle", "", [(x,) for x in loads]), NodeTable("Parcel", parcels)], [rel(spark, "CARRIES", "Vehicle", "Parcel", [(v, p) for v, ps in loads.items() for p in ps])])
    kinds = {"Fragile": "sh:property [ sh:path ex:fragile ; sh:hasValue true ]", "Heavy": "sh:property [ sh:path ex:kg ; sh:minExclusive 50 ]"}
    limits = {"Fragile": "sh:qualifiedMinCount 1", "Heavy": "sh:qualifiedMaxCount 1"}
    text = "".join(f"ex:{k} {body} .\n" for k, body in kinds.items())
    text += "ex:S sh:targetClass ex:Vehicle ; " + " ; ".join(f'sh:property [ sh:path ex:carries ; w:relationship "CARRIES" ; w:name "{k}" ; sh:qualifiedValueShape ex:{k} ; sh:qualifiedValueShapesDisjoint true ; {n} ]' for k, n in limits.items()) + " ."
    assert found(run(graph, text)) == {"ex:S/ex:carries/sh:qualifiedMinCount": ["cart", "sled"], "ex:S/ex:carries/sh:qualifiedMaxCount": ["truck"]}


def test_durations_keep_apart(spark):
    df = spark.createDataFrame([("a", timedelta(days=3), 14), ("b", timedelta(hours=2), 2)], "id string, d interval day to second, m int").withColumn("ym", F.expr("make_ym_interval(0, m)"))
    graph = PropertyGraph([NodeTable("Item", df)])
    text = 'sh:property [ sh:path ex:d ; sh:maxInclusive "P1D"^^xsd:duration ; sh:minInclusive "P1M"^^xsd:duration ] ; sh:property [ sh:path ex:ym ; sh:maxInclusive "P1Y"^^xsd:duration ; sh:datatype xsd:yearMonthDuration ]'
    assert found(run(graph, shape(text))) == {"ex:S/ex:d/sh:maxInclusive": ["a"], "ex:S/ex:d/sh:minInclusive": ["a", "b"], "ex:S/ex:ym/sh:maxInclusive": ["a"]}


def test_focus_and_value_structs(spark, mine):
    flood = 'ex:S w:targetRelationship "PUMPS" ; sh:property [ sh:path ex:litres ; sh:maxExclusive 500 ] .'
    first = run(mine, flood).rules[0].violations[0]["focus"]
    assert {k: first[k] for k in ("type", "startKey", "endKey")} == {"type": "PUMPS", "startKey": "cyd", "endKey": "dot"} and first["elementId"].startswith("cyd->dot#")
    keyed = PropertyGraph([nodes(spark, "Shaft", "", [("x",), ("y",)])], [RelTable("PUMPS", "Shaft", "Shaft", spark.createDataFrame([("r1", "x", "y", 501), ("r2", "x", "y", 501)], "rid string, src string, dst string, litres int"), key="rid")])
    assert [v["focus"]["elementId"] for v in run(keyed, flood).rules[0].violations] == ["r1", "r2"]
    report = run(mine, shape("sh:property [ sh:path ex:vents ; sh:class ex:Shaft ]", SHAFT))
    assert {v["focus"]["keyValue"] for v in report.rules[0].violations} == {"bea", "cyd"}
    assert all(v["value"] == {"label": "Fan", "keyValue": "f1", "elementId": "f1"} for v in report.rules[0].violations)
    many = NodeTable("Thing", spark.createDataFrame([("t1", ["Thing", "Tool"], None), ("t2", ["Thing", "Toy", "Tool"], None), ("t3", None, None)], "id string, l array<string>, name string"), labels="l")
    text = "ex:Toy rdfs:subClassOf ex:Gear . ex:Tool rdfs:subClassOf ex:Gear . ex:S sh:targetClass ex:Gear ; sh:property [ sh:path ex:name ; sh:minCount 1 ] ."
    report = run(PropertyGraph([many]), text)
    assert {(v["focus"]["label"], v["focus"]["keyValue"]) for v in report.rules[0].violations} == {("Tool", "t1"), ("Tool", "t2")}


def test_depth_cap_and_cycles(spark):
    n = 14
    graph = PropertyGraph([nodes(spark, "N", "", [(f"n{i:02}",) for i in range(n)])], [rel(spark, "NEXT", "N", "N", [(f"n{i:02}", f"n{i + 1:02}") for i in range(n - 1)] + [(f"n{n - 1:02}", "n05")])])
    text = "ex:S sh:targetClass ex:N ; sh:property [ sh:path [ sh:oneOrMorePath ex:next ] ; sh:maxCount 8 ] ."
    reach = {i: set() for i in range(n)}
    for i in range(n):
        x = i
        for _ in range(10):
            x = x + 1 if x < n - 1 else 5
            reach[i].add(x)
    assert found(run(graph, text)) == {"ex:S/ex:next+/sh:maxCount": [f"n{i:02}" for i in range(n) if len(reach[i]) > 8]}
    assert run(graph, text, Options(max_path_depth=3)).conforms


def test_schema_decides(mine):
    text = shape("sh:property [ sh:path ex:foreman ; sh:datatype xsd:string ] ; sh:property [ sh:path ex:note ; sh:datatype xsd:integer ] ; sh:property [ sh:path ex:opened ; sh:minCount 0 ] ; sh:property [ sh:path ex:feeds ; sh:class ex:Shaft ] ; sh:property [ sh:path ex:feeds ; w:name \"R\" ; sh:class ex:Fan ]", SHAFT)
    compiled = compile_shapes([Document("s.ttl", HEAD + text)], mine.snapshot())
    by = {(r.path, r.name): r.status for r in compiled.rules}
    assert sorted(by.values()) == ["guaranteed-by-schema"] * 3 + ["schema-mismatch"] * 2
    assert len(compiled.diagnostics) == 2 and all(d["code"] == "SchemaMismatch" for d in compiled.diagnostics)
    report = validate(mine, compiled)
    assert report.summary()["guaranteedBySchema"] == 3 and report.summary()["skipped"] == 2 and exit_code(report) == 0
    with pytest.raises(CompileError):
        compile_shapes([Document("s.ttl", HEAD + text)], mine.snapshot(), Options(fail_on_schema_mismatch=True))
    missing = compile_shapes([Document("s.ttl", HEAD + shape("sh:property [ sh:path ex:nope ; sh:minCount 1 ]", SHAFT))], mine.snapshot())
    assert "nope" in missing.diagnostics[0]["message"] and missing.rules[0].status == "compiled"


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "`the.id` string, `a.b``c` int")
    graph = PropertyGraph([NodeTable("Item", df, "the.id")])
    assert found(run(graph, 'ex:p w:property "a.b`c" . ' + shape("sh:property [ sh:path ex:p ; sh:minCount 1 ]"))) == {"ex:S/ex:p/sh:minCount": ["b"]}


def test_fused_rules_scan_once(spark, mine):
    from graphwarden import Engine

    text = shape("sh:property [ sh:path ex:foreman ; sh:minCount 1 ; sh:maxLength 3 ] ; sh:property [ sh:path ex:note ; sh:minCount 1 ] ; sh:property [ sh:path ex:feeds ; sh:minCount 1 ]", SHAFT)
    compiled = compile_shapes([Document("s.ttl", HEAD + text)], mine.snapshot())
    groups = Engine(mine).fused(compiled.rules)
    assert sorted(len(g) for g, _ in groups) == [1, 3]
    counts = {r.rule_id: r.violation_count for r in Engine(mine).summary(compiled.rules).collect()}
    assert counts == {"ex:S/ex:foreman/sh:minCount": 3, "ex:S/ex:foreman/sh:maxLength": 1, "ex:S/ex:note/sh:minCount": 3, "ex:S/ex:feeds/sh:minCount": 2}


def test_stream(spark, tmp_path):
    from graphwarden.streaming.validate import validate_stream

    graph = PropertyGraph([nodes(spark, "Buoy", "depth int", []), nodes(spark, "Chain", "", [("c9",)])], [rel(spark, "HELD_BY", "Buoy", "Chain", [("red", "c9")])])
    compiled = compile_shapes([Document("s.ttl", HEAD + shape("sh:property [ sh:path ex:depth ; sh:maxExclusive 30 ] ; sh:property [ sh:path ex:heldBy ; sh:minCount 1 ]", "sh:targetClass ex:Buoy"))], graph.snapshot())
    spark.createDataFrame([("red", 44), ("green", 12)], "id string, depth int").write.json(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id string, depth int").json(str(tmp_path / "in"))
    query = validate_stream(stream, graph, "Buoy", compiled, lambda df, n: seen.extend((r.rule_id, r.focus_key) for r in df.collect()), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(60)
    assert sorted(seen) == [("ex:S/ex:depth/sh:maxExclusive", "red"), ("ex:S/ex:heldBy/sh:minCount", "green")]


def _berths(spark, berth_key, ship_key):
    berths = NodeTable("Berth", spark.createDataFrame([(7,), (8,), (9,)], "id int").select(F.col("id").cast(berth_key)))
    ships = NodeTable("Ship", spark.createDataFrame([(1,), (2,), (3,)], "id int").select(F.col("id").cast(ship_key)))
    moored = spark.createDataFrame([(1, 7), (2, 8), (2, 9), (2, 9)], "src int, dst int").select(F.col("src").cast(ship_key), F.col("dst").cast("bigint"))
    return PropertyGraph([berths, ships, NodeTable("Log", spark.createDataFrame([("x",)], "id string"))], [RelTable("MOORED_AT", "Ship", "Berth", moored)])


@pytest.mark.parametrize("berth_key, ship_key, kind", [("int", "bigint", "bigint"), ("smallint", "int", "bigint"), ("string", "int", "string"), ("int", "string", "string"), ("int", "decimal(9,0)", "string")])
def test_key_types(spark, berth_key, ship_key, kind):
    graph = _berths(spark, berth_key, ship_key)
    assert {graph.key_type("Ship"), graph.key_type("Berth")} == {kind} and graph.key_type("Log") == "string"
    shapes = shape(
        "sh:property [ sh:path ex:mooredAt ; sh:minCount 1 ; sh:maxCount 1 ] ; sh:property [ sh:path ( ex:mooredAt [ sh:inversePath ex:mooredAt ] ) ; sh:maxCount 0 ] ; sh:property [ sh:path [ sh:zeroOrMorePath ex:mooredAt ] ; sh:class ex:Berth ]",
        "sh:targetClass ex:Ship",
    )
    got = sorted(tuple(sorted(x)) for x in found(run(graph, shapes)).values())
    assert got == [("1", "2"), ("1", "2", "3"), ("2",), ("3",)]


def test_native_keys_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/ships")
    spark.range(100).selectExpr("id AS src", "id + 1000 AS dst").write.parquet(f"{tmp_path}/moored")
    ships, moored = spark.read.parquet(f"{tmp_path}/ships"), spark.read.parquet(f"{tmp_path}/moored")
    graph = PropertyGraph([NodeTable("Ship", ships), NodeTable("Berth", ships.selectExpr("id + 1000 AS id"))], [RelTable("MOORED_AT", "Ship", "Berth", moored)])
    from graphwarden.operators.rules import Engine

    rules = compile_shapes([Document("s.ttl", HEAD + shape("sh:property [ sh:path ex:mooredAt ; sh:maxCount 1 ]", "sh:targetClass ex:Ship"))], graph.snapshot(), Options()).rules
    plan = Engine(graph).all_violations(rules)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "[" in line]
    assert joins and not any("cast(" in line for line in joins)
