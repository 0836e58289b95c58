"""N-Triples as data: lines against the Turtle parser, the projection, and SHACL Core components over triples."""

import json

import pytest

from graphwarden import Document, Options, compile_shapes, validate
from graphwarden.cli import main
from graphwarden.errors import SourceError
from graphwarden.sources.graph import load_graph
from graphwarden.sources.ntriples import project, read
from graphwarden.sources.turtle import Blank, Iri, parse

from test_rules import HEAD, found

LINES = r"""
<http://e/s> <http://e/p> <http://e/o> .
  <http://e/s>	<http://e/p>	"plain"	.   # a comment with "quotes" .
<http://e/s> <http://e/p> "a \"quoted\" \\ word\\" .
<http://e/s> <http://e/p> "ends # no comment" . # said "x" .
<http://e/s><http://e/p>"tight"^^<http://www.w3.org/2001/XMLSchema#token>.
<http://e/s> <http://e/p> "café \U0001F600 \t\n\r\b\f\'" .
<http://e/é> <http://e/p> "" .
_:b1 <http://e/p> _:b.2 .
_:b1 <http://e/p> "12"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://e/s> <http://e/p> "hallo"@de-AT .
# only a comment

<http://e/s> <http://e/p> "日本 \\u0041 {} |" .
"""
BAD = ['<http://e/s> <http://e/p> "open .', '<http://e/s> <http://e/p> "a" b" .', "<http://e/s> <http://e/p> .", '<http://e/s> "p" <http://e/o> .', '<http://e/s> <http://e/p> "x\\q" .', "<a b> <http://e/p> <http://e/o> .", '<http://e/s> <http://e/p> "x"', '"s" <http://e/p> <http://e/o> .', "<> <http://e/p> <http://e/o> .", "nonsense"]


def test_lines_like_the_parser(spark, tmp_path):
    (tmp_path / "a.nt").write_text(LINES, encoding="utf-8")
    rows = read(spark, str(tmp_path / "a.nt")).collect()
    want = []
    for line in LINES.splitlines():
        want += parse(line, "a.nt", "nt").parse()
    got = []
    for r in rows:
        got.append((r.s if not r.s.startswith("_:") else "_:" + r.s.partition(".")[2], r.p, r.o if r.kind != "blank" else "_:" + r.o.partition(".")[2], r.kind, r.datatype, r.lang))
    plain = lambda t: "_:" if isinstance(t, Blank) else t.value
    assert len(want) == len(got) == 11
    for w, g in zip(want, got):
        assert (plain(w.s), w.p.value) == (g[0] if not g[0].startswith("_:") else "_:", g[1])
        if isinstance(w.o, Iri):
            assert g[2:4] == (w.o.value, "iri")
        elif not isinstance(w.o, Blank):
            assert (g[2], (g[5] or "").lower()) == (w.o.value, w.o.language)
    by = [g[2] for g in got]
    assert 'a "quoted" \\ word\\' in by and "ends # no comment" in by and "café 😀 \t\n\r\b\f'" in by and "" in by and "日本 \\u0041 {} |" in by and "_:b.2" in by


@pytest.mark.parametrize("line", BAD)
def test_malformed_lines(spark, tmp_path, line):
    (tmp_path / "a.nt").write_text(f"<http://e/s> <http://e/p> <http://e/o> .\n{line}\n")
    assert read(spark, str(tmp_path / "a.nt"), "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="not N-Triples"):
        read(spark, str(tmp_path / "a.nt")).collect()


E = "http://example.org/"
XSD = "http://www.w3.org/2001/XMLSchema#"


def nt(text):
    """Short triples (`a b c`, one a line; numbers, "text", ^^type) in full."""
    out = []
    for line in text.strip().splitlines():
        s, p, o = line.split(None, 2)
        s, p = (x if x.startswith("_:") else f"<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>" if x == "a" else f"<{E}{x}>" for x in (s, p))
        if o.startswith('"'):
            value, _, kind = o.rpartition("^^") if "^^" in o else (o, "", "")
            o = f"{value}^^<{XSD}{kind}>" if kind else o
        elif o.lstrip("-").isdigit():
            o = f'"{o}"^^<{XSD}integer>'
        elif not o.startswith("_:"):
            o = f"<{E}{o}>"
        out.append(f"{s} {p} {o} .")
    return "\n".join(out) + "\n"


def imported(spark, folder, text, **more):
    (folder / "data.nt").write_text(nt(text), encoding="utf-8")
    return load_graph(spark, project(spark, read(spark, str(folder / "data.nt")), str(folder / "graph"), **more))


def test_projection(spark, tmp_path):
    graph = imported(spark, tmp_path, """
        ann a Poet
        ann a Baker
        ann born 1901
        ann name "Ann"
        ann name "Anna"
        ann knows bob
        ann knows bob
        bob a Poet
        bob born "1899"^^gYear
        bob knows nowhere
        bob weight "81.5"^^double
        bob weight "heavy"
        bob since "2001-02-03"^^date
        bob since "2001-13-03"^^date
        _:x a Baker
        _:x knowsWell ann
    """)  # fmt: skip
    by = {n.label: n for n in graph.nodes}
    assert sorted(by) == ["Baker", "Poet", "Resource"] and by["Baker"].carries == ("Poet",)
    assert by["Baker"].properties["born"] == "LIST<INT64>" and by["Poet"].properties["weight"] == "LIST<ANY>" and by["Poet"].properties["since"] == "LIST<ANY>" and by["Poet"].properties["born"] == "LIST<STRING>"
    rows = {r["@id"]: r for r in by["Baker"].df.collect()}
    ann = rows[E + "ann"]
    assert sorted(ann["name"]) == ["Ann", "Anna"] and ann["born"] == [1901] and ann["@labels"] == ["Baker", "Poet"] and len(rows) == 2
    assert {(r.type, r.start, r.end): r.df.count() for r in graph.rels} == {("KNOWS", "Baker", "Poet"): 1, ("KNOWS", "Poet", "Resource"): 1, ("KNOWS_WELL", "Baker", "Baker"): 1}
    assert graph.snapshot().enforced is False and graph.snapshot().nodes["Poet"]["name"] == "LIST<STRING>"
    text = HEAD + "ex:S sh:targetClass ex:Poet ; sh:property [ sh:path ex:weight ; sh:datatype xsd:double ] ; sh:property [ sh:path ex:since ; sh:datatype xsd:date ] ; sh:property [ sh:path ex:name ; sh:minCount 1 ] ; sh:property [ sh:path ex:knows ; sh:class ex:Poet ] ."
    got = found(validate(graph, compile_shapes([Document("s.ttl", text)], graph.snapshot())))
    assert got == {"ex:S/ex:weight/sh:datatype": [E + "bob"], "ex:S/ex:since/sh:datatype": [E + "bob"], "ex:S/ex:name/sh:minCount": [E + "bob"], "ex:S/ex:knows/sh:class": [E + "bob"]}


@pytest.mark.parametrize("text, match", [("x name \"a\"@en", "language tags"), ('x name "a"\nx other/name "b"', "several predicates"), ("x a One\ny a http/One", "several predicates"), ("x to y\nx other/to y", "several predicates")])
def test_names_that_can_not_be_told_apart(spark, tmp_path, text, match):
    with pytest.raises(SourceError, match=match):
        imported(spark, tmp_path, text)


def test_empty_and_classless(spark, tmp_path):
    graph = imported(spark, tmp_path, "x to y")
    assert [(n.label, n.df.count()) for n in graph.nodes] == [("Resource", 2)]
    (tmp_path / "empty.nt").write_text("# nothing\n")
    assert project(spark, read(spark, str(tmp_path / "empty.nt")), str(tmp_path / "none")) == {"nodes": [], "rels": []}


def test_command(spark, tmp_path, capsys):
    (tmp_path / "d.nt").write_text(nt("x a Item\nx size 9\ny a Item"))
    assert main(["import", str(tmp_path / "d.nt"), "--folder", str(tmp_path / "g"), "-o", str(tmp_path / "graph.json")]) == 0
    graph = load_graph(spark, str(tmp_path / "graph.json"))
    assert [(n["label"], n["key"]) for n in json.loads((tmp_path / "graph.json").read_text())["nodes"]] == [("Item", "@id")] and graph.nodes[0].df.count() == 2


# -- components of SHACL Core over triples, one class of nodes for each case: triples, shape, ids that fail
COMPONENTS = {
    "complex example": ("""
        c1 a Skipper
        c1 licence "AB-12"
        c1 sails boatA
        c2 a Skipper
        c2 licence "AB-12"
        c2 licence "XY-99"
        c3 a Skipper
        c3 licence "12-AB"
        c3 sails c1
        c3 hobby "chess"
        boatA a Yawl""",
        'sh:targetClass ex:Skipper ; sh:property [ sh:path ex:licence ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:pattern "^[A-Z]{2}-[0-9]{2}$" ] ; sh:property [ sh:path ex:sails ; sh:class ex:Yawl ; sh:nodeKind sh:IRI ] ; sh:closed true ; sh:ignoredProperties (rdf:type ex:wage)', "c2 c3"),
    "node: and": ("d1 a Loaf\nd1 grams 500\nd1 crust \"dark\"\nd2 a Loaf\nd2 grams 500\nd3 a Loaf\nd3 crust \"pale\"", "sh:targetClass ex:Loaf ; sh:and ( [ sh:path ex:grams ; sh:minCount 1 ] [ sh:path ex:crust ; sh:minCount 1 ] )", "d2 d3"),
    "node: in": ("green a Signal\nred a Signal\nmauve a Signal", 'sh:targetClass ex:Signal ; sh:in (ex:green ex:red ex:amber)', "mauve"),
    "node: node": ("f1 a Ferry\nf1 deck 2\nf2 a Ferry", "sh:targetClass ex:Ferry ; sh:node [ sh:property [ sh:path ex:deck ; sh:minCount 1 ] ]", "f2"),
    "node: or": ("g1 a Guest\ng1 phone \"1\"\ng2 a Guest\ng2 mail \"m\"\ng3 a Guest", "sh:targetClass ex:Guest ; sh:or ( [ sh:path ex:phone ; sh:minCount 1 ] [ sh:path ex:mail ; sh:minCount 1 ] )", "g3"),
    "node: xone": ("h1 a Badge\nh1 full \"A B\"\nh2 a Badge\nh2 full \"A B\"\nh2 first \"A\"\nh3 a Badge", "sh:targetClass ex:Badge ; sh:xone ( [ sh:path ex:full ; sh:minCount 1 ] [ sh:path ex:first ; sh:minCount 1 ] )", "h2 h3"),
    "node: xone of one shape twice": ("i1 a Stub\ni2 a Stub\ni2 mark 1", "sh:targetClass ex:Stub ; sh:xone ( ex:Marked ex:Marked )", "i1 i2"),
    "path: inverse": ("j1 a Hive\nbee1 livesAt j1\nbee2 livesAt j1\nj2 a Hive\nbee1 a Bee\nbee2 a Bee", "sh:targetClass ex:Hive ; sh:property [ sh:path [ sh:inversePath ex:livesAt ] ; sh:minCount 1 ; sh:class ex:Bee ]", "j2"),
    "path: sequence of one inverse": ("k1 a Weir\nk2 a Weir\nk1 feeds k2\nk2 feeds k3", "sh:targetClass ex:Weir ; sh:property [ sh:path ( [ sh:inversePath ex:feeds ] ex:feeds ) ; sh:minCount 1 ]", "k1"),
    "path: alternative of inverses": ("l1 a Mast\nl1 stays l2\nl2 a Mast\nl3 a Mast", "sh:targetClass ex:Mast ; sh:property [ sh:path [ sh:alternativePath ( ex:stays [ sh:inversePath ex:stays ] ) ] ; sh:minCount 1 ]", "l3"),
    "property: datatype": ('m1 a Meter\nm1 reads 7\nm2 a Meter\nm2 reads "7"\nm3 a Meter\nm3 reads "seven"^^integer\nm4 a Meter\nm4 reads "7.5"^^double', "sh:targetClass ex:Meter ; sh:property [ sh:path ex:reads ; sh:datatype xsd:integer ]", "m2 m3 m4"),
    "property: hasValue": ('n1 a Coat\nn1 lined "wool"\nn1 lined "silk"\nn2 a Coat\nn2 lined "silk"\nn3 a Coat', 'sh:targetClass ex:Coat ; sh:property [ sh:path ex:lined ; sh:hasValue "wool" ]', "n2 n3"),
    "property: in": ('o1 a Tap\no1 state "open"\no2 a Tap\no2 state "stuck"\no3 a Tap', 'sh:targetClass ex:Tap ; sh:property [ sh:path ex:state ; sh:in ("open" "shut") ]', "o2"),
    "property: maxLength": ('p1 a Memo\np1 line "short"\np2 a Memo\np2 line "rather long"', "sh:targetClass ex:Memo ; sh:property [ sh:path ex:line ; sh:maxLength 6 ]", "p2"),
    "property: minExclusive": ('q1 a Kiln2\nq1 heat 900\nq2 a Kiln2\nq2 heat 800\nq3 a Kiln2\nq3 heat "hot"', "sh:targetClass ex:Kiln2 ; sh:property [ sh:path ex:heat ; sh:minExclusive 800 ]", "q2 q3"),
    "property: minLength": ('r1 a Sign\nr1 text "Exit"\nr2 a Sign\nr2 text ""', "sh:targetClass ex:Sign ; sh:property [ sh:path ex:text ; sh:minLength 1 ]", "r2"),
    "property: node": ("s1 a Team\ns1 led s2\ns2 a Lead\ns2 rank 3\ns3 a Team\ns3 led s4\ns4 a Lead", "sh:targetClass ex:Team ; sh:property [ sh:path ex:led ; sh:node [ sh:property [ sh:path ex:rank ; sh:minCount 1 ] ] ]", "s3"),
    "property: node within node": ("t1 a Choir\nt1 sings t2\nt2 a Song\nt2 inKey t3\nt3 a Tone\nt3 sharp 1\nt4 a Choir\nt4 sings t5\nt5 a Song\nt5 inKey t6\nt6 a Tone", "sh:targetClass ex:Choir ; sh:property [ sh:path ex:sings ; sh:node [ sh:property [ sh:path ex:inKey ; sh:node [ sh:property [ sh:path ex:sharp ; sh:minCount 1 ] ] ] ] ]", "t4"),
    "property: pattern": ('u1 a Plate\nu1 no "KA 77"\nu2 a Plate\nu2 no "ka 77"', 'sh:targetClass ex:Plate ; sh:property [ sh:path ex:no ; sh:pattern "^[A-Z]+ [0-9]+$" ]', "u2"),
    "property: pattern with flags": ('v1 a Plate2\nv1 no "KA 77"\nv2 a Plate2\nv2 no "ka 77"\nv3 a Plate2\nv3 no "77"', 'sh:targetClass ex:Plate2 ; sh:property [ sh:path ex:no ; sh:pattern "^[A-Z]+ [0-9]+$" ; sh:flags "i" ]', "v3"),
    "property: qualified minimum of disjoint shapes": ("w1 a Deck\nw1 holds ace\nw1 holds king\nw2 a Deck\nw2 holds ace\nace a Ace\nking a King", "sh:targetClass ex:Deck ; sh:property [ sh:path ex:holds ; sh:qualifiedValueShape [ sh:class ex:Ace ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 ] ; sh:property [ sh:path ex:holds ; w:name \"kings\" ; sh:qualifiedValueShape [ sh:class ex:King ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 ]", "w2"),
    "property: qualified shapes that overlap": ("x1 a Crate\nx1 packs amp\nx2 a Crate\nx2 packs bulb\namp a Heavy\namp a Frail\nbulb a Frail", "sh:targetClass ex:Crate ; sh:property [ sh:path ex:packs ; sh:qualifiedValueShape [ sh:class ex:Frail ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 ] ; sh:property [ sh:path ex:packs ; w:name \"heavy\" ; sh:qualifiedValueShape [ sh:class ex:Heavy ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMaxCount 5 ]", "x1"),
    "targets: several": ("y1 a Tram\ny2 stopsAt y1\ny3 a Tram\ny3 line 5", "sh:targetClass ex:Tram ; sh:targetSubjectsOf ex:stopsAt ; sh:property [ sh:path ex:line ; sh:minCount 1 ]", "y1 y2"),
    "targets: class": ("z1 a Lock\nz2 a Lock\nz2 keyed 1", "sh:targetClass ex:Lock ; sh:property [ sh:path ex:keyed ; sh:minCount 1 ]", "z1"),
    "targets: implicit class": ("aa1 a Pier\naa2 a Pier\naa2 planks 9", None, "aa1"),
    "targets: subjects of a relationship": ("bb1 tows bb2\nbb2 tows bb3\nbb2 power 70", "sh:targetSubjectsOf ex:tows ; sh:property [ sh:path ex:power ; sh:minCount 1 ]", "bb1"),
    "targets: subjects of a property": ('cc1 slogan "Go"\ncc2 slogan "No"\ncc2 year 1999', "sh:targetSubjectsOf ex:slogan ; sh:property [ sh:path ex:year ; sh:minCount 1 ]", "cc1"),
}


@pytest.fixture(scope="module")
def components(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nt")
    graph = imported(spark, folder, "\n".join(t for t, *_ in COMPONENTS.values()))
    shapes = ["ex:Marked sh:property [ sh:path ex:mark ; sh:minCount 1 ] .", "ex:Pier a rdfs:Class , sh:NodeShape ; sh:property [ sh:path ex:planks ; sh:minCount 1 ] ."]
    shapes += [f"ex:C{k} {body} ." for k, (_, body, _) in enumerate(COMPONENTS.values()) if body]
    report = validate(graph, compile_shapes([Document("s.ttl", HEAD + "\n".join(shapes))], graph.snapshot(), Options(node_key="@name")), workers=4)
    assert not [(r.rule_id, r.status_reason) for r in report.rules if r.status == "error"]
    return found(report)


@pytest.mark.parametrize("name", COMPONENTS)
def test_component(components, name):
    assert len(COMPONENTS) == 27
    k = list(COMPONENTS).index(name)
    prefix = f"ex:C{k}/" if COMPONENTS[name][1] else "ex:Pier/"
    got = {x for rule, foci in components.items() if rule.startswith(prefix) for x in foci}
    assert got == set(COMPONENTS[name][2].split())
