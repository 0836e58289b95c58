"""What compilation, manifests, plans and the command line say about shapes: facts that hold without data, beside
the snapshot of the driver's tables."""

import contextlib
import io

import pytest

from graphwarden import cli
from graphwarden.catalogue_surface import SHAPES, _document, _property
from graphwarden.errors import CompileError, ManifestError
from graphwarden.functions.xsdregex import translate
from graphwarden.plans.ir import Closed, Count, Pair, Rel, Source, Test as ValueTest, and_, scope_faults
from graphwarden.plans.lower import Options
from graphwarden.plans.manifest import compile_shapes, load_manifest
from graphwarden.runner import plans_text
from graphwarden.sources.retail import retail_graph

FACTS = {}


def _values(columns, *rows):
    return list(rows)


def _facts(spark, rows, schema):
    return rows


def query(rows):
    def register(f):
        FACTS[f.__name__] = (f, rows)
        return f

    return register


def _problem(body: str, **options) -> str | None:
    try:
        compile_shapes([_document(body)], None, Options(**options))
    except CompileError as error:
        return str(error).splitlines()[0].partition(": ")[2]
    return None


@query(_values("what, rejected", ("node target", True), ("repeated sequence", True), ("recursive shape", True), ("language tags", True), ("no convention", True), ("plain", False)))
def rejected_shapes(spark, sf_dir):
    texts = {
        "node target": ("ex:S sh:targetNode ex:n ; sh:closed true .", {}), "repeated sequence": (_property("Order", "[ sh:oneOrMorePath (ex:placedBy ex:inNation) ]", "sh:minCount 1"), {}),
        "recursive shape": ("ex:S sh:targetClass ex:Order ; sh:node ex:S .", {}), "language tags": (_property("Part", "ex:p_name", "sh:uniqueLang true"), {}),
        "no convention": (_property("Part", "ex:p_name", "sh:minCount 1"), {"strict": True}), "plain": (_property("Part", "ex:p_name", "sh:minCount 1"), {}),
    }
    return _facts(spark, [(k, _problem(t, **o) is not None) for k, (t, o) in texts.items()], "what string, rejected boolean")


@query(_values("constraint_name, status", ("sh:uniqueLang", "unsupported"), ("sh:minCount", "compiled"), ("sh:node", "unsupported")))
def lenient_rules(spark, sf_dir):
    text = _property("Part", "ex:p_name", "sh:uniqueLang true ; sh:minCount 1") + " ex:R sh:targetClass ex:Part ; sh:node ex:R ."
    c = compile_shapes([_document(text)], retail_graph(spark, sf_dir).snapshot(), Options(lenient=True))
    return _facts(spark, [(r.constraint, r.status) for r in c.rules], "constraint_name string, status string")


_PATTERNS = {"a(b": False, "a(?=b)": False, "a**": False, "a{2,1}": False, r"(a)\2": False, r"\q": False, "[a": False, r"^(a|b)\1$": True, "[a-z-[aeiou]]+": True, r"\p{Lu}{2,3}?": True}


@query(_values("pattern, valid", *_PATTERNS.items()))
def pattern_syntax(spark, sf_dir):
    def valid(pattern: str) -> bool:
        try:
            return translate(pattern) is not None
        except CompileError:
            return False

    return _facts(spark, [(p, valid(p)) for p in _PATTERNS], "pattern string, valid boolean")


@query(_values("condition, faults", ("label of a literal", 1), ("values of a literal", 2), ("closed literal", 1), ("nodes over hops", 0)))
def free_variables(spark, sf_dir):
    """Tests of a variable that nothing binds to a node are found before anything runs."""
    hop, own = Source(Rel(("R",))), Source(None, ("p",))
    asked = {
        "label of a literal": Count(own, ValueTest("label", labels=("A",)), True, 1), "values of a literal": Count(own, and_((Pair(own, own, "equals"),)), True, 1),
        "closed literal": Count(own, Closed((), ()), True, 1), "nodes over hops": Count(hop, and_((Count(own, ValueTest("length", op=">=", n=1), True, 1), Closed((), ()))), True, 1),
    }
    return _facts(spark, [(k, len(scope_faults(e, True))) for k, e in asked.items()], "condition string, faults int")


_MANIFEST = [
    ("S.c_acctbal.minInclusive", "ex:S/ex:c_acctbal/sh:minInclusive", "compiled", "scan", None, "Warning"), ("S.inNation.minCount", "ex:S/ex:inNation/sh:minCount", "compiled", "scan+expand", None, "Violation"),
    ("T.next_plus.maxCount", "ex:T/ex:next+/sh:maxCount", "compiled", "unbounded-path", 7, "Violation"), ("P.p_size.datatype", "ex:P/ex:p_size/sh:datatype", "guaranteed-by-schema", "scan", None, "Violation"),
]
_MANIFEST_SHAPES = (
    "ex:S sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ; sh:severity sh:Warning ] ; sh:property [ sh:path ex:inNation ; sh:minCount 1 ] . "
    "ex:T sh:targetClass ex:Turn ; sh:property [ sh:path [ sh:oneOrMorePath ex:next ] ; sh:maxCount 3 ] . ex:P sh:targetClass ex:Part ; sh:property [ sh:path ex:p_size ; sh:datatype xsd:int ] ."
)


@query(_values("name, rule_id, status, cost, depth, severity", *_MANIFEST))
def manifest_rules(spark, sf_dir):
    """Names, ids, costs and depths of a manifest that was loaded again."""
    schema = retail_graph(spark, sf_dir).snapshot()
    c = compile_shapes([_document(_MANIFEST_SHAPES)], schema, Options(max_path_depth=7))
    rules = load_manifest(c.to_json(), schema).manifest()["rules"]
    return _facts(spark, [(r["name"], r["ruleId"], r["status"], r["costClass"], r["pathDepthCap"], r["severity"]) for r in rules], "name string, rule_id string, status string, cost string, depth int, severity string")


@query(_values("place, rule_id", (1, "ex:P/ex:p_size/sh:datatype"), (2, "ex:S/ex:c_acctbal/sh:minInclusive"), (3, "ex:S/ex:inNation/sh:minCount"), (4, "ex:T/ex:next+/sh:maxCount")))
def rule_order(spark, sf_dir):
    c = compile_shapes([_document(_MANIFEST_SHAPES)], retail_graph(spark, sf_dir).snapshot())
    return _facts(spark, [(k, r.rule_id) for k, r in enumerate(c.rules, 1)], "place int, rule_id string")


@query(_values("change, same", ("moved", True), ("blank shapes swapped", True), ("other bound", False), ("manifest of other shapes", False)))
def fingerprints(spark, sf_dir):
    def prints(*bodies: str) -> list:
        inner = " ; ".join(f"sh:property [ {b} ]" for b in bodies)
        return [(r.rule_id, r.fingerprint) for r in compile_shapes([_document(_property("Order", "ex:placedBy", f"sh:class ex:Customer ; sh:node [ {inner} ]"))]).rules]

    a, b = "sh:path ex:c_acctbal ; sh:minInclusive 0", "sh:path ex:c_name ; sh:minCount 1"
    first = compile_shapes([_document(_property("Part", "ex:p_size", "sh:minInclusive 1"))])
    moved = compile_shapes([_document("\n\n" + _property("Part", "ex:p_size", "sh:minInclusive 1"))])
    other = first.to_json().replace(first.rules[0].fingerprint, "0" * 16)
    try:
        loaded = load_manifest(other) is not None
    except ManifestError:
        loaded = False
    same = lambda x, y: [r.fingerprint for r in x.rules] == [r.fingerprint for r in y.rules]
    rows = [("moved", same(first, moved)), ("blank shapes swapped", prints(a, b) == prints(b, a)), ("other bound", prints(a, b) == prints(a.replace("0", "1"), b)), ("manifest of other shapes", loaded)]
    return _facts(spark, rows, "change string, same boolean")


@query(_values("label, property", ("Nation", "n_name"), ("Region", "r_name")))
def recommended_keys(spark, sf_dir):
    text = 'ex:S sh:targetClass ex:Nation ; w:key "n_name" ; sh:property [ sh:path ex:n_name ; sh:minLength 1 ] . ex:T sh:targetClass ex:Region ; sh:property [ sh:path ex:r_name ; sh:minLength 1 ] .'
    c = compile_shapes([_document(text)], retail_graph(spark, sf_dir).snapshot(), Options(node_key="r_name"))
    return _facts(spark, [(k["label"], k["property"]) for k in c.recommended_keys], "label string, property string")


@query(_values("rule_id, scans", ("ex:S/ex:c_acctbal/sh:maxInclusive", 1), ("ex:S/ex:c_acctbal/sh:minInclusive", 1)))
def plans_listed(spark, sf_dir):
    """Rules that share a focus share one plan with one scan."""
    graph = retail_graph(spark, sf_dir)
    text = plans_text(graph, compile_shapes([_document(_property("Customer", "ex:c_acctbal", "sh:minInclusive 0 ; sh:maxInclusive 9"))], graph.snapshot()))
    ids = [x.partition(": ")[2] for x in text.splitlines() if x.startswith("-- ruleId")]
    return _facts(spark, [(i, text.count("\n(1) Scan parquet")) for i in ids], "rule_id string, scans int")


@query(_values("call, code", ("compile", 0), ("compile nothing", 1), ("no such graph", 2)))
def command_line(spark, sf_dir):
    calls = {"compile": ["compile", str(SHAPES / "orders.ttl")], "compile nothing": ["compile", str(SHAPES / "none.ttl")], "no such graph": ["validate", str(SHAPES / "orders.ttl"), "--graph", str(SHAPES / "none.json")]}
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        return _facts(spark, [(k, cli.main(a)) for k, a in calls.items()], "call string, code int")


@pytest.mark.parametrize("name", FACTS)
def test_facts(spark, sf, name):
    f, rows = FACTS[name]
    assert sorted(map(str, f(spark, sf))) == sorted(map(str, rows))
