"""Random graphs and shapes against a naive evaluator that walks the graph value by value."""

import random
from itertools import product

import pytest

from graphwarden import Document, NodeTable, Options, PropertyGraph, RelTable, compile_shapes, validate

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.org/> .\n"
LABELS = {"A": ("a", "x"), "B": ("b", "y")}


class Naive:
    """Nodes as {id: (label, properties)}, edges as (type, from, to)."""

    def __init__(self, nodes, edges):
        self.nodes, self.edges = nodes, edges

    def values(self, node, path):
        kind, *rest = path
        if kind == "prop":
            v = self.nodes[node][1].get(rest[0])
            return {x for x in (v if isinstance(v, list) else [v]) if x is not None}
        if kind == "rel":
            return {t for r, s, t in self.edges if r == rest[0].upper() and s == node}
        if kind == "inv":
            return {s for r, s, t in self.edges if r == rest[0].upper() and t == node}
        if kind == "seq":
            return {v for m in self.values(node, rest[0]) for v in self.values(m, rest[1])}
        if kind == "alt":
            return self.values(node, rest[0]) | self.values(node, rest[1])
        seen, front = set(), {node}
        for _ in range(1 if kind == "opt" else 4):
            front = {v for m in front for v in self.values(m, rest[0])} - seen
            seen |= front
        return seen | ({node} if kind in ("star", "opt") else set())

    def conforms(self, node, shape):
        path, (name, value) = shape
        got = self.values(node, path) if path else {node}
        if name == "minCount":
            return len(got) >= value
        if name == "maxCount":
            return len(got) <= value
        if name == "class":
            return all(self.nodes[v][0] == value for v in got)
        if name == "minInclusive":
            return all(isinstance(v, int) and v >= value for v in got)
        if name == "in":
            return all(v in value for v in got)
        if name == "hasValue":
            return value in got
        if name == "node":
            return all(self.conforms(v, value) for v in got)
        if name == "not":
            return all(not self.conforms(v, value) for v in got)
        if name == "or":
            return all(any(self.conforms(v, s) for s in value) for v in got)
        if name == "xone":
            return all(sum(self.conforms(v, s) for s in value) == 1 for v in got)
        least, inner = value
        return sum(self.conforms(v, inner) for v in got) >= least


def turtle_path(p):
    kind, *rest = p
    if kind in ("prop", "rel"):
        return f"ex:{rest[0]}"
    if kind == "inv":
        return f"[ sh:inversePath ex:{rest[0]} ]"
    if kind == "seq":
        return f"( {turtle_path(rest[0])} {turtle_path(rest[1])} )"
    if kind == "alt":
        return f"[ sh:alternativePath ( {turtle_path(rest[0])} {turtle_path(rest[1])} ) ]"
    return f"[ sh:{ {'star': 'zeroOrMore', 'plus': 'oneOrMore', 'opt': 'zeroOrOne'}[kind] }Path {turtle_path(rest[0])} ]"


def turtle_body(shape):
    path, (name, value) = shape
    out = f"sh:path {turtle_path(path)} ; " if path else ""
    if name in ("minCount", "maxCount", "minInclusive", "hasValue"):
        return out + f"sh:{name} {value}"
    if name == "class":
        return out + f"sh:class ex:{value}"
    if name == "in":
        return out + f"sh:in ( {' '.join(map(str, value))} )"
    if name in ("node", "not"):
        return out + f"sh:{name} [ {turtle_body(value)} ]"
    if name in ("or", "xone"):
        return out + f"sh:{name} ( {' '.join(f'[ {turtle_body(s)} ]' for s in value)} )"
    return out + f"sh:qualifiedValueShape [ {turtle_body(value[1])} ] ; sh:qualifiedMinCount {value[0]}"


def random_shape(rng, depth=0):
    rel = lambda: (rng.choice(("rel", "inv")), rng.choice(("knows", "likes")))
    hops = rng.choice([rel, rel, lambda: ("seq", rel(), rel()), lambda: ("alt", rel(), rel()), lambda: (rng.choice(("star", "plus", "opt")), rel())])()
    prop = rng.choice([("prop", "n"), ("prop", "m"), ("seq", rel(), ("prop", "n")), ("seq", ("alt", rel(), rel()), ("prop", "m"))])
    literal = rng.choice([("minCount", rng.randint(1, 2)), ("maxCount", rng.randint(0, 2)), ("minInclusive", rng.randint(0, 4)), ("in", [1, 2, 3]), ("hasValue", rng.randint(0, 4))])
    if depth == 2 or rng.random() < 0.35:
        return rng.choice([(prop, literal), (hops, rng.choice([("minCount", rng.randint(1, 3)), ("maxCount", rng.randint(0, 3)), ("class", rng.choice("AB"))]))])
    inner = [random_shape(rng, depth + 1) for _ in range(2)]
    return rng.choice([(hops, ("node", inner[0])), (hops, ("not", inner[0])), (hops, ("or", inner)), (hops, ("xone", inner)), (hops, ("qualifiedMinCount", (rng.randint(1, 2), inner[0]))), (None, ("or", inner)), (None, ("xone", inner)), (None, ("not", inner[0]))])


@pytest.mark.parametrize("seed", range(4))
def test_like_the_naive_evaluator(spark, seed):
    rng = random.Random(seed)
    ids = [f"{label.lower()}{k}" for label, k in product("AB", range(5))]
    value = lambda: rng.choice([None, *range(5)])
    nodes = {i: (i[0].upper(), {"n": value(), "m": rng.choice([None, [], [value() for _ in range(3)]])}) for i in ids}
    edges = {(r, rng.choice(ids), rng.choice(ids)) for r in ("KNOWS", "LIKES") for _ in range(9)}
    tables = [NodeTable(x, spark.createDataFrame([(i, p["n"], p["m"]) for i, (label, p) in nodes.items() if label == x], "id string, n int, m array<int>")) for x in "AB"]
    rels = [
        RelTable(r, a, b, spark.createDataFrame([(s, t) for q, s, t in edges if q == r and nodes[s][0] == a and nodes[t][0] == b], "src string, dst string"))
        for r in ("KNOWS", "LIKES") for a in "AB" for b in "AB"
    ]
    graph, naive = PropertyGraph(tables, rels), Naive(nodes, edges)
    shapes = [random_shape(rng) for _ in range(7)]
    text = "".join(f"ex:S{k} sh:targetClass ex:A ; {turtle_body(s)} .\n" if s[0] is None else f"ex:S{k} sh:targetClass ex:A ; sh:property [ {turtle_body(s)} ] .\n" for k, s in enumerate(shapes))
    report = validate(graph, compile_shapes([Document("s.ttl", HEAD + text)], graph.snapshot(), Options(max_path_depth=4)), limit=None)
    assert not [r.status_reason for r in report.rules if r.status == "error"], text
    got = {k: set() for k in range(len(shapes))}
    for r in report.rules:
        if r.status == "schema-mismatch":
            got.pop(int(r.shape[4:]), None)
            continue
        got.get(int(r.shape[4:]), set()).update(v["focus"]["keyValue"] for v in r.violations)
    for k, bad in got.items():
        assert bad == {i for i in ids if i[0] == "a" and not naive.conforms(i, shapes[k])}, turtle_body(shapes[k])
