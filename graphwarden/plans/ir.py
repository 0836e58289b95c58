"""The intermediate representation: value sources, quantified conditions, rules."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import CompileError
from ..functions.datatypes import Constant, DatatypeCheck


# -- paths over the graph
@dataclass(frozen=True)
class Rel:
    """One hop over any of the relationship types; out of the node or into it."""

    types: tuple[str, ...]
    out: bool = True


@dataclass(frozen=True)
class Seq:
    parts: tuple[Step, ...]


@dataclass(frozen=True)
class Alt:
    parts: tuple[Step, ...]


@dataclass(frozen=True)
class Repeat:
    part: Rel
    least: int
    most: int


Step = Rel | Seq | Alt | Repeat


@dataclass(frozen=True)
class Source:
    """Values of a variable: over hops (none: the variable's own node), then of any of the properties
    (none: the nodes themselves). ``whole``: list properties are single values."""

    hops: Step | None = None
    properties: tuple[str, ...] = ()
    whole: bool = False

    @property
    def is_self(self) -> bool:
        return self.hops is None and not self.properties

    @property
    def nodes(self) -> bool:
        return not self.properties


# -- conditions: total, two-valued
@dataclass(frozen=True)
class Bool:
    value: bool


@dataclass(frozen=True)
class Not:
    part: Expr


@dataclass(frozen=True)
class And:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Xone:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class All:
    source: Source
    test: Expr


@dataclass(frozen=True)
class Count:
    """Number of distinct values that satisfy a filter, at least or at most n."""

    source: Source
    filter: Expr
    least: bool
    n: int


@dataclass(frozen=True)
class Test:
    """kind: datatype, label, compare, length, matches, in, key."""

    kind: str
    check: DatatypeCheck | None = None
    labels: tuple[str, ...] = ()
    op: str = ""
    bound: Constant | None = None
    n: int = 0
    regex: str = ""
    values: tuple[Constant, ...] = ()
    full_iri: bool = False


@dataclass(frozen=True)
class Pair:
    """op: equals, disjoint, lessThan, lessThanOrEquals."""

    left: Source
    right: Source
    op: str


@dataclass(frozen=True)
class Closed:
    properties: tuple[str, ...]
    rels: tuple[str, ...]


Expr = Bool | Not | And | Or | Xone | All | Count | Test | Pair | Closed


def not_(e: Expr) -> Expr:
    if isinstance(e, Bool):
        return Bool(not e.value)
    return e.part if isinstance(e, Not) else Not(e)


def and_(parts) -> Expr:
    flat: list[Expr] = []
    for p in parts:
        if isinstance(p, Bool):
            if not p.value:
                return p
        else:
            flat += p.parts if isinstance(p, And) else [p]
    flat = list(dict.fromkeys(flat))
    return Bool(True) if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def or_(parts) -> Expr:
    flat: list[Expr] = []
    for p in parts:
        if isinstance(p, Bool):
            if p.value:
                return p
        else:
            flat += p.parts if isinstance(p, Or) else [p]
    flat = list(dict.fromkeys(flat))
    return Bool(False) if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def xone(parts) -> Expr:
    true = sum(p == Bool(True) for p in parts)
    rest = tuple(p for p in parts if not isinstance(p, Bool))
    if true > 1:
        return Bool(False)
    if true == 1:
        return and_(not_(p) for p in rest)
    return Bool(False) if not rest else rest[0] if len(rest) == 1 else Xone(rest)


def all_(source: Source, test: Expr) -> Expr:
    if test == Bool(True):
        return test
    return test if source.is_self else All(source, test)


def count(source: Source, test: Expr, least: bool, n: int) -> Expr:
    if least and n == 0:
        return Bool(True)
    if test == Bool(False):
        return Bool(not least)
    if source.is_self:
        return (test if n == 1 else Bool(False)) if least else (Bool(True) if n >= 1 else not_(test))
    return Count(source, test, least, n)


# -- rules
@dataclass(frozen=True)
class Focus:
    """kind: labels, subjects, objects, relationships."""

    kind: str
    labels: tuple[str, ...] = ()
    source: Source | None = None
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Detail:
    rule_id: str
    holds: Expr


@dataclass
class Rule:
    segments: tuple[str, ...]
    shape: str
    path: str | None
    constraint: str
    severity: str
    message: str
    focus: tuple[Focus, ...]
    #: Per value: values of the source that fail the condition; per focus (no source): failing nodes.
    source: Source | None
    holds: Expr
    details: tuple[Detail, ...] = ()
    key: str | None = None
    status: str = "compiled"
    reason: str | None = None
    depth_cap: int | None = None
    file: str = ""
    line: int = 0
    names: tuple[str | None, str | None] = (None, None)
    rule_id: str = ""
    name: str = ""
    fingerprint: str = ""
    cost: str = "scan"

    @property
    def per_value(self) -> bool:
        return self.source is not None


def sources_of(e: Expr) -> list[Source]:
    """All value sources within a condition."""
    if isinstance(e, Not):
        return sources_of(e.part)
    if isinstance(e, And | Or | Xone):
        return [s for p in e.parts for s in sources_of(p)]
    if isinstance(e, All):
        return [e.source, *sources_of(e.test)]
    if isinstance(e, Count):
        return [e.source, *sources_of(e.filter)]
    if isinstance(e, Pair):
        return [e.left, e.right]
    return []


def scope_faults(e: Expr, nodes: bool) -> list[str]:
    """What a condition asks of its variable that the variable can't have: properties, hops and labels belong
    to nodes only. ``nodes``: whether the variable stands for a node."""
    if isinstance(e, Bool):
        return []
    if isinstance(e, Not):
        return scope_faults(e.part, nodes)
    if isinstance(e, And | Or | Xone):
        return [x for p in e.parts for x in scope_faults(p, nodes)]
    if isinstance(e, Test):
        wrong = e.kind in ("label", "key") and not nodes
        return [f"a {e.kind} test of a literal"] if wrong else []
    if isinstance(e, Closed):
        return [] if nodes else ["a closed test of a literal"]
    sources = [e.left, e.right] if isinstance(e, Pair) else [e.source]
    out = [f"values of a literal ({s.hops or s.properties})" for s in sources if not s.is_self and not nodes]
    if isinstance(e, Pair):
        return out
    inner = e.test if isinstance(e, All) else e.filter
    return out + scope_faults(inner, nodes if e.source.is_self else e.source.nodes)


def check_scope(rule: Rule) -> None:
    """Every variable of a rule must be bound to something that can answer its tests."""
    start = rule.source is None or rule.source.is_self or rule.source.nodes
    for e in (rule.holds, *(d.holds for d in rule.details)):
        if faults := scope_faults(e, start):
            raise CompileError(f"{rule.file}:{rule.line}: {rule.rule_id or rule.constraint}: {faults[0]}")


def pairs_of(e: Expr) -> list[Pair]:
    if isinstance(e, Pair):
        return [e]
    if isinstance(e, Not):
        return pairs_of(e.part)
    if isinstance(e, And | Or | Xone):
        return [x for p in e.parts for x in pairs_of(p)]
    if isinstance(e, All):
        return pairs_of(e.test)
    return pairs_of(e.filter) if isinstance(e, Count) else []


def closed_in(e: Expr) -> bool:
    if isinstance(e, Closed):
        return True
    parts = [e.part] if isinstance(e, Not) else e.parts if isinstance(e, And | Or | Xone) else [e.test] if isinstance(e, All) else [e.filter] if isinstance(e, Count) else []
    return any(closed_in(p) for p in parts)


