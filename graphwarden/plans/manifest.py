"""Compilation: from shape files to named rules and their manifest."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import CompileError, ManifestError
from ..sources.schema import Snapshot
from ..sources.shapes import Document, ShapesGraph, load
from .ast import ANNOTATIONS, Shapes
from .ir import Repeat, Rule, Step, check_scope, pairs_of, sources_of
from .lower import Lowering, Options

VERSION = "0.1.0"
_MARKS = {"/": ".", "|": "_or_", "^": "inv_", "*": "_star", "+": "_plus", "?": "_opt", "(": "", ")": ""}


# -- names
def _sanitize(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_\-]", "_", text)


def _local(token: str) -> str:
    return _sanitize(re.split(r"[/#]", token[1:-1])[-1] if token.startswith("<") else token.split(":")[-1])


def _flat(path: str) -> str:
    """A path as identifier characters."""
    return "".join(_MARKS[t] if t in _MARKS else _local(t) for t in re.findall(r"<[^>]*>|[/|^*+?()]|[^/|^*+?()<]+", path))


def _name(rule: Rule) -> str:
    component = _local(rule.segments[-1])
    own, shape = rule.names
    if own:
        return f"{own}.{component}"
    first = rule.segments[0]
    shape = shape or (_sanitize(first[3:]) if first.startswith("[]@") else _local(first))
    middle = "/".join(rule.segments[1:-1])
    return ".".join(x for x in (shape, _flat(middle) if middle else "", component) if x)


def _canonical(rule: Rule) -> str:
    """The content of a rule without its place in the files."""
    text = repr((rule.focus, rule.source, rule.holds, [(d.rule_id, d.holds) for d in rule.details], rule.severity, rule.message))
    return re.sub(r"\[\]@[^\s'\"/]*:\d+", "[]", text)


def _assign_names(rules: list[Rule]) -> None:
    times = Counter("/".join(r.segments) for r in rules)
    for r in rules:
        base, canonical = "/".join(r.segments), _canonical(r)
        tail = "~" + hashlib.sha256(canonical.encode()).hexdigest()[:6] if times[base] > 1 else ""
        r.rule_id, r.name = base + tail, _name(r) + tail
        r.fingerprint = hashlib.sha256(f"spark\n{canonical}".encode()).hexdigest()[:16]
        r.cost = _cost(r)
    problems = []
    for what, get in (("rule id", lambda r: r.rule_id), ("rule name", lambda r: r.name)):
        for value, n in sorted(Counter(map(get, rules)).items()):
            if n > 1:
                places = ", ".join(f"{r.file}:{r.line}" for r in rules if get(r) == value)
                problems.append(f"duplicate {what} `{value}` (at {places})")
    if problems:
        raise CompileError(problems)


def _repeats(step: Step | None) -> bool:
    if step is None:
        return False
    return step.most > 1 if isinstance(step, Repeat) else any(map(_repeats, getattr(step, "parts", ())))


def _cost(r: Rule) -> str:
    exprs = [r.holds, *(d.holds for d in r.details)]
    sources = [s for e in exprs for s in sources_of(e)] + ([r.source] if r.source else [])
    if any(_repeats(s.hops) for s in sources):
        return "unbounded-path"
    if any(p.left.hops is not None and p.right.hops is not None for e in exprs for p in pairs_of(e)):
        return "quadratic"
    return "scan+expand" if any(s.hops is not None for s in sources) else "scan"


@dataclass
class Compilation:
    """Rules, ready to run on a graph, and the manifest that describes them."""

    rules: list[Rule]
    diagnostics: list[dict]
    inputs: list[dict]
    options: Options
    snapshot_digest: str | None = None
    sources: dict = field(default_factory=dict)

    def rule(self, name: str) -> Rule:
        for r in self.rules:
            if name in (r.rule_id, r.name):
                return r
        raise KeyError(name)

    @property
    def recommended_keys(self) -> list[dict]:
        """(label, key) pairs by which node tables are best bucketed."""
        found = {
            (x, r.key or self.options.node_key)
            for r in self.rules for f in r.focus for x in f.labels if r.status == "compiled" and (r.key or self.options.node_key)
        }
        return [{"label": a, "property": b} for a, b in sorted(found)]

    def manifest(self) -> dict:
        o = self.options
        return {
            "schemaVersion": 1, "compilerVersion": VERSION, "dialect": "spark", "inputs": self.inputs, "schemaSnapshotHash": self.snapshot_digest,
            "options": {"nodeKey": o.node_key, "labels": "inherited" if o.inherited_labels else "explicit", "strict": o.strict, "lenient": o.lenient, "verbose": o.verbose, "maxPathDepth": o.max_path_depth},
            "rules": [
                {
                    "name": r.name, "ruleId": r.rule_id, "fingerprint": r.fingerprint, "shape": r.shape, "path": r.path, "constraint": r.constraint, "severity": r.severity, "status": r.status,
                    "statusReason": r.reason, "costClass": r.cost, "pathDepthCap": r.depth_cap, "source": {"file": r.file, "line": r.line}, "message": r.message,
                }
                for r in self.rules
            ],
            "staticDiagnostics": self.diagnostics, "recommendedIndexes": self.recommended_keys,
            "shapes": self.sources,
        }

    def to_json(self) -> str:
        return json.dumps(self.manifest(), indent=2, ensure_ascii=False) + "\n"


def compile_shapes(
    sources: list[str | Document], schema: Snapshot | None = None, options: Options | None = None, ontology: list[str | Document] | None = None, remote=None
) -> Compilation:
    """Compile shape files (paths or documents). With a schema, names are resolved against it, and an
    enforced one decides what it can."""
    options = options or Options()
    if not 1 <= options.max_path_depth:
        raise ValueError("max_path_depth must be at least 1")
    graph = load(sources, options.base_dir, remote if options.allow_remote_imports else None)
    extra: ShapesGraph | None = None
    inputs = list(graph.inputs)
    if ontology:
        extra = load(ontology, options.base_dir, remote if options.allow_remote_imports else None, role="ontology")
        inputs += extra.inputs
    shapes = Shapes(graph, options.annotations or ANNOTATIONS, extra)
    lowered = Lowering(shapes, schema, options).run()
    _assign_names(lowered.rules)
    for r in lowered.rules:
        if r.status == "compiled":
            check_scope(r)
    rules = sorted(lowered.rules, key=lambda r: r.rule_id)
    kept = {"documents": [{"name": s.name, "text": s.text, "syntax": s.syntax} if isinstance(s, Document) else {"path": str(s)} for s in sources], "ontology": [{"name": s.name, "text": s.text, "syntax": s.syntax} if isinstance(s, Document) else {"path": str(s)} for s in ontology or []]}
    return Compilation(rules, lowered.diagnostics, inputs, options, schema.digest() if schema else None, kept)


def load_manifest(text: str, schema: Snapshot | None = None) -> Compilation:
    """Rules of a manifest, from the shapes that it names; they must still be what was compiled."""
    try:
        data = json.loads(text)
    except ValueError as error:
        raise ManifestError(f"malformed manifest: {error}") from error
    if data.get("schemaVersion") != 1:
        raise ManifestError(f"unsupported manifest version {data.get('schemaVersion')!r}")
    if data.get("dialect") != "spark":
        raise ManifestError(f"a manifest of dialect {data.get('dialect')!r} can't run on Spark")
    o, shapes = data["options"], data.get("shapes") or {}
    options = Options(node_key=o["nodeKey"], inherited_labels=o["labels"] == "inherited", strict=o["strict"], lenient=o["lenient"], verbose=o["verbose"], max_path_depth=o["maxPathDepth"])
    back = lambda items: [Document(**x) if "text" in x else x["path"] for x in items]
    out = compile_shapes(back(shapes.get("documents", [])), schema, options, back(shapes.get("ontology", [])) or None)
    was = {r["ruleId"]: r["fingerprint"] for r in data["rules"]}
    if was != {r.rule_id: r.fingerprint for r in out.rules}:
        raise ManifestError("the shapes or the schema have changed since the manifest was written")
    return out


def read_snapshot(path: str) -> Snapshot:
    return Snapshot.from_json(Path(path).read_text(encoding="utf-8"))
