"""Schema snapshots: node types, relationship types with endpoints, property types."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from ..errors import CompileError
from ..functions.datatypes import neutral_type
from ..functions.nested import Properties


@dataclass
class RelType:
    name: str
    endpoints: list[tuple[str, str]] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=Properties)


@dataclass
class Snapshot:
    nodes: dict[str, dict[str, str]] = field(default_factory=dict)
    rels: dict[str, RelType] = field(default_factory=dict)
    #: Whether the data can't deviate from it; DataFrame schemas are enforced.
    enforced: bool = True

    def to_json(self) -> str:
        return json.dumps(
            {
                "nodeTypes": [{"name": n, "properties": [{"name": k, "type": t} for k, t in sorted(p.items())]} for n, p in sorted(self.nodes.items())],
                "relTypes": [
                    {"name": r.name, "endpoints": [{"from": a, "to": b} for a, b in sorted(set(r.endpoints))], "properties": [{"name": k, "type": t} for k, t in sorted(r.properties.items())]}
                    for _, r in sorted(self.rels.items())
                ],
            },
            indent=2,
        )

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        try:
            data = json.loads(text)
        except ValueError as error:
            raise CompileError(f"schema snapshot: {error}") from error
        out, problems = cls(), []

        def fields(x: dict, known: set[str], where: str) -> None:
            problems.extend(f"schema snapshot: unknown field `{k}` in {where}" for k in sorted(set(x) - known))

        def properties(x: dict, where: str) -> dict[str, str]:
            found = Properties()
            for p in x.get("properties", []):
                fields(p, {"name", "type"}, where)
                if p["name"] in dict.keys(found):
                    problems.append(f"schema snapshot: duplicate property `{p['name']}` of {where}")
                try:
                    found[p["name"]] = neutral_type(p["type"])
                except CompileError as error:
                    problems.append(f"schema snapshot: {error} of {where}.{p['name']}")
            return found

        try:
            fields(data, {"nodeTypes", "relTypes"}, "the snapshot")
            for n in data.get("nodeTypes", []):
                fields(n, {"name", "properties"}, n["name"])
                if n["name"] in out.nodes:
                    problems.append(f"schema snapshot: duplicate node type `{n['name']}`")
                out.nodes[n["name"]] = properties(n, n["name"])
            for r in data.get("relTypes", []):
                fields(r, {"name", "properties", "endpoints"}, r["name"])
                if r["name"] in out.rels:
                    problems.append(f"schema snapshot: duplicate relationship type `{r['name']}`")
                ends = [(e["from"], e["to"]) for e in r.get("endpoints", [])]
                if not ends:
                    problems.append(f"schema snapshot: relationship type `{r['name']}` has no endpoints")
                problems.extend(f"schema snapshot: endpoint `{x}` of `{r['name']}` is not declared" for e in ends for x in e if x not in out.nodes)
                out.rels[r["name"]] = RelType(r["name"], ends, properties(r, r["name"]))
        except (KeyError, TypeError, AttributeError) as error:
            raise CompileError(f"schema snapshot: malformed: {error!r}") from error
        if problems:
            raise CompileError(problems)
        return out
