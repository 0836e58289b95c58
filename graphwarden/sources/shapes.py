"""The union of shape files: triples with locations, prefixes, imports and input digests."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

from ..errors import CompileError
from .turtle import RDF, Blank, Iri, Literal, Term, Triple, parse

OWL_IMPORTS = Iri("http://www.w3.org/2002/07/owl#imports")
SYNTAXES = {".ttl": "ttl", ".nt": "nt", ".trig": "trig"}
MAX_REMOTE_BYTES = 16 << 20


@dataclass(frozen=True)
class Document:
    """A document in memory, treated like the file base_dir/name."""

    name: str
    text: str
    syntax: str = "ttl"


@dataclass
class ShapesGraph:
    triples: list[Triple] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)
    inputs: list[dict[str, str]] = field(default_factory=list)
    by_subject: dict[Term, dict[Iri, list[Triple]]] = field(default_factory=dict)

    def add(self, t: Triple) -> None:
        of = self.by_subject.setdefault(t.s, {}).setdefault(t.p, [])
        if all(x.o != t.o for x in of):
            of.append(t)
            self.triples.append(t)

    def get(self, s: Term, p: Iri) -> list[Triple]:
        return self.by_subject.get(s, {}).get(p, [])

    def one(self, s: Term, p: Iri, what: str) -> Triple | None:
        found = self.get(s, p)
        if len(found) > 1:
            raise CompileError(f"{self.place(found[1])}: several values of {what}")
        return found[0] if found else None

    @staticmethod
    def place(t: Triple) -> str:
        return f"{t.file}:{t.line}"

    def members(self, head: Term, t: Triple) -> list[Term]:
        """The items of an RDF list."""
        out, seen = [], set()
        nil, first, rest = Iri(RDF + "nil"), Iri(RDF + "first"), Iri(RDF + "rest")
        while head != nil:
            a, b = self.get(head, first), self.get(head, rest)
            if head in seen:
                raise CompileError(f"{self.place(t)}: cyclic list")
            if len(a) != 1 or len(b) != 1:
                raise CompileError(f"{self.place(t)}: malformed list")
            seen.add(head)
            out.append(a[0].o)
            head = b[0].o
        return out

    def compact(self, iri: str) -> str:
        """``ex:name`` by the longest declared namespace, else ``<iri>``."""
        best = ""
        name = ""
        for prefix, namespace in sorted(self.prefixes.items()):
            if namespace and iri.startswith(namespace) and len(namespace) > len(best) and re.fullmatch(r"[\w\-.]*", iri[len(namespace) :]):
                best, name = namespace, f"{prefix}:{iri[len(namespace):]}"
        return name or f"<{iri}>"


def load(
    sources: list[str | Document], base_dir: str | None = None, remote: Callable[[str], str] | None = None, role: str = "shapes", into: ShapesGraph | None = None
) -> ShapesGraph:
    """Read files and documents with what they import. Files are ordered by path, each is read once, and
    the first file that declares a prefix decides it. Remote imports need a fetcher."""
    graph = into or ShapesGraph()
    base = os.path.realpath(base_dir or os.getcwd())
    todo: list[tuple[str, Document | None, str]] = []
    for s in sources:
        if isinstance(s, Document):
            todo.append((os.path.join(base, s.name), s, role))
        else:
            todo.append((os.path.realpath(os.path.join(base, s)), None, role))
    todo.sort(key=lambda x: x[0])
    seen: set[str] = set()
    while todo:
        place, document, role = todo.pop(0)
        if place in seen:
            continue
        seen.add(place)
        name = place if "://" in place else os.path.relpath(place, base)
        if document is not None:
            text, syntax = document.text, document.syntax
        elif "://" in place:
            if remote is None:
                raise CompileError(f"remote import {place} is not allowed")
            text, syntax = remote(place), SYNTAXES.get(Path(urlparse(place).path).suffix, "ttl")
            if len(text.encode()) > MAX_REMOTE_BYTES:
                raise CompileError(f"remote import {place} is larger than {MAX_REMOTE_BYTES} bytes")
        else:
            syntax = SYNTAXES.get(Path(place).suffix.lower(), "")
            if not syntax:
                raise CompileError(f"{name}: unknown kind of file; known: {', '.join(SYNTAXES)}")
            try:
                text = Path(place).read_text(encoding="utf-8")
            except (OSError, UnicodeDecodeError) as error:
                raise CompileError(f"{name}: {error}") from error
        base_iri = place if "://" in place else Path(place).as_uri()
        parser = parse(text, name, syntax, base_iri, f"d{len(seen)}")
        for prefix, namespace in parser.prefixes.items():
            graph.prefixes.setdefault(prefix, namespace)
        graph.inputs.append({"path": name, "role": role, "sha256": hashlib.sha256(text.encode()).hexdigest()})
        more = []
        for t in parser.triples:
            graph.add(t)
            if t.p == OWL_IMPORTS:
                if isinstance(t.o, Literal | Blank):
                    raise CompileError(f"{graph.place(t)}: an import needs an IRI")
                url = urlparse(t.o.value)
                if url.scheme == "file":
                    more.append((os.path.realpath(unquote(url.path)), None, "import"))
                elif url.scheme in ("http", "https"):
                    more.append((t.o.value, None, "import"))
                else:
                    raise CompileError(f"{graph.place(t)}: unsupported import <{t.o.value}>")
        todo += sorted(more, key=lambda x: x[0])
    return graph
