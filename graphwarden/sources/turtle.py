"""Parser for Turtle, N-Triples and TriG with the line on which each triple ends."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

from ..errors import CompileError

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True, order=True)
class Iri:
    value: str


@dataclass(frozen=True, order=True)
class Blank:
    value: str


@dataclass(frozen=True, order=True)
class Literal:
    value: str
    datatype: str = XSD + "string"
    language: str = ""


Term = Iri | Blank | Literal


@dataclass(frozen=True)
class Triple:
    s: Iri | Blank
    p: Iri
    o: Term
    file: str
    line: int


_PN = r"[A-Za-z0-9_·À-˿Ͱ-ͽͿ-῿‌‍‿⁀⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff]"
_LOCAL = rf"(?:(?:{_PN}|[:%]|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:{_PN}|[:%.\-]|\\[_~.\-!$&'()*+,;=/?#@%])*(?:{_PN}|[:%\-]|\\[_~.\-!$&'()*+,;=/?#@%]))?)?"
_TOKEN = re.compile(
    rf"""(?P<space>(?:\s|\#[^\n]*)+)
    |(?P<iri><[^\x00-\x20<>"{{}}|^`\\]*(?:\\[uU][0-9A-Fa-f]+[^\x00-\x20<>"{{}}|^`\\]*)*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+(?![\w:]))
    |(?P<blank>_:{_PN}(?:(?:{_PN}|[.\-])*(?:{_PN}|-))?)
    |(?P<name>(?:{_PN}(?:(?:{_PN}|[.\-])*(?:{_PN}|-))?)?:{_LOCAL})
    |(?P<type>\^\^)
    |(?P<word>[A-Za-z]+)
    |(?P<punct>[\[\](){{}}.;,])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise ValueError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class Parser:
    """One document. ``blank``: what sets this document's blank nodes apart from others'."""

    def __init__(self, text: str, file: str, base: str = "", blank: str = "b", trig: bool = False):
        self.text, self.file, self.base, self.scope, self.trig = text, file, base, blank, trig
        self.prefixes: dict[str, str] = {}
        self.triples: list[Triple] = []
        self.fresh = 0
        self.line = 1
        self.tokens = self._scan()
        self.kind, self.value = "", ""
        self._next()

    def _fail(self, what: str) -> CompileError:
        return CompileError(f"{self.file}:{self.line}: {what}")

    def _scan(self):
        at, line = 0, 1
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                self.line = line
                raise self._fail(f"unexpected character {self.text[at]!r}")
            if m.lastgroup != "space":
                self.line = line + m[0].count("\n")
                yield m.lastgroup, m[0]
            line += m[0].count("\n")
            at = m.end()
        yield "end", ""

    def _next(self) -> None:
        self.kind, self.value = next(self.tokens)

    def _take(self, value: str) -> bool:
        if self.kind in ("punct", "word", "type") and self.value == value:
            self._next()
            return True
        return False

    def _need(self, value: str) -> None:
        if self.kind not in ("punct", "type") or self.value != value:
            raise self._fail(f"expected `{value}`, found `{self.value or 'the end of the file'}`")
        self._next()

    def parse(self) -> list[Triple]:
        try:
            while self.kind != "end":
                self._statement()
        except (ValueError, StopIteration) as error:
            raise self._fail(str(error)) from error
        return self.triples

    def _statement(self) -> None:
        word = self.value.lower() if self.kind == "word" else self.value if self.kind == "directive" else ""
        if word in ("@prefix", "prefix"):
            self._next()
            if self.kind != "name" or not self.value.endswith(":"):
                raise self._fail("expected a prefix")
            name = self.value[:-1]
            self._next()
            self.prefixes[name] = self._iri_token()
        elif word in ("@base", "base"):
            self._next()
            self.base = self._iri_token()
        elif self.trig and (word == "graph" or self.value == "{"):
            if word == "graph":
                self._next()
                self._subject()
            self._graph()
            return
        else:
            self._triples(True)
            return
        if word[0] == "@":
            self._need(".")

    def _graph(self) -> None:
        self._need("{")
        while not self._take("}"):
            self._triples(False)

    def _iri_token(self) -> str:
        if self.kind != "iri":
            raise self._fail("expected an IRI")
        value = _unescape(self.value[1:-1])
        self._next()
        return urljoin(self.base, value) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", value) else value

    def _name(self) -> Iri:
        prefix, _, local = self.value.partition(":")
        if prefix not in self.prefixes:
            raise self._fail(f"undeclared prefix `{prefix}:`")
        self._next()
        return Iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def _blank(self) -> Blank:
        self.fresh += 1
        return Blank(f"{self.scope}.{self.fresh}@{self.line}")

    def _subject(self) -> Iri | Blank:
        if self.kind == "iri":
            return Iri(self._iri_token())
        if self.kind == "name":
            return self._name()
        if self.kind == "blank":
            node = Blank(f"{self.scope}:{self.value[2:]}")
            self._next()
            return node
        if self.value == "(" and self.kind == "punct":
            return self._collection()
        raise self._fail(f"expected a subject, found `{self.value or 'the end of the file'}`")

    def _triples(self, dot: bool) -> None:
        if self.kind == "punct" and self.value == "[":
            s = self._properties()
            if self.kind == "punct" and self.value not in (".", "}"):
                pass
            if not (self.kind == "punct" and self.value in (".", "}")):
                self._predicates(s)
        else:
            s = self._subject()
            if self.trig and self.kind == "punct" and self.value == "{":
                self._graph()
                return
            self._predicates(s)
        if dot or not (self.kind == "punct" and self.value == "}"):
            self._need(".")

    def _predicates(self, s: Iri | Blank) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                p = Iri(RDF + "type")
                self._next()
            elif self.kind == "iri":
                p = Iri(self._iri_token())
            elif self.kind == "name":
                p = self._name()
            else:
                raise self._fail(f"expected a predicate, found `{self.value or 'the end of the file'}`")
            while True:
                o, line = self._object(), self.line
                self.triples.append(Triple(s, p, o, self.file, line))
                if not self._take(","):
                    break
            if not self._take(";"):
                return
            while self._take(";"):
                pass
            if self.kind == "punct" and self.value in (".", "]", "}"):
                return

    def _properties(self) -> Blank:
        node = self._blank()
        self._need("[")
        if not self._take("]"):
            self._predicates(node)
            self._need("]")
        return node

    def _collection(self) -> Iri | Blank:
        self._need("(")
        items = []
        while not (self.kind == "punct" and self.value == ")"):
            items.append((self._object(), self.line))
        self._next()
        rest: Iri | Blank = Iri(RDF + "nil")
        for item, line in reversed(items):
            node = self._blank()
            self.triples.append(Triple(node, Iri(RDF + "first"), item, self.file, line))
            self.triples.append(Triple(node, Iri(RDF + "rest"), rest, self.file, line))
            rest = node
        return rest

    def _object(self) -> Term:
        kind, value = self.kind, self.value
        if kind == "punct" and value == "[":
            return self._properties()
        if kind == "string":
            n = 3 if value[:3] in ('"""', "'''") else 1
            text = _unescape(value[n:-n])
            self._next()
            if self.kind == "lang":
                language = self.value[1:].lower()
                self._next()
                return Literal(text, RDF + "langString", language)
            if self._take("^^"):
                return Literal(text, Iri(self._iri_token()).value if self.kind == "iri" else self._name().value)
            return Literal(text)
        if kind in ("integer", "decimal", "double"):
            self._next()
            return Literal(value, XSD + kind)
        if kind == "word" and value in ("true", "false"):
            self._next()
            return Literal(value, XSD + "boolean")
        return self._subject()


def parse(text: str, file: str, syntax: str = "ttl", base: str = "", blank: str = "b") -> Parser:
    """Parse a document; ``syntax`` is ttl, nt or trig."""
    parser = Parser(text, file, base, blank, trig=syntax == "trig")
    parser.parse()
    return parser
