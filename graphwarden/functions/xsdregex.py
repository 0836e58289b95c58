"""XSD regular expressions with SHACL flags as Java patterns for substring search."""

from __future__ import annotations

import re

from pyspark import SparkContext

from ..errors import CompileError

#: XML name characters (fixed values, XML 1.0 productions NameStartChar and NameChar).
NAME_START = r":A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
NAME_CHAR = NAME_START + r"\-.0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
_NAMES = {"i": NAME_START, "c": NAME_CHAR, "I": f"^{NAME_START}", "C": f"^{NAME_CHAR}"}


def translate(pattern: str, flags: str = "") -> str:
    """The Java pattern, with inline flags, that a string must contain a match of."""
    for f in flags:
        if f not in "smixq":
            raise CompileError(f"unknown regular expression flag `{f}`")
    inline = "".join(sorted(set(flags) & set("smi")))
    head = f"(?{inline}u)" if "i" in inline else f"(?{inline})" if inline else ""
    if "q" in flags:
        return head + re.sub(r"([\\^$.|?*+()\[\]{}&~\-#])", r"\\\1", pattern)
    out, at = [], 0
    atom, opened, closed = False, [], set()  # whether a quantifier may follow; groups by number
    groups = 0
    while at < len(pattern):
        c = pattern[at]
        if "x" in flags and c in " \t\n\r":
            at += 1
            continue
        if c == "\\":
            if m := re.match(r"[1-9]\d*", pattern[at + 1 :]):
                if int(m[0]) not in closed:
                    raise CompileError(f"pattern {pattern!r} refers to group {m[0]}, which isn't closed before it")
                text, at = f"\\{m[0]}", at + 1 + m.end()
            else:
                text, at = _escape(pattern, at, False)
            out.append(text)
            atom = True
        elif c == "[":
            text, at = _class(pattern, at, "x" in flags)
            out.append(text)
            atom = True
        elif c == "(":
            plain = pattern[at + 1 : at + 2] != "?"
            if not plain and pattern[at + 2 : at + 3] != ":":
                raise CompileError(f"pattern {pattern!r} has a group that XSD doesn't know: {pattern[at : at + 3]!r}")
            groups += plain
            opened.append(groups if plain else 0)
            out.append("(" if plain else "(?:")
            at += 1 if plain else 3
            atom = False
        elif c == ")":
            if not opened:
                raise CompileError(f"pattern {pattern!r} closes a group that isn't open")
            closed.add(opened.pop())
            out.append(c)
            at, atom = at + 1, True
        elif c in "*+?{":
            m = re.match(r"[*+?]|\{(\d+)(?:,(\d*))?\}", pattern[at:])
            if not atom or not m or m[1] and m[2] and int(m[2]) < int(m[1]):
                raise CompileError(f"pattern {pattern!r} has a quantifier that is malformed or follows nothing")
            out.append(m[0])
            at += m.end()
            if pattern[at : at + 1] == "?":
                out.append("?")
                at += 1
            atom = False
        elif c in "]}":
            raise CompileError(f"pattern {pattern!r} has an unescaped {c!r}")
        else:
            out.append(c)
            at, atom = at + 1, c not in "|^$"
    if opened:
        raise CompileError(f"pattern {pattern!r} has an unterminated group")
    return head + "".join(out)


def compiled_pattern(pattern: str, flags: str = "") -> str:
    """``translate``, tried out in the JVM if there is one, so that no invalid pattern reaches a job."""
    java = translate(pattern, flags)
    if SparkContext._active_spark_context is not None:
        check(java, SparkContext._active_spark_context)
    return java


#: Escapes of one character (fixed values, XSD production SingleCharEsc and XPath's ``$``) and of many.
_SINGLE, _MULTI = set("nrt\\|.?*+(){}-[]^$"), set("sSdDwW")


def _escape(p: str, at: int, inside: bool) -> tuple[str, int]:
    if at + 1 >= len(p):
        raise CompileError(f"pattern {p!r} ends with a backslash")
    c = p[at + 1]
    if c in _NAMES:
        return _NAMES[c] if inside and c in "ic" else f"[{_NAMES[c]}]", at + 2
    if c in "pP":
        m = re.match(r"\{(\^?\w[\w\-]*)\}", p[at + 2 :])
        if not m:
            raise CompileError(f"pattern {p!r} has an incomplete category escape")
        if m[1].startswith("Is"):
            raise CompileError(f"pattern {p!r} uses a Unicode block, which is not supported")
        return f"\\{c}{m[0]}", at + 2 + m.end()
    if c not in _SINGLE and c not in _MULTI:
        raise CompileError(f"pattern {p!r} has an unknown escape {p[at : at + 2]!r}")
    return p[at : at + 2], at + 2


def _class(p: str, at: int, spaced: bool) -> tuple[str, int]:
    """A character class; subtraction becomes an intersection with the complement."""
    at += 1
    out = ["["]
    if p[at : at + 1] == "^":
        out.append("^")
        at += 1
    first = True
    while True:
        if at >= len(p):
            raise CompileError(f"pattern {p!r} has an unterminated character class")
        c = p[at]
        if c == "]" and not first:
            return "".join([*out, "]"]), at + 1
        if c == "-" and p[at + 1 : at + 2] == "[":
            inner, at = _class(p, at + 1, spaced)
            if p[at : at + 1] != "]":
                raise CompileError(f"pattern {p!r}: a subtraction must end its class")
            body = "".join(out)
            negated = "[" + inner[2:] if inner.startswith("[^") else "[^" + inner[1:]
            return f"[{body}]&&{negated}]", at + 1
        first = False
        if c == "\\":
            text, at = _escape(p, at, True)
            out.append(text)
        elif c in "[&~":
            out.append("\\" + c)
            at += 1
        else:
            out.append(c)
            at += 1


def check(java: str, context: SparkContext) -> None:
    """Compile a pattern with the JVM, so that an invalid one is a compile error and no run-time one."""
    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise CompileError(f"invalid pattern {java!r}: {str(error).splitlines()[-1]}") from error
