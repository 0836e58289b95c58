"""Value tests as columns. Every test is total: false for nulls and for values of another type."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.datatypes import INTEGER_TYPES, Constant, column_verdict, comparable, equatable, lit
from ..plans.ir import And, Bool, Expr, Not, Or, Test, Xone

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_VARIANT_INT = ("BIGINT", "INT", "SMALLINT", "TINYINT")
_VARIANT_OF = {
    **dict.fromkeys(INTEGER_TYPES, _VARIANT_INT), "STRING": ("STRING",), "BOOLEAN": ("BOOLEAN",), "DATE": ("DATE",), "LOCAL_DATETIME": ("TIMESTAMP_NTZ",), "ZONED_DATETIME": ("TIMESTAMP",),
    "DOUBLE": ("DOUBLE",), "FLOAT": ("FLOAT",), "DECIMAL": ("DECIMAL",), "BLOB": ("BINARY",),
}


def total(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def exactly_one(parts: list[Column]) -> Column:
    n = F.lit(0)
    for p in parts:
        n = n + p.cast("int")
    return n == 1


def value_condition(e: Expr, x: Column, kind: str, known: bool = False) -> Column:
    """A condition of one property value of the neutral type ``kind``. ``known``: the value can't be null;
    typed tests then need no guard, and simple ones can be pushed down to the scan."""
    if isinstance(e, Bool):
        return F.lit(e.value)
    if isinstance(e, Not):
        return ~value_condition(e.part, x, kind, known)
    if isinstance(e, And | Or | Xone):
        parts = [value_condition(p, x, kind, known) for p in e.parts]
        if isinstance(e, Xone):
            return exactly_one(parts)
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(e, And) else out | p
        return out
    if isinstance(e, Test):
        if kind == "ANY":
            return total(_variant(e, x))
        return _typed(e, x, kind) if known else total(_typed(e, x, kind))
    return F.lit(False)  # conditions of nodes


def _number(x: Column, kind: str, ok: Column) -> Column:
    return ok & ~F.isnan(x) if kind in ("DOUBLE", "FLOAT") else ok


def _equal(x: Column, kind: str, values: tuple[Constant, ...]) -> Column:
    same = [lit(c) for c in values if equatable(c, kind)]
    return _number(x, kind, x.isin(*same)) if same else F.lit(False)


def _typed(e: Test, x: Column, kind: str) -> Column:
    if e.kind == "datatype":
        verdict = column_verdict(e.check, kind)
        if verdict == "range":
            return _range(e, x)
        return F.lit(verdict == "guaranteed") & x.isNotNull()
    if e.kind == "compare":
        return _number(x, kind, OPS[e.op](x, lit(e.bound))) if comparable(e.bound, kind) else F.lit(False)
    if e.kind == "in":
        return _equal(x, kind, e.values)
    if e.kind in ("length", "matches"):
        if kind != "STRING" and kind not in INTEGER_TYPES:
            return F.lit(False)
        text = x if kind == "STRING" else x.cast("string")
        return OPS[e.op](F.char_length(text), F.lit(e.n)) if e.kind == "length" else text.rlike(e.regex)
    return F.lit(False)


def _range(e: Test, x: Column) -> Column:
    out = x.isNotNull()
    if e.check.low is not None and e.check.low > -(1 << 63):
        out = out & (x >= F.lit(e.check.low))
    if e.check.high is not None and e.check.high < (1 << 63) - 1:
        out = out & (x <= F.lit(e.check.high))
    return out


def _variant(e: Test, x: Column) -> Column:
    """Tests of untyped values: the value's own type decides first, so that nothing is coerced."""
    t = F.schema_of_variant(x)

    def typed(kinds: tuple[str, ...], cast: str, kind: str) -> Column:
        is_one = t.startswith("DECIMAL(") if kinds == ("DECIMAL",) else t.isin(*kinds)
        return F.when(is_one, total(_typed(e, F.variant_get(x, "$", cast), kind))).otherwise(False)

    if e.kind == "datatype":
        names = [k for a in e.check.allowed for k in _VARIANT_OF.get(a, ())]
        plain = F.lit(False)
        if any(n in _VARIANT_INT for n in names):
            plain = F.when(t.isin(*_VARIANT_INT), _range(e, F.variant_get(x, "$", "bigint"))).otherwise(False)
        others = [n for n in names if n not in _VARIANT_INT and n != "DECIMAL"]
        if others:
            plain = plain | t.isin(*others)
        return plain | t.startswith("DECIMAL(") if "DECIMAL" in names else plain
    out = typed(("STRING",), "string", "STRING") | typed(_VARIANT_INT, "bigint", "INT64")
    if e.kind in ("compare", "in"):
        for kinds, cast, kind in (
            (("DOUBLE", "FLOAT"), "double", "DOUBLE"), (("DECIMAL",), "decimal(38,18)", "DECIMAL"), (("BOOLEAN",), "boolean", "BOOLEAN"), (("DATE",), "date", "DATE"),
            (("TIMESTAMP_NTZ",), "timestamp_ntz", "LOCAL_DATETIME"), (("TIMESTAMP",), "timestamp", "ZONED_DATETIME"),
        ):
            out = out | typed(kinds, cast, kind)
    return out


def shown(x: Column, kind: str) -> Column:
    """A value as text."""
    if kind == "ANY":
        return F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")).otherwise(F.to_json(x))
    return F.to_json(F.struct(x)) if kind.startswith("LIST<") else x.cast("string")


def family(kind: str) -> str:
    """Types whose values are compared with each other."""
    return "INT" if kind in INTEGER_TYPES else "FLOAT" if kind in ("DOUBLE", "FLOAT", "DECIMAL") else "MAP" if kind.startswith("MAP") else kind


def distinct_key(x: Column, kind: str) -> Column:
    """What makes two values of one type the same value."""
    if kind == "ANY":
        return F.concat(F.schema_of_variant(x), F.lit("|"), F.to_json(x))
    return x
