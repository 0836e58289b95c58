"""XSD datatypes, the neutral value types that hold them, and typed constants."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..sources.turtle import RDF, XSD, Iri, Literal

INTEGER_TYPES = {"INT64": 64, "INT32": 32, "INT16": 16, "INT8": 8, "UINT64": -64, "UINT32": -32, "UINT16": -16, "UINT8": -8}
NEUTRAL = {*INTEGER_TYPES, "STRING", "DOUBLE", "FLOAT", "DECIMAL", "BOOLEAN", "DATE", "LOCAL_DATETIME", "ZONED_DATETIME", "LOCAL_TIME", "ZONED_TIME", "DURATION", "DURATION_DAY_TIME", "DURATION_YEAR_MONTH", "POINT", "BLOB", "ANY", "STRUCT", "OTHER"}


def _signed(bits: int) -> tuple[int, int]:
    return -(1 << (bits - 1)), (1 << (bits - 1)) - 1


#: XSD local name: what it is and its inclusive range (None: open).
_INTEGERS = {
    "integer": (None, None), "long": _signed(64), "int": _signed(32), "short": _signed(16), "byte": _signed(8),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, (1 << 64) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, (1 << 16) - 1), "unsignedByte": (0, 255),
}
_OTHERS = {
    **dict.fromkeys(("string", "normalizedString", "token", "anyURI"), ("STRING",)), "boolean": ("BOOLEAN",), "date": ("DATE",),
    "dateTime": ("ZONED_DATETIME", "LOCAL_DATETIME"), "dateTimeStamp": ("ZONED_DATETIME",), "time": ("LOCAL_TIME", "ZONED_TIME"),
    "duration": ("DURATION", "DURATION_DAY_TIME", "DURATION_YEAR_MONTH"), "dayTimeDuration": ("DURATION_DAY_TIME",), "yearMonthDuration": ("DURATION_YEAR_MONTH",),
    "decimal": ("DECIMAL", "DOUBLE", "FLOAT"), "double": ("DOUBLE", "FLOAT"), "float": ("DOUBLE", "FLOAT"),
}


@dataclass(frozen=True)
class DatatypeCheck:
    """Neutral types allowed, and for integers the inclusive range."""

    allowed: tuple[str, ...]
    low: int | None = None
    high: int | None = None


def datatype_check(iri: str) -> DatatypeCheck:
    if iri == RDF + "langString":
        raise CompileError("rdf:langString is not supported: property graphs have no language tags")
    name = iri.removeprefix(XSD)
    if iri.startswith(XSD) and name in _INTEGERS:
        return DatatypeCheck(tuple(INTEGER_TYPES), *_INTEGERS[name])
    if iri.startswith(XSD) and name in _OTHERS:
        return DatatypeCheck(_OTHERS[name])
    raise CompileError(f"unsupported datatype <{iri}>")


def neutral_type(text: str) -> str:
    """A type name as annotations and snapshots write it: any case, blanks for underscores, LIST<...>, MAP<...> (of
    the values)."""
    name = re.sub(r"\s+", "_", text.strip().upper())
    m = re.fullmatch(r"LIST<_?(.*)_?>", name)
    if m:
        return f"LIST<{neutral_type(m[1].strip('_'))}>"
    m = re.fullmatch(r"MAP<_?(.*)_?>", name)
    if m or name == "MAP":
        return f"MAP<{neutral_type(m[1].strip('_'))}>" if m else name
    if name not in NEUTRAL:
        raise CompileError(f"unknown type `{text}`")
    return name


def type_of(dt: T.DataType, metadata: dict | None = None) -> str:
    """The neutral type of a column."""
    if metadata and "neutral" in metadata:
        return neutral_type(metadata["neutral"])
    if isinstance(dt, T.ArrayType):
        return f"LIST<{type_of(dt.elementType)}>"
    for kind, name in (
        (T.StringType, "STRING"), (T.LongType, "INT64"), (T.IntegerType, "INT32"), (T.ShortType, "INT16"), (T.ByteType, "INT8"), (T.DoubleType, "DOUBLE"), (T.FloatType, "FLOAT"),
        (T.DecimalType, "DECIMAL"), (T.BooleanType, "BOOLEAN"), (T.DateType, "DATE"), (T.TimestampNTZType, "LOCAL_DATETIME"), (T.TimestampType, "ZONED_DATETIME"),
        (T.DayTimeIntervalType, "DURATION_DAY_TIME"), (T.YearMonthIntervalType, "DURATION_YEAR_MONTH"), (T.BinaryType, "BLOB"),
    ):
        if isinstance(dt, kind):
            return name
    if type(dt).__name__ == "TimeType":
        return "LOCAL_TIME"
    if isinstance(dt, T.StructType):
        return "STRUCT"
    if isinstance(dt, T.MapType):
        return f"MAP<{type_of(dt.valueType)}>" if isinstance(dt.keyType, T.StringType) else "MAP"
    if isinstance(dt, T.NullType):
        return "STRING"
    return "ANY" if isinstance(dt, T.VariantType) else "OTHER"


def column_verdict(check: DatatypeCheck, neutral: str) -> str:
    """What a column's type says about a datatype: guaranteed, contradicted, range or value (per row)."""
    if neutral.startswith("LIST<") and not any(a.startswith("LIST<") for a in check.allowed):
        neutral = neutral[5:-1]
    if neutral == "ANY":
        return "value"
    if neutral not in check.allowed:
        return "contradicted"
    if neutral in INTEGER_TYPES and (check.low is not None or check.high is not None):
        bits = INTEGER_TYPES[neutral]
        low, high = _signed(bits) if bits > 0 else (0, (1 << -bits) - 1)
        if (check.low is not None and low < check.low) or (check.high is not None and high > check.high):
            return "range"
    return "guaranteed"


# -- constants --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Constant:
    """A literal or IRI constant: kind (String, Integer, Decimal, Double, Boolean, Date, LocalDateTime,
    ZonedDateTime, Time, DayTime, YearMonth, Iri) and value."""

    kind: str
    value: object

    def text(self) -> str:
        return str(self.value)


def constant(term: Literal | Iri) -> Constant:
    if isinstance(term, Iri):
        return Constant("Iri", term.value)
    name, v = term.datatype.removeprefix(XSD), term.value
    if term.language:
        raise CompileError(f"language-tagged constant {v!r}")
    try:
        if name in ("string", "normalizedString", "token", "anyURI"):
            return Constant("String", v)
        if name in _INTEGERS:
            n = int(v)
            if not -(1 << 63) <= n < 1 << 63:
                raise CompileError(f"integer constant {v} is out of range")
            return Constant("Integer", n)
        if name == "decimal":
            return Constant("Decimal", Decimal(v))
        if name in ("double", "float"):
            x = float(v)
            if x != x or x in (float("inf"), float("-inf")):
                raise CompileError(f"constant {v} is not finite")
            return Constant("Double", x)
        if name == "boolean":
            return Constant("Boolean", {"true": True, "1": True, "false": False, "0": False}[v])
        if name == "date":
            return Constant("Date", date.fromisoformat(v))
        if name in ("dateTime", "dateTimeStamp"):
            x = datetime.fromisoformat(v)
            return Constant("LocalDateTime" if x.tzinfo is None else "ZonedDateTime", x)
        if name == "time":
            x = time.fromisoformat(v)
            if x.tzinfo is not None:
                raise CompileError(f"times with a zone are not supported: {v}")
            return Constant("Time", x)
        if name in ("duration", "dayTimeDuration", "yearMonthDuration"):
            return _duration(v)
    except (ValueError, KeyError, InvalidOperation) as error:
        raise CompileError(f"ill-formed constant {v!r} of type {name}") from error
    raise CompileError(f"constant of unsupported datatype <{term.datatype}>")


def _duration(v: str) -> Constant:
    m = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", v)
    if not m or not any(m.groups()[1:]):
        raise ValueError(v)
    sign = -1 if m[1] else 1
    months = int(m[2] or 0) * 12 + int(m[3] or 0)
    seconds = int(m[4] or 0) * 86400 + int(m[5] or 0) * 3600 + int(m[6] or 0) * 60 + Decimal(m[7] or 0)
    if months and seconds:
        raise CompileError(f"durations with both months and seconds are not supported: {v}")
    return Constant("YearMonth", sign * months) if months else Constant("DayTime", sign * seconds)


def lit(c: Constant) -> Column:
    """The constant as a typed literal."""
    if c.kind == "Integer":
        return F.lit(c.value).cast("bigint")
    if c.kind == "LocalDateTime":
        return F.lit(c.value.isoformat()).cast("timestamp_ntz")
    if c.kind == "ZonedDateTime":
        return F.lit(c.value.isoformat()).cast("timestamp")
    if c.kind == "Time":
        return F.expr(f"time'{c.value.isoformat()}'")
    if c.kind == "YearMonth":
        return F.make_ym_interval(F.lit(0), F.lit(c.value))
    if c.kind == "DayTime":
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(c.value).cast("decimal(18,6)"))
    return F.lit(c.value)


_NUMBERS = {*INTEGER_TYPES, "DOUBLE", "FLOAT", "DECIMAL"}


def comparable(c: Constant, neutral: str) -> bool:
    """Whether values of the type have an order with the constant."""
    return {
        "String": neutral == "STRING", "Integer": neutral in _NUMBERS, "Decimal": neutral in _NUMBERS, "Double": neutral in _NUMBERS, "Boolean": neutral == "BOOLEAN", "Date": neutral == "DATE",
        "LocalDateTime": neutral == "LOCAL_DATETIME", "ZonedDateTime": neutral == "ZONED_DATETIME", "Time": neutral == "LOCAL_TIME", "DayTime": neutral == "DURATION_DAY_TIME", "YearMonth": neutral == "DURATION_YEAR_MONTH",
    }.get(c.kind, False)


def equatable(c: Constant, neutral: str) -> bool:
    """Whether a value of the type can equal the constant: numbers keep their kind."""
    if c.kind == "Integer":
        return neutral in INTEGER_TYPES
    if c.kind in ("Decimal", "Double"):
        return neutral in _NUMBERS - set(INTEGER_TYPES)
    return comparable(c, neutral)
