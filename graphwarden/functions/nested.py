"""Columns of any Spark type as properties: scalars, lists, structs and maps.

A walk over the column types gives each property its neutral type. Fields of a struct are properties of their
own, named by their way (``address.city``); fields of the structs in a list are lists. A key of a map with text
keys is a property too (``tags.colour``), whether it occurs or not: absent keys have no value. A column whose own
name has a dot comes first. Whole structs and maps can be counted and compared as one value each, shown as JSON
with a map's entries sorted by key; they have no datatype, order, length or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .datatypes import type_of
from .names import column


class Properties(dict):
    """Names and neutral types; keys of maps are found when asked for."""

    def _of_map(self, name: str) -> str | None:
        at = name.find(".")
        while at > 0:
            kind = dict.get(self, name[:at])
            if kind and kind.startswith("MAP<"):
                return kind[4:-1]
            at = name.find(".", at + 1)
        return None

    def get(self, name: str, default: str | None = None) -> str | None:
        return dict.get(self, name) or self._of_map(name) or default

    def __contains__(self, name: object) -> bool:
        return dict.__contains__(self, name) or self._of_map(str(name)) is not None

    def __missing__(self, name: str) -> str:
        found = self._of_map(name)
        if found is None:
            raise KeyError(name)
        return found


def properties(schema: T.StructType, leave: tuple[str | None, ...] = ()) -> Properties:
    """All properties of a table, those of nested fields included; ``leave``: columns that are none."""
    out = Properties()

    def walk(name: str, dt: T.DataType, metadata: dict | None, listed: bool) -> None:
        kind = type_of(dt, metadata)
        if listed:
            kind = f"LIST<{kind[5:-1] if kind.startswith('LIST<') else kind}>"
        out.setdefault(name, kind)
        inner = dt.elementType if isinstance(dt, T.ArrayType) else dt
        if isinstance(inner, T.StructType):
            for f in inner.fields:
                walk(f"{name}.{f.name}", f.dataType, f.metadata, listed or isinstance(dt, T.ArrayType))

    for f in schema.fields:  # columns first: their names may have dots
        if f.name not in leave:
            out[f.name] = type_of(f.dataType, f.metadata)
    for f in schema.fields:
        if f.name not in leave:
            walk(f.name, f.dataType, f.metadata, False)
    return out


def find(schema: T.StructType, name: str) -> tuple[Column, T.DataType] | None:
    """The column of a property and its type."""
    types = {f.name: f.dataType for f in schema.fields}
    if name in types:
        return column(name), types[name]
    parts = name.split(".")
    for k in range(len(parts) - 1, 0, -1):
        first = ".".join(parts[:k])
        if first in types:
            got = _inside(column(first), types[first], parts[k:])
            if got is not None:
                return got
    return None


def _inside(x: Column, dt: T.DataType, way: list[str]) -> tuple[Column, T.DataType] | None:
    if not way:
        return x, dt
    if isinstance(dt, T.MapType):
        key = ".".join(way)  # the rest is one key
        return (F.try_element_at(x, F.lit(key)), dt.valueType) if isinstance(dt.keyType, T.StringType) else None
    struct = dt.elementType if isinstance(dt, T.ArrayType) else dt
    if not isinstance(struct, T.StructType):
        return None
    for k in range(len(way), 0, -1):
        name = ".".join(way[:k])
        if name in struct.names:
            inner = struct[name].dataType
            y = x.getField(name)
            if isinstance(dt, T.ArrayType):
                y, inner = (F.flatten(F.filter(y, lambda v: v.isNotNull())), inner) if isinstance(inner, T.ArrayType) else (y, T.ArrayType(inner))
            return _inside(y, inner, way[k:])
    return None


def element(kind: str) -> str:
    """The type of the values of a property: of a list, that of its elements."""
    return kind[5:-1] if kind.startswith("LIST<") else kind


def nested(kind: str) -> bool:
    """Whether values of the type are structs, maps or of a type without a neutral one."""
    return kind in ("STRUCT", "OTHER") or kind.startswith("MAP")


def sorted_maps(x: Column, dt: T.DataType) -> Column:
    """A value whose maps are arrays of entries in the order of their keys, so that equal values have one form."""
    if isinstance(dt, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(x), lambda k: k))
        return F.transform(entries, lambda k: F.struct(k.alias("key"), sorted_maps(F.element_at(x, k), dt.valueType).alias("value")))
    if isinstance(dt, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(sorted_maps(x.getField(f.name), f.dataType).alias(f.name) for f in dt.fields)))
    if isinstance(dt, T.ArrayType):
        return F.transform(x, lambda v: sorted_maps(v, dt.elementType))
    return x


def as_text(x: Column, dt: T.DataType) -> Column:
    """A struct or map as JSON; null stays null."""
    if isinstance(dt, T.StructType) and not dt.fields:
        return F.when(x.isNotNull(), F.lit("{}"))
    if isinstance(dt, T.MapType) or isinstance(dt, T.StructType):
        return F.to_json(sorted_maps(x, dt))
    return F.to_json(F.struct(x.alias("value")))


def flat(x: Column, dt: T.DataType) -> Column:
    """A property's column with structs and maps, within lists too, as text."""
    if isinstance(dt, T.ArrayType) and nested(type_of(dt.elementType)):
        return F.transform(x, lambda v: as_text(v, dt.elementType))
    return as_text(x, dt) if nested(type_of(dt)) else x
