"""Property graphs over DataFrames: one node table for each label, one relationship table for each
(type, from, to). Nothing is read or copied until a rule runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from importlib import import_module
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType, VariantType

from ..errors import SourceError
from ..functions import nested
from ..functions.names import column
from .schema import RelType, Snapshot


@dataclass
class NodeTable:
    """Nodes of one label. ``key``: the column that identifies a node. ``labels``: a column with all
    labels of a node, for nodes that carry more than the table's own; ``carries``: those that occur in it."""

    label: str
    df: DataFrame
    key: str = "id"
    labels: str | None = None
    carries: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for c in (self.key, *([self.labels] if self.labels else [])):
            if c not in self.df.columns:
                raise SourceError(f"node table {self.label} has no column {c}")

    @property
    def properties(self) -> nested.Properties:
        """Names and neutral types of columns and of their fields."""
        return nested.properties(self.df.schema, (self.labels,))

    def value(self, name: str) -> Column:
        """A property's column; structs and maps as text."""
        return nested.flat(*nested.find(self.df.schema, name))


@dataclass
class RelTable:
    """Relationships of one type between two labels; src and dst hold the endpoints' keys. ``key``: a column
    that identifies a relationship, where there is one. ``inverse``: the same rows laid out by dst, for paths that
    go against the relationships."""

    type: str
    start: str
    end: str
    df: DataFrame
    src: str = "src"
    dst: str = "dst"
    key: str | None = None
    inverse: DataFrame | None = None

    def __post_init__(self) -> None:
        for c in (self.src, self.dst, *([self.key] if self.key else [])):
            if c not in self.df.columns:
                raise SourceError(f"relationship table {self.type} has no column {c}")

    @property
    def properties(self) -> dict[str, str]:
        return nested.properties(self.df.schema, (self.src, self.dst))


def _common(types: list[DataType]) -> str:
    """The type in which keys of these types are compared: their own if it is one, text otherwise."""
    if all(isinstance(t, IntegralType) for t in types):
        return "bigint"
    plain = isinstance(types[0], StringType | DateType | TimestampType | TimestampNTZType | DecimalType | BooleanType)
    return types[0].simpleString() if plain and len(set(types)) == 1 else "string"


@dataclass
class PropertyGraph:
    """Keys are compared in their own type where all tables that relationships connect agree on it, as text
    otherwise."""

    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    key_types: dict[str, str] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        labels = [n.label for n in self.nodes]
        if len(set(labels)) < len(labels):
            raise SourceError("a label has two node tables")
        for r in self.rels:
            for x in (r.start, r.end):
                if x not in labels:
                    raise SourceError(f"relationship table {r.type} ends at unknown label {x}")
        self.key_types = self._key_types()

    def _key_types(self) -> dict[str, str]:
        found = [({n.label}, [n.df.schema[n.key].dataType]) for n in self.nodes]
        for r in self.rels:
            met = [x for x in found if x[0] & {r.start, r.end}]
            found = [x for x in found if x not in met]
            found.append((set().union(*(x[0] for x in met)), [t for x in met for t in x[1]] + [r.df.schema[c].dataType for c in (r.src, r.dst)]))
        return {label: kind for labels, kind in ((x[0], _common(x[1])) for x in found) for label in labels}

    def key_type(self, label: str) -> str:
        """The type of a label's keys in plans."""
        return self.key_types.get(label, "string")

    def table(self, label: str) -> NodeTable | None:
        return next((n for n in self.nodes if n.label == label), None)

    @property
    def spark(self) -> SparkSession:
        return self.nodes[0].df.sparkSession

    def snapshot(self) -> Snapshot:
        """The schema, from column types alone: no data is read. A label that nodes of other tables carry has
        their properties and relationships too; tables with such nodes leave decisions to the data."""
        out = Snapshot({n.label: n.properties for n in self.nodes}, enforced=not any(n.labels for n in self.nodes))
        also = {n.label: (n.label, *n.carries) for n in self.nodes}
        for n in self.nodes:
            for x in n.carries:
                out.nodes.setdefault(x, nested.Properties()).update(n.properties)
        for r in self.rels:
            t = out.rels.setdefault(r.type, RelType(r.type))
            t.endpoints += [(a, b) for a in also[r.start] for b in also[r.end]]
            t.properties |= r.properties
        return out

    def observed(self) -> dict[str, list[str]]:
        """For each property without a declared type (``Label.name``), the types that occur in it: one aggregate a
        table, over all its untyped columns. Objects and arrays are one type each, whatever is in them."""
        out = {}
        for t in self.nodes:
            names = sorted(f.name for f in t.df.schema.fields if isinstance(f.dataType, VariantType))
            if names:
                kind = lambda c: F.regexp_replace(F.schema_of_variant(column(c)), "<.*$", "")
                row = t.df.agg(*(F.collect_set(kind(c)) for c in names)).first()
                out |= {f"{t.label}.{c}": sorted(set(found) - {"VOID"}) for c, found in zip(names, row)}
        return out

    def observed_endpoints(self) -> list[dict]:
        """For each relationship table, the labels at whose nodes its rows start and end and how many rows those are:
        declared, or found in other tables, or ``None`` where no table has the key. One job a table: both ends
        are joined with the keys of all nodes; only counts by label reach the driver. A key that several tables
        have counts for the declared one, or else for the first by name."""
        out = []
        for r in self.rels:
            rows = r.df.select(column(r.src).cast("string").alias("src"), column(r.dst).cast("string").alias("dst"))
            for end, declared in (("src", r.start), ("dst", r.end)):
                first = F.when(F.col("label") == declared, F.lit(0)).otherwise(F.lit(1))
                keys = [t.df.select(column(t.key).cast("string").alias(end), F.lit(t.label).alias("label")) for t in self.nodes]
                found = reduce(DataFrame.unionAll, keys).where(F.col(end).isNotNull()).groupBy(end).agg(F.min(F.struct(first.alias("o"), "label")).alias(f"{end}_at"))
                rows = rows.join(found, end, "left")
            counts = rows.groupBy(F.col("src_at.label").alias("a"), F.col("dst_at.label").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
            out += [{"type": r.type, "declared": [r.start, r.end], "from": c.a, "to": c.b, "rows": c.n} for c in sorted(counts, key=lambda c: (str(c.a), str(c.b)))]
        return out


def registered(spark: SparkSession, name: str) -> str:
    """Registers a Python data source (``module:Class``) and returns the format that it answers to."""
    module, _, kind = name.partition(":")
    found = getattr(import_module(module), kind)
    spark.dataSource.register(found)
    return found.name()


def load_graph(spark: SparkSession, source: str | dict, base_dir: str | None = None) -> PropertyGraph:
    """A graph from a configuration (JSON file or dict):

    {"nodes": [{"label", "table" | "path" (+"format", "options") | "sql", "key", "labels", "carries"}],
     "rels":  [{"type", "from", "to", the same source fields, "src", "dst", "key"}]}

    where a source may also be {"format" | "source", "options", "schema"}.

    ``table`` names a catalog table, ``path`` a file or folder for spark.read, ``sql`` any query. A source with a
    ``format`` and ``options`` needs no path: JDBC tables with partition bounds, or a Python data source, which
    ``source`` names as ``module:Class`` and which is registered first. ``schema`` is a DDL string, for formats
    that have none of their own. Options that are numbers or objects are handed on as text."""
    if isinstance(source, str):
        base_dir = base_dir or str(Path(source).resolve().parent)
        try:
            source = json.loads(Path(source).read_text())
        except (OSError, ValueError) as error:
            raise SourceError(f"{source}: {error}") from error
    views: dict[str, DataFrame] = {}

    def frame(spec: dict) -> DataFrame:
        try:
            if "table" in spec:
                return spark.table(spec["table"])
            if "sql" in spec:
                return spark.sql(spec["sql"], **views)
            kind = spec.get("format", "parquet")
            if "source" in spec:
                kind = registered(spark, spec["source"])
            elif kind == "dbapi":
                kind = registered(spark, "graphwarden.sources.dbapi:DbApi")
            options = {k: v if isinstance(v, str) else json.dumps(v) for k, v in spec.get("options", {}).items()}
            reader = spark.read.format(kind).options(**options)
            if "schema" in spec:
                reader = reader.schema(spec["schema"])
            path = spec.get("path")
            if path is None:
                if not {"format", "source"} & set(spec):
                    raise SourceError("it has neither table, sql, path, format nor source")
                return reader.load()
            if base_dir and "://" not in path and not path.startswith("/"):
                path = f"{base_dir}/{path}"
            return reader.load(path)
        except Exception as error:
            raise SourceError(f"can't open {spec}: {str(error).splitlines()[0]}") from error

    try:
        return PropertyGraph(
            [NodeTable(n["label"], frame(n), n.get("key", "id"), n.get("labels"), tuple(n.get("carries", ()))) for n in source.get("nodes", [])],
            [RelTable(r["type"], r["from"], r["to"], frame(r), r.get("src", "src"), r.get("dst", "dst"), r.get("key")) for r in source.get("rels", [])],
        )
    except KeyError as error:
        raise SourceError(f"graph configuration lacks {error}") from error
