"""A data source over Python database drivers (DB-API 2.0): a table or query, read in partitions.

Options: ``module`` (the driver), ``connect`` (JSON: keyword arguments of its ``connect``), ``dbtable`` or ``query``;
and for several partitions ``partitionColumn``, ``lowerBound``, ``upperBound`` (integers) and ``numPartitions``, with
the meaning that they have for JDBC: bounds only shape the partitions, all rows are read; nulls are in the first
one. A schema must be given. Executors open connections of their own and fetch ``fetchsize`` rows (10,000) at a
time; a partition that is read again, after a lost executor, is the same query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import SourceError


@dataclass
class Part(InputPartition):
    condition: str | None


def conditions(name: str, low: int, high: int, parts: int) -> list[str | None]:
    """What tells the partitions apart: strides of equal width, open at both ends."""
    parts = max(1, min(parts, high - low))
    if parts == 1:
        return [None]
    edges = [low + (high - low) * k // parts for k in range(1, parts)]
    middle = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(edges[:-1], edges[1:])]
    return [f"({name} < {edges[0]} OR {name} IS NULL)", *middle, f"{name} >= {edges[-1]}"]


class DbApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def schema(self) -> str:
        raise SourceError("a dbapi source needs a schema")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, {k.lower(): v for k, v in options.items()}
        if "module" not in self.options or ("query" in self.options) == ("dbtable" in self.options):
            raise SourceError("a dbapi source needs a module, and either a query or a dbtable")

    def partitions(self) -> list[Part]:
        o = self.options
        wanted = [x in o for x in ("partitioncolumn", "lowerbound", "upperbound", "numpartitions")]
        if any(wanted) and not all(wanted):
            raise SourceError("partitionColumn, lowerBound, upperBound and numPartitions belong together")
        if not any(wanted):
            return [Part(None)]
        return [Part(c) for c in conditions(o["partitioncolumn"], int(o["lowerbound"]), int(o["upperbound"]), int(o["numpartitions"]))]

    def read(self, partition: Part) -> Iterator[tuple]:
        o = self.options
        origin = f"({o['query']}) q" if "query" in o else o["dbtable"]
        sql = f"SELECT {', '.join(self.names)} FROM {origin}" + (f" WHERE {partition.condition}" if partition.condition else "")
        link = import_module(o["module"]).connect(**json.loads(o.get("connect", "{}")))
        try:
            cursor = link.cursor()
            cursor.execute(sql)
            while rows := cursor.fetchmany(int(o.get("fetchsize", "10000"))):
                yield from map(tuple, rows)
        finally:
            link.close()
