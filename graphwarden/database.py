"""A graph that stays open: shapes are checked against it until it is closed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import ClosedError
from .plans.lower import Options
from .plans.manifest import Compilation, compile_shapes
from .runner import Report, validate
from .sources.graph import PropertyGraph, load_graph
from .sources.schema import Snapshot
from .sources.shapes import Document


class Database:
    """A property graph with the calls that users make on it. Usable in a ``with`` block; a closed one raises
    ``ClosedError``. The Spark session stays: it is the caller's."""

    def __init__(self, graph: PropertyGraph):
        self._graph: PropertyGraph | None = graph

    @classmethod
    def open(cls, spark: SparkSession, source: str | dict, base_dir: str | None = None) -> Database:
        """The graph of a configuration (JSON file or dict)."""
        return cls(load_graph(spark, source, base_dir))

    @property
    def graph(self) -> PropertyGraph:
        if self._graph is None:
            raise ClosedError("the database is closed")
        return self._graph

    @property
    def closed(self) -> bool:
        return self._graph is None

    def schema(self) -> Snapshot:
        return self.graph.snapshot()

    def compile(self, shapes: list[str | Document], options: Options | None = None, ontology: list[str | Document] | None = None) -> Compilation:
        return compile_shapes(shapes, self.schema(), options, ontology)

    def validate(self, shapes: Compilation | list[str | Document], options: Options | None = None, **more) -> Report:
        """``more``: limit, sample_size, timeout and workers, as for ``graphwarden.validate``."""
        return validate(self.graph, shapes if isinstance(shapes, Compilation) else self.compile(shapes, options), **more)

    def close(self) -> None:
        self._graph = None

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()
