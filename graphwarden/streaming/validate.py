"""Rules over a stream of nodes: each micro-batch takes the place of one label's table, the rest of the
graph stays static, and the batch's violations go to a sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import Engine
from ..plans.manifest import Compilation
from ..sources.graph import PropertyGraph


def batch_violations(graph: PropertyGraph, label: str, batch: DataFrame, compiled: Compilation) -> DataFrame:
    """Violations of the rules that focus on the label, for the nodes of a batch."""
    nodes = [replace(n, df=batch) if n.label == label else n for n in graph.nodes]
    rules = [r for r in compiled.rules if r.status == "compiled" and any(label in f.labels for f in r.focus)]
    return Engine(PropertyGraph(nodes, graph.rels), compiled.options.node_key, only=label).all_violations(rules)


def validate_stream(stream: DataFrame, graph: PropertyGraph, label: str, compiled: Compilation, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that validates each micro-batch of new nodes of a label."""

    def each(batch: DataFrame, number: int) -> None:
        sink(batch_violations(graph, label, batch, compiled), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
