"""Tables laid out for the joins that rules make: bucketed by the keys that paths join on.

Node tables are bucketed and sorted by their key, relationship tables by the key of the end that a path leaves
from (both ways if paths go both ways), all with one number of buckets and the graph's key types. A join of nodes
with their relationships, and counts for each start, then need no exchange: each task reads one bucket of both
sides. Hubs are what buckets can't split; tables whose largest bucket is out of proportion are left as they are.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import column
from .plans.ir import Alt, Rel, Repeat, Seq, Step, sources_of
from .plans.manifest import Compilation
from .sources.graph import NodeTable, PropertyGraph, RelTable

#: A bucket of more than so many times the mean is out of proportion.
UNEVEN = 8


def hops_of(step: Step | None) -> list[Rel]:
    if step is None:
        return []
    if isinstance(step, Rel):
        return [step]
    if isinstance(step, Repeat):
        return [step.part]
    return [h for p in step.parts for h in hops_of(p)] if isinstance(step, Seq | Alt) else []


def ways_of(compiled: Compilation) -> dict[str, set[bool]]:
    """The relationship types on the rules' paths, and whether paths leave by their source (True) or target."""
    out: dict[str, set[bool]] = {}
    for r in compiled.rules:
        if r.status != "compiled":
            continue
        sources = [s for e in (r.holds, *(d.holds for d in r.details)) for s in sources_of(e)] + ([r.source] if r.source else [])
        for hop in [h for s in sources for h in hops_of(s.hops)]:
            for kind in hop.types:
                out.setdefault(kind, set()).add(hop.out)
    return out


def uneven(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether one bucket would hold far more rows than the others; counts by bucket are all that is read of them."""
    n = [r["count"] for r in df.groupBy(F.pmod(F.hash(column(key)), F.lit(buckets)).alias("b")).count().collect()]
    return bool(n) and max(n) > UNEVEN * max(1, sum(n) / buckets)


def rewrite(graph: PropertyGraph, compiled: Compilation, folder: str, buckets: int = 200, database: str = "default") -> PropertyGraph:
    """The graph over bucketed tables of what the rules join, in a folder that the cluster shares and under names of
    that folder in the catalog, which knows the buckets; other tables, and those with an uneven bucket, stay as
    they are. A rewrite into the same folder takes the place of the one before, whose graph can't be read then."""
    spark, ways = graph.spark, ways_of(compiled)
    prefix = f"{database}.gw_" + hashlib.sha256(folder.encode()).hexdigest()[:12]

    def table(df: DataFrame, name: str, keys: dict[str, str], by: str) -> DataFrame:
        typed = df.withColumns({c: column(c).cast(t) for c, t in keys.items()})
        if uneven(typed, by, buckets):
            return df
        plain = re.sub(r"[^A-Za-z0-9_]", lambda m: f"_{ord(m[0]):x}", name).lower()
        full = f"{prefix}_{plain}"
        typed.write.mode("overwrite").format("parquet").option("path", f"{folder.rstrip('/')}/{plain}").bucketBy(buckets, by).sortBy(by).saveAsTable(full)
        return spark.table(full)

    joined = {x for r in graph.rels if r.type in ways for x in (r.start, r.end)}
    nodes = [
        NodeTable(n.label, table(n.df, f"node_{n.label}", {n.key: graph.key_type(n.label)}, n.key), n.key, n.labels, n.carries) if n.label in joined else n
        for n in graph.nodes
    ]
    rels = []
    for r in graph.rels:
        keys, name = {r.src: graph.key_type(r.start), r.dst: graph.key_type(r.end)}, f"rel_{r.type}_{r.start}_{r.end}"
        out = table(r.df, name, keys, r.src) if True in ways.get(r.type, ()) else r.df
        back = table(r.df, f"{name}_in", keys, r.dst) if False in ways.get(r.type, ()) else None
        rels.append(RelTable(r.type, r.start, r.end, out, r.src, r.dst, r.key, back))
    return PropertyGraph(nodes, rels)
