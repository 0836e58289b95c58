"""Paths as joins: pairs of (start label, start id, end label, end id); ids have the graph's key type."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.names import column
from ..plans.ir import Alt, Rel, Repeat, Seq, Step
from ..sources.graph import PropertyGraph

def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the cluster's shared one; of our own only in tests on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphwarden-"))
        found = sc.getCheckpointDir()
    return f"{found}/graphwarden-{uuid.uuid4().hex}"


def cut(df: DataFrame, written: list[str]) -> DataFrame:
    """Cut the lineage of an iteration with a table in the cluster's shared folder; it outlives lost executors, and
    how many rows it has is in its footers. ``written`` gets its path."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


class Paths:
    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.written: list[str] = []

    def clear(self) -> None:
        """Delete the tables of repeated paths, once no frame that reads them is needed."""
        spark = self.graph.spark
        while self.written:
            found = spark._jvm.org.apache.hadoop.fs.Path(self.written.pop())
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)

    def empty(self, labels: set[str]) -> DataFrame:
        kind = self.graph.key_type(next(iter(labels), ""))
        return self.graph.spark.createDataFrame([], f"sl string, sid {kind}, el string, eid {kind}")

    def edges(self, step: Rel, starts: set[str]) -> DataFrame:
        """Pairs of one hop from the labels."""
        found = []
        for r in self.graph.rels:
            a, b = (r.start, r.end) if step.out else (r.end, r.start)
            if r.type not in step.types or a not in starts:
                continue
            s, e = (r.src, r.dst) if step.out else (r.dst, r.src)
            s, e = column(s).cast(self.graph.key_type(a)), column(e).cast(self.graph.key_type(b))
            rows = r.inverse if r.inverse is not None and not step.out else r.df
            found.append(rows.select(F.lit(a).alias("sl"), s.alias("sid"), F.lit(b).alias("el"), e.alias("eid")).where("sid IS NOT NULL AND eid IS NOT NULL"))
        return union(found) if found else self.empty(starts)

    def ends(self, step: Step, starts: set[str]) -> set[str]:
        """Labels that a step from the labels can reach."""
        if isinstance(step, Rel):
            return {(r.end if step.out else r.start) for r in self.graph.rels if r.type in step.types and (r.start if step.out else r.end) in starts}
        if isinstance(step, Seq):
            for p in step.parts:
                starts = self.ends(p, starts)
            return starts
        if isinstance(step, Alt):
            return set().union(*(self.ends(p, starts) for p in step.parts))
        out, front = (set(starts) if step.least == 0 else set()), set(starts)
        for _ in range(step.most):
            front = self.ends(step.part, front)
            if front <= out:
                break
            out |= front
        return out

    def pairs(self, step: Step, label: str, enough: int | None = None) -> DataFrame:
        """Pairs of a whole path from the nodes of a label; parallel ways may repeat a pair. ``enough``: so many
        different ends of a start will do; starts of a repeated path that have them go no further."""
        if isinstance(step, Repeat) and step.most > 1:
            return self._closure(step, {label}, enough)
        return self._extend(step, None, {label})

    def _closure(self, step: Repeat, labels: set[str], enough: int | None) -> DataFrame:
        """Pairs within ``step.most`` hops from all nodes of the labels, in a number of rounds that is the logarithm
        of it: what is 1 to 2k hops away is at most k hops away, or k hops from a node that is exactly k hops away.
        Each pair has its least distance, so every round joins only pairs of distance k with known ones. With
        ``enough``, a start keeps its nearest ends only: those of a start that has too few are complete."""
        on = ["sl", "sid", "el", "eid"]
        every = labels | self.ends(Repeat(step.part, 1, step.most), labels)
        known = self.edges(step.part, every).distinct().withColumn("d", F.lit(1))
        if enough is not None:
            known = self._cut(self._nearest(known, enough))
        else:
            known = self._cut(known)
        reached = 1
        while reached < step.most:
            more = min(reached, step.most - reached)
            front = known.where(F.col("d") == reached)
            if enough is not None:
                full = known.groupBy("sl", "sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
                front = front.join(full, ["sl", "sid"], "left_anti")
            ahead = known.where(F.col("d") <= more).select(F.col("sl").alias("el"), F.col("sid").alias("eid"), F.col("el").alias("nl"), F.col("eid").alias("nid"), F.col("d").alias("nd"))
            new = front.join(ahead, ["el", "eid"]).groupBy("sl", "sid", F.col("nl").alias("el"), F.col("nid").alias("eid")).agg(F.min(F.col("d") + F.col("nd")).alias("d"))
            new = self._cut(new.join(known, on, "left_anti"))
            if new.isEmpty():
                break
            known = known.unionAll(new)
            if enough is not None:
                known = self._cut(self._nearest(known, enough))
            reached += more
        found = known.where(F.col("sl").isin(*labels)).select(*on)
        return found.unionAll(self._nodes(labels)).distinct() if step.least == 0 else found

    def _cut(self, df: DataFrame) -> DataFrame:
        return cut(df, self.written)

    @staticmethod
    def _nearest(known: DataFrame, n: int) -> DataFrame:
        near = Window.partitionBy("sl", "sid").orderBy("d", "el", "eid")
        return known.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= n).drop("nth")

    def _nodes(self, labels: set[str]) -> DataFrame:
        found = [
            t.df.withColumn("sid", column(t.key).cast(self.graph.key_type(t.label))).select(F.lit(t.label).alias("sl"), "sid", F.lit(t.label).alias("el"), F.col("sid").alias("eid"))
            for t in self.graph.nodes if t.label in labels
        ]
        return union(found) if found else self.empty(labels)

    def _extend(self, step: Step, before: DataFrame | None, labels: set[str]) -> DataFrame:
        """Pairs so far (none: every node of the labels with itself) followed by a step."""
        if isinstance(step, Rel):
            hop = self.edges(step, labels)
            return hop if before is None else self._join(before, hop)
        if isinstance(step, Seq):
            for p in step.parts:
                before, labels = self._extend(p, before, labels), self.ends(p, labels)
            return before
        if isinstance(step, Alt):
            return union([self._extend(p, before, labels) for p in step.parts])
        return self._repeat(step, before, labels)

    @staticmethod
    def _join(before: DataFrame, hop: DataFrame) -> DataFrame:
        hop = hop.select(F.col("sl").alias("ml"), F.col("sid").alias("mid"), F.col("el").alias("nl"), F.col("eid").alias("nid"))
        joined = before.join(hop, (F.col("el") == F.col("ml")) & (F.col("eid") == F.col("mid")))
        return joined.select("sl", "sid", F.col("nl").alias("el"), F.col("nid").alias("eid")).distinct()

    def _repeat(self, step: Repeat, before: DataFrame | None, labels: set[str]) -> DataFrame:
        """Breadth-first: each round joins the new pairs only and keeps those not seen before."""
        start = self._nodes(labels) if before is None else before
        hop = self.edges(step.part, labels | self.ends(Repeat(step.part, 1, step.most), labels))
        front = self.edges(step.part, labels).distinct() if before is None else self._join(before, hop)
        seen = start.unionAll(front).distinct() if step.least == 0 else front
        if step.most == 1:
            return seen
        on = ["sl", "sid", "el", "eid"]
        front = seen = self._cut(seen)
        for _ in range(step.most - 1):
            front = self._cut(self._join(front, hop).join(seen, on, "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionAll(front)
        return seen
