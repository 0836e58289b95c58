"""Violations as a table, for graphs whose violations don't fit in the driver.

``store`` writes the violations of each rule into a partition of its own (``rule=<digest of the rule id>``), which a
repeated run overwrites: after it the table holds what the run found and nothing else of these rules. What became of
each rule, and how many violations it has, is in ``run.json``, written first as unfinished and last as finished, so
a table that a run left half written is not read. Only counts and the first violations reach the driver; ``stream``
writes all of them as JSON or SARIF, one partition of rows at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SourceError
from .jobs import Limit, at_once
from .operators.rules import SCHEMA, Engine, first_of_each
from .plans.ir import Rule
from .plans.manifest import Compilation
from .report import sarif_parts
from .runner import Report, as_violation, blank_results, cause, groups_of
from .sources.graph import PropertyGraph

FORMATS = ("json", "sarif")


def _file(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, whole or not at all."""
    files, to = _file(spark, path)
    _, part = _file(spark, f"{path}.part")
    out = files.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files.delete(to, False)
    files.rename(part, to)


def _get(spark: SparkSession, path: str) -> dict:
    files, found = _file(spark, path)
    if not files.exists(found):
        raise SourceError(f"{path}: no run has been stored there")
    reader = spark._jvm.org.apache.commons.io.IOUtils
    stream = files.open(found)
    try:
        return json.loads(reader.toString(stream, "UTF-8"))
    finally:
        stream.close()


def partition(rule_id: str) -> str:
    return "r" + hashlib.sha256(rule_id.encode()).hexdigest()[:16]


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, rule string").parquet(f"{folder}/violations")


def store(graph: PropertyGraph, compiled: Compilation, folder: str, limit: int = 5, timeout: float | None = None, workers: int = 1) -> Report:
    """Run every rule and write all violations into a folder that the cluster shares. The report lists the first
    ``limit`` of each rule; ``timeout`` and ``workers`` as for ``validate``. A rule whose group fails keeps the
    rows of the run before in the table, but not in what is read: its status says that it has none."""
    began, spark, folder = time.monotonic(), graph.spark, folder.rstrip("/")
    rules, results = {r.rule_id: r for r in compiled.rules}, blank_results(compiled)
    _put(spark, f"{folder}/run.json", json.dumps({"finished": False}))

    def run(group: list[Rule], plan: Callable[[], DataFrame]) -> None:
        start, parts = time.monotonic(), {partition(r.rule_id): r for r in group}
        with Limit(spark, timeout) as bound:
            try:
                frame = plan()
                bound.check()
                for p in parts:  # a rule without violations writes no partition, so none may be left
                    files, old = _file(spark, f"{folder}/violations/rule={p}")
                    files.delete(old, True)
                named = F.create_map(*(F.lit(x) for p, r in parts.items() for x in (r.rule_id, p)))
                rows = frame.withColumn("rule", named[F.col("rule_id")]).hint("rebalance", "rule")
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule").parquet(f"{folder}/violations")
                bound.check()
                written = _table(spark, folder).where(F.col("rule").isin(*parts))
                for x in written.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect():
                    r = results[parts[x["rule"]].rule_id]
                    r.status, r.violation_count = "failed", x["n"]
                for r in group:
                    results[r.rule_id].violation_count = results[r.rule_id].violation_count or 0
                if limit:
                    for row in first_of_each(written, limit).collect():
                        results[row["rule_id"]].violations.append(as_violation(row, rules[row["rule_id"]], compiled.options.node_key))
            except Exception as error:
                for r in group:
                    x = results[r.rule_id]
                    x.status, x.status_reason, x.violation_count = ("timeout", None, None) if bound.hit else ("error", cause(error), None)
        for r in group:
            x = results[r.rule_id]
            x.duration_ms, x.sample = int((time.monotonic() - start) * 1000), [v["focus"] for v in x.violations]

    engines = []

    def engine() -> Engine:
        engines.append(Engine(graph, compiled.options.node_key, compiled.options.verbose))
        return engines[-1]

    try:
        at_once(spark, [lambda g=g, p=p: run(g, p) for g, p in groups_of(engine, compiled.rules)], workers)
    finally:
        for e in engines:
            e.clear()
    report = Report([results[r.rule_id] for r in compiled.rules], int((time.monotonic() - began) * 1000))
    _put(spark, f"{folder}/run.json", json.dumps({"finished": True, "report": report.to_dict()}))
    return report


def _run(spark: SparkSession, folder: str) -> dict:
    found = _get(spark, f"{folder.rstrip('/')}/run.json")
    if not found["finished"]:
        raise SourceError(f"{folder}: the run that wrote it has not ended")
    return found["report"]


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """The stored violations of the last run."""
    found = [partition(r["ruleId"]) for r in _run(spark, folder)["rules"] if r["violationCount"]]
    table = _table(spark, folder.rstrip("/")) if found else spark.createDataFrame([], f"{SCHEMA}, rule string")
    return table.where(F.col("rule").isin(*found)).drop("rule") if found else table.drop("rule")


def _each(spark: SparkSession, folder: str, rule: Rule, node_key: str | None) -> Iterator[dict]:
    rows = _table(spark, folder.rstrip("/")).where(F.col("rule") == partition(rule.rule_id))
    for row in rows.orderBy("focus_label", "focus_key", "focus_id", "value").toLocalIterator():
        yield as_violation(row, rule, node_key)


def stream(spark: SparkSession, compiled: Compilation, folder: str, form: str, write: Callable[[str], object]) -> None:
    """The stored run as JSON or SARIF with all its violations, in the order of focus and value, handed to ``write``
    piece by piece."""
    if form not in FORMATS:
        raise ValueError(f"a stored run can't be streamed as {form!r}")
    report, rules, key = _run(spark, folder), {r.rule_id: r for r in compiled.rules}, compiled.options.node_key
    text = lambda x: json.dumps(x, ensure_ascii=False)
    if form == "json":
        write(text({k: v for k, v in report.items() if k != "rules"})[:-1] + ', "rules": [\n')
        for k, r in enumerate(report["rules"]):
            write((",\n" if k else "") + text({n: v for n, v in r.items() if n != "violations"})[:-1] + ', "violations": [')
            for i, v in enumerate(_each(spark, folder, rules[r["ruleId"]], key) if r["violationCount"] else ()):
                write((",\n" if i else "\n") + text(v))
            write("]}")
        write("\n]}\n")
        return
    head, tail, result = sarif_parts(report)
    write(head)
    first = True
    for r in report["rules"]:
        for v in _each(spark, folder, rules[r["ruleId"]], key) if r["violationCount"] else ():
            write(("\n" if first else ",\n") + text(result(r, v)))
            first = False
    write(tail)
