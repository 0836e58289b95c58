"""Runs compiled rules on a graph and collects a report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import Limit, at_once
from .operators.rules import Engine, first_of_each, joins_needed, way
from .plans.ir import Rule
from .plans.manifest import VERSION, Compilation
from .sources.graph import PropertyGraph

RANK = {"Info": 0, "Warning": 1, "Violation": 2}
TOOL = "graphwarden"


@dataclass
class RuleResult:
    name: str
    rule_id: str
    shape: str
    path: str | None
    constraint: str
    severity: str
    status: str
    message: str
    file: str
    line: int
    status_reason: str | None = None
    violation_count: int | None = None
    duration_ms: int = 0
    sample: list[dict] = field(default_factory=list)
    violations: list[dict] = field(default_factory=list)


@dataclass
class Report:
    rules: list[RuleResult]
    duration_ms: int

    @property
    def conforms(self) -> bool:
        return not any(r.status == "failed" for r in self.rules)

    @property
    def complete(self) -> bool:
        return not any(r.status in ("timeout", "error") for r in self.rules)

    def summary(self) -> dict[str, int]:
        n = lambda s: sum(r.status == s for r in self.rules)
        return {
            "rules": len(self.rules), "passed": n("passed"), "failed": n("failed"), "timeouts": n("timeout"), "errors": n("error"), "skipped": n("skipped"),
            "guaranteedBySchema": n("guaranteed-by-schema"), "violations": sum(r.violation_count or 0 for r in self.rules), "durationMs": self.duration_ms,
        }

    def to_dict(self) -> dict:
        rules = []
        for r in self.rules:
            d = asdict(r)
            rules.append({
                "name": d["name"], "ruleId": d["rule_id"], "shape": d["shape"], "path": d["path"], "constraint": d["constraint"], "severity": d["severity"], "status": d["status"],
                "statusReason": d["status_reason"], "violationCount": d["violation_count"], "durationMs": d["duration_ms"], "source": {"file": d["file"], "line": d["line"]},
                "message": d["message"], "sample": d["sample"], "violations": d["violations"],
            })
        return {"tool": TOOL, "toolVersion": VERSION, "dialect": "spark", "conforms": self.conforms, "complete": self.complete, "summary": self.summary(), "rules": rules}


def exit_code(report: Report, fail_on: str = "violation") -> int:
    """1: a rule at or above ``fail_on`` has violations; 3: a rule timed out or failed to run; else 0."""
    least = RANK[fail_on.capitalize()]
    if any(r.violation_count and RANK.get(r.severity, 2) >= least for r in report.rules):
        return 1
    return 0 if report.complete else 3


def _skipped(r: Rule) -> tuple[str, str | None]:
    if r.status == "guaranteed-by-schema":
        return "guaranteed-by-schema", None
    if r.status == "schema-mismatch":
        return "skipped", "schema mismatch; see the manifest's static diagnostics"
    return "skipped", r.reason or r.status


def as_violation(row, rule: Rule, node_key: str | None) -> dict:
    d = row.asDict()
    if any(f.kind == "relationships" for f in rule.focus):
        focus = {"type": d["focus_label"], "startKey": d["focus_start"], "endKey": d["focus_end"], "elementId": d["focus_id"]}
    else:
        focus = {"label": d["focus_label"], "key": rule.key or node_key, "keyValue": d["focus_key"], "elementId": d["focus_id"]}
    value = d["value"] if d["value_label"] is None else {"label": d["value_label"], "keyValue": d["value_key"], "elementId": d["value"]}
    out = {
        "ruleId": d["rule_id"], "shape": d["shape"], "path": d["path"], "constraint": d["constraint"], "severity": d["severity"], "focus": focus,
        "value": value, "message": d["message"], "details": d["details"],
    }
    return out if d["properties"] is None else out | {"properties": json.loads(d["properties"])}


def focus_name(focus: dict) -> tuple[str, str]:
    """Label and key of a node, type and endpoints of a relationship."""
    return (focus["type"], f"{focus['startKey']}->{focus['endKey']}") if "type" in focus else (str(focus["label"]), str(focus["keyValue"]))


def cause(error: Exception) -> str:
    """The first line of what went wrong at the bottom of an error."""
    java = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while java is not None and java.getCause() is not None:
        java = java.getCause()
    text = (java.getMessage() if java is not None else None) or str(error)
    return next((x for x in text.splitlines() if x.strip()), type(error).__name__)


def blank_results(compiled: Compilation) -> dict[str, RuleResult]:
    """The results of a run that has found nothing yet."""
    results: dict[str, RuleResult] = {}
    for r in compiled.rules:
        status, reason = ("passed", None) if r.status == "compiled" else _skipped(r)
        results[r.rule_id] = RuleResult(r.name, r.rule_id, r.shape, r.path, r.constraint, r.severity, status, r.message, r.file, r.line, reason)
    return results


def validate(graph: PropertyGraph, compiled: Compilation, limit: int | None = 100, sample_size: int = 5, timeout: float | None = None, workers: int = 1) -> Report:
    """Run every rule. ``limit``: violations listed for each rule (None or 0: all, for graphs whose violations fit in
    the driver; ``sink.store`` writes them as a table instead); ``timeout``: seconds for each group of rules that
    share a scan; ``workers``: groups that run at the same time, each from a thread of its own in a scheduler pool
    of its own. What is set for the calling thread (tags, descriptions) holds for all of them, so cancelling the
    caller's tag cancels them all; a group's timeout cancels that group's jobs alone."""
    began = time.monotonic()
    spark, engines = graph.spark, []
    rules = {r.rule_id: r for r in compiled.rules}
    results = blank_results(compiled)

    def run(group: list[Rule], plan) -> None:
        start = time.monotonic()
        with Limit(spark, timeout) as bound:
            try:
                frame: DataFrame = plan()
                bound.check()
                counts = {x["rule_id"]: x["n"] for x in frame.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            except Exception as error:
                for r in group:
                    results[r.rule_id].status = "timeout" if bound.hit else "error"
                    results[r.rule_id].status_reason = None if bound.hit else cause(error)
                counts = None
            if counts is not None:
                for r in group:
                    results[r.rule_id].violation_count = counts.get(r.rule_id, 0)
                    if r.rule_id in counts:
                        results[r.rule_id].status = "failed"
                if counts:
                    try:
                        bound.check()
                        for row in (first_of_each(frame, limit) if limit else frame).collect():
                            results[row["rule_id"]].violations.append(as_violation(row, rules[row["rule_id"]], compiled.options.node_key))
                    except Exception as error:
                        for i in counts:
                            results[i].status_reason = "timed out; violations are not listed" if bound.hit else f"violations are not listed: {cause(error)}"
        for r in group:
            x = results[r.rule_id]
            x.duration_ms = int((time.monotonic() - start) * 1000)
            x.violations.sort(key=lambda v: focus_name(v["focus"]) + (str(v["value"]),))
            x.sample = [v["focus"] for v in x.violations[:sample_size]]

    def engine() -> Engine:
        engines.append(Engine(graph, compiled.options.node_key, compiled.options.verbose))
        return engines[-1]

    try:
        at_once(spark, [lambda g=g, p=p: run(g, p) for g, p in groups_of(engine, compiled.rules)], workers)
    finally:
        for e in engines:
            e.clear()
    return Report([results[r.rule_id] for r in compiled.rules], int((time.monotonic() - began) * 1000))


def plans_text(graph: PropertyGraph, compiled: Compilation) -> str:
    """The physical plan of each group of rules, headed by the rules' names and ids."""
    out = []
    for group, plan in groups_of(lambda: Engine(graph, compiled.options.node_key, compiled.options.verbose), compiled.rules):
        out += [f"-- name: {r.name}\n-- ruleId: {r.rule_id}" for r in group]
        out.append(plan()._jdf.queryExecution().explainString(graph.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    return "\n".join(out) + "\n"


def groups_of(engine: Callable[[], Engine], rules: list[Rule]):
    """Groups of rules with a function that plans them, by an engine of its own; a plan that fails spoils its
    group only."""
    fused: dict[tuple, list[Rule]] = {}
    for r in rules:
        if r.status == "compiled":
            fused.setdefault((r.focus, r.key) if not joins_needed(r) else (r.focus, r.key, way(r)) if way(r) else (r.rule_id,), []).append(r)
    for group in fused.values():
        yield group, lambda group=group: engine().all_violations(group)
