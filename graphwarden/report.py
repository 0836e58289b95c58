"""Reports as text: a table, JSON, JUnit XML and SARIF 2.1.0 (their keys and element names are the formats')."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Callable
from itertools import groupby

from .plans.manifest import VERSION
from .runner import TOOL, Report, RuleResult, focus_name

SHOWN = 10
#: Statuses in the order of the table's sections, with their headings.
SECTIONS = {"failed": "violated", "error": "could not run", "timeout": "ran out of time", "skipped": "not run", "guaranteed-by-schema": "settled by the schema", "passed": "kept"}
_SARIF_LEVELS = defaultdict(lambda: "error", Warning="warning", Info="note")


def describe(violation: dict) -> str:
    """One violation as a line of text."""
    label, key = focus_name(violation["focus"])
    value = violation["value"]
    if isinstance(value, dict):
        value = f"{value['label']} {value['keyValue']}"
    return f"{label} {key} - {violation['message']}" + ("" if value is None else f" [{value}]")


def excerpt(r: RuleResult) -> list[str]:
    """The first violations of a rule, then how many are left out and what the runner says."""
    lines = [describe(v) for v in r.violations[:SHOWN]]
    left = (r.violation_count or 0) - len(lines)
    if lines and left > 0:
        lines.append(f"and {left} others")
    return lines + ([r.status_reason] if r.status_reason else [])


def table(report: Report) -> str:
    """A heading with the totals, then a section for each status that occurs; rules by name."""
    totals = report.summary()
    seconds = report.duration_ms / 1000
    lines = [f"{TOOL}: {totals['rules']} rules, {totals['violations']} violations, {seconds:.1f} s, {'complete' if report.complete else 'incomplete'}"]
    by_status = defaultdict(list)
    for r in report.rules:
        by_status[r.status].append(r)
    for status, heading in SECTIONS.items():
        found = sorted(by_status[status], key=lambda r: r.name)
        if not found:
            continue
        lines += ["", f"== {heading}: {len(found)}"]
        for r in found:
            amount = f", {r.violation_count} x" if r.violation_count else ""
            lines.append(f"{r.name} <{r.severity}{amount}> {r.file}:{r.line}, {r.duration_ms} ms")
            lines += [f"    {x}" for x in excerpt(r)]
    return "\n".join(lines) + "\n"


def _printable(text: object) -> str:
    """Text without the characters that XML 1.0 forbids."""
    allowed = lambda c: c in "\t\n\r" or " " <= c <= "퟿" or "" <= c <= "�" or c >= "\U00010000"
    return "".join(filter(allowed, str(text)))


def _element(parent: ET.Element, tag: str, text: str | None = None, **attributes: object) -> ET.Element:
    out = ET.SubElement(parent, tag, {k: _printable(v) for k, v in attributes.items()})
    out.text = None if text is None else _printable(text)
    return out


def junit(report: Report) -> str:
    """A suite for each shape, a test case for each of its rules."""
    root = ET.Element("testsuites", name=TOOL)
    ordered = sorted(report.rules, key=lambda r: (r.shape, r.rule_id))
    for shape, rules in groupby(ordered, key=lambda r: r.shape):
        rules = list(rules)
        number = lambda *statuses: sum(r.status in statuses for r in rules)  # noqa: E731, B023
        suite = _element(
            root, "testsuite", name=shape, tests=len(rules), failures=number("failed"), errors=number("error", "timeout"), skipped=number("skipped"), time=sum(r.duration_ms for r in rules) / 1000
        )
        for r in rules:
            case = _element(suite, "testcase", classname=shape, name=r.name, file=r.file, line=r.line, time=r.duration_ms / 1000)
            if r.status == "failed":
                _element(case, "failure", "\n".join(excerpt(r)), type=r.severity, message=f"{r.constraint}: {r.violation_count}")
            elif r.status in ("error", "timeout"):
                _element(case, "error", r.status_reason, type=r.status, message=r.status_reason or SECTIONS[r.status])
            elif r.status == "skipped":
                _element(case, "skipped", message=r.status_reason or SECTIONS["skipped"])
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True) + "\n"


class _Sarif:
    def __init__(self, report: Report):
        self.report = report
        self.index = {r.rule_id: k for k, r in enumerate(report.rules)}

    def descriptor(self, r: RuleResult) -> dict:
        about = {"shape": r.shape, "constraint": r.constraint} | ({"path": r.path} if r.path else {})
        return {"id": r.rule_id, "name": r.name, "shortDescription": {"text": r.message}, "defaultConfiguration": {"level": _SARIF_LEVELS[r.severity]}, "properties": about}

    def result(self, r: RuleResult, violation: dict | None) -> dict:
        region = {"physicalLocation": {"artifactLocation": {"uri": r.file.replace("\\", "/")}, "region": {"startLine": r.line}}}
        out = {"ruleId": r.rule_id, "ruleIndex": self.index[r.rule_id], "kind": "fail", "level": _SARIF_LEVELS[r.severity], "locations": [region], "occurrenceCount": 1}
        if violation is None:  # the runner lists none
            return out | {"message": {"text": f"{r.name}: {r.violation_count} violations"}, "occurrenceCount": max(1, r.violation_count or 1)}
        label, key = focus_name(violation["focus"])
        region["logicalLocations"] = [{"name": key, "kind": "element", "fullyQualifiedName": f"{label}/{key}"}]
        extra = {k: violation[k] for k in ("focus", "value", "details") if violation[k]}
        return out | {"message": {"text": violation["message"]}, "properties": extra}

    def notification(self, r: RuleResult) -> dict:
        return {"level": "error", "message": {"text": r.status_reason or SECTIONS[r.status]}, "associatedRule": {"id": r.rule_id, "index": self.index[r.rule_id]}}

    def log(self) -> dict:
        rules = self.report.rules
        broken = [self.notification(r) for r in rules if r.status in ("error", "timeout")]
        found = [self.result(r, v) for r in rules if r.status == "failed" for v in r.violations or [None]]
        driver = {"name": TOOL, "semanticVersion": VERSION, "rules": [self.descriptor(r) for r in rules]}
        run = {"tool": {"driver": driver}, "results": found, "invocations": [{"executionSuccessful": not broken, "toolExecutionNotifications": broken}]}
        return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}


def sarif(report: Report) -> dict:
    return _Sarif(report).log()


def sarif_parts(data: dict) -> tuple[str, str, Callable[[dict, dict], dict]]:
    """For results that are written one after the other: the log's text before and after them, and what makes one of
    a rule's and a violation's JSON. ``data``: a report's JSON."""
    rules = [
        RuleResult(r["name"], r["ruleId"], r["shape"], r["path"], r["constraint"], r["severity"], r["status"], r["message"], r["source"]["file"], r["source"]["line"], r["statusReason"], r["violationCount"])
        for r in data["rules"]
    ]
    made, by = _Sarif(Report(rules, 0)), {r.rule_id: r for r in rules}
    log = made.log()
    log["runs"][0]["results"] = []
    before, after = json.dumps(log, ensure_ascii=False).split('"results": []')
    return f'{before}"results": [', f"]{after}\n", lambda r, v: made.result(by[r["ruleId"]], v)


def _json(data: dict) -> str:
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"


FORMATS = {"table": table, "json": lambda r: _json(r.to_dict()), "junit": junit, "sarif": lambda r: _json(sarif(r))}


def render(report: Report, form: str = "table") -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown report format {form!r}")
    return FORMATS[form](report)
