"""Command line: compile, validate, plan, schema."""

from __future__ import annotations

import argparse
import json
import sys
from contextlib import nullcontext
from pathlib import Path

from .errors import WardenError
from .plans.lower import Options
from .plans.manifest import compile_shapes, load_manifest, read_snapshot
from .report import render
from .runner import exit_code, plans_text, validate
from . import sink
from .sink import store
from .sources.graph import load_graph
from .sources.ntriples import project, read


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphwarden", description="Checks property graphs in DataFrames against SHACL shapes.")
    commands = top.add_subparsers(dest="command", required=True)

    def shapes(p: argparse.ArgumentParser, many: str) -> None:
        p.add_argument("shapes", nargs=many)
        p.add_argument("--ontology", action="append", default=[])
        p.add_argument("--schema", help="schema snapshot (JSON)")
        p.add_argument("--node-key")
        p.add_argument("--labels", choices=["explicit", "inherited"], default="explicit")
        p.add_argument("--max-path-depth", type=int, default=10)
        p.add_argument("--annotations", help="namespace IRI of the mapping annotations")
        for flag in ("strict", "lenient", "verbose", "fail-on-schema-mismatch", "allow-remote-imports"):
            p.add_argument(f"--{flag}", action="store_true")
        p.add_argument("-o", "--output")

    shapes(commands.add_parser("compile", help="write the manifest of the rules"), "+")
    run = commands.add_parser("validate", help="run rules on a graph")
    shapes(run, "*")
    run.add_argument("--graph", required=True, help="graph configuration (JSON)")
    run.add_argument("--manifest")
    run.add_argument("--format", choices=["table", "json", "junit", "sarif"], default="table")
    run.add_argument("--limit", type=int, default=100, help="violations listed for each rule; 0: all")
    run.add_argument("--sample-size", type=int, default=5)
    run.add_argument("--timeout", type=float)
    run.add_argument("--store", metavar="FOLDER", help="write all violations as a table there; json and sarif are streamed from it")
    run.add_argument("--workers", type=int, default=1, help="groups of rules that run at the same time")
    run.add_argument("--fail-on", choices=["violation", "warning", "info"], default="violation")
    plan = commands.add_parser("plan", help="print the physical plan of each group of rules")
    shapes(plan, "+")
    plan.add_argument("--graph", required=True)
    dump = commands.add_parser("schema", help="print a graph's schema snapshot")
    dump.add_argument("--graph", required=True)
    dump.add_argument("--observed", action="store_true", help="also the types that occur in properties without a declared one, and the labels at which relationships start and end (reads the data)")
    dump.add_argument("-o", "--output")
    load = commands.add_parser("import", help="turn N-Triples into node and relationship tables and write their graph configuration")
    load.add_argument("triples", nargs="+")
    load.add_argument("--folder", required=True, help="where the tables go; a folder that the cluster shares")
    load.add_argument("--drop-malformed", action="store_true")
    load.add_argument("-o", "--output", help="the graph configuration (JSON)")
    return top


def _options(a: argparse.Namespace) -> Options:
    return Options(
        node_key=a.node_key, strict=a.strict, lenient=a.lenient, max_path_depth=a.max_path_depth, inherited_labels=a.labels == "inherited", verbose=a.verbose,
        fail_on_schema_mismatch=a.fail_on_schema_mismatch, allow_remote_imports=a.allow_remote_imports, annotations=a.annotations,
    )


def _fetch(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as reply:
        return reply.read((16 << 20) + 1).decode("utf-8")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("graphwarden").getOrCreate()


def _write(text: str, to: str | None) -> None:
    if to:
        Path(to).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "compile":
            schema = read_snapshot(a.schema) if a.schema else None
            _write(compile_shapes(a.shapes, schema, _options(a), a.ontology, _fetch).to_json(), a.output)
            return 0
        if a.command == "import":
            spark = _session()
            config = project(spark, read(spark, a.triples, "DROPMALFORMED" if a.drop_malformed else "FAILFAST"), a.folder)
            _write(json.dumps(config, indent=2) + "\n", a.output)
            return 0
        graph = load_graph(_session(), a.graph)
        if a.command == "schema":
            text = graph.snapshot().to_json()
            _write((json.dumps({"schema": json.loads(text), "observedTypes": graph.observed(), "observedEndpoints": graph.observed_endpoints()}, indent=2) if a.observed else text) + "\n", a.output)
            return 0
        if a.command == "plan":
            schema = read_snapshot(a.schema) if a.schema else graph.snapshot()
            _write(plans_text(graph, compile_shapes(a.shapes, schema, _options(a), a.ontology, _fetch)), a.output)
            return 0
        if bool(a.manifest) == bool(a.shapes):
            raise WardenError("give either shape files or a manifest")
        schema = read_snapshot(a.schema) if a.schema else graph.snapshot()
        compiled = load_manifest(Path(a.manifest).read_text(encoding="utf-8"), schema) if a.manifest else compile_shapes(a.shapes, schema, _options(a), a.ontology, _fetch)
        if a.store:
            report = store(graph, compiled, a.store, a.sample_size, a.timeout, a.workers)
            if a.format in sink.FORMATS:
                with open(a.output, "w", encoding="utf-8") if a.output else nullcontext(sys.stdout) as out:
                    sink.stream(graph.spark, compiled, a.store, a.format, out.write)
            else:
                _write(render(report, a.format), a.output)
            return exit_code(report, a.fail_on)
        report = validate(graph, compiled, a.limit or None, a.sample_size, a.timeout, a.workers)
        _write(render(report, a.format), a.output)
        return exit_code(report, a.fail_on)
    except (WardenError, OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1 if a.command == "compile" else 2


if __name__ == "__main__":
    sys.exit(main())
