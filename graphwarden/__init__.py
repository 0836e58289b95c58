"""Shape validation of property graphs held in Spark DataFrames."""

from .database import Database
from .errors import ClosedError, CompileError, ManifestError, SourceError, WardenError
from .operators.rules import Engine
from .plans.lower import Options
from .plans.manifest import Compilation, compile_shapes, load_manifest
from .report import render
from .runner import Report, exit_code, validate
from .sources.graph import NodeTable, PropertyGraph, RelTable, load_graph
from .sources.schema import Snapshot
from .sources.shapes import Document

__all__ = [
    "ClosedError", "CompileError", "Compilation", "Database", "Document", "Engine", "ManifestError", "NodeTable", "Options", "PropertyGraph", "RelTable", "Report", "Snapshot", "SourceError", "WardenError",
    "compile_shapes", "exit_code", "load_graph", "load_manifest", "render", "validate",
]
