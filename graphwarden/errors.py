"""Errors of the package."""

from __future__ import annotations


class WardenError(Exception):
    """Base class."""


class CompileError(WardenError):
    """Everything that is wrong with the shapes, one message for each problem."""

    def __init__(self, problems: list[str] | str):
        self.problems = [problems] if isinstance(problems, str) else list(problems)
        super().__init__("\n".join(self.problems))


class ManifestError(WardenError):
    """A manifest that can't be used."""


class SourceError(WardenError):
    """A graph, table or file that can't be opened."""


class ClosedError(WardenError):
    """A call on a database that was closed."""
