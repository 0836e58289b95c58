"""Column names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")
