"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and the executors
    are threads of this machine (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphwarden-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts the lineage, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = df._written_at
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def written() -> int:
    """How many intermediate tables there are: a mark for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the intermediate tables of this process (those written after the mark ``since``), once no result
    that reads them is needed; the materialized table ``but`` stays."""
    spared = [p for p in _written[since:] if but is not None and p == but._written_at]
    for path in _written[since:]:
        if path not in spared:
            _delete(spark, path)
    _written[since:] = spared


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
