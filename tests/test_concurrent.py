"""Groups of rules at the same time: they overlap, limits hit one, the caller's tag cancels all."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from graphwarden import Document, NodeTable, PropertyGraph, compile_shapes, validate
from graphwarden.jobs import at_once

from test_rules import HEAD, found


@pytest.fixture(scope="module")
def slow(spark):
    """Two tables that take their time (Slow: seconds for each row), and a fast one."""
    rows = spark.range(0, 3, 1, 1).selectExpr("cast(id as string) AS id", "id AS size")
    late = F.udf(lambda x: (time.sleep(0.7), x)[1], "long").asNondeterministic()
    return PropertyGraph([NodeTable("Quick", rows), NodeTable("Left", rows.withColumn("size", late("size"))), NodeTable("Right", rows.withColumn("size", late("size")))])


def shapes(*labels):
    return HEAD + "".join(f"ex:{x}S sh:targetClass ex:{x} ; sh:property [ sh:path ex:size ; sh:maxInclusive 1 ] .\n" for x in labels)


def test_same_report_for_any_number_of_workers(spark, slow):
    compiled = compile_shapes([Document("s.ttl", shapes("Quick", "Left", "Right"))], slow.snapshot())
    one, many = (validate(slow, compiled, workers=n) for n in (1, 3))
    assert found(one) == found(many) == {f"ex:{x}S/ex:size/sh:maxInclusive": ["2"] for x in ("Quick", "Left", "Right")}
    times = lambda r: {x.rule_id: x.duration_ms for x in r.rules}
    assert many.duration_ms < 0.8 * sum(times(many).values())  # they overlapped


def test_a_limit_hits_one_group(spark, slow):
    compiled = compile_shapes([Document("s.ttl", shapes("Quick", "Left"))], slow.snapshot())
    report = validate(slow, compiled, workers=2, timeout=1.0)
    assert {r.rule_id[3:-len("S/ex:size/sh:maxInclusive")]: r.status for r in report.rules} == {"Quick": "failed", "Left": "timeout"}


def test_the_callers_tag_cancels_all(spark, slow):
    compiled = compile_shapes([Document("s.ttl", shapes("Left", "Right"))], slow.snapshot())
    spark.sparkContext.addJobTag("caller")
    stop = threading.Timer(0.6, lambda: spark.sparkContext.cancelJobsWithTag("caller"))
    stop.start()
    try:
        report = validate(slow, compiled, workers=2)
    finally:
        stop.cancel()
        spark.sparkContext.removeJobTag("caller")
    assert {r.status for r in report.rules} == {"error"}


def test_errors_come_out_and_pools_differ(spark):
    seen, spare = [], spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    def call(k):
        seen.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        time.sleep(0.2)
        if k == 2:
            raise KeyError(k)

    with pytest.raises(KeyError):
        at_once(spark, [lambda k=k: call(k) for k in range(4)], 2)
    assert set(seen) == {"graphwarden-0", "graphwarden-1"} and len(seen) == 4
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == spare
