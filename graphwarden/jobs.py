"""Spark jobs with limits of time, and several at a time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Limit:
    """Cancels the Spark jobs of a block that runs too long."""

    def __init__(self, spark, seconds: float | None):
        self.sc, self.seconds, self.tag, self.hit = spark.sparkContext, seconds, f"graphwarden-{uuid.uuid4().hex}", False

    def __enter__(self):
        if self.seconds:
            self.sc.addJobTag(self.tag)
            self.timer = threading.Timer(self.seconds, self._stop)
            self.timer.start()
        return self

    def _stop(self) -> None:
        self.hit = True  # before the jobs end: who waits for them asks for it
        self.sc.cancelJobsWithTag(self.tag)

    def __exit__(self, *_) -> None:
        if self.seconds:
            self.timer.cancel()
            self.sc.removeJobTag(self.tag)

    def check(self) -> None:
        """Raises if time is up: jobs that start after the limit are not cancelled by it."""
        if self.hit:
            raise TimeoutError("time is up")


def at_once(spark: SparkSession, calls: list[Callable[[], None]], workers: int) -> None:
    """Run calls that start Spark jobs from some threads, each in a scheduler pool of its own; the first error is
    raised when all have ended."""
    if workers <= 1 or len(calls) < 2:
        for call in calls:
            call()
        return
    inherit = inheritable_thread_target(spark)

    def pooled(k: int, call: Callable[[], None]) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"graphwarden-{k % workers}")
        call()

    with ThreadPoolExecutor(workers) as pool:
        for done in [pool.submit(inherit(lambda k=k, call=call: pooled(k, call))) for k, call in enumerate(calls)]:
            done.result()
