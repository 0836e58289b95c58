"""Decontamination over many shards: one Python worker a task, the same rows; what the operators leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from graphwarden.llm import decontam, jaccard, storage


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")


def test_many_shards_like_one(spark, tables):
    docs, bench = tables
    rows = lambda df: sorted(str((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.hits)) for r in df.collect())
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] // 12
    parts = decontam.Shards(bench, shard_bytes=size)
    assert len(parts) >= 10
    many = decontam.contamination(docs, bench, shard_bytes=size)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1  # one worker a task: each pass was written
    assert rows(many) == rows(decontam.contamination(docs, bench))


def test_rounds_over_shards_like_one_pass(spark, tables):
    docs, bench = tables
    kept = lambda df: sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
    assert kept(decontam.decontaminate(docs, bench, shard_bytes=3000)) == kept(decontam.decontaminate(docs, bench))


@pytest.mark.parametrize("name", ["op2", "op2 shards", "op6"])
def test_only_what_the_result_reads_stays(spark, tables, name):
    docs, bench = tables
    before = storage.written()
    run = {"op2": lambda: decontam.report(docs, bench), "op2 shards": lambda: decontam.contamination(docs, bench, shard_bytes=5000), "op6": lambda: jaccard.classes(docs)}
    out = run[name]()
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in storage._written[before:]}
    assert left <= {"op2": set(), "op2 shards": {"marked"}, "op6": {"sets", "classes"}}[name]
    assert out.count() == docs.count()
    storage.clear(spark, before)
