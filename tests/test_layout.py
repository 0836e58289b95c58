"""Bucketed tables: joins along paths without an exchange, hubs left alone, the same rows as before."""

import pytest
from pyspark.sql import functions as F

from graphwarden import Document, Engine, NodeTable, PropertyGraph, RelTable, compile_shapes
from graphwarden.layout import rewrite, ways_of

from test_rules import HEAD

TEXT = HEAD + """ex:S sh:targetClass ex:Ship ; sh:property [ sh:path ex:carries ; sh:minCount 2 ; sh:maxCount 3 ] . ex:T sh:targetClass ex:Load ; sh:property [ sh:path [ sh:inversePath ex:carries ] ; sh:minCount 1 ] ."""


@pytest.fixture(scope="module")
def fleet(spark):
    ships, loads = spark.range(300).selectExpr("cast(id as int) AS id"), spark.range(500)
    carries = spark.range(900).selectExpr("cast(id * 7 % 280 as int) AS src", "id * 13 % 450 AS dst")
    return PropertyGraph([NodeTable("Ship", ships), NodeTable("Load", loads), NodeTable("Other", loads)], [RelTable("CARRIES", "Ship", "Load", carries)])


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_without_an_exchange(spark, fleet, without_broadcasts, tmp_path):
    compiled = compile_shapes([Document("s.ttl", TEXT)], fleet.snapshot())
    assert ways_of(compiled) == {"CARRIES": {True, False}}
    laid = rewrite(fleet, compiled, str(tmp_path), buckets=5)
    plan = lambda graph, rule: Engine(graph).violations(rule)._jdf.queryExecution().executedPlan().toString()
    rows = lambda graph, rule: sorted(r.focus_key for r in Engine(graph).violations(rule).collect())
    counted = 0
    for rule in compiled.rules:
        assert rows(laid, rule) == rows(fleet, rule) and rows(laid, rule)
        assert "Exchange" in plan(fleet, rule)
        if "count(distinct" not in plan(laid, rule):  # nodes joined with relationships
            assert "Exchange" not in plan(laid, rule)
            counted += 1
    assert counted >= 2 and laid.nodes[2].df is fleet.nodes[2].df


def test_hubs_stay_unbucketed(spark, fleet, tmp_path):
    compiled = compile_shapes([Document("s.ttl", TEXT)], fleet.snapshot())
    hub = fleet.rels[0].df.unionAll(spark.range(20_000).select(F.lit(1), F.col("id") % 450))
    graph = PropertyGraph(fleet.nodes, [RelTable("CARRIES", "Ship", "Load", hub)])
    laid = rewrite(graph, compiled, str(tmp_path), buckets=40)
    assert laid.rels[0].df is hub and laid.rels[0].inverse is not None
    count = lambda g: Engine(g).all_violations(compiled.rules).count()
    assert count(laid) == count(graph)


def test_names_and_repeated_rewrites(spark, fleet, tmp_path):
    graph = PropertyGraph([NodeTable("Ship", fleet.nodes[0].df), NodeTable("Lo ad", fleet.nodes[1].df)], [RelTable("CARRIES", "Ship", "Lo ad", fleet.rels[0].df)])
    compiled = compile_shapes([Document("s.ttl", HEAD + "ex:S sh:targetClass ex:Ship ; sh:property [ sh:path ex:carries ; sh:minCount 2 ] .")], graph.snapshot())
    for _ in range(2):
        again = rewrite(graph, compiled, str(tmp_path / "laid"), buckets=3)
        assert again.rels[0].inverse is None and any(t.name.endswith("node_lo_20ad") for t in spark.catalog.listTables()) and (tmp_path / "laid" / "node_lo_20ad").is_dir()
        assert again.nodes[1].df.count() == 500 and Engine(again).all_violations(compiled.rules).count() == Engine(graph).all_violations(compiled.rules).count()
