"""Graph files whose sources have no path: JDBC with partition bounds, Python data sources, database drivers."""

import json
import sqlite3
from pathlib import Path

import pytest

from graphwarden import Document, Options, compile_shapes, validate
from graphwarden.errors import SourceError
from graphwarden.sources.dbapi import DbApi, Reader, conditions
from graphwarden.sources.graph import load_graph

from test_rules import HEAD, found, shape


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "quarry.db")
    with sqlite3.connect(path) as link:
        link.execute("CREATE TABLE stone (id TEXT, kg INTEGER, kind TEXT)")
        link.executemany("INSERT INTO stone VALUES (?, ?, ?)", [(f"s{i}", None if i % 10 == 0 else i, "basalt" if i % 3 else None) for i in range(100)])
    return path


def spec(database, **more):
    options = {"module": "sqlite3", "connect": {"database": database}, "dbtable": "stone", **more}
    return {"label": "Item", "format": "dbapi", "options": options, "schema": "id string, kg int, kind string"}


def test_partitions_cover_all_rows(spark, database):
    bounds = {"partitionColumn": "kg", "lowerBound": 20, "upperBound": 60, "numPartitions": 4}
    graph = load_graph(spark, {"nodes": [spec(database, **bounds)]})
    df = graph.nodes[0].df
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100 and df.where("kg IS NULL").count() == 10
    one = load_graph(spark, {"nodes": [spec(database, fetchsize=7)]}).nodes[0].df
    assert one.rdd.getNumPartitions() == 1 and sorted(one.collect()) == sorted(df.collect())
    query = spec(database, query="SELECT id, kg, kind FROM stone WHERE kg > 90")
    del query["options"]["dbtable"]
    assert load_graph(spark, {"nodes": [query]}).nodes[0].df.count() == 9


def test_rules_over_a_database(spark, database, tmp_path):
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [spec(database, partitionColumn="kg", lowerBound=0, upperBound=100, numPartitions=3)]}))
    graph = load_graph(spark, str(tmp_path / "graph.json"))
    compiled = compile_shapes([Document("s.ttl", HEAD + shape("sh:property [ sh:path ex:kg ; sh:minCount 1 ; sh:maxInclusive 96 ]"))], graph.snapshot(), Options())
    assert found(validate(graph, compiled)) == {"ex:S/ex:kg/sh:minCount": sorted(f"s{i}" for i in range(0, 100, 10)), "ex:S/ex:kg/sh:maxInclusive": ["s97", "s98", "s99"]}


def test_jdbc_without_a_path(spark):
    url = "jdbc:derby:memory:quay;create=true"
    options = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(40).selectExpr("id", "id % 7 AS depth").write.format("jdbc").options(**options, dbtable="BERTH").mode("overwrite").save()
    node = {"label": "Item", "format": "jdbc", "key": "id", "options": {**options, "dbtable": "BERTH", "partitionColumn": "id", "lowerBound": 0, "upperBound": 40, "numPartitions": 4}}
    graph = load_graph(spark, {"nodes": [node]})
    assert graph.nodes[0].df.rdd.getNumPartitions() == 4 and graph.nodes[0].df.count() == 40
    compiled = compile_shapes([Document("s.ttl", HEAD + shape("sh:property [ sh:path ex:depth ; sh:maxExclusive 6 ]"))], graph.snapshot())
    assert found(validate(graph, compiled)) == {"ex:S/ex:depth/sh:maxExclusive": ["13", "20", "27", "34", "6"]}


def test_registered_source(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("tides.py")))  # executors import the class
    df = load_graph(spark, {"nodes": [{"label": "Item", "source": "tides:Tides", "key": "id"}]}).nodes[0].df
    assert df.rdd.getNumPartitions() == 3 and df.count() == 15


@pytest.mark.parametrize(
    "node", [{"label": "Item"}, {"label": "Item", "source": "no.such.module:X"}, {"label": "Item", "source": "tides:Nope"}, {"label": "Item", "format": "nope", "options": {}}, {"label": "Item", "format": "dbapi", "options": {"module": "sqlite3", "dbtable": "x"}}]
)
def test_errors_name_the_source(spark, node):
    with pytest.raises(SourceError, match="can't open"):
        load_graph(spark, {"nodes": [node]})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_conditions_meet_every_value_once(n):
    with sqlite3.connect(":memory:") as link:
        for v in [*range(-5, 30), None]:
            assert sum(link.execute(f"SELECT count(*) FROM (SELECT {'NULL' if v is None else v} AS c) WHERE {c or '1'}").fetchone()[0] for c in conditions("c", 0, 25, n)) == 1


def test_options_belong_together():
    schema = DbApi({}).schema
    with pytest.raises(SourceError):
        schema()
    from pyspark.sql.types import StructType

    with pytest.raises(SourceError):
        Reader(StructType(), {"module": "sqlite3"})
    with pytest.raises(SourceError):
        Reader(StructType(), {"module": "sqlite3", "dbtable": "t", "numPartitions": "3"}).partitions()
