"""Queries of what surrounds the rules: sources of shapes and graphs, compilation, manifests, reports and the
interfaces. Facts about a compilation are rows whose SQL states them; everything else is computed by both."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .errors import ClosedError
from .layout import rewrite
from .operators.paths import shared_folder
from .operators.rules import Engine
from .plans.lower import Options
from .plans.manifest import compile_shapes, load_manifest
from .report import render, sarif
from .runner import exit_code, validate
from .sink import store, violations
from .sources import ntriples
from .sources.graph import NodeTable, PropertyGraph, RelTable, load_graph
from .sources.retail import retail_graph
from .sources.schema import Snapshot
from .sources.shapes import Document

Query = Callable[[SparkSession, str], DataFrame]
PREFIXES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.org/> . @prefix w: <urn:graphwarden:annotation#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
"""
SHAPES = Path(__file__).with_name("shapes")
_FOUND = ["rule_id", "focus_label", "focus_key"]


def _document(body: str, name: str = "shapes.ttl", syntax: str = "ttl") -> Document:
    return Document(name, body if syntax == "nt" else PREFIXES + body, syntax)


def _property(label: str, path: str, body: str, extra: str = "") -> str:
    return f"ex:S sh:targetClass ex:{label} ; {extra} sh:property [ sh:path {path} ; {body} ] ."


def _violations(spark: SparkSession, sf_dir: str, documents: list, columns: list[str] = _FOUND, graph: PropertyGraph | None = None, schema: Snapshot | None = None, ontology: list | None = None, **options) -> DataFrame:
    graph = graph or retail_graph(spark, sf_dir)
    c = compile_shapes(documents, schema or graph.snapshot(), Options(**options), ontology)
    return Engine(graph, c.options.node_key, c.options.verbose).all_violations(c.rules).select(*columns)


def _facts(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(columns: str, *rows: tuple) -> str:
    """SQL of fixed rows."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _found(rule: str, label: str, key: str, rest: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{label}' AS focus_label, CAST({key} AS VARCHAR) AS focus_key {rest}"


QUERIES: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# -- sources of shapes
_NT = """<http://example.org/S> <http://www.w3.org/ns/shacl#targetClass> <http://example.org/Part> .
<http://example.org/S> <http://www.w3.org/ns/shacl#property> _:p .
_:p <http://www.w3.org/ns/shacl#path> <http://example.org/p_size> .
_:p <http://www.w3.org/ns/shacl#minInclusive> "10"^^<http://www.w3.org/2001/XMLSchema#integer> .
"""


@query(_found("<http://example.org/S>/<http://example.org/p_size>/sh:minInclusive", "Part", "p_partkey", "FROM part WHERE p_size < 10"))
def source_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, [_document(_NT, "shapes.nt", "nt")])


@query(_found("ex:S/ex:p_size/sh:maxInclusive", "Part", "p_partkey", "FROM part WHERE p_size > 40") + " UNION ALL " + _found("ex:T/ex:c_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 0"))
def source_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "ex:g1 { " + _property("Part", "ex:p_size", "sh:maxInclusive 40") + " }\nGRAPH ex:g2 { ex:T sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] . }"
    return _violations(spark, sf_dir, [_document(text, "shapes.trig", "trig")])


@query(_found("ex:Orders/ex:o_orderstatus/sh:in", "Order", "o_orderkey", "FROM orders WHERE o_orderstatus NOT IN ('O', 'F')") + " UNION ALL "
       + _found("ex:Orders/ex:placedBy/sh:node", "Order", "o_orderkey", "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -500") + " UNION ALL "
       + _found("ex:S/ex:p_size/sh:minExclusive", "Part", "p_partkey", "FROM part WHERE p_size <= 3"))
def source_files_and_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file, what it imports, and a document, taken together."""
    return _violations(spark, sf_dir, [str(SHAPES / "orders.ttl"), _document(_property("Part", "ex:p_size", "sh:minExclusive 3"))])


_PARTY = _found("ex:S/ex:c_acctbal|ex:s_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 100") + " UNION ALL " + _found("ex:S/ex:c_acctbal|ex:s_acctbal/sh:minInclusive", "Supplier", "s_suppkey", "FROM supplier WHERE s_acctbal < 100")


@query(_PARTY)
def source_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclasses stated in a file of their own."""
    own = _document("ex:Customer rdfs:subClassOf ex:Party . ex:Supplier rdfs:subClassOf ex:Party .", "classes.ttl")
    return _violations(spark, sf_dir, [_document(_property("Party", "[ sh:alternativePath (ex:c_acctbal ex:s_acctbal) ]", "sh:minInclusive 100"))], ontology=[own])


@query(_found("ex:S/ex:c_mktsegment/sh:maxLength", "Customer", "c_custkey", "FROM customer WHERE length(c_mktsegment) > 9"))
def source_schema_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled against a snapshot that was written as JSON and read again."""
    schema = Snapshot.from_json(retail_graph(spark, sf_dir).snapshot().to_json())
    return _violations(spark, sf_dir, [_document(_property("Customer", "ex:c_mktsegment", "sh:maxLength 9"))], schema=schema)


def _configured(sf_dir: str) -> dict:
    """A graph from a file, SQL queries and options of the reader."""
    return {
        "nodes": [
            {"label": "Customer", "path": f"{sf_dir}/customer.parquet", "key": "c_custkey", "format": "parquet", "options": {"mergeSchema": "false"}},
            {"label": "Nation", "sql": f"SELECT n_nationkey, upper(n_name) AS n_name FROM parquet.`{sf_dir}/nation.parquet`", "key": "n_nationkey"},
        ],
        "rels": [{"type": "IN_NATION", "from": "Customer", "to": "Nation", "sql": f"SELECT c_custkey, c_nationkey FROM parquet.`{sf_dir}/customer.parquet` WHERE c_acctbal > 0", "src": "c_custkey", "dst": "c_nationkey"}],
    }


@query(_found("ex:S/ex:inNation/sh:minCount", "Customer", "c_custkey", "FROM customer WHERE c_acctbal <= 0"))
def source_configured_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, [_document(_property("Customer", "ex:inNation", "sh:class ex:Nation ; sh:minCount 1"))], graph=load_graph(spark, _configured(sf_dir)))


_PART = {"any": "ANY", "p_brand": "STRING", "p_name": "STRING", "p_partkey": "INT64", "p_retailprice": "DOUBLE", "p_size": "INT32", "p_type": "STRING"}


@query(_values("name, type", *_PART.items(), ("observed", "BIGINT,DOUBLE,STRING")))
def schema_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of parts in the snapshot, and the types that occur in the one without a type."""
    graph = retail_graph(spark, sf_dir)
    data = json.loads(graph.snapshot().to_json())
    part = next(n for n in data["nodeTypes"] if n["name"] == "Part")
    return _facts(spark, [(p["name"], p["type"]) for p in part["properties"]] + [("observed", ",".join(graph.observed()["Part.any"]))], "name string, type string")


@query("SELECT 'BY_USER' AS type, CASE WHEN user_id <= 40 THEN 'Few' WHEN user_id IN (SELECT c_custkey FROM customer) THEN 'Customer' END AS \"to\", count(*) AS n FROM events GROUP BY ALL")
def observed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels at which relationships end, beside the declared one: the first forty customers are a table of their own."""
    customer, events = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("customer", "events"))
    nodes = [NodeTable("Customer", customer.where("c_custkey > 40"), "c_custkey"), NodeTable("Few", customer.where("c_custkey <= 40"), "c_custkey"), NodeTable("Event", events.withColumn("event_id", F.concat(F.lit("e"), "event_id")), "event_id")]
    graph = PropertyGraph(nodes, [RelTable("BY_USER", "Event", "Customer", events.select(F.concat(F.lit("e"), "event_id").alias("src"), F.col("user_id").alias("dst")))])
    return _facts(spark, [(x["type"], x["to"], x["rows"]) for x in graph.observed_endpoints()], "type string, to string, n long")


# -- paths, targets and mappings
@query(_found("ex:S/ex:inRegion|^ex:inNation/sh:maxCount", "Nation", "n_nationkey", "FROM nation WHERE 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 60"))
def path_many_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alternative whose routes run in two directions to three labels."""
    return _violations(spark, sf_dir, [_document(_property("Nation", "[ sh:alternativePath (ex:inRegion [ sh:inversePath ex:inNation ]) ]", "sh:maxCount 60"))])


@query(_found("ex:S/ex:balance/sh:minInclusive", "Supplier", "s_suppkey", "FROM supplier WHERE s_acctbal < 0") + " UNION ALL " + _found("ex:S/ex:home/sh:maxCount", "Supplier", "s_suppkey", "FROM supplier"))
def mapping_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, property, relationship and direction by annotation."""
    text = 'ex:Vendor w:label "Supplier" . ex:balance w:property "s_acctbal" . ex:home w:relationship "IN_NATION" ; w:direction "out" . ex:S sh:targetClass ex:Vendor ; sh:property [ sh:path ex:balance ; sh:minInclusive 0 ] ; sh:property [ sh:path ex:home ; sh:class ex:Nation ; sh:maxCount 0 ] .'
    return _violations(spark, sf_dir, [_document(text)])


@query("SELECT 'ex:S/ex:c_acctbal/sh:minInclusive' AS rule_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Builder' ELSE 'Debtor' END AS focus_label, CAST(c_custkey AS VARCHAR) AS focus_key FROM customer WHERE c_acctbal < 0 AND (c_acctbal < -500 OR c_mktsegment = 'BUILDING')")
def focus_label_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a node with several labels the first targeted one names the focus; targets are ordered by name."""
    carried = F.array_compact(F.array(F.lit("Client"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Builder")), F.when(F.col("c_acctbal") < -500, F.lit("Debtor"))))
    clients = NodeTable("Client", spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("carried", carried), "c_custkey", "carried")
    text = 'ex:S sh:targetClass ex:Debtor , ex:Builder ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] . ex:Debtor w:label "Debtor" . ex:Builder w:label "Builder" .'
    return _violations(spark, sf_dir, [_document(text)], graph=PropertyGraph([clients]))


# -- rows of violations
@query("SELECT 'ex:S/ex:p_size/sh:maxInclusive' AS rule_id, CAST(p_partkey AS VARCHAR) AS focus_key, 'part ' || p_partkey || ' is ' || p_size || ' long' AS message FROM part WHERE p_size > 44")
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, [_document(_property("Part", "ex:p_size", 'sh:maxInclusive 44 ; sh:message "part {$this} is {?value} long"'))], ["rule_id", "focus_key", "message"])


@query("SELECT CAST(s_nationkey AS VARCHAR) AS focus_key, CAST(s_suppkey AS VARCHAR) AS value, 'Supplier' AS value_label, s_name AS value_key FROM supplier")
def value_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are nodes come with their label and key."""
    text = 'ex:S sh:targetClass ex:Nation ; w:key "n_nationkey" ; sh:property [ sh:path [ sh:inversePath ex:inNation ] ; sh:class ex:Customer ] .'
    return _violations(spark, sf_dir, [_document(text)], ["focus_key", "value", "value_label", "value_key"], node_key="s_name")


@query("SELECT 'CONTAINS' AS focus_label, CAST(l_orderkey AS VARCHAR) AS focus_start, CAST(l_partkey AS VARCHAR) AS focus_end, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY ALL")
def relationship_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship is named by its type and the keys of both ends; parallel ones are foci of their own."""
    text = 'ex:S w:targetRelationship "CONTAINS" ; sh:property [ sh:path ex:l_discount ; sh:maxInclusive 0.08 ] .'
    ends = ["focus_label", "focus_start", "focus_end"]
    return _violations(spark, sf_dir, [_document(text)], ends).groupBy(*ends).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS focus_key, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS properties FROM nation WHERE n_regionkey <> 1")
def keys_and_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focus by the key that an annotation names, and all its properties."""
    return _violations(spark, sf_dir, [_document(_property("Nation", "ex:n_regionkey", "sh:in (1)", 'w:key "n_name" ;'))], ["focus_key", "properties"], verbose=True)


@query(_found("ex:S/ex:age/sh:maxInclusive", "Order", "o_orderkey", "FROM orders WHERE o_orderdate - TIMESTAMP '1995-01-01' > INTERVAL 100 DAY") + " UNION ALL " + _found("ex:S/ex:age/sh:minInclusive", "Order", "o_orderkey", "FROM orders"))
def duration_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and months can't be compared: against a bound of the other kind every value is a violation."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("age", F.col("o_orderdate") - F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'"))
    text = _property("Order", "ex:age", 'sh:maxInclusive "P100D"^^xsd:dayTimeDuration ; sh:minInclusive "P1M"^^xsd:yearMonthDuration')
    return _violations(spark, sf_dir, [_document(text)], graph=PropertyGraph([NodeTable("Order", orders, "o_orderkey")]))


# -- structs, maps and lists of structs
def _addressed(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Suppliers with their address as a struct and their accounts as a map, orders with their lines as structs."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    address = F.when(F.col("s_acctbal") > 0, F.struct("s_nationkey", F.struct(F.col("s_name").alias("name"), F.length("s_name").alias("length")).alias("owner")))
    funds = F.map_from_arrays(F.array(F.lit("total"), F.when(F.col("s_nationkey") < 12, F.lit("low")).otherwise(F.lit("high"))), F.array("s_acctbal", F.col("s_acctbal") / 2))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("lines"))
    return PropertyGraph([NodeTable("Supplier", supplier.select("s_suppkey", address.alias("address"), funds.alias("funds")), "s_suppkey"), NodeTable("Order", lines, "l_orderkey")])


@query(_found("ex:S/ex:address/ex:s_nationkey/sh:maxInclusive", "Supplier", "s_suppkey", "FROM supplier WHERE s_acctbal > 0 AND s_nationkey > 20") + " UNION ALL "
       + _found("ex:S/ex:address/ex:owner/ex:name/sh:pattern", "Supplier", "s_suppkey", "FROM supplier WHERE s_acctbal > 0 AND NOT regexp_matches(s_name, '[02468]$')"))
def struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of structs, also of structs within structs, read by their way."""
    text = 'ex:S sh:targetClass ex:Supplier ; sh:property [ sh:path (ex:address ex:s_nationkey) ; sh:maxInclusive 20 ] ; sh:property [ sh:path (ex:address ex:owner ex:name) ; sh:pattern "[02468]$" ] .'
    return _violations(spark, sf_dir, [_document(text)], graph=_addressed(spark, sf_dir))


@query("SELECT rule_id, CAST(k AS VARCHAR) AS focus_key, CAST(value AS VARCHAR) AS value FROM (SELECT 'ex:S/ex:address/sh:minCount' AS rule_id, s_suppkey AS k, NULL AS value FROM supplier WHERE s_acctbal <= 0 "
       "UNION ALL SELECT 'ex:S/ex:address/sh:nodeKind', s_suppkey, '{\"s_nationkey\":' || s_nationkey || ',\"owner\":{\"name\":\"' || s_name || '\",\"length\":' || length(s_name) || '}}' FROM supplier WHERE s_acctbal > 0)")  # fmt: skip
def struct_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole structs: whether there is one, and how one is shown."""
    text = "ex:S sh:targetClass ex:Supplier ; sh:property [ sh:path ex:address ; sh:minCount 1 ; sh:nodeKind sh:IRI ] ."
    return _violations(spark, sf_dir, [_document(text)], ["rule_id", "focus_key", "value"], graph=_addressed(spark, sf_dir))


@query(_found("ex:S/ex:funds/ex:high/sh:maxCount", "Supplier", "s_suppkey", "FROM supplier WHERE s_nationkey >= 12") + " UNION ALL " + _found("ex:S/ex:funds/ex:low/sh:minInclusive", "Supplier", "s_suppkey", "FROM supplier WHERE s_nationkey < 12 AND s_acctbal / 2 < 100"))
def map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a map are properties, absent ones without a value."""
    text = "ex:S sh:targetClass ex:Supplier ; sh:property [ sh:path (ex:funds ex:high) ; sh:maxCount 0 ] ; sh:property [ sh:path (ex:funds ex:low) ; sh:minInclusive 100 ] ."
    return _violations(spark, sf_dir, [_document(text)], graph=_addressed(spark, sf_dir))


@query(_found("ex:S/ex:lines/ex:l_returnflag/sh:maxCount", "Order", "l_orderkey", "FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 2)") + " UNION ALL "
       + _found("ex:S/ex:lines/sh:minCount", "Order", "l_orderkey", "FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_partkey, l_quantity, l_returnflag)) < 4)"))
def listed_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of structs: distinct structs, and the distinct values of one of their fields."""
    text = "ex:S sh:targetClass ex:Order ; sh:property [ sh:path (ex:lines ex:l_returnflag) ; sh:maxCount 2 ] ; sh:property [ sh:path ex:lines ; sh:minCount 4 ] ."
    return _violations(spark, sf_dir, [_document(text)], graph=_addressed(spark, sf_dir))


@query(_found("ex:S/ex:inNation/sh:class", "Customer", "c_custkey", "FROM customer WHERE c_nationkey < 5") + " UNION ALL " + _found("ex:S/ex:c_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < -700"))
def source_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a path: a database driver's query in four partitions, and a table of it in one."""
    read = lambda name, columns, **more: {"format": "dbapi", "schema": columns, "options": {"module": "duckdb", "query": f"SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')", **more}}
    bounds = {"partitionColumn": "c_custkey", "lowerBound": 0, "upperBound": 1500, "numPartitions": 4}
    graph = load_graph(spark, {
        "nodes": [{"label": "Customer", "key": "c_custkey", **read("customer", "c_custkey bigint, c_acctbal double", **bounds)}, {"label": "Nation", "key": "n_nationkey", **read("nation", "n_nationkey bigint, n_name string")}, {"label": "Old", "key": "n_nationkey", **read("nation", "n_nationkey bigint")}],
        "rels": [{"type": "IN_NATION", "from": "Customer", "to": x, "src": "c_custkey", "dst": "c_nationkey", **read("customer", "c_custkey bigint, c_nationkey bigint", query=f"SELECT * FROM read_parquet('{sf_dir}/customer.parquet') WHERE c_nationkey {c} 5")} for x, c in (("Nation", ">="), ("Old", "<"))],
    })
    return _violations(spark, sf_dir, [_document("ex:S sh:targetClass ex:Customer ; sh:property [ sh:path ex:inNation ; sh:class ex:Nation ] ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive -700 ] .")], graph=graph)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS focus_start, l_returnflag AS value, count(*) AS n, count(*) AS ids, count(*) FILTER (k = 1) AS plain FROM "
       "(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_returnflag) AS k FROM lineitem WHERE l_returnflag <> 'N') GROUP BY ALL")  # fmt: skip
def parallel_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal parallel relationships have ids of their own: ``ids`` counts different ones, ``plain`` those without a number."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linestatus", "l_returnflag")
    status = NodeTable("Status", items.select("l_linestatus").distinct(), "l_linestatus")
    graph = PropertyGraph([NodeTable("Order", spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey"), status], [RelTable("HAS", "Order", "Status", items, "l_orderkey", "l_linestatus")])
    rows = _violations(spark, sf_dir, [_document('ex:S w:targetRelationship "HAS" ; sh:property [ sh:path ex:l_returnflag ; sh:in ("N") ] .')], ["focus_start", "value", "focus_id"], graph=graph)
    plain = F.count(F.when(~F.col("focus_id").contains("."), 1))
    return rows.groupBy("focus_start", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("focus_id").alias("ids"), plain.alias("plain"))


@query(_found("ex:S/ex:p_size/sh:maxInclusive", "Part", "p_partkey", "FROM part WHERE p_size > 47"))
def lenient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient: node targets, recursive shapes and language tags are left out, everything else runs."""
    text = "ex:S sh:targetClass ex:Part ; sh:property [ sh:path ex:p_size ; sh:maxInclusive 47 ; sh:uniqueLang true ] . ex:R sh:targetClass ex:Part ; sh:node ex:R . ex:T sh:targetNode ex:p1 ; sh:property [ sh:path ex:p_size ; sh:maxCount 0 ] ."
    return _violations(spark, sf_dir, [_document(text)], lenient=True)


@query("SELECT * FROM (SELECT 1 AS place, 'C.c_acctbal.minInclusive' AS name, CAST(c_custkey AS VARCHAR) AS focus_key FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 2, 'P.p_size.maxExclusive', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size >= 40)")
def manifest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written and loaded again, its rules run in their order, strictly named by the schema."""
    graph = retail_graph(spark, sf_dir)
    text = "ex:P sh:targetClass ex:Part ; sh:property [ sh:path ex:p_size ; sh:maxExclusive 40 ] . ex:C sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] ."
    written = compile_shapes([_document(text)], graph.snapshot(), Options(strict=True)).to_json()
    c = load_manifest(written, graph.snapshot())
    place = F.create_map(*(F.lit(x) for k, r in enumerate(c.rules, 1) for x in (r.rule_id, k)))
    return Engine(graph).all_violations(c.rules).select(place[F.col("rule_id")].alias("place"), F.col("rule_name").alias("name"), "focus_key")


# -- triples as data
_TRIPLES = "ex:S sh:targetClass ex:Vendor ; sh:property [ sh:path ex:balance ; sh:minInclusive 0 ] ; sh:property [ sh:path ex:phone ; sh:pattern \"7$\" ; sh:maxCount 0 ] ; sh:property [ sh:path (ex:inNation ex:label) ; sh:in (\"FRANCE\" \"PERU\" \"CHINA\") ] ."


@query("SELECT * FROM (SELECT 'ex:S/ex:balance/sh:minInclusive' AS rule_id, 'v' || s_suppkey AS focus_key FROM supplier WHERE s_acctbal < 0 "
       "UNION ALL SELECT 'ex:S/ex:phone/sh:maxCount', 'v' || s_suppkey FROM supplier UNION ALL SELECT 'ex:S/ex:phone/sh:pattern', 'v' || s_suppkey FROM supplier WHERE NOT s_name LIKE '%7' "
       "UNION ALL SELECT 'ex:S/ex:inNation/ex:label/sh:in', 'v' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN ('FRANCE', 'PERU', 'CHINA'))")  # fmt: skip
def source_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations written as N-Triples, read again as a graph."""
    folder = shared_folder(spark)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("iri", F.concat(F.lit("v"), "s_suppkey"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("iri", F.concat(F.lit("n"), "n_nationkey"))
    ntriples.write(supplier, f"{folder}/supplier", F.col("iri"), "Vendor", {"balance": "s_acctbal", "phone": "s_name"})
    ntriples.write(nation, f"{folder}/nation", F.col("iri"), "Nation", {"label": "n_name"})
    ntriples.write_links(supplier.select("iri", F.concat(F.lit("n"), "s_nationkey").alias("to")), f"{folder}/links", F.col("iri"), "inNation", F.col("to"))
    graph = load_graph(spark, ntriples.project(spark, ntriples.read(spark, [f"{folder}/{x}" for x in ("supplier", "nation", "links")]), f"{folder}/graph"))
    return _violations(spark, sf_dir, [_document(_TRIPLES)], ["rule_id", "focus_key"], graph=graph, node_key="@name")


@query("SELECT 'ex:S/ex:l_discount/sh:maxInclusive' AS rule_id, CAST(l_orderkey AS VARCHAR) AS focus_start, CAST(l_partkey AS VARCHAR) AS focus_end, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL UNION ALL "
       "SELECT 'ex:T/ex:o_totalprice/sh:maxInclusive', NULL, CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_totalprice > 100000")  # fmt: skip
def stored_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations written as a table, twice, and read again."""
    graph, folder = retail_graph(spark, sf_dir), shared_folder(spark)
    text = 'ex:S w:targetRelationship "CONTAINS" ; sh:property [ sh:path ex:l_discount ; sh:maxInclusive 0.05 ] . ex:T sh:targetClass ex:Order ; sh:property [ sh:path ex:o_totalprice ; sh:maxInclusive 100000 ] .'
    c = compile_shapes([_document(text)], graph.snapshot())
    for _ in range(2):
        store(graph, c, folder, workers=2)
    end = F.coalesce("focus_end", "focus_key").alias("focus_end")
    return violations(spark, folder).groupBy("rule_id", "focus_start", end).agg(F.count(F.lit(1)).alias("n"))


@query(_found("ex:S/ex:suppliedBy/sh:maxCount", "Order", "o_orderkey", "FROM orders WHERE (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) > 2") + " UNION ALL "
       + _found("ex:T/^ex:suppliedBy/sh:minCount", "Supplier", "s_suppkey", "FROM supplier WHERE (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) < 300"))
def bucketed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, suppliers and what joins them, rewritten in buckets by the keys that rules join on, both ways."""
    graph = retail_graph(spark, sf_dir)
    text = "ex:S sh:targetClass ex:Order ; sh:property [ sh:path ex:suppliedBy ; sh:class ex:Supplier ; sh:maxCount 2 ] . ex:T sh:targetClass ex:Supplier ; sh:property [ sh:path [ sh:inversePath ex:suppliedBy ] ; sh:minCount 300 ] ."
    some = PropertyGraph([graph.table("Order"), graph.table("Supplier")], [r for r in graph.rels if r.type == "SUPPLIED_BY"])
    c = compile_shapes([_document(text)], some.snapshot())
    return Engine(rewrite(some, c, shared_folder(spark), buckets=8)).all_violations(c.rules).select(*_FOUND)


# -- summaries and reports
_RULES = "ex:S sh:targetClass ex:Customer ; sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ; sh:severity sh:Warning ] ; sh:property [ sh:path ex:c_mktsegment ; sh:maxLength 8 ] ; sh:property [ sh:path ex:c_name ; sh:minCount 1 ] ; sh:property [ sh:path ex:c_custkey ; sh:datatype xsd:long ] ."
_COUNTED = """(SELECT 'ex:S/ex:c_acctbal/sh:minInclusive' AS rule_id, 'Warning' AS severity, count(*) AS n FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'ex:S/ex:c_mktsegment/sh:maxLength', 'Violation', count(*) FROM customer WHERE length(c_mktsegment) > 8
UNION ALL SELECT 'ex:S/ex:c_name/sh:minCount', 'Violation', 0)"""


def _report(spark: SparkSession, sf_dir: str, **more):
    graph = retail_graph(spark, sf_dir)
    return validate(graph, compile_shapes([_document(_RULES)], graph.snapshot()), **more)


@query("""SELECT rule_id, n AS violation_count, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (
    SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE CASE WHEN c.rule_id LIKE '%minInclusive' THEN c_acctbal < 0 WHEN c.rule_id LIKE '%maxLength' THEN length(c_mktsegment) > 8 ELSE false END ORDER BY k LIMIT 3)), '') AS sample
    FROM """ + _COUNTED + " c")  # fmt: skip
def summary_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three foci of each rule, in order, beside its count."""
    graph = retail_graph(spark, sf_dir)
    c = compile_shapes([_document(_RULES)], graph.snapshot())
    return Engine(graph).summary(c.rules, 3).select("rule_id", "violation_count", F.array_join(F.col("sample.key"), ",").alias("sample"))


@query("SELECT name, n FROM (SELECT 'rules' AS name, 4 AS n UNION ALL SELECT 'guaranteedBySchema', 1 UNION ALL SELECT 'passed', count(*) FILTER (n = 0) FROM " + _COUNTED + " UNION ALL SELECT 'failed', count(*) FILTER (n > 0) FROM " + _COUNTED + " UNION ALL SELECT 'violations', CAST(sum(n) AS BIGINT) FROM " + _COUNTED + ")")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _report(spark, sf_dir).summary()
    return _facts(spark, [(k, s[k]) for k in ("rules", "guaranteedBySchema", "passed", "failed", "violations")], "name string, n long")


@query("SELECT rule_id, n, least(n, 4) AS listed, least(n, 2) AS sampled FROM " + _COUNTED)
def report_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _report(spark, sf_dir, limit=4, sample_size=2).rules
    return _facts(spark, [(r.rule_id, r.violation_count, len(r.violations), len(r.sample)) for r in rules if r.status in ("passed", "failed")], "rule_id string, n long, listed long, sampled long")


@query("SELECT rule_id, severity, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, n FROM " + _COUNTED + " UNION ALL SELECT 'ex:S/ex:c_custkey/sh:datatype', 'Violation', 'guaranteed-by-schema', NULL")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = json.loads(render(_report(spark, sf_dir), "json"))["rules"]
    return _facts(spark, [(r["ruleId"], r["severity"], r["status"], r["violationCount"]) for r in rules], "rule_id string, severity string, status string, n long")


@query("SELECT line FROM (SELECT '== violated: ' || count(*) FILTER (n > 0) AS line FROM " + _COUNTED + " UNION ALL SELECT '== kept: ' || count(*) FILTER (n = 0) FROM " + _COUNTED + " UNION ALL SELECT '== settled by the schema: 1') ")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, [(x,) for x in render(_report(spark, sf_dir), "table").splitlines() if x.startswith("== ")], "line string")


@query("SELECT rule_id, severity, split_part(rule_id, '/', 3) || ': ' || n AS message FROM " + _COUNTED + " WHERE n > 0")
def report_junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir)
    ids = {r.name: r.rule_id for r in report.rules}
    found = [(ids[c.get("name")], f.get("type"), f.get("message")) for c in ET.fromstring(render(report, "junit")).iter("testcase") for f in c.iter("failure")]
    return _facts(spark, found, "rule_id string, severity string, message string")


@query("SELECT rule_id, CASE severity WHEN 'Warning' THEN 'warning' ELSE 'error' END AS level, least(n, 100) AS results FROM " + _COUNTED + " WHERE n > 0")
def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = sarif(_report(spark, sf_dir))["runs"][0]
    found = {(x["ruleId"], x["level"]): sum(y["ruleId"] == x["ruleId"] for y in run["results"]) for x in run["results"]}
    return _facts(spark, [(*k, n) for k, n in found.items()], "rule_id string, level string, results long")


@query("SELECT fail_on, CASE WHEN n > 0 THEN 1 ELSE 0 END AS code FROM (SELECT 'warning' AS fail_on, sum(n) AS n FROM " + _COUNTED + " UNION ALL SELECT 'violation', sum(n) FILTER (severity = 'Violation') FROM " + _COUNTED + ")")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir)
    return _facts(spark, [(x, exit_code(report, x)) for x in ("warning", "violation")], "fail_on string, code int")


# -- interfaces
@query("SELECT 'violations' AS what, count(*) AS n FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT 'labels', 2 UNION ALL SELECT 'refused when closed', 1")
def database_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph opened, asked, and closed."""
    with Database.open(spark, _configured(sf_dir)) as db:
        n = db.validate([_document(_property("Customer", "ex:inNation", "sh:class ex:Nation ; sh:minCount 1"))]).summary()["violations"]
        labels = len(db.schema().nodes)
    try:
        db.schema()
        refused = 0
    except ClosedError:
        refused = 1
    return _facts(spark, [("violations", n), ("labels", labels), ("refused when closed", refused)], "what string, n long")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
