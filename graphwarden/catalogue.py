"""Queries of the shape-validation operators over the driver's tables, with the SQL that checks them.

Every query compiles its shapes from Turtle and returns rule_id, severity, focus_label, focus_key,
details and, where values have one textual form everywhere, value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue_surface
from .operators.rules import Engine
from .plans.lower import Options
from .plans.manifest import Compilation, compile_shapes
from .sources.retail import retail_graph
from .sources.shapes import Document

PREFIXES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.org/> . @prefix w: <urn:graphwarden:annotation#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
"""


@dataclass(frozen=True)
class Case:
    shapes: str
    sql: str
    value: bool = True
    options: dict = field(default_factory=dict)


def compiled(spark: SparkSession, sf_dir: str, case: Case) -> tuple[Engine, Compilation]:
    graph = retail_graph(spark, sf_dir)
    c = compile_shapes([Document("shapes.ttl", PREFIXES + case.shapes)], graph.snapshot(), Options(**case.options))
    return Engine(graph, c.options.node_key), c


def rows(df: DataFrame, value: bool) -> DataFrame:
    return df.select("rule_id", "severity", "focus_label", "focus_key", *(["value"] if value else []), F.array_join("details", ",").alias("details"))


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, c = compiled(spark, sf_dir, case)
        return rows(engine.all_violations(c.rules), case.value)

    return run


def _sql(rule: str, label: str, key: str, rest: str, value: str | None = "NULL", severity: str = "Violation", details: str = "''") -> str:
    out = f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, '{label}' AS focus_label, CAST({key} AS VARCHAR) AS focus_key"
    if value is not None:
        out += f", CAST({value} AS VARCHAR) AS value"
    return f"{out}, {details} AS details {rest}"


def _node(label: str, body: str) -> str:
    return f"ex:S sh:targetClass ex:{label} ; {body} ."


def _prop(label: str, path: str, body: str) -> str:
    return _node(label, f"sh:property [ sh:path {path} ; {body} ]")


def _simple(label: str, path: str, body: str, component: str, key: str, table: str, where: str, value: str | None = "NULL", shown: str | None = None, **options) -> Case:
    return Case(_prop(label, path, body), _sql(f"ex:S/{shown or path}/{component}", label, key, f"FROM {table} WHERE {where}", value), value is not None, options)


_WORD = "the"
_CHAIN = "(SELECT conv_id, turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn) AS after FROM conversations a)"
_NEXT = "conv_id || '-' || turn"

CASES: dict[str, Case] = {
    "min_inclusive": _simple("Customer", "ex:c_acctbal", "sh:minInclusive 0", "sh:minInclusive", "c_custkey", "customer", "c_acctbal < 0", "c_acctbal"),
    "max_inclusive": _simple("Part", "ex:p_size", "sh:maxInclusive 45", "sh:maxInclusive", "p_partkey", "part", "p_size > 45", "p_size"),
    "min_exclusive": _simple("Part", "ex:p_size", "sh:minExclusive 5", "sh:minExclusive", "p_partkey", "part", "p_size <= 5", "p_size"),
    "max_exclusive": _simple("Order", "ex:o_totalprice", "sh:maxExclusive 400000.0", "sh:maxExclusive", "o_orderkey", "orders", "NOT o_totalprice < 400000", None),
    "range_date": _simple("Order", "ex:o_orderdate", 'sh:minInclusive "1995-06-17T00:00:00"^^xsd:dateTime', "sh:minInclusive", "o_orderkey", "orders", "o_orderdate < TIMESTAMP '1995-06-17'", None),
    "range_wrong_type": _simple("Customer", "ex:c_name", "sh:minInclusive 0", "sh:minInclusive", "c_custkey", "customer", "c_name IS NOT NULL", "c_name"),
    "min_count_property": _simple("Event", "ex:error_value", "sh:minCount 1", "sh:minCount", "event_id", "events", "event_type <> 'error' OR value IS NULL"),
    "max_count_list": _simple("Document", "ex:words", "sh:maxCount 300", "sh:maxCount", "doc_id", "documents", "len(list_distinct(string_split(text, ' '))) > 300"),
    "min_count_relationship": _simple("Order", "ex:contains", "sh:class ex:Part ; sh:minCount 1", "sh:minCount", "o_orderkey", "orders", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "min_count_inverse": Case(
        _prop("Customer", "[ sh:inversePath ex:placedBy ]", "sh:minCount 5"),
        _sql("ex:S/^ex:placedBy/sh:minCount", "Customer", "c_custkey", "FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 5"),
    ),
    "max_count_relationship": _simple(
        "Order", "ex:suppliedBy", "sh:class ex:Supplier ; sh:maxCount 3", "sh:maxCount", "o_orderkey", "orders JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", "n > 3"
    ),
    "datatype_range": _simple("Part", "ex:p_partkey", "sh:datatype xsd:byte", "sh:datatype", "p_partkey", "part", "p_partkey NOT BETWEEN -128 AND 127", "p_partkey"),
    "datatype_any": _simple("Part", "ex:any", "sh:datatype xsd:integer", "sh:datatype", "p_partkey", "part", "p_size % 3 <> 0", None),
    "compare_any": _simple("Part", "ex:any", "sh:minInclusive 1000", "sh:minInclusive", "p_partkey", "part", "NOT CASE p_size % 3 WHEN 0 THEN p_partkey >= 1000 WHEN 1 THEN false ELSE p_retailprice >= 1000 END", None),
    "node_kind": _simple("Nation", "ex:n_name", "sh:nodeKind sh:IRI ; w:property \"n_name\"", "sh:nodeKind", "n_nationkey", "nation", "true", "n_name"),
    "class_relationship": Case(
        _node("Nation", "sh:property [ sh:path [ sh:inversePath ex:inNation ] ; sh:class ex:Customer ]"),
        _sql("ex:S/^ex:inNation/sh:class", "Nation", "s_nationkey", "FROM supplier", "s_suppkey"),
    ),
    "min_length": _simple("Document", "ex:source", "sh:minLength 5", "sh:minLength", "doc_id", "documents", "length(source) < 5", "source"),
    "max_length": _simple("Document", "ex:text", "sh:maxLength 5000", "sh:maxLength", "doc_id", "documents", "length(text) > 5000", None),
    "length_integer": _simple("Order", "ex:o_orderkey", "sh:maxLength 4", "sh:maxLength", "o_orderkey", "orders", "length(CAST(o_orderkey AS VARCHAR)) > 4", "o_orderkey"),
    "pattern": _simple("Part", "ex:p_brand", 'sh:pattern "[13]$"', "sh:pattern", "p_partkey", "part", "NOT regexp_matches(p_brand, '[13]$')", "p_brand"),
    "pattern_flags": _simple("Order", "ex:o_orderpriority", 'sh:pattern "URGENT|high" ; sh:flags "i"', "sh:pattern", "o_orderkey", "orders", "NOT regexp_matches(o_orderpriority, 'urgent|high', 'i')", "o_orderpriority"),
    "pattern_subtraction": _simple("Page", "ex:url", r'sh:pattern "/[\\i-[a-e]]{2}/"', "sh:pattern", "page_id", "pages", "NOT regexp_matches(url, '/[f-zA-Z_:]{2}/')", "url"),
    "in_list": _simple("Customer", "ex:c_mktsegment", 'sh:in ("BUILDING" "MACHINERY")', "sh:in", "c_custkey", "customer", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment"),
    "in_numbers": _simple("Part", "ex:p_size", "sh:in (1 2 3 5 8 13 21 34)", "sh:in", "p_partkey", "part", "p_size NOT IN (1, 2, 3, 5, 8, 13, 21, 34)", "p_size"),
    "in_node_key": Case(
        _prop("Nation", "ex:inRegion", "sh:class ex:Region ; sh:in (ex:EUROPE ex:ASIA)"),
        _sql("ex:S/ex:inRegion/sh:in", "Nation", "n_nationkey", "FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('EUROPE', 'ASIA')", "n_regionkey"), options={"node_key": "r_name"},
    ),
    "has_value": _simple("Document", "ex:words", f'sh:hasValue "{_WORD}"', "sh:hasValue", "doc_id", "documents", f"NOT list_contains(string_split(text, ' '), '{_WORD}')"),
    "equals": _simple("Part", "ex:p_size", "sh:equals ex:p_partkey", "sh:equals", "p_partkey", "part", "p_size <> p_partkey"),
    "disjoint": _simple("Event", "ex:k", "sh:disjoint ex:user_id", "sh:disjoint", "event_id", "events", "CAST(json_extract_string(props, '$.k') AS INT) = user_id"),
    "less_than": _simple("Part", "ex:p_size", "sh:lessThan ex:p_partkey", "sh:lessThan", "p_partkey", "part", "NOT p_size < p_partkey"),
    "less_than_or_equals": _simple("Vec", "ex:label", "sh:lessThanOrEquals ex:vec_id", "sh:lessThanOrEquals", "vec_id", "embeddings", "NOT label <= vec_id"),
    "less_than_list": _simple("Vec", "ex:embedding", "sh:lessThan ex:label", "sh:lessThan", "vec_id", "embeddings", "NOT list_max(embedding) < label"),
    "equals_nodes": Case(
        _prop("Order", "ex:returnedTo", "sh:class ex:Supplier ; sh:equals ex:acceptedFrom"),
        _sql("ex:S/ex:returnedTo/sh:equals", "Order", "k", """FROM (SELECT l_orderkey k FROM (
            SELECT l_orderkey, l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) r, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) a FROM lineitem GROUP BY 1, 2)
            WHERE r <> a GROUP BY 1)"""),
    ),
    "disjoint_nodes": Case(
        _prop("Order", "ex:returnedTo", "sh:class ex:Supplier ; sh:disjoint ex:acceptedFrom"),
        _sql("ex:S/ex:returnedTo/sh:disjoint", "Order", "k", "FROM (SELECT DISTINCT a.l_orderkey k FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A')"),
    ),
    "closed": Case(
        _node("Event", "sh:closed true ; sh:ignoredProperties (ex:ts ex:user_id ex:event_type ex:value ex:props ex:k ex:byUser)"),
        _sql("ex:S/sh:closed", "Event", "event_id", "FROM events WHERE event_type = 'error' AND value IS NOT NULL"),
    ),
    "closed_relationships": Case(
        _node("Order", "sh:closed true ; sh:ignoredProperties (ex:o_custkey ex:o_orderstatus ex:o_totalprice ex:o_orderdate ex:o_orderpriority ex:placedBy ex:contains ex:suppliedBy ex:acceptedFrom)"),
        _sql("ex:S/sh:closed", "Order", "o_orderkey", "FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    ),
    "node_nested": Case(
        'ex:Good sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ] ; sh:property [ sh:path ex:c_mktsegment ; sh:in ("BUILDING" "MACHINERY" "AUTOMOBILE") ] .\n' + _prop("Order", "ex:placedBy", "sh:node ex:Good"),
        _sql("ex:S/ex:placedBy/sh:node", "Order", "o_orderkey", "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')", "c_custkey",
             details="concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'ex:Good/ex:c_acctbal/sh:minInclusive' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'ex:Good/ex:c_mktsegment/sh:in' END)"),
    ),
    "not_shape": Case(_node("Event", 'sh:not [ sh:path ex:event_type ; sh:hasValue "error" ]'), _sql("ex:S/sh:not", "Event", "event_id", "FROM events WHERE event_type = 'error'", "event_id")),
    "and_shapes": Case(
        _node("Customer", 'sh:and ([ sh:path ex:c_acctbal ; sh:minInclusive 0 ] [ sh:path ex:c_mktsegment ; sh:hasValue "BUILDING" ])'),
        _sql("ex:S/sh:and", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 0 OR c_mktsegment <> 'BUILDING'", "c_custkey",
             details="concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'ex:S/sh:and[0]/ex:c_acctbal/sh:minInclusive' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'ex:S/sh:and[1]/ex:c_mktsegment/sh:hasValue' END)"),
    ),
    "or_shapes": Case(
        _node("Customer", 'sh:or ([ sh:path ex:c_acctbal ; sh:minInclusive 5000 ] [ sh:path ex:c_mktsegment ; sh:in ("BUILDING" "MACHINERY") ])'),
        _sql("ex:S/sh:or", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 5000 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_custkey", details="'ex:S/sh:or[0]/ex:c_acctbal/sh:minInclusive,ex:S/sh:or[1]/ex:c_mktsegment/sh:in'"),
    ),
    "xone_shapes": Case(
        _node("Part", "sh:xone ([ sh:path ex:p_size ; sh:maxInclusive 20 ] [ sh:path ex:p_size ; sh:minInclusive 10 ])"),
        _sql("ex:S/sh:xone", "Part", "p_partkey", "FROM part WHERE p_size BETWEEN 10 AND 20", "p_partkey"),
    ),
    "qualified_min": Case(
        _prop("Order", "ex:contains", "sh:qualifiedValueShape [ sh:property [ sh:path ex:p_size ; sh:minExclusive 40 ] ] ; sh:qualifiedMinCount 1 ; w:relationship \"CONTAINS\""),
        _sql("ex:S/ex:contains/sh:qualifiedMinCount", "Order", "o_orderkey", "FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40)"),
    ),
    "qualified_max": Case(
        _prop("Order", "ex:contains", "sh:qualifiedValueShape [ sh:property [ sh:path ex:p_size ; sh:minExclusive 40 ] ] ; sh:qualifiedMaxCount 2 ; w:relationship \"CONTAINS\""),
        _sql("ex:S/ex:contains/sh:qualifiedMaxCount", "Order", "l_orderkey", "FROM (SELECT l_orderkey, count(DISTINCT l_partkey) n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1) WHERE n > 2"),
    ),
    "qualified_disjoint": Case(
        "ex:Big sh:property [ sh:path ex:p_size ; sh:minInclusive 30 ] . ex:Dear sh:property [ sh:path ex:p_retailprice ; sh:minInclusive 1500 ] .\n"
        + _node("Order", " ; ".join(f'sh:property [ sh:path ex:contains ; w:relationship "CONTAINS" ; w:name "{n}" ; sh:qualifiedValueShape ex:{n} ; sh:qualifiedValueShapesDisjoint true ; {b} ]' for n, b in (("Big", "sh:qualifiedMinCount 1"), ("Dear", "sh:qualifiedMaxCount 0")))),
        _sql("ex:S/ex:contains/sh:qualifiedMinCount", "Order", "o_orderkey", "FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 30 AND p_retailprice < 1500)")
        + " UNION ALL "
        + _sql("ex:S/ex:contains/sh:qualifiedMaxCount", "Order", "k", "FROM (SELECT DISTINCT l_orderkey k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_retailprice >= 1500 AND p_size < 30)"),
    ),
    "path_sequence": Case(
        _prop("Customer", "( ex:inNation ex:inRegion ex:r_name )", 'sh:in ("EUROPE" "ASIA")'),
        _sql("ex:S/ex:inNation/ex:inRegion/ex:r_name/sh:in", "Customer", "c_custkey", "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('EUROPE', 'ASIA')", "r_name"),
    ),
    "path_alternative_relationships": Case(
        _prop("Order", "[ sh:alternativePath (ex:returnedTo ex:acceptedFrom) ]", "sh:class ex:Supplier ; sh:maxCount 2"),
        _sql("ex:S/ex:returnedTo|ex:acceptedFrom/sh:maxCount", "Order", "l_orderkey", "FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1) WHERE n > 2"),
    ),
    "path_alternative_properties": Case(
        _prop("Event", "[ sh:alternativePath (ex:error_value ex:value) ]", "sh:maxInclusive 90"),
        _sql("ex:S/ex:error_value|ex:value/sh:maxInclusive", "Event", "event_id", "FROM events WHERE value > 90", None), value=False,
    ),
    "path_mixed_directions": Case(
        _prop("Nation", "( [ sh:inversePath ex:inNation ] [ sh:inversePath ex:placedBy ] )", "sh:minCount 600"),
        _sql("ex:S/^ex:inNation/^ex:placedBy/sh:minCount", "Nation", "n_nationkey", "FROM nation WHERE (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) < 600"),
    ),
    "path_optional": Case(_prop("Turn", "[ sh:zeroOrOnePath ex:next ]", "sh:maxCount 1"), _sql("ex:S/ex:next?/sh:maxCount", "Turn", _NEXT, f"FROM {_CHAIN} WHERE after > 0")),
    "path_plus": Case(_prop("Turn", "[ sh:oneOrMorePath ex:next ]", "sh:maxCount 3"), _sql("ex:S/ex:next+/sh:maxCount", "Turn", _NEXT, f"FROM {_CHAIN} WHERE after > 3")),
    "path_star": Case(_prop("Turn", "[ sh:zeroOrMorePath ex:next ]", "sh:maxCount 3"), _sql("ex:S/ex:next*/sh:maxCount", "Turn", _NEXT, f"FROM {_CHAIN} WHERE after > 2")),
    "path_plus_depth": Case(_prop("Turn", "[ sh:oneOrMorePath ex:next ]", "sh:minCount 3"), _sql("ex:S/ex:next+/sh:minCount", "Turn", _NEXT, f"FROM {_CHAIN} WHERE least(after, 2) < 3"), options={"max_path_depth": 2}),
    "target_subjects": Case('ex:S sh:targetSubjectsOf ex:error_value ; sh:property [ sh:path ex:error_value ; sh:maxInclusive 50 ] .', _sql("ex:S/ex:error_value/sh:maxInclusive", "Event", "event_id", "FROM events WHERE event_type = 'error' AND value > 50", None), value=False),
    "target_objects": Case(
        "ex:S sh:targetObjectsOf ex:labelled ; sh:property [ sh:path ex:toxic ; sh:hasValue 0 ] .\nex:labelled w:relationship \"LABELLED\" .",
        _sql("ex:S/ex:toxic/sh:hasValue", "DocLabel", "doc_id", "FROM labels WHERE toxic <> 0 AND doc_id IN (SELECT doc_id FROM documents)"),
    ),
    "target_union": Case(
        "ex:S sh:targetClass ex:Supplier ; sh:targetObjectsOf ex:byUser ; sh:property [ sh:path [ sh:alternativePath (ex:c_acctbal ex:s_acctbal) ] ; sh:minInclusive 0 ] .\nex:byUser w:relationship \"BY_USER\" .",
        _sql("ex:S/ex:c_acctbal|ex:s_acctbal/sh:minInclusive", "Supplier", "s_suppkey", "FROM supplier WHERE s_acctbal < 0", None) + " UNION ALL "
        + _sql("ex:S/ex:c_acctbal|ex:s_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT user_id FROM events)", None), value=False,
    ),
    "target_implicit": Case("ex:Part a rdfs:Class ; sh:property [ sh:path ex:p_size ; sh:maxInclusive 48 ] .", _sql("ex:Part/ex:p_size/sh:maxInclusive", "Part", "p_partkey", "FROM part WHERE p_size > 48", "p_size")),
    "target_relationship": Case(
        'ex:S w:targetRelationship "CONTAINS" ; sh:property [ sh:path ex:l_quantity ; sh:maxInclusive 45 ] .',
        _sql("ex:S/ex:l_quantity/sh:maxInclusive", "CONTAINS", "l_orderkey || '->' || l_partkey", "FROM lineitem WHERE l_quantity > 45", None), value=False,
    ),
    "subclass_expansion": Case(
        "ex:Customer rdfs:subClassOf ex:Party . ex:Supplier rdfs:subClassOf ex:Party .\n" + _prop("Party", "[ sh:alternativePath (ex:c_acctbal ex:s_acctbal) ]", "sh:minInclusive 1000"),
        _sql("ex:S/ex:c_acctbal|ex:s_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 1000", None) + " UNION ALL "
        + _sql("ex:S/ex:c_acctbal|ex:s_acctbal/sh:minInclusive", "Supplier", "s_suppkey", "FROM supplier WHERE s_acctbal < 1000", None), value=False,
    ),
    "metadata": Case(
        _node("Customer", 'sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ; sh:severity sh:Warning ; sh:message "{$this} owes {?value}" ] ; sh:property [ sh:path ex:c_name ; sh:minLength 100 ; sh:deactivated true ]'),
        _sql("ex:S/ex:c_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 0", "c_acctbal", "Warning"),
    ),
}

_FUSED = Case(
    _node("Customer", 'sh:property [ sh:path ex:c_acctbal ; sh:minInclusive 0 ; sh:maxInclusive 9000 ] ; sh:property [ sh:path ex:c_mktsegment ; sh:in ("BUILDING" "MACHINERY") ; sh:maxLength 8 ] ; sh:property [ sh:path ex:c_name ; sh:minCount 1 ]'),
    " UNION ALL ".join((
        _sql("ex:S/ex:c_acctbal/sh:minInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal < 0", "c_acctbal"),
        _sql("ex:S/ex:c_acctbal/sh:maxInclusive", "Customer", "c_custkey", "FROM customer WHERE c_acctbal > 9000", "c_acctbal"),
        _sql("ex:S/ex:c_mktsegment/sh:in", "Customer", "c_custkey", "FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment"),
        _sql("ex:S/ex:c_mktsegment/sh:maxLength", "Customer", "c_custkey", "FROM customer WHERE length(c_mktsegment) > 8", "c_mktsegment"),
    )),
)
CASES["fused_scan"] = _FUSED


def summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rule of the fused case, silent rules included."""
    engine, c = compiled(spark, sf_dir, _FUSED)
    return engine.summary(c.rules).drop("sample")


_SUMMARY_SQL = f"""SELECT r.rule_id, 'Violation' AS severity, count(v.rule_id) AS violation_count
FROM (VALUES ('ex:S/ex:c_acctbal/sh:minInclusive'), ('ex:S/ex:c_acctbal/sh:maxInclusive'), ('ex:S/ex:c_mktsegment/sh:in'), ('ex:S/ex:c_mktsegment/sh:maxLength'), ('ex:S/ex:c_name/sh:minCount')) r(rule_id)
LEFT JOIN ({_FUSED.sql}) v ON r.rule_id = v.rule_id GROUP BY 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(case) for name, case in CASES.items()} | {"summary_all": summary_all} | catalogue_surface.queries()


def oracle_sql() -> dict[str, str]:
    return {name: case.sql for name, case in CASES.items()} | {"summary_all": _SUMMARY_SQL} | catalogue_surface.oracle_sql()
