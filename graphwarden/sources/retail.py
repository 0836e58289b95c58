"""The driver's tables as a property graph: customers, orders, parts, suppliers, events, documents and
conversations. Keys are the tables' own; frames are lazy, and a rule reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import NodeTable, PropertyGraph, RelTable

_graphs: dict[tuple[str, str], PropertyGraph] = {}


def retail_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = _build(spark, sf_dir)
    return _graphs[key]


def _build(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    region, nation, customer, supplier, part, orders, lineitem, events, documents, labels, embeddings, pages, benchmark, conversations = map(
        table, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations")
    )
    part = part.withColumn(
        "any", F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("variant")).when(F.col("p_size") % 3 == 1, F.col("p_name").cast("variant")).otherwise(F.col("p_retailprice").cast("variant"))
    )
    events = events.withColumns({"error_value": F.when(F.col("event_type") == "error", F.col("value")), "k": F.get_json_object("props", "$.k").cast("int")})
    documents = documents.withColumn("words", F.split("text", " "))
    turn_id = F.concat_ws("-", "conv_id", "turn")
    turns = conversations.withColumn("id", turn_id)
    after = conversations.select("conv_id", F.col("turn").alias("t"))
    follows = conversations.select("conv_id", "turn", (F.col("turn") + 1).alias("t")).join(after, ["conv_id", "t"])
    items = {"src": "l_orderkey", "dst": "l_suppkey"}
    return PropertyGraph(
        [
            NodeTable("Region", region, "r_regionkey"), NodeTable("Nation", nation, "n_nationkey"), NodeTable("Customer", customer, "c_custkey"), NodeTable("Supplier", supplier, "s_suppkey"),
            NodeTable("Part", part, "p_partkey"), NodeTable("Order", orders, "o_orderkey"), NodeTable("Event", events, "event_id"), NodeTable("Document", documents, "doc_id"),
            NodeTable("DocLabel", labels, "doc_id"), NodeTable("Vec", embeddings, "vec_id"), NodeTable("Page", pages, "page_id"), NodeTable("Item", benchmark, "item_id"), NodeTable("Turn", turns, "id"),
        ],
        [
            RelTable("IN_REGION", "Nation", "Region", nation.select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey"),
            RelTable("IN_NATION", "Customer", "Nation", customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey"),
            RelTable("IN_NATION", "Supplier", "Nation", supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey"),
            RelTable("PLACED_BY", "Order", "Customer", orders.select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey"),
            RelTable("CONTAINS", "Order", "Part", lineitem.drop("l_suppkey"), "l_orderkey", "l_partkey"),
            RelTable("SUPPLIED_BY", "Order", "Supplier", lineitem.select("l_orderkey", "l_suppkey"), **items),
            RelTable("RETURNED_TO", "Order", "Supplier", lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), **items),
            RelTable("ACCEPTED_FROM", "Order", "Supplier", lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_suppkey"), **items),
            RelTable("BY_USER", "Event", "Customer", events.select("event_id", "user_id"), "event_id", "user_id"),
            RelTable("LABELLED", "Document", "DocLabel", labels.select("doc_id", F.col("doc_id").alias("of")), "doc_id", "of"),
            RelTable("NEXT", "Turn", "Turn", follows.select(turn_id.alias("src"), F.concat_ws("-", "conv_id", "t").alias("dst"))),
        ],
    )
