"""Tables and the memory-graph frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Supplier nodes stand beside part nodes in one id space.
SUPPLIER_BASE = 1_000_000_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, rel_type, weight, evidence, last_used) between parts and suppliers: one for each pair and return flag."""
    kind = F.when(F.col("l_returnflag") == "A", "CO_ACTIVATED_WITH").when(F.col("l_returnflag") == "R", "CONTRADICTS").otherwise("ASSOCIATED_WITH")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst"), kind.alias("rel_type"), "l_discount", "l_shipdate")
    return lines.groupBy("src", "dst", "rel_type").agg(F.round(F.avg("l_discount") * 10, 6).alias("weight"), F.count("*").alias("evidence"), F.max("l_shipdate").alias("last_used"))


EDGES_SQL = f"""(SELECT l_partkey AS src, l_suppkey + {SUPPLIER_BASE} AS dst,
  CASE l_returnflag WHEN 'A' THEN 'CO_ACTIVATED_WITH' WHEN 'R' THEN 'CONTRADICTS' ELSE 'ASSOCIATED_WITH' END AS rel_type,
  round(avg(l_discount) * 10, 6) AS weight, count(*) AS evidence, max(l_shipdate) AS last_used
  FROM lineitem GROUP BY ALL)"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(node_id, name, path, layer, role_type, confidence): a row for each part and supplier."""
    part, supplier = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    parts = part.select(
        F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat(F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "p_brand").alias("path"),
        (F.col("p_size") % 4).alias("layer"), F.lower(F.element_at(F.split("p_type", " "), -1)).alias("role_type"), F.round(F.col("p_retailprice") / 2000, 6).alias("confidence"),
    )
    suppliers = supplier.select(
        (F.col("s_suppkey") + SUPPLIER_BASE).alias("node_id"), F.col("s_name").alias("name"), F.concat(F.lit("/supplier/"), F.col("s_nationkey").cast("string")).alias("path"),
        F.lit(4).alias("layer"), F.lit("supplier").alias("role_type"), F.round((F.col("s_acctbal") + 1000) / 11000, 6).alias("confidence"),
    )
    return parts.unionByName(suppliers)


NODES_SQL = f"""(SELECT p_partkey AS node_id, p_name AS name, '/' || replace(p_type, ' ', '/') || '/' || p_brand AS path, p_size % 4 AS layer,
  lower(split_part(p_type, ' ', -1)) AS role_type, round(p_retailprice / 2000, 6) AS confidence FROM part
  UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, s_name, '/supplier/' || s_nationkey, 4, 'supplier', round((s_acctbal + 1000) / 11000, 6) FROM supplier)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of model calls: time, session, task, latency, tokens, error."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").alias("time"), F.col("user_id").alias("session_id"), F.col("event_type").alias("task"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"), F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("")).alias("error"),
    )


CALLS_SQL = """(SELECT event_id, ts AS time, user_id AS session_id, event_type AS task, value AS latency_ms,
  CAST(json_extract_string(props, '$.k') AS INT) AS tokens, CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error FROM events)"""
