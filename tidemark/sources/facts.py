"""The canonical usage facts, from logs or from the star schema of the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import table

BUCKETS = ["input", "output", "cache_read", "cache_write", "reasoning"]


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: one model response each, with token buckets taken from the JSON properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("client"),
        F.concat(F.lit("m"), (k % 7).cast("string")).alias("model_id"),
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("timestamp_ms"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        k.alias("input"),
        (k % 50).alias("output"),
        (k * 3 % 40).alias("cache_read"),
        (k % 4).alias("cache_write"),
        (k % 5).alias("reasoning"),
        F.col("value").cast("decimal(18,4)").alias("cost"),
        (k * 1000).alias("duration_ms"),
    ).withColumn("units", sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0])))


def warehouse_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as stored day rows: (user, device, date, client) with units and cost; lines are made narrow before they are joined."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_suppkey") % 5).alias("device"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_returnflag").alias("client"),
        F.col("l_linestatus").alias("model_id"),
        F.col("l_quantity").cast("long").alias("units"),
        (F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(5,2)"))).cast("decimal(18,4)").alias("cost"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), "device", F.date_format("day", "yyyy-MM-dd").alias("date"), "client", "model_id", "units", "cost")
