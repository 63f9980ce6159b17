"""The day and session reports over a stream of messages (timestamp ts, client, units, cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_days(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    return messages.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "client").agg(F.sum("units").alias("units"), F.count("*").alias("messages")).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "client", "units", "messages")


def streaming_sessions(messages: DataFrame, gap: str = "180 seconds", lateness: str = "1 day") -> DataFrame:
    return messages.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "client", "user_id").agg(F.sum("units").alias("units"), F.count("*").alias("messages")).select("client", "user_id", F.unix_millis("session_window.start").alias("start"), "units", "messages")
