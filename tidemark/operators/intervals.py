"""Sessions from gaps in time, and what overlapping intervals amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import cut_lineage

GAP_MS = 180_000
DAY_MS = 86_400_000
#: Time by which intervals of all sessions are dealt: a cell holds few windows once merged, and a bounded number of times.
CELL_MS = 600_000


def spans(facts: DataFrame) -> DataFrame:
    """start and end of each message; rows without a time are left out."""
    return facts.where("timestamp_ms > 0").select("client", "session_id", F.col("timestamp_ms").alias("start"), (F.col("timestamp_ms") + F.greatest("duration_ms", F.lit(0))).alias("end"), "units", "cost", F.lit(1).alias("n"))


def sessionize(parts: DataFrame, gap_ms: int = GAP_MS, keys: tuple[str, ...] = ("client", "session_id")) -> DataFrame:
    """Intervals of each key: a message joins the block before it if it starts at most gap_ms after that block's end."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("end").over(before)
    marked = parts.withColumn("new", F.when(last.isNull() | (F.col("start") > last + gap_ms), 1).otherwise(0))
    # both frames have one order, so the second needs no further shuffle or sort
    blocks = marked.withColumn("block", F.sum("new").over(upto))
    out = blocks.groupBy(*keys, "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"), F.sum("n").alias("messages"))
    return out.withColumn("active_ms", F.col("end") - F.col("start")).drop("block")


def merged(intervals: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Windows of all sessions together; cells of time are merged apart first, so that what one task holds grows with the time that they span, not with their number."""
    by_cell = intervals.withColumn("cell", F.floor(F.col("start") / CELL_MS)).withColumns({"units": F.lit(0), "cost": F.lit(0), "n": F.lit(1)})
    local = sessionize(by_cell, gap_ms, ("cell",)).select("start", "end", F.lit(0).alias("units"), F.lit(0).alias("cost"), F.lit(1).alias("n"), F.lit(0).alias("all"))
    return sessionize(local, gap_ms, ("all",)).select("start", "end", "active_ms")


def max_concurrent(intervals: DataFrame) -> DataFrame:
    """The most intervals at one time; touching ones overlap, and empty ones last a millisecond.

    Running sums are taken within cells of time, on top of the number of intervals open when the cell begins.
    """
    ends = F.when(F.col("end") <= F.col("start"), F.col("start") + 1).otherwise(F.col("end"))
    events = intervals.select(F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("delta")), F.struct(ends.alias("t"), F.lit(-1).alias("delta")))).alias("e")).select("e.t", "e.delta")
    events = events.withColumn("cell", F.floor(F.col("t") / CELL_MS)).groupBy("cell", "t", "delta").agg(F.sum("delta").alias("change"))
    cells = events.groupBy("cell").agg(F.sum("change").alias("net"))
    opened = cells.withColumn("open", F.coalesce(F.sum("net").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("cell", "open")
    running = F.sum("change").over(Window.partitionBy("cell").orderBy("t", F.desc("delta")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("running", running).join(opened, "cell").agg(F.coalesce(F.max(F.col("running") + F.col("open")), F.lit(0)).alias("max_concurrent"))


def time_metrics(intervals: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Total active time, session count, longest continuous window and most concurrent sessions, as one row."""
    intervals = cut_lineage(intervals, "intervals")
    totals = intervals.agg(F.coalesce(F.sum("active_ms"), F.lit(0)).alias("active_ms"), F.sum(F.when(F.col("messages") > 0, 1).otherwise(0)).alias("sessions"))
    longest = merged(intervals.select("start", "end"), gap_ms).agg(F.coalesce(F.max("active_ms"), F.lit(0)).alias("longest_ms"))
    return totals.join(longest).join(max_concurrent(intervals))


def daily_active(intervals: DataFrame, zone: str = "UTC") -> DataFrame:
    """Active milliseconds of each calendar day in a zone; an interval is shared out over the days that it touches.

    A day goes from one midnight of the zone to the next, and so has 23 or 25 hours where its clock changes; where
    that skips midnight, the day begins at the first time that there is. Times are written in UTC, as the session's
    time zone must be.
    """
    if zone == "UTC":
        midnight = lambda day: day * DAY_MS
        local = lambda ms: F.floor(ms / DAY_MS)
    else:
        midnight = lambda day: F.unix_millis(F.to_utc_timestamp(F.timestamp_seconds(day * (DAY_MS // 1000)), zone))
        local = lambda ms: F.unix_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone).cast("date")).cast("long")
    days = intervals.where("active_ms > 0").select("start", "end", F.explode(F.sequence(local(F.col("start")), local(F.col("end")))).alias("day"))
    part = F.least("end", midnight(F.col("day") + 1)) - F.greatest("start", midnight(F.col("day")))
    return days.groupBy("day").agg(F.sum(part).alias("active_ms")).where("active_ms > 0").select(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")), "yyyy-MM-dd").alias("date"), "active_ms")
