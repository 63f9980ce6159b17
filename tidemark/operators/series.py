"""Calendar and chart operators over day rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def dense(days: DataFrame, *keys: str) -> DataFrame:
    """Every day from the first to the last for each key, zero where there is no row. days has keys, date and units."""
    bounds = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = bounds.select(F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    grid = days.select(*keys).distinct().join(F.broadcast(calendar)) if keys else calendar
    return grid.join(days, [*keys, "date"], "left").select(*keys, "date", F.coalesce("units", F.lit(0)).alias("units"))


def trailing_average(days: DataFrame, n: int, *keys: str) -> DataFrame:
    """Mean of the last n days, or of as many as there are so far."""
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(1 - n, Window.currentRow)
    return days.withColumn("average", F.round(F.avg(F.greatest("units", F.lit(0))).over(frame), 6))


def top_with_other(rows: DataFrame, key: str, most: int, value: str = "units") -> DataFrame:
    """The most - 1 largest keys, and all others as one, where there are more than most keys."""
    totals = rows.groupBy(key).agg(F.sum(value).alias(value))
    first = totals.orderBy(F.desc(value), key).limit(most + 1)
    placed = first.withColumns({"place": F.row_number().over(Window.orderBy(F.desc(value), key)), "keys": F.count("*").over(Window.partitionBy())})
    named = placed.where((F.col("keys") <= most) | (F.col("place") < most)).select(F.col(key).alias("__key"), F.lit(True).alias("__named"))
    label = F.when(F.col("__named"), F.col(key).cast("string")).otherwise("other")
    return totals.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("__key")), "left").groupBy(label.alias("series")).agg(F.sum(value).alias(value))


def streaks(days: DataFrame, *keys: str) -> DataFrame:
    """Runs of successive days with cost: keys, first_date, last_date and days."""
    active = days.where("cost > 0").select(*keys, F.col("date").cast("date").alias("date")).distinct()
    island = F.date_sub("date", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    return active.withColumn("island", island).groupBy(*keys, "island").agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"), F.count("*").alias("days")).drop("island")


def longest_streak(days: DataFrame, *keys: str) -> DataFrame:
    return streaks(days, *keys).groupBy(*keys).agg(F.max("days").alias("longest"))


def current_streak(days: DataFrame, today: str, *keys: str) -> DataFrame:
    """The streak that ends today or on the day before; keys without one have none."""
    return streaks(days, *keys).where(F.datediff(F.lit(today).cast("date"), F.col("last_date").cast("date")).between(0, 1)).select(*keys, F.col("days").alias("current"))
