"""Day, session, year and model reports over usage facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.facts import BUCKETS


def money(total: Column) -> Column:
    return total.cast("double")


def measures() -> list[Column]:
    return [F.sum("units").alias("units"), money(F.sum("cost")).alias("cost"), F.count("*").alias("messages")]


def saturating_sum(name: str) -> Column:
    """A sum of longs that stops at the largest one instead of overflowing."""
    return F.least(F.sum(F.col(name).cast("decimal(38,0)")), F.lit(9223372036854775807).cast("decimal(38,0)")).cast("long")


def rollup(facts: DataFrame, *keys: str) -> DataFrame:
    """Sums of units, cost and messages, and of each kind of units where the facts have them."""
    own = [F.sum(b).alias(b) for b in BUCKETS if b in facts.columns]
    return facts.groupBy(*keys).agg(*measures(), *own)


def providers_by_day(facts: DataFrame) -> DataFrame:
    return facts.groupBy("date").agg(F.array_join(F.sort_array(F.collect_set("provider_id")), ", ").alias("providers"))


def nested_days(facts: DataFrame) -> DataFrame:
    """Day rows that hold their client and model subtotals as a sorted array."""
    inner = rollup(facts.select("date", "client", "model_id", "units", "cost"), "date", "client", "model_id")
    return inner.groupBy("date").agg(F.sum("units").alias("units"), F.sort_array(F.collect_list(F.struct("client", "model_id", "units", "cost", "messages"))).alias("clients"))


def sessions(facts: DataFrame) -> DataFrame:
    """Session totals with first and last second and the client, provider and model of the highest cost."""
    inner = facts.groupBy("session_id", "client", "provider_id", "model_id").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"), F.count("*").alias("messages"), F.min("timestamp_ms").alias("lo"), F.max("timestamp_ms").alias("hi"))
    top = F.min_by(F.struct("client", "provider_id", "model_id"), F.struct(-F.col("cost"), "client", "provider_id", "model_id"))
    out = inner.groupBy("session_id").agg(F.sum("units").alias("units"), money(F.sum("cost")).alias("cost"), F.sum("messages").alias("messages"), F.floor(F.min("lo") / 1000).alias("first_seen"), F.floor(F.max("hi") / 1000).alias("last_seen"), top.alias("top"))
    return out.select("session_id", "units", "cost", "messages", "first_seen", "last_seen", F.col("top.client").alias("top_client"), F.col("top.provider_id").alias("top_provider"), F.col("top.model_id").alias("top_model"))


def summary(facts: DataFrame) -> DataFrame:
    """Totals over all days; the average is over active days (any units, cost or messages)."""
    days = facts.groupBy("date").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"), F.count("*").alias("messages"))
    active = F.sum(F.when((F.col("units") > 0) | (F.col("cost") > 0) | (F.col("messages") > 0), 1).otherwise(0))
    totals = days.agg(saturating_sum("units").alias("units"), money(F.sum("cost")).alias("cost"), F.count("*").alias("days"), active.alias("active_days"), money(F.max("cost")).alias("max_day_cost"))
    sets = facts.agg(F.array_join(F.sort_array(F.collect_set("client")), ",").alias("clients"), F.array_join(F.sort_array(F.collect_set("model_id")), ",").alias("models"))
    return totals.join(sets).withColumn("average", F.round(F.col("cost") / F.greatest("active_days", F.lit(1)), 6))


def years(facts: DataFrame) -> DataFrame:
    """By year of the date; dates of fewer than four characters are skipped."""
    return facts.where(F.length("date") >= 4).groupBy(F.substring("date", 1, 4).alias("year")).agg(F.sum("units").alias("units"), money(F.sum("cost")).alias("cost"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def model_report(facts: DataFrame) -> DataFrame:
    """By client, provider and model, with coverage and pace of the timed rows."""
    timed = F.when(F.col("duration_ms") > 0, F.col("units")).otherwise(0)
    out = facts.groupBy("client", "provider_id", "model_id").agg(
        *[F.sum(b).alias(b) for b in BUCKETS], F.count("*").alias("messages"), F.sum("duration_ms").alias("duration_ms"), F.sum(timed).alias("timed_units"), F.sum(F.when(F.col("duration_ms") > 0, 1).otherwise(0)).alias("samples"), F.sum("units").alias("units")
    )
    pace = F.when(F.col("timed_units") > 0, F.round(F.col("duration_ms") * 1000 / F.col("timed_units"), 6))
    return out.withColumn("coverage", F.when(F.col("units") > 0, F.round(F.col("timed_units") / F.col("units"), 6))).withColumn("ms_per_1k", pace)


def share(facts: DataFrame, key: str) -> DataFrame:
    """Cost of each key and its percentage of all cost."""
    by = facts.groupBy(key).agg(F.sum("units").alias("units"), money(F.sum("cost")).alias("cost"))
    total = F.sum("cost").over(Window.partitionBy())
    return by.withColumn("percent", F.round(F.col("cost") * 100 / total, 6))


def intensity(days: DataFrame, measure: str, inclusive_from_below: bool = False) -> DataFrame:
    """0 to 4 by the ratio to the largest day; quarters belong to the upper step, or to the lower one if inclusive_from_below."""
    ratio = F.col(measure) / F.max(measure).over(Window.partitionBy())
    if inclusive_from_below:
        level = F.when(F.coalesce(ratio, F.lit(0)) <= 0, 0).when(ratio <= 0.25, 1).when(ratio <= 0.5, 2).when(ratio <= 0.75, 3).otherwise(4)
    else:
        level = F.when(ratio >= 0.75, 4).when(ratio >= 0.5, 3).when(ratio >= 0.25, 2).when(ratio > 0, 1).otherwise(0)
    return days.withColumn("intensity", level)


def weekdays(days: DataFrame) -> DataFrame:
    """Units by weekday (Sunday is 0) over days with units."""
    return days.where("units > 0").groupBy((F.dayofweek(F.col("date").cast("date")) - 1).alias("weekday")).agg(F.sum("units").alias("units"), F.count("*").alias("days"))


def devices(rows: DataFrame) -> DataFrame:
    """Totals of each device and its days with units."""
    return rows.groupBy("device").agg(*measures(), F.count_distinct(F.when(F.col("units") > 0, F.col("date"))).alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def whole_percents(values: DataFrame, key: str, value: str) -> DataFrame:
    """Whole percentages that add up to 100: the largest remainders are rounded up, ties by key."""
    everything = Window.partitionBy()
    exact = F.col(value).cast("decimal(38,0)") * 100
    split = values.withColumn("floor", F.floor(exact / F.sum(F.col(value).cast("decimal(38,0)")).over(everything))).withColumn("rest", exact - F.col("floor") * F.sum(F.col(value).cast("decimal(38,0)")).over(everything))
    order = Window.orderBy(F.desc("rest"), key)
    missing = 100 - F.sum("floor").over(everything)
    return split.withColumn("percent", (F.col("floor") + F.when(F.row_number().over(order) <= missing, 1).otherwise(0)).cast("long")).select(key, "percent")
