"""Checks of submitted usage: each gives the rows or groups that break a rule, with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHANGE, UNITS, COST, EPSILON = 0.01, 100, 0.10, 1e-6
#: Days after today that a clock may be ahead.
DAYS_AHEAD = 2


def broken(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key and the names of all rules that a row breaks, for rows that break any; one pass."""
    names = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, names.alias("broken")).where(F.size("broken") > 0).select(*key, F.array_join("broken", ",").alias("broken"))


def field_rules(clients: list[str]) -> dict[str, Column]:
    """Ranges and enumerations of a usage row."""
    return {"client": ~F.col("client").isin(clients), "units": F.col("units") < 0, "cost": (F.col("cost") < 0) | F.isnan(F.col("cost").cast("double")), "date": ~F.col("date").rlike(r"^\d{4}-\d\d-\d\d$")}


def future(days: DataFrame, today: str, key: list[str]) -> DataFrame:
    """Days later than two days after today."""
    return days.where(F.col("date").cast("date") > F.date_add(F.lit(today).cast("date"), DAYS_AHEAD)).select(*key, "date")


def differs(told: Column, found: Column, least: float) -> Column:
    """By more than a hundredth and more than least."""
    off = F.abs(told - found)
    return (off > CHANGE * F.abs(found)) & (off > least)


def wrong_totals(told: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups whose told units or cost differ too much from the sum of their rows."""
    sums = rows.groupBy(*key).agg(F.sum("units").alias("sum_units"), F.sum("cost").cast("double").alias("sum_cost"))
    both = told.join(sums, key, "left").withColumns({"sum_units": F.coalesce("sum_units", F.lit(0)), "sum_cost": F.coalesce("sum_cost", F.lit(0.0))})
    return both.where(differs(F.col("units"), F.col("sum_units"), UNITS) | differs(F.col("cost").cast("double"), F.col("sum_cost"), COST)).select(*key, "units", "sum_units")


def free_cost(rows: DataFrame, exempt: Column) -> DataFrame:
    """Rows with a cost but no units, but for exempt ones."""
    return rows.where((F.col("cost") > EPSILON) & (F.col("units") <= 0) & ~exempt)


def day_faults(days: DataFrame, key: str) -> DataFrame:
    """Of each submission: repeated days, days out of its years' range and its number of active days."""
    by_day = days.groupBy(key, "date").agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    return by_day.groupBy(key).agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("units") > 0, 1).otherwise(0)).alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def revision_faults(rows: DataFrame, submission: str) -> DataFrame:
    """Clients that a submission reports with more than one revision, or with one above 1 and no manifest."""
    found = rows.groupBy(submission, "client").agg(F.count_distinct("revision").alias("revisions"), F.max("revision").alias("revision"), F.max("has_manifest").alias("has_manifest"))
    return found.where((F.col("revisions") > 1) | ((F.col("revision") > 1) & ~F.col("has_manifest"))).select(submission, "client", "revisions", "revision")


def bad_coverage(coverage: DataFrame) -> DataFrame:
    """Coverage that ends before it begins, or whose ends are no days."""
    return coverage.where(F.col("start").try_cast("date").isNull() | F.col("end").try_cast("date").isNull() | (F.col("start") > F.col("end")))


def foreign_clients(rows: DataFrame, provider: Column) -> DataFrame:
    """Rows of cloud devices that report another client than their own."""
    return rows.where(provider.isNotNull() & (F.col("client") != provider))


def archive_faults(days: DataFrame, owner: str, cutoff: str, most_days: int = 4000, most_clients: int = 64) -> DataFrame:
    """Owners whose archive has a day that is none, that comes twice or not before the cutoff, or too many days or clients."""
    rows = days.groupBy(owner, "date").agg(F.count("*").alias("n"), F.max("clients").alias("clients"))
    found = rows.groupBy(owner).agg(
        F.sum(F.when(F.col("date").try_cast("date").isNull(), 1).otherwise(0)).alias("unreal"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"),
        F.sum(F.when(F.col("date") >= cutoff, 1).otherwise(0)).alias("late"),
        F.count("*").alias("days"),
        F.max("clients").alias("clients"),
    )
    return found.where((F.col("unreal") > 0) | (F.col("repeated") > 0) | (F.col("late") > 0) | (F.col("days") > most_days) | (F.col("clients") > most_clients))


def speed_faults(rows: DataFrame, speeds: DataFrame, key: list[str]) -> DataFrame:
    """Rows of usage whose parts by speed (key, speed, source, units, messages) repeat a pair of speed and source, or exceed the row's own units or messages."""
    pairs = speeds.groupBy(*key, "speed", "source").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("messages").alias("messages"))
    sums = pairs.groupBy(*key).agg(F.max(F.col("n") > 1).alias("repeated"), F.sum("units").alias("speed_units"), F.sum("messages").alias("speed_messages"))
    both = rows.select(*key, "units", "messages").join(sums, key)
    found = both.select(*key, "repeated", (F.col("speed_units") > F.col("units")).alias("more_units"), (F.col("speed_messages") > F.col("messages")).alias("more_messages"))
    return found.where("repeated or more_units or more_messages")
