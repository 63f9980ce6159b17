"""Reports of one account or device: totals, days, shares, calendars and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import if_small

DAY_SUMS = ("units", "input", "output", "cache_read", "cache_write", "reasoning")


def sums(*columns: str) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]


def stats(rows: DataFrame, *keys: str) -> DataFrame:
    """All sums, cost, first and last day and the number of submissions."""
    return rows.groupBy(*keys).agg(*sums(*DAY_SUMS), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"), F.count("*").alias("submits"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def days(rows: DataFrame, owner: str, aliases: DataFrame | None = None) -> DataFrame:
    """Rows of several devices merged by owner, day, client and model; a model's alias (model_id, shown) stands for it."""
    if aliases is not None:
        rows = rows.join(if_small(aliases), "model_id", "left").withColumn("model_id", F.coalesce("shown", "model_id"))
    return rows.groupBy(owner, "date", "client", "model_id").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"), F.count("*").alias("messages"), F.min("timestamp_ms").alias("timestamp_ms"))


def nested_days(flat: DataFrame, owner: str) -> DataFrame:
    """One row a day, with a map of clients, each with a map of its models' units; a few entries, never raw rows."""
    clients = flat.groupBy(owner, "date", "client").agg(F.sum("units").alias("units"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_id", "units")))).alias("models"))
    return clients.groupBy(owner, "date").agg(F.sum("units").alias("units"), F.map_from_entries(F.collect_list(F.struct("client", F.struct("units", "models").alias("held")))).alias("clients"))


def unnested(nested: DataFrame, owner: str) -> DataFrame:
    """The flat rows of nested days."""
    by_client = nested.select(owner, "date", F.explode("clients").alias("client", "held"))
    return by_client.select(owner, "date", "client", F.explode("held.models").alias("model_id", "units"))


def day_totals(nested: DataFrame, owner: str) -> DataFrame:
    """Units of each day from its clients, and the number of clients, without exploding."""
    values = F.map_values("clients")
    return nested.select(owner, "date", F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x["units"]).alias("units"), F.size("clients").cast("long").alias("n_clients"))


def model_shares(rows: DataFrame, synthetic: str = "<synthetic>") -> DataFrame:
    """Units, cost and percent of cost of each model but the synthetic one, and its place by cost, then units."""
    models = rows.where(F.col("model_id") != synthetic).groupBy("model_id").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"))
    all_cost = F.sum("cost").over(Window.partitionBy(F.lit(0)))
    return models.withColumn("percent", F.when(all_cost > 0, F.round(F.col("cost") * 100 / all_cost, 6)).otherwise(0.0)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cost"), F.desc("units"), "model_id")))


def habits(by_day: DataFrame) -> DataFrame:
    """Best weekday (Sunday is 0) and its percent of units, and the biggest day, from days with units."""
    used = by_day.where("units > 0")
    weekdays = used.groupBy((F.dayofweek(F.col("date").cast("date")) - 1).alias("weekday")).agg(F.sum("units").alias("units"))
    best = weekdays.agg(F.max_by("weekday", F.struct("units", -F.col("weekday"))).alias("best_weekday"), F.max("units").alias("best"), F.sum("units").alias("every"))
    biggest = used.agg(F.min_by("date", F.struct(-F.col("units"), "date")).alias("biggest_day"), F.max("units").alias("biggest_units"))
    return best.select("best_weekday", F.round(F.col("best") * 100 / F.col("every"), 6).alias("percent")).join(biggest)


def device_totals(devices: DataFrame, rows: DataFrame) -> DataFrame:
    """Every device, also one without rows, with sums, active days and first and last day."""
    found = rows.groupBy("device").agg(F.sum("units").alias("units"), F.count_distinct(F.when(F.col("units") > 0, F.col("date"))).alias("active_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return devices.join(found, "device", "left").withColumns({"units": F.coalesce("units", F.lit(0)), "active_days": F.coalesce("active_days", F.lit(0))})


def cloud_groups(rows: DataFrame, key: str) -> DataFrame:
    """Sessions of cloud devices folded by the provider in their key: units, sessions, distinct days and the last day."""
    cloud = rows.where(F.startswith(F.col(key), F.lit("cloud_"))).withColumn("provider", F.split_part(F.col(key), F.lit("_"), F.lit(2)))
    return cloud.groupBy("provider").agg(F.sum("units").alias("units"), F.count_distinct(key).alias("sessions"), F.count_distinct("date").alias("days"), F.max("date").alias("last_date"))


def nested_today(rows: DataFrame, date: str) -> DataFrame:
    """Clients of one day with their models, dearest first at both levels, as places."""
    models = rows.where(F.col("date") == date).groupBy("client", "model_id").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"))
    with_client = models.withColumn("client_cost", F.sum("cost").over(Window.partitionBy("client")))
    return with_client.withColumn("place", F.row_number().over(Window.orderBy(F.desc("client_cost"), "client", F.desc("cost"), F.desc("units"), "model_id"))).drop("client_cost")


def submission_rollup(rows: DataFrame, key: str) -> DataFrame:
    """Sums, range, active days and rows of each submission, with its distinct clients and models in order."""
    return rows.groupBy(key).agg(
        F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct(F.when(F.col("units") > 0, F.col("date"))).alias("active_days"), F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set("client")), ",").alias("clients"), F.array_join(F.sort_array(F.collect_set("model_id")), ",").alias("models"),
    )


def composition(rows: DataFrame, parts: tuple[str, ...] = DAY_SUMS[1:]) -> DataFrame:
    """Share of each kind of unit in all; kinds without any are left out."""
    total = rows.agg(*[F.sum(p).alias(p) for p in parts])
    long = total.select(F.explode(F.create_map(*[x for p in parts for x in (F.lit(p), F.col(p))])).alias("part", "units"))
    return long.where("units > 0").withColumn("percent", F.round(F.col("units") * 100 / F.sum("units").over(Window.partitionBy(F.lit(0))), 6))


def speed_usage(rows: DataFrame, *keys: str) -> DataFrame:
    """Units and messages of each speed and source; rows without a speed are the remainder, never a standard speed."""
    return rows.groupBy(*keys, F.coalesce("speed", F.lit("unknown")).alias("speed"), F.coalesce("source", F.lit("none")).alias("source")).agg(F.sum("units").alias("units"), F.count("*").alias("messages"))


def unpriced(rows: DataFrame, most: int = 20) -> DataFrame:
    """Usage without a price by provider and model, the largest first; beyond the first ones a row that counts the rest."""
    groups = rows.where("price is null").groupBy("provider_id", "model_id").agg(F.sum("units").alias("units"), F.count("*").alias("messages"))
    top = groups.orderBy(F.desc("units"), F.desc("messages"), "provider_id", "model_id").limit(most)
    rest = groups.join(top, ["provider_id", "model_id"], "left_anti").agg(F.lit("").alias("provider_id"), F.lit("others").alias("model_id"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.count("*").alias("n")).where("n > 0").drop("n")
    return top.unionByName(rest)


def reconciled(parts: DataFrame, key: list[str], name: str, value: str, target: str) -> DataFrame:
    """Parts that add up to their key's target: larger sums are scaled down and the last positive part takes what is left over, of smaller ones a row named remainder takes it."""
    whole = Window.partitionBy(*key)
    clean = parts.withColumn("v", F.when(F.isnan(value) | (F.col(value) < 0) | F.col(value).isNull(), 0.0).otherwise(F.col(value).cast("double")))
    summed = clean.withColumn("all", F.sum("v").over(whole)).withColumn("close", F.greatest(F.lit(1e-9), 1e-12 * F.abs(F.col(target))))
    over = F.col("all") > F.col(target) + F.col("close")
    scaled = summed.withColumn("s", F.when(over, F.col("v") * F.col(target) / F.col("all")).otherwise(F.col("v")))
    last = F.max(F.when(F.col("s") > 0, F.col(name))).over(whole)
    others = F.sum(F.when(F.col(name) == last, 0.0).otherwise(F.col("s"))).over(whole)
    fixed = scaled.withColumn("last", last).withColumn("others", others).withColumn("value", F.when(over & (F.col(name) == F.col("last")), F.col(target) - F.col("others")).otherwise(F.col("s")))
    short = summed.groupBy(*key).agg(F.first(target).alias(target), F.first("all").alias("all"), F.first("close").alias("close")).where(F.col("all") < F.col(target) - F.col("close"))
    rest = short.select(*key, F.lit("remainder").alias(name), (F.col(target) - F.col("all")).alias("value"))
    return fixed.select(*key, name, "value").unionByName(rest)


def inclusive(scalar: Column, *parts: Column) -> Column:
    """The larger of a told total and the sum of its parts; what is no number, or negative, counts nothing."""
    clean = lambda x: F.when(x.isNull() | F.isnan(x.cast("double")) | (x < 0), 0).otherwise(x)
    total = clean(parts[0])
    for p in parts[1:]:
        total = total + clean(p)
    return F.greatest(clean(scalar), total)


def chart(rows: DataFrame, most: int, window: int) -> DataFrame:
    """Series of the most used models and of all others, on every day between the first and the last, each with its trailing average."""
    top = rows.groupBy("model_id").agg(F.sum("units").alias("n")).orderBy(F.desc("n"), "model_id").limit(most).select("model_id", F.lit(True).alias("top"))
    named = rows.join(F.broadcast(top), "model_id", "left").select("date", "units", F.when(F.col("top"), F.col("model_id")).otherwise("other").alias("series"))
    points = named.groupBy("series", "date").agg(F.sum("units").alias("units"))
    ends = rows.agg(F.min("date").cast("date").alias("lo"), F.max("date").cast("date").alias("hi"))
    # a few series, and one row of ends: both are small by their nature
    grid = points.select("series").distinct().join(F.broadcast(ends)).select("series", F.explode(F.sequence("lo", "hi")).alias("day")).select("series", F.col("day").cast("string").alias("date"))
    dense = grid.join(points, ["series", "date"], "left").select("series", "date", F.coalesce("units", F.lit(0)).alias("units"))
    trailing = Window.partitionBy("series").orderBy("date").rowsBetween(1 - window, 0)
    return dense.withColumn("average", F.round(F.avg("units").over(trailing), 6))


def mirrored(points: DataFrame, series: str) -> DataFrame:
    """Points of each series in reverse, by place from 0."""
    return points.withColumn("place", F.row_number().over(Window.partitionBy(series).orderBy(F.desc("date"))) - 1)


def stack_order(points: DataFrame, most: int = 5) -> DataFrame:
    """Places of series in a legend: the largest first, names deciding ties, the others' series last, and whether the legend shows it."""
    totals = points.groupBy("series").agg(F.sum("units").alias("units")).where("units > 0")
    order = Window.orderBy(F.col("series") == "other", F.desc("units"), "series")
    return totals.withColumn("place", F.row_number().over(order)).withColumn("shown", F.col("place") <= most)


def calendar(by_day: DataFrame, until: str) -> DataFrame:
    """The trailing year up to a day as weeks from Sunday: every day with its week, weekday, units and whether it opens a month."""
    end = F.lit(until).cast("date")
    first = F.add_months(end, -12)
    start = F.date_sub(first, F.dayofweek(first) - 1)
    grid = by_day.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    placed = grid.select(F.col("day").cast("string").alias("date"), F.floor(F.date_diff("day", start) / 7).cast("int").alias("week"), (F.dayofweek("day") - 1).alias("weekday"), (F.dayofmonth("day") == 1).alias("opens_month"), (F.col("day") >= first).alias("counts"))
    return placed.join(by_day.select("date", "units"), "date", "left").withColumn("units", F.when(F.col("counts"), F.coalesce("units", F.lit(0))).otherwise(0))


def range_options(rows: DataFrame) -> DataFrame:
    """The years that occur, each with the first and last day that can be chosen."""
    year = F.substring("date", 1, 4)
    return rows.groupBy(year.alias("year")).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumns({"start": F.concat("year", F.lit("-01-01")), "end": F.concat("year", F.lit("-12-31"))})


def active_days(rows: DataFrame) -> DataFrame:
    """The four counts of active days: any use, units by row, cost by day, units by day."""
    by_day = rows.groupBy("date").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"), F.count("*").alias("messages"), F.max((F.col("units") > 0).cast("int")).alias("used"))
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    return by_day.agg(one((F.col("units") > 0) | (F.col("cost") > 0) | (F.col("messages") > 0)).alias("any_use"), one(F.col("used") > 0).alias("unit_rows"), one(F.col("cost") > 0).alias("cost_days"), one(F.col("units") > 0).alias("unit_days"))


def carried(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """The last known value of a column up to each row of its key."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(f"{column}_carried", F.last(column, ignorenulls=True).over(upto))


def end_anchored(rows: DataFrame) -> DataFrame:
    """Times of answers that were stamped when they ended: start is the end less the duration, never before the epoch."""
    return rows.withColumn("start_ms", F.greatest(F.col("timestamp_ms") - F.greatest("duration_ms", F.lit(0)), F.lit(0)))


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of each key the newest row, later columns deciding ties."""
    best = F.max_by(F.struct(*columns), F.struct(order, *columns))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def trailing_year(days: DataFrame, today: str) -> DataFrame:
    """date, units, cost and intensity (0 to 4) of the days from a year and a week before today on; only those of the year up to today have an intensity, by quarters of their largest units."""
    end = F.lit(today).cast("date")
    start = F.add_months(end, -12)
    recent = days.where(F.col("date") >= F.date_sub(start, 7).cast("string")).groupBy("date").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"))
    inside = (F.col("date") >= start.cast("string")) & (F.col("date") <= end.cast("string"))
    # a row a day: at most as many as there are days from the cutoff on
    share = F.col("units") / F.max(F.when(inside, F.greatest("units", F.lit(0)))).over(Window.partitionBy(F.lit(0)))
    steps = F.when(share >= 0.75, 4).when(share >= 0.5, 3).when(share >= 0.25, 2).when(share > 0, 1).otherwise(0)
    return recent.withColumn("intensity", F.when(inside, steps).otherwise(0))
