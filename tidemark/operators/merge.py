"""Deduplication and keyed merges. Merges give a new snapshot; plain Parquet tables have no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = rows.where(F.col(key).isNotNull()).withColumn("place", place).where("place = 1").drop("place")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def field_max(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each key with the largest value of each field: partial reports of one message become one."""
    return rows.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])


def largest_snapshot(rows: DataFrame, key: str, columns: list[str], size: list[str]) -> DataFrame:
    """Of each key the row of the largest size, later columns deciding ties."""
    best = F.max_by(F.struct(*columns), F.struct(*size, *columns))
    return rows.groupBy(key).agg(best.alias("row")).select(key, "row.*")


def window_union(cached: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys of both; incoming values win."""
    both = cached.alias("c").join(incoming.alias("i"), F.col(f"c.{key}") == F.col(f"i.{key}"), "full")
    there = F.col(f"i.{key}").isNotNull()
    return both.select(F.coalesce(f"i.{key}", f"c.{key}").alias(key), *[F.when(there, F.col(f"i.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in columns])


def precedence_cutoff(authoritative: DataFrame, legacy: DataFrame, time: str = "timestamp_ms", margin_ms: int = 3_600_000) -> DataFrame:
    """The authoritative rows, and legacy ones from before the first of them less a margin."""
    cut = authoritative.agg((F.min(time) - margin_ms).alias("cut"))
    older = legacy.join(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col(time) < F.col("cut"))).drop("cut")
    return authoritative.unionByName(older)


def ledger_append(ledger: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of new keys are added; rows that the ledger has stay as they are."""
    return ledger.unionByName(incoming.join(ledger.select(key), key, "left_anti").select(ledger.columns))


def guarded_merge(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored day rows against incoming ones, both with units and revision.

    Missing rows stay if they have units; a lower revision, or the same with fewer units, never replaces a row.
    """
    s, i = stored.select(*keys, F.col("units").alias("s_units"), F.col("revision").alias("s_revision")), incoming.select(*keys, F.col("units").alias("i_units"), F.col("revision").alias("i_revision"))
    both = s.join(i, keys, "full")
    keep = F.col("s_revision").isNotNull() & (F.col("i_revision").isNull() | (F.col("i_revision") < F.col("s_revision")) | ((F.col("i_revision") == F.col("s_revision")) & (F.col("i_units") < F.col("s_units"))))
    merged = both.select(*keys, F.when(keep, F.col("s_units")).otherwise(F.col("i_units")).alias("units"), F.when(keep, F.col("s_revision")).otherwise(F.col("i_revision")).alias("revision"), F.col("i_revision").isNull().alias("missing"))
    return merged.where("not missing or units > 0").drop("missing")


def revision_floor(stored: DataFrame, incoming: DataFrame, client: str = "client") -> DataFrame:
    """Incoming rows whose revision is at least the largest stored one of their client."""
    floor = stored.groupBy(client).agg(F.max("revision").alias("floor"))
    return incoming.join(floor, client, "left").where("floor is null or revision >= floor").drop("floor")


def covered(stored: DataFrame, coverage: DataFrame, client: str = "client") -> DataFrame:
    """Stored rows that no coverage interval (client, start, end) of an authoritative source takes away."""
    hit = (F.col("r." + client) == F.col("c." + client)) & F.col("r.date").between(F.col("c.start"), F.col("c.end"))
    return stored.alias("r").join(coverage.alias("c"), hit, "left_anti")


def replace_window(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key that incoming has are replaced as a whole."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def apportion(rows: DataFrame, key: str, order: str, total: str, weight: str) -> DataFrame:
    """Whole parts of each key's total, by weight, that add up to it exactly."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    share = F.floor(F.col(total).cast("decimal(19,0)") * F.sum(weight).over(upto).cast("decimal(19,0)") / F.sum(weight).over(whole).cast("decimal(19,0)")).cast("long")
    before = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("upto", share).withColumn("part", F.col("upto") - F.coalesce(F.lag("upto").over(before), F.lit(0))).drop("upto")


def twins(rows: DataFrame, least: int) -> DataFrame:
    """Pairs of rows of different devices that agree in user, date, client and units, from least units on."""
    large = rows.where(F.col("units") >= least)
    a, b = large.select("user_id", "date", "client", "units", F.col("device").alias("device_a")), large.select("user_id", "date", "client", "units", F.col("device").alias("device_b"))
    return a.join(b, ["user_id", "date", "client", "units"]).where("device_a < device_b")


def monotonic(new: Column, old: Column) -> Column:
    return F.greatest(new, old)


def content_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def complete(rows: DataFrame, key: str, largest: list[str], flags: list[str], firsts: list[str], order: str, reported: str) -> DataFrame:
    """Reports of one message in several files: largest of each measure, any of each flag, first known of each text, and the cost that the source itself reported before any other."""
    cost = F.max_by("cost", F.struct((F.col("cost_source") == reported).cast("int"), -F.col(order)))
    texts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in largest], *[F.bool_or(c).alias(c) for c in flags], *texts, cost.alias("cost"))


def scoped_key(key: Column, path: Column, local_mark: str = ":tool_result:") -> Column:
    """A key that holds across files, but for those with the mark of keys that hold in their own file only."""
    return F.when(F.contains(key, F.lit(local_mark)), F.concat(path, F.lit("#"), key)).otherwise(key)


def incoming_fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one client and day as one: sums, the least schema and the largest counts of where they come from."""
    return rows.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"), F.min("schema").alias("schema"), F.max("n_models").alias("n_models"), F.array_join(F.sort_array(F.collect_set("model_id")), ",").alias("models"))


def folded_aliases(rows: DataFrame, aliases: dict[str, str], keys: list[str]) -> DataFrame:
    """Rows of a client's other names count as its own; sums of each key."""
    named = rows.replace(aliases, subset=["client"])
    return named.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"))


def reclaimed(rows: DataFrame, device: int, least: int) -> DataFrame:
    """Rows of other devices that equal one of the device's, from least units on, become the device's: they go, as it has them."""
    own = rows.where((F.col("device") == device) & (F.col("units") >= least)).select("user_id", "date", "client", "units").distinct()
    theirs = rows.where((F.col("device") != device) | F.col("device").isNull()).join(own, ["user_id", "date", "client", "units"], "left_anti")
    return rows.where(F.col("device") == device).unionByName(theirs)


def adopted(rows: DataFrame, legacy: int, device: int) -> DataFrame:
    """A user's rows of the legacy device become the device's where the user has no rows of any other device."""
    modern = rows.where(F.col("device") != legacy).select("user_id").distinct().withColumn("modern", F.lit(True))
    take = (F.col("device") == legacy) & F.col("modern").isNull()
    return rows.join(modern, "user_id", "left").withColumn("device", F.when(take, device).otherwise(F.col("device"))).drop("modern")


def unduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share a key: of each client the larger units, then totals, the earliest time and the longest activity."""
    clients = rows.groupBy(*keys, "client").agg(F.max("units").alias("units"), F.min("timestamp_ms").alias("timestamp_ms"), F.max("active_ms").alias("active_ms"))
    return clients.groupBy(*keys).agg(F.sum("units").alias("units"), F.count("*").alias("clients"), F.min("timestamp_ms").alias("timestamp_ms"), F.max("active_ms").alias("active_ms"))


def upserted(stored: DataFrame, incoming: DataFrame, key: str, texts: list[str], measures: list[str]) -> DataFrame:
    """All keys of both: a new text stands where it is known, measures of incoming rows replace stored ones."""
    both = stored.alias("s").join(incoming.alias("i"), F.col(f"s.{key}") == F.col(f"i.{key}"), "full")
    new = F.col(f"i.{key}").isNotNull()
    return both.select(F.coalesce(f"i.{key}", f"s.{key}").alias(key), *[F.coalesce(f"i.{c}", f"s.{c}").alias(c) for c in texts], *[F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in measures])


def uncovered(snapshots: DataFrame, executions: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots that no execution covers by any of the keys; a null key covers nothing."""
    for key in keys:
        snapshots = snapshots.join(executions.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return snapshots


def best_lane(rows: DataFrame, lane: str, scope: list[str], ids: list[str]) -> DataFrame:
    """Rows but for those that share an id with a row of a better (smaller) lane of their scope.

    Kinds of records that report the same events, from the most exact to the coarsest, are counted once. Every row has
    its say, also one that is left out itself; null ids are shared with none.
    """
    kept = rows
    for name in ids:
        best = rows.where(F.col(name).isNotNull()).groupBy(*scope, name).agg(F.min(lane).alias("__best"))
        # rows without the id meet nothing, and are kept out of the join, where they would all go to one task
        met = kept.where(F.col(name).isNotNull()).join(best, [*scope, name]).where(F.col(lane) <= F.col("__best")).select(kept.columns)
        kept = met.unionByName(kept.where(F.col(name).isNull()))
    return kept
