"""Where results go: payloads, ledgers by month, caches by shard, and keyed updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, functions as F
from pyspark.sql.types import StructType

from tidemark.operators import aggregate as agg, merge as mg
from tidemark.session import cut_lineage

SHARDS = 256


def payload(facts: DataFrame, generated_at: str, version: str, device: dict[str, str] | None = None, times: DataFrame | None = None, revisions: dict[str, int] | None = None, coverage: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The report of all facts as one JSON document: meta, summary, years and days with their clients. It grows with days, never with rows.

    device: what tells the sending device; times: the one row of intervals.time_metrics; revisions: of the adapters,
    by client, of which those in the facts are told; coverage: by client the first and last day that the report tells
    in full. What is not given is not in the document.
    """
    flat = facts.groupBy("date", "client", "model_id").agg(*agg.measures())
    days = flat.groupBy("date").agg(F.sum("units").alias("units"), F.round(F.sum("cost"), 6).alias("cost"), F.sum("messages").alias("messages"), F.sort_array(F.collect_list(F.struct("client", F.col("model_id").alias("modelId"), "units", "cost", "messages"))).alias("clients"))
    years = flat.groupBy(F.substring("date", 1, 4).alias("year")).agg(F.sum("units").alias("totalUnits"), F.round(F.sum("cost"), 6).alias("totalCost"), F.struct(F.min("date").alias("start"), F.max("date").alias("end")).alias("range"))
    all_days = days.agg(F.sum("units").alias("units"), F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), F.sort_array(F.collect_list(F.struct("date", "units", "cost", "messages", "clients"))).alias("contributions"))
    all_years = years.agg(F.sort_array(F.collect_list(F.struct("year", "totalUnits", "totalCost", "range"))).alias("years"))
    meta = F.struct(F.lit(generated_at).alias("generatedAt"), F.lit(version).alias("version"), F.struct("start", "end").alias("dateRange"))
    summary = F.struct(F.col("units").alias("totalUnits"), F.col("cost").alias("totalCost"), F.col("n").alias("totalDays"))
    whole, parts = all_days.join(all_years), [meta.alias("meta")]
    if device:
        parts.append(F.struct(*[F.lit(v).alias(k) for k, v in device.items()]).alias("device"))
    parts += [summary.alias("summary"), F.col("years"), F.col("contributions")]
    if times is not None:
        names = {"active_ms": "totalActiveTimeMs", "longest_ms": "longestContinuousMs", "max_concurrent": "maxConcurrentSessions", "sessions": "sessionCount"}
        whole = whole.join(times.select(F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("timeMetrics")))
        parts.append(F.col("timeMetrics"))
    if revisions:
        told = F.create_map(*[x for c, r in sorted(revisions.items()) for x in (F.lit(c), F.lit(r))])
        spans = F.create_map(*[x for c, (first, last) in sorted((coverage or {}).items()) for x in (F.lit(c), F.struct(F.lit("full").alias("mode"), F.lit(first).alias("start"), F.lit(last).alias("end"), F.lit("tombstone").alias("missingData")))]) if coverage else None
        entry = F.struct("client", F.coalesce(F.element_at(told, F.col("client")), F.lit(1)).alias("parserRevision"), *([F.element_at(spans, F.col("client")).alias("coverage")] if coverage else []))
        clients = flat.select("client").distinct().agg(F.sort_array(F.collect_list(entry)).alias("clients") if not coverage else F.array_sort(F.collect_list(entry), lambda x, y: F.when(x["client"] < y["client"], -1).otherwise(1)).alias("clients"))
        whole = whole.join(clients.select(F.struct(F.lit(1).alias("schemaVersion"), "clients").alias("clientManifest")))
        parts.append(F.col("clientManifest"))
    return whole.select(F.to_json(F.struct(*parts)).alias("payload"))


def pretty(document: DataFrame) -> DataFrame:
    """The same, indented."""
    schema = F.schema_of_json(document.first()["payload"])
    return document.select(F.to_json(F.from_json("payload", schema), {"pretty": "true"}).alias("payload"))


def _merged(rows: DataFrame, path: str, parts: list[str], read: Callable[[DataFrameReader, str], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Rows with those that the folders of their parts have, cut from the files that are about to be replaced."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return merge(rows.limit(0), rows)
    kinds = StructType([f for f in rows.schema.fields if f.name not in parts] + [rows.schema[p] for p in parts])
    # touched folders alone are read: a semi join on partition columns is pruned at run time
    stored = read(spark.read.schema(kinds), path).join(F.broadcast(rows.select(*parts).distinct()), parts, "left_semi")
    return cut_lineage(merge(stored.select(rows.columns), rows), "merged")


def write_ledger(rows: DataFrame, path: str, key: str, date: str = "date") -> None:
    """JSON lines in a folder for each month, to which rows of new keys are added.

    A row whose key the month has stays as it is there; of several new rows of one key the smallest counts. Months
    that rows do not touch are not read. The key says in which month it is: a key that comes again under another
    month is looked up in the months of all rows given.
    """
    dated = rows.withColumn("month", F.substring(date, 1, 7))
    columns = [c for c in dated.columns if c != key]
    one = dated.groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select(key, "row.*").select(dated.columns)
    added = _merged(one, path, ["month"], lambda reader, p: reader.json(p), lambda stored, new: mg.ledger_append(stored, new, key))
    added.repartition("month").write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def write_cache(rows: DataFrame, path: str, key: str) -> None:
    """Parquet in a folder for each client and shard of the key; rows replace those of their client and key, and all others of the shards that they touch stay."""
    keys = ["client", key]
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int"))
    columns = [c for c in sharded.columns if c not in keys]
    one = sharded.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("row")).select(*keys, "row.*").select(sharded.columns)
    added = _merged(one, path, ["client", "shard"], lambda reader, p: reader.parquet(p), lambda stored, new: inserted(stored, new, keys))
    added.repartition("client", "shard").write.partitionBy("client", "shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def inserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, with incoming ones in place of those of equal keys, as a new snapshot."""
    return stored.join(incoming.select(*keys), keys, "left_anti").select(stored.columns).unionByName(incoming.select(stored.columns))


def updated(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the changes' columns where there are any; changes of unknown keys do nothing."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    both = stored.join(new, key, "left")
    changed = {c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns}
    return both.select(*[changed.get(c, F.col(c)) for c in stored.columns])
