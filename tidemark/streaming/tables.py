"""Keyed tables that micro-batches merge into. A batch writes the buckets that its keys fall in, and a manifest that names the newest version of every bucket; until that is whole, readers see the table as it was.

A batch that runs again finds the manifest before it and writes the same again. Its cost goes with the buckets that
it touches: rows spread over `buckets` by a hash of the key, so give large tables many. Versions that neither of the
two newest manifests names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import merge as mg, profile as pf

#: Time before the last seen one that a source reads again: its hour of corrections, and five minutes for clocks.
CORRECTION_MS, SKEW_MS = 3_600_000, 300_000
#: Manifests that are kept, and so versions of a bucket that a reader may still be reading.
KEPT = 2

#: Gives the table's rows of some buckets from those stored (none, in the batch's columns, at first) and the batch's.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names of the folders below path, and whether each is finished, in any file system that Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return [(f.getPath().getName(), system.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) for f in system.listStatus(where)]


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(name[len(prefix) :]) for name, done in _listed(spark, path) if done and name.startswith(prefix))


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int] | None:
    """The version of each bucket that has rows; a row a bucket, so the driver can hold it. None where the table has no buckets."""
    every = _numbers(spark, f"{path}/_manifests", "m=")
    known = [n for n in every if before is None or n < before]
    if not known:
        return {} if every else None
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/_manifests/m={known[-1]}").collect()}


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before a batch; None where there is none or it has no rows."""
    buckets = _manifest(spark, path, before)
    if buckets is not None:
        return _of_buckets(spark, path, buckets)
    known = [v for v in _numbers(spark, path, "v=") if before is None or v < before]
    return spark.read.parquet(f"{path}/v={known[-1]}") if known else None


def _of_buckets(spark: SparkSession, path: str, buckets: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/v={v}/__bucket={b}" for b, v in buckets.items()]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], merge: Merge, buckets: int = 64) -> None:
    """Merge one batch, numbered upwards, into the table at path."""
    spark = batch.sparkSession
    before = _manifest(spark, path, number) or {}
    # a batch is read several times, and may come from a stream that is costly to read
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch.withColumn("__bucket", bucket).write.mode("overwrite").parquet(f"{path}/_batch")
    rows = spark.read.parquet(f"{path}/_batch")
    touched = [r[0] for r in rows.select("__bucket").distinct().collect()]
    incoming = rows.drop("__bucket")
    stored = _of_buckets(spark, path, {b: v for b, v in before.items() if b in touched})
    merged = merge(incoming.limit(0) if stored is None else stored, incoming)
    merged.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v={number}")
    written = {int(name.partition("=")[2]) for name, _ in _listed(spark, f"{path}/v={number}") if name.startswith("__bucket=")}
    after = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(written, number)
    spark.createDataFrame(sorted(after.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifests/m={number}")
    _clean(spark, path)


def _clean(spark: SparkSession, path: str) -> None:
    """Remove manifests but the newest, and versions of buckets that none of these names."""
    known = _numbers(spark, f"{path}/_manifests", "m=")
    kept = known[-KEPT:]
    named = {(b, v) for n in kept for b, v in (_manifest(spark, path, n + 1) or {}).items()}
    for v in _numbers(spark, path, "v="):
        there = [int(name.partition("=")[2]) for name, _ in _listed(spark, f"{path}/v={v}") if name.startswith("__bucket=")]
        gone = [b for b in there if (b, v) not in named]
        if len(gone) == len(there) and v < known[-1]:
            _removed(spark, f"{path}/v={v}")
            continue
        for b in gone:
            _removed(spark, f"{path}/v={v}/__bucket={b}")
    for n in known[:-KEPT]:
        _removed(spark, f"{path}/_manifests/m={n}")


def merged_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], merge: Merge, buckets: int = 64, **trigger: object) -> StreamingQuery:
    """A query that merges each micro-batch into the table at path; the number of buckets must stay the same."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, keys, merge, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def incoming_wins(key: str, columns: list[str]) -> Merge:
    """Rows of a batch replace stored ones of their key; of several in one batch the newest by updated_ms counts, if there is that column, or else the largest."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        time = ["updated_ms"] if "updated_ms" in batch.columns else []
        newest = pf.latest(batch, key, time[0], [*time, *columns]) if time else mg.largest_snapshot(batch, key, columns, columns)
        return mg.window_union(stored.select(key, *columns), newest.select(key, *columns), key, columns)

    return merge


def never_shrinks(keys: list[str]) -> Merge:
    """Late or smaller reports never replace larger ones, in the batch as in the table; what a batch does not name stays. Rows are the keys, units and revision."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        largest = batch.groupBy(*keys).agg(F.max(F.struct("revision", "units")).alias("most")).select(*keys, "most.units", "most.revision")
        named = stored.join(largest.select(*keys), keys, "left_semi")
        rest = stored.join(largest.select(*keys), keys, "left_anti").select(*keys, "units", "revision")
        return rest.unionByName(mg.guarded_merge(named, largest, keys))

    return merge


def with_tombstones(keys: list[str], merge: Merge, gone: str = "gone") -> Merge:
    """Rows of a batch whose column gone is true take their key's stored row away; the others go to merge. A key that comes with both is taken away."""

    def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
        taken = batch.where(F.col(gone)).select(*keys).distinct()
        left = batch.where(~F.coalesce(F.col(gone), F.lit(False))).drop(gone).join(taken, keys, "left_anti")
        return merge(stored.drop(gone).join(taken, keys, "left_anti"), left)

    return merged


def read_again_from(last_seen_ms: int) -> int:
    """Where a source that corrects its past is read from."""
    return last_seen_ms - CORRECTION_MS - SKEW_MS


def refreshed(spark: SparkSession, path: str, report: Callable[[], DataFrame], number: int) -> None:
    """A derived table written anew as a version of its own; readers keep the one before until it is whole, and older ones are removed."""
    report().write.mode("overwrite").parquet(f"{path}/v={number}")
    for v in _numbers(spark, path, "v=")[:-KEPT]:
        _removed(spark, f"{path}/v={v}")
