"""What changed between two snapshots of a keyed table, and re-scans that read only what was touched since a mark.

Kinds of changes: insert, delete, rewrite (other content under the same key) and rekey (the same content under
another key). A deleted and an inserted row count as one rekey where their content occurs once among the deleted and
once among the inserted rows; where it occurs more often nothing tells which became which, and they stay apart.

Defined results: of several rows of one key the one with the largest content hash stands for it. Rows without a key
cannot be followed and are left out. Equal snapshots have no changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.merge import content_hash
from tidemark.session import cut_lineage


def inventory(rows: DataFrame, key: str, columns: list[str], updated: str | None = None) -> DataFrame:
    """key, hash of the content and, where given, the time of the last update: one row a key, a few dozen bytes."""
    time = F.col(updated) if updated else F.lit(None)
    kept = rows.where(F.col(key).isNotNull()).select(key, time.cast("long").alias("updated"), content_hash(columns).alias("hash"))
    return kept.groupBy(key).agg(F.max(F.struct("hash", "updated")).alias("last")).select(key, "last.hash", "last.updated")


def _with_rekeys(moved: DataFrame, key: str) -> DataFrame:
    """kind, key and old_key of changes: of moved(key, was, hash), hashes before and after of keys whose content changed."""
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("hash").isNull(), "delete").otherwise("rewrite")
    kinds = moved.withColumn("kind", kind)
    loose = kinds.where("kind <> 'rewrite'").withColumn("content", F.coalesce("hash", "was"))
    one = lambda k: F.count(F.when(F.col("kind") == k, 1))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col(key)))
    pairs = loose.groupBy("content").agg(one("insert").alias("inserted"), one("delete").alias("deleted"), of("insert").alias(key), of("delete").alias("old_key")).where("inserted = 1 and deleted = 1")
    rekeyed = pairs.select(F.lit("rekey").alias("kind"), key, "old_key")
    # keys are unique among changes, so a content that a third of all rows share is spread by them
    gone = rekeyed.select(F.col(key).alias("__k"), F.lit("insert").alias("__kind")).unionByName(rekeyed.select(F.col("old_key").alias("__k"), F.lit("delete").alias("__kind")))
    rest = kinds.join(gone, (F.col(key) == F.col("__k")) & (F.col("kind") == F.col("__kind")), "left_anti")
    return rest.select("kind", key, F.lit(None).cast(moved.schema[key].dataType).alias("old_key")).unionByName(rekeyed)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """kind, key and old_key (of rekeys) of every change from old to new: one full join of key and hash, not of rows."""
    before, after = inventory(old, key, columns).select(key, F.col("hash").alias("was")), inventory(new, key, columns).select(key, "hash")
    moved = before.join(after, key, "full").where("not (was <=> hash)")
    return _with_rekeys(cut_lineage(moved, "moved"), key)


def applied(old: DataFrame, found: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old snapshot with changes applied: rows of new are read for inserted, rewritten and rekeyed keys alone."""
    dropped = found.where("kind in ('delete', 'rewrite')").select(key).unionByName(found.where("kind = 'rekey'").select(F.col("old_key").alias(key)))
    added = found.where("kind <> 'delete'").select(key)
    return old.join(dropped, key, "left_anti").unionByName(new.join(added, key, "left_semi").select(old.columns))


@dataclass(frozen=True)
class Mark:
    """What a scan leaves for the next one: an inventory with update times, the latest of these, and what was asked."""

    inventory: DataFrame
    high: int | None
    question: str


def scanned(source: DataFrame, key: str, columns: list[str], updated: str) -> Mark:
    """The mark of a full scan."""
    seen = cut_lineage(inventory(source, key, columns, updated), "inventory")
    return Mark(seen, seen.agg(F.max("updated")).first()[0], _question(key, columns, updated))


def _question(key: str, columns: list[str], updated: str) -> str:
    return " ".join([key, updated, *sorted(columns)])


def rescanned(source: DataFrame, mark: Mark, key: str, columns: list[str], updated: str) -> tuple[DataFrame, Mark, bool]:
    """The changes since a mark, the new mark, and whether all rows had to be read.

    Keys and update times of all rows are read (two columns) and joined to the mark's. Rows that are new or have
    another time must have one from the mark's latest on; the rest of their columns is read behind that filter, which
    reaches the files. Where one has an earlier time (restored or backdated rows), or the mark answers another
    question, everything is read. A row whose content changed while its time stayed is not seen, as that is what a
    mark relies on.
    """
    asked = _question(key, columns, updated)
    if mark.question != asked or mark.high is None:
        return _in_full(source, mark, key, columns, updated)
    ids = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(updated).cast("long")).alias("now"))
    both = ids.join(mark.inventory.select(key, F.col("updated").alias("then"), F.col("hash").alias("was")), key, "full")
    moved = cut_lineage(both.where("not (now <=> then) or was is null or (now is null and then is null)"), "moved")
    there = moved.join(source.select(key).distinct(), key, "left_semi") if moved.where("now is null").limit(1).count() else moved
    if there.where(F.col("now").isNull() | (F.col("now") < mark.high)).limit(1).count():
        return _in_full(source, mark, key, columns, updated)
    recent = source.where(F.col(updated) >= mark.high)
    fresh = cut_lineage(inventory(recent.join(moved.select(key), key, "left_semi"), key, columns, updated), "fresh")
    compared = moved.select(key, "was").join(fresh.select(key, "hash"), key, "left").where("not (was <=> hash)")
    seen = cut_lineage(mark.inventory.join(moved.select(key), key, "left_anti").unionByName(fresh.select(mark.inventory.columns)), "inventory")
    return _with_rekeys(cut_lineage(compared, "moved"), key), Mark(seen, seen.agg(F.max("updated")).first()[0], asked), False


def _in_full(source: DataFrame, mark: Mark, key: str, columns: list[str], updated: str) -> tuple[DataFrame, Mark, bool]:
    new = scanned(source, key, columns, updated)
    same = mark.question == new.question
    before = mark.inventory.select(key, F.col("hash").alias("was"))
    # hashes of other columns say nothing: every key that both have counts as rewritten
    before = before if same else before.withColumn("was", F.lit(""))
    moved = before.join(new.inventory.select(key, "hash"), key, "full").where("not (was <=> hash)")
    return _with_rekeys(cut_lineage(moved, "moved"), key), new, True
