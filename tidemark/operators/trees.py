"""Roots, marks and branches of parent chains, by pointer jumping: each round doubles the distance that a row has looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut_lineage


def roots(rows: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """key and root of each row; a parent that is no row's key ends the chain at the row itself. Rows on a cycle have no root."""
    known = rows.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    ends = known.select(F.col("id").alias("up")).distinct()
    step = cut_lineage(known.join(ends.withColumn("there", F.lit(True)), "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"), F.col("id").alias("top")), "roots")
    limit = max(1, step.count()).bit_length() + 1
    for _ in range(limit):
        if not step.where("up is not null").limit(1).count():
            break
        nearer = step.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("top").alias("end"))
        step = cut_lineage(step.join(nearer, "up", "left").select("id", F.col("further").alias("up"), F.when(F.col("up").isNull(), F.col("top")).otherwise(F.col("end")).alias("top")), "roots")
    return step.where("up is null").select(F.col("id").alias(key), F.col("top").alias("root"))


def below_marked(rows: DataFrame, group: list[str], key: str, parent: str, marked: str) -> DataFrame:
    """group, key and below: whether any row above it, by parents of its group, is marked.

    A row's answer covers twice as many ancestors after each round. Parents that are no row end a chain; on a cycle
    every row stands above every other and itself. Of several rows of one key one parent counts (the largest), and
    the key is marked if any of them is. Rows without a key are left out.
    """
    known = rows.where(F.col(key).isNotNull()).groupBy(*group, F.col(key).alias("id")).agg(F.max(parent).alias("up"), F.coalesce(F.max(F.col(marked)), F.lit(False)).alias("own"))
    own = known.select(*group, F.col("id").alias("up"), F.col("own").alias("marked"))
    first = known.alias("k").join(own.alias("o"), _same_named("k", "o", group) & (F.col("k.up") == F.col("o.up")), "left")
    step = cut_lineage(first.select(*[F.col(f"k.{g}").alias(g) for g in group], F.col("k.id").alias("id"), F.when(F.col("o.up").isNotNull(), F.col("k.up")).alias("up"), F.coalesce(F.col("o.marked"), F.lit(False)).alias("below")), "below")
    for _ in range(max(1, step.count()).bit_length()):
        if not step.where("up is not null and not below").limit(1).count():
            break
        # rows that know their answer need not look further
        open_, done = step.where("up is not null and not below"), step.where("up is null or below")
        nearer = step.alias("n")
        moved = open_.alias("k").join(nearer, _same_named("k", "n", group) & (F.col("k.up") == F.col("n.id")), "left")
        step = cut_lineage(done.unionByName(moved.select(*[F.col(f"k.{g}").alias(g) for g in group], F.col("k.id").alias("id"), F.col("n.up").alias("up"), F.coalesce(F.col("n.below"), F.lit(False)).alias("below"))), "below")
    return step.select(*group, F.col("id").alias(key), "below")


def _same_named(a: str, b: str, group: list[str]) -> Column:
    found = F.lit(True)
    for g in group:
        found = found & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return found


def on_last_branch(entries: DataFrame, log: list[str], key: str, parent: str, order: str) -> DataFrame:
    """log, key and active: whether an entry is the last one of its log or stands above it.

    Logs that grow by appending hold a tree: an entry names its parent, and going back to an earlier entry leaves a
    branch behind. All logs are walked at once: after each round the reached part of every branch is twice as long.
    Where the chain above the last entry names one that the log does not hold, all of the log's entries are active,
    as its part beyond the hole cannot be told. A cycle ends where it closes. Of several entries of one key the last
    one's parent counts; entries without a key are left out.
    """
    keyed = entries.where(F.col(key).isNotNull())
    known = keyed.groupBy(*log, F.col(key).alias("id")).agg(F.max_by(parent, order).alias("up"), F.max(order).alias("at"))
    ids = known.select(*log, F.col("id").alias("up"), F.lit(True).alias("there"))
    placed = known.alias("k").join(ids.alias("i"), _same_named("k", "i", log) & (F.col("k.up") == F.col("i.up")), "left")
    of = lambda name: [F.col(f"{name}.{g}").alias(g) for g in log]
    # beyond: the entry 1, 2, 4 ... places above; hole: a parent on the way is missing
    jump = cut_lineage(placed.select(*of("k"), F.col("k.id").alias("id"), F.when(F.col("i.there"), F.col("k.up")).alias("beyond"), (F.col("k.up").isNotNull() & F.col("i.there").isNull()).alias("hole")), "jumps")
    holes = jump.where("hole").select(*log, F.col("id"))
    reached = cut_lineage(known.groupBy(*log).agg(F.max_by("id", "at").alias("id")), "reached")
    size, rounds = reached.count(), max(1, jump.count()).bit_length()
    for _ in range(rounds):
        further = reached.alias("r").join(jump.alias("j"), _same_named("r", "j", log) & (F.col("r.id") == F.col("j.id"))).where("j.beyond is not null").select(*of("r"), F.col("j.beyond").alias("id"))
        reached = cut_lineage(reached.union(further).distinct(), "reached")
        found = reached.count()
        if found == size:
            break
        size = found
        twice = jump.alias("k").join(jump.alias("j"), _same_named("k", "j", log) & (F.col("k.beyond") == F.col("j.id")), "left")
        jump = cut_lineage(twice.select(*of("k"), F.col("k.id").alias("id"), F.col("j.beyond").alias("beyond")), "jumps")
    broken = reached.join(holes, [*log, "id"], "left_semi").select(*log).distinct().withColumn("broken", F.lit(True))
    marked = known.select(*log, "id").alias("k").join(reached.withColumn("on", F.lit(True)).alias("r"), _same_named("k", "r", log) & (F.col("k.id") == F.col("r.id")), "left").select(*of("k"), F.col("k.id").alias("id"), "on")
    whole = marked.alias("m").join(broken.alias("b"), _same_named("m", "b", log), "left")
    return whole.select(*of("m"), F.col("m.id").alias(key), F.coalesce(F.col("b.broken") | F.col("m.on"), F.col("m.on"), F.col("b.broken"), F.lit(False)).alias("active"))
