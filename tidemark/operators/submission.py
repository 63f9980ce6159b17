"""A batch of submissions against what is stored, as one job: checks, names, adoption, floors, guards, coverage, twins.

Rows are user_id, device, date, client, units and revision; a submission is what one device of a user sends. All
submissions of a batch are handled at once. No rule looks beyond a user, so stored and sent rows are dealt out by user
once, together, and each step is a window over rows that already lie in one place.

Defined results: a submission with a faulty row is refused whole, and changes nothing. Repeated rows of a day and
client add up, with the largest revision, stored ones among themselves as sent ones, so neither side needs a shuffle
before the one by user. Rows of devices that do not submit change only by adoption and as twins. Null users or devices
submit nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import validate as vd

OWNER, KEYS = ["user_id", "device"], ["user_id", "device", "date", "client"]
ROW = [*KEYS, "units", "revision"]


def _rules(clients: list[str], today: str) -> dict[str, Column]:
    """Reasons to refuse a row."""
    day = F.col("date").try_cast("date")
    return {"client": F.coalesce(~F.col("client").isin(clients), F.lit(True)), "units": F.coalesce(F.col("units") < 0, F.lit(True)), "date": day.isNull(), "future": day > F.date_add(F.lit(today).cast("date"), vd.DAYS_AHEAD)}


def faults(incoming: DataFrame, clients: list[str], today: str) -> DataFrame:
    """user_id, device and reasons (sorted, joined by commas) of submissions with a row that breaks a rule or lies in the future."""
    told = incoming.select(*OWNER, F.explode(F.array(*[F.when(broken, reason) for reason, broken in _rules(clients, today).items()])).alias("reason")).where("reason is not null")
    return told.groupBy(*OWNER).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def submitted(stored: DataFrame, incoming: DataFrame, clients: list[str], today: str, aliases: dict[str, str] | None = None, coverage: DataFrame | None = None, legacy: int = 0, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """All rows after a batch, and the refused submissions with their reasons; nothing runs before they are read.

    1. Submissions with a fault are refused. 2. A client's other names count as its own. 3. Rows of the legacy device
    become those of a user's first submitting device, if the user has no rows of another one. 4. Rows of a lower
    revision than the largest stored one of their device and client are dropped. 5. A stored row of the device stays
    where the new one has a lower revision, or the same and fewer units, or is not there. 6. coverage (user_id, device,
    client, start, end): days that a submission claims to tell in full; a stored row there that it does not name goes.
    7. Rows of a user's devices that do not submit go where they equal a submitting one's, from least units on.
    """
    named = incoming.where("user_id is not null and device is not null").select(ROW).replace(aliases or {}, subset=["client"])
    sent = named.withColumns({"sent": F.lit(True), "bad": reduce(or_, _rules(clients, today).values())})
    rows = stored.select(ROW).withColumns({"sent": F.lit(False), "bad": F.lit(False)}).unionByName(sent).repartition("user_id")
    user, device = Window.partitionBy("user_id"), Window.partitionBy(*OWNER)
    rows = rows.withColumn("bad", F.max("bad").over(device)).where("not (sent and bad)").drop("bad")
    # adoption
    other = F.col("device") != legacy
    rows = rows.withColumns({"modern": F.coalesce(F.max(~F.col("sent") & other).over(user), F.lit(False)), "first": F.min(F.when(F.col("sent") & other, F.col("device"))).over(user)})
    rows = rows.withColumn("device", F.when(~F.col("sent") & ~other & ~F.col("modern") & F.col("first").isNotNull(), F.col("first")).otherwise(F.col("device"))).drop("modern", "first")
    # coverage and floor, among the rows of submitting devices
    claimed = F.lit(False)
    if coverage is not None:
        spans = coverage.where("user_id is not null").groupBy("user_id").agg(F.collect_list(F.struct("device", "client", "start", "end")).alias("spans"))
        rows = rows.join(spans, "user_id", "left")
        claimed = F.coalesce(F.exists("spans", lambda s: (s["device"] == F.col("device")) & (s["client"] == F.col("client")) & F.col("date").between(s["start"], s["end"])), F.lit(False))
    rows = rows.select(*ROW, "sent", claimed.alias("claimed"))
    rows = rows.withColumns({"floor": F.max(F.when(~F.col("sent"), F.col("revision"))).over(Window.partitionBy(*OWNER, "client")), "sender": F.max("sent").over(device)})
    # guard: the sent rows of a key as one, against its stored rows as one; each is told at its first row
    key, later = Window.partitionBy("user_id", "date", "client", "device"), F.col("sent")
    rows = rows.withColumns({
        "s_units": F.sum(F.when(~later, F.col("units"))).over(key), "s_revision": F.max(F.when(~later, F.col("revision"))).over(key),
        "i_units": F.sum(F.when(later, F.col("units"))).over(key), "i_revision": F.max(F.when(later, F.col("revision"))).over(key), "named": F.max("sent").over(key),
        "head": ~F.lag("sent").over(key.orderBy("sent")).eqNullSafe(later),
    })
    passing = F.col("named") & (F.col("floor").isNull() | F.coalesce(F.col("i_revision") >= F.col("floor"), F.lit(False)))
    rows = rows.withColumn("passing", passing).withColumns({c: F.when(F.col("passing"), F.col(c)) for c in ("i_units", "i_revision")})
    rows = rows.withColumn("keep", F.coalesce(F.col("s_revision").isNotNull() & (F.col("i_revision").isNull() | (F.col("i_revision") < F.col("s_revision")) | ((F.col("i_revision") == F.col("s_revision")) & (F.col("i_units") < F.col("s_units")))), F.lit(False)))
    gone = "sender and claimed and not named"
    rows = rows.where(f"head and (not sender or not sent and keep and not ({gone}) and (i_revision is not null or s_units > 0) or sent and passing and not keep and (i_revision is not null or i_units > 0))")
    after = rows.select(*KEYS, F.when(later, F.col("i_units")).otherwise(F.col("s_units")).alias("units"), F.when(later, F.col("i_revision")).otherwise(F.col("s_revision")).alias("revision"), "sender")
    # twins
    own = F.collect_set(F.when(F.col("sender") & (F.col("units") >= least), F.col("units"))).over(Window.partitionBy("user_id", "date", "client"))
    twin = F.expr("not sender and device is not null and date is not null and client is not null") & F.coalesce(F.array_contains("own", F.col("units")), F.lit(False))
    return after.withColumn("own", own).where(~twin).select(ROW), faults(named, clients, today)


def totals(rows: DataFrame) -> DataFrame:
    """Units, first and last day, days and clients of each user, over all devices: what a profile shows after a batch."""
    return rows.groupBy("user_id").agg(F.sum("units").alias("units"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("days"), F.array_join(F.array_sort(F.collect_set("client")), ",").alias("clients"))
