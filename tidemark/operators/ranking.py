"""Leaderboards: totals by user, ranks, search and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import is_small

#: Users whose ranks are found by comparing them with all totals.
MOST_ASKED = 1_000
#: The kinds of directives, and marks that end a sentence and not a value.
KINDS, CLOSING = ("client", "model"), ".,;)"


def totals(rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Units and cost of each user, over the days from since to until where given."""
    if since:
        rows = rows.where(F.col("date") >= since)
    if until:
        rows = rows.where(F.col("date") <= until)
    return rows.groupBy("user_id").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"))


#: Ranges of totals by which users are dealt, for each doubling of the total.
RANGES = 32


def _placed(users: DataFrame, order: list[Column], kind: Column) -> DataFrame:
    """kind (rank or row number) of each row, the largest first value of order first, without one task for all rows.

    Rows are dealt to ranges of the first value, a few thousand at most whatever the rows, so equal ones share a range;
    a range counts from the number of rows in the higher ranges.
    """
    key = order[0].cast("double")
    ranged = users.withColumn("__range", F.coalesce(F.floor(F.signum(key) * F.log2(F.abs(key) + 1) * RANGES), F.lit(-(1 << 20))))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    higher = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(higher), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(order[0].desc(), *order[1:])
    placed = ranged.withColumn("__at", kind.over(inside)).join(F.broadcast(before), "__range")
    return placed.withColumn("rank", (F.col("__at") + F.col("__before")).cast("int")).drop("__range", "__at", "__before")


def competition_rank(users: DataFrame, by: str = "units") -> DataFrame:
    """Equal totals share a rank, and leave a gap."""
    return _placed(users, [F.col(by)], F.rank())


def ordinal_rank(users: DataFrame, by: str = "units", then: str = "cost", name: str = "user_id") -> DataFrame:
    return _placed(users, [F.col(by), F.desc(then), F.col(name)], F.row_number())


def rank_of(users: DataFrame, user: Column, by: str = "units") -> DataFrame:
    """The total and rank (one more than the number of higher totals) of the users that the condition names; no row for an unknown one. A few are compared with all totals, many are ranked with all users."""
    own = users.where(user).select("user_id", F.col(by).alias("own"))
    if not is_small(own, MOST_ASKED):
        return competition_rank(users, by).join(own.select("user_id"), "user_id").select("user_id", by, "rank")
    higher = users.select(F.col(by).alias("other")).join(F.broadcast(own), F.col("other") > F.col("own")).groupBy("user_id").agg(F.count("*").alias("n"))
    return own.join(F.broadcast(higher), "user_id", "left").select("user_id", F.col("own").alias(by), (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def directives(search: str) -> tuple[dict[str, list[str]], str]:
    """kind:value words of a search, in lower case, and the free text that is left."""
    found: dict[str, list[str]] = {}
    rest = []
    for word in search.split():
        kind, colon, value = word.partition(":")
        kind = kind.lstrip("(\"'").lower()
        if colon and kind in KINDS and value:
            if value := value.lower().rstrip(CLOSING):
                found.setdefault(kind, []).append(value)
        else:
            rest.append(word)
    return found, " ".join(rest)


def matching_rows(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows whose client and model contain one of the texts of their kind."""
    for kind, column in (("client", "client"), ("model", "model_id")):
        if wanted.get(kind):
            any_of = F.lit(False)
            for text in wanted[kind]:
                any_of = any_of | F.contains(F.lower(column), F.lit(text))
            rows = rows.where(any_of)
    return rows


def users_with(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Users of whom any value of the column contains the text."""
    return rows.where(F.contains(F.lower(column), F.lit(text.lower()))).select("user_id").distinct()


def page(ranked: DataFrame, number: int, size: int = 50) -> DataFrame:
    number, size = min(max(number, 1), 500), min(max(size, 1), 100)
    return ranked.orderBy("rank", "user_id").offset((number - 1) * size).limit(size)
