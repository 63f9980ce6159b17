"""Which rows a report is about: clients, periods, public users, single users and logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import names


def client_list(asked: list[str], flags: list[str], defaults: list[str], known: list[str]) -> list[str]:
    """The clients asked for, in their order and once each: flags and lists beat defaults, unknown names are dropped."""
    chosen = [*flags, *asked] or defaults
    return [c for c in dict.fromkeys(c.strip().lower() for c in chosen) if c in known]


def by_clients(rows: DataFrame, clients: list[str], gateway: bool = False) -> DataFrame:
    """Rows of these clients, and with gateway also those that went through it, whatever their client."""
    wanted = F.col("client").isin(clients)
    return rows.where(wanted | names.is_gateway(F.col("client"), F.col("model_id"), F.col("provider_id")) if gateway else wanted)


def period(name: str, today: dt.date, since: str | None = None, until: str | None = None) -> tuple[str, str] | None:
    """First and last day of a period; None for all. since is also the viewer's own day for today and yesterday."""
    day = dt.date.fromisoformat(since) if since and name in ("today", "yesterday") else today
    first = today.replace(day=1)
    ends = {
        "today": (day, day),
        "yesterday": (day - dt.timedelta(1), day - dt.timedelta(1)),
        "week": (today - dt.timedelta(6), today),
        "month": (first, today),
        "last-month": ((first - dt.timedelta(1)).replace(day=1), first - dt.timedelta(1)),
    }
    if name == "custom":
        return (since, until) if since and until else None
    return tuple(d.isoformat() for d in ends[name]) if name in ends else None


def profile_range(name: str, today: dt.date) -> tuple[str, str] | None:
    """Of a profile: week and month are the last 7 and 30 days, year begins on the same day of the last year, or on the 28th of February."""
    if name == "year":
        last = today.year - 1
        start = dt.date(last, 2, 28) if (today.month, today.day) == (2, 29) else today.replace(year=last)
        return start.isoformat(), today.isoformat()
    days = {"week": 6, "month": 29}.get(name)
    return None if days is None else ((today - dt.timedelta(days)).isoformat(), today.isoformat())


def within(rows: DataFrame, days: tuple[str, str] | None, date: str = "date") -> DataFrame:
    return rows if days is None else rows.where(F.col(date).between(*days))


def of_year(rows: DataFrame, year: int | None, days: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a year; a period that is also given comes first."""
    if days is not None or year is None:
        return within(rows, days)
    return rows.where(F.startswith(F.col("date"), F.lit(f"{year:04d}-")))


def public(users: DataFrame) -> DataFrame:
    """Users who are neither banned nor private."""
    return users.where("banned_at is null and not coalesce(is_private, false)")


def one_user(users: DataFrame, name: str, column: str = "username") -> DataFrame:
    """The user of this name, whatever its case; an error where two have it."""
    found = users.where(F.lower(column) == name.lower()).limit(2)
    n = found.count()
    if n > 1:
        raise ValueError(f"{name!r} names more than one user")
    return found


def ambiguous_names(users: DataFrame, column: str = "username") -> DataFrame:
    """Names that more than one user has, but for case."""
    return users.groupBy(F.lower(column).alias("name")).agg(F.count("*").alias("users")).where("users > 1")


def without_free_cost(rows: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Rows but for those with a cost and no units; exempt ones stay."""
    tokenless = (F.col("cost") > 0) & (F.col("units") <= 0)
    return rows.where(~tokenless | (exempt if exempt is not None else F.lit(False)))


def banned(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Banned users with what they claimed, the latest ban first."""
    return users.where("banned_at is not null").join(totals, "user_id", "left").orderBy(F.desc("banned_at"), "user_id")


def log_entries(rows: DataFrame, since_ms: int | None = None, until_ms: int | None = None, workspace: str | None = None, client: str | None = None) -> DataFrame:
    """Entries from since on and before until, newest first."""
    for wanted in (None if since_ms is None else F.col("timestamp_ms") >= since_ms, None if until_ms is None else F.col("timestamp_ms") < until_ms, None if workspace is None else F.col("workspace") == workspace, None if client is None else F.col("client") == client):
        rows = rows if wanted is None else rows.where(wanted)
    return rows.orderBy(F.desc("timestamp_ms"), "event_id")
