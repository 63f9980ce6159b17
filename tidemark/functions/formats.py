"""Numbers, times and labels as people read them, and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lenient_long(value: Column) -> Column:
    """A whole number written as one, or as text; null for all else."""
    return F.when(value.cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), value.cast("string").try_cast("bigint"))


def estimated_units(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def compact(count: Column) -> Column:
    """1.5K, 2.0M, 3.1B, 4.25T; what would round to 1000.0 goes to the next unit."""
    def scaled(unit: float, name: str, upper: str) -> Column:
        value = count / unit
        return F.when(value >= 999.95, F.concat(F.format_string("%.1f", value / 1000), F.lit(upper))).otherwise(F.concat(F.format_string("%.1f", value), F.lit(name)))

    tera = F.concat(F.regexp_replace(F.format_string("%.3f", count / 1e12), r"\.?0+$", ""), F.lit("T"))
    return F.when(count >= 1e12, tera).when(count >= 1e9, scaled(1e9, "B", "T")).when(count >= 1e6, scaled(1e6, "M", "B")).when(count >= 1e3, scaled(1e3, "K", "M")).otherwise(count.cast("string"))


def money(amount: Column) -> Column:
    """$12.34, $1.20K, $3.00M, $4.50B."""
    def scaled(unit: float, name: str, upper: str) -> Column:
        value = amount / unit
        return F.when(value >= 999.995, F.concat(F.lit("$"), F.format_string("%.2f", value / 1000), F.lit(upper))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", value), F.lit(name)))

    return F.when(amount >= 1e9, F.concat(F.lit("$"), F.format_string("%.2f", amount / 1e9), F.lit("B"))).when(amount >= 1e6, scaled(1e6, "M", "B")).when(amount >= 1e3, scaled(1e3, "K", "M")).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", amount)))


def percent(share: Column) -> Column:
    """One decimal; a share above nothing that would read 0.0% is <0.1%."""
    return F.when((share > 0) & (share < 0.05), "<0.1%").otherwise(F.concat(F.format_string("%.1f", share), F.lit("%")))


def duration(ms: Column) -> Column:
    """1h 1m, 1m 30s (seconds below ten minutes only), 5s, <1s; a dash for none."""
    total = F.floor(ms / 1000)
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    hours = F.when(m > 0, F.concat_ws(" ", text(h, "h"), text(m, "m"))).otherwise(text(h, "h"))
    minutes = F.when((s > 0) & (m < 10), F.concat_ws(" ", text(m, "m"), text(s, "s"))).otherwise(text(m, "m"))
    return F.when(ms.isNull() | (ms <= 0), "—").when(h > 0, hours).when(m > 0, minutes).when(s > 0, text(s, "s")).otherwise("<1s")


def relative(then_ms: Column, now_ms: Column) -> Column:
    """just now, 5m ago, 3h ago, 12d ago, 2mo ago, 1y ago; never for none."""
    minutes = F.floor((now_ms - then_ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(then_ms.isNull(), "never").when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 30, ago(days, "d")).when(days < 365, ago(F.floor(days / 30), "mo")).otherwise(ago(F.floor(days / 365), "y"))


def masked(name: Column) -> Column:
    """The first and last two characters of a device's name; of a short one the first only."""
    plain = F.trim(name)
    n = F.length(plain)
    return F.when(n == 0, "").when(n <= 4, F.concat(F.substring(plain, 1, 1), F.lit("***"))).otherwise(F.concat(F.substring(plain, 1, 2), F.lit("****"), F.right(plain, F.lit(2))))


def cloud_provider(key: Column) -> Column:
    """The provider in a cloud device's key, null for other devices."""
    found = F.regexp_extract(key, "^cloud_([a-z]+)_([0-9a-f]{32})$", 1)
    return F.when(found != "", found)


def verified(links: Column, least: int = 2) -> Column:
    return F.coalesce(F.size(links) >= least, F.lit(False))


def stale(updated_ms: Column, now_ms: Column, days: int = 30) -> Column:
    """Older than so many days; null times are not."""
    return F.coalesce(now_ms - updated_ms > days * 86_400_000, F.lit(False))


def day_key(ts_ms: Column, zone: str) -> Column:
    """The calendar day in a zone, null for times that are none."""
    return F.when(ts_ms > 0, F.date_format(F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone), "yyyy-MM-dd"))


def hour_key(ts_ms: Column, zone: str) -> Column:
    """The calendar day and hour in a zone, null for times that are none; an hour that a clock repeats is one."""
    return F.when(ts_ms > 0, F.date_format(F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone), "yyyy-MM-dd HH:00"))


def rebucketed(ts_ms: Column, date: Column, zone: str) -> Column:
    """The day in a zone; rows without a time keep the day that they have."""
    return F.coalesce(day_key(ts_ms, zone), date)


def week_place(date: Column, first: Column) -> tuple[Column, Column]:
    """Week and weekday (from Sunday, 0) of a date in a grid that begins on the Sunday on or before first."""
    sunday = F.date_sub(first, F.dayofweek(first) - 1)
    days = F.date_diff(date, sunday)
    return F.floor(days / 7).cast("int"), (days % 7).cast("int")
