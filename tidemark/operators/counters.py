"""Usage from counters that only grow: what each report adds to the ones before it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import share_package

PARTS = ("input", "output", "cached", "reasoning")
REPORT = [f"{kind}_{p}" for kind in ("total", "last") for p in PARTS]
#: A total of at least so many hundredths of the one before is a late report, not a new count.
LATE_PERCENT = 98


class Counter:
    """The state of one log: the last total that counted."""

    def __init__(self) -> None:
        self.before: tuple[int, ...] | None = None

    def late(self, total: tuple[int, ...], last: tuple[int, ...]) -> bool:
        old, new, step = sum(self.before or ()), sum(total), sum(last)
        return min(old, new, step) > 0 and (new * 100 >= old * LATE_PERCENT or new + 2 * step >= old)

    def add(self, total: tuple[int, ...] | None, last: tuple[int, ...] | None) -> tuple[int, ...] | None:
        """What a report adds, or None where it does not count; an empty one never moves the state."""
        before = self.before
        grown = total is not None and before is not None and all(x >= y for x, y in zip(total, before))
        if total is None and last is None or total is not None and total == before:
            return None
        if last is not None:
            if total is not None and before is not None and not grown and self.late(total, last):
                return None
            found = last
            after = total if total is not None else tuple(x + y for x, y in zip(before, last)) if before is not None else None
        elif before is None:
            found = after = total
        elif grown:
            found, after = tuple(x - y for x, y in zip(total, before)), total
        else:
            self.before = total
            return None
        if not any(split(*found)):
            return None
        self.before = after
        return found


def told(row: Sequence[int | None]) -> tuple[tuple[int, ...] | None, tuple[int, ...] | None]:
    """Total and last of a report's eight values, each None where none of its parts is given; nothing counts below 0."""
    parts = (row[: len(PARTS)], row[len(PARTS) :])
    total, last = (tuple(max(x or 0, 0) for x in part) if any(x is not None for x in part) else None for part in parts)
    return total, last


def split(input_: int, output: int, cached: int, reasoning: int) -> tuple[int, int, int, int]:
    """Input without what was cached, output without reasoning, and both: parts that add up."""
    kept, thought = max(min(cached, input_), 0), min(max(reasoning, 0), max(output, 0))
    return max(input_ - kept, 0), max(output, 0) - thought, kept, thought


def split_columns(input_: Column, output: Column, cached: Column, reasoning: Column) -> dict[str, Column]:
    """The same of columns."""
    zero = F.lit(0).cast("long")
    kept, thought = F.greatest(F.least(cached, input_), zero), F.least(F.greatest(reasoning, zero), F.greatest(output, zero))
    return {"input": F.greatest(input_ - kept, zero), "output": F.greatest(output, zero) - thought, "cache_read": kept, "reasoning": thought}


def deltas(reports: DataFrame, log: str, order: str) -> DataFrame:
    """log, order and the split parts of each report that counts. reports has total_ and last_ columns of PARTS, null where absent.

    Logs are dealt and sorted by Spark; a task walks its rows in order and holds one log's state, never a whole log.
    """
    share_package(reports.sparkSession)
    columns = REPORT
    source = reports.select(log, order, *[F.col(c).cast("long") for c in columns])
    schema = f"{source.schema[log].simpleString().replace(':', ' ')}, {source.schema[order].simpleString().replace(':', ' ')}, input bigint, output bigint, cache_read bigint, reasoning bigint"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, counter = object(), Counter()
        for batch in batches:
            rows = []
            values = batch[columns].astype("Int64").to_numpy(dtype=object, na_value=None)
            for name, at, row in zip(batch[log], batch[order], values):
                if name != current:
                    current, counter = name, Counter()
                found = counter.add(*told(row))
                if found is not None:
                    rows.append((name, at, *split(*found)))
            yield pd.DataFrame(rows, columns=[log, order, "input", "output", "cache_read", "reasoning"])

    return source.repartition(log).sortWithinPartitions(log, order).mapInPandas(walk, schema)


def without_replays(reports: DataFrame, log: str, parent: str, order: str, content: list[str]) -> DataFrame:
    """Rows that a forked log repeats from its parent's history count once: the first by log and order of each parent and content."""
    family = F.coalesce(F.col(parent), F.col(log))
    first = F.min(F.struct(log, order))
    kept = reports.groupBy(family.alias("family"), *content).agg(first.alias("first"))
    return kept.select(F.col(f"first.{log}").alias(log), F.col(f"first.{order}").alias(order), *content)
