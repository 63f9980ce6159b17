"""Logs that grow, read where they grew: byte ranges behind a mark, and counters whose state outlives a run.

Two ways to keep a counter's state. counted() is a Structured Streaming query: Spark's state store holds one state a
log, saved with the checkpoint, so a stream that is stopped between any two batches goes on as if it had not been.
resumed() is the same as a batch job over a table of states, for logs that are read by marks.

Defined results: reports at or before the last place of their log that was handled are repeats and count nowhere, so
a batch that runs again adds nothing. Of several reports at one place the first of a batch counts. A null log is a
log of its own. Logs without new reports keep their state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.counters import PARTS, REPORT, Counter, split, told
from tidemark.session import cut_lineage, share_package
from tidemark.sources import adapters
from tidemark.sources.reading import opened

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes that are read at once, and the samples of what stands before a mark: so many, of so many bytes.
BLOCK, SAMPLES, SAMPLE = 1 << 20, 5, 4096
_STATE = ", ".join(f"{p} bigint" for p in PARTS)


def _new_parts(counter: Counter, rows: pd.DataFrame, after: int | None, order: str) -> tuple[list[tuple], int | None]:
    """order and parts of what each report adds, in order; and the last place handled."""
    found = []
    rows = rows.sort_values(order, kind="stable")
    for at, values in zip(rows[order], rows[REPORT].astype("Int64").to_numpy(dtype=object, na_value=None)):
        if after is not None and at <= after:
            continue
        after = int(at)
        added = counter.add(*told(values))
        if added is not None:
            found.append((after, *split(*added)))
    return found, after


class _Counted(StatefulProcessor):
    """One counter a log: its last total, and the last place that was handled."""

    def __init__(self, log: str, order: str):
        self.log, self.order = log, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("counter", f"place bigint, known boolean, {_STATE}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        counter, after = Counter(), None
        if self.kept.exists():
            after, known, *total = self.kept.get()
            counter.before = tuple(total) if known else None
        found, after = _new_parts(counter, pd.concat(rows), after, self.order)
        total = counter.before or (0,) * len(PARTS)
        self.kept.update((after, counter.before is not None, *total))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=[self.log, self.order, "input", "output", "cache_read", "reasoning"])

    def close(self) -> None:
        pass


def counted(reports: DataFrame, log: str, order: str) -> DataFrame:
    """counters.deltas of a stream of reports, whose logs may be cut anywhere into micro-batches.

    order is a whole number that grows along a log. A task holds the new reports of one log in a micro-batch, which
    the source's own limits bound, and Spark's state store one row a log. Needs spark.sql.streaming.stateStore.providerClass
    to be RocksDB's.
    """
    share_package(reports.sparkSession)
    source = reports.select(log, F.col(order).cast("long").alias(order), *[F.col(c).cast("long") for c in REPORT]).where(F.col(order).isNotNull())
    kind = source.schema[log].dataType.simpleString()
    schema = f"{log} {kind}, {order} bigint, input bigint, output bigint, cache_read bigint, reasoning bigint"
    return source.groupBy(log).transformWithStateInPandas(_Counted(log, order), schema, "Append", "None")


def resumed(reports: DataFrame, states: DataFrame | None, log: str, order: str) -> tuple[DataFrame, DataFrame]:
    """What new reports add, and the states after them; states is None at first, then what the last call gave.

    A log's state goes ahead of its reports, and its new state behind them; a task walks the rows of its logs in
    order and holds one counter. Rows and states are written once to the shared folder.
    """
    share_package(reports.sparkSession)
    source = reports.select(log, F.col(order).cast("long").alias(order), *[F.col(c).cast("long") for c in REPORT], F.lit(1).alias("kind")).where(F.col(order).isNotNull())
    if states is not None:
        before = states.select(log, F.col("place").alias(order), *[F.when(F.col("known"), F.col(p)).alias(f"total_{p}") for p in PARTS], *[F.lit(None).cast("long").alias(f"last_{p}") for p in PARTS], F.lit(0).alias("kind"))
        source = before.unionByName(source)
    kind = source.schema[log].dataType.simpleString()
    columns = [log, order, "known", *PARTS]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, counter, after = object(), Counter(), None
        seen = False

        def state() -> list[tuple]:
            return [(current, after, counter.before is not None, *(counter.before or (None,) * len(PARTS)))] if seen else []

        for batch in batches:
            rows = []
            values = batch[REPORT].astype("Int64").to_numpy(dtype=object, na_value=None)
            for name, at, new, row in zip(batch[log], batch[order], batch["kind"], values):
                name = None if pd.isna(name) else name
                if not seen or name != current:
                    rows += state()
                    current, counter, after, seen = name, Counter(), None, True
                if not new:
                    after, counter.before = int(at), told(row)[0]
                elif after is None or at > after:
                    after = int(at)
                    added = counter.add(*told(row))
                    if added is not None:
                        rows.append((name, after, None, *split(*added)))
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(state(), columns=columns)

    ordered = source.repartition(log).sortWithinPartitions(log, "kind", order)
    both = cut_lineage(ordered.mapInPandas(walk, f"{log} {kind}, {order} bigint, known boolean, {_STATE}"), "tails")
    added = both.where("known is null").select(log, order, "input", "output", F.col("cached").alias("cache_read"), "reasoning")
    return added, both.where("known is not null").select(log, F.col(order).alias("place"), "known", *PARTS)


def _guard(file: Any, offset: int) -> str:
    """A hash of samples of the bytes before offset, evenly spread: another file of the same name has another."""
    digest = hashlib.sha256(str(offset).encode())
    for k in range(SAMPLES):
        file.seek(max(offset - SAMPLE, 0) * k // (SAMPLES - 1))
        digest.update(file.read(min(SAMPLE, offset)))
    return digest.hexdigest()


def appended(spark: SparkSession, root: str, glob: str, marks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The whole lines that text files gained since marks, and the new marks; marks is None at first.

    lines: path, place (the byte where the line begins), line and anew, true where the file is not the one that was
    marked (shorter, or other bytes before the mark) and so is read from its start. A line without its end waits for
    the next call. marks: path, offset, guard; a file that is gone or
    empty loses its mark, one that cannot be opened keeps it.
    Only bytes behind the mark and a few samples before it are read; a task reads one file in blocks.
    """
    share_package(spark)
    listed = adapters.files(spark, root, glob).select("path")
    known = listed.join(marks, "path", "left") if marks is not None else listed.selectExpr("path", "cast(null as bigint) as offset", "cast(null as string) as guard")
    schema = "path string, place bigint, line string, anew boolean, offset bigint, guard string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, guard in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with opened(path) as file:
                        size = file.size()
                        same = offset is not None and size >= offset and _guard(file, offset) == guard
                        at = offset if same else 0
                        anew = offset is not None and not same
                        rest = b""
                        file.seek(at)
                        while block := file.read(min(BLOCK, size - at - len(rest))):
                            *lines, rest = (rest + block).split(b"\n")
                            places = []
                            for line in lines:
                                places.append(at)
                                at += len(line) + 1
                            yield _rows(path, places, [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], anew)
                        yield _mark(path, anew, at, _guard(file, at))
                except OSError:
                    if offset is not None:
                        yield _mark(path, False, offset, guard)

    names = ["path", "place", "line", "anew", "offset", "guard"]

    def _rows(path: str, places: list[int], lines: list[str], anew: bool) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string()), pa.array([anew] * n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)

    def _mark(path: str, anew: bool, offset: int, guard: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([anew]), pa.array([offset], pa.int64()), pa.array([guard], pa.string())], names=names)

    # files are dealt out by path: the listing itself is one small partition
    both = cut_lineage(known.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, schema), "appended")
    return both.where("offset is null").select("path", "place", "line", "anew"), both.where("offset is not null").select("path", "offset", "guard")
