import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import counters
from tidemark.plans.reports import _reports
from tidemark.sources.facts import event_facts
from tidemark.streaming import tails

SCHEMA = "log string, at long, " + ", ".join(f"{c} long" for c in counters.REPORT) + ", note string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tails.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def made(n=400, seed=3):
    """Reports of a few logs: totals that grow, repeat, fall back or are absent; one log without a name, one of a single report."""
    pick, rows, totals = random.Random(seed), [], {}
    for at in range(n):
        log = pick.choice(["a", "a", "a", "b", "c", None])
        step = [pick.randint(0, 40) for _ in range(4)]
        total = totals[log] = [x + y for x, y in zip(totals.get(log, [0] * 4), step)]
        kind = pick.random()
        told = total if kind < 0.6 else [x - pick.randint(0, 60) for x in total] if kind < 0.8 else [None] * 4
        rows.append((log, at, *told, *(step if pick.random() < 0.7 else [None] * 4), "clash"))
    return [*rows, ("single", 0, 5, 5, 5, 5, *[None] * 4, "")]


def rows(frame):
    return sorted(map(repr, map(tuple, frame.select("log", "at", "input", "output", "cache_read", "reasoning").collect())))


def test_a_stream_cut_anywhere_equals_the_batch(spark, tmp_path, rocksdb):
    everything = made()
    wanted = rows(counters.deltas(spark.createDataFrame(everything, SCHEMA), "log", "at"))
    for n, cuts in enumerate(([0, 500], [0, 37, 38, 250, 500])):
        inbox, out, state = (str(tmp_path / f"{d}{n}") for d in ("in", "out", "state"))
        for a, b in zip(cuts, cuts[1:]):
            # the last report before a cut comes again, as does the whole batch before it
            part = everything[max(a - 1, 0) : b]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(SCHEMA).parquet(inbox)
            # another query object each time: its state is the checkpoint's alone
            run = tails.counted(stream, "log", "at").writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
            assert run.awaitTermination(120) and run.exception() is None
        assert rows(spark.read.parquet(out)) == wanted


@pytest.mark.parametrize("cuts", [[0, 500], [0, 1, 200, 200, 500]])
def test_resumed_batches_equal_the_batch(spark, cuts):
    everything, states, found = made(seed=8), None, []
    for a, b in zip(cuts, cuts[1:]):
        added, states = tails.resumed(spark.createDataFrame(everything[max(a - 3, 0) : b], SCHEMA), states, "log", "at")
        found += rows(added)
    assert sorted(found) == rows(counters.deltas(spark.createDataFrame(everything, SCHEMA), "log", "at"))
    assert states.count() == 5
    again, states = tails.resumed(spark.createDataFrame(everything, SCHEMA), states, "log", "at")
    assert again.count() == 0
    nothing, same = tails.resumed(spark.createDataFrame([], SCHEMA), states, "log", "at")
    assert nothing.count() == 0 and sorted(map(repr, same.collect())) == sorted(map(repr, states.collect()))


def test_events_in_three_runs(spark, sf_dir):
    reports = _reports(event_facts(spark, sf_dir))
    third = reports.agg(F.max("event_id")).first()[0] // 3
    states, found = None, []
    for k in range(3):
        part = reports.where((F.col("event_id") > third * k - (k == 0)) & ((F.col("event_id") <= third * (k + 1)) | F.lit(k == 2)))
        added, states = tails.resumed(part, states, "user_id", "event_id")
        found += map(tuple, added.collect())
    assert sorted(found) == sorted(map(tuple, counters.deltas(reports, "user_id", "event_id").collect()))


def test_files_are_read_where_they_grew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tails, "BLOCK", 7)
    a, b = tmp_path / "with space" / "a.log", tmp_path / "b+c.log"
    a.parent.mkdir()
    a.write_bytes(b"one\r\ntwo\nthr")
    b.write_bytes(b"")
    seen = lambda lines: sorted((os.path.basename(r["path"]), r["place"], r["line"], r["anew"]) for r in lines.collect())
    lines, marks = tails.appended(spark, str(tmp_path), "*.log", None)
    assert seen(lines) == [("a.log", 0, "one", False), ("a.log", 5, "two", False)]
    assert sorted(r["offset"] for r in marks.collect()) == [9]  # an empty file is not listed
    with a.open("ab") as more:
        more.write(b"ee\n\nbad \xff byte\n")
    b.write_bytes(b"first\n")
    lines, marks = tails.appended(spark, str(tmp_path), "*.log", marks)
    assert seen(lines) == [("a.log", 9, "three", False), ("a.log", 15, "", False), ("a.log", 16, "bad � byte", False), ("b+c.log", 0, "first", False)]
    lines, marks = tails.appended(spark, str(tmp_path), "*.log", marks)
    assert seen(lines) == []
    # one file is written anew, one is cut short, a third is gone
    a.write_bytes(b"ONE\r\ntwo\nthree\n\nbad \xff byte\nmore\n")
    b.unlink()
    lines, marks = tails.appended(spark, str(tmp_path), "*.log", marks)
    assert [r[3] for r in seen(lines)] == [True] * 6 and marks.count() == 1
    a.write_bytes(b"x\n")
    lines, marks = tails.appended(spark, str(tmp_path), "*.log", marks)
    assert seen(lines) == [("a.log", 0, "x", True)]
