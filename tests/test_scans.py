import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes as ch
from tidemark.sources.facts import warehouse_days
from tidemark.streaming import tables

ROWS = "id long, content string, updated long, kind string"


def snapshot(spark, rows):
    return spark.createDataFrame([(i, c, u, "clash") for i, c, u in rows], ROWS)


def plain(old, new):
    """Changes between two dictionaries of key and content."""
    found = [("rewrite", k, None) for k in old.keys() & new.keys() if old[k] != new[k]]
    fresh, gone = [k for k in new if k not in old], [k for k in old if k not in new]
    content = lambda keys, rows: {c: [k for k in keys if rows[k] == c] for c in {rows[k] for k in keys}}
    a, b = content(fresh, new), content(gone, old)
    pairs = {a[c][0]: b[c][0] for c in a.keys() & b.keys() if len(a[c]) == len(b[c]) == 1}
    found += [("rekey", k, v) for k, v in pairs.items()]
    found += [("insert", k, None) for k in fresh if k not in pairs] + [("delete", k, None) for k in gone if k not in pairs.values()]
    return sorted(found, key=str)


def seen(frame):
    return sorted(((r["kind"], r["id"], r["old_key"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_changes_are_those_of_plain_dictionaries(spark, seed):
    pick = random.Random(seed)
    # few contents: many rows share one, as a third of all rows may
    old = {k: pick.choice("abcdefgh") * pick.choice([1, 1, 1, 9]) for k in pick.sample(range(60), 35)}
    new = {k + (1000 if pick.random() < 0.2 else 0): v if pick.random() < 0.8 else v + "!" for k, v in old.items() if pick.random() < 0.8} | {k: "new" + str(k) for k in pick.sample(range(60, 90), 5)}
    a, b = snapshot(spark, [(k, v, 1) for k, v in old.items()] + [(None, "x", 1)]), snapshot(spark, [(k, v, 2) for k, v in new.items()] * 2 + [(None, "y", 1)])
    found = ch.changes(a, b, "id", ["content"])
    assert seen(found) == plain(old, new)
    assert {r["id"]: r["content"] for r in ch.applied(a, found, b, "id").where("id is not null").collect()} == new
    assert ch.changes(b, b, "id", ["content"]).count() == 0


def test_null_and_empty_contents_differ(spark):
    a, b = snapshot(spark, [(1, None, 1), (2, "", 1), (3, None, 1)]), snapshot(spark, [(1, "", 1), (2, "", 1), (4, None, 1)])
    assert seen(ch.changes(a, b, "id", ["content"])) == [("rekey", 4, 3), ("rewrite", 1, None)]
    empty = snapshot(spark, [])
    assert ch.changes(empty, empty, "id", ["content"]).count() == 0
    assert seen(ch.changes(a, empty, "id", ["content"])) == [("delete", k, None) for k in (1, 2, 3)]


def rescan(spark, mark, rows, columns=("content",)):
    found, mark, full = ch.rescanned(snapshot(spark, rows), mark, "id", list(columns), "updated")
    return seen(found), mark, full


def test_a_rescan_reads_what_was_touched(spark):
    first = [(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, "d", 30)]
    mark = ch.scanned(snapshot(spark, first), "id", ["content"], "updated")
    assert mark.high == 30
    # a rewrite long after its creation, a touch that changes nothing, a deletion, and a row under another key
    second = [(1, "A", 40), (2, "b", 41), (5, "d", 42), (6, "new", 30)]
    found, mark, full = rescan(spark, mark, second)
    assert not full and found == [("delete", 3, None), ("insert", 6, None), ("rekey", 5, 4), ("rewrite", 1, None)]
    assert mark.high == 42 and {(r["id"], r["updated"]) for r in mark.inventory.collect()} == {(1, 40), (2, 41), (5, 42), (6, 30)}
    found, mark, full = rescan(spark, mark, second)
    assert not full and found == []
    # a restored row is older than the mark: everything is read, with the same result
    third = [*second, (7, "old", 5)]
    found, mark, full = rescan(spark, mark, third)
    assert full and found == [("insert", 7, None)]
    # rows without a time, and another question, too
    found, mark, full = rescan(spark, mark, [*third, (8, "timeless", None)])
    assert full and found == [("insert", 8, None)]
    found, mark, full = rescan(spark, mark, third, ("content", "kind"))
    assert full and {k for k, _, _ in found} == {"rewrite", "delete"}
    found, mark, full = rescan(spark, mark, [], ("content", "kind"))
    assert {k for k, _, _ in found} == {"delete"} and mark.high is None
    assert rescan(spark, mark, [(1, "a", 1)], ("content", "kind"))[0] == [("insert", 1, None)]


def test_the_filter_of_a_rescan_reaches_the_files(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    mark = ch.scanned(events, "event_id", ["value"], "event_id")
    found, _, full = ch.rescanned(events, mark, "event_id", ["value"], "event_id")
    assert not full and found.count() == 0


USAGE = "user_id long, date string, client string, units long, revision long"


def stream(spark, tmp_path, batches, schema, keys, merge, buckets=4):
    """The table after each batch."""
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        query = tables.merged_into(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "state"), keys, merge, buckets)
        assert query.awaitTermination(120) and query.exception() is None
        now = tables.current(spark, path)
        yield set() if now is None else {tuple(r) for r in now.collect()}


def test_batches_never_shrink_a_table(spark, tmp_path):
    batches = [[(1, "d", "a", 10, 1), (2, "d", "a", 5, 1), (1, "d", "a", 4, 1)], [(1, "d", "a", 7, 1), (3, "d", "a", 1, 1)], [(1, "d", "a", 3, 2)]]
    found = stream(spark, tmp_path, batches, USAGE, ["user_id", "date", "client"], tables.never_shrinks(["user_id", "date", "client"]))
    wanted = [{(1, 10), (2, 5)}, {(1, 10), (2, 5), (3, 1)}, {(1, 3), (2, 5), (3, 1)}]
    for rows, want in zip(found, wanted):
        assert {(r[0], r[3]) for r in rows} == want
    path = str(tmp_path / "table")
    # the manifest before the last is still there, the first is not
    assert tables.current(spark, path, 2).count() == 3 and tables.current(spark, path, 1) is None
    assert tables.current(spark, str(tmp_path / "none")) is None


def test_the_first_batch_is_merged_with_itself(spark, tmp_path):
    schema = "id long, units long, updated_ms long, extra string"
    batches = [[(1, 5, 10, "x"), (1, 9, 20, "x"), (2, 1, 1, "x")], [(2, 7, 5, "x"), (2, 6, 4, "x")]]
    found = list(stream(spark, tmp_path, batches, schema, ["id"], tables.incoming_wins("id", ["units"])))
    assert found == [{(1, 9), (2, 1)}, {(1, 9), (2, 7)}]


def test_a_batch_writes_its_own_buckets_and_old_versions_go(spark, tmp_path):
    schema, path = "id long, units long", str(tmp_path / "table")
    merge = tables.incoming_wins("id", ["units"])
    rows = [(k, 0) for k in range(100)]
    tables.merge_batch(spark.createDataFrame(rows, schema), 0, path, ["id"], merge, 16)
    written = lambda v: {p.name for p in (tmp_path / "table" / f"v={v}").glob("__bucket=*")}
    assert len(written(0)) == 16
    for n in range(1, 5):
        tables.merge_batch(spark.createDataFrame([(7, n)], schema), n, path, ["id"], merge, 16)
        assert len(written(n)) == 1
    # a batch that runs again changes nothing
    tables.merge_batch(spark.createDataFrame([(7, 4)], schema), 4, path, ["id"], merge, 16)
    assert {tuple(r) for r in tables.current(spark, path).collect()} == {(k, 4 if k == 7 else 0) for k in range(100)}
    assert {tuple(r) for r in tables.current(spark, path, 4).collect()} == {(k, 3 if k == 7 else 0) for k in range(100)}
    assert len(written(0)) == 15 and {v for v in range(5) if written(v)} == {0, 3, 4}
    # an unfinished batch is as if it had not been
    (tmp_path / "table" / "_manifests" / "m=5").mkdir()
    assert tables.current(spark, path).where("units = 4").count() == 1


def test_tombstones_take_rows_away(spark, tmp_path):
    schema = "id long, units long, gone boolean"
    merge = tables.with_tombstones(["id"], tables.incoming_wins("id", ["units"]))
    batches = [[(1, 5, None), (2, 6, False), (3, 7, True), (3, 8, False)], [(1, None, True), (4, 1, False)], [(2, None, True), (4, None, True)], [(2, 3, None)]]
    assert list(stream(spark, tmp_path, batches, schema, ["id"], merge)) == [{(1, 5), (2, 6)}, {(2, 6), (4, 1)}, set(), {(2, 3)}]


def test_any_cut_into_batches_equals_one(spark, tmp_path):
    pick = random.Random(5)
    rows = [(pick.randint(0, 20), pick.randint(0, 99), at, "") for at in range(120)]
    schema, merge = "id long, units long, updated_ms long, extra string", tables.incoming_wins("id", ["units"])
    whole = list(stream(spark, tmp_path / "one", [rows], schema, ["id"], merge))[-1]
    assert list(stream(spark, tmp_path / "many", [rows[:7], rows[7:8], rows[8:]], schema, ["id"], merge))[-1] == whole


def test_lines_are_narrow_before_they_meet_orders(spark, sf_dir):
    """What the join shuffles are the days' own columns, not those that they are made of."""
    plan = warehouse_days(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert all(made in below and made not in above for made in ("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"))
