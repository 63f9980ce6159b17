"""The whole job of a batch against a plain walk over dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import submission as sb
from tidemark.plans import scans

ROW = "user_id long, device long, date string, client string, units long, revision long, note string"
COVER = "user_id long, device long, client string, start string, end string"
DAYS = [f"2024-01-{d:02d}" for d in range(1, 8)]


def plain(stored, incoming, spans):
    bad, new = {}, {}
    for u, d, day, c, n, r in incoming:
        if u is None or d is None:
            continue
        c = {"old": "a"}.get(c, c)
        for reason, broken in (("client", c not in ("a", "b")), ("units", n < 0), ("date", day == "2024-02-31"), ("future", day == "2024-09-09")):
            if broken:
                bad.setdefault((u, d), set()).add(reason)
        n0, r0 = new.get((u, d, day, c), (0, r))
        new[u, d, day, c] = (n0 + n, max(r0, r))
    new = {k: v for k, v in new.items() if k[:2] not in bad}
    senders = {k[:2] for k in new}
    modern = {u for u, d, *_ in stored if d != 0}
    first = {}
    for u, d in sorted(senders):
        if d != 0:
            first.setdefault(u, d)
    kept = {(u, first[u] if d == 0 and u not in modern and u in first else d, day, c): (n, r) for (u, d, day, c), (n, r) in stored.items()} if isinstance(stored, dict) else None
    floor = {}
    for (u, d, day, c), (n, r) in kept.items():
        floor[u, d, c] = max(floor.get((u, d, c), r), r)
    passing = {k: v for k, v in new.items() if v[1] >= floor.get((k[0], k[1], k[3]), v[1])}
    covered = {k for k in kept if k[:2] in senders and k not in new and any(s[0] == k[0] and s[1] == k[1] and s[2] == k[3] and s[3] <= k[2] <= s[4] for s in spans)}
    after = {}
    for k in {k for k in kept if k[:2] in senders and k not in covered} | set(passing):
        s, i = kept.get(k) if k not in covered else None, passing.get(k)
        if s and (i is None or i[1] < s[1] or i[1] == s[1] and i[0] < s[0]):
            if i is not None or s[0] > 0:
                after[k] = s
        elif i:
            after[k] = i
    twin = {(k[0], k[2], k[3], v[0]) for k, v in after.items() if v[0] >= 10}
    rest = {k: v for k, v in kept.items() if k[:2] not in senders and (k[0], k[2], k[3], v[0]) not in twin}
    return {**after, **rest}, {k: ",".join(sorted(v)) for k, v in bad.items()}


@pytest.mark.parametrize("seed", range(3))
def test_a_batch_equals_a_plain_walk(spark, seed):
    pick = random.Random(seed)
    stored = {}
    for u in range(12):
        for d in [0] if u % 3 == 0 else [0, 1, 2] if u % 3 == 1 else [1, 3]:
            for day in DAYS:
                for c in "ab":
                    if pick.random() < 0.6:
                        stored[u, d, day, c] = (pick.choice([0, 5, 10, 20]), pick.randint(1, 2))
    incoming = [(pick.choice([*range(14), None]), pick.choice([1, 2, 2, None]), pick.choice(DAYS), pick.choice(["a", "b", "old"]), pick.choice([0, 5, 10, 20]), pick.randint(1, 3)) for _ in range(150)]
    incoming += [(3, 1, DAYS[0], "c", 1, 1), (4, 1, DAYS[0], "a", -1, 1), (4, 1, "2024-02-31", "a", 1, 1), (5, 1, "2024-09-09", "a", 1, 1)]
    spans = [(u, d, c, DAYS[1], DAYS[3]) for u in range(12) for d in (1, 2, 3) for c in "ab" if pick.random() < 0.4]
    wanted, bad = plain(stored, incoming, spans)
    rows = lambda x: spark.createDataFrame([(*r, "clash") for r in x], ROW)
    found, refused = sb.submitted(rows([(*k, *v) for k, v in stored.items()]), rows(incoming), ["a", "b"], "2024-01-31", {"old": "a"}, spark.createDataFrame(spans, COVER))
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found.collect()} == wanted and found.count() == len(wanted)
    assert {(r["user_id"], r["device"]): r["reasons"] for r in refused.collect()} == bad and len(bad) >= 3


def test_nothing_sent_changes_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "2024-01-01", "a", 5, 1, "")], ROW)
    none = rows.limit(0)
    found, refused = sb.submitted(rows, none, ["a"], "2024-01-31")
    assert [tuple(r) for r in found.collect()] == [(1, 0, "2024-01-01", "a", 5, 1)] and refused.count() == 0
    assert sb.submitted(none, none, ["a"], "2024-01-31")[0].count() == 0
    first, _ = sb.submitted(none, rows, ["a"], "2024-01-31")
    assert first.count() == 1 and tuple(sb.totals(first).first()) == (1, 5, "2024-01-01", "2024-01-01", 1, "a")


def _exchanges(frame):
    """Shuffles in a frame's plan, before any of it runs."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_batch_is_dealt_out_once(spark):
    """Rows go by user once, and coverage to them; nothing is written or run on the way."""
    rows = spark.createDataFrame([(1, 0, DAYS[0], "a", 5, 1, ""), (None, 1, None, None, None, None, "")], ROW)
    spans = spark.createDataFrame([(1, 1, "a", DAYS[0], DAYS[1])], COVER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sparkContext.setJobGroup("batch", "a batch of submissions")
        found, refused = sb.submitted(rows, rows, ["a"], "2024-01-31", None, spans)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("batch")
        assert _exchanges(found) == 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_rows_stay_and_match_nothing(spark):
    stored = [(None, 1, DAYS[0], "a", 20, 1, ""), (1, None, DAYS[0], "a", 20, 1, ""), (1, 2, None, "a", 20, 1, ""), (1, 2, DAYS[0], None, 20, 1, ""), (1, 2, DAYS[0], "a", None, 1, ""), (1, 1, None, "a", 20, 1, ""), (1, 2, DAYS[1], "a", 20, 1, "")]
    sent = [(1, 1, DAYS[0], "a", 20, 1, ""), (None, 1, DAYS[0], "a", 20, 1, ""), (1, None, DAYS[0], "a", 20, 1, ""), (1, 1, DAYS[1], "a", 15, 1, ""), (1, 1, DAYS[1], "a", 5, 3, "")]
    found, refused = sb.submitted(spark.createDataFrame(stored, ROW), spark.createDataFrame(sent, ROW), ["a"], "2024-01-31")
    # the last stored row is the twin of two sent ones that add up
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([s[:6] for s in stored[:-1]] + [(1, 1, DAYS[0], "a", 20, 1), (1, 1, DAYS[1], "a", 20, 3)], key=repr)
    assert refused.count() == 0


def test_totals_need_no_shuffle_of_their_own(spark):
    rows = spark.createDataFrame([(1, 0, DAYS[0], "a", 5, 1, ""), (1, 1, DAYS[0], "a", 7, 1, "")], ROW)
    totals = sb.totals(sb.submitted(rows, rows.where("device = 1"), ["a"], "2024-01-31")[0])
    assert _exchanges(totals) == 1 and [tuple(r) for r in totals.collect()] == [(1, 12, DAYS[0], DAYS[0], 1, "a")]


def test_refused_are_told_from_what_was_sent_alone(spark):
    """Neither what is stored is read, nor a row after the batch made."""
    rows = spark.createDataFrame([(1, 1, DAYS[0], "c", -5, 1, "")], ROW)
    unreadable = rows.withColumn("units", F.raise_error(F.lit("stored rows were read")).cast("long"))
    refused = sb.submitted(unreadable, rows, ["a"], "2024-01-31")[1]
    assert _exchanges(refused) == 1 and [tuple(r) for r in refused.collect()] == [(1, 1, "client,units")]


def test_stored_rows_that_repeat_add_up_in_their_place(spark):
    stored = [(1, 0, DAYS[0], "a", 5, 1, ""), (1, 0, DAYS[0], "a", 7, 2, ""), (2, 1, DAYS[0], "a", 4, 1, ""), (2, 1, DAYS[0], "a", 5, 1, ""), (2, 1, DAYS[1], "a", 0, 1, ""), (2, 1, DAYS[1], "a", 0, 1, ""), (2, 2, DAYS[0], "a", 6, 1, ""), (2, 2, DAYS[0], "a", 4, 1, "")]
    sent = [(2, 1, DAYS[0], "a", 6, 1, ""), (2, 1, DAYS[0], "a", 4, 1, "")]
    found = sb.submitted(spark.createDataFrame(stored, ROW), spark.createDataFrame(sent, ROW), ["a"], "2024-01-31")[0]
    # the last two stored rows are together the twin of the two sent ones
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, DAYS[0], "a", 12, 2), (2, 1, DAYS[0], "a", 10, 1)]


def test_the_query_deals_stored_rows_out_once(spark):
    """Of three shuffles one is of all rows, and two of the covered days; what is stored needs none before."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        days = spark.createDataFrame([(1, 1, DAYS[0], "A", 5)], "user_id long, device long, date string, client string, units long")
        assert _exchanges(sb.totals(scans._submission(days)[0])) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
