"""Cases that the tables of the tests do not hold."""

from pyspark.sql import functions as F

from tidemark.operators import aggregate, intervals, merge, pricing, ranking, series, trees
from tidemark.plans import catalogue
from tidemark.sources import logs


def test_search_directives():
    assert ranking.directives("foo client:Codex, model:GPT-4.1. bar client:x) client: other:y") == ({"client": ["codex", "x"], "model": ["gpt-4.1"]}, "foo bar client: other:y")


def test_saturating_sum(spark):
    big = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "x long")
    assert big.agg(aggregate.saturating_sum("x")).first()[0] == 2**63 - 1


def test_gap_is_inclusive(spark):
    rows = [("c", "s", 1, 1, 1, 1.0, 1), ("c", "s", 180_001, 180_001, 1, 1.0, 1), ("c", "s", 360_002, 360_002, 1, 1.0, 1)]
    found = intervals.sessionize(spark.createDataFrame(rows, "client string, session_id string, start long, end long, units long, cost double, n int")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["messages"]) for r in found] == [(1, 180_001, 2), (360_002, 360_002, 1)]


def test_touching_intervals_overlap(spark):
    frame = spark.createDataFrame([(0, 10), (10, 20), (5, 5), (86_400_000 - 5, 86_400_000 + 5), (86_400_000, 86_400_001)], "start long, end long")
    assert intervals.max_concurrent(frame).first()[0] == 2
    assert intervals.max_concurrent(frame.limit(0)).first()[0] == 0


def test_keep_first_keeps_rows_without_a_key(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, key string")
    assert sorted(r["id"] for r in merge.keep_first(frame, "key", "id").collect()) == [1, 3, 4]


def test_monotonic_skips_nulls(spark):
    assert spark.range(1).select(merge.monotonic(F.lit(None).cast("long"), F.lit(3))).first()[0] == 3


def test_pricing_look_up(spark):
    models = spark.createDataFrame([("claude-x-1",), ("claude-x",), ("none",), ("claude-x-1",)], "model_id string")
    rates = spark.createDataFrame([("claude", 1.0), ("claude-x", 2.0)], "key string, input double")
    assert sorted((r["model_id"], r["key"]) for r in pricing.look_up(models, rates).collect()) == [("claude-x", "claude-x"), ("claude-x-1", "claude-x")]


def test_roots(spark):
    frame = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6)], "id long, parent long")
    assert sorted((r["id"], r["root"]) for r in trees.roots(frame).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_current_streak_allows_a_day(spark):
    days = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 1.0), ("2024-01-04", 0.0)], "date string, cost double")
    assert series.current_streak(days, "2024-01-03").first()["current"] == 2
    assert series.current_streak(days, "2024-01-04").count() == 0


def test_times(spark):
    frame = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("x",)], "t string")
    assert [r[0] for r in frame.select(logs.epoch_ms(F.col("t"))).collect()] == [1_700_000_000_000, 1_700_000_000_000, 1_704_067_200_000, 1_704_067_200_000, None]


def test_bad_lines_lose_only_themselves(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"id": 1}\n\n{broken\n{"id": 2}\n')
    (tmp_path / "y.txt").write_text('{"id": 3}\n')
    assert sorted(r["id"] for r in logs.json_lines(spark, str(tmp_path), "id long").collect()) == [1, 2]


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "new.csv").write_text("Date,Kind,Model,Max Mode,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost\n2024-01-01T00:00:00Z,k,m,No,1,2,3,4,10,$1.50\n")
    row = logs.csv_usage(spark, str(tmp_path / "new.csv")).first()
    assert (row["timestamp_ms"], row["input"], row["output"], row["cost"]) == (1_704_067_200_000, 2, 4, 1.5)


def test_streams(spark, tmp_path):
    from tidemark.streaming import usage

    source = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts, 'c' as client, 1L as user_id, id as units from range(5)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, client string, user_id long, units long").parquet(source)
    for name, frame, n in (("days", usage.streaming_days(stream), 1), ("sessions", usage.streaming_sessions(stream), 1)):
        query = frame.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.table(name).count() == n and spark.table(name).first()["units"] == 10


def test_day_series_cover_every_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    users, units = events.agg(F.count_distinct("user_id"), F.sum(F.col("k") + F.col("k") % 50 + F.col("k") * 3 % 40 + F.col("k") % 4 + F.col("k") % 5)).first()
    for name in ("dense_days_by_user", "trailing_average_by_user"):
        found = catalogue.QUERIES[name](spark, sf_dir)
        assert found.agg(F.count_distinct("user_id"), F.sum("units")).first() == (users, units)


def test_merged_sides_cover_every_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    for name in ("window_union_by_date", "ledger_append_by_date"):
        found = catalogue.QUERIES[name](spark, sf_dir).select("event_id")
        assert found.exceptAll(events).count() == events.exceptAll(found).count() == 0


def test_top_with_other_sorts_no_more_than_the_top(spark):
    frame = spark.createDataFrame([(None, 9), (1, 5), (1, 2), (2, 6), (3, 1), (4, 1)], "k int, units long")
    for most, wanted in ((2, {(None, 9), ("other", 15)}), (3, {(None, 9), ("1", 7), ("other", 8)}), (5, {(None, 9), ("1", 7), ("2", 6), ("3", 1), ("4", 1)})):
        found = series.top_with_other(frame, "k", most)
        assert {tuple(r) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("GlobalLimit")


def test_a_view_is_refreshed_beside_its_readers(spark, tmp_path):
    from tidemark.streaming import tables

    path = str(tmp_path / "gold")
    assert tables.current(spark, path) is None
    for n in range(1, 5):
        tables.refreshed(spark, path, lambda n=n: spark.range(n), n)
        assert tables.current(spark, path).count() == n
        if n > 1:
            assert tables.current(spark, path, n).count() == n - 1
    assert sorted(p.name for p in tmp_path.glob("gold/v=*")) == ["v=3", "v=4"]
    assert tables.read_again_from(10_000_000) == 6_100_000


def test_fragments_begin_and_end_where_words_do(spark):
    texts = ["azure/gpt-5.4-codex", "a--b", "", None, "-x-", "gpt5", "día/ñandú-2"]

    def plain(text):
        word = str.isalnum
        n = len(text)
        return sorted({text[a:e] for a in range(n) for e in range(a + 1, n + 1) if (a == 0 or not word(text[a - 1])) and (e == n or not word(text[e]))})

    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pricing.fragments(F.col("t"), 1).alias("f")).collect()
    assert all(sorted(r["f"] or []) == plain(r["t"] or "") for r in found)


def test_pricing_stages_sources_and_custom_rates(spark):
    rates = spark.createDataFrame(
        [
            ("openai/gpt-9-turbo", "openai", "second", 2.0, None), ("azure/gpt-9-turbo", "azure", "first", 3.0, None), ("gpt-9", "openai", "second", None, None), ("gpt-9-empty", "openai", "first", float("nan"), -1.0),
            ("poe/gpt-9-turbo-xl", "poe", "second", 9.0, 9.0), ("glm-9", "zai", "first", 0.0, 0.0), ("vendor/claude-9", "vendor", "first", 5.0, 5.0),
        ],
        "key string, provider string, source string, input double, output double",
    )
    price = lambda *names, **more: {r["model_id"]: (r["key"], r["stage"]) for r in pricing.look_up(spark.createDataFrame([(n,) for n in names], "model_id string"), rates, **more).collect()}
    # a row of nulls is no candidate: the name is then found inside others, the vendor's own row first, the longest without it
    found = price("gpt-9", "gpt-9-empty", "claude", "laude-9", "9-turbo", "glm-9")
    assert found == {"gpt-9": ("openai/gpt-9-turbo", 6), "9-turbo": ("openai/gpt-9-turbo", 6), "glm-9": ("glm-9", 0)}
    # the order of sources goes before what the catalogue's rows are
    assert price("gpt-9-turbo") == {"gpt-9-turbo": ("openai/gpt-9-turbo", 0)}
    assert price("gpt-9-turbo", sources=["first", "second"]) == {"gpt-9-turbo": ("azure/gpt-9-turbo", 0)}
    custom = spark.createDataFrame([("GPT-9-Turbo", 0.5, 0.5), ("glm-9", None, None)], "key string, input double, output double")
    assert price("gpt-9-TURBO", "glm-9", custom=custom) == {"gpt-9-TURBO": ("GPT-9-Turbo", -1), "glm-9": ("glm-9", 0)}
    hinted = lambda hint: pricing.look_up(spark.createDataFrame([("gpt-9-turbo", hint)], "model_id string, hint string"), rates).first()["key"]
    assert (hinted("azure"), hinted("openai"), hinted("")) == ("azure/gpt-9-turbo", "openai/gpt-9-turbo", "openai/gpt-9-turbo")
    sure = {r["model_id"]: tuple(r)[1:] for r in pricing.evidence(spark.createDataFrame([("gpt-9-turbo",), ("glm-9",), ("none-such",)], "model_id string"), rates).collect()}
    assert sure == {"gpt-9-turbo": (2, False, True, 0), "glm-9": (1, True, True, 0)}
    assert pricing.look_up(spark.createDataFrame([], "model_id string"), rates).count() == 0


def test_many_ranks_are_those_of_a_few(spark, monkeypatch):
    users = spark.createDataFrame([(k, k // 3, 0.0) for k in range(60)], "user_id long, units long, cost double")
    few = sorted(map(tuple, ranking.rank_of(users, F.col("user_id") < 20).collect()))
    monkeypatch.setattr(ranking, "MOST_ASKED", 5)
    assert sorted(map(tuple, ranking.rank_of(users, F.col("user_id") < 20).collect())) == few and len(few) == 20


def test_days_of_a_zone_are_as_long_as_its_clock_says(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from tidemark.operators import intervals

    ms = lambda text: int(datetime.fromisoformat(text + "+00:00").timestamp() * 1000)
    spans = [(ms("2024-03-08T00:00:00"), ms("2024-03-12T12:00:00")), (ms("2024-11-02T23:00:00"), ms("2024-11-05T00:00:00")), (ms("2024-03-09T05:00:00"), ms("2024-03-09T05:00:00")), (ms("2018-11-03T00:00:00"), ms("2018-11-05T12:00:00"))]
    frame = spark.createDataFrame([(a, b, b - a) for a, b in spans], "start long, end long, active_ms long")
    # the last one's clock skips midnight on 2018-11-04
    for zone in ("America/New_York", "America/Sao_Paulo", "Asia/Kathmandu", "UTC"):
        wanted = {}
        for a, b in spans:
            at = a
            while at < b:
                day = datetime.fromtimestamp(at / 1000, ZoneInfo(zone)).date()
                end = at
                # the first millisecond of the next day, by quarters of an hour
                while end < b and datetime.fromtimestamp(end / 1000, ZoneInfo(zone)).date() == day:
                    end += 900_000 - end % 900_000
                end = min(end, b)
                wanted[str(day)] = wanted.get(str(day), 0) + end - at
                at = end
        assert {r["date"]: r["active_ms"] for r in intervals.daily_active(frame, zone).collect()} == wanted, zone
    assert {r["date"]: r["active_ms"] for r in intervals.daily_active(frame, "America/New_York").collect()}["2024-03-10"] == 23 * 3_600_000
    assert intervals.daily_active(frame, "America/New_York").where("date = '2024-11-03'").first()["active_ms"] == 25 * 3_600_000
