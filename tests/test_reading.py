"""Files that are large, broken, or in another mode than a plain copy of their bytes can be read in."""

import json
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.sources import adapters, reading, sinks


def seen(frame):
    return sorted((r["path"].rsplit("/", 1)[1], r["place"], r["line"]) for r in frame.collect())


@pytest.mark.parametrize("size", [1, 3, 10, 64, 1 << 20])
def test_ranges_of_any_size_give_the_same_lines(spark, tmp_path, size):
    raw = {"a.log": b"one\n\ntwo \xff\r\nlast without end", "b c+d.log": b"x" * 100 + b"\n" + b"y\n" * 20, "empty.log": b"", "end.log": b"\n\n"}
    wanted = []
    for name, content in raw.items():
        (tmp_path / name).write_bytes(content)
        at = 0
        for line in content.splitlines(keepends=True) if content else []:
            wanted.append((name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
            at += len(line)
    assert seen(reading.lossy_lines(spark, str(tmp_path), "*.log", size)) == sorted(wanted)
    assert reading.damages(spark, str(tmp_path), "*.log").count() == 0


def test_a_broken_archive_loses_only_itself(spark, tmp_path, monkeypatch):
    pack = zstandard.ZstdCompressor().compress
    text = b"".join(b'{"n": %d}\n' % k for k in range(5_000))
    (tmp_path / "whole.zst").write_bytes(pack(text))
    (tmp_path / "frames.zst").write_bytes(pack(b"first\n") + pack(b"second\n"))
    (tmp_path / "cut.zst").write_bytes(pack(text)[:-200])
    (tmp_path / "short.zst").write_bytes(pack(b"one more frame\n") + pack(text)[:6])
    (tmp_path / "garbage.zst").write_bytes(b"no archive at all")
    found = seen(reading.lossy_lines(spark, str(tmp_path), "*.zst"))
    assert [f for f in found if f[0] != "whole.zst"] == [("frames.zst", 0, "first"), ("frames.zst", 6, "second")]
    assert len(found) == 5_002
    bad = {r["path"].rsplit("/", 1)[1] for r in reading.damages(spark, str(tmp_path), "*.zst").collect()}
    assert bad == {"cut.zst", "short.zst", "garbage.zst"}


def test_an_archive_that_decodes_without_end_is_left_out(tmp_path):
    path = tmp_path / "bomb.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress(b"\0" * 5_000_000))
    with reading.opened(str(path)) as file:
        assert reading.archive_damage(file, 1_000_000) == "decodes to more than 1000000 bytes"
    with reading.opened(f"file:{path}") as file:
        assert reading.archive_damage(file) is None
    with pytest.raises(OSError):
        reading.opened("nosuchsystem://host/file")


def test_databases_in_either_mode(spark, tmp_path):
    for mode in ("delete", "wal"):
        base = sqlite3.connect(tmp_path / f"{mode}.db", isolation_level=None)
        base.execute(f"pragma journal_mode = {mode}")
        base.execute("create table t(a int, b text)")
        base.execute("insert into t values (1, 'x'), (2, cast(x'ff41' as text))")
        if mode == "wal":
            # a writer is still there: the rows stand in the log beside the database alone
            keep = base
            assert (tmp_path / "wal.db-wal").stat().st_size > 0
        else:
            base.close()
    (tmp_path / "other.db").write_bytes(b"no database")
    sqlite3.connect(tmp_path / "schema.db").execute("create table another(x)").connection.close()
    asked = ["select nowhere from t", "select a, b from t order by a"]
    rows = seen(reading.sqlite_rows(spark, str(tmp_path), "*.db", asked))
    keep.close()
    assert [(f, p, json.loads(r)) for f, p, r in rows] == [(f"{m}.db", k, {"a": k + 1, "b": b}) for m in ("delete", "wal") for k, b in enumerate(["x", "�A"])]
    assert [r["path"].rsplit("/", 1)[1] for r in reading.damages(spark, str(tmp_path), "*.db", asked).collect()] == ["other.db"]


def test_files_of_a_system_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_bytes(b"one\ntwo\n")
    base = sqlite3.connect(tmp_path / "w.db", isolation_level=None)
    base.execute("pragma journal_mode = wal")
    base.execute("create table t(a int)")
    base.execute("insert into t values (7)")
    monkeypatch.setattr(reading, "SYSTEMS", {})
    assert seen(reading.lossy_lines(spark, str(tmp_path), "*.log", 2)) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert [json.loads(r[2]) for r in seen(reading.sqlite_rows(spark, str(tmp_path), "w.db", "select a from t"))] == [{"a": 7}]
    base.close()


def test_sessions_with_only_cached_units_or_cost_count(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "state.db")
    base.executescript(
        """create table sessions(id text, model text, started_at real, message_count int, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, billing_provider text, estimated_cost_usd real, actual_cost_usd real);
create table session_model_usage(session_id text, model text, billing_provider text, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, estimated_cost_usd real, actual_cost_usd real);
insert into sessions values ('cached', 'm', 1767000000, 4, 0, 0, 500, 0, 0, null, 0.5, null), ('cost', 'm', 1767000000, 2, null, null, null, null, null, null, 0.25, null), ('none', 'm', 1767000000, 1, 0, 0, 0, 0, 0, null, 0, null), ('blank', ' ', 1767000000, 1, 5, 5, 0, 0, 0, null, 1, null),
 ('models', 'main', 1767000000, 9, 1, 1, 1, 1, 1, null, 7, null), ('empty', 'm', 1767000000, 3, 5, 0, 0, 0, 0, null, null, null);
insert into session_model_usage values ('models', 'aside', 'x', 0, 0, 0, 3, 0, 0.1, 0), ('models', 'main', 'x', 2, 0, 0, 0, 0, 0.2, 0.3), ('models', 'main', 'y', 0, 0, 0, 0, 6, null, null), ('models', 'idle', 'y', 0, 0, 0, 0, 0, 0, null), ('empty', '', 'y', 5, 0, 0, 0, 0, 0, null);"""
    )
    base.commit()
    base.close()
    found = {(r["session_id"], r["model_id"], r["dedup_key"].rsplit(":", 1)[1]): r for r in adapters.facts(spark, "hermes", str(tmp_path)).collect()}
    assert {k: (r["input"], r["cache_read"], r["cache_write"], r["reasoning"], r["cost"], r["message_count"]) for k, r in found.items()} == {
        ("cached", "m", "<null>"): (0, 500, 0, 0, 0.5, 4), ("cost", "m", "<null>"): (0, 0, 0, 0, 0.25, 2),
        ("models", "main", "x"): (2, 0, 0, 0, 0.3, 9), ("models", "main", "y"): (0, 0, 0, 6, 0.0, 0), ("models", "aside", "x"): (0, 0, 3, 0, 0.1, 0),
    }


def test_both_schemas_of_one_format(spark, tmp_path):
    data = json.dumps({"role": "assistant", "modelID": "gpt-5.4", "providerID": "openai", "cost": 0.5, "time": {"created": 1_767_000_000_000}, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}})
    second = json.loads(data)
    del second["role"]
    for name, made in (
        ("first", ["create table message(id, session_id, data)", "create table session(id, title, directory)", "insert into session values ('s', 'a title', '/w')", ("insert into message values ('m', 's', ?)", data)]),
        ("bare", ["create table message(id, session_id, data)", ("insert into message values ('m', 's', ?)", data)]),
        ("second", ["create table session_message(id, session_id, type, data)", "create table session_v2(id, title, directory)", ("insert into session_message values ('n', 's', 'assistant', ?)", json.dumps(second)), ("insert into session_message values ('o', 's', 'user', ?)", json.dumps(second))]),
    ):
        (tmp_path / name).mkdir()
        base = sqlite3.connect(tmp_path / name / "opencode.db")
        for x in made:
            base.execute(*([x] if isinstance(x, str) else (x[0], (x[1],))))
        base.commit()
        base.close()
        found = adapters.facts(spark, "opencode", str(tmp_path / name)).collect()
        assert [(r["session_id"], r["message_id"], r["input"], r["output"], r["reasoning"], r["cache_read"], r["cache_write"], r["cost"]) for r in found] == [("s", "n" if name == "second" else "m", 1, 2, 3, 4, 5, 0.5)]
    rows = reading.sqlite_rows(spark, str(tmp_path / "first"), "*.db", adapters.ADAPTERS["opencode"].statement).collect()
    assert json.loads(rows[0]["line"])["title"] == "a title"


def test_ledgers_and_caches_keep_what_they_have(spark, tmp_path):
    rows = "date string, client string, id long, units long"
    days = lambda *r: spark.createDataFrame(list(r), rows)
    ledger, cache = str(tmp_path / "ledger"), str(tmp_path / "cache")
    first, second = days(("2026-01-05", "a", 1, 1), ("2026-02-05", "b", 2, 2)), days(("2026-02-06", "b", 3, 3), ("2026-02-07", "b", 2, 99), ("2026-03-01", "c", 4, 4), ("2026-03-01", "c", 4, 4))
    for frame in (first, second, second):
        sinks.write_ledger(frame, ledger, "id")
        sinks.write_cache(frame, cache, "id")
    back = lambda frame: sorted((r["id"], r["date"], r["units"]) for r in frame.collect())
    # a ledger keeps the row it had, a cache takes the new one
    assert back(spark.read.schema(rows).json(ledger)) == [(1, "2026-01-05", 1), (2, "2026-02-05", 2), (3, "2026-02-06", 3), (4, "2026-03-01", 4)]
    assert back(spark.read.parquet(cache)) == [(1, "2026-01-05", 1), (2, "2026-02-07", 99), (3, "2026-02-06", 3), (4, "2026-03-01", 4)]
    sinks.write_ledger(days(), ledger, "id")
    sinks.write_cache(days(), cache, "id")
    assert spark.read.json(ledger).count() == spark.read.parquet(cache).count() == 4
    assert spark.read.parquet(cache).where(F.col("client") == "b").select("shard").distinct().count() <= 2


def test_exports_as_comma_separated_lines(spark, tmp_path):
    """Three layouts of the heading; quotes, signs of money and commas; the JSON export of the same name goes first."""
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("usage.csv", 'Date,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total,Cost\n"2026-01-02T03:04:05.678Z",gpt-5.4,1,2,3,4,10,"$1,234.50"\n2026-01-03, "claude-opus-4-6" ,x,-5,7,8,9,NaN\n\nshort,line\nno date,gpt-5.4,1,1,1,1,1,1\n2026-01-03,,1,1,1,1,1,1\n')
    put("usage.a b.csv", 'Date,Kind,Model,Max Mode,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost\n2026-01-02T03:04:05Z,"Included, free",gpt-5.4,No,1,2,3,4,10,0.5\n')
    put("usage.wide.csv", "Date,User,Kind,Team,Model,Max,In W,In,Read,Out,Total,Cost\n2026-01-02T03:04:05,u,k,t,gpt-5.4,No,1,2,3,4,10,-3\n")
    put("usage.both.csv", "Date,Model,a,b,c,d,e,f\n2026-01-02,gpt-5.4,9,9,9,9,9,9\n")
    put("usage.both.json", json.dumps({"usageEventsDisplay": [{"conversationId": "c", "timestamp": "1767000000000", "model": "gpt-5.4", "tokenUsage": {"inputTokens": 1}}]}))
    put("usage.other.csv", "no,heading\n1,2,3,4,5,6,7,8\n")
    found = sorted((r["session_id"], r["model_id"], r["provider_id"], r["input"], r["output"], r["cache_read"], r["cache_write"], r["cost"], r["timestamp_ms"]) for r in adapters.facts(spark, "cursor", str(tmp_path)).collect())
    assert found == [
        ("c", "gpt-5.4", "openai", 1, 0, 0, 0, None, 1_767_000_000_000),
        ("cursor-a-b-2026-01-02T03:04:05Z", "gpt-5.4", "openai", 2, 4, 3, 1, 0.5, 1_767_323_045_000),
        ("cursor-active-2026-01-02T03:04:05.678Z", "gpt-5.4", "openai", 2, 4, 3, 1, 1234.5, 1_767_323_045_678),
        ("cursor-active-2026-01-03", "claude-opus-4-6", "anthropic", 0, 8, 7, 0, None, 1_767_441_600_000),
        ("cursor-wide-2026-01-02T03:04:05", "gpt-5.4", "openai", 2, 4, 3, 1, None, 1_767_323_045_000),
    ]


def test_messages_of_sessions_in_a_database(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "sessions.db")
    base.execute("create table sessions(id text, model text, working_directory text)")
    base.execute("create table message_nodes(row_id integer, session_id text, chat_message text, created_at integer)")
    base.executemany("insert into sessions values (?, ?, '')", [("s", "gpt-5.4"), ("t", "adaptive"), ("u", None)])
    chat = lambda role="assistant", **m: json.dumps({"role": role, "metadata": m})
    used = {"input_tokens": 5, "output_tokens": 6, "cache_read_tokens": 7, "cache_creation_tokens": -1, "total_time_ms": 2_500}
    rows = [("s", chat(metrics=used, request_id=" r ")), ("s", chat(num_tokens=9)), ("s", chat("user", num_tokens=9)), ("s", chat()), ("s", "no json"), ("t", chat(num_tokens=1)), ("t", chat(num_tokens=2, generation_model="claude-x", metrics={})), ("u", chat(num_tokens=3)), ("gone", chat(num_tokens=4))]
    base.executemany("insert into message_nodes values (?, ?, ?, ?)", [(k, s, c, None if k == 1 else 1_767_323_045) for k, (s, c) in enumerate(rows)])
    base.commit()
    base.close()
    found = {r["dedup_key"]: (r["model_id"], r["provider_id"], r["input"], r["output"], r["cache_read"], r["cache_write"], r["timestamp_ms"]) for r in adapters.facts(spark, "devin-cli", str(tmp_path)).collect()}
    when = found.pop("devin-cli:s:row:1")
    assert when[:6] == ("gpt-5.4", "openai", 0, 9, 0, 0) and when[6] > 1_767_323_045_000
    assert found == {"devin-cli:s:request:r": ("gpt-5.4", "openai", 5, 6, 7, 0, 1_767_323_042_500), "devin-cli:t:row:6": ("claude-x", "anthropic", 0, 2, 0, 0, 1_767_323_045_000)}


def test_chats_without_counts_are_estimated(spark, tmp_path):
    agent = {"runState": {"sessionState": {"mainAgentState": {"agentType": "base2-free-x"}}}}

    def put(chat, rows):
        path = tmp_path / "manicode" / "projects" / "p" / "chats" / chat / "chat-messages.json"
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps(rows))

    put("2026-01-02T03-04-05.678Z", [{"variant": "user", "content": "x" * 9}, {"variant": "user", "blocks": [{"content": "y" * 4}, {"other": 1}]}, {"variant": "ai", "content": ""}, {"role": "assistant", "content": "z", "metadata": agent}, {"variant": "agent", "blocks": [{"content": "w" * 8}], "timestamp": "2026-01-03T00:00:00Z"}])
    put("paid", [{"variant": "ai", "content": "z"}])
    put("counted", [{"variant": "ai", "content": "z", "metadata": {**agent, "usage": {"inputTokens": 3}}}])
    (tmp_path / "manicode" / "settings.json").write_text('{"freebuffModel": "deepseek-v3"}')
    found = sorted((r["session_id"], r["model_id"], r["provider_id"], r["input"], r["output"], r["timestamp_ms"]) for r in adapters.facts(spark, "freebuff", str(tmp_path)).collect())
    session = "manicode/p/2026-01-02T03-04-05.678Z"
    assert found == [(session, "deepseek-v3", "deepseek", 0, 2, 1_767_398_400_000), (session, "deepseek-v3", "deepseek", 4, 1, 1_767_323_045_678)]


def test_a_report_tells_its_device_times_and_revisions(spark, sf_dir):
    from tidemark.plans.catalogue import _sessions
    from tidemark.operators import intervals
    from tidemark.sources.facts import event_facts

    facts = event_facts(spark, sf_dir)
    times = intervals.time_metrics(_sessions(spark, sf_dir))
    told = json.loads(sinks.payload(facts, "2026-01-01T00:00:00Z", "1", {"id": "d", "name": "laptop"}, times, {"view": 3, "gone": 9}, {"click": ("2024-01-01", "2024-01-31")}).first()["payload"])
    assert list(told) == ["meta", "device", "summary", "years", "contributions", "timeMetrics", "clientManifest"]
    assert told["device"] == {"id": "d", "name": "laptop"} and told["timeMetrics"]["sessionCount"] == times.first()["sessions"] > 0
    manifest = {c["client"]: c for c in told["clientManifest"]["clients"]}
    assert list(manifest) == sorted({r["client"] for r in facts.select("client").distinct().collect()}) and manifest["view"]["parserRevision"] == 3
    assert manifest["click"] == {"client": "click", "parserRevision": 1, "coverage": {"mode": "full", "start": "2024-01-01", "end": "2024-01-31", "missingData": "tombstone"}} and "coverage" not in manifest["view"]
    plain = json.loads(sinks.payload(facts, "2026-01-01T00:00:00Z", "1").first()["payload"])
    assert list(plain) == ["meta", "summary", "years", "contributions"]
