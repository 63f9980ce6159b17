"""Adapters over small logs in the vendors' formats, with the totals that they must give."""

import json
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.sources import adapters, sinks


def totals(frame):
    return tuple(frame.agg(*[F.sum(c) for c in ("input", "output", "cache_read", "cache_write", "reasoning")], F.count("*")).first())


def usage(i, c, o, r):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}


def test_growing_counters_and_archives(spark, tmp_path):
    def told(total, last=None, at=0):
        return json.dumps({"timestamp": f"2026-01-02T03:04:{at:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}})

    lines = [
        json.dumps({"timestamp": "2026-01-02T03:04:00Z", "type": "turn_context", "payload": {"model": "gpt-5.4"}}),
        told(usage(100, 40, 20, 5), usage(100, 40, 20, 5), 1),
        told(usage(100, 40, 20, 5), usage(100, 40, 20, 5), 2),  # repeated
        told(usage(150, 50, 30, 5), usage(50, 10, 10, 0), 3),
        told(usage(149, 50, 30, 5), usage(50, 10, 10, 0), 4),  # late
        "not json",
        told(usage(180, 50, 40, 9), None, 5),  # only a total
        told(usage(0, 0, 0, 0), usage(0, 0, 0, 0), 6),
        told(usage(200, 60, 44, 9), None, 7),
    ]
    raw = ("\n".join(lines)).encode() + b"\n\xff\xfe broken\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_bytes(raw)
    (tmp_path / "a" / "two.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    found = adapters.facts(spark, "codex", str(tmp_path))
    rows = found.where("session_id = 'one'").orderBy("timestamp_ms").collect()
    assert [(r["input"], r["output"], r["cache_read"], r["reasoning"], r["model_id"]) for r in rows] == [(60, 15, 40, 5, "gpt-5.4"), (40, 10, 10, 0, "gpt-5.4"), (30, 6, 0, 4, "gpt-5.4"), (10, 4, 10, 0, "gpt-5.4")]
    assert found.count() == 8


def test_streamed_duplicates(spark, tmp_path):
    def row(i, o, request="r1", message="m1"):
        return json.dumps({"type": "assistant", "timestamp": "2026-01-02T03:04:05Z", "requestId": request, "sessionId": "s", "message": {"id": message, "model": "claude-opus-4-6", "usage": {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 2}}})

    (tmp_path / "s.jsonl").write_text("\n".join([row(10, 1), row(10, 5), row(3, 3, None, "m2"), row(4, 4, "r2"), json.dumps({"type": "user"}), "{"]))
    found = adapters.facts(spark, "claude", str(tmp_path))
    assert totals(found) == (17, 12, 21, 6, 0, 3)
    assert {r["provider_id"] for r in found.collect()} == {"anthropic"}


def test_arrays_and_one_format_under_several_names(spark, tmp_path):
    chat = tmp_path / "p" / "chats" / "c1"
    chat.mkdir(parents=True)
    (chat / "chat-messages.json").write_text(json.dumps([{"variant": "user"}, {"variant": "ai", "timestamp": "2026-01-02T03:04:05Z", "metadata": {"model": "gpt-5.4", "usage": {"inputTokens": 5, "outputTokens": 6, "cacheCreationInputTokens": 7, "cacheReadInputTokens": 8}}}, {"variant": "ai"}]))
    found = adapters.facts(spark, "codebuff", str(tmp_path))
    assert totals(found) == (5, 6, 8, 7, 0, 1) and found.first()["session_id"] == "c1" and found.first()["provider_id"] == "openai"
    message = {"type": "message", "id": "x", "timestamp": "2026-01-02T03:04:05Z", "message": {"role": "assistant", "model": "glm-4.6", "timestamp": 1_767_000_000_000, "usage": {"input": 3, "output": 4, "cost": {"total": 0.5}}}}
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "s1.jsonl").write_text("\n".join([json.dumps({"type": "session", "id": "s1"}), json.dumps(message), json.dumps(message)]))
    for client in ("pi", "gjc", "omp", "kimchi", "senpi", "craft-agent"):
        found = adapters.facts(spark, client, str(tmp_path / "own"))
        assert totals(found) == (3, 4, 0, 0, 0, 1)
        row = found.first()
        assert (row["client"], row["cost"], row["timestamp_ms"], row["provider_id"], row["dedup_key"]) == (client, 0.5, 1_767_000_000_000, "zai", "s1:x")


def test_databases(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "state.db")
    base.executescript(
        """create table sessions(id text, model text, started_at real, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, billing_provider text, estimated_cost_usd real, actual_cost_usd real);
create table session_model_usage(session_id text, model text, billing_provider text, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, estimated_cost_usd real, actual_cost_usd real);
insert into sessions values ('a', 'gpt-5.4', 1767000000.5, 10, 20, 1, 2, 3, 'openai', 0.5, 0), ('b', 'm', 1767000000, 9, 9, 9, 9, 9, 'x-ai', 1, 2), ('c', 'm', 1767000000, 0, 0, 0, 0, 0, null, null, null);
insert into session_model_usage values ('b', 'm1', 'x-ai', 1, 2, 3, 4, 5, 0.1, 0.2), ('b', 'm2', 'x-ai', 1, 1, 1, 1, 1, 0.3, 0);"""
    )
    base.commit()
    base.close()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "state.db").write_bytes(b"no database at all")
    found = {r["session_id"] + ":" + r["model_id"]: r for r in adapters.facts(spark, "hermes", str(tmp_path)).collect()}
    assert {k: (r["input"], r["output"], r["cost"], r["provider_id"]) for k, r in found.items()} == {"a:gpt-5.4": (10, 20, 0.0, "openai"), "b:m1": (1, 2, 0.2, "xai"), "b:m2": (1, 1, 0.3, "xai")}
    base = sqlite3.connect(tmp_path / "kilo.db")
    base.execute("create table message(id text, session_id text, data text)")
    used = {"role": "assistant", "modelID": "kimi-k2", "cost": 0.25, "time": {"created": 1_767_000_000_000}, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}}
    base.executemany("insert into message values (?, 's', ?)", [("1", json.dumps(used)), ("2", json.dumps({"role": "user"})), ("3", json.dumps({"role": "assistant"}))])
    base.commit()
    base.close()
    for client in ("opencode", "kilo", "micode"):
        found = adapters.facts(spark, client, str(tmp_path))
        assert totals(found) == (1, 2, 4, 5, 3, 1) and found.first()["provider_id"] == "moonshotai"


def test_other_formats(spark, tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))

    put("roo/t1/ui_messages.json", [{"type": "say", "say": "api_req_started", "ts": 1_767_000_000_000, "text": json.dumps({"tokensIn": 1, "tokensOut": 2, "cacheReads": 3, "cacheWrites": 4, "cost": 0.5, "apiProtocol": "anthropic"})}, {"type": "say", "say": "text", "text": "x", "ts": 1}, {"type": "say", "say": "api_req_started", "ts": 5, "text": "no json"}])
    for client in ("roocode", "kilocode", "cline"):
        found = adapters.facts(spark, client, str(tmp_path / "roo"))
        assert totals(found) == (1, 2, 3, 4, 0, 1) and (found.first()["session_id"], found.first()["provider_id"], found.first()["cost"]) == ("t1", "anthropic", 0.5)
    put("qwen/proj/chats/c.jsonl", json.dumps({"type": "assistant", "timestamp": "2026-01-02T03:04:05Z", "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": -1, "thoughtsTokenCount": 2}}) + "\n" + json.dumps({"type": "assistant", "usageMetadata": {}}))
    found = adapters.facts(spark, "qwen", str(tmp_path / "qwen"))
    assert totals(found) == (5, 0, 0, 0, 2, 1) and found.first()["session_id"] == "proj-c"
    put("mux/s9/session-usage.json", {"byModel": {"x-ai:grok-4": {"input": {"tokens": 4, "cost_usd": 0.25}, "output": {"tokens": 1, "cost_usd": 0.5}}, "plain": {"input": {"tokens": 0}}}, "lastRequest": {"timestamp": 1_767_000_000_000}})
    row = adapters.facts(spark, "mux", str(tmp_path / "mux")).collect()
    assert [(r["model_id"], r["provider_id"], r["input"], r["cost"], r["dedup_key"]) for r in row] == [("grok-4", "xai", 4, 0.75, "mux:s9:x-ai:grok-4")]
    put("hind/2026-01.jsonl", "\n".join(map(json.dumps, [{"id": "1", "trace_id": " ", "provider": "openai", "model": "gpt-5.4", "started_at": "2026-01-02T03:04:05+00:00", "input_tokens": 2, "output_tokens": 3, "cached_tokens": 1}, {"id": "2", "started_at": "2026-01-02T03:04:05Z", "input_tokens": 2, "total_tokens": 0}, {"id": "3", "input_tokens": 9}])))
    found = adapters.facts(spark, "hindsight", str(tmp_path / "hind"))
    assert totals(found) == (2, 3, 1, 0, 0, 1) and found.first()["session_id"] == "1"
    put("amp/T-1.json", {"id": "T-1", "created": 1_767_000_000_000, "messages": [{"role": "assistant", "messageId": 3, "usage": {"model": "claude-x", "inputTokens": 7, "outputTokens": 8, "cacheReadInputTokens": 9}}, {"role": "user", "messageId": 4}]})
    assert totals(adapters.facts(spark, "amp", str(tmp_path / "amp"))) == (7, 8, 9, 0, 0, 1)
    put("cur/usage.me.json", {"usageEventsDisplay": [{"conversationId": "c", "timestamp": "1767000000000", "model": "gpt-5.4", "chargedCents": 50, "tokenUsage": {"inputTokens": 1, "outputTokens": 2, "cacheReadTokens": 3, "cacheWriteTokens": 4}}, {"timestamp": "1767000000000", "model": " "}]})
    found = adapters.facts(spark, "cursor", str(tmp_path / "cur"))
    assert totals(found) == (1, 2, 3, 4, 0, 1) and found.first()["cost"] == 0.5
    put("rev/r.jsonl", json.dumps({"type": "llm_response", "timestamp": "2026-01-02T03:04:05Z", "model": "deepseek-v3", "usage": {"prompt_tokens": 6, "completion_tokens": 7}}))
    found = adapters.facts(spark, "opencodereview", str(tmp_path / "rev"))
    assert totals(found) == (6, 7, 0, 0, 0, 1) and found.first()["provider_id"] == "deepseek"
    base = sqlite3.connect(tmp_path / "sessions.db")
    base.execute("create table sessions(id text, model_config_json text, provider_name text, created_at text, total_tokens int, input_tokens int, output_tokens int, accumulated_total_tokens int, accumulated_input_tokens int, accumulated_output_tokens int)")
    base.executemany("insert into sessions values (?, ?, ?, '2026-01-02 03:04:05', 9, 3, 4, ?, null, null)", [("a", json.dumps({"model_name": "gpt-5.4"}), None, 12), ("b", "", "x", 1), ("c", json.dumps({"model_name": " "}), "x", 1)])
    base.commit()
    base.close()
    found = adapters.facts(spark, "goose", str(tmp_path))
    assert totals(found) == (3, 4, 0, 0, 5, 1) and found.first()["timestamp_ms"] == 1_767_323_045_000


def test_listing_claims_formats_and_changes(spark, tmp_path):
    for name in ("x/usage.json", "x/usage.csv", "y/usage.csv", "node_modules/usage.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = adapters.files(spark, str(tmp_path), "usage.*")
    short = lambda frame: sorted("/".join(r["path"].split("/")[-2:]) for r in frame.collect())
    kept = adapters.pruned(listed, ["node_modules"])
    assert short(kept) == ["x/usage.csv", "x/usage.json", "y/usage.csv"]
    assert short(adapters.preferred_format(kept)) == ["x/usage.json", "y/usage.csv"]
    claimed = adapters.sources({"a": kept, "b": listed, "c": listed}, ["a", "b"])
    assert claimed.groupBy("client").count().orderBy("client").collect() == [("a", 3), ("b", 1)]
    before = adapters.fingerprints(spark, str(tmp_path), "usage.*").collect()
    (tmp_path / "y" / "usage.csv").write_text("another")
    assert short(adapters.changed(adapters.fingerprints(spark, str(tmp_path), "usage.*"), spark.createDataFrame(before))) == ["y/usage.csv"]


def test_sinks(spark, sf_dir, tmp_path):
    from tidemark.sources.facts import event_facts

    facts = event_facts(spark, sf_dir)
    document = sinks.payload(facts, "2026-01-01T00:00:00Z", "1")
    told = json.loads(document.first()["payload"])
    assert told["summary"]["totalUnits"] == facts.agg(F.sum("units")).first()[0] == sum(d["units"] for d in told["contributions"])
    assert [d["date"] for d in told["contributions"]] == sorted({d["date"] for d in told["contributions"]})
    assert json.loads(sinks.pretty(document).first()["payload"]) == told
    stored = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id long, name string, n long")
    new = spark.createDataFrame([(2, "z", 7), (3, "w", 8)], stored.schema)
    assert sorted(map(tuple, sinks.inserted(stored, new, ["id"]).collect())) == [(1, "x", 5), (2, "z", 7), (3, "w", 8)]
    assert sorted(map(tuple, sinks.updated(stored, new, "id", ["n"]).collect())) == [(1, "x", 5), (2, "y", 7)]


def test_one_user_by_name(spark):
    from tidemark.operators import filters

    users = spark.createDataFrame([("Ada",), ("ada",), ("Bo",)], "username string")
    assert filters.one_user(users, "BO").first()["username"] == "Bo" and filters.one_user(users, "no").count() == 0
    with pytest.raises(ValueError):
        filters.one_user(users, "ada")
