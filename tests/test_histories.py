"""Formats read with the files beside them, with the facts that they must give."""

import sqlite3

from tests.test_formats import AT, base, put, told  # noqa: F401  fixtures
from tidemark.sources import adapters


def test_status_updates_and_turns(spark, put):  # noqa: F811
    def update(i, key=None, at=AT / 1000, kind="StatusUpdate"):
        return {"timestamp": at, "message": {"type": kind, "payload": {"message_id": key, "token_usage": {"input_other": i, "output": 1, "inputCacheRead": 2}}}}

    put("my home/sessions/g/s1/wire.jsonl", {"type": "metadata"}, update(5, "m"), update(7, "m", AT / 1000 - 9), update(6, "m"), update(3), update(3), update(9, kind="Other"), "{")
    put("my home/config.json", {"model": "kimi-k2"})
    put("bare/sessions/g/s2/wire.jsonl", update(1))
    record = {"type": "usage.record", "usageScope": "turn", "time": AT, "usage": {"inputOther": 4}}
    put("code/sessions/slug/s3/agents/main/wire.jsonl", {"type": "llm.request", "model": "kimi-code/k3", "time": AT - 700}, record, {**record, "usageScope": "session"}, record, {"type": "llm.request", "model": "__default__", "time": AT + 5}, {**record, "model": " own "})
    root = put("x.txt", "")
    assert told(spark, "kimi", root) == sorted([
        *[("s1", "kimi-k2", "moonshot", (i, 1, 2, 0, 0)) for i in (7, 3, 3)], ("s2", "kimi-for-coding", "moonshot", (1, 1, 2, 0, 0)),
        ("s3", "k3", "moonshot", (4, 0, 0, 0, 0)), ("s3", "k3", "moonshot", (4, 0, 0, 0, 0)), ("s3", "own", "moonshot", (4, 0, 0, 0, 0)),
    ])
    found = adapters.facts(spark, "kimi", root)
    assert sorted(r["timestamp_ms"] for r in found.where("session_id = 's3'").collect()) == [AT - 700, AT, AT]
    assert found.where("dedup_key = 'm'").first()["timestamp_ms"] == AT - 9000


def test_counts_or_estimates(spark, put, base, tmp_path):  # noqa: F811
    root = put(
        "p/log.jsonl", {"role": "user", "content": "abcdef"}, {"role": "assistant", "content": ["x"], "model": "GLM-4.6", "timestamp": "2026-01-02T03:04:05Z"}, {"role": "system", "content": []}, {"role": "assistant", "content": "", "sessionId": "s", "usage": {"input": 0}, "token_usage": {"prompt_tokens": 10, "outputTokens": 6, "cache_read_tokens": 4, "reasoning": 1, "total": 16}},
        {"role": "assistant", "usage": {"input_tokens": 10, "output": 6, "cacheReadTokens": 4, "total": 20}}, {"role": "tool", "content": None},
    )
    # said before: "abcdef" with its quotes, 8 characters; the reply ["x"] has 5
    assert told(spark, "zcode", root) == [("log", "glm-4.6", "zhipu", (2, 2, 0, 0, 0)), ("s", "glm-4.6", "zhipu", (6, 5, 4, 0, 1)), ("s", "glm-4.6", "zhipu", (10, 6, 4, 0, 0))]
    assert {r["dedup_key"] for r in adapters.facts(spark, "zcode", root).collect()} == {"log:0", "s:1", "s:2"}
    columns = "id text, session_id text, model_id text, started_at int, completed_at int, duration_ms int, input_tokens int, output_tokens int, reasoning_tokens int, cache_read_input_tokens int, cache_creation_input_tokens int"
    for name, total, sessions in (("new", True, True), ("bare", True, False), ("old", False, False)):
        (tmp_path / name).mkdir()
        made = sqlite3.connect(tmp_path / name / "z.db")
        made.execute(f"create table model_usage({columns}{', computed_total_tokens int' if total else ''})")
        if sessions:
            made.execute("create table session(id text)")
        rows = [("1", name, "GLM-5", 0, AT, 5, 10, 6, 1, 3, 1, 16), ("2", name, "", AT, 0, 0, 10, 6, 1, 3, 1, 21), ("3", "", "m", AT, 0, 0, 0, 0, 0, 0, 0, 0)]
        made.executemany(f"insert into model_usage values ({', '.join('?' * (12 if total else 11))})", [r if total else r[:-1] for r in rows])
        made.commit()
        made.close()
    plain, net = (10, 6, 3, 1, 1), (6, 5, 3, 1, 1)
    for name, first, second in (("new", net, plain), ("bare", plain, plain), ("old", net, net)):
        assert told(spark, "zcode", str(tmp_path / name)) == [(name, "glm-5", "zhipu", first), (name, "glm-5.2", "zhipu", second)]
        assert {r["timestamp_ms"] for r in adapters.facts(spark, "zcode", str(tmp_path / name)).collect()} == {AT - 5, AT}


def test_snapshots_with_session_files(spark, put):  # noqa: F811
    put("s1/usage-v2.json", {"snapshot": {"input_tokens": 99, "models": [{"model": "anthropic/claude-x", "input_tokens": 3, "total_cost": 0.5, "request_count": 2}, {"model": "house", "output_tokens": 4, "total_cost": -1}, {"model": "idle", "request_count": 3}]}})
    put("s1/session.json", {"updated_at_ms": AT, "created_at_ms": 5})
    put("s2/usage-v2.json", {"session_id": "own", "snapshot": {"reasoning_tokens": 7, "models": []}})
    put("s3/usage-v2.json", {"snapshot": {"request_count": 0}})
    root = put("s4/usage-v2.json", {"session_id": "none"}) + "/.."
    assert told(spark, "fx", root) == [("own", "fx-unknown", "zai", (0, 0, 0, 0, 7)), ("s1", "claude-x", "anthropic", (3, 0, 0, 0, 0)), ("s1", "house", "zai", (0, 4, 0, 0, 0))]
    rows = adapters.facts(spark, "fx", root).where("session_id = 's1'").orderBy("model_id").collect()
    assert [(r["timestamp_ms"], r["cost"], r["message_count"]) for r in rows] == [(AT, 0.5, 2), (AT, 0.0, 0)]


def test_chats_streams_and_statistics(spark, put):  # noqa: F811
    reply = {"type": "gemini", "id": "1", "model": "gemini-3-pro", "timestamp": "2026-01-02T03:04:05Z", "tokens": {"input": 10, "output": 5, "cached": 4, "thoughts": 1, "tool": 2, "total": 18}}
    put("tmp/h/chats/session-a.json", {"sessionId": "a", "messages": [reply, {**reply, "tokens": {"promptTokenCount": 10, "cachedContentTokenCount": 4}}, {"type": "user"}, {**reply, "model": None}]})
    put("tmp/h/chats/one.json", {"model": "m", "stats": {"models": {"gemini-3-pro": {"tokens": {"prompt": 9, "candidates": 1, "cached": 4}}, "idle": {"tokens": {"prompt": 0}}}}})
    put("elsewhere/two.json", {"model": "m", "stats": {"input": 5}})
    put("tmp/h/chats/b.jsonl", {"type": "init", "session_id": "b", "model": "flash"}, {**reply, "model": None}, {**reply, "tokens": {"input": 1}}, {"type": "result", "stats": {"input": 5, "cached": 2, "output": 3}}, {"type": "result", "result": {"stats": {"input_tokens": 5, "cached": 2}}}, "{", {"type": "result", "stats": {}})
    root = put("x.txt", "")
    assert told(spark, "gemini", root) == sorted([
        ("a", "gemini-3-pro", "google", (8, 5, 4, 0, 1)), ("a", "gemini-3-pro", "google", (10, 0, 4, 0, 0)), ("one", "gemini-3-pro", "google", (5, 1, 4, 0, 0)),
        ("b", "gemini-3-pro", "google", (1, 0, 0, 0, 0)), ("b", "gemini-3-pro", "google", (5, 3, 2, 0, 0)), ("b", "gemini-3-pro", "google", (3, 0, 2, 0, 0)),
    ])
