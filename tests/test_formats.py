"""Formats whose rows need other rows, several files or packed columns, with the facts that they must give."""

import json
import sqlite3

import pytest
import zstandard

from tidemark.sources import adapters

AT = 1_767_323_045_000  # 2026-01-02T03:04:05Z
UNITS = ("input", "output", "cache_read", "cache_write", "reasoning")


@pytest.fixture
def put(tmp_path):
    def write(name, *values):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(v if isinstance(v, str) else json.dumps(v) for v in values))
        return str(path.parent)

    return write


@pytest.fixture
def base(tmp_path):
    def write(name, script, **rows):
        made = sqlite3.connect(tmp_path / name)
        made.executescript(script)
        for table, values in rows.items():
            made.executemany(f"insert into {table} values ({', '.join('?' * len(values[0]))})", values)
        made.commit()
        made.close()
        return str(tmp_path)

    return write


def told(spark, client, root):
    """Facts as session, model, provider and units, in order."""
    rows = adapters.facts(spark, client, root).collect()
    assert {r["client"] for r in rows} <= {client}
    return sorted((r["session_id"], r["model_id"], r["provider_id"], tuple(r[u] for u in UNITS)) for r in rows)


def test_model_of_the_heading(spark, put):
    root = put("a.jsonl", {"type": "usage", "sessionId": "s", "timestamp": AT, "input": 1}, {"type": "session_meta", "modelId": "gemini-3-pro"}, {"type": "usage", "sessionId": "s", "timestamp": str(AT), "input": "5", "output": -2, "responseId": "r"}, {"type": "usage", "sessionId": "s", "timestamp": 0, "input": 5}, {"type": "usage", "timestamp": AT, "input": 5}, "{")
    assert told(spark, "antigravity", root) == [("s", "gemini-3-pro", "google", (5, 0, 0, 0, 0)), ("s", "unknown", "antigravity", (1, 0, 0, 0, 0))]


def test_cached_replies_of_services(spark, put):
    root = put("trae/x.json", [{"session_id": "a", "usage_time": AT // 1000, "model_name": "GPT-5.3 Codex", "dollar_float": 0.5, "extra_info": {"input_token": 3, "output_token": 4}}, {"session_id": "b", "usage_time": AT // 1000, "mode": "Builder", "extra_info": {"cache_read_token": 2}}, {"session_id": "c", "usage_time": AT // 1000, "model_name": "GLM 5.1", "extra_info": {}}, {"session_id": "d", "usage_time": AT // 1000, "model_name": "GPT-6", "extra_info": {"input_token": 1}}])
    assert told(spark, "trae", root) == [("a", "gpt-5.3-codex", "openai", (3, 4, 0, 0, 0)), ("b", "trae-builder", "trae", (0, 0, 2, 0, 0)), ("d", "GPT-6", "openai", (1, 0, 0, 0, 0))]
    root = put("warp/usage.json", {"syncedAt": "2026-01-02T03:04:05Z", "usage": {"requestsUsed": 9, "spendCents": 9}, "workspaces": [{"id": " My Team! ", "requestsUsed": 3, "spendCents": 150}, {"id": "none", "requestsUsed": 0}]})
    put("warp/usage-2.json", {"syncedAt": "2026-01-02T03:04:05Z", "usage": {"requestsUsed": 7}})
    put("warp/usage-3.json", {"usage": {"requestsUsed": 7}})
    found = adapters.facts(spark, "warp", root).collect()
    assert sorted((r["session_id"], r["message_count"], r["cost"] or 0, r["timestamp_ms"]) for r in found) == [("warp-aggregate-account", 7, 0, AT), ("warp-aggregate-my-team", 3, 1.5, AT)]


def test_daily_counts(spark, put):
    row = {"ts": "2026-01-02T03:04:05Z", "model": "deepseek/deepseek-v3", "prompt": 10, "completion": 6, "reasoning": 2, "cache_hit": 4, "total": 16, "requests": 3}
    root = put("d.jsonl", row, {**row, "turn": True}, {**row, "model": " "}, {**row, "total": 0, "requests": 0}, {**row, "cache_miss": 7, "model": "house-model", "reasoning": 9}, {**row, "cache_miss": 0, "cache_hit": 99, "model": "grok-4"})
    assert sorted(t[1:] for t in told(spark, "reasonix", root)) == [("deepseek-v3", "deepseek", (6, 4, 4, 0, 2)), ("grok-4", "xai", (0, 4, 99, 0, 2)), ("house-model", "reasonix", (7, 0, 4, 0, 6))]
    assert {r["message_count"] for r in adapters.facts(spark, "reasonix", root).collect()} == {3}


def test_turns_end_with_results(spark, put):
    def message(turn, n, role="assistant"):
        return {"type": "message", "message": {"role": role, "turnId": turn, "timestamp": AT // 1000, "usage": {"inputTokens": n, "outputTokens": 1 if n else 0}}}

    result = {"type": "exec.result", "turnId": "t", "sessionId": "s", "model": {"providerId": "p", "modelId": "m"}}
    root = put("a.jsonl", message("t", 1), message(" t ", 2), message("t", 0), message("u", 3), message("t", 9, "user"), {**result, "model": {"modelId": "m"}}, result, message("t", 4), {**result, "sessionId": "z"}, message("t", 5))
    found = sorted((r["dedup_key"], r["input"], r["timestamp_ms"], r["provider_id"]) for r in adapters.facts(spark, "mcode", root).collect())
    assert found == [("mcode:s:t:0:1:1:0:0", 1, AT, "p"), ("mcode:s:t:1:2:1:0:0", 2, AT, "p"), ("mcode:z:t:0:4:1:0:0", 4, AT, "p")]


def test_last_usage_of_a_turn(spark, put):
    def node(n):
        return {"token_usage": {"input_tokens": n, "output_tokens": n and 1, "cache_read_input_tokens": 0}}

    turns = [
        {"completed": True, "finishedAt": "2026-01-02T03:04:05Z", "exchange": {"request_id": "q", "response_nodes": [node(3), node(5), node(0), {}]}},
        {"completed": True, "sequenceId": 7, "exchange": {"model_id": "gpt-5.4", "response_nodes": [node(2)]}}, {"completed": False, "exchange": {"response_nodes": [node(2)]}}, {"completed": True, "exchange": {"response_nodes": []}}, {"completed": True},
        {"completed": True, "exchange": {"response_nodes": [node(1)]}},
    ]
    root = put("s1.json", {"agentState": {"modelId": "claude-x"}, "chatHistory": turns})
    assert told(spark, "augment", root) == [("s1", "claude-x", "anthropic", (1, 1, 0, 0, 0)), ("s1", "claude-x", "anthropic", (5, 1, 0, 0, 0)), ("s1", "gpt-5.4", "openai", (2, 1, 0, 0, 0))]
    assert {r["dedup_key"] for r in adapters.facts(spark, "augment", root).collect()} == {"augment:s1:req:q", "augment:s1:seq:7", "augment:s1:turn:5"}


def test_events_of_several_models(spark, put):
    def event(*usages, **more):
        return {"kind": "AgentEvent", "event": {"agentEvent": {"kind": "LlmResponseMetadataEvent", "modelUsage": list(usages)}}, **more}

    used = {"model": "claude-x", "inputTokens": 5, "output": "7", "cacheRead": 1, "thinkingTokens": 2.9, "cost": "0.25", "time": 1000}
    root = put("session-260102-030405-x/events.jsonl", {"kind": "UserPromptEvent"}, event(used, {"model": "m", "cost": 0.5}, {"model": " ", "input": 9}, {"model": "idle"}, timestampMs=AT), event(used, timestampMs=AT), event({"model": "m", "provider": "x_ai", "input": 1}), {**event(used), "kind": "AgentPatchCreatedEvent"})
    session = "session-260102-030405-x"
    assert told(spark, "junie", root) == [(session, "claude-x", "anthropic", (5, 7, 1, 0, 2)), (session, "m", "junie", (0, 0, 0, 0, 0)), (session, "m", "xai", (1, 0, 0, 0, 0))]
    assert sorted(r["timestamp_ms"] for r in adapters.facts(spark, "junie", root).collect()) == [AT - 1000, AT, AT]


def test_snapshot_and_journal(spark, put):
    def message(key, i, hit=None, written=None, role="assistant"):
        return {"id": key, "role": role, "timestamp": "2026-01-02T03:04:05Z", "tool_duration_ms": 5, "token_usage": {"input_tokens": i, "output_tokens": 1, "cache_read_input_tokens": hit, "cache_creation_input_tokens": written}}

    root = put("a b+c%/session_1.json", {"id": "s", "provider_key": "anthropic", "model": "claude-x", "messages": [message("a", 10, 4), message("b", 10, 4, 0), message("c", 3, 9), {"id": "u", "role": "user"}]})
    put("a b+c%/session_1.journal.jsonl", {"append_messages": [message("a", 20)]}, "{", {"meta": {"model": "gpt-5.4", "provider_key": "openai_codex"}, "append_messages": [message("d", 1), message(None, 2)]})
    put("a b+c%/session_2.journal.jsonl", {"append_messages": [message("x", 20)]})
    assert told(spark, "jcode", root) == [("s", "claude-x", "anthropic", (3, 1, 9, 0, 0)), ("s", "claude-x", "anthropic", (10, 1, 4, 0, 0)), ("s", "claude-x", "anthropic", (20, 1, 0, 0, 0)), ("s", "gpt-5.4", "openai", (1, 1, 0, 0, 0)), ("s", "gpt-5.4", "openai", (2, 1, 0, 0, 0))]
    assert {r["timestamp_ms"] for r in adapters.facts(spark, "jcode", root).collect()} == {AT - 5}


def test_messages_and_extension_logs(spark, put, base):
    line = {"type": "message", "role": "assistant", "sessionId": "s", "timestamp": AT, "providerData": {"model": "glm-4.6", "messageId": "m", "usage": {"inputTokens": 10, "outputTokens": 2, "totalTokens": 12, "cacheTokens": 4}}}
    more = {**line, "providerData": {**line["providerData"], "usage": {"input_tokens": 30, "completion_tokens": 2, "cached_tokens": 0}}}
    log = [
        "[2026/1/2 03:04:05.000] [info] [CraftInvokableAgent] [a1] Model prepared: House (gpt-5.4)",
        '[2026/1/2 03:04:06.000] [info] [AgentReporter] [a1] Agent execution successful with usage: {"inputTokens": 3, "outputTokens": 4, "reasoningTokens": 1} end',
        '2026-01-02 03:04:07 [info] [AgentReporter] [a2] Agent execution successful with usage: {"cacheMissTokens": 6, "outputTokens": 1}', "[AgentReporter] [a2] Agent execution successful with usage: none",
    ]
    put("one.jsonl", line, more, {**line, "status": "failed"}, {**line, "role": "user"}, {"type": "function_call", "message": {"usage": {"prompt_tokens": 1}}})
    root = put("ext.log", *log)
    rest = [("a1", "gpt-5.4", "openai", (3, 4, 0, 0, 1)), ("a2", "{}", "tencent", (6, 1, 0, 0, 0)), ("one", "{}", "tencent", (1, 0, 0, 0, 0)), ("s", "glm-4.6", "zai", (30, 2, 0, 0, 0))]
    named = lambda client: [(s, m.format(client), p, u) for s, m, p, u in rest]
    assert told(spark, "codebuddy", root) == named("codebuddy")
    base("workbuddy.db", "create table session_usage(session_id text, used int, updated_at int); create table sessions(id text, model text, cwd text)", session_usage=[("w", 8, AT), ("x", 0, AT), ("y", 2, AT // 1000)], sessions=[("w", "kimi-k2", "/a")])
    assert told(spark, "workbuddy", root) == sorted([*named("workbuddy"), ("w", "kimi-k2", "moonshotai", (8, 0, 0, 0, 0)), ("y", "auto", "workbuddy", (2, 0, 0, 0, 0))])
    put("ext.log", log[1])
    assert [r["timestamp_ms"] for r in adapters.facts(spark, "codebuddy", root).where("session_id = 'a1'").collect()] == [AT + 1000]


def test_cost_by_session_tree_and_day(spark, base):
    root = base(
        "crush.db", "create table sessions(id text, parent_session_id text, cost real, created_at int, updated_at int, message_count int); create table messages(session_id text, role text, created_at int)",
        sessions=[("r", None, 4.0, 1, 2, 3), ("c", "r", 9.0, 1, 2, 1), ("q", None, 0.5, AT // 1000, 0, 0), ("idle", None, 0, 1, 1, 5), ("none", None, 0, 1, 1, 0)],
        messages=[("r", "assistant", AT), ("c", "assistant", AT // 1000 + 60), ("c", "assistant", AT + 1), ("c", "assistant", AT + 86_400_000), ("c", "user", AT)],
    )
    found = sorted((r["session_id"].split(":")[-1], r["timestamp_ms"], r["cost"], r["message_count"]) for r in adapters.facts(spark, "crush", root).collect())
    assert found == [("q", AT, 0.5, 0), ("r", AT, 3.0, 3), ("r", AT + 86_400_000, 1.0, 1)]


def test_studio(spark, base):
    def meta(kind, **used):
        return json.dumps({"contextUsage": used, "responseDetails": {"providerType": kind}})

    root = base(
        "studio.db", "create table chat_messages(id text, thread_id text, role text, created_at int, metadata_json text); create table chat_threads(id text, model_id text); create table api_usage_events(id text, endpoint text, model text, prompt_tokens int, completion_tokens int, total_tokens int, created_at int)",
        chat_messages=[
            ("1", "t", "assistant", AT // 1000, meta("kimi", promptTokens=10, completionTokens=4, totalTokens=20, cachedTokens=3, cacheWriteTokens=90, reasoningTokens=1)), ("2", "", "assistant", AT // 1000, meta("Local", promptTokens=2, modelId="own")),
            ("3", "t", "assistant", AT // 1000, "no json"), ("4", "t", "user", AT // 1000, meta("openai", promptTokens=2)), ("5", "t", "assistant", AT // 1000, meta("box", completionTokens=2)),
        ],
        chat_threads=[("t", "thread-model")], api_usage_events=[("9", "/v1", " ", 3, 4, 0, AT // 1000)],
    )
    assert told(spark, "unsloth", root) == [("t", "thread-model", "moonshotai", (6, 3, 3, 7, 1)), ("t", "thread-model", "unpriced:box", (0, 2, 0, 0, 0)), ("unsloth:api", "unknown", "local", (3, 4, 0, 0, 0)), ("unsloth:chat:2", "own", "local", (2, 0, 0, 0, 0))]


@pytest.mark.parametrize("dated", [True, False])
def test_packed_threads(spark, base, dated):
    def thread(**more):
        return json.dumps({"model": {"provider": "zed.dev", "model": "claude-x"}, **more}).encode()

    packed = zstandard.ZstdCompressor().compress(thread(request_token_usage={"a": {"input_tokens": 1, "output_tokens": "2"}, "b": {"input_tokens": 3}, "c": {}}))
    rows = [("1", "zstd", packed), ("2", "json", thread(request_token_usage=[{"cache_read_input_tokens": 4}], cumulative_token_usage={"input_tokens": 99})), ("3", "json", thread(cumulative_token_usage={"input_tokens": 5})), ("4", "json", thread(imported=True, cumulative_token_usage={"input_tokens": 5})), ("5", "zstd", b"broken"), ("6", "other", b"{}"), ("7", "json", json.dumps({"model": {"provider": "else", "model": "m"}, "cumulative_token_usage": {"input_tokens": 5}}).encode())]
    when = "2026-01-02T03:04:05Z"
    root = base("threads.db", f"create table threads(id text, updated_at text, {'created_at text, ' if dated else ''}data_type text, data blob)", threads=[(i, when, *([when] if dated else []), k, d) for i, k, d in rows])
    assert told(spark, "zed", root) == [("1", "claude-x", "zed.dev", (4, 2, 0, 0, 0)), ("2", "claude-x", "zed.dev", (0, 0, 4, 0, 0)), ("3", "claude-x", "zed.dev", (5, 0, 0, 0, 0))]
    assert sorted((r["message_count"], r["timestamp_ms"]) for r in adapters.facts(spark, "zed", root).collect()) == [(1, AT), (1, AT), (2, AT)]


def test_gateway_databases(spark, base):
    whole = "create table messages(id text, model text, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, cost real, timestamp real, session_id text, provider text);"
    short = "create table token_usage(id text, model text, input_tokens int, output_tokens int, timestamp real, session_id text);"
    root = base("a.db", whole + short, messages=[("1", "hf:org/Kimi-K2", 1, 2, 3, 4, 5, -1.0, AT / 1000, "s", None), ("2", "m", 0, 0, 0, 0, 0, 1.0, AT, "s", "p")], token_usage=[("9", "m", 7, 7, AT, "s")])
    base("b.db", short, token_usage=[("3", "m", 7, 0, AT, None), ("4", "m", 0, 0, AT, "s")])
    assert told(spark, "synthetic", root) == [("s", "kimi-k2", "synthetic", (1, 2, 3, 4, 5)), ("unknown", "m", "synthetic", (7, 0, 0, 0, 0))]
