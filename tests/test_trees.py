import itertools
import json
import random

import pytest

from tidemark.operators import matching, merge as mg, trees
from tidemark.plans import catalogue, scans  # noqa: F401
from tidemark.sources import adapters, transcripts


def forest(seed, n=60, groups=("x", "y", None)):
    """Rows of random trees with holes, cycles, doubled keys and rows without one."""
    pick, rows = random.Random(seed), []
    for g in groups:
        for k in range(n):
            up = pick.choice([None, -1, *range(max(k - 4, 0), k), *( [k + 1] if pick.random() < 0.1 else [])]) if k else None
            rows.append((g, k, up, pick.random() < 0.15, len(rows)))
    # a third of all rows stand below one
    rows += [("hub", 0, None, True, len(rows))] + [("hub", k, 0, False, len(rows) + k) for k in range(1, 60)]
    return rows + [("x", None, 3, True, 10**6), ("y", 5, 5, False, 10**6 + 1)]


FOREST = "g string, k long, up long, flag boolean, at long"


@pytest.mark.parametrize("seed", range(3))
def test_marks_above(spark, seed):
    rows = forest(seed)
    keys = {(g, k) for g, k, *_ in rows if k is not None}
    up = {(g, k): max((r[2] for r in rows if r[:2] == (g, k) and r[2] is not None), default=None) for g, k in keys}
    flag = {(g, k): any(r[3] for r in rows if r[:2] == (g, k)) for g, k in keys}
    wanted = set()
    for g, k in keys:
        seen, at, below = set(), up[g, k], False
        while (g, at) in keys and at not in seen:
            seen.add(at)
            below |= flag[g, at]
            at = up[g, at]
        wanted.add((g, k, below))
    assert {tuple(r) for r in trees.below_marked(spark.createDataFrame(rows, FOREST), ["g"], "k", "up", "flag").collect()} == wanted
    assert trees.below_marked(spark.createDataFrame([], FOREST), ["g"], "k", "up", "flag").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_last_branches(spark, seed):
    pick = random.Random(seed)
    rows = [r for r in forest(seed + 10, 25, tuple("abcdefgh")) if seed % 2 or r[2] != -1]
    rows = [(g, k, None if up == -1 and pick.random() < 0.7 else up, f, at) for g, k, up, f, at in rows]
    wanted = set()
    for g in {r[0] for r in rows if r[1] is not None}:
        mine = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: r[4])
        up, on, at, hole = {r[1]: r[2] for r in mine}, set(), mine[-1][1], False
        while at is not None and at not in on and not hole:
            hole = at not in up
            on.add(at)
            at = up.get(at)
        wanted |= {(g, k, hole or k in on) for k in up}
    assert {tuple(r) for r in trees.on_last_branch(spark.createDataFrame(rows, FOREST), ["g"], "k", "up", "at").collect()} == wanted
    assert trees.on_last_branch(spark.createDataFrame([], FOREST), ["g"], "k", "up", "at").count() == 0


def enumerated(edges, rights):
    found = []

    def go(k, used, taken, cost):
        if k == len(edges):
            found.append((-len(used), cost, taken))
            return
        go(k + 1, used, (*taken, None), cost)
        for r, c in edges[k]:
            if r not in used:
                go(k + 1, used | {r}, (*taken, r), cost + c)

    go(0, frozenset(), (), 0)
    best = min(f[:2] for f in found)
    return best, [f[2] for f in found if f[:2] == best]


def test_matchings_are_the_cheapest_of_all(spark):
    pick, rows, wanted = random.Random(1), [], []
    for t in range(400):
        lefts, rights = pick.randint(1, 5), pick.randint(1, 5)
        edges = [[(r, pick.choice([0, 1, 2, 2, 5])) for r in range(rights) if pick.random() < 0.6] for _ in range(lefts)]
        partner, certain = matching.cheapest(edges, rights)
        best, every = enumerated(edges, rights)
        taken = [p for p in partner if p is not None]
        assert (-len(taken), sum(dict(edges[k])[p] for k, p in enumerate(partner) if p is not None)) == best and len(set(taken)) == len(taken)
        assert certain == [all(e[k] is not None for e in every) for k in range(lefts)]
        if t < 60:
            rows += [(f"{t}-{k}", f"{t}-{r}", c, "") for k, out in enumerate(edges) for r, c in out] * (1 + t % 2)
            wanted.append((f"{t}", best, {f"{t}-{k}": c for k, c in enumerate(certain) if edges[k]}))
    # dearer edges of a pair, and edges without an end, change nothing
    rows += [("0-0", rows[0][1], 99, ""), (None, "z", 1, ""), ("z", None, 1, ""), ("z", "z", None, "")]
    found = matching.matched(spark.createDataFrame(rows, "left string, right string, cost long, note string")).collect()
    for t, best, certain in wanted:
        mine = [r for r in found if r["left"].split("-")[0] == t]
        assert (-sum(r["right"] is not None for r in mine), sum(r["cost"] or 0 for r in mine)) == best
        assert {r["left"]: r["certain"] for r in mine} == certain and all(r["solved"] for r in mine)
    assert len(found) == sum(len(c) for _, _, c in wanted)


def test_large_components_are_told(spark):
    rows = [(a, b, 1) for a, b in itertools.product("abc", "xyz")] + [("d", "w", 3)]
    found = {r["left"]: (r["right"], r["certain"], r["solved"]) for r in matching.matched(spark.createDataFrame(rows, "left string, right string, cost long"), most=5).collect()}
    assert found == {**dict.fromkeys("abc", (None, False, False)), "d": ("w", True, True)}
    assert matching.matched(spark.createDataFrame([], "left string, right string, cost long")).count() == 0


def test_responses_of_events_are_matched_once(spark, sf_dir):
    found = catalogue.QUERIES["matched_responses"](spark, sf_dir).collect()
    taken = [r["right"] for r in found if r["right"] is not None]
    assert len(taken) == len(set(taken)) > 0 and len({r["left"] for r in found}) == len(found) and all(r["solved"] for r in found)


def test_lanes(spark):
    rows = [("f", 0, "t", None), ("f", 1, "t", "r"), ("f", 2, None, "r"), ("f", 3, "u", "r2"), ("g", 3, "t", None), ("f", 1, None, None), ("f", 0, "t", None)]
    found = mg.best_lane(spark.createDataFrame(rows, "s string, lane int, a string, b string"), "lane", ["s"], ["a", "b"])
    # the response that the suppressed second row names suppresses the third all the same
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [rows[0], rows[3], rows[4], rows[5], rows[6]]))


def span(name, trace, span_id, parent=None, at=1_775_934_260, **attributes):
    return {"type": "span", "traceId": trace, "spanId": span_id, "parentSpanId": parent, "name": name, "startTime": [at, 133_000_000], "endTime": [at + 4, 967_317_833], "attributes": attributes}


def units(i, o, r=0, w=0, t=0):
    return {"gen_ai.usage.input_tokens": i, "gen_ai.usage.output_tokens": o, "gen_ai.usage.cache_read.input_tokens": r, "gen_ai.usage.cache_write_input_tokens": str(w), "gen_ai.usage.reasoning_tokens": float(t)}


def test_traces_of_spans(spark, tmp_path):
    lines = [
        {"type": "metric", "name": "gen_ai.client.token.usage"},
        # a chat and what its invocation sums up: the chat counts; the invocation's own agent comes later in the file
        span("chat x", "t1", "c1", "i2", **{"gen_ai.request.model": " claude-sonnet-4 ", "gen_ai.conversation.id": "conv-1"}, **units(19_452, 281, 123, 7, 128)),
        span("invoke_agent sub", "t1", "i2", "m", **{"gen_ai.agent.id": "inner"}, **units(1, 1)),
        {"traceId": "t1", "spanId": "m", "parentSpanId": "i1", "name": "no attributes"},
        span("invoke_agent main", "t1", "i1", "0000", **{"gen_ai.agent.id": "outer", "session.id": "better"}, **units(20_000, 300)),
        # the same span told again with more
        span("chat x", "t1", "c1", "i2", **units(19_460, 290, 123)),
        # records of a response without a trace, from the most exact to the coarsest
        {"body": "GenAI inference: x", "time": [1_775_934_300, 0], "attributes": {"gen_ai.response.id": "r9", "gen_ai.response.model": "gpt-5.4", **units(10, 5, 40)}},
        {"_body": "copilot_chat.agent.turn: 1", "timestamp": 1_775_934_301_000_000_000, "attributes": {"gen_ai.response.id": "r9", "turn.index": "1", **units(10, 5)}},
        # only a summary, in a trace of its own; a turn of another
        span("other", "t3", "s3", **{"gen_ai.operation.name": "invoke_agent", "gen_ai.response.model": "grok-4"}, **units(3, 0)),
        {"spanContext": {"traceId": "t4", "spanId": "0000000000000000"}, "traceId": "00000000000000000000000000000000", "attributes": {"event.name": "copilot_chat.agent.turn", "copilot_chat.turn.index": 2, **units(0, 6)}},
        {"type": "event", "attributes": {"event.name": "copilot_chat.agent.turn"}},
    ]
    (tmp_path / "otel.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json", "", "[1]"]))
    found = {r["dedup_key"].split(":177")[0]: r for r in adapters.facts(spark, "copilot", str(tmp_path)).collect()}
    assert {k: (r["session_id"], r["model_id"], r["provider_id"], r["input"], r["output"], r["cache_read"], r["cache_write"], r["reasoning"]) for k, r in found.items()} == {
        "t1:c1": ("conv-1", "claude-sonnet-4", "anthropic", 19_337, 290, 123, 7, 128),
        "log:r9": ("r9", "gpt-5.4", "openai", 0, 5, 40, 0, 0),
        "t3:s3": ("t3", "grok-4", "xai", 3, 0, 0, 0, 0),
        "agent-turn:t4:2": ("t4", "unknown", "github-copilot", 0, 6, 0, 0, 0),
    }
    assert found["t1:c1"]["timestamp_ms"] == 1_775_934_260_133 and found["log:r9"]["timestamp_ms"] == 1_775_934_300_000
    contexts = {r["trace"]: r for r in transcripts.trace_contexts(transcripts.span_records(spark, str(tmp_path), "*.jsonl")).collect()}
    assert (contexts["t1"]["trace_agent"], contexts["t1"]["trace_model"], contexts["t1"]["trace_session"]) == ("outer", "claude-sonnet-4", "conv-1")


def reply(i, parent, second, **more):
    return {"type": "message", "id": i, "parentId": parent, "timestamp": f"2026-01-02T03:04:{second:02d}.000Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "four letters"}]}, **more}


def used(i, o, r=0, w=0, cost=None):
    return {"inputTokens": i, "outputTokens": o, "cacheReadTokens": r, "cacheWriteTokens": w, **({} if cost is None else {"costUsd": cost})}


def test_conversations_that_branch(spark, tmp_path):
    home = tmp_path / ".commandcode"
    logs = home / "projects" / "p"
    logs.mkdir(parents=True)
    (home / "config.json").write_text('{"model": "MiniMaxAI/MiniMax-M3"}')
    ask = lambda i, parent: {"type": "message", "id": i, "parentId": parent, "message": {"role": "user", "content": "12345678"}}
    third = [
        {"type": "session", "id": "S", "version": 3}, {"type": "model_change", "id": "m", "parentId": None, "model": "Meta/Muse-Spark-1.1"},
        ask("a", "m"), reply("b", "a", 1, usage=used(100, 5, 60, 10, 0.5)),
        ask("c", "b"), reply("left", "c", 2, usage=used(7, 7)),  # a branch that was left
        ask("d", "b"), reply("e", "d", 3, usage=used(0, 0, 0, 0, 0.0)),  # neither used nor billed
        reply("f", "e", 4, usage=used(0, 0, 0, 0, 0.25), model="gpt-5.4"), reply("g", "f", 5),
    ]
    write = lambda name, rows: (logs / name).write_text("\n".join(map(json.dumps, rows)))
    write("one.jsonl", third)
    write("one.checkpoints.jsonl", third)
    # a line between leaf and root is lost: nothing is dropped
    write("hole.jsonl", [{**r, "id": "h" + r["id"], "parentId": r.get("parentId") and "h" + r["parentId"]} for r in third if r["id"] not in ("b", "S")])
    write("old.jsonl", [{"sessionId": "L", "role": "user", "content": [{"type": "text", "text": "x" * 40}]}, {"sessionId": "L", "role": "assistant", "content": ""}, {"sessionId": "other", "role": "assistant", "content": [{"type": "text", "text": "y"}]}])
    rows = adapters.facts(spark, "commandcode", str(home)).collect()
    pick = lambda s: sorted((r["message_id"] or "", r["model_id"], r["provider_id"], r["input"], r["output"], r["cache_read"], r["cache_write"], r["cost"]) for r in rows if r["session_id"] == s)
    text = len(json.dumps([{"type": "text", "text": "four letters"}], separators=(",", ":")))
    assert pick("S") == [("b", "Muse-Spark-1.1", "meta", 30, 5, 60, 10, 0.5), ("f", "gpt-5.4", "openai", 0, 0, 0, 0, 0.25), ("g", "gpt-5.4", "openai", 0, -(-text // 4), 0, 0, None)]
    assert [r[0] for r in pick("hole")] == ["hf", "hg", "hleft"]
    asked = len(json.dumps([{"type": "text", "text": "x" * 40}], separators=(",", ":")))
    assert [(r[1], r[2], r[3], r[4]) for r in pick("L")] == [("MiniMax-M3", "minimax", 0, -(-len('[{"type":"text","text":"y"}]') // 4)), ("MiniMax-M3", "minimax", -(-asked // 4), 0)]
    assert len({r["dedup_key"] for r in rows}) == len(rows) and {r["dedup_key"] for r in rows if r["message_id"] == "b"} == {"b:1767323041000"}


def shares(total, weights):
    done, out, upto = 0, [], 0
    for w in weights:
        done += w
        now = total * done // sum(weights)
        out.append(now - upto)
        upto = now
    return out


def test_totals_shared_out_over_a_transcript(spark, tmp_path):
    settings = lambda **more: json.dumps({"model": "custom:Claude-Opus-4.5-[Thinking]-", "providerLock": "anthropic", "providerLockTimestamp": "2040-01-02T03:04:05Z", "tokenUsage": {"inputTokens": 1_001, "outputTokens": 77, "cacheCreationTokens": 13, "cacheReadTokens": 50_000, "thinkingTokens": 5}, **more})
    pick, lines = random.Random(3), []
    for k in range(30):
        lines.append(json.dumps({"type": "message", "message": {"role": "user", "content": "x" * pick.randint(0, 90)}}))
        if k == 12:
            lines.append(json.dumps({"type": "compaction_state", "summary": "y" * 40}))
        if k == 20:
            lines.append("broken \\ line é")
        at = {} if k == 5 else {"timestamp": f"2026-01-02T03:{k:02d}:05Z"}
        lines.append(json.dumps({"type": "message", **at, "message": {"role": "assistant", "content": "z" * pick.randint(0, 300)}}))
    (tmp_path / "a.settings.json").write_text(settings())
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.settings.json").write_text(settings(model=None, providerLock="openai"))
    (tmp_path / "c.settings.json").write_text(settings(model=None))
    (tmp_path / "c.jsonl").write_text('{"type": "x", "text": "Model: Sonnet 4.5 [fast]\\n"}\n')
    (tmp_path / "d.settings.json").write_text(json.dumps({"model": "m", "tokenUsage": {"inputTokens": 0}}))
    (tmp_path / "e.settings.json").write_text("no json")
    # plain walk over the lines
    turns, context = [], 0
    for line in lines:
        row = json.loads(line) if line.startswith("{") else {}
        size = len(line.encode())
        if row.get("type") == "compaction_state":
            context = size
            continue
        read, context = context, context + size
        if row.get("message", {}).get("role") == "assistant" and "timestamp" in row:
            turns.append((max(read, 1), size, row["timestamp"]))
    rows = adapters.facts(spark, "droid", str(tmp_path)).collect()
    found = sorted((r for r in rows if r["session_id"] == "a"), key=lambda r: int(r["message_id"]))
    assert len(found) == len(turns) == 29
    for name, total, side in (("input", 1_001, 0), ("cache_read", 50_000, 0), ("cache_write", 13, 0), ("output", 77, 1), ("reasoning", 5, 1)):
        assert [r[name] for r in found] == shares(total, [t[side] for t in turns])
        assert sum(r[name] for r in found) == total
    assert [r["message_count"] for r in found] == [29] + [0] * 28 and {(r["model_id"], r["provider_id"]) for r in found} == {("claude-opus-4-5", "anthropic")}
    others = {r["session_id"]: (r["model_id"], r["input"], r["message_count"], r["timestamp_ms"]) for r in rows if r["session_id"] != "a"}
    assert others == {"b": ("gpt-unknown", 1_001, 1, 2_209_086_245_000), "c": ("sonnet 4-5", 1_001, 1, 2_209_086_245_000)}
    # neighbours are joined: at most so many parts, with the same sums
    text = spark.createDataFrame([("s", k, line) for k, line in enumerate(lines)], "stem string, place long, line string")
    for most in (1, 4, 10, 29, 100):
        parts = transcripts.transcript_parts(text, most).orderBy("part").collect()
        run = -(-29 // most)
        chunks = [turns[k : k + run] for k in range(0, 29, run)]
        assert [(r["context"], r["spoken"], r["replies"]) for r in parts] == [(sum(t[0] for t in c), sum(t[1] for t in c), len(c)) for c in chunks] and len(parts) <= most
