"""Formats whose records are no lines."""

import json
import random
import sqlite3

import pytest
import zstandard

from tidemark.sources import adapters, records


def record(k, **usage):
    return json.dumps({"id": f"chatcmpl-{k}", "object": "x", "model": f"m{k % 3}", "choices": [{"text": 'a "usage": {"prompt_tokens": 9} } { \\ b'}], "usage": usage}, indent=k % 2 or None)


def log():
    parts = ["[2026-07-09 10:00:00][INFO] start {\n", 'stray "usage": {"prompt_tokens": 5, "nested": {"usage": {"prompt_tokens": 7}}}\n', 'open "usage": {"prompt_tokens": 1\n']
    for k in range(9):
        parts.append(f"[2026-07-09 10:00:{k:02d}][INFO][fixture] Final \xe9: ")
        parts.append(record(k, prompt_tokens=10 + k, completion_tokens=5, total_tokens=20 + k, prompt_tokens_details={"cached_tokens": k}, completion_tokens_details={"reasoning_tokens": 2}) + "\n")
    parts += ['[2026-07-09 10:01:00][INFO] {"id": "other", "usage" : {"promptTokens": 3, "outputTokens": 4, "cached_tokens": 99}}\n', '"usage": {"prompt_tokens": 0}\n', '"usage": {broken}\n', '{\\"usage\\": {"prompt_tokens": 4}} "usage": 7 "usage"']
    return "".join(parts)


def test_records_are_the_same_for_ranges_of_any_size(spark, tmp_path):
    (tmp_path / "server.log").write_text(log(), encoding="latin-1")
    seen = lambda size: sorted((r["place"], r["stop"], r["prompt"], r["all_output"], r["cache_read"], r["reasoning"], r["total"], r["said_model"], r["said_id"], r["said_time"]) for r in records.log_records(spark, str(tmp_path), "*.log", size).collect())
    wanted = seen(1 << 20)
    # the stray record, one that is never closed and holds the rest up to where braces balance, or not
    assert [r[2:] for r in wanted if r[8] == "chatcmpl-4"] == [(14, 5, 4, 2, 24, "m1", "chatcmpl-4", "2026-07-09 10:00:04")]
    assert (3, 4, 3, 0, 7, None, None, "2026-07-09 10:01:00") in [r[2:] for r in wanted]
    assert [r[2] for r in wanted][0] == 5 and len(wanted) == 11
    for size in (37, 64, 500):
        assert seen(size) == wanted
    found = adapters.facts(spark, "lmstudio", str(tmp_path)).collect()
    assert len(found) == 11 and len({r["dedup_key"] for r in found}) == 11
    one = next(r for r in found if r["message_id"] == "chatcmpl-4")
    assert (one["input"], one["output"], one["cache_read"], one["reasoning"], one["model_id"], one["cost"], one["timestamp_ms"]) == (15, 3, 4, 2, "m1", 0.0, 1_783_591_204_000)


def test_object_ends():
    for text, end in ((b'{"a": "}"}x', 10), (b'{"a": "\\"}"}', 12), (b"{{}", None), (b'{"a', None), (b"{}", 2), (b'{"\\\\"}', 6)):
        assert records.object_end(text, 0) == end


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def packed(*fields):
    """A message of (number, value): whole numbers are varints, (8, n) eight bytes, (4, n) four, texts and bytes with their length."""
    out = b""
    for number, value in fields:
        if isinstance(value, tuple):
            out += varint(number << 3 | (1 if value[0] == 8 else 5)) + value[1].to_bytes(value[0], "little")
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def test_wire_messages_come_back():
    pick = random.Random(4)

    def made(depth=0):
        kinds = [lambda: pick.randrange(1 << pick.randint(1, 64)), lambda: (8, pick.randrange(1 << 64)), lambda: (4, pick.randrange(1 << 32)), lambda: "é" * pick.randint(0, 200)]
        return [(pick.randint(1, 3_000), made(depth + 1) if depth < 3 and pick.random() < 0.3 else pick.choice(kinds)()) for _ in range(pick.randint(0, 6))]

    def raw(message):
        return packed(*[(n, raw(v) if isinstance(v, list) else v) for n, v in message])

    def same(message, found):
        found = list(found)
        assert len(found) == len(message)
        for (n, v), (m, kind, w) in zip(message, found):
            assert n == m
            if isinstance(v, list):
                same(v, records.fields(w))
            else:
                assert w == (v.encode() if isinstance(v, str) else v[1] if isinstance(v, tuple) else v)

    for _ in range(300):
        message = made()
        whole = raw(message)
        same(message, records.fields(whole))
        # a damaged end loses only what is behind it
        cut = whole[: pick.randint(0, len(whole))]
        found = list(records.fields(cut))
        assert found == list(records.fields(whole))[: len(found)]
        assert list(records.fields(bytes(pick.randrange(256) for _ in range(40)))) is not None
    nested = packed((1, packed((4, packed((9, 70), (9, 80), (11, "r"))))), (1, b""))
    assert records.field(nested, "1.4.9", 0) == 70 and records.field(nested, "1.4.11", 2) == b"r" and records.field(nested, "1.5.9", 0) is None and records.field(None, "1", 0) is None


NOW = 1_790_000_000_000


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (packed((1, 1_789_999_000), (2, 5_000_000)), 1_789_999_000_005), (packed((1, 1_789_999_000_007)), 1_789_999_000_007), (packed((1, (8, 1_789_999_000_000_000))), 1_789_999_000_000),
        ((1_789_999_000).to_bytes(8, "little"), 1_789_999_000_000), ((1_789_999_000_000_000_000).to_bytes(8, "big"), 1_789_999_000_000), (packed((1, 1_600_000_000)), None), (b"x", None), (None, None), ((1 << 64) - 1).to_bytes(8, "big") and (((1 << 64) - 1).to_bytes(8, "big"), None),
    ],
)
def test_times_of_unknown_form(raw, wanted):
    assert records.told_ms(raw, 1_789_998_000_000, NOW) == wanted
    assert records.told_ms(raw, None, NOW) is None


def generation(i=0, j=0, cached=0, o=0, r=0, response="", model="", label="", at=None):
    usage = packed((1, i), (2, j), (5, cached), (9, o), (10, r), *([(11, response)] if response else []))
    return packed((1, packed((4, usage), *([(9, packed((4, packed((1, at)))))] if at else []), *([(19, model)] if model else []), *([(21, label)] if label else []))))


def test_wire_blobs_in_databases(spark, tmp_path):
    def base(name, rows, steps=(), meta=None):
        b = sqlite3.connect(tmp_path / name)
        b.execute("create table gen_metadata(idx integer, data blob)")
        b.executemany("insert into gen_metadata values (?, ?)", rows)
        if steps is not None:
            b.execute("create table steps(step_type integer, metadata blob)")
            b.executemany("insert into steps values (?, ?)", steps)
        if meta:
            b.execute("create table trajectory_metadata_blob(data blob)")
            b.execute("insert into trajectory_metadata_blob values (?)", (meta,))
        b.commit()
        b.close()

    step = lambda at, response="", gen=None: packed((1, packed((1, at))), *([(9, packed((11, response)))] if response else []), *([(20, packed((3, gen)))] if gen is not None else []))
    base(
        "one.db",
        [
            (0, generation(10, 5, 3, 7, 2, "r0", "claude-sonnet-4", "Sonnet", 1_767_000_000)), (1, generation(1, o=1, response="r1", model="gemini-default", label="Sonnet")), (2, generation(4, response="r0", model="x")),
            (3, generation(2, model=" Gemini-Default ", label="Unknown label")), (4, generation(3, label="Gemini 3.5 Flash (High)")), (5, b"\xff\xff"), (6, generation()), (7, generation(6)),
        ],
        [(15, step(1_767_000_100, "r1")), (15, step(1_767_000_200, "", 3)), (14, step(1, "", 4)), (15, b"\x0a\xff")],
        packed((2, packed((1, 1_766_999_000), (2, 1)))),
    )
    base("two.db", [(0, generation(1, model="gpt-5.4")), (1, generation(2, model="gemini-default"))], None)
    found = {(r["session_id"], r["message_id"]): r for r in adapters.facts(spark, "antigravity-cli", str(tmp_path)).collect()}
    assert {k: (r["model_id"], r["provider_id"], r["input"], r["output"], r["cache_read"], r["reasoning"]) for k, r in found.items()} == {
        ("one", "0"): ("claude-sonnet-4", "anthropic", 15, 7, 3, 2), ("one", "1"): ("claude-sonnet-4", "anthropic", 1, 1, 0, 0), ("one", "3"): (" Gemini-Default ", "google", 2, 0, 0, 0),
        ("one", "4"): ("gemini-3.5-flash-high", "google", 3, 0, 0, 0), ("one", "7"): ("unknown", "antigravity", 6, 0, 0, 0),
        ("two", "0"): ("gpt-5.4", "openai", 1, 0, 0, 0), ("two", "1"): ("gpt-5.4", "openai", 2, 0, 0, 0),
    }
    assert [found["one", k]["timestamp_ms"] for k in "0137"] == [1_767_000_000_000, 1_767_000_100_000, 1_767_000_200_000, 1_766_999_000_000]


def event(kind, seq, **data):
    return {"type": kind, "seq": seq, "time": 1_780_000_000_000 + seq, "data": data}


def use(i, o, r=0, w=0, t=0):
    return {"inputTokens": i, "outputTokens": o, "cacheReadTokens": r, "cacheWriteTokens": w, "reasoningTokens": t}


def test_logs_keyed_by_a_sequence(spark, tmp_path):
    """Reports repeated within a log, or taken over from the session that it continues, count once."""
    header = event("request/header", 1, header={"config": {"provider": "p", "model": "m"}})
    say = lambda i, seq, usage, **source: event("assistant/message", seq, turn=0, message={"id": i, "source": source}, usage=usage)
    first = [{"type": "session", "id": "a"}, header, say("x", 3, use(11, 2, 110, 1)), event("compaction/summary", 7, compactionId="c", usage=use(300, 31, 3_000, 7))]
    # continues the first, repeats its reports and adds one; a report twice
    second = [{"type": "session", "id": "b", "parentSession": "a"}, *first[1:], say("y", 8, use(19, 7, 190, 2)), say("y", 8, use(19, 7, 190, 2)), say(" ", 9, use(1, 1)), say(None, 10, use(1, 1)), say("z", 11, use(0, 0))]
    # seeded with five events of another log
    third = [{"type": "session", "id": "c", "seedLength": 5}, header, say("s", 4, use(5, 5)), say("t", 5, use(6, 9, t=20), model="asked", replayState={"response": {"responseModel": " served "}}), event("assistant/message", 6, usage=use(1, 0))]
    for name, rows, pack in (("a", first, False), ("b", second, True), ("c", third, False)):
        (tmp_path / name).mkdir()
        raw = "\n".join(map(json.dumps, rows)).encode()
        (tmp_path / name / ("session.jsonl.zst" if pack else "session.jsonl")).write_bytes(zstandard.ZstdCompressor().compress(raw) if pack else raw)
    found = adapters.facts(spark, "dsh", str(tmp_path)).collect()
    once = {r["dedup_key"]: r for r in found}
    assert sum(r["input"] for r in once.values()) == 11 + 300 + 19 + 1 + 1 + 6 + 1 and len(once) == 7
    assert sum(r["session_id"] == "b" for r in found) == 5
    served = next(r for r in found if r["model_id"] == "served")
    assert (served["provider_id"], served["output"], served["reasoning"], served["message_id"]) == ("p", 0, 9, "t")
    assert {r["dedup_key"].split(":")[1] + ":" + r["dedup_key"].split(":")[2] for r in found if r["session_id"] == "b"} >= {"msg:x", "summary:cmp", "seq:9", "seq:10"}
