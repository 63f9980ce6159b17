"""A parent's counts hold its children's, which count once."""

import json

from tidemark.sources import adapters, lineages


def counts(i, o=0, r=0, w=0):
    return {"input": i, "output": o, "cacheRead": r, "cacheWrite": w}


def stamp(second, ms=0):
    return f"2026-01-02T03:04:{second:02d}.{ms:03d}Z"


def head(name, parent=None, depth=0):
    return {"type": "session", "id": name, "parentSession": parent, "rlmDepth": depth}


def reply(i, at, usage, model="gpt-5.4"):
    return {"type": "message", "id": i, "timestamp": at, "message": {"role": "assistant", "model": model, "provider": "openai", "usage": usage}}


def part(i, target, at, child, total):
    return {"type": "child_usage_attributed", "id": i, "targetId": target, "timestamp": at, "childUsage": child, "aggregateUsage": total}


def totals(spark, tmp_path):
    return {(r["session_id"], r["message_id"].split(":")[1]): (r["input"], r["output"], r["cache_read"], r["cache_write"]) for r in adapters.facts(spark, "prime-agent", str(tmp_path)).collect()}


def write(tmp_path, **logs):
    for name, rows in logs.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))


def test_children_with_logs_are_taken_off_their_parents(spark, tmp_path):
    parent = [
        head("p"),
        # its own 10, a child of 5 whose log is there, and one of 7 whose log is gone
        reply("a", stamp(1), counts(22, 3)), part("x", "a", stamp(5, 20), counts(5), counts(15, 3)), part("y", "a", stamp(9), counts(7), counts(22, 3)),
        # a later attribution is not yet in the sum
        part("z", "a", stamp(11), counts(9), counts(31, 3)), reply("b", stamp(2), counts(4)), {"type": "message", "message": {"role": "user"}},
    ]
    write(tmp_path, p=parent, c=[head("c", "p.jsonl", 1), reply("k", stamp(5), counts(5)), reply("far", stamp(20), counts(7))], d=[head("d", "other.jsonl", 1), reply("k", stamp(9, 1), counts(7))])
    assert totals(spark, tmp_path) == {("p", "a"): (17, 3, 0, 0), ("p", "b"): (4, 0, 0, 0), ("c", "k"): (5, 0, 0, 0), ("c", "far"): (7, 0, 0, 0), ("d", "k"): (7, 0, 0, 0)}


def test_forks_copy_replies_and_attributions(spark, tmp_path):
    rows = [reply("a", stamp(1), counts(15, 1)), part("x", "a", stamp(5), counts(5), counts(15, 1))]
    write(tmp_path, p=[head("p"), *rows], q=[head("q", "p.jsonl"), *rows, reply("n", stamp(30), counts(1))], r=[head("r", "q.jsonl"), *rows], c=[head("c", "p.jsonl", 1), reply("k", stamp(5), counts(5))])
    assert totals(spark, tmp_path) == {("p", "a"): (10, 1, 0, 0), ("q", "n"): (1, 0, 0, 0), ("c", "k"): (5, 0, 0, 0)}
    # forks that name each other are one lineage too
    (tmp_path / "loop").mkdir()
    write(tmp_path / "loop", p=[head("p", "q.jsonl"), *rows], q=[head("q", "p.jsonl"), *rows], c=[head("c", "q.jsonl", 1), reply("k", stamp(5), counts(5))])
    assert totals(spark, tmp_path / "loop") == {("p", "a"): (10, 1, 0, 0), ("c", "k"): (5, 0, 0, 0)}


def test_what_cannot_be_told_apart_stays_with_the_parents(spark, tmp_path):
    """Two attributions, one reply: the nearer one; at equal distance neither is certain."""
    two = lambda a, b: [head("p"), reply("a", stamp(1), counts(15)), part("x", "a", stamp(5, a), counts(5), counts(15)), reply("b", stamp(2), counts(25)), part("y", "b", stamp(5, b), counts(5), counts(25))]
    child = [head("c", "p.jsonl", 1), reply("k", stamp(5, 100), counts(5))]
    for name, (a, b), wanted in (("near", (110, 150), (10, 25)), ("even", (150, 50), (15, 25))):
        (tmp_path / name).mkdir()
        write(tmp_path / name, p=two(a, b), c=child)
        found = totals(spark, tmp_path / name)
        assert (found["p", "a"][0], found["p", "b"][0]) == wanted, name
    # without times on both sides lineage and counts must do; a time on one side proves nothing
    (tmp_path / "timeless").mkdir()
    write(tmp_path / "timeless", p=[head("p"), reply("a", stamp(1), counts(15)), part("x", "a", None, counts(5), counts(15))], c=[head("c", "p.jsonl", 1), reply("k", None, counts(5))])
    assert totals(spark, tmp_path / "timeless")["p", "a"] == (10, 0, 0, 0)
    write(tmp_path / "timeless", c=[head("c", "p.jsonl", 1), reply("k", stamp(5), counts(5))])
    assert totals(spark, tmp_path / "timeless")["p", "a"] == (15, 0, 0, 0)


def test_lineages(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "y")]
    found = {r["path"]: r["lineage"] for r in lineages.lineages(spark.createDataFrame(rows, "path string, parent string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x", "z": "x"}


def test_streamed_calls_share_names(spark, tmp_path):
    def row(model="claude-x", at=None, i=1, o=0, **names):
        return {"type": "assistant", "timestamp": at, **{k: names[k] for k in ("requestId", "uuid") if k in names}, "message": {"model": model, "id": names.get("id"), "usage": {"input_tokens": i, "output_tokens": o}}}

    write(
        tmp_path,
        a=[
            row(at=stamp(1), i=5, requestId="r", uuid="u1"), row(at=stamp(3), i=2, o=9, id="m", uuid="u1", model="deepseek-v3"), row(i=1, o=4, id="m"),  # one call, through two names
            row(i=7), row(i=7),  # without a name each stands alone
            row(i=1, requestId="x", id="both"), row(i=2, requestId="y", id="both"), row(i=3, id="both"), row(i=4, requestId="x"),  # two requests share a message: each is a call, what names none stays
            row(model="<synthetic>"), row(model=" "), row(i=0), {"type": "user"},
        ],
        b=[row(i=30, requestId="r")],  # another file's names are others
    )
    found = sorted((r["session_id"], r["model_id"], r["provider_id"], r["input"], r["output"]) for r in adapters.facts(spark, "cherrystudio", str(tmp_path)).collect())
    other = ("claude-x", "anthropic")
    assert found == sorted([("a", "deepseek-v3", "deepseek", 5, 9), ("a", *other, 7, 0), ("a", *other, 7, 0), ("a", *other, 4, 0), ("a", *other, 2, 0), ("a", *other, 3, 0), ("b", *other, 30, 0)])
