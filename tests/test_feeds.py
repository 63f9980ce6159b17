"""Price lists in three forms, and what stands in for one that cannot be read."""

import json

from tidemark.operators import pricing
from tidemark.sources import feeds


def rows(frame):
    return sorted((r["key"], r["provider"], *[r[c] for c in feeds.RATES]) for r in frame.collect())


def test_three_forms(spark):
    text = lambda value: spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "value string")
    unit = {"gpt-5.4": {"input_cost_per_token": 2e-06, "output_cost_per_token": "1e-5", "litellm_provider": "openai", "mode": "chat"}, "free": {"input_cost_per_token": 0}, "bad": {"input_cost_per_token": -1}, "none": {"mode": "x"}}
    assert rows(feeds.by_unit(text(unit))) == [("free", None, 0.0, None, None, None), ("gpt-5.4", "openai", 2e-06, 1e-05, None, None)]
    listed = {"data": [{"id": "x-ai/grok-4", "pricing": {"prompt": "0.000003", "completion": "0.000015", "input_cache_read": "x"}}, {"id": None, "pricing": {"prompt": "1"}}, {"id": "y"}]}
    assert rows(feeds.by_text(text(listed))) == [("x-ai/grok-4", "x-ai", 3e-06, 1.5e-05, None, None)]
    million = {"anthropic": {"models": {"claude-x": {"cost": {"input": 5, "output": 25, "cache_read": 0.5, "cache_write": 6.25}}, "no": {}}}, "empty": {}}
    found = rows(feeds.by_million(text(million)))
    assert [r[:2] for r in found] == [("anthropic/claude-x", "anthropic")] and [round(x * 1e6, 6) for x in found[0][2:]] == [5, 25, 0.5, 6.25]
    for form in (feeds.by_unit, feeds.by_text, feeds.by_million):
        assert rows(form(text("no json"))) == rows(form(text("[]"))) == rows(form(text(""))) == []


def test_a_broken_list_degrades_to_its_copy(spark, tmp_path):
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    one.write_text(json.dumps({"gpt-5.4": {"input_cost_per_token": 2e-06, "litellm_provider": "openai"}}))
    lists = {"one": (str(one), feeds.by_unit), "two": (str(two), feeds.by_text)}
    copies = str(tmp_path / "copies")
    found, states = feeds.catalogue(spark, lists, copies, 1)
    assert states == {"one": "fresh", "two": "missing"} and found.count() == 1
    two.write_text(json.dumps({"data": [{"id": "openai/gpt-5.4", "pricing": {"prompt": "0.5"}}]}))
    one.write_text('{"gpt-5.4": {"input_co')
    found, states = feeds.catalogue(spark, lists, copies, 2)
    assert states == {"one": "stale", "two": "fresh"} and {(r["source"], r["key"], r["input"]) for r in found.collect()} == {("one", "gpt-5.4", 2e-06), ("two", "openai/gpt-5.4", 0.5)}
    # an empty list never replaces a good copy
    one.write_text("{}")
    two.unlink()
    found, states = feeds.catalogue(spark, lists, copies, 3)
    assert states == {"one": "stale", "two": "stale"} and found.count() == 2
    priced = lambda *order: pricing.look_up(spark.createDataFrame([("gpt-5.4",)], "model_id string"), found, sources=list(order)).first()["input"]
    assert (priced("one", "two"), priced("two", "one")) == (2e-06, 0.5)
