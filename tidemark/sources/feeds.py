"""Price lists of several publishers as one catalogue; a list that cannot be read degrades to its last good copy, then to nothing.

A feed is a JSON file that another job fetches. Its rows are key, provider, source and the rates of a unit. A copy of
each good list is kept as a version of its own, so one broken, empty or cut-short file costs no prices.

Defined results: entries that are no objects, or without any rate that is a number from 0 on, are left out. A list
without a usable entry counts as unreadable: a good copy is never replaced by an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import cut_lineage
from tidemark.streaming import tables

RATES = ("input", "output", "cache_read", "cache_write")


def _rate(text: str) -> Column:
    value = F.expr(f"try_cast({text} as double)")
    return F.when((value >= 0) & (value < float("inf")), value)


def _rows(listed: DataFrame, rates: dict[str, str], scale: float, key: str, provider: str) -> DataFrame:
    found = listed.select(F.expr(key).alias("key"), F.expr(provider).alias("provider"), *[(_rate(rates[r]) * scale).alias(r) for r in RATES])
    return found.where("key is not null").where(" or ".join(f"{r} is not null" for r in RATES)).dropDuplicates(["key"])


# Names of fields in each form of a list.
def by_unit(text: DataFrame) -> DataFrame:
    """An object of models by name, with rates of one unit."""
    entry = "input_cost_per_token string, output_cost_per_token string, cache_read_input_token_cost string, cache_creation_input_token_cost string, litellm_provider string"
    listed = text.select(F.explode(F.from_json("value", f"map<string, struct<{entry}>>")).alias("name", "e"))
    return _rows(listed, {"input": "e.input_cost_per_token", "output": "e.output_cost_per_token", "cache_read": "e.cache_read_input_token_cost", "cache_write": "e.cache_creation_input_token_cost"}, 1.0, "name", "e.litellm_provider")


def by_text(text: DataFrame) -> DataFrame:
    """A list of models, with rates of one unit as texts."""
    listed = text.select(F.explode(F.from_json("value", "data array<struct<id string, pricing struct<prompt string, completion string, input_cache_read string, input_cache_write string>>>")["data"]).alias("e"))
    return _rows(listed, {"input": "e.pricing.prompt", "output": "e.pricing.completion", "cache_read": "e.pricing.input_cache_read", "cache_write": "e.pricing.input_cache_write"}, 1.0, "e.id", "substring_index(e.id, '/', 1)")


def by_million(text: DataFrame) -> DataFrame:
    """An object of providers, each with an object of models, with rates of a million units."""
    providers = text.select(F.explode(F.from_json("value", "map<string, struct<models map<string, struct<cost struct<input string, output string, cache_read string, cache_write string>>>>>")).alias("by", "p"))
    listed = providers.select("by", F.explode("p.models").alias("name", "e"))
    return _rows(listed, {r: f"e.cost.{r}" for r in RATES}, 1e-6, "by || '/' || name", "by")


Form = Callable[[DataFrame], DataFrame]


def feed(spark: SparkSession, path: str, form: Form, copies: str, number: int) -> tuple[DataFrame | None, str]:
    """The rows of a list and whether they are fresh, stale (the newest copy) or missing (None). A fresh list becomes copy number `number`."""
    try:
        fresh = cut_lineage(form(spark.read.option("wholetext", "true").text(path)), "feed")
        if fresh.limit(1).count():
            tables.refreshed(spark, copies, lambda: fresh, number)
            return fresh, "fresh"
    except PySparkException:
        pass  # no such file, or one that no reader can open: the copy stands in
    stored = tables.current(spark, copies)
    return stored, "missing" if stored is None else "stale"


def catalogue(spark: SparkSession, lists: dict[str, tuple[str, Form]], copies: str, number: int) -> tuple[DataFrame, dict[str, str]]:
    """All lists as one catalogue with a column source, and the state of each; lists maps a source to its path and form."""
    empty = spark.createDataFrame([], "key string, provider string, " + ", ".join(f"{r} double" for r in RATES) + ", source string")
    states = {}
    for source, (path, form) in lists.items():
        rows, states[source] = feed(spark, path, form, f"{copies.rstrip('/')}/{source}", number)
        if rows is not None:
            empty = empty.unionByName(rows.withColumn("source", F.lit(source)))
    return empty, states
