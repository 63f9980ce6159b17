"""Queries of pricing, and for each what DuckDB must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import pricing
from tidemark.plans.catalogue import _E, _events, query
from tidemark.session import if_small, table
from tidemark.sources.facts import event_facts

_USE = {"input": "input * 6000", "output": "output * 6000", "reasoning": "reasoning * 9000", "cache_read": "cache_read * 7000", "cache_write": "cache_write * 90000"}
_RATES = {"input": 3.0, "output": 15.0, "cache_read": 0.3, "cache_write": 3.75, "input_128": 4.0, "input_200": 6.0, "input_272": 7.0, "output_200": 22.5, "output_272": 30.0, "cache_read_200": 0.6, "cache_write_200": 7.5}
_SOLD = ["openai", "xai", "anthropic"]


def _request_costs(e: DataFrame) -> DataFrame:
    use = {k: F.expr(v) for k, v in _USE.items()}
    vendor = F.element_at(F.array(*map(F.lit, _SOLD)), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", F.round(pricing.request_cost(use, {k: F.lit(v) for k, v in _RATES.items()}, vendor), 4).alias("cost"))


def _steps(kind: str, n: str) -> str:
    found, below = f"{n} * {_RATES[kind]}::double", _RATES[kind]
    for t in pricing.TIERS[kind]:
        rate = _RATES.get(f"{kind}_{t // 1000}")
        if rate is not None:
            found += f" + greatest({n} - {t}, 0) * {rate - below}::double"
            below = rate
    return found


_N = {"input": "i", "output": "o", "cache_read": "r", "cache_write": "w"}
_flat = lambda t: " + ".join(f"{n} * {_RATES.get(f'{k}_{t}', _RATES[k])}::double" for k, n in _N.items())
_events(
    "request_costs",
    _request_costs,
    f""", u as (select event_id, {_USE['input']} as i, {_USE['output']} + {_USE['reasoning']} as o, {_USE['cache_read']} as r, {_USE['cache_write']} as w from e)
select event_id, round(case event_id % 3 when 0 then case when i + r + w > 272000 then {_flat(272)} else {_flat(0)} end when 1 then case when i + r + w >= 200000 then {_flat(200)} else {_flat(0)} end else {' + '.join(_steps(k, n) for k, n in _N.items())} end, 4) as cost from u""",
)
_events("progressive_tiers", lambda e: e.select("event_id", F.round(pricing.progressive(F.expr(_USE["input"]), F.lit(3.0), [(t, F.lit(_RATES.get(f"input_{t // 1000}")).cast("double")) for t in pricing.TIERS["input"]]), 4).alias("cost")), f", u as (select event_id, {_USE['input']} as i from e) select event_id, round({_steps('input', 'i')}, 4) as cost from u")
_events(
    "cost_precedence",
    lambda e: e.select("event_id", pricing.precedence(F.when(F.col("event_id") % 3 == 0, F.col("cost").cast("double")), F.col("units") * 2.0, F.col("event_id") % 5 == 0).alias("cost")),
    "select event_id, case when event_id % 3 = 0 then cast(cost as double) when event_id % 5 = 0 then null else units * 2.0::double end as cost from e",
)
_events(
    "rate_coverage",
    lambda e: e.select("event_id", pricing.covers({k: F.col(k) for k in _USE}, {"input": F.when(F.col("event_id") % 4 > 0, F.lit(0.0)), "output": F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 2).cast("double")), "cache_read": F.when(F.col("event_id") % 5 > 0, 0.0), "cache_write": F.lit(None).cast("double")}).alias("covered")),
    ", r as (select *, case when event_id % 4 > 0 then 0.0 end as ri, case when event_id % 3 > 0 then event_id % 2 end as ro, case when event_id % 5 > 0 then 0.0 end as rr from e) select event_id, coalesce(ri is not null and ro = 0, false) or ((input <= 0 or ri is not null) and (output <= 0 or ro is not null) and (reasoning <= 0 or ro is not null) and (cache_read <= 0 or rr is not null) and cache_write <= 0) as covered from r",
)
# Names of models as logs write them, and a small price list.
MODELS = ["gpt-5.4", "GPT-5.4-20261001", "gpt-5.4-codex-max", "team-gpt-5.4", "openai/gpt-5.4", "claude-4-6-opus", "anthropic/claude-opus-4-6", "auto", "gpt-5.4(strange)", "gpt-5.4(high)", "none-such", "glm-4.6-air-x-y-z"]
CATALOGUE = [("openai/gpt-5.4", "openai", 1.0, 8.0), ("azure/gpt-5.4", "azure", 1.1, 8.8), ("gpt-5.4-codex", "openai", 1.5, 9.0), ("claude-opus-4-6", "anthropic", 5.0, 25.0), ("openrouter/claude-opus-4-6", "openrouter", 5.5, 27.5), ("glm-4-6-air", "zai", 0.2, 1.1)]
#: What each model of MODELS, without a hint and with the hint azure, is priced by.
PRICED = {
    "gpt-5.4": ("openai/gpt-5.4", "azure/gpt-5.4"), "GPT-5.4-20261001": ("openai/gpt-5.4", "azure/gpt-5.4"), "gpt-5.4-codex-max": ("gpt-5.4-codex", "gpt-5.4-codex"), "team-gpt-5.4": ("openai/gpt-5.4", "azure/gpt-5.4"),
    "openai/gpt-5.4": ("openai/gpt-5.4", "openai/gpt-5.4"), "claude-4-6-opus": ("claude-opus-4-6", "claude-opus-4-6"), "anthropic/claude-opus-4-6": ("claude-opus-4-6", "claude-opus-4-6"), "gpt-5.4(high)": ("openai/gpt-5.4", "azure/gpt-5.4"), "glm-4.6-air-x-y-z": ("glm-4-6-air", "glm-4-6-air"),
}


def _priced_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct models and hints are looked up once, then joined to all rows."""
    rows = event_facts(spark, sf).select("event_id", "units", F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % len(MODELS) + 1).cast("int")).alias("model_id"), F.when(F.col("event_id") % 2 == 0, "azure").otherwise("").alias("hint"))
    rates = spark.createDataFrame(CATALOGUE, "key string, provider string, input double, output double")
    return rows.join(if_small(pricing.look_up(rows, rates).select("model_id", "hint", "key", "input")), ["model_id", "hint"], "left").select("event_id", "model_id", "key", (F.col("units") * F.col("input")).alias("cost"))


_VALUES = ", ".join(f"('{m}', {h}, '{k}', {dict((c[0], c[2]) for c in CATALOGUE)[k]})" for m, both in PRICED.items() for h, k in enumerate(both))
_LIST = ", ".join(f"'{m}'" for m in MODELS)
query("staged_price_lookup", f"with {_E}, m as (select *, ([{_LIST}])[event_id % {len(MODELS)} + 1] as name from e), p(name, hinted, key, rate) as (values {_VALUES}) select event_id, m.name as model_id, key, units * cast(rate as double) as cost from m left join p on p.name = m.name and hinted = (event_id + 1) % 2")(_priced_rows)
_ODD = """case event_id % 6 when 0 then 'auto' when 1 then ' Agent_Review ' when 2 then client || '(high)' when 3 then client || ' (odd one)' when 4 then 'auto-' || client else client end"""
_BY = """case event_id % 5 when 0 then 'unpriced' when 1 then 'Unpriced:' || client when 2 then 'openai' when 3 then 'unpriceds' end"""
_events("priceless_models", lambda e: e.select("event_id", pricing.refused(F.expr(_ODD), F.expr(_BY)).alias("refused")), "select event_id, event_id % 6 in (0, 1, 3) or event_id % 5 in (0, 1) as refused from e")
query("borrowed_rates", "select p_partkey, case when p_size % 3 > 0 then p_retailprice end as input, coalesce(case when p_size % 2 = 0 then 1.0 end, case when p_size % 3 = 0 or p_size % 5 > 0 then 2.0 end)::double as cache_read from part")(
    lambda spark, sf: (lambda t: pricing.borrowed(t.select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("input"), F.when(F.col("p_size") % 2 == 0, 1.0).alias("cache_read")), t.select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_retailprice")).otherwise(F.col("p_retailprice") + 1).alias("input"), F.lit(2.0).alias("cache_read")), "p_partkey", ("input",), ("cache_read",)))(table(spark, sf, "part"))
)

# Lookups over names made of the parts: a catalogue of brand/name-size with a price each, a fifth of it without one; models are names, with a size, or with more after it
_PART_RATES = """p as (select *, replace(p_name, ' ', '-') as name, 'maker' || translate(p_brand, 'Brand#0123456789', '      abcdefghij') as brand0 from part),
p1 as (select * exclude brand0, replace(brand0, ' ', '') as brand from p),
c as (select brand || '/' || name || '-' || p_size as key, min(case when p_partkey % 5 > 0 then p_retailprice end) as input from p1 group by 1),
m as (select distinct case p_partkey % 4 when 0 then name when 1 then name || '-' || p_size when 2 then name || '-' || p_size || '-fast' else upper(name) || '.' || p_size end as model_id, case when p_partkey % 3 = 0 then brand else '' end as hint from p1),
n as (select *, lower(model_id) as low, replace(lower(model_id), '.', '-') as alike from m),
f as (select n.*, c.key, c.input, split_part(c.key, '/', 2) as tail, split_part(c.key, '/', 1) as brand from n join c on c.input is not null and (contains(c.key, n.low) or contains(c.key, n.alike) or contains(n.alike, split_part(c.key, '/', 2)))),
st as (select *, case when tail = low then 0 when tail = alike then 1 when regexp_matches(key, '(^|[^a-z0-9])' || replace(low, '.', '[.]') || '($|[^a-z0-9])') and length(low) >= 5 then 6
 when alike[: length(tail)] = tail and alike[length(tail) + 1] = '-' and len(string_split(alike[length(tail) + 2 :], '-')) <= 4 then 8 + 2 * (len(string_split(alike[length(tail) + 2 :], '-')) - 1) + case when low[: length(tail)] = tail and low[length(tail) + 1] = '-' then 0 else 1 end
 when alike[-length(tail) :] = tail and alike[-length(tail) - 1] = '-' and len(string_split(alike[: -length(tail) - 2], '-')) <= 2 then 16 + 2 * (len(string_split(alike[: -length(tail) - 2], '-')) - 1) + case when low[-length(tail) :] = tail then 0 else 1 end end as stage from f)"""


def _part_prices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf, "part").withColumns({"name": F.replace("p_name", F.lit(" "), F.lit("-")), "brand": F.concat(F.lit("maker"), F.translate(F.regexp_replace("p_brand", "[^0-9]", ""), "0123456789", "abcdefghij"))})
    rates = parts.groupBy(F.concat("brand", F.lit("/"), "name", F.lit("-"), "p_size").alias("key")).agg(F.min(F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice"))).alias("input"))
    made = "case p_partkey % 4 when 0 then name when 1 then name || '-' || p_size when 2 then name || '-' || p_size || '-fast' else upper(name) || '.' || p_size end"
    return parts.select(F.expr(made).alias("model_id"), F.expr("if(p_partkey % 3 = 0, brand, '')").alias("hint")), rates


_PLACED = "select *, row_number() over (partition by model_id, hint order by stage, brand = hint desc, length(key) desc, key) as place, min(stage) over (partition by model_id, hint) as first_stage from st where stage is not null"
query("names_inside_names", f"with {_PART_RATES}, r as ({_PLACED}) select model_id, hint, key, cast(stage as integer) as stage, input from r where place = 1")(lambda spark, sf: pricing.look_up(*_part_prices(spark, sf)))
query("price_evidence", f"with {_PART_RATES}, r as ({_PLACED}) select model_id, hint, count(*) as n_candidates, count(distinct input) = 1 as consensus, min(stage) = 0 as exact, cast(min(stage) as integer) as stage from r where stage = first_stage group by 1, 2")(
    lambda spark, sf: (lambda m, r: pricing.evidence(m, r.withColumn("output", F.lit(None).cast("double"))))(*_part_prices(spark, sf))
)
