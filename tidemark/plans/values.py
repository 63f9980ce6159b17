"""Queries of names, formats and filters, and for each what DuckDB must return."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import formats as fm, names as nm
from tidemark.operators import filters as fl, merge as mg, ranking as rk
from tidemark.plans.catalogue import _D, _E, _U, _days, _events, query
from tidemark.session import table
from tidemark.sources.facts import event_facts, warehouse_days

MODELS = ["GATEWAY-A/GPT-5.4-20261001(HIGH)", "gateway-b/anthropic/claude-4-6-opus", "Qwen/Qwen3", "gateway-a-other/gpt-5.4", "gateway-a/team/gpt-5.4", "gateway-a/gateway-b/gpt-5.4", "hf:deepseek-ai/DeepSeek-V3-0324", "accounts/fireworks/models/kimi-k2", "gateway-a/", "glm-4.6", "ollama/llama3", " Claude-3-7-Sonnet-20250219 "]
PROVIDERS = ["x-ai", "Vertex_AI", "openai-codex/", "<synthetic>", "unknown", "gpt-4", "deepseek-ai", "alibaba-cn", "", "glhf", "AI21"]
AGENTS = ["Astrape:code-reviewer", "plan  mode", "omo-planner", "sisyphus", "Orchestrator-Sisyphus", "api ui-tester", "  explore ", "oh-my-codex:UX-lead"]
PATHS = ["C:\\work\\repo\\", "/home/u//repo/.worktrees/feature", "/srv/app/worktrees/x/y", "", "/", "notes"]
TASKS = ["Feat", "BUG", "code review", "setup", "other things", "Refactoring"]
SPEEDS = ["standard", "fast", "priority", "ultrafast", "auto"]


def _pick(values: list[str], by: str = "event_id") -> Column:
    """One of the values, by a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _picked(values: list[str], by: str = "event_id") -> str:
    """The same in SQL."""
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{by} % {len(values)} + 1]"


_FAMILIES = " ".join(f"when regexp_matches(n, '{f}') then '{v}'" for f, v in nm.VENDORS)
_VENDOR = "case {n} end".format(n=_FAMILIES)
_CANONICAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^(?:gateway-a/team/|gateway-a/|gateway-b/)(.+)$', '\1'), '\([^()]*\)$', ''), '-[0-9]{8}$', ''), '^anthropic/(claude-.+)$', '\1'),
 '^claude-([0-9]+)-([0-9]+)-(opus|sonnet|haiku)$', 'claude-\3-\1-\2')"""
_events(
    "model_names",
    lambda e: e.select("event_id", _pick(MODELS).alias("raw")).select("event_id", nm.canonical_model(F.col("raw"), ["gateway-a/", "Gateway-B/", "gateway-a/team/"]).alias("model"), nm.alias_key(F.col("raw")).alias("alias"), nm.gateway_model(F.col("raw")).alias("bare"), nm.inferred_provider(F.col("raw")).alias("vendor")),
    rf""", m as (select event_id, {_picked(MODELS)} as raw from e), v as (select *, regexp_replace(lower(raw), '^(ollama/)+', '') as n from m)
select event_id, {_CANONICAL} as model, replace(lower(trim(raw)), '.', '-') as alias, regexp_replace(regexp_replace(lower(raw), '^hf:(?:[^/]*/)?(.*)$', '\1'), '^accounts/.*?/models/(.*)$', '\1') as bare, {_VENDOR} as vendor from v""",
)
_PROVIDER = f"case when c in ('', 'unknown') or regexp_matches(c, '^<.*>$') then null when c = 'ai21' then c when {nm.case_sql('c', nm.PROVIDERS)} is not null then {nm.case_sql('c', nm.PROVIDERS)} when regexp_matches(c, '[0-9]') then null else c end"
_events(
    "provider_names",
    lambda e: e.select("event_id", _pick(PROVIDERS).alias("p"), _pick(MODELS).alias("m")).select("event_id", nm.canonical_provider(F.col("p")).alias("provider"), nm.resolved_provider(F.col("p"), F.col("m")).alias("resolved")),
    f""", p as (select event_id, {_picked(PROVIDERS)} as p, {_picked(MODELS)} as m from e), q as (select *, replace(regexp_replace(lower(trim(p)), '/+$', ''), '-', '_') as c, regexp_replace(lower(m), '^(ollama/)+', '') as n from p)
select event_id, {_PROVIDER} as provider, coalesce({_PROVIDER}, {_VENDOR}, 'unknown') as resolved from q""",
)
_TITLE = r"list_aggregate(list_transform(list_filter(regexp_split_to_array(n, '[-\s]+'), lambda w: w <> ''), lambda w: case when lower(w) in ('ui', 'ux', 'api') then upper(w) else upper(w[1]) || w[2:] end), 'string_agg', ' ')"
_events(
    "agent_names",
    lambda e: e.select("event_id", nm.agent_name(_pick(AGENTS)).alias("agent")),
    rf""", a as (select event_id, trim(regexp_replace(regexp_replace(trim({_picked(AGENTS)}), '^(?i)(astrape:|oh-my-claudecode:|oh-my-codex:)', ''), '\s+', ' ', 'g')) as n from e)
select event_id, case when contains(lower(n), 'plan') and (contains(lower(n), 'omo') or contains(lower(n), 'sisyphus')) then 'Planner-Sisyphus' when contains(lower(n), 'plan') then {_TITLE} when lower(n) in ('omo', 'sisyphus') then 'Sisyphus' when lower(n) = 'orchestrator-sisyphus' then 'Atlas' else {_TITLE} end as agent from a""",
)
_events(
    "workspaces",
    lambda e: e.select("event_id", _pick(PATHS).alias("p")).select("event_id", nm.workspace_key(F.col("p")).alias("key"), nm.workspace_label(F.col("p")).alias("label")),
    rf""", p as (select event_id, nullif(regexp_replace(regexp_replace(regexp_replace(replace(trim({_picked(PATHS)}), '\', '/'), '/+', '/', 'g'), '(.)/$', '\1'), '/\.?worktrees/.*$', ''), '') as key from e) select event_id, key, split_part(key, '/', -1) as label from p""",
)
_events(
    "speeds_and_tasks",
    lambda e: e.select("event_id", nm.speed("claude", _pick(SPEEDS)).alias("claude"), nm.speed("codex", _pick(SPEEDS)).alias("codex"), nm.task_category(_pick(TASKS)).alias("task")),
    f", s as (select event_id, {_picked(SPEEDS)} as s, lower({_picked(TASKS)}) as t from e) select event_id, {nm.case_sql('s', nm.SPEEDS['claude'])} as claude, {nm.case_sql('s', nm.SPEEDS['codex'])} as codex, {nm.case_sql('t', nm.TASKS, chr(39) + 'other' + chr(39))} as task from s",
)
_events(
    "alias_join",
    lambda e: e.join(F.broadcast(e.sparkSession.createDataFrame([("m1", "large"), ("m3", "small"), ("large", "never")], "model_id string, shown string")), "model_id", "left").groupBy(F.coalesce("shown", "model_id").alias("model")).agg(F.sum("units").alias("units")),
    "select case model_id when 'm1' then 'large' when 'm3' then 'small' else model_id end as model, cast(sum(units) as bigint) as units from e group by 1",
)

# Formats
_NUM = "case when n >= {u} * 999.95::double then printf('%.1f', round(n / ({u} * 1000::double), 1)) || '{up}' else printf('%.1f', round(n / {u}::double, 1)) || '{name}' end"
query(
    "compact_numbers",
    f"with {_U}, n as (select user_id, units * units * (user_id % 7) as n, cost * (user_id % 9) as c from u) select user_id, case when n >= 1000000000000 then regexp_replace(printf('%.3f', round(n / 1e12, 3)), '\\.?0+$', '') || 'T' when n >= 1000000000 then {_NUM.format(u='1000000000', up='T', name='B')} when n >= 1000000 then {_NUM.format(u='1000000', up='B', name='M')} when n >= 1000 then {_NUM.format(u='1000', up='M', name='K')} else cast(n as varchar) end as units, n as n from n",
)(lambda spark, sf: rk.totals(warehouse_days(spark, sf)).select("user_id", (F.col("units") * F.col("units") * (F.col("user_id") % 7)).alias("n")).select("user_id", fm.compact(F.col("n")).alias("units"), "n"))
_MS = "(event_id * 7919) % 90000000"
_TOTAL = f"({_MS}) // 1000"
_events(
    "durations",
    lambda e: e.select("event_id", fm.duration((F.col("event_id") * 7919) % 90_000_000).alias("took"), fm.relative(F.col("timestamp_ms"), F.lit(1_706_800_000_000)).alias("ago"), fm.stale(F.col("timestamp_ms"), F.lit(1_706_800_000_000), 14).alias("stale"), fm.percent(F.col("units") / 40).alias("share")),
    f""", t as (select *, {_TOTAL} // 3600 as h, ({_TOTAL} % 3600) // 60 as m, {_TOTAL} % 60 as s, {_MS} as ms, (1706800000000 - timestamp_ms) // 60000 as ago from e)
select event_id, case when ms <= 0 then '—' when h > 0 then case when m > 0 then h || 'h ' || m || 'm' else h || 'h' end when m > 0 then case when s > 0 and m < 10 then m || 'm ' || s || 's' else m || 'm' end when s > 0 then s || 's' else '<1s' end as took,
 case when ago < 1 then 'just now' when ago < 60 then ago || 'm ago' when ago < 1440 then (ago // 60) || 'h ago' when ago < 43200 then (ago // 1440) || 'd ago' when ago < 525600 then (ago // 43200) || 'mo ago' else (ago // 525600) || 'y ago' end as ago,
 1706800000000 - timestamp_ms > 14 * 86400000 as stale, case when units > 0 and units / 40 < 0.05 then '<0.1%' else printf('%.1f', round(units / 40, 1)) || '%' end as share from t""",
)
query("masked_names", "select c_custkey, case when length(t) <= 4 then t[1] || '***' else t[1:2] || '****' || right(t, 2) end as name, sha256(c_name) as hash, ceil(length(c_name) / 4)::bigint as size, split_part(c_name, '#', 2) as part, c_name like '%#0000001__' as hundred, coalesce(c_custkey % 4 >= 2, false) as verified from (select *, substr(c_name, 1, (c_custkey % 19)::int + 1) as t from customer)")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", fm.masked(F.substring("c_name", F.lit(1), (F.col("c_custkey") % 19 + 1).cast("int"))).alias("name"), F.sha2("c_name", 256).alias("hash"), fm.estimated_units(F.col("c_name")).alias("size"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"), F.col("c_name").like("%#0000001__").alias("hundred"), fm.verified(F.sequence(F.lit(1), F.col("c_custkey") % 4 + 1).cast("array<long>"), 3).alias("verified"))
)
_events(
    "rebucketed_days",
    lambda e: e.select(fm.rebucketed(F.when(F.col("event_id") % 5 > 0, F.col("timestamp_ms")).otherwise(0), F.col("date"), "Asia/Tokyo").alias("date"), "units").groupBy("date").agg(F.sum("units").alias("units")),
    ", r as (select case when event_id % 5 > 0 then strftime(make_timestamp((timestamp_ms + 32400000) * 1000), '%Y-%m-%d') else date end as date, units from e) select date, cast(sum(units) as bigint) as units from r group by 1",
)
_events("lenient_numbers", lambda e: e.select("event_id", fm.lenient_long(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" -"), F.col("event_id").cast("string"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))).alias("n")), "select event_id, case event_id % 3 when 0 then event_id when 1 then -event_id end as n from e")
_events("week_grid", lambda e: e.groupBy(*[c.alias(n) for c, n in zip(fm.week_place(F.col("date").cast("date"), F.lit("2024-01-01").cast("date")), ("week", "weekday"))]).agg(F.sum("units").alias("units")), "select cast((cast(date as date) - date '2023-12-31') // 7 as integer) as week, cast((cast(date as date) - date '2023-12-31') % 7 as integer) as weekday, cast(sum(units) as bigint) as units from e group by 1, 2")

# Filters
TODAY = dt.date(2024, 1, 25)
_sum = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("units").alias("units"), F.count("*").alias("n"))
_SUM = "cast(sum(units) as bigint) as units, count(*) as n"
_events("client_filter", lambda e: _sum(fl.by_clients(e, fl.client_list(["view", "nothing", "View"], ["purchase"], ["click"], ["click", "purchase", "view"])), "client"), f"select client, {_SUM} from e where client in ('purchase', 'view') group by 1")
_events(
    "gateway_filter",
    lambda e: _sum(fl.by_clients(e.withColumns({"model_id": _pick(MODELS), "provider_id": _pick(PROVIDERS, "user_id")}), ["synthetic"], True), "client", "model_id"),
    f", g as (select client, {_picked(MODELS)} as model_id, {_picked(PROVIDERS, 'user_id')} as provider_id, units from e) select client, model_id, {_SUM} from g where regexp_matches(lower(model_id), '^(hf:|accounts/fireworks/|accounts/together/)') or lower(provider_id) in ('synthetic', 'glhf', 'synthetic.new', 'octofriend') group by 1, 2",
)


def _all_periods(e: DataFrame) -> DataFrame:
    found = None
    for name in ("all", "today", "yesterday", "week", "month", "last-month"):
        part = _sum(fl.within(e, fl.period(name, TODAY))).withColumn("period", F.lit(name))
        found = part if found is None else found.unionByName(part)
    for name in ("week", "month", "year"):
        found = found.unionByName(_sum(fl.within(e, fl.profile_range(name, TODAY))).withColumn("period", F.lit(f"profile {name}")))
    return found


_RANGES = {"all": ("0000", "9999"), "today": ("2024-01-25", "2024-01-25"), "yesterday": ("2024-01-24", "2024-01-24"), "week": ("2024-01-19", "2024-01-25"), "month": ("2024-01-01", "2024-01-25"), "last-month": ("2023-12-01", "2023-12-31"), "profile week": ("2024-01-19", "2024-01-25"), "profile month": ("2023-12-27", "2024-01-25"), "profile year": ("2023-01-25", "2024-01-25")}
_events("periods", _all_periods, "".join(f"{' union all ' if k else ''} select cast(sum(units) as bigint) as units, count(*) as n, '{name}' as period from e where date between '{a}' and '{b}'" for k, (name, (a, b)) in enumerate(_RANGES.items())))
_days("year_filter", lambda d: _sum(fl.of_year(d, 1995), "client"), f"select client, {_SUM} from d where date like '1995-%' group by 1")
_PUBLIC = "c_custkey % 11 <> 0 and not c_custkey % 7 = 0"
_users = lambda spark, sf: table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("User")).otherwise(F.lit("user")), (F.col("c_custkey") % 99).cast("string")).alias("username"), F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") % 5).alias("banned_at"), (F.col("c_custkey") % 7 == 0).alias("is_private"))
query("public_ranking", f"with {_U} select u.*, rank() over (order by units desc) as rank from u join customer on c_custkey = user_id where {_PUBLIC}")(lambda spark, sf: rk.competition_rank(rk.totals(warehouse_days(spark, sf)).join(fl.public(_users(spark, sf)).select("user_id"), "user_id")))
query("rank_of_one_user", f"with {_U}, r as (select *, rank() over (order by units desc) as rank, count(*) over () as users from u) select user_id, units, rank, users from r where user_id = 77")(lambda spark, sf: (lambda u: rk.competition_rank(u).where("user_id = 77").select("user_id", "units", "rank").join(u.agg(F.count("*").alias("users"))))(rk.totals(warehouse_days(spark, sf))))
query("ambiguous_names", "select 'user' || (c_custkey % 99) as name, count(*) as users from customer group by 1 having count(*) > 1")(lambda spark, sf: fl.ambiguous_names(_users(spark, sf)))
query("ban_list", f"with {_U} select c_custkey as user_id, c_custkey % 5 as banned_at, units, cost from customer left join u on c_custkey = user_id where c_custkey % 11 = 0")(lambda spark, sf: fl.banned(_users(spark, sf), rk.totals(warehouse_days(spark, sf))).select("user_id", "banned_at", "units", "cost"))
_free = lambda e: e.withColumn("units", F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("units")))
_events("tokenless_cost", lambda e: fl.without_free_cost(_free(e), F.col("client") == "view").groupBy("date").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"), F.count("*").alias("n")), ", z as (select date, client, case when event_id % 4 = 0 then 0 else units end as units, cost from e) select date, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost, count(*) as n from z where not (cost > 0 and units <= 0) or client = 'view' group by 1")
_events("log_entries", lambda e: fl.log_entries(e.withColumn("workspace", F.concat(F.lit("w"), F.col("user_id") % 9)), 1_704_500_000_000, 1_706_000_000_000, None, "view").select("event_id", "workspace", "timestamp_ms"), "select event_id, 'w' || (user_id % 9) as workspace, timestamp_ms from e where timestamp_ms >= 1704500000000 and timestamp_ms < 1706000000000 and client = 'view'")
_events("scoped_keys", lambda e: e.select("event_id", mg.scoped_key(F.concat(F.col("client"), F.when(F.col("event_id") % 2 == 0, F.lit(":tool_result:")).otherwise(F.lit(":")), F.col("model_id")), F.col("session_id")).alias("key")).groupBy("key").agg(F.count("*").alias("n")), ", k as (select case when event_id % 2 = 0 then session_id || '#' || client || ':tool_result:' || model_id else client || ':' || model_id end as key from e) select key, count(*) as n from k group by 1")
