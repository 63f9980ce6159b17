"""Queries of profiles, folds, checks and counters, and for each what DuckDB must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import aggregate as agg, counters as ct, graph, merge as mg, profile as pf, validate as vd
from tidemark.plans.catalogue import _CAL, _D, _DAYS, _E, _SI, _SUMS, _U, _by_day, _days, _events, _incoming, _stored, query
from tidemark.session import table
from tidemark.sources.facts import event_facts, warehouse_days

_UNITS = "cast(sum(units) as bigint) as units"
_COST = "cast(sum(cost) as double) as cost"
_KINDS = ("units", "input", "output", "cache_read", "cache_write", "reasoning")
_ALL = ", ".join(f"cast(sum({b}) as bigint) as {b}" for b in _KINDS)

# Profiles
_events("profile_stats", lambda e: pf.stats(e, "user_id"), f"select user_id, {_ALL}, {_COST}, count(*) as submits, min(date) as first_date, max(date) as last_date from e group by 1")
_aliases = lambda e: e.sparkSession.createDataFrame([("m1", "large"), ("m3", "large")], "model_id string, shown string")
_events("profile_days", lambda e: pf.days(e, "user_id", _aliases(e)), f"select user_id, date, client, case when model_id in ('m1', 'm3') then 'large' else model_id end as model_id, {_UNITS}, {_COST}, count(*) as messages, min(timestamp_ms) as timestamp_ms from e group by 1, 2, 3, 4")
_nested = lambda e: pf.nested_days(e.groupBy("user_id", "date", "client", "model_id").agg(F.sum("units").alias("units")), "user_id")
_events("nested_days", lambda e: pf.unnested(_nested(e), "user_id"), f"select user_id, date, client, model_id, {_UNITS} from e group by 1, 2, 3, 4")
_events("day_totals_from_clients", lambda e: pf.day_totals(_nested(e), "user_id"), f"select user_id, date, {_UNITS}, count(distinct client) as n_clients from e group by 1, 2")
_events("model_shares", lambda e: pf.model_shares(e.replace("m0", "<synthetic>", "model_id")), f", g as (select model_id, {_UNITS}, {_COST} from e where model_id <> 'm0' group by 1) select *, round(cost * 100 / sum(cost) over (), 6) as percent, row_number() over (order by cost desc, units desc, model_id) as place from g")
_events("habits", lambda e: pf.habits(_by_day(e)), f", {_DAYS}, w as (select dayofweek(cast(date as date)) as weekday, sum(units) as units from g where units > 0 group by 1) select cast((select weekday from w order by units desc, weekday limit 1) as integer) as best_weekday, round((select max(units) * 100 / sum(units) from w), 6) as percent, (select date from g order by units desc, date limit 1) as biggest_day, (select max(units) from g) as biggest_units")
_days("device_totals_left", lambda d: pf.device_totals(d.sparkSession.range(8).withColumnRenamed("id", "device"), d), f", g as (select device, {_UNITS}, count(distinct case when units > 0 then date end) as active_days, min(date) as first_date, max(date) as last_date from d group by 1) select r.device, coalesce(units, 0) as units, coalesce(active_days, 0) as active_days, first_date, last_date from (select unnest(range(8)) as device) r left join g using (device)")
_KEY = "case user_id % 3 when 0 then 'cloud_alpha_' || md5(session_id) when 1 then 'cloud_beta_' || md5(session_id) else 'laptop_' || session_id end"
_keyed = lambda e: e.withColumn("key", F.concat(F.when(F.col("user_id") % 3 == 0, F.lit("cloud_alpha_")).when(F.col("user_id") % 3 == 1, F.lit("cloud_beta_")).otherwise(F.lit("laptop_")), F.when(F.col("user_id") % 3 == 2, F.col("session_id")).otherwise(F.md5("session_id"))))
_events("cloud_groups", lambda e: pf.cloud_groups(_keyed(e), "key"), f", k as (select *, {_KEY} as key from e) select split_part(key, '_', 2) as provider, {_UNITS}, count(distinct key) as sessions, count(distinct date) as days, max(date) as last_date from k where key like 'cloud\\_%' escape '\\' group by 1")
query("cloud_devices_by_pattern", f"with {_E}, k as (select *, {_KEY} as key from e) select regexp_extract(key, '^cloud_([a-z]+)_([0-9a-f]{{32}})$', 1) as provider, {_UNITS} from k join customer on c_custkey = user_id where regexp_matches(key, '^cloud_([a-z]+)_([0-9a-f]{{32}})$') group by 1")(
    lambda spark, sf: _keyed(event_facts(spark, sf)).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), "user_id").where(F.col("key").rlike("^cloud_([a-z]+)_([0-9a-f]{32})$")).groupBy(F.regexp_extract("key", "^cloud_([a-z]+)_([0-9a-f]{32})$", 1).alias("provider")).agg(F.sum("units").alias("units"))
)
_events("account_days", lambda e: pf.stats(e, "user_id", "date").select("user_id", "date", "units", "cost"), f"select user_id, date, {_UNITS}, {_COST} from e group by 1, 2")
_events("embed_today", lambda e: pf.nested_today(e, "2024-01-10"), f", m as (select client, model_id, {_UNITS}, {_COST} from e where date = '2024-01-10' group by 1, 2), c as (select *, sum(cost) over (partition by client) as cc from m) select client, model_id, units, cost, row_number() over (order by cc desc, client, cost desc, units desc, model_id) as place from c")
_events("submission_rollup", lambda e: pf.submission_rollup(e, "session_id"), f"select session_id, {_UNITS}, {_COST}, min(date) as first_date, max(date) as last_date, count(distinct case when units > 0 then date end) as active_days, count(*) as n, string_agg(distinct client, ',' order by client) as clients, string_agg(distinct model_id, ',' order by model_id) as models from e group by 1")
_days("having_or", lambda d: d.groupBy("user_id", "client").agg(F.sum(F.coalesce(F.nullif("units", F.lit(0)), F.lit(1))).alias("units"), F.max("cost").alias("most")).where("units > 200 or most > 90000").select("user_id", "client", "units"), "select user_id, client, cast(sum(coalesce(nullif(units, 0), 1)) as bigint) as units from d group by 1, 2 having sum(coalesce(nullif(units, 0), 1)) > 200 or max(cost) > 90000")
_events("clients_regrouped", lambda e: agg.intensity(_by_day(e.where("client in ('view', 'click')")), "units"), ", g as (select date, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from e where client in ('view', 'click') group by date) select *, case when units / max(units) over () >= 0.75 then 4 when units / max(units) over () >= 0.5 then 3 when units / max(units) over () >= 0.25 then 2 when units > 0 then 1 else 0 end as intensity from g")
_events("unit_composition", pf.composition, ", s as (select " + ", ".join(f"sum({k}) as {k}" for k in _KINDS[1:]) + ' from e), l as (unpivot s on columns(*) into name part value units) select part, cast(units as bigint) as units, round(units * 100 / sum(units) over (), 6) as percent from l where units > 0')
_fast = lambda e: e.withColumns({"speed": F.when(F.col("event_id") % 3 == 0, "fast").when(F.col("event_id") % 3 == 1, "standard"), "source": F.when(F.col("event_id") % 3 < 2, "reported")})
_events("speed_usage", lambda e: pf.speed_usage(_fast(e), "client"), f"select client, case event_id % 3 when 0 then 'fast' when 1 then 'standard' else 'unknown' end as speed, case when event_id % 3 < 2 then 'reported' else 'none' end as source, {_UNITS}, count(*) as messages from e group by 1, 2, 3")
_events("unpriced_usage", lambda e: pf.unpriced(e.withColumn("price", F.when(F.col("model_id") == "m2", 1.0)), 5), f", g as (select provider_id, model_id, {_UNITS}, count(*) as messages from e where model_id <> 'm2' group by 1, 2), p as (select *, row_number() over (order by units desc, messages desc, provider_id, model_id) as n from g) select provider_id, model_id, units, messages from p where n <= 5 union all select '', 'others', cast(sum(units) as bigint), cast(sum(messages) as bigint) from p where n > 5")
_events(
    "reconciled_parts",
    lambda e: pf.reconciled(e.groupBy("date", "model_id").agg(F.sum("units").alias("v"), F.first((F.dayofmonth(F.col("date").cast("date")) * 1_000).cast("double")).alias("target")), ["date"], "model_id", "v", "target").withColumn("value", F.round("value", 6)),
    """, v as (select date, model_id, cast(sum(units) as double) as v, cast(day(cast(date as date)) * 1000 as double) as target from e group by 1, 2), s as (select *, sum(v) over (partition by date) as every from v),
o as (select *, case when every > target then v * target / every else v end as x from s) select date, model_id, round(x, 6) as value from o union all select date, 'remainder', round(min(target) - min(every), 6) from s where every < target group by date""",
)
_events("inclusive_units", lambda e: e.select("event_id", pf.inclusive(F.col("input") - 20, F.col("output"), F.col("cache_read") - 10).alias("units")), "select event_id, greatest(greatest(input - 20, 0), output + greatest(cache_read - 10, 0)) as units from e")
_CHART = f""", t as (select model_id from e group by 1 order by sum(units) desc, model_id limit 3), s as (select case when model_id in (from t) then model_id else 'other' end as series, date, {_UNITS} from e group by 1, 2),
cal as (select strftime(unnest(generate_series((select min(cast(date as timestamp)) from e), (select max(cast(date as timestamp)) from e), interval 1 day)), '%Y-%m-%d') as date),
f as (select g.series, cal.date, coalesce(units, 0) as units from (select distinct series from s) g cross join cal left join s on s.series = g.series and s.date = cal.date)"""
_events("usage_chart", lambda e: pf.chart(e, 3, 7), f"{_CHART} select *, round(avg(units) over (partition by series order by date rows between 6 preceding and current row), 6) as average from f")
_events("mirrored_chart", lambda e: pf.mirrored(pf.chart(e, 3, 7).select("series", "date", "units"), "series"), f"{_CHART} select *, row_number() over (partition by series order by date desc) - 1 as place from f")
_events("legend_order", lambda e: pf.stack_order(pf.chart(e, 3, 7), 2), f"{_CHART}, n as (select series, {_UNITS} from f group by 1 having sum(units) > 0), p as (select *, row_number() over (order by series = 'other', units desc, series) as place from n) select *, place <= 2 as shown from p")
_events("calendar", lambda e: pf.calendar(_by_day(e), "2024-02-29"), f", {_DAYS}, c as (select cast(unnest(generate_series(timestamp '2023-02-26', timestamp '2024-02-29', interval 1 day)) as date) as d) select strftime(d, '%Y-%m-%d') as date, cast((d - date '2023-02-26') // 7 as integer) as week, cast(dayofweek(d) as integer) as weekday, day(d) = 1 as opens_month, d >= date '2023-02-28' as counts, case when d >= date '2023-02-28' then coalesce(units, 0) else 0 end as units from c left join g on g.date = strftime(d, '%Y-%m-%d')")
_days("range_options", pf.range_options, "select substr(date, 1, 4) as year, min(date) as first_date, max(date) as last_date, substr(date, 1, 4) || '-01-01' as start, substr(date, 1, 4) || '-12-31' as \"end\" from d group by 1")
_days("active_day_counts", lambda d: pf.active_days(d.withColumn("cost", F.when(F.col("client") == "R", 0).otherwise(F.col("cost")))), ", z as (select date, sum(units) as u, sum(case when client = 'R' then 0 else cost end) as c, count(*) as n, max(case when units > 0 then 1 else 0 end) as h from d group by 1) select count(*) filter (u > 0 or c > 0 or n > 0) as any_use, count(*) filter (h > 0) as unit_rows, count(*) filter (c > 0) as cost_days, count(*) filter (u > 0) as unit_days from z")
_events("carried_model", lambda e: pf.carried(e.withColumn("known", F.when(F.col("event_id") % 3 == 0, F.col("model_id"))), "user_id", ["timestamp_ms", "event_id"], "known").select("event_id", "known_carried"), ", k as (select *, case when event_id % 3 = 0 then model_id end as known from e) select event_id, last_value(known ignore nulls) over (partition by user_id order by timestamp_ms, event_id rows unbounded preceding) as known_carried from k")
_events("end_anchored", lambda e: pf.end_anchored(e).select("event_id", "start_ms"), "select event_id, greatest(timestamp_ms - greatest(duration_ms, 0), 0) as start_ms from e")
_events("latest_row", lambda e: pf.latest(e, "user_id", "timestamp_ms", ["event_id", "client"]), ", r as (select *, row_number() over (partition by user_id order by timestamp_ms desc, event_id desc) as n from e) select user_id, event_id, client from r where n = 1")
_days("nulls_last_order", lambda d: (lambda g: g.withColumn("place", F.row_number().over(pf.Window.partitionBy("client").orderBy(F.desc_nulls_last("most"), "model_id"))))(d.groupBy("client", "model_id").agg(F.max(F.when(F.col("client") != "N", F.col("units"))).alias("most"))), ", g as (select client, model_id, max(case when client <> 'N' then units end) as most from d group by 1, 2) select *, row_number() over (partition by client order by most desc nulls last, model_id) as place from g")
_days("duplicate_counts", lambda d: d.select("user_id", "date", "client", "device", F.count("*").over(pf.Window.partitionBy("user_id", "date")).alias("n")), "select user_id, date, client, device, count(*) over (partition by user_id, date) as n from d")
query("import_rollup", f"with {_D}, g as (select date, client, model_id, {_UNITS}, {_COST}, count(*) as messages from d group by 1, 2, 3) select *, sum(units) over (partition by date)::bigint as day_units from g")(lambda spark, sf: warehouse_days(spark, sf).groupBy("date", "client", "model_id").agg(*agg.measures()).withColumn("day_units", F.sum("units").over(pf.Window.partitionBy("date"))))
query("json_keys_unnested", "with k as (select event_type, unnest(json_keys(props)) as key, props from events) select event_type, key, count(*) as n, cast(sum(cast(json_extract(props, '$.' || key) as bigint)) as bigint) as total from k group by 1, 2")(lambda spark, sf: table(spark, sf, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v")).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("v").alias("total")))
query("totals_updated", f"with {_U}, t as (select user_id, {_UNITS}, count(*) as n from d where client = 'R' group by 1) select c_custkey as user_id, coalesce(u.units, 0) as units, coalesce(t.units, 0) as returned, coalesce(t.n, 0) as n from customer left join u on u.user_id = c_custkey left join t on t.user_id = c_custkey")(
    lambda spark, sf: (lambda d: table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(d.groupBy("user_id").agg(F.sum("units").alias("units"), F.sum(F.when(F.col("client") == "R", F.col("units"))).alias("returned"), F.count(F.when(F.col("client") == "R", 1)).alias("n")), "user_id", "left").na.fill(0, ["units", "returned", "n"]))(warehouse_days(spark, sf))
)

# Merges
_files = lambda e: e.select("event_id", F.concat_ws(":", "user_id", "model_id").alias("key"), "input", "duration_ms", (F.col("event_id") % 5 == 0).alias("turn"), F.when(F.col("event_id") % 4 == 1, F.col("client")).alias("title"), "cost", F.when(F.col("event_id") % 6 == 0, "reported").otherwise("priced").alias("cost_source"))
_events("complete_messages", lambda e: mg.complete(_files(e), "key", ["input", "duration_ms"], ["turn"], ["title"], "event_id", "reported").withColumn("cost", F.col("cost").cast("double")), ", k as (select *, user_id || ':' || model_id as key from e) select key, max(input) as input, max(duration_ms) as duration_ms, bool_or(event_id % 5 = 0) as turn, arg_min(client, event_id) filter (event_id % 4 = 1) as title, cast(coalesce(arg_min(cost, event_id) filter (event_id % 6 = 0), arg_min(cost, event_id)) as double) as cost from k group by 1")
_events("incoming_fold", lambda e: mg.incoming_fold(e.withColumns({"schema": F.col("event_id") % 4, "n_models": F.col("input")}), ["date", "client"]), f"select date, client, {_UNITS}, {_COST}, min(event_id % 4) as schema, max(input) as n_models, string_agg(distinct model_id, ',' order by model_id) as models from e group by 1, 2")
_events("folded_aliases", lambda e: mg.folded_aliases(e, {"view": "click"}, ["date", "client"]), f"select date, case client when 'view' then 'click' else client end as client, {_UNITS}, {_COST} from e group by 1, 2")
_months = lambda d: d.withColumn("date", F.substring("date", 1, 7)).select("user_id", "device", "date", "client", "units")
_MONTHS = ", w as (select user_id, device, substr(date, 1, 7) as date, client, units from d)"
_days("twin_reclaim", lambda d: mg.reclaimed(_months(d), 2, 10), f"{_MONTHS} select * from w where device = 2 or not exists (select 1 from w o where o.device = 2 and o.units >= 10 and o.user_id = w.user_id and o.date = w.date and o.client = w.client and o.units = w.units)")
_days("legacy_adoption", lambda d: mg.adopted(_months(d).withColumn("device", F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("device"))), 0, 9), f"{_MONTHS}, v as (select user_id, case when user_id % 2 = 0 then 0 else device end as device, date, client, units from w) select user_id, case when device = 0 and not exists (select 1 from v o where o.user_id = v.user_id and o.device <> 0) then 9 else device end as device, date, client, units from v")
_events("duplicate_row_merge", lambda e: mg.unduplicated(e.withColumn("active_ms", F.col("duration_ms")), ["user_id", "date"]), ", c as (select user_id, date, client, max(units) as units, min(timestamp_ms) as t, max(duration_ms) as a from e group by 1, 2, 3) select user_id, date, cast(sum(units) as bigint) as units, count(*) as clients, min(t) as timestamp_ms, max(a) as active_ms from c group by 1, 2")
_side = lambda e, low: e.where("event_id % 3 <> 0" if low else "event_id % 2 = 0 or event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % (7 if low else 4) > 0, F.concat(F.lit("a" if low else "b"), F.col("client"))).alias("title"), (F.col("units") * (1 if low else 2)).alias("units"))
_events("wiki_upsert", lambda e: mg.upserted(_side(e, True), _side(e, False), "event_id", ["title"], ["units"]), ", s as (select event_id, case when event_id % 7 > 0 then 'a' || client end as title, units from e where event_id % 3 <> 0), i as (select event_id, case when event_id % 4 > 0 then 'b' || client end as title, units * 2 as units from e where event_id % 2 = 0 or event_id % 3 = 0) select coalesce(i.event_id, s.event_id) as event_id, coalesce(i.title, s.title) as title, case when i.event_id is not null then i.units else s.units end as units from s full join i on s.event_id = i.event_id")
_snapshots = lambda e: e.where("event_id % 3 <> 0").select("event_id", "session_id", F.col("input").alias("call"))
_executions = lambda e: e.where("event_id % 3 = 0").select(F.when(F.col("event_id") % 90 == 0, F.col("session_id")).alias("session_id"), F.when(F.col("input") % 5 == 0, F.col("input")).alias("call"))
_events("covered_snapshots", lambda e: mg.uncovered(_snapshots(e), _executions(e), ["session_id", "call"]), ", x as (select case when event_id % 90 = 0 then session_id end as session_id, case when input % 5 = 0 then input end as call from e where event_id % 3 = 0) select event_id, session_id, input as call from e where event_id % 3 <> 0 and not exists (select 1 from x where x.session_id = e.session_id) and not exists (select 1 from x where x.call = e.input)")
query("in_and_not_in", f"with {_SI} select s.* from s where (user_id, date) in (select (user_id, date) from i) and client not in (select client from i where revision = 3 and units > 100)")(
    lambda spark, sf: (lambda i: _stored(warehouse_days(spark, sf)).join(i.select("user_id", "date"), ["user_id", "date"], "left_semi").join(i.where("revision = 3 and units > 100").select("client").distinct(), "client", "left_anti"))(_incoming(warehouse_days(spark, sf)))
)

# Shared aliases and growing counters
_records = lambda e: e.select("event_id", F.array(F.concat(F.lit("a"), F.floor(F.col("event_id") / 3)), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("b"), F.floor(F.col("event_id") / 7)))).alias("aliases"), F.when(F.col("event_id") % 5 < 2, F.concat(F.lit("r"), F.floor(F.col("event_id") / 40))).alias("request"), "units")
_events(
    "component_dedup",
    lambda e: graph.merged_records(_records(e), "event_id", "aliases", "request", ["units"]).drop("call"),
    """, al as (select event_id, 'a' || (event_id // 3) as alias from e union all select event_id, 'b' || (event_id // 7) from e where event_id % 4 = 0),
ed as (select distinct x.event_id as a, y.event_id as b from al x join al y using (alias)), reach as materialized (with recursive w as (select distinct a as node, a as near from ed union select w.node, ed.b from w join ed on ed.a = w.near where abs(ed.b - w.node) < 400) select node, min(near) as root from w group by 1),
r as (select e.event_id, root, units, case when event_id % 5 < 2 then 'r' || (event_id // 40) end as request from e join reach on node = event_id), n as (select root, count(distinct request) as ids from r group by 1)
select root, max(units) as units, count(*) as records from r join n using (root) group by root, case when ids > 1 then coalesce('r' || request, 'k' || event_id) else '' end""",
)
_T = "sum(units) over (partition by user_id order by event_id)"


def _reports(e: DataFrame) -> DataFrame:
    """Totals that mostly grow; some repeat, fall back or are absent."""
    upto = pf.Window.partitionBy("user_id").orderBy("event_id")
    t = F.sum("units").over(upto)
    told = e.withColumn("t", t).withColumn("total", F.when(F.col("event_id") % 7 == 0, F.coalesce(F.lag("t").over(upto), F.col("t"))).when(F.col("event_id") % 11 == 0, F.col("t") - 2 * F.col("units")).when(F.col("event_id") % 97 == 0, F.col("units")).otherwise(F.col("t")))
    parts = {"input": 1, "output": 2, "cached": 3, "reasoning": 5}
    gone_total, gone_last = F.col("event_id") % 17 == 0, F.col("event_id") % 13 == 0
    return told.select("user_id", "event_id", *[F.when(~gone_total, F.floor(F.col("total") / d)).alias(f"total_{p}") for p, d in parts.items()], *[F.when(~gone_last, F.floor(F.col("units") / d)).alias(f"last_{p}") for p, d in parts.items()])


_GROWN = "(p is not null and tot is not null and tot[1] >= p[1] and tot[2] >= p[2] and tot[3] >= p[3] and tot[4] >= p[4])"
_LATE = "(list_sum(p) > 0 and list_sum(tot) > 0 and list_sum(las) > 0 and (list_sum(tot) * 100 >= list_sum(p) * 98 or list_sum(tot) + 2 * list_sum(las) >= list_sum(p)))"
_PARTS = "greatest(x[1] - greatest(least(x[3], x[1]), 0), 0) as input, greatest(x[2], 0) - least(greatest(x[4], 0), greatest(x[2], 0)) as output, greatest(least(x[3], x[1]), 0) as cache_read, least(greatest(x[4], 0), greatest(x[2], 0)) as reasoning"
_WALK = f"""with recursive {_E}, b0 as (select *, sum(units) over (partition by user_id order by event_id) as t from e),
b as (select user_id, event_id, units, greatest(case when event_id % 7 = 0 then coalesce(lag(t) over (partition by user_id order by event_id), t) when event_id % 11 = 0 then t - 2 * units when event_id % 97 = 0 then units else t end, 0) as total, row_number() over (partition by user_id order by event_id) as n from b0),
r as (select user_id, event_id, n, case when event_id % 17 <> 0 then [total::bigint, total::bigint // 2, total::bigint // 3, total::bigint // 5] end as tot, case when event_id % 13 <> 0 then [units::bigint, units::bigint // 2, units::bigint // 3, units::bigint // 5] end as las from b),
f as (select user_id, 0::bigint as n, null::bigint as event_id, null::bigint[] as p, null::bigint[] as x from (select distinct user_id from r)
 union all select user_id, n, event_id, case when code = 'skip' or code <> 'rebase' and not used then p when code = 'last' then coalesce(tot, case when p is not null then [p[1] + las[1], p[2] + las[2], p[3] + las[3], p[4] + las[4]] end) else tot end, case when used then x end
 from (select *, coalesce(greatest(x[1], x[2], x[3], x[4]) > 0 and (greatest(x[1] - least(x[3], x[1]), 0) > 0 or x[2] > 0 or least(x[3], x[1]) > 0), false) as used
 from (select *, case code when 'last' then las when 'total' then tot when 'delta' then [tot[1] - p[1], tot[2] - p[2], tot[3] - p[3], tot[4] - p[4]] end as x
 from (select r.*, f.p, case when tot is null and las is null then 'skip' when tot is not null and p is not null and tot = p then 'skip' when las is not null and tot is not null and p is not null and not {_GROWN} and {_LATE} then 'skip'
 when las is not null then 'last' when p is null then 'total' when {_GROWN} then 'delta' else 'rebase' end as code from f join r on r.user_id = f.user_id and r.n = f.n + 1))))
select user_id, event_id, {_PARTS} from f where x is not null"""
query("counter_deltas", _WALK)(lambda spark, sf: ct.deltas(_reports(event_facts(spark, sf)), "user_id", "event_id"))
_events("bucket_split", lambda e: e.select("event_id", *[c.alias(n) for n, c in ct.split_columns(F.col("input"), F.col("output"), F.col("cache_read"), F.col("reasoning")).items()]), "select event_id, greatest(input - greatest(least(cache_read, input), 0), 0) as input, greatest(output, 0) - least(greatest(reasoning, 0), greatest(output, 0)) as output, greatest(least(cache_read, input), 0) as cache_read, least(greatest(reasoning, 0), greatest(output, 0)) as reasoning from e")
_events("fork_replays", lambda e: ct.without_replays(e.select("session_id", F.when(F.col("user_id") % 3 > 0, F.floor(F.col("user_id") / 3).cast("string")).alias("parent"), "event_id", "input", "output"), "session_id", "parent", "event_id", ["input", "output"]), ", f as (select *, coalesce(case when user_id % 3 > 0 then cast(user_id // 3 as varchar) end, session_id) as family from e), p as (select *, row_number() over (partition by family, input, output order by session_id, event_id) as n from f) select session_id, event_id, input, output from p where n = 1")

# Checks
_told = lambda d: d.groupBy("user_id").agg((F.sum("units") + F.when(F.col("user_id") % 10 == 0, 150).when(F.col("user_id") % 10 == 1, 90).otherwise(0)).alias("units"), F.sum("cost").cast("double").alias("cost"))
_days("wrong_totals", lambda d: vd.wrong_totals(_told(d), d, ["user_id"]), ", s as (select user_id, cast(sum(units) as bigint) as n from d group by 1), t as (select user_id, n + case user_id % 10 when 0 then 150 when 1 then 90 else 0 end as units, n as sum_units from s) select * from t where abs(units - sum_units) > 0.01 * sum_units and abs(units - sum_units) > 100")
_events("row_rules", lambda e: vd.broken(e.withColumn("units", F.when(F.col("event_id") % 50 == 0, -1).otherwise(F.col("units"))), ["event_id"], vd.field_rules(["view", "click", "purchase", "signup"])), ", b as (select event_id, concat_ws(',', case when client = 'error' then 'client' end, case when event_id % 50 = 0 then 'units' end) as broken from e) select * from b where broken <> ''")
_events("future_days", lambda e: vd.future(e, "2024-01-20", ["event_id"]), "select event_id, date from e where cast(date as date) > date '2024-01-22'")
_events("free_cost_rows", lambda e: vd.free_cost(e.withColumn("units", F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("units"))), F.col("client") == "view").select("event_id", "client"), "select event_id, client from e where cost > 0.000001 and (event_id % 4 = 0 or units <= 0) and client <> 'view'")
_events("day_faults", lambda e: vd.day_faults(e.select("session_id", "date", "units"), "session_id"), ", g as (select session_id, date, count(*) as n, sum(units) as u from e group by 1, 2) select session_id, count(*) filter (n > 1) as repeated, count(*) filter (u > 0) as active_days, min(date) as first_date, max(date) as last_date from g group by 1")
_events("revision_faults", lambda e: vd.revision_faults(e.withColumns({"revision": F.when(F.col("user_id") % 5 == 0, F.col("event_id") % 2 + 1).otherwise(F.col("user_id") % 3), "has_manifest": F.col("user_id") % 2 == 0}), "session_id"), ", v as (select session_id, client, case when user_id % 5 = 0 then event_id % 2 + 1 else user_id % 3 end as revision, user_id % 2 = 0 as m from e), g as (select session_id, client, count(distinct revision) as revisions, max(revision) as revision, bool_or(m) as m from v group by 1, 2) select session_id, client, revisions, revision from g where revisions > 1 or revision > 1 and not m")
_events("bad_coverage", lambda e: vd.bad_coverage(e.select("event_id", F.when(F.col("event_id") % 90 == 0, "2024-02-31").otherwise(F.col("date")).alias("start"), F.lit("2024-01-15").alias("end"))), ", c as (select event_id, case when event_id % 90 = 0 then '2024-02-31' else date end as start, '2024-01-15' as \"end\" from e) select * from c where try_cast(start as date) is null or start > \"end\"")
_events("foreign_clients", lambda e: vd.foreign_clients(e, F.when(F.col("user_id") % 3 == 0, "view")).select("event_id", "client"), "select event_id, client from e where user_id % 3 = 0 and client <> 'view'")
_events("archive_faults", lambda e: vd.archive_faults(e.select("user_id", "date", F.col("input").alias("clients")), "user_id", "2024-01-30", 28, 90), ", g as (select user_id, date, count(*) as n, max(input) as c from e group by 1, 2), s as (select user_id, count(*) filter (try_cast(date as date) is null) as unreal, count(*) filter (n > 1) as repeated, count(*) filter (date >= '2024-01-30') as late, count(*) as days, max(c) as clients from g group by 1) select * from s where unreal > 0 or repeated > 0 or late > 0 or days > 28 or clients > 90")
