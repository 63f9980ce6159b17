"""The reports over the tables of the tests, and for each what DuckDB must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import aggregate as agg, intervals as iv, merge as mg, pricing, ranking as rk, series as sr, trees
from tidemark.session import table
from tidemark.sources import logs
from tidemark.sources.facts import event_facts, warehouse_days

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_E = """e0 as (select *, cast(json_extract(props, '$.k') as bigint) as k from events),
e as (select event_id, user_id, event_type as client, 'm' || (k % 7) as model_id, 'p' || (k % 3) as provider_id, cast(user_id as varchar) as session_id,
 epoch_us(ts) // 1000 as timestamp_ms, strftime(ts, '%Y-%m-%d') as date, k as input, k % 50 as output, k * 3 % 40 as cache_read, k % 4 as cache_write, k % 5 as reasoning,
 cast(value as decimal(18,4)) as cost, k * 1000 as duration_ms, k + k % 50 + k * 3 % 40 + k % 4 + k % 5 as units from e0)"""
_D = """d as (select o_custkey as user_id, l_suppkey % 5 as device, strftime(l_shipdate, '%Y-%m-%d') as date, l_returnflag as client, l_linestatus as model_id,
 cast(l_quantity as bigint) as units, cast(cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(5,2))) as decimal(18,4)) as cost
 from lineitem join orders on l_orderkey = o_orderkey)"""
_SUMS = "cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost, count(*) as messages"
_BUCKETS = ", ".join(f"cast(sum({b}) as bigint) as {b}" for b in ("input", "output", "cache_read", "cache_write", "reasoning"))
_I = f"""{_E}, sp as (select client, session_id, timestamp_ms as s, timestamp_ms + greatest(duration_ms, 0) as t, units, cost from e where timestamp_ms > 0),
mk as (select *, case when s > max(t) over (partition by client, session_id order by s, t rows between unbounded preceding and 1 preceding) + 180000 then 1 else 0 end as new from sp),
bl as (select *, sum(new) over (partition by client, session_id order by s, t rows unbounded preceding) as b from mk),
iv as (select client, session_id, min(s) as s, max(t) as t, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost, count(*) as messages from bl group by client, session_id, b)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _events(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, f"with {_E} {sql}")(lambda spark, sf: f(event_facts(spark, sf)))


def _days(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, f"with {_D} {sql}")(lambda spark, sf: f(warehouse_days(spark, sf)))


# Reports
_events("daily_rollup", lambda e: agg.rollup(e, "date"), f"select date, {_SUMS}, {_BUCKETS} from e group by date")
_events("daily_client_rollup", lambda e: agg.rollup(e, "date", "client", "model_id"), f"select date, client, model_id, {_SUMS}, {_BUCKETS} from e group by date, client, model_id")
_events("providers_by_day", agg.providers_by_day, "select date, string_agg(distinct provider_id, ', ' order by provider_id) as providers from e group by date")
_events(
    "session_rollup_top_client",
    agg.sessions,
    """, i as (select session_id, client, provider_id, model_id, sum(units) as units, sum(cost) as cost, count(*) as messages, min(timestamp_ms) as lo, max(timestamp_ms) as hi from e group by all),
r as (select *, row_number() over (partition by session_id order by cost desc, client, provider_id, model_id) as n from i)
select session_id, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost, cast(sum(messages) as bigint) as messages, cast(floor(min(lo) / 1000) as bigint) as first_seen,
 cast(floor(max(hi) / 1000) as bigint) as last_seen, max(client) filter (n = 1) as top_client, max(provider_id) filter (n = 1) as top_provider, max(model_id) filter (n = 1) as top_model from r group by session_id""",
)
_events(
    "summary_global",
    agg.summary,
    """, y as (select date, sum(units) as units, sum(cost) as cost from e group by date)
select cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost, count(*) as days, count(*) as active_days, cast(max(cost) as double) as max_day_cost,
 (select string_agg(distinct client, ',' order by client) from e) as clients, (select string_agg(distinct model_id, ',' order by model_id) from e) as models, round(cast(sum(cost) as double) / count(*), 6) as average from y""",
)
_days("year_rollup", agg.years, "select substr(date, 1, 4) as year, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost, min(date) as first_date, max(date) as last_date from d group by 1")
_events("hourly_rollup", lambda e: agg.rollup(e.withColumn("hour", F.concat("date", F.lit(" "), F.lpad((F.floor(F.col("timestamp_ms") / 3_600_000) % 24).cast("string"), 2, "0"), F.lit(":00"))), "hour"), f"select strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:00') as hour, {_SUMS}, {_BUCKETS} from e group by 1")
_events(
    "model_report_performance",
    agg.model_report,
    f""", g as (select client, provider_id, model_id, {_BUCKETS}, count(*) as messages, cast(sum(duration_ms) as bigint) as duration_ms, cast(sum(case when duration_ms > 0 then units else 0 end) as bigint) as timed_units,
 cast(sum(case when duration_ms > 0 then 1 else 0 end) as bigint) as samples, cast(sum(units) as bigint) as units from e group by client, provider_id, model_id)
select *, case when units > 0 then round(timed_units / units, 6) end as coverage, case when timed_units > 0 then round(duration_ms * 1000 / timed_units, 6) end as ms_per_1k from g""",
)
_events("share_of_total", lambda e: agg.share(e, "model_id"), ", g as (select model_id, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from e group by 1) select *, round(cost * 100 / sum(cost) over (), 6) as percent from g")
_STEPS = "case when {r} >= 0.75 then 4 when {r} >= 0.5 then 3 when {r} >= 0.25 then 2 when {r} > 0 then 1 else 0 end"
_DAYS = "g as (select date, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from e group by date)"
_by_day = lambda e: e.groupBy("date").agg(F.sum("units").alias("units"), F.sum("cost").cast("double").alias("cost"))
_events("intensity_cost", lambda e: agg.intensity(_by_day(e), "cost"), f", {_DAYS} select *, {_STEPS.format(r='cost / max(cost) over ()')} as intensity from g")
_events("intensity_units", lambda e: agg.intensity(_by_day(e), "units"), f", {_DAYS} select *, {_STEPS.format(r='units / max(units) over ()')} as intensity from g")
_events("intensity_profile", lambda e: agg.intensity(_by_day(e), "cost", True), f", {_DAYS}, q as (select *, cost / max(cost) over () as r from g) select date, units, cost, case when r <= 0 then 0 when r <= 0.25 then 1 when r <= 0.5 then 2 when r <= 0.75 then 3 else 4 end as intensity from q")
_events("weekday_distribution", lambda e: agg.weekdays(_by_day(e)), f", {_DAYS} select cast(dayofweek(cast(date as date)) as integer) as weekday, cast(sum(units) as bigint) as units, count(*) as days from g where units > 0 group by 1")
_days("device_totals_active_days", agg.devices, f"select device, {_SUMS}, count(distinct case when units > 0 then date end) as active_days, min(date) as first_date, max(date) as last_date from d group by device")
_events(
    "largest_remainder_percent",
    lambda e: agg.whole_percents(e.groupBy("model_id").agg(F.sum("units").alias("units")), "model_id", "units"),
    """, g as (select model_id, cast(sum(units) as bigint) as t from e group by 1), f as (select *, (100 * t) // cast(sum(t) over () as bigint) as fl, (100 * t) % cast(sum(t) over () as bigint) as rest from g)
select model_id, cast(fl + case when row_number() over (order by rest desc, model_id) <= 100 - sum(fl) over () then 1 else 0 end as bigint) as percent from f""",
)
query("global_stats_distinct", f"with {_D} select {_SUMS}, count(distinct user_id) as users from d")(lambda spark, sf: warehouse_days(spark, sf).agg(*agg.measures(), F.count_distinct("user_id").alias("users")))
query("json_extract_sum", "select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by 1")(lambda spark, sf: table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))
query("first_user_message", "select conv_id, left(arg_min(text, turn) filter (trim(text) <> '' and not regexp_matches(text, '^ *<(environment_context|system-reminder|user_instructions)>')), 1000) as first_message, count(*) as user_turns from conversations where role = 'user' group by conv_id")(lambda spark, sf: logs.first_user_messages(table(spark, sf, "conversations")))

# Leaderboards
_U = f"{_D}, u as (select user_id, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from d group by 1)"
query("rank_all_time", f"with {_U} select *, rank() over (order by units desc) as rank from u")(lambda spark, sf: rk.competition_rank(rk.totals(warehouse_days(spark, sf))))
query("rank_period_ordinal", f"with {_D}, u as (select user_id, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from d where date between '1995-01-01' and '1995-12-31' group by 1) select *, row_number() over (order by units desc, cost desc, user_id) as rank from u")(lambda spark, sf: rk.ordinal_rank(rk.totals(warehouse_days(spark, sf), "1995-01-01", "1995-12-31")))
query("rank_user_by_count", f"with {_U} select user_id, units, (select count(*) from u o where o.units > u.units) + 1 as rank from u where user_id = 100")(lambda spark, sf: rk.rank_of(rk.totals(warehouse_days(spark, sf)), F.col("user_id") == 100))
query("rank_then_filter_text", f"with {_U}, r as (select *, rank() over (order by units desc) as rank from u) select r.*, c_name from r join customer on c_custkey = user_id where contains(lower(c_name), '01')")(
    lambda spark, sf: rk.competition_rank(rk.totals(warehouse_days(spark, sf))).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name").where(F.contains(F.lower("c_name"), F.lit("01"))), "user_id")
)
query("rank_with_row_directive", f"with {_D}, u as (select user_id, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from d where contains(lower(client), 'r') and contains(lower(model_id), 'f') group by 1) select *, rank() over (order by units desc) as rank from u")(
    lambda spark, sf: rk.competition_rank(rk.totals(rk.matching_rows(warehouse_days(spark, sf), rk.directives("client:R model:f, rest")[0])))
)
query("rank_with_exists_directive", f"with {_U} select *, rank() over (order by units desc) as rank from u where user_id in (select user_id from d where contains(lower(client), 'a'))")(
    lambda spark, sf: rk.competition_rank(rk.totals(warehouse_days(spark, sf)).join(rk.users_with(warehouse_days(spark, sf), "client", "A"), "user_id"))
)
query("page_offset", f"with {_U}, r as (select *, rank() over (order by units desc) as rank from u) select * from r order by rank, user_id limit 20 offset 40")(lambda spark, sf: rk.page(rk.competition_rank(rk.totals(warehouse_days(spark, sf))), 3, 20))

# Joins
query("user_left_submission", f"with {_U} select c_custkey as user_id, coalesce(units, 0) as units from customer left join u on c_custkey = user_id")(
    lambda spark, sf: table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(rk.totals(warehouse_days(spark, sf)), "user_id", "left").select("user_id", F.coalesce("units", F.lit(0)).alias("units"))
)
query("semi_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")(lambda spark, sf: table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"))
query("anti_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")(lambda spark, sf: table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"))
query("duplicate_group_semi", f"with {_D} select user_id, device, date, client, units from d where (user_id, date) in (select (user_id, date) from d group by user_id, date having count(*) > 1)")(
    lambda spark, sf: warehouse_days(spark, sf).select("user_id", "device", "date", "client", "units").join(warehouse_days(spark, sf).groupBy("user_id", "date").agg(F.count("*").alias("n")).where("n > 1"), ["user_id", "date"], "left_semi")
)
query("twin_self_join", f"with {_D}, w as (select user_id, substr(date, 1, 7) as date, client, device, units from d) select a.user_id, a.date, a.client, a.units, a.device as device_a, b.device as device_b from w a join w b on a.user_id = b.user_id and a.date = b.date and a.client = b.client and a.units = b.units and a.device < b.device where a.units >= 10")(lambda spark, sf: mg.twins(warehouse_days(spark, sf).withColumn("date", F.substring("date", 1, 7)), 10))

# Intervals
_sessions = lambda spark, sf: iv.sessionize(iv.spans(event_facts(spark, sf)))
query("sessionize_gap", f"with {_I} select client, session_id, s as start, t as \"end\", units, cost, messages, t - s as active_ms from iv")(_sessions)
_SWEEP = """ev as (select s as t, 1 as d from iv union all select case when t <= s then s + 1 else t end, -1 from iv), sw as (select sum(d) over (order by t, d desc rows unbounded preceding) as n from ev)"""
_LONG = """lm as (select *, case when s > max(t) over (order by s, t rows between unbounded preceding and 1 preceding) + 180000 then 1 else 0 end as new from iv),
lb as (select *, sum(new) over (order by s, t rows unbounded preceding) as b from lm), lg as (select max(t) - min(s) as n from lb group by b)"""
query("max_concurrent", f"with {_I}, {_SWEEP} select cast(max(n) as bigint) as max_concurrent from sw")(lambda spark, sf: iv.max_concurrent(_sessions(spark, sf)))
query("time_metrics", f"with {_I}, {_SWEEP}, {_LONG} select cast((select sum(t - s) from iv) as bigint) as active_ms, (select count(*) from iv) as sessions, (select max(n) from lg) as longest_ms, cast((select max(n) from sw) as bigint) as max_concurrent")(lambda spark, sf: iv.time_metrics(_sessions(spark, sf)))
query("daily_active_split", f"with {_I}, dd as (select s, t, unnest(range(s // 86400000, t // 86400000 + 1)) as day from iv where t > s), p as (select day, least(t, (day + 1) * 86400000) - greatest(s, day * 86400000) as ms from dd) select strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') as date, cast(sum(ms) as bigint) as active_ms from p group by day having sum(ms) > 0")(lambda spark, sf: iv.daily_active(_sessions(spark, sf)))

# Series
_CAL = "cal as (select strftime(unnest(generate_series((select min(cast(date as timestamp)) from g), (select max(cast(date as timestamp)) from g), interval 1 day)), '%Y-%m-%d') as date)"
_one = lambda e: e.groupBy("date").agg(F.sum("units").alias("units"))
_ONE = "g as (select date, cast(sum(units) as bigint) as units from e group by date)"
_events("dense_days", lambda e: sr.dense(_one(e)), f", {_ONE}, {_CAL} select cal.date, coalesce(units, 0) as units from cal left join g using (date)")
_events("trailing_average", lambda e: sr.trailing_average(sr.dense(_one(e)), 7), f", {_ONE}, {_CAL}, f as (select cal.date, coalesce(units, 0) as units from cal left join g using (date)) select date, units, round(avg(units) over (order by date rows between 6 preceding and current row), 6) as average from f")
_user_days = lambda e: e.groupBy("user_id", "date").agg(F.sum("units").alias("units"))
_USER_DAYS = "g as (select user_id, date, cast(sum(units) as bigint) as units from e group by 1, 2)"
_GRID = "grid as (select user_id, cal.date from (select distinct user_id from g) cross join cal)"
_events("dense_days_by_user", lambda e: sr.dense(_user_days(e), "user_id"), f", {_USER_DAYS}, {_CAL}, {_GRID} select user_id, date, coalesce(units, 0) as units from grid left join g using (user_id, date)")
_events("trailing_average_by_user", lambda e: sr.trailing_average(sr.dense(_user_days(e), "user_id"), 7, "user_id"), f", {_USER_DAYS}, {_CAL}, {_GRID}, f as (select user_id, date, coalesce(units, 0) as units from grid left join g using (user_id, date)) select *, round(avg(units) over (partition by user_id order by date rows between 6 preceding and current row), 6) as average from f")
_events("topk_other", lambda e: sr.top_with_other(e, "user_id", 12), ", g as (select user_id, cast(sum(units) as bigint) as units from e group by 1), p as (select *, row_number() over (order by units desc, user_id) as n, count(*) over () as c from g) select case when c <= 12 or n < 12 then cast(user_id as varchar) else 'other' end as series, cast(sum(units) as bigint) as units from p group by 1")
_STREAK = ", a as (select distinct user_id, cast(date as date) as d from e where cost > 0), i as (select *, d - cast(row_number() over (partition by user_id order by d) as integer) as g from a), s as (select user_id, max(d) as hi, count(*) as n from i group by user_id, g)"
_events("streak_longest", lambda e: sr.longest_streak(e, "user_id"), f"{_STREAK} select user_id, max(n) as longest from s group by 1")
_events("streak_current", lambda e: sr.current_streak(e, "2024-01-20", "user_id"), f"{_STREAK} select user_id, n as current from s where date '2024-01-20' - hi between 0 and 1")

# Merges
_events("dedup_keep_first", lambda e: mg.keep_first(e.withColumn("key", F.when(F.col("input") > 0, F.concat_ws(":", "user_id", "client"))), "key", "timestamp_ms", "event_id").select("event_id", "key", "units"), ", k as (select *, case when input > 0 then user_id || ':' || client end as key from e), r as (select *, row_number() over (partition by key order by timestamp_ms, event_id) as n from k) select event_id, key, units from r where key is null or n = 1")
_events("dedup_field_max", lambda e: mg.field_max(e.withColumn("key", F.concat_ws(":", "user_id", "model_id")), "key", ["input", "output", "cache_read", "duration_ms"]), "select user_id || ':' || model_id as key, max(input) as input, max(output) as output, max(cache_read) as cache_read, max(duration_ms) as duration_ms from e group by 1")
_events("largest_snapshot", lambda e: mg.largest_snapshot(e, "session_id", ["event_id", "units"], ["units", "cost"]), ", r as (select *, row_number() over (partition by session_id order by units desc, cost desc, event_id desc) as n from e) select session_id, event_id, units from r where n = 1")
_half = lambda e, low: e.where("event_id % 3 <> 0" if low else "event_id % 2 = 0 or event_id % 3 = 0")
_events("window_union_replace", lambda e: mg.window_union(_half(e, True).select("event_id", "units"), _half(e, False).select("event_id", (F.col("units") * 2).alias("units")), "event_id", ["units"]), "select event_id, case when event_id % 2 = 0 or event_id % 3 = 0 then units * 2 else units end as units from e")
_events("source_precedence_cutoff", lambda e: mg.precedence_cutoff(e.where("client = 'purchase' and date >= '2024-01-10'").select("event_id", "timestamp_ms"), e.where("not (client = 'purchase' and date >= '2024-01-10')").select("event_id", "timestamp_ms")), ", a as (select event_id, timestamp_ms from e where client = 'purchase' and date >= '2024-01-10') select * from a union all select event_id, timestamp_ms from e where not (client = 'purchase' and date >= '2024-01-10') and timestamp_ms < (select min(timestamp_ms) - 3600000 from a)")
_events("ledger_append", lambda e: mg.ledger_append(_half(e, True).select("event_id", "units"), _half(e, False).select("event_id", F.lit(-1).cast("long").alias("units")), "event_id"), "select event_id, case when event_id % 3 <> 0 then units else -1 end as units from e")

_side = lambda e, low: e.where("coalesce(date, '') <= '2024-01-20'" if low else "date >= '2024-01-10'")
_events("window_union_by_date", lambda e: mg.window_union(_side(e, True).select("event_id", "units"), _side(e, False).select("event_id", (F.col("units") * 2).alias("units")), "event_id", ["units"]), "select event_id, case when date >= '2024-01-10' then units * 2 else units end as units from e")
_events("ledger_append_by_date", lambda e: mg.ledger_append(_side(e, True).select("event_id", "units"), _side(e, False).select("event_id", F.lit(-1).cast("long").alias("units")), "event_id"), "select event_id, case when coalesce(date, '') <= '2024-01-20' then units else -1 end as units from e")


def _stored(d: DataFrame) -> DataFrame:
    return d.groupBy("user_id", "date", "client").agg(F.sum("units").alias("units")).withColumn("revision", F.col("user_id") % 3)


def _incoming(d: DataFrame) -> DataFrame:
    return _stored(d.where("device <> 1")).withColumn("units", F.col("units") + F.when(F.col("user_id") % 5 == 0, -3).otherwise(2)).withColumn("revision", F.col("user_id") % 4)


_SI = f"{_D}, s as (select user_id, date, client, cast(sum(units) as bigint) as units, user_id % 3 as revision from d group by 1, 2, 3), i as (select user_id, date, client, cast(sum(units) as bigint) + case when user_id % 5 = 0 then -3 else 2 end as units, user_id % 4 as revision from d where device <> 1 group by 1, 2, 3)"
query(
    "guarded_merge",
    f"with {_SI}, b as (select coalesce(s.user_id, i.user_id) as user_id, coalesce(s.date, i.date) as date, coalesce(s.client, i.client) as client, s.units as st, s.revision as sr, i.units as it, i.revision as ir, s.revision is not null and (i.revision is null or i.revision < s.revision or i.revision = s.revision and i.units < s.units) as keep from s full join i on s.user_id = i.user_id and s.date = i.date and s.client = i.client) select user_id, date, client, case when keep then st else it end as units, case when keep then sr else ir end as revision from b where ir is not null or st > 0",
)(lambda spark, sf: mg.guarded_merge(_stored(warehouse_days(spark, sf)), _incoming(warehouse_days(spark, sf)), ["user_id", "date", "client"]))
query("revision_floor_filter", f"with {_SI} select i.* from i where revision >= (select max(revision) from s where s.client = i.client)")(lambda spark, sf: mg.revision_floor(_stored(warehouse_days(spark, sf)), _incoming(warehouse_days(spark, sf))).select("user_id", "date", "client", "units", "revision"))
query("coverage_tombstone", f"with {_SI} select s.* from s where not (client = 'R' and date between '1994-01-01' and '1994-06-30') and not (client = 'N' and date >= '1997-01-01' and date <= '1997-03-31')")(
    lambda spark, sf: mg.covered(_stored(warehouse_days(spark, sf)), spark.createDataFrame([("R", "1994-01-01", "1994-06-30"), ("N", "1997-01-01", "1997-03-31")], "client string, start string, end string"))
)
query("replace_window", f"with {_SI} select * from s where not exists (select 1 from i where i.user_id = s.user_id and i.date = s.date) union all select * from i")(lambda spark, sf: mg.replace_window(_stored(warehouse_days(spark, sf)), _incoming(warehouse_days(spark, sf)), ["user_id", "date"]))
_events("apportion_exact", lambda e: mg.apportion(e.select("session_id", "event_id", F.lit(1000).alias("total"), (F.col("units") + 1).alias("weight")), "session_id", "event_id", "total", "weight").select("session_id", "event_id", "part"), ", w as (select session_id, event_id, (1000 * sum(units + 1) over (partition by session_id order by event_id)) // sum(units + 1) over (partition by session_id) as upto from e) select session_id, event_id, cast(upto - coalesce(lag(upto) over (partition by session_id order by event_id), 0) as bigint) as part from w")
query("recursive_tree", "with recursive t as (select c_custkey as id, c_custkey as root from customer where c_custkey // 3 = 0 or c_custkey // 3 not in (select c_custkey from customer) union all select c.c_custkey, t.root from customer c join t on c.c_custkey // 3 = t.id where c.c_custkey // 3 > 0) select id, root from t")(
    lambda spark, sf: trees.roots(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") >= 3, F.floor(F.col("c_custkey") / 3)).alias("parent")))
)

# Pricing
_L = "select l_orderkey, l_linenumber, cast(l_extendedprice as bigint) as units, cast(l_quantity as bigint) as w from lineitem"
_lines = lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("long").alias("units"), F.col("l_quantity").cast("long").alias("w"))
_L = _L.replace("cast(l_extendedprice as bigint)", "cast(trunc(l_extendedprice) as bigint)").replace("cast(l_quantity as bigint)", "cast(trunc(l_quantity) as bigint)")
query("tiered_cost", f"with l as ({_L}) select l_orderkey, l_linenumber, round((units - greatest(units - 20000, 0)) * 3.0 + greatest(units - 20000, 0) * 6.0, 4)::double as cost from l")(lambda spark, sf: _lines(spark, sf).select("l_orderkey", "l_linenumber", pricing.tiered(F.col("units"), F.lit(3.0), F.lit(6.0), 20_000).alias("cost")))
query("whole_request_tier", f"with l as ({_L}) select l_orderkey, l_linenumber, (units * case when w > 25 then 6.0 else 3.0 end)::double as cost from l")(lambda spark, sf: _lines(spark, sf).select("l_orderkey", "l_linenumber", pricing.whole_request(F.col("units"), F.col("w"), F.lit(3.0), F.lit(6.0), 25).alias("cost")))
query("cache_surcharge", f"with l as ({_L}) select l_orderkey, l_linenumber, least(w, units) * 1.5::double as cost from l")(lambda spark, sf: _lines(spark, sf).select("l_orderkey", "l_linenumber", pricing.cache_surcharge(F.col("units"), F.col("w"), F.lit(2.0), F.lit(2.5)).alias("cost")))
query("validation_violations", "select o_orderkey, o_totalprice < 0 or o_orderdate > timestamp '1998-01-01' or o_orderstatus not in ('O', 'F', 'P') as violates, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines from orders")(
    lambda spark, sf: table(spark, sf, "orders").join(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey", "left")
    .select("o_orderkey", ((F.col("o_totalprice") < 0) | (F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss") > "1998-01-01 00:00:00") | ~F.col("o_orderstatus").isin("O", "F", "P")).alias("violates"), F.coalesce("n", F.lit(0)).alias("lines"))
)
