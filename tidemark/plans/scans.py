"""Queries of repeated scans, trees and matchings, and for each what DuckDB must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import formats as fm, names
from tidemark.operators import changes as ch, intervals as iv, matching, merge as mg, profile as pf, submission as sb, trees, validate as vd
from tidemark.plans.catalogue import _D, _E, query
from tidemark.session import cut_lineage, table
from tidemark.sources.facts import event_facts, warehouse_days

# Two snapshots of all events: by the last digit of the id some are gone, new, rewritten, under another key, or copies of each other
_CONTENT = ["event_type", "user_id", "value", "props"]
_SNAPSHOTS = """o as (select event_id as key, event_type, user_id, value, props, epoch_us(ts) as updated from events where event_id % 10 <> 3),
n as (select case when event_id % 10 = 5 then event_id + 1000000000 else event_id end as key, event_type, user_id, case when event_id % 10 = 1 then value + 1 else value end as value, props,
 case when event_id % 10 in (1, 3, 5) then (select max(epoch_us(ts)) from events) + event_id else epoch_us(ts) end as updated from events where event_id % 10 <> 7),
moved as (select coalesce(o.key, n.key) as key, o.key is null as fresh, n.key is null as gone, case when o.key is null then n.event_type else o.event_type end as event_type, case when o.key is null then n.user_id else o.user_id end as user_id,
 case when o.key is null then n.value else o.value end as value, case when o.key is null then n.props else o.props end as props from o full join n on o.key = n.key where o.key is null or n.key is null),
pairs as (select max(key) filter (fresh) as key, max(key) filter (gone) as old_key from moved group by event_type, user_id, value, props having count(*) filter (fresh) = 1 and count(*) filter (gone) = 1),
found as (select 'rekey' as kind, key, old_key from pairs union all select case when fresh then 'insert' else 'delete' end, key, null from moved where key not in (select key from pairs union all select old_key from pairs)
 union all select 'rewrite', o.key, null from o join n on o.key = n.key where (o.event_type, o.user_id, o.value, o.props) is distinct from (n.event_type, n.user_id, n.value, n.props))"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").withColumn("updated", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("digit", F.col("event_id") % 10)
    latest = F.lit(events.agg(F.max("updated")).first()[0])
    old = events.where("digit <> 3").select(F.col("event_id").alias("key"), *_CONTENT, "updated")
    new = events.where("digit <> 7").select(
        F.when(F.col("digit") == 5, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")).alias("key"), "event_type", "user_id", F.when(F.col("digit") == 1, F.col("value") + 1).otherwise(F.col("value")).alias("value"), "props",
        F.when(F.col("digit").isin(1, 3, 5), latest + F.col("event_id")).otherwise(F.col("updated")).alias("updated"),
    )
    return old, new


def _snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.changes(*_snapshots(spark, sf_dir), "key", _CONTENT)


def _changes_since_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return ch.rescanned(new, ch.scanned(old, "key", _CONTENT, "updated"), "key", _CONTENT, "updated")[0]


def _changes_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return ch.applied(old, ch.changes(old, new, "key", _CONTENT), new, "key").select("key", *_CONTENT)


query("snapshot_changes", f"with {_SNAPSHOTS} select * from found")(_snapshot_changes)
query("changes_since_mark", f"with {_SNAPSHOTS} select * from found")(_changes_since_mark)
query("changes_applied", f"with {_SNAPSHOTS} select key, event_type, user_id, value, props from n")(_changes_applied)

# Trees over all events: a user's events are a log, each below the one before it; every seventh goes back three places, and some name a parent that is not there
_NTH = "n0 as (select event_id, user_id, event_type, epoch_us(ts) as at, row_number() over (partition by user_id order by ts, event_id) as n from events)"
_TREE = f"""{_NTH}, t as (select user_id, event_id, n, event_type, case when event_id % 1009 = 5 then -n when n = 1 then null when n % 7 = 0 then n - 3 else n - 1 end as up from n0)"""


def _nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order).cast("long"))


def _active_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.when(F.col("event_id") % 1009 == 5, -F.col("n")).when(F.col("n") == 1, None).when(F.col("n") % 7 == 0, F.col("n") - 3).otherwise(F.col("n") - 1)
    return trees.on_last_branch(_nth(spark, sf_dir).withColumn("up", up).withColumn("place", F.col("n")), ["user_id"], "n", "up", "place")


query(
    "active_branches",
    f"""with recursive {_TREE}, leaf as (select user_id, max(n) as n from t group by 1),
w as (select t.user_id, t.n, t.up from t join leaf using (user_id, n) union select t.user_id, t.n, t.up from w join t on t.user_id = w.user_id and t.n = w.up),
broken as (select distinct user_id from w where up < 0) select t.user_id, t.n, t.user_id in (from broken) or exists (select 1 from w where w.user_id = t.user_id and w.n = t.n) as active from t""",
)(_active_branches)


def _inner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _nth(spark, sf_dir).select("user_id", "n", F.when(F.col("n") > 1, F.floor(F.col("n") / 2)).alias("up"), (F.col("event_type") == "purchase").alias("invokes"))
    return trees.below_marked(spans, ["user_id"], "n", "up", "invokes")


query(
    "inner_spans",
    f"""with recursive {_NTH}, t as (select user_id, n, case when n > 1 then n // 2 end as up, event_type = 'purchase' as invokes from n0),
w as (select user_id, n, up, false as below from t union all select w.user_id, w.n, t.up, t.invokes from w join t on t.user_id = w.user_id and t.n = w.up)
select user_id, n, bool_or(below) as below from w group by 1, 2""",
)(_inner_spans)
query(
    "best_lanes",
    """with l as (select event_id, user_id % 50 as scope, case event_type when 'view' then 3 when 'click' then 2 when 'purchase' then 1 else 0 end as lane, case when event_id % 4 > 0 then event_id // 7 end as trace, case when event_id % 5 > 0 then user_id end as response from events)
select event_id from l where not exists (select 1 from l o where o.scope = l.scope and o.lane < l.lane and o.trace = l.trace) and not exists (select 1 from l o where o.scope = l.scope and o.lane < l.lane and o.response = l.response)""",
)(
    lambda spark, sf: mg.best_lane(
        table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("scope"), F.expr("case event_type when 'view' then 3 when 'click' then 2 when 'purchase' then 1 else 0 end").alias("lane"), F.expr("if(event_id % 4 > 0, event_id div 7, null)").alias("trace"), F.expr("if(event_id % 5 > 0, user_id, null)").alias("response")),
        "lane", ["scope"], ["trace", "response"],
    ).select("event_id")
)


def _matched_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks of a user as two kinds of rows that tell of the same, at most a day apart; no SQL: which matching is cheapest is tested against enumeration."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type").withColumn("day", F.expr("at div 86400"))
    a = events.where("event_type = 'purchase'").select(F.col("event_id").alias("left"), "user_id", "at", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)).alias("day"))
    b = events.where("event_type = 'click'").select(F.col("event_id").alias("right"), "user_id", F.col("at").alias("then"), "day")
    edges = a.join(b, ["user_id", "day"]).withColumn("cost", F.abs(F.col("at") - F.col("then"))).where("cost <= 86400")
    return matching.matched(edges)


query("matched_responses")(_matched_responses)


# Days and hours of a zone across a change of its clocks: two months later than they were, so that the second Sunday of March is among them; SQL has the one change as a constant
_ZONE, _LATER_MS = "America/New_York", 60 * 86_400_000
_LOCAL = f"""{_E}, x as (select user_id, units, timestamp_ms + {_LATER_MS} as ts, duration_ms from e), off as (select *, case when ts < epoch_ms(timestamp '2024-03-10 07:00:00') then 5 else 4 end * 3600000 as o from x)"""
_shifted = lambda e: e.withColumn("timestamp_ms", F.col("timestamp_ms") + _LATER_MS)


def _daily_active_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _shifted(event_facts(spark, sf_dir)).groupBy("user_id").agg(F.min("timestamp_ms").alias("start"), F.max(F.col("timestamp_ms") + F.col("duration_ms")).alias("end"))
    return iv.daily_active(spans.withColumn("active_ms", F.col("end") - F.col("start")), _ZONE)


query(
    "daily_active_in_zone",
    f"""with {_LOCAL}, g as (select user_id, min(ts) as s, max(ts + duration_ms) as t from x group by 1),
z as (select d, epoch_ms(d) + case when d <= date '2024-03-10' then 5 else 4 end * 3600000 as a, epoch_ms(d + interval 1 day) + case when d + interval 1 day <= date '2024-03-10' then 5 else 4 end * 3600000 as b from (select cast(unnest(generate_series(timestamp '2024-02-28', timestamp '2024-04-02', interval 1 day)) as date) as d))
select strftime(d, '%Y-%m-%d') as date, cast(sum(least(t, b) - greatest(s, a)) as bigint) as active_ms from z join g on s < b and t > a and t > s group by 1 having sum(least(t, b) - greatest(s, a)) > 0""",
)(_daily_active_in_zone)
query("hours_in_zone", f"with {_LOCAL} select strftime(make_timestamp((ts - o) * 1000), '%Y-%m-%d %H:00') as hour, cast(sum(units) as bigint) as units, count(*) as messages from off group by 1")(
    lambda spark, sf: _shifted(event_facts(spark, sf)).groupBy(fm.hour_key(F.col("timestamp_ms"), _ZONE).alias("hour")).agg(F.sum("units").alias("units"), F.count("*").alias("messages"))
)


# Names of agents made of the parts' names, checks of parts by speed, and the trailing year
_AGENTS = "case p_partkey % 5 when 0 then 'github.copilot.' || replace(p_name, ' ', '.') when 1 then 'Plugin:' || lower(p_type) || ':' || replace(p_name, ' ', '-') when 2 then 'Atlas - Plan Executor' when 3 then p_name || '  ui-api' else 'PLUGIN:' || p_type end"
_WORD = "upper(w[1]) || w[2:]"
_TITLE = "array_to_string([{word} for w in string_split({of}, ' ')], ' ')".format


def _agent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr(_AGENTS).alias("agent"))
    return made.select("p_partkey", names.copilot_agent_name(F.col("agent")).alias("copilot"), names.family_agent_name(F.col("agent")).alias("family"))


query(
    "agent_names_of_kinds",
    f"""with p as (select *, {_TITLE(word=_WORD, of='p_name')} as t from part) select p_partkey, case p_partkey % 5 when 0 then t when 1 then {_TITLE(word=_WORD, of='lower(p_type)')} || ': ' || t when 2 then 'Atlas Plan Executor' when 3 then t || ' UI API' else p_type end as copilot,
case p_partkey % 5 when 0 then 'Github.copilot.' || replace(p_name, ' ', '.') when 1 then 'Plugin:' || lower(p_type) || ':' || split_part(p_name, ' ', 1) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] when 2 then 'Atlas' when 3 then t || ' UI API' else 'PLUGIN:' || p_type end as family from p""",
)(_agent_kinds)


def _speed_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_facts(spark, sf_dir)
    rows = e.groupBy("user_id", "client").agg(F.sum("units").alias("units"), F.count("*").alias("messages"))
    parts = e.groupBy("user_id", "client", F.when(F.col("event_id") % 2 == 0, "fast").otherwise("standard").alias("speed"), F.lit("reported").alias("source"), F.expr("if(event_id % 50 = 0, 1, 0)").alias("again")).agg(F.sum(F.col("units") + F.when(F.col("event_id") % 40 == 1, 500).otherwise(0)).alias("units"), F.sum(F.when(F.col("event_id") % 60 == 2, 2).otherwise(1)).alias("messages"))
    return vd.speed_faults(rows, parts, ["user_id", "client"])


query(
    "speed_faults",
    f"""with {_E}, r as (select user_id, client, sum(units) as units, count(*) as messages, sum(units + case when event_id % 40 = 1 then 500 else 0 end) as su, sum(case when event_id % 60 = 2 then 2 else 1 end) as sm, bool_or(event_id % 50 = 0) and bool_or(event_id % 50 <> 0 and event_id % 2 = 0) as repeated from e group by 1, 2)
select user_id, client, repeated, su > units as more_units, sm > messages as more_messages from r where repeated or su > units or sm > messages""",
)(_speed_faults)
query(
    "trailing_year",
    f"""with {_D}, g as (select date, cast(sum(units) as bigint) as units, cast(sum(cost) as double) as cost from d where date >= '1996-06-08' group by 1), m as (select max(units) as most from g where date between '1996-06-15' and '1997-06-15')
select date, units, cost, case when date not between '1996-06-15' and '1997-06-15' then 0 when units / most >= 0.75 then 4 when units / most >= 0.5 then 3 when units / most >= 0.25 then 2 when units > 0 then 1 else 0 end as intensity from g, m""",
)(lambda spark, sf: pf.trailing_year(warehouse_days(spark, sf), "1997-06-15"))


# A batch of submissions against what is stored: half of the users have a legacy device alone, a tenth sends a client that there is not, one client has another name
_SPANS = [("R", "1994-01-01", "1994-06-30"), ("N", "1997-01-01", "1997-03-31")]


def _submission(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    # rows of a day and client add up on their way
    stored = d.withColumns({"device": F.expr("if(user_id % 2 = 0, 0, device)"), "revision": F.col("user_id") % 3})
    sent = d.where("device in (1, 2)").withColumns({"client": F.expr("case when user_id % 11 = 0 then 'X' when user_id % 7 = 0 and client = 'A' then 'B' else client end"), "units": F.expr("units + case when user_id % 5 = 0 then -1 when user_id % 5 < 3 then 1 else 0 end"), "revision": F.col("user_id") % 4})
    spans = sent.select("user_id", "device").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(c).alias("client"), F.lit(a).alias("start"), F.lit(b).alias("end")) for c, a, b in _SPANS]))).select("user_id", "device", "s.*")
    return sb.submitted(stored, sent, ["R", "A", "N"], "2010-01-01", {"B": "A"}, spans, least=20)


def _day_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse_days(spark, sf_dir).select("user_id", "device", "date", "client", "units")


def _after_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what is stored, sent and covered all come from the same days, which are joined once
    return _submission(cut_lineage(_day_units(spark, sf_dir), "days"))[0]


_SUBMISSION = f"""with {_D}, st as (select user_id, case when user_id % 2 = 0 then 0 else device end as device, date, client, cast(sum(units) as bigint) as units, user_id % 3 as revision from d group by 1, 2, 3, 4),
sent as (select user_id, device, date, case when user_id % 11 = 0 then 'X' when user_id % 7 = 0 and client = 'A' then 'A' else client end as client, units + case when user_id % 5 = 0 then -1 when user_id % 5 < 3 then 1 else 0 end as units, user_id % 4 as revision from d where device in (1, 2)),
bad as (select distinct user_id, device from sent where client = 'X' or units < 0), n as (select user_id, device, date, client, cast(sum(units) as bigint) as units, max(revision) as revision from sent where (user_id, device) not in (from bad) group by 1, 2, 3, 4),
snd as (select distinct user_id, device from n), ad as (select st.* replace (case when device = 0 and not exists (select 1 from st o where o.user_id = st.user_id and o.device <> 0) then coalesce((select min(device) from snd where snd.user_id = st.user_id), 0) else device end as device) from st),
pa as (select n.* from n left join (select user_id, device, client, max(revision) as floor from ad group by 1, 2, 3) f using (user_id, device, client) where floor is null or revision >= floor),
th as (select ad.* from ad where (user_id, device) in (from snd) and not (((client = 'R' and date between '1994-01-01' and '1994-06-30') or (client = 'N' and date between '1997-01-01' and '1997-03-31')) and not exists (select 1 from n where n.user_id = ad.user_id and n.device = ad.device and n.date = ad.date and n.client = ad.client))),
re as (select ad.* from ad where (user_id, device) not in (from snd)),
g as (select coalesce(s.user_id, i.user_id) as user_id, coalesce(s.device, i.device) as device, coalesce(s.date, i.date) as date, coalesce(s.client, i.client) as client, s.units as su, s.revision as sr, i.units as iu, i.revision as ir, s.revision is not null and (i.revision is null or i.revision < s.revision or i.revision = s.revision and i.units < s.units) as keep
 from th s full join pa i on s.user_id = i.user_id and s.device = i.device and s.date = i.date and s.client = i.client),
af as (select user_id, device, date, client, case when keep then su else iu end as units, case when keep then sr else ir end as revision from g where ir is not null or su > 0),
fin as (select * from af union all select * from re where not exists (select 1 from af where af.units >= 20 and af.user_id = re.user_id and af.date = re.date and af.client = re.client and af.units = re.units))"""
query("submission_rows", f"{_SUBMISSION} select * from fin")(_after_submission)
query("submissions_refused", f"{_SUBMISSION} select user_id, device, concat_ws(',', case when bool_or(client = 'X') then 'client' end, case when bool_or(units < 0) then 'units' end) as reasons from sent where (user_id, device) in (from bad) group by 1, 2")(lambda spark, sf: _submission(_day_units(spark, sf))[1])
query("totals_after_submission", f"{_SUBMISSION} select user_id, cast(sum(units) as bigint) as units, min(date) as first_date, max(date) as last_date, count(distinct date) as days, string_agg(distinct client, ',' order by client) as clients from fin group by 1")(lambda spark, sf: sb.totals(_after_submission(spark, sf)))
