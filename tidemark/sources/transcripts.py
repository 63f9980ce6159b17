"""Log formats whose records hang together: traces of spans, conversations that go back and branch off, and totals that a transcript explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import names
from tidemark.operators import merge as mg, trees
from tidemark.sources.adapters import Adapter, text_path
from tidemark.sources.formats import STEM, said, whole
from tidemark.sources.logs import epoch_ms
from tidemark.sources.reading import lossy_lines

_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt"}


def _records(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """path, modified_ms, place, line and row of each line that parses."""
    lines = lossy_lines(spark, root, glob).withColumn("row", F.from_json("line", f"{schema}, _corrupt string", _CORRUPT))
    return lines.where("row is not null and row._corrupt is null")


# Traces of spans. Names of attributes, of which the first that is given counts.
_SPAN = """type string, name string, kind string, traceId string, spanId string, parentSpanId string, spanContext struct<traceId string, spanId string, parentSpanId string>, body string, _body string,
 startTime string, endTime string, duration string, hrTime string, _hrTime string, time string, timestamp string, observedTimestamp string, timeUnixNano string, attributes map<string, string>"""
_MODEL = ["gen_ai.response.model", "gen_ai.request.model"]
_SESSION = ["session.id", "copilot_chat.chat_session_id", "copilot_chat.session_id", "gen_ai.conversation.id", "github.copilot.interaction_id", "gen_ai.response.id"]
#: sessions of one kind stand in for each other: the first four, then an interaction, then a response
_SESSION_RANK = [3, 3, 3, 3, 2, 1]
_COUNTS = {
    "prompt": ["gen_ai.usage.input_tokens"],
    "output": ["gen_ai.usage.output_tokens"],
    "cache_read": ["gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens"],
    "cache_write": ["gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write_input_tokens", "gen_ai.usage.cache_creation_input_tokens"],
    "reasoning": ["gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens"],
}
#: Records that report the same use, from the most exact to the coarsest.
_LANES = ("chat", "inference", "turn", "summary")


def _attribute(name: str) -> str:
    return f"row.attributes['{name}']"


def _first_said(attributes: list[str]) -> str:
    return f"coalesce({', '.join(said(_attribute(a)) for a in attributes)})"


def _identity(name: str) -> str:
    """SQL of an id of a record or of its context; zeros stand for none."""
    valid = lambda x: f"if({x} rlike '^0*$', null, {x})"
    return f"coalesce({valid(f'row.{name}')}, {valid(f'row.spanContext.{name}')})"


def _pair_ms(value: str) -> str:
    """SQL of milliseconds of a pair of seconds and nanoseconds."""
    pair = f"from_json({value}, 'array<bigint>')"
    return f"try_add(get({pair}, 0) * 1000, get({pair}, 1) div 1000000)"


def _scalar_ms(value: str) -> str:
    n = f"try_cast(try_cast({value} as decimal(30, 6)) as bigint)"
    return f"case when abs({n}) >= 100000000000000000 then {n} div 1000000 when abs({n}) >= 100000000000000 then {n} div 1000 when abs({n}) >= 100000000000 then {n} else {n} * 1000 end"


_DURATION = f"""coalesce(nullif(greatest({_pair_ms('row.endTime')} - {_pair_ms('row.startTime')}, 0), 0), nullif(greatest(coalesce({_pair_ms('row.duration')},
 if(try_cast(row.duration as double) >= 1000000, try_cast(row.duration as double) / 1000000, try_cast(row.duration as double)))::bigint, 0), 0))"""
_NANOS = "try_cast(row.timeUnixNano as bigint)"
_TIME = f"""coalesce({_pair_ms('row.startTime')}, {_pair_ms('row.endTime')} - coalesce({_DURATION}, 0), {_pair_ms('row.hrTime')}, {_pair_ms('row._hrTime')}, {_pair_ms('row.time')},
 {_scalar_ms('row.timestamp')}, {_scalar_ms('row.observedTimestamp')}, if({_NANOS} > 0, {_NANOS} div 1000000, null))"""
_IS_SPAN = """(row.type <=> 'span' or row.type is null and row.name is not null and coalesce(row.spanId, row.traceId, row.startTime, row.endTime, row.duration, row.kind) is not null)"""
_LANE = f"""case when {_IS_SPAN} then case when {_attribute('gen_ai.operation.name')} <=> 'chat' or row.name like 'chat %' then 0 when {_attribute('gen_ai.operation.name')} <=> 'invoke_agent' or row.name like 'invoke\\_agent %' then 3 end
 when {_attribute('event.name')} <=> 'gen_ai.client.inference.operation.details' or startswith(coalesce(row.body, row._body), 'GenAI inference:') then 1
 when {_attribute('event.name')} <=> 'copilot_chat.agent.turn' or startswith(coalesce(row.body, row._body), 'copilot_chat.agent.turn') then 2 end"""


def span_records(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """One row a record of a trace, with what it says of trace, span, model, session, agent, times and counts; lane is the kind of a record that reports use, null for others."""
    rows = _records(spark, root, glob, _SPAN)
    got = lambda keys: f"coalesce({', '.join(f'nullif(greatest({whole(_attribute(k))}, 0), 0)' for k in keys)}, 0)"
    rank = "case " + " ".join(f"when {said(_attribute(k))} is not null then {r}" for k, r in zip(_SESSION, _SESSION_RANK)) + " end"
    turn = f"coalesce(try_cast({_attribute('turn.index')} as bigint), try_cast({_attribute('copilot_chat.turn.index')} as bigint))"
    columns = {
        "lane": _LANE, "trace": _identity("traceId"), "span": _identity("spanId"), "parent": _identity("parentSpanId"), "model": _first_said(_MODEL), "session": _first_said(_SESSION), "session_rank": rank,
        "agent": _first_said(["gen_ai.agent.id"]), "response": said(_attribute("gen_ai.response.id")), "turn": turn, "told_ms": _TIME, "duration_ms": _DURATION, "start_ms": _pair_ms("row.startTime"), "end_ms": _pair_ms("row.endTime"), **{k: got(v) for k, v in _COUNTS.items()},
    }
    return rows.select("path", "modified_ms", "place", F.expr("row.attributes is not null").alias("told"), *[F.expr(v).alias(k) for k, v in columns.items()])


def trace_contexts(records: DataFrame) -> DataFrame:
    """path, trace and what its records say together: trace_model (the first), trace_session (the first of the best kind) and trace_agent.

    A trace's agent is that of its outermost invocation, told by the spans' parents wherever they stand in the file;
    without one that names an agent, that of any invocation, and else the first that any record names.
    """
    scope = ["path", "trace"]
    known = records.where("trace is not null")
    invoked = known.where("lane = 3 and told and span is not null")
    spans = known.where("span is not null").select(*scope, "span", "parent", F.coalesce(F.col("lane") == 3, F.lit(False)).alias("invokes"))
    inner = trees.below_marked(spans, scope, "span", "parent", "invokes")
    outer = invoked.where("agent is not null").join(inner, [*scope, "span"]).groupBy(*scope).agg(F.min_by("agent", F.struct("below", "place")).alias("invoked"))
    first = lambda c, order="place": F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order) if isinstance(order, str) else order))
    told = known.where("told").groupBy(*scope).agg(first("model").alias("trace_model"), first("session", F.struct(-F.col("session_rank"), F.col("place"))).alias("trace_session"), first("agent").alias("first_agent"))
    return told.join(outer, scope, "left").select(*scope, "trace_model", "trace_session", F.coalesce("invoked", "first_agent").alias("trace_agent"))


def span_usage(records: DataFrame) -> DataFrame:
    """One row a use: of records that report the same, the most exact kind counts, and repeated reports of one span become one with the largest counts."""
    used = records.where("told and lane is not null and greatest(prompt, output, cache_read, cache_write, reasoning) > 0")
    resolved = used.join(trace_contexts(records), ["path", "trace"], "left")
    resolved = resolved.withColumns({"model": F.coalesce("model", "trace_model", F.lit("unknown")), "session": F.coalesce("session", "trace_session", "trace", F.lit("unknown-session")), "direct": F.col("agent").isNotNull(), "agent": F.coalesce("agent", "trace_agent"), "at": F.coalesce("told_ms", "modified_ms")})
    exact = mg.best_lane(resolved, "lane", ["path"], ["trace", "response"])
    spot = "session || ':' || at || ':' || place"
    key = f"""case when lane in (0, 3) then case when trace is not null and span is not null then trace || ':' || span when span is not null then 'span:' || session || ':' || span else 'span:' || {spot} end
 when lane = 1 then if(trace is not null and span is not null, 'log:' || trace || ':' || span, 'log:' || {spot})
 when trace is not null then 'agent-turn:' || trace || ':' || coalesce(turn, 'idx-' || place) else 'agent-turn:' || session || ':' || coalesce(turn, 'idx-' || place) || ':' || place end"""
    # an end alone is no start; a time alone is one
    begun = F.coalesce("start_ms", F.expr("if(duration_ms is not null or end_ms is null, told_ms, null)"))
    keyed = exact.withColumns({"key": F.expr(key), "begun": begun})
    first = lambda c: F.min_by(c, "place").alias(c)
    merged = keyed.groupBy("path", "key").agg(*[F.max(c).alias(c) for c in _COUNTS], F.coalesce(F.min("begun"), F.min("at")).alias("at"), first("model"), first("session"), F.min_by("agent", F.when(F.length("agent") > 0, F.struct(~F.col("direct"), F.col("agent")))).alias("agent"), F.min("place").alias("place"), first("modified_ms"))
    return merged.withColumns({"cached": F.least("cache_read", "prompt"), "provider": names.resolved_provider(F.lit(None).cast("string"), F.col("model"), "github-copilot")})


# Conversations that branch. A line is a session's head, a change of model, or a message; older writers leave the type out.
_ENTRY = "type string, id string, parentId string, timestamp string, model string, role string, sessionId string, message struct<role string>, usage struct<inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint, costUsd double>"
#: No real count or bill is larger; fixed values of the format's own readers.
_MOST_UNITS, _MOST_COST = 10**12, 10**6


def _characters(value: Column) -> Column:
    """Length of a JSON value as it is written, 0 for empty ones."""
    text = F.to_json(value)
    return F.when(text.isNull() | text.isin("null", '""', "[]", "{}"), 0).otherwise(F.length(text))


def branch_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row a reply that counts, with its session, model, counts and cost.

    A reply that tells no counts is estimated at a unit for four characters of what was said since the one before, and
    of itself. Replies on branches that were left are dropped; one that neither used nor cost anything is, too.
    """
    rows = _records(spark, root, "*.jsonl", _ENTRY).where("path not like '%.checkpoints.jsonl'")
    parsed = F.try_parse_json("line")
    content = F.coalesce(F.try_variant_get(parsed, "$.message.content", "variant"), F.when(F.col("row.message").isNull(), F.try_variant_get(parsed, "$.content", "variant")))
    rows = rows.select("path", "modified_ms", "place", "row", _characters(content).alias("characters"), F.expr("nullif(row.id, '')").alias("id"), F.expr("nullif(row.parentId, '')").alias("parent"), F.expr("coalesce(row.message.role, if(row.message is null, row.role, null))").alias("role"))
    here = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "head": F.last(F.expr("if(row.type = 'session', id, null)"), ignorenulls=True).over(here),
        "older": F.first(F.expr("if(row.type <=> 'session', null, nullif(row.sessionId, ''))"), ignorenulls=True).over(here),
        "known": F.last(F.expr("nullif(row.model, '')"), ignorenulls=True).over(here),
        "said": F.coalesce(F.col("role") != "assistant", F.lit(False)) & ~F.coalesce(F.col("row.type") == "model_change", F.lit(False)),
        "turn": F.count(F.when((F.col("role") == "assistant") & ~F.coalesce(F.col("row.type") == "model_change", F.lit(False)), 1)).over(before),
    })
    heard = F.sum(F.when(F.col("said"), F.col("characters")).otherwise(0)).over(Window.partitionBy("path", "turn"))
    replies = rows.withColumn("heard", heard).where("role = 'assistant' and not (row.type <=> 'model_change')")
    told = "(row.usage is not null and coalesce(row.usage.inputTokens, row.usage.outputTokens, row.usage.cacheReadTokens, row.usage.cacheWriteTokens) is not null)"
    count = lambda name: f"least(greatest(coalesce(row.usage.{name}, 0), 0), {_MOST_UNITS})"
    replies = replies.withColumns({
        "cache_read": F.expr(f"if({told}, {count('cacheReadTokens')}, 0)"), "cache_write": F.expr(f"if({told}, {count('cacheWriteTokens')}, 0)"),
        "input": F.expr(f"if({told}, greatest({count('inputTokens')} - {count('cacheReadTokens')} - {count('cacheWriteTokens')}, 0), ceil(heard / 4))"),
        "output": F.expr(f"if({told}, {count('outputTokens')}, ceil(characters / 4))"),
        "cost": F.expr(f"if(row.usage.costUsd between 0 and {_MOST_COST}, row.usage.costUsd, null)"),
    }).where("greatest(input, output, cache_read, cache_write) > 0 or cost > 0")
    active = trees.on_last_branch(rows.where("id is not null").select("path", "id", "parent", "place"), ["path"], "id", "parent", "place")
    kept = replies.join(active.where("not active").select("path", "id"), ["path", "id"], "left_anti")
    # the model of a home's settings, for logs that name none
    settings = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "config.json").option("wholetext", "true").text(root)
    configured = settings.select(F.regexp_replace(F.regexp_replace(text_path(), "^file:/+", "/"), "/[^/]*$", "").alias("home"), F.get_json_object("value", "$.model").alias("configured")).where("trim(configured) <> ''")
    kept = kept.withColumn("home", F.expr("regexp_extract(regexp_replace(path, '^file:/+', '/'), '^(.*)/projects/', 1)")).join(configured, "home", "left")
    raw = F.coalesce("known", "configured", F.lit("unknown"))
    return kept.withColumns({"raw": raw, "provider": names.resolved_provider(F.lit(None).cast("string"), raw, "command-code"), "session": F.coalesce("head", "older", F.expr(STEM)), "stamp": F.expr("unix_millis(try_to_timestamp(row.timestamp))")})


# Totals of a session that are shared out over its transcript. Most parts of a session, lines in which a model is looked for, and models of providers that name none.
MOST_PARTS, _HEAD_LINES = 1024, 500
_UNNAMED = {"anthropic": "claude-unknown", "openai": "gpt-unknown", "google": "gemini-unknown", "xai": "grok-unknown"}
_SETTINGS = "model string, providerLock string, providerLockTimestamp string, tokenUsage struct<inputTokens bigint, outputTokens bigint, cacheCreationTokens bigint, cacheReadTokens bigint, thinkingTokens bigint>"


def _plain_model(model: Column) -> Column:
    """Lower case with hyphens alone, without a mark of custom models and what stands in brackets."""
    bare = F.regexp_replace(F.regexp_replace(model, "^custom:", ""), r"\[[^\]]*\]?", "")
    return F.regexp_replace(F.replace(F.lower(F.regexp_replace(F.replace(bare, F.lit("]"), F.lit("")), "-+$", "")), F.lit("."), F.lit("-")), "-+", "-")


def shared_out(parts: DataFrame, key: str, order: str, totals: dict[str, str]) -> DataFrame:
    """parts with each total of their key, in whole numbers by weights, so that they add up to it exactly; totals maps a total's column to its weight's.

    A part gets what the total's share up to it exceeds the share up to the one before.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_ = Window.partitionBy(key)
    shares = {f"__{t}": F.floor(wide(t) * F.sum(w).over(upto).cast("decimal(19,0)") / F.sum(w).over(whole_).cast("decimal(19,0)")).cast("long") for t, w in totals.items()}
    found = parts.withColumns(shares)
    return found.withColumns({t: F.col(f"__{t}") - F.coalesce(F.lag(f"__{t}").over(Window.partitionBy(key).orderBy(order)), F.lit(0)) for t in totals}).drop(*shares)


def transcript_parts(lines: DataFrame, most: int = MOST_PARTS) -> DataFrame:
    """stem, part, at, context, spoken and replies of each transcript: its replies in order, neighbours joined so that there are at most so many.

    What a reply read is the length of all lines before it, from the last compaction on; what it said is that of its
    own line. lines: stem, place, line.
    """
    row = F.from_json("line", "type string, timestamp string, message struct<role string>")
    rows = lines.select("stem", "place", F.octet_length("line").cast("long").alias("size"), row.alias("row"))
    here = Window.partitionBy("stem").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("since", F.count(F.when(F.col("row.type") == "compaction_state", 1)).over(here))
    read = F.coalesce(F.sum("size").over(Window.partitionBy("stem", "since").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = rows.withColumns({"read": read, "at": epoch_ms(F.col("row.timestamp"))}).where("row.type = 'message' and row.message.role = 'assistant' and at > 0")
    numbered = told.withColumns({"nth": F.row_number().over(Window.partitionBy("stem").orderBy("place")) - 1, "n": F.count("*").over(Window.partitionBy("stem"))})
    joined = numbered.withColumn("part", F.expr(f"nth div cast(ceil(n / {most}) as int)")).groupBy("stem", "part")
    return joined.agg(F.max("at").alias("at"), F.sum(F.greatest("read", F.lit(1))).alias("context"), F.sum(F.greatest("size", F.lit(1))).alias("spoken"), F.count("*").alias("replies"))


def transcript_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row a part of a session's transcript with its share of the session's totals; one in all for a session without a transcript that tells times."""
    stem = r"regexp_replace(regexp_replace(path, '^file:/+', '/'), '[.](settings[.]json|jsonl)$', '')"
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.settings.json").option("wholetext", "true").text(root)
    settings = text.select(text_path().alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"), F.from_json("value", _SETTINGS).alias("row")).where("row.tokenUsage is not null").withColumn("stem", F.expr(stem))
    counts = {"input": "inputTokens", "output": "outputTokens", "cache_read": "cacheReadTokens", "cache_write": "cacheCreationTokens", "reasoning": "thinkingTokens"}
    settings = settings.where(" + ".join(f"coalesce(row.tokenUsage.{c}, 0)" for c in counts.values()) + " <> 0").withColumns({k: F.expr(f"greatest(coalesce(row.tokenUsage.{c}, 0), 0)") for k, c in counts.items()})
    lines = lossy_lines(spark, root, "*.jsonl").select(F.expr(stem).alias("stem"), "place", "line").join(settings.select("stem"), "stem", "left_semi")
    # the model that a transcript's first lines name
    head = lines.withColumn("nth", F.row_number().over(Window.partitionBy("stem").orderBy("place"))).where(f"nth <= {_HEAD_LINES}").withColumn("said", F.trim(F.regexp_extract("line", r'Model:([^\[\\"]*)', 1))).where("said <> ''")
    said_model = head.groupBy("stem").agg(F.min_by("said", "place").alias("said"))
    parts = transcript_parts(lines)
    sessions = settings.join(said_model, "stem", "left")
    provider = F.coalesce("row.providerLock", names.inferred_provider(F.col("row.model")), F.lit("unknown"))
    unnamed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _UNNAMED.items() for x in pair]), F.coalesce(names.canonical_provider(F.col("provider")), F.col("provider"))), F.concat("provider", F.lit("-unknown")))
    sessions = sessions.withColumn("provider", provider).withColumn("model", F.coalesce(_plain_model(F.col("row.model")), _plain_model(F.col("said")), unnamed))
    dealt = shared_out(sessions.join(parts, "stem"), "stem", "part", {k: "spoken" if k in ("output", "reasoning") else "context" for k in counts})
    dealt = dealt.withColumn("count", F.when(F.col("part") == 0, F.sum("replies").over(Window.partitionBy("stem"))).otherwise(0))
    locked = epoch_ms(F.col("row.providerLockTimestamp"))
    alone = sessions.join(parts.select("stem").distinct(), "stem", "left_anti").withColumns({"at": F.greatest("modified_ms", F.when(locked > 0, locked)), "count": F.lit(1).cast("long"), "part": F.lit(0)})
    columns = ["path", "modified_ms", "stem", "part", "provider", "model", "at", "count", *counts]
    return dealt.select(*columns).unionByName(alone.select(*columns))


TRANSCRIPTS: dict[str, Adapter] = {
    "droid": Adapter(
        "droid", "*.settings.json", "document", read=transcript_rows, told=True, used="true",
        columns={"session_id": "regexp_extract(stem, '([^/]*)$', 1)", "message_id": "cast(part as string)", "model_id": "model", "provider_id": "provider", "time": "cast(at as string)", **{k: k for k in ("input", "output", "cache_read", "cache_write", "reasoning")}, "message_count": "count"},
    ),
    "copilot": Adapter(
        "copilot", "*.jsonl", "lines", read=lambda spark, root: span_usage(span_records(spark, root, "*.jsonl")), told=True,
        columns={"session_id": "session", "message_id": "key", "model_id": "model", "provider_id": "provider", "time": "cast(at as string)", "input": "prompt - cached", "output": "output", "cache_read": "cache_read", "cache_write": "cache_write", "reasoning": "reasoning", "dedup_key": "key"},
    ),
    "commandcode": Adapter(
        "commandcode", "*.jsonl", "lines", read=branch_rows, told=True, used="true",
        columns={"session_id": "session", "message_id": "id", "model_id": "regexp_extract(raw, '([^/]*)$', 1)", "provider_id": "provider", "time": "coalesce(cast(stamp as string), cast(modified_ms as string))", "input": "input", "output": "output", "cache_read": "cache_read", "cache_write": "cache_write", "cost": "cost",
                 "dedup_key": "coalesce(id || ':' || coalesce(stamp, -1), home || ':' || session || ':' || place)"},
    ),
}
