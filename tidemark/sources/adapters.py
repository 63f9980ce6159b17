"""Usage facts from vendors' logs: an adapter says where the files are, how they are read and what each column means.

Every adapter gives client, session_id, message_id, model_id, provider_id, timestamp_ms, the five kinds of units, cost,
message_count, dedup_key and path. A row that is no usage is left out; a file that cannot be read loses only itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import names
from tidemark.operators import counters
from tidemark.sources.logs import epoch_ms
from tidemark.sources.reading import lossy_lines, sqlite_rows

FACTS = ("client", "session_id", "message_id", "model_id", "provider_id", "timestamp_ms", "input", "output", "cache_read", "cache_write", "reasoning", "cost", "message_count", "dedup_key", "path")


def text_path() -> Column:
    """A text file's path as the other readers spell it: Spark gives it encoded as a URL."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, size and time of each file below root whose name fits."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))


def pruned(listed: DataFrame, parts: list[str]) -> DataFrame:
    """Files in none of these folders."""
    return listed.where(~F.exists(F.split("path", "/"), lambda p: p.isin(parts))) if parts else listed


def sources(listed: dict[str, DataFrame], claims: list[str] | None = None) -> DataFrame:
    """client and path of all clients' files, each path once a client; a path that a client of claims has goes to no other, the first claim counting."""
    found = None
    for client, frame in listed.items():
        part = frame.select(F.lit(client).alias("client"), F.regexp_replace("path", "/+", "/").alias("path"))
        found = part if found is None else found.unionByName(part)
    found = found.dropDuplicates(["client", "path"])
    for k, client in enumerate(claims or []):
        free = [*(claims or [])[: k + 1]]
        claimed = found.where(F.col("client") == client).select("path")
        found = found.where(F.col("client").isin(free)).unionByName(found.where(~F.col("client").isin(free)).join(claimed, "path", "left_anti"))
    return found


def preferred_format(listed: DataFrame, better: str = "json", worse: str = "csv") -> DataFrame:
    """Files but for those of the worse format that the better one has under the same name."""
    stem, kind = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"\.([^./]*)$", 1)
    marked = listed.withColumns({"__stem": stem, "__kind": kind})
    there = marked.where(F.col("__kind") == better).select("__stem")
    return marked.where(F.col("__kind") != worse).unionByName(marked.where(F.col("__kind") == worse).join(there, "__stem", "left_anti").select(marked.columns)).drop("__stem", "__kind")


def fingerprints(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, size, time and content hash of each file: what tells whether it must be read again."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), F.sha2("content", 256).alias("hash"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or whose content is another."""
    return now.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


@dataclass(frozen=True)
class Adapter:
    """columns: SQL over the source's columns path, place, modified_ms and row (a parsed JSON value; kind text: a struct of the line); keep: which rows are usage."""

    client: str
    glob: str
    kind: str
    schema: str = ""
    keep: str = "true"
    columns: dict[str, str] = field(default_factory=dict)
    statement: str | list[str] = ""
    #: a text in row that is JSON again, and its schema: parsed as d
    inner: str = ""
    inner_schema: str = ""
    #: an array in row, each element of which is d
    each: str = ""
    #: applied to the rows first, for what other rows of the file tell; then columns by name, each seeing those before it
    prepare: Callable[[DataFrame], DataFrame] | None = None
    also: dict[str, str] = field(default_factory=dict)
    #: gives the rows where one file alone does not
    read: Callable[[SparkSession, str], DataFrame] | None = None
    #: the provider where nothing tells it; told: provider_id is taken as it stands
    fallback: str = "unknown"
    told: bool = False
    #: which facts count
    used: str = "greatest(input, output, cache_read, cache_write, reasoning) > 0"
    #: applied to the facts; for what no single row tells
    fold: Callable[[DataFrame], DataFrame] | None = None


def _by_larger(facts: DataFrame) -> DataFrame:
    """Reports of one message, which only grow, become one with the largest of each kind; rows without a key stay."""
    kinds = ["input", "output", "cache_read", "cache_write", "reasoning", "cost", "timestamp_ms"]
    rest = [c for c in FACTS if c not in kinds and c != "dedup_key"]
    one = facts.where("dedup_key is not null").groupBy("dedup_key").agg(*[F.max(k).alias(k) for k in kinds], *[F.min(c).alias(c) for c in rest])
    return facts.where("dedup_key is null").unionByName(one.select(*FACTS))


_CODEX = "timestamp string, type string, payload struct<model string, type string, info struct<total_token_usage struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint>, last_token_usage struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint>>>"
_CLAUDE = "type string, timestamp string, requestId string, sessionId string, message struct<id string, model string, usage struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint>>"
_PI = "type string, id string, timestamp string, message struct<role string, model string, provider string, timestamp bigint, usage struct<input bigint, output bigint, cacheRead bigint, cacheWrite bigint, reasoning bigint, cost struct<total double>>>"
_PI_COLUMNS = {"session_id": "regexp_extract(path, '([^/]+)\\\\.jsonl$', 1)", "message_id": "row.id", "model_id": "row.message.model", "provider_id": "row.message.provider", "time": "coalesce(cast(row.message.timestamp as string), row.timestamp)", "input": "row.message.usage.input", "output": "row.message.usage.output", "cache_read": "row.message.usage.cacheRead", "cache_write": "row.message.usage.cacheWrite", "reasoning": "row.message.usage.reasoning", "cost": "row.message.usage.cost.total", "dedup_key": "regexp_extract(path, '([^/]+)\\\\.jsonl$', 1) || ':' || row.id"}
#: Usage of sessions: by model where a build records that, else the session's own totals; a session's messages go with its own model first.
_HERMES_USED = "input > 0 or output > 0 or cache_read > 0 or cache_write > 0 or reasoning > 0 or cost > 0"
_HERMES_TOTALS = "select id as session_id, model, billing_provider as provider, started_at, message_count as messages, coalesce(input_tokens, 0) as input, coalesce(output_tokens, 0) as output, coalesce(cache_read_tokens, 0) as cache_read, coalesce(cache_write_tokens, 0) as cache_write, coalesce(reasoning_tokens, 0) as reasoning, coalesce(actual_cost_usd, estimated_cost_usd, 0) as cost from sessions where trim(model) <> ''"
_HERMES_MODELS = f"""with each as (select u.session_id, u.model, u.billing_provider as provider, s.started_at, s.model as main, coalesce(s.message_count, 0) as all_messages, sum(u.input_tokens) as input, sum(u.output_tokens) as output, sum(u.cache_read_tokens) as cache_read,
 sum(u.cache_write_tokens) as cache_write, sum(u.reasoning_tokens) as reasoning, sum(coalesce(nullif(u.actual_cost_usd, 0), u.estimated_cost_usd, 0)) as cost from session_model_usage u join sessions s on s.id = u.session_id where trim(u.model) <> '' group by 1, 2, 3, 4, 5, 6),
 used as (select *, row_number() over (partition by session_id order by model <> main, model, provider) as nth from each where {_HERMES_USED})
select session_id, model, provider, started_at, case nth when 1 then all_messages else 0 end as messages, input, output, cache_read, cache_write, reasoning, cost from used
union all select * from ({_HERMES_TOTALS} and id not in (select session_id from session_model_usage)) where {_HERMES_USED}"""
_HERMES = [_HERMES_MODELS, f"select * from ({_HERMES_TOTALS}) where {_HERMES_USED}"]
#: builds that do not count messages
_HERMES += [asked.replace("coalesce(s.message_count, 0)", "1").replace("message_count as messages", "1 as messages") for asked in _HERMES]
_OPENCODE = [
    # the second schema, then the first; of each the variant that the database has
    *(f"select m.id, m.session_id, m.data, {title} as title from session_message m{join} where m.type = 'assistant' and json_extract(m.data, '$.tokens') is not null order by m.id, m.session_id" for join, title in ((" left join session_v2 s on s.id = m.session_id", "s.title"), (" left join session s on s.id = m.session_id", "s.title"), ("", "null"))),
    *(f"select m.id, m.session_id, m.data, {title} as title from message m{join} where json_extract(m.data, '$.role') = 'assistant' and json_extract(m.data, '$.tokens') is not null order by m.id, m.session_id" for join, title in ((" left join session s on s.id = m.session_id", "s.title"), ("", "null"))),
]
_OPENCODE_ROW = "modelID string, providerID string, cost double, time struct<created bigint>, tokens struct<input bigint, output bigint, reasoning bigint, cache struct<read bigint, write bigint>>"
_OPENCODE_COLUMNS = {"session_id": "row.session_id", "message_id": "row.id", "model_id": "d.modelID", "provider_id": "d.providerID", "time": "cast(d.time.created as string)", "input": "d.tokens.input", "output": "d.tokens.output", "cache_read": "d.tokens.cache.read", "cache_write": "d.tokens.cache.write", "reasoning": "d.tokens.reasoning", "cost": "d.cost", "dedup_key": "row.id"}
_MUX = "struct<tokens bigint, cost_usd double>"
_GOOSE = "select id, model_config_json, provider_name, created_at, coalesce(accumulated_total_tokens, total_tokens, 0) as total, coalesce(accumulated_input_tokens, input_tokens, 0) as input, coalesce(accumulated_output_tokens, output_tokens, 0) as output from sessions where trim(model_config_json) <> ''"
_CHAT = "variant string, timestamp string, metadata struct<model string, usage struct<inputTokens bigint, outputTokens bigint, cacheCreationInputTokens bigint, cacheReadInputTokens bigint>>"

ADAPTERS = {
    "codex": Adapter("codex", "*.jsonl*", "lines", _CODEX, fold=None),
    "claude": Adapter("claude", "*.jsonl", "lines", _CLAUDE, "row.type = 'assistant' and row.message.usage is not null", {"session_id": "coalesce(row.sessionId, regexp_extract(path, '([^/]+)\\\\.jsonl$', 1))", "message_id": "row.message.id", "model_id": "row.message.model", "provider_id": "'anthropic'", "time": "row.timestamp", "input": "row.message.usage.input_tokens", "output": "row.message.usage.output_tokens", "cache_read": "row.message.usage.cache_read_input_tokens", "cache_write": "row.message.usage.cache_creation_input_tokens", "dedup_key": "case when row.requestId is not null then row.message.id || ':' || row.requestId else 'message:' || row.message.id end"}, fold=_by_larger),
    "codebuff": Adapter("codebuff", "chat-messages.json", "array", _CHAT, "row.variant = 'ai' and row.metadata.usage is not null", {"session_id": "regexp_extract(path, '/chats/([^/]+)/', 1)", "model_id": "row.metadata.model", "time": "row.timestamp", "input": "row.metadata.usage.inputTokens", "output": "row.metadata.usage.outputTokens", "cache_read": "row.metadata.usage.cacheReadInputTokens", "cache_write": "row.metadata.usage.cacheCreationInputTokens"}),
    "hermes": Adapter("hermes", "state.db", "sqlite", "session_id string, model string, provider string, started_at double, messages bigint, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, cost double", columns={"session_id": "row.session_id", "model_id": "row.model", "provider_id": "row.provider", "time": "cast(row.started_at as string)", "input": "row.input", "output": "row.output", "cache_read": "row.cache_read", "cache_write": "row.cache_write", "reasoning": "row.reasoning", "cost": "row.cost", "message_count": "row.messages", "dedup_key": "'hermes:' || row.session_id || ':' || row.model || ':' || coalesce(row.provider, '<null>')"}, statement=_HERMES, used="true"),
    **{client: Adapter(client, glob, "sqlite", "id string, session_id string, data string", columns=_OPENCODE_COLUMNS, statement=_OPENCODE, inner="row.data", inner_schema=_OPENCODE_ROW) for client, glob in (("opencode", "*.db"), ("kilo", "kilo.db"), ("micode", "*.db"))},
    **{client: Adapter(client, "ui_messages.json", "array", "type string, say string, text string, ts string, modelInfo struct<providerId string, modelId string>", "row.type = 'say' and row.say = 'api_req_started' and row.ts is not null", {"session_id": "regexp_extract(path, '([^/]+)/[^/]+$', 1)", "model_id": "coalesce(nullif(trim(row.modelInfo.modelId), ''), 'unknown')", "provider_id": "coalesce(d.apiProtocol, row.modelInfo.providerId)", "time": "row.ts", "input": "d.tokensIn", "output": "d.tokensOut", "cache_read": "d.cacheReads", "cache_write": "d.cacheWrites", "cost": "greatest(d.cost, 0)"}, inner="row.text", inner_schema="tokensIn bigint, tokensOut bigint, cacheReads bigint, cacheWrites bigint, cost double, apiProtocol string") for client in ("roocode", "kilocode", "cline")},
    "qwen": Adapter("qwen", "*.jsonl", "lines", "type string, model string, timestamp string, sessionId string, usageMetadata struct<promptTokenCount bigint, candidatesTokenCount bigint, thoughtsTokenCount bigint, cachedContentTokenCount bigint>", "row.type = 'assistant' and row.usageMetadata is not null", {"session_id": "coalesce(nullif(row.sessionId, ''), regexp_extract(path, '([^/]+)/[^/]+/[^/]+$', 1) || '-' || regexp_extract(path, '([^/]+)\\.jsonl$', 1))", "model_id": "coalesce(row.model, 'unknown')", "provider_id": "'qwen'", "time": "row.timestamp", "input": "row.usageMetadata.promptTokenCount", "output": "row.usageMetadata.candidatesTokenCount", "cache_read": "row.usageMetadata.cachedContentTokenCount", "reasoning": "row.usageMetadata.thoughtsTokenCount", "dedup_key": "'qwen:' || path || ':' || place"}),
    "mux": Adapter("mux", "session-usage.json", "document", f"byModel map<string, struct<input {_MUX}, cached {_MUX}, cacheCreate {_MUX}, output {_MUX}, reasoning {_MUX}>>, lastRequest struct<timestamp bigint>", columns={"session_id": "regexp_extract(path, '([^/]+)/[^/]+$', 1)", "model_id": "regexp_replace(d.key, '^[^:]*:', '')", "provider_id": "regexp_extract(d.key, '^([^:]*):', 1)", "time": "cast(row.lastRequest.timestamp as string)", "input": "d.value.input.tokens", "output": "d.value.output.tokens", "cache_read": "d.value.cached.tokens", "cache_write": "d.value.cacheCreate.tokens", "reasoning": "d.value.reasoning.tokens", "cost": " + ".join(f"coalesce(d.value.{k}.cost_usd, 0)" for k in ("input", "cached", "cacheCreate", "output", "reasoning")), "dedup_key": "'mux:' || regexp_extract(path, '([^/]+)/[^/]+$', 1) || ':' || d.key"}, each="map_entries(row.byModel)"),
    "hindsight": Adapter("hindsight", "*.jsonl", "lines", "id string, trace_id string, provider string, model string, started_at string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, total_tokens bigint", "coalesce(row.total_tokens, 1) > 0 and row.started_at is not null and (row.input_tokens > 0 or row.output_tokens > 0)", {"session_id": "coalesce(nullif(trim(row.trace_id), ''), row.id)", "message_id": "row.id", "model_id": "row.model", "provider_id": "row.provider", "time": "row.started_at", "input": "row.input_tokens", "output": "row.output_tokens", "cache_read": "row.cached_tokens", "dedup_key": "row.id"}),
    "goose": Adapter("goose", "sessions.db", "sqlite", "id string, model_config_json string, provider_name string, created_at string, total bigint, input bigint, output bigint", "d.model_name is not null and trim(d.model_name) <> '' and (row.input > 0 or row.output > 0 or row.total > 0)", {"session_id": "row.id", "model_id": "trim(d.model_name)", "provider_id": "row.provider_name", "time": "row.created_at", "input": "row.input", "output": "row.output", "reasoning": "row.total - greatest(row.input, 0) - greatest(row.output, 0)", "dedup_key": "row.id"}, statement=_GOOSE, inner="row.model_config_json", inner_schema="model_name string"),
    "amp": Adapter("amp", "T-*.json", "document", "id string, created bigint, messages array<struct<role string, messageId bigint, usage struct<model string, inputTokens bigint, outputTokens bigint, cacheReadInputTokens bigint, cacheCreationInputTokens bigint>>>", columns={"session_id": "row.id", "message_id": "cast(d.messageId as string)", "model_id": "d.usage.model", "time": "cast(row.created as string)", "input": "d.usage.inputTokens", "output": "d.usage.outputTokens", "cache_read": "d.usage.cacheReadInputTokens", "cache_write": "d.usage.cacheCreationInputTokens", "dedup_key": "row.id || ':' || d.messageId"}, keep="d.usage is not null", each="row.messages"),
    "cursor": Adapter("cursor", "usage*.json", "document", "usageEventsDisplay array<struct<conversationId string, timestamp string, model string, chargedCents double, tokenUsage struct<inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint, totalCents double>>>", "trim(d.model) <> '' and d.timestamp is not null", {"session_id": "coalesce(nullif(trim(d.conversationId), ''), 'cursor-' || regexp_extract(path, '([^/]+)\\.json$', 1))", "model_id": "trim(d.model)", "time": "d.timestamp", "input": "d.tokenUsage.inputTokens", "output": "d.tokenUsage.outputTokens", "cache_read": "d.tokenUsage.cacheReadTokens", "cache_write": "d.tokenUsage.cacheWriteTokens", "cost": "coalesce(d.chargedCents, d.tokenUsage.totalCents) / 100"}, each="row.usageEventsDisplay"),
    "opencodereview": Adapter("opencodereview", "*.jsonl", "lines", "type string, timestamp string, model string, duration_ms bigint, usage struct<prompt_tokens bigint, completion_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint>", "row.type = 'llm_response' and row.usage is not null", {"session_id": "regexp_extract(path, '([^/]+)\\.jsonl$', 1)", "model_id": "coalesce(row.model, 'unknown')", "time": "row.timestamp", "input": "row.usage.prompt_tokens", "output": "row.usage.completion_tokens", "cache_read": "row.usage.cache_read_tokens", "cache_write": "row.usage.cache_write_tokens", "dedup_key": "path || ':' || place"}),
    # one format, written under several names
    **{client: Adapter(client, "*.jsonl", "lines", _PI, "row.type = 'message' and row.message.role = 'assistant' and row.message.usage is not null", _PI_COLUMNS, fold=_by_larger) for client in ("pi", "gjc", "senpi", "kimchi", "omp", "craft-agent")},
}


def _rows(spark: SparkSession, adapter: Adapter, root: str) -> DataFrame:
    """path, place and row (and d, the parsed data column of a database) of each JSON value that parses."""
    if adapter.read:
        return adapter.read(spark, root)
    if adapter.kind in ("array", "document"):
        whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", adapter.glob).option("wholetext", "true").text(root).select(text_path().alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"), "value")
        shape = _typed(adapter.schema)
        parsed = F.posexplode(F.from_json("value", f"array<struct<{shape}>>")).alias("place", "row") if adapter.kind == "array" else F.from_json("value", f"struct<{shape}>").alias("row")
        rows = whole.select("path", "modified_ms", parsed).where("row is not null")
    else:
        lines = sqlite_rows(spark, root, adapter.glob, adapter.statement) if adapter.kind == "sqlite" else lossy_lines(spark, root, adapter.glob)
        parsed = F.struct("line") if adapter.kind == "text" else F.from_json("line", f"{adapter.schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        rows = lines.select("path", "modified_ms", "place", parsed.alias("row"))
        rows = rows if adapter.kind == "text" else rows.where("row is not null and row._corrupt is null")
    if adapter.each:
        rows = rows.select("*", F.explode(F.expr(adapter.each)).alias("d"))
    return rows.withColumn("d", F.from_json(F.expr(adapter.inner), adapter.inner_schema)).where("d is not null") if adapter.inner else rows


def _typed(ddl: str) -> str:
    """Top-level fields of a DDL string as those of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def facts(spark: SparkSession, client: str, root: str) -> DataFrame:
    """The usage facts of a client's files below root, in all formats that the client writes."""
    from tidemark.sources import formats, histories, lineages, records, transcripts

    known = (ADAPTERS | formats.FORMATS | histories.FORMATS | transcripts.TRANSCRIPTS | records.RECORDS | lineages.LINEAGES)[client]
    return reduce(DataFrame.unionByName, [_facts(spark, adapter, root) for adapter in (known if isinstance(known, tuple) else (known,))])


def _facts(spark: SparkSession, adapter: Adapter, root: str) -> DataFrame:
    client, rows = adapter.client, _rows(spark, adapter, root)
    if client == "codex":
        return _codex(rows)
    rows = adapter.prepare(rows) if adapter.prepare else rows
    for name, value in adapter.also.items():
        rows = rows.withColumn(name, F.expr(value))
    get = lambda name, kind: F.expr(adapter.columns[name]).cast(kind) if name in adapter.columns else F.lit(None).cast(kind)
    units = {k: F.greatest(F.coalesce(get(k, "long"), F.lit(0)), F.lit(0)) for k in ("input", "output", "cache_read", "cache_write", "reasoning")}
    found = rows.where(adapter.keep).select(
        F.lit(client).alias("client"), *[get(c, "string").alias(c) for c in ("session_id", "message_id", "model_id")],
        (get("provider_id", "string") if adapter.told else names.resolved_provider(get("provider_id", "string"), get("model_id", "string"), adapter.fallback)).alias("provider_id"), epoch_ms(get("time", "string")).alias("timestamp_ms"),
        *[u.alias(k) for k, u in units.items()], get("cost", "double").alias("cost"), F.coalesce(get("message_count", "long"), F.lit(1)).alias("message_count"), get("dedup_key", "string").alias("dedup_key"), "path",
    ).select(*FACTS)
    used = found.where(adapter.used)
    return adapter.fold(used) if adapter.fold else used


def _codex(rows: DataFrame) -> DataFrame:
    """Counters that grow along a log: each report's own part, with the model that was last told."""
    info = "row.payload.info"
    told = rows.where("row.type = 'event_msg' and row.payload.type = 'token_count' and row.payload.info is not null")
    parts = {"input": "input_tokens", "output": "output_tokens", "cached": "cached_input_tokens", "reasoning": "reasoning_output_tokens"}
    reports = told.select("path", "place", *[F.col(f"{info}.{kind}_token_usage.{name}").alias(f"{kind}_{p}") for kind in ("total", "last") for p, name in parts.items()])
    upto = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    context = rows.select("path", "place", F.last("row.payload.model", ignorenulls=True).over(upto).alias("model_id"), F.col("row.timestamp").alias("time"))
    found = counters.deltas(reports, "path", "place").join(context, ["path", "place"])
    session = F.regexp_extract("path", r"([^/]+)\.jsonl(\.zst)?$", 1)
    return found.select(F.lit("codex").alias("client"), session.alias("session_id"), F.col("place").cast("string").alias("message_id"), "model_id", F.lit("openai").alias("provider_id"), epoch_ms(F.col("time")).alias("timestamp_ms"), "input", "output", "cache_read", F.lit(0).cast("long").alias("cache_write"), "reasoning", F.lit(None).cast("double").alias("cost"), F.lit(1).cast("long").alias("message_count"), F.lit(None).cast("string").alias("dedup_key"), "path")
