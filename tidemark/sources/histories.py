"""Log formats that are read with the files beside them, or whose counts must be worked out from the conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.sources.adapters import Adapter, text_path
from tidemark.sources.reading import lossy_lines
from tidemark.sources.formats import STEM, said, whole


def _plain(path: str | Column = "path") -> Column:
    """The path in one spelling, whichever reader gave it."""
    return F.regexp_replace(path, "^file:/+", "/")


def documents(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """path, modified_ms, folder and row of whole JSON files that parse."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(root)
    found = text.select(_plain(text_path()).alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"), F.from_json("value", schema).alias("row"))
    return found.where("row is not null").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))


def _up_to_here(*keys: str):
    return Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)


# Names of counts.
_WIRE_UNITS = {"input": ["input_other", "inputOther"], "output": ["output"], "cache_read": ["input_cache_read", "inputCacheRead"], "cache_write": ["input_cache_creation", "inputCacheCreation"]}
_WIRE_USAGE = "struct<" + ", ".join(f"{k} bigint" for ks in _WIRE_UNITS.values() for k in ks) + ">"
_WIRE_TOTAL = " + ".join(whole("coalesce(" + ", ".join(f"u.{k}" for k in ks) + ")") for ks in _WIRE_UNITS.values())


def _wire_rows(spark: SparkSession, root: str) -> DataFrame:
    """Reports of usage with model, time and session: status updates under the model of the folder's settings, of which each message's fullest counts; and the turns of agents, which begin with their last request."""
    shape = f"timestamp double, type string, model string, usageScope string, time bigint, usage {_WIRE_USAGE}, message struct<type string, payload struct<token_usage {_WIRE_USAGE}, message_id string>>"
    rows = lossy_lines(spark, root, "wire.jsonl").select(_plain().alias("path"), "modified_ms", "place", F.from_json("line", shape).alias("row")).where("row is not null")
    agents = "path rlike '/agents/[^/]+/[^/]+$'"
    name = "trim(regexp_replace(trim(row.model), '^kimi-code/', ''))"
    concrete = F.expr(f"if({name} = '' or {name} rlike '^__.*__$', null, {name})")

    turns = rows.where(agents).where("row.type in ('llm.request', 'usage.record')").withColumn("told", concrete)
    asked, closed = F.col("row.type") == "llm.request", F.expr("row.type = 'usage.record' and row.usageScope = 'turn'")
    turns = turns.withColumns({
        "request": F.last(F.when(asked, F.struct("place", F.col("row.time").alias("at"))), ignorenulls=True).over(_up_to_here("path")),
        "ended": F.last(F.when(closed, F.col("place")), ignorenulls=True).over(_before("path")),
        "model": F.last(F.when(asked, F.col("told")), ignorenulls=True).over(_up_to_here("path")),
    }).where(closed)
    began = "if(request.place > coalesce(ended, -1) and request.at > 0 and row.time > request.at, request.at, null)"
    turns = turns.select("path", F.expr("regexp_extract(path, '([^/]+)/agents/[^/]+/[^/]+$', 1)").alias("session"), F.coalesce("told", "model").alias("model"), F.expr(f"coalesce({began}, if(row.time > 0, row.time, null), modified_ms)").alias("at"), F.lit(None).cast("string").alias("id"), F.col("row.usage").alias("u"))

    settings = documents(spark, root, "config.json", "model string").select(F.col("folder").alias("home"), F.col("row.model").alias("model"))
    status = rows.where(f"not ({agents})").where("coalesce(row.type, '') <> 'metadata' and row.message.type = 'StatusUpdate'")
    status = status.select("path", "place", F.expr("if(row.timestamp > 0, cast(row.timestamp * 1000 as bigint), null)").alias("told"), "modified_ms", F.expr("nullif(row.message.payload.message_id, '')").alias("id"), F.col("row.message.payload.token_usage").alias("u")).where("u is not null")
    fullest = Window.partitionBy("path", F.coalesce("id", F.concat(F.lit("/"), "place"))).orderBy(F.expr(_WIRE_TOTAL).desc(), F.col("told").desc_nulls_last(), F.desc("place"))
    status = status.withColumn("__rank", F.row_number().over(fullest)).where("__rank = 1").withColumn("home", F.regexp_replace("path", "(/[^/]+){4}$", ""))
    status = status.join(settings, "home", "left").select("path", F.expr("regexp_extract(path, '([^/]+)/[^/]+$', 1)").alias("session"), F.nullif("model", F.lit("")).alias("model"), F.coalesce("told", "modified_ms").alias("at"), "id", "u")
    return turns.unionByName(status).where("u is not null")


# Spellings of counts.
_ENTRY_UNITS = {
    "i": ["input", "input_tokens", "prompt_tokens", "inputTokens"], "o": ["output", "output_tokens", "completion_tokens", "outputTokens"], "r": ["cache_read", "input_cache_read", "cache_read_tokens", "cacheReadTokens"],
    "w": ["cache_write", "input_cache_creation", "cache_write_tokens", "cacheCreationTokens"], "h": ["reasoning", "reasoningTokens"], "total": ["total", "totalTokens"],
}
_ENTRY_USAGE = "struct<" + ", ".join(f"{k} bigint" for ks in _ENTRY_UNITS.values() for k in ks) + ">"


def _entry_counts(usage: str) -> str:
    """SQL of one struct of counts; null where nothing is counted."""
    parts = {k: "coalesce(" + ", ".join(f"{usage}.{s}" for s in ks) + ")" for k, ks in _ENTRY_UNITS.items()}
    counted = " + ".join(whole(parts[k]) for k in "iorwh")
    return f"if({counted} > 0, named_struct(" + ", ".join(f"'{k}', {whole(parts[k])}" for k in "iorwh") + f", 'total', {parts['total']}), null)"


def _estimated(rows: DataFrame) -> DataFrame:
    """Replies with u, their counts: told, or a quarter of the characters of what was said before and in the reply; nth, their number in the log."""
    text = F.expr("to_json(row.content)")
    rows = rows.withColumn("chars", F.when(text.isNull() | text.isin("null", '""', "[]", "{}"), 0).otherwise(F.length(text)))
    rows = rows.withColumns({
        "session": F.coalesce(F.first(F.expr("nullif(row.sessionId, '')"), ignorenulls=True).over(_up_to_here("path")), F.expr(STEM)),
        "model": F.lower(F.last(F.expr("nullif(row.model, '')"), ignorenulls=True).over(_up_to_here("path"))),
        "heard": F.coalesce(F.sum("chars").over(_before("path")), F.lit(0)),
    }).where("row.role = 'assistant'")
    guess = "named_struct('i', cast(ceil(heard / 4) as bigint), 'o', cast(ceil(chars / 4) as bigint), 'r', 0L, 'w', 0L, 'h', 0L, 'total', cast(null as bigint))"
    rows = rows.withColumn("u", F.expr(f"coalesce({_entry_counts('row.usage')}, {_entry_counts('row.token_usage')}, {guess})")).where("u.i + u.o + u.r + u.w + u.h > 0")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1)


#: A total that equals prompt and output says that the prompt holds the cached parts and the output the reasoning; the older tables, which have no total, always do.
_ENTRY_COLUMNS = {"input": "if(inclusive, greatest(u.i - u.r - u.w, 0), u.i)", "output": "if(inclusive, greatest(u.o - u.h, 0), u.o)", "cache_read": "u.r", "cache_write": "u.w", "reasoning": "u.h", "model_id": "coalesce(model, 'glm-5.2')", "provider_id": "'zhipu'"}
_INCLUSIVE = "u.r + u.w + u.h > 0 and coalesce(greatest(u.total, 0) = u.i + u.o, false)"
_USAGE_TABLE = "select id, session_id, model_id, started_at, completed_at, duration_ms, input_tokens as i, output_tokens as o, reasoning_tokens as h, cache_read_input_tokens as r, cache_creation_input_tokens as w, {0} as total, {1} as older from model_usage{2}"

_SNAPSHOT = "total_cost double, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint, request_count bigint"
_SNAPSHOT_UNITS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")


def _snapshot_rows(spark: SparkSession, root: str) -> DataFrame:
    """d, each used model of a session's snapshot, or the whole where no model has any use; the time is that of the session's own file."""
    found = documents(spark, root, "usage-v2.json", f"session_id string, snapshot struct<{_SNAPSHOT}, models array<struct<model string, {_SNAPSHOT}>>>").where("row.snapshot is not null")
    heads = documents(spark, root, "session.json", "created_at_ms bigint, updated_at_ms bigint").select("folder", F.expr("coalesce(row.updated_at_ms, row.created_at_ms)").alias("at"))
    found = found.join(heads, "folder", "left").withColumn("used", F.expr("filter(row.snapshot.models, m -> greatest(" + ", ".join(f"m.{k}" for k in _SNAPSHOT_UNITS) + ") > 0)"))
    fields = ["total_cost", *_SNAPSHOT_UNITS, "request_count"]
    all_of_it = "array(named_struct('model', 'fx-unknown', " + ", ".join(f"'{k}', row.snapshot.{k}" for k in fields) + "))"
    return found.select("path", "modified_ms", "at", F.expr("coalesce(nullif(row.session_id, ''), regexp_extract(path, '([^/]+)/[^/]+$', 1))").alias("session"), F.explode(F.expr(f"if(size(used) > 0, used, {all_of_it})")).alias("d"))


# Spellings of counts, by the order in which they are asked.
_CHAT_UNITS = {
    "i": ["input", "prompt", "input_tokens", "prompt_tokens", "promptTokenCount"], "o": ["output", "candidates", "output_tokens", "completion_tokens", "candidatesTokenCount"], "r": ["cached", "cached_tokens", "cachedContentTokenCount"],
    "h": ["thoughts", "reasoning", "thoughts_tokens"], "tool": ["tool", "tool_tokens"], "total": ["total", "totalTokenCount", "total_tokens"],
}
_STATS_UNITS = {"prompt": ["prompt", "input_tokens", "prompt_tokens"], "net": ["input"], "o": ["candidates", "output", "output_tokens", "candidates_tokens"], "r": ["cached", "cached_tokens"], "h": ["thoughts", "thoughts_tokens", "reasoning", "reasoning_tokens"]}
_CHAT_USAGE = "struct<" + ", ".join(f"{k} bigint" for ks in _CHAT_UNITS.values() for k in ks) + ">"
_STATS_FIELDS = ", ".join(f"{k} bigint" for ks in _STATS_UNITS.values() for k in ks)
_STATS = f"struct<models map<string, struct<tokens struct<{_STATS_FIELDS}>, {_STATS_FIELDS}>>, tokens struct<{_STATS_FIELDS}>, {_STATS_FIELDS}>"
_CHAT = f"sessionId string, session_id string, type string, id string, model string, timestamp string, created_at string, tokens {_CHAT_USAGE}, stats {_STATS}, result struct<stats {_STATS}>"


def _picked(source: str, keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"{source}.{k}" for k in keys) + ")"


def _chat_counts(usage: str) -> str:
    """SQL of input, output, cached and reasoning of one reply; tools count as input, and a total without the cached part says that the input holds it."""
    i, o, r, h, tool, total = (_picked(usage, _CHAT_UNITS[k]) for k in ("i", "o", "r", "h", "tool", "total"))
    holds = f"{whole(r)} > 0 and {total} is not null and {whole(total)} = {whole(i)} + {whole(o)} + {whole(h)} + {whole(tool)}"
    return f"named_struct('i', if({holds}, greatest({whole(i)} - {whole(r)}, 0), {whole(i)}) + {whole(tool)}, 'o', {whole(o)}, 'r', {whole(r)}, 'h', {whole(h)})"


def _stats_counts(usage: str) -> str:
    """SQL of the same of summed statistics: only a bare net input excludes the cached part."""
    parts = []
    for source, wrapped in ((f"{usage}.tokens", True), (usage, False)):
        prompt, net, o, r, h = (_picked(source, _STATS_UNITS[k]) for k in ("prompt", "net", "o", "r", "h"))
        i = whole(f"coalesce({prompt}, {net})")
        holds = "true" if wrapped else f"({prompt} is not null or {net} is null)"
        parts.append(f"named_struct('i', if({holds}, greatest({i} - {whole(r)}, 0), {i}), 'o', {whole(o)}, 'r', {whole(r)}, 'h', {whole(h)})")
    return f"if({usage}.tokens is not null, {parts[0]}, {parts[1]})"


def _replies_and_statistics(rows: DataFrame) -> DataFrame:
    """d, the counts by model of each event: a reply's own, or of statistics those by model, or else the whole."""
    stats = "coalesce(row.stats, row.result.stats)"
    by_model = f"filter(transform(map_entries({stats}.models), m -> named_struct('model', m.key, 'n', {_stats_counts('m.value')})), m -> m.n.i + m.n.o + m.n.r + m.n.h > 0)"
    direct = "(coalesce(row.type, '') = 'gemini' or row.tokens is not null) and coalesce(row.type, '') <> 'init'"
    one = f"array(named_struct('model', model, 'n', {_chat_counts('row.tokens')}))"
    rest = f"array(named_struct('model', coalesce(model, 'unknown'), 'n', {_stats_counts(stats)}))"
    rows = rows.withColumn("direct", F.expr(direct)).withColumn("each", F.expr(f"case when direct and row.tokens is not null and model is not null then {one} when direct or coalesce(row.type, '') = 'init' or {stats} is null then null when size({by_model}) > 0 then {by_model} else {rest} end"))
    return rows.withColumn("d", F.explode("each"))


def _chat_lines(spark: SparkSession, root: str) -> DataFrame:
    """Events of streamed logs, under the session and model last told; a reply told again is the later one."""
    rows = lossy_lines(spark, root, "*.jsonl").select(_plain().alias("path"), "modified_ms", "place", F.from_json("line", _CHAT).alias("row")).where("row is not null")
    named = "(row.type = 'init' or row.type = 'gemini' or row.tokens is not null)"
    rows = rows.withColumns({
        "session": F.coalesce(F.last(F.expr("nullif(coalesce(row.session_id, row.sessionId), '')"), ignorenulls=True).over(_up_to_here("path")), F.expr(STEM)),
        "model": F.last(F.expr(f"if({named}, nullif(row.model, ''), null)"), ignorenulls=True).over(_up_to_here("path")),
    })
    found = _replies_and_statistics(rows)
    last = Window.partitionBy("path", F.expr("if(direct and row.id is not null, row.id, '/' || place || '/' || d.model)")).orderBy(F.desc("place"))
    return found.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").select("path", "modified_ms", "session", F.expr("coalesce(row.timestamp, row.created_at)").alias("told"), "d")


def _chat_documents(spark: SparkSession, root: str) -> DataFrame:
    """Replies of saved chats; of other documents in the same place, their one reply or statistics."""
    found = documents(spark, root, "*.json", f"{_CHAT}, messages array<struct<id string, timestamp string, model string, tokens {_CHAT_USAGE}>>").where("path rlike '/session-[^/]*$' or path rlike '/tmp/[^/]+/chats/[^/]+$'")
    chats = found.where("row.messages is not null and row.sessionId is not null").select("path", "modified_ms", F.col("row.sessionId").alias("session"), F.explode("row.messages").alias("m")).where("m.tokens is not null and m.model is not null")
    chats = chats.select("path", "modified_ms", "session", F.col("m.timestamp").alias("told"), F.expr(f"named_struct('model', m.model, 'n', {_chat_counts('m.tokens')})").alias("d"))
    others = _replies_and_statistics(found.where("row.messages is null or row.sessionId is null").withColumns({"session": F.expr(STEM), "model": F.expr("nullif(row.model, '')")}))
    return chats.unionByName(others.select("path", "modified_ms", "session", F.expr("coalesce(row.timestamp, row.created_at)").alias("told"), "d"))


_CHAT_COLUMNS = {"session_id": "session", "model_id": "d.model", "provider_id": "'google'", "time": "coalesce(told, cast(modified_ms as string))", "input": "d.n.i", "output": "d.n.o", "cache_read": "d.n.r", "reasoning": "d.n.h"}

FORMATS: dict[str, Adapter | tuple[Adapter, ...]] = {
    "kimi": Adapter(
        "kimi", "wire.jsonl", "lines", columns={**{k: "coalesce(" + ", ".join(f"u.{s}" for s in ks) + ")" for k, ks in _WIRE_UNITS.items()}, "session_id": "session", "message_id": "id", "model_id": "coalesce(model, 'kimi-for-coding')", "provider_id": "'moonshot'", "time": "cast(at as string)", "dedup_key": "id"},
        read=_wire_rows, told=True,
    ),
    "zcode": (
        Adapter(
            "zcode", "*.jsonl", "lines", f"role string, content variant, usage {_ENTRY_USAGE}, token_usage {_ENTRY_USAGE}, model string, timestamp string, sessionId string",
            columns={**_ENTRY_COLUMNS, "session_id": "session", "time": "coalesce(row.timestamp, cast(modified_ms as string))", "dedup_key": "session || ':' || nth"}, prepare=_estimated, also={"inclusive": _INCLUSIVE}, told=True,
        ),
        Adapter(
            "zcode", "*.db", "sqlite", "id string, session_id string, model_id string, started_at bigint, completed_at bigint, duration_ms bigint, i bigint, o bigint, h bigint, r bigint, w bigint, total bigint, older bigint",
            columns={
                **_ENTRY_COLUMNS, "session_id": "coalesce(nullif(row.session_id, ''), 'unknown')", "message_id": "row.id", "dedup_key": "'zcode-sqlite:' || row.id",
                "time": "cast(case when row.started_at > 0 then row.started_at when row.completed_at is not null then row.completed_at - coalesce(greatest(row.duration_ms, 0), 0) else modified_ms end as string)",
            },
            # with sessions and totals; without sessions, where totals say nothing; without totals
            statement=[_USAGE_TABLE.format("computed_total_tokens", "0", " where (select count(*) from session) >= 0"), _USAGE_TABLE.format("null", "0", " where computed_total_tokens is null or 1"), _USAGE_TABLE.format("null", "1", "")],
            also={"u": "named_struct('i', " + whole("row.i") + ", 'o', " + whole("row.o") + ", 'r', " + whole("row.r") + ", 'w', " + whole("row.w") + ", 'h', " + whole("row.h") + ", 'total', row.total)", "model": "nullif(lower(row.model_id), '')", "inclusive": f"row.older > 0 or ({_INCLUSIVE})"},
            told=True,
        ),
    ),
    "fx": Adapter(
        "fx", "usage-v2.json", "document", keep="greatest(" + ", ".join(f"d.{k}" for k in _SNAPSHOT_UNITS) + ", d.request_count, d.total_cost) > 0",
        columns={
            **{k.removesuffix("_tokens"): f"d.{k}" for k in _SNAPSHOT_UNITS}, "session_id": "session", "model_id": "model", "provider_id": "if(model <> name, substring_index(name, '/', 1), null)", "time": "cast(coalesce(at, modified_ms) as string)",
            "cost": "if(d.total_cost >= 0 and d.total_cost < double('infinity'), d.total_cost, 0)", "message_count": "least(" + whole("d.request_count") + ", 2147483647)", "dedup_key": "'fx:' || session || ':' || model",
        },
        read=_snapshot_rows, also={"name": "coalesce(d.model, 'fx-unknown')", "model": "regexp_replace(name, '^[^/]+/(.+)$', '$1')"}, fallback="zai", used="true",
    ),
    "gemini": (
        Adapter("gemini", "*.json", "document", columns=_CHAT_COLUMNS, read=_chat_documents, told=True),
        Adapter("gemini", "*.jsonl", "lines", columns=_CHAT_COLUMNS, read=_chat_lines, told=True),
    ),
}
