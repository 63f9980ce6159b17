"""Further log formats, whose rows need their file's other rows, several files, packed columns, or a cost without units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import names
from tidemark.sources.adapters import ADAPTERS, FACTS, Adapter, text_path
from tidemark.sources.reading import listed, lossy_lines

STEM = "regexp_extract(path, '([^/]+)[.][^./]*$', 1)"
FOLDER = "regexp_extract(path, '([^/]+)/[^/]+$', 1)"


def whole(value: str) -> str:
    """SQL of a count given as a number or text: not below 0, and 0 where it is neither."""
    return f"greatest(try_cast(try_cast({value} as double) as bigint), 0)"


def said(value: str) -> str:
    """SQL of a text that is null where blank."""
    return f"nullif(trim({value}), '')"


def shared(prompt: str, output: str, cached: str, reasoning: str) -> dict[str, str]:
    """Columns of counts in which the prompt holds the cached part and the output the reasoning."""
    thought = f"least({whole(reasoning)}, {whole(output)})"
    return {"input": f"{whole(prompt)} - least({whole(cached)}, {whole(prompt)})", "output": f"{whole(output)} - {thought}", "cache_read": whole(cached), "reasoning": thought}


def _export_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of usage exports as comma-separated lines, but for those that stand beside an export of the same name as JSON.

    The heading of each file tells where its columns are, in three layouts; lines that are too short or name no model
    or time are left out. A value may be in quotes, and a comma in them parts nothing.
    """
    stem = r"regexp_replace(regexp_replace(path, '^file:/+', '/'), '[.][^./]*$', '')"
    better = listed(spark, root, "usage*.json").select(F.expr(stem).alias("stem"))
    lines = lossy_lines(spark, root, "usage*.csv").withColumn("stem", F.expr(stem)).join(better, "stem", "left_anti")
    fields = F.transform(F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda f: F.regexp_replace(F.trim(f), '^"+|"+$', ""))
    heads = lines.where("place = 0 and contains(line, 'Date') and contains(line, 'Model')").select("path", fields.alias("head"))
    kind = F.array_contains("head", F.lit("Kind"))
    # Places of model, both kinds of input, cached input, output and cost
    layout = F.when(kind & (F.size("head") >= 11), F.array(*map(F.lit, (4, 6, 7, 8, 9, 11)))).when(kind, F.array(*map(F.lit, (2, 4, 5, 6, 7, 9)))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4, 5, 7))))
    rows = lines.where("place > 0 and trim(line) <> ''").select("path", "modified_ms", "place", fields.alias("f")).join(heads.select("path", layout.alias("at")), "path").where("size(f) > at[5]")
    names_ = ("model", "written", "input", "cached", "output", "cost")
    rows = rows.select("path", "modified_ms", "place", F.expr("f[0]").alias("date"), *[F.expr(f"f[at[{k}]]").alias(n) for k, n in enumerate(names_)])
    return rows.withColumn("day", F.expr("if(date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$', date || 'T12:00:00', date)")).where("model <> ''")


def _model_of_log(rows: DataFrame) -> DataFrame:
    """known: the model that the log's heading last gave."""
    upto = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("known", F.last(F.expr(f"if(row.type = 'session_meta', {said('row.modelId')}, null)"), ignorenulls=True).over(upto))


def _turns_with_results(rows: DataFrame) -> DataFrame:
    """Messages with r, the first result after them that names session and model of their turn, and nth, their place among its messages."""
    rows = rows.withColumn("turn", F.expr(said("if(row.type = 'message', row.message.turnId, row.turnId)"))).where("turn is not null")
    result = F.expr(f"if(row.type = 'exec.result', named_struct('place', place, 'session', {said('row.sessionId')}, 'model', {said('row.model.modelId')}, 'provider', {said('row.model.providerId')}), null)")
    named = F.when(result["session"].isNotNull() & result["model"].isNotNull() & result["provider"].isNotNull(), result)
    later = Window.partitionBy("path", "turn").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    counted = " + ".join(whole(f"row.message.usage.{k}") for k in _MCODE_UNITS.values())
    found = rows.withColumn("r", F.first(named, ignorenulls=True).over(later)).where(f"r is not null and row.type = 'message' and row.message.role = 'assistant' and {counted} > 0")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("path", "turn", F.col("r.place")).orderBy("place")) - 1)


def _once(facts: DataFrame) -> DataFrame:
    """One row a key and file."""
    return facts.dropDuplicates(["path", "dedup_key"])


def _fullest(facts: DataFrame) -> DataFrame:
    """Of each key's rows in a file the one with most units, the later if equal; rows without a key stay."""
    units = F.expr("input + output + cache_read + cache_write + reasoning")
    one = facts.where("dedup_key is not null").groupBy("path", "dedup_key").agg(F.max_by(F.struct(*FACTS), F.struct(units, "timestamp_ms")).alias("f")).select("f.*")
    return facts.where("dedup_key is null").unionByName(one)


_JCODE_MESSAGE = "array<struct<id string, role string, timestamp string, tool_duration_ms bigint, token_usage struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, reasoning_output_tokens bigint>>>"


def _snapshots_and_journals(spark: SparkSession, root: str) -> DataFrame:
    """Messages of a session's snapshot and of the journal beside it, whose headings change the model from there on; a message told again is the later one."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "session_*.json").option("wholetext", "true").text(root)
    snapshot = text.select(text_path().alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"), F.from_json("value", f"id string, provider_key string, model string, messages {_JCODE_MESSAGE}").alias("s"))
    told = snapshot.where("s is not null").select("path", F.lit(-1).cast("long").alias("place"), "modified_ms", F.expr(f"coalesce(s.id, {STEM})").alias("session"), "s.model", "s.provider_key", "s.messages")
    entry = F.from_json("line", f"meta struct<provider_key string, model string>, append_messages {_JCODE_MESSAGE}").alias("j")
    journal = lossy_lines(spark, root, "session_*.journal.jsonl").select("path", "place", "modified_ms", entry).where("j is not null")
    added = journal.select("path", "place", "modified_ms", F.lit(None).cast("string").alias("session"), "j.meta.model", "j.meta.provider_key", F.col("j.append_messages").alias("messages"))
    upto = Window.partitionBy("stem").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    logs = told.unionByName(added).withColumn("stem", F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"(\.journal\.jsonl|\.json)$", ""))
    logs = logs.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("session", "model", "provider_key")}).where("session is not null")
    each = logs.select("stem", "path", "place", "modified_ms", "session", "model", "provider_key", F.posexplode("messages").alias("nth", "d")).where("d.token_usage is not null")
    each = each.withColumn("id", F.expr("coalesce(d.id, if(place < 0, 'snapshot:', 'journal:' || place || ':') || nth)"))
    last = Window.partitionBy("stem", "id").orderBy(F.desc("place"), F.desc("nth"))
    return each.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


# Providers whose use is paid for.
METERED = ["anthropic", "deepseek", "gemini", "huggingface", "kimi", "mistral", "openai", "openrouter", "qwen"]


def _studio_provider(rows: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce(F.expr(said("d.responseDetails.providerType")), F.lit("unknown")))
    paid = F.when(kind == "kimi", "moonshotai").otherwise(F.coalesce(names.canonical_provider(kind), kind))
    return rows.withColumn("provider", F.when(kind == "local", kind).when(kind.isin(METERED), paid).otherwise(F.concat(F.lit("unpriced:"), kind)))


def _usual_spelling(raw: str):
    """provider: the usual spelling of what is told, or just that."""
    return lambda rows: rows.withColumn("provider", F.coalesce(names.canonical_provider(F.expr(raw)), F.expr(raw)))


# Names of counts in the formats below.
_MCODE_UNITS = {"input": "inputTokens", "output": "outputTokens", "cache_read": "cacheReadTokens", "cache_write": "cacheWriteTokens"}
_PLAIN_UNITS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
_JUNIE_UNITS = {
    "input": ["inputTokens", "input"], "output": ["outputTokens", "output"], "cache_read": ["cacheInputTokens", "cacheReadInputTokens", "cacheRead"],
    "cache_write": ["cacheCreateTokens", "cacheCreationInputTokens", "cacheWrite"], "reasoning": ["reasoningTokens", "reasoningOutputTokens", "thinkingTokens"],
}
_BUDDY_UNITS = {
    "missed": ["cachedMissTokens", "cacheMissTokens"], "given": ["input_tokens", "inputTokens", "prompt_tokens"], "total": ["total_tokens", "totalTokens"], "output": ["output_tokens", "outputTokens", "completion_tokens"],
    "read": ["cache_read_input_tokens", "cacheReadInputTokens", "cacheTokens", "prompt_cache_hit_tokens", "cached_tokens"], "written": ["cache_creation_input_tokens", "cacheCreationInputTokens", "cachedWriteTokens", "prompt_cache_write_tokens"],
    "thought": ["completion_thinking_tokens", "completionThinkingTokens", "reasoningTokens"],
}
_JUNIE_SKIPPED = ["AgentStateUpdatedEvent", "AgentCurrentStatusUpdatedEvent", "AgentPatchCreatedEvent", "UserPromptEvent"]

_JUNIE_USAGE = "struct<model string, provider string, cost string, time string, " + ", ".join(f"{k} string" for ks in _JUNIE_UNITS.values() for k in ks) + ">"
_BUDDY_USAGE = "struct<" + ", ".join(f"{k} bigint" for ks in _BUDDY_UNITS.values() for k in ks) + ">"
_ZED_USAGE = "struct<" + ", ".join(f"{k} string" for k in _PLAIN_UNITS.values()) + ">"


def _first_of(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"u.{k}" for k in keys) + ")"


def _first_above_zero(keys: list[str]) -> str:
    return "coalesce(try_element_at(filter(array(" + ", ".join(f"u.{k}" for k in keys) + "), x -> x > 0), 1), 0)"


#: Where a total equals prompt and output, the prompt holds the cached part too.
_BUDDY_PARTS = {
    "r": _first_above_zero(_BUDDY_UNITS["read"]), "w": _first_above_zero(_BUDDY_UNITS["written"]), **{k: _first_of(_BUDDY_UNITS[k]) for k in ("missed", "total")},
    **{k: f"greatest({_first_of(_BUDDY_UNITS[k])}, 0)" for k in ("given", "output", "thought")},
    "i": "case when missed is not null then greatest(missed, 0) when r > 0 and total = given + output then greatest(given - r, 0) else given end",
}
_BUDDY_COLUMNS = {"input": "i", "output": "output", "cache_read": "r", "cache_write": "w", "reasoning": "thought"}


def _buddy_models(rows: DataFrame) -> DataFrame:
    """agent, the model last prepared for it, and u, the usage that a line of an extension's log reports."""
    rows = rows.withColumn("agent", F.trim(F.regexp_extract("row.line", r"\[(?:CraftInvokableAgent|AgentReporter)\][^\[]*\[([^\]]*)\]", 1))).where("agent <> ''")
    prepared = F.trim(F.regexp_extract("row.line", r"\[CraftInvokableAgent\].*?Model prepared:(.*)$", 1))
    model = F.coalesce(F.nullif(F.trim(F.regexp_extract(prepared, r"\(([^()]*)\)[^(]*$", 1)), F.lit("")), F.nullif(prepared, F.lit("")))
    upto = Window.partitionBy("path", "agent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("model", F.last(model, ignorenulls=True).over(upto)).where("contains(row.line, '[AgentReporter]')")
    return rows.withColumn("u", F.from_json(F.regexp_extract("row.line", r"Agent execution successful with usage:\s*(\{.*\})", 1), _BUDDY_USAGE)).where("u is not null")


def _buddy(client: str) -> tuple[Adapter, Adapter]:
    """Logs of the two clients of one vendor: messages, and the extension's log."""
    provider = f"struct<model string, requestModelId string, messageId string, traceId string, usage {_BUDDY_USAGE}, rawUsage {_BUDDY_USAGE}>"
    session = f"coalesce(row.sessionId, {STEM})"
    messages = Adapter(
        client, "*.jsonl", "lines", f"id string, timestamp bigint, type string, role string, status string, sessionId string, message struct<model string, usage {_BUDDY_USAGE}>, providerData {provider}",
        "u is not null and ((row.type = 'message' and row.role = 'assistant') or row.type = 'function_call') and coalesce(row.status, 'completed') = 'completed'",
        {
            **_BUDDY_COLUMNS, "session_id": session, "model_id": f"coalesce({said('coalesce(row.providerData.model, row.providerData.requestModelId, row.message.model)')}, '{client}')",
            "time": "cast(coalesce(row.timestamp, modified_ms) as string)", "dedup_key": f"'{client}:' || {session} || ':' || coalesce(row.providerData.messageId, row.providerData.traceId, row.id)",
        },
        also={"u": "coalesce(row.message.usage, row.providerData.usage, row.providerData.rawUsage)", **_BUDDY_PARTS}, fallback="tencent", fold=_fullest,
    )
    day = r"regexp_replace(regexp_extract(row.line, r'^\[?([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2} [0-9:.]+)', 1), '/', '-')"
    log = Adapter(
        client, "*.log", "text", columns={
            **_BUDDY_COLUMNS, "session_id": "agent", "model_id": f"coalesce(model, '{client}')", "time": f"coalesce({said(day)}, cast(modified_ms as string))",
            "dedup_key": f"'{client}:extension-log:' || agent || ':' || substring({day}, 1, 19) || ':' || concat_ws(':', i, output, r, w, thought)",
        },
        prepare=_buddy_models, also=_BUDDY_PARTS, fallback="tencent",
    )
    return messages, log


_WORKBUDDY = "select u.session_id as session, u.used as used, u.updated_at as at, s.model as model from session_usage u left join sessions s on s.id = u.session_id where u.used > 0 and u.updated_at > 0"
#: Cost by session tree and day; days are UTC.
_CRUSH = """with recursive below(root, id) as (select id, id from sessions where parent_session_id is null union select b.root, s.id from below b join sessions s on s.parent_session_id = b.id),
spoken as (select b.root as root, m.created_at * case when m.created_at < 100000000000 then 1000 else 1 end as at from below b join messages m on m.session_id = b.id where m.role = 'assistant' and m.created_at > 0),
days as (select root, min(at) as at, count(*) as n from spoken group by root, at / 86400000)
select s.id as id, max(coalesce(s.cost, 0), 0) as cost, coalesce(d.at, iif(s.updated_at > 0, s.updated_at, s.created_at)) as at, coalesce(d.n, 0) as n, sum(coalesce(d.n, 0)) over (partition by s.id) as total
from sessions s left join days d on d.root = s.id where s.parent_session_id is null and (coalesce(s.message_count, 0) > 0 or coalesce(s.cost, 0) > 0)"""
_ZED = ["select id, updated_at, created_at, unpacked(data_type, data) as body from threads", "select id, updated_at, null as created_at, unpacked(data_type, data) as body from threads"]
_STUDIO_CHAT = "select m.id as id, m.thread_id as thread, m.created_at as at, t.model_id as model, case when json_valid(m.metadata_json) then m.metadata_json else '{}' end as meta from chat_messages m left join chat_threads t on t.id = m.thread_id where m.role = 'assistant'"
_OCTO = [
    "select id, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, cost, timestamp, session_id, provider from messages",
    "select id, model, input_tokens, output_tokens, timestamp, session_id from token_usage where input_tokens > 0 or output_tokens > 0",
]


def _studio(prompt: str, completion: str, total: str, read: str, written: str, reasoning: str) -> dict[str, str]:
    """Counts of which the total may exceed prompt and completion, and the prompt holds what was read from and written to the cache."""
    p, c = whole(prompt), whole(completion)
    r, o = f"least({whole(read)}, {p})", f"least({whole(reasoning)}, {c})"
    w = f"least({whole(written)}, {p} - {r})"
    return {"input": f"greatest({whole(total)}, {p} + {c}) - {c} - {r} - {w}", "output": f"{c} - {o}", "cache_read": r, "cache_write": w, "reasoning": o}


def _estimated_chat(rows: DataFrame) -> DataFrame:
    """Replies of chats of the free agent that tell no counts: heard, what was said since the reply before, and spoken, in characters; the model is that of the settings beside the projects."""
    said_ = "length(coalesce(row.content, '')) + aggregate(coalesce(row.blocks, array()), 0, (n, b) -> n + length(coalesce(b.content, '')))"
    rows = rows.withColumns({"characters": F.expr(said_), "replies": F.expr("coalesce(row.variant, row.role, '') in ('ai', 'agent', 'assistant')")})
    rows = rows.withColumns({"free": F.expr("coalesce(startswith(row.metadata.runState.sessionState.mainAgentState.agentType, 'base2-free'), false)"), "counted": F.expr("replies and coalesce(greatest(row.metadata.usage.inputTokens, row.metadata.usage.outputTokens, row.metadata.usage.cacheReadInputTokens, row.metadata.usage.cacheCreationInputTokens), 0) > 0")})
    chat = Window.partitionBy("path")
    rows = rows.withColumns({"free": F.max("free").over(chat), "counted": F.max("counted").over(chat)}).where("free and not counted")
    spoken = F.col("replies") & (F.col("characters") > 0)
    rows = rows.withColumn("turn", F.count(F.when(spoken, 1)).over(chat.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("heard", F.sum(F.when(~F.col("replies"), F.col("characters")).otherwise(0)).over(Window.partitionBy("path", "turn"))).where(spoken)
    return rows.withColumn("home", F.expr(r"regexp_extract(regexp_replace(path, '^file:/+', '/'), '^(.*)(/[^/]+){4}/[^/]+$', 1)"))


def _estimated_rows(spark: SparkSession, root: str) -> DataFrame:
    text = lambda glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(root).select(text_path().alias("path"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms"), "value")
    shape = "array<struct<variant string, role string, content string, timestamp string, createdAt string, blocks array<struct<content string>>, metadata struct<runState struct<sessionState struct<mainAgentState struct<agentType string>>>, usage struct<inputTokens bigint, outputTokens bigint, cacheReadInputTokens bigint, cacheCreationInputTokens bigint>>>>"
    rows = text("chat-messages.json").select("path", "modified_ms", F.posexplode(F.from_json("value", shape)).alias("place", "row")).where("row is not null")
    models = text("settings.json").select(F.expr(r"regexp_replace(regexp_replace(path, '^file:/+', '/'), '/[^/]*$', '')").alias("home"), F.expr(said("get_json_object(value, '$.freebuffModel')")).alias("model")).where("model is not null")
    return _estimated_chat(rows).join(models, "home", "left")


_DEVIN = "select m.row_id, m.session_id, m.chat_message, m.created_at * 1000 as created_ms, s.model from message_nodes m join sessions s on s.id = m.session_id order by m.row_id"
_DEVIN_CHAT = "role string, metadata struct<num_tokens bigint, request_id string, generation_model string, metrics struct<input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, total_time_ms bigint>>"
_FREE_SESSION = r"regexp_replace(regexp_extract(path, '([^/]+/projects/[^/]+/chats/[^/]+)/[^/]+$', 1), '/(projects|chats)/', '/')"
_LONG = "greatest(coalesce(try_cast({} as bigint), 0L), 0L)".format
_COST = "try_cast(regexp_replace(cost, '[$,]', '') as double)"
FORMATS: dict[str, Adapter | tuple[Adapter, ...]] = {
    "devin-cli": Adapter(
        "devin-cli", "sessions.db", "sqlite", "row_id bigint, session_id string, chat_message string, created_ms bigint, model string", "d.role = 'assistant' and model <> 'adaptive'", statement=_DEVIN, inner="row.chat_message", inner_schema=_DEVIN_CHAT, fallback="devin",
        also={"model": "coalesce(nullif(d.metadata.generation_model, ''), nullif(row.model, ''))", "m": "d.metadata.metrics", **{k: f"coalesce({whole(f'm.{c}')}, 0L)" for k, c in (("input", "input_tokens"), ("told", "output_tokens"), ("cache_read", "cache_read_tokens"), ("cache_write", "cache_creation_tokens"))}, "took": f"coalesce({whole('m.total_time_ms')}, 0L)"},
        columns={"session_id": "row.session_id", "message_id": "cast(row.row_id as string)", "model_id": "model", "time": "cast(if(row.created_ms is null, modified_ms, greatest(row.created_ms - took, 0)) as string)", "input": "input", "cache_read": "cache_read", "cache_write": "cache_write", "output": f"if(greatest(input, told, cache_read, cache_write) > 0, told, {whole('d.metadata.num_tokens')})",
                 "dedup_key": f"'devin-cli:' || row.session_id || coalesce(':request:' || {said('d.metadata.request_id')}, ':row:' || row.row_id)"},
    ),
    "freebuff": Adapter(
        "freebuff", "chat-messages.json", "array", read=_estimated_rows,
        columns={"session_id": _FREE_SESSION, "message_id": "cast(place as string)", "model_id": "coalesce(model, 'freebuff-unknown')", "time": r"coalesce(row.timestamp, row.createdAt, nullif(regexp_replace(regexp_extract(path, '/chats/([0-9]{4}-[^/]+)/[^/]+$', 1), 'T([0-9]{2})-([0-9]{2})-([0-9]{2})', 'T$1:$2:$3'), ''), cast(modified_ms as string))",
                 "input": "ceil(heard / 4)", "output": "ceil(characters / 4)", "dedup_key": _FREE_SESSION + " || ':' || turn"},
    ),
    "cursor": (
        ADAPTERS["cursor"],
        Adapter(
            "cursor", "usage*.csv", "lines", read=_export_rows, used="timestamp_ms is not null",
            columns={"session_id": r"'cursor-' || coalesce(nullif(regexp_replace(regexp_extract(path, '/usage[.](.+)[.]csv$', 1), '[^A-Za-z0-9._-]', '-'), ''), 'active') || '-' || date", "model_id": "model", "time": "day", "input": _LONG("input"), "output": _LONG("output"), "cache_read": _LONG("cached"), "cache_write": _LONG("written"),
                     "cost": f"if({_COST} >= 0 and {_COST} < double('infinity'), {_COST}, null)"},
        ),
    ),
    "antigravity": Adapter(
        "antigravity", "*.jsonl", "lines", "type string, sessionId string, timestamp string, modelId string, providerId string, responseId string, input string, output string, cacheRead string, cacheWrite string, reasoning string",
        f"row.type = 'usage' and row.sessionId is not null and {whole('row.timestamp')} > 0",
        {
            "session_id": "row.sessionId", "message_id": "row.responseId", "model_id": f"coalesce({said('row.modelId')}, known, 'unknown')", "provider_id": "row.providerId", "time": "row.timestamp", "input": whole("row.input"), "output": whole("row.output"),
            "cache_read": whole("row.cacheRead"), "cache_write": whole("row.cacheWrite"), "reasoning": whole("row.reasoning"), "dedup_key": said("row.responseId"),
        },
        prepare=_model_of_log, fallback="antigravity",
    ),
    "trae": Adapter(
        "trae", "*.json", "array", "session_id string, usage_time bigint, model_name string, mode string, dollar_float double, extra_info struct<input_token bigint, output_token bigint, cache_read_token bigint, cache_write_token bigint>",
        "row.session_id <> '' and row.usage_time > 0",
        {
            "session_id": "row.session_id", "model_id": "model", "time": "cast(row.usage_time * 1000 as string)", "input": "row.extra_info.input_token", "output": "row.extra_info.output_token", "cache_read": "row.extra_info.cache_read_token",
            "cache_write": "row.extra_info.cache_write_token", "cost": "coalesce(row.dollar_float, 0)", "dedup_key": "'trae:' || row.session_id || ':' || row.usage_time",
            "provider_id": "case when model rlike 'GPT|gpt' then 'openai' when model rlike 'Claude|claude' then 'anthropic' when model rlike 'Gemini|gemini' then 'google' when model rlike 'GLM|glm' then 'zhipu' else 'trae' end",
        },
        # the display names of these models stand for their ids; other names are ids already
        also={"model": "case when row.model_name rlike '^(GPT-5[.]4|GPT-5[.][123]([- ]Codex)?|Gemini 3[.]1( Pro)?|GLM[- ]5[.]1|Claude[- ]Sonnet[- ]4[.][56])$' then replace(lower(row.model_name), ' ', '-') when row.model_name <> '' then row.model_name else 'trae-' || lower(coalesce(nullif(row.mode, ''), 'unknown')) end"}, told=True,
    ),
    "warp": Adapter(
        "warp", "usage*.json", "document", "syncedAt string, usage struct<requestsUsed bigint, spendCents bigint>, workspaces array<struct<id string, name string, requestsUsed bigint, spendCents bigint>>", "d.requests > 0 or d.cents > 0",
        {"session_id": "d.session", "model_id": "'aggregate-requests'", "provider_id": "'warp'", "time": "row.syncedAt", "cost": "greatest(d.cents, 0) / 100", "message_count": "greatest(least(d.requests, 2147483647), 0)"},
        # the account's own line counts only where no workspace has any use
        each="""if(exists(row.workspaces, w -> greatest(w.requestsUsed, w.spendCents) > 0),
            transform(row.workspaces, w -> named_struct('session', 'warp-aggregate-' || coalesce(nullif(trim(both '-' from regexp_replace(lower(trim(w.id)), '[^a-z0-9_.-]', '-')), ''), 'unknown'), 'requests', w.requestsUsed, 'cents', w.spendCents)),
            array(named_struct('session', 'warp-aggregate-account', 'requests', row.usage.requestsUsed, 'cents', row.usage.spendCents)))""",
        told=True, used="timestamp_ms > 0",
    ),
    "reasonix": Adapter(
        "reasonix", "*.jsonl", "lines", "ts string, model string, prompt bigint, completion bigint, reasoning bigint, cache_hit bigint, cache_miss bigint, total bigint, requests bigint, turn boolean",
        "not coalesce(row.turn, false) and name <> '' and greatest(row.total, row.requests) > 0",
        {
            **shared("row.prompt", "row.completion", "row.cache_hit", "row.reasoning"), "input": f"if(row.cache_miss <> 0, greatest(row.cache_miss, 0), greatest({whole('row.prompt')} - {whole('row.cache_hit')}, 0))",
            "session_id": "'reasonix-stats:' || path", "model_id": "if(contains(model, '�'), 'unknown', model)", "provider_id": "provider", "time": "row.ts", "message_count": "greatest(row.requests, 1)",
            "dedup_key": "'reasonix:' || path || ':' || place || ':' || coalesce(row.requests, 0) || ':' || coalesce(row.total, 0)",
        },
        also={"name": "trim(row.model)", "model": "if(contains(name, '/'), substring(name, instr(name, '/') + 1), name)", "provider": "if(contains(name, '/') and not contains(substring_index(name, '/', 1), '�'), substring_index(name, '/', 1), null)"},
        fallback="reasonix", used="timestamp_ms is not null",
    ),
    "mcode": Adapter(
        "mcode", "*.jsonl", "lines", "type string, turnId string, sessionId string, model struct<providerId string, modelId string>, message struct<role string, turnId string, timestamp bigint, usage struct<" + ", ".join(f"{k} bigint" for k in _MCODE_UNITS.values()) + ">>", "true",
        {
            **{k: f"row.message.usage.{v}" for k, v in _MCODE_UNITS.items()}, "session_id": "r.session", "model_id": "r.model", "provider_id": "r.provider", "time": "cast(coalesce(row.message.timestamp, modified_ms) as string)",
            "dedup_key": "'mcode:' || r.session || ':' || turn || ':' || nth || ':' || concat_ws(':', " + ", ".join(whole(f"row.message.usage.{v}") for v in _MCODE_UNITS.values()) + ")",
        },
        prepare=_turns_with_results, told=True, used="timestamp_ms > 0",
    ),
    "augment": Adapter(
        "augment", "*.json", "document", "sessionId string, agentState struct<modelId string>, chatHistory array<struct<finishedAt string, completed boolean, sequenceId string, exchange struct<model_id string, request_id string, response_nodes array<struct<token_usage struct<" + ", ".join(f"{k} bigint" for k in _PLAIN_UNITS.values()) + ">>>>>>",
        "d.turn.completed and u is not null",
        {
            **{k: f"u.{v}" for k, v in _PLAIN_UNITS.items()}, "session_id": "session", "model_id": f"coalesce({said('d.turn.exchange.model_id')}, {said('row.agentState.modelId')}, 'unknown')", "time": "coalesce(d.turn.finishedAt, cast(modified_ms as string))",
            "dedup_key": f"'augment:' || session || ':' || coalesce('req:' || {said('d.turn.exchange.request_id')}, 'seq:' || nullif(d.turn.sequenceId, ''), 'turn:' || d.nth)",
        },
        each="transform(row.chatHistory, (t, i) -> named_struct('nth', i, 'turn', t))",
        also={
            "session": f"coalesce({said('row.sessionId')}, {STEM})",
            "u": "try_element_at(filter(d.turn.exchange.response_nodes, n -> greatest(" + ", ".join(f"n.token_usage.{k}" for k in _PLAIN_UNITS.values()) + ") > 0), -1).token_usage",
        },
        fallback="augment",
    ),
    "unsloth": (
        Adapter(
            "unsloth", "studio.db", "sqlite", "id string, thread string, at bigint, model string, meta string", "row.at > 0 and trim(row.id) <> ''",
            {
                **_studio(*[f"d.contextUsage.{k}" for k in ("promptTokens", "completionTokens", "totalTokens", "cachedTokens", "cacheWriteTokens", "reasoningTokens")]), "session_id": f"coalesce({said('row.thread')}, 'unsloth:chat:' || row.id)",
                "message_id": "row.id", "model_id": f"coalesce({said('d.responseDetails.responseModelId')}, {said('d.contextUsage.modelId')}, {said('row.model')}, 'unknown')", "provider_id": "provider", "time": "cast(row.at as string)", "dedup_key": "'unsloth:chat:' || row.id",
            },
            _STUDIO_CHAT, "row.meta", "contextUsage struct<promptTokens bigint, completionTokens bigint, totalTokens bigint, cachedTokens bigint, cacheWriteTokens bigint, reasoningTokens bigint, modelId string>, responseDetails struct<responseModelId string, providerType string>",
            prepare=_studio_provider, told=True,
        ),
        Adapter(
            "unsloth", "studio.db", "sqlite", "id string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, created_at bigint", "row.created_at > 0 and trim(row.id) <> ''",
            {**_studio("row.prompt_tokens", "row.completion_tokens", "row.total_tokens", "0", "0", "0"), "session_id": "'unsloth:api'", "message_id": "row.id", "model_id": f"coalesce({said('row.model')}, 'unknown')", "provider_id": "'local'", "time": "cast(row.created_at as string)", "dedup_key": "'unsloth:api:' || row.id"},
            "select id, model, prompt_tokens, completion_tokens, total_tokens, created_at from api_usage_events", told=True,
        ),
    ),
    "crush": Adapter(
        "crush", "crush.db", "sqlite", "id string, cost double, at bigint, n bigint, total bigint", "(row.total > 0 or row.cost > 0) and row.at > 0",
        {"session_id": "path || ':' || row.id", "model_id": "'session-total'", "provider_id": "'crush'", "time": "cast(row.at as string)", "cost": "if(row.total > 0, row.cost * row.n / row.total, row.cost)", "message_count": "row.n"},
        _CRUSH, told=True, used="true",
    ),
    "junie": Adapter(
        "junie", "events.jsonl", "lines", f"timestampMs string, kind string, event struct<agentEvent struct<kind string, modelUsage array<{_JUNIE_USAGE}>>>",
        f"row.event.agentEvent.kind = 'LlmResponseMetadataEvent' and coalesce(row.kind, '') not in ({', '.join(repr(k) for k in _JUNIE_SKIPPED)}) and {said('u.model')} is not null",
        {
            **{k: whole("coalesce(" + ", ".join(f"u.{v}" for v in vs) + ")") for k, vs in _JUNIE_UNITS.items()}, "session_id": "session", "model_id": "trim(u.model)", "provider_id": "u.provider", "cost": "paid",
            # a report that tells its own time tells the end of the answer
            "time": "cast(if(told > 0, told - took, coalesce(unix_millis(try_to_timestamp(regexp_extract(session, '^session-([0-9]{6}-[0-9]{6})(-|$)', 1), 'yyMMdd-HHmmss')), modified_ms)) as string)",
            "dedup_key": "concat_ws(':', 'junie', session, told, trim(u.model), " + ", ".join(whole("coalesce(" + ", ".join(f"u.{v}" for v in vs) + ")") for vs in _JUNIE_UNITS.values()) + ", format_string('%.12f', paid), d.nth)",
        },
        each="transform(row.event.agentEvent.modelUsage, (x, i) -> named_struct('nth', i, 'usage', x))",
        also={"u": "d.usage", "session": f"coalesce({said(FOLDER)}, 'unknown')", "told": whole("row.timestampMs"), "took": whole("u.time"), "paid": "if(try_cast(u.cost as double) >= 0 and try_cast(u.cost as double) < double('infinity'), try_cast(u.cost as double), 0)"},
        fallback="junie", used="greatest(input, output, cache_read, cache_write, reasoning, cost) > 0", fold=_once,
    ),
    "jcode": Adapter(
        "jcode", "session_*.json", "document", columns={
            # without a count of writes, the prompt holds what was read from the cache
            "input": "if(d.token_usage.cache_creation_input_tokens is not null or hit > sent, sent, sent - hit)", "output": "d.token_usage.output_tokens", "cache_read": "hit", "cache_write": "d.token_usage.cache_creation_input_tokens", "reasoning": "d.token_usage.reasoning_output_tokens",
            "session_id": "session", "message_id": "id", "model_id": f"coalesce({said('model')}, 'unknown')", "provider_id": "provider", "dedup_key": "'jcode:' || session || ':' || id",
            "time": "cast(coalesce(unix_millis(try_cast(d.timestamp as timestamp)) - greatest(d.tool_duration_ms, 0), modified_ms) as string)",
        },
        read=_snapshots_and_journals, prepare=_usual_spelling(f"coalesce({said('provider_key')}, 'jcode')"),
        also={"sent": whole("d.token_usage.input_tokens"), "hit": whole("d.token_usage.cache_read_input_tokens")}, told=True,
    ),
    "codebuddy": _buddy("codebuddy"),
    "workbuddy": (
        *_buddy("workbuddy"),
        Adapter("workbuddy", "workbuddy.db", "sqlite", "session string, used bigint, at bigint, model string", columns={"session_id": "row.session", "model_id": f"coalesce({said('row.model')}, 'auto')", "time": "cast(row.at as string)", "input": "row.used", "dedup_key": "'workbuddy:' || row.session || ':' || row.at"}, statement=_WORKBUDDY, fallback="workbuddy"),
    ),
    "zed": Adapter(
        "zed", "threads.db", "sqlite", "id string, updated_at string, created_at string, body string", "not coalesce(d.imported, false) and lower(trim(d.model.provider)) = 'zed.dev' and trim(d.model.model) <> '' and row.id is not null",
        {
            "session_id": "row.id", "model_id": "trim(d.model.model)", "provider_id": "'zed.dev'", "time": "coalesce(row.created_at, row.updated_at, d.updated_at)", "message_count": "greatest(size(uses), 1)", "dedup_key": "'zed:' || row.id",
            **{k: f"if(size(uses) > 0, aggregate(uses, 0L, (a, x) -> a + {whole(f'x.{v}')}), {whole(f'd.cumulative_token_usage.{v}')})" for k, v in _PLAIN_UNITS.items()},
        },
        _ZED, "row.body", f"imported boolean, updated_at string, model struct<provider string, model string>, request_token_usage string, cumulative_token_usage {_ZED_USAGE}",
        also={"uses": f"filter(coalesce(map_values(from_json(d.request_token_usage, 'map<string, {_ZED_USAGE}>')), from_json(d.request_token_usage, 'array<{_ZED_USAGE}>'), array()), x -> " + " + ".join(whole(f"x.{v}") for v in _PLAIN_UNITS.values()) + " > 0)"}, told=True,
    ),
    "synthetic": Adapter(
        "synthetic", "*.db", "sqlite", "id string, model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint, cost double, timestamp double, session_id string, provider string",
        columns={
            **{k: f"row.{k}_tokens" for k in ("input", "output", "cache_read", "cache_write", "reasoning")}, "session_id": "coalesce(row.session_id, 'unknown')", "message_id": "row.id", "model_id": "model", "provider_id": "coalesce(row.provider, 'synthetic')",
            "time": "cast(row.timestamp as string)", "cost": "greatest(row.cost, 0)", "dedup_key": "row.id",
        },
        statement=_OCTO, prepare=lambda rows: rows.withColumn("model", names.gateway_model(F.coalesce("row.model", F.lit("")))), told=True,
    ),
}
