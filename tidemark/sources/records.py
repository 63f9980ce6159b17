"""Log formats whose records are no lines: objects inside a free log, messages of a wire format inside databases, and events keyed by a sequence."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import names
from tidemark.session import share_package
from tidemark.sources import reading
from tidemark.sources.adapters import Adapter
from tidemark.sources.formats import STEM, said, whole

#: Bytes of a free log that one task reads, and the most that a record may span: one that is not closed by then is none.
RANGE, MOST_RECORD = 16 << 20, 1 << 20

# Objects inside a free log. The marker of a record, the fields that name it, and the stamp of a log line.
_MARKED = re.compile(rb'(?<!\\)"(usage|model|id)"\s*:\s*')
_STAMP = re.compile(rb"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\]\[", re.M)
_TEXT = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)
_DELIMITERS = re.compile(rb'["\\{}]')


def object_end(text: bytes, start: int) -> int | None:
    """Where the object that begins at start ends: braces inside strings do not count; None if it does not end."""
    depth, at, quoted = 0, start, False
    while found := _DELIMITERS.search(text, at):
        sign, at = found[0], found.end()
        if quoted:
            if sign == b"\\":
                at += 1
            elif sign == b'"':
                quoted = False
        elif sign == b'"':
            quoted = True
        elif sign == b"{":
            depth += 1
        elif sign == b"}":
            depth -= 1
            if depth == 0:
                return at
    return None


def marks_in(text: bytes, first: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    """place, end, kind and value of what a log holds from first on and before end; text may go on behind end."""
    for found in _MARKED.finditer(text):
        kind, at = found[1].decode(), found.start()
        if not first <= at < end:
            continue
        if kind == "usage":
            if text[found.end() : found.end() + 1] == b"{" and (stop := object_end(text[: at + MOST_RECORD], found.end())):
                yield at, stop, kind, text[found.end() : stop].decode("utf-8", "replace")
        elif value := _TEXT.match(text, found.end()):
            try:
                yield at, value.end(), kind, json.loads(value[0])
            except ValueError:
                continue
    for found in _STAMP.finditer(text):
        if first <= found.start() < end:
            yield found.start(), found.end(), "time", found[1].decode()


def log_marks(spark: SparkSession, root: str, glob: str, size: int = RANGE) -> DataFrame:
    """path, modified_ms, place, stop, kind and value of the records, names and stamps in free logs.

    A large log is read by many tasks. Each finds what begins in its range of bytes, and reads behind it as far as a
    record may go, so the result is the same for any size of the ranges.
    """
    share_package(spark)
    files = reading.listed(spark, root, glob)
    ranges = files.select("path", "modified_ms", "content", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("first"))
    names_ = ["path", "modified_ms", "place", "stop", "kind", "value"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, changed_ms, content, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with reading._file(path, content) as file:
                        # the byte before tells whether a quote is escaped, and a line begins
                        low = max(first - 1, 0)
                        file.seek(low)
                        text = bytes(file.read(min(first + size + MOST_RECORD, length) - low))
                except OSError:
                    continue
                found = [(path, changed_ms, low + a, low + b, k, v) for a, b, k, v in marks_in(text, first - low, first - low + size)]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names_)

    return reading._dealt(ranges, "path", "first").mapInArrow(read, "path string, modified_ms bigint, place bigint, stop bigint, kind string, value string")


_COUNT = {
    "prompt": ["prompt_tokens", "promptTokens", "input_tokens", "inputTokens"],
    "output": ["completion_tokens", "completionTokens", "output_tokens", "outputTokens"],
    "total": ["total_tokens", "totalTokens"], "cached": ["cached_tokens"], "written": ["cache_creation_input_tokens"], "thought": ["reasoning_tokens"],
}
_DETAILS = {"prompt": ["prompt_tokens_details", "input_tokens_details", "inputTokensDetails"], "output": ["output_tokens_details", "completion_tokens_details", "completionTokensDetails", "outputTokensDetails"]}
_USAGE = ", ".join([f"{k} bigint" for ks in _COUNT.values() for k in ks] + [f"{k} struct<cached_tokens bigint, cache_read_tokens bigint, cache_creation_input_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint>" for ks in _DETAILS.values() for k in ks])


def log_records(spark: SparkSession, root: str, glob: str = "*.log", size: int = RANGE) -> DataFrame:
    """One row a record of a free log with its counts and, of what stands between the record before and it, the last model, id and stamp."""
    marks = log_marks(spark, root, glob, size)
    before = Window.partitionBy("path").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # a marker inside another record's object is none
    open_ = F.coalesce(F.max(F.when(F.col("kind") == "usage", F.col("stop"))).over(before), F.lit(0))
    kept = marks.withColumn("open", open_).where("kind <> 'usage' or place >= open")
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.struct("place", "value")), ignorenulls=True).over(before)
    told = kept.withColumns({k: last(k) for k in ("model", "id", "time")}).withColumn("since", F.coalesce(F.max(F.when(F.col("kind") == "usage", F.col("stop"))).over(before), F.lit(0))).where("kind = 'usage'")
    first = lambda keys, where="u": "coalesce(" + ", ".join(f"{where}.{k}" for k in keys) + ", 0)"
    detail = lambda side, keys: f"greatest({', '.join(first(keys, f'u.{d}') for d in _DETAILS[side])})"
    rows = told.withColumn("u", F.from_json("value", _USAGE)).where("u is not null")
    for name, value in {
        "prompt": f"greatest({first(_COUNT['prompt'])}, 0)", "all_output": f"greatest({first(_COUNT['output'])}, 0)",
        "cache_read": f"least(greatest({detail('prompt', ['cached_tokens', 'cache_read_tokens'])}, {first(_COUNT['cached'])}, 0), prompt)",
        "cache_write": f"least(greatest({detail('prompt', ['cache_creation_input_tokens', 'cache_write_tokens'])}, {first(_COUNT['written'])}, 0), prompt - cache_read)",
        "reasoning": f"least(greatest({detail('output', ['reasoning_tokens'])}, {first(_COUNT['thought'])}, 0), all_output)",
        "total": f"greatest({first(_COUNT['total'])}, prompt + all_output)",
        "said_model": "if(model.place >= since, nullif(trim(model.value), ''), null)", "said_id": "if(id.place >= since and id.value rlike '^(chatcmpl-|cmpl-|resp_)', id.value, null)", "said_time": "if(time.place >= since, time.value, null)",
    }.items():
        rows = rows.withColumn(name, F.expr(value))
    return rows.where("total > 0")


# Messages of a wire format. A field is a number with a kind: a varint, eight or four bytes, or bytes with their length.


def _varint(raw: bytes, at: int) -> tuple[int, int] | None:
    value = shift = 0
    while at < len(raw) and shift < 64:
        byte = raw[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & (1 << 64) - 1, at
    return None


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """number, kind and value of a message's fields, up to the first that is damaged."""
    at = 0
    while at < len(raw):
        tag = _varint(raw, at)
        if tag is None:
            return
        number, kind, at = tag[0] >> 3, tag[0] & 7, tag[1]
        if kind == 0:
            found = _varint(raw, at)
            if found is None:
                return
            value, at = found
        elif kind == 2:
            found = _varint(raw, at)
            if found is None or found[1] + found[0] > len(raw):
                return
            value, at = raw[found[1] : found[1] + found[0]], found[1] + found[0]
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(raw):
                return
            value, at = int.from_bytes(raw[at : at + size], "little"), at + size
        else:
            return
        yield number, kind, value


def field(raw: bytes | None, path: str, kind: int) -> int | bytes | None:
    """The value of a field, by the numbers that lead to it: the first of its number and kind, null where there is none."""
    *outer, last = map(int, path.split("."))
    for number in outer:
        raw = next((v for n, k, v in fields(raw or b"") if n == number and k == 2), None)
        if raw is None:
            return None
    return next((v for n, k, v in fields(raw or b"") if n == last and k == kind), None)


def _count_field(raw: bytes | None, path: str) -> int | None:
    value = field(raw, path, 0)
    return None if value is None else min(value, (1 << 63) - 1)


def _text_field(raw: bytes | None, path: str) -> str | None:
    """A text; null where it is blank or no UTF-8."""
    value = field(raw, path, 2)
    try:
        text = (value or b"").decode()
    except UnicodeDecodeError:
        return None
    return text if text.strip() else None


def _stamp_ms(raw: bytes | None) -> int | None:
    """Milliseconds of a message of seconds and nanoseconds."""
    seconds, nanos = field(raw, "1", 0), field(raw, "2", 0) or 0
    if seconds is None or not 0 <= nanos < 10**9:
        return None
    seconds -= (1 << 64) if seconds >= 1 << 63 else 0
    found = seconds * 1000 + nanos // 10**6
    return found if abs(found) < 1 << 63 else None


def _time_field(raw: bytes | None, path: str) -> int | None:
    found = _stamp_ms(field(raw, path, 2))
    return found if found and found > 0 else None


# Years 2020 to 2099, and how far a time may lie before its session and after now.
_FIRST_MS, _LAST_MS, _AROUND_MS = 1_577_836_800_000, 4_102_444_800_000, 3_600_000


def _scaled(value: int | None) -> tuple[int, int] | None:
    """Which unit a number is a time in (0 seconds to 3 nanoseconds), and its milliseconds; the first unit that gives a year of use."""
    if value is None or value >= 1 << 63:
        return None
    return next(((unit, ms) for unit, ms in enumerate((value * 1000, value, value // 1000, value // 10**6)) if _FIRST_MS <= ms <= _LAST_MS), None)


def told_ms(raw: bytes | None, begun_ms: int | None, now_ms: int) -> int | None:
    """The time that a field of unknown form gives: a stamp, a number or eight bytes in either order; none unless it lies between its session's begin and now."""
    if raw is None or not begun_ms or begun_ms <= 0:
        return None

    def fits(ms: int | None) -> bool:
        return ms is not None and begun_ms - _AROUND_MS <= ms <= now_ms + _AROUND_MS

    stamp = _stamp_ms(raw)
    if fits(stamp) and _FIRST_MS <= stamp <= _LAST_MS:
        return stamp
    for kind in (0, 1):
        found = _scaled(field(raw, "1", kind))
        if found and fits(found[1]):
            return found[1]
    if len(raw) != 8:
        return None
    little, big = _scaled(int.from_bytes(raw, "little")), _scaled(int.from_bytes(raw, "big"))
    if little and big:
        # both orders give a time: the finer unit of the common order is the likelier, else nothing tells
        found = little[1] if little[1] == big[1] or big[0] > little[0] else None
    else:
        found = (little or big or (0, None))[1]
    return found if fits(found) else None


def _session_time(raw: bytes | None, begun_ms: int | None) -> int | None:
    return told_ms(field(raw, "1.9.10", 2), begun_ms, int(time.time() * 1000))


_FUNCTIONS = {"count_field": (2, _count_field), "text_field": (2, _text_field), "time_field": (2, _time_field), "session_time": (2, _session_time)}
_META = "(select time_field(data, '2') from trajectory_metadata_blob limit 1)"
_STEPS = "(select rowid as n, time_field(metadata, '1') as ms, trim(text_field(metadata, '9.11')) as response, count_field(metadata, '20.3') as gen from steps where step_type = 15 and metadata is not null)"


def _generations(begun: str, steps: str) -> str:
    counts = {"first_input": "1.4.1", "more_input": "1.4.2", "cache_read": "1.4.5", "output": "1.4.9", "reasoning": "1.4.10"}
    step = f"(select ms from {steps} s where ms > 0 and s.{{}} = g.{{}} order by n desc limit 1)" if steps else "null"
    return f"""with g as (select idx, {', '.join(f"coalesce(count_field(data, '{p}'), 0) as {k}" for k, p in counts.items())}, text_field(data, '1.4.11') as response, text_field(data, '1.19') as model, text_field(data, '1.21') as label,
 time_field(data, '1.9.4') as own_ms, session_time(data, {begun}) as guessed_ms, {begun} as begun from gen_metadata)
select *, coalesce(own_ms, guessed_ms, {step.format('response', 'response')}, {step.format('gen', 'idx')}, begun) as at from g order by idx"""


GENERATIONS = [_generations(b, s) for s in (_STEPS, "") for b in (_META, "null")]
_GENERATION = "idx bigint, first_input bigint, more_input bigint, cache_read bigint, output bigint, reasoning bigint, response string, model string, label string, at bigint"
# Labels that name no model, and models of labels.
_ROUTING = "gemini-default"
_LABELS = {"Gemini 3.5 Flash (Low)": "gemini-3.5-flash-extra-low", "Gemini 3.5 Flash (Medium)": "gemini-3.5-flash-medium", "Gemini 3.5 Flash (High)": "gemini-3.5-flash-high"}


def generation_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row a generation that used something, the first of each response, with its model.

    A generation whose model is a routing label takes that of its display label, if all that name one agree, or the
    session's only model, if it has no label and all labels of the session are known.
    """
    lines = reading.sqlite_rows(spark, root, "*.db", GENERATIONS, _FUNCTIONS)
    rows = lines.select("path", "modified_ms", "place", F.from_json("line", _GENERATION).alias("r")).select("path", "modified_ms", "place", "r.*")
    rows = rows.withColumn("named", F.when(F.lower(F.trim("model")) != _ROUTING, F.col("model")))
    named = rows.where("named is not null")
    by_label = named.where("label is not null").groupBy("path", "label").agg(F.count_distinct(names.alias_key(F.col("named"))).alias("n"), F.min_by("named", "place").alias("labelled")).where("n = 1").select("path", "label", "labelled")
    open_ = rows.where("named is null and label is not null").select("path", "label").distinct().join(by_label, ["path", "label"], "left_anti").select("path").distinct()
    sole = named.groupBy("path").agg(F.count_distinct("named").alias("n"), F.first("named").alias("sole")).where("n = 1").select("path", "sole").join(open_, "path", "left_anti")
    known = F.element_at(F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair]), F.trim("label"))
    used = rows.where("greatest(first_input, more_input, cache_read, output, reasoning) > 0").withColumn("nth", F.row_number().over(Window.partitionBy("path", F.coalesce("response", F.concat(F.lit("\0"), "place"))).orderBy("place"))).where("nth = 1")
    found = used.join(by_label, ["path", "label"], "left").join(sole, "path", "left")
    raw = F.coalesce("named", F.when(F.col("label").isNotNull(), F.col("labelled")).otherwise(F.col("sole")), known, "model", F.lit("unknown"))
    return found.withColumns({"raw": raw, "provider": names.resolved_provider(F.lit(None).cast("string"), raw, "antigravity")})


# Events keyed by a sequence.
_EVENT = """type string, id string, seq bigint, seedLength bigint, time bigint, data struct<header struct<config struct<provider string, model string>>, compactionId string, usage struct<inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint, reasoningTokens bigint>,
 message struct<id string, source struct<provider string, model string, replayState struct<response struct<responseModel string>>>>>"""


def sequence_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row a use of an event log: replies and summaries, but those copied from the session that a log was seeded with.

    A use is known by its message, its summary or its place in the sequence, its time, model and counts: what a log
    repeats, and what another log has of it, has the same key.
    """
    lines = reading.lossy_lines(spark, root, "session.jsonl*")
    rows = lines.withColumn("row", F.from_json("line", f"{_EVENT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).where("row.type is not null and row._corrupt is null")
    here = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda when, value: F.last(F.expr(f"if(row.type = '{when}', struct({value} as v), null)"), ignorenulls=True).over(here)["v"]
    rows = rows.withColumns({"head": last("session", "row.id"), "seed": last("session", "row.seedLength"), "by": last("request/header", "row.data.header.config.provider"), "with": last("request/header", said("row.data.header.config.model"))})
    rows = rows.where("row.type in ('assistant/message', 'compaction/summary') and row.data.usage is not null and row.time > 0 and not coalesce(seed > 0 and row.seq < seed, false)")
    source = "row.data.message.source"
    for name, value in {
        "all_output": whole("row.data.usage.outputTokens"), "reasoning": f"least({whole('coalesce(row.data.usage.reasoningTokens, 0)')}, coalesce(all_output, 0))", "output": "coalesce(all_output, 0) - reasoning",
        "input": f"coalesce({whole('row.data.usage.inputTokens')}, 0)", "cache_read": f"coalesce({whole('row.data.usage.cacheReadTokens')}, 0)", "cache_write": f"coalesce({whole('row.data.usage.cacheWriteTokens')}, 0)",
        "model": f"coalesce({said(f'{source}.replayState.response.responseModel')}, {said(f'{source}.model')}, with, 'unknown')", "provider": f"coalesce({source}.provider, by, 'unknown')",
        "session": r"coalesce(head, regexp_extract(path, '([^/]+)/[^/]+$', 1))", "summary": "row.type = 'compaction/summary'",
        "identity": f"coalesce('msg:' || {said('row.data.message.id')}, if(summary, 'cmp:' || {said('row.data.compactionId')}, null), 'seq:' || row.seq, 'sid:' || session)",
        "key": "concat_ws(':', 'dsh', if(summary, 'summary', null), identity, row.time, provider, model, input, output, cache_read, cache_write, reasoning)",
    }.items():
        rows = rows.withColumn(name, F.expr(value))
    used = rows.where("greatest(input, output, cache_read, cache_write, reasoning) > 0")
    return used.withColumn("nth", F.row_number().over(Window.partitionBy("path", "key").orderBy("place"))).where("nth = 1")


RECORDS: dict[str, Adapter] = {
    "lmstudio": Adapter(
        "lmstudio", "*.log", "lines", read=log_records, told=True, used="true",
        columns={"session_id": "'lmstudio:' || left(sha2(path, 256), 12)", "message_id": "said_id", "model_id": "coalesce(said_model, 'unknown')", "provider_id": "'lmstudio'", "time": "coalesce(replace(said_time, ' ', 'T') || 'Z', cast(modified_ms as string))", "input": "total - all_output - cache_read - cache_write",
                 "output": "all_output - reasoning", "cache_read": "cache_read", "cache_write": "cache_write", "reasoning": "reasoning", "cost": "0.0", "dedup_key": "'lmstudio:' || coalesce(said_id, sha2(concat_ws(':', path, place, said_model, prompt, all_output), 256))"},
    ),
    "antigravity-cli": Adapter(
        "antigravity-cli", "*.db", "sqlite", read=generation_rows, told=True,
        columns={"session_id": STEM, "message_id": "cast(idx as string)", "model_id": "raw", "provider_id": "provider", "time": "cast(coalesce(at, modified_ms) as string)", "input": "first_input + more_input", "output": "output", "cache_read": "cache_read", "reasoning": "reasoning", "dedup_key": "response"},
    ),
    "dsh": Adapter(
        "dsh", "session.jsonl*", "lines", read=sequence_rows, told=True,
        columns={"session_id": "session", "message_id": "row.data.message.id", "model_id": "model", "provider_id": "provider", "time": "cast(row.time as string)", "input": "input", "output": "output", "cache_read": "cache_read", "cache_write": "cache_write", "reasoning": "reasoning", "dedup_key": "key"},
    ),
}
