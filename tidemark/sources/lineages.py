"""Log formats in which records tell of the same use: sessions that count what they started, and calls that are streamed.

A parent's reply tells sums that hold its children's replies; records of attribution say which part is a child's. Where
the child's own log is there, that part is counted there and taken off the parent. Which child's reply an attribution
means is found by a cheapest matching; where equally cheap ones leave an attribution out, or no reply fits, the part
stays with the parent. Forks copy replies and attributions, which count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import names
from tidemark.operators import graph, matching, trees
from tidemark.session import cut_lineage
from tidemark.sources.adapters import Adapter
from tidemark.sources.formats import STEM, said, whole
from tidemark.sources.logs import epoch_ms
from tidemark.sources.reading import lossy_lines

#: A child's reply and its attribution are written at most so many milliseconds apart. Fixed value.
NEAR_MS = 1_000
KINDS = ("input", "output", "cache_read", "cache_write")
_COUNTS = "struct<input bigint, output bigint, cacheRead bigint, cacheWrite bigint>"
_LINE = f"""type string, id string, targetId string, timestamp string, parentSession string, rlmDepth bigint, childUsage {_COUNTS}, aggregateUsage {_COUNTS},
 message struct<role string, model string, responseModel string, responseId string, provider string, usage {_COUNTS}>"""


def _usage(of: str) -> str:
    """SQL of the four counts as an array: rows of equal counts have equal arrays."""
    return "array(" + ", ".join(f"coalesce({whole(f'{of}.{k}')}, 0L)" for k in ("input", "output", "cacheRead", "cacheWrite")) + ")"


def lineages(forks: DataFrame) -> DataFrame:
    """path and lineage of forks(path, parent): the head of each chain of forks, the smallest path where chains close."""
    heads = trees.roots(forks, "path", "parent")
    loops = forks.join(heads, "path", "left_anti").where("parent is not null")
    closed = graph.components(loops.select(F.col("path").alias("a"), F.col("parent").alias("b"))).select(F.col("node").alias("path"), "root")
    return forks.select("path").distinct().join(heads, "path", "left").join(closed.withColumnRenamed("root", "loop"), "path", "left").select("path", F.coalesce("root", "loop", "path").alias("lineage"))


def edges(attributions: DataFrame, replies: DataFrame) -> DataFrame:
    """left, right and cost: attributions (name, owner, usage, at) and children's replies (name, parent, usage, at) that may mean the same.

    The reply's parent owns the attribution, the counts are equal, and both times are near, or neither has one. Times
    meet by their second and its neighbours, so a parent's many equal replies are not all compared.
    """
    cell = F.floor(F.col("at") / NEAR_MS)
    left = attributions.select(F.col("name").alias("left"), F.col("owner").alias("parent"), "usage", "at").withColumn("cell", F.explode(F.when(F.col("at").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(cell - 1, cell, cell + 1))))
    right = replies.select(F.col("name").alias("right"), "parent", "usage", F.col("at").alias("then")).withColumn("cell", F.coalesce(F.floor(F.col("then") / NEAR_MS), F.lit(-1)))
    met = left.join(right, ["parent", "usage", "cell"])
    apart = F.abs(F.col("at") - F.col("then"))
    both = F.col("at").isNull() & F.col("then").isNull()
    return met.where(both | (apart <= NEAR_MS)).select("left", "right", F.coalesce(apart, F.lit(NEAR_MS + 1)).alias("cost"))


def lineage_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row a reply with what it used itself, and what of its children no log of their own tells."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    lines = lossy_lines(spark, root, "*.jsonl").withColumn("row", F.from_json("line", f"{_LINE}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).where("row.type is not null and row._corrupt is null")
    lines = cut_lineage(lines.select(plain.alias("path"), "modified_ms", "place", "row", epoch_ms(F.col("row.timestamp")).alias("at")), "lineage")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    named = F.when(F.startswith("row.parentSession", F.lit("/")), F.col("row.parentSession")).when(F.col("row.parentSession").isNotNull(), F.concat(folder, F.lit("/"), F.col("row.parentSession")))
    heads = lines.where("row.type = 'session'").groupBy("path").agg(F.min_by(F.struct(F.col("row.id").alias("session"), named.alias("parent"), F.coalesce(F.col("row.rlmDepth") > 0, F.lit(False)).alias("child")), "place").alias("h")).select("path", "h.*")
    replies = lines.join(heads, "path").where("row.type = 'message' and row.message.role = 'assistant' and row.message.usage is not null").select(
        "path", "modified_ms", "place", "at", "child", "parent", "session", F.col("row.id").alias("id"), F.expr(f"coalesce({said('row.message.responseModel')}, {said('row.message.model')}, 'unknown')").alias("model"), F.expr(said("row.message.provider")).alias("by"), F.expr(_usage("row.message.usage")).alias("usage"),
        F.expr(f"coalesce('response:' || {said('row.message.responseId')}, 'message:' || row.id || ':' || coalesce(at, -1), path || ':' || place)").alias("key"),
    )
    replies = cut_lineage(replies, "replies")
    told = lines.where("row.type = 'child_usage_attributed' and row.id is not null and row.targetId is not null and row.childUsage is not null and row.aggregateUsage is not null")
    told = told.join(heads, "path").select("path", "place", "at", F.when(~F.col("child"), F.col("parent")).alias("fork"), F.col("row.id").alias("id"), F.col("row.targetId").alias("target"), F.expr(_usage("row.childUsage")).alias("part"), F.expr(_usage("row.aggregateUsage")).alias("sum"))
    line = lineages(heads.select("path", F.when(~F.col("child"), F.col("parent")).alias("parent")))
    told = cut_lineage(told.join(line, "path").withColumn("name", F.concat_ws("\0", "lineage", "id")), "attributions")
    # copies of an attribution are one, owned by every file that has it, the head of their forks and those that they were forked from
    owned = told.select("name", F.col("part").alias("usage"), "at", "place", "path", F.explode(F.array_distinct(F.filter(F.array("path", "lineage", "fork"), lambda p: p.isNotNull()))).alias("owner"))
    once = owned.groupBy("name").agg(F.min_by(F.struct("usage", "at"), F.struct("path", "place")).alias("one"), F.collect_set("owner").alias("owners")).select("name", "one.*", F.explode("owners").alias("owner"))
    children = replies.where("child and parent is not null").select(F.concat_ws("\0", "path", "place").alias("name"), "parent", "usage", "at")
    counted = matching.matched(edges(once, children)).where("certain").select(F.col("left").alias("name"), F.lit(True).alias("counted"))
    # of a reply's attributions those count that are in its sum: up to the last whose sum is what the reply tells
    aimed = told.alias("t").join(replies.alias("r"), (F.col("t.path") == F.col("r.path")) & (F.col("t.target") == F.col("r.id"))).select("r.key", "t.path", "r.usage", "t.place", "t.name", "t.part", "t.sum", F.col("t.target").alias("target"))
    last = F.max(F.when(F.col("sum") == F.col("usage"), F.col("place"))).over(Window.partitionBy("path", "target"))
    held = aimed.withColumn("last", last).where("place <= last")
    four = range(len(KINDS))
    parts = held.groupBy("key", "path").agg(F.array(*[F.sum(F.col("part")[k]) for k in four]).alias("taken"))
    kept = held.select("key", "name", "part").dropDuplicates(["key", "name"]).join(counted, "name", "left").where("counted is null").groupBy("key").agg(F.array(*[F.sum(F.col("part")[k]) for k in four]).alias("kept"))
    own = replies.join(parts, ["key", "path"], "left").select("key", "path", "place", "modified_ms", "at", "session", "model", "by", F.transform(F.arrays_zip("usage", F.coalesce("taken", F.array(*[F.lit(0).cast("long")] * len(KINDS))).alias("taken")), lambda x: F.greatest(x["usage"] - x["taken"], F.lit(0))).alias("own"))
    first = F.min_by(F.struct("path", "place", "modified_ms", "at", "session", "model", "by"), F.struct("path", "place")).alias("one")
    merged = own.groupBy("key").agg(first, *[F.max(F.col("own")[k]).alias(f"own_{name}") for k, name in enumerate(KINDS)]).join(kept, "key", "left")
    merged = merged.select("key", "one.*", *[(F.col(f"own_{name}") + F.coalesce(F.col("kept")[k], F.lit(0))).alias(name) for k, name in enumerate(KINDS)])
    return merged.withColumns({"provider": names.resolved_provider(F.col("by"), F.col("model"), "prime-agent"), "session": F.coalesce("session", F.expr(STEM))})


_CALL = "type string, timestamp string, requestId string, uuid string, message struct<id string, requestId string, uuid string, model string, usage struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint>>"


def call_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row a call of streamed logs: records of a file that share a request, a message or a uuid, directly or through others, are one call with the largest counts and the last record's model and time."""
    lines = lossy_lines(spark, root, "*.jsonl").withColumn("row", F.from_json("line", f"{_CALL}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).where("row._corrupt is null and row.type = 'assistant' and row.message.usage is not null")
    counts = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
    alias = lambda kind, value: f"'{kind}:' || path || ':' || {value}"
    request = said("coalesce(row.requestId, row.message.requestId)")
    rows = lines.select(
        F.concat_ws(":", "path", F.lpad(F.col("place").cast("string"), 20, "0")).alias("key"), "path", "modified_ms", epoch_ms(F.col("row.timestamp")).alias("at"), F.expr(f"{said('row.message.model')}").alias("model"), F.expr(request).alias("request"),
        F.array(*[F.expr(alias(kind, value)) for kind, value in (("request", request), ("message", said("row.message.id")), ("uuid", said("coalesce(row.uuid, row.message.uuid)")))]).alias("aliases"),
        *[F.expr(f"coalesce({whole(f'row.message.usage.{c}')}, 0L)").alias(k) for k, c in counts.items()],
    ).where("model is not null and model <> '<synthetic>' and lower(model) <> 'unknown' and greatest(input, output, cache_read, cache_write) > 0")
    rows = cut_lineage(rows, "calls")
    found = graph.merged_records(rows, "key", "aliases", "request", list(counts), ["path", "modified_ms", "at", "model"], ["at", "key"])
    return found.withColumn("provider", names.resolved_provider(F.lit(None).cast("string"), F.col("model"), "unknown"))


LINEAGES: dict[str, Adapter] = {
    "cherrystudio": Adapter(
        "cherrystudio", "*.jsonl", "lines", read=call_rows, told=True,
        columns={"session_id": STEM, "message_id": "root", "model_id": "model", "provider_id": "provider", "time": "cast(coalesce(at, modified_ms) as string)", **{k: k for k in KINDS}},
    ),
    "prime-agent": Adapter(
        "prime-agent", "*.jsonl", "lines", read=lineage_rows, told=True,
        columns={"session_id": "session", "message_id": "key", "model_id": "model", "provider_id": "provider", "time": "cast(coalesce(at, modified_ms) as string)", **{k: k for k in KINDS}, "dedup_key": "'prime-agent:' || key"},
    ),
}
