"""Readers of usage logs: JSON lines, JSON arrays, CSV and tables kept as JSON in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def json_lines(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """One row for each line that parses; blank and malformed lines are skipped, one bad line loses only itself."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    parsed = lines.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    return parsed.where("row is not null and row._corrupt is null").select("file", "row.*").drop("_corrupt")


def json_files(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path, schema=schema, multiLine=True)


def csv_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage exports in either header layout; costs may carry a dollar sign, unreadable numbers are null."""
    rows = spark.read.csv(path, header=True, escape='"')
    cost = "Cost"
    long = lambda name: F.expr(f"try_cast(`{name}` as bigint)")
    return rows.select(
        epoch_ms(F.col("Date")).alias("timestamp_ms"),
        F.col("Model").alias("model_id"),
        long("Input (w/o Cache Write)").alias("input"),
        long("Input (w/ Cache Write)").alias("cache_write"),
        long("Cache Read").alias("cache_read"),
        long("Output Tokens").alias("output"),
        F.expr(f"try_cast(regexp_replace(`{cost}`, '[$,]', '') as double)").alias("cost"),
    )


def prefer(preferred: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows of others only where no preferred row has their keys."""
    return preferred.unionByName(others.join(preferred.select(*keys).distinct(), list(keys), "left_anti"))


def epoch_ms(value: Column) -> Column:
    """Epoch milliseconds of seconds, milliseconds or an ISO time (without a zone: UTC); null where unreadable."""
    number = value.try_cast("double")
    scaled = F.when(F.abs(number) >= 1e12, number).otherwise(number * 1000).cast("long")
    text = value.cast("string")
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(scaled, F.unix_millis(F.try_to_timestamp(zoned)))


def uuid_v7_ms(value: Column) -> Column:
    return F.conv(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


# Characters of a first message, and how texts begin that a program puts in a user's mouth.
MOST_MESSAGE = 1_000
INJECTED = ("<environment_context>", "<system-reminder>", "<user_instructions>")


def first_user_messages(turns: DataFrame) -> DataFrame:
    """conv_id, the first text of a user's that is no program's, cut to MOST_MESSAGE characters (null where there is none), and the number of user turns."""
    trimmed = F.ltrim("text")
    own = (F.length(F.trim("text")) > 0) & ~F.greatest(*[F.startswith(trimmed, F.lit(p)) for p in INJECTED])
    first = F.min_by("text", F.when(own, F.col("turn")))
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.substring(first, 1, MOST_MESSAGE).alias("first_message"), F.count("*").alias("user_turns"))
