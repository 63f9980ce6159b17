"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Defined results: a null or letterless text has no language and goes in the first stage, so later ones see none in a
run; called alone, they take it as empty text. Repeated rows are near duplicates of each other, so one stays. Rows of
one id with different texts are judged apart. A null id is kept as it is, and packed like any other. Other columns
come through unchanged, whatever their names. Empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, langid, neardup, packing, pii
from tidemark.session import cut_lineage, table

#: Iterative classes, a learned field and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one, so that names which an operator adds cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _restored(found: DataFrame, docs: DataFrame, **changed: str) -> DataFrame:
    """The columns of docs in their order."""
    return found.select(*[F.expr(changed[c]).cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; a missing lang is filled with the prediction."""
    model = langid.fit(docs)
    held = _carried(docs)
    found = langid.predict(held.withColumn("body", F.col("text")), model, ["row", "body"]).withColumnRenamed("body", "text")
    kept = found.where(F.col("lang_pred") != langid.UNDETERMINED) if model.langs else found.where(F.col("text").rlike(r"\p{L}"))
    return _restored(kept, docs, lang="coalesce(row.lang, lang_pred)")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the smallest doc_id, a null one last; of equal ids that of the smallest hash of its text."""
    rows = cut_lineage(_carried(docs).withColumn("number", F.monotonically_increasing_id()), "rows")
    classes = neardup.near_duplicates(rows, "number").select(F.col("id").alias("number"), "class_id")
    keys = rows.select("number", F.col("row.doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "number")
    first = classes.join(keys, "number").groupBy("class_id").agg(F.min(order).alias("first")).select("first.number")
    return _restored(rows.join(first, "number", "left_semi"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    held = _carried(docs).withColumn("body", F.col("text"))
    found = decontaminate.decontaminate(held, table(spark, sf_dir, "benchmark"), ["row", "body"]).withColumnRenamed("body", "text")
    return _restored(found.where(~F.col("contaminated")), docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets; n_chars follows."""
    found = pii.find_spans(_carried(docs), pii.fit(docs), ["row"]).withColumnRenamed("redacted", "text")
    return _restored(found, docs, n_chars="length(text)")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), ["doc_id"])


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name)
    return docs
