"""Connected components, and records that share aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) of every node in links(a, b): smallest neighbour, then pointer jumping."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut_lineage(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return labels


def merged_records(rows: DataFrame, key: str, aliases: str, request: str, measures: list[str], last: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row of each logical call, with the largest of each measure and the number of its records; and the columns last of its last record by order, nulls first.

    Records that share an alias, directly or through others, form a component. With at most one request id it is one
    call; with several, each request id is one, and records without any stay as they are. Records without an alias
    stand alone.
    """
    named = rows.select(key, F.explode(aliases).alias("alias")).where("alias is not null").distinct()
    # a record and the first record of its alias: a star for each alias, never all its pairs
    links = named.join(named.groupBy("alias").agg(F.min(key).alias("a")), "alias").select("a", F.col(key).alias("b"))
    roots = components(links).select(F.col("node").alias(key), "root")
    placed = rows.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    ids = placed.groupBy("root").agg(F.count_distinct(request).alias("ids"))
    call = F.when(F.col("ids") > 1, F.coalesce(F.concat(F.lit("r"), F.col(request)), F.concat(F.lit("k"), F.col(key).cast("string"))))
    return placed.join(ids, "root").withColumn("call", F.coalesce(call, F.lit(""))).groupBy("root", "call").agg(*[F.max(m).alias(m) for m in measures], F.count("*").alias("records"), *([F.max_by(F.struct(*last), F.struct(*order)).alias("__last")] if last else [])).select("root", "call", *measures, "records", *(["__last.*"] if last else []))
