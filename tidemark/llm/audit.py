"""How filters of a corpus interact: what each removes in every order of applying them, from one count of failures.

A document fails a set of filters, written as a mask of bits. Documents are counted once by part and mask; a
subset-zeta transform of these counts gives, for every subset of filters, the documents that survive it. Any step
of any order is then the difference of two neighbouring subsets, for documents and for labels alike, so all orders
cost one pass over the corpus and 2^n counts a part.

Defined results: a null text counts as empty; null and empty part names are one part. A null id is smaller than
none, so such a row is never a later copy. Of several label rows of one id any that says yes counts; labels
without a document count nowhere. Repeated rows count as often as they occur. No documents, no rows.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut_lineage

LETTERS = "ABCDE"
#: Orders of more filters than this are too many to list; survivors() has no such bound.
MOST_FILTERS = 7


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides: few words, repeated words, capitals, signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 80,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failing_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, documents, good and toxic: how many documents of each part fail exactly the filters of each mask.

    Texts are read once and leave the first stage as a hash. The first of equal texts is found by a minimum a hash,
    and matched on hash and id together, so a text that a third of all rows share is spread by its ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(text_failures(F.col("text")).values())]
    mask = bits[0] + bits[1] + bits[2] + bits[3]
    facts = cut_lineage(read.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("hash")), "audit")
    firsts = facts.where("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    # rows without an id match nothing: they go by their hash, so that no task gets them all
    known = facts.where("doc_id is not null").join(firsts, ["hash", "doc_id"], "left").join(judged, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "good", "toxic")
    nameless = facts.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("documents"), one("good").alias("good"), one("toxic").alias("toxic"))


def survivors(masks: DataFrame, filters: int, measures: list[str]) -> DataFrame:
    """part and, for each measure, exact_<measure> and kept_<measure>: arrays by mask and by subset of filters.

    exact holds the counts of documents that fail just a mask; kept those that fail nothing in a subset. One round
    a filter: with its bit set only documents that pass it stay, without it all do.
    """
    size = 1 << filters
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures).alias("counts"))))
    found = masks.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in measures]).groupBy("part").agg(by_mask.alias("by_mask"))
    found = found.select("part", *[F.expr(f"transform(sequence(0, {size - 1}), i -> coalesce(by_mask[i].{m}, 0L))").alias(f"exact_{m}") for m in measures])
    found = found.withColumns({f"kept_{m}": F.col(f"exact_{m}") for m in measures})
    for k in range(filters):
        found = found.withColumns({f"kept_{m}": F.expr(f"transform(kept_{m}, (x, i) -> if((i & {1 << k}) > 0, kept_{m}[i - {1 << k}], x + kept_{m}[i + {1 << k}]))") for m in measures})
    return found


def order_steps(filters: str) -> list[dict[str, object]]:
    """Each step of each order: its place, its filter's bit, and the subset that was applied before it."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"orders of at most {MOST_FILTERS} filters can be listed")
    found = []
    for order in permutations(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            found.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return found


def audit(masks: DataFrame, filters: str = LETTERS) -> DataFrame:
    """One row a part, order of the filters and step, with what the step removes; masks as failing_masks() gives them.

    kept, removed: documents after the step, and lost by it. redundant: failing its filter, but gone before.
    unique_fails: failing no other filter. good_lost, toxic_lost: labelled documents among the removed. shapley: what
    its filter removes, summed over all orders.
    """
    steps = order_steps(filters)
    found = survivors(masks, len(filters), ["documents", "good", "toxic"])
    kept, bits = F.col("kept_documents"), [1 << k for k in range(len(filters))]
    # removed by each filter in all orders: each subset before it stands in as many orders as there are of both sides
    in_orders: dict[int, dict[int, int]] = {bit: {} for bit in bits}
    for s in steps:
        in_orders[s["bit"]][s["before"]] = in_orders[s["bit"]].get(s["before"], 0) + 1
    shapley = {bit: sum((kept[before] - kept[before | bit]) * n for before, n in counts.items()) for bit, counts in in_orders.items()}
    found = found.withColumn("by_filter", F.create_map(*[x for bit in bits for x in (F.lit(bit), shapley[bit])]))
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    found = found.withColumn("s", F.explode(listed)).select("*", "s.*")
    lost = lambda m: F.expr(f"kept_{m}[before] - kept_{m}[before + bit]")
    failing = F.expr("kept_documents[0] - kept_documents[bit]")
    return found.select(
        "part", "filter_order", "step", F.expr("kept_documents[before + bit]").alias("kept"), lost("documents").alias("removed"), (failing - lost("documents")).alias("redundant"),
        F.expr("exact_documents[bit]").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.expr("by_filter[bit]").alias("shapley"),
    )
