"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Vectors are indexed in blocks. A block's postings (dimension, vector, value) are put into segments by quantised
impact: segment j holds the values whose magnitude has j bits. For a block of queries the segments are taken from
the highest impact down and add to one accumulator for each query and vector. What a vector's postings below a
segment can still add is at most the product of the two remaining lengths (Cauchy and Schwarz); as soon as that
proves that few vectors can be among the k best, exactly these are scored anew with all their values. Where nothing
can be proved, all segments are taken, and the accumulators are the scores. A block of no more vectors than that few
needs no proof: all of them are scored.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part. Shorter
vectors count as filled up with zeros. Equal scores go to the smaller id, repeated rows are as many candidates, and
rows with the query's id are its own. Queries are the distinct pairs of id and vector among those asked for. A null
id takes no part. Scores beyond 64 bits are held at the largest or smallest one. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import cut_lineage, share_package, shared_dir

K = 5
SCALE = 256
#: Queries in one broadcast, vectors in one block of the index, and queries that are scored at once.
QUERY_BLOCK, BLOCK, BATCH = 16_384, 16_384, 128
#: A query stops where at most so many of a block's vectors, times k, can still be among its best.
FEW = 16
_LARGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and values (floor of scale times each component) of the vectors that take part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(good).select(F.col(key).cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x * scale).cast("double")).alias("values"))


def _matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class ImpactIndex:
    """Segments of one block's postings, the highest impact first, and the length of what lies below each."""

    def __init__(self, values: np.ndarray, exact: type):
        self.values = values
        bits = np.frexp(np.abs(values))[1]  # quantised impact: the number of bits
        self.segments: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        rest = values.copy()
        for level in sorted(set(np.unique(bits).tolist()) - {0}, reverse=True):
            part = np.where(bits == level, values, 0)
            rest = rest - part
            self.segments.append(part.T.astype(exact))
            self.below.append(np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9))

    def search(self, queries: np.ndarray, k: int, exact: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, members, scores): every member of the k best, ties at the last place included, and few others."""
        n = len(self.values)
        open_ = np.arange(len(queries))
        sums = np.zeros((len(queries), n), exact)
        sizes = np.sqrt((queries * queries).sum(axis=1)) * (1 + 1e-9)
        few = max(FEW * k, n // 256)
        for segment, below in zip(self.segments, self.below):
            sums[open_] += queries[open_].astype(exact) @ segment
            ended = not below.any()
            if not ended and n > few:
                # a sample of the lower bounds' k-th best is a valid threshold already
                room = sizes[open_, None] * below[None, :]
                low = sums[open_] - room
                least = np.partition(low, n - k, axis=1)[:, n - k] if n >= k else low.min(axis=1)
                possible = sums[open_] + room >= least[:, None] - 0.5
                proved = possible.sum(axis=1) <= few
            elif ended:
                # the accumulators are the scores
                best = sums[open_]
                least = np.partition(best, n - k, axis=1)[:, n - k] if n >= k else best.min(axis=1)
                possible, proved = best >= least[:, None], np.ones(len(open_), bool)
            else:
                possible, proved = np.ones((len(open_), n), bool), np.ones(len(open_), bool)
            for row in np.flatnonzero(proved).tolist():
                members = np.flatnonzero(possible[row])
                yield int(open_[row]), members, self.values[members] @ queries[open_[row]]
            open_ = open_[~proved]
            if not len(open_):
                return
        for q in open_.tolist():  # no segments: all values are 0
            yield q, np.arange(n), np.zeros(n)


def _huge(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores in whole numbers of any size, held to 64 bits."""
    exact = [sum(int(a) * int(b) for a, b in zip(row, query) if a and b) for row in values]
    return np.array([max(-_LARGEST - 1, min(_LARGEST, x)) for x in exact], dtype=np.int64)


def block_best(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query place, id and score of each query's k best in one block, its own rows left out."""
    width = max(values.shape[1], queries.shape[1])
    values, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (values, queries))
    most = (np.abs(values).max(initial=0) * np.abs(queries).sum(axis=1).max(initial=0)) if len(queries) else 0.0
    small = most < 1 << 24
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(q: int, members: np.ndarray, scores: np.ndarray) -> None:
        best = np.lexsort((ids[members], -scores))
        best = best[ids[members][best] != query_ids[q]][:k]
        out.append((np.full(len(best), q), ids[members][best], scores[best].astype(np.int64)))

    own = np.isin(query_ids, ids)
    if most >= 1 << 52:
        for q in range(len(queries)):
            add(q, np.arange(len(ids)), _huge(values, queries[q]))
    else:
        exact = np.float32 if small else np.float64
        index = ImpactIndex(values, exact)
        repeats = np.unique(ids, return_counts=True)[1].max(initial=1)
        for first in range(0, len(queries), BATCH):
            part = slice(first, first + BATCH)
            # a query's own rows may be among its best, so as many more are asked for
            more = k + int(repeats if own[part].any() else 0)
            for q, members, scores in index.search(queries[part], min(more, len(ids)), exact):
                add(first + q, members, scores)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query, with their rank."""
    order = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score. Both frames have id and values; queries are taken in blocks of bounded size.

    With several blocks each is a round of its own: its best rows are written to the shared folder, and its broadcast
    is released before the next one. The plan and what is held at once do not grow with the number of blocks.
    """
    spark = candidates.sparkSession
    share_package(spark)
    queries = queries.dropDuplicates(["id", "values"])
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    if blocks > 1:
        queries = cut_lineage(queries, "queries")
    path = f"{shared_dir(spark)}/best-{uuid.uuid4().hex}"
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id", "values"), F.lit(blocks)) == block) if blocks > 1 else queries
        held = part.toArrow()
        shared = spark.sparkContext.broadcast((held["id"].to_numpy().astype(np.int64), _matrix(held["values"].combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, vectors = shared.value

            def best(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
                whole = pa.Table.from_batches(rows).combine_chunks()
                q, ids, scores = block_best(whole["id"].to_numpy().astype(np.int64), _matrix(whole["values"].chunk(0)), query_ids, vectors, k)
                return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(query_ids[q], pa.int64()), pa.array(ids), pa.array(scores)], names=["q", "query_id", "vec_id", "score"])

            held, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                n += batch.num_rows
                if n >= BLOCK:
                    yield best(held)
                    held, n = [], 0
            if n:
                yield best(held)

        found = _best(candidates.mapInArrow(run, "q bigint, query_id bigint, vec_id bigint, score bigint"), k)
        if blocks == 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.parquet(path).select("query_id", "rank", "vec_id", "score")
