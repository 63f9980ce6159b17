"""Best-fit packing of tokenised documents into sequences of fixed capacity, certified by lower bounds.

Pieces are dealt into groups of bounded size. Each group is packed by best-fit decreasing, and dual feasible
functions bound from below how many sequences its pieces need. A group whose count meets its bound is done, but
for its emptiest sequence; the open sequences of the other groups, and those emptiest ones, give up their pieces,
which are dealt anew into fewer groups and packed again.

Defined results: a null text is an empty document, which still holds the closing id, so every row yields a piece.
Repeated rows are packed as often as they occur. Equal lengths are taken in any order. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.counting import encoder_for, vocabulary_path
from tidemark.session import cut_lineage, extended, share_package

CAPACITY = 2048
END_ID = 0
#: Pieces in a group; one task holds one group at a time.
GROUP_ITEMS = 8_192
#: Rounds of exchange at most. What no bound certifies by then is told in the column certified.
ROUNDS = 4


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all but the first are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, keep: list[str], text: str = "text", capacity: int = CAPACITY, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """keep, piece, start, length and ids_crc32 for each piece of each row; a map without a shuffle."""
    share_package(docs.sparkSession)
    default = path is None
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = extended(source.schema.fields[:-1], "piece int, start bigint, length bigint, ids_crc32 bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path or vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken") if default else ranks)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            rows, out = [], []
            column = batch.column(len(keep))
            for i in range(batch.num_rows):
                ids = np.concatenate([encoder.ids(column[i].as_py()), end])
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    rows.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            kept = batch.take(pa.array(rows, pa.int64()))
            arrays = [*(kept.column(i) for i in range(len(keep))), *(pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the largest bound that two families of dual feasible functions give."""
    if not len(lengths):
        return 0
    sizes, times = np.unique(lengths.astype(np.int64), return_counts=True)
    best = -(-int((sizes * times).sum()) // capacity)
    for cut in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < cut <= capacity // 2:
            value = np.where(sizes > capacity - cut, capacity, np.where(sizes >= cut, sizes, 0))
            best = max(best, -(-int((value * times).sum()) // capacity))
    for k in range(1, 9):
        scaled = (k + 1) * sizes
        # in units of 1 / (k * capacity): x stays where (k + 1) x is whole, else its floor over k
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * times).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, fill of each bin): each item goes where the least room is left."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a bin has room r
    for i in order.tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _filler(names: list[str], capacity: int, step: int, last: bool):
    """Packs one group; open says whether a sequence gives its pieces up to the next round."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        open_bins = np.zeros(len(fills), bool)
        certified = len(fills) <= lower_bound(lengths, capacity)
        if not last:
            if not certified:
                open_bins = fills < capacity
            open_bins[int(np.argmin(fills))] = True
        base = (step << 56) + (int(pdf["__group"].iloc[0]) << 20)
        return pdf[names].assign(sequence_id=base + bins, offset=offsets, certified=certified, open=open_bins[bins])

    return fill


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id, offset and certified (whether the piece's partition has as few sequences as a bound allows). pieces has a column length, from 1 to capacity, and is read more than once."""
    spark = pieces.sparkSession
    share_package(spark)
    names = pieces.columns
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    todo, done = pieces.where(F.col("length") < capacity), [full]
    schema = extended(pieces.schema.fields, "sequence_id bigint, offset bigint, certified boolean, open boolean")
    before = None
    for step in range(rounds):
        n = todo.count()
        groups = max(1, -(-n // group_items))
        last = step == rounds - 1 or groups == 1 or before == (n, groups)
        before = (n, groups)

        dealt = todo.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(step)), F.lit(groups)))
        packed = cut_lineage(dealt.groupBy("__group").applyInPandas(_filler(names, capacity, step, last), schema), f"packed{step}")
        done.append(packed.where(~F.col("open")).drop("open"))
        if last:
            break
        todo = packed.where("open").select(*names)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, keep: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece."""
    return pack(cut_lineage(tokenised_pieces(docs, keep, text, capacity), "pieces"), capacity)
