"""Fingerprints of texts by locally consistent parsing.

A text is a sequence of names, at first its characters. On each level a run of one name becomes one name; then
deterministic coin tossing gives every name a label below six that depends on the name and the four before it, and
each local minimum of the labels opens a phrase. A phrase is named by a hash of the names in it, and the phrases are
the sequence of the next level, until one name is left. Where phrases begin depends on a few names around, never on
the offset, so equal substrings are cut and named alike but for their ends, in any text and on any machine.

A fingerprint is `root.phrases.pieces`: the name of the whole text (16 hexadecimal digits); the PHRASES smallest
hashes of phrases of the second level and above and of what fills long runs, a name's second, third ... occurrence
being names of their own; and, where these are fewer than SHORT, the PIECES smallest hashes of characters and
first-level phrases (8 digits each). Equal texts have equal fingerprints, and the likeness of two is an estimate of
the share of phrases that both texts have.

Defined results: a null text counts as empty, whose fingerprint has the root 0 and no names. Ids are whole numbers.
The next document is that of the next larger id, after the largest that of the smallest; of several documents of one
id the one with the smallest hash of its text stands for it, and rows of one id all have the same next one. Rows
without an id are no one's next one; their own is that of the smallest id, or an empty text if there is no id at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import extended, share_package

#: Names that a fingerprint keeps, and below how many phrases it keeps smaller pieces too.
PHRASES, PIECES, SHORT = 64, 16, 16
#: A run of a character counts once for so many of it, one of a first-level phrase likewise, later ones each time.
LONG_RUN = {0: 8, 1: 2}
#: Characters that are parsed at once, but for a single longer text; names that are labelled at once.
BATCH_CHARS, SEGMENT = 1 << 20, 1 << 16
#: Ranges of ids for each shuffle partition, and in all: bounds that the driver holds.
RANGES, MOST_RANGES = 8, 1 << 15

_GOLDEN, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: Each lowest set bit times this number has another value in its top six bits.
_SPREAD = np.uint64(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, np.uint8)
_PLACE[[(1 << k) * int(_SPREAD) % (1 << 64) >> 58 for k in range(64)]] = range(64)
#: Context on the left that a border depends on: four rounds of tossing and the label before.
_LEFT = 5


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close ones are far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss_table() -> np.ndarray:
    """The label of each pair of labels below 128: twice the lowest place where they differ, and the first one's bit there."""
    x, y = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = np.maximum((x ^ y) & -(x ^ y), 1)
    place = np.log2(low).astype(int)
    return (2 * place + (x >> place & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; those of neighbours differ. The name before a text's first one is taken as its own with another last bit."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[0] = names[0] ^ _ONE
    before[first] = names[first] ^ _ONE
    differ = names ^ before
    place = _PLACE[((differ & (~differ + _ONE)) * _SPREAD) >> np.uint64(58)]
    label = place * np.uint8(2) + ((names >> place) & _ONE).astype(np.uint8)
    for _ in range(3):
        pairs = label.astype(np.int32) << 7
        pairs[1:] |= label[:-1]
        pairs[0] |= label[0] ^ 1
        pairs[first] = (label[first].astype(np.int32) << 7) | (label[first] ^ 1)
        label = _TOSS[pairs]
    return label


def _borders(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each name; worked out in segments, whose ends see the names around."""
    found = np.empty(len(names), bool)
    for at in range(0, len(names), SEGMENT):
        low, high = max(at - _LEFT, 0), min(at + SEGMENT + 1, len(names))
        head = first[low:high]
        label = _labels(names[low:high], np.flatnonzero(head))
        least = np.zeros(len(label), bool)
        least[1:] = label[1:] < label[:-1]
        # the last name of a text has nothing after it
        least[:-1] &= (label[:-1] < label[1:]) | head[1:]
        end = min(at + SEGMENT, len(names))
        found[at:end] = (least | head)[at - low : end - low]
    return found


def _named(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name for each phrase, of the names in it and their places."""
    found = np.empty(len(at), np.uint64)
    for k in range(0, len(at), SEGMENT):
        starts = at[k : k + SEGMENT]
        low, high = starts[0], at[k + SEGMENT] if k + SEGMENT < len(at) else len(names)
        starts = starts - low
        place = np.arange(high - low) - np.repeat(starts, np.diff(starts, append=high - low))
        found[k : k + SEGMENT] = np.add.reduceat(_mixed(names[low:high] + (place.astype(np.uint64) + _ONE) * _GOLDEN), starts)
    return _mixed(found)


def _smallest(names: list[np.ndarray], owner: list[np.ndarray], texts: int, most: int) -> tuple[list[str], np.ndarray]:
    """For each text the smallest hashes of its names as hexadecimal digits, and how many names it has; the second, third ... time that a name occurs counts as another name."""
    if not names:
        return [""] * texts, np.zeros(texts, np.int64)
    keys = np.sort((np.concatenate(owner).astype(np.uint64) << np.uint64(40)) | (np.concatenate(names) >> np.uint64(24)))
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    nth = np.arange(len(keys)) - np.repeat(at, np.diff(at, append=len(keys)))
    whose = keys >> np.uint64(40)
    hashes = _mixed((keys & np.uint64((1 << 40) - 1)) + nth.astype(np.uint64) * _GOLDEN) >> np.uint64(32)
    keys = np.sort((whose << np.uint64(32)) | hashes)
    count = np.bincount(whose.astype(np.int64), minlength=texts)
    rank = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
    digits = (keys[rank < most] & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    ends = np.cumsum(np.minimum(count, most)) * 8
    return [digits[a:b] for a, b in zip([0, *ends[:-1]], ends)], count


def fingerprints_of(texts: list[str]) -> list[str]:
    """The fingerprint of each text. Memory is about 60 bytes a character of all, so give texts in batches."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    roots = np.zeros(len(texts), np.uint64)
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    phrases: list[tuple[np.ndarray, np.ndarray]] = []
    level = 0
    while len(names):
        (pieces if level < 2 else phrases).append((names, owner))
        first = np.ones(len(names), bool)
        first[1:] = owner[1:] != owner[:-1]
        # texts of one name are done
        alone = first & np.append(first[1:], True)
        if alone.any():
            roots[owner[alone]] = names[alone]
            names, owner, first = names[~alone], owner[~alone], first[~alone]
        if not len(names):
            break
        head = first.copy()
        head[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(head)
        if len(at) < len(names):
            length = np.diff(at, append=len(names))
            names, owner, first = names[at], owner[at], first[at]
            # a long run counts by its length, as no phrase within it is left
            times = np.where(length > 1, length // LONG_RUN.get(level, 1), 0)
            phrases.append((np.repeat(_mixed(names + _GOLDEN), times), np.repeat(owner, times)))
            run = length > 1
            names[run] = _mixed(names[run] ^ _mixed(length[run].astype(np.uint64) * _GOLDEN))
        at = np.flatnonzero(_borders(names, first))
        names, owner = _named(names, at), owner[at]
        level += 1
    coarse, count = _smallest([n for n, _ in phrases], [o for _, o in phrases], len(texts), PHRASES)
    # only short texts need pieces
    chosen = [(n, o, (count < SHORT)[o]) for n, o in pieces]
    fine, _ = _smallest([_mixed(n[c] + _GOLDEN) for n, _, c in chosen], [o[c] for _, o, c in chosen], len(texts), PIECES)
    roots[lengths > 0] = _mixed(roots[lengths > 0] + _GOLDEN)
    return [f"{root:016x}.{a}.{b}" for root, a, b in zip(roots.tolist(), coarse, fine)]


def _both(a: str, b: str, most: int) -> tuple[int, int]:
    """Of the smallest names of two lists together: how many both have, and how many there are."""
    x, y = ({s[k : k + 8] for k in range(0, len(s), 8)} for s in (a, b))
    united = x | y
    low = united if len(united) <= most else set(sorted(united)[:most])
    return len(low & x & y), len(low)


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of phrases that two fingerprints' texts have in common; pieces fill up where there are few phrases."""
    if a == b:
        return 1.0
    (_, a_phrases, a_pieces), (_, b_phrases, b_pieces) = a.split("."), b.split(".")
    same, every = _both(a_phrases, b_phrases, PHRASES)
    if every < SHORT:
        fine_same, fine_every = _both(a_pieces, b_pieces, PIECES)
        if fine_every:
            weight = min(1.0, (SHORT - every) / fine_every)
            same, every = same + fine_same * weight, every + fine_every * weight
    return same / every if every else 0.0


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns keys, n_chars and fingerprint of each document: one pass, no shuffle."""
    share_package(docs.sparkSession)
    source = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = extended([docs.schema[k] for k in keys], "n_chars bigint, fingerprint string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_characters(batch, len(keys)):
                texts = part.column(len(keys)).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(map(len, texts), pa.int64()), pa.array(fingerprints_of(texts), pa.string())], names=schema.names)

    return source.mapInArrow(read, schema)


def _by_characters(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_CHARS bytes of text, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(int(np.searchsorted(size, done + BATCH_CHARS, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


class _Ranges:
    """Ranges of ids, for each the smallest id of the range after it, and over how many places its rows go."""

    def __init__(self, docs: DataFrame, key: str, most: int):
        ids = docs.select(F.col(key).cast("long").alias("id"))
        found = ids.agg(F.percentile_approx("id", [k / most for k in range(1, most)] or [0.5], max(10_000, 10 * most)).alias("at")).first()["at"] or []
        # an id that fills whole ranges gets one of its own
        often = {a for a, b in zip(found, found[1:]) if a == b}
        self.edges = np.array(sorted({*found, *(v - 1 for v in often)}), np.int64)
        edges = self.edges

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.Table.from_batches([batch]).append_column("range", pa.array(_range_of(edges, batch.column(0))))
                summed = rows.group_by("range").aggregate([("id", "min"), ("id", "max"), ("id", "count"), ("range", "count")])
                yield pa.RecordBatch.from_arrays([summed[c].combine_chunks() for c in ("range", "id_min", "id_max", "range_count")], names=["range", "low", "high", "rows"])

        parts = ids.mapInArrow(count, "range int, low bigint, high bigint, rows bigint").groupBy("range").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
        stats = sorted(tuple(r) for r in parts.collect())  # at most two rows a range
        whole = max(1, 2 * sum(r[3] for r in stats) // most)
        self.places = {r[0]: -(-r[3] // whole) if r[1] == r[2] else 1 for r in stats}
        known = [r for r in stats if r[1] is not None]
        #: where a copy of each range's first document goes: the range before, and those whose next one is the very first
        self.heads: dict[int, list[int]] = {}
        for (_, low, _, _), before in zip(known, [known[-1], *known[:-1]] if known else []):
            self.heads[low] = [before[0]]
        if known and len(known) < len(stats):
            self.heads[known[0][1]].append(stats[-1][0])


def _range_of(edges: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The range of each id; ids that are null go after all others."""
    found = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32)
    found[ids.is_null().to_numpy(zero_copy_only=False)] = len(edges) + 1
    return found


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, keys: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns keys, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    The edited text ends with the beginning of the next document in place of its last quarter. Ids are cut into ranges
    of about equal numbers of rows; texts are shuffled once, to their range, and a copy of a range's first document
    goes to the range before. A task reads a range from its end and holds one batch of texts. An id that fills
    whole ranges is dealt over several places, as all its rows have the same next document.
    """
    spark = docs.sparkSession
    share_package(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = _Ranges(docs, key, min(partitions * RANGES, MOST_RANGES))
    edges, places, heads = ranges.edges, ranges.places, ranges.heads
    n = len(keys)
    fields = [docs.schema[k] for k in keys]
    placed = extended(fields, "__id bigint, __text string, __hash binary, __range int, __place int, __own boolean")
    source = docs.select(*keys, F.col(key).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[bytes, str]] = {}
        at = 0
        for batch in batches:
            ids, texts = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            hashes = [hashlib.sha256(t.encode()).digest() for t in texts]
            found = _range_of(edges, batch.column(n))
            where = [(at + k) % places[r] for k, r in enumerate(found.tolist())]
            at += len(ids)
            for i, h, t in zip(ids, hashes, texts):
                if i in heads:
                    first[i] = min(first.get(i, (h, t)), (h, t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.binary()), pa.array(found, pa.int32()), pa.array(where, pa.int32()), pa.array([True] * len(ids))], names=placed.names)
        copies = [(i, t, h, r, p, False) for i, (h, t) in first.items() for r in heads[i] for p in range(places[r])]
        if copies:
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
            nothing = [pa.nulls(len(copies), c.type) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*nothing, *[pa.array(c, k) for c, k in zip(zip(*copies), kinds)]], names=placed.names)

    schema = extended(fields, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = ("", fingerprints_of([""])[0])
        where, group, following, last = None, None, nothing, nothing
        for batch in batches:
            for part in _by_characters(batch, n + 1):
                ids, texts, own = part.column(n).to_pylist(), part.column(n + 1).to_pylist(), part.column(n + 5).to_pylist()
                prints, nexts = fingerprints_of(texts), []
                for i, t, p, *at, o in zip(ids, texts, prints, part.column(n + 3).to_pylist(), part.column(n + 4).to_pylist(), own):
                    if at != where:
                        where, group, last = at, None, nothing
                    if (o, i) != group:
                        group, following = (o, i), last
                    nexts.append(following)
                    last = (t, p)
                kept = [k for k, o in enumerate(own) if o]
                edited = [_edited(texts[k], nexts[k][0]) for k in kept]
                changed = fingerprints_of(edited)
                columns = [
                    pa.array([len(texts[k]) for k in kept], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array([prints[k] for k in kept], pa.string()), pa.array(changed, pa.string()),
                    pa.array([likeness(prints[k], c) for k, c in zip(kept, changed)], pa.float64()), pa.array([likeness(prints[k], nexts[k][1]) for k in kept], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*[c.filter(part.column(n + 5)) for c in part.columns[:n]], *columns], names=schema.names)

    dealt = source.mapInArrow(place, placed).repartition(partitions, "__range", "__place")
    # copies of the next range's first document come first, then ids from the largest; of one id the smallest hash last
    ordered = dealt.sortWithinPartitions("__range", "__place", "__own", F.col("__id").desc(), F.col("__hash").desc())
    return ordered.mapInArrow(compare, schema)
