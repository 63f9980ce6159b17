"""Removal of repeated byte strings by sorted suffixes (deep-shallow sorting), over documents of any number.

A byte goes where a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. Equal strings pick equal anchors: the smallest hash among the string's runs of GRAM bytes.

1. Anchors: each document's text gives its anchors' hashes; hashes that occur twice are kept, by chunk of documents.
2. In each chunk the suffixes that start in the range of a kept anchor are sorted to LENGTH bytes. All but the first
   of equal ones are marked. The first ones, with their bytes, go to a bucket that their anchor names; those of very
   frequent anchors go by a hash of their own bytes, so that no bucket holds an unbounded group.
3. In each bucket suffixes are sorted again, and all but the first of equal ones are marked.
4. Marks return to their chunk, where the marked bytes leave the documents. The texts are shuffled by chunk once.

Sorting: multikey quicksort by words of eight bytes to SHALLOW bytes; groups that are still equal there are ordered
by blind tries, whose nodes hold only the depth of the first difference and the words that branch there. Both handle
all groups of a task at once.

Defined results: a null text is empty. Documents shorter than LENGTH lose nothing. Repeated rows of equal id and text
are one document and give equal results; rows of one id with different texts are ordered by a hash of their text; a
null id comes before all others. Only adjacent bytes are joined to one span. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.session import share_package

LENGTH, GRAM, SHALLOW = 100, 32, 32
#: Bytes of text in a chunk and in a bucket's share, about.
CHUNK_BYTES = 4 << 20
#: Anchors with more occurrences are dealt by their suffixes' own bytes.
FREQUENT = 8_000
_BASE = 0x9E3779B97F4A7C15 | 1
_NULL = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number in byte order; a view."""
    return np.ndarray(max(0, len(data) - 7), ">u8", data, strides=(1,))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram bytes from each place on; gram is a multiple of 8."""
    w = _words(data).astype(np.uint64)
    n = len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        h = (h ^ w[k : k + n]) * np.uint64(_BASE)
        h ^= h >> np.uint64(29)
    return _mixed(h)


def _sliding(x: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of each span of successive values."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x = pick(x[: len(x) - step], x[step:])
        width += step
    return x


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts) of each anchor: every start of length bytes belongs to one, the least hash inside."""
    low = _sliding(gram_hashes(data, gram), length - gram + 1, np.minimum)
    cut = np.flatnonzero(_groups(low))
    return low[cut], cut, np.diff(np.concatenate([cut, [len(low)]]))


def anchor_hashes(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The hash at each place that is the least one inside some string of length bytes; repeats near each other count too."""
    h = gram_hashes(data, gram)
    span = length - gram + 1
    ends = np.zeros(span - 1, np.uint64)
    return h[h == _sliding(np.concatenate([ends, _sliding(h, span, np.minimum), ends]), span, np.maximum)]


def _groups(order_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], order_keys[1:] != order_keys[:-1]])


def equal_suffixes(data: np.ndarray, places: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> list[np.ndarray]:
    """Groups of places (as indices into places) whose next length bytes are equal, by deep-shallow sorting; single ones are left out.

    The result is two arrays: the indices, group after group, and the group number of each.
    """
    words = _words(data)
    at = np.arange(len(places))
    group = np.zeros(len(places), np.int64)
    last = length - 8
    depths = [*range(0, last, 8), last]
    shallow_depths = [d for d in depths if d < shallow]
    for d in shallow_depths:
        if len(at):
            at, group = _split(words[places[at] + d].astype(np.uint64), at, group)
    deep = [d for d in depths if d >= shallow]
    done_at, done_group, made = [], [], 0
    while len(at):
        first = np.flatnonzero(_groups(group))
        sizes = np.diff(np.concatenate([first, [len(group)]]))
        head = np.repeat(places[at[first]], sizes)
        branch = np.full(len(at), len(deep))
        alive = np.arange(len(at))
        for k, d in enumerate(deep):
            differs = words[places[at[alive]] + d] != words[head[alive] + d]
            branch[alive[differs]] = k
            alive = alive[~differs]
        node = np.minimum.reduceat(branch, first)
        equal = np.repeat(node == len(deep), sizes)
        if equal.any():
            number = np.cumsum(_groups(group)) - 1
            done_at.append(at[equal])
            done_group.append(number[equal] + made)
            made += len(first)
        at, group, depth = at[~equal], group[~equal], np.repeat(node, sizes)[~equal]
        if len(at):
            at, group = _split(words[places[at] + np.array(deep)[depth]].astype(np.uint64), at, group)
    if not done_at:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return [np.concatenate(done_at), np.concatenate(done_group)]


def _split(keys: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order each group by keys, and split it where they differ; groups of one are dropped."""
    order = np.argsort(keys)
    if group[0] != group[-1]:
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(_groups(keys[order]))
        order = np.argsort(group * (len(keys) + 1) + rank)
    keys, at, group = keys[order], at[order], group[order]
    new = _groups(keys)
    new[1:] |= group[1:] != group[:-1]
    more = np.append(~new[1:], False)
    kept = more | ~new
    return at[kept], np.cumsum(new & more)[kept]


def _not_first(groups: list[np.ndarray]) -> np.ndarray:
    """All but the smallest index of each group."""
    at, group = groups
    if not len(at):
        return at
    first = np.flatnonzero(_groups(group))
    least = np.minimum.reduceat(at, first)
    return at[at != np.repeat(least, np.diff(np.append(first, len(at))))]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, number) of runs of successive starts; the input is sorted by doc and start."""
    if not len(doc):
        return doc, start, start
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    return doc[new], start[new], np.diff(np.concatenate([new, [len(doc)]]))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of first[1], ..."""
    if not len(n):
        return np.zeros(0, np.int64)
    return np.arange(int(n.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _blob(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


_FOUND = "kind int, key bigint, chunk bigint, ids binary, ties binary, starts binary, counts binary, data binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _grams(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, grams, chunks and counts: the anchors of the texts, summed within a few megabytes before the shuffle."""

    def run(batches):
        held_g, held_c, size = [], [], 0

        def flush():
            g, c = np.concatenate(held_g), np.concatenate(held_c)
            order = np.lexsort((c, g))
            g, c = g[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
            n = np.diff(np.concatenate([new, [len(g)]]))
            g, c = g[new], c[new]
            bucket = (g >> np.uint64(20)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.concatenate([np.diff(bucket[order]) != 0, [True]])) + 1
            rows, a = [], 0
            for b in ends.tolist():
                part = order[a:b]
                rows.append((int(bucket[part[0]]), _blob(g[part], "<u8"), _blob(c[part], "<i4"), _blob(np.minimum(n[part], 1 << 30), "<i4")))
                a = b
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "grams", "chunks", "counts"])

        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                if len(raw) >= LENGTH:
                    g = anchor_hashes(raw)
                    held_g.append(g)
                    held_c.append(np.full(len(g), batch.column(0)[i].as_py(), np.int64))
                    size += len(raw)
                if size > 4 * CHUNK_BYTES:
                    yield flush()
                    held_g, held_c, size = [], [], 0
        if size:
            yield flush()

    return docs.select("chunk", "text").mapInArrow(run, "bucket bigint, grams binary, chunks binary, counts binary")


def _repeated(grams: DataFrame) -> DataFrame:
    """chunk, grams and frequent: the hashes that occur more than once, for each chunk that holds them."""

    def run(table: pa.Table) -> pa.Table:
        g, c, n = _joined(table["grams"], "<u8"), _joined(table["chunks"], "<i4"), _joined(table["counts"], "<i4")
        order = np.argsort(g, kind="stable")
        g, c, n = g[order], c[order], n[order]
        first = np.flatnonzero(_groups(g))
        total = np.add.reduceat(n.astype(np.int64), first)
        total = np.repeat(total, np.diff(np.concatenate([first, [len(g)]])))
        kept = total > 1
        g, c, often = g[kept], c[kept], total[kept] > FREQUENT
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, bool)
        g, c, often = g[new], c[new], often[new]
        order = np.argsort(c, kind="stable")
        g, c, often = g[order], c[order], often[order]
        ends = [*(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)] if len(c) else []
        cuts = list(zip([0, *ends[:-1]], ends))
        return pa.table({"chunk": pa.array([int(c[a]) for a, _ in cuts], pa.int64()), "grams": pa.array([_blob(g[a:b], "<u8") for a, b in cuts], pa.binary()), "frequent": pa.array([_blob(often[a:b], "u1") for a, b in cuts], pa.binary())})

    return grams.groupBy("bucket").applyInArrow(run, "chunk bigint, grams binary, frequent binary")


class _Chunk:
    """The texts of a chunk end to end, in the order of (id, tie)."""

    def __init__(self, table: pa.Table):
        ids, ties = table["id"].to_numpy(), table["tie"].to_numpy()
        order = np.lexsort((ties, ids))
        self.ids, self.ties, self.times = ids[order], ties[order], table["times"].to_numpy()[order]
        column = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.texts = [np.frombuffer(column[int(i)].as_buffer(), np.uint8) for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])


def _sorted_chunks(docs: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """Marks within each chunk (kind 0) and the suffixes that go to a bucket (kind 1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            chunk, number = _Chunk(left), left["chunk"][0].as_py()
            known, often = _joined(right["grams"], "<u8"), _joined(right["frequent"], "u1")
            order = np.argsort(known)
            known, often = known[order], often[order]
            doc, start, gram, frequent = [], [], [], []
            for k, raw in enumerate(chunk.texts):
                if len(raw) < LENGTH:
                    continue
                g, first, n = anchors(raw)
                place = np.minimum(np.searchsorted(known, g), len(known) - 1)
                hit = known[place] == g
                g, first, n, place = g[hit], first[hit], n[hit], place[hit]
                start.append(_ranges(first, n))
                doc.append(np.full(len(start[-1]), k))
                gram.append(np.repeat(g, n))
                frequent.append(np.repeat(often[place], n))
            if doc:
                doc, start, gram, frequent = (np.concatenate(x) for x in (doc, start, gram, frequent))
                data = np.concatenate(chunk.texts)
                places = chunk.offsets[doc] + start
                again = _not_first(equal_suffixes(data, places))
                marked = np.zeros(len(places), bool)
                marked[again] = True
                d, s, n = _runs(doc[marked], start[marked])
                if len(d):
                    rows.append((0, number % buckets, number, _blob(chunk.ids[d], "<i8"), _blob(chunk.ties[d], "<i8"), _blob(s, "<i8"), _blob(n, "<i8"), b""))
                rest = ~marked
                doc, start, gram, frequent, places = doc[rest], start[rest], gram[rest], frequent[rest], places[rest]
                bucket = (gram >> np.uint64(20)).astype(np.int64) % buckets
                own = np.flatnonzero(frequent)
                if len(own):
                    h = np.zeros(len(own), np.uint64)
                    words = _words(data)
                    for d in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
                        h = (h ^ words[places[own] + d].astype(np.uint64)) * np.uint64(_BASE)
                        h ^= h >> np.uint64(29)
                    bucket[own] = (_mixed(h) >> np.uint64(20)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                ends = [*(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)] if len(order) else []
                for a, b in zip([0, *ends[:-1]], ends):
                    part = order[a:b]
                    d, s, n = _runs(doc[part], start[part])
                    text = data[_ranges(chunk.offsets[d] + s, n + LENGTH - 1)]
                    rows.append((1, int(bucket[part[0]]), number, _blob(chunk.ids[d], "<i8"), _blob(chunk.ties[d], "<i8"), _blob(s, "<i8"), _blob(n, "<i8"), _packed(text.tobytes())))
        return _table(rows)

    return docs.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(run, _FOUND)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)


def _sorted_buckets(found: DataFrame) -> DataFrame:
    """The marks within chunks, and those across chunks for each bucket of suffixes."""

    def run(whole: pa.Table) -> pa.Table:
        marks, table = whole.filter(pc.equal(whole["kind"], 0)), whole.filter(pc.equal(whole["kind"], 1))
        if not table.num_rows:
            return marks
        ids, ties, s, n = (_joined(table[c], "<i8") for c in ("ids", "ties", "starts", "counts"))
        data = np.frombuffer(b"".join(map(_unpacked, table["data"].to_pylist())), "u1")
        runs = np.array([len(x) // 8 for x in table["ids"].to_pylist()])
        chunks = np.repeat(table["chunk"].to_numpy(), runs)
        base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
        order = np.lexsort((s, ties, ids))  # smaller indices stand for earlier strings
        base, chunks, ids, ties, s, n = (x[order] for x in (base, chunks, ids, ties, s, n))
        places, start, of = _ranges(base, n), _ranges(s, n), np.repeat(np.arange(len(n)), n)
        again = np.sort(_not_first(equal_suffixes(data, places)))
        rows = []
        if len(again):
            r, first, count = _runs(of[again], start[again])
            order = np.argsort(chunks[r], kind="stable")
            r, first, count = r[order], first[order], count[order]
            ends = [*(np.flatnonzero(np.diff(chunks[r])) + 1).tolist(), len(r)]
            for a, b in zip([0, *ends[:-1]], ends):
                c = int(chunks[r[a]])
                rows.append((0, c, c, _blob(ids[r[a:b]], "<i8"), _blob(ties[r[a:b]], "<i8"), _blob(first[a:b], "<i8"), _blob(count[a:b], "<i8"), b""))
        return pa.concat_tables([marks, _table(rows)])

    return found.groupBy("key").applyInArrow(run, _FOUND)


def _removed(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents without their marked bytes."""
    out = "id bigint, tie bigint, times bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(8)]
        if left.num_rows:
            chunk = _Chunk(left)
            cover = np.zeros(int(chunk.offsets[-1]) + 1, np.int32)
            if right.num_rows:
                ids, ties, s, n = (_joined(right[c], "<i8") for c in ("ids", "ties", "starts", "counts"))
                by = {x: k for k, x in enumerate(zip(chunk.ids.tolist(), chunk.ties.tolist()))}
                doc = np.array([by[x] for x in zip(ids.tolist(), ties.tolist())], np.int64)
                np.add.at(cover, chunk.offsets[doc] + s, 1)
                np.add.at(cover, chunk.offsets[doc] + s + n + LENGTH - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for k, raw in enumerate(chunk.texts):
                own = gone[chunk.offsets[k] : chunk.offsets[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8)))
                kept = raw[~own]
                for column, x in zip(columns, (int(chunk.ids[k]), int(chunk.ties[k]), int(chunk.times[k]), len(raw), len(raw) - len(kept), len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), [{"a": a, "b": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])):
                    column.append(x)
        kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in out.split(", ")[:8]])

    return docs.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, out)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges that go) for each row."""
    share_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL)).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    repeated_ids = rows.groupBy("id").count().where("count > 1").limit(1).count()
    rows = rows.groupBy("id", "text").agg(F.count("*").alias("times")) if repeated_ids else rows.withColumn("times", F.lit(1).cast("long"))
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(64, chunks)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("id", "tie"), F.lit(chunks)).cast("long"))
    repeated = _repeated(_grams(rows, buckets))
    marks = _sorted_buckets(_sorted_chunks(rows, repeated, buckets)).select("chunk", "ids", "ties", "starts", "counts")
    out = _removed(rows, marks)
    if repeated_ids:
        out = out.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select(F.expr(f"nullif(id, {_NULL})").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
