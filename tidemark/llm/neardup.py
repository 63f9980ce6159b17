"""Near duplicates by Order MinHash: sketches of a few minimal occurrence-labelled shingles, kept in text order.

1. Texts of equal words are one node (exact copies).
2. Each node's shingles of SHINGLE words get an occurrence number. For each of SKETCHES hash orders the PICKED
   smallest ones, in the order in which they stand in the text, are a sketch; equal sketches share a bucket.
   Of buckets that hold the same nodes one is kept.
3. In a bucket every node could be paired with four centres (smallest, largest, smallest and largest hash). Each
   node takes the CENTRES ones of them with which it shares most buckets.
4. A pair is a link where a banded alignment of the words finds an edit similarity (one less the edits' share of
   the longer text's words) of SIMILARITY or more. Before it, a bound that every link meets is asked: the number of
   common pairs of neighbouring words.
5. The links' connected components are the classes. Buckets that still hold several classes are compared whole:
   each node outside a bucket's largest class meets every node of another class in that bucket, block by block.
   A block estimates the bound from sketches, takes the likeliest pairs first, aligns each pair whose classes no
   link of the block has joined so far, and gives only links that join classes, so what leaves it is linear in its
   nodes. No pair that shares a bucket is left out, whatever the bucket's size.

Defined results: null texts are copies of each other, and so are texts without a word. Texts of fewer than SHINGLE
words have one shingle. The class id is the smallest id of the class's rows, null where all of them are null; rows
of one id with different texts are judged apart. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.graph import components
from tidemark.session import cut_lineage, share_package

SHINGLE = 5
SIMILARITY = 0.8
#: A lone pair at the limit, with a fifth of its words replaced at random, has a third of its shingles in common and
#: meets in one of 48 sketches of two with a chance of about 0.85; of 32 sketches of three it was 0.23.
SKETCHES = 48
PICKED = 2
#: Words in a gram of the bound: an edit takes at most so many grams from either text.
GRAM = 2
#: Bins of the sketch that estimates how many grams two texts share.
BINS = 256
#: Standard deviations by which an estimate may fall short.
SLACK = 4.5
#: Centres with which each node is compared first.
CENTRES = 3
#: Nodes of a bucket, and bytes of their texts, in one side of a block, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Bytes of a set's size behind its bins.
_COUNT = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Elements of one matrix of hash values.
_CELLS = 1 << 19
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_POWERS = {_BASE: np.ones(1, np.uint64), _UNBASE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    kept = _POWERS[base]
    while len(kept) < n:
        kept = np.concatenate([kept, kept * np.uint64(pow(base, len(kept), 1 << 64))])
    _POWERS[base] = kept
    return kept[:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word: a run of ASCII letters, digits and characters above U+007F, in lower case."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    # differences of prefix sums of c * base^position, shifted back to position 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * _powers(_UNBASE, len(raw))[starts]) if len(starts) else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of size words; of the whole where it is shorter."""
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        h = _mixed(h * np.uint64(31) + words[k : k + len(h)] + np.uint64(k + 1))
    return h


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the first, second, ... occurrence apart."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    occurrence = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(ranked)]])))
    out = np.empty_like(grams)
    out[order] = np.where(occurrence > 0, _mixed(ranked + occurrence.astype(np.uint64) * _MIX), ranked)
    return out


def sketches(grams: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Order MinHash: per hash order, one hash of the picked smallest labelled shingles in text order."""
    grams = labelled(grams)
    n = len(grams)
    picked = min(picked, n)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n, dtype=np.uint64)
    marks = np.empty(count, np.uint64)
    step = max(1, _CELLS // max(1, n))
    for first in range(0, count, step):
        orders = np.arange(first, min(first + step, count), dtype=np.uint64)
        seeds = _mixed((orders + np.uint64(1)) * _MIX)
        value = (grams[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint64(1))
        value = (value & ~low) | place
        if n > picked:
            value.partition(picked - 1, axis=1)
        found = np.sort((value[:, :picked] & low).astype(np.int64), axis=1)
        h = orders + np.uint64(1)
        for k in range(picked):
            h = _mixed(h * np.uint64(31) + grams[found[:, k]])
        marks[first : first + len(orders)] = h
    return marks


def grams_of(words: np.ndarray) -> np.ndarray:
    """Labelled grams of GRAM words, in order of their hashes: a set in which repeats count."""
    return np.sort(labelled(shingles(words, GRAM)))


def binned(grams: np.ndarray, bins: int = BINS) -> bytes:
    """One-permutation MinHash of a set of grams: a byte (1 to 255) of the smallest hash in each bin, 0 where the bin is empty; then the set's size."""
    h = _mixed(grams ^ _MIX)
    empty = ~np.uint64(0)
    least = np.full(bins, empty)
    np.minimum.at(least, (h % np.uint64(bins)).astype(np.int64), h // np.uint64(bins))
    return np.where(least == empty, 0, 1 + least % np.uint64(255)).astype(np.uint8).tobytes() + len(h).to_bytes(_COUNT, "little")


def _unbinned(sketches_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and set sizes of binned sketches."""
    cells = np.frombuffer(b"".join(sketches_), np.uint8).reshape(-1, BINS + _COUNT)
    return cells[:, :BINS], np.ascontiguousarray(cells[:, BINS:]).view("<u4").ravel().astype(np.float64)


def least_common(m: np.ndarray, n: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Grams that texts of m and n grams must share if their edit similarity is at least this."""
    longer = np.maximum(m, n)
    return np.maximum(longer - GRAM * (1 - similarity) * (longer + GRAM - 1) - 1e-6, 0)


def likely(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Whether bins x and y (last axis) of texts of m and n grams can be of texts this similar, and the share of bins that agree.

    The used bins are a sample, without replacement, of the union.
    """
    agree = ((x == y) & (x != 0)).sum(axis=-1)
    used = np.maximum(((x | y) != 0).sum(axis=-1), 1)
    common = least_common(m, n, similarity)
    union = np.maximum(m + n - common, 2)
    share = common / union
    left = np.maximum(union - used, 0) / (union - 1)
    fits = agree >= share * used - SLACK * np.sqrt(share * (1 - share) * used * left) - 1
    short = GRAM - 1
    return fits & (np.minimum(m, n) + short >= similarity * (np.maximum(m, n) + short) - 1e-9), agree / used


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two word sequences is at most most.

    A banded alignment: only the 2 * most + 1 diagonals that such a distance can use are filled, column by column, the
    differences of neighbouring cells held as the bits of whole numbers.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    diff = np.flatnonzero(a[: len(b)] != b)
    same = int(diff[0]) if len(diff) else len(b)
    a, b = a[same:], b[same:]
    if len(b):
        diff = np.flatnonzero(a[: -len(b) - 1 : -1] != b[::-1])
        cut = int(diff[0]) if len(diff) else len(b)
        a, b = a[: len(a) - cut], b[: len(b) - cut]
    n, bottom = len(a), len(a) - most
    if bottom <= 0:
        return True
    places: dict[int, int] = {}
    for k, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    full, top = (1 << 2 * most + 1) - 1, 1 << 2 * most
    up, down = ((1 << most + 1) - 1) << most, 0
    # the distance at the band's lowest diagonal, then, past the last row, along that row
    distance = most
    for k, word in enumerate(b.tolist()):
        bits = places.get(word, 0)
        match = (bits >> k - most if k >= most else bits << most - k) & full
        level = ((match & up) + up ^ up | match | down) & full
        right, left = (down | ~(level | up)) & full, level & up
        if k < bottom:
            distance += not level & top
            if distance > most + len(b) - bottom:
                return False
        else:
            row = top >> k - bottom + 1
            distance += bool(right & row) - bool(left & row)
        up, down = (left | ~(level >> 1 | right)) & full, level >> 1 & right
    return distance <= most


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two word sequences reaches the limit."""
    return _alike(a, grams_of(a), b, grams_of(b), similarity)


def _alike(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, similarity: float) -> bool:
    """As similar, with the grams of both."""
    longest = max(len(a), len(b))
    if not longest or min(len(a), len(b)) == 0:
        return len(a) == len(b)
    if min(len(a), len(b)) < similarity * longest - 1e-9:
        return False
    if len(np.intersect1d(ga, gb, assume_unique=True)) < least_common(np.float64(len(ga)), np.float64(len(gb)), similarity):
        return False
    most = int((1 - similarity) * longest + 1e-9)
    return within(a, b, most)


def _node(text: str | None, words: np.ndarray) -> bytes:
    """Equal for texts of equal words; null texts are a node of their own."""
    return b"" if text is None else hashlib.md5(words.astype("<u8").tobytes()).digest()


def _sketched(docs: DataFrame) -> DataFrame:
    """id, node, sketches and the binned sketch, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes, marks, least = batch.column(1), [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                own = word_hashes(text) if text is not None else np.zeros(0, np.uint64)
                nodes.append(_node(text, own))
                grams = shingles(own)
                marks.append((sketches(grams) if len(own) else np.zeros(0, np.uint64)).view(np.int64))
                least.append(binned(grams_of(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(least, pa.binary())], names=["id", "node", "marks", "least"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, node binary, marks array<bigint>, least binary")


def _with_nodes(docs: DataFrame) -> DataFrame:
    """node and text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            nodes = [_node(t, word_hashes(t)) for t in (texts[i].as_py() for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), texts], names=["node", "text"])

    return docs.where("text is not null").select("text").mapInArrow(run, "node binary, text string")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are links. texts has one row for each node."""

    def read(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = word_hashes(text)
        return words, grams_of(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(maxsize=16)(read)  # rows of equal b stand together
        for batch in batches:
            kept = [i for i in range(batch.num_rows) if _alike(*once(batch.column(2)[i].as_py()), *once(batch.column(3)[i].as_py()), similarity)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _different(buckets: DataFrame) -> DataFrame:
    """bucket, node and times: of buckets that hold the same two or more nodes the first, and how many there are.

    Sets are told by their size and two sums of hashes of their nodes, which are added up before they are shuffled.
    """
    low = F.lit((1 << 40) - 1)
    sets = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").bitwiseAND(low)).alias("y")).where("n > 1")
    first = sets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times"))
    return buckets.join(first.select("bucket", "times"), "bucket")


def _centred(buckets: DataFrame, most: int = CENTRES) -> DataFrame:
    """(a, b), a < b: each node with those of its buckets' centres with which it shares most buckets. buckets(bucket, node, times)."""
    order = F.xxhash64("node")
    stats = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.array(F.min("node"), F.max("node"), F.min_by("node", order), F.max_by("node", order)).alias("centres")).where("n > 1")
    met = buckets.join(stats, "bucket").select("node", "times", F.explode(F.array_distinct("centres")).alias("c")).where("node <> c")
    counted = met.groupBy("node", "c").agg(F.sum("times").alias("n"))
    best = counted.groupBy("node").agg(F.expr(f"slice(array_sort(collect_list(struct(-n as n, c))), 1, {most})").alias("best")).select("node", F.explode("best.c").alias("c"))
    return best.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _joined(names: np.ndarray, pairs: Iterator[tuple[int, int]], linked: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Of the pairs of places in names, the links that join what no earlier one has joined."""
    above = {x: x for x in names.tolist()}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i, j in pairs:
        x, y = top(int(names[i])), top(int(names[j]))
        if x != y and linked(i, j):
            above[max(x, y)] = min(x, y)
            yield i, j


def _across(buckets: DataFrame, roots: DataFrame, heads: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b), a < b: links that join all classes which a chain of links within buckets can join.

    Nodes outside the largest class of a bucket are asked against all its nodes, in blocks that a hash of the node deals.
    A pair is compared in the smallest bucket that both share: they are of different classes, so it is compared too.
    """

    def padded(earlier: pa.Array, bucket: int) -> np.ndarray:
        """A row of buckets for each node, filled up with bucket."""
        lengths = np.diff(earlier.offsets.to_numpy())
        cells = np.full((len(lengths), lengths.max(initial=0)), bucket, np.int64)
        cells[np.arange(cells.shape[1])[None, :] < lengths[:, None]] = earlier.flatten().to_numpy()
        return cells

    def compared(bucket: int, found: list, sketch: list, asks: np.ndarray, earlier: np.ndarray, text: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
        asked, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        kinds = np.unique(np.array(found, object), return_inverse=True)[1]
        cells, sizes = _unbinned(sketch)
        rows, columns, shares = [], [], []
        step = max(1, (_CELLS * 16) // (BINS * max(1, len(asked))))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            fits, share = likely(cells[some][:, None, :], cells[asked][None, :, :], sizes[some][:, None], sizes[asked][None, :], similarity)
            x, y = np.nonzero(fits & (kinds[some][:, None] != kinds[asked][None, :]))
            left, right = earlier[some[x]], earlier[asked[y]]
            met = ((left[:, :, None] == right[:, None, :]) & (left != bucket)[:, :, None]).any(axis=(1, 2))
            rows.append(some[x[~met]])
            columns.append(asked[y[~met]])
            shares.append(share[x[~met], y[~met]])
        if not rows:
            return iter(())
        order = np.argsort(-np.concatenate(shares), kind="stable")
        likeliest = zip(*(np.concatenate(x)[order].tolist() for x in (rows, columns)))

        @lru_cache(maxsize=None)
        def read(i: int) -> tuple[np.ndarray, np.ndarray]:
            words = word_hashes(text[i].as_py())
            return words, grams_of(words)

        return _joined(kinds, likeliest, lambda i, j: _alike(*read(i), *read(j), similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            """Links of all groups in rows, which are whole and in order."""
            keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), rows.num_rows]
            nodes, found, sketch = (rows.column(k).to_pylist() for k in (3, 4, 5))
            asks = rows.column(6).to_numpy()
            earlier = pa.concat_arrays(rows.column(7).chunks)
            a, b = [], []
            for low, high in zip(edges[:-1], edges[1:]):
                for i, j in compared(keys[0, low], found[low:high], sketch[low:high], asks[low:high], padded(earlier[low:high], keys[0, low]), rows.column(8)[low:high]):
                    a.append(min(nodes[low + i], nodes[low + j]))
                    b.append(max(nodes[low + i], nodes[low + j]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            # rows from last on are of one group that may go on in the next batch
            whole = last > 0 or (bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(3)))
            if whole:
                yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(pa.Table.from_batches(held))

    rooted = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most")).where("classes > 1")
    members = cut_lineage(rooted.join(mixed, "bucket"), "members")
    # rows are dealt without their texts, which join them on the way to their blocks and are written once
    sized = cut_lineage(members.join(texts.select("node", F.octet_length("text").alias("size")), "node").withColumn("h", F.xxhash64("node")), "sized")
    bytes_ = sized.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.sum(F.when(F.col("root") != F.col("largest"), F.col("size"))).alias("bytes_asking"))
    parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(F.col(size) / block_bytes))
    cut = sized.join(bytes_, "bucket").withColumn("n_all", parts(F.col("n"), "bytes")).withColumn("n_asking", parts(F.col("n") - F.col("most"), "bytes_asking"))
    asked = cut.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asking") - 1)).alias("i"), F.expr("pmod(h, n_all)").alias("j"), "node", "root", F.lit(False).alias("asks"))
    asking = cut.where("root <> largest").select("bucket", F.expr("pmod(h, n_asking)").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)).alias("j"), "node", "root", F.lit(True).alias("asks"))
    shared = members.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("shared"))
    held = shared.join(heads.select("node", "least"), "node").join(texts, "node")
    placed = asked.union(asking).join(held, "node").select("bucket", "i", "j", "node", "root", "least", "asks", F.expr("filter(shared, s -> s < bucket)").alias("earlier"), "text")
    dealt = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id and copies (rows of the same words) for each row of docs; key must be an integer."""
    share_package(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = cut_lineage(_sketched(source), "sketches")
    exact = rows.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    heads = cut_lineage(rows.select("node", "marks", "least").dropDuplicates(["node"]).where(F.size("marks") > 0), "heads")
    buckets = heads.select("node", F.explode("marks").alias("bucket"))
    met = cut_lineage(_different(buckets), "met")
    pairs = cut_lineage(_centred(met), "pairs")
    wanted = met.select("node").distinct().join(exact.select("node", "rep"), "node").select(F.coalesce("rep", F.lit(_NO_ID)).alias("id"))
    named = source.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    texts = cut_lineage(_with_nodes(named.join(wanted.distinct(), "id", "left_semi")).dropDuplicates(["node"]), "texts")
    links = cut_lineage(_verified(pairs, texts, similarity), "links")
    more = cut_lineage(_across(met, components(links), heads, texts, similarity), "links")
    roots = components(links.union(more))
    classes = exact.join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("node", "class_id", "copies")
    return rows.select("id", "node").join(named, "node").select("id", "class_id", "copies")


#: Stands for a null id while texts are looked up.
_NO_ID = -(1 << 63)
