"""Benchmark decontamination: a generalised suffix automaton of the test items reads every document's words.

The automaton's states stand for the word strings of the items. A document's words are streamed through it, and
the longest suffix that occurs in an item is known at each word; where a window (WINDOW words, or a whole shorter
item) ends, its words are hit.

Defined results: null texts and texts without words have no hits and are not contaminated; items without words
are no windows. A null item_id counts as the empty text, and equal item ids count once. An empty benchmark hits nothing.
The benchmark is taken in blocks of at most BLOCK_CHARS characters, so that what is broadcast stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut_lineage, extended, share_package

WINDOW = 13
#: A document is contaminated where at least one word in so many is hit.
COVERAGE = 20
#: Characters of items in one automaton, about 40 bytes of memory each.
BLOCK_CHARS = 4_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8: ASCII letters (A-Z in lower case), digits, and every character above U+007F."""
    return text.encode().translate(_TABLE).split()


class SuffixAutomaton:
    """Of the word strings of all items, each item starting anew at the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: windows by state: word count and the items that hold them
        self.windows: dict[int, dict[int, set[str]]] = {}
        self.least = window
        for item, ids in coded:
            n = min(window, len(ids))
            if n:
                self.least = min(self.least, n)
                self._mark(item, ids, n)
        self.up = self._nearest()

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.size[q] == self.size[last] + 1:
                return q
            return self._clone(last, c, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, item: str, ids: list[int], n: int) -> None:
        state, length = 0, 0
        for i, c in enumerate(ids):
            state, length = self.next[state][c], length + 1
            if length > n:
                length = n
            while state and self.size[self.link[state]] >= length:
                state = self.link[state]
            if i >= n - 1:
                self.windows.setdefault(state, {}).setdefault(n, set()).add(item)

    def _nearest(self) -> list[int]:
        """For each state the nearest one along the suffix links, itself included, that has windows; else -1."""
        up = [-1] * len(self.size)
        for s in sorted(range(len(self.size)), key=self.size.__getitem__):
            up[s] = s if s in self.windows else up[self.link[s]] if s else -1
        return up

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of word positions, merged and ascending, and the items whose windows occur."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        hits: list[list[int]] = []
        items: set[str] = set()
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first < self.least:
                continue
            state, length = 0, 0
            for i, c in enumerate(ids[first:end].tolist(), first):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.size[state]
                if c not in self.next[state]:
                    length = 0
                    continue
                state, length = self.next[state][c], length + 1
                at = self.up[state]
                while at >= 0:
                    for n, of in self.windows[at].items():
                        if n <= length:
                            items |= of
                            if hits and hits[-1][1] >= i - n + 1:
                                hits[-1][1] = i + 1
                                hits[-1][0] = min(hits[-1][0], i - n + 1)
                                while len(hits) > 1 and hits[-2][1] >= hits[-1][0]:
                                    last = hits.pop()
                                    hits[-1] = [min(hits[-1][0], last[0]), last[1]]
                            else:
                                hits.append([i - n + 1, i + 1])
                    at = self.up[self.link[at]] if at else -1
        return [(a, b) for a, b in hits], items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keep, n_words, hit_spans (word ranges), items, n_hit, n_items, items_sha256 and contaminated for each row; no shuffle."""
    spark = docs.sparkSession
    share_package(spark)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    state = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"), F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("__spans"), F.lit(None).cast("array<string>").alias("__items"))
    schema = extended(state.schema.fields[: len(keep)], "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<struct<a:bigint,b:bigint>>, items array<string>")
    kept, k = len(keep), len(keep)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        shared = spark.sparkContext.broadcast([(r[0], words_of(r[1])) for r in rows])
        final = block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, final=final) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(shared.value, window)
            for batch in batches:
                texts = batch.column(k)
                spans_in, items_in = batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist()
                spans, found, words = [], [], []
                for i in range(batch.num_rows):
                    own = words_of(texts[i].as_py())
                    hit, of = automaton.scan(own)
                    words.append(len(own))
                    spans.append(_merged([*((s["a"], s["b"]) for s in spans_in[i] or ()), *hit]))
                    found.append(sorted(of.union(items_in[i] or ())))
                arrays = [batch.column(j) for j in range(kept)]
                ranges = pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                listed = pa.array(found, pa.list_(pa.string()))
                if not final:
                    yield pa.RecordBatch.from_arrays([*arrays, texts, ranges, listed], names=[*keep, "__text", "__spans", "__items"])
                    continue
                hits = [sum(b - a for a, b in s) for s in spans]
                arrays += [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in found], pa.int64())]
                arrays += [pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]), pa.array([h > 0 and coverage * h >= n for h, n in zip(hits, words)]), ranges, listed]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *_OUT, "hit_spans", "items"])

        if final:
            return state.mapInArrow(run, schema)
        state = cut_lineage(state.mapInArrow(run, state.schema), "hits")
    raise AssertionError("there is at least one block")


_OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
