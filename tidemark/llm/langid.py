"""Language identification with unigram pieces, summed over all segmentations of each word.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the
sum over all ways to cut it into pieces (the forward algorithm); a text's is the product over its words.

Defined results: a null text, or one without a letter, gives ``und`` with score 0. Equal scores go to the
language that sorts first. Empty tables give empty results; without any labelled row every text is ``und``.
A run of letters is one word, however long: all its segmentations are summed. Only the fit cuts runs, every
FIT_RUN letters.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import extended, share_package

#: Labelled rows that the fit uses, about (a bounded sample, chosen by a hash of the row's key, text and place), dealt evenly to the languages.
FIT_ROWS = 4_000
#: Rows of each language that may be drawn in any case, however many languages there are; of a smaller language all are.
LANG_ROWS = 500
EM_ROUNDS = 3
#: Letters of a run that the fit takes as one word; longer runs are cut there, by the fit alone.
FIT_RUN = 40
SMOOTHING = 0.05
CACHE_WORDS = 300_000
#: Cells (words times letters) of one lattice, and words in it at most.
CELLS, CHUNK = 1 << 19, 8_192
#: A forward sum below the first is multiplied by the second, and the word's count of such steps goes up.
_SMALL, _LIFT = 1e-140, 1e140
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, the word start written as a leading low line."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", "_").lower()
        if piece and (piece == "_" or _LETTERS.fullmatch(piece.removeprefix("_"))):
            found.add(piece)
    return sorted(found)


def words_of(text: str, most: int | None = None) -> list[str]:
    """Letter runs in lower case; those of more than most letters in parts."""
    words = _LETTERS.findall(text.lower())
    if most and any(len(w) > most for w in words):
        words = [w[i : i + most] for w in words for i in range(0, len(w), most)]
    return words


def in_chunks(words: list[str]) -> Iterator[list[str]]:
    """Words of a lattice's size each time, the shortest first."""
    chunk: list[str] = []
    for w in sorted(words, key=len):
        if chunk and (len(chunk) >= CHUNK or (len(w) + 1) * (len(chunk) + 1) > CELLS):
            yield chunk
            chunk = []
        chunk.append(w)
    if chunk:
        yield chunk


class Pieces:
    """Piece ids by a hash of their characters; the last two ids stand for no piece and for an unknown character."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self.hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.n = keys[order], order.astype(np.int64), len(pieces)
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], self.n)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """order and lengths of the words (longest first), and for each (start, length) the piece ids of the words that reach so far."""
        text = np.array(["_" + w for w in words])
        chars = text.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
        lengths = (chars > 0).sum(axis=1)
        order = np.argsort(-lengths, kind="stable")
        chars, lengths = chars[order], lengths[order]
        width = int(lengths[0])
        reach = np.searchsorted(-lengths, -np.arange(width + 1), side="right").tolist()
        edges = {}
        h = np.zeros((width, len(words)), dtype=np.uint64)
        for size in range(1, min(self.longest, width) + 1):
            # row i: the letters from i on
            h = h[: width - size + 1] * _BASE + chars.T[size - 1 :] + np.uint64(1)
            ids = self.find(h)
            if size == 1:
                ids = np.where(ids == self.n, self.n + 1, ids)
            for i in np.flatnonzero((ids != self.n).any(axis=1)).tolist():
                edges[i, size] = ids[i, : reach[i + size]]
        return order, lengths, edges

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations, for each word and language; words of any length."""
        order, lengths, edges = self.lattice(words)
        width, n, langs = int(lengths[0]), len(lengths), prob.shape[1]
        # the last sums only: row j stands at j modulo the ring's size
        ring = np.zeros((self.longest + 1, n, langs))
        ring[0] = 1
        lifts = np.zeros((n, langs))
        out = np.empty((n, langs))
        logs = np.log(_LIFT)
        ends = np.searchsorted(-lengths, -np.arange(width + 2), side="right")  # words that reach a position
        for j in range(1, width + 1):
            live = ends[j]
            row = ring[j % len(ring)]
            row[:live] = 0
            for size in range(1, min(self.longest, j) + 1):
                ids = edges.get((j - size, size))
                if ids is not None:
                    row[: len(ids)] += ring[(j - size) % len(ring), : len(ids)] * prob[ids]
            low = row[:live] < _SMALL
            if low.any():
                ring[:, :live][:, low] *= _LIFT
                lifts[:live][low] += 1
            done = ends[j + 1]  # words from here to live end at j
            out[done:live] = np.log(np.maximum(row[done:live], 1e-300)) - lifts[done:live] * logs
        back = np.empty_like(out)
        back[order] = out
        return back

    def forward(self, lengths: np.ndarray, edges: dict, prob: np.ndarray) -> np.ndarray:
        """alpha[position, word, language]: the summed probability of all segmentations up to there; for words of the fit."""
        width = int(lengths[0])
        alpha = np.zeros((width + 1, len(lengths), prob.shape[1]))
        alpha[0] = 1
        for j in range(1, width + 1):
            for size in range(1, min(self.longest, j) + 1):
                ids = edges.get((j - size, size))
                if ids is not None:
                    alpha[j, : len(ids)] += alpha[j - size, : len(ids)] * prob[ids]
        return alpha

    def backward(self, lengths: np.ndarray, edges: dict, prob: np.ndarray) -> np.ndarray:
        width = int(lengths[0])
        beta = np.zeros((width + 1, len(lengths), prob.shape[1]))
        beta[lengths, np.arange(len(lengths))] = 1
        for j in range(width - 1, -1, -1):
            for size in range(1, min(self.longest, width - j) + 1):
                ids = edges.get((j, size))
                if ids is not None:
                    beta[j, : len(ids)] += beta[j + size, : len(ids)] * prob[ids]
        return beta


class LanguageModel:
    """Piece probabilities by language: prob[piece, language], with rows for "no piece" (0) and "unknown character"."""

    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob

    def __getstate__(self):
        return {"pieces": self.pieces, "langs": self.langs, "prob": self.prob}

    def __setstate__(self, state):
        self.__init__(state["pieces"], state["langs"], state["prob"])

    def score_words(self, words: list[str]) -> np.ndarray:
        """log P(word) for each word and language."""
        index = self.__dict__.setdefault("_index", None) or Pieces(self.pieces)
        self._index = index
        found = {}
        for chunk in in_chunks(words):
            found.update(zip(chunk, index.log_likelihood(chunk, self.prob)))
        return np.array([found[w] for w in words]).reshape(len(words), len(self.langs))

    def predict(self, texts: Iterable[str | None], cache: dict[str, int], table: list[np.ndarray]) -> Iterator[tuple[str, float]]:
        """(language, posterior) of each text. cache and table keep the scores of words seen before, up to CACHE_WORDS."""
        texts = [t or "" for t in texts]
        if not self.langs:
            yield from ((UNDETERMINED, 0.0) for _ in texts)
            return
        split = [words_of(t) for t in texts]
        if len(cache) > CACHE_WORDS:
            cache.clear()
            table.clear()
        new = sorted({w for words in split for w in words}.difference(cache))
        if new:
            first = len(cache)
            cache.update(zip(new, range(first, first + len(new))))
            table[:] = [np.concatenate([*table, self.score_words(new)])]
        for words in split:
            if not words:
                yield UNDETERMINED, 0.0
                continue
            logs = table[0][list(map(cache.__getitem__, words))].sum(axis=0)
            best = int(np.argmax(logs))
            yield self.langs[best], float(1 / np.exp(np.minimum(logs - logs[best], 0)).sum())


def _expected_counts(counts: dict[str, Counter], langs: list[str], pieces: Pieces, prob: np.ndarray | None) -> np.ndarray:
    """Expected uses of each piece by language; without a model so far, every place where a piece fits counts by its length."""
    total = np.zeros((pieces.n + 2, len(langs)))
    for k, lang in enumerate(langs):
        items = sorted(counts.get(lang, {}).items())
        for at in range(0, len(items), CHUNK):
            part = items[at : at + CHUNK]
            order, lengths, edges = pieces.lattice([w for w, _ in part])
            times = np.array([n for _, n in part], dtype=float)[order]
            if prob is None:
                for (_, size), ids in edges.items():
                    np.add.at(total[:, k], ids, times[: len(ids)] * size)
                continue
            own = prob[:, k : k + 1]
            alpha, beta = pieces.forward(lengths, edges, own), pieces.backward(lengths, edges, own)
            weight = times / np.maximum(alpha[lengths, np.arange(len(lengths)), 0], 1e-300)
            for (i, size), ids in edges.items():
                n = len(ids)
                np.add.at(total[:, k], ids, alpha[i, :n, 0] * own[ids, 0] * beta[i + size, :n, 0] * weight[:n])
    return total


def _normalised(total: np.ndarray, n: int) -> np.ndarray:
    total = total.copy()
    total[n] = 0
    total += SMOOTHING
    total[n + 1] = SMOOTHING
    total[n] = 0
    return total / total.sum(axis=0, keepdims=True)


def drawn(rows: DataFrame, key: str, text: str, lang: str, fit_rows: int, lang_rows: int = LANG_ROWS) -> tuple[list[str], DataFrame]:
    """All languages of rows, and of each language all rows or a sample of about max(lang_rows, fit_rows / languages), as lang and text."""
    sizes = dict(rows.groupBy(lang).count().collect())
    rows = rows.withColumn("__draw", F.xxhash64(F.col(key).cast("string"), F.col(text), F.monotonically_increasing_id()))
    most = max(lang_rows, fit_rows // max(1, len(sizes)))
    limits = {x: int(most / n * (1 << 62)) for x, n in sizes.items() if n > most}
    if limits:
        below = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])[F.col(lang)]
        rows = rows.where(below.isNull() | (F.pmod("__draw", F.lit(1 << 62)) < below))
    return sorted(sizes), rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit by expectation maximisation over a sample of every language's labelled rows; each round is one Spark job.

    Tasks return expected piece counts (vocabulary times languages), which the driver adds up.
    """
    spark = labelled.sparkSession
    share_package(spark)
    pieces = load_pieces(vocabulary or default_vocabulary())
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    langs, picked = drawn(rows, key, text, lang, fit_rows)
    if not langs:
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 2, 0)))
    index = Pieces(pieces)
    prob = None
    for _ in range(EM_ROUNDS + 1):
        shared = spark.sparkContext.broadcast((pieces, langs, prob))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, known, current = shared.value
            index, counts = Pieces(names), defaultdict(Counter)
            total = np.zeros((index.n + 2, len(known)))
            for batch in batches:
                for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts[lang_].update(words_of(text_, FIT_RUN))
                if sum(map(len, counts.values())) > CACHE_WORDS:
                    total += _expected_counts(counts, known, index, current)
                    counts.clear()
            total += _expected_counts(counts, known, index, current)
            at, by = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(by.astype(np.int32)), pa.array(total[at, by])], names=["piece", "lang", "n"])

        total = np.zeros((len(pieces) + 2, len(langs)))
        for piece, by, n in picked.mapInArrow(count, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n")).collect():
            total[piece, by] = n
        prob = _normalised(total, index.n)
    return LanguageModel(pieces, langs, prob)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep with lang_pred and score, one row per input row; no shuffle."""
    spark = docs.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    schema = extended(source.schema.fields[:-1], "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        table: list[np.ndarray] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = list(shared.value.predict(batch.column(len(keep)).to_pylist(), cache, table))
                arrays = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> F.Column:
    """True where crc32 of the key as text, modulo 3, is 1; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1
