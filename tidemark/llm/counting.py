"""Counts and ids of the pieces of texts by a public byte-level BPE vocabulary.

The tokenizers library is the judge of every result. Long texts are split at safe boundaries: in front of a
single space that follows a non-space and precedes one, where the vocabulary's own splitting rule always cuts.
Parts that the rank file of the same vocabulary is known to treat alike (characters below U+0250, no special
string, no very long run without a space) go through its faster encoder; all others through tokenizers.

Defined results: a null text counts as empty (0 bytes, no ids). Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.session import extended, share_package

LIMIT = 1024
#: Bytes of text that one batch encodes at most, but for a single longer text.
BATCH_BYTES = 4 << 20
#: Characters of a part; longer texts are split at safe boundaries.
PART_CHARS = 1 << 16
#: Without a space for so long, a text goes to the tokenizers library, whose merging is not quadratic there.
LONG_RUN = 2_000
_SPECIAL = "<|endoftext|>"
_ODD = re.compile("[^\x00-\u024f]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs_long(text: str) -> bool:
    at, end = 0, len(text)
    while end - at > LONG_RUN:
        space = text.rfind(" ", at, at + LONG_RUN)
        if space < 0:
            return True
        at = space + 1
    return False


def _plain(text: str) -> bool:
    """Only characters that both encoders are known to treat alike (tests compare them all)."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _ODD.search(text)


class Encoder:
    """Ids of texts by the tokenizers library, or by the rank file of the same vocabulary where that is known to agree."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.whole = any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in self.slow.get_added_tokens_decoder().values())
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def parts(self, text: str, most: int = PART_CHARS) -> list[str]:
        """Parts that are encoded alone, cut at the first safe boundary after every most characters."""
        if len(text) <= most or self.whole:
            return [text] if text else []
        out, at = [], 0
        while len(text) - at > most:
            cut = _SAFE.search(text, at + most)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def _is_fast(self, part: str) -> bool:
        return bool(self.fast) and _SPECIAL not in part and not _runs_long(part) and _plain(part)

    def lengths(self, texts: list[str]) -> list[int]:
        """Counts of a batch; ids are dropped at once."""
        parts: dict[bool, tuple[list[str], list[int]]] = {True: ([], []), False: ([], [])}
        for i, text in enumerate(texts):
            for part in self.parts(text):
                for small in [part] if self._is_fast(part) else self.parts(part, LONG_RUN):
                    held, of = parts[self._is_fast(small)]
                    held.append(small)
                    of.append(i)
        counts = [0] * len(texts)
        for fast, (held, of) in parts.items():
            found = () if not held else self.fast.encode_ordinary_batch(held, num_threads=1) if fast else self.slow.encode_batch_fast(held, add_special_tokens=False)
            for i, ids in zip(of, found):
                counts[i] += len(ids)
        return counts

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of the text."""
        found = []
        for part in self.parts(text):
            if self._is_fast(part):
                found.append(np.array(self.fast.encode_ordinary(part), dtype="<u4"))
                continue
            for small in self.parts(part, LONG_RUN):
                ids = self.fast.encode_ordinary(small) if self._is_fast(small) else self.slow.encode(small, add_special_tokens=False).ids
                found.append(np.array(ids, dtype="<u4"))
        return np.concatenate(found).astype("<u4", copy=False) if found else np.zeros(0, dtype="<u4")


def byte_batches(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes sum to most at most; a longer text is alone."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def encoder_for(path: str, ranks: str | None) -> Encoder:
    """One encoder for each worker process."""
    if _KEPT.get("of") != (path, ranks):
        _KEPT.update(of=(path, ranks), encoder=Encoder(path, ranks))
    return _KEPT["encoder"]


_KEPT: dict = {}


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit for each row; a map without a shuffle."""
    share_package(docs.sparkSession)
    default = path is None
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = extended(source.schema.fields[:-1], "n_bytes bigint, n_tokens bigint, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path or vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken") if default else ranks)
        for batch in batches:
            column = batch.column(len(keep))
            sizes = pc.binary_length(column).to_pylist()
            counts: list[int] = []
            for a, b in byte_batches(sizes):
                counts += encoder.lengths(column.slice(a, b - a).to_pylist())
            arrays = [*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, schema)
