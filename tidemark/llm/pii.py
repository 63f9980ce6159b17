"""Personal data: fixed base patterns, and more spans from a skip-chain conditional random field.

The field's nodes are the words with a digit or an at sign; all other words are plainly outside. Neighbouring
nodes share chain potentials. A token of at least DISTINCT characters shares skip potentials with its previous
occurrence in the document, or else with the last token of its shape. Labels of base spans are known; loopy message
passing gives the label probabilities of all other nodes, so a token that a base pattern finds in one place can be
found in others where the pattern does not fit.

Weights are learned from the base patterns' labels on a bounded sample of documents, by maximum pseudo-likelihood:
each node's label given its features and its neighbours' labels, and once more with its features held back, so that
the potentials must tell the label alone.

Defined results: a null or empty text has no spans. Spans are in code points, end exclusive; base spans always
stay, and an added span never overlaps a base one. Without any base span to learn from, nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import extended, share_package

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *KINDS]
#: Documents that the fit may use at most, about.
FIT_ROWS = 20_000
#: Characters that a token with skip potentials has at least; shorter ones repeat by chance.
DISTINCT = 5
#: Digits that an added run of words of a kind may have.
MOST_DIGITS = {"card": 19, "phone": 15}
#: An added token's probability must reach this.
CERTAIN = 0.9
PASSES = 10
#: Weight of a node whose features are held back, rounds of the fit, and the decay of weights.
HELD_BACK, ROUNDS, DECAY = 1.0, 1_500, 1e-5
_ANY = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign, so that a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and not _NOT_LOCAL.match(text, first - 1):
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS), by start and then kind."""
    if not text or not _ANY.search(text):
        return []
    spans = [(a, b, 0) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


@dataclass
class Chain:
    """Nodes of one document and their edges: (left, right, kind), kind 0 neighbours, 1 equal words, 2 words of equal shape."""

    starts: list[int]
    ends: list[int]
    features: list[tuple[str, ...]]
    edges: list[tuple[int, int, int]]


def shape(token: str) -> str:
    """Digits as 9, letters as a, repeats of letters once: what makes two words similar."""
    return re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", _DIGITS.sub("9", token)))


def features(token: str, before: str, after: str) -> tuple[str, ...]:
    digits = "".join(_DIGITS.findall(token))
    n = len(digits)
    found = [f"digits{min(n, 20) if n > 13 or n < 2 else n // 3 * 3}"]
    if "@" in token:
        found.append("mail" if re.search(r"[^@]@[^@.]+\.[^@]", token) else "at")
    if n and n == len(token):
        found.append("number")
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", token):
        found.append("quad" + str(all(len(p) < 4 and int(p) <= 255 for p in token.split("."))))
    if 14 <= n <= 19:
        found.append(f"check{luhn(digits)}")
    if token.startswith("+"):
        found.append("plus")
    if re.fullmatch(r"\(?\d{2,4}\)?", token):
        found.append("area")
    if re.fullmatch(r"[\d-]+", token) and "-" in token:
        found.append("dashes")
    if re.search(r"[^\W\d_]", token):
        found.append("letters")
    found += ["after_plus"] * before.startswith("+") + ["after_area"] * bool(re.fullmatch(r"\(\d+\)", before)) + ["before_area"] * bool(re.fullmatch(r"\(\d+\)", after))
    return tuple(found)


def chain_of(text: str) -> Chain:
    chain = Chain([], [], [], [])
    equal: dict[str, int] = {}
    alike: dict[str, int] = {}
    words = [(m.start(), m[0]) for m in _TOKEN.finditer(text)]
    previous = -2
    for k, (at, raw) in enumerate(words):
        if not _ANY.search(raw):
            continue
        token = raw.rstrip(".,;:!?\"'").lstrip("\"'")
        if not token:
            continue
        at += len(raw) - len(raw.lstrip("\"'"))
        node = len(chain.starts)
        chain.starts.append(at)
        chain.ends.append(at + len(token))
        chain.features.append(features(token, words[k - 1][1] if k else "", words[k + 1][1] if k + 1 < len(words) else ""))
        if previous == k - 1:
            chain.edges.append((node - 1, node, 0))
        previous = k
        key = token.lower()
        if len(key) < DISTINCT:
            continue
        if key in equal:
            chain.edges.append((equal[key], node, 1))
        elif (form := shape(key)) in alike:
            chain.edges.append((alike[form], node, 2))
        equal[key] = node
        alike[shape(key)] = node
    return chain


def silver(chain: Chain, base: list[tuple[int, int, int]]) -> list[int]:
    """Label of each node by the base span that it overlaps first, else 0."""
    labels, at = [], 0
    for a, b in zip(chain.starts, chain.ends):
        while at < len(base) and base[at][1] <= a:
            at += 1
        hit = next((s for s in base[at : at + 4] if s[0] < b and a < s[1]), None)
        labels.append(hit[2] + 1 if hit else 0)
    return labels


class SkipChainField:
    def __init__(self, weights: dict[str, list[float]], pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def scores(self, names: tuple[str, ...]) -> np.ndarray:
        return np.sum([self.weights.get(f, _NONE) for f in ("bias", *names)], axis=0)

    def marginals(self, chain: Chain, known: list[int] | None = None) -> np.ndarray:
        """Label probabilities of each node by loopy message passing, damped, PASSES times over all edges; labels known but 0 are given."""
        node = np.array([self.scores(f) for f in chain.features])
        for i, label in enumerate(known or ()):
            if label:
                node[i] = np.where(np.arange(len(LABELS)) == label, 0.0, -50.0)
        if not chain.edges:
            return _softmax(node)
        left, right, kind = (np.array(x) for x in zip(*chain.edges))
        source, target = np.concatenate([left, right]), np.concatenate([right, left])
        pair = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        n = len(left)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, len(LABELS)))
        for _ in range(PASSES):
            belief = node.copy()
            np.add.at(belief, target, message)
            outgoing = belief[source] - message[back]
            new = np.logaddexp.reduce(outgoing[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        np.add.at(node, target, message)
        return _softmax(node)

    def added_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs of neighbouring nodes of one certain label that touch no base span; a run ends where it would have too many digits, and no two mails or addresses are one."""
        chain = chain_of(text)
        if not chain.starts:
            return []
        taken, free = silver(chain, base), []
        prob = self.marginals(chain, taken)
        label, sure = prob.argmax(axis=1), prob.max(axis=1)
        near = {b for a, b, kind in chain.edges if kind == 0}
        for i in range(len(taken)):
            if taken[i] or not label[i] or sure[i] < CERTAIN:
                continue
            kind = int(label[i]) - 1
            if free and free[-1][2] == kind and i in near and free[-1][3] == i - 1 and len(_DIGITS.findall(text[free[-1][0] : chain.ends[i]])) <= MOST_DIGITS.get(KINDS[kind], 0):
                free[-1] = (free[-1][0], chain.ends[i], kind, i)
            else:
                free.append((chain.starts[i], chain.ends[i], kind, i))
        return [(a, b, k) for a, b, k, _ in free if not any(x < b and a < y for x, y, _ in base)]


_NONE = np.zeros(len(LABELS))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: What a node's neighbours are to it, each with the kind of edge and whether the node is the edge's right end.
_SIDES = {"before": (0, True), "after": (0, False), "equal_before": (1, True), "equal_after": (1, False), "alike_before": (2, True), "alike_after": (2, False)}


def contexts(chain: Chain, labels: list[int]) -> list[tuple[str, ...]]:
    """For each node its neighbours' labels, by what they are to it."""
    found: list[list[str]] = [[] for _ in labels]
    names = {v: k for k, v in _SIDES.items()}
    for a, b, kind in chain.edges:
        found[b].append(f"{names[kind, True]}={labels[a]}")
        found[a].append(f"{names[kind, False]}={labels[b]}")
    return [tuple(sorted(x)) for x in found]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> SkipChainField:
    """Maximum pseudo-likelihood. Tasks return counts of (features, neighbours' labels, label), whose number does not grow with the rows.

    Rows are drawn by a hash of key, text and place, so that neither one key nor one text is drawn as a whole.
    """
    share_package(docs.sparkSession)
    share = min(1.0, fit_rows / max(1, docs.where(F.col(text).isNotNull()).count()))
    placed = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text), F.monotonically_increasing_id()).alias("h"))
    picked = placed.where(F.col("text").rlike("[0-9@]") & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                chain = chain_of(value)
                labels = silver(chain, base_spans(value))
                counts.update((" ".join(f), " ".join(c), y) for f, c, y in zip(chain.features, contexts(chain, labels), labels))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([k[2] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["features", "context", "y", "n"])

    found = sorted(tuple(r) for r in picked.mapInArrow(count, "features string, context string, y int, n bigint").groupBy("features", "context", "y").agg(F.sum("n")).collect())
    rows = [(["bias", *f.split(), *c.split()], y, float(n)) for f, c, y, n in found] + [(["bias", *c.split()], y, HELD_BACK * n) for f, c, y, n in found if c]
    names = ["bias", *sorted({f for fs, _, _ in rows for f in fs} - {"bias"})]
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (fs, _, _) in enumerate(rows):
        for f in fs:
            x[i, place[f]] += 1
    w = np.zeros((len(names), len(LABELS)))
    w[0, 0] = 4.0  # outside unless the features say otherwise
    if rows:
        y, n = np.array([y for _, y, _ in rows]), np.array([n for _, _, n in rows])
        # rare labels weigh more than their number, so that they count
        n = n / np.sqrt(np.bincount(y, n, len(LABELS))[y])
        n /= n.sum()
        for _ in range(ROUNDS):
            wrong = _softmax(x @ w)
            wrong[np.arange(len(y)), y] -= 1
            w -= x.T @ (wrong * n[:, None]) + DECAY * w
    pair = np.zeros((3, len(LABELS), len(LABELS)))
    for side, (kind, is_right) in _SIDES.items():
        for label in range(len(LABELS)):
            told = w[place[f"{side}={label}"]] if f"{side}={label}" in place else _NONE
            # a potential is the mean of what both ends learned
            pair[kind, *((label, slice(None)) if is_right else (slice(None), label))] += (told - told.mean()) / 2
    return SkipChainField({f: w[i].tolist() for f, i in place.items() if "=" not in f}, pair)


def find_spans(docs: DataFrame, model: SkipChainField, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_email, n_ip, n_card, n_phone, base_sha256, spans and redacted (the text with each span replaced by its kind); no shuffle."""
    spark = docs.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    counts = [f"n_{k}" for k in KINDS]
    schema = extended(source.schema.fields[:-1], ", ".join([*(f"{c} bigint" for c in counts), "base_sha256 string", "spans string", "redacted string"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            base, every, texts = [], [], []
            for i in range(batch.num_rows):
                value = column[i].as_py()
                own = base_spans(value)
                more = model.added_spans(value, own) if value and _ANY.search(value) else []
                base.append(own)
                every.append(sorted([*own, *more], key=lambda s: (s[0], s[2])))
                texts.append(redact(value, every[-1]))
            arrays = [batch.column(j) for j in range(len(keep))]
            arrays += [pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            arrays += [pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base]), pa.array([joined(s) for s in every], pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *counts, "base_sha256", "spans", "redacted"])

    return source.mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each span as its kind in angle brackets; of overlapping spans the first one's kind stands for all."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
