import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, frame
from tidemark.llm import phrases

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def toss(x, y):
    low = (x ^ y) & -(x ^ y)
    place = max(low.bit_length() - 1, 0)
    return 2 * place + (x >> place & 1)


def parse(names):
    """The phrases of one level, name by name: (name of the phrase, the names in it), after runs are joined."""
    joined, k = [], 0
    while k < len(names):
        end = k
        while end < len(names) and names[end] == names[k]:
            end += 1
        joined.append(names[k] if end - k == 1 else mixed(names[k] ^ mixed((end - k) * 0x9E3779B97F4A7C15 & MASK)))
        k = end
    label = joined
    for _ in range(4):
        label = [toss(x, label[i - 1] if i else x ^ 1) for i, x in enumerate(label)]
    assert max(label) < 6 and all(a != b for a, b in zip(label, label[1:]))
    starts = [i for i, x in enumerate(label) if i == 0 or x < label[i - 1] and (i + 1 == len(label) or x < label[i + 1])]
    out = []
    for a, b in zip(starts, [*starts[1:], len(joined)]):
        out.append((mixed(sum(mixed((x + (p + 1) * 0x9E3779B97F4A7C15) & MASK) for p, x in enumerate(joined[a:b])) & MASK), joined[a:b]))
    return out


def root(text):
    names = [ord(c) for c in text]
    while len(names) > 1:
        names = [n for n, _ in parse(names)]
    return mixed((names[0] + 0x9E3779B97F4A7C15) & MASK) if names else 0


def texts():
    pick = random.Random(4)
    made = ["".join(pick.choices("ab", k=n)) for n in (1, 2, 3, 5, 17, 400)] + ["".join(map(chr, pick.choices(range(32, 0x3000), k=300))), "a" * 999, "ab" * 500, ""]
    return made + [r[1] or "" for r in documents() if len(r[1] or "") < 5_000]


def test_names_are_those_of_the_plain_parsing():
    for text, found in zip(texts(), phrases.fingerprints_of(texts())):
        assert int(found.split(".")[0], 16) == root(text), text[:50]


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_segments_change_nothing(monkeypatch, segment):
    wanted = phrases.fingerprints_of(texts())
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    assert phrases.fingerprints_of(texts()) == wanted
    assert [phrases.fingerprints_of([t])[0] for t in texts()] == wanted


def test_equal_substrings_are_cut_alike_at_any_offset():
    """Level by level, all borders of a substring but those near its ends are the same in any surroundings."""
    pick = random.Random(8)
    for _ in range(30):
        inner = pick.choices("abcdefgh ", k=600)
        cuts = []
        for _ in range(2):
            left, right = (pick.choices("abcdefgh ", k=pick.randint(0, 90)) for _ in range(2))
            names = np.array([ord(c) for c in [*left, *inner, *right]], np.uint64)
            # characters without their runs, as borders are those of names after runs are joined
            keep = np.append(True, names[1:] != names[:-1])
            border = np.flatnonzero(keep)[phrases._borders(names[keep], np.append(True, np.zeros(keep.sum() - 1, bool)))]
            cuts.append({int(b) - len(left) for b in border if 40 <= b - len(left) < 560})
        assert cuts[0] == cuts[1] and 100 < len(cuts[0]) < 300


def test_likeness():
    pick = random.Random(2)
    words = ["".join(pick.choices("abcdefghijklmno", k=pick.randint(2, 8))) for _ in range(3_000)]
    text = " ".join(pick.choices(words, k=2_000))
    other = " ".join(pick.choices(words, k=2_000))
    shifted = "one more word " + text
    half = text[: len(text) // 2] + other[: len(text) // 2]
    prints = dict(zip(("text", "other", "shifted", "half", "empty", "run", "longer"), phrases.fingerprints_of([text, other, shifted, half, "", "x" * 3_000, "x" * 4_000])))
    like = lambda a, b: phrases.likeness(prints[a], prints[b])
    assert like("text", "text") == like("empty", "empty") == 1.0
    assert like("text", "shifted") > 0.9 and 0.2 < like("text", "half") < 0.5
    assert like("text", "other") < 0.1 and like("text", "empty") == 0.0
    # runs share what the shorter one has
    assert like("run", "longer") > 0.6
    assert like("text", "half") == like("half", "text")


def expected(rows):
    """edited text and next text of each row, by the stated rules."""
    text = lambda r: r[1] or ""
    rank = lambda r: hashlib.sha256(text(r).encode()).digest()
    heads = {}
    for r in rows:
        if r[0] is not None and (r[0] not in heads or rank(r) < rank(heads[r[0]])):
            heads[r[0]] = r
    ids = sorted(heads)
    out = []
    for r in rows:
        following = "" if not ids else text(heads[ids[0]]) if r[0] is None or r[0] == ids[-1] else text(heads[ids[ids.index(r[0]) + 1]])
        n = len(text(r)) // 4
        out.append((text(r)[: len(text(r)) - n] + following[:n], following))
    return out


def check(spark, rows):
    found = phrases.with_next(frame(spark, rows), ["doc_id", "text"]).collect()
    prints = lambda t: phrases.fingerprints_of([t])[0]
    wanted = []
    for r, (edited, following) in zip(rows, expected(rows)):
        own, changed = prints(r[1] or ""), prints(edited)
        wanted.append((r[0], r[1], len(r[1] or ""), hashlib.sha256(edited.encode()).hexdigest(), own, changed, phrases.likeness(own, changed), phrases.likeness(own, prints(following))))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_next_documents(spark):
    check(spark, documents())


@pytest.mark.parametrize("rows", [[], [(5, "only one")], [(None, "without an id")], [(None, None), (3, "abcdefgh"), (None, "xyzxyzxyz")], [(1, "same")] * 7, [(-(10**12), "far " * 9), (10**12, "away " * 9)]], ids=["none", "one", "nameless", "mixed", "repeated", "far"])
def test_few_documents(spark, rows):
    check(spark, [(*r, *[None] * 7) for r in rows])


def test_many_ranges_with_gaps_and_an_id_that_fills_some(spark, monkeypatch):
    pick = random.Random(6)
    ids = [pick.randint(0, 10**9) for _ in range(300)] + [77] * 250 + [None] * 200 + list(range(10**6, 10**6 + 100))
    rows = [(i, f"text {k % 400} " * pick.randint(0, 9), *[None] * 7) for k, i in enumerate(ids)]
    monkeypatch.setattr(phrases, "RANGES", 16)
    monkeypatch.setattr(phrases, "BATCH_CHARS", 200)
    check(spark, rows)


def test_fingerprints_alone(spark):
    found = phrases.fingerprints(frame(spark), ["doc_id", "key"]).collect()
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["fingerprint"]) for r in found) == sorted((repr(r[0]), len(r[1] or ""), phrases.fingerprints_of([r[1] or ""])[0]) for r in documents())
