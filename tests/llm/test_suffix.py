import hashlib
import random

import numpy as np

from tests.llm.fixtures import documents, frame
from tidemark.llm import suffix


def brute_force(rows, length=100):
    """Every string of length bytes, in the order of documents and starts."""
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    first, marked = {}, {}
    for d, (i, text) in enumerate(docs):
        raw = text.encode()
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s : s + length], (d, s))
        marked[i, text] = bytearray(len(raw))
    for d, (i, text) in enumerate(docs):
        raw = text.encode()
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < (d, s):
                marked[i, text][s : s + length] = b"\1" * length
    out = {}
    for (i, text), mask in marked.items():
        raw = text.encode()
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))
        out[i, text] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, **kwargs):
    found = suffix.remove_repeats(frame(spark, rows), **kwargs).collect()
    wanted = brute_force(rows)
    expected = sorted((str(r[0]), *wanted[r[0], r[1] or ""]) for r in rows)
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in found) == expected
    return found


def test_removes_what_brute_force_removes(spark):
    rows = [r for r in documents() if not (r[0] == 7 and r[1].startswith("another"))]
    found = check(spark, rows)
    assert sum(r["n_removed"] for r in found) > 60_000


def test_many_copies_over_many_chunks(spark, monkeypatch):
    pick = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(pick.choices(words, k=60))
    copy = " ".join(pick.choices(words, k=80))
    rows = []
    for i in range(150):
        own = " ".join(pick.choices(words, k=pick.randint(0, 60)))
        rows.append((i, copy if i % 3 == 0 else own + passage[: pick.randint(80, 300)] + own[::-1]) + (None,) * 7)
    monkeypatch.setattr(suffix, "FREQUENT", 20)
    check(spark, rows, chunk_bytes=4_000)
    check(spark, rows, chunk_bytes=1 << 20)


def test_empty_table(spark):
    assert suffix.remove_repeats(frame(spark, [])).collect() == []


def test_equal_suffixes_finds_the_groups_of_equal_strings():
    pick = random.Random(1)
    data = np.frombuffer(bytes(pick.choices(b"ab", k=40)) * 20 + bytes(pick.choices(b"abc", k=800)), np.uint8)
    places = np.arange(len(data) - 100 + 1)
    at, group = suffix.equal_suffixes(data, places)
    by = {}
    for i in places.tolist():
        by.setdefault(data[i : i + 100].tobytes(), set()).add(i)
    found = {}
    for i, g in zip(at.tolist(), group.tolist()):
        found.setdefault(g, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in by.values() if len(x) > 1)
