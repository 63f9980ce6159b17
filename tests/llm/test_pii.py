import itertools
import re

import numpy as np
import pytest

from tests.llm.fixtures import documents, frame
from tidemark.llm import pii


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def plain(text):
    """The contract's patterns, one by one."""
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_are_the_plain_patterns(spark, sf_dir):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    pick = np.random.default_rng(2)
    texts += ["".join(pick.choice(list("0129 .-+()@aZ_%\n"), int(pick.integers(1, 60)))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == plain(text), text


def test_marginals_against_enumeration():
    """On chains and trees, message passing gives the exact marginals."""
    pick = np.random.default_rng(3)
    k = len(pii.LABELS)
    for edges in ([(0, 1, 0), (1, 2, 0)], [(0, 1, 0), (0, 2, 1), (2, 3, 2)], [(1, 2, 1)], []):
        n = 4
        names = [(f"f{i}",) for i in range(n)]
        field = pii.SkipChainField({f"f{i}": pick.normal(size=k).tolist() for i in range(n)}, pick.normal(size=(3, k, k)))
        chain = pii.Chain(list(range(n)), list(range(1, n + 1)), names, edges)
        total = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            if labels[3] != 2:
                continue
            weight = np.exp(sum(field.scores(names[i])[y] for i, y in enumerate(labels)) + sum(field.pair[e][labels[a], labels[b]] for a, b, e in edges))
            for i, y in enumerate(labels):
                total[i, y] += weight
        found = field.marginals(chain, [0, 0, 0, 2])
        assert np.allclose(found, total / total.sum(axis=1, keepdims=True), atol=1e-2)


def test_skip_edges_change_the_result(model):
    chain_only = pii.SkipChainField(model.weights, np.concatenate([model.pair[:1], np.zeros_like(model.pair[1:])]))
    text = "card 378282246310005. Again 378282246310005 77"
    base = pii.base_spans(text)
    assert pii.joined(base) == "card:5:20"
    assert pii.joined(model.added_spans(text, base)) == "card:28:43"
    assert chain_only.added_spans(text, base) == []


def test_two_cards_are_never_one(model):
    text = "pay 7536784127813050 4845168114407329 now"
    assert pii.base_spans(text) == []
    assert all(b - a <= 19 for a, b, _ in model.added_spans(text, []))


def test_plain_numbers_stay(model):
    for text in ("on 2024-01-02 we sold 12 of 345 items for 19.99", "version 1.2.3 on port 8080", "call 564-555-4526 @ noon", "pages 12-15, 1998"):
        assert model.added_spans(text, pii.base_spans(text)) == []


def test_odd_rows(spark, model):
    rows = documents() + [(400, "a@b.example " * 3) + (None,) * 7]
    found = pii.find_spans(frame(spark, rows), model, ["doc_id", "row"]).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[43]["spans"] == by_id[44]["spans"] == "" and by_id[43]["redacted"] is None
    assert by_id[400]["n_email"] == 3 and by_id[400]["redacted"] == "<email> " * 3
    assert pii.find_spans(frame(spark, []), model, ["doc_id"]).collect() == []
    nothing = pii.fit(frame(spark, []))
    assert nothing.added_spans("card 378282246310005 1", []) == []


def test_one_key_is_not_drawn_as_a_whole(spark, monkeypatch):
    rows = spark.range(4_000).selectExpr("cast(7 as long) as doc_id", "concat('mail a', id, '@b.example or 10.0.0.', id % 256) as text")
    assert pii.fit(rows, fit_rows=400).weights["mail"][1] > 0
