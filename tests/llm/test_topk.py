import math
import random

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in good if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


def run(spark, rows, **kwargs):
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in topk.top_k(vectors.where("id % 50 = 0"), vectors, **kwargs).collect())


def rows(n, seed=2, dims=24):
    pick = random.Random(seed)
    out = [(i, [float(pick.gauss(0, 0.2)) for _ in range(dims)], 0) for i in range(n)]
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(i, [single(x) for x in v], y) for i, v, y in out]


def test_against_brute_force(spark, monkeypatch):
    data = rows(700)
    data += [(1000 + i, data[50][1], 0) for i in range(9)]  # ties
    data += [(2000, None, 0), (2050, [None, 1.0], 0), (2100, [math.nan], 0), (2150, [math.inf], 0), (None, [1.0], 0), (2200, [], 0), (2250, [0.5, 0.5], 0), (2300, [0.0] * 24, 0)]
    data += [data[3], data[3], data[100]]
    expected = sorted(brute_force(data))
    assert run(spark, data) == expected
    assert run(spark, data, query_block=4) == expected
    monkeypatch.setattr(topk, "FEW", 1)
    monkeypatch.setattr(topk, "BLOCK", 64)
    assert run(spark, data) == expected


def test_large_components(spark):
    data = [(i, [2.0**40 * (i % 7), 3.0, 2.0**55], 0) for i in range(60)]
    largest = (1 << 63) - 1
    assert run(spark, data) == sorted((i, r, j, min(s, largest)) for i, r, j, s in brute_force_held(data))


def brute_force_held(data):
    out = []
    for i in (0, 50):
        q = [math.floor(256 * x) for x in data[i][1]]
        scores = sorted((-min((1 << 63) - 1, sum(a * math.floor(256 * b) for a, b in zip(q, v))), j) for j, v, _ in data if j != i)[:5]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


def test_few_or_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, rows(1)) == []
    assert len(run(spark, rows(3))) == 2


def test_early_stop_is_proved():
    import numpy as np

    values = np.floor(256 * np.random.default_rng(1).normal(0, 0.125, (4096, 64)))
    index = topk.ImpactIndex(values, np.float32)
    for q, members, scores in index.search(values[:40], 5, np.float32):
        best = np.sort(values @ values[q])[::-1][:5]
        assert np.array_equal(np.sort(scores)[::-1][:5], best)
        assert len(members) < 1000


def test_against_sql(spark, sf_dir):
    from tests.oracle import compare
    from tidemark.llm import queries

    assert compare(spark, sf_dir, "op9_top_k", queries.op9_top_k, queries.OP9_SQL) > 0


def test_rounds_find_the_same(spark, sf_dir):
    from tidemark.session import table

    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    asked = vectors.where("id % 10 = 0")
    whole, rounds = (sorted(map(tuple, topk.top_k(asked, vectors, 5, block).collect())) for block in (16_384, 2))
    assert whole == rounds
