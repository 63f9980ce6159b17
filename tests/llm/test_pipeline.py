import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.fixtures import documents, frame
from tidemark.llm import neardup, pii


@pytest.fixture(scope="module")
def rows():
    """Some documents, null and empty ones, copies, one id with two texts, benchmark passages and personal data."""
    plain = [r for r in documents(seed=5, n=20) if r[1] is None or len(r[1]) < 5_000]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    return plain + [(700, f"before {item} after") + plain[0][2:], (701, "mail a@b.example or a@b.example now") + plain[0][2:], (701, "second text of the id") + plain[0][2:]]


def repeated(rows):
    return sorted(map(repr, rows))


def test_language_stage_drops_letterless_documents_only(spark, rows):
    docs = frame(spark, rows)
    found = corpus_pipeline.language_stage(spark, docs, "")
    assert found.columns == docs.columns
    wanted = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert sorted((repr(r[0]), r[1]) for r in found.collect()) == sorted((repr(r[0]), r[1]) for r in wanted)
    assert all(r["lang"] is not None for r in found.collect())


def test_decontamination_stage_against_brute_force(spark, sf_dir, rows, tmp_path):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, None), (3, "second text of")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {tuple(w[k : k + 13]) for w in (words(t) for _, t in items) if w for k in range(max(1, len(w) - 12))}

    def contaminated(text):
        w = words(text)
        hit = {k for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x for k in range(i, i + len(x))}
        return bool(hit) and 20 * len(hit) >= len(w)

    docs = frame(spark, rows)
    found = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert repeated(map(tuple, found.collect())) == repeated(r for r in rows if not contaminated(r[1]))
    assert {700, 701} & {r[0] for r in rows if contaminated(r[1])} == {700, 701}


def test_personal_data_stage_replaces_every_base_span(spark, rows):
    docs = frame(spark, rows)
    found = corpus_pipeline.personal_data_stage(spark, docs, "").collect()
    assert Counter(repr(r["doc_id"]) for r in found) == Counter(repr(r[0]) for r in rows)
    texts = {r["text"] for r in found}
    assert "mail <email> or <email> now" in texts and "second text of the id" in texts
    assert all(not pii.base_spans(r["text"]) for r in found if r["doc_id"] == 701)
    assert all(r["n_chars"] == len(r["text"]) for r in found if r["text"] is not None)


def test_packing_stage_holds_every_document(spark, rows):
    found = corpus_pipeline.packing_stage(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"] for r in found} == {r[0] for r in rows}
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_empty_tables_and_the_whole_run(spark, sf_dir):
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, empty, sf_dir)
        assert found.collect() == [] and (name == "packing" or found.columns == empty.columns)
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = found.count()
    assert 0 < n < docs.count() and found.join(docs, "doc_id", "left_anti").count() == 0


def test_near_dedup_keeps_one_row_of_each_class(spark):
    base = [f"w{k}" for k in range(200)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (5, 60, 120, 180)]
    rows = [r for r in documents(seed=9, n=25) if r[1] is None or len(r[1]) < 5_000]
    # near copies under one id and under none, and one id with a clean text beside a near copy
    rows += [(i, t) + rows[0][2:] for i, t in ((600, near[0]), (600, near[1]), (None, near[2]), (None, near[3]), (601, near[1]), (601, "clean text of its own"), (None, "twice"), (None, "twice"))]
    words = [None if r[1] is None else neardup.word_hashes(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            if label[i] != label[j] and (a is None) == (b is None) and (a is None or neardup.similar(a, b)):
                label = [label[j] if x == label[i] else x for x in label]
    classes = {}
    for r, x in zip(rows, label):
        classes.setdefault(x, []).append(r)
    docs = frame(spark, rows)
    found = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert found.columns == docs.columns
    kept = [tuple(r) for r in found.collect()]
    assert len(kept) == len(classes)
    for members in classes.values():
        own = [r for r in kept if r in members]
        assert len(own) == 1
        assert own[0][0] == min((r[0] for r in members if r[0] is not None), default=None)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").collect() == []
