import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def test_a_rare_language_is_known(spark):
    rows = [(k, f"the river and the stone {k}", "en") for k in range(3_000)] + [(None, "der fluss und das licht über dem wasser", "de")]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), fit_rows=20)
    assert model.langs == ["de", "en"]
    found = langid.predict(spark.createDataFrame([(1, "das licht über dem fluss", None), (2, "the stone and the river", None)], SCHEMA), model, ["doc_id"]).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {1: "de", 2: "en"}


def test_rows_without_a_key_are_drawn_apart(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 1000 == 0, "de").otherwise("en").alias("lang"))
    langs, picked = langid.drawn(rows, "doc_id", "text", "lang", 4_000)
    counts = dict(picked.groupBy("lang").count().collect())
    assert langs == ["de", "en"] and counts["de"] == 20 and 1_700 < counts["en"] < 2_300


def segmentations(word, prob):
    """The sum over all cuts, one by one."""
    if not word:
        return 1.0
    return sum(prob(word[:k]) * segmentations(word[k:], prob) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pick = np.random.default_rng(4)
    pieces = sorted({"_", "_a", "a", "b", "ab", "ba", "abb", "_abba", "bbbbbbbbbbbbbbbbb"})
    index = langid.Pieces(pieces)
    prob = np.vstack([pick.random((len(pieces), 3)), np.zeros((1, 3)), pick.random((1, 3)) * 1e-3])
    words = ["".join(pick.choice(list("abc"), int(pick.integers(1, 11)))) for _ in range(60)] + ["b" * 19]
    found = langid.LanguageModel(pieces, ["x", "y", "z"], prob).score_words(words)
    for k, word in enumerate(words):
        for lang in range(3):
            def one(piece, lang=lang):
                return prob[pieces.index(piece), lang] if piece in pieces else prob[-1, lang] if len(piece) == 1 else 0.0
            assert np.isclose(np.exp(found[k, lang]), segmentations("_" + word, one), rtol=1e-9)
    order, lengths, edges = index.lattice(words)
    alpha, beta = index.forward(lengths, edges, prob), index.backward(lengths, edges, prob)
    assert np.allclose(alpha[lengths, np.arange(len(words))], beta[0]) and np.allclose(np.log(beta[0]), found[order])


def test_long_runs_are_summed_whole():
    pieces = ["_", "a", "aa", "b"]
    prob = np.array([[0.1, 0.1], [0.2, 0.3], [0.1, 0.05], [0.5, 0.5], [0, 0], [0.1, 0.05]])
    model = langid.LanguageModel(pieces, ["x", "y"], prob)
    for n in (3, 300, 20_000):
        found = model.score_words(["a" * n])[0]
        for lang in (0, 1):
            p, q = prob[1, lang], prob[2, lang]
            last, now, logs = 0.0, 1.0, np.log(prob[0, lang])
            for _ in range(n):
                last, now = now, p * now + q * last
                logs, last, now = logs + np.log(now), last / now, 1.0
            assert np.isclose(found[lang], logs, rtol=1e-9)


def test_one_key_and_equal_rows_still_teach(spark):
    rows = spark.range(9_000).selectExpr("cast(7 as long) as doc_id", "case when id % 3 = 0 then 'le chat et la souris' else 'the cat and the mouse' end as text", "case when id % 3 = 0 then 'fr' else 'en' end as lang")
    for fit_rows in (100, 4_000):
        model = langid.fit(rows, fit_rows=fit_rows)
        asked = spark.createDataFrame([(1, "the mouse"), (2, "la souris"), (2, "la souris"), (None, None), (3, ""), (4, "12 34 !"), (5, "x" * 90_000)], "doc_id long, text string")
        found = langid.predict(asked, model, ["doc_id"]).collect()
        assert [r["lang_pred"] for r in found][:6] == ["en", "fr", "fr", "und", "und", "und"] and len(found) == 7
    assert 60 < langid.drawn(rows, "doc_id", "text", "lang", 100, 50)[1].count() < 150


def test_no_rows_and_ties(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.fit(empty)
    assert langid.predict(empty, model, ["doc_id"]).collect() == []
    assert [r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "word", None)], SCHEMA), model, ["doc_id"]).collect()] == ["und"]
    same = langid.fit(spark.createDataFrame([(1, "one word", "b"), (2, "one word", "a")], SCHEMA))
    tied = langid.predict(spark.createDataFrame([(3, "one word", None)], SCHEMA), same, ["doc_id"]).collect()[0]
    assert tied["lang_pred"] == "a" and abs(tied["score"] - 0.5) < 1e-9
