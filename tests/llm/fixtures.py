"""Small documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, key string, __text string"


def documents(seed: int = 3, n: int = 40) -> list[tuple]:
    """Null and empty texts, a very long one, copies, near copies, repeated rows, null ids, and one id with two texts."""
    pick = random.Random(seed)
    words = ["the", "river", "of", "stone", "and", "light", "über", "señor", "naïve", "10.0.0.1", "a@b.example", "key", "日本", "word"]
    texts = [" ".join(pick.choices(words, k=pick.randint(1, 120))) for _ in range(n)]
    texts += [texts[0], texts[1] + " end", texts[2][:200], None, "", " \n\t", "x" * 70_000, ("long line of text " * 3_000), "😀" * 60]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, texts[0]), (5, texts[5]), (7, "another text of the same id"), (None, "text of a null id"), (None, None)]
    return [(i, t, "en" if t else None, None, None, 0.5, "r", "k", "clash") for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
