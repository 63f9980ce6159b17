import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.fixtures import documents, frame
from tests.oracle import compare
from tidemark.llm import infill, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(row, seed=42, rate=50, spm=80):
    text = row[1] or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digits = hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in infill.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(n=250):
    pick = random.Random(1)
    signs = ["a", "bc", " ", "  ", "\n", "\t", "\x0b", "\x01", "\x02", "\x02d", "\x02e", "\x01\x01", "é", "😀", "\xa0", "\x1f", "\x85", "<", ">", "<P", "S>", "<M", "$0", "\\", "$1"]
    made = [(k + 1000, "".join(pick.choices(signs, k=pick.randint(0, 40))), *[None] * 7) for k in range(n)]
    return made + [(2000 + k, t, *[None] * 7) for k, t in enumerate(["<P>", "a <S> b", "x<M>", "<p> <s> <m>", "  ", "one", " one", "one "])] * 3 + documents()


def check(spark, **settings):
    rows = rows_of()
    made = infill.fill_in_middle(frame(spark, rows), ["doc_id", "text"], **settings)
    found = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(repr((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in found) == sorted(repr((r[0], r[1], *expected(r, **settings))) for r in rows)
    assert all(r["back"] == (r["text"] or "") for r in found)
    return {f: sum(r["form"] == f for r in found) for f in ("plain", "psm", "spm")}


def test_outputs_and_the_way_back(spark):
    forms = check(spark)
    assert min(forms.values()) > 10


def test_other_settings(spark):
    assert check(spark, seed=7, rate=100, spm=0)["spm"] == 0
    assert check(spark, rate=0)["plain"] == len(rows_of())


def test_escaping_hides_the_delimiter(spark):
    texts = ["\x01", "\x02", "\x02d\x01e\x02\x02", "", "plain"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", infill.escaped(F.col("t")).alias("e")).withColumn("u", infill.unescaped(F.col("e"))).collect()
    assert all(infill.DELIMITER not in r["e"] and r["u"] == r["t"] for r in found)


def test_empty_table(spark):
    assert infill.fill_in_middle(frame(spark, []), ["doc_id"]).collect() == []


def test_queries_against_sql(spark, sf_dir):
    for name in ("op11_filter_audit", "op13_fill_in_middle"):
        assert compare(spark, sf_dir, name, queries.queries()[name], queries.oracle_sql()[name]) > 0
