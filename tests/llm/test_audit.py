import itertools
import random
import re

import pytest

from tests.llm.fixtures import documents, frame
from tidemark.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string, part string"


def failures(rows):
    """The letters that each row fails, by the stated conditions."""
    firsts = {}
    for r in rows:
        if r[0] is not None:
            firsts[r[1] or ""] = min(firsts.get(r[1] or "", r[0]), r[0])
    out = []
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": r[0] is not None and r[0] > firsts[text],
        }
        out.append({k for k, v in failed.items() if v})
    return out


def expected(rows, labels):
    """Every order, applied filter by filter to lists of rows."""
    fails = failures(rows)
    good = {x[0] for x in labels if x[0] is not None and x[1] == 1}
    toxic = {x[0] for x in labels if x[0] is not None and x[2] == 1}
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for n, letter in enumerate(order, 1):
                gone = [k for k in left if letter in fails[k]]
                kept = [k for k in left if letter not in fails[k]]
                before = sum(letter in fails[k] for k in mine) - len(gone)
                only = sum(fails[k] == {letter} for k in mine)
                steps.append([part, "".join(order), n, len(kept), len(gone), before, only, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)])
                removed_by[letter] += len(gone)
                left = kept
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def check(spark, rows, labels):
    masks = audit.failing_masks(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in audit.audit(masks).collect()) == expected(rows, labels)


def row(i, text, lang):
    return (i, text, lang, *[None] * 6)


def test_all_orders_equal_filtering_one_by_one(spark):
    pick = random.Random(5)
    words = ["Over", "and", "under", "#1", "CAPS", "100%", "plain", "text", "x|y"] + [f"w{k}" for k in range(200)]
    rows = [row(k, " ".join(pick.choices(words, k=pick.choice([3, 90, 99, 100, 101, 150, 300]))), pick.choice(["en", "de", "", None])) for k in range(60)]
    rows += [row(100 + k, rows[k % 7][1], "en") for k in range(30)] + [row(3, rows[3][1], "en"), row(None, rows[0][1], "en"), row(None, None, None), row(None, None, "de")]
    labels = [(k, pick.choice([0, 1, None]), pick.choice([0, 1]), "clash", "clash") for k in range(0, 130, 2)] + [(4, 0, 0, "", ""), (4, 1, 1, "", ""), (None, 1, 1, "", ""), (99999, 1, 1, "", "")]
    check(spark, rows, labels)


def test_hard_documents(spark):
    check(spark, [(r[0], r[1], r[2], *r[3:]) for r in documents()], [(0, 1, 0, "", ""), (5, 0, 1, "", "")])


@pytest.mark.parametrize("labels", [[], [(1, 1, 1, "", "")]])
def test_few_documents(spark, labels):
    check(spark, [], labels)
    check(spark, [row(1, None, "en")], labels)
    check(spark, [row(1, "same " * 120, "en")] * 4 + [row(2, "same " * 120, "en")] * 3, labels)


def test_conditions_at_their_limits(spark):
    distinct = " ".join(f"w{k}" for k in range(100))
    # 80 of 100 words differ; a tenth of the characters are capitals; both pass
    edge = " ".join([f"v{k}" for k in range(80)] + ["v0"] * 20)
    capital = "A" + "b" * 9
    rows = [row(1, distinct, "en"), row(2, distinct + " #", "en"), row(3, edge, "en"), row(4, edge.replace("v79", "v78"), "en"), row(5, capital, "en"), row(6, "A" + capital, "en"), row(7, "a\x0bb\x0cc\x1fd\xa0e", "en")]
    assert [sorted(f) for f in failures(rows)] == [[], ["D"], [], ["B"], ["A"], ["A", "C"], ["A"]]
    check(spark, rows, [])


def test_survivors_of_every_subset(spark):
    """The transform of any counts equals adding up the masks that miss the subset; more filters than orders can be listed for."""
    pick = random.Random(9)
    n = 8
    counts = [(part, pick.randrange(1 << n), pick.randint(0, 9)) for part in ("x", "y") for _ in range(90)]
    found = audit.survivors(spark.createDataFrame(counts, "part string, mask int, documents long"), n, ["documents"]).collect()
    for r in found:
        for subset in range(1 << n):
            assert r["kept_documents"][subset] == sum(c for p, m, c in counts if p == r["part"] and not m & subset)
            assert r["exact_documents"][subset] == sum(c for p, m, c in counts if p == r["part"] and m == subset)
    with pytest.raises(ValueError):
        audit.order_steps("ABCDEFGH")
