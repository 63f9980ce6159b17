import hashlib
import re

import pytest

from tests.llm.fixtures import documents, frame
from tidemark.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def expected(text):
    spans = base_spans(text)
    joined = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    return tuple(sum(s[1] == k for s in spans) for k in range(3)) + (hashlib.sha256(joined.encode()).hexdigest(),)


CASES = [
    'password="hunter22" Passwd : abc secret = abcdef', "token:token:abcdef", "token=secret=abcdefgh", "API_KEY='a.b-c_d=' apikey: x", "AKIA" + "Q" * 16 + " AKIAQ AKIAAKIA" + "B" * 15,
    "deadbeef" * 3 + " " + "0" * 23 + "日本 é" + "f" * 24, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "pass word token", "secret:" + "a" * 5 + "! secret=" + "a" * 6, ("x token = abcdef1 " * 300),
]


def test_base_spans_are_those_of_the_plain_scan(spark):
    rows = documents() + [(100 + k, t) + (None,) * 7 for k, t in enumerate(CASES)]
    found = secrets.find_secrets(frame(spark, rows)).collect()
    assert sorted(((str(r[0]),) + tuple(r)[1:5] for r in found)) == sorted((str(r[0]),) + expected(r[1]) for r in rows)


def test_added_rules(spark):
    rows = [(1, "x -----BEGIN RSA PRIVATE KEY----- y ghp_" + "a" * 36) + (None,) * 7]
    spans = secrets.find_secrets(frame(spark, rows)).first()["spans"]
    assert spans.split(",")[0] == "pem:2:33" and any(s.startswith("github:36:") for s in spans.split(","))


def test_empty_table(spark):
    assert secrets.find_secrets(frame(spark, [])).collect() == []


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_every_match_holds_an_alternative(rule):
    query = secrets.trigram_query(rule.pattern)
    texts = CASES + ["-----BEGIN PRIVATE KEY-----", "gho_" + "Z" * 40, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c"]
    for text in texts:
        for m in re.finditer(rule.pattern, text):
            assert query is None or any(all(t in m[0].lower() for t in alternative) for alternative in query)
    assert (query is None) == (rule.kind == "hex")
