"""Secrets by regular expressions over a trigram inverted index; DataFrame functions only.

1. From each rule's expression a Boolean trigram query is derived: alternatives, each a set of trigrams that all
   must occur (lower case). A rule with an alternative that needs no trigram is scanned over every text.
2. Postings: for each trigram that some query asks for, and each bucket of row keys, the keys of the rows that hold it.
3. Within each bucket postings are intersected for every alternative and united over alternatives: candidates.
4. Candidates' texts are verified with the expression itself. Only they are shuffled with their texts on a large
   input, as Spark filters the larger side of the join by a Bloom filter, or broadcasts candidates of a measured size.

A key is a 64-bit hash of id and text: equal keys only ever add candidates, which are verified.

Defined results: a null text is empty and has no secrets. Spans are in code points, end exclusive, by start and then
by the rule's place. Repeated rows give repeated results; rows of one id with different texts are told apart.
Columns of other names are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

try:
    from re import _constants as op, _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as op
    import sre_parse as parser

#: Rows in one bucket of the postings, about.
BUCKET_ROWS = 4_096
#: Alternatives that a query may have; beyond it an element counts as unknown.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = True


def either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# The base rules, then the rules that add spans.
RULES = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", base=False),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", base=False),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that any match holds in lower case; None where some match need not hold one."""
    found = {trigrams for trigrams, _ in _walk(parser.parse(pattern), {(frozenset(), "")})}
    if frozenset() in found:
        return None
    return sorted((t for t in found if not any(other < t for other in found)), key=sorted)


def _known(state: set, texts: set[str]) -> set:
    """state after any of the one-character texts."""
    new = set()
    for trigrams, tail in state:
        for c in texts:
            joined = (tail + c)[-3:]
            new.add((trigrams | {joined} if len(joined) == 3 else trigrams, joined[-2:]))
    return new if len(new) <= MOST_ALTERNATIVES else _unknown(state)


def _unknown(state: set) -> set:
    return {(trigrams, "") for trigrams, _ in state}


def _walk(items, state: set) -> set:
    for kind, value in items:
        if kind is op.LITERAL:
            state = _known(state, {chr(value).lower()})
        elif kind is op.IN and value[0][0] is not op.NEGATE and all(k is op.LITERAL for k, _ in value) and len({chr(v).lower() for _, v in value}) <= 8:
            state = _known(state, {chr(v).lower() for _, v in value})
        elif kind is op.SUBPATTERN:
            state = _walk(value[-1], state)
        elif kind is op.BRANCH:
            new = set().union(*(_walk(branch, state) for branch in value[1]))
            state = new if len(new) <= MOST_ALTERNATIVES else _unknown(state)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            once = state
            for _ in range(min(least, 3)):
                once = _walk(inner, once)
            if (least, most) == (0, 1):
                state = state | _walk(inner, state)
            elif least == most and least <= 3:
                state = once
            else:
                state = _unknown(once)
        elif kind is not op.AT:
            state = _unknown(state)
    return state


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Sorted (start, place, end) of the rule's matches of sufficient length: gaps and matches alternate, so lengths give places."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    each = F.zip_with(F.zip_with(whole, sized, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("size"))), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda x, gap: F.struct(x["n"].alias("n"), x["size"].alias("size"), F.length(gap).alias("gap")))
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        span = F.array(F.struct(first.alias("start"), F.lit(place).alias("place"), (first + x["n"]).alias("end")))
        return F.struct((first + x["n"]).alias("at"), F.when(x["size"] >= rule.least, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.when(F.size(whole) == 0, none).otherwise(F.aggregate(each, start, step, lambda s: s["found"]))


def candidates(docs: DataFrame, rules: dict[int, Rule], rows: int) -> DataFrame:
    """key and place of each row that a rule's trigram query lets through. docs has key and text."""
    queries = {place: trigram_query(rule.pattern) for place, rule in rules.items()}
    trigrams = sorted({t for q in queries.values() for alternative in q for t in alternative})
    low = docs.select("key", F.lower("text").alias("low"))
    held = low.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))).alias("trigram"))
    buckets = max(1, -(-rows // BUCKET_ROWS))
    postings = held.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket"), "trigram").agg(F.collect_set("key").alias("rows"))
    index = postings.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("of"))
    none = F.array().cast("array<bigint>")

    def rows_of(query: list[frozenset[str]]) -> Column:
        out = none
        for alternative in query:
            every = None
            for t in sorted(alternative):
                one = F.coalesce(F.col("of")[trigrams.index(t)], none)
                every = one if every is None else F.array_intersect(every, one)
            out = F.array_union(out, every)
        return out

    found = index.select(F.array(*[F.struct(F.lit(p).alias("place"), rows_of(q).alias("rows")) for p, q in queries.items()]).alias("by"))
    return found.select(F.inline("by")).select("place", F.explode("rows").alias("key"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, a count for each base rule, base_sha256 and spans (kind:start:end, comma-joined) for each row."""
    source = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    indexed = {p: r for p, r in enumerate(rules) if trigram_query(r.pattern)}
    full = {p: r for p, r in enumerate(rules) if p not in indexed}
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    found = source.select("id", "key", F.xxhash64("text", "key").alias("check"), F.concat(none, *[_spans(F.col("text"), r, p) for p, r in full.items()]).alias("found"))
    if indexed:
        wanted = candidates(source, indexed, source.count()).groupBy("key").agg(F.expr("bit_or(shiftleft(1, place))").alias("mask"))
        texts = source.join(wanted, "key").select("key", "text", "mask").dropDuplicates(["key", "text"])
        verified = texts.select("key", F.xxhash64("text", "key").alias("check"), F.concat(none, *[F.when(F.col("mask").bitwiseAND(1 << p) != 0, _spans(F.col("text"), r, p)).otherwise(none) for p, r in indexed.items()]).alias("more")).where(F.size("more") > 0)
        found = found.join(verified, ["key", "check"], "left").select("id", F.concat("found", F.coalesce("more", none)).alias("found"))
    every = F.array_sort("found")
    base = F.filter(every, lambda s: s["place"].isin([p for p, r in enumerate(rules) if r.base]))
    names = F.array(*[F.lit(r.kind) for r in rules])

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["place"]], s["start"].cast("string"), s["end"].cast("string"))))

    def number(p: int) -> Column:
        return F.size(F.filter("found", lambda s: s["place"] == p)).cast("long")

    return found.select(
        F.col("id").alias(key),
        *[number(p).alias(f"n_{r.kind}") for p, r in enumerate(rules) if r.base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
