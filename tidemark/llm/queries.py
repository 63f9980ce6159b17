"""The thin queries of the operators in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import audit, counting, decontaminate, html, infill, langid, neardup, packing, phrases, pii, secrets, suffix, topk
from tidemark.session import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its near-duplicate class) and copies (documents of the same words)."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "copies")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    marked = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(marked, model, ["doc_id", "held_out"])


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_spans(docs, pii.fit(docs), ["doc_id"]).drop("redacted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, items, ["doc_id"]).drop("hit_spans", "items")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("id % 50 = 0"), vectors)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.failing_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    rebuilt = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
with item as (select coalesce(cast(item_id as varchar), '') as item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, w[i : i + n - 1] as words, n from (
    select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from item where len(w) > 0)),
doc as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
pos as (select r, n, i, w[i : i + n - 1] as words from (
    select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, (select distinct n from win))),
hit as (select pos.r, pos.i, pos.n, win.item_id from pos join win on pos.words = win.words and pos.n = win.n),
covered as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hit) group by r),
named as (select r, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct r, item_id from hit) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join covered using (r) left join named using (r)
"""


OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
    where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""


OP11_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, min(doc_id) over (partition by text) as lo, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
g as (select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when doc_id > lo then 'E' else '' end) as fails,
    count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select p.c || q.c || r.c || s.c || t.c as filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
st as (select filter_order, step, filter_order[step] as own, filter_order[: step - 1] as before from (select filter_order, unnest(range(1, 6)) as step from o)),
m as (select part, filter_order, step, own, sum(n) as every, sum(case when regexp_matches(fails, '[' || before || own || ']') then 0 else n end) as kept,
    sum(case when contains(fails, own) and (before = '' or not regexp_matches(fails, '[' || before || '_]')) then n else 0 end) as removed,
    sum(case when contains(fails, own) then n else 0 end) as failing, sum(case when fails = own then n else 0 end) as unique_fails,
    sum(case when contains(fails, own) and not regexp_matches(fails, '[' || before || '_]') then good else 0 end) as good_lost,
    sum(case when contains(fails, own) and not regexp_matches(fails, '[' || before || '_]') then toxic else 0 end) as toxic_lost from g, st group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(failing - removed as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from m
"""


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
h as (select *, cast(len(u) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[:a], '') as pre, array_to_string(u[a + 1 : b], '') as mid, array_to_string(u[b + 1 :], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontaminate": OP7_SQL, "op9_top_k": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
