import zlib

import numpy as np

from tests.llm.fixtures import documents, frame
from tests.oracle import compare
from tidemark.llm import counting, decontaminate, langid, neardup, packing, pii, queries


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(counting.vocabulary_path("byte_bpe_50k.json"))


def test_token_counts_are_the_library_s(spark):
    rows = documents() + [(300, "a<|endoftext|>b " * 3) + (None,) * 7]
    found = counting.count_tokens(frame(spark, rows), ["doc_id"]).collect()
    encode = library()
    wanted = [(str(r[0]), len((r[1] or "").encode()), len(encode.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == sorted(wanted)
    assert counting.count_tokens(frame(spark, []), ["doc_id"]).collect() == []


def test_pieces_fill_sequences_without_gaps(spark):
    everything = packing.pack_documents(frame(spark), ["doc_id"]).toPandas()
    assert everything.doc_id.isna().sum() == 2 and len(everything) >= len(documents())
    rows = [r for r in documents() if r[0] is not None and r[0] not in (0, 5, 7)]
    found = packing.pack_documents(frame(spark, rows), ["doc_id"]).toPandas()
    encode = library()
    ids = {r[0]: np.array([*encode.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    for p in found.itertuples():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    assert found.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for _, group in found.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
    assert packing.pack_documents(frame(spark, []), ["doc_id"]).collect() == []


def test_both_encoders_agree_on_plain_characters():
    encoder = counting.Encoder(counting.vocabulary_path("byte_bpe_50k.json"), counting.vocabulary_path("byte_bpe_50k.tiktoken"))
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b {c}{c} 1{c}2", f" {c} {c}x\n{c}\t{c}"):
            assert encoder.fast.encode_ordinary(text) == encoder.slow.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_exchange_between_groups(spark):
    """Many small groups: rounds of exchange keep every piece, overfill nothing and need fewer sequences than the first round alone."""
    pick = np.random.default_rng(6)
    lengths = [int(x) for x in pick.integers(300, 2048, 3_000)] + [2048] * 5 + [1] * 3
    pieces = spark.createDataFrame([(k % 2_900, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    used = {}
    for rounds in (1, 4):
        found = packing.pack(pieces, group_items=60, rounds=rounds).toPandas()
        assert sorted(found.length) == sorted(lengths)
        for _, group in found.sort_values("offset").groupby("sequence_id"):
            assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 2048
        used[rounds] = found.sequence_id.nunique()
        assert found[found.length == 2048].certified.all()
    assert packing.lower_bound(np.array(lengths), 2048) <= used[4] <= used[1]


def test_lower_bound_never_exceeds_a_packing():
    pick = np.random.default_rng(4)
    for _ in range(50):
        lengths = pick.integers(1, 101, pick.integers(1, 60))
        assert packing.lower_bound(lengths, 100) <= len(packing.best_fit_decreasing(lengths, 100)[2])


def test_near_duplicates_against_all_pairs(spark):
    rows = documents(seed=9, n=25)
    base = " ".join(f"w{k}" for k in range(200))
    rows += [(500 + k, base.replace(f"w{40 * k + 5} ", "x ") if k else base) + (None,) * 7 for k in range(4)]
    rows = [r for r in rows if r[0] is not None and r[0] not in (7,)]
    found = {r["id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    words = {r[0]: None if r[1] is None else neardup.word_hashes(r[1]) for r in rows}
    label = {i: i for i in words}
    for i in sorted(words):
        for j in sorted(words):
            a, b = words[i], words[j]
            if (a is None) == (b is None) and (a is None or neardup.similar(a, b)):
                low = min(label[i], label[j])
                old = {label[i], label[j]}
                label = {k: low if v in old else v for k, v in label.items()}
    assert found == label


def test_decontamination_against_sql(spark, sf_dir):
    assert compare(spark, sf_dir, "op7_decontaminate", queries.op7_decontaminate, queries.OP7_SQL) > 0


def test_decontamination_in_blocks(spark):
    rows = documents()
    items = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows[:6])] + [(90, "river of stone"), (91, None), (None, "!")], "item_id long, text string")
    whole = decontaminate.decontaminate(frame(spark, rows), items, ["doc_id"]).drop("hit_spans").collect()
    parts = decontaminate.decontaminate(frame(spark, rows), items, ["doc_id"], block_chars=200).drop("hit_spans").collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts)) and any(r["contaminated"] for r in whole)


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries.op3_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    model = langid.fit(frame(spark))
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame(spark).where("doc_id >= 43"), model, ["doc_id"]).collect()}
    assert odd[43] == odd[44] == odd[45] == "und"


def test_personal_data(spark):
    text = "write to a.b@c.example or +1 (564) 555-4526 from 10.0.0.255 or 999.0.0.1, card 4111 1111 1111 1111"
    rows = documents() + [(400, text) + (None,) * 7]
    found = {r["doc_id"]: r for r in pii.find_spans(frame(spark, rows), pii.fit(frame(spark, rows)), ["doc_id"]).collect()}
    assert (found[400]["n_email"], found[400]["n_ip"], found[400]["n_card"], found[400]["n_phone"]) == (1, 1, 1, 1)
    assert found[400]["redacted"].startswith("write to <email> or <phone> from <ip>")
    assert found[43]["spans"] == found[44]["spans"] == ""


def classes_by_brute_force(texts):
    words = {k: neardup.word_hashes(t) for k, t in texts.items()}
    label = {k: k for k in words}
    for i in sorted(words):
        for j in sorted(words):
            if i < j and label[i] != label[j] and neardup.similar(words[i], words[j]):
                low, old = min(label[i], label[j]), {label[i], label[j]}
                label = {k: low if v in old else v for k, v in label.items()}
    return label


def test_a_large_bucket_of_many_classes_is_searched_whole(spark):
    pick = np.random.default_rng(3)
    shared = [f"s{k}" for k in range(120)]
    texts = {}
    for family in range(50):
        own = [f"f{family}x{k}" for k in range(40)]
        for copy in range(3):
            words = own[:20] + shared + own[20:]
            words[int(pick.integers(0, len(words)))] = f"c{copy}"
            texts[len(texts)] = " ".join(words)
    rows = [(k, t) + (None,) * 7 for k, t in texts.items()]
    found = {r["id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert found == classes_by_brute_force(texts) and len(set(found.values())) == 50


def test_blocks_join_the_same_classes(spark):
    pick = np.random.default_rng(5)
    base = [[f"w{f}x{k}" for k in range(60)] for f in range(4)]
    texts = {}
    for k in range(40):
        words = list(base[k % 4])
        for at in pick.choice(60, 6, replace=False):
            words[at] = f"e{k}x{at}"
        texts[bytes([k])] = " ".join(words)
    words = {k: neardup.word_hashes(t) for k, t in texts.items()}
    buckets = spark.createDataFrame([(b, k) for b in (1, 2) for k in texts], "bucket long, node binary")
    heads = spark.createDataFrame([(k, neardup.binned(neardup.grams_of(w))) for k, w in words.items()], "node binary, least binary")
    roots = spark.createDataFrame([(bytes([k]), bytes([k % 4])) for k in range(12)], "node binary, root binary")
    held = spark.createDataFrame(list(texts.items()), "node binary, text string")
    start = {k: bytes([k[0] % 4]) if k[0] < 12 else k for k in texts}

    def classes(links):
        label = dict(start)
        for a, b in links:
            low, old = min(label[a], label[b]), {label[a], label[b]}
            label = {k: low if v in old else v for k, v in label.items()}
        return label

    wanted = classes([(a, b) for a in texts for b in texts if a < b and neardup.similar(words[a], words[b])])
    for block in (512, 8):
        links = [tuple(r) for r in neardup._across(buckets, roots, heads, held, 0.8, block).collect()]
        assert all(neardup.similar(words[a], words[b]) for a, b in links) and classes(links) == wanted
    assert 4 <= len(set(wanted.values())) < 40


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment_against_the_whole_table():
    pick = np.random.default_rng(1)
    for _ in range(400):
        a, b = (neardup._mixed(pick.integers(0, 4, pick.integers(0, 16)).astype(np.uint64)) for _ in range(2))
        true = edits(a, b)
        for most in (0, 1, 2, 5, 20):
            assert neardup.within(a, b, most) == (true <= most)


def test_bounds_keep_every_similar_pair():
    pick = np.random.default_rng(8)
    for size in (1, 2, 3, 10, 60, 300, 3000):
        for _ in range(30):
            a = neardup._mixed(pick.integers(0, max(2, size // 2), size).astype(np.uint64))
            b = list(a)
            for _ in range(int(0.2 * size)):
                at = int(pick.integers(0, len(b)))
                if pick.random() < 0.6:
                    b[at] = np.uint64(pick.integers(1, 1 << 60))
                elif pick.random() < 0.5:
                    del b[at]
                else:
                    b.insert(at, np.uint64(pick.integers(1, 1 << 60)))
            b = np.array(b, np.uint64)
            if size < 100 and edits(a, b) > 0.2 * max(len(a), len(b)):
                continue
            if size >= 100 and not neardup.within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)):
                continue
            assert neardup.similar(a, b)
            (x, m), (y, n) = (neardup._unbinned([neardup.binned(neardup.grams_of(w))]) for w in (a, b))
            assert neardup.likely(x, y, m, n)[0].all()


def test_repeats_leave_first_occurrences_alone():
    grams = np.arange(20, dtype=np.uint64)
    assert set(grams) <= set(neardup.labelled(np.concatenate([grams, grams[:3]])))


def test_recall_of_near_copies_by_edit_similarity(spark):
    """Copies with up to a tenth of their words changed: at least nine of ten pairs of all edit-similar ones end in one class."""
    pick = np.random.default_rng(11)
    texts = []
    for family in range(60):
        words = [f"f{family}x{int(k)}" for k in pick.integers(0, 90, int(pick.integers(40, 300)))]
        texts.append(words)
        for _ in range(2):
            copy = list(words)
            for at in pick.integers(0, len(copy), int(len(copy) * pick.uniform(0, 0.1))):
                copy[at] = f"e{int(pick.integers(0, 1 << 30))}"
            texts.append(copy)
    rows = [(k, " ".join(t)) + (None,) * 7 for k, t in enumerate(texts)]
    found = {r["id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    words = [neardup.word_hashes(" ".join(t)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similar(words[i], words[j])]
    assert len(near) > 100 and sum(found[i] == found[j] for i, j in near) >= 0.9 * len(near)


def test_recall_of_lone_pairs_down_to_the_limit(spark):
    """Pairs that no third text joins, with a twentieth to almost a fifth of their words replaced at random places: nine of ten that are similar end in one class, four of five at the very limit."""
    pick = np.random.default_rng(12)
    rows, kinds = [], {}
    for share in (0.05, 0.1, 0.15, 0.19):
        for _ in range(120):
            n = int(pick.integers(60, 300))
            words = [f"w{k}" for k in pick.integers(0, 5_000, n)]
            other = list(words)
            for at in pick.choice(n, int(n * share), replace=False):
                other[at] = f"v{pick.integers(0, 5_000)}"
            texts = " ".join(words), " ".join(other)
            if neardup.similar(*map(neardup.word_hashes, texts)):
                kinds.setdefault(share, []).append(len(rows))
                rows += [(len(rows), texts[0]), (len(rows) + 1, texts[1])]
    found = {r["id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for share, pairs in kinds.items():
        together = sum(found[k] == found[k + 1] for k in pairs)
        assert len(pairs) >= 100 and together >= (0.8 if share > 0.18 else 0.9) * len(pairs), (share, together, len(pairs))
    # and no pair meets another one
    assert len({c for c in found.values()}) >= len(rows) // 2


def test_near_duplicates_of_null_ids_repeats_and_nothing(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (7, "one two three four five six"), (7, "quite another text under this id"), (None, None), (None, "alone under no id at all here")]
    found = neardup.near_duplicates(frame(spark, [r + (None,) * 7 for r in rows])).collect()
    assert sorted(map(repr, ((r["id"], r["class_id"], r["copies"]) for r in found))) == sorted(map(repr, [(None, 7, 3), (None, 7, 3), (7, 7, 3), (7, 7, 1), (None, None, 1), (None, None, 1)]))
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
