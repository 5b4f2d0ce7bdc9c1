"""Parts of the operators against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folium.llm import exact_dedup, jaccard_join, license_scan, quality_ftrl, repeat_parse, token_blocks, toxicity_fm
from folium.llm.components import components
from folium.llm.piece_viterbi import MARK, PieceCodec, PieceModel


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        index = exact_dedup.PerfectHash(digests)
        assert sorted(index.slot(digests)) == list(range(n))
        strangers = index.slot(rng.integers(0, 256, (100, 32), dtype=np.uint8))
        assert ((strangers >= -1) & (strangers < max(n, 1))).all()


def test_elias_fano_selects():
    rng = random.Random(2)
    for values in ([], [0], [5], [3, 3, 3], sorted(rng.randrange(10**6) for _ in range(700)), [0] * 200 + [2**40], [0, 2**64 - 1], sorted(rng.randrange(2**64) for _ in range(500))):
        ef = token_blocks.EliasFano.of(np.array(values, "u8"))
        ef = token_blocks.EliasFano(ef.n, ef.low_bits, ef.low, ef.high, ef.ones.tobytes())
        assert values == [ef.select(k) for k in range(len(values))]


ALPHABET = ["a", "b", " ", " ", "\n", "  ", "the", "ing", "12", "!", "'s", "<s>", "é", "日", "　", MARK, "\t", "word", "ß", "𝒳", "\x1c", "aaaa", "==", "<|endoftext|>"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_byte_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = random_texts(3000, 3)
    for t, ids in zip(texts, token_blocks.ByteBpe(path).encode(texts)):
        assert plain.encode(t, add_special_tokens=False).ids == ids.tolist(), t


def test_pieces_equal_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain, codec = sentencepiece.SentencePieceProcessor(model_file=path), PieceCodec(PieceModel(path))
    texts = [*random_texts(3000, 4), "x" * 1000, "日" * 500, " " * 77 + "end", "ab" * 400]
    for t, ids in zip(texts, codec.encode(texts)):
        assert plain.encode(t) == ids.tolist(), t
        assert codec.decode(ids) == t.replace(MARK, " ")


def spelled(words):
    """Ids that spell a word out."""
    return np.array([ord(c) for w in words for c in w]), np.array(list(map(len, words)))


def test_a_full_cache_starts_anew():
    from folium.llm.word_cache import WordCache

    cache = WordCache(spelled, "<u4", 3)
    for words in (["a", "bc"], ["d", "e", "a"], ["f"], [], list("ghijk")):
        ids, ends = cache.ids(words)
        assert "".join(map(chr, ids)) == "".join(words) and ends.tolist() == np.cumsum([0, *map(len, words)]).tolist()
    assert ["".join(map(chr, x)) for x in cache.texts([["a", "long"], [], ["a"]])] == ["along", "", "a"]


@pytest.mark.parametrize("bits", [4, 7, 16])
def test_word_tables_spell_all_words(bits):
    """Words of all lengths, with NUL bytes at their ends, in tables that are full again and again."""
    from folium.llm.word_cache import WordTable, cut_at_spaces

    rng = random.Random(bits)
    table = WordTable(spelled, "<u4", bits)
    for _ in range(60):
        texts = ["".join(rng.choice("ab\0é日 ") for _ in range(rng.randrange(200))) + "x" * rng.choice((0, 8, 16, 17, 40)) for _ in range(rng.randrange(1, 6))]
        texts = [re.sub(" +", " ", t).strip(" ") or "-" for t in texts]
        raw, starts, ends, first = cut_at_spaces([t + "\ny" for t in texts])
        ids, upto = table.ids(raw, starts, ends)
        assert ["".join(map(chr, ids[upto[a] : upto[b]])) for a, b in zip(first, first[1:])] == [t.replace(" ", "") + "\ny" for t in texts]


def test_license_offsets():
    weight = {w: 1.0 for t in license_scan.TEMPLATES for w in license_scan._split(t[1])}
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, weight)
    match = lambda t: index.match(license_scan.words(t))[0]
    assert match("x. Licensed under the Apache License, Version 2.0 (y)") == {"apache-2.0"}
    assert match("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert match("License the under Apache licensed 2.0 version, apache") == set()
    assert match("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    for label, text, _ in license_scan.TEMPLATES:  # whole licences in a file, with a word of them changed
        changed = text.replace("software", "library", 1) if len(text) > 300 and "software" in text[60:] and "this software" not in text else text
        assert label in match(f"Copyright (c) 2020 someone.\n{changed}\nimport x"), label


def test_rtree_join_leaves_out_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, (6, jaccard_join.GROUPS))
    points = np.abs(base[rng.integers(0, 6, 300)] + rng.integers(-1, 2, (300, jaccard_join.GROUPS))).astype(np.uint8)
    n = points.sum(axis=1).astype(np.int64)
    tree = jaccard_join.RTree(np.arange(300), n, points)
    got = {tuple(sorted(p)) for x, y in tree.join(tree, 85, np.arange(300)) for p in zip(x.tolist(), y.tolist())}
    shared = np.minimum(points[:, None, :], points[None, :, :]).sum(axis=2, dtype=np.int64)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if 100 * shared[a, b] >= 85 * (n[a] + n[b] - shared[a, b])}
    assert want and want <= got and len(got) < 300 * 299 // 2


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_meetings_and_shared_rows_across_batches(size, monkeypatch):
    rng = random.Random(size)
    h = sorted(rng.randrange(12) for _ in range(60))
    rows = pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "node": pa.array(range(60), pa.int64()), "n": pa.array([1] * 60, pa.int32()), "at": pa.array([0] * 60, pa.int32())})
    batches = lambda: (rows.slice(k, size) for k in range(0, 60, size))
    got = [v for b in jaccard_join._shared(batches(), 85) for v in b.column(1).to_pylist()]
    assert got == [k for k in range(60) if h.count(h[k]) > 1]
    monkeypatch.setattr(jaccard_join, "LAG", 3)
    assert got == [v for b in jaccard_join._shared(batches(), 85) for v in b.column(1).to_pylist()]
    blocks = list(jaccard_join._meetings(batches(), 4))
    assert [v for _, b in blocks for v in b["node"].tolist()] == list(range(60))
    assert all(len(set(b["h"].tolist())) == 1 and len(b["h"]) <= 4 for _, b in blocks)
    assert [int(b["h"][0]) for first, b in blocks if first] == sorted(set(h))


def test_rows_without_a_possible_partner_go():
    """Sizes that differ too much, and places that leave too little in common."""
    rows = [(1, 100, 0), (1, 80, 0), (2, 100, 0), (2, 100, 14), (3, 100, 5), (3, 100, 8), (4, 10, 0), (5, 100, 0), (5, 40, 0), (5, 95, 3)]
    batch = pa.RecordBatch.from_pydict({"h": pa.array([r[0] for r in rows], pa.int64()), "node": pa.array(range(10), pa.int64()), "n": pa.array([r[1] for r in rows], pa.int32()), "at": pa.array([r[2] for r in rows], pa.int32())})
    assert jaccard_join._possible(batch, 85).column(1).to_pylist() == [4, 5, 7, 9]


def test_frequent_hashes_come_last():
    rng = np.random.default_rng(6)
    for n, many in ((1, 0), (50, 3), (200, 150), (300, 300)):
        s = np.unique(rng.integers(0, 2**63, n).astype("u8"))
        last = np.sort(np.concatenate([rng.permutation(s)[:many], rng.integers(0, 2**63, 40).astype("u8")]))
        order = [*[x for x in s if x not in last], *[x for x in s if x in last]]
        for size in (1, 10, len(s)):
            assert jaccard_join._first(s, size, last).tolist() == order[:size]
    assert jaccard_join._first(s, 5, last[:0]).tolist() == s[:5].tolist()


def test_folded_points_are_those_of_fewer_groups():
    s = np.unique(np.random.default_rng(4).integers(0, 2**63, 3000).astype("u8"))
    assert (jaccard_join._folded(jaccard_join._point(s, 1024)[None, :], 64)[0] == jaccard_join._point(s, 64)).all()


def test_many_copies_meet_in_one_place(spark):
    """A meeting of several blocks: copies of two texts with a shared line, some of them near ones."""
    rng = random.Random(9)
    line = " ".join(f"l{k}" for k in range(60))
    first = [f"a{k}" for k in range(80)]
    texts = [line + " " + " ".join([*first[:k], f"x{k}", *first[k + 1 :]]) for k in range(0, 80, 2)] + [line + " " + " ".join(f"r{rng.random()}" for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    whole = jaccard_join.BLOCK
    jaccard_join.BLOCK = 16
    try:
        got = {r.doc_id: r.component_id for r in jaccard_join.group(docs, 4, 85).collect()}
    finally:
        jaccard_join.BLOCK = whole
    assert got == {k: 0 if k < 40 else k for k in range(80)}


def test_components_without_an_id_of_their_own_keep_a_document_each(spark, tmp_path):
    """Null ids and one id on different texts: as many components as texts, of which two are near copies."""
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.random()}" for _ in range(30)) for _ in range(8)]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:]] + [(None, texts[0] + " more"), (7, texts[5] + " more"), (None, ""), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one(spark.read.parquet(f"{tmp_path}/docs")).collect()]
    assert sorted((t or "").removesuffix(" more") for _, t in got) == sorted(["", "", *texts])
    assert sorted(str(d) for d, _ in got) == ["7"] * 3 + ["None"] * 7


@pytest.mark.parametrize("most", [0, 500_000])
def test_components(spark, monkeypatch, most):
    import folium.llm.components as module

    monkeypatch.setattr(module, "ONE_TASK", most)
    rng = random.Random(most)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: m for x, m in least.items() if x != m}
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 150)}


def removed(texts):
    """Of each text what is left, by looking at all windows."""
    import collections

    raw = [t.encode() for t in texts]
    seen = collections.Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    out = []
    for x in raw:
        gone = {j for i in range(len(x) - 399) if seen[x[i : i + 400]] > 1 for j in range(i, i + 400)}
        out.append(bytes(c for j, c in enumerate(x) if j not in gone))
    return out


def repeat_texts():
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    texts = ["".join(rng.choice("xyz") for _ in range(n)) + passage[a:b] for n, a, b in ((700, 0, 2500), (13, 100, 2400), (5, 1000, 1399), (9, 1000, 1400), (0, 0, 2500), (300, 700, 1500))]
    texts += ["q" * 1500, "pq" * 600, "pq" * 250 + "r", passage[:900] + "é" + passage[901:1900]]
    for _ in range(60):  # one place of many different surroundings
        n = rng.randrange(700)
        texts.append("".join(rng.choice("klm") for _ in range(rng.randrange(200, 600))) + passage[n : n + rng.randrange(395, 900)] + "".join(rng.choice("klm") for _ in range(300)))
    return texts


@pytest.mark.parametrize("crowded", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, crowded):
    """Also where keys with many different regions go through all rounds, and beyond the bounds of the broadcasts."""
    if crowded:
        monkeypatch.setattr(repeat_parse, "CROWD", 1500)
        monkeypatch.setattr(repeat_parse, "BROADCAST_ROWS", 0)
    texts = repeat_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: bytes(r.kept) for r in repeat_parse.remove(docs).collect()}
    want = removed(texts)
    assert [got.get(k, t.encode()) for k, t in enumerate(texts)] == want
    assert 40 < sum(len(t.encode()) != len(w) for t, w in zip(texts, want)) < len(texts)


def test_texts_of_equal_hashes_keep_their_bytes(spark):
    """Two different texts whose linear hashes modulo 2^64 are equal: blocks in the order of Thue and Morse, and of its complement."""
    order = [bin(k).count("1") % 2 for k in range(128)]
    texts = ["".join(("kcW", "Wuw")[k ^ flip] for k in order) + "0123456789abcdef" for flip in (0, 1)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + "x"])), "row long, text string")
    assert len(texts[0]) == 400 and {r.row: bytes(r.kept) for r in repeat_parse.remove(docs).collect()} == {0: b"", 2: b"x"}


def test_segments_have_the_same_regions(monkeypatch):
    data = np.frombuffer(repeat_texts()[0].encode() + b"a" * 900, np.uint8)
    monkeypatch.setattr(repeat_parse, "SEGMENT", 600)
    some = [(a, b) for _, first, last, _ in repeat_parse.regions(data) for a, b in zip(first.tolist(), last.tolist())]
    assert [w for a, b in some for w in range(a, b + 1)] == list(range(len(data) - 399))
    monkeypatch.setattr(repeat_parse, "SEGMENT", 1 << 21)
    assert {a for _, first, *_ in repeat_parse.regions(data) for a in first.tolist()} <= {a for a, _ in some}


def test_dictionary_and_parse_give_the_order_of_suffixes():
    rng = random.Random(3)
    base = [bytes(rng.choice(b"ab ") for _ in range(700)) for _ in range(3)]
    texts = [base[rng.randrange(3)][:600] + base[rng.randrange(3)][: rng.randrange(50, 500)] for _ in range(12)] + [b"a" * 500, b"ab" * 300]
    parse = repeat_parse.Parse(texts)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    at = np.concatenate([np.arange(s, s + len(t)) for s, t in zip(starts, texts)])
    suffix = {int(p): t[p - s :] for s, t in zip(starts.tolist(), texts) for p in range(s, s + len(t))}
    ordered = [suffix[int(p)] for p in at[parse.order(at)]]
    assert ordered == sorted(ordered)
    assert len(parse.phrases) < len(parse.at)


def test_pairs_count_in_the_factorization_machine():
    """An insult and a group mention are toxic together only: no sum of two weights tells that from either alone twice."""
    toxicity = toxicity_fm
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["w%d" % rng.randrange(300) for _ in range(5)] + ["insult"] * insult + ["group"] * group)
        rows.append((toxicity.text_terms(text), int(insult and group)))
    model = toxicity.fit(rows)
    assert model.score("insult group w1") > 0.7
    assert max(model.score("insult w1"), model.score("group w2"), model.score("w3")) < 0.5
    assert toxicity.fit([]).score("x") == 0.5


def test_terms_that_tell_nothing_alone_count_in_pairs():
    """Toxic are texts with both terms or neither: each term alone is as often toxic as not."""
    rng = random.Random(18)
    rows = []
    for _ in range(2500):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["w%d" % rng.randrange(300) for _ in range(5)] + ["alpha"] * one + ["omega"] * two)
        rows.append((toxicity_fm.text_terms(text), int(one == two)))
    model = toxicity_fm.fit(rows)
    assert min(model.score("alpha omega w1"), model.score("w2 w3")) > 0.7 > 0.3 > max(model.score("alpha w1"), model.score("omega w2"))


def test_a_repeated_id_brings_a_bounded_sample(spark, tmp_path):
    from folium.llm import labelled

    spark.createDataFrame([(0, f"text {k}") for k in range(300)] + [(3, "other"), (None, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 1), (0, 0, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = labelled.sample(spark, str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), "toxic", 10**9, 1)
    assert {r.y for r in rows.where("text LIKE 'text%'").collect()} == {1} and rows.count() == 301
    assert labelled.first_rows(rows, 20).count() == 20


HELD_OUT = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "of", "rest"), [("op5_toxicity", "toxic", 3, 1), ("op7_quality", "quality", 4, 2)])
def test_held_out_labels(spark, name, label, of, rest):
    """Of labels that the classifiers haven't seen they find nine in ten at least, and what they find is right as often."""
    import os

    from folium.llm import queries

    if not os.path.isdir(HELD_OUT):
        pytest.skip("no test data")
    truth = spark.read.parquet(f"{HELD_OUT}/labels.parquet").groupBy("doc_id").agg({label: "max"}).toDF("doc_id", "y").where("y IS NOT NULL")
    rows = queries.queries()[name](spark, HELD_OUT).where("held_out").join(truth, "doc_id").select("y", "predicted", "score").collect()
    assert len(rows) > 500
    hits = sum(r.y and r.predicted for r in rows)
    recall, precision = hits / sum(r.y for r in rows), hits / max(1, sum(r.predicted for r in rows))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_quality_learns_shapes():
    tokens = quality_ftrl._Tokens()
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(400):
        good = k % 2
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(30))
        rows.append((*quality_ftrl.features(text, tokens), good))
    model = quality_ftrl.fit(rows)
    assert model.score(*quality_ftrl.features("abcab bcabc cabca defgh " * 5, tokens)) > 0.7
    assert model.score(*quality_ftrl.features("QQQQ!! RRRR!! SSSS!! TTTT!! " * 5, tokens)) < 0.3


def test_reparameterised_question_is_found(spark):
    from folium.llm.decontamination import flag

    item = "A train leaves town at 12 km per hour with 30 people on it and comes back at 12 km per hour in the evening"
    same = "so: A train leaves town at 45 km per hour with 99 people on it and comes back at 45 km per hour in the evening"
    other = same.replace("back at 45", "back at 46")
    docs = spark.createDataFrame([(0, 0, same), (1, 1, other), (2, 2, None), (3, 3, "nothing alike"), (4, 4, item)], "row long, doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in flag(docs, bench).collect()} == {0: [7], 4: [7]}


def test_ownership_separates_examples_from_live_secrets(spark):
    from pyspark.sql import functions as F

    from folium.llm.secret_scan import judge, ownership, scan

    shared, live, spread, two = "token=sharedexample1", "secret = zX9qLm27RtYw", "password: abcd0123efgh", "api_key: q1w2e3r4t5y6u7"
    rows = [(k, shared, f"o{k}", "r") for k in range(4)] + [(9, live, "o9", "r"), (10, live, "o9", "r"), (11, None, None, None)]
    rows += [(20 + k, spread, "o1", f"r{k}") for k in range(4)] + [(30, two, "o1", "r"), (31, two, "o2", "r")]
    found = scan(spark.createDataFrame(rows, "doc_id long, text string, o string, r string"), F.col("o"), F.col("r"))
    kinds = {r.doc_id: sorted(a.kind for a in r.added) for r in judge(found).collect()}
    assert kinds == {**{k: [3] for k in (0, 1, 2, 3, 20, 21, 22, 23)}, 9: [4], 10: [4], 11: [], 30: [5], 31: [5]}
    assert sorted((r.n_rows, r.n_owners, r.n_repositories) for r in ownership(found).collect()) == [(2, 1, 1), (2, 2, 2), (4, 1, 4), (4, 4, 4)]


def flagged(spark, items, texts):
    """By place in texts: the items that flag it."""
    from folium.llm.decontamination import flag

    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r["items"] for r in flag(docs, bench).collect()}


def test_an_edited_quote_of_an_item_is_found(spark):
    """One of two occurrences changed, marks at a repeated value, and verbatim words beside values that were equal by chance."""
    short = "the old shop sold 12 pears on monday and then sold 12 plums on friday"
    long = "there are 2 apples and 2 pears on the table of the house " + " ".join(f"word{chr(97 + k)}" for k in range(20))
    texts = [
        short.replace("12 plums", "13 plums"), short.replace("12 pears", "12, pears"), long.replace("2 apples and 2", "4 apples and 5"), short.replace("12 pears", "14 pears").replace("12 plums", "15 plums"), short.replace("12", "1.2"),
    ]
    assert flagged(spark, [short, long], texts) == {0: [0], 1: [0], 2: [1], 4: [0]}


def test_names_anywhere_and_glued_units_are_typed(spark):
    item = "Tom has 5kg of rice and sells 2kg. How much is left now?"
    texts = [
        "Ann has 9kg of rice and sells 4kg. How much is left now?", "so Ann has 9 kg of rice and sells 4 KG. How much is left now?", '"Ann has 9kg of rice and sells 4kg.\nHow much is left now?"', item.lower(),
        "Ann has 9kg of corn or buys 4kg. How much is left now?", "drives 60km/h",
    ]
    repeated = "Tom went to the market with Ann today. Tom came home from there very late"
    more = [repeated.replace("Tom", "Bob"), repeated.replace("Tom", "Bob", 1).replace("Tom", "Max"), repeated.replace("with Ann", "with Eve")]
    assert flagged(spark, [item, repeated], texts + more) == {0: [0], 1: [0], 2: [0], 3: [0], 6: [1], 8: [1]}


def family_texts(seed):
    """Families of near copies of sizes on both sides of the levels, a common line in many, and chains of edits."""
    rng = random.Random(seed)
    line, texts = [f"l{k}" for k in range(40)], []
    for size in (30, 230, 290, 900, 1150, 2600):
        words = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            copy = list(words)
            for _ in range(int(size * rng.choice((0, 0.005, 0.01, 0.02, 0.05)))):
                copy[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = copy
            texts.append(" ".join(copy[: int(size * rng.choice((1, 1, 0.9)))] + (line if rng.random() < 0.3 else [])))
    return texts + [" ".join(line + [f"r{rng.random()}" for _ in range(rng.randrange(30))]) for _ in range(40)]


@pytest.mark.parametrize("few", [True, False])
def test_families_equal_brute_force(spark, monkeypatch, few):
    """Also in places of several blocks, and beyond the bound of the broadcast."""
    from test_contracts import linked, sets_of

    if few:
        monkeypatch.setattr(jaccard_join, "BLOCK", 8)
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr("folium.llm.components.ONE_TASK", 0)
    texts = family_texts(12)
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    for size, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in jaccard_join.group(docs, size, percent).collect()}
        roots = linked(sets_of(list(enumerate(texts)), size), percent)
        assert 10 < len(set(roots)) < len(texts) - 20, len(set(roots))
        assert got == {k: roots.index(r) for k, r in enumerate(roots)}


def test_large_ids_beside_null_ids_stay_whole(spark, tmp_path):
    """Ids around 2^53, 2^62 and the ends of the range, with nulls in the same bucket."""
    ids = [None, 2**53 + 1, 2**53 + 2, 2**53 + 3, 2**62, 2**62 + 1, 2**63 - 1, -(2**63), None]
    rows = [(i, f"text {k % 3}") for k, i in enumerate(ids * 3)] + [(2**53 + 1, "other"), (2**53, "other"), (None, "other"), (2**63 - 1, "last"), (None, "last"), (None, "none"), (None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = exact_dedup.op1_exact_dedup(spark, str(tmp_path)).collect()
    want = {}
    for i, t in rows:
        best = want.get(t)
        want[t] = i if best is None or (i is not None and i < best) else best
    import hashlib

    digest = {hashlib.sha256(t.replace(" ", "").encode()).hexdigest(): t for t in want}
    assert len(got) == len(rows) and all(r.keep_id == want[digest[r.text_sha256]] for r in got)
    assert sum(r.kept for r in got) == len(want)


def test_lists_of_numbers_are_no_copies_of_each_other(spark):
    items = ["List 4 8 15 16 23 42 7 9 10 3 please", "a table: 1 2 3 4 5 6 7 8 9 10 11 12"]
    texts = ["scores: 1 2 3 4 5 6 7 8 19 10 21 12 13 14", "scores: 31 32 33 34 35 36 37 38 39 40 41 42 43 44", "well List 4 8 15 16 23 42 7 9 10 3 please", "so 5 6 7 8 9 10 11 12 13 14 15"]
    assert flagged(spark, items, texts) == {0: [1], 2: [0], 3: [1]}


def test_items_without_an_id_or_with_one_id_are_told_apart(spark):
    from folium.llm.decontamination import flag

    first = "the quick brown fox jumps over the lazy dog near the old river bank"
    second = "no other words of this second item stand in the first one at all today"
    bench = spark.createDataFrame([(None, first), (5, second), (5, "some third item of the same id and size that no text has in it here"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(0, 0, f"so {first} it said"), (1, 1, f"{second} {first}"), (2, 2, "nothing")], "row long, doc_id long, text string")
    got = {r.doc_id: (r["items"], r.n_items, r.covered) for r in flag(docs, bench).collect()}
    assert got == {0: ([], 1, 1.0), 1: ([5], 2, 1.0)}


def test_reparameterised_items_are_found(spark):
    """Items of templates with other names (of one word or more), numbers (digits or words) and units: nine in ten at least, and no other text."""
    rng = random.Random(21)
    names = ["Tom", "Maria", "John Smith", "Ana Lucia Perez", "Oleg", "Priya", "Mary Ann"]
    units = ["kg", "km", "ml", "min"]
    number = lambda: rng.choice([str(rng.randrange(2, 900)), f"{rng.randrange(2, 90)}.{rng.randrange(1, 9)}", rng.choice(["two", "seven", "twelve", "forty"])])
    things = ["apples", "books", "stones", "tickets", "lamps"]
    forms = [
        lambda a, b, m, n, u, t: f"{a} has {m} {t} and gives {n} of them to {b}. How many {t} does {a} have left at the end of the day?",
        lambda a, b, m, n, u, t: f"A box of {t} weighs {m}{u} and a bag weighs {n} {u}. What is the weight of the box and the bag that {a} carries home?",
        lambda a, b, m, n, u, t: f"On the way to the market {a} walked {m} {u} and then met {b}, who had walked {n} {u}. Who of the two walked further, and by how much?",
    ]
    fill = lambda f, t: f(rng.choice(names[:3]), rng.choice(names[3:]), number(), number(), rng.choice(units), t)
    items, texts = [], []
    for t in things:
        for f in forms:
            items.append(fill(f, t))
            texts.append(f"Notes of the week. {fill(f, t)} That was all.")
    clean = [" ".join(rng.choice(["Then", "we", "saw", "12", "old", "trees", "and", "Tom", "sang", "kg"]) for _ in range(60)) for _ in range(20)]
    got = flagged(spark, items, texts + clean)
    assert sum(k in got.get(k, []) for k in range(len(texts))) >= 0.9 * len(texts), sorted(set(range(len(texts))) - set(got))
    assert not [k for k in got if k >= len(texts)]


def test_rows_that_are_shuffled_before_lose_and_keep_the_right_ones(spark):
    """Documents that don't come straight from files, with nulls and one id for all: their numbers are given once."""
    from folium.llm.decontamination import drop_contaminated

    rng = random.Random(30)
    texts = [" ".join(f"w{rng.random()}" for _ in range(30)) for _ in range(40)]
    rows = [(None if k % 3 else 5, t) for k, t in enumerate([*texts, *texts[:10], *[t + " more" for t in texts[10:20]]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(r.text for r in exact_dedup.drop_duplicates(docs).collect()) == sorted({t for _, t in rows})
    kept = [r.text.removesuffix(" more") for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept) == sorted(texts)
    bench = spark.createDataFrame([(0, texts[0])], "item_id long, text string")
    assert sorted(r.text for r in drop_contaminated(docs, bench).collect()) == sorted(t for _, t in rows if t != texts[0])


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_runs_of_small_alphabets(k):
    """Every run of four periods and of two, by trying all periods; hashes that always agree leave the result as it is."""
    from test_contracts import plain_runs

    from folium.llm import periodic_runs

    rng = random.Random(k)
    for _ in range(400):
        w = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
        if w and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randint(1, 9)
            w = w[:a] + (w[a : a + p] * len(w))[: len(w) - a] + w[: rng.randint(0, 5)]
        assert periodic_runs.runs(w) == plain_runs(w)


def test_runs_decide_by_words(monkeypatch):
    from test_contracts import plain_runs

    from folium.llm import periodic_runs

    rng = random.Random(3)
    monkeypatch.setattr(periodic_runs.Words, "_hash", lambda self, a, b: 0)
    for _ in range(100):
        w = [rng.randrange(2) for _ in range(12)] * rng.randint(1, 5) + [rng.randrange(2) for _ in range(rng.randint(0, 9))]
        assert periodic_runs.runs(w) == plain_runs(w)


def test_runs_of_long_texts():
    """A million equal words and Fibonacci words are a matter of seconds; runs of two periods of the latter are as many as known."""
    from folium.llm import periodic_runs

    assert periodic_runs.runs([7] * 1_000_000) == [(0, 1_000_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert periodic_runs.runs(b) == []
    assert len(periodic_runs.runs(b[:144], 2, 2)) == 107  # 2 F(n-2) - 3 for the word of length F(n) = 144


def test_runs_table(spark):
    from folium.llm import periodic_runs

    docs = spark.createDataFrame([(1, "go a b a b a b a b end"), (2, None), (None, "x " * 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "go a b end"
    assert (got[2].n_words, got[2].runs, got[2].collapsed) == (0, [], "")
    assert got[None].collapsed == "x"


def test_alignment_in_slices(monkeypatch):
    """Long texts in slices, and pair counts given out in parts, have the results of one piece."""
    import public_tokenizers

    from folium.llm import token_alignment as T

    rng = random.Random(9)
    texts = ["", "one two  three\n", " ".join(rng.choice(("überall", "naïve", "word", "1234", "日本", "\t", "▁")) for _ in range(900)), " ".join(rng.choice(("überall", "naïve" * 90, "a\nb")) for _ in range(900)), "<|endoftext|> <s>", "\n\n x", "a ▁ b"]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    whole = T.Aligner(T.Words(T.BytePieces(paths[0]), T.SpacedPieces(paths[1])))
    want, full = whole.chunk(list(range(len(texts))), texts)
    assert not full
    monkeypatch.setattr(T, "SLICE", 50)
    monkeypatch.setattr(T, "HELD_PAIRS", 4)
    monkeypatch.setattr(T, "HELD_WORDS", 3)
    uncut = T.Words(T.BytePieces(paths[0]), T.SpacedPieces(paths[1]))
    uncut.cut = lambda text: [text]
    for words in (T.shared_words(*paths), uncut):
        parts = T.Aligner(words)
        got, full = parts.chunk(list(range(len(texts))), texts)
        assert got.to_pylist() == want.to_pylist() and full
        counts = parts.partial().to_pylist()
    assert counts == whole.partial().to_pylist()
    row = got.to_pylist()[3]
    assert row["n_overlaps"] >= sum(row["times"]) == row["n_groups"] > 0 and got.to_pylist()[2]["n_a"] == 0 == got.to_pylist()[-1]["n_b"]


@pytest.mark.parametrize("flat", [True, False])
def test_licences_with_words_put_in_and_left_out(spark, sf_dir, flat):
    """Up to three words at a third, at half and at two thirds, outside of the mandatory phrases, or one left out there."""
    weight = {w: 1.0 for t in license_scan.TEMPLATES for w in license_scan.words(t[1])} if flat else license_scan.corpus_weights(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, weight)
    lost = []
    for t, (label, _, _) in enumerate(license_scan.TEMPLATES):
        ws, phrases = index.words[t], index.phrases[t]
        if len(ws) < 20:
            continue
        held = {k + x for k, p in phrases for x in range(1, len(p))}
        places = [next((x for x in range(at, len(ws)) if x not in held), None) for at in (len(ws) // 3, len(ws) // 2, 2 * len(ws) // 3)]
        for some in ([places[0]], [places[1]], [places[2]], places):
            for words in ([b"example"], [b"by", b"example", b"inc"]):
                text = list(ws)
                for at in sorted({x for x in some if x is not None}, reverse=True):
                    text[at:at] = words
                if label not in index.match([b"intro"] * 5 + text)[0]:
                    lost.append((label, some, words))
        gone = [k for k in places if k is not None and k not in held and k not in {p[0] for p in phrases}]
        for at in gone:
            if label not in index.match(ws[:at] + ws[at + 1 :])[0]:
                lost.append((label, at, "left out"))
    assert not lost
    assert index.match([b"license", b"software"] * 20_000)[0] == set()


def test_many_rows_of_one_id_are_dealt_out(spark, tmp_path):
    """Rows of one doc_id, and of none, lie in several parts, each once, in one order."""
    import zlib

    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.when(F.col("id") % 4 < 2, F.lit(None)).when(F.col("id") % 4 == 2, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        token_blocks.write_blocks(spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/blocks", public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/blocks").groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    got = token_blocks.read_documents(spark, f"{tmp_path}/blocks").orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array([*t.encode(f"text {k}").ids, 2], "<u4").tobytes()) for k in range(4000))


def test_reparameterised_units_in_words_are_found(spark):
    """Word problems whose units and numbers are written out, with others in their place."""
    pairs = [
        ("A tank holds 300 liters of water and a pump takes out 10 minutes worth of it. How much is left in the tank after that?", "A tank holds 750 gallons of water and a pump takes out 25 seconds worth of it. How much is left in the tank after that?"),
        ("The recipe asks for 2 cups of flour, 3 teaspoons of salt and 1 pound of butter. How much of all is needed for twice the cake?", "The recipe asks for 5 grams of flour, 7 ounces of salt and 6 kilograms of butter. How much of all is needed for twice the cake?"),
        ("Tom ran 3 miles before lunch and 4 miles after it. How far did he run in all on that day?", "Ana ran 8 kilometers before lunch and 9 kilometers after it. How far did he run in all on that day?"),
        ("The rope is twelve feet long and the pole is seven inches wide. Which of them fits into the box?", "The rope is forty metres long and the pole is nine yards wide. Which of them fits into the box?"),
        ("A ticket costs 15 dollars and a drink costs 40 cents at the stand near the gate of the park", "A ticket costs 25 euros and a drink costs 60 pence at the stand near the gate of the park"),
        ("Water boils at 212 degrees and it takes 3 hours to cool it down to the heat of the room", "Water boils at 100 kelvin and it takes 45 minutes to cool it down to the heat of the room"),
    ]
    got = flagged(spark, [a for a, _ in pairs], [f"We read this once. {b} And so on." for _, b in pairs])
    assert sum(k in got.get(k, []) for k in range(len(pairs))) >= 0.9 * len(pairs), got
