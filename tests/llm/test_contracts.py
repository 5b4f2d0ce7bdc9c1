"""Queries against brute force, on odd texts and on the smallest tables."""

import collections
import hashlib
import itertools
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import rows_of

import corpus_pipeline
from folium.llm import common, language_vectors, license_scan, token_alignment
from folium.llm import queries as Q

QUERIES = Q.queries()
SPACE = re.compile("[\x20\x09-\x0d]+")


def docs_of(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "sf"])
def folder(request, tables, sf_dir):
    return tables["odd"] if request.param == "odd" else sf_dir


def check(spark, folder, name, want):
    """want: the rows of the contract's columns, for each document in turn."""
    got = QUERIES[name](spark, folder).toPandas()
    wanted = __import__("pandas").DataFrame(want)
    assert len(got) == len(wanted)
    assert rows_of(got[list(wanted.columns)]) == rows_of(wanted)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(params=[False, True])
def hot(request, monkeypatch):
    """Also with keys of two rows and more as hot ones."""
    if request.param:
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "SHARES", 10**9)


def test_op1(spark, folder, hot):
    docs = docs_of(spark, folder)
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups[SPACE.sub("", t or "")].append((d, t or ""))
    want = []
    for d, t in docs:
        group = groups[SPACE.sub("", t or "")]
        keep = min(group, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        want.append({"doc_id": d, "keep_id": keep, "group_size": len(group), "text_sha256": hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()})
    check(spark, folder, "op1_exact_dedup", want)
    kept = QUERIES["op1_exact_dedup"](spark, folder).where("kept").toPandas()
    assert len(kept) == len(groups) == kept.text_sha256.nunique()


def test_op2(spark, folder, hot):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    want, spans_of = [], []
    for d, t in docs_of(spark, folder):
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least)
        base = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found)
        n = collections.Counter(kinds[k][0] for _, k, _ in found)
        want.append({"doc_id": d, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": hashlib.sha256(base.encode()).hexdigest()})
        spans_of.append(base)
    check(spark, folder, "op2_secret_ownership", want)
    spans = QUERIES["op2_secret_ownership"](spark, folder).toPandas().spans
    plain = [",".join(s for s in x.split(",") if not s.startswith(("example", "live", "shared"))) for x in spans]
    assert sorted(plain) == sorted(spans_of)


@pytest.mark.parametrize("name", [n for n in Q.oracle_sql() if n in QUERIES])
def test_sql(spark, sf_dir, duck, name):
    assert rows_of(QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.sql(Q.oracle_sql()[name]).df())


def test_op3(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted(docs_of(spark, folder), key=lambda x: (x[0] is not None, x[0] or 0))
    if any(d is None for d, _ in docs):  # the order of equal ids is open: only sums are fixed
        got = QUERIES["op3_token_blocks"](spark, folder).orderBy("start").toPandas()
        assert (got.start.iloc[1:].to_numpy() == got.n_tokens.cumsum().iloc[:-1].to_numpy()).all()
        assert sorted(got.ids_crc32) == sorted(zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, x in docs)
        return
    want, start = [], 0
    for d, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append({"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    check(spark, folder, "op3_token_blocks", want)


def test_op4(spark, folder):
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for d, t in docs_of(spark, folder):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        found = [(k, label) for p, label in base.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in found]
        want.append({"doc_id": d, "n_words": len(words), "n_base": len(found), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted({x for _, x in found}))})
    check(spark, folder, "op4_license_scan", want)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weight = license_scan.corpus_weights(docs)
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, weight)
    documents = docs_of(spark, folder)
    for d, t in documents:  # on one offset, and in chains
        labels, score = plain_labels(t, weight, base)
        found = license_scan.words(t)
        own = {label for p, label in base.items() if f" {p} " in " " + b" ".join(found).decode() + " "}
        one, best = index.match(found, 0)
        assert (",".join(sorted(own | one)), best) == (labels, pytest.approx(score))
        more, better = index.match(found)
        assert one <= more and better >= best and all(in_order(found, label, weight) for label in more - one)
    got = QUERIES["op4_license_scan"](spark, folder).toPandas()
    assert len(got) == len(documents) and (got.score.between(0, 1)).all()
    assert weight == plain_weights(documents)


def plain_weights(documents):
    """Inverse document frequencies by counting the words' documents one by one."""
    import math

    sets = [set(license_scan.words(t)) for _, t in documents]
    return {w: math.log((len(sets) + 2) / (sum(w in s for s in sets) + 1)) for w in {w for t in license_scan.TEMPLATES for w in license_scan.words(t[1])}}


def in_order(found, label, weight):
    """Whether enough of a template of that label stands in the file in its order, and its phrases do."""
    for name, text, phrases in license_scan.TEMPLATES:
        ws = license_scan.words(text)
        if name != label or any(b" " + b" ".join(license_scan.words(p)) + b" " not in b" " + b" ".join(found) + b" " for p in phrases):
            continue
        best = [0.0] * (len(ws) + 1)
        for w in found:
            prior = best[:]
            for k in range(len(ws)):
                best[k + 1] = max(prior[k + 1], best[k], prior[k] + weight[w] if ws[k] == w else 0)
        if best[-1] >= license_scan.LEAST * sum(weight[w] for w in ws) - 1e-9:
            return True
    return False


def plain_labels(text, weight, base):
    """Labels and score by trying every template at every place, with the operator's definitions: votes, phrases, share of weight."""
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    raw, labels, best = [w.encode() for w in found], set(), 0.0
    joined = " " + " ".join(found) + " "
    labels |= {label for p, label in base.items() if f" {p} " in joined}
    rank = lambda ws: sorted(set(ws), key=lambda w: (-weight[w], w))[: license_scan.RARE]
    templates = [(label, license_scan.words(t), [license_scan.words(p) for p in phrases]) for label, t, phrases in license_scan.TEMPLATES]
    have = set(raw) & set(weight)
    open_ = [x for x in templates if all(w in have for p in x[2] for w in p)]
    look = (set(rank(have)) | {w for x in open_ for w in rank(x[1])}) & have
    for label, ws, phrases in open_:
        least = max(1, sum(ws.count(w) for w in rank(ws)) // 2)
        for at in range(-len(ws), len(raw)):
            same = [k for k in range(len(ws)) if 0 <= at + k < len(raw) and raw[at + k] == ws[k]]
            if sum(ws[k] in look for k in same) < least:
                continue
            places = [next(k for k in range(len(ws)) if ws[k : k + len(p)] == p) for p in phrases]
            if any(raw[max(0, at + k) : at + k + len(p)] != p for k, p in zip(places, phrases)):
                continue
            score = sum(weight[ws[k]] for k in same) / sum(weight[w] for w in ws)
            if score >= license_scan.LEAST:
                labels.add(label)
                best = max(best, score)
    return ",".join(sorted(labels)), min(1.0, best)


def sets_of(docs, k):
    out = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def linked(sets, percent):
    """Component of each set: by all pairs."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            parent[root(max(a, b))] = root(min(a, b))
    return [root(k) for k in range(len(sets))]


def test_op6(spark, folder):
    docs = docs_of(spark, folder)
    sets = sets_of(docs, 4)
    roots = linked(sets, 85)
    least = collections.defaultdict(list)
    for (d, _), r in zip(docs, roots):
        if d is not None:
            least[r].append(d)
    want = [{"doc_id": d, "n_shingles": len(s), "component_id": min(least[r], default=None)} for (d, _), s, r in zip(docs, sets, roots)]
    check(spark, folder, "op6_jaccard_join", want)


def test_op9(spark, folder):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in docs_of(spark, folder):
        ids = sp.encode(t or "")
        want.append({"doc_id": d, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes()), "round_trip": True})
    check(spark, folder, "op9_sentencepiece", want)


def test_op10(spark, folder):
    docs = [(d, (t or "").encode()) for d, t in docs_of(spark, folder)]
    seen = collections.Counter(b[k : k + 400] for _, b in docs for k in range(len(b) - 399))
    want = []
    for d, b in docs:
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[max(k, end) : k + 400] = b"\1" * (k + 400 - max(k, end))
                end = k + 400
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append({"doc_id": d, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    check(spark, folder, "op10_repeats", want)


def plain_runs(w):
    """Runs by trying every period at every place."""
    number = {}
    x, out = np.array([number.setdefault(v, len(number)) for v in w]), []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], x[:-q] == x[q:], [0]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            n = e + q - s
            if n >= max(6, 4 * q) and not any((x[s : s + n - d] == x[s + d : s + n]).all() for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_op11(spark, folder):
    want = []
    for d, t in docs_of(spark, folder):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        row = dict(zip(("start", "length", "period"), best or (None,) * 3)) | {"exponent_milli": best and 1000 * best[1] // best[2]}
        want.append({"doc_id": d, "n_runs": len(runs)} | row | {"runs_sha256": sha(listed), "collapsed_sha256": sha(" ".join(x for k, x in enumerate(w) if k not in gone))})
    check(spark, folder, "op11_periodic_runs", want)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_alignment(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    rows, held = [], collections.Counter()
    for d, t in docs:
        x, y = [], []
        if t:
            e = a.encode(" " + t, add_special_tokens=False)
            x = [(i, bytes(byte[c] for c in s)) for i, s in zip(e.ids, e.tokens)]
            y = [(i, bytes([int(s[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", s) else s.replace("\u2581", " ").encode()) for i, s in ((i, b.id_to_piece(i)) for i in b.encode(t))]
            whole = (" " + t).encode()
            if b"".join(s for _, s in x) != whole or b"".join(s for _, s in y) != whole:
                x, y = [], []
        ends = [dict(zip(itertools.accumulate(len(s) for _, s in z), z)) for z in (x, y)]
        links = [(ends[0][e][0], ends[1][e][0]) for e in sorted(ends[0].keys() & ends[1].keys())]
        held.update(links)
        groups, at, both = [], [0, 0], [list(z) for z in ends]
        for e in sorted(ends[0].keys() & ends[1].keys()):
            upto = [z.index(e, k) + 1 for z, k in zip(both, at)]
            groups.append("|".join(",".join(str(i) for i, _ in z[k:m]) for z, k, m in zip((x, y), at, upto)))
            at = upto
        rows.append((d, len(x), len(y), groups, links))
    most = collections.Counter()
    for (_, i), n in held.items():
        most[i] = max(most[i], n)
    return [
        {"doc_id": d, "n_a": x, "n_b": y, "n_groups": len(g), "n_links": len(ls), "n_best": sum(held[p] == most[p[1]] for p in ls), "count_sum": sum(held[p] for p in ls), "groups_sha256": sha(";".join(g)) if g else ""}
        for d, x, y, g, ls in rows
    ]


def short(docs):
    """The plain alignment goes over all ends for each group."""
    return [(d, t) for d, t in docs if len(t or "") < 20_000]


@pytest.mark.parametrize("broadcast", [True, False])
def test_op12(spark, folder, monkeypatch, broadcast, tmp_path):
    if not broadcast:
        monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 1)
        monkeypatch.setattr(common, "HOT_ROWS", 20)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("coalesce(length(text), 0) < 20000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), "op12_token_alignment", plain_alignment(short(docs_of(spark, folder))))


def test_op13(spark, tables):
    """Held-out accuracy on the middle tables; odd texts are `und` where they have no letter."""
    got = QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01")
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(true, "doc_id").toPandas()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() >= 0.98
    assert held.score.between(0, 1).all()
    odd = QUERIES["op13_language_id"](spark, tables["odd"]).toPandas()
    texts = collections.defaultdict(set)
    for d, t in docs_of(spark, tables["odd"]):
        texts[d].add(any(map(str.isalpha, t or "")))
    assert len(odd) == len(docs_of(spark, tables["odd"]))
    for d, lang, score in zip(odd.doc_id, odd.lang_pred, odd.score):
        if d == d:
            assert (lang == "und") == (texts[d] == {False}) and (lang != "und" or score == 0)
    assert set(odd.lang_pred) <= {"en", "de", "und"}
    none = QUERIES["op13_language_id"](spark, tables["empty"])
    assert none.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_op13_by_letters():
    """Bundles and cosines from the definition, letter by letter."""
    letters = language_vectors.Letters(64)
    text = "Ab, c1É  x!"
    marked = "\0ab\0c\0é\0x\0"
    want = np.zeros(64)
    for k in range(len(marked) - 2):
        v = np.ones(64)
        for j, c in enumerate(marked[k : k + 3]):
            v *= np.roll(letters.vectors(np.array([ord(c)]))[0], j)
        want += v
    got = language_vectors.bundles([None, text, "12", ""], letters)
    assert (got[1] == want).all() and not got[[0, 2, 3]].any()
    model = language_vectors.Languages(["a", "b"], np.stack([want, -want]))
    names, scores = model.predict([text, None, "12"], letters)
    assert names == ["a", "und", "und"] and scores.tolist() == pytest.approx([1, 0, 0])


def test_op8(spark, sf_dir):
    """Whole items are found, and nothing that shares no eight words with an item is flagged."""
    items = [t for _, t in ((r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())]
    grams = {tuple(w[i : i + 8]) for t in items for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 7)}
    flagged = {r.doc_id for r in QUERIES["op8_decontamination"](spark, sf_dir).where("contaminated").collect()}
    for d, t in docs_of(spark, sf_dir):
        words = re.findall(r"\w+", (t or "").lower())
        if any(x in (t or "") for x in items):
            assert d in flagged
        if not any(tuple(words[i : i + 8]) in grams for i in range(len(words))) and not re.search(r"\d", t or ""):
            assert d not in flagged


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables["empty"]).count() == 0


@pytest.mark.parametrize("name", ["op5_toxicity", "op7_quality", "op8_decontamination"])
def test_odd_rows_come_back_whole(spark, tables, name):
    got = QUERIES[name](spark, tables["odd"]).toPandas()
    assert len(got) == len(docs_of(spark, tables["odd"]))
    if "score" in got:
        assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
        rest = 1 if name.startswith("op5") else 2
        assert [bool(h) for h in got.held_out] == [d == d and d is not None and zlib.crc32(str(int(d)).encode()) % (rest + 2) == rest for d in got.doc_id]


def test_stages(spark, tables, sf_dir):
    """Each stage on all that is before it: columns stay, and duplicates go by brute force."""
    for folder in (tables["odd"], sf_dir, tables["empty"]):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs_of_frame(docs)
            docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{k}")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns
                after = docs_of_frame(docs)
            if k == 1:
                assert len(after) == len({SPACE.sub("", t or "") for _, t in before}) == len({SPACE.sub("", t or "") for _, t in after})
            if k == 2:
                sets = sets_of(before, 5)
                groups = {r if s else ("none", i) for i, (r, s) in enumerate(zip(linked(sets, 80), sets))}
                assert len(after) == len(groups)
        assert docs.where("NOT round_trip").count() == 0 and docs.count() == len(after)


def docs_of_frame(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
