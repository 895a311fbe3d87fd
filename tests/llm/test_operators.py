import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import jaccard, licenses, media, packing, piecemodel, quality, sharding, suffixes, warc

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.sampled_from([*"ab c.,\n\t▁é日🙂1", "the", " of", "<s>", "<|endoftext|>", "  "]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_piece_model_is_the_library(text):
    own, lib = piecemodel.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = lib.encode(text)
    got, spans = own.encode(text)
    assert got == ids and own.count_all([text]) == [len(ids)] and own.decode(ids) == lib.decode(ids)
    assert own.digests([text])[0][0] == len(ids)
    raw, at = text.encode(), 0
    for a, b in spans:  # they follow each other and cover the source
        assert a == at and a <= b
        at = b
    assert not ids or at == len(raw)


def test_long_pieces():
    own, lib = piecemodel.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a" * 3000, "aaaaab" * 300, " " * 1000, "日本" * 500):
        assert own.encode(text)[0] == lib.encode(text)


def test_compiled_character_map():
    """A map of two keys, a -> x and ab -> yz, laid out by hand: the longest prefix wins, and offsets stay the source's."""
    units = [0] * 1024
    units[0] = 256 << 10  # root: children at 0 ^ 256 ^ byte
    a = 256 ^ ord("a")
    units[a] = ((a ^ 512) << 10) | 0x100 | ord("a")
    units[512] = 0x80000000 | 0
    b = 512 ^ ord("b")
    units[b] = ((b ^ 768) << 10) | 0x100 | ord("b")
    units[768] = 0x80000000 | 2
    blob = np.array(units, "<u4").tobytes()
    made = piecemodel.CharacterMap(len(blob).to_bytes(4, "little") + blob + b"x\0yz\0")
    assert made.longest_prefix(b"abc", 0) == (b"yz", 2) and made.longest_prefix(b"ac", 0) == (b"x", 1) and made.longest_prefix(b"c", 0) is None


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_digests_come_with_spans(text):
    own = piecemodel.piece_model(MODEL)
    ids, spans = own.encode(text)
    [(parts, (low, high))] = own.encoded([text])
    assert list(zip(low.tolist(), high.tolist())) == spans and ",".join(p[1] for p in parts) == ",".join(map(str, ids))
    assert own.digests([text]) == [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())]


def test_query_projects_every_piece(monkeypatch):
    own, seen = piecemodel.piece_model(MODEL), []
    real = piecemodel.PieceModel.projected
    monkeypatch.setattr(piecemodel.PieceModel, "projected", lambda *a: seen.append(real(*a)) or real(*a))
    n = own.digests(["the é日🙂 of", ""])
    assert [len(low) for low, _ in seen] == [x[0] for x in n] and seen[0][1][-1] == len("the é日🙂 of".encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*"abcé 日", "  ", "ab"]), max_size=20).map("".join), st.booleans())
def test_normalised_with_a_map(text, strip):
    """By a map of a -> x and ab -> y and a space (longest prefix first), against a walk over the text."""
    own = object.__new__(piecemodel.PieceModel)
    own.strip_spaces, own.dummy_prefix, own.map = strip, True, hand_map()
    out, at = [], 0
    while at < len(text):
        width = 2 if text[at : at + 2] == "ab" else 1
        out += [(c, len(text[:at].encode())) for c in {"a": "x", "ab": "y "}.get(text[at : at + width], text[at : at + width])]
        at += width
    if strip:
        while out and out[0][0] == " ":
            out.pop(0)
        while out and out[-1][0] == " ":
            out.pop()
        out = [c for k, c in enumerate(out) if not k or c[0] != " " or out[k - 1][0] != " "]
    out = [(" ", out[0][1]), *out] if out else []
    normal, source = own.normalise(text)
    assert normal == "".join(c for c, _ in out).replace(" ", "▁") and source.tolist() == [*[p for _, p in out], len(text.encode())]


def hand_map():
    units = [0] * 1024
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = ((a ^ 512) << 10) | 0x100 | ord("a")
    units[512] = 0x80000000 | 0
    b = 512 ^ ord("b")
    units[b] = ((b ^ 768) << 10) | 0x100 | ord("b")
    units[768] = 0x80000000 | 2
    blob = np.array(units, "<u4").tobytes()
    return piecemodel.CharacterMap(len(blob).to_bytes(4, "little") + blob + b"x\0y \0")


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_byte_bpe_is_the_library(text):
    assert packing.byte_bpe(BPE).ids(text) == np.array(packing.byte_bpe(BPE).whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=20))
def test_packing_plan_is_valid(counts):
    places, bins = packing.packing_plan(counts, 64)
    fill, ranks = Counter(), Counter()
    for s, r, n, b, offset in sorted(places, key=lambda p: (p[0], p[1])):
        assert r == ranks[s]
        ranks[s] += n
    for s, r, n, b, offset in places:
        for i in range(n):
            fill[b + i] += s
    assert dict(ranks) == counts and len(fill) == bins and max(fill.values(), default=0) <= 64


def test_packing(awkward, empty):
    rows = packing.pack_documents(awkward, BPE, 64).collect()
    assert len({r["doc_id"] for r in rows}) == 11
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty, BPE, 64).count() == 0


def test_licenses(awkward, empty):
    rows = {r["doc_id"]: r for r in licenses.scan(awkward).collect()}
    assert rows[None]["base_labels"] == "mit" and rows[None]["first_word"] == 2
    assert rows[9]["base_labels"] == "apache-2,cc-by-nc" and rows[9]["n_base"] == 2
    assert rows[4]["n_words"] == 0 and rows[4]["labels"] == "" and rows[1]["score"] == 0
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(empty).count() == 0


def test_notices(spark):
    """Each notice, whole and with a tenth of its words changed, gets its own label and no other; repeated pieces get none."""
    rows, want = [(0, "free of charge x " * 50), (1, "of the license x " * 60), (2, "in all copies " * 400)], {0: "", 1: "", 2: ""}
    rng = np.random.default_rng(4)
    for name, notice in licenses.NOTICES.items():
        words = notice.split()
        changed = list(words)
        for k in rng.choice(len(words), len(words) // 10, replace=False):
            changed[k] = "changed"
        for text in (notice, " ".join(changed), " ".join(words[: len(words) // 2]), " ".join(words[:4]) + " and " + " ".join(words[4:])):
            base = next((label for phrase, label in licenses.PHRASES.items() if phrase in text), "")
            want[len(rows)] = base if len(text.split()) < 0.8 * len(words) else name
            rows.append((len(rows), f"so it goes {text} and on"))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in got.items()} == want
    assert all(r["score"] == (1 if r["base_labels"] else r["score"]) and 0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == 1


def test_notices_of_a_table(spark, awkward):
    """Notices given as a table: long ones of a vocabulary whose k-grams need 64 bits; the built-in ones again; none; null rows; too many words."""
    rng = np.random.default_rng(5)
    made = {f"own-{k}": " ".join(f"t{x}" for x in rng.integers(0, 3000, n)) for k, n in enumerate((700, 600, 900, 12))}
    table = spark.createDataFrame([*made.items(), (None, "a b c d"), ("none", None), ("none", "!!")], "label string, text string")
    t = licenses.given(table)
    assert t.kind == np.int64 and licenses.BUILT_IN.kind == np.int32
    ids = t.numbers(made["own-0"].split())
    assert licenses.words_in(licenses.grams(ids, t), t).tolist() == ids.tolist() and ids.min() > 0
    rows, want = [(0, "under the MIT license"), (1, licenses.NOTICES["bsd"]), (2, None)], {0: "mit", 1: "", 2: ""}
    for name, text in made.items():
        words = text.split()
        changed = [w if k % 12 else "other" for k, w in enumerate(words)]
        for own, label in ((words, name), (changed, name), (words[: len(words) // 2], "")):
            want[len(rows)] = label
            rows.append((len(rows), f"before it {' '.join(own).upper()} after it"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, table).collect()}
    assert {i: r["labels"] for i, r in got.items()} == want
    assert got[0]["base_labels"] == "mit" and got[0]["score"] == 1 and all(0.8 <= got[i]["score"] <= 1 for i, x in want.items() if x.startswith("own"))
    same = spark.createDataFrame(list(licenses.NOTICES.items()), "label string, text string")
    key = lambda r: str(r)
    assert sorted(licenses.scan(awkward, same).collect(), key=key) == sorted(licenses.scan(awkward).collect(), key=key)
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs, table.limit(0)).collect()}[0] == "mit"
    with pytest.raises(ValueError):
        licenses.given(spark.createDataFrame([("x", "w " * (licenses.MOST_WORDS + 1))], "label string, text string"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(0, 4), max_size=14))
def test_alignment(notice, words):
    import difflib

    n, first, last = licenses.aligned(notice, words)
    table = [[0] * (len(words) + 1) for _ in range(len(notice) + 1)]
    for i, a in enumerate(notice):
        for k, b in enumerate(words):
            table[i + 1][k + 1] = table[i][k] + 1 if a == b else max(table[i][k + 1], table[i + 1][k])
    assert n == table[-1][-1] and (not n or 0 <= first <= last < len(words))
    assert n >= sum(m.size for m in difflib.SequenceMatcher(None, notice, words, autojunk=False).get_matching_blocks())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=20))
def test_grams_hold_their_words(ids):
    got = licenses.words_in(licenses.grams(np.array(ids, np.int32)))
    assert got.tolist() == (ids if len(ids) >= licenses.K else [])


def test_counts(awkward, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((r["doc_id"] or -1, len(lib.encode(r["text"] or ""))) for r in awkward.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in piecemodel.count_tokens(awkward, MODEL).collect()) == want
    assert piecemodel.encode_decode(awkward, MODEL).count() == len(want) and piecemodel.encode_decode(empty, MODEL).count() == 0
    assert piecemodel.encode_spans(awkward, MODEL).count() == len(want)


def test_binomial_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == 1
    for k, n, error in ((0, 439, 0.0125), (7, 60, 0.01), (59, 60, 0.2), (5000, 100_000, 0.0025)):
        p = quality.upper_bound(k, n, error)
        log = lambda i, n=n, p=p: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        assert sum(math.exp(log(i)) for i in range(k + 1)) == pytest.approx(error, rel=1e-6)
    assert quality.upper_bound(0, 437, 0.05 / 4) <= 0.01 < quality.upper_bound(0, 435, 0.05 / 4)


def test_certified_step():
    kept = lambda *n: [*n, *[0] * (len(quality.STEPS) + 1 - len(n))]
    none = [0] * len(quality.STEPS)
    assert quality.certified([*none, 5000], kept(10), 0.01, 0.0125) == 0  # the most lenient of ties
    assert quality.certified([*none, 5000], kept(10, 3), 0.01, 0.0125) == 1
    assert quality.certified([0, 500, *none[2:], 5000], kept(10, 3), 0.01, 0.0125) == 0  # the second set rejects too many good ones
    assert quality.certified([*none, 100], kept(10), 0.01, 0.0125) is None and quality.certified([0, *none], kept(10), 0.01, 0.0125) is None


def test_quality_rejects_under_certified_cutoffs(spark):
    """Good and bad documents of two languages, labelled; a third language has too few labels and is left alone."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(1300):
        lang = "a" if i < 600 else "b" if i < 1200 else "c"
        bad = i % 10 == 0
        text = " ".join(rng.choice(words, 60)) + (" #$%&" * 40 if bad else " #" * (i % 2))
        rows.append((i, lang, text))
        labels.append((i, int(not bad), 0))
    docs, labelled = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labelled).collect()}
    assert all(got[i]["kept"] == (i % 10 != 0) for i in range(1200)) and all(got[i]["kept"] for i in range(1200, 1300))
    assert {r["rejected_by"] for r in got.values()} == {None, "symbol_share"}
    alone = quality.judge(docs.where("lang = 'a'"), labelled, alpha=0.03).collect()  # one stratum: half of its labels shape the path
    assert sum(not r["kept"] for r in alone) == 60


def test_copies_certify_nothing(spark):
    """500 copies of one good text are one document to the bound; 500 texts are enough. One copy labelled bad makes the text bad."""
    words = [f"w{i}" for i in range(900)]
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice(words, 60))
    one = text()
    rows = [(i, "a", one if i < 500 else text()) for i in range(520)] + [(i, "b", text()) for i in range(1000, 1500)]
    rows += [(2000 + i, "ab"[i % 2], text() + " #$%&" * 40) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i < 2000 and i != 17), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    measured = quality.with_measures(quality.keyed_texts(docs))
    assert [r["stratum"] for r in quality.certify(measured, labels, 0.012, 0.05).collect()] == ["b"]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels, 0.012).collect()}
    assert all(got[i] == (i < 2000 or i % 2 == 0) for i in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_repeat_words(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    assert quality.measure(" ".join(words))[4] == len(covered)


def test_quality(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(awkward, labels).collect()
    assert len(rows) == awkward.count() and {r["doc_id"] for r in rows if r["kept"]} >= {1, 2, 3, 10}
    assert quality.kept_documents(awkward, labels).columns == awkward.columns
    assert quality.kept_documents(empty, labels).count() == 0


def brute_repeats(texts):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in datas for i in range(len(b) - 399))
    out = []
    for b in datas:
        gone = np.zeros(len(b) + 2, np.int8)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i + 1 : i + 401] = 1
        inner = gone[1:-1].astype(bool)
        out.append((len(b), int(inner.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~inner].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot, salt", [(1000, 1000), (1, 1000), (1, 1)])
def test_repeats(awkward, empty, monkeypatch, hot, salt):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SALT", salt)
    rows = awkward.collect()
    want = sorted((r["doc_id"] or -1, *w) for r, w in zip(rows, brute_repeats([r["text"] for r in rows])))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(awkward).collect())
    assert got == want
    assert suffixes.removed(empty).count() == 0


def test_repeats_within_one_document(spark):
    """Anchors found very often in one document, with equal and with different surroundings."""
    rng = np.random.default_rng(3)
    mixed = "".join("k" * 140 + "".join(rng.choice(list("abc"), 90)) for _ in range(300))
    texts = ["ab" * 3000, "z" * 2500, mixed, mixed[1000:9000], "q" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(docs).collect())
    assert got == [(k, *w) for k, w in enumerate(brute_repeats(texts))]


def test_anchors_of_parts(monkeypatch):
    """Anchors do not depend on how a text is cut into parts."""
    rng = np.random.default_rng(5)
    data = np.r_[rng.integers(97, 123, 9000), np.full(3000, 97), rng.integers(97, 99, 3000)].astype(np.uint8)
    whole = suffixes.anchors(data)
    for at_once in (400, 401, 1000, 1013):
        monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
        assert all(np.array_equal(a, b) for a, b in zip(whole, suffixes.anchors(data)))


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_of_a_long_text(spark, monkeypatch, hot):
    """A text hashed in parts: what occurs once stays, and a passage over the cut that occurs twice goes."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    clean = np.random.default_rng(7).integers(97, 123, suffixes.AT_ONCE + 20_000).astype(np.uint8)
    twice = clean.copy()
    twice[1000:1600] = twice[suffixes.AT_ONCE - 700 : suffixes.AT_ONCE - 100]
    twice[[999, 1600]] = 65, 66
    keep = np.ones(len(twice), bool)
    keep[1000:1600] = keep[suffixes.AT_ONCE - 700 : suffixes.AT_ONCE - 100] = False
    for data, spans, kept in ((clean, 0, clean), (twice, 2, twice[keep])):
        docs = spark.createDataFrame([(1, data.tobytes().decode())], "doc_id long, text string")
        r = suffixes.removed(docs).first()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), len(data) - len(kept), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept.tobytes()).hexdigest()


def test_jaccard(awkward, empty):
    rows = {r["doc_id"]: r for r in jaccard.linked(awkward).collect()}
    assert rows[1]["class_id"] == rows[2]["class_id"] == rows[3]["class_id"] == rows[10]["class_id"] == 1
    assert rows[1]["n_links"] == 3 and rows[1]["n_copies"] == 1 and rows[11]["n_links"] == 0 and rows[4]["class_id"] == rows[5]["class_id"] == 4
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 6, 7, 9, 11]
    assert jaccard.linked(empty).count() == 0


def test_chance_of_a_pair_in_large_buckets():
    """Pairs at the threshold share a token at each depth in so many runs that RUNS of them miss one with a chance below 1e-5."""
    rng, hits, pairs = np.random.default_rng(11), 0, 1000
    for _ in range(pairs):
        a = rng.integers(0, 2**63, 100).astype(np.uint64)
        x, y = jaccard.sketch(a)[1], jaccard.sketch(a[:80])[1]
        both = [bool(set(p) & set(q)) for p, q in zip(x, y)]
        hits += sum(all(both[r * jaccard.DEPTH : (r + 1) * jaccard.DEPTH]) for r in range(jaccard.RUNS))
    assert (1 - hits / (pairs * jaccard.RUNS)) ** jaccard.RUNS < 1e-5
    assert np.prod([1 - np.exp(-p) for p in jaccard.PHI]) > 1 - 1e-5 ** (1 / jaccard.RUNS)


def test_one_of_each_class_without_own_id(spark):
    """Unlike texts without ids, and unlike texts of one id, are classes of their own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " end"), (None, b), (5, c), (5, d), (6, d), (5, c), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"] or "") for r in jaccard.one_of_each(docs).collect()]
    near = [k for k in kept if k[1].startswith(b)]
    assert len(near) == 1 and sorted(map(str, kept)) == sorted(map(str, [(None, a), *near, (5, c), (5, d), (None, "")]))
    found = jaccard.linked(docs)
    assert found.select("label").distinct().count() == 5 and found.where("doc_id = 6").first()["class_id"] == 5


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "http://c/", "é" * 5000)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.archived(pages).collect()}
    assert (rows[1]["record_type"], rows[1]["refers_to"], rows[2]["record_type"], rows[3]["refers_to"]) == ("revisit", 2, "response", 4)
    assert rows[5]["payload_bytes"] == 10000 and rows[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert warc.archived(pages, 2).where("record_type = 'revisit'").count() == 0 and warc.archived(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a", "x", 1), (7, "b", "x", 2), (None, "c", "y", 3), (8, "d", "z", 4), (8, "d", "z", 4), (9, None, "z", 5)], "page_id long, url string, html string, sha1 int")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.archived(odd).collect())
    assert got == [(-1, "response", None), (-1, "response", None), (7, "response", None), (8, "revisit", 9), (8, "revisit", 9), (9, "response", None)]
    some = warc.read(warc.write(pages).where("page_id = 5")).first()
    assert some["payload"].decode() == "é" * 5000


def test_media(awkward, empty):
    rows = media.stored(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 and r["media_bytes"] == r["payload_bytes"] + 44
    one = next(r for r in rows if r["doc_id"] == 4)
    assert one["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest() and one["tail_crc32"] == zlib.crc32(b" " * 16)
    assert media.stored(empty).count() == 0


def test_media_of_several_tasks(spark):
    """Equal passages in texts of several tasks and blocks: stored more than once at first, once after compaction; every medium is rebuilt."""
    rng = np.random.default_rng(6)
    common = "".join(rng.choice(list("abcdefgh "), 40_000))
    texts = [common + "".join(rng.choice(list("ijklm"), 3000)) for _ in range(6)] + ["".join(rng.choice(list("ab"), 200_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    written = media.put(docs)
    report = media.store_report(written).first()
    assert report["repeated_bytes"] > 0 and report["distinct_chunks"] < report["chunks"]
    want = {hashlib.sha256(media.payload_of(t)[0]).hexdigest() for t in texts}
    for recipe in (media.recipes(written), media.compacted(written)):
        assert {r["payload_sha256"] for r in media.rebuilt(recipe).collect()} == want
    files = {p["place"]["archive"] for r in media.compacted(written).collect() for p in r["chunks"]}
    assert not files & {p["archive"] for r in written.collect() for p in r["places"]}


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=30000))
def test_cuts(data):
    ends = media.cuts(data)
    assert ([0, *ends][-1] == len(data)) and all(0 < b - a <= media.MOST for a, b in zip([0, *ends], ends))


def test_sharding(awkward, empty):
    rows = sharding.shard(awkward, 3).collect()
    text = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    places = {}
    for r in rows:
        places.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in places.values()) and sharding.shard(empty, 3).count() == 0


def least_capacity(sizes, n):
    def fits(c):
        bins, room = 1, c
        for x in sizes:
            if x > c:
                return False
            if x > room:
                bins, room = bins + 1, c
            room -= x
        return bins <= n

    return next(c for c in range(1, sum(sizes) + 2) if fits(c))


def test_smallest_capacity(spark):
    sizes = [7, 2, 9, 4, 4, 1, 8, 3]
    ends = spark.createDataFrame([(int(e),) for e in np.cumsum(sizes)], "end long")
    assert sharding.smallest_capacity(ends, sum(sizes), max(sizes), 3) == (least_capacity(sizes, 3), [9, 22])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 9), st.sampled_from([(2, 2), (8, 4), (4096, 1024)]))
def test_capacity_search(sizes, n, resolution):
    """The search sees buckets only, however coarse, and ends with the least capacity and cuts that keep to it."""
    ends, held = np.cumsum(sizes).tolist(), (sharding.WIDE, sharding.FINE)
    sharding.WIDE, sharding.FINE = resolution
    calls = []

    def look(regions, k):
        calls.append(regions)
        found = {}
        for i, (a, b) in enumerate(regions):
            for e in ends:
                if a <= e <= b:
                    found.setdefault((i, (e - a) * k // (b - a + 1)), []).append(e)
        return [(min(v), max(v), len(v)) for v in found.values()]

    try:
        capacity, cuts = sharding.search(look, sum(sizes), max(sizes), n)
    finally:
        sharding.WIDE, sharding.FINE = held
    at = [0, *cuts, sum(sizes)]
    assert capacity == least_capacity(sizes, n) and len(cuts) == n - 1 and len(calls) < 60
    assert all(0 <= b - a <= capacity for a, b in zip(at, at[1:])) and set(cuts) <= {0, *ends}


def test_words_pattern():
    assert re.fullmatch(licenses.WORDS, "aé日")
