"""Passages of words that repeat, against brute force."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
WORDS = suffixes.UNITS.window


def units(b):
    """(from, to) of the units of a text: words, those of over 16 bytes in pieces."""
    out = []
    for w in re.finditer(rb"[^ \t\n\v\f\r]+", b):
        first, end = w.span()
        at = first
        for p in range(first + 1, end + 1):
            x, y, z = b[p - 3 : p] if p >= first + 3 else (0, 0, 0)
            marked = p >= first + 3 and ((x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32 >> 16) % 7 == 0
            if p == end or end - first > 16 and (marked or p - at == 16):
                out.append((at, p))
                at = p
    return out


def brute(texts):
    """Texts without the runs of WORDS units or more that start elsewhere too, and the white space between units that go."""
    datas = [(t or "").encode() for t in texts]
    places = [units(b) for b in datas]
    split = [[b[a:e] for a, e in at] for b, at in zip(datas, places)]
    runs = Counter(tuple(w[i : i + WORDS]) for w in split for i in range(len(w) - WORDS + 1))
    out = []
    for b, at, w in zip(datas, places, split):
        keep = np.ones(len(b), bool)
        gone = sorted({k for i in range(len(w) - WORDS + 1) if runs[tuple(w[i : i + WORDS])] > 1 for k in range(i, i + WORDS)})
        for k, then in zip(gone, [*gone[1:], -1]):
            keep[at[k][0] : at[then][0] if then == k + 1 else at[k][1]] = False
        out.append(np.frombuffer(b, np.uint8)[keep].tobytes().decode(errors="ignore"))
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] or "" for r in suffixes.without_repeats(docs, suffixes.UNITS).collect()}
    assert got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("hot", [1000, 1])
def test_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    made = lambda seed, n: [f"{w:x}" for w in np.random.default_rng(seed).integers(16, 256, n)]
    short, less = made(1, WORDS + 1), made(2, WORDS - 1)
    rows = [made(k, 80) for k in range(10, 17)]
    texts = [" ".join(rows[0] + short + rows[1]), "\n".join(rows[2] + short) + "\t", " ".join(less + rows[3]), " ".join(rows[4] + less), " ".join(rows[5] + ["é"] * 70 + rows[6]), " ".join(short), " ".join(short) + " ", None, "", " \n", "z" * 900, "x" + "z" * 900, " ".join(rows[6])]
    assert len(" ".join(short)) < suffixes.BYTES.window
    check(spark, texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_words_in_passages_of_a_table(spark):
    """op6's following column, over the whole table: units in runs of WORDS or more that start elsewhere too."""
    rows = queries.table(spark, SF, "documents").collect()
    split = [[(r["text"] or "").encode()[a:e] for a, e in units((r["text"] or "").encode())] for r in rows]
    runs = Counter(tuple(w[i : i + WORDS]) for w in split for i in range(len(w) - WORDS + 1))
    want = {r["doc_id"]: len({k for i in range(len(w) - WORDS + 1) if runs[tuple(w[i : i + WORDS])] > 1 for k in range(i, i + WORDS)}) for r, w in zip(rows, split)}
    got = {r["doc_id"]: r["n_passage_words"] for r in queries.op6_suffix_dedup(spark, SF).collect()}
    assert got == want and any(want.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_passages_of_a_table(spark):
    check(spark, [r["text"] for r in queries.table(spark, SF, "documents").orderBy("doc_id").collect()])


def test_units():
    """Words of up to 16 bytes are units; cuts of longer ones do not depend on where the word starts, and no unit has more than 16 bytes."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        data = rng.choice(np.frombuffer(b"abcdefghij \n", np.uint8), int(rng.integers(0, 300)), p=[0.099] * 10 + [0.005] * 2)
        first, end = suffixes.units_of(data)
        assert list(zip(first.tolist(), end.tolist())) == units(data.tobytes())
    word = rng.integers(97, 123, 5000).astype(np.uint8)
    whole, later = (set(suffixes.units_of(x)[1].tolist()) for x in (word, word[1234:]))
    assert len({x + 1234 for x in later} & whole) > 0.95 * len(later)
    assert 5 < 5000 / len(whole) < 9


def test_codes_of_parts(monkeypatch):
    """Codes do not depend on how a text is cut into parts."""
    data = np.frombuffer(b" ab  c\nab c " + b"long" * 50 + b"\tc", np.uint8)
    whole = suffixes.unit_codes(data)
    monkeypatch.setattr(suffixes, "AT_ONCE", 5)
    code = suffixes.unit_codes(data).tolist()
    assert code == whole.tolist() and code[0] == code[2] and code[1] == code[3] == code[-1] and len(code) > 12


@pytest.mark.parametrize("how", [suffixes.BYTES, suffixes.UNITS])
def test_one_anchor_of_many_windows(spark, monkeypatch, how):
    """A passage too short to count in hundreds of documents: one anchor with 10^5 distinct windows and more, merged in parts; a few copies among them are found."""
    monkeypatch.setattr(suffixes, "PLACES", 40)
    monkeypatch.setattr(suffixes, "SALT", 100)
    monkeypatch.setattr(suffixes, "HOT", 100)
    monkeypatch.setattr(suffixes, "CELL", 50)
    made = lambda seed, n: " ".join(f"{w:x}" for w in np.random.default_rng(seed).integers(1 << 12, 1 << 20, n))
    core = made(0, 48)
    texts = [f"{made(k, 60)} {core} {made(-k % 10**6, 60)}" for k in range(1, 700)]
    texts += [f"{made(8000, 9)} {texts[5][40:]}", f"{texts[6][:-40]} {made(8001, 9)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(docs, how).collect()}
    if how is suffixes.UNITS:
        assert got == dict(enumerate(brute(texts)))
    else:
        assert {i for i, t in enumerate(texts) if got[i] != t} == {5, 6, 699, 700}
