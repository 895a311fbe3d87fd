"""Every operator on a text of some megabytes beside nulls, empty texts and short ones."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quarry.llm import jaccard, licenses, media, packing, piecemodel, quality, queries, ranked, sharding, suffixes

N = 300_000


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    words = np.array([f"w{k:x}" for k in range(5000)])
    long = " ".join(words[rng.integers(0, 5000, N)])
    assert len(long) > 1_500_000
    return {1: long, 2: None, 3: "", 4: "under the mit license " + " ".join(words[:60]), 5: long[:1_000_000] + " end"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_and_shards(spark, docs, texts):
    lic, judged = by_id(licenses.scan(docs)), by_id(quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    shards, stored = by_id(sharding.shard(docs, 8)), by_id(media.stored(docs))
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        n = len((t or "").split())
        assert lic[i]["n_words"] == judged[i]["n_words"] == n and judged[i]["kept"] == (n >= 50)
        assert (shards[i]["size"], shards[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and stored[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_tokens(docs, texts):
    model = public_tokenizers.path(queries.PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    counted, coded = by_id(piecemodel.count_tokens(docs, model, 4096)), by_id(piecemodel.encode_decode(docs, model))
    packed = {r["doc_id"]: r["n"] for r in packing.pack_documents(docs, public_tokenizers.path(queries.BYTE_BPE), 1024, 2).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    for i, t in texts.items():
        ids = lib.encode(t or "")
        assert counted[i]["n_tokens"] == coded[i]["n_tokens"] == len(ids) and coded[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert packed[2] == packed[3] == 1 and packed[1] > N


def test_pairs_and_search(spark, docs, texts):
    cut = by_id(suffixes.removed(docs))
    assert cut[5]["n_removed"] == 1_000_000 == cut[1]["n_removed"] and cut[4]["n_removed"] == 0 and cut[1]["n_passage_words"] >= 190_000
    links = by_id(jaccard.linked(docs))
    assert (links[1]["n_links"], links[2]["n_links"], links[4]["n_links"]) == (0, 1, 0)  # 2 and 3 are both empty
    found = ranked.rank(docs, spark.createDataFrame([(1, "license w0"), (2, texts[1])], "item_id long, text string")).collect()
    assert [(r["item_id"], r["doc_id"]) for r in sorted(found, key=lambda r: (r["item_id"], r["rank"]))][0] == (1, 4) and sum(r["item_id"] == 2 for r in found) == 3
