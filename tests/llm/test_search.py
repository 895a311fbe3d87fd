"""Nearest neighbours, hard negatives and ranked search: against SQL and brute force, and on awkward rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives, neighbours, queries, ranked, vectors

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
NEW = ["op11_vantage_points", "op12_hard_negatives", "op13_ranked_search"]
ASKS = "vec_id % 50 = 0"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("sf", [SF, LARGER])
def test_matches_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got, *names) == sorted(res.fetchall())  # to the last bit


def brute_nearest(rows, asks, k=5):
    """Of (place, id, vector) rows: (query id, rank, id, score), places told apart."""
    out = []
    for p, i, v in rows:
        if asks(i):
            scored = sorted((-float(neighbours.product(v[None], w[None])[0] / (np.sqrt(neighbours.product(v[None], v[None])[0]) * np.sqrt(neighbours.product(w[None], w[None])[0]))), j) for q, j, w in rows if q != p)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_leaves_blocks_and_copies(spark, monkeypatch, kind):
    """Shards, leaves and query blocks of a few rows; a third of all rows are copies of one vector, others are its multiples, ids repeat."""
    for name, value in (("ROWS", 40), ("QUERIES", 3), ("LEAF", 4)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(vectors, "SPAN", 2)
    rng = np.random.default_rng(3)
    hot = rng.integers(-3, 4, 6).astype(float)
    made = [(i, hot if i % 3 == 0 else 2 * hot if i % 10 == 1 else rng.integers(-3, 4, 6) + 0.5) for i in range(300)]
    made += [(50, made[7][1]), (7, made[7][1]), (100, made[100][1])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in made], f"vec_id long, embedding array<{kind}>")
    found = neighbours.nearest(df, F.expr(ASKS))
    assert rows_of(found.drop("share")) == brute_nearest([(p, i, v) for p, (i, v) in enumerate(made)], lambda i: i % 50 == 0)


def test_awkward_vectors(spark):
    """Nulls, zeros, infinities, other lengths, huge and tiny components; fewer candidates than asked for; empty tables; clashing columns."""
    inf = float("inf")
    rows = [(0, [1e200, 1e200]), (50, [1e-200, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [inf, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(i, v, i, 5) for i, v in rows], "vec_id long, embedding array<double>, row long, id int")
    got = rows_of(neighbours.nearest(df, F.expr(ASKS)).drop("share"))
    assert [r[:3] for r in got] == [(0, 1, 50), (50, 1, 0)] and all(abs(r[3] - 0.5**0.5) < 1e-15 for r in got)
    labelled = df.withColumn("label", F.when(F.col("vec_id") != 6, 1))
    for table in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 0")):
        assert neighbours.nearest(table, F.expr(ASKS)).count() == 0
        assert negatives.hard_negatives(table.withColumn("label", F.lit(1)), F.expr(ASKS), F.col("label")).count() == 0
    assert negatives.hard_negatives(labelled, F.expr(ASKS), F.col("label")).count() == 0  # no other label


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
def test_recall_falls_with_the_factor(spark):
    """A factor of one is exact; of four still finds 0.9, and reads less."""
    df = queries.table(spark, LARGER, "embeddings")
    exact, less = neighbours.nearest(df, F.expr(ASKS), factor=1.0), neighbours.nearest(df, F.expr(ASKS), factor=4.0)
    assert neighbours.recall(exact, exact) == 1 and neighbours.recall(less, exact) >= 0.9
    share = lambda d: d.agg(F.avg("share")).first()[0]
    assert share(less) <= share(exact) <= 1


def test_pruning_skips_far_clusters(spark, monkeypatch):
    """Tight clusters far apart: exact search compares a query with a small part of the vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 10
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.01).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.expr(ASKS))
    assert found.agg(F.max("share")).first()[0] < 0.2
    assert rows_of(found.drop("share")) == brute_nearest([(p, i, np.array(v)) for p, (i, v) in enumerate(rows)], lambda i: i % 50 == 0)


def brute_negatives(rows, asks, n=5, k=5, low=80, high=100):
    out = []
    whole = [[int(np.floor(256 * x)) for x in v] for _, _, v in rows]
    for a, (i, label, _) in enumerate(rows):
        if asks(i):
            scored = sorted((-sum(x * y for x, y in zip(whole[a], w)), j, other) for b, ((j, other, _), w) in enumerate(zip(rows, whole)) if b != a)
            for p, j, _ in [x for x in scored if x[2] == label][:n]:
                fit = [x for x in scored if x[2] != label and low * -p <= high * -x[0] <= high * -p][:k]
                out += [(i, j, r + 1, m, -p, -s) for r, (s, m, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e6])
def test_hard_negatives_in_blocks(spark, monkeypatch, scale):
    """Small blocks, ties, repeated rows, negative scores; products beyond 53 bits are exact too."""
    monkeypatch.setattr(negatives, "ROWS", 30)
    monkeypatch.setattr(negatives, "QUERIES", 4)
    monkeypatch.setattr(vectors, "SPAN", 2)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-2, 4, 5) * scale + 0.3).tolist()) for i in range(200)]
    rows += [rows[10], rows[10], (20, 2, rows[11][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))
    assert rows_of(got) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_scores_saturate():
    a = np.array([[2.0**40, 1.0]])
    assert negatives.scores_of(a, np.array([[2.0**40, 0.0], [-(2.0**40), 0.0], [1.0, 1.0]])).tolist() == [[2**63 - 1, 2 - 2**63, 2**40 + 1]]


def brute_rank(docs, items, k=50):
    from math import floor, log

    held = [(i, ranked.terms_of(t or "")) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total, out = len(held), sum(s for _, _, s in held), []
    for item, text in items:
        terms = set(ranked.terms_of(text or ""))
        w = {t: floor(1000 * log((2 * n + 2) / (2 * df + 1))) for t in terms if (df := sum(t in c for _, c, _ in held))}
        scored = sorted((-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * s * n // total))) for t in w if t in c), i is None, i or 0) for i, c, s in held)
        out += [(item, r + 1, None if none else i, -x) for r, (x, none, i) in enumerate([y for y in scored if y[0] < 0][:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once, cells, k", [(1 << 20, 1 << 21, 50), (5, 64, 3), (40, 7, 1)])
def test_ranked_search_in_passes(spark, monkeypatch, at_once, cells, k):
    """Ties, repeated documents, a null id, null and empty texts, one very long text, items that share all or no terms, in one pass or many."""
    monkeypatch.setattr(ranked, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(ranked, "CELLS", cells)
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in (rng.zipf(1.3, 4000) % 60)]
    docs = [(i, " ".join(words[j : j + int(m)])) for i, (j, m) in enumerate(zip(rng.integers(0, 3900, 200), rng.integers(1, 60, 200)))]
    docs += [docs[3], docs[3], (None, docs[4][1]), (900, None), (901, ""), (902, "!? \x7f"), (903, "W1,w1;É_É " + "w2 " * 30000), (904, docs[5][1])]
    items = [(1, "w1 w2 W3"), (2, " ".join(words[:300])), (3, None), (4, "absent"), (5, "É"), (1, "w59 w58 w7"), (6, "w1 w2 w3")]
    got = ranked.rank(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int"), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int"), k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_rank(docs, items, k)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank(docs.limit(0), items).count() == 0 and ranked.rank(docs, items.limit(0)).count() == 0 and ranked.rank(docs.where("doc_id = 2"), items).count() == 0


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
def test_bounds_leave_documents_out(spark):
    """The stored impacts and suffix bounds are safe (SQL agrees above) and at work: terms that most documents have generate nothing."""
    docs, items = queries.table(spark, LARGER, "documents"), queries.table(spark, LARGER, "benchmark")
    entries = ranked.item_terms(items)
    terms = sorted(r["term"] for r in entries.select("term").distinct().collect())
    rows = ranked.postings(docs, terms)
    n, total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "name string, number int")
    numbered = entries.join(numbers, F.col("term") == F.col("name")).select("item", F.col("number").alias("term"))
    bounds = ranked.item_bounds(numbered, ranked.term_bounds(rows, n, total, 50))
    assert bounds.where("least > 0 and not generates").count() > 0 and bounds.where("rest >= least and least > 0").count() == 0
