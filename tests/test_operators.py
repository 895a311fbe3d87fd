import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import arrays
from quarry.operators import graph, grid, order, sampling, splits, stats
from quarry.sources import sinks, tables


def test_auc_with_ties_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 9))) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert stats.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"] == pytest.approx(want, abs=1e-6)


def test_auc_of_one_class_is_null(spark):
    assert stats.auc(spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, s double"), "y", "s").first()["auc"] is None


def test_hamming_pairs_match_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(20)]
    codes = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]
    got = {(r.a, r.b) for r in graph.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "k long, h long"), "k", "h", 5).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if (codes[i] ^ codes[j]).bit_count() <= 5}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (10, 11)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 10), (11, 10)}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60))
def test_mcnemar_is_a_probability_and_symmetric(a, b):
    assert 0 <= stats.mcnemar_p(a, b) <= 1 and stats.mcnemar_p(a, b) == stats.mcnemar_p(b, a)


def test_fisher_known_value():
    assert stats.fisher_p(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "k string, p double")
    got = [r["p_holm"] for r in stats.holm(df, "p", "k").orderBy("p").collect()]
    assert got == sorted(got) and got[0] == pytest.approx(0.04)


def test_constant_grid_has_no_outlier(spark):
    df = spark.createDataFrame([("g", y, x, 3.0) for y in range(4) for x in range(4)], "g string, y int, x int, v double")
    assert {r["z"] for r in grid.robust_z(df, "g", "v").collect()} == {0.0}


def test_strides_cover():
    for n in (90, 192, 193, 500):
        s = grid.strides(n, 192, 96)
        assert s[0] == 0 and (n <= 192 or s[-1] == n - 192)


def test_group_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(i % 20, "ab"[i % 2], i) for i in range(200)], "g int, s string, i int")
    assert all(r["k"] == 1 for r in sampling.stratified_group_folds(df, "g", "s", 4, "x").selectExpr("g", "fold").distinct().groupBy("g").count().withColumnRenamed("count", "k").collect())


def test_jpeg_tables_and_round_trip():
    assert all(arrays.estimate_quality(arrays.quantisation_table(q)) == q for q in range(2, 100))
    image = np.full((16, 24), 128.0)
    assert (arrays.jpeg_like(image, 90) == image).all()
    d = arrays.dct_matrix()
    assert np.allclose(d @ d.T, np.eye(8))


def test_metadata_of_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tables.container_metadata(png)["width"] == 640
    assert tables.container_metadata(b"text")["error"] and tables.container_metadata(b"\xff\xd8\xff")["error"]


def test_sinks(spark, tmp_path):
    sinks.append_log(spark, str(tmp_path / "log"), event="a", number=1)
    sinks.append_log(spark, str(tmp_path / "log"), event="b", number=2)
    assert tables.json_lines(spark, str(tmp_path / "log"), "event string, number int").count() == 2
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), build, code=1).count() == 3
    assert len(calls) == 1 and sinks.markdown_table(spark.range(1)).startswith("| id |")


def _counted(spark, rows):
    """(edges, counter): how many rows have been computed, which a costly join would be."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return spark.createDataFrame(rows, "a long, b long").repartition(2).mapInPandas(pass_on, "a long, b long"), seen


def test_components_compute_edges_once(spark):
    """Chains, both directions, repeats, edges to oneself and missing ends: the same nodes and roots, from one pass over the edges."""
    rows = [(2, 1), (2, 3), (3, 2), (4, 3), (4, 3), (7, 7), (9, 10), (10, 10), (None, 12), (13, None)]
    edges, seen = _counted(spark, rows)
    got = {(r.node, r.root) for r in graph.components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (9, 9), (10, 9), (12, 12), (13, 13), (None, None)}
    assert seen.value == len(rows)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges, seen = _counted(spark, [(2, 1), (5, 4)])
    assert {(r.node, r.root) for r in graph.components(edges, spark.range(1, 7).toDF("node")).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)} and seen.value == 2


def test_sorted_neighbours_of_one_group_in_bounded_tasks(spark, monkeypatch):
    """All rows have one key: pairs as by brute force, and no task has more than a few parts' worth of rows."""
    monkeypatch.setattr(order, "PART", 200)
    rows = [(0, k, float(k * 37 % 50), (k * 11 % 7) / 100) for k in range(3000)]
    pairs = grid.sorted_neighbours(spark.createDataFrame(rows, "g int, k long, q double, d double"), "g", "k", ["q", "d"], 5, 0.015)
    ran = sorted((q, d, k) for _, k, q, d in rows)
    want = {(k, b) for i, (q, d, k) in enumerate(ran) for p, e, b in ran[i + 1 : i + 6] if abs(q - p) <= 0.015 and abs(d - e) <= 0.015}
    got = [(r.a, r.b) for r in pairs.select("a", "b").collect()]
    assert len(got) == len(want) and set(got) == want
    assert pairs.groupBy(F.spark_partition_id()).count().count() >= 12


def test_sorted_neighbours_shuffle_into_few_parts(spark, monkeypatch):
    """As many rows as make 300 parts: shuffles keep to the 200 that a map task writes without holding its rows, pairs as by brute force."""
    monkeypatch.setattr(order, "PART", 10)
    rows = [(k % 3, k, float(k * 37 % 50), (k * 11 % 7) / 100) for k in range(3000)]
    pairs = grid.sorted_neighbours(spark.createDataFrame(rows, "g int, k long, q double, d double"), "g", "k", ["q", "d"], 5, 0.015)
    want = set()
    for g in range(3):
        ran = sorted((q, d, k) for at, k, q, d in rows if at == g)
        want |= {(k, b) for i, (q, d, k) in enumerate(ran) for p, e, b in ran[i + 1 : i + 6] if abs(q - p) <= 0.015 and abs(d - e) <= 0.015}
    got = [(r.a, r.b) for r in pairs.select("a", "b").collect()]
    assert len(got) == len(want) and set(got) == want
    assert 100 <= pairs.rdd.getNumPartitions() <= 200


def test_parts_are_few_before_they_are_small():
    for n, parts in ((1, 1), (100 << 18, 100), (199 << 18, 199), (1000 << 18, 199), (199 << 21, 199), (1000 << 21, 1000)):
        assert order._parts(n, 199) == parts and -(-n // parts) <= order.GROWN * order.PART


def test_merge_rules_compute_edges_once(spark):
    """Two rules in turn, each of whose edges may be a costly join: one pass over each, unknown ends left out."""
    first, one = _counted(spark, [(1, 2), (2, 3), (8, 99)])
    then, two = _counted(spark, [(3, 1), (3, 4), (6, 5)])
    labels, counts = splits.merge_rules(spark.range(1, 9).toDF("node"), [("first", first), ("then", then)])
    assert {(r.node, r.root) for r in labels.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (8, 8)}
    assert [(r.rule, r.merges) for r in counts.orderBy("position").collect()] == [("first", 2), ("then", 2)]
    assert (one.value, two.value) == (3, 3)


def test_hamming_links_have_the_components_of_all_pairs(spark, monkeypatch):
    """Random codes, a dense group, repeats of a code and unknown keys, in few and in many blocks: the components of all near pairs, with fewer links than rows a block."""
    rng = np.random.default_rng(5)
    codes = [*map(int, rng.integers(0, 1 << 63, 200)), *[(1 << 62) + (1 << (i % 9)) for i in range(300)], *[77] * 20, *[77 ^ 0b1111]]
    rows = spark.createDataFrame([*enumerate(codes), (None, 77), (999, None)], "k long, h long")
    wanted = {(r.node, r.root) for r in graph.components(graph.hamming_pairs(rows, "k", "h", 4)).collect()}
    for block in (1 << 17, 40):
        monkeypatch.setattr(graph, "BLOCK", block)
        links = graph.hamming_links(rows, "k", "h", 4)
        assert {(r.node, r.root) for r in graph.components(links).collect()} == wanted and len(wanted) == 321
        assert links.count() <= max(5, -(-523 // block)) * 523


def test_hamming_links_by_vectors(spark):
    """One code and vectors apart by steps of 1: links under the limit alone, not at it; no nulls, no other length."""
    v = [[0.0, 0.0], [1.0, 1.0], [2.5, 2.5], [3.5, 3.0], [5.0, 4.5], [9.0, 9.0], [9.5, None], [9.0, 9.0, 9.0], None]
    rows = spark.createDataFrame([(k, 7, e) for k, e in enumerate(v)], "k long, h long, e array<float>")
    assert {(min(r), max(r)) for r in graph.hamming_links(rows, "k", "h", 0, "e", 1.5).collect()} == {(0, 1), (2, 3)}


def test_split_groups_carry_fewer_near_pairs_than_rows(spark, tmp_path, monkeypatch):
    """All 120 vectors but one are near each other, some are of no document: one group, and the near rule gives few edges, none over an unknown end."""
    from quarry.plans import splits as plans

    spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in range(0, 240, 2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one, other = [float(i % 5) for i in range(64)], [float(-(i % 3)) for i in range(64)]
    spark.createDataFrame([(k, 0, other if k == 8 else one) for k in range(240)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, merge = [], splits.merge_rules
    monkeypatch.setattr(splits, "merge_rules", lambda nodes, rules: seen.append(dict(rules)["near"]) or merge(nodes, rules))
    assert {(r.doc_id, r.split_group) for r in plans.split_groups(spark, str(tmp_path)).collect()} == {(k, 8 if k == 8 else 0) for k in range(0, 240, 2)}
    edges = [(r.a, r.b) for r in seen[0].collect()]
    assert len(edges) <= 5 * 120 and all(k % 2 == 0 for e in edges for k in e)
