"""Names, files, images, order, models and streams."""

import struct
import zlib
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import arrays, names, pixels
from quarry.operators import bootstrap, graph, grid, nearest, order, sampling, selection, shared, splits, stats
from quarry.plans.splits import require_rows
from quarry.sources import sinks, tables
from quarry.streaming import events


def test_names(spark):
    rows = ["Au_ani_00018.jpg", "Tp_S_NRN_S_N_arc00013_arc00013_00243.tif", "Tp_D_CND_M_N_ani00018_sec96_00138.tif", "Au_an_1.jpg", "Tp_X_a_b_c_ani00018_sec00096_1.tif", "text"]
    got = [r["s"] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(names.parsed(F.col("p")).alias("s")).collect()]
    assert (got[0]["kind"], got[0]["host_id"], got[0]["error"]) == ("original", "ani00018", None)
    assert (got[1]["type"], got[1]["flags"], got[1]["number"]) == ("copy-move", "NRN_S_N", "00243")
    assert (got[2]["type"], got[2]["host_id"], got[2]["donor_id"], got[2]["category"]) == ("splicing", "ani00018", "sec00096", "ani")
    assert all(g["error"].startswith("not a known name") and g["kind"] is None for g in got[3:])


def test_strict_names_fail(spark):
    bad = spark.createDataFrame([("text.jpg",)], "p string")
    with pytest.raises(Exception, match="not a known name"):
        bad.select(names.strict(names.parsed(F.col("p")))["kind"]).collect()
    with pytest.raises(Exception, match="not a mask name"):
        bad.select(names.mask_number(F.col("p"))).collect()


@pytest.mark.parametrize("mask, number, relation", [("Tp_D_CND_M_N_ani00018_sec00096_00138_gt.png", "00138", "identical"), ("Tp_S_CND_M_N_ani00018_sec00096_00138_gt.png", "00138", "letter_only"), ("Tp_D_CND_M_N_ani00018_xxx00000_00138_gt.png", "00138", "ids"), ("Tp_D_CND_M_N_ani00018_sec00096_00138_gt3.png", "00138", "odd_suffix")])
def test_masks(spark, mask, number, relation):
    r = spark.createDataFrame([(mask,)], "m string").select(names.mask_number(F.col("m")).alias("n"), names.mask_relation(F.lit("Tp_D_CND_M_N_ani00018_sec00096_00138"), F.col("m")).alias("r")).first()
    assert (r["n"], r["r"]) == (number, relation)


def test_csv_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.write_csv(spark.range(n).selectExpr("lpad(id, 4, '0') id", "0.1 * id x"), path)
    back = tables.typed_csv(spark, path, "id string, x double")
    assert back.count() == 5 and {r["id"] for r in back.collect()} == {f"000{k}" for k in range(5)}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_long_reports_are_refused(spark):
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(5), limit=4)


def test_unique_by_fails_on_repeats(spark):
    with pytest.raises(Exception, match="repeat"):
        tables.unique_by(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_empty_selection_fails(spark):
    with pytest.raises(ValueError, match="nothing there"):
        require_rows(spark.range(3).where("id > 5"), "nothing there")
    assert require_rows(spark.range(3), "nothing there").count() == 3


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 2**31))
def test_png(h, w, colour, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w)).astype(np.uint8)
    assert (pixels.decode(pixels.png(image)) == (image if colour else image[..., None])).all()


def filtered_png(image, kind):
    """A PNG whose rows all have one filter, made by the rules of the format."""
    h, w = image.shape
    rows, above = b"", np.zeros(w + 1, int)
    for line in image.astype(int):
        row = np.r_[0, line]
        left, up, corner = row[:-1], above[1:], above[:-1]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        rows += bytes([kind, *((line - guess) % 256).tolist()])
        above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return pixels.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (7, 11)).astype(np.uint8)
    assert (pixels.decode(filtered_png(image, kind))[..., 0] == image).all()


def test_bmp_and_uploads():
    image = np.random.default_rng(0).integers(0, 256, (9, 10, 3)).astype(np.uint8)
    rows = b"".join(line[:, ::-1].tobytes() + b"\0\0" for line in image[::-1])
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, 10, 9, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (pixels.decode(bmp) == image).all() and pixels.check_upload(bmp) == (True, "", None)
    whole = pixels.png(image)
    assert pixels.check_upload(whole)[0] and not pixels.check_upload(whole[:-40])[0] and not pixels.check_upload(None)[0]
    assert "sides" in pixels.check_upload(pixels.png(image[:4]))[2]
    assert pixels.check_upload(arrays.jpeg_header(90, 20, 20))[2] == "not readable: truncated" and pixels.check_upload(arrays.jpeg_header(90, 20, 20) + b"\xff\xd9")[0]


def test_headers_of_more_formats():
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + struct.pack("<HHII", 256, 3, 1, 40) + struct.pack("<HHII", 257, 3, 1, 30) + struct.pack("<HHII", 277, 3, 1, 3)
    m = tables.container_metadata(tiff)
    assert (m["format"], m["width"], m["height"], m["mode"]) == ("TIFF", 40, 30, "RGB")
    m = tables.container_metadata(arrays.jpeg_header(75, 64, 48))
    assert (m["width"], m["height"], m["mode"], m["n_qtables"], m["qtable_luma_dc"]) == (64, 48, "L", 2, 8)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert tables.container_metadata(webp)["width"] == 100


def test_trends(spark):
    fit = stats.quadratic_trend(spark.createDataFrame([("g", float(k), 2.0 - 3 * k + 0.5 * k * k) for k in range(8)], "g string, x double, y double"), "g", "x", "y").first()
    assert (fit["a"], fit["b"], fit["c"]) == pytest.approx((2, -3, 0.5)) and fit["rss"] == pytest.approx(0, abs=1e-6)


def test_consensus():
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 200, (60, 2))
    b = a @ np.array([[0.9, 0.1], [-0.1, 0.9]]) + (30, -10)
    b[40:] = rng.uniform(0, 200, (20, 2))
    found = pixels.consensus(a, b)
    assert found[:40].all() and found[40:].sum() <= 2 and not pixels.consensus(a[:2], b[:2]).any()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9)), min_size=1, max_size=40, unique=True))
def test_running_sums(spark, rows):
    df = spark.createDataFrame([(g, x, x + 1) for g, x in rows], "g string, x int, v int")
    got = {(r["g"], r["x"]): r["s"] for r in order.with_running(df, ["x"], {"s": "v"}, ("g",)).collect()}
    assert got == {(g, x): sum(y + 1 for h, y in rows if h == g and y < x) for g, x in rows}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [("ab"[k % 2], float(v)) for k, v in enumerate(rng.integers(0, 30, 101))] + [("a", None), ("c", 5.0)]
    got = {r["g"]: r for r in order.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    for g in "abc":
        v = [x for h, x in rows if h == g and x is not None]
        assert (got[g]["low"], got[g]["mid"], got[g]["top"]) == pytest.approx(tuple(np.quantile(v, q) for q in (0.1, 0.5, 1)))


def test_bands_keep_every_pair_with_fewer_candidates(spark):
    assert all(n * (radius + 1) > most for most in range(20) for n, radius in [graph.bands_of(most, 63)])
    n, radius = graph.bands_of(16, 63)
    share = n * sum(comb(63 // n, r) for r in range(radius + 1)) / 2 ** (63 // n)
    assert n * (radius + 1) > 16 and share < 0.35  # 17 exact bands: 1.4 candidates a random pair
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**62, 30)]
    codes = base + [b ^ sum(1 << int(i) for i in rng.choice(62, k % 18, replace=False)) for k, b in enumerate(base)]
    got = {(r.a, r.b) for r in graph.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "k long, h long"), "k", "h", 16).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if (codes[i] ^ codes[j]).bit_count() <= 16}


def test_merge_rules(spark):
    nodes = spark.range(10).withColumnRenamed("id", "node")
    edge = lambda *e: spark.createDataFrame(list(e), "a long, b long")
    labels, counts = splits.merge_rules(nodes, [("one", edge((0, 1), (1, 2))), ("two", edge((0, 2), (3, 4), (9, 77))), ("three", edge((2, 4), (5, 5)))])
    assert [(r["rule"], r["merges"]) for r in counts.orderBy("position").collect()] == [("one", 2), ("two", 1), ("three", 1)]
    assert {r["node"]: r["root"] for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0} | {k: k for k in range(5, 10)}


def test_splits_are_near_their_shares(spark):
    df = spark.createDataFrame([(i, i % 300, "xy"[i % 3 == 0]) for i in range(3000)], "k long, g long, s string")
    out = splits.make_splits(df, "k", "g", "s", "seed").cache()
    share = {r["split"]: r["count"] / 3000 for r in out.groupBy("split").count().collect()}
    assert abs(share["test"] - 0.15) < 0.02 and abs(share["val"] - 0.15) < 0.02 and splits.violations(out, "k").first() == (0, 0, 0, 0)
    wrong = out.withColumn("split", F.when(F.col("k") == 0, "test").otherwise(F.col("split")))
    assert sum(splits.violations(wrong.unionByName(wrong.limit(1)), "k").first()) > 0


def test_slices_are_disjoint(spark):
    got = sampling.slices(spark.range(100), "id", {"a": 10, "b": 20}, "s")
    assert {r["slice"]: r["count"] for r in got.groupBy("slice").count().collect()} == {"a": 10, "b": 20} and got.select("id").distinct().count() == 30


def test_grid_clusters_and_windows(spark):
    cells = spark.createDataFrame([("g", 0, 0), ("g", 1, 1), ("g", 5, 5), ("h", 1, 0)], "g string, y int, x int")
    assert {(r["g"], r["y"], r["x"], r["size"]) for r in grid.clusters(cells, "g", "y", "x").collect()} == {("g", 0, 0, 2), ("g", 5, 5, 1), ("h", 1, 0, 1)}
    windows = grid.stride_windows(spark.createDataFrame([(90,), (192,), (193,), (500,)], "n int"), "n", 192, 96)
    got = {n: sorted(r["start"] for r in windows.where(f"n = {n}").collect()) for n in (90, 192, 193, 500)}
    assert got == {n: grid.strides(n, 192, 96) for n in got}


def test_array_correlation_and_share(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=30), rng.normal(size=30)
    df = spark.createDataFrame([(a.tolist(), b.tolist()), (a.tolist(), [1.0] * 30)], "a array<double>, b array<double>")
    one, flat = [r["c"] for r in df.select(graph.array_correlation(F.col("a"), F.col("b")).alias("c")).collect()]
    assert one == pytest.approx(np.corrcoef(a, b)[0, 1]) and flat is None
    assert df.select(stats.share_within(F.col("a"), F.slice("b", 1, 3), 0.1).alias("s")).first()["s"] is None


def test_no_shared_folder_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Far:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Far)


def test_stream_of_files(spark, tmp_path):
    """Late rows are left out, each file counts once, and a second run goes on where the first stopped."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    put = lambda *rows: spark.createDataFrame(list(rows), "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    run = lambda: events.write_available(events.tumbling(events.event_stream(spark, source, schema), "1 hour", "30 minutes"), out, state)
    put((1, "2024-01-01 00:10:00", 1, "a", 1.0), (2, "2024-01-01 00:20:00", 1, "a", 2.0), (3, "2024-01-01 03:00:00", 1, "a", 3.0))
    run()
    put((4, "2024-01-01 00:30:00", 1, "a", 9.0), (5, "2024-01-01 06:00:00", 1, "a", 4.0))
    run()
    got = {(str(r["start"]), r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-01 00:00:00", 2, 3.0) in got and all(total != 9.0 and n < 3 for _, n, total in got)


@pytest.fixture
def parts(spark):
    """Every range is a part of its own, also of small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_states_over_parts(spark, parts):
    """Sums, extremes, last values, holders and conditions against brute force; groups that span parts, nulls in groups and values, one row, none."""
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None, "c"][int(g)], k, None if v == 0 else int(v)) for k, (g, v) in enumerate(zip(rng.choice(4, 90, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 9, 90)))]
    for own in (rows, rows[:1], []):
        df = spark.createDataFrame(own, "g string, k int, v int")
        ran = order.deal(df, ["k"], ("g",)).scan({"s": order.total("v"), "most": order.largest("v"), "least": order.smallest("v"), "last": order.latest("v", ["k"]), "who": order.holder("v", "k"), "all": order.every(F.col("v") < 8)})
        got = {r["k"]: tuple(r[c] for c in ("s", "most", "least", "last", "who", "all")) for r in ran.rows.collect()}
        for g, k, _ in own:
            seen = [(j, x) for h, j, x in own if h == g and j <= k]
            some = [(x, j) for j, x in seen if x is not None]
            want = (sum(x for x, _ in some), max(some)[0], min(some)[0], some[-1][0], max(some)[1]) if some else (0, None, None, None, None)
            assert got[k] == (*want, all(x is not None and x < 8 for _, x in seen))


@pytest.mark.parametrize("k", [1, 3, 40])
def test_rows_ahead_over_parts(spark, parts, k):
    """The next k rows, also where a part has fewer rows than that."""
    rows = [("ab"[i % 5 == 0], i) for i in range(60)]
    near = order.deal(spark.createDataFrame(rows, "g string, x int"), ["x"], ("g",)).ahead(k, "near", F.col("x"))
    got = {r["x"]: r["near"] for r in near.rows.collect()}
    assert got == {x: [y for h, y in rows if h == g and y > x][:k] for g, x in rows}
    assert near.scan({"s": order.total("x")}).rows.where("x = 59").first()["s"] == sum(x for g, x in rows if g == "a")


def test_parts_are_bounded(spark, monkeypatch):
    """A task has a part of about PART rows however the session merges small ones, in one group too, and finds the rows ahead in one exchange of rows."""
    monkeypatch.setattr(order, "PART", 500)
    df = spark.range(10_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 10_007).alias("x"))
    dealt = order.deal(df, ["x"], ("g",)).ahead(2, "near", F.col("x"))
    n = [r["n"] for r in dealt.parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(n) >= 18 and max(n) <= 1000
    xs = sorted(i * 7919 % 10_007 for i in range(10_000))
    assert {r["x"]: r["near"] for r in dealt.rows.collect()} == {x: xs[i + 1 : i + 3] for i, x in enumerate(xs)}
    one = dealt.rows.select("x", F.size("near"))
    one.collect()
    assert "ReusedExchange" in one._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_no_task(spark, parts):
    """One key holds half the rows: no part has more than twice the mean, a scan has one exchange of rows, and states are right."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), "id", (F.col("id") * 7919 % 10007).alias("v"))
    dealt = order.deal(df, ["id"], ("g",))
    ran = dealt.scan({"most": order.largest("v")})
    n = [r["count"] for r in ran.parts.groupBy("_part").count().collect()]
    assert len(n) == 7 and max(n) < 2 * sum(n) / len(n)
    plan = ran.parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") <= 2 and "hashpartitioning(_part" not in plan
    assert ran.rows.where("g = -1 and id = 39998").first()["most"] == max(i * 7919 % 10007 for i in range(0, 40_000, 2))


HARD = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 1e308, -1e308, 1.7e308, 1.0, 2.0, 4.0, 2.0**1023, 2.0**-1022, *[float(np.nextafter(2.0**k, w)) for k in (-1000, -3, 0, 1, 9, 900) for w in (0, 1e309)]]


def test_bins_follow_the_order(spark):
    """No value falls into a lower bin than a smaller one, next to powers of two and at the ends of the range too."""
    rng = np.random.default_rng(2)
    values = sorted([*HARD, *(rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)).tolist(), float("inf"), -float("inf")])
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*values, float("nan")])], "k int, v double")
    bins = [r["b"] for r in df.select("k", selection.coarse(F.col("v")).alias("b")).orderBy("k").collect()]
    assert bins == sorted(bins) and bins[-1] > bins[-2]


@pytest.mark.parametrize("few, direct", [(20_000, 10**6), (20_000, -1), (0, -1)])
def test_quantiles_by_histograms(spark, monkeypatch, few, direct):
    """Two columns and several groups against numpy: heavy ties, hard values, one value, nulls in values and groups; bins are broadcast or joined, in two or three rounds."""
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "DIRECT", direct)
    rng = np.random.default_rng(3)
    rows = [("many", float(v), float(w)) for v, w in zip(rng.normal(size=3000) * 1e3, rng.integers(0, 5, 3000))]
    rows += [("ties", 7.0 if k % 3 else float(v), None) for k, v in enumerate(rng.normal(size=301))] + [(None, 3.5, 1.0), (None, 4.5, None), ("none", None, None)]
    rows += [("hard", v, -v) for v in HARD if abs(v) < 1e300]
    wanted = {"a": ("x", 0.0), "b": ("x", 0.5), "c": ("x", 0.987), "d": ("y", 0.25), "e": ("x", 1.0)}
    got = {r["g"]: r for r in selection.quantiles(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], wanted).collect()}
    assert set(got) == {"many", "ties", None, "hard"}
    for g, r in got.items():
        for name, (c, q) in wanted.items():
            v = [row[1 if c == "x" else 2] for row in rows if row[0] == g]
            v = [x for x in v if x is not None]
            assert r[name] == (pytest.approx(np.quantile(v, q), rel=1e-12) if v else None)
    whole = selection.quantiles(spark.createDataFrame(rows, "g string, x double, y double"), [], {"m": ("x", 0.5)}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.median([x for _, x, _ in rows if x is not None]))
    assert selection.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], {"m": ("x", 0.5)}).count() == 0


@pytest.mark.parametrize("digits", [4, 1, 0])
def test_hash_cutoffs(spark, monkeypatch, digits):
    """The n rows of the smallest hashes, whatever share of the hash is counted; small groups whole; a null group is a group."""
    import hashlib

    monkeypatch.setattr(selection, "DIGITS", digits)
    rows = [(["a", "b", None][k % 10 // 4], k) for k in range(150)]
    got = sampling.stratified_sample(spark.createDataFrame(rows, "g string, k int"), "g", "k", 40, "s").collect()
    want = [(g, k) for h in ("a", "b", None) for g, k in sorted((r for r in rows if r[0] == h), key=lambda r: hashlib.md5(f"s|{r[1]}".encode()).hexdigest())[:40]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    few = sampling.slices(spark.range(25), "id", {"a": 10, "b": 20, "c": 5}, "s").groupBy("slice").count().collect()
    assert {r["slice"]: r["count"] for r in few} == {"a": 10, "b": 15}


def test_permutations_match_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(k, int(k % 4 == 0), int(v)) for k, v in enumerate(rng.integers(0, 50, 200))] + [(900, None, 5), (901, 1, None)]
    r = stats.permutation_p(spark.createDataFrame(rows, "k int, y int, v int"), "k", "y", "v", 20, "p").first()
    whole = [x for x in rows if x[1] is not None and x[2] is not None]
    observed, n = sum(v for _, y, v in whole if y), sum(y for _, y, _ in whole)
    drawn = [sum(v for _, _, v in sorted(whole, key=lambda x: hashlib.md5(f"p|{i}|{x[0]}".encode()).hexdigest())[:n]) for i in range(20)]
    assert (r["observed"], r["n"], r["p"]) == (observed, 200, round((1 + sum(d >= observed for d in drawn)) / 21, 6))


def test_areas_of_weights(spark, parts):
    """Areas for many weights at once against one at a time; a hot score, scores that span batches, a replicate of one class, nulls."""
    rng = np.random.default_rng(7)
    n, w = 400, rng.integers(0, 4, (400, 6))
    y, s = rng.integers(0, 2, n), np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 40, n))
    w[y == 1, 5] = 0
    rows = [(float(a), int(b), c.tolist()) for a, b, c in zip(s, y, w)] + [(None, 1, [1] * 6), (5.0, None, [1] * 6)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    got = {r["r"]: r["auc"] for r in bootstrap.areas(spark.createDataFrame(rows, "s double, y int, w array<int>"), "y", "s", 6).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(5):
        p, q = (np.repeat(s[y == c], w[y == c, k]) for c in (1, 0))
        assert got[k] == pytest.approx(((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q)), abs=1e-6)
    assert got[5] is None


def test_statistics_that_merge(spark, parts):
    """A statistic of a user's own, all replicates in one pass: the weighted mean agrees with bootstrap_mean."""
    class Mean(bootstrap.Statistic):
        def start(self, n):
            return np.zeros(n), np.zeros(n)

        def update(self, state, rows, w):
            return state[0] + rows["v"].to_numpy(float) @ w, state[1] + w.sum(axis=0)

        def merge(self, a, b):
            return a[0] + b[0], a[1] + b[1]

        def finish(self, state):
            return np.where(state[1] > 0, state[0] / np.maximum(state[1], 1), np.nan)

    df = spark.createDataFrame([(k % 13, float(k * k % 101)) for k in range(500)], "g long, v double")
    a, b = bootstrap.bootstrap_of(df, "g", Mean(), ["v"], 30).first(), bootstrap.bootstrap_mean(df, "g", "v", 30).first()
    assert a["replicates"] == 30 and all(a[c] == pytest.approx(b[c], abs=2e-6) for c in ("estimate", "low", "high"))
    none = bootstrap.bootstrap_of(df, "g", bootstrap.Median("v"), ["v"], 5, "v < 0").first()
    assert none["estimate"] is None and none["replicates"] == 0


def test_a_killed_run_goes_on(spark, tmp_path):
    """Parts that were committed before a failure stay; the next run builds the others in one scan; after that nothing is read."""
    folder, df = str(tmp_path / "out"), spark.range(1000).repartition(4)
    path = str(tmp_path / "in")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    bad = lambda d: d.select("part", "id", F.when(F.col("part") == 11, F.raise_error(F.lit("killed"))).otherwise(1).cast("int").alias("run"))
    with pytest.raises(Exception, match="killed"):
        sinks.resumable(spark, folder, df, "id", 12, lambda d: bad(d).where("part <> 11 or run > 0"))
    first = sinks.committed(spark, folder)
    assert 11 not in first
    seen = []

    def good(d):
        out = d.select("part", "id", F.lit(2).alias("run"))
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    got = sinks.resumable(spark, folder, df, "id", 12, good)
    rows = {r["id"]: (r["part"], r["run"]) for r in got.collect()}
    assert len(rows) == 1000 == got.count() and all((run == 1) == (part in first) for part, run in rows.values())
    assert len(seen) == 1 and seen[0].count("FileScan") == 1
    assert sinks.resumable(spark, folder, df, "id", 12, good).count() == 1000 and len(seen) == 1


def test_one_to_one_fails_on_either_side(spark):
    one, twice = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert tables.one_to_one(one, one, "k").count() == 2
    for a, b in ((one, twice), (twice, one)):
        with pytest.raises(Exception, match="repeat"):
            tables.one_to_one(a, b, "k").collect()


@pytest.mark.parametrize("how", ["nearest", "area", "linear"])
def test_resizing_keeps_constants(spark, how):
    flat = spark.createDataFrame([("g", y, x, 3.0) for y in range(5) for x in range(7)], "g string, y int, x int, v double")
    got = grid.resized(flat, "g", (5, 7), (8, 9), how).collect()
    assert len(got) == 72 and all(abs(r["v"] - 3) < 1e-12 for r in got)


def test_morphology_against_brute_force(spark):
    """Openings, closings and least areas of random masks, for all combinations, two grids at once."""
    rng = np.random.default_rng(9)
    h, w = 11, 13
    masks = {g: rng.random((h, w)) < p for g, p in (("a", 0.75), ("b", 0.5))}
    inside = lambda y, x: 0 <= y < h and 0 <= x < w

    def spread(m, k):
        return np.array([[any(inside(y + dy, x + dx) and m[y + dy, x + dx] for dy, dx in grid.disc(k)) for x in range(w)] for y in range(h)])

    def shrunk(m, k):
        return ~spread(~m, k)

    def large(m, least):
        left, out = {(y, x) for y in range(h) for x in range(w) if m[y, x]}, set()
        while left:
            todo, part = [left.pop()], set()
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            out |= part if len(part) >= least else set()
        return out

    cells = spark.createDataFrame([(g, y, x) for g in masks for y in range(h) for x in range(w)], "g string, y int, x int")
    marked = spark.createDataFrame([(g, y, x) for g, m in masks.items() for y in range(h) for x in range(w) if m[y, x]], "g string, y int, x int")
    got = {}
    for r in grid.cleaned_masks(marked, cells, "g", [0, 1, 2], [0, 2], [1, 5]).collect():
        got.setdefault((r["opening"], r["closing"], r["area"], r["g"]), set()).add((r["y"], r["x"]))
    for g, m in masks.items():
        for o in (0, 1, 2):
            for c in (0, 2):
                done = shrunk(spread(spread(shrunk(m, o), o), c), c)
                for a in (1, 5):
                    assert got.get((o, c, a, g), set()) == large(done, a)


@pytest.mark.parametrize("n, block, k", [(400, 30, 5), (400, 4096, 5), (3, 10, 5), (1, 10, 2), (0, 10, 2)])
def test_nearest_against_brute_force(spark, monkeypatch, n, block, k):
    """Clusters, copies of one row (ties go to the smaller key) and far rows; in tight clusters few pairs are compared."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "PIVOTS", 12)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 5)) * 100
    rows = [(3 * i, (centres[i % 8] + rng.normal(size=5) * 0.1 if i % 4 else centres[0]).tolist()) for i in range(n)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, [1.0, None])], "id long, v array<double>")
    found = nearest.k_nearest(df, "id", "v", k).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["a"], r["rank"])):
        got.setdefault(r["a"], []).append((r["b"], round(r["distance"], 9)))
    v = np.array([x for _, x in rows]).reshape(n, 5)
    for i, (key, own) in enumerate(rows):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        want = sorted((float(x), rows[j][0]) for j, x in enumerate(d) if j != i)[:k]
        assert got.get(key, []) == [(b, round(x, 9)) for x, b in want]
    if n == 400:
        assert max(r["compared"] for r in found) < 0.6


def test_a_block_within_itself_is_compared_by_slices():
    """Memory of a worker with a full block: a slice of its distances, not the square; the k-th distances are right."""
    import tracemalloc

    v = np.random.default_rng(5).normal(size=(nearest.BLOCK, 64))
    tracemalloc.start()
    bound = nearest.kth_within(np.arange(len(v)), v, 10, 1e-6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for i in (0, 511, 512, 4095):
        assert abs(bound[i] - np.sort(np.sqrt(((v - v[i]) ** 2).sum(axis=1)))[10]) < 1e-9


def test_nearest_shuffles_rows_and_not_pairs_of_blocks(spark, monkeypatch):
    """Many blocks and vectors that no bound parts, copies among them: shuffled bytes stay within a few times the vectors, results as by brute force."""
    monkeypatch.setattr(nearest, "BLOCK", 32)
    monkeypatch.setattr(nearest, "PIVOTS", 8)
    v = np.random.default_rng(9).normal(size=(1500, 16)).astype(np.float32).astype(float)
    v[::50] = v[7]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    found = nearest.k_nearest(spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<float>"), "id", "v", 5).collect()
    assert 0 < written() - before < 10 * v.nbytes
    got = {(r["a"], r["rank"]): (r["b"], round(r["distance"], 9)) for r in found}
    assert len(found) == len(got) == 5 * len(v)
    for i in range(len(v)):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.lexsort((np.arange(len(v)), d))[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, round(d[j], 9)) for j in want]


def test_contributions_against_all_subsets(spark):
    """Small made trees: Shapley values over all subsets of features, a feature split on twice, a tree of one leaf."""
    from itertools import combinations

    from quarry.operators import explain

    trees = [
        {0: (1, 2, 0, 5.0, 10.0, 0.5), 1: (3, 4, 1, 2.0, 6.0, 0.3), 2: (5, 6, 0, 8.0, 4.0, 0.8), 3: (-1, -1, -1, None, 4.0, 0.1), 4: (-1, -1, -1, None, 2.0, 0.7), 5: (-1, -1, -1, None, 1.0, 0.2), 6: (-1, -1, -1, None, 3.0, 1.0)},
        {0: (1, 2, 2, 1.0, 10.0, 0.4), 1: (-1, -1, -1, None, 7.0, 0.25), 2: (-1, -1, -1, None, 3.0, 0.75)},
        {0: (-1, -1, -1, None, 10.0, 0.6)},
    ]
    table = spark.createDataFrame([(t, i, *n) for t, tree in enumerate(trees) for i, n in tree.items()], "tree int, id int, left int, right int, feature int, threshold double, weight double, value double")
    rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate([(1, 1, 0), (5, 3, 2), (7, 2, 1), (9, 0, 5)])]
    got = {(r["k"], r["feature"]): r["value"] for r in explain.contributions(spark.createDataFrame(rows, "k int, a double, b double, c double"), "k", ["a", "b", "c"], explain.paths(table), 3).collect()}

    def expected(tree, x, known, i=0):
        left, right, f, at, w, v = tree[i]
        if left < 0:
            return v
        if f in known:
            return expected(tree, x, known, left if x[f] <= at else right)
        return sum(tree[j][4] / w * expected(tree, x, known, j) for j in (left, right))

    for k, *x in rows:
        score = lambda known, x=x: sum(expected(t, x, known) for t in trees) / 3
        assert got[k, None] == pytest.approx(score(set()), abs=1e-12)
        for f, name in enumerate("abc"):
            rest = [g for g in range(3) if g != f]
            want = sum((score({*s, f}) - score(set(s))) / (3 * (1 if len(s) in (0, 2) else 2)) for n in range(3) for s in combinations(rest, n))
            assert got[k, name] == pytest.approx(want, abs=1e-12)


def test_header_ranges(spark, tmp_path):
    """Headers by ranges agree with whole files; a bad file is an error row, a repeated or missing key fails the job."""
    rng = np.random.default_rng(0)
    tiff = lambda order, mark: mark + struct.pack(order + "I", 3008) + rng.bytes(3000) + struct.pack(order + "H", 2) + struct.pack(order + "HHI", 256, 4, 1) + struct.pack(order + "I", 70000) + struct.pack(order + "HHI", 257, 3, 1) + struct.pack(order + "HH", 9, 0)
    jpeg = arrays.jpeg_header(60, 99, 33)
    made = {"a_1.tif": tiff("<", b"II*\0"), "a_2.tif": tiff(">", b"MM\0*"), "a_3.jpg": jpeg[:2] + b"\xff\xe1" + (40000).to_bytes(2, "big") + rng.bytes(39998) + jpeg[2:] + rng.bytes(9000), "a_4.png": pixels.png(np.zeros((70, 9), np.uint8)), "a_5.bmp": b"text", "a_6.tif": b"II*\0\xff\xff\0\0", "a_7.gif": b"GIF8"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].split("/")[-1]: r for r in tables.headers(spark, str(tmp_path), "a_*", r"a_([0-9]+)\.").collect()}
    for name, content in made.items():
        want, r = tables.container_metadata(content), got[name]
        assert all(r[c] == want[c] for c in ("width", "height", "mode", "n_qtables", "qtable_luma_dc")) and (r["error"] is None) == (want["error"] is None)
        assert r["file_bytes"] == len(content) and r["bytes_read"] <= 400 and r["key"] == name[2]
    (tmp_path / "a_1.png").write_bytes(b"x")
    with pytest.raises(Exception, match="repeat"):
        tables.headers(spark, str(tmp_path), "a_*", r"a_([0-9]+)\.").collect()
    with pytest.raises(Exception, match="no key"):
        tables.headers(spark, str(tmp_path), "a_3*", r"b_([0-9]+)\.").collect()


def exact_machine(x, y, c, gamma, penalty):
    """Margins of the exact kernel machine with the same loss, by a general solver in the dual coordinates of all rows."""
    from quarry.operators import kernel

    k = kernel.kernel(x, x, gamma)
    value, vector = np.linalg.eigh(k)
    z = np.c_[vector[:, value > 1e-12] * np.sqrt(value[value > 1e-12]), np.ones(len(x))]
    ridge = np.diag(np.r_[np.full(z.shape[1] - 1, penalty), 1e-9])
    w = np.zeros(z.shape[1])
    loss = lambda v: v @ ridge @ v + (c * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    for _ in range(200):
        inside = 1 - y * (z @ w) > 0
        target = np.linalg.solve((z[inside] * c[inside, None]).T @ z[inside] + ridge, z[inside].T @ (c * y)[inside])
        step = next(s for s in 0.5 ** np.arange(30) if loss(w + s * (target - w)) <= loss(w) + 1e-12)
        w = w + step * (target - w)
    return z @ w


def test_kernel_machine_against_the_exact_one(spark):
    """All rows as landmarks: the exact machine's margins. A quarter of them: margins and area with a small gap. One row, none."""
    from quarry.operators import kernel

    rng = np.random.default_rng(12)
    x = rng.normal(size=(160, 2))
    y = np.where((x**2).sum(axis=1) + 0.3 * rng.normal(size=160) > 1.4, 1.0, -1.0)
    c = np.where(y > 0, 1.5, 0.75)
    df = spark.createDataFrame([(k, int(y[k] > 0), float(c[k]), *map(float, x[k])) for k in range(160)], "k int, label int, weight double, a double, b double")
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    want = exact_machine(scaled, y, c, 0.5, 1.0)
    gap = {}
    for n in (160, 40):
        ready = shared.cut_lineage(kernel.with_landmarks(df, ["a", "b"], "k", n, 0.5))
        got = np.array([r["score"] for r in kernel.scores(ready, kernel.fitted(ready, 1.0)).orderBy("k").collect()])
        area = [(s[y > 0][:, None] > s[y < 0]).mean() for s in (got, want)]
        gap[n] = np.abs(got - want).max(), abs(area[0] - area[1])
    assert gap[160][0] < 1e-5 and gap[40][0] < 0.1 and gap[40][1] < 0.005
    assert kernel.fitted(kernel.with_landmarks(df.where("k = 1"), ["a", "b"], "k", 5, 0.5), 1.0).shape == (2,)
    assert kernel.fitted(kernel.with_landmarks(df.limit(0), ["a", "b"], "k", 5, 0.5), 1.0).shape == (0,)


def test_published_versions(spark, tmp_path):
    """A reader has the old table until the new one is complete; a failed job leaves the old one; sweeping keeps the newest."""
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    first = sinks.publish(spark.range(3), path)
    reader = spark.read.parquet(sinks.published(spark, path))
    with pytest.raises(Exception, match="broken"):
        sinks.publish(spark.range(5).select(F.raise_error(F.lit("broken"))), path)
    assert sinks.published(spark, path).endswith(first.rsplit("/", 1)[1]) and reader.count() == 3
    sinks.publish(spark.range(7), path)
    assert spark.read.parquet(sinks.published(spark, path)).count() == 7 and reader.count() == 3 and len(sinks.versions(spark, path)) == 2
    sinks.sweep(spark, path)
    assert len(sinks.versions(spark, path)) == 1 and spark.read.parquet(sinks.published(spark, path)).count() == 7
