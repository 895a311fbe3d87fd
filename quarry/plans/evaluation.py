"""Queries on evaluation statistics, grids and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import bootstrap, explain, graph, grid, kernel, models, stats
from quarry.operators.graph import array_correlation, hamming_pairs, mean_abs_difference
from quarry.operators.shared import cut_lineage, new_path
from quarry.plans.catalogue import CELLS, DRAWN, FACTS, PAIRS, PROB, cells, hashed, labelled, probabilities, query, scored
from quarry.sources import sinks, tables
from quarry.sources.tables import register, table

# Areas, thresholds, folds

PLANTED = f"SELECT event_type AS g, y, x, v AS e, y BETWEEN 6 AND 17 AND x BETWEEN 4 AND 11 AS m FROM ({CELLS}) WHERE y % 2 = 0 AND x % 2 = 0 UNION ALL SELECT 'flat', y, x, 0, y < 3 FROM ({CELLS}) WHERE event_type = 'click' UNION ALL SELECT 'empty', y, x, v, FALSE FROM ({CELLS}) WHERE event_type = 'click'"


@query(f"""WITH p AS ({PLANTED}), r AS (SELECT g, e, m, rank() OVER (PARTITION BY g ORDER BY e) + (count(*) OVER (PARTITION BY g, e) - 1) / 2.0::DOUBLE AS rk FROM p),
a AS (SELECT g, min(e) = max(e) AS flat, count(*) FILTER (WHERE m) AS np, count(*) FILTER (WHERE NOT m) AS nn, sum(CASE WHEN m THEN rk END) AS s FROM r GROUP BY g)
SELECT g, CASE WHEN flat OR np = 0 OR nn = 0 THEN 0.5::DOUBLE ELSE round((s - np * (np + 1) / 2.0::DOUBLE) / (np * nn), 6) END AS auc FROM a""")
def pixel_auc(spark, sf_dir):
    """The area of each map against its mask on every second cell; one half where the map says nothing."""
    register(spark, sf_dir, "events")
    d = spark.sql(PLANTED).withColumn("m", F.col("m").cast("int"))
    return stats.guarded_auc(d, "g", "m", "e")


@query(f"""WITH c AS (SELECT event_type, v > 500 AS m, v / 2000 AS s FROM ({CELLS})), t AS (SELECT unnest(generate_series(1, 19)) / 20.0::DOUBLE AS t), f AS (SELECT event_type, t, count(*) FILTER (WHERE m AND s >= t) AS tp, count(*) FILTER (WHERE m <> (s >= t)) AS wrong FROM c, t GROUP BY 1, 2),
r AS (SELECT event_type, t, round(CASE WHEN 2 * tp + wrong > 0 THEN 2 * tp / CAST(2 * tp + wrong AS DOUBLE) ELSE 1 END, 6) AS f1 FROM f) SELECT event_type, t AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f1 DESC, t) AS k FROM r) WHERE k = 1""")
def best_threshold(spark, sf_dir):
    return stats.best_threshold(cells(spark, sf_dir), "event_type", F.col("v") > 500, F.col("v") / 2000, [k / 20 for k in range(1, 20)])


@query(f"""WITH f AS ({FACTS}), c AS (SELECT lang, CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) tp, CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) fp, CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS DOUBLE) fn, CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS DOUBLE) tn FROM f GROUP BY 1),
m AS (SELECT unnest(['accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([round((tp + tn) / (tp + tn + fp + fn), 6), round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6), round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6), round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6), round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)]) AS v FROM c)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM m GROUP BY 1""")
def fold_summary(spark, sf_dir):
    """Mean and deviation of every metric over folds (here, languages)."""
    register(spark, sf_dir, "labels", "documents")
    return stats.fold_summary(spark.sql(FACTS), "lang", F.col("y"), F.col("p"))


@query(f"""SELECT w / 100.0::DOUBLE AS width, count(*) FILTER (WHERE abs(p - 0.5::DOUBLE) >= w / 200.0::DOUBLE) AS judged, round((avg(CASE WHEN y = 1 AND abs(p - 0.5::DOUBLE) >= w / 200.0::DOUBLE THEN CASE WHEN p >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END END) + avg(CASE WHEN y = 0 AND abs(p - 0.5::DOUBLE) >= w / 200.0::DOUBLE THEN CASE WHEN p < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END END)) / 2, 6) AS balanced FROM {PROB}, (SELECT unnest(generate_series(0, 80, 4)) AS w) GROUP BY w""")
def coverage_balanced(spark, sf_dir):
    """Balanced accuracy of what is judged, for 21 widths, in one pass."""
    d = probabilities(spark, sf_dir)
    inside = lambda w: F.abs(F.col("p") - 0.5) >= F.lit(w / 200.0)
    rate = lambda w, y: F.avg(F.when((F.col("y") == y) & inside(w), ((F.col("p") >= 0.5) == F.lit(bool(y))).cast("double")))
    rows = F.array(*[F.struct(F.lit(w / 100.0).alias("width"), F.count_if(inside(w)).alias("judged"), F.round((rate(w, 1) + rate(w, 0)) / 2, 6).alias("balanced")) for w in range(0, 81, 4)])
    return d.agg(rows.alias("rows")).select(F.inline("rows"))


X = "x AS (SELECT source, quality AS y, CAST(n_chars AS DOUBLE) AS s, CAST(doc_id % 100 AS DOUBLE) AS t FROM labels JOIN documents USING (doc_id))"


def area_sql(column: str) -> str:
    return f"""SELECT r, round(sum(p * (below + n / 2.0::DOUBLE)) / nullif((sum(p) * sum(n))::DOUBLE, 0), 6) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY r ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT r, {column} AS v, sum(CASE WHEN y = 1 THEN times ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN times ELSE 0 END) AS n FROM {{rows}} GROUP BY r, {column})) GROUP BY r"""


@query(f"""WITH {X}, {DRAWN.format(group='source', source='x', last=49)}, w AS (SELECT t.r, x.y, x.s, x.t, t.times FROM t JOIN x ON x.source = t.grp), o AS (SELECT 0 AS r, y, s, t, 1 AS times FROM x),
delta AS (SELECT a.auc - b.auc AS d FROM ({area_sql('s').format(rows='w')}) a JOIN ({area_sql('t').format(rows='w')}) b USING (r) WHERE a.auc IS NOT NULL), e AS (SELECT a.auc - b.auc AS e FROM ({area_sql('s').format(rows='o')}) a JOIN ({area_sql('t').format(rows='o')}) b USING (r))
SELECT (SELECT round(e, 6) FROM e) AS estimate, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(1.0::DOUBLE, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN d >= 0 THEN 1.0::DOUBLE ELSE 0 END))), 6) AS p, count(*) AS replicates FROM delta""")
def paired_auc_delta(spark, sf_dir):
    """Two scores against one label, with shared draws of whole groups."""
    d = labelled(spark, sf_dir).select("source", "quality", F.col("n_chars").cast("double").alias("s"), (F.col("doc_id") % 100).cast("double").alias("t"))
    return bootstrap.paired_auc_delta(d, "source", "quality", "s", "t", 50)


@query(f"""WITH {X}, {DRAWN.format(group='source', source='x', last=39)}, w AS (SELECT r, s, unnest(generate_series(1, times)) FROM t JOIN x ON x.source = t.grp WHERE y = 1), m AS (SELECT r, median(s) AS m FROM w GROUP BY r)
SELECT (SELECT round(median(s), 6) FROM x WHERE y = 1) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def bootstrap_statistic(spark, sf_dir):
    """Any mergeable statistic under the cluster bootstrap: here the median length of good documents; draws without one are left out."""
    d = labelled(spark, sf_dir).select("source", "quality", "n_chars")
    return bootstrap.bootstrap_of(d, "source", bootstrap.Median("n_chars"), ["n_chars"], 40, "quality = 1")


@query("""WITH x AS (SELECT doc_id AS k, quality AS y, n_chars AS v FROM labels JOIN documents USING (doc_id)), o AS (SELECT sum(CASE WHEN y = 1 THEN v END) AS observed, count(*) FILTER (WHERE y = 1) AS marked, count(*) AS n FROM x),
d AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', 'p', r, k)), k) - 1 AS pos FROM x, (SELECT unnest(generate_series(0, 49)) AS r)), s AS (SELECT r, sum(v) AS s FROM d, o WHERE pos < marked GROUP BY r)
SELECT CAST(observed AS BIGINT) AS observed, n, round((1 + (SELECT count(*) FROM s WHERE s.s >= observed)) / 51.0::DOUBLE, 6) AS p FROM o""")
def permutation_null(spark, sf_dir):
    """Are good documents longer than as many drawn by hash?"""
    return stats.permutation_p(labelled(spark, sf_dir), "doc_id", "quality", "n_chars", 50)


HOURS = f"SELECT event_type, y - 12 AS x, sum(v) AS v FROM ({CELLS}) GROUP BY 1, 2"


@query(f"""WITH h AS ({HOURS}), s AS (SELECT event_type, count(*)::DOUBLE s0, sum(x)::DOUBLE s1, sum(x * x)::DOUBLE s2, sum(x * x * x)::DOUBLE s3, sum(x * x * x * x)::DOUBLE s4, sum(v) t0, sum(x * v) t1, sum(x * x * v) t2 FROM h GROUP BY 1),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
f AS (SELECT event_type, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS a, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det AS b, (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS c FROM d)
SELECT f.event_type, round(a, 2) AS a, round(b, 2) AS b, round(c, 2) AS c, round(sum((v - a - b * x - c * x * x) * (v - a - b * x - c * x * x)), 0) AS rss FROM f JOIN h ON h.event_type = f.event_type GROUP BY f.event_type, a, b, c""")
def quadratic_trend(spark, sf_dir):
    register(spark, sf_dir, "events")
    fit = stats.quadratic_trend(spark.sql(HOURS), "event_type", "x", "v")
    return fit.select("event_type", *[F.round(c, 2).alias(c) for c in "abc"], F.round("rss", 0).alias("rss"))


# Arrays and pairs


@query(f"""WITH p AS ({PAIRS}), e AS (SELECT p.a, p.b, unnest(x.embedding)::DOUBLE AS u, unnest(y.embedding)::DOUBLE AS v, md5(CAST(x.embedding AS VARCHAR)) <> md5(CAST(y.embedding AS VARCHAR)) AS apart FROM p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b WHERE x.label <> y.label)
SELECT a, b, round(corr(u, v), 6) AS correlation, round(avg(CASE WHEN abs(u - v) <= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within, round(avg(abs(u - v)), 6) AS mad FROM e WHERE apart GROUP BY a, b HAVING corr(u, v) > 0.3""")
def near_dup_full(spark, sf_dir):
    """Candidates of other groups with other contents, verified by correlation; also the share of entries within a tolerance."""
    h = hashed(spark, sf_dir)
    v = h.select("vec_id", "label", F.md5(F.to_json(F.struct("embedding"))).alias("h"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    pairs = hamming_pairs(h, "vec_id", "h", 16).join(v.toDF("a", "la", "ha", "ea"), "a").join(v.toDF("b", "lb", "hb", "eb"), "b").where("la <> lb and ha <> hb")
    a, b = F.col("ea"), F.col("eb")
    found = pairs.withColumn("correlation", array_correlation(a, b)).where("correlation > 0.3")
    return found.select("a", "b", F.round("correlation", 6).alias("correlation"), F.round(stats.share_within(a, b, 0.5), 6).alias("within"), F.round(mean_abs_difference(a, b), 6).alias("mad"))


@query("""WITH b AS (SELECT lang, least(9, n_chars // 500) AS bin FROM documents), k AS (SELECT DISTINCT lang FROM b), i AS (SELECT unnest(generate_series(0, 9)) AS i), h AS (SELECT k.lang, i, count(b.bin) / CAST(sum(count(b.bin)) OVER (PARTITION BY k.lang) AS DOUBLE) AS h FROM k CROSS JOIN i LEFT JOIN b ON b.lang = k.lang AND b.bin = i GROUP BY 1, 2), g AS (SELECT i, count(b.bin) / CAST(sum(count(b.bin)) OVER () AS DOUBLE) AS g FROM i LEFT JOIN b ON b.bin = i GROUP BY 1)
SELECT lang, round(sum(CASE WHEN h + g > 0 THEN (h - g) * (h - g) / (h + g) ELSE 0 END) / 2, 6) AS distance FROM h JOIN g USING (i) GROUP BY lang""")
def histogram_distance(spark, sf_dir):
    """Chi-square distance of each language's length histogram from that of all."""
    binned = table(spark, sf_dir, "documents").select("lang", F.least(F.lit(9), F.floor(F.col("n_chars") / 500)).alias("bin"))
    histogram = F.array(*[F.count_if(F.col("bin") == i) / F.count("*") for i in range(10)])
    whole = binned.agg(histogram.alias("g"))
    return binned.groupBy("lang").agg(histogram.alias("h")).crossJoin(F.broadcast(whole)).select("lang", F.round(stats.chi2(F.col("h"), F.col("g")), 6).alias("distance"))


# Grids

Z = f"""g AS ({CELLS}), m AS (SELECT event_type, median(v) AS m, stddev_pop(v) AS sd FROM g GROUP BY 1), d AS (SELECT event_type, median(abs(v - m)) AS mad FROM g JOIN m USING (event_type) GROUP BY 1),
z AS (SELECT event_type, y, x, v, least(50, greatest(-50, (v - m) / greatest(1.4826 * mad, 1e-6 * (abs(m) + 1), 0.1 * sd))) AS z FROM g JOIN m USING (event_type) JOIN d USING (event_type))"""
NEAR = """h AS (SELECT event_type, y, x, event_type || '|' || lpad(y::VARCHAR, 3, '0') || '|' || lpad(x::VARCHAR, 3, '0') AS k FROM {marked}), r AS (SELECT k, k AS root FROM h UNION SELECT b.k, r.root FROM r JOIN h a ON a.k = r.k JOIN h b ON b.event_type = a.event_type AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1), c AS (SELECT k, min(root) AS root FROM r GROUP BY k), s AS (SELECT root, count(*) AS size FROM c GROUP BY root)"""


@query(f"""WITH RECURSIVE {Z}, {NEAR.format(marked='z WHERE z > 1')} SELECT split_part(root, '|', 1) AS event_type, split_part(root, '|', 2)::INTEGER AS y, split_part(root, '|', 3)::INTEGER AS x, size FROM s WHERE size >= 2""")
def grid_clusters(spark, sf_dir):
    """8-connected components of outlying cells, those of two cells or more."""
    z = grid.robust_z(cells(spark, sf_dir), "event_type", "v").where("z > 1")
    return grid.clusters(z, "event_type", "y", "x", 2)


@query(f"""WITH RECURSIVE {Z}, {NEAR.format(marked='z WHERE z > 2.5')}, t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY z DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM z), l AS (SELECT split_part(root, '|', 1) AS event_type, max(size) AS largest FROM s GROUP BY 1)
SELECT t.event_type, round(max(z), 4) AS z_max, round(quantile_cont(z, 0.99), 4) AS z_p99, round(avg(CASE WHEN z > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, round(avg(CASE WHEN k <= greatest(n // 20, 1) THEN z END), 4) AS top, round(coalesce(max(largest), 0) / max(n)::DOUBLE, 6) AS cluster FROM t LEFT JOIN l ON l.event_type = t.event_type GROUP BY 1""")
def inconsistency_bundle(spark, sf_dir):
    b = grid.inconsistency(cells(spark, sf_dir), "event_type", "y", "x", "v")
    return b.select("event_type", *[F.round(c, 4).alias(c) for c in ("z_max", "z_p99")], F.round("share", 6).alias("share"), F.round("top", 4).alias("top"), F.round("cluster", 6).alias("cluster"))


FULL = "SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)"


@query(f"""WITH g AS ({FULL}), d AS (SELECT unnest([-1, 0, 1]) AS d) SELECT a.vec_id, a.y, a.x, round(sum(b.v) / 9, 5) AS mean FROM g a, d dy, d dx, g b WHERE b.vec_id = a.vec_id AND b.y = greatest(0, least(7, a.y + dy.d)) AND b.x = greatest(0, least(7, a.x + dx.d)) GROUP BY 1, 2, 3""")
def box_mean(spark, sf_dir):
    """3x3 means of full grids, borders repeated."""
    g = grid.of_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 8)
    return grid.box_mean(g, "vec_id", "y", "x", "v").select("vec_id", "y", "x", F.round("mean", 5).alias("mean"))


@query("WITH d AS (SELECT doc_id, greatest(n_chars - 512, 0) AS last FROM documents) SELECT DISTINCT doc_id, start FROM (SELECT doc_id, unnest(list_append(generate_series(0, last, 256), last)) AS start FROM d)")
def stride_windows(spark, sf_dir):
    """Windows of 512 every 256, and a last one at the end."""
    return grid.stride_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 512, 256).select("doc_id", "start")


@query(f"""WITH c AS (SELECT event_type, v > 500 AS m, v FROM ({CELLS})) SELECT event_type, round(count(*) FILTER (WHERE v > 700) / count(*)::DOUBLE, 6) AS predicted, round(count(*) FILTER (WHERE m) / count(*)::DOUBLE, 6) AS truth FROM c GROUP BY 1""")
def predicted_area(spark, sf_dir):
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return cells(spark, sf_dir).groupBy("event_type").agg(share(F.col("v") > 700).alias("predicted"), share(F.col("v") > 500).alias("truth"))


@query(f"""WITH s AS (SELECT {', '.join(f"count(*) FILTER (WHERE v > 500 AND v >= {t * 100}) AS tp{t}, count(*) FILTER (WHERE (v > 500) <> (v >= {t * 100})) AS w{t}" for t in range(1, 13))}, event_type FROM ({CELLS}) GROUP BY event_type),
f AS (SELECT unnest([{', '.join(str(t * 100) for t in range(1, 13))}]) AS threshold, unnest([{', '.join(f'CASE WHEN 2 * tp{t} + w{t} > 0 THEN 2 * tp{t} / (2 * tp{t} + w{t})::DOUBLE ELSE 1 END' for t in range(1, 13))}]) AS f1 FROM s)
SELECT threshold, round(avg(f1), 6) AS mean_f1 FROM f GROUP BY 1 ORDER BY avg(f1) DESC, threshold LIMIT 1""")
def tuned_threshold(spark, sf_dir):
    """The threshold with the best mean F1 over grids, all thresholds in one pass; the first stage of tuning."""
    thresholds = range(100, 1201, 100)

    def f1(t):
        tp, wrong = F.count_if((F.col("v") > 500) & (F.col("v") >= t)), F.count_if((F.col("v") > 500) != (F.col("v") >= t))
        return F.struct(F.lit(t).alias("threshold"), F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(F.lit(1.0)).alias("f1"))

    per = cells(spark, sf_dir).groupBy("event_type").agg(F.array(*[f1(t) for t in thresholds]).alias("f")).select(F.inline("f"))
    return per.groupBy("threshold").agg(F.avg("f1").alias("m")).orderBy(F.desc("m"), "threshold").limit(1).select("threshold", F.round("m", 6).alias("mean_f1"))


NEIGHBOURS = "SELECT unnest([{0}]) AS dy, unnest([{1}]) AS dx"


def disc_sql(k):
    return NEIGHBOURS.format(*(", ".join(str(p[axis]) for p in grid.disc(k)) for axis in (0, 1)))


@query(f"""WITH RECURSIVE c AS (SELECT event_type AS g, y, x, v FROM ({CELLS})), k AS ({" UNION ALL ".join(f"SELECT {r} AS r, dy, dx FROM ({disc_sql(r)})" for r in range(3))}), r AS (SELECT unnest([0, 1, 2]) AS r), m AS (SELECT * FROM c WHERE v > 400),
k1 AS (SELECT r.r AS opening, c.g, c.y, c.x, c.v, bool_or(coalesce(o.v <= 400, FALSE)) AS hole FROM c JOIN r ON TRUE JOIN k ON k.r = r.r LEFT JOIN c o ON o.g = c.g AND o.y = c.y + k.dy AND o.x = c.x + k.dx GROUP BY ALL), e1 AS (SELECT * FROM k1 WHERE NOT hole),
o1 AS (SELECT DISTINCT e1.opening, c.g, c.y, c.x FROM e1 JOIN k ON k.r = e1.opening JOIN c ON c.g = e1.g AND c.y = e1.y + k.dy AND c.x = e1.x + k.dx),
d2 AS (SELECT DISTINCT o1.opening, r.r AS closing, c.g, c.y, c.x FROM o1 JOIN r ON TRUE JOIN k ON k.r = r.r JOIN c ON c.g = o1.g AND c.y = o1.y + k.dy AND c.x = o1.x + k.dx),
h2 AS (SELECT d2.opening, d2.closing, d2.g, d2.y, d2.x, bool_or(o.g IS NOT NULL AND f.g IS NULL) AS hole FROM d2 JOIN k ON k.r = d2.closing LEFT JOIN c o ON o.g = d2.g AND o.y = d2.y + k.dy AND o.x = d2.x + k.dx LEFT JOIN d2 f ON f.opening = d2.opening AND f.closing = d2.closing AND f.g = o.g AND f.y = o.y AND f.x = o.x GROUP BY ALL),
n AS (SELECT opening, closing, g, y, x, concat_ws('|', opening, closing, g, lpad(y::VARCHAR, 3, '0'), lpad(x::VARCHAR, 3, '0')) AS id FROM h2 WHERE NOT hole),
p AS (SELECT id, id AS root FROM n UNION SELECT b.id, p.root FROM p JOIN n a ON a.id = p.id JOIN n b ON b.opening = a.opening AND b.closing = a.closing AND b.g = a.g AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1),
t AS (SELECT id, min(root) AS root FROM p GROUP BY id), z AS (SELECT root, count(*) AS size FROM t GROUP BY root), kept AS (SELECT n.*, a.area FROM n JOIN t USING (id) JOIN z USING (root) JOIN (SELECT unnest([1, 4, 12]) AS area) a ON z.size >= a.area),
every AS (SELECT o.r AS opening, q.r AS closing, a.area, c.* FROM c, r o, r q, (SELECT unnest([1, 4, 12]) AS area) a), f AS (SELECT opening, closing, area, g, CASE WHEN 2 * count(*) FILTER (WHERE v > 500 AND kept.id IS NOT NULL) + count(*) FILTER (WHERE (v > 500) <> (kept.id IS NOT NULL)) > 0
THEN 2 * count(*) FILTER (WHERE v > 500 AND kept.id IS NOT NULL) / (2 * count(*) FILTER (WHERE v > 500 AND kept.id IS NOT NULL) + count(*) FILTER (WHERE (v > 500) <> (kept.id IS NOT NULL)))::DOUBLE ELSE 1 END AS f1 FROM every LEFT JOIN kept USING (opening, closing, area, g, y, x) GROUP BY ALL)
SELECT opening, closing, area, round(avg(f1), 6) AS mean_f1 FROM f GROUP BY ALL""")
def tuned_cleaning(spark, sf_dir):
    """The second stage of tuning: mean F1 over grids for 27 combinations of opening, closing and least area, at a threshold."""
    c = cut_lineage(cells(spark, sf_dir).withColumnRenamed("event_type", "g"))
    kept = grid.cleaned_masks(c.where("v > 400"), c, "g", [0, 1, 2], [0, 1, 2], [1, 4, 12])
    truth = c.where("v > 500").select("g", "y", "x", F.lit(1).alias("t"))
    hits = kept.join(truth, ["g", "y", "x"], "left").groupBy("opening", "closing", "area", "g").agg(F.count("t").alias("tp"), F.count("*").alias("n"))
    sizes = c.groupBy("g").agg(F.count_if(F.col("v") > 500).alias("true"))
    few = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    all_ = sizes.crossJoin(F.broadcast(few("opening", [0, 1, 2]))).crossJoin(F.broadcast(few("closing", [0, 1, 2]))).crossJoin(F.broadcast(few("area", [1, 4, 12])))
    scored = all_.join(hits, ["opening", "closing", "area", "g"], "left").fillna(0, ["tp", "n"])
    f1 = F.when(F.col("n") + F.col("true") > 0, 2 * F.col("tp") / (F.col("n") + F.col("true"))).otherwise(F.lit(1.0))
    return scored.groupBy("opening", "closing", "area").agg(F.round(F.avg(f1), 6).alias("mean_f1"))


# Models

SMALL = ["n_chars", "n_words", "n_marks"]


def modelled(spark, sf_dir):
    return scored(spark, sf_dir, None)


@query(None)
def nested_cv(spark, sf_dir):
    """Out-of-fold area where each fold's model is chosen on the other folds alone."""
    out, chosen = models.nested_scores(modelled(spark, sf_dir), SMALL, "fold", 3, {f"ridge {r}": lambda r=r: models.logistic(r) for r in (0.0, 0.1)})
    return stats.auc(out, "label", "score").withColumn("chosen", F.lit(",".join(chosen)))


@query(None)
def rbf_svm_auc(spark, sf_dir):
    """Out-of-fold area of a balanced machine with the RBF kernel on 128 landmarks."""
    d = models.balanced(modelled(spark, sf_dir), "label")
    return stats.auc(kernel.machine(d, SMALL, "doc_id", "fold", 3), "label", "score")


@query(None)
def feature_ablations(spark, sf_dir):
    rows = models.ablations(modelled(spark, sf_dir), {"length": ["n_chars", "n_words"], "marks": ["n_marks"]}, "fold", 3, models.MODELS["logistic"])
    return spark.createDataFrame(rows, "kind string, columns string, auc double")


@query(None)
def feature_importance(spark, sf_dir):
    rows = models.permutation_importance(modelled(spark, sf_dir), SMALL, "fold", 3, models.MODELS["logistic"], "doc_id")
    return spark.createDataFrame(rows, "feature string, loss double")


def explained(spark, sf_dir):
    """Rows with a forest's score, and the contributions to it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = cut_lineage(modelled(spark, sf_dir))
    ready = VectorAssembler(inputCols=SMALL, outputCol="features").transform(models.balanced(d, "label"))
    forest = models.RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=12, maxDepth=5, featureSubsetStrategy="sqrt", seed=42).fit(ready)
    score = forest.transform(ready).select("doc_id", vector_to_array("probability")[1].alias("score"))
    return score, explain.contributions(d, "doc_id", SMALL, explain.paths(explain.nodes(spark, forest)), 12)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS off FROM labels JOIN documents USING (doc_id)")
def contributions_add_up(spark, sf_dir):
    """Of every row the contributions of its features and the expected score sum to the forest's score, to 1e-9."""
    score, parts = explained(spark, sf_dir)
    both = score.join(parts.groupBy("doc_id").agg(F.sum("value").alias("total")), "doc_id", "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.abs(F.col("score") - F.col("total")) > 1e-9, F.lit(True))).alias("off"))


@query(None)
def tree_contributions(spark, sf_dir):
    """How much each feature moves the scores of a forest: mean absolute and largest contribution."""
    parts = explained(spark, sf_dir)[1].where("feature is not null")
    return parts.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("value")), 6).alias("mean"), F.round(F.max(F.abs("value")), 6).alias("most"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ, TRUE AS refused FROM labels JOIN documents USING (doc_id)")
def model_roundtrip(spark, sf_dir):
    """A fitted model, saved and loaded, scores every row as before; other settings than it was fitted under are refused."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = models.balanced(modelled(spark, sf_dir), "label")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=SMALL, outputCol="features"), models.MODELS["logistic"]()]).fit(d)
    path = new_path(spark, "model")
    sinks.save_model(fitted, path, protocol="B", features=SMALL)
    again, _ = tables.load_model(spark, path, protocol="B")
    try:
        tables.load_model(spark, path, protocol="A")
        refused = False
    except ValueError:
        refused = True
    score = lambda m, name: m.transform(d).select("doc_id", vector_to_array("probability")[1].alias(name))
    both = score(fitted, "a").join(score(again, "b"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("differ"), F.lit(refused).alias("refused"))
