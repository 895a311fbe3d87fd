"""Queries on grids of cells: sizes, kernels, frequencies, grey levels, and on pairs of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import pixels
from quarry.operators import grid, nearest, order, selection
from quarry.plans.catalogue import query, sql
from quarry.plans.evaluation import FULL
from quarry.sources.tables import table


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def grids(spark, sf_dir):
    """Each vector as an 8 x 8 grid, a row a cell."""
    return grid.of_vectors(vectors(spark, sf_dir), "vec_id", "embedding", 8)


def weighted(cells, weight, digits=4):
    """(vec_id, value): the sum of a grid's cells with weights."""
    return cells.groupBy("vec_id").agg(F.round(F.sum(F.col("v") * weight), digits).alias("value"))


@query(f"WITH g AS ({FULL}) SELECT vec_id, round(sum(v * (y // 2 * 4 + x // 2 + 1)) / 4, 4) AS value FROM g GROUP BY 1")
def resize_area(spark, sf_dir):
    """8x8 to 4x4 by area, read off with the weights 1 to 16."""
    return weighted(grid.resized(grids(spark, sf_dir), "vec_id", (8, 8), (4, 4), "area"), F.col("y") * 4 + F.col("x") + 1)


@query(f"WITH g AS ({FULL}) SELECT vec_id, round(sum(v * (y // 2 * 4 + x // 2 + 1)), 4) AS value FROM g WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY 1")
def resize_nearest(spark, sf_dir):
    return weighted(grid.resized(grids(spark, sf_dir), "vec_id", (8, 8), (4, 4), "nearest"), F.col("y") * 4 + F.col("x") + 1)


@query(f"WITH g AS ({FULL}), s AS (SELECT unnest(generate_series(0, 15)) AS k), w AS (SELECT k, greatest(0, least(7, (k + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) AS at FROM s) SELECT vec_id, round(sum(v * greatest(0, 1 - abs(a.at - y)) * greatest(0, 1 - abs(b.at - x)) * (a.k + 2 * b.k + 1)), 3) AS value FROM g, w a, w b WHERE abs(a.at - y) < 1 AND abs(b.at - x) < 1 GROUP BY 1")
def upsample_bilinear(spark, sf_dir):
    """8x8 to 16x16, cell centres, edges repeated."""
    return weighted(grid.resized(grids(spark, sf_dir), "vec_id", (8, 8), (16, 16), "linear"), F.col("y") + 2 * F.col("x") + 1, 3)


@query(f"""WITH g AS ({FULL}), n AS (SELECT a.vec_id, a.y, a.x, sum(CASE WHEN b.y = a.y AND b.x = a.x THEN -4 * b.v ELSE b.v * (CASE WHEN (a.y IN (0, 7) AND b.x = a.x) THEN 2 ELSE 1 END) * (CASE WHEN (a.x IN (0, 7) AND b.y = a.y) THEN 2 ELSE 1 END) END) AS l FROM g a JOIN g b ON b.vec_id = a.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)
SELECT vec_id, round(sum(abs(l)), 4) AS value FROM n GROUP BY 1""")
def laplace_filter(spark, sf_dir):
    """A 3x3 kernel with mirrored borders."""
    edges = grid.convolved(grids(spark, sf_dir), "vec_id", {(0, 0): -4, (-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1})
    return edges.groupBy("vec_id").agg(F.round(F.sum(F.abs("v")), 4).alias("value"))


@query("""WITH p AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)), k AS (SELECT unnest([1, 2, 5]) AS k), f AS (SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) AS m FROM p, k GROUP BY 1, 2), z AS (SELECT vec_id, abs(sum(v)) AS m FROM p GROUP BY 1)
SELECT vec_id, round(sum(f.m / (z.m + 1e-9) * (z.m + 1e-9)), 3) AS value FROM f JOIN z USING (vec_id) GROUP BY 1""")
def fourier_magnitude(spark, sf_dir):
    """Magnitudes of three frequencies."""
    e = vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return grid.magnitudes(e, "vec_id", "i", "v", 64, [1, 2, 5]).groupBy("vec_id").agg(F.round(F.sum("magnitude"), 3).alias("value"))


LEVELS = "SELECT vec_id, i, CAST(least(255, greatest(0, floor(CAST(embedding[i + 1] AS DOUBLE) * 60 + 128))) AS INTEGER) AS g FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)"


def levels(spark, sf_dir):
    """(vec_id, g): grey levels of all entries."""
    x = F.col("x").cast("double")
    return vectors(spark, sf_dir).select("vec_id", F.explode("embedding").alias("x")).select("vec_id", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x * 60 + 128))).cast("int").alias("g"))


@query(f"""WITH g AS ({LEVELS}), c AS (SELECT vec_id, g, count(*) OVER (PARTITION BY vec_id ORDER BY g) AS up FROM g), f AS (SELECT vec_id, min(up) AS first FROM c GROUP BY 1)
SELECT vec_id, CAST(sum(CASE WHEN first = 64 THEN g ELSE round_even((up - first) / (64 - first)::DOUBLE * 255, 0) END) AS BIGINT) AS value FROM c JOIN f USING (vec_id) GROUP BY 1""")
def histogram_equalised(spark, sf_dir):
    """Grey levels spread by their cumulative shares."""
    return grid.equalised(levels(spark, sf_dir), "vec_id", "g").groupBy("vec_id").agg(F.sum(F.col("n") * F.col("spread")).alias("value"))


@query(f"""WITH g AS ({LEVELS}), t AS (SELECT vec_id, greatest(quantile_cont(g, 0.9), 1e-3) AS top FROM g GROUP BY 1) SELECT vec_id, CAST(sum(floor(least(255, greatest(0, g / top * 255)))) AS BIGINT) AS value FROM g JOIN t USING (vec_id) GROUP BY 1""")
def contrast_stretched(spark, sf_dir):
    """Values up to their 90th percentile brought to 0 to 255."""
    g = levels(spark, sf_dir)
    top = selection.quantiles(g, ["vec_id"], {"top": ("g", 0.9)})
    wide = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("g") / F.greatest(F.col("top"), F.lit(1e-3)) * 255)))
    return g.join(top, "vec_id").groupBy("vec_id").agg(F.sum(wide).alias("value"))


@query(f"""WITH g AS ({FULL}), o AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY y + x, CASE WHEN (y + x) % 2 = 1 THEN y ELSE x END) AS k FROM g) SELECT vec_id, round(sum(v * k), 4) AS value FROM o GROUP BY 1""")
def zigzag_order(spark, sf_dir):
    """Entries in zig-zag order, weighted by their place."""
    places = spark.createDataFrame([(y, x, k) for k, (y, x) in enumerate(grid.zigzag(8), 1)], "y int, x int, k int")
    return weighted(grids(spark, sf_dir).join(F.broadcast(places), ["y", "x"]), F.col("k"))


@query(f"""WITH g AS ({FULL}) SELECT vec_id, y // 4 AS "by", x // 4 AS bx, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd FROM g GROUP BY 1, 2, 3""")
def block_mean_std(spark, sf_dir):
    e = vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "v"))
    y, x = F.floor(F.col("i") / 8), F.col("i") % 8
    return e.groupBy("vec_id", F.floor(y / 4).cast("int").alias("by"), F.floor(x / 4).cast("int").alias("bx")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"), F.round(F.stddev_pop(F.col("v").cast("double")), 5).alias("sd"))


sql(
    "array_operations",
    "SELECT vec_id, CAST(array_position(embedding, array_min(embedding)) - 1 AS INTEGER) AS argmin, round(aggregate(slice(reverse(array_sort(transform(embedding, x -> CAST(x AS DOUBLE)))), 1, 6), 0D, (a, b) -> a + b) / 6, 5) AS top, round(aggregate(zip_with(reverse(embedding), concat(array(CAST(0 AS FLOAT)), slice(embedding, 1, 63)), (a, b) -> CAST(a AS DOUBLE) * b), 0D, (a, b) -> a + b), 4) AS flipped FROM embeddings",
    "SELECT vec_id, CAST(list_position(embedding, list_min(embedding)) - 1 AS INTEGER) AS argmin, round(list_sum(list_sort(list_transform(embedding, lambda x: x::DOUBLE), 'DESC')[1:6]) / 6, 5) AS top, round(list_sum(list_transform(list_zip(list_reverse(embedding), list_concat([0::FLOAT], embedding[1:63])), lambda z: z[1]::DOUBLE * z[2])), 4) AS flipped FROM embeddings",
)


@query("SELECT label, count(*)::INTEGER AS n, count(*) FILTER (WHERE vec_id % 3 <> 0)::INTEGER AS inliers FROM embeddings GROUP BY 1")
def affine_consensus(spark, sf_dir):
    """Two pairs in three are moved alike, the others anywhere: the largest affine agreement finds the first."""
    i = F.col("vec_id")
    ax, ay = (i * 7919 % 1009).cast("double"), (i * 104729 % 997).cast("double")
    moved = i % 3 != 0
    far = F.conv(F.substring(F.md5(i.cast("string")), 1, 6), 16, 10).cast("double")
    pairs = vectors(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select(
        "label", ax.alias("ax"), ay.alias("ay"), F.when(moved, ax * 0.9 + ay * 0.1 + 300).otherwise(5000 + far).alias("bx"), F.when(moved, ay * 1.1 - 40).otherwise(9000 - far).alias("by_"))
    return pixels.consensus_by(pairs, ["label"])


NEAREST = """e AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings), d AS (SELECT a.vec_id AS a, b.vec_id AS b, array_distance(a.v, b.v) AS d FROM e a JOIN e b ON b.vec_id <> a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d), n AS (SELECT * FROM r WHERE k <= 10)"""


@query(f"WITH {NEAREST} SELECT a, b, CAST(k AS INTEGER) AS rank, round(d, 6) AS distance FROM n")
def nearest_ten(spark, sf_dir):
    """The ten nearest others of every vector, whatever its label."""
    return nearest.k_nearest(vectors(spark, sf_dir), "vec_id", "embedding", 10).select("a", "b", "rank", F.round("distance", 6).alias("distance"))


@query(f"""WITH {NEAREST}, m AS (SELECT *, lead(d) OVER (PARTITION BY a ORDER BY k) AS next FROM n), s AS (SELECT *, min(CASE WHEN next IS NULL OR d >= 0.97::DOUBLE * next THEN k END) OVER (PARTITION BY a) AS stop FROM m)
SELECT a, b FROM s WHERE k < stop""")
def nearest_chains(spark, sf_dir):
    """Of each vector's ten nearest others, those before the first that isn't clearly nearer than the next."""
    return nearest.chains(nearest.k_nearest(vectors(spark, sf_dir), "vec_id", "embedding", 10), 0.97)


@query(f"""WITH g AS ({LEVELS}), c AS (SELECT vec_id, g, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT vec_id, g, n, sum(n) OVER (PARTITION BY vec_id ORDER BY g) AS up FROM c) SELECT vec_id, min(g) FILTER (WHERE up >= 32) AS middle FROM t GROUP BY 1""")
def grey_medians(spark, sf_dir):
    """The lower median grey level of each image, from counts and their running sums."""
    ran = order.with_running(levels(spark, sf_dir).groupBy("vec_id", "g").agg(F.count("*").alias("n")), ["g"], {"before": "n"}, ("vec_id",))
    return ran.where("before + n >= 32").groupBy("vec_id").agg(F.min("g").alias("middle"))
