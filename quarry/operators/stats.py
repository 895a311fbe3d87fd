"""Rank statistics, confusion metrics, calibration and tests, as compositions of built-in functions."""

from __future__ import annotations

from math import comb, exp, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import with_running
from quarry.operators.selection import cutoffs
from quarry.operators.shared import cut_lineage


def auc(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties at half, per group; NULL where one class is missing."""
    w = F.col(weight) if weight else F.lit(1)
    by_score = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("_neg"))
    ran = with_running(by_score, ["_s"], {"_below": "_neg"}, by)
    pos, neg = F.sum("_pos"), F.sum("_neg")
    area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))) / F.nullif(pos * neg, F.lit(0)).cast("double")
    return ran.groupBy(*by).agg(pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"), F.round(area, 6).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point for each distinct score: share of negatives and positives at or above it."""
    by_score = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"))
    ran = with_running(by_score, ["threshold"], {"pb": "p", "nb": "n"})
    total = by_score.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return ran.crossJoin(F.broadcast(total)).select("threshold", F.round((F.col("tn") - F.col("nb")) / F.col("tn"), 6).alias("fpr"), F.round((F.col("tp") - F.col("pb")) / F.col("tp"), 6).alias("tpr"))


def midranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the mid-rank (from 1) of a column."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = with_running(counts.withColumn("_v", F.col("_v").cast("double")), ["_v"], {"_below": "_n"}).select("_v", (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, F.col(column).cast("double") == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = midranked(midranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return both.agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def confusion(label: Column, predicted: Column) -> list[Column]:
    """Accuracy, balanced accuracy, precision (0 when undefined), recall and F1."""
    tp, fp = F.count_if((label == 1) & (predicted == 1)), F.count_if((label == 0) & (predicted == 1))
    fn, tn = F.count_if((label == 1) & (predicted == 0)), F.count_if((label == 0) & (predicted == 0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [F.round(c, 6).alias(n) for n, c in {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / F.lit(2.0),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}.items()]


#: Bin edges as binary floating point gives them (fixed values): 3 * 0.1 is above 0.3.
EDGES = [i * 0.1 for i in range(1, 10)]


def reliability(df: DataFrame, p: str, y: str) -> DataFrame:
    """Ten bins of a probability: count, mean probability, observed rate."""
    which = F.aggregate(F.array(*[F.lit(e) for e in EDGES]), F.lit(0), lambda n, e: n + (F.col(p) >= e).cast("int"))
    return df.groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact two-sided p from discordant counts."""
    n, k = only_a + only_b, min(only_a, only_b)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n < 1000 else min(1.0, 2 * sum(exp(log_choose(n, i) - n * 0.6931471805599453) for i in range(k + 1)))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Exact two-sided p of a 2x2 table: all tables that are no more likely."""
    row, column, n = a + b, a + c, a + b + c + d
    logs = {k: log_choose(row, k) + log_choose(n - row, column - k) - log_choose(n, column) for k in range(max(0, column - (n - row)), min(row, column) + 1)}
    return min(1.0, sum(exp(v) for v in logs.values() if v <= logs[a] + 1e-7))


def holm(df: DataFrame, p: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Holm's step-down adjustment of a small family of p-values."""
    w = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = df.withColumn("_adj", (m - F.row_number().over(w) + 1) * F.col(p))
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("_adj").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_adj")


def chi2(a: Column, b: Column) -> Column:
    """Chi-square distance of two histograms."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v) / F.lit(2.0)


def mask_scores(a: Column, b: Column) -> list[Column]:
    """IoU, F1 and Matthews correlation of two masks (both empty: 1; no denominator: 0)."""
    tp, fp, fn = F.count_if(a & b), F.count_if(~a & b), F.count_if(a & ~b)
    tn = F.count_if(~a & ~b)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    empty = (tp + fp + fn) == 0
    return [
        F.round(F.when(empty, F.lit(1.0)).otherwise(tp / F.greatest(tp + fp + fn, F.lit(1))), 6).alias("iou"),
        F.round(F.when(empty, F.lit(1.0)).otherwise(2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))), 6).alias("f1"),
        F.round(F.when(root > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / root).otherwise(F.lit(0.0)), 6).alias("mcc"),
    ]


def guarded_auc(df: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """(by, auc) with one half where a group has one class only or a constant score: such a map says nothing."""
    flat = df.groupBy(by).agg((F.max(score) == F.min(score)).alias("_flat"))
    areas = auc(df, label, score, by=(by,)).select(F.col(by).alias("_by"), "auc")
    return flat.join(areas, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, F.when(F.col("_flat") | F.col("auc").isNull(), F.lit(0.5)).otherwise(F.col("auc")).alias("auc"))


def best_threshold(df: DataFrame, by: str, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """(by, threshold, f1): the threshold with the best F1 in each group, the lowest of ties; all in one pass of conditional sums."""
    rows = []
    for t in thresholds:
        hit = score >= F.lit(t)
        tp, wrong = F.count_if(truth & hit), F.count_if(truth != hit)
        f1 = F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(F.lit(1.0))
        rows.append(F.struct(F.round(f1, 6).alias("f1"), F.lit(-t).alias("less")))
    best = df.groupBy(by).agg(F.array_max(F.array(*rows)).alias("best"))
    return best.select(by, (-F.col("best.less")).alias("threshold"), "best.f1")


def fold_summary(df: DataFrame, fold: str, label: Column, predicted: Column) -> DataFrame:
    """(metric, mean, sd) over folds of the metrics of confusion()."""
    per = df.groupBy(fold).agg(*confusion(label, predicted))
    long = per.unpivot([fold], [c for c in per.columns if c != fold], "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def permutation_p(df: DataFrame, key: str, label: str, value: str, permutations: int = 100, seed: str = "p") -> DataFrame:
    """Sum of value over the marked rows, and the share of hashed permutations of the marks in which it is as large.

    A permutation marks as many rows, those of the smallest hashes of (seed,
    number, key): rows are counted and summed by the hash's prefix where they are,
    and only those of one prefix in each permutation are moved and ordered.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(label).alias("_y"), F.col(value).alias("_v")).where("_y is not null and _v is not null")
    seen = cut_lineage(rows.agg(F.sum(F.when(F.col("_y") == 1, F.col("_v"))).alias("observed"), F.count_if(F.col("_y") == 1).alias("marked"), F.count("*").alias("n")))
    marked = seen.first()["marked"]
    copies = rows.select("_key", "_v", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("r")).withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "r", "_key")))
    null = cutoffs(copies, ["r"], [marked], {"s": "_v"}).crossJoin(F.broadcast(seen)).agg(F.count_if(F.col("s") >= F.col("observed")).alias("reached"))
    return seen.crossJoin(null).select("observed", "n", F.round((F.col("reached") + 1) / F.lit(permutations + 1.0), 6).alias("p"))


def quadratic_trend(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, a, b, c, rss): the least-squares fit y = a + b x + c x * x of each group, from power sums alone."""
    power = {k: F.sum(F.pow(F.col(x).cast("double"), F.lit(k))) for k in range(5)}
    moment = {k: F.sum(F.pow(F.col(x).cast("double"), F.lit(k)) * F.col(y)) for k in range(3)}
    sums = df.groupBy(by).agg(*[c.alias(f"s{k}") for k, c in power.items()], *[c.alias(f"t{k}") for k, c in moment.items()], F.sum(F.col(y) * F.col(y).cast("double")).alias("yy"))
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    rows = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    swapped = lambda k: [[F.col(f"t{i}") if j == k else rows[i][j] for j in range(3)] for i in range(3)]
    base = F.nullif(det(rows), F.lit(0.0))
    fit = sums.select(by, "yy", "t0", "t1", "t2", *[(det(swapped(k)) / base).alias(n) for k, n in enumerate("abc")])
    return fit.select(by, "a", "b", "c", (F.col("yy") - F.col("a") * F.col("t0") - F.col("b") * F.col("t1") - F.col("c") * F.col("t2")).alias("rss"))


def share_within(a: Column, b: Column, tolerance: float) -> Column:
    """The share of places at which two arrays differ by at most `tolerance`; NULL for arrays of different lengths."""
    near = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), F.lit(0), lambda n, hit: n + hit.cast("int"))
    return F.when(F.size(a) == F.size(b), near / F.size(a))
