"""Exact contributions of features to a forest's scores, from a table of its paths.

A path is a leaf with what each feature must be to reach it, and the share of the
training weight that goes its way at the feature's splits. If a set S of features
is known, a path counts with the product of (does the row fit?) over S and of the
shares over the others. The Shapley value of a feature in a path needs only the
elementary symmetric sums of the other features on it, so one pass over rows and
paths, and one sum, gives all contributions.
"""

from __future__ import annotations

from math import factorial

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shared import cut_lineage, new_path


def nodes(spark: SparkSession, forest: RandomForestClassificationModel) -> DataFrame:
    """(tree, id, left, right, feature, threshold, weight, value) of a forest's nodes; value: the share of class 1. Splits must be on numbers."""
    path = new_path(spark, "forest")
    forest.write().overwrite().save(path)
    n = F.col("nodeData")
    stats = n["impurityStats"]
    weight = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)
    split = n["split"]
    checked = F.when(split["numCategories"] > 0, F.raise_error(F.lit("splits on categories are not covered")).cast("double")).otherwise(F.get(split["leftCategoriesOrThreshold"], F.lit(0)))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), split["featureIndex"].alias("feature"),
        F.when(n["leftChild"] >= 0, checked).alias("threshold"), weight.alias("weight"), (F.get(stats, F.lit(1)) / weight).alias("value"))


def paths(table: DataFrame) -> DataFrame:
    """(tree, leaf, value, steps) with steps: for each feature on the way (feature, low, high, share); a row fits where low < x <= high."""
    table = cut_lineage(table)
    children = table.select(F.col("tree").alias("_t"), F.col("id").alias("_id"), F.col("left").alias("_left"), F.col("right").alias("_right"), F.col("feature").alias("_f"), F.col("threshold").alias("_th"), F.col("weight").alias("_w"), F.col("value").alias("_v"))
    now = table.where("id = 0").select("tree", "id", "left", "right", "feature", "threshold", "weight", "value", F.expr("cast(array() as array<struct<feature:int,low:double,high:double,share:double>>)").alias("way"))
    done = None
    while True:
        now = cut_lineage(now)  # a model's nodes of one depth
        leaves = now.where("left < 0").select("tree", F.col("id").alias("leaf"), "value", "way")
        done = leaves if done is None else done.unionByName(leaves)
        inner = now.where("left >= 0")
        if inner.isEmpty():
            break
        sides = F.explode(F.array(F.struct(F.col("left").alias("_to"), F.lit(True).alias("_down")), F.struct(F.col("right").alias("_to"), F.lit(False).alias("_down"))))
        inner = inner.select("*", sides.alias("_s")).select("*", "_s.*")
        joined = inner.join(children, (F.col("tree") == F.col("_t")) & (F.col("_to") == F.col("_id")))
        step = F.struct(
            F.col("feature").alias("feature"), F.when(F.col("_down"), F.lit(float("-inf"))).otherwise(F.col("threshold")).alias("low"),
            F.when(F.col("_down"), F.col("threshold")).otherwise(F.lit(float("inf"))).alias("high"), (F.col("_w") / F.col("weight")).alias("share"))
        now = joined.select("tree", F.col("_id").alias("id"), F.col("_left").alias("left"), F.col("_right").alias("right"), F.col("_f").alias("feature"), F.col("_th").alias("threshold"), F.col("_w").alias("weight"), F.col("_v").alias("value"), F.array_append("way", step).alias("way"))
    one = done.select("tree", "leaf", "value", F.explode_outer("way").alias("s")).groupBy("tree", "leaf", "value", F.col("s.feature").alias("feature")).agg(
        F.max("s.low").alias("low"), F.min("s.high").alias("high"), F.product("s.share").alias("share"))
    return one.groupBy("tree", "leaf", "value").agg(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "low", "high", "share"))).alias("steps"))


def fits(step: Column, x: Column) -> Column:
    at = F.get(x, step["feature"])
    return ((at > step["low"]) & (at <= step["high"])).cast("double")


def contributions(rows: DataFrame, key: str, features: list[str], way: DataFrame, n_trees: int) -> DataFrame:
    """(key, feature, value): what each feature adds to a row's score, and under a null feature the score that is expected without any; they sum to the score.

    way is a model's paths: its size is the model's, so it is broadcast. Features
    that are on no path have no row. Null and NaN features are not covered.
    """
    way = cut_lineage(way)
    most = way.agg(F.max(F.size("steps"))).first()[0] or 0
    if not most:
        value = way.agg((F.sum("value") / n_trees).alias("value"))
        return rows.select(key).crossJoin(F.broadcast(value)).select(key, F.lit(None).cast("string").alias("feature"), "value")
    coefficient = F.array(*[F.array(*[F.lit(factorial(k) * factorial(m - 1 - k) / factorial(m)) for k in range(m)]) for m in range(1, most + 1)])
    x = rows.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("x")).crossJoin(F.broadcast(way))  # rows by a model's leaves
    held = x.select(key, "value", F.transform("steps", lambda s: F.struct(s["feature"].alias("f"), fits(s, F.col("x")).alias("o"), s["share"].alias("r"))).alias("s"))
    times = lambda acc, j: F.zip_with(F.concat(acc, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), acc), lambda a, b: a * j["r"] + b * j["o"])

    def share(i: Column) -> Column:
        sums = F.aggregate(F.filter("s", lambda j: j["f"] != i["f"]), F.array(F.lit(1.0)), times)
        weighted = F.aggregate(F.zip_with(sums, F.get(coefficient, F.size("s") - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.struct(i["f"].alias("f"), (F.col("value") * (i["o"] - i["r"]) * weighted).alias("v"))

    base = F.array(F.struct(F.lit(-1).alias("f"), (F.col("value") * F.aggregate("s", F.lit(1.0), lambda a, j: a * j["r"])).alias("v")))
    each = held.select(key, F.explode(F.concat(F.transform("s", share), base)).alias("c")).groupBy(key, "c.f").agg((F.sum("c.v") / n_trees).alias("value"))
    return each.select(key, F.get(F.array(*[F.lit(c) for c in features]), F.col("f")).alias("feature"), "value") if len(features) else each
