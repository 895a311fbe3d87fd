"""Cross-validated models, calibration and the verdict rule, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import numbered
from quarry.operators.shared import cut_lineage
from quarry.operators.stats import auc


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with `weight`: rows of each class weigh the same in total."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = df.agg(F.count("*").alias("_all"))
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(n)).withColumn("weight", F.col("_all") / (2 * F.col("_n"))).drop("_n", "_all")


def logistic(ridge: float = 0.0) -> Estimator:
    return LogisticRegression(labelCol="label", weightCol="weight", standardization=True, regParam=ridge)


MODELS: dict[str, Callable[[], Estimator]] = {
    "forest": lambda: RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=100, maxDepth=8, featureSubsetStrategy="sqrt", seed=42),
    "logistic": logistic,
    "boosted": lambda: GBTClassifier(labelCol="label", weightCol="weight", maxIter=10, seed=42),
}


def out_of_fold(df: DataFrame, features: list[str], fold: str, k: int, make: Callable[[], Estimator], which: list[int] | None = None) -> DataFrame:
    """df with `score`: each fold (or each of `which`) is scored by a model fitted on the others."""
    out = None
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(cut_lineage(balanced(df, "label")))
    for f in range(k) if which is None else which:
        model = Pipeline(stages=[make()]).fit(ready.where(F.col(fold) != f))
        scored = model.transform(ready.where(F.col(fold) == f)).select(*df.columns, F.round(vector_to_array("probability")[1], 6).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def calibrated(scored: DataFrame, fold: str, k: int) -> DataFrame:
    """scored with `calibrated`: isotonic regression of label on score, fitted on the other folds."""
    out = None
    for f in range(k):
        model = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(scored.where(F.col(fold) != f).select("score", F.col("label").cast("double").alias("label")))
        part = model.transform(scored.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def verdict(p: Column, band: float) -> Column:
    """Inclusive on both sides of a band around one half."""
    return F.when(p >= 0.5 + band / 2, "tampered").when(p <= 0.5 - band / 2, "authentic").otherwise("inconclusive")


def area(df: DataFrame) -> float:
    return auc(df, "label", "score").first()["auc"] or 0.0


def nested_scores(df: DataFrame, features: list[str], fold: str, k: int, grid: dict[str, Callable[[], Estimator]]) -> tuple[DataFrame, list[str]]:
    """Out-of-fold scores where each outer fold's model is chosen by the area on the other folds' own folds; and the choices, by outer fold."""
    out, chosen = None, []
    for f in range(k):
        inner = df.where(F.col(fold) != f)
        folds = [i for i in range(k) if i != f]
        best = max(grid, key=lambda name: (area(out_of_fold(inner, features, fold, k, grid[name], folds)), -list(grid).index(name)))
        chosen.append(best)
        part = out_of_fold(df, features, fold, k, grid[best], [f])
        out = part if out is None else out.unionByName(part)
    return out, chosen


def ablations(df: DataFrame, groups: dict[str, list[str]], fold: str, k: int, make: Callable[[], Estimator]) -> list[tuple[str, str, float]]:
    """(kind, group, area) with each group of columns alone, and with all but it; ("all", "", area) first."""
    every = [c for cs in groups.values() for c in cs]
    out = [("all", "", area(out_of_fold(df, every, fold, k, make)))]
    for name, columns in groups.items():
        out.append(("alone", name, area(out_of_fold(df, columns, fold, k, make))))
        if rest := [c for c in every if c not in columns]:
            out.append(("without", name, area(out_of_fold(df, rest, fold, k, make))))
    return out


def permutation_importance(df: DataFrame, features: list[str], fold: str, k: int, make: Callable[[], Estimator], key: str) -> list[tuple[str, float]]:
    """(feature, loss of area) when a feature's values are dealt round by hashed order in the scored folds."""
    models = []
    ready = cut_lineage(balanced(df, "label"))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    for f in range(k):
        models.append(Pipeline(stages=[assembler, make()]).fit(ready.where(F.col(fold) != f)))

    def score(rows: DataFrame) -> float:
        parts = [m.transform(rows.where(F.col(fold) == f)).select("label", vector_to_array("probability")[1].alias("score")) for f, m in enumerate(models)]
        return area(reduce(DataFrame.unionByName, parts))

    base, out = score(ready), []
    by_key = numbered(ready, [key], "_at")
    for c in features:
        other = numbered(df.select(F.col(key).alias("_k"), F.col(c).alias("_new")).withColumn("_h", F.md5(F.concat_ws("|", F.lit(c), "_k"))), ["_h", "_k"], "_at").select("_at", "_new")
        out.append((c, base - score(by_key.join(other, "_at").drop(c).withColumnRenamed("_new", c))))
    return out
