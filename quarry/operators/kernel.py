"""A machine with the RBF kernel on Nystroem landmarks: squared hinge loss, solved by Newton steps on sums over blocks of rows.

The kernel of a row with the landmarks, times the inverse root of the landmarks'
own kernel, is a row of features whose products are the kernel projected onto the
landmarks; with all rows as landmarks the machine is the exact one. A step needs
the features' weighted second moments over the rows inside the margin, one pass;
what comes to the driver is one matrix, as large as the landmarks are many squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.selection import hashed
from quarry.operators.shared import cut_lineage

#: Newton steps, at most.
STEPS = 40


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def with_landmarks(df: DataFrame, features: list[str], key: str, landmarks: int, gamma: float, seed: str = "landmarks") -> DataFrame:
    """df with `z`: the features of the standardised columns on `landmarks` rows, those of the smallest hashes of key, and a constant one."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.greatest(F.coalesce(F.stddev_pop(c), F.lit(0.0)), F.lit(1e-9)).alias("s")).alias(c) for c in features]).first()
    scaled = F.array(*[(F.col(c).cast("double") - float(stats[c]["m"] or 0.0)) / float(stats[c]["s"]) for c in features])
    chosen = df.orderBy(hashed(seed, key), key).limit(landmarks).select(scaled.alias("x")).collect()  # bounded by the parameter
    at = np.unique(np.array([r["x"] for r in chosen]).reshape(-1, len(features)), axis=0)
    value, vector = np.linalg.eigh(kernel(at, at, gamma)) if len(at) else (np.zeros(0), np.zeros((0, 0)))
    kept = value > 1e-12 * value.max(initial=1.0)
    root = vector[:, kept] / np.sqrt(value[kept])

    @F.pandas_udf("array<double>")
    def z(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_list()).reshape(-1, len(features)) if len(x) else np.zeros((0, len(features)))
        return pd.Series(list(np.c_[kernel(rows, at, gamma) @ root, np.ones(len(rows))]))

    return df.withColumn("z", z(scaled))


def sums(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of rows (z, label 0 or 1, weight): the loss, and second moments and right side over the rows whose margin is under one."""
    d = len(w)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d * d + d)
        for batch in batches:
            if len(batch):
                z, y, c = np.stack(batch["z"].to_list()), 2.0 * batch["label"].to_numpy(float) - 1, batch["weight"].to_numpy(float)
                short = 1 - y * (z @ w)
                inside = short > 0
                z, y, c = z[inside], y[inside], c[inside]
                total += np.r_[(c * short[inside] ** 2).sum(), ((z * c[:, None]).T @ z).ravel(), z.T @ (c * y)]
        yield pd.DataFrame({"s": [total.tobytes()]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d * d + d)
        for batch in batches:
            for s in batch["s"]:
                total += np.frombuffer(s)
        yield pd.DataFrame({"s": [total.tobytes()]})

    got = np.frombuffer(rows.select("z", "label", "weight").mapInPandas(part, "s binary").repartition(1).mapInPandas(whole, "s binary").first()["s"])
    return got[0], got[1 : 1 + d * d].reshape(d, d), got[1 + d * d :]


def fitted(rows: DataFrame, penalty: float) -> np.ndarray:
    """The weights that minimise penalty * |w| ** 2 + the weighted squared hinge loss; the constant is not penalised. rows (z, label, weight) are read once a step, so they should be written."""
    first = rows.select(F.size("z").alias("d")).first()
    if first is None:
        return np.zeros(0)
    d = first["d"]
    ridge = np.diag(np.r_[np.full(d - 1, penalty), 1e-9])
    w = np.zeros(d)
    loss, second, right = sums(rows, w)
    for _ in range(STEPS):
        target = np.linalg.solve(second + ridge, right)
        step, moved = 1.0, None
        while step > 1e-4:  # halved where the loss would grow
            new = w + step * (target - w)
            moved = sums(rows, new)
            if moved[0] + new @ ridge @ new <= loss + w @ ridge @ w + 1e-12:
                break
            step /= 2
        done = np.abs(new - w).max() <= 1e-9 * (1 + np.abs(w).max())
        w, (loss, second, right) = new, moved
        if done:
            break
    return w


def scores(rows: DataFrame, w: np.ndarray, out: str = "score") -> DataFrame:
    """rows without z, with their margins."""
    @F.pandas_udf("double")
    def margin(z: pd.Series) -> pd.Series:
        return pd.Series(np.stack(z.to_list()) @ w if len(z) else np.zeros(0))

    return rows.withColumn(out, margin("z")).drop("z")


def machine(df: DataFrame, features: list[str], key: str, fold: str, k: int, landmarks: int = 128, gamma: float = 0.5, penalty: float = 1.0) -> DataFrame:
    """df (label 0 or 1, weight) with `score`: the margin under a machine that was fitted on the other folds. Landmarks and scales are of all rows, labels of the others only."""
    ready = cut_lineage(with_landmarks(df, features, key, landmarks, gamma))
    out = None
    for f in range(k):
        one = scores(ready.where(F.col(fold) == f), fitted(ready.where(F.col(fold) != f), penalty))
        out = one if out is None else out.unionByName(one)
    return out
