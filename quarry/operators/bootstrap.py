"""Cluster bootstrap with hashed draws: replicate r, slot i draws group number hash(r|i) mod G."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import numbered
from quarry.operators.shared import cut_lineage


def hash32(c: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def draws(groups: DataFrame, group: str, replicates: int) -> DataFrame:
    """(r, group, times) over groups numbered by key; one row for each group number drawn."""
    spark = groups.sparkSession
    numbers = numbered(groups.select(group).distinct(), [group], "_g")
    n = numbers.agg(F.count("*").alias("n"))
    slots = spark.range(replicates).withColumnRenamed("id", "r").crossJoin(F.broadcast(n)).select("r", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    drawn = slots.select("r", F.pmod(hash32(F.concat_ws("|", "r", "i")), F.col("n")).alias("_g")).groupBy("r", "_g").agg(F.count("*").alias("times"))
    return drawn.join(numbers, "_g").select("r", group, "times")


def interval(df: DataFrame, column: str) -> list[F.Column]:
    return [F.round(F.percentile(column, F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]


def bootstrap_mean(df: DataFrame, group: str, value: str, replicates: int = 100) -> DataFrame:
    """Estimate and 95 % percentile interval of a mean; whole groups are drawn, and only their sums are joined to draws."""
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    per = draws(sums, group, replicates).join(sums, group).groupBy("r").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("c") * F.col("times"))).alias("m"))
    point = df.agg(F.round(F.avg(value), 6).alias("estimate"))
    return point.crossJoin(per.agg(*interval(per, "m"), F.count("*").alias("replicates")))


def paired_delta(df: DataFrame, group: str, a: str, b: str, replicates: int = 100) -> DataFrame:
    """Mean difference of two columns with shared draws: estimate, interval and two-sided p from the share of signs."""
    sums = df.groupBy(group).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count("*").alias("c"))
    per = draws(sums, group, replicates).join(sums, group).groupBy("r").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("c") * F.col("times"))).alias("m"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double"))))
    return df.agg(F.round(F.avg(F.col(a) - F.col(b)), 6).alias("estimate")).crossJoin(per.agg(*interval(per, "m"), F.round(p, 6).alias("p")))


def weights(groups: DataFrame, group: str, replicates: int) -> DataFrame:
    """(group, w): how often each replicate draws a group, after a one for the sample itself; a row a group."""
    drawn = draws(groups, group, replicates).groupBy(F.col(group).alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct("r", "times"))).alias("_m"))
    times = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)).cast("short"))
    all_ = groups.select(group).distinct().join(drawn, F.col(group) == F.col("_g"), "left")
    return all_.select(group, F.concat(F.array(F.lit(1).cast("short")), times).alias("w"))


def areas(df: DataFrame, label: str, score: str, n: int) -> DataFrame:
    """(r, auc): the area for each of n weights in the array w of a row; null where one class has no weight.

    Weights are summed for each score where the rows are, then scores are dealt by
    ranges. A range gives (area, positives, negatives) of its own for all weights
    at once; two ranges in order give (a1 + a2 + p2 * n1, p1 + p2, n1 + n2), so
    what meets in the end is a row a range.
    """
    rows = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), "w")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s, at = np.unique(batch["s"].to_numpy(), return_inverse=True)
                sums = np.zeros((len(s), 2, n), np.int64)
                np.add.at(sums, (at, batch["y"].to_numpy()), np.stack(batch["w"].to_list()).astype(np.int64))
                yield pd.DataFrame({"s": s, "sums": [x.tobytes() for x in sums]})

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, area, below, pos, last, held = None, np.zeros(n), np.zeros(n), np.zeros(n), None, np.zeros((2, n))
        for batch in batches:
            if not len(batch):
                continue
            s = batch["s"].to_numpy()
            new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sums = np.add.reduceat(np.frombuffer(b"".join(batch["sums"]), np.int64).reshape(-1, 2, n).astype(float), new)
            if last == s[0]:
                sums[0] += held
            elif last is not None:
                sums = np.concatenate([held[None], sums])
            first, last, held = s[0] if first is None else first, s[-1], sums[-1]
            up = below + np.cumsum(sums[:-1, 0], axis=0)
            area += (sums[:-1, 1] * (up - sums[:-1, 0] / 2)).sum(axis=0)
            pos += sums[:-1, 1].sum(axis=0)
            below = up[-1] if len(up) else below
        if first is not None:
            yield pd.DataFrame({"s": [first], "area": [area + held[1] * (below + held[0] / 2)], "pos": [pos + held[1]], "neg": [below + held[0]]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = pd.concat(batches).sort_values("s")
        area = pos = neg = np.zeros(n)
        for a, p, q in zip(parts["area"], parts["pos"], parts["neg"]):
            area, pos, neg = area + a + p * neg, pos + p, neg + q
        with np.errstate(invalid="ignore"):
            value = np.where((pos > 0) & (neg > 0), area / (pos * neg), np.nan)
        yield pd.DataFrame({"r": np.arange(n), "auc": [None if np.isnan(x) else x for x in value]}).astype({"auc": "Float64"})

    dealt = rows.mapInPandas(summed, "s double, sums binary").repartitionByRange("s").sortWithinPartitions("s")
    parts = dealt.mapInPandas(ranged, "s double, area array<double>, pos array<double>, neg array<double>")
    return parts.repartition(1).mapInPandas(whole, "r long, auc double").select("r", F.round("auc", 6).alias("auc"))  # a row a range


def paired_auc_delta(df: DataFrame, group: str, label: str, a: str, b: str, replicates: int = 50) -> DataFrame:
    """Difference of two scores' areas with shared draws: estimate, interval, two-sided p; draws with one class are left out."""
    weighted = df.select(group, label, a, b).join(cut_lineage(weights(df, group, replicates)), group)
    both = areas(weighted, label, a, replicates + 1).join(areas(weighted, label, b, replicates + 1).withColumnRenamed("auc", "_b"), "r")
    d = cut_lineage(both.select("r", (F.col("auc") - F.col("_b")).alias("d")).where("d is not null"))
    per = d.where("r > 0")
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    point = d.agg(F.max(F.when(F.col("r") == 0, F.round("d", 6))).alias("estimate"))
    return point.crossJoin(per.agg(*interval(per, "d"), F.round(p, 6).alias("p"), F.count("*").alias("replicates")))


class Statistic:
    """A statistic under n weights at once, as states that merge: one pass over the rows gives all replicates."""

    def start(self, n: int) -> object:
        raise NotImplementedError

    def update(self, state: object, rows: pd.DataFrame, w: np.ndarray) -> object:
        """The state with rows, the weights of which are the rows of w (one column a replicate)."""
        raise NotImplementedError

    def merge(self, a: object, b: object) -> object:
        raise NotImplementedError

    def finish(self, state: object) -> np.ndarray:
        """A value for each replicate; NaN leaves it out."""
        raise NotImplementedError


class Median(Statistic):
    """The median of a column of few distinct values: weights summed for each value."""

    def __init__(self, column: str):
        self.column = column

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0), np.zeros((0, n), np.int64)

    def update(self, state: tuple, rows: pd.DataFrame, w: np.ndarray) -> tuple:
        some = rows[self.column].notna().to_numpy()
        return self.merge(state, (rows[self.column].to_numpy(float, na_value=np.nan)[some], w[some]))

    def merge(self, a: tuple, b: tuple) -> tuple:
        values, at = np.unique(np.r_[a[0], b[0]], return_inverse=True)
        sums = np.zeros((len(values), a[1].shape[1]), np.int64)
        np.add.at(sums, at, np.concatenate([a[1], b[1]]))
        return values, sums

    def finish(self, state: tuple) -> np.ndarray:
        values, up = state[0], np.cumsum(state[1], axis=0)
        if not len(values):
            return np.full(state[1].shape[1], np.nan)
        n = up[-1]
        low, high = ((up <= place).sum(axis=0) for place in ((n - 1) // 2, n // 2))
        middle = (values[np.minimum(low, len(values) - 1)] + values[np.minimum(high, len(values) - 1)]) / 2
        return np.where(n > 0, middle, np.nan)


def bootstrap_of(df: DataFrame, group: str, statistic: Statistic, columns: list[str], replicates: int = 50, where: str = "true") -> DataFrame:
    """Estimate and interval of any mergeable statistic of the rows where a condition holds, as often as their group is drawn; groups are drawn from all rows.

    A task folds its rows into one state for all replicates; states merge in two levels.
    """
    n = replicates + 1
    weighted = df.where(where).select(group, *columns).join(weights(df, group, replicates), group).select("w", *columns)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = statistic.start(n)
        for batch in batches:
            if len(batch):
                state = statistic.update(state, batch[columns], np.stack(batch["w"].to_list()).astype(np.int64))
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = statistic.start(n)
        for batch in batches:
            for x in batch["state"]:
                state = statistic.merge(state, pickle.loads(x))
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in merged(batches):
            yield pd.DataFrame({"r": np.arange(n), "value": statistic.finish(pickle.loads(batch["state"].iloc[0]))})

    states = weighted.mapInPandas(folded, "state binary").withColumn("_to", F.spark_partition_id() % 16)
    states = states.repartition(16, "_to").select("state").mapInPandas(merged, "state binary")
    per = cut_lineage(states.repartition(1).mapInPandas(finished, "r long, value double").where("value is not null and not isnan(value)"))  # 16 states
    point = per.agg(F.max(F.when(F.col("r") == 0, F.round("value", 6))).alias("estimate"))
    return point.crossJoin(per.where("r > 0").agg(*interval(per, "value"), F.count("*").alias("replicates")))


def bootstrap_auc(df: DataFrame, group: str, label: str, score: str, replicates: int = 50) -> DataFrame:
    """AUC with its interval: members weigh as often as their group is drawn; draws with one class are left out."""
    weighted = df.select(group, label, score).join(weights(df, group, replicates), group)
    per = cut_lineage(areas(weighted, label, score, replicates + 1).where("auc is not null"))
    point = per.agg(F.max(F.when(F.col("r") == 0, F.col("auc"))).alias("estimate"))
    return point.crossJoin(per.where("r > 0").agg(*interval(per, "auc"), F.count("*").alias("replicates")))
