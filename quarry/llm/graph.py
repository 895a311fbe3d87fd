"""Connected components of a distributed edge table, and grouped streams of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import heavy_join, materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): the smallest node that it is connected with.

    Each round, edges are drawn towards the smallest neighbour (large star),
    then towards the smallest label seen (small star), until nothing moves.
    Every round is written to the shared folder. A hub's neighbours stay where they
    are: what it is told is broadcast (see heavy_join).
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        near = both(now)
        least = materialise(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = heavy_join(near, least, ["u"], "n").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        lower = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lower")
        small = heavy_join(large, lower, ["a"], "n").select("b", "m").where("b <> m").withColumnRenamed("b", "a").withColumnRenamed("m", "b").union(lower.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, "small-star")
        moved = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        release(now, large, least, lower)
        now = after
        if not moved:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream of frames whose rows are sorted by keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if held and (held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        bounds = [*change[1:], len(batch)]
        start = 0
        for end in bounds[:-1]:
            held.append(batch.iloc[start:end])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held, start = [], end
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
