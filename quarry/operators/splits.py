"""Leakage-safe splits: groups from several merge rules, dealt to training, validation and test, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import components
from quarry.operators.sampling import stratified_group_folds
from quarry.operators.shared import cut_lineage

BINS, TEST, VAL, FOLDS = 20, 3, 3, 5


def merge_rules(nodes: DataFrame, rules: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(node, root) after all rules, and (rule, position, merges): by how much each rule, in its turn, lowers the number of groups.

    nodes holds column node; a rule's edges are (a, b), and those with an
    unknown end are left out. A rule is applied to the groups made so far, so
    later rules work on fewer nodes.
    """
    spark = nodes.sparkSession
    labels = cut_lineage(nodes.select("node").distinct().withColumn("root", F.col("node")))
    counts = []
    for k, (name, edges) in enumerate(rules):
        lifted = edges.join(labels.toDF("a", "ra"), "a").join(labels.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
        again = cut_lineage(components(lifted).toDF("root", "new"))
        n = again.agg(F.count("*") - F.count_distinct("new")).first()[0]
        counts.append((name, k, n))
        if n:
            labels = cut_lineage(labels.join(again, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
    return labels, spark.createDataFrame(counts, "rule string, position int, merges long")


def make_splits(df: DataFrame, key: str, group: str, stratum: str, seed: str) -> DataFrame:
    """(key, split, cv_fold, split_group): BINS stratified bins of whole groups, TEST of them for test, VAL for validation; the others and validation have FOLDS folds (test: -1)."""
    binned = cut_lineage(stratified_group_folds(df.select(key, group, stratum), group, stratum, BINS, seed).withColumnRenamed("fold", "bin"))
    split = F.when(F.col("bin") < TEST, "test").when(F.col("bin") < TEST + VAL, "val").otherwise("train")
    placed = binned.withColumn("split", split)
    folded = stratified_group_folds(placed.where("split <> 'test'").select(key, group, stratum), group, stratum, FOLDS, seed + "|cv").select(key, "fold")
    return placed.join(folded, key, "left").select(key, "split", F.coalesce("fold", F.lit(-1)).alias("cv_fold"), F.col(group).alias("split_group"))


def violations(splits: DataFrame, key: str) -> DataFrame:
    """One row of counts that must all be 0: repeated keys, groups in several splits or folds, test rows with a fold, others without."""
    keys = splits.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    groups = splits.groupBy("split_group").agg(F.count_distinct("split").alias("s"), F.count_distinct("cv_fold").alias("f")).agg(F.count_if(F.col("s") > 1).alias("split_groups"), F.count_if(F.col("f") > 1).alias("folded_groups"))
    return keys.crossJoin(groups).crossJoin(splits.agg(F.count_if((F.col("split") == "test") != (F.col("cv_fold") == -1)).alias("wrong_folds")))
