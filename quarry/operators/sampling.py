"""Deterministic samples, halves, folds and digests: every choice is a hash of (seed, key)."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import numbered
from quarry.operators.selection import cutoffs, hashed


def half(key: Column) -> Column:
    """0 or 1: the parity of the last hex digit of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), -1, 1), 16, 10).cast("int") % 2


def smallest_hashes(df: DataFrame, by: list[str], key: list[str], n: int, seed: str) -> DataFrame:
    """n rows of each group, those of the smallest seeded hashes of key: cutoffs from counted prefixes, then one filter."""
    marked = df.withColumn("_h", hashed(seed, *key)).withColumn("_key", F.struct(*key))
    cuts = cutoffs(marked.select(*by, "_h", "_key"), by, [n]).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_cut")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return marked.join(cuts, same, "left").where(F.col("_cut").isNull() | (F.struct("_h", "_key") <= F.col("_cut"))).select(*df.columns)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, those of the smallest seeded hashes."""
    return smallest_hashes(df, [stratum], [key], n, seed)


def folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """Grouped folds: all rows of a group share a fold."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), group)), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(number, F.lit(k)).cast("int"))


def digest(df: DataFrame, column: str) -> DataFrame:
    """SHA-256 of the newline-joined sorted values: freezes a small key set, which meets in one row."""
    return df.agg(F.expr(f"sha2(listagg(cast({column} as string), '\n') within group (order by cast({column} as string)), 256)").alias("digest"), F.count("*").alias("n"))


def bucket_digest(df: DataFrame, column: str) -> DataFrame:
    """Freezes a key set of any size: SHA-256 over the digests of 256 buckets by the keys' MD5, each as digest() takes it.

    A bucket is split once more, by the next two hex digits, so that 65,536 short lists are joined and no long one.
    """
    text = F.col(column).cast("string")
    parts = df.select(text.alias("k"), F.md5(text).alias("h")).groupBy(F.substring("h", 1, 4).alias("b4")).agg(F.expr("sha2(listagg(k, '\n') within group (order by k), 256)").alias("d"), F.count("*").alias("n"))
    whole = parts.groupBy(F.substring("b4", 1, 2).alias("b2")).agg(F.expr("sha2(listagg(d, '\n') within group (order by b4), 256)").alias("d"), F.sum("n").alias("n"))
    return whole.agg(F.expr("sha2(listagg(d, '\n') within group (order by b2), 256)").alias("digest"), F.sum("n").alias("n"))


def stratified_group_folds(df: DataFrame, group: str, stratum: str, k: int, seed: str) -> DataFrame:
    """df with `fold`: groups stay whole, and within their largest stratum they are dealt round, the largest first.

    Groups are ordered by (largest stratum, size, hashed key) and numbered within
    the stratum; folds are dealt there and back (0 .. k - 1, k - 1 .. 0), so their
    sizes differ by less than the largest group for each stratum. Only counts of
    groups move, none come to the driver.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("_n"))
    main = counts.groupBy(group).agg(F.sum("_n").alias("_size"), F.max_by(stratum, F.struct("_n", F.col(stratum))).alias("_main"))
    order = main.withColumn("_less", -F.col("_size")).withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), group)))
    at = numbered(order, ["_less", "_hash", group], "_at", ("_main",))
    turn = F.pmod(F.col("_at"), F.lit(2 * k))
    folded = at.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return df.join(folded, group)


def balanced_sample(df: DataFrame, by: list[str], key: list[str], n: int, seed: str) -> DataFrame:
    """Up to n rows of each combination of `by` (such as image and label), those of the smallest seeded hashes of key."""
    return smallest_hashes(df, by, key, n, seed)


def slices(df: DataFrame, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """Shuffle and cut: disjoint slices of the given sizes, in the order of seeded hashes; df with `slice`."""
    marked = df.withColumn("_h", hashed(seed, key)).withColumn("_key", F.col(key))
    ends = list(accumulate(sizes.values()))
    cuts = cutoffs(marked.select("_h", "_key"), [], ends).groupBy().pivot("_k", list(range(len(ends)))).agg(F.first("_cut"))
    named = [F.when(F.col(str(k)).isNull() | (F.struct("_h", "_key") <= F.col(str(k))), F.lit(name)) for k, name in enumerate(sizes)]
    return marked.crossJoin(F.broadcast(cuts)).withColumn("slice", F.coalesce(*named)).where("slice is not null").select(*df.columns, "slice")  # one row
