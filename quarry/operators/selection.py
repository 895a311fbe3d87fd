"""The n-th smallest by refined histograms: exact quantiles of many columns and groups, and hash cutoffs of samples.

Each round counts rows by bins, keeps the bins that hold a wanted place, and looks
only into those: no sort, no buffer of a group's values, three aggregations that
combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shared import cut_lineage

#: Bins of the second round in each bin of the first, and bins looked into that are broadcast, at most (some 100 bytes each).
FINE, FEW = 4096, 20_000
#: Rows in all bins looked into up to which the second round is left out: their values are counted at once.
DIRECT = 1_000_000
#: First hex digits of a hash that are counted.
DIGITS = 4


def coarse(v: Column) -> Column:
    """A bin of 1/32 octave of a double; never falls while v grows (NaN is the largest, as in Spark's order)."""
    a, beyond = F.abs(v), 2200 * 32
    e = F.floor(F.log2(a))
    size = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(beyond)).otherwise((e + 1100) * 32 + F.floor((a / F.pow(F.lit(2.0), e) - 1) * 32) + 1)
    return F.when(F.isnan(v), F.lit(2 * beyond)).otherwise(F.signum(v) * size).cast("int")


def looked_into(rows: DataFrame, bins: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """rows in the given (written) bins, with the bins' columns `more`; few bins are broadcast."""
    right = bins.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *more).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    small = bins.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(right) if small else right, same).drop(*[f"_r{i}" for i in range(len(keys))])


def narrowed(counts: DataFrame, wanted: DataFrame, keys: list[str], bin: str) -> DataFrame:
    """wanted (places `_rank` in a bin, by keys) with the finer bin of counts (keys, bin, _n, _lo, _hi) that each falls into, and its place in there."""
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(bin)) - F.col("_n")
    right = counts.withColumn("_below", below).select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in (bin, "_n", "_lo", "_hi") if c not in keys], "_below")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    left = wanted.drop("_n", "_lo", "_hi", *([bin] if bin not in keys else []))
    found = left.join(right, same & (F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
    return found.withColumn("_rank", F.col("_rank") - F.col("_below")).drop("_below", *[f"_r{i}" for i in range(len(keys))])


def at_places(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """(by, names): for each name the value of its column at place(n) of the group's n values that are not null, from 0, smallest first.

    A place between two is interpolated. Groups without a value give no row, names
    without one give null. df is read twice, or three times where many rows are near the places.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    long = df.select(*by, values.alias("_x")).select(*by, "_x._c", "_x._v").where("_v is not null").withColumn("_b", coarse(F.col("_v")))
    group, keys = [*by, "_c"], [*by, "_c", "_b"]
    summary = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    hist = cut_lineage(long.groupBy(*keys).agg(*summary))
    sizes = hist.groupBy(*group).agg(F.sum("_n").alias("_size"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(columns.index(c)).alias("_of"), place(F.col("_size")).cast("double").alias("_place")) for k, (c, place) in enumerate(wanted.values())]))
    asked = sizes.select(*group, places.alias("_p")).where("_p._of = _c").select(*group, "_p._k", "_p._place")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.floor("_place").alias("_rank")), F.struct(F.lit(1).alias("_side"), F.ceil("_place").alias("_rank"))))
    asked = asked.select(*group, "_k", (F.col("_place") - F.floor("_place")).alias("_part"), sides.alias("_s")).select("*", "_s.*").drop("_s")
    first = cut_lineage(narrowed(hist, asked, group, "_b"))

    done = ["_k", "_side", "_part", F.col("_lo").alias("_value")]
    found = first.where("_lo <=> _hi").select(*by, *done)
    wide, by_value = first.where("not _lo <=> _hi"), [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    if (wide.select(*keys, "_n").distinct().agg(F.sum("_n")).first()[0] or 0) <= DIRECT:
        exact = looked_into(long, wide, keys, []).groupBy(*keys, "_v").agg(*by_value)
        return _read(found.unionByName(narrowed(exact, wide, keys, "_v").select(*by, *done)), by, wanted)
    inside = looked_into(long, wide, keys, ["_lo", "_hi"])
    step = F.least(F.lit(FINE - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * FINE)).cast("int")
    fine = inside.withColumn("_f", step).groupBy(*keys, "_f").agg(*summary)
    second = cut_lineage(narrowed(fine, wide, keys, "_f"))

    found = found.unionByName(second.where("_lo <=> _hi").select(*by, *done))
    wide = second.where("not _lo <=> _hi")
    inside = looked_into(long, wide, keys, ["_f", "_lo", "_hi"]).where("_v between _lo and _hi")
    exact = inside.groupBy(*keys, "_f", "_v").agg(*by_value)
    return _read(found.unionByName(narrowed(exact, wide, [*keys, "_f"], "_v").select(*by, *done)), by, wanted)


def _read(found: DataFrame, by: list[str], wanted: dict) -> DataFrame:
    """Values at both sides of a place, interpolated, a column a name."""

    def value(k: int) -> Column:
        low, high, part = (F.max(F.when((F.col("_k") == k) & (F.col("_side") == s), F.col(c))) for s, c in ((0, "_value"), (1, "_value"), (0, "_part")))
        return F.when(part == 0, low).otherwise(low + (high - low) * part)

    return found.groupBy(*by).agg(*[value(k).alias(n) for k, n in enumerate(wanted)])


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, names): for each name the linearly interpolated quantile of its column."""
    return at_places(df, by, {n: (c, lambda size, q=q: F.lit(float(q)) * (size - 1)) for n, (c, q) in wanted.items()})


def hashed(seed: str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *key))


def cutoffs(rows: DataFrame, by: list[str], ranks: list[int], sums: dict[str, str] | None = None, n: Column | None = None) -> DataFrame:
    """(by, _k, _cut, and sums): of rows (by, _h, _key) the n-th smallest (_h, _key) of each group for each n of ranks (numbered _k), or n(group's columns).

    Groups with fewer rows have no row for it. sums: name -> column, its sum over
    the rows up to the cut. rows is read twice: hash prefixes are counted, then
    only rows with the prefix that holds the place are ordered.
    """
    sums = sums or {}
    rows = rows.withColumn("_b", F.substring("_h", 1, DIGITS))
    keys = [*by, "_b"]
    bins = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])
    up = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select("*", (F.sum("_n").over(up) - F.col("_n")).alias("_below"), *[(F.coalesce(F.sum(f"_s_{name}").over(up), F.lit(0)) - F.coalesce(f"_s_{name}", F.lit(0))).alias(f"_u_{name}") for name in sums])
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), (F.lit(r) if n is None else n).cast("long").alias("_place")) for k, r in enumerate(ranks)]))
    held = cut_lineage(bins.select("*", asked.alias("_a")).select("*", "_a.*").where("_below < _place and _place <= _below + _n").drop("_a", "_n", *[f"_s_{name}" for name in sums]))
    inside = looked_into(rows, held, keys, [])
    order = Window.partitionBy(*keys).orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.select("*", F.row_number().over(order).alias("_at"), *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"_w_{name}") for name, c in sums.items()])
    right = held.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_k", (F.col("_place") - F.col("_below")).alias("_in"), *[f"_u_{name}" for name in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    found = ranked.join(right, same & (F.col("_at") == F.col("_in")))
    return found.select(*by, "_k", F.struct("_h", "_key").alias("_cut"), *[(F.col(f"_u_{name}") + F.col(f"_w_{name}")).alias(name) for name in sums])
