"""Global order without a single task: running states of any associative operation, neighbours in order, row numbers and exact quantiles.

Rows are dealt by ranges of (group, order) and written once, so a hot group
spreads over as many parts as it needs. Inside a part, windows run; a part's
first group may have begun before it, so one row for the first and the last group
of each part carries states on, and nothing else moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shared import cut_lineage

#: Rows of a part, about: a task sorts one and holds it in windows.
PART = 1 << 18

#: A shuffle into many parts holds all rows of a map task in memory, one into few writes them as they come: before parts become many, they grow up to so many times PART.
GROWN = 8


@dataclass(frozen=True)
class State:
    """An associative operation: an aggregate of rows, the same of aggregates, two aggregates (the earlier one first) merged, and what is read off; null stands for no row."""

    of_rows: Column
    of_states: Callable[[Column], Column]
    merged: Callable[[Column, Column], Column]
    value: Callable[[Column], Column] = lambda c: c


def total(column: str | Column) -> State:
    """The sum, 0 before any row."""
    c = F.col(column) if isinstance(column, str) else column
    return State(F.sum(c), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def largest(column: str | Column) -> State:
    c = F.col(column) if isinstance(column, str) else column
    return State(F.max(c), F.max, F.greatest)


def smallest(column: str | Column) -> State:
    c = F.col(column) if isinstance(column, str) else column
    return State(F.min(c), F.min, F.least)


def every(condition: Column) -> State:
    """Whether a condition has held so far (where it is null, it does not)."""
    return State(F.min(F.coalesce(condition, F.lit(False))), F.min, lambda a, b: F.coalesce(a, F.lit(True)) & F.coalesce(b, F.lit(True)))


def latest(value: str, order: list[str]) -> State:
    """The last value that is not null."""
    row = F.struct(*order, F.col(value).alias("_value"))
    return State(F.max(F.when(F.col(value).isNotNull(), row)), F.max, lambda a, b: F.coalesce(b, a), lambda c: c["_value"])


def holder(value: str, payload: str) -> State:
    """payload of the row with the largest value; of ties the largest payload."""
    row = F.struct(F.col(value).alias("_value"), F.col(payload).alias("_payload"))
    return State(F.max(F.when(F.col(value).isNotNull(), row)), F.max, lambda a, b: F.when(b.isNull() | (a > b), a).otherwise(b), lambda c: c["_payload"])


class Dealt:
    """Rows in parts by ranges of (by, order); rows must be unique in it."""

    def __init__(self, rows: DataFrame, order: list[str], by: tuple[str, ...], spread: bool = False, parts: int | None = None):
        self.order, self.by = order, by
        #: Windows and groups by part (and more) need no further exchange. Of a known number of parts each gets a task: bounds at every third of one leave no two together.
        self.parts = rows if spread else rows.repartitionByRange(3 * parts, "_part") if parts else rows.repartitionByRange("_part")

    @property
    def rows(self) -> DataFrame:
        return self.parts.drop("_part")

    def mapped(self, change: Callable[[DataFrame], DataFrame]) -> Dealt:
        """With columns added, changed or filtered; part, order and group stay."""
        return Dealt(change(self.parts), self.order, self.by, True)

    def scan(self, states: dict[str, State], before: bool = False) -> Dealt:
        """With each state over the rows of the group up to and with this one; before: without it."""
        window = Window.partitionBy("_part", *self.by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        inside = self.parts.select("*", *[s.of_rows.over(window).alias(f"_in_{n}") for n, s in states.items()])
        per = self.parts.groupBy("_part", *self.by).agg(*[s.of_rows.alias(f"_all_{n}") for n, s in states.items()])
        if self.by:
            group, part = F.struct(*self.by), Window.partitionBy("_part")
            per = per.withColumn("_edge", group.eqNullSafe(F.min(group).over(part)) | group.eqNullSafe(F.max(group).over(part))).where("_edge")
        earlier = Window.partitionBy(*self.by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in self.by], *[s.of_states(F.col(f"_all_{n}")).over(earlier).alias(f"_from_{n}") for n, s in states.items()])
        same = F.col("_part") == F.col("_p")
        for c in self.by:
            same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        both = inside.join(F.broadcast(carried), same, "left")  # two rows a part at most
        return Dealt(both.select(*self.parts.columns, *[s.value(s.merged(F.col(f"_from_{n}"), F.col(f"_in_{n}"))).alias(n) for n, s in states.items()]), self.order, self.by, True)

    def ahead(self, k: int, out: str, row: Column) -> Dealt:
        """With an array `out` of `row` of the next k rows of the group (fewer at its end).

        The last k rows of a part look among the first and last k rows of all parts,
        which are few; all others find theirs in the part.
        """
        part, columns = Window.partitionBy("_part").orderBy(*self.by, *self.order), self.parts.columns
        near = lambda window: F.array_compact(F.array(*[F.lead(row, d).over(window) for d in range(1, k + 1)]))
        placed = self.parts.withColumn("_at", F.row_number().over(part)).withColumn("_last", F.lead(F.lit(1), k).over(part).isNull())
        edges = placed.where((F.col("_at") <= k) | F.col("_last")).withColumn("_over", near(Window.partitionBy(*self.by).orderBy(*self.order))).where("_last")
        over = edges.select(F.col("_part").alias("_p"), F.col("_at").alias("_a"), "_over")  # k rows a part at most
        inside = placed.withColumn(out, near(Window.partitionBy("_part", *self.by).orderBy(*self.order)))
        both = inside.join(F.broadcast(over), (F.col("_part") == F.col("_p")) & (F.col("_at") == F.col("_a")), "left")
        return Dealt(both.select(*columns, F.coalesce("_over", out).alias(out)), self.order, self.by, True)


def deal(df: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> Dealt:
    """Rows dealt by ranges and written once, since later steps must see the same ranges. They are counted, and a part has about GROWN * PART of them at most."""
    n, sc = df.count(), df.sparkSession.sparkContext
    few = int(sc.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")) - 1  # less one, as ranges of _part have an empty one at the end
    return _dealt(df, order, by, max(_parts(n, few), sc.defaultParallelism) if n > PART else None)


def _parts(n: int, few: int) -> int:
    """In how many parts n rows are dealt: of PART rows, while they are few, then few larger ones, then as many as keep them at GROWN * PART."""
    return min(-(-n // PART), max(few, -(-n // (GROWN * PART))))


def _dealt(df: DataFrame, order: list[str], by: tuple[str, ...], parts: int | None = None) -> Dealt:
    ranges = df.repartitionByRange(parts, *by, *order) if parts else df.repartitionByRange(*by, *order)
    return Dealt(cut_lineage(ranges.withColumn("_part", F.spark_partition_id())), order, by, parts=parts)


def with_running(df: DataFrame, order: list[str], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each name in sums, the sum of its column over rows of the group that stand before this one."""
    return _dealt(df, order, by).scan({n: total(c) for n, c in sums.items()}, before=True).rows


def numbered(df: DataFrame, order: list[str], out: str = "row", by: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place in its group, from 0; rows must be unique in (by, order)."""
    return with_running(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}, by).drop("_one")


def terciles(df: DataFrame, order: list[str], out: str = "tercile", parts: int = 3) -> DataFrame:
    """df with the part, 1 to `parts`, of each row's percent rank; rows must be unique in order."""
    n = df.agg(F.count("*").alias("_n"))
    rank = F.when(F.col("_n") > 1, F.col("_row") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return numbered(df, order, "_row").crossJoin(F.broadcast(n)).withColumn(out, F.greatest(F.ceil(rank * parts), F.lit(1)).cast("int")).drop("_row", "_n")


def exact_quantiles(df: DataFrame, by: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of each group, from the two rows around each place; nulls are left out.

    Counts of equal values stand for them, so the order is unique and a value
    that is found very often is one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    ran = with_running(counts, [value], {"_below": "_n"}, (by,))
    sizes = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_size"))
    at = ran.join(sizes, F.col(by).eqNullSafe(F.col("_by")))

    def quantile(q: float) -> F.Column:
        place = F.lit(float(q)) * (F.col("_size") - 1)
        holds = lambda p: (F.col("_below") <= p) & (p < F.col("_below") + F.col("_n"))
        low, high = (F.max(F.when(holds(p), F.col(value))) for p in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return at.groupBy(by).agg(*[quantile(q).alias(name) for name, q in wanted.items()])
