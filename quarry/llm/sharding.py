"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import globally_ordered, materialise, release

#: Buckets of a histogram of group ends: over everything at first, then around each cut.
WIDE, FINE = 4096, 1024


class Ends:
    """What is known of the group ends: some of them, and the ranges (both ends outside) where others may lie."""

    def __init__(self, total: int):
        self.points, self.open = [0, total], [(0, total)] if total > 1 else []

    def reach(self, x: int, hopeful: bool) -> int:
        """The last known end up to x; hopeful: x itself where an unknown end may be at x or close before."""
        if hopeful:
            k = bisect_right(self.open, (x, -1)) - 1
            if k >= 0 and self.open[k][0] < x < self.open[k][1]:
                return x
        return self.points[bisect_right(self.points, x) - 1]

    def path(self, capacity: int, n_shards: int, hopeful: bool) -> list[int]:
        """Ends of greedily filled shards."""
        at = [0]
        for _ in range(n_shards):
            at.append(self.reach(min(at[-1] + capacity, self.points[-1]), hopeful))
        return at

    def smallest(self, low: int, high: int, n_shards: int, hopeful: bool) -> int:
        """The smallest capacity whose path comes to the end; `high` counts as one."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.path(mid, n_shards, hopeful)[-1] >= self.points[-1] else (mid + 1, high)
        return low

    def unsure(self, a: int, b: int) -> tuple[int, int] | None:
        """The part of a range (both ends inside) from its first to its last place where an unknown end may lie."""
        near = [(max(lo + 1, a), min(hi - 1, b)) for lo, hi in self.open if lo + 1 <= b and hi - 1 >= a]
        return (near[0][0], near[-1][1]) if near else None

    def learn(self, regions: list[tuple[int, int]], buckets: list[tuple[int, int, int]]) -> None:
        """Take in buckets (first end, last end, how many) of all ends that lie in regions (both ends inside)."""
        rest = self.open
        for a, b in regions:
            rest = [x for lo, hi in rest for x in ([(lo, hi)] if hi <= a or lo >= b else [(lo, a), (b, hi)]) if x[1] - x[0] > 1]
        self.open = sorted({*rest, *((lo, hi) for lo, hi, n in buckets if n > 2)})
        self.points = sorted({*self.points, *(x for lo, hi, _ in buckets for x in (lo, hi))})


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def search(look: Callable[[list[tuple[int, int]], int], list[tuple[int, int, int]]], total: int, largest: int, n_shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and its cuts. look(regions, n): buckets (first end, last end, how many), n a region, of the ends in regions.

    Filling is checked once as if there were an end wherever one may be, and
    once with the known ends only. Where the two differ, the ranges around the
    cuts are looked up again in finer buckets.
    """
    low, high = max(-(-total // n_shards), largest, 1), -(-total // n_shards) + largest
    known, regions, n = Ends(total), [(1, max(1, total))], WIDE
    while True:
        known.learn(regions, look(regions, n))
        best = known.smallest(low, high, n_shards, True)
        cuts = known.path(best, n_shards, False)
        if cuts[-1] >= total:
            return best, cuts[1:n_shards]
        most = known.smallest(best, high, n_shards, False)
        low, high = best, most
        regions = merged([x for a, b in zip(cuts[1:], known.path(most, n_shards, True)[1:]) if (x := known.unsure(a, b))])
        n = max(FINE, 4 * max(sum(lo < b and hi > a for lo, hi in known.open) for a, b in regions))  # finer than what is known


def smallest_capacity(ends: DataFrame, total: int, largest: int, n_shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which greedy contiguous filling needs at most n_shards shards, and its cuts.

    `ends` holds column `end`: the running size at the end of each group, in
    order. The search runs on histograms of the ends, whose buckets' first and
    last ends are exact; each is one aggregation, whose WIDE rows (then FINE a
    cut) come to the driver, however many groups there are.
    """

    def look(regions: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
        at = F.coalesce(*[F.when(F.col("end").between(a, b), F.floor((F.col("end") - a) * n / F.lit(b - a + 1)) + k * n) for k, (a, b) in enumerate(regions)])
        found = ends.select("end", at.alias("at")).where("at is not null").groupBy("at").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n"))
        return [(r["a"], r["b"], r["n"]) for r in found.collect()]

    return search(look, total, largest, n_shards)


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Put documents into contiguous shards so that the largest shard is as small as the order of groups allows.

    A group is all documents of one text (null counts as empty) and is never
    split. Groups stand in the order of a 128-bit hash of the text. Law:
    `bytes`. Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    Repeated rows each get a slot of their own; a null doc_id is carried; an
    empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"),
    )
    rows, totals = globally_ordered(base, "k1", "k2", "doc_id", sums=("size",))
    rows = materialise(rows, "rows")
    groups = rows.groupBy("k1", "k2").agg(F.max("end_size").alias("end"), F.sum("size").alias("size"))
    ends = materialise(groups.select("end", "size"), "ends")
    largest = ends.agg(F.max("size")).first()[0] or 0
    _, cuts = smallest_capacity(ends, totals["size"], largest, n_shards)
    release(ends)
    shard_of = sum(((F.col("end_size") - F.col("size")) >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    placed = rows.withColumn("shard", shard_of.cast("int"))
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    first = F.coalesce(*[F.when(F.col("shard") == s, F.lit(f)) for s, f in firsts.items()], F.lit(0))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
