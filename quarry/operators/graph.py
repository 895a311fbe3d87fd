"""Near-duplicate joins on 64-bit hashes, links enough for their components, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.shared import cut_lineage, heavy_join, release

#: Values near a band's value that a row is dealt to, over all bands, at most.
SPREAD = 512
#: Rows of a block, about, at most, and blocks at least: a task compares two.
BLOCK, BLOCKS = 1 << 17, 5
#: Codes compared at a time, and pairs whose vectors are.
TILE, CHUNK = (128, 4096), 1 << 15


def gradient_hash(vector: Column, n: int = 64) -> Column:
    """n - 1 bits: whether each entry exceeds the one before it, the first pair in the highest bit."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.when(F.element_at(vector, i + 1) > F.element_at(vector, i), 1).otherwise(0))


def bands_of(most: int, width: int) -> tuple[int, int]:
    """(bands, radius): of two codes that differ in at most `most` bits some band differs in at most `radius` = most // bands.

    One side is dealt to all values within the radius, SPREAD a row at most; of
    the choices, that with the smallest share of random pairs as candidates.
    """
    choices = []
    for n in range(1, most + 2):
        size, radius = width // n, most // n
        spread = n * sum(comb(size + 1, r) for r in range(radius + 1))
        if spread <= SPREAD or not radius:
            choices.append((n * sum(comb(size, r) for r in range(radius + 1)) / 2**size, n, radius))
    return min(choices)[1:]


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int, width: int = 63) -> DataFrame:
    """Pairs (a, b, distance) with a < b whose hashes differ in at most `most` bits.

    Of a pair, some band differs in at most `radius` bits (see bands_of), so one
    side is joined by its band values and the other by all values within the
    radius; each pair is kept in its first such band, so no distinct is needed.
    """
    n, radius = bands_of(most, width)
    cuts = [width * i // n for i in range(n + 1)]
    value = lambda c, i: F.shiftright(c, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    around = [sorted(sum(1 << b for b in on) for r in range(radius + 1) for on in combinations(range(cuts[i + 1] - cuts[i]), r)) for i in range(n)]
    rows = df.select(F.col(key).alias("k"), F.col(bits).alias("h"))
    a = rows.select("k", "h", F.posexplode(F.array(*[value(F.col("h"), i) for i in range(n)])).alias("band", "v")).alias("a")
    near = F.array(*[F.struct(F.lit(i).alias("band"), value(F.col("h"), i).alias("v"), F.array(*[F.lit(m).cast("long") for m in around[i]]).alias("masks")) for i in range(n)])
    spread = rows.select("k", "h", F.inline(near)).select("k", "h", "band", "v", F.explode("masks").alias("m"))
    b = spread.select("k", "h", "band", F.col("v").bitwiseXOR(F.col("m")).alias("v")).alias("b")
    differ = F.col("a.h").bitwiseXOR(F.col("b.h"))
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.k") < F.col("b.k")) & (F.bit_count(differ) <= most)
    first = F.coalesce(*[F.when(F.bit_count(value(differ, i)) <= radius, F.lit(i)) for i in range(n)])
    return a.join(b, same & (first == F.col("a.band"))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.bit_count(differ).cast("int").alias("distance"))


class Joined:
    """Components of the numbers below n, as pairs come in."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Which of the pairs, in their order, join two components."""
        to: dict[int, int] = {}

        def root(v: int) -> int:
            while v in to:
                to[v] = v = to.get(to[v], to[v])
            return v

        kept = []
        for i, (a, b) in enumerate(zip(self.of[x].tolist(), self.of[y].tolist())):
            a, b = root(a), root(b)
            if a != b:
                to[max(a, b)] = min(a, b)
                kept.append(i)
        if kept:
            now = np.arange(len(self.of))
            now[list(to)] = [root(v) for v in list(to)]
            self.of = now[self.of]
        return kept


def near_codes(a: np.ndarray, b: np.ndarray, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of codes that differ in at most `most` bits, CHUNK pairs at most at a time; same: b is a, and each pair comes once."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    for s in range(0, len(a), TILE[0]):
        for t in range(s if same else 0, len(b), TILE[1]):
            some = b[t : t + TILE[1]]
            x, y = np.divmod(np.flatnonzero(np.bitwise_count(a[s : s + TILE[0], None] ^ some) <= most), len(some))
            x, y = x + s, y + t
            if same:
                x, y = x[x < y], y[x < y]
            for c in range(0, len(x), CHUNK):
                yield x[c : c + CHUNK], y[c : c + CHUNK]


def matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, entries by row, 0 behind the shorter ones) of lists without nulls."""
    size = np.concatenate([np.zeros(0, np.int64), *[c.value_lengths().to_numpy() for c in lists.chunks]])
    entries = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks])
    if size.min() == size.max():
        return size, entries.reshape(len(size), -1)
    out = np.zeros((len(size), size.max()), entries.dtype)
    out[np.arange(size.max()) < size[:, None]] = entries
    return size, out


def hamming_links(df: DataFrame, key: str, bits: str, most: int, vector: str | None = None, close: float = 0.0) -> DataFrame:
    """(a, b): as many of hamming_pairs() as it takes to have the same components, not all of them.

    vector: only pairs whose mean absolute difference is under `close`; keys must
    then be unique, and vectors that are null or hold nulls take no part. Every two
    blocks of rows meet in one task, vectors included, and of their pairs it gives
    those that join two components of what it has seen: fewer than rows. So up to
    BLOCK * BLOCKS rows what moves grows with the rows, though the number of near
    pairs grows with their square; beyond it, blocks grow in number.
    """
    rows = df.select(F.col(key).alias("k"), F.col(bits).alias("h"), *([F.col(vector).alias("e")] if vector else [])).where("k is not null and h is not null")
    if vector:
        rows = rows.where(F.col("e").isNotNull() & F.forall("e", lambda v: v.isNotNull()))
    blocks = max(BLOCKS, -(-df.count() // BLOCK))
    own, other = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("*", own.alias("own"), other.alias("other")).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")

    def links(cell: tuple, rows: pa.Table) -> pa.Table:
        cell = tuple(c.as_py() for c in cell)
        left, right = (np.flatnonzero(rows["own"].to_numpy() == c) for c in cell)
        codes, joined = rows["h"].to_numpy(), Joined(len(rows))
        if vector:
            size, vectors = matrix(rows["e"])
        number = rows["k"].combine_chunks().dictionary_encode().indices.to_numpy()
        a, b = [], []
        for x, y in near_codes(codes[left], codes[right], most, cell[0] == cell[1]):
            x, y = left[x], right[y]
            apart = joined.of[number[x]] != joined.of[number[y]]
            x, y = x[apart], y[apart]
            if vector and len(x):
                mean = np.cumsum(np.abs(vectors[x].astype(float) - vectors[y]), axis=1)[:, -1] / size[x]  # summed in order, as Spark does
                near = (size[x] == size[y]) & (mean < close)
                x, y = x[near], y[near]
            kept = joined.add(number[x], number[y])
            a.append(x[kept])
            b.append(y[kept])
        none = left[:0]
        return pa.table({name: rows["k"].take(pa.array(np.concatenate([none, *at]))) for name, at in (("a", a), ("b", b))})

    kind = dict(df.dtypes)[key]
    spread = dealt.repartition(blocks * (blocks + 1), "i", "j")  # a known number, as a pair of blocks has few bytes for its work
    return spread.groupBy("i", "j").applyInArrow(links, f"a {kind}, b {kind}")


def mean_abs_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def array_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; NULL where one is constant."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    n = F.size(a).cast("double")
    sa, sb = total(F.transform(a, lambda x: x.cast("double"))), total(F.transform(b, lambda x: x.cast("double")))
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u.cast("double") * v))
    return (n * dot(a, b) - sa * sb) / F.nullif(F.sqrt((n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb)), F.lit(0.0))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root): root is the smallest node of the connected component.

    Each round draws every node's neighbours to the smallest of them (large
    star), then the smaller ones to their smallest (small star): no node's label
    becomes a key that a whole component is joined on, and what a hub is told is
    broadcast (see heavy_join). The edges are written once, as they may be costly,
    and every round is; it ends when no edge moves. Rounds keep all nodes that have
    an edge to another, so the given edges aren't read again for them.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    turned = F.col("a") < F.col("b")
    given = cut_lineage(edges.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")).distinct())
    now, read = given.where("a <> b"), [given]
    if nodes is None:
        loose = cut_lineage(given.where("a = b or a is null or b is null"))
    while True:
        near = both(now)
        least = cut_lineage(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut_lineage(heavy_join(near, least, "u", "n").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        lower = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = heavy_join(large, lower, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).distinct()
        after = cut_lineage(small)
        moved = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        release(*read, least, large, lower)
        now, read = after, [after]
        if not moved:
            every = nodes.select("node") if nodes is not None else both(now).unionByName(both(loose)).select(F.col("u").alias("node"))
            return every.distinct().join(now.select(F.col("a").alias("node"), F.col("b").alias("_root")), "node", "left").select("node", F.coalesce("_root", "node").alias("root"))


def what_if(labels: DataFrame, extra: DataFrame) -> DataFrame:
    """Component sizes after adding edges: components of components, so the old edges aren't read again."""
    lifted = extra.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    again = components(lifted.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = labels.join(again.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    return moved.groupBy(F.coalesce("new", "root").alias("root")).agg(F.count("*").alias("size"))
