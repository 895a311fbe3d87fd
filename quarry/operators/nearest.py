"""Exact k nearest rows of every row, in bounded tasks: cells around pivots, cut into blocks by distance from the pivot, in two rounds.

First each block is compared with itself, which bounds every row's k-th distance
from above, as the k + 1 rows next to each pivot do. Then all blocks stream past
each block, from the shared folder, in the task that holds its rows' nearest so
far: no pair of blocks is shuffled, and disk grows with the rows alone. The
triangle inequality and the bisectors between pivots leave blocks out, and of the
others the rows whose distance from the pivot is too far from its own. Pivots are
a bounded sample; how well they prune decides the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quarry.operators.order import numbered
from quarry.operators.shared import cut_lineage, release

#: Pivots, and rows of a cell in a block, at most: a task holds two blocks of vectors.
PIVOTS, BLOCK = 64, 4096
#: Rows compared with a block at a time: so many times BLOCK distances are held. Pairs whose distances are taken exactly at a time.
SLICE, CHUNK = 512, 1 << 15
#: Rows for which a task is worth its start.
LEAST = 1024
#: More than the rounding of a distance, by the size of the vectors; and of a square in 32 bits, by dimensions and the square of that size.
ROUNDING, SINGLE = 1e-6, 2.0**-23


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def largest(v: np.ndarray) -> float:
    """The largest finite length of a row."""
    size = np.sqrt((v * v).sum(axis=1))
    return float(size[np.isfinite(size)].max(initial=0))


def nearer(dist: np.ndarray, who: np.ndarray, own: np.ndarray, a: np.ndarray, bound: np.ndarray, others: np.ndarray, b: np.ndarray, centre: np.ndarray) -> None:
    """dist and who, the distances and numbers of the k nearest of each of a so far, by distance, then by number, brought up to date with b.

    bound: what the k-th distances can't exceed. Squares in 32 bits of the
    vectors as seen from the centre find what may come in; its distances are
    taken exactly.
    """
    k, (x, y) = dist.shape[1], (a - centre, b - centre)
    p, q = (x * x).sum(axis=1), (y * y).sum(axis=1)
    spare = (a.shape[1] + 16) * SINGLE * (np.sqrt(p) + largest(y)) ** 2 + 1e-40
    within = np.minimum(bound, dist[:, -1]) ** 2 + spare
    kind = np.float32 if largest(x) + largest(y) < 1e15 else float
    left, right = np.column_stack([-2 * x, p, np.ones(len(p))]).astype(kind), np.column_stack([y, np.ones(len(q)), q]).astype(kind)
    square = left @ right.T
    free = ~np.isfinite(within)
    if len(b) > k and free.any():  # the row itself may be among the k + 1 nearest
        within[free] = np.partition(square[free], k, axis=1)[:, k] + 2 * spare[free]
    x, y = np.divmod(np.flatnonzero(square <= np.nextafter(within.astype(kind), kind(np.inf))[:, None]), len(b))
    some = (own[x] != others[y]) & ((dist[x, -1] > 0) | (others[y] < who[x, -1]))
    x, y = x[some], y[some]
    d = np.concatenate([np.zeros(0), *(np.sqrt(((a[x[s : s + CHUNK]] - b[y[s : s + CHUNK]]) ** 2).sum(axis=1)) for s in range(0, len(x), CHUNK))])
    some = np.isfinite(d) & ((d < dist[x, -1]) | ((d == dist[x, -1]) & (others[y] < who[x, -1])))
    x, d, m = x[some], d[some], others[y[some]]
    rows = np.unique(x)
    x, d, m = np.concatenate([x, np.repeat(rows, k)]), np.concatenate([d, dist[rows].ravel()]), np.concatenate([m, who[rows].ravel()])
    by = np.lexsort((m, d, x))
    x, d, m = x[by], d[by], m[by]
    place = np.arange(len(x)) - np.searchsorted(x, x)
    top = place < k
    dist[x[top], place[top]], who[x[top], place[top]] = d[top], m[top]


def none_yet(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), np.inf), np.full((n, k), -1)


def kth_within(own: np.ndarray, v: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Each row's distance to the k-th nearest of its own block, SLICE rows at a time. It is exact whatever the slack."""
    out, centre = [], v[0]
    for s in range(0, len(own), SLICE):
        part = slice(s, s + SLICE)
        dist, who = none_yet(len(own[part]), k)
        nearer(dist, who, own[part], v[part], np.full(len(dist), np.inf), own, v, centre)
        out.append(dist[:, -1])
    return np.concatenate(out)


def k_nearest(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, rank, distance, compared): the k nearest other rows of each row by Euclidean distance, ties by the smaller row of key.

    Keys must be unique. Null vectors and vectors with null entries take no part;
    all must have one length. Fewer than k others give all. compared: candidates
    whose distance was computed for the row's block, over all pairs of it.
    """
    single = isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    vec = F.col(vector) if single else F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("key"), vec.alias("vec")).where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    rows = cut_lineage(numbered(rows, ["key"], "n"))
    sample = rows.orderBy(F.xxhash64("n"), "n").limit(PIVOTS).select("vec").collect()
    schema = "a " + dict(df.dtypes)[key] + ", b " + dict(df.dtypes)[key] + ", rank int, distance double, compared double"
    if not sample:
        return df.sparkSession.createDataFrame([], schema)
    pivots = np.unique(np.array([r["vec"] for r in sample], float), axis=0)
    between = distances(pivots, pivots)
    size = largest(pivots)
    d = pivots.shape[1]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = distances(np.stack(batch["vec"].to_list()).astype(float), pivots)
                cell = far.argmin(axis=1)
                yield batch[["n", "vec"]].assign(cell=cell.astype(np.int32), off=far[np.arange(len(far)), cell])

    cells = rows.select("n", "vec").mapInPandas(placed, f"n long, vec {dict(rows.dtypes)['vec']}, cell int, off double")
    dealt = numbered(cells, ["off", "n"], "_at", ("cell",)).withColumn("part", F.floor(F.col("_at") / BLOCK).cast("int"))
    # a row and k others of a cell are at most so far apart: its distance from the pivot, and theirs
    reach = np.full(len(pivots), np.inf)
    for r in dealt.where(F.col("_at") == k).select("cell", "off").collect():  # a row a pivot
        reach[r["cell"]] = r["off"]

    def sides(far: np.ndarray, home: int) -> np.ndarray:
        """Each row's least distance from the rows of each cell by its bisector with the row's own; 0 where pivots are too near each other to tell."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(between[home] > 1e-3 * size, (far**2 - far[:, home, None] ** 2) / (2 * between[home]), 0)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a block: its rows by distance from the pivot, and by cell what of their surroundings it may hold."""
        for group in whole(batches, ["cell", "part"]):
            n, v, off, home = group["n"].to_numpy(np.int64), np.stack(group["vec"].to_list()), group["off"].to_numpy(), int(group["cell"].iloc[0])
            wide = v.astype(float)
            far, slack = distances(wide, pivots), ROUNDING * (1 + max(size, largest(wide)))
            bound = np.minimum(kth_within(n, wide, k, slack), (far + reach).min(axis=1)) + slack
            near, most, side = (np.fmin.reduce(x) for x in (far - bound[:, None], -far - bound[:, None], sides(far, home) - bound[:, None]))
            side[home] = -np.inf
            yield pd.DataFrame({"cell": [home], "low": [np.fmin.reduce(off) - slack], "high": [np.fmax.reduce(off) + slack], "slack": [slack], "size": [len(n)], "near": [near], "most": [-most], "side": [side], "data": [n.tobytes() + off.tobytes() + bound.tobytes() + v.astype(kind).tobytes()]})

    by_block = dealt.select("cell", "part", "n", "off", "vec").repartition("cell", "part").sortWithinPartitions("cell", "part", "off", "n")
    schema = "cell int, low double, high double, slack double, size long, near array<double>, most array<double>, side array<double>, data binary"
    blocks = cut_lineage(by_block.mapInPandas(packed, schema).withColumn("block", F.monotonically_increasing_id()))
    count, total = blocks.agg(F.count("*"), F.sum("size")).first()

    def opened(data: pa.Buffer) -> tuple[np.ndarray, ...]:
        n = data.size // (24 + d * np.dtype(kind).itemsize)
        return np.frombuffer(data, np.int64, n).copy(), np.frombuffer(data, float, n, 8 * n).copy(), np.frombuffer(data, float, n, 16 * n).copy(), np.frombuffer(data, kind, n * d, 24 * n).reshape(n, d).astype(float)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of the blocks of a task, held while all others stream by; of these one is open at a time."""
        held, at = {}, None
        for batch in batches:
            value = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                block, home, to, cell, low, high, slack = (value[c][i].as_py() for c in ("block", "home", "to", "cell", "low", "high", "slack"))
                if block not in held:
                    n, _, bound, v = opened(value["own"][i].as_buffer())
                    far = distances(v, pivots)
                    held[block] = [n, v, bound, far, sides(far, home), *none_yet(len(n), k), 0]
                if to != at:
                    (others, off, _, w), at = opened(value["data"][i].as_buffer()), to
                n, v, bound, far, side, dist, who, _ = held[block]
                limit, by = np.minimum(bound, dist[:, -1]) + slack, far[:, cell]
                some = np.flatnonzero((by - high <= limit) & (low - by <= limit) & ((side[:, cell] <= limit) | (cell == home)))
                some = some[np.argsort(by[some])]
                for s in range(0, len(some), SLICE):
                    part = some[s : s + SLICE]
                    first, last = np.searchsorted(off, (by[part] - limit[part]).min()), np.searchsorted(off, (by[part] + limit[part]).max(), "right")
                    if first < last:
                        held[block][-1] += len(part) * int(last - first)
                        best = dist[part], who[part]
                        nearer(*best, n[part], v[part], bound[part], others[first:last], w[first:last], pivots[cell])
                        dist[part], who[part] = best
        for n, _, _, _, _, dist, who, read in held.values():
            i, r = np.nonzero(np.isfinite(dist))
            share = np.full(len(i), read / max(1, len(n) * (total - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(n[i]), pa.array(who[i, r]), pa.array((r + 1).astype(np.int32)), pa.array(dist[i, r]), pa.array(share)], ["n", "m", "rank", "distance", "compared"])

    # the hint keeps the blocks that stream by out of any shuffle and broadcast: every task reads them from the shared folder
    own = blocks.select("block", F.col("cell").alias("home"), "near", "most", "side", F.col("data").alias("own")).repartitionByRange(max(1, min(count, -(-total // LEAST))), "block")
    others = blocks.select(F.col("block").alias("to"), "cell", "low", "high", "slack", "data").coalesce(1)
    by_cell = lambda name: F.element_at(name, F.col("cell") + 1)
    meet = (by_cell("near") <= F.col("high")) & (by_cell("most") >= F.col("low")) & (by_cell("side") <= F.col("slack"))
    pairs = others.hint("shuffle_replicate_nl").join(own, meet).select("block", "home", "own", "to", "cell", "low", "high", "slack", "data")
    found = cut_lineage(pairs.mapInArrow(compared, "n long, m long, rank int, distance double, compared double"))
    release(blocks)
    names = lambda at, name: rows.select(F.col("n").alias(at), F.col("key").alias(name))
    return found.join(names("n", "a"), "n").join(names("m", "b"), "m").select("a", "b", "rank", "distance", "compared")


def whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby(keys, sort=True):
            if held and tuple(held[-1][keys].iloc[0]) != tuple(part[keys].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def chains(found: DataFrame, ratio: float) -> DataFrame:
    """(a, b): of each row's nearest, in order, those before the first whose distance isn't under `ratio` times the next one's; the last has no next."""
    near = found.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "b"))).alias("n"))  # k rows a group
    clear = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.element_at("n", i)["distance"] < F.lit(ratio) * F.greatest(F.element_at("n", i + 1)["distance"], F.lit(1e-6)))
    stops = F.array_position(clear, False)
    length = F.when(stops > 0, stops - 1).otherwise(F.size(clear)).cast("int")
    return near.where("size(n) > 1").select("a", F.explode(F.slice("n", F.lit(1), length)).alias("x")).select("a", "x.b")
