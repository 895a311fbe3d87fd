"""Grid analytics on long tables (grid, y, x, value): robust z, Moran's I, blocks, windows, neighbours, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import order
from quarry.operators.graph import components
from quarry.operators.selection import at_places, quantiles
from quarry.operators.shared import cut_lineage


def robust_z(df: DataFrame, grid: str, value: str) -> DataFrame:
    """df with z = (value - median) / scale, within a grid, clipped to 50; scale: 1.4826 MAD, floored. df is written once and read several times."""
    df = cut_lineage(df)
    spread = df.groupBy(F.col(grid).alias("_g")).agg(F.stddev_pop(value).alias("_sd"))
    middle = quantiles(df, [grid], {"_m": (value, 0.5)}).join(spread, F.col(grid) == F.col("_g")).drop("_g")
    off = df.join(cut_lineage(middle), grid)
    mad = quantiles(off.select(grid, F.abs(F.col(value) - F.col("_m")).alias("_off")), [grid], {"_mad": ("_off", 0.5)})
    scale = F.greatest(F.lit(1.4826) * F.col("_mad"), F.lit(1e-6) * (F.abs("_m") + 1), F.lit(0.1) * F.col("_sd"))
    z = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), (F.col(value) - F.col("_m")) / scale))
    return off.join(mad, grid).withColumn("z", z).drop("_m", "_sd", "_mad")


def morans_i(df: DataFrame, grid: str, y: str, x: str, value: str) -> DataFrame:
    """Moran's I with rook neighbours: equal joins with the cell to the right and the cell below."""
    d = df.join(df.groupBy(grid).agg(F.avg(value).alias("_mean")), grid).select(grid, F.col(y).alias("y"), F.col(x).alias("x"), (F.col(value) - F.col("_mean")).alias("d"))
    ways = F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"))))
    moved = d.select(grid, ways.alias("w"), "y", "x", F.col("d").alias("e")).select(grid, (F.col("y") - F.col("w.dy")).alias("y"), (F.col("x") - F.col("w.dx")).alias("x"), "e")
    pairs = d.join(moved, [grid, "y", "x"]).groupBy(grid).agg(F.count("*").alias("w"), F.sum(F.col("d") * F.col("e")).alias("cross"))
    square = d.groupBy(grid).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    return square.join(pairs, grid).select(grid, "n", F.round(F.when(F.col("ss") > 0, F.col("n") * F.col("cross") / (F.col("w") * F.col("ss"))).otherwise(0.0), 6).alias("moran"))


def block_mean(df: DataFrame, grid: str, y: str, x: str, value: str, size: int) -> DataFrame:
    return df.groupBy(grid, F.floor(F.col(y) / size).alias("by"), F.floor(F.col(x) / size).alias("bx")).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def integral(df: DataFrame, grid: str, y: str, x: str, value: str) -> DataFrame:
    """The sum over all cells up and left of each cell, itself included: running sums along rows, then along columns."""
    rows = Window.partitionBy(grid, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    columns = Window.partitionBy(grid, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_row", F.sum(value).over(rows)).withColumn("integral", F.sum("_row").over(columns)).drop("_row")


def moving_sum(df: DataFrame, by: str, place: str, value: str, width: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(place).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn("moving", F.sum(value).over(w))


def sorted_neighbours(df: DataFrame, by: str, key: str, columns: list[str], lags: int, close: float) -> DataFrame:
    """Pairs (a, b) at most `lags` apart in lexicographic order whose columns all differ by at most `close`; a group may be of any size."""
    row = F.struct(F.col(key).alias("b"), *[F.col(c).alias(f"_{c}") for c in columns])
    near = order.deal(df.select(by, key, *columns), [*columns, key], (by,)).ahead(lags, "near", row).rows
    pairs = near.select(by, F.col(key).alias("a"), *columns, F.inline("near"))
    for c in columns:
        pairs = pairs.where(F.abs(F.col(c) - F.col(f"_{c}")) <= close)
    return pairs.select(by, "a", "b")


def shift_votes(pairs: DataFrame, dy: str, dx: str, size: int, least: int) -> DataFrame:
    """Votes for shift vectors in bins of `size`, those with at least `least`."""
    return pairs.groupBy(F.floor(F.col(dy) / size).alias("by"), F.floor(F.col(dx) / size).alias("bx")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def strides(size: int, window: int, step: int) -> list[int]:
    """Window starts that cover 0 to size: every `step`, and a last one at the end."""
    if size <= window:
        return [0]
    out = list(range(0, size - window + 1, step))
    return out if out[-1] == size - window else [*out, size - window]


def stride_windows(df: DataFrame, size: str, window: int, step: int, out: str = "start") -> DataFrame:
    """A row for each window that covers 0 to `size`: every `step`, and a last one at the end."""
    last = F.greatest(F.col(size) - window, F.lit(0))
    return df.withColumn(out, F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")), F.array(last.cast("long"))))))


def box_mean(df: DataFrame, grid: str, y: str, x: str, value: str, reach: int = 1) -> DataFrame:
    """(grid, y, x, mean) over squares of 2 * reach + 1 cells of full grids; at borders the edge is repeated.

    Each axis is one join with 2 * reach + 1 copies of the cells, as rows, then columns.
    """
    far = df.groupBy(grid).agg(F.max(y).alias("_y"), F.max(x).alias("_x"))
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))

    def along(cells: DataFrame, axis: str, end: str) -> DataFrame:
        wanted = cells.drop("_v").withColumn("_d", steps).withColumn("_at", F.greatest(F.lit(0), F.least(F.col(end), F.col(axis) + F.col("_d"))))
        other = "x" if axis == "y" else "y"
        source = cells.select(F.col(grid).alias("_g"), F.col(axis).alias("_at"), F.col(other).alias("_o"), "_v")
        near = wanted.join(source, (F.col(grid) == F.col("_g")) & (wanted["_at"] == source["_at"]) & (F.col(other) == F.col("_o")))
        return near.groupBy(grid, "y", "x", "_y", "_x").agg(F.sum("_v").alias("_v"))

    cells = df.select(grid, F.col(y).alias("y"), F.col(x).alias("x"), F.col(value).alias("_v")).join(far, grid)
    return along(along(cells, "y", "_y"), "x", "_x").select(grid, "y", "x", (F.col("_v") / (2 * reach + 1) ** 2).alias("mean"))


def clusters(cells: DataFrame, grid: str, y: str, x: str, least: int = 1) -> DataFrame:
    """(grid, root, size) of 8-connected components of marked cells, those of at least `least` cells; root is the smallest (grid, y, x)."""
    node = F.struct(F.col(grid).alias("g"), F.col(y).alias("y"), F.col(x).alias("x"))
    marked = cells.select(node.alias("node"))
    ways = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = marked.select("node", ways.alias("w")).select("node", F.struct(F.col("node.g").alias("g"), (F.col("node.y") + F.col("w.dy")).alias("y"), (F.col("node.x") + F.col("w.dx")).alias("x")).alias("b"))
    edges = moved.join(marked.select(F.col("node").alias("b")), "b").select(F.col("node").alias("a"), "b")
    found = components(edges, marked).groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return found.select(F.col("root.g").alias(grid), F.col("root.y").alias("y"), F.col("root.x").alias("x"), "size")


def inconsistency(df: DataFrame, grid: str, y: str, x: str, value: str, valid: str | None = None) -> DataFrame:
    """How far the cells of a grid depart from it: z_max, z_p99, share above 3, mean of the top twentieth, largest cluster's share, Moran's I.

    Cells that `valid` marks false take no part. A grid with fewer than two valid cells has zeros.
    """
    cells = df.where(valid) if valid else df
    z = cut_lineage(robust_z(cells.select(grid, y, x, value), grid, value))
    twentieth = lambda n: F.greatest(F.floor(n / 20), F.lit(1))
    marks = at_places(z, [grid], {"z_p99": ("z", lambda n: F.lit(0.99) * (n - 1)), "_t": ("z", lambda n: n - twentieth(n))})
    above = F.col("z") > F.col("_t")
    top = z.join(cut_lineage(marks), grid).groupBy(grid).agg(
        F.max("z").alias("z_max"), F.first("z_p99").alias("z_p99"), F.avg((F.col("z") > 3).cast("double")).alias("share"), F.count("*").alias("n"),
        ((F.coalesce(F.sum(F.when(above, F.col("z"))), F.lit(0.0)) + (twentieth(F.count("*")) - F.count_if(above)) * F.first("_t")) / twentieth(F.count("*"))).alias("top"))
    largest = clusters(z.where("z > 2.5"), grid, y, x).groupBy(F.col(grid).alias("_g")).agg(F.max("size").alias("_largest"))
    moran = morans_i(cells, grid, y, x, value).select(F.col(grid).alias("_h"), "moran")
    both = top.join(largest, F.col(grid).eqNullSafe(F.col("_g")), "left").join(moran, F.col(grid).eqNullSafe(F.col("_h")), "left")
    few = F.col("n") < 2
    return both.select(grid, *[F.when(few, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("z_max", "z_p99", "share", "top")], (F.coalesce("_largest", F.lit(0)) / F.col("n")).alias("cluster"), F.coalesce("moran", F.lit(0.0)).alias("moran"))


def of_vectors(df: DataFrame, grid: str, vector: str, width: int) -> DataFrame:
    """(grid, y, x, v): a row for each entry of an array that holds a grid row by row."""
    e = df.select(grid, F.posexplode(vector).alias("_i", "_v"))
    return e.select(grid, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).alias("x"), F.col("_v").cast("double").alias("v"))


def resize_weights(n: int, m: int, how: str) -> list[tuple[int, int, float]]:
    """(to, from, weight) of one axis from n to m cells: mean over the area, nearest, or linear between cell centres with edges repeated."""
    step, out = n / m, []
    for i in range(m):
        if how == "area":
            out += [(i, j, (min(j + 1, (i + 1) * step) - max(j, i * step)) / step) for j in range(int(i * step), n) if j < (i + 1) * step - 1e-12]
        elif how == "nearest":
            out.append((i, int(i * step), 1.0))
        else:
            at = min(max((i + 0.5) * step - 0.5, 0.0), n - 1.0)
            out += [(i, j, 1 - abs(at - j)) for j in {int(at), min(int(at) + 1, n - 1)} if abs(at - j) < 1]
    return out


def resized(cells: DataFrame, grid: str, before: tuple[int, int], after: tuple[int, int], how: str = "area") -> DataFrame:
    """(grid, y, x, v) of full grids at another size: one join with the weights of each axis, a few for each row or column of a grid."""
    spark = cells.sparkSession
    for axis, n, m in (("y", before[0], after[0]), ("x", before[1], after[1])):
        weights = spark.createDataFrame(resize_weights(n, m, how), f"_to int, {axis} int, _w double")
        other = "x" if axis == "y" else "y"
        cells = cells.join(F.broadcast(weights), axis).groupBy(grid, other, F.col("_to").alias(axis)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return cells.select(grid, "y", "x", "v")


def convolved(cells: DataFrame, grid: str, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """(grid, y, x, v) of full grids under a kernel {(dy, dx): weight}; at borders the cells inside are mirrored, the edge not repeated."""
    ends = cells.groupBy(grid).agg(F.max("y").alias("_ye"), F.max("x").alias("_xe"))
    ways = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for (dy, dx), w in kernel.items()]))
    mirrored = lambda at, end: F.when(F.abs(at) > end, 2 * end - F.abs(at)).otherwise(F.abs(at))
    wanted = cells.join(ends, grid).select(grid, "y", "x", "_ye", "_xe", ways.alias("_k"))
    wanted = wanted.select(grid, "y", "x", F.col("_k.w").alias("_w"), mirrored(F.col("y") + F.col("_k.dy"), F.col("_ye")).alias("_y"), mirrored(F.col("x") + F.col("_k.dx"), F.col("_xe")).alias("_x"))
    source = cells.select(grid, F.col("y").alias("_y"), F.col("x").alias("_x"), "v")
    return wanted.join(source, [grid, "_y", "_x"]).groupBy(grid, "y", "x").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def magnitudes(df: DataFrame, grid: str, at: str, value: str, n: int, frequencies: list[int]) -> DataFrame:
    """(grid, k, magnitude) of the discrete Fourier transform of series of n values at a few frequencies, all in one pass."""
    angle = lambda k: F.col(at) * (2 * 3.141592653589793 * k / n)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.sqrt(F.pow(F.sum(F.col(value) * F.cos(angle(k))), F.lit(2)) + F.pow(F.sum(F.col(value) * F.sin(angle(k))), F.lit(2))).alias("magnitude")) for k in frequencies])
    return df.groupBy(grid).agg(rows.alias("_rows")).select(grid, F.inline("_rows"))


def equalised(levels: DataFrame, grid: str, level: str, top: int = 255) -> DataFrame:
    """(grid, level, n, spread): a grey level's share of the levels below it, spread over 0 to top (half to even); grids of one level keep it. Levels are counted, then counts are summed in order."""
    counts = levels.groupBy(grid, F.col(level).alias("level")).agg(F.count("*").alias("n"))
    ran = order.with_running(counts, ["level"], {"_below": "n"}, (grid,))
    whole = counts.groupBy(grid).agg(F.sum("n").alias("_all"), F.min(F.struct("level", "n")).alias("_first"))
    up = F.col("_below") + F.col("n") - F.col("_first.n")
    spread = F.when(F.col("_first.n") == F.col("_all"), F.col("level")).otherwise(F.bround(up / (F.col("_all") - F.col("_first.n")) * top, 0).cast("int"))
    return ran.join(whole, grid).select(grid, "level", "n", spread.alias("spread"))


def zigzag(n: int) -> list[tuple[int, int]]:
    """(y, x) of a square in zig-zag order: along diagonals, down the odd ones and up the even ones."""
    return sorted(((y, x) for y in range(n) for x in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


def disc(k: int) -> list[tuple[int, int]]:
    """Offsets of at most k (by the Euclidean distance)."""
    return [(dy, dx) for dy in range(-k, k + 1) for dx in range(-k, k + 1) if dy * dy + dx * dx <= k * k]


def dilated(marked: DataFrame, cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, y, x) of cells within `reach` of a marked one; both tables have keys, y and x."""
    if not reach:
        return marked.select(*keys, "y", "x")
    ways = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(reach)]))
    moved = marked.select(*keys, "y", "x", ways.alias("_w")).select(*keys, (F.col("y") + F.col("_w.dy")).alias("y"), (F.col("x") + F.col("_w.dx")).alias("x")).distinct()
    return moved.join(cells.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def eroded(marked: DataFrame, cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, y, x) of marked cells all of whose cells within `reach` are marked; what lies outside the grid does not count: the complement's dilation, taken away."""
    if not reach:
        return marked.select(*keys, "y", "x")
    at = [*keys, "y", "x"]
    rest = cells.select(*at).join(marked.select(*at), at, "left_anti")
    return marked.select(*at).join(dilated(rest, cells, keys, reach), at, "left_anti")


def cleaned_masks(marked: DataFrame, cells: DataFrame, grid: str, openings: list[int], closings: list[int], areas: list[int]) -> DataFrame:
    """(opening, closing, area, grid, y, x): marked cells after an opening, a closing, and without 8-connected components of fewer than `area` cells, for all combinations in one plan.

    A combination is part of the key, so a step runs once for all grids and all
    combinations that share it, and components are found once for all areas.
    """
    spark = marked.sparkSession
    steps = marked.select(grid, "y", "x")
    for name, reaches, first, then in (("opening", openings, eroded, dilated), ("closing", closings, dilated, eroded)):
        keys = [c for c in steps.columns if c not in ("y", "x")]
        out = None
        for r in reaches:  # a few kernels
            one = then(first(steps, _all(cells, steps, grid, keys), keys, r), _all(cells, steps, grid, keys), keys, r).withColumn(name, F.lit(r))
            out = one if out is None else out.unionByName(one)
        steps = cut_lineage(out)
    node = F.struct("opening", "closing", grid, "y", "x")
    marks = steps.select(node.alias("node"))
    ways = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = marks.select("node", ways.alias("w")).select("node", F.struct("node.opening", "node.closing", f"node.{grid}", (F.col("node.y") + F.col("w.dy")).alias("y"), (F.col("node.x") + F.col("w.dx")).alias("x")).alias("b"))
    labels = components(moved.join(marks.select(F.col("node").alias("b")), "b").select(F.col("node").alias("a"), "b"), marks)
    sizes = labels.groupBy("root").agg(F.count("*").alias("_size"))
    least = spark.createDataFrame([(a,) for a in areas], "area int")
    kept = labels.join(sizes, "root").join(F.broadcast(least), F.col("_size") >= F.col("area"))
    return kept.select("node.opening", "node.closing", "area", f"node.{grid}", "node.y", "node.x")


def _all(cells: DataFrame, steps: DataFrame, grid: str, keys: list[str]) -> DataFrame:
    """cells for each combination so far (a few)."""
    more = [c for c in keys if c != grid]
    return cells.select(grid, "y", "x").crossJoin(F.broadcast(steps.select(*more).distinct())) if more else cells.select(grid, "y", "x")
