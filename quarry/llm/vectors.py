"""Vectors in blocks: which rows take part, blocks of bounded size, and every block of rows met by every block of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import bound_batches, materialise

#: Rows in a block of the table, rows in a block of queries, and blocks of queries that meet a block of the table in one task.
ROWS, QUERIES, SPAN = 16384, 512, 32


def usable(vectors: DataFrame, key: str, vector: str, more: dict[str, Column] | None = None, nonzero: bool = False) -> tuple[DataFrame, np.dtype]:
    """(row, id, vec, and the columns of `more`) of the rows that take part, written and numbered once; and the type of a packed component.

    Left out: a null id, a null or empty vector, null or non-finite components,
    with `nonzero` also vectors of zeros, and vectors that don't have the most
    frequent number of components (of ties the smaller): they have no product
    with the others.
    """
    bound_batches(vectors.sparkSession)
    kind = np.dtype("<f4" if vectors.schema[vector].dataType.elementType == T.FloatType() else "<f8")
    v = F.col(vector).cast("array<float>" if kind.itemsize == 4 else "array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("vec"), *[c.alias(n) for n, c in (more or {}).items()])
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & finite)
    if nonzero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    written = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    usual = written.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return written.where(F.size("vec") == (usual["d"] if usual else 0)), kind


def blocks(rows: DataFrame, kind: np.dtype, size: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(block, data) and the number of blocks: rows dealt by a hash of their number, about `size` in each, packed for unpack().

    Equal vectors, ids and labels spread like any others.
    """
    n = -(-rows.count() // size)
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(max(n, 1))).cast("int").alias("block"), "id", "row", "vec", *more)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def one() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            columns = [part[c].to_numpy(np.int64) for c in ("id", "row", *more)]
            data = np.array([len(part)], "<i8").tobytes() + b"".join(c.tobytes() for c in columns) + np.concatenate(part["vec"].to_list()).astype(kind).tobytes()
            return pd.DataFrame({"block": [int(part["block"].iloc[0])], "data": [data]})

        for batch in batches:
            for _, part in batch.groupby("block", sort=False):
                if held and held[-1]["block"].iloc[0] != part["block"].iloc[0]:
                    yield one()
                    held.clear()
                held.append(part)
        if held:
            yield one()

    packed = dealt.repartition("block").sortWithinPartitions("block", "id", "row").mapInPandas(pack, "block int, data binary")
    return materialise(packed, "blocks"), max(n, 1)


def unpack(data: bytes, kind: np.dtype, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vectors of a block as doubles, and its columns: id, row and what else was packed. Rows are in the order of ids."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    own = [np.frombuffer(data, "<i8", n, 8 + 8 * n * k) for k in range(columns)]
    return np.frombuffer(data, kind, offset=8 + 8 * n * columns).reshape(n, -1).astype(np.float64), own


def meet(table: DataFrame, n_table: int, queries: DataFrame, n_queries: int, opened: Callable, work: Callable[[object, bytes, bytes | None], bytes]) -> DataFrame:
    """(block, data): work(opened(block of the table), query block, its note) for each pair, under the query block's number.

    The query set is stated, so each of its blocks meets each block of the table.
    A task holds one block of the table and reads up to SPAN blocks of queries one
    after the other, so the table is copied once for SPAN * QUERIES queries and
    the queries once for ROWS rows. queries may have a column `note`.
    """
    spans = -(-n_queries // SPAN)
    note = F.col("note") if "note" in queries.columns else F.lit(None).cast("binary")
    left = table.select("block", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.lit(-1).alias("query"), "data", F.lit(None).cast("binary").alias("note"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_table - 1))).alias("at"), F.floor(F.col("block") / SPAN).cast("int").alias("span"), F.col("block").alias("query"), "data", note.alias("note"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.query < 0:
                    held, at = opened(row.data), row.block
                elif at == row.block:  # a block of the table may be empty
                    out.append((row.query, work(held, row.data, row.note)))
            yield pd.DataFrame(out, columns=["block", "data"])

    both = left.union(right.select(F.col("at").alias("block"), "span", "query", "data", "note"))
    return both.repartition("block", "span").sortWithinPartitions("block", "span", "query").mapInPandas(run, "block int, data binary")


def merge(parts: DataFrame, fold: Callable[[bytes | None, bytes], bytes]) -> DataFrame:
    """(block, data): the parts of each query block folded together as they stream by; one is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if at is not None and at != row.block:
                    yield pd.DataFrame({"block": [at], "data": [held]})
                    held = None
                at, held = row.block, fold(held, row.data)
        if at is not None:
            yield pd.DataFrame({"block": [at], "data": [held]})

    return parts.repartition("block").sortWithinPartitions("block").mapInPandas(run, "block int, data binary")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row (last axis) with their ids, largest first, equal ones by smaller id."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)
