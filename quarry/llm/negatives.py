"""Hard negatives: integer scores of each anchor with all rows, sorted block by block.

The scores of an anchor with a block of rows are sorted by score and id. The
first rows of its label in each block, merged, are its positives. Each
positive's upper limit is then found by binary search in the sorted scores of
every block, and the first rows of other labels from there down to the lower
limit, merged over the blocks, are its negatives. The first k of a union are
among the first k of its parts, so nothing is lost and no block is joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import materialise
from quarry.llm.vectors import QUERIES, ROWS, best_of, blocks, meet, merge, unpack, usable

#: Components are multiplied by this and rounded down.
UNIT = 256
#: What stands for no row: below any score, and with a negative of its own.
NONE = -np.iinfo(np.int64).max
#: Anchors scored at once.
AT_ONCE = 64


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(UNIT * v)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; what does not fit a long is the nearest long above NONE."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in a], object).dot(np.array([[int(x) for x in r] for r in b], object).T)
    return np.clip(whole, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def by_score(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by score, largest first, then by id."""
    return np.lexsort((ids, -scores))


def first_between(scores: np.ndarray, other: np.ndarray, upper: int, k: int, low: int, high: int) -> np.ndarray:
    """Places of the first k in sorted scores (largest first) that are marked in the sorted places `other` and lie in low * upper <= high * score <= high * upper."""
    start = np.searchsorted(-scores, -upper, "left")
    least = -(-low * upper // high)  # the smallest score allowed
    end = np.searchsorted(-scores, -least, "right") if least <= upper else start
    at = other[np.searchsorted(other, start) :][:k]
    return at[at < end]


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, n_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the k hardest rows of other labels.

    Positives are the first n_positives other rows of the anchor's label by
    score, then id; negatives the first k of other labels with
    low * positive <= high * negative <= high * positive. Fewer give all; a
    negative positive score gives none. Rows that are left out (see
    vectors.usable, and a null label) are neither; repeated rows and ids are rows
    like any others. An empty table gives no rows.
    """
    rows, kind = usable(vectors, key, vector, {"label": label.cast("long"), "asks": F.coalesce(anchors, F.lit(False))})
    rows = rows.where("label is not null")
    table, n_table = blocks(rows, kind, ROWS, ("label",))
    asked, n_asked = blocks(rows.where("asks"), kind, QUERIES, ("label",))

    def opened(data: bytes) -> tuple:
        v, own = unpack(data, kind, 3)
        return integers(v), own

    def scored(held: tuple, data: bytes):
        """For each anchor: its number, label, row, and its scores with the block."""
        v, (_, own, labels) = unpack(data, kind, 3)
        for a in range(0, len(v), AT_ONCE):
            for i, s in enumerate(scores_of(integers(v[a : a + AT_ONCE]), held[0]), a):
                yield i, labels[i], own[i], s

    def positives(held: tuple, data: bytes, _: bytes | None) -> bytes:
        _, (ids, own, labels) = held
        n = int(np.frombuffer(data, "<i8", 1)[0])
        scores, found = np.full((n, n_positives), NONE), np.zeros((n, n_positives), np.int64)
        for i, mine, row, s in scored(held, data):
            same = np.flatnonzero((labels == mine) & (own != row))
            same = same[by_score(s[same], ids[same])[:n_positives]]
            scores[i, : len(same)], found[i, : len(same)] = s[same], ids[same]
        return scores.tobytes() + found.tobytes()

    def negatives(held: tuple, data: bytes, note: bytes) -> bytes:
        _, (ids, _, labels) = held
        limits, _ = halves(note, n_positives)
        scores, found = np.full((len(limits), n_positives, k), NONE), np.zeros((len(limits), n_positives, k), np.int64)
        for i, mine, _, s in scored(held, data):
            order = by_score(s, ids)
            s, other = s[order], np.flatnonzero(labels[order] != mine)
            for p, upper in enumerate(limits[i].tolist()):
                if upper > NONE:
                    at = first_between(s, other, upper, k, low, high)
                    scores[i, p, : len(at)], found[i, p, : len(at)] = s[at], ids[order[at]]
        return scores.tobytes() + found.tobytes()

    def halves(data: bytes, *shape: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(data, "<i8").reshape(2, -1, *shape)
        return both[0], both[1]

    def folded(*shape: int):
        def fold(held: bytes | None, part: bytes) -> bytes:
            if held is None:
                return part
            (s1, f1), (s2, f2) = halves(held, *shape), halves(part, *shape)
            return b"".join(np.ascontiguousarray(x).tobytes() for x in best_of(np.concatenate([s1, s2], -1), np.concatenate([f1, f2], -1), shape[-1]))

        return fold

    def rows_of(batches):
        for batch in batches:
            for data, note, part in zip(batch["data"], batch["note"], batch["part"]):
                _, (ids, _, _) = unpack(data, kind, 3)
                limits, positive = halves(note, n_positives)
                scores, found = halves(part, n_positives, k)
                i, p, r = np.nonzero(scores > NONE)
                yield pd.DataFrame({"anchor_id": ids[i], "positive_id": positive[i, p], "rank": (r + 1).astype(np.int32), "negative_id": found[i, p, r], "positive_score": limits[i, p], "negative_score": scores[i, p, r]})

    known = materialise(merge(meet(table, n_table, asked, n_asked, opened, positives), folded(n_positives)).withColumnRenamed("data", "note"), "positives")
    noted = asked.join(known, "block")
    found = merge(meet(table, n_table, noted, n_asked, opened, negatives), folded(n_positives, k)).withColumnRenamed("data", "part")
    return noted.join(found, "block").mapInPandas(rows_of, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
