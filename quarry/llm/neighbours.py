"""Nearest neighbours by cosine: a vantage-point tree per shard, pruned by the triangle inequality.

Unit vectors have a metric, sqrt(2 - 2 cosine). A tree halves its shard at the
median distance from a vantage point, over and over, down to leaves; on both
sides of a cut it keeps the least and the largest distance. What a query is away
from the vantage points bounds its distance from each leaf from below. A leaf is
left out when bound * factor is more than the distance of the k-th row found so
far: with a factor of one nothing nearer can be lost, with larger ones less is
read and some neighbours may be.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.vectors import QUERIES, ROWS, best_of, blocks, meet, merge, unpack, usable

#: Distinct vectors in a leaf, at most; vantage points tried at each cut, on so many rows.
LEAF, TRIES, SEEN = 64, 4, 256
#: Relaxation that the query uses.
FACTOR = 1.0
#: More than the rounding of a distance near zero.
SLACK = 1e-7


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last: the same bits whatever else is computed, and in SQL."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, so that products neither overflow nor vanish (the cosine stays as it is), and their lengths."""
    out = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])
    return out, np.sqrt(product(out, out))


class Tree:
    """A shard: its distinct vectors in the order of the leaves, each with the ids that have it, and the cuts."""

    def __init__(self, data: bytes, kind: np.dtype, keep: int):
        vectors, (ids, rows) = unpack(data, kind, 2)
        n, d = vectors.shape
        _, first, which = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, 8 * d))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")  # rows are in the order of ids
        place = np.arange(n) - np.searchsorted(which.ravel()[order], which.ravel()[order])
        order = order[place < keep]  # of a vector's ids, only the smallest can be among the nearest
        v, length = scaled(vectors[first])
        unit = v / length[:, None]
        rng = np.random.default_rng(n)
        at, self.cuts, leaves = np.arange(len(v)), [], []
        todo = [(0, len(v), 0)]
        self.n_nodes = 1
        while todo:
            a, b, node = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b, node))
                continue
            own = at[a:b]
            seen = rng.choice(own, min(SEEN, b - a), replace=False)
            tried = unit[seen[:TRIES]]
            point = tried[np.argmax(distances(tried, unit[seen]).std(axis=1))]
            far = distances(point[None], unit[own])[0]
            by = np.argsort(far, kind="stable")
            at[a:b], far, mid = own[by], far[by], (b - a) // 2
            inner, outer = self.n_nodes, self.n_nodes + 1
            self.n_nodes += 2
            self.cuts.append((node, inner, outer, point, far[0], far[mid - 1], far[mid], far[-1]))
            todo += [(a, a + mid, inner), (a + mid, b, outer)]
        self.leaves, self.v, self.length = leaves, v[at], length[at]
        back = np.empty(len(at), np.int64)
        back[at] = np.arange(len(at))
        self.owner, self.ids, self.rows = back[which.ravel()[order]], ids[order], rows[order]
        self.least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.owner, self.ids)

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For each query and leaf, a distance that no vector in the leaf can be nearer than."""
        low = np.zeros((self.n_nodes, len(unit)))
        if self.cuts:
            away = distances(np.stack([c[3] for c in self.cuts]), unit)
            for d, (node, inner, outer, _, a, b, c, e) in zip(away, self.cuts):  # parents come first
                low[inner] = np.maximum(low[node], np.maximum(d - b, a - d))
                low[outer] = np.maximum(low[node], np.maximum(c - d, d - e))
        return low[[node for _, _, node in self.leaves]].T

    def search(self, vectors: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids) of the k nearest of each query but itself (row numbers `own`), -inf where there are fewer; and the vectors compared.

        A query reads leaves from the least bound up, in rounds of 1, 1, 2, 4, ...
        leaves; leaves, not queries, are the unit of a product.
        """
        v, length = scaled(vectors)
        m = k + 1  # one may be the query itself
        low = self.bounds(v / length[:, None])
        order = np.argsort(low, axis=1, kind="stable")
        low = np.take_along_axis(low, order, 1)
        worst, read = np.full(len(v), -np.inf), 0
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        a, b = 0, 1
        while a < len(self.leaves):
            limit = np.sqrt(np.clip(2 - 2 * worst, 0, None))
            q, j = np.nonzero(low[:, a:b] * factor <= limit[:, None] + SLACK)
            if not len(q):
                break  # bounds only grow
            leaf = order[q, a + j]
            by = np.argsort(leaf, kind="stable")
            found = [best]
            for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                s, e, _ = self.leaves[leaf[part[0]]]
                who = q[part]
                near = v[who] @ self.v[s:e].T / (length[who][:, None] * self.length[s:e])
                read += near.size
                x, y = np.nonzero(near >= worst[who][:, None] - 1e-9)
                y += s
                found.append((who[x], y, product(v[who[x]], self.v[y]) / (length[who[x]] * self.length[y])))
            x, y, score = (np.concatenate(c) for c in zip(*found))
            by = np.lexsort((self.least[y], -score, x))
            x, y, score = x[by], y[by], score[by]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            best = tuple(c[place < m] for c in (x, y, score))
            last = place == m - 1
            worst[x[last]] = score[last]
            a, b = b, 2 * b
        return *self.rows_of(*best, own, k), read

    def rows_of(self, x: np.ndarray, y: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k first rows of each query among those that have its best vectors."""
        by = np.argsort(self.owner, kind="stable")
        start, end = (np.searchsorted(self.owner[by], y, side) for side in ("left", "right"))
        times = end - start
        at = by[np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())]
        x, score = np.repeat(x, times), np.repeat(score, times)
        other = self.rows[at] != own[x]
        x, score, ids = x[other], score[other], self.ids[at][other]
        by = np.lexsort((ids, -score, x))
        x, score, ids = x[by], score[by], ids[by]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        scores, out = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
        first = place < k
        scores[x[first], place[first]], out[x[first], place[first]] = score[first], ids[first]
        return scores, out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2 - 2 * (a @ b.T), 0, None))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, and share (compared vectors over all, of the query's block): the k nearest other rows of each row for which `queries` holds.

    Nearest is the largest cosine in double precision, ties go to the smaller id.
    A query's own row is no candidate; other rows with its vector, or even its
    id, are. Rows that are left out (see vectors.usable; zero vectors too) neither
    ask nor answer; rows with an id that is found more than once are rows like any
    others. Fewer than k candidates give all of them; none, or an empty table, give no rows.
    """
    rows, kind = usable(vectors, key, vector, {"asks": F.coalesce(queries, F.lit(False))}, nonzero=True)
    table, n_table = blocks(rows, kind, ROWS)
    asked, n_asked = blocks(rows.where("asks"), kind, QUERIES)

    def opened(data: bytes) -> Tree:
        return Tree(data, kind, k + 1)

    def work(tree: Tree, data: bytes, _: bytes | None) -> bytes:
        v, (ids, own) = unpack(data, kind, 2)
        scores, found, read = tree.search(v, own, k, factor)
        return b"".join(x.tobytes() for x in (np.array([len(ids), read, len(ids) * len(tree.v)], "<i8"), ids, scores, found))

    def opened_part(data: bytes) -> tuple[np.ndarray, ...]:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        at = 24 + 8 * n
        return np.frombuffer(data, "<i8", 2, 8), np.frombuffer(data, "<i8", n, 24), np.frombuffer(data, "<f8", n * k, at).reshape(n, k), np.frombuffer(data, "<i8", n * k, at + 8 * n * k).reshape(n, k)

    def fold(held: bytes | None, part: bytes) -> bytes:
        if held is None:
            return part
        (r1, ids, s1, f1), (r2, _, s2, f2) = opened_part(held), opened_part(part)
        scores, found = best_of(np.hstack([s1, s2]), np.hstack([f1, f2]), k)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array([len(ids), *(r1 + r2)], "<i8"), ids, scores, found))

    def rows_of(batches):
        for batch in batches:
            for data in batch["data"]:
                (read, full), ids, scores, found = opened_part(data)
                q, r = np.nonzero(scores > -np.inf)
                yield pd.DataFrame({"query_id": ids[q], "rank": (r + 1).astype(np.int32), "vec_id": found[q, r], "score": scores[q, r], "share": read / max(full, 1)})

    merged = merge(meet(table, n_table, asked, n_asked, opened, work), fold)
    return merged.mapInPandas(rows_of, "query_id long, rank int, vec_id long, score double, share double")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    pairs = exact.select("query_id", "vec_id")
    n = pairs.count()
    return found.select("query_id", "vec_id").distinct().join(pairs, ["query_id", "vec_id"]).count() / n if n else 1.0
