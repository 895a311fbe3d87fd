"""The Burrows-Wheeler transform and common prefixes of a collection, column by column in sequential external files.

Round j inserts the symbol before the suffix of length j of every document that
is that long. The transform lies in one set of files for each first symbol
(0: the end of a document; ends are told apart by the documents' order): its
symbols, the common prefix of each suffix with the one before it, and each
suffix's document and length. A round reads the files it needs from start to end
and writes them anew with the insertions. It takes as many rounds as the longest
document has bytes, so it serves collections of bounded length; the query for
repeats over whole corpora works on aligned columns instead (see suffixes).
"""

from __future__ import annotations

import os

import numpy as np

KINDS = {"symbols": np.int16, "common": np.int32, "document": np.int32, "length": np.int32}


class Files:
    """The files of each first symbol; moved counts the bytes read and written."""

    def __init__(self, folder: str):
        self.folder, self.moved = folder, 0
        os.makedirs(folder, exist_ok=True)

    def read(self, first: int, kind: str) -> np.ndarray:
        path = f"{self.folder}/{first}.{kind}"
        out = np.fromfile(path, KINDS[kind]) if os.path.exists(path) else np.zeros(0, KINDS[kind])
        self.moved += out.nbytes
        return out

    def write(self, first: int, kind: str, values: np.ndarray) -> None:
        path = f"{self.folder}/{first}.{kind}"
        values.astype(KINDS[kind]).tofile(path + ".new")
        os.replace(path + ".new", path)
        self.moved += len(values) * np.dtype(KINDS[kind]).itemsize


def symbols_before(texts: list[bytes], documents: np.ndarray, length: int) -> np.ndarray:
    """1 + the byte before the suffix of a length; 0 where the document begins."""
    return np.array([texts[d][-length - 1] + 1 if len(texts[d]) > length else 0 for d in documents], np.int64)


def build(texts: list[bytes], folder: str, rounds: int | None = None) -> tuple[Files, int]:
    """The files of a collection, and the rounds done (`rounds` at most; all by default)."""
    files = Files(folder)
    documents = np.arange(len(texts))
    bucket, place = np.zeros(len(texts), np.int64), documents.copy()
    symbol = symbols_before(texts, documents, 0)
    files.write(0, "symbols", symbol)
    for kind, values in (("common", 0 * documents), ("document", documents), ("length", 0 * documents)):
        files.write(0, kind, values)
    sizes, counts = {0: len(texts)}, {0: np.bincount(symbol, minlength=257)}
    done = 0
    while True:
        on = symbol > 0
        documents, bucket, place, symbol = documents[on], bucket[on], place[on], symbol[on]
        if not len(documents) or rounds is not None and done >= rounds:
            return files, done
        done += 1
        rank, own, following = (np.zeros(len(documents), np.int64) for _ in range(3))
        for b in np.unique(bucket).tolist():
            before = sum((counts[a] for a in sizes if a < b), np.zeros(257, np.int64))
            row, common = files.read(b, "symbols"), files.read(b, "common")
            for c in np.unique(symbol[bucket == b]).tolist():
                mine = np.flatnonzero((bucket == b) & (symbol == c))
                at = np.flatnonzero(row == c)
                k = np.searchsorted(at, place[mine])
                rank[mine] = before[c] + k
                least = np.minimum.reduceat(common[: at[-1] + 1], np.r_[0, at[:-1] + 1])  # after the occurrence before, up to each
                later = any(counts[a][c] for a in sizes if a > b)
                own[mine] = np.where(k > 0, 1 + least[k], 1 if before[c] else 0)
                following[mine] = np.where(k + 1 < len(at), 1 + least[np.minimum(k + 1, len(at) - 1)], 1 if later else 0)
        new = symbols_before(texts, documents, done)
        for c in np.unique(symbol).tolist():
            mine = np.flatnonzero(symbol == c)
            mine = mine[np.argsort(rank[mine])]
            n = sizes.get(c, 0) + len(mine)
            old = np.ones(n, bool)
            old[rank[mine]] = False
            for kind, values in (("symbols", new[mine]), ("common", own[mine]), ("document", documents[mine]), ("length", np.full(len(mine), done))):
                out = np.zeros(n, KINDS[kind])
                out[old], out[rank[mine]] = files.read(c, kind), values
                if kind == "common":
                    after = rank[mine] + 1
                    out[after[after < n]] = following[mine][after < n]
                files.write(c, kind, out)
            sizes[c] = n
            counts[c] = counts.get(c, np.zeros(257, np.int64)) + np.bincount(new[mine], minlength=257)
        bucket, place, symbol = symbol, rank, new


def repeated_starts(files: Files, texts: list[bytes], window: int) -> list[np.ndarray]:
    """For each document, the starts of windows that also start elsewhere: a neighbour in the order has them in common."""
    out: list[list[int]] = [[] for _ in texts]
    for first in range(1, 257):
        common = files.read(first, "common")
        long = common >= window
        long[:-1] |= long[1:].copy()
        for d, n in zip(files.read(first, "document")[long].tolist(), files.read(first, "length")[long].tolist()):
            out[d].append(len(texts[d]) - n)
    return [np.array(sorted(x), np.int64) for x in out]
