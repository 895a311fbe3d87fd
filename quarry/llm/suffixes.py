"""Removal of strings that repeat, by a column-wise suffix order of many documents.

A text is read as symbols: as bytes, or as units (words; long ones in pieces).
Two equal strings of `window` symbols pick the same anchor: the leftmost smallest
hash among the strings of `gram` symbols inside. Only anchors whose hash repeats matter; each
brings the symbols of the windows that pick it. The strings of an anchor are
aligned at it, so columns correspond, and the suffix order is built column by
column from the right: a round inserts one symbol of every string, sorts the
strings stably by it (the column of the collection's Burrows-Wheeler transform)
and updates the common prefixes of neighbours. A window whose common prefix with
a neighbour is a window or more is found anywhere else. Anchors found very often,
in many documents or in one, are dealt by window hashes instead, so no task
gathers them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import grouped
from quarry.llm.shared import KEY, heavy_join, keyed, materialise, release

#: An anchor found more often is searched by window hashes: a task takes about SALT of its places; their distinct hashes are merged in PARTS parts, or more where a part would have those of more than PLACES.
HOT, SALT, PARTS, PLACES = 1000, 1000, 16, 16_000
PAIR = [("h1", "<u8"), ("h2", "<u8")]
#: Strings in one column-wise construction, at least.
ROWS = 6_000
#: What parts words.
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Documents' bytes that are hashed at once.
AT_ONCE = 1 << 20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverses, modulo 2 ** 64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Roller:
    """Hashes of all strings of a length, from one sum over a text."""

    def __init__(self, seed: int):
        self.base = int.from_bytes(hashlib.sha256(b"base%d" % seed).digest()[:8], "little") | 5
        self.table = np.array([int.from_bytes(hashlib.sha256(b"%d:%d" % (seed, b)).digest()[:8], "little") for b in range(256)], np.uint64)
        self.up = self.down = np.zeros(0, np.uint64)

    def hashes(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(self.base, 1 << n.bit_length())  # for the longest part so far, not for the longest there may be
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values(data) * self.up[:n], out=total[1:])
        return mixed((total[length:] - total[:-length]) * self.down[: n - length + 1])

    def values(self, data: np.ndarray) -> np.ndarray:
        """A number for each symbol; wider ones than bytes are hashes already."""
        return self.table[data] if data.itemsize == 1 else mixed(data.astype(np.uint64) * self.table[0] + self.table[1])

    def pieces(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings between first bytes and ends."""
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(self.base, 1 << n.bit_length())
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        return mixed((total[end] - total[first]) * self.down[first])


#: The two largest primes under 2 ** 31 (fixed values).
PRIMES = (2147483647, 2147483629)


class PrimeRoller:
    """As Roller, modulo two primes, packed into 64 bits: two strings of a length n agree in both with a chance of (n / 2 ** 31) ** 2 at most, whatever they look like."""

    def __init__(self, seed: int):
        self.parts = []
        for k, p in enumerate(PRIMES):
            number = lambda what, k=k, p=p: int.from_bytes(hashlib.sha256(b"%d:%d:%d" % (seed, k, what)).digest()[:8], "little") % (p - 2) + 2
            base = number(256)
            self.parts.append((p, base, pow(base, -1, p), np.array([number(b) for b in range(256)], np.uint64)))
        self.tables = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * len(PRIMES)

    def hashes(self, data: np.ndarray, length: int) -> np.ndarray:
        n, out = len(data), None
        for k, (p, base, inverse, table) in enumerate(self.parts):
            up, down = self.tables[k]
            while len(up) < n + 1:
                step = len(up)
                up, down = (np.r_[x, x * np.uint64(pow(b, step, p)) % np.uint64(p)] for x, b in ((up, base), (down, inverse)))
            self.tables[k] = up, down
            total = np.zeros(n + 1, np.uint64)
            value = table[data] if data.itemsize == 1 else mixed(data.astype(np.uint64) * table[0] + table[1]) % np.uint64(p)
            np.cumsum(value * up[:n] % np.uint64(p), out=total[1:])
            h = (total[length:] - total[:-length]) % np.uint64(p) * down[: n - length + 1] % np.uint64(p)
            out = h if out is None else out << np.uint64(32) | h
        return out


_rollers: dict[int, Roller | PrimeRoller] = {}


def roller(seed: int) -> Roller | PrimeRoller:
    """0 chooses anchors; 1 (modulo primes) and 2 name windows; 3 names words."""
    if seed not in _rollers:
        _rollers[seed] = PrimeRoller(seed) if seed == 1 else Roller(seed)
    return _rollers[seed]


#: Words of more bytes are cut into pieces: after the bytes where a hash of the three before is a multiple of CUT, and at LONG bytes.
LONG, CUT = 16, 7


def units_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of a text's units: words, or the pieces of words of more than LONG bytes, so that texts without spaces have units as well.

    Where a word is cut depends on the bytes just before, so pieces agree wherever
    the word starts.
    """
    edges = np.diff(np.r_[True, SPACES[data], True].astype(np.int8))
    first, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    long = end - first > LONG
    if not long.any():
        return first, end
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first[long] + 3] += 1
    inside[end[long]] -= 1
    b = data.astype(np.uint32)
    gram = (b[:-3] * np.uint32(0x9E3779B1) + b[1:-2] * np.uint32(0x85EBCA77) + b[2:-1] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    cut = np.flatnonzero((gram % np.uint32(CUT) == 0) & (np.cumsum(inside)[3:-1] > 0)) + 3
    start = np.sort(np.r_[first, cut])
    stop = np.minimum(np.r_[start[1:], len(data)], end[np.searchsorted(first, start, "right") - 1])
    times = -(-(stop - start) // LONG)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    first = np.repeat(start, times) + LONG * step
    return first, np.minimum(first + LONG, np.repeat(stop, times))


def unit_codes(data: np.ndarray) -> np.ndarray:
    """32 bits of each unit's hash; computed for parts of AT_ONCE bytes and to the end of their last unit."""
    first, end = units_of(data)
    out = [np.zeros(0, "<u4")]
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first // AT_ONCE)) + 1):
        if len(part):
            at = first[part[0]]
            out.append((roller(3).pieces(data[at : end[part[-1]]], first[part] - at, end[part] - at) >> np.uint64(32)).astype("<u4"))
    return np.concatenate(out)


@dataclass(frozen=True)
class Reading:
    """Texts as symbols: how many make a window and a gram, how they are kept and what lies beyond a string, and how they are read from bytes."""

    window: int
    gram: int
    kept: str
    held: type
    pad: int
    read: Callable[[np.ndarray], np.ndarray]

    @property
    def reach(self) -> int:
        """Grams in a window; an anchor's windows start up to reach - 1 symbols before it."""
        return self.window - self.gram + 1

    @property
    def width(self) -> int:
        return self.reach - 1 + self.window


BYTES = Reading(400, 128, "u1", np.int16, 256, lambda data: data)
#: Two windows of units that differ in one word agree with a chance of 2 ** -32.
UNITS = Reading(50, 16, "<u4", np.int64, 1 << 32, unit_codes)


def anchors(data: np.ndarray, how: Reading = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: hash, place, and first and last window that picks it.

    Long texts go in parts that overlap by a window less one symbol, so that each
    window is in one part; a place that two parts pick is one anchor.
    """
    n = len(data)
    if n < how.window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    found = []
    for start in range(0, n - how.window + 1, AT_ONCE - how.window + 1):
        part = data[start : start + AT_ONCE]
        h = roller(0).hashes(part, how.gram)
        bits = np.uint64(23)
        key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        low, width = key, 1
        while 2 * width <= how.reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < how.reach:
            low = np.minimum(low[: len(low) - (how.reach - width)], low[how.reach - width :])
        place = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        at = place[first]
        found.append((h[at], at + start, first + start, last + start))
    h, place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.r_[True, place[1:] != place[:-1]]
    return h[new], place[new], first[new], last[np.r_[new[1:], True]]


def windows_of(batch: pd.DataFrame) -> Iterator[tuple]:
    for row in batch.itertuples(index=False):
        yield row, np.frombuffer(row.text.encode(), np.uint8)


def profile(texts: DataFrame, how: Reading) -> DataFrame:
    """For each row: doc_id, KEY, n_bytes, n (symbols), sha256, its anchors' hashes, and how often each is found in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, data in windows_of(batch):
                symbols = how.read(data)
                fps, n = np.unique(anchors(symbols, how)[0].astype(np.int64), return_counts=True)
                out.append((row.doc_id, row.d, row.k1, row.k2, len(data), len(symbols), hashlib.sha256(data).hexdigest(), fps, n))
            names = ["doc_id", *KEY, "n_bytes", "n", "sha256", "fps", "times"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return texts.mapInPandas(run, "doc_id long, d string, k1 long, k2 long, n_bytes long, n long, sha256 string, fps array<long>, times array<long>")


def contexts(texts: DataFrame, how: Reading) -> DataFrame:
    """For each place of a plain anchor: fp, rid, its distance from the first window that picks it, that window's start, and the windows' symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for row, data in windows_of(batch):
                data = how.read(data)
                fp, place, first, last = anchors(data, how)
                fp = fp.astype(np.int64)
                plain = np.isin(fp, np.asarray(row.plain, np.int64))
                for f, p, a, b in zip(fp[plain].tolist(), place[plain].tolist(), first[plain].tolist(), last[plain].tolist()):
                    out.append((f, row.rid, p - a, a, data[a : b + how.window].tobytes()))
                    held += len(out[-1][-1])
                if held > 8 << 20:
                    yield frame(out)
                    out, held = [], 0
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["fp", "rid", "lead", "start", "data"])

    return texts.where("size(plain) > 0").mapInPandas(run, "fp long, rid long, lead int, start int, data binary")


#: Windows in a cell of packed hashes, at most.
CELL = 1 << 17


def window_hashes(texts: DataFrame, how: Reading) -> DataFrame:
    """For each document and hot anchor: fp, rid, and packed hashes and starts of the windows that pick it, CELL at most in a row."""

    def packed_windows(row: tuple, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, _, first, last = anchors(data, how)
        fp = fp.astype(np.int64)
        hot = np.isin(fp, np.asarray(row.hot, np.int64))
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[hot], last[hot])])
        packed = np.zeros(len(starts), [*PAIR, ("s", "<i4")])
        for seed, name in ((1, "h1"), (2, "h2")):
            for k in range(0, len(data) - how.window + 1, AT_ONCE - how.window + 1):
                part = data[k : k + AT_ONCE]
                inside = (starts >= k) & (starts <= k + len(part) - how.window)
                packed[name][inside] = roller(seed).hashes(part, how.window)[starts[inside] - k]
        packed["s"] = starts
        return np.repeat(fp[hot], (last - first + 1)[hot]), packed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for row, data in windows_of(batch):
                which, packed = packed_windows(row, how.read(data))
                order = np.argsort(which, kind="stable")
                packed, which = packed[order], which[order]
                for group in np.split(np.arange(len(which)), np.flatnonzero(np.diff(which)) + 1):
                    for a in range(group[0], group[-1] + 1, CELL):
                        out.append((int(which[a]), row.rid, packed[a : min(a + CELL, group[-1] + 1)].tobytes()))
                        held += len(out[-1][-1])
                        if held > 32 << 20:
                            yield pd.DataFrame(out, columns=["fp", "rid", "data"])
                            out, held = [], 0
            yield pd.DataFrame(out, columns=["fp", "rid", "data"])

    return texts.where("size(hot) > 0").mapInPandas(run, "fp long, rid long, data binary")


def runs_of(h1: np.ndarray, h2: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash pair (then by others), and the starts of equal pairs in it."""
    order = np.lexsort((*then, h2, h1))
    a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def hot_search(windows: DataFrame, most: int, how: Reading) -> DataFrame:
    """(rid, spans) of windows (fp, rid, data) whose hash is found twice or more; equal windows have one anchor.

    No anchor is found more than `most` times. Its rows are dealt over most / SALT tasks. Each gives its distinct hashes
    and whether they repeat in it; lists are merged by parts of the hashes; each
    task gets back those of its hashes that repeat anywhere, and marks its windows.
    """
    salts, n_parts = -(-most // SALT), max(PARTS, -(-most // PLACES))
    dealt = windows.select("fp", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "rid", "data")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["fp", "salt"]):
            packed = np.frombuffer(b"".join(group["data"]), [*PAIR, ("s", "<i4")])
            order, at = runs_of(packed["h1"], packed["h2"])
            some = np.zeros(len(at), [*PAIR, ("n", "u1")])
            some["h1"], some["h2"] = packed["h1"][order[at]], packed["h2"][order[at]]
            some["n"] = np.minimum(np.diff(np.r_[at, len(order)]), 2)
            part = (some["h2"] % np.uint64(n_parts)).astype(np.int64)
            parts = np.unique(part)
            yield pd.DataFrame({"fp": group["fp"].iloc[0], "part": parts, "salt": group["salt"].iloc[0], "data": [some[part == k].tobytes() for k in parts]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["fp", "part"]):
            data = group["data"].tolist()
            some = np.frombuffer(b"".join(data), [*PAIR, ("n", "u1")])
            order, at = runs_of(some["h1"], some["h2"])
            total = np.add.reduceat(some["n"][order].astype(np.int64), at)
            often = np.zeros(len(some), bool)
            often[order] = np.repeat(total > 1, np.diff(np.r_[at, len(order)]))
            pairs = np.zeros(len(some), PAIR)
            pairs["h1"], pairs["h2"] = some["h1"], some["h2"]
            ends = np.cumsum([len(x) // some.itemsize for x in data])
            lists = [pairs[a:b][often[a:b]].tobytes() for a, b in zip(np.r_[0, ends], ends)]
            yield pd.DataFrame({"fp": group["fp"], "salt": group["salt"], "kind": 0, "rid": 0, "data": lists})

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["fp", "salt"]):
            first = (group["kind"] == 0).to_numpy()
            known = np.frombuffer(b"".join(group["data"][first]), PAIR)
            own = group[~first]
            data = own["data"].tolist()
            packed = np.frombuffer(b"".join(data), [*PAIR, ("s", "<i4")])
            is_own = np.r_[np.zeros(len(known), bool), np.ones(len(packed), bool)]
            order, at = runs_of(np.r_[known["h1"], packed["h1"]], np.r_[known["h2"], packed["h2"]], is_own)
            hit = np.zeros(len(order), bool)
            hit[order] = np.repeat(~is_own[order[at]], np.diff(np.r_[at, len(order)]))
            hit = np.flatnonzero(hit[len(known) :])
            if not len(hit):
                continue
            owner, rids, out = np.repeat(np.arange(len(data)), [len(x) // packed.itemsize for x in data]), own["rid"].to_numpy(), []
            for part in np.split(hit, np.flatnonzero(np.diff(owner[hit])) + 1):
                s = np.sort(packed["s"][part])
                out.append((rids[owner[part[0]]], union_of([np.stack([s, s + how.window], axis=1).astype("<i4").tobytes()]).astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["rid", "spans"])

    by_task = dealt.repartition("fp", "salt").sortWithinPartitions("fp", "salt")
    lists = by_task.select("fp", "salt", "data").mapInPandas(distinct, "fp long, part int, salt int, data binary")
    often = lists.repartition("fp", "part").sortWithinPartitions("fp", "part").mapInPandas(merged, "fp long, salt int, kind int, rid long, data binary")
    both = dealt.union(often).repartition("fp", "salt").sortWithinPartitions("fp", "salt", "kind")
    return both.mapInPandas(marked, "rid long, spans binary")


def column_wise(group: np.ndarray, strings: np.ndarray, own: np.ndarray, how: Reading = BYTES) -> np.ndarray:
    """For strings (rows) in columns, sorted by group: which of the first `reach` columns starts a window found in another string of the group.

    From the last column to the first: `order` holds the strings sorted by
    group and suffix, `common` the common prefix of each with the one before.
    """
    n = len(strings)
    order, common = np.arange(n), np.zeros(n, np.int32)
    repeats = np.zeros((n, how.reach), bool)
    columns = np.ascontiguousarray(strings.T)
    base = group.astype(np.int64) * (how.pad + 1)
    for c in range(how.width - 1, -1, -1):
        symbol = columns[c]
        key = (base + symbol)[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.r_[False, key[1:] == key[:-1]] & (symbol[order[moved]] != how.pad)
        right = np.flatnonzero(same)
        fresh = np.zeros(n, np.int32)
        if len(right):
            a, b = moved[right - 1], moved[right]
            value = common[b]
            far = np.flatnonzero(b - a > 1)
            if len(far):
                bounds = np.empty(2 * len(far), np.int64)
                bounds[::2], bounds[1::2] = a[far] + 1, b[far] + 1
                value[far] = np.minimum.reduceat(np.r_[common, np.int32(0)], bounds)[::2]
            fresh[right] = value + 1
        order, common = order[moved], fresh
        if c < how.reach:
            long = common >= how.window
            long[:-1] |= long[1:]
            repeats[order[long], c] = True
    return repeats & own


def search(rows: DataFrame, how: Reading) -> DataFrame:
    """(rid, spans): packed (from, to) symbols that repeated windows cover."""

    def plain(batch: pd.DataFrame) -> list[tuple[int, bytes]]:
        fp = batch["fp"].to_numpy()
        size = pd.Series(fp).groupby(fp).transform("size").to_numpy()
        batch, fp = batch[size > 1], fp[size > 1]
        n = len(batch)
        if not n:
            return []
        group = np.cumsum(np.r_[0, fp[1:] != fp[:-1]])
        left = how.reach - 1 - batch["lead"].to_numpy()
        data = [np.frombuffer(x, how.kept) for x in batch["data"]]
        lengths = np.fromiter(map(len, data), np.int64, n)
        strings = np.full((n, how.width), how.pad, how.held)
        for row, at, own in zip(strings, left.tolist(), data):
            row[at : at + len(own)] = own
        c = np.arange(how.reach)
        own = (c >= left[:, None]) & (c <= (left + lengths - how.window)[:, None])
        found = column_wise(group, strings, own, how)
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r1, c1 = np.nonzero(edges == 1)
        _, c2 = np.nonzero(edges == -1)
        if not len(r1):
            return []
        shift = batch["start"].to_numpy() - left
        spans = np.stack([shift[r1] + c1, shift[r1] + c2 - 1 + how.window], axis=1).astype("<i4")
        rids = batch["rid"].to_numpy()
        cut = np.flatnonzero(np.diff(r1)) + 1
        return [(rids[r1[k]], s.tobytes()) for k, s in zip(np.r_[0, cut], np.split(spans, cut))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            yield pd.DataFrame(plain(part), columns=["rid", "spans"]).astype({"rid": "int64"})

    return rows.repartition("fp").sortWithinPartitions("fp").mapInPandas(run, "rid long, spans binary")


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of ROWS rows or more that hold whole groups of fp."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < ROWS:
            continue
        part = pd.concat(held, ignore_index=True)
        other = np.flatnonzero((part["fp"] != part["fp"].iloc[-1]).to_numpy())
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield part.iloc[:cut]
        held, n = [part.iloc[cut:]], len(part) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def union_of(spans: list[bytes]) -> np.ndarray:
    """Sorted, disjoint, not touching (from, to) rows."""
    x = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1])
    first = np.r_[True, x[1:, 0] > end[:-1]]
    at = np.flatnonzero(first)
    return np.stack([x[at, 0], end[np.r_[at[1:], len(x)] - 1]], axis=1)


def repeated(docs: DataFrame, how: Reading) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows, cut, tables that cut alone needs). rows: doc_id, KEY, rid (a number of its own), n_bytes, n (symbols), sha256 of each document and whole (all of it repeats).

    cut: for each rid of which a part repeats, its text and spans, the lists of
    packed (from, to) symbols. Documents of equal text count as copies: if they
    have a window or more, all of them repeat, and only one is searched.
    """
    own = keyed(docs.select("doc_id", "text"))
    rows = materialise(profile(own, how).withColumn("rid", F.monotonically_increasing_id()), "profiles")  # numbered once, as it is written
    many = materialise(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("rid").alias("one")).where("copies > 1"), "copies")
    marked = heavy_join(rows.select("doc_id", *KEY, "rid", "n_bytes", "n", "sha256"), many, ["k1", "k2"], "copies", "left")
    light = marked.select("doc_id", *KEY, "rid", "n_bytes", "n", "sha256", (F.col("copies").isNotNull() & (F.col("n") >= how.window)).alias("whole"))
    fps = rows.select(F.explode(F.arrays_zip("fps", "times")).alias("f"), "k1").groupBy(F.col("f.fps").alias("fp")).agg(
        F.min("k1").alias("least"), F.max("k1").alias("most"), F.sum("f.times").alias("n"), F.max("f.times").alias("in_one"))
    shared = fps.where("least <> most or in_one > 1").select("fp", (F.col("n") > HOT).alias("hot"), "n")
    shared = materialise(shared, "anchors")
    most = shared.where("hot").agg(F.max("n")).first()[0]
    one = heavy_join(rows.where(f"n >= {how.window}").select("rid", *KEY, "fps"), many, ["k1", "k2"], "copies", "left").where("one is null or one = rid")
    todo = one.select("rid", *KEY, F.explode("fps").alias("fp")).join(shared, "fp").groupBy("rid", *KEY).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("fp"))).alias("plain"), F.collect_set(F.when(F.col("hot"), F.col("fp"))).alias("hot"))
    texts = materialise(own.select(*KEY, "text").join(todo, KEY).drop(*KEY), "texts", "zstd")
    release(shared)
    spans = search(contexts(texts, how), how)
    if most:
        windows = materialise(window_hashes(texts, how), "windows")
        spans = spans.union(hot_search(windows, most, how))
    found = spans.groupBy("rid").agg(F.collect_list("spans").alias("spans"))
    found = materialise(found, "spans")
    if most:
        release(windows)
    partial = found.join(light.where("not whole").select("rid"), "rid", "left_semi")
    cut = texts.select("rid", "text").join(partial, "rid")
    return light, cut, [texts, found]


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def passage_words(docs: DataFrame) -> DataFrame:
    """KEY and n_passage_words of the rows of which some units stand in passages of 50 or more that stand elsewhere too: how many do."""
    light, cut, used = repeated(docs, UNITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unions = [union_of(list(spans)) for spans in batch["spans"]]
            yield pd.DataFrame({"rid": batch["rid"], "words": [int((u[:, 1] - u[:, 0]).sum()) for u in unions]})

    parts = cut.select("rid", "spans").mapInPandas(run, "rid long, words long").dropDuplicates(["rid"])
    words = F.when(F.col("whole"), F.col("n")).otherwise(F.col("words"))
    out = light.join(parts, "rid", "left").where("whole or words is not null").groupBy(*KEY).agg(F.max(words).alias("n_passage_words"))
    out = materialise(out, "passages")
    release(*used)
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words for every row.

    Removed is each byte that a string of 400 bytes covers which also starts
    elsewhere, in this document or another. n_passage_words counts the words (of
    long ones the pieces) in passages of 50 or more that stand elsewhere too,
    however few their bytes; they are told, not removed. A null text is empty.
    Repeated rows are copies of each other. An empty table gives no rows.
    """
    light, cut, used = repeated(docs, BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text, spans in zip(batch["rid"], batch["text"], batch["spans"]):
                union = union_of(list(spans))
                kept = kept_bytes(text.encode(), union)
                out.append((rid, int((union[:, 1] - union[:, 0]).sum()), len(union), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["rid", "cut_bytes", "cut_spans", "cut_sha256"])

    parts = materialise(cut.mapInPandas(run, "rid long, cut_bytes long, cut_spans long, cut_sha256 string").dropDuplicates(["rid"]), "parts")
    release(*used)
    words = passage_words(docs)
    whole = F.col("whole")
    nothing = hashlib.sha256(b"").hexdigest()
    return light.join(parts, "rid", "left").join(words, KEY, "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("cut_bytes", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"),
    )


def without_repeats(docs: DataFrame, how: Reading = BYTES) -> DataFrame:
    """docs with what repeats gone from text: strings of 400 bytes (BYTES), or passages of 50 words (UNITS), that stand elsewhere too.

    With UNITS the white space between two words that go goes too. A character of
    which only a part is left goes too. A null text stays null; documents of equal
    text with a window or more have an empty one left. An empty table gives no rows.
    """
    light, cut, _ = repeated(docs, how)

    def in_bytes(data: bytes, spans: np.ndarray) -> np.ndarray:
        if how.kept == "u1":
            return spans
        first, end = units_of(np.frombuffer(data, np.uint8))
        return np.stack([first[spans[:, 0]], end[spans[:, 1] - 1]], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch["text"], batch["spans"]):
                data = text.encode()
                kept.append(kept_bytes(data, in_bytes(data, union_of(list(spans)))).decode(errors="ignore"))
            yield pd.DataFrame({"rid": batch["rid"], "kept": kept})

    parts = cut.mapInPandas(run, "rid long, kept string").dropDuplicates(["rid"])
    changed = light.join(parts, "rid", "left").where("whole or kept is not null").groupBy(*KEY).agg(F.max(F.when(~F.col("whole"), F.col("kept"))).alias("kept"))
    changed = materialise(changed.select(*KEY, F.coalesce("kept", F.lit("")).alias("kept")), "changed", "zstd")
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # docs may have columns of the key's names
    rows = keyed(docs.select("*", F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).toDF(*own.values(), "doc_id", "text"), whole=False)
    joined = rows.drop("text").join(changed, KEY, "left")
    return joined.select(*[(F.coalesce("kept", F.col(new)) if c == "text" else F.col(new)).alias(c) for c, new in own.items()])
