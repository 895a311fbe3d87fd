"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: items above a third of the capacity pair at most twice a bin by greedy
matching; smaller ones best-fit into the gaps that are left. All of it is done
on the histogram of lengths, which has at most `capacity` entries however many
documents there are; a piece then finds its place by its rank among the pieces
of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import globally_ordered, materialise, whole_texts

CACHE = 400_000
#: More than one white-space character in a row; then whole-text splitting is used.
RUN = re.compile(r"\s\s")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Ids of a byte-level BPE file, kept by word as little-endian 32-bit bytes.

    Its splitting pattern never joins a character to a following space, and a
    line feed between two other characters stands alone, so words between
    single spaces and line feeds can be encoded one by one.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = bytes_of_letters()
        ranks = {bytes(plain[c] for c in w): i for w, i in spec["model"]["vocab"].items() if all(c in plain for c in w)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s in special:
            ranks.pop(s.encode(), None)
        pre = spec["pre_tokenizer"]
        assert pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True), "another kind of tokenizer"
        self.special = tuple(special)
        self.bpe = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        self.path = path
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.line_feed = self._plain("\n")

    @cached_property
    def whole(self):
        """The library's tokenizer, for texts with special strings."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Drop the words seen so far: workers live longer than tasks."""
        self.first.clear()
        self.spaced.clear()

    def _plain(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _parts(self, words: list[str], known: dict[str, bytes], lead: str) -> list[bytes]:
        try:
            return [known[w] for w in words]
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in words:
            if (got := known.get(w)) is None:
                got = self._plain(lead + w) if w else b""
                if len(w) <= 64:
                    known[w] = got
            out.append(got)
        return out

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            import numpy as np

            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if RUN.search(text) or text[:1].isspace() or text[-1:].isspace():
            return self._plain(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_feed)
            head, *rest = line.split(" ")
            out += self._parts([head], self.first, "")
            if rest:
                out += self._parts(rest, self.spaced, " ")
        return b"".join(out)


#: The public splitting pattern of byte-level BPE (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: printable Latin-1 ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Each document's ids, then end_id; longer ones in pieces of `capacity`, of which the first may be shorter."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = byte_bpe(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = bpe.ids(text) + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    upto = at + ((n - at) % capacity or capacity)
                    out.append((doc_id, k, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto])))
                    at, k = upto, k + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        bpe.forget()

    return whole_texts(docs).mapInPandas(pieces, PIECES)


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for counts[length] items of each length, and the number of bins.

    A place is (length, first rank, how many, first bin, offset): item first
    rank + i goes into first bin + i. Runs of equal items and of equal bins are
    placed at once.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first bin, how many)
    order: list[int] = []  # gaps with bins, ascending
    bins = 0

    def place(s: int, n: int, first_bin: int, offset: int) -> None:
        places.append((s, used[s], n, first_bin, offset))
        used[s] += n
        left[s] -= n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first_bin, n))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    ascending = large[::-1]
    for s in large:
        while left[s] > 0:
            k = bisect_left(ascending, min(capacity - s, s) + 1) - 1
            while k >= 0 and (left[ascending[k]] <= 0 or ascending[k] == s and left[s] < 2):
                k -= 1
            if k < 0:
                n, partner = left[s], 0
            else:
                partner = ascending[k]
                n = left[s] // 2 if partner == s else min(left[s], left[partner])
            place(s, n, bins, 0)
            if partner:
                place(partner, n, bins, s)
            leave(capacity - s - partner, bins, n)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s] > 0:
            k = bisect_left(order, s)
            if k < len(order):
                gap = order[k]
                first_bin, have = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
            else:
                gap, first_bin, have = capacity, bins, -(-left[s] // (capacity // s))
                bins += have
            fit = gap // s
            n = min(have, left[s] // fit)
            if n:
                each = fit
            else:
                n, each = 1, left[s]
            for i in range(each):
                place(s, n, first_bin, capacity - gap + i * s)
            leave(gap - each * s, first_bin, n)
            leave(gap, first_bin + n, have - n)
    return places, bins


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), each of 1 to capacity tokens.

    Ties among equal lengths go by doc_id and piece. The table of places has at
    most a few entries for each length and gap, so it is bounded by the capacity.
    """
    spark = pieces.sparkSession
    rows, _ = globally_ordered(pieces, "length", "doc_id", "piece")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, first = 0, []
    for s in sorted(lengths):
        first.append((s, before))
        before += lengths[s]
    places, _ = packing_plan(lengths, capacity)
    start = dict(first)
    table = spark.createDataFrame([(s, start[s] + r, start[s] + r + n, b, o) for s, r, n, b, o in places], "length long, row_from long, row_to long, bin long, offset long")
    at = rows.alias("r").join(F.broadcast(table).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("r.row") >= F.col("p.row_from")) & (F.col("r.row") < F.col("p.row_to")))
    return at.select("r.*", (F.col("p.bin") + F.col("r.row") - F.col("p.row_from")).alias("sequence_id"), F.col("p.offset").alias("offset")).drop("row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the method finds.

    A null text counts as empty: one piece of the end id. Repeated rows are
    packed once each; a null doc_id is carried; an empty table gives no rows.
    """
    return pack(materialise(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
