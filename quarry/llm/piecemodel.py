"""Piece models (BPE with byte fallback): counting, encoding with source offsets, decoding.

The model file is read here; merges run on ragged numpy arrays for all words of
a batch at once: each round applies every sequence's lowest-ranked pair.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.shared import whole_texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_RANK = np.int64(1) << 40
CACHE = 400_000
#: Words up to so many characters are remembered between batches.
SHORT = 64


def fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: (number, int or float or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, buf[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", buf[at : at + 4])[0]
            at += 4
        elif kind == 1:
            yield key >> 3, struct.unpack("<d", buf[at : at + 8])[0]
            at += 8
        else:
            raise ValueError(f"wire type {kind}")


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings and the strings that replace them."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.strings = compiled[4 + size :]
        self.starts = np.zeros(256, bool)  # first bytes of keys
        if self.units:
            base = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
            self.starts[[b for b in range(256) if base ^ b < len(self.units) and self.units[base ^ b] & 0x800000FF == b]] = True

    def longest_prefix(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that data has at `at`, and the key's length."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        value, length = found
        return self.strings[value : self.strings.index(b"\0", value)], length


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        charsmap, self.dummy_prefix, self.strip_spaces, self.escape = b"", True, True, True
        kind_of_model, byte_fallback = 1, False
        self.unk_surface = " ⁇ "
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                kind_of_model, byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
                self.unk_surface = spec[44].decode() if 44 in spec else self.unk_surface
            elif number == 3:
                spec = dict(fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.strip_spaces, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind_of_model != 2 or not byte_fallback or not self.escape or USER_DEFINED in self.kinds:
            raise ValueError("only BPE models with byte fallback and escaped spaces, without user-defined pieces, are handled")
        self.map = CharacterMap(charsmap)
        self.plain = not charsmap and not self.strip_spaces
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self._tables(scores)
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.counts: dict[str, int] = {}
        self.known: dict[str, tuple[int, str, str, bool, bytes]] = {}

    def _tables(self, scores: list[float]) -> None:
        """Symbols are the normal pieces and their characters; for each pair of symbols that spells a piece: that piece's symbol."""
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        names = list(self.ids)
        names += sorted({c for p in names for c in p} - set(names))
        self.symbol = {p: k for k, p in enumerate(names)}
        self.names = names
        self.symbol_id = np.array([self.ids.get(p, -1) for p in names])
        by_score = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = np.array([by_score[scores[self.ids[p]]] if p in self.ids else NO_RANK for p in names], np.int64)
        shared = np.bincount(self.rank[self.rank < NO_RANK])
        self.shown = [str(self.ids.get(p, -1)) for p in names]
        self.surfaces = [p.replace(SPACE, " ") for p in names]
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for p, k in self.symbol.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = k
        pairs: dict[int, int] = {}
        # One piece may spell another's end before it is made itself; then pairs go one at a time, from the left.
        self.careful = np.array([r < NO_RANK and shared[r] > 1 for r in self.rank])
        n = len(names)
        for p, k in self.symbol.items():
            if p not in self.ids:
                continue
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                for part in (a, b):
                    if part is not None and self.rank[k] < self.rank[part] < NO_RANK:
                        self.careful[part] = True
                if a is not None and b is not None:
                    pairs[a * n + b] = k
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_symbol = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair spells, or -1."""
        keys = left * len(self.names) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_symbol[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that survive in all words, the characters that each covers, and how many each word has.

        Characters that no piece has are -1. A round finds each word's lowest
        rank and joins all its pairs of that rank together, the left one first
        where two overlap; words in which nothing more can be joined leave.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        syms = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        spans = np.ones(len(syms), np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        joined = np.full(len(syms), -1, np.int64)
        if len(syms) > 1:
            joined[:-1] = np.where(word[:-1] == word[1:], self._join(syms[:-1], syms[1:]), -1)
        while len(syms):
            ranks = np.where(joined >= 0, self.rank[joined], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(ranks, starts)
            if (over := best == NO_RANK).any():
                gone = np.repeat(over, sizes)
                done.append((syms[gone], spans[gone], word[gone]))
                syms, spans, word, joined, ranks = (x[~gone] for x in (syms, spans, word, joined, ranks))
                if not len(syms):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                sizes, best = np.diff(np.r_[starts, len(word)]), best[~over]
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            run = np.r_[True, np.diff(at) != 1] | first
            place = np.arange(len(at))
            odd = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 1
            alone = self.careful[joined[at]] | self.careful[joined[at[np.maximum.accumulate(np.where(first, place, 0))]]]
            at = at[np.where(alone, first, ~odd)]
            syms[at] = joined[at]
            spans[at] += spans[at + 1]
            keep = np.ones(len(syms), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            syms, spans, word, joined = syms[keep], spans[keep], word[keep], joined[keep]
            near = np.zeros(len(syms), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            again = np.flatnonzero(near)
            joined[again] = -1
            again = again[again + 1 < len(syms)]
            again = again[word[again] == word[again + 1]]
            joined[again] = self._join(syms[again], syms[again + 1])
        if done:
            syms, spans, word = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(word, kind="stable")
            syms, spans, word = syms[order], spans[order], word[order]
        return syms, spans, np.bincount(word, minlength=len(words))

    def encode_words(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each normalised word its ids, and for each id the characters it starts a new symbol with (bytes after the first: 0)."""
        syms, spans, sizes = self.merge(words)
        out, k = [], 0
        symbol_id, syms, spans = self.symbol_id, syms.tolist(), spans.tolist()
        for w, n in zip(words, sizes.tolist()):
            ids, chars, at = [], [], 0
            for s, c in zip(syms[k : k + n], spans[k : k + n]):
                i = symbol_id[s] if s >= 0 else -1
                if i >= 0:
                    ids.append(int(i))
                    chars.append(c)
                else:
                    raw = w[at : at + c].encode()
                    ids += [self.byte_id[b] for b in raw]
                    chars += [c] + [0] * (len(raw) - 1)
                at += c
            k += n
            out.append((ids, chars))
        return out

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its characters (and the end) the byte of the source where it starts.

        At each place the longest prefix that the compiled map knows is
        replaced; a character that it doesn't know stays. Prefixes are looked up
        where a key's first byte stands; what lies between is taken over whole.
        """
        if self.strip_spaces:
            return self.stripped(text)
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero(raw & 0xC0 != 0x80)
        out: list[str] = []
        source: list[np.ndarray] = []
        at = k = 0  # byte, and its character
        for c in np.flatnonzero(self.map.starts[raw[starts]]).tolist():
            if c < k or (hit := self.map.longest_prefix(data, int(starts[c]))) is None:
                continue
            out.append(text[k:c])
            source.append(starts[k:c])
            at = int(starts[c])
            new = hit[0].decode(errors="replace")
            out.append(new)
            source.append(np.full(len(new), at))
            at += hit[1]
            k = int(np.searchsorted(starts, at))
        out.append(text[k:])
        source.append(starts[k:])
        normal, places = "".join(out), np.concatenate(source)
        if data and self.dummy_prefix:
            normal, places = " " + normal, np.r_[0, places]
        return normal.replace(" ", SPACE), np.r_[places, len(data)]

    def stripped(self, text: str) -> tuple[str, np.ndarray]:
        """normalise() for models that strip spaces at the ends and join those in a row."""
        data = text.encode()
        out: list[str] = []
        source: list[int] = []
        at, n = 0, len(data)

        def step(at: int) -> tuple[str, int]:
            if (hit := self.map.longest_prefix(data, at)) is not None:
                return hit[0].decode(errors="replace"), hit[1]
            b = data[at]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return data[at : at + width].decode(), width

        if self.strip_spaces:
            while at < n:
                new, width = step(at)
                if new.strip(" "):
                    break
                at += width
        if at < n and self.dummy_prefix:
            out.append(SPACE)
            source.append(at)
        after_space = self.strip_spaces
        while at < n:
            new, width = step(at)
            if after_space and self.strip_spaces:
                new = new.lstrip(" ")
            for c in new:
                out.append(SPACE if c == " " else c)
                source.append(at)
            if new:
                after_space = new[-1] == " "
            at += width
        if self.strip_spaces:
            while out and out[-1] == SPACE and len(out) > self.dummy_prefix:
                out.pop()
                source.pop()
            if out == [SPACE]:
                out, source = [], []
        return "".join(out), np.array([*source, n])

    def projected(self, chars: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to of each id's source bytes. chars: the characters that it starts a new symbol with (bytes after the first: 0)."""
        head = np.flatnonzero(chars)
        if not len(head):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.cumsum(chars[head])
        if head[0] or end[-1] != len(source) - 1:
            raise ValueError("pieces do not cover the normalised text")
        low, high, width = source[end - chars[head]], source[end], np.diff(np.r_[head, len(chars)])
        if len(head) == len(chars):
            return low, high
        symbol = np.repeat(np.arange(len(head)), width)
        apart = ((width > 1) & (high - low == width))[symbol]  # a byte for each id
        inside = np.arange(len(chars)) - head[symbol]
        return np.where(apart, low[symbol] + inside, low[symbol]), np.where(apart, low[symbol] + inside + 1, high[symbol])

    def split(self, normal: str) -> list[str]:
        """Words of a normalised text, which can be merged apart from each other."""
        return WORD.findall(normal) if self.separable else [normal] if normal else []

    def words_of(self, text: str) -> list[str]:
        """Normalised words: no piece has a space after another character, so words can be merged apart from each other."""
        if not text:
            return []
        if self.plain:
            text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        else:
            text = self.normalise(text)[0]
        return WORD.findall(text) if self.separable else [text]

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and for each id the bytes (from, to) of the source that it stands for."""
        normal, source = self.normalise(text)
        ids: list[int] = []
        chars: list[int] = []
        for got, some in self.encode_words(self.split(normal)):
            ids += got
            chars += some
        low, high = self.projected(np.array(chars, np.int64), source)
        return ids, list(zip(low.tolist(), high.tolist()))

    def surface(self, ids: list[int]) -> str:
        """The text of ids, as it stands inside a text."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[at : at + width]).decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            if (b := self.id_byte.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                flush()
            if self.kinds[i] == UNKNOWN:
                out.append(self.unk_surface)
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def leads(self, i: int) -> bool:
        return self.kinds[i] == NORMAL and self.pieces[i].startswith(SPACE)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.leads(first) and (self.dummy_prefix or self.strip_spaces) else text

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text: symbols that survive; a character that no piece has counts its bytes."""
        split = [self.words_of(t) for t in texts]
        known = self.counts
        if len(known) > CACHE:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        long: dict[str, int] = {}
        if new:
            syms, _, sizes = self.merge(new)
            own = (syms >= 0) & (self.symbol_id[syms] >= 0)
            if not own.all():
                odd = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(~own), "right"))
                sizes[odd] = [len(ids) for ids, _ in self.encode_words([new[k] for k in odd])]
            for w, n in zip(new, sizes.tolist()):
                (known if len(w) <= SHORT else long)[w] = n
        return [sum([known[w] if w in known else long[w] for w in words]) if long else sum(map(known.__getitem__, words)) for words in split]

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[tuple], tuple[np.ndarray, np.ndarray]]]:
        """For each text its words (number of ids, ids joined by commas, surface, whether it leads, characters of each id), and from and to of each id's source bytes."""
        normal = [self.normalise(t) for t in texts]
        split = [self.split(n) for n, _ in normal]
        known = self.known
        if len(known) > CACHE // 3:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        long: dict[str, tuple[int, str, str, bool, bytes]] = {}
        syms, spans, sizes = self.merge(new)
        own = (syms >= 0) & (self.symbol_id[syms] >= 0)
        ends = np.cumsum(sizes)
        odd = set(np.searchsorted(ends, np.flatnonzero(~own), "right").tolist())
        spans, wide = spans.astype("<i4").tobytes(), 4
        syms, k = syms.tolist(), 0
        for i, (w, end) in enumerate(zip(new, ends.tolist())):
            if i in odd:
                ids, chars = self.encode_words([w])[0]
                got = len(ids), ",".join(map(str, ids)), self.surface(ids), self.leads(ids[0]), np.array(chars, "<i4").tobytes()
            else:
                part = syms[k:end]
                got = end - k, ",".join([self.shown[x] for x in part]), "".join([self.surfaces[x] for x in part]), self.names[part[0]][0] == SPACE, spans[k * wide : end * wide]
            (known if len(w) <= SHORT else long)[w] = got
            k = end
        for words, (_, source) in zip(split, normal):
            parts = [known[w] if w in known else long[w] for w in words] if long else list(map(known.__getitem__, words))
            yield parts, self.projected(np.frombuffer(b"".join([p[4] for p in parts]), "<i4"), source)

    def forget(self) -> None:
        """Drop the words seen so far: workers live longer than tasks."""
        self.counts.clear()
        self.known.clear()

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids joined by commas and of the decoded text, for each text."""
        out = []
        for parts, (low, _) in self.encoded(texts):
            text = "".join([p[2] for p in parts])
            if parts and parts[0][3] and (self.dummy_prefix or self.strip_spaces):
                text = text[1:]
            ids = ",".join([p[1] for p in parts])
            out.append((len(low), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out


LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
REST = f"[^{LATIN}{SPACE}\n]"
LETTERS = rf"(?:[{LATIN}]+(?:(?![{LATIN}])\w{REST}*)?)"
#: Words end before a space, around a line feed, and between a Latin letter and a sign.
WORD = re.compile(rf"{SPACE}+{REST}*{LETTERS}*|{REST}+{LETTERS}*|{LETTERS}+|\n")
#: A piece with one of these would forbid it.
CUT = re.compile(rf"\n|[{LATIN}][^\w{SPACE}]")

_loaded: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _loaded:
        model = PieceModel(path)
        model.separable &= not any(CUT.search(p) for p in model.ids)
        _loaded[path] = model
    return _loaded[path]


#: Characters of text that are handled at once.
AT_ONCE = 2_000_000


def in_parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of about AT_ONCE characters."""
    group = (batch["text"].str.len().cumsum() // AT_ONCE).to_numpy()
    for _, part in batch.groupby(group, sort=False):
        yield part


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Whole texts, without begin and end ids; a null text counts as empty (0
    tokens); strings such as <s> inside a text are ordinary text. Repeated rows
    and null ids are carried; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_model(model)
        for batch in batches:
            for part in in_parts(batch):
                texts = part["text"].tolist()
                n = np.array(pieces.count_all(texts), np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit})
        pieces.forget()

    return whole_texts(docs).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row, of the whole text's ids and of their decoding.

    Null text: empty, no ids. Repeated rows and null ids are carried; an empty
    table gives no rows.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_model(model)
        for batch in batches:
            for part in in_parts(batch):
                got = pieces.digests(part["text"].tolist())
                n, ids, text = zip(*got)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text})
        pieces.forget()

    return whole_texts(docs).mapInPandas(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_spans(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, and for each id the bytes of the source text that it stands for (array of from and to).

    A null or empty text has no ids; repeated rows are rows of their own; an empty table gives no rows.
    """

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_model(model)
        for batch in batches:
            for part in in_parts(batch):
                got = list(pieces.encoded(part["text"].tolist()))
                ids = [[int(i) for p in parts for i in p[1].split(",")] for parts, _ in got]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": ids, "starts": [low for _, (low, _) in got], "ends": [high for _, (_, high) in got]})
        pieces.forget()

    return whole_texts(docs).mapInPandas(spans, "doc_id long, ids array<int>, starts array<int>, ends array<int>")
