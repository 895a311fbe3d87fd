"""Media columns in a chunk store with content-defined cuts.

A payload becomes an 8-bit mono WAV; its bytes are cut where a rolling gear hash
says so, so equal passages give equal chunks wherever they stand. Chunks go into
block files in the shared folder (each writing task stores a digest once); a
Spark join on digests then picks one canonical copy for all tasks, and recipes
(ordered lists of canonical places) rebuild each medium, whose digest is verified.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import heavy_join, materialise, new_path, whole_texts
from quarry.llm.store import Reader, Writer, make_folder

FRAME = 192
HEADER = 44
#: Chunks have at least LEAST and at most MOST bytes (the last of a medium may have fewer), 2 KB more than LEAST on average.
LEAST, MOST, CUT_BITS = 512, 8192, 11
#: Bytes of chunks in one compressed block.
BLOCK = 64 << 10
#: Bytes of media that a task rebuilds at once.
AT_ONCE = 8 << 20
PLACE = "archive string, offset long, length long, inside int, n int"
WRITTEN = "doc_id long, n_bytes long, medium binary, digests array<binary>, places array<struct<archive:string,offset:bigint,length:bigint,inside:int,n:int>>"
FEATURES = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME), len(raw)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """An 8-bit mono PCM file with the payload as its samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples_of(medium: bytes) -> bytes:
    if medium[:4] != b"RIFF" or medium[36:40] != b"data":
        raise ValueError("no WAV medium")
    return medium[HEADER : HEADER + struct.unpack("<I", medium[40:44])[0]]


def gear_table() -> np.ndarray:
    """256 numbers, one for each byte, from its digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = gear_table()


def cuts(data: bytes) -> list[int]:
    """Chunk ends. The gear hash of 32 bytes cuts where its top CUT_BITS bits are 0, LEAST bytes after the last cut at the earliest."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    marks = (np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist()
    ends, start = [], 0
    for at in marks:
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def put(docs: DataFrame) -> DataFrame:
    """Write the media of all rows' texts into block files; returns WRITTEN: for each row the digests and places of its chunks."""
    folder = make_folder(new_path(docs.sparkSession, "chunks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{uuid.uuid4().hex}.blocks"  # another name for each attempt
        out, squeeze = None, zstandard.ZstdCompressor(level=3)
        known: dict[bytes, tuple] = {}
        block, waiting = bytearray(), []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal out
            if block:
                out = out or Writer(path)
                offset, length = out.add(squeeze.compress(bytes(block)))
                for digest, inside, n in waiting:
                    known[digest] = (path, offset, length, inside, n)
                block.clear()
                waiting.clear()

        def frame() -> pd.DataFrame:
            done = [(d, n, m, digests, [known[x] for x in digests]) for d, n, m, digests in rows]
            rows.clear()
            return pd.DataFrame(done, columns=["doc_id", "n_bytes", "medium", "digests", "places"]).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                payload, n = payload_of(text)
                medium = wav(payload)
                digests, start = [], 0
                for end in cuts(medium):
                    digest = hashlib.blake2b(medium[start:end], digest_size=16).digest()
                    digests.append(digest)
                    if digest not in known:
                        known[digest] = ()
                        waiting.append((digest, len(block), end - start))
                        block += medium[start:end]
                        if len(block) >= BLOCK:
                            flush()
                    start = end
                rows.append((doc_id, n, hashlib.sha256(medium).digest(), digests))
            flush()
            if rows:
                yield frame()
        if out:
            out.close()

    return materialise(whole_texts(docs).mapInPandas(run, WRITTEN), "written")


def chunk_lists(written: DataFrame) -> DataFrame:
    """(medium, seq, digest, place) of each distinct medium's chunks, as one of its writers placed them."""
    one = written.groupBy("medium").agg(F.min_by(F.struct("digests", "places"), F.element_at("places", 1)).alias("w")).select("medium", "w.digests", "w.places")
    chunks = one.select("medium", F.posexplode(F.arrays_zip("digests", "places")).alias("seq", "c")).select("medium", "seq", F.col("c.digests").alias("digest"), F.col("c.places").alias("place"))
    return materialise(chunks, "chunk-list")


def canonical(chunks: DataFrame) -> DataFrame:
    """(digest, place, uses): the smallest place of each chunk digest, and how many chunks of the lists it stands for."""
    return materialise(chunks.groupBy("digest").agg(F.min("place").alias("place"), F.count("*").alias("uses")), "canonical")


def recipe_of(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """For each medium the ordered places of its chunks. A chunk found in very many media is broadcast."""
    placed = heavy_join(chunks.drop("place"), places, ["digest"], "uses")
    return placed.groupBy("medium").agg(F.array_sort(F.collect_list(F.struct("seq", "place"))).alias("chunks"))


def recipes(written: DataFrame) -> DataFrame:
    """For each distinct medium the ordered canonical places of its chunks: the smallest place of each digest."""
    chunks = chunk_lists(written)
    return recipe_of(chunks, canonical(chunks))


def compacted(written: DataFrame) -> DataFrame:
    """recipes() on block files that hold each chunk once: canonical chunks are copied in the order they lie, and no other file is needed.

    put() stores a chunk once in each task that meets it; this drops the other
    copies, at the price of reading the store once. The old files may go then.
    Nulls and repeated rows are as in stored(); an empty table gives no rows.
    """
    chunks = chunk_lists(written)
    best = canonical(chunks)
    folder = make_folder(new_path(written.sparkSession, "chunks"))
    dealt = best.withColumn("a", F.col("place.archive")).withColumn("o", F.col("place.offset"))
    n = -(-(best.agg(F.sum("place.n")).first()[0] or 1) // (4 * AT_ONCE))
    dealt = dealt.repartition(n, "a", F.floor(F.col("o") / F.lit(AT_ONCE))).sortWithinPartitions("a", "o", "place.inside").select("digest", "place", "uses")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{uuid.uuid4().hex}.blocks"
        out, reader, squeeze, expand = None, Reader(), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        at, data, block, waiting = None, b"", bytearray(), []
        for batch in batches:
            rows = []
            for digest, p, uses in zip(batch["digest"], batch["place"], batch["uses"]):
                if at != (p["archive"], p["offset"]):
                    at = p["archive"], p["offset"]
                    data = expand.decompress(next(reader.read(p["archive"], [(p["offset"], p["length"])]))[1])
                waiting.append((digest, len(block), p["n"], uses))
                block += data[p["inside"] : p["inside"] + p["n"]]
                if len(block) >= BLOCK:
                    out = out or Writer(path)
                    offset, length = out.add(squeeze.compress(bytes(block)))
                    rows += [(d, (path, offset, length, inside, n), u) for d, inside, n, u in waiting]
                    block, waiting = bytearray(), []
            if block:
                out = out or Writer(path)
                offset, length = out.add(squeeze.compress(bytes(block)))
                rows += [(d, (path, offset, length, inside, n), u) for d, inside, n, u in waiting]
                block, waiting = bytearray(), []
            names = ["archive", "offset", "length", "inside", "n"]
            yield pd.DataFrame({"digest": [r[0] for r in rows], "place": [dict(zip(names, r[1])) for r in rows], "uses": [r[2] for r in rows]})
        reader.close()
        if out:
            out.close()

    moved = materialise(dealt.mapInPandas(run, f"digest binary, place struct<{PLACE.replace(' string', ':string').replace(' long', ':bigint').replace(' int', ':int')}>, uses long"), "moved")
    return recipe_of(chunks, moved)


def store_report(written: DataFrame) -> DataFrame:
    """One row: chunks of the media, distinct digests, bytes of the distinct ones and bytes that other tasks stored again; zeros for an empty table."""
    placed = written.select(F.explode(F.arrays_zip("digests", "places")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.places").alias("place"))
    stored = placed.groupBy("digest", "place.archive", "place.offset", "place.inside").agg(F.max("place.n").alias("n"), F.count("*").alias("uses"))
    per = stored.groupBy("digest").agg(F.sum("n").alias("all"), F.max("n").alias("one"), F.sum("uses").alias("uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per.agg(zero(F.sum("uses")).alias("chunks"), F.count("*").alias("distinct_chunks"), zero(F.sum("one")).alias("distinct_bytes"), zero(F.sum(F.col("all") - F.col("one"))).alias("repeated_bytes"))


def feature(samples: np.ndarray) -> str:
    """Of the samples around 128: number, smallest, largest, sum, energy, sign changes."""
    x = samples.astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};min={x.min()};max={x.max()};sum={x.sum()};energy={int((x * x).sum())};changes={changes}"


def rebuilt(recipe: DataFrame) -> DataFrame:
    """Read each medium back from the store, verify it and compute FEATURES.

    Rows are dealt by where their first chunk lies and read in that order, in
    parts of AT_ONCE bytes; blocks near each other are read together.
    """
    first = F.col("chunks")[0]["place"]
    dealt = recipe.withColumn("a", first["archive"]).withColumn("o", first["offset"])
    dealt = dealt.repartition("a", F.floor(F.col("o") / F.lit(AT_ONCE))).sortWithinPartitions("a", "o").select("medium", F.col("chunks.place").alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, blocks = Reader(), OrderedDict()
        expand = zstandard.ZstdDecompressor()

        def rebuild(rows: list[tuple]) -> pd.DataFrame:
            for key in {(p["archive"], p["offset"], p["length"]) for _, places in rows for p in places}:
                if key in blocks:
                    blocks.move_to_end(key)
                else:
                    blocks[key] = None
            by_file: dict[str, list[tuple[int, int]]] = {}
            for (archive, offset, length), data in blocks.items():
                if data is None:
                    by_file.setdefault(archive, []).append((offset, length))
            for archive, ranges in by_file.items():
                ranges.sort()
                for k, data in reader.read(archive, ranges):
                    blocks[(archive, *ranges[k])] = expand.decompress(data)
            done = []
            for digest, places in rows:
                medium = b"".join([blocks[(p["archive"], p["offset"], p["length"])][p["inside"] : p["inside"] + p["n"]] for p in places])
                if hashlib.sha256(medium).digest() != digest:
                    raise ValueError("a medium isn't what was stored")
                payload = samples_of(medium)
                done.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(medium), digest.hex(), feature(np.frombuffer(payload, np.uint8))))
            while len(blocks) > 2 * AT_ONCE // BLOCK:
                blocks.popitem(last=False)
            return pd.DataFrame(done, columns=[x.split()[0] for x in FEATURES.split(", ")])

        for batch in batches:
            rows, held = [], 0
            for digest, places in zip(batch["medium"], batch["places"]):
                rows.append((digest, places))
                held += sum(p["n"] for p in places)
                if held >= AT_ONCE:
                    yield rebuild(rows)
                    rows, held = [], 0
            if rows:
                yield rebuild(rows)
        reader.close()

    return dealt.mapInPandas(run, FEATURES)


def stored(docs: DataFrame) -> DataFrame:
    """Store every row's text as a medium, read it back and return doc_id, n_bytes and FEATURES but the key.

    A null or empty text becomes 192 spaces. Equal texts share one medium.
    Repeated rows and null ids are carried; an empty table gives no rows.
    """
    written = put(docs)
    copies = written.groupBy("medium").agg(F.count("*").alias("copies"))
    media = materialise(rebuilt(recipes(written)).join(copies, "medium"), "media")
    return heavy_join(written.select("doc_id", "n_bytes", "medium"), media, ["medium"], "copies").drop("medium", "copies")
