"""Images as arrays: PNG and BMP bytes, checks of uploads; affine consensus of points."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import container_metadata

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SMALLEST, LARGEST = 8, 12_000


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey (h x w) or colour (h x w x 3) array as PNG bytes."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def unfiltered(data: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """PNG rows without their filters (none, left, up, average, Paeth)."""
    out = np.zeros((h + 1, stride + step), np.int64)  # a row above and a pixel to the left of zeros
    raw = np.frombuffer(data, np.uint8).reshape(h, stride + 1).astype(np.int64)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:], out[y]
        row = out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + up[step:] & 255
        else:
            for x in range(stride):
                left, above, corner = int(row[x]), int(up[x + step]), int(up[x])
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above) // 2
                elif kind == 4:
                    p = left + above - corner
                    guess = min((left, above, corner), key=lambda v, p=p: abs(p - v))
                else:
                    raise ValueError(f"filter {kind}")
                row[x + step] = line[x] + guess & 255
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """RGB of an 8- or 16-bit PNG without interlacing; alpha is dropped, 16 bits are brought to 8 by the high byte."""
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n:
            raise ValueError("truncated")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or interlace or colour not in (0, 2, 3, 4, 6):
        raise ValueError(f"PNG with {depth} bits, colour type {colour}, interlace {interlace} is not read")
    channels, size = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], depth // 8
    try:
        plain = zlib.decompress(body)
    except zlib.error as e:
        raise ValueError(f"truncated: {e}") from None
    stride = w * channels * size
    if len(plain) < h * (stride + 1):
        raise ValueError("truncated")
    pixels = unfiltered(plain[: h * (stride + 1)], h, stride, channels * size).reshape(h, w, channels, size)[..., 0].astype(np.uint8)
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3]


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB of a BMP with 24 or 32 bits a pixel."""
    start, (w, h), bits = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    if bits not in (24, 32):
        raise ValueError(f"BMP with {bits} bits is not read")
    step, stride = bits // 8, (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data[start : start + abs(h) * stride], np.uint8)
    if rows.size < abs(h) * stride:
        raise ValueError("truncated")
    image = rows.reshape(abs(h), stride)[:, : w * step].reshape(abs(h), w, step)[..., 2::-1]
    return image[::-1] if h > 0 else image


def decode(data: bytes) -> np.ndarray:
    """RGB (h x w x 3) of PNG or BMP bytes; JPEG, GIF and TIFF go through images(), Spark's own reader."""
    if data[:8] == SIGNATURE:
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("not a PNG or BMP file")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files by Spark's reader: path, height, width, n_channels and RGB (or grey) bytes; unreadable files are left out."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([bytes(d) if c == 1 else np.frombuffer(d, np.uint8).reshape(-1, c)[:, 2::-1].tobytes() for d, c in zip(data, channels)])

    return found.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), rgb("data", "nChannels").alias("data"))


def masks(df: DataFrame, content: str, threshold: int = 127) -> DataFrame:
    """df with mask_height, mask_width, mask_area (pixels whose grey value is above the threshold) and mask_error."""

    @F.pandas_udf("mask_height int, mask_width int, mask_area long, mask_error string")
    def read(files: pd.Series) -> pd.DataFrame:
        out = []
        for b in files:
            try:
                m = decode(bytes(b or b""))[..., 0] > threshold
                out.append((*m.shape, int(m.sum()), None))
            except (ValueError, struct.error, IndexError) as e:
                out.append((None, None, None, str(e)[:200]))
        return pd.DataFrame(out, columns=["mask_height", "mask_width", "mask_area", "mask_error"]).astype({"mask_height": "Int32", "mask_width": "Int32", "mask_area": "Int64"})

    return df.withColumn("_mask", read(content)).select("*", "_mask.*").drop("_mask")


def check_upload(data: bytes | None) -> tuple[bool, str, str | None]:
    """(accepted, notes, error) of a file somebody sent: known format, sides within limits, decodable, 16 bits brought to 8."""
    data = bytes(data or b"")
    head = container_metadata(data)
    if head["error"]:
        return False, "", head["error"]
    sides = head["width"], head["height"]
    if max(sides) > LARGEST or min(sides) < SMALLEST:
        return False, "", f"sides must have {SMALLEST} to {LARGEST} pixels"
    notes = []
    if head["format"] in ("PNG", "BMP"):
        try:
            decode(data)
        except (ValueError, struct.error, IndexError) as e:
            return False, "", f"not readable: {str(e)[:100]}"
        if head["format"] == "PNG" and data[24] == 16:
            notes.append("16 bits brought to 8")
    elif head["format"] == "JPEG" and data[-2:] != b"\xff\xd9":
        return False, "", "not readable: truncated"
    return True, "; ".join(notes), None


def checked_uploads(df: DataFrame, content: str) -> DataFrame:
    """df with accepted, notes and error of each file; a bad file is a row, not a failed job."""

    @F.pandas_udf("accepted boolean, notes string, error string")
    def check(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check_upload(b) for b in files], columns=["accepted", "notes", "error"])

    return df.withColumn("_check", check(content)).select("*", "_check.*").drop("_check")


def affine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 3 x 2 matrix that best takes points a (with a column of ones) to b."""
    return np.linalg.lstsq(np.c_[a, np.ones(len(a))], b, rcond=None)[0]


def consensus(a: np.ndarray, b: np.ndarray, within: float = 3.0, tries: int = 200, seed: int = 0) -> np.ndarray:
    """Which pairs agree with one affine transform: of seeded samples of three pairs the one most agree with, refitted on those."""
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    agrees = lambda m: np.hypot(*(np.c_[a, np.ones(len(a))] @ m - b).T) <= within
    if len(a) < 3:
        return best
    for _ in range(tries):
        pick = rng.choice(len(a), 3, replace=False)
        if abs(np.linalg.det(np.c_[a[pick], np.ones(3)])) < 1e-6:
            continue
        now = agrees(affine(a[pick], b[pick]))
        if now.sum() > best.sum():
            best = now
    return agrees(affine(a[best], b[best])) if best.sum() >= 3 else best


def consensus_by(pairs: DataFrame, by: list[str], within: float = 3.0, least: int = 3) -> DataFrame:
    """(by, n, inliers) of pairs (by, ax, ay, bx, by_): the largest affine agreement within each image and matching mode; fewer than `least` count as none."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in by), "n int, inliers int"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(consensus(rows[["ax", "ay"]].to_numpy(float), rows[["bx", "by_"]].to_numpy(float), within).sum())
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "n": [len(rows)], "inliers": [k if k >= least else 0]})

    return pairs.groupBy(*by).applyInPandas(one, schema)


def vectors_as_images(df: DataFrame, vector: str, size: int = 8) -> DataFrame:
    """df with `content`: the PNG bytes of a vector of size x size, 60 grey levels a unit around 128."""

    @F.pandas_udf("binary")
    def make(v: pd.Series) -> pd.Series:
        return pd.Series([png(np.clip(np.floor(np.asarray(x, np.float64) * 60 + 128), 0, 255).reshape(size, size)) for x in v])

    return df.withColumn("content", make(vector))
