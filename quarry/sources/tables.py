"""Scans: parquet tables, typed CSV, white-space text, JSON lines, Markdown JSON, files and their container metadata."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL, so aggregates skip them."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema: nothing is inferred, so ids keep leading zeros and doubles round-trip."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def csv_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All parts of a folder of CSV files, with `part`: the place of a row's file in the order of names (1, 2, ...)."""
    rows = typed_csv(spark, folder, schema).withColumn("_file", F.input_file_name())
    names = rows.select("_file").distinct().withColumn("part", F.row_number().over(Window.orderBy("_file")))  # one row a file
    return rows.join(names, "_file").drop("_file")


def npz_arrays(df: DataFrame, content: str, name: str) -> DataFrame:
    """df with `values`: the flattened array of a name from .npz bytes (NULL where it is missing), and its shape."""

    @F.pandas_udf("values array<double>, shape array<int>")
    def load(files: pd.Series) -> pd.DataFrame:
        out = []
        for b in files:
            with np.load(io.BytesIO(b)) as z:
                a = z[name] if name in z.files else None
            out.append((None, None) if a is None else (a.astype(float).ravel().tolist(), list(a.shape)))
        return pd.DataFrame(out, columns=["values", "shape"])

    return df.withColumn("_npz", load(content)).select("*", "_npz.values", "_npz.shape").drop("_npz")


def load_model(spark: SparkSession, path: str, **expected: object) -> tuple[PipelineModel, dict]:
    """A pipeline of save_model() and its metadata; metadata that differs from what is expected is an error."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if wrong := {k: (metadata.get(k), v) for k, v in expected.items() if metadata.get(k) != v}:
        raise ValueError(f"the model was fitted under other settings: {wrong}")
    return PipelineModel.load(f"{path}/model"), metadata


def spaced_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Header-less lines of white-space separated fields."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown_json(df: DataFrame, column: str, section: str, label: str, schema: str) -> DataFrame:
    """The JSON object that follows `label` in the given section of Markdown texts."""
    found = F.regexp_extract(column, rf"(?s)#+\s*{section}\b.*?{label}[^{{]*(\{{.*?\}})", 1)
    return df.select("*", F.from_json(F.nullif(found, F.lit("")), schema).alias("json"))


def files(spark: SparkSession, path: str, prefix: str = "", extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")) -> DataFrame:
    """path, name, length and content of files with a prefix and one of the extensions, hidden files left out."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("name", name)
    return found.where(name.startswith(prefix) & ~name.startswith(".") & F.lower(F.substring_index(name, ".", -1)).isin(*extensions))


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing at run time if a key repeats."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(counted.where(F.assert_true(F.col("_n") == 1, F.lit(f"{keys} repeat")).isNull()).drop("_n"), list(keys))


def one_to_one(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """The join of two tables, failing at run time if a key repeats on either side; null keys match nothing and may repeat."""
    some = " and ".join(f"{k} is not null" for k in keys)
    sides = [unique_by(side.where(some), *keys) for side in (left, right)]
    return sides[0].join(sides[1], list(keys), how)


METADATA = "path string, format string, width int, height int, mode string, n_qtables int, qtable_luma_dc int, qtable_luma_mean double, file_bytes long, bytes_per_pixel double, error string"


def jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of the header segments of a JPEG file."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        yield content[at + 1], content[at + 4 : at + 2 + size]
        at += 2 + size


def quantisation_tables(content: bytes) -> dict[int, list[int]]:
    """Quantisation tables of a JPEG file by number, in the file's zig-zag order."""
    found = {}
    for marker, body in jpeg_segments(content):
        k = 0
        while marker == 0xDB and k < len(body):
            kind = ">64H" if body[k] >> 4 else ">64B"
            found[body[k] & 15] = list(struct.unpack(kind, body[k + 1 : k + 1 + struct.calcsize(kind)]))
            k += 1 + struct.calcsize(kind)
    return found


def container_metadata(content: bytes) -> dict:
    """Format, size, mode and quantisation tables from the headers of JPEG, PNG, BMP, GIF, TIFF and WebP files; no pixel is decoded."""
    out = {"format": None, "width": None, "height": None, "mode": None, "n_qtables": 0, "qtable_luma_dc": -1, "qtable_luma_mean": -1.0, "error": None}
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            out |= {"format": "PNG", "mode": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(content[25] if len(content) > 25 else None)} | dict(zip(("width", "height"), struct.unpack(">II", content[16:24])))
        elif content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
            out |= {"format": "BMP", "width": w, "height": abs(h), "mode": {8: "P", 24: "RGB", 32: "RGBA"}.get(struct.unpack("<H", content[28:30])[0])}
        elif content[:6] in (b"GIF87a", b"GIF89a"):
            out |= {"format": "GIF"} | dict(zip(("width", "height"), struct.unpack("<HH", content[6:10])))
        elif content[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if content[:2] == b"II" else ">"
            at = struct.unpack(order + "I", content[4:8])[0]
            for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
                tag, kind, _ = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
                value = struct.unpack(order + ("H" if kind == 3 else "I"), content[at + 10 + 12 * k : at + 10 + 12 * k + (2 if kind == 3 else 4)])[0]
                out |= {256: {"width": value}, 257: {"height": value}, 277: {"mode": {1: "L", 3: "RGB", 4: "RGBA"}.get(value)}}.get(tag, {})
            out["format"] = "TIFF"
        elif content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            out["format"] = "WEBP"
            if content[12:16] == b"VP8X":
                out |= {"width": 1 + int.from_bytes(content[24:27], "little"), "height": 1 + int.from_bytes(content[27:30], "little")}
            elif content[12:16] == b"VP8 ":
                out |= {k: v & 0x3FFF for k, v in zip(("width", "height"), struct.unpack("<HH", content[26:30]))}
        elif content[:2] == b"\xff\xd8":
            out["format"] = "JPEG"
            for marker, body in jpeg_segments(content):
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    out["height"], out["width"] = struct.unpack(">HH", body[1:5])
                    out["mode"] = {1: "L", 3: "RGB", 4: "CMYK"}.get(body[5])
            tables = quantisation_tables(content)
            out["n_qtables"] = len(tables)
            if 0 in tables:
                out |= {"qtable_luma_dc": tables[0][0], "qtable_luma_mean": sum(tables[0]) / 64}
        else:
            out["error"] = "unknown format"
        if out["error"] is None and not (out["width"] and out["height"]):
            out["error"] = "truncated header"
    except (struct.error, IndexError) as e:
        out["error"] = f"bad header: {e}"
    return out


def metadata(found: DataFrame) -> DataFrame:
    """METADATA of files (path, content); a bad file gets an error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                m = container_metadata(bytes(content or b""))
                pixels = (m["width"] or 0) * (m["height"] or 0)
                n = len(content or b"")
                rows.append({"path": path, **m, "file_bytes": n, "bytes_per_pixel": n / pixels if pixels else None})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in METADATA.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return found.select("path", "content").mapInPandas(run, METADATA)


#: Bytes of a file that are read first; enough for the heads of PNG, BMP, GIF and WebP.
FIRST = 32


def head(read: Callable[[int, int], bytes]) -> bytes:
    """What container_metadata() needs of a file, by ranges (from, length): the first bytes, then a TIFF's directory wherever it stands, or a JPEG's segments up to its frame, of which only tables and frames are read."""
    start = read(0, FIRST)
    if start[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if start[:2] == b"II" else ">"
        at = struct.unpack(order + "I", start[4:8])[0]
        n = read(at, 2)
        return start[:4] + struct.pack(order + "I", 8) + n + read(at + 2, 12 * struct.unpack(order + "H", n)[0])
    if start[:2] != b"\xff\xd8":
        return start
    out, at = [b"\xff\xd8"], 2
    while True:
        mark = start[at : at + 4] if at + 4 <= len(start) else read(at, 4)
        if len(mark) < 4 or mark[0] != 0xFF or mark[1] == 0xDA:
            return b"".join(out)
        size = struct.unpack(">H", mark[2:])[0]
        frame = 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC)
        if frame or mark[1] == 0xDB:
            out.append(mark + read(at + 4, size - 2))
        if frame:
            return b"".join(out)
        at += 2 + size


def headers(spark: SparkSession, path: str, glob: str, key: str) -> DataFrame:
    """METADATA, key and bytes_read of the files under a path whose names match a glob: files are listed by Spark, and each is opened by Arrow for a few short ranges.

    key: a pattern whose first group names a file; the job fails where a name
    doesn't match or a key repeats. A bad file gets an error, not a failed job; empty
    files are not listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    named = found.withColumn("key", F.when(name.rlike(key), F.regexp_extract(name, key, 1)).otherwise(F.raise_error(F.concat(F.lit("no key in "), name)).cast("string")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, length, own in zip(batch["path"], batch["length"], batch["key"]):
                system, at = fs.FileSystem.from_uri(path)
                seen = 0
                with system.open_input_file(at) as f:

                    def read(start: int, n: int) -> bytes:
                        nonlocal seen
                        got = f.read_at(max(n, 0), start) if start < length else b""
                        seen += len(got)
                        return got

                    try:
                        m = container_metadata(head(read))
                    except struct.error as e:
                        m = container_metadata(b"") | {"error": f"bad header: {e}"}
                pixels = (m["width"] or 0) * (m["height"] or 0)
                rows.append({"path": path, **m, "file_bytes": length, "bytes_per_pixel": length / pixels if pixels else None, "key": own, "bytes_read": seen})
            yield pd.DataFrame(rows, columns=[*(x.split()[0] for x in METADATA.split(", ")), "key", "bytes_read"]).astype({"width": "Int32", "height": "Int32"})

    return unique_by(named, "key").mapInPandas(run, METADATA + ", key string, bytes_read long")
