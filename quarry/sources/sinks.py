"""Sinks: audit log, JSON summaries, Markdown tables, checksums, resumable parts and a fingerprint-keyed cache."""

from __future__ import annotations

import hashlib
import io
import json
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(spark: SparkSession, path: str, **event: object) -> None:
    """Append one event as a JSON line with its time."""
    row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), *[F.lit(v).alias(k) for k, v in event.items()])
    row.coalesce(1).write.mode("append").json(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, NaN as null and nulls kept."""
    from quarry.sources.tables import nan_to_null

    clean = nan_to_null(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report of at most `limit` rows as a Markdown table; a longer one is an error, not a shorter table."""
    show = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return "\n".join(["| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]]])


def write_csv(df: DataFrame, path: str, parts: str | None = None) -> None:
    """CSV with a header, put in place in one step: written beside its place, then renamed over what stands there."""
    spark, beside = df.sparkSession, f"{path}.writing-{uuid.uuid4().hex}"
    writer = df.write.option("header", True)
    (writer.partitionBy(parts) if parts else writer).csv(beside)
    replace(spark, beside, path)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Rename `new` to `path`; what stood there goes last, and comes back if the rename fails."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    at, old = Path(path), Path(f"{path}.old-{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(Path(new), at):
        if had:
            fs.rename(old, at)
        raise OSError(f"{new} can't be renamed to {path}")
    if had:
        fs.delete(old, True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions under a path, oldest first: those whose job ended, as its _SUCCESS tells."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v-*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def publish(df: DataFrame, path: str, format: str = "parquet", **options: object) -> str:
    """Write df as a new version under a path, and return its folder. Nothing is moved or overwritten.

    A version is there from the moment its _SUCCESS is: one small file, in any
    store. Readers of published() have the old table until then and the new one
    after it; a job that fails, or a driver that dies, leaves the old one.
    """
    spark = df.sparkSession
    last = [int(v.rsplit("/", 1)[1].split("-")[1]) for v in versions(spark, path)]
    folder = f"{path}/v-{max(last, default=0) + 1:012d}-{uuid.uuid4().hex}"
    df.write.format(format).options(**options).save(folder)
    return folder


def published(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no complete version")
    return found[-1]


def sweep(spark: SparkSession, path: str) -> None:
    """Delete all versions older than the newest, when nothing reads them any more; incomplete newer ones stay."""
    newest = published(spark, path).rsplit("/", 1)[1]
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v-*")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(at):
        if f.getPath().getName() < newest:
            fs.delete(f.getPath(), True)


def npz(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as the bytes of a compressed .npz file."""
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def save_model(model: PipelineModel, path: str, **metadata: object) -> None:
    """A fitted pipeline with what it was fitted under, as a JSON text beside its stages."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def checksums(files: DataFrame, column: str = "content") -> DataFrame:
    """`sha1  name` lines for files, sorted by name."""
    return files.select(F.concat_ws("  ", F.sha1(column), "path").alias("line"), "path").sort("path").select("line")


def fingerprint(**parts: object) -> str:
    """SHA-1 of canonical JSON: the same parts give the same key."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, folder: str, build: Callable[[], DataFrame], **parts: object) -> DataFrame:
    """build()'s table, written under the fingerprint of its parts; computed again only when a part changes."""
    path = f"{folder}/{fingerprint(**parts)}"
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def committed(spark: SparkSession, folder: str) -> set[int]:
    """The parts of resumable() that have been written: a part is one file, put in place when its task ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part=*/part-*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return {int(f.getPath().getParent().getName().split("=")[1]) for f in found}


def resumable(spark: SparkSession, folder: str, df: DataFrame, key: str, parts: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(df with `part`), which must keep that column, in `parts` hash parts: one scan and one shuffle for all parts that are missing.

    A part is one task's file and stands in the folder as soon as its task has
    ended, so a run that was killed goes on with the others; parts must be small
    enough for a task. A run that ended leaves _SUCCESS, and then nothing is read.
    """
    if not _exists(spark, folder):
        missing = sorted(set(range(parts)) - committed(spark, folder))
        rows = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).where(F.col("part").isin(missing))
        written = build(rows).repartition(max(len(missing), 1), "part").write.mode("append").partitionBy("part")
        written.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    return spark.read.parquet(folder)
