"""The folder that driver and executors share, and tables written there to cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a folder of its own, a cluster has none to share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str = "cut") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: computed once, and safe when executors are lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quarry_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables of cut_lineage() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_quarry_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Keys of more than a thousandth of all rows are a thousand at most, so that many rows may be broadcast.
HEAVY = 1000


def heavy_join(rows: DataFrame, keyed: DataFrame, on: str, weight: str) -> DataFrame:
    """rows joined with keyed: a row a key, `weight` says how many of rows have it; a written table, as it is read three times.

    Keys of more than 1 / HEAVY of the rows are broadcast, so their rows stay
    where they are; the others are shuffled.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    heavy = keyed.where(F.col(weight) * HEAVY > total)
    if total < HEAVY or heavy.isEmpty():
        return rows.join(keyed, on)
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(keyed.where(F.col(weight) * HEAVY <= total), on)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)
