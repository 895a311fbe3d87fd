"""What the corpus operators share: the shared folder, written tables and global row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Keys of more than a thousandth of all rows are a thousand at most, so that many rows may be broadcast.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets one of its own; a cluster has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quarry_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables written by materialise() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_quarry_path", None):
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Arrow batches hold so many bytes at most, whatever their number of rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def heavy_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with keyed: one row a key, `weight` says how many of rows have it.

    Keys of more than 1 / HEAVY of the rows, HEAVY at most, are broadcast, so
    their rows stay where they are; the others are shuffled. keyed must be a
    written table, as it is read three times.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    heavy = keyed.where(F.col(weight) * HEAVY > total)
    if total < HEAVY or not heavy.limit(1).count():
        return rows.join(keyed, on, how)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(keyed.where(F.col(weight) * HEAVY <= total), on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a row is known by: its id as text (null: empty) and 128 bits of its text.
KEY = ["d", "k1", "k2"]


def keyed(docs: DataFrame, whole: bool = True) -> DataFrame:
    """docs (needs doc_id and text) with KEY; whole: a null text becomes an empty one, which the key takes it for anyhow."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)})
    return out.withColumn("text", text) if whole else out


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), whatever else the table holds."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def globally_ordered(df: DataFrame, *order: str, sums: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Rows with `row` (their place, from 0, in the order) and for each of sums `end_<c>` (the sum up to and with the row).

    The rows are dealt by ranges of the whole order, so that equal leading keys
    spread over as many tasks as they need; only one row a partition comes to
    the driver. Returns the table and the totals.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    dealt = materialise(dealt.select("*", F.shiftright(mid, 33).cast("int").alias("_part"), mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordered")
    per_part = dealt.groupBy("_part").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"sum_{c}") for c in sums]).orderBy("_part").collect()
    before, rows = {"row": 0, **{c: 0 for c in sums}}, []
    for r in per_part:
        rows.append((r["_part"], before["row"], *[before[c] for c in sums]))
        before["row"] += r["n"]
        for c in sums:
            before[c] += r[f"sum_{c}"]
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_row0", T.LongType()), *[T.StructField(f"_{c}0", T.LongType()) for c in sums]])
    offsets = spark.createDataFrame(rows, schema)  # one row a partition
    out = dealt.join(F.broadcast(offsets), "_part")
    if sums:
        from pyspark.sql import Window

        w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.select("*", *[(F.col(f"_{c}0") + F.sum(c).over(w)).alias(f"end_{c}") for c in sums])
    out = out.withColumn("row", F.col("_row0") + F.col("_at")).drop("_part", "_at", "_row0", *[f"_{c}0" for c in sums])
    return out, before
