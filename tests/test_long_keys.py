"""Queries on names against their SQL, over part keys of more than five digits."""

import duckdb
import pytest

from quarry.functions import names
from quarry.plans import CATALOGUE


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long_keys"))
    rows = [(key, size) for size in range(1, 13) for key in (7 * size, 99_990 + size, 100_000 + size, 1_200_000 + size)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def both(spark, d, name):
    run, sql = CATALOGUE[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{d}/part.parquet/*.parquet')")
    df = run(spark, d)
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()))


@pytest.mark.parametrize("name", ["mask_names", "parsed_names"])
def test_names_of_long_keys(spark, long_keys, name):
    got, want = both(spark, long_keys, name)
    assert got == want


def test_long_ids_are_errors_unless_cut(spark):
    df = spark.createDataFrame([("d/Tp_D_CND_M_N_ani100053_sec00025_10005.TIF",)], "p string")
    strict, cut = df.select(names.parsed(df["p"]).alias("a"), names.parsed(df["p"], cut=True).alias("b")).first()
    assert strict["error"] and (cut["error"], cut["host_id"], cut["donor_id"]) == (None, "ani10005", "sec00025")
