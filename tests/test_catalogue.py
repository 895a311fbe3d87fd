import math
import os

import duckdb
import pytest

from quarry.plans import CATALOGUE
from quarry.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
#: Queries without SQL, and what holds for their rows.
RULES = {
    "rf_oof_auc": lambda rows: 0.5 < rows[0]["auc"] <= 1,
    "isotonic_calibration": lambda rows: 0 <= rows[0]["after"] <= 0.25,
    "nested_cv": lambda rows: 0 <= rows[0]["auc"] <= 1 and rows[0]["chosen"].count(",") == 2,
    "rbf_svm_auc": lambda rows: 0.5 < rows[0]["auc"] <= 1,
    "feature_ablations": lambda rows: [r["kind"] for r in rows] == ["all", "alone", "without", "alone", "without"],
    "tree_contributions": lambda rows: {r["feature"] for r in rows} == {"n_chars", "n_words", "n_marks"} and all(0 < r["mean"] <= r["most"] < 1 for r in rows),
    "feature_importance": lambda rows: {r["feature"] for r in rows} == {"n_chars", "n_words", "n_marks"},
}
#: Expensive ones are left to the correctness run at the next scale.
SLOW = {"nested_cv", "feature_ablations", "feature_importance"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{v + 0.0:.5f}"
    return "" if v is None else str(v).removesuffix("+00:00")


@pytest.mark.parametrize("name", [n for n, (_, text) in CATALOGUE.items() if text])
def test_matches_sql(spark, duck, name):
    run, sql = CATALOGUE[name]
    df = run(spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, text) in CATALOGUE.items() if not text and n not in SLOW])
def test_without_sql(spark, name):
    assert RULES[name](CATALOGUE[name][0](spark, SF).collect())


def test_every_query_has_sql_or_a_rule():
    assert {n for n, (_, text) in CATALOGUE.items() if not text} == set(RULES)
