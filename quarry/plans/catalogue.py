"""The query catalogue over the driver's tables: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import arrays
from quarry.operators import bootstrap, graph, grid, models, order, sampling, selection, stats
from quarry.operators.shared import cut_lineage
from quarry.sources.tables import TABLES, metadata, quantisation_tables, register, table
from quarry.streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        CATALOGUE[f.__name__] = f, oracle
        return f

    return put


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose plan is Spark SQL; the oracle is the same text where both dialects agree."""

    names = sorted(set(re.findall(r"\b(?:" + "|".join(TABLES) + r")\b", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *names)
        return spark.sql(text)

    CATALOGUE[name] = run, oracle or text


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


# Ranks and areas

MID = """(SELECT {keys} {label} AS y, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {pk} {score}) - 1) / CAST(2 AS DOUBLE) AS r FROM labels JOIN documents USING (doc_id))"""
AREA = "round((sum(CASE WHEN y = 1 THEN r END) - sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) * (sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) + 1) / CAST(2 AS DOUBLE)) / nullif(CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) * sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS DOUBLE), 0), 6)"
COUNTS = "CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg"


@query(f"SELECT {COUNTS}, {AREA} AS auc FROM {MID.format(keys='', label='quality', part='', pk='', score='n_chars')}")
def auc_overall(spark, sf_dir):
    return stats.auc(labelled(spark, sf_dir), "quality", "n_chars")


@query(f"SELECT lang, {COUNTS}, {AREA} AS auc FROM {MID.format(keys='lang,', label='quality', part='PARTITION BY lang', pk='lang,', score='n_chars')} GROUP BY lang")
def auc_by_lang(spark, sf_dir):
    return stats.auc(labelled(spark, sf_dir), "quality", "n_chars", by=("lang",))


@query(f"""WITH d AS (SELECT quality AS y, lang, n_chars FROM labels JOIN documents USING (doc_id)), langs AS (SELECT DISTINCT lang FROM d),
g AS (SELECT lang AS grp, y, n_chars FROM d WHERE y = 1 UNION ALL SELECT langs.lang, y, n_chars FROM d CROSS JOIN langs WHERE y = 0),
m AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY n_chars) + (count(*) OVER (PARTITION BY grp, n_chars) - 1) / CAST(2 AS DOUBLE) AS r FROM g)
SELECT grp, {COUNTS}, {AREA} AS auc FROM m GROUP BY grp""")
def auc_pairwise_negatives(spark, sf_dir):
    """Each language's positives against the negatives of all: overlapping groups by exploded membership."""
    d = labelled(spark, sf_dir).select("quality", "lang", "n_chars")
    langs = d.select(F.col("lang").alias("grp")).distinct()
    both = d.where("quality = 1").withColumnRenamed("lang", "grp").unionByName(d.where("quality = 0").drop("lang").crossJoin(F.broadcast(langs)))
    return stats.auc(both, "quality", "n_chars", by=("grp",))


@query("""WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS threshold, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS n FROM labels JOIN documents USING (doc_id) GROUP BY n_chars)
SELECT threshold, round(sum(n) OVER (ORDER BY threshold DESC) / CAST(sum(n) OVER () AS DOUBLE), 6) AS fpr, round(sum(p) OVER (ORDER BY threshold DESC) / CAST(sum(p) OVER () AS DOUBLE), 6) AS tpr FROM s""")
def roc_points(spark, sf_dir):
    return stats.roc_points(labelled(spark, sf_dir), "quality", "n_chars")


RANKED = """SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / CAST(2 AS DOUBLE) AS ra,
rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / CAST(2 AS DOUBLE) AS rb, count(*) OVER () AS n FROM orders JOIN customer ON o_custkey = c_custkey"""


def priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")


@query(f"SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM ({RANKED})")
def spearman(spark, sf_dir):
    return stats.spearman(priced(spark, sf_dir), "o_totalprice", "c_acctbal")


@query(f"SELECT o_orderkey, round((ra / n + rb / n) / 2, 6) AS ensemble FROM ({RANKED})")
def rank_average(spark, sf_dir):
    d = priced(spark, sf_dir)
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    both = stats.midranked(stats.midranked(d, "o_totalprice", "ra"), "c_acctbal", "rb").crossJoin(n)
    return both.select("o_orderkey", F.round((F.col("ra") / F.col("n") + F.col("rb") / F.col("n")) / 2, 6).alias("ensemble"))


# Classification and calibration

CONF = """WITH c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) tp, CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) fp, CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS DOUBLE) fn, CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS DOUBLE) tn
FROM (SELECT quality AS y, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)))
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy,
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""


@query(CONF)
def confusion_metrics(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("p", (F.col("n_chars") >= 1500).cast("int"))
    return d.agg(*stats.confusion(F.col("quality"), F.col("p")))


sql("majority_accuracy", "SELECT round(greatest(avg(CAST(quality AS DOUBLE)), 1 - avg(CAST(quality AS DOUBLE))), 6) AS accuracy FROM labels")

PROB = "(SELECT quality AS y, n_chars / CAST(n_chars + 1000 AS DOUBLE) AS p, lang, doc_id FROM labels JOIN documents USING (doc_id))"
BIN = "CASE " + " ".join(f"WHEN p < CAST({e!r} AS DOUBLE) THEN {i}" for i, e in enumerate(stats.EDGES)) + " ELSE 9 END"


def probabilities(spark, sf_dir):
    return labelled(spark, sf_dir).select(F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000).cast("double")).alias("p"), "lang", "doc_id")


@query(f"SELECT {BIN} AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM {PROB} GROUP BY 1")
def reliability_table(spark, sf_dir):
    r = stats.reliability(probabilities(spark, sf_dir), "p", "y")
    return r.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(f"""WITH b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS rate FROM {PROB} GROUP BY 1)
SELECT round(sum(n * abs(mp - rate)) / sum(n), 6) AS ece, (SELECT round(avg((p - y) * (p - y)), 6) FROM {PROB}) AS brier FROM b""")
def ece_brier(spark, sf_dir):
    d = probabilities(spark, sf_dir)
    ece = stats.reliability(d, "p", "y").agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))
    return ece.crossJoin(d.agg(F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier")))


CURVE = f"""SELECT w / CAST(100 AS DOUBLE) AS width, count(*) AS n, round(avg(CASE WHEN abs(p - CAST(0.5 AS DOUBLE)) >= w / CAST(200 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS coverage,
round(avg(CASE WHEN abs(p - CAST(0.5 AS DOUBLE)) >= w / CAST(200 AS DOUBLE) THEN CASE WHEN (p >= CAST(0.5 AS DOUBLE)) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END END), 6) AS accuracy
FROM {PROB} CROSS JOIN (SELECT {{series}} AS w) GROUP BY w"""


def curve(spark, sf_dir):
    """21 band widths as conditional aggregates of one pass, then a row for each."""
    d = probabilities(spark, sf_dir)
    right = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")
    judged = lambda w: F.abs(F.col("p") - 0.5) >= F.lit(w / 200.0)
    widths = range(0, 81, 4)
    one = d.agg(F.array(*[F.struct(F.lit(w / 100.0).alias("width"), F.count("*").alias("n"), F.round(F.avg(judged(w).cast("double")), 6).alias("coverage"), F.round(F.avg(F.when(judged(w), right)), 6).alias("accuracy")) for w in widths]).alias("rows"))
    return one.select(F.inline("rows"))


@query(CURVE.format(series="unnest(generate_series(0, 80, 4))"))
def coverage_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@query(f"""WITH c AS ({CURVE.format(series="unnest(generate_series(0, 80, 4))")}), t AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN accuracy >= 0.85 AND coverage >= 0.5 THEN 0 ELSE 1 END, CASE WHEN accuracy >= 0.85 AND coverage >= 0.5 THEN width END, accuracy DESC, width) AS k FROM c)
SELECT width, coverage, accuracy FROM t WHERE k = 1""")
def choose_band(spark, sf_dir):
    """The smallest width that is accurate enough at enough coverage, else the most accurate."""
    c = curve(spark, sf_dir)
    good = (F.col("accuracy") >= 0.85) & (F.col("coverage") >= 0.5)
    best = F.struct(F.when(good, 0).otherwise(1).alias("k"), F.when(good, F.col("width")).alias("w"), (-F.col("accuracy")).alias("a"), "width", "coverage", "accuracy")
    return c.agg(F.min(best).alias("b")).select("b.width", "b.coverage", "b.accuracy")


sql("verdict_counts", f"SELECT CASE WHEN p >= CAST(0.62 AS DOUBLE) THEN 'tampered' WHEN p <= CAST(0.38 AS DOUBLE) THEN 'authentic' ELSE 'inconclusive' END AS verdict, lang, count(*) AS n FROM {PROB} GROUP BY 1, 2")

# Strings, hashes and samples

sql(
    "parse_url_parts",
    r"SELECT page_id, split(split(url, '://')[1], '/')[0] AS host, split(url, '://')[0] AS scheme, nullif(regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1), '') AS number, lpad(coalesce(nullif(regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1), ''), '0'), 8, '0') AS padded, contains(url, '?') AS has_query FROM pages".replace("\\", "\\\\"),
    r"SELECT page_id, string_split(string_split(url, '://')[2], '/')[1] AS host, string_split(url, '://')[1] AS scheme, nullif(regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1), '') AS number, lpad(coalesce(nullif(regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1), ''), '0'), 8, '0') AS padded, contains(url, '?') AS has_query FROM pages",
)
sql(
    "name_relation",
    "SELECT a.p_partkey, CASE WHEN a.p_name = b.p_name THEN 'same' WHEN size(split(a.p_name, ' ')) <> size(split(b.p_name, ' ')) THEN 'shape' ELSE concat(size(filter(zip_with(split(a.p_name, ' '), split(b.p_name, ' '), (x, y) -> x <> y), z -> z)), ' differ') END AS relation FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "SELECT a.p_partkey, CASE WHEN a.p_name = b.p_name THEN 'same' WHEN len(string_split(a.p_name, ' ')) <> len(string_split(b.p_name, ' ')) THEN 'shape' ELSE concat(len(list_filter(list_zip(string_split(a.p_name, ' '), string_split(b.p_name, ' ')), lambda z: z[1] <> z[2])), ' differ') END AS relation FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
)


@query("""WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT substr(h, 1, 4) AS b4, sha256(string_agg(k, chr(10) ORDER BY k)) AS d, count(*) AS n FROM k GROUP BY 1),
w AS (SELECT substr(b4, 1, 2) AS b2, sha256(string_agg(d, chr(10) ORDER BY b4)) AS d, sum(n) AS n FROM p GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b2)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM w""")
def digest_frozen_split(spark, sf_dir):
    return sampling.bucket_digest(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


@query("SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest, count(*) AS n FROM nation")
def digest_names(spark, sf_dir):
    """The plain digest, for small key sets."""
    return sampling.digest(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT c_mktsegment, CAST(strpos('0123456789abcdef', right(md5(CAST(c_custkey AS VARCHAR)), 1)) - 1 AS INTEGER) % 2 AS half, count(*) AS n FROM customer GROUP BY 1, 2")
def md5_halves(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", sampling.half(F.col("c_custkey")).alias("half")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('s1|', c_custkey)), c_custkey) AS rn FROM customer) WHERE rn <= 10")
def stratified_sample_n(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 10, "s1").select("c_mktsegment", "c_custkey")


FOLD = "CAST(CAST(('0x' || substr(md5(concat('f|', c_nationkey)), 1, 8)) AS BIGINT) % 5 AS INTEGER)"


@query(f"SELECT {FOLD} AS fold, count(*) AS n, count(DISTINCT c_nationkey) AS groups FROM customer GROUP BY 1")
def grouped_folds(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "customer"), "c_nationkey", 5, "f").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("groups"))


@query(f"SELECT count(*) AS violations FROM (SELECT c_nationkey FROM (SELECT c_nationkey, {FOLD} AS fold FROM customer) GROUP BY 1 HAVING count(DISTINCT fold) > 1)")
def integrity_violations(spark, sf_dir):
    folded = sampling.folds(table(spark, sf_dir, "customer"), "c_nationkey", 5, "f")
    return folded.groupBy("c_nationkey").agg(F.countDistinct("fold").alias("k")).where("k > 1").agg(F.count("*").alias("violations"))


@query("""WITH c AS (SELECT c_custkey % 97 AS g, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT g, c_mktsegment AS main, sum(n) OVER (PARTITION BY g) AS size, row_number() OVER (PARTITION BY g ORDER BY n DESC, c_mktsegment DESC) AS k FROM c),
a AS (SELECT g, (row_number() OVER (PARTITION BY main ORDER BY size DESC, md5(concat('f|', g)), g) - 1) % 10 AS turn FROM r WHERE k = 1), f AS (SELECT g, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM a)
SELECT fold, c_mktsegment, count(*) AS n, count(DISTINCT g) AS groups FROM customer JOIN f ON g = c_custkey % 97 GROUP BY 1, 2""")
def stratified_group_folds(spark, sf_dir):
    """Groups never cross folds, and strata stay balanced."""
    d = table(spark, sf_dir, "customer").select(F.pmod("c_custkey", F.lit(97)).alias("g"), "c_mktsegment")
    return sampling.stratified_group_folds(d, "g", "c_mktsegment", 5, "f").groupBy("fold", "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("g").alias("groups"))


# Reports

sql("value_counts_top", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
sql("crosstab_counts", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s.lower()}" for s in "OFP") + " FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
sql("crosstab_share", "SELECT l_returnflag, l_linestatus, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS DOUBLE), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")


@query("SELECT coalesce(l_returnflag, 'All') AS flag, coalesce(l_linestatus, 'All') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_margins(spark, sf_dir):
    cubed = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return cubed.select(F.coalesce("l_returnflag", F.lit("All")).alias("flag"), F.coalesce("l_linestatus", F.lit("All")).alias("status"), "n")


@query("SELECT coalesce(event_type, 'All') AS event_type, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 6) AS share FROM events GROUP BY ROLLUP (event_type)")
def rollup_total(spark, sf_dir):
    rolled = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    total = rolled.where("g = 1").select(F.col("n").alias("all"))
    return rolled.crossJoin(F.broadcast(total)).select(F.coalesce("event_type", F.lit("All")).alias("event_type"), "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("SELECT o_orderpriority, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 4) AS {s.lower()}" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_mean(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))
    return p.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS o, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'X'), 4) AS x, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) AS f FROM lineitem GROUP BY 1")
def pivot_reindex(spark, sf_dir):
    """A fixed column order; a value that never occurs is a NULL column."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "X", "F"]).agg(F.round(F.avg("l_quantity"), 4))
    return p.withColumnsRenamed({"O": "o", "X": "x", "F": "f"})


sql("summarize_two_keys", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd, round(sum(l_quantity), 2) AS total, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("dup_counts", "SELECT md5(text) AS h, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")


@query("SELECT doc_id, dup_count, two > 1 AS cross_label FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS dup_count, max(quality) OVER (PARTITION BY md5(text)) - min(quality) OVER (PARTITION BY md5(text)) + 1 AS two FROM documents JOIN labels USING (doc_id)) WHERE dup_count > 1")
def dup_cross_label(spark, sf_dir):
    """Group sizes are counted by hash and joined back: a hot text stays one row on one side."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")).join(table(spark, sf_dir, "labels"), "doc_id")
    g = d.groupBy("h").agg(F.count("*").alias("dup_count"), F.countDistinct("quality").alias("k")).where("dup_count > 1")
    return d.join(g, "h").select("doc_id", "dup_count", (F.col("k") > 1).alias("cross_label"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(median(l_quantity), 4) AS median_quantity FROM lineitem GROUP BY l_returnflag")
def quantile_profile(spark, sf_dir):
    """Exact quantiles from the global order: no buffer holds a group's values."""
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    price = order.exact_quantiles(d, "l_returnflag", "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    quantity = d.groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity"))  # of 50 values
    return price.join(quantity, "l_returnflag").select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95", "median_quantity")])


sql("std_both_ddof", "SELECT event_type, round(stddev_samp(value), 6) AS sd1, round(stddev_pop(value), 6) AS sd0 FROM events GROUP BY event_type")
sql(
    "majority_vote",
    """WITH v AS (SELECT o_orderkey, array_compact(array(CASE WHEN o_totalprice >= 150000 THEN 'high' ELSE 'low' END, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'low' END, CASE WHEN o_orderstatus = 'F' THEN 'low' WHEN o_orderstatus = 'O' THEN 'high' END)) AS votes FROM orders)
SELECT o_orderkey, CASE WHEN size(filter(votes, x -> x = votes[0])) * 2 >= size(votes) THEN votes[0] ELSE votes[1] END AS vote FROM v""",
    """WITH v AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice >= 150000 THEN 'high' ELSE 'low' END, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'low' END, CASE WHEN o_orderstatus = 'F' THEN 'low' WHEN o_orderstatus = 'O' THEN 'high' END], lambda x: x IS NOT NULL) AS votes FROM orders)
SELECT o_orderkey, CASE WHEN len(list_filter(votes, lambda x: x = votes[1])) * 2 >= len(votes) THEN votes[1] ELSE votes[2] END AS vote FROM v""",
)
sql("conditional_share", "SELECT l_shipdate >= TIMESTAMP '1995-01-01' AS late, round(avg(CASE WHEN l_discount > 0.05 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share, round(avg(l_quantity) FILTER (WHERE l_tax > 0.04), 6) AS quantity FROM lineitem GROUP BY 1")
sql("histogram_bins", "SELECT CAST(floor(log10(o_totalprice) * 10) AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
sql("weighted_mean", "SELECT n_name, round(sum(c_acctbal * k) / sum(k), 4) AS weighted FROM (SELECT n_name, c_mktsegment, avg(c_acctbal) AS c_acctbal, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment) GROUP BY n_name")
sql("argmax_key", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
sql("group_sum_prefix", "SELECT split_part(p_type, ' ', 1) AS family, round(sum(abs(p_retailprice - 1000)), 2) AS total, count(*) AS n FROM part GROUP BY 1")
sql("range_buckets", "SELECT CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 30 THEN '10-30' ELSE '>=30' END AS bucket, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1")
@query("WITH m AS (SELECT p_brand AS b, median(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - m), p_partkey) AS k FROM part JOIN m ON b = p_brand) WHERE k = 1")
def nearest_to_median(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    middle = selection.quantiles(d, ["p_brand"], {"m": ("p_retailprice", 0.5)})
    nearest = F.min_by("p_partkey", F.struct(F.abs(F.col("p_retailprice") - F.col("m")), "p_partkey"))
    return d.join(middle, "p_brand").groupBy("p_brand").agg(nearest.alias("p_partkey"))


sql("one_hot_ratio", "SELECT p_partkey, CAST(p_size > 25 AS INTEGER) AS large, round(p_retailprice / p_size, 6) AS per_size, CASE WHEN p_type LIKE '%BRASS' THEN 1 ELSE 0 END AS brass FROM part WHERE p_size BETWEEN 1 AND 40 AND p_brand NOT IN ('Brand#11', 'Brand#12')")

# Joins and sets

sql("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sql("left_lookup", "SELECT c_custkey, coalesce(n_name, 'missing') AS nation, o_orderkey IS NULL AS no_order FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sql("self_fk_join", "SELECT a.o_orderkey, a.o_custkey % 3 <> b.o_custkey % 3 AS crosses FROM orders a JOIN orders b ON b.o_orderkey = a.o_custkey")
sql("protocol_filters", "SELECT k.name, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem CROSS JOIN (SELECT 'all' AS name UNION ALL SELECT 'returned' UNION ALL SELECT 'cheap') k WHERE k.name = 'all' OR (k.name = 'returned' AND l_returnflag = 'R') OR (k.name = 'cheap' AND l_extendedprice < 10000) GROUP BY k.name")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def validated_join(spark, sf_dir):
    """The join fails at run time if the key repeats on the one side."""
    from quarry.sources.tables import unique_by

    one = unique_by(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return table(spark, sf_dir, "orders").join(one, "o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, round(avg(CAST(quality AS DOUBLE) * n_chars), 4) AS mean FROM documents JOIN labels USING (doc_id)")
def one_to_one_join(spark, sf_dir):
    """As validated_join, with both sides checked."""
    from quarry.sources.tables import one_to_one

    both = one_to_one(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").cast("double") * F.col("n_chars")), 4).alias("mean"))


sql("upsert_replace", "SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey) UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")


@query("SELECT p_partkey AS id, p_name AS name, CAST(NULL AS DOUBLE) AS balance FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


sql("set_equality", "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS missing, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS extra")

# Near duplicates and components

HASHED = "SELECT vec_id, embedding, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(generate_series(1, 63), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN CAST(1 AS BIGINT) ELSE 0 END)), lambda a, b: a * 2 + b) AS h FROM embeddings"
PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM ({HASHED}) a JOIN ({HASHED}) b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 16"


def hashed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", graph.gradient_hash(F.col("embedding")).alias("h"))


@query(PAIRS)
def near_dup_hamming(spark, sf_dir):
    return graph.hamming_pairs(hashed(spark, sf_dir), "vec_id", "h", 16)


@query(f"WITH p AS ({PAIRS}) SELECT p.a, p.b, round(list_sum(list_transform(generate_series(1, 64), lambda i: abs(CAST(x.embedding[i] AS FLOAT) - y.embedding[i]))) / 64, 4) AS mad FROM p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b WHERE x.label = y.label")
def near_dup_verified(spark, sf_dir):
    """Cheap candidates first, then the costly comparison of what they name."""
    h = hashed(spark, sf_dir)
    v = h.select("vec_id", "label", "embedding")
    pairs = graph.hamming_pairs(h, "vec_id", "h", 16).join(v.toDF("a", "la", "ea"), "a").join(v.toDF("b", "lb", "eb"), "b")
    return pairs.where("la = lb").select("a", "b", F.round(graph.mean_abs_difference(F.col("ea"), F.col("eb")), 4).alias("mad"))


CLOSED = f"""WITH RECURSIVE e AS ({PAIRS}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


@query(f"{CLOSED} SELECT node, root FROM c")
def components_min_label(spark, sf_dir):
    return graph.components(graph.hamming_links(hashed(spark, sf_dir), "vec_id", "h", 16))


@query(f"{CLOSED} SELECT root, count(*) AS size FROM c GROUP BY root")
def component_sizes(spark, sf_dir):
    return components_min_label(spark, sf_dir).groupBy("root").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE e AS ({PAIRS}), n AS (SELECT DISTINCT unnest([a, b]) AS node FROM e), x AS (SELECT a, b FROM e UNION ALL SELECT p.node, q.node FROM n p JOIN n q ON q.node = p.node + 1), s AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
r AS (SELECT node, node AS root FROM n UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node) SELECT root, count(*) AS size FROM c GROUP BY root""")
def what_if_component(spark, sf_dir):
    """Sizes after edges between neighbouring ids are added."""
    labels = cut_lineage(components_min_label(spark, sf_dir))
    nodes = labels.select("node")
    extra = nodes.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(nodes.select(F.col("node").alias("b")), "b").select("a", "b")
    return graph.what_if(labels, extra)


# Windows and tests

@query("SELECT t, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM (SELECT n_chars, CAST(greatest(ceil(percent_rank() OVER (ORDER BY n_chars, doc_id) * 3), 1) AS INTEGER) AS t FROM documents) GROUP BY t")
def tercile_profile(spark, sf_dir):
    d = order.terciles(table(spark, sf_dir, "documents").select("n_chars", "doc_id"), ["n_chars", "doc_id"], "t")
    return d.groupBy("t").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


P_VALUES = "SELECT p_brand, count(*) / CAST(20000 AS DOUBLE) + CAST(min(p_size) AS DOUBLE) / 1000 AS p FROM part GROUP BY p_brand"


@query(f"SELECT p_brand, round(p, 6) AS p, round(least(1, max((m - rn + 1) * p) OVER (ORDER BY p, p_brand)), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, p_brand) AS rn, count(*) OVER () AS m FROM ({P_VALUES}))")
def holm_adjust(spark, sf_dir):
    register(spark, sf_dir, "part")
    return stats.holm(spark.sql(P_VALUES), "p", "p_brand").select("p_brand", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query("SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM orders")
def running_max(spark, sf_dir):
    d = order.deal(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_orderkey"], ("o_custkey",))
    return d.scan({"best": order.largest("o_totalprice")}).rows.drop("o_totalprice")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM orders),
l AS (SELECT *, max(CASE WHEN o_totalprice = best THEN k END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_at FROM b) SELECT o_custkey, CAST(min(k) AS BIGINT) AS stops FROM l WHERE k - best_at >= 3 GROUP BY o_custkey""")
def early_stopping(spark, sf_dir):
    """The first order that is the third in a row without a new best."""
    d = order.deal(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_orderkey"], ("o_custkey",))
    d = d.scan({"k": order.total(F.lit(1).cast("long")), "best": order.largest("o_totalprice")})
    d = d.scan({"best_at": order.largest(F.when(F.col("o_totalprice") == F.col("best"), F.col("k")))})
    return d.rows.where("k - best_at >= 3").groupBy("o_custkey").agg(F.min("k").alias("stops"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase, arg_max(event_id, struct_pack(v := value, e := event_id)) OVER w AS best_event
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_last_and_best(spark, sf_dir):
    """For each event of a user the last value of a kind so far, and the event with the largest value so far."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"))
    d = order.deal(d, ["event_id"], ("user_id",)).scan({"last_purchase": order.latest("bought", ["event_id"]), "best_event": order.holder("value", "event_id")})
    return d.rows.drop("value", "bought")


sql("row_share", "SELECT n_regionkey, n_name, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY n_regionkey) AS DOUBLE), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name")
sql("best_worst_picks", "SELECT c_mktsegment, c_custkey, CASE WHEN k <= 2 THEN 'best' WHEN k > n - 2 THEN 'worst' ELSE 'median' END AS pick FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k <= 2 OR k > n - 2 OR k - floor(n / 2) IN (0, 1)")

FACTS = "SELECT quality AS y, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS p, lang, n_chars, toxic FROM labels JOIN documents USING (doc_id)"


@query(f"""WITH f AS ({FACTS}), u AS (SELECT y <> p AS wrong, unnest(['long', 'toxic', 'english']) AS name, unnest([n_chars > 5000, toxic = 1, lang = 'en']) AS hit FROM f)
SELECT name, count(*) FILTER (WHERE wrong AND hit) AS a, count(*) FILTER (WHERE wrong AND NOT hit) AS b, count(*) FILTER (WHERE NOT wrong AND hit) AS c, count(*) FILTER (WHERE NOT wrong AND NOT hit) AS d FROM u GROUP BY name""")
def enrichment_counts(spark, sf_dir):
    return enrichment(spark, sf_dir)


def enrichment(spark, sf_dir):
    register(spark, sf_dir, "labels", "documents")
    marks = F.explode(F.create_map(F.lit("long"), F.col("n_chars") > 5000, F.lit("toxic"), F.col("toxic") == 1, F.lit("english"), F.col("lang") == "en")).alias("name", "hit")
    u = spark.sql(FACTS).select((F.col("y") != F.col("p")).alias("wrong"), marks)
    count = lambda w, h: F.count_if((F.col("wrong") == w) & (F.col("hit") == h))
    return u.groupBy("name").agg(count(True, True).alias("a"), count(True, False).alias("b"), count(False, True).alias("c"), count(False, False).alias("d"))


LOG_CHOOSE = "(lgamma({0} + 1) - CASE WHEN {1} > 0 THEN lgamma({1} + 1) ELSE 0 END - CASE WHEN {0} - {1} > 0 THEN lgamma({0} - {1} + 1) ELSE 0 END)"


@query(f"""WITH f AS ({FACTS}), u AS (SELECT y <> p AS wrong, unnest(['long', 'toxic', 'english']) AS name, unnest([n_chars > 5000, toxic = 1, lang = 'en']) AS hit FROM f),
t AS (SELECT name, count(*) FILTER (WHERE wrong AND hit) AS a, count(*) FILTER (WHERE wrong AND NOT hit) AS b, count(*) FILTER (WHERE NOT wrong AND hit) AS c, count(*) FILTER (WHERE NOT wrong AND NOT hit) AS d FROM u GROUP BY name),
k AS (SELECT *, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS k FROM t),
l AS (SELECT *, {LOG_CHOOSE.format('(a + b)', 'k')} + {LOG_CHOOSE.format('(c + d)', '(a + c - k)')} - {LOG_CHOOSE.format('(a + b + c + d)', '(a + c)')} AS lp FROM k),
m AS (SELECT *, max(CASE WHEN k = a THEN lp END) OVER (PARTITION BY name) AS own FROM l)
SELECT name, round(a / nullif(CAST(a + b AS DOUBLE), 0), 6) AS in_errors, round(c / nullif(CAST(c + d AS DOUBLE), 0), 6) AS in_others, round((a / nullif(CAST(a + b AS DOUBLE), 0)) / nullif(c / nullif(CAST(c + d AS DOUBLE), 0), 0), 6) AS ratio, round(least(1.0::DOUBLE, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM m GROUP BY name, a, b, c, d""")
def enrichment_table(spark, sf_dir):
    """Shares among errors and others, their ratio, and Fisher's exact p, one row a predicate."""
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_p(*map(int, x)) for x in zip(a, b, c, d)])

    share = lambda x, y: F.try_divide(F.col(x), F.col(x) + F.col(y))
    return enrichment(spark, sf_dir).select("name", F.round(share("a", "b"), 6).alias("in_errors"), F.round(share("c", "d"), 6).alias("in_others"), F.round(F.try_divide(share("a", "b"), share("c", "d")), 6).alias("ratio"), F.round(p("a", "b", "c", "d"), 6).alias("p"))


MC = f"SELECT count(*) FILTER (WHERE p = y AND q <> y) AS only_a, count(*) FILTER (WHERE p <> y AND q = y) AS only_b FROM (SELECT *, CASE WHEN n_chars >= 3000 THEN 1 ELSE 0 END AS q FROM ({FACTS}))"
sql("mcnemar_counts", MC)


@query(f"""WITH c AS ({MC}), i AS (SELECT *, only_a + only_b AS n, unnest(generate_series(0, least(only_a, only_b))) AS i FROM c)
SELECT only_a, only_b, round(least(1.0::DOUBLE, 2 * sum(exp({LOG_CHOOSE.format('n', 'i')} - n * ln(2.0::DOUBLE)))), 6) AS p FROM i GROUP BY only_a, only_b""")
def mcnemar_test(spark, sf_dir):
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([stats.mcnemar_p(int(x), int(y)) for x, y in zip(a, b)])

    return CATALOGUE["mcnemar_counts"][0](spark, sf_dir).select("only_a", "only_b", F.round(p("only_a", "only_b"), 6).alias("p"))


# Bootstrap

DRAWN = """g AS (SELECT {group} AS grp, row_number() OVER (ORDER BY {group}) - 1 AS k FROM (SELECT DISTINCT {group} FROM {source})), n AS (SELECT count(*) AS n FROM g),
d AS (SELECT r, CAST(('0x' || substr(md5(concat(r, '|', i)), 1, 8)) AS BIGINT) % n AS k, count(*) AS times FROM n, (SELECT unnest(generate_series(0, {last})) AS r) rr, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i) ii GROUP BY 1, 2),
t AS (SELECT r, grp, times FROM d JOIN g USING (k))"""


@query(f"""WITH {DRAWN.format(group='l_suppkey', source='lineitem', last=99)}, s AS (SELECT l_suppkey AS grp, sum(l_quantity) AS s, count(l_quantity) AS c FROM lineitem GROUP BY 1),
m AS (SELECT r, sum(s * times) / sum(c * times) AS m FROM t JOIN s USING (grp) GROUP BY r)
SELECT (SELECT round(avg(l_quantity), 6) FROM lineitem) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def group_bootstrap_mean(spark, sf_dir):
    return bootstrap.bootstrap_mean(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 100)


@query(f"""WITH {DRAWN.format(group='l_suppkey', source='lineitem', last=99)}, s AS (SELECT l_suppkey AS grp, sum(l_discount - l_tax) AS s, count(*) AS c FROM lineitem GROUP BY 1),
m AS (SELECT r, sum(s * times) / sum(c * times) AS m FROM t JOIN s USING (grp) GROUP BY r)
SELECT (SELECT round(avg(l_discount - l_tax), 6) FROM lineitem) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
round(least(1, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN m >= 0 THEN 1.0::DOUBLE ELSE 0 END))), 6) AS p FROM m""")
def paired_bootstrap_delta(spark, sf_dir):
    return bootstrap.paired_delta(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", "l_tax", 100)


@query(f"""WITH x AS (SELECT source, quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), {DRAWN.format(group='source', source='x', last=49)},
w AS (SELECT r, s, sum(CASE WHEN y = 1 THEN times ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN times ELSE 0 END) AS n FROM t JOIN x ON x.source = t.grp GROUP BY r, s),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
a AS (SELECT r, round(sum(p * (below + n / 2.0::DOUBLE)) / nullif((sum(p) * sum(n))::DOUBLE, 0), 6) AS auc FROM c GROUP BY r),
o AS (SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM x))
SELECT (SELECT auc FROM o) AS estimate, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(*) AS replicates FROM a WHERE auc IS NOT NULL""")
def bootstrap_auc(spark, sf_dir):
    return bootstrap.bootstrap_auc(labelled(spark, sf_dir), "source", "quality", "n_chars", 50)


# Grids

CELLS = "SELECT event_type, CAST(hour(ts) AS INTEGER) AS y, CAST(user_id % 16 AS INTEGER) AS x, sum(value) AS v FROM events GROUP BY 1, 2, 3"


def cells(spark, sf_dir):
    register(spark, sf_dir, "events")
    return spark.sql(CELLS)


@query(f"""WITH g AS ({CELLS}), m AS (SELECT event_type, median(v) AS m, stddev_pop(v) AS sd FROM g GROUP BY 1), d AS (SELECT event_type, median(abs(v - m)) AS mad FROM g JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, y, x, round(least(50, greatest(-50, (v - m) / greatest(1.4826 * mad, 1e-6 * (abs(m) + 1), 0.1 * sd))), 4) AS z FROM g JOIN m USING (event_type) JOIN d USING (event_type)""")
def robust_z_outliers(spark, sf_dir):
    return grid.robust_z(cells(spark, sf_dir), "event_type", "v").select("event_type", "y", "x", F.round("z", 4).alias("z"))


@query(f"""WITH g AS ({CELLS}), d AS (SELECT event_type, y, x, v - avg(v) OVER (PARTITION BY event_type) AS d FROM g), p AS (SELECT a.event_type, count(*) AS w, sum(a.d * b.d) AS c FROM d a JOIN d b ON a.event_type = b.event_type AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)) GROUP BY 1)
SELECT d.event_type, count(*) AS n, round(count(*) * min(c) / (min(w) * sum(d * d)), 6) AS moran FROM d JOIN p USING (event_type) GROUP BY 1""")
def moran_grid(spark, sf_dir):
    return grid.morans_i(cells(spark, sf_dir), "event_type", "y", "x", "v")


@query(f"SELECT event_type, CAST(floor(y / 4) AS BIGINT) AS \"by\", CAST(floor(x / 4) AS BIGINT) AS bx, round(avg(v), 6) AS mean, count(*) AS n FROM ({CELLS}) GROUP BY 1, 2, 3")
def grid_block_mean(spark, sf_dir):
    return grid.block_mean(cells(spark, sf_dir), "event_type", "y", "x", "v", 4)


@query(f"SELECT a.event_type, a.y, a.x, round((SELECT sum(b.v) FROM ({CELLS}) b WHERE b.event_type = a.event_type AND b.y <= a.y AND b.x <= a.x AND EXISTS (SELECT 1 FROM ({CELLS}) c WHERE c.event_type = a.event_type AND c.y = b.y AND c.x = a.x)), 3) AS integral FROM ({CELLS}) a")
def integral_window(spark, sf_dir):
    return grid.integral(cells(spark, sf_dir), "event_type", "y", "x", "v").select("event_type", "y", "x", F.round("integral", 3).alias("integral"))


@query(f"SELECT event_type, y, x, round(sum(v) OVER (PARTITION BY event_type, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS moving FROM ({CELLS})")
def moving_sum(spark, sf_dir):
    d = cells(spark, sf_dir).withColumn("row", F.concat_ws("|", "event_type", "y"))
    return grid.moving_sum(d, "row", "x", "v", 4).select("event_type", "y", "x", F.round("moving", 4).alias("moving"))


LAGS = """WITH o AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS a, l_quantity AS q, l_discount AS d, """ + ", ".join(f"lead(struct_pack(k := l_orderkey * 8 + l_linenumber, q := l_quantity, d := l_discount), {i}) OVER w AS n{i}" for i in range(1, 6)) + """ FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity, l_discount, l_orderkey * 8 + l_linenumber)),
u AS (SELECT l_suppkey, a, q, d, unnest([n1, n2, n3, n4, n5]) AS n FROM o) SELECT l_suppkey, a, n.k AS b FROM u WHERE abs(q - n.q) <= 0.015 AND abs(d - n.d) <= 0.015"""


@query(LAGS)
def lag_neighbours(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), "l_quantity", "l_discount")
    return grid.sorted_neighbours(d, "l_suppkey", "key", ["l_quantity", "l_discount"], 5, 0.015)


@query(f"SELECT CAST(floor((b - a) / 2048) AS BIGINT) AS \"by\", CAST(floor(l_suppkey / 2) AS BIGINT) AS bx, count(*) AS votes FROM ({LAGS}) GROUP BY 1, 2 HAVING count(*) >= 3")
def shift_votes(spark, sf_dir):
    pairs = lag_neighbours(spark, sf_dir).select(((F.col("b") - F.col("a")) / 1024).alias("dy"), F.col("l_suppkey").alias("dx"))
    return grid.shift_votes(pairs, "dy", "dx", 2, 3)


@query(f"""WITH m AS (SELECT event_type, v > 500 AS a, v > 700 AS b FROM ({CELLS})), c AS (SELECT event_type, CAST(count(*) FILTER (WHERE a AND b) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT a AND b) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE a AND NOT b) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT a AND NOT b) AS DOUBLE) AS tn FROM m GROUP BY 1)
SELECT event_type, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END, 6) AS iou, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c""")
def cell_scores(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("event_type").agg(*stats.mask_scores(F.col("v") > 500, F.col("v") > 700))


# Arrays, models, streams



@query("""WITH p AS (SELECT vec_id, unnest(generate_series(0, 63)) AS i, unnest(embedding) AS v FROM embeddings), k AS (SELECT unnest(generate_series(0, 7)) AS u), b AS (SELECT x.u AS u, y.u AS v FROM k x, k y),
c AS (SELECT vec_id, b.u, b.v, sum(CAST(p.v AS DOUBLE) * cos(pi() * (2 * (i // 8) + 1) * b.u / 16) * cos(pi() * (2 * (i % 8) + 1) * b.v / 16)) * (CASE WHEN b.u = 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE WHEN b.v = 0 THEN sqrt(0.125) ELSE 0.5 END) AS c FROM p, b GROUP BY 1, 2, 3)
SELECT vec_id, round(sum(CASE WHEN u + v > 0 THEN c * c ELSE 0 END), 4) AS ac, round(sum(CASE WHEN u + v = 0 THEN c ELSE 0 END), 4) AS dc FROM c GROUP BY 1""")
def dct_block_energy(spark, sf_dir):
    """The 8x8 DCT of a vector of 64, a batch of blocks in two matrix products."""
    d = arrays.dct_matrix()

    @F.pandas_udf("ac double, dc double")
    def energy(v: pd.Series) -> pd.DataFrame:
        c = d @ np.stack(v.to_list()).astype(float).reshape(-1, 8, 8) @ d.T if len(v) else np.zeros((0, 8, 8))
        return pd.DataFrame({"ac": (c * c).sum(axis=(1, 2)) - c[:, 0, 0] ** 2, "dc": c[:, 0, 0]})

    return table(spark, sf_dir, "embeddings").select("vec_id", energy("embedding").alias("e")).select("vec_id", F.round("e.ac", 4).alias("ac"), F.round("e.dc", 4).alias("dc"))


@query("SELECT vec_id, CAST(2 + vec_id % 98 AS INTEGER) AS quality, CAST(2 + vec_id % 98 AS INTEGER) AS estimate, 2 AS n_qtables, label + 8 AS width FROM embeddings")
def jpeg_table_quality(spark, sf_dir):
    """JPEG headers of known quality are written as bytes, read by the metadata scan, and the quality estimated from their tables."""
    @F.pandas_udf("binary")
    def header(i: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([arrays.jpeg_header(2 + int(k) % 98, int(x) + 8, 16) for k, x in zip(i, w)])

    @F.pandas_udf("int")
    def estimate(content: pd.Series) -> pd.Series:
        return pd.Series([arrays.estimate_quality(np.array(quantisation_tables(bytes(c))[0])) for c in content])

    made = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), header("vec_id", "label").alias("content"), "vec_id")
    read = metadata(made.select("path", "content")).select(F.col("path").cast("long").alias("vec_id"), "n_qtables", "width")
    return made.select("vec_id", (2 + F.col("vec_id") % 98).cast("int").alias("quality"), estimate("content").alias("estimate")).join(read, "vec_id")


def scored(spark, sf_dir, model="forest"):
    d = labelled(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n_words"), F.size(F.regexp_extract_all("text", F.lit("([#*$%&|!])"), F.lit(1))).alias("n_marks")), "doc_id")
    d = sampling.folds(d.withColumn("label", F.col("quality")), "source", 3, "cv").select("doc_id", "label", "fold", *[F.col(c).cast("double").alias(c) for c in ("n_chars", "n_words", "n_marks")])
    return models.out_of_fold(d, ["n_chars", "n_words", "n_marks"], "fold", 3, models.MODELS[model]) if model else d


@query(None)
def rf_oof_auc(spark, sf_dir):
    """Out-of-fold area of a random forest under grouped folds."""
    return stats.auc(scored(spark, sf_dir), "label", "score")


@query(None)
def isotonic_calibration(spark, sf_dir):
    """Brier score before and after isotonic calibration fitted on the other folds."""
    c = models.calibrated(scored(spark, sf_dir, "logistic"), "fold", 3)
    brier = lambda p: F.round(F.avg((F.col(p) - F.col("label")) * (F.col(p) - F.col("label"))), 6)
    return c.agg(brier("score").alias("before"), brier("calibrated").alias("after"), F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return streaming.tumbling(table(spark, sf_dir, "events"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return streaming.sessions(table(spark, sf_dir, "events"))
