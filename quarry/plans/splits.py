"""Queries on leakage-safe splits, deterministic samples and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, order, sampling, selection, splits
from quarry.plans.catalogue import PAIRS, hashed, query, sql
from quarry.sources.tables import register, table

# Groups from three rules, and what each merges

RULES = f"""n AS (SELECT doc_id AS node FROM documents), e1 AS (SELECT min(doc_id) OVER (PARTITION BY md5(text)) AS a, doc_id AS b FROM documents WHERE text IS NOT NULL),
e2 AS (SELECT p.a, p.b FROM ({PAIRS}) p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b WHERE list_sum(list_transform(generate_series(1, 64), lambda i: abs(CAST(x.embedding[i] AS DOUBLE) - y.embedding[i]))) / 64 < 1.2),
e3 AS (SELECT doc_id AS a, doc_id - 1 AS b FROM labels WHERE toxic = 1)"""
CLOSE = """r{k} AS (SELECT node, node AS root FROM n UNION SELECT s.b, r{k}.root FROM r{k} JOIN (SELECT a, b FROM x{k} UNION ALL SELECT b, a FROM x{k}) s ON s.a = r{k}.node), c{k} AS (SELECT node, min(root) AS root FROM r{k} GROUP BY node)"""
KNOWN = "WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)"
GROUPS = f"""WITH RECURSIVE {RULES}, x1 AS (SELECT * FROM e1 {KNOWN}), x2 AS (SELECT * FROM x1 UNION ALL SELECT * FROM e2 {KNOWN}), x3 AS (SELECT * FROM x2 UNION ALL SELECT * FROM e3 {KNOWN}), """ + ", ".join(CLOSE.format(k=k) for k in (1, 2, 3))


def merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    exact = docs.where("h is not null").join(first, "h").select("a", F.col("doc_id").alias("b"))
    known = hashed(spark, sf_dir).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")  # links must not lead over unknown ends
    near = graph.hamming_links(known, "vec_id", "h", 16, "embedding", 1.2)
    donors = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") - 1).alias("b"))
    return splits.merge_rules(docs.select(F.col("doc_id").alias("node")), [("exact", exact), ("near", near), ("donor", donors)])


@query(f"""{GROUPS} SELECT * FROM (SELECT 'exact' AS rule, 0 AS position, (SELECT count(*) FROM n) - (SELECT count(DISTINCT root) FROM c1) AS merges UNION ALL SELECT 'near', 1, (SELECT count(DISTINCT root) FROM c1) - (SELECT count(DISTINCT root) FROM c2) UNION ALL SELECT 'donor', 2, (SELECT count(DISTINCT root) FROM c2) - (SELECT count(DISTINCT root) FROM c3))""")
def merge_rule_counts(spark, sf_dir):
    """Same text, verified near duplicate, donor: by how many groups each rule, in its turn, has fewer."""
    return merged(spark, sf_dir)[1]


@query(f"{GROUPS} SELECT node AS doc_id, root AS split_group FROM c3")
def split_groups(spark, sf_dir):
    return merged(spark, sf_dir)[0].toDF("doc_id", "split_group")


DEALT = """{c} AS (SELECT g, s, count(*) AS n FROM {rows} GROUP BY 1, 2), {c}r AS (SELECT g, s AS main, sum(n) OVER (PARTITION BY g) AS size, row_number() OVER (PARTITION BY g ORDER BY n DESC, s DESC) AS k FROM {c}),
{c}a AS (SELECT g, (row_number() OVER (PARTITION BY main ORDER BY size DESC, md5(concat('{seed}|', g)), g) - 1) % {twice} AS turn FROM {c}r WHERE k = 1), {c}f AS (SELECT g, CAST(CASE WHEN turn < {k} THEN turn ELSE {twice} - 1 - turn END AS INTEGER) AS fold FROM {c}a)"""
TABLE = f"""WITH base AS (SELECT c_custkey, c_custkey % 211 AS g, c_mktsegment AS s FROM customer), {DEALT.format(c='b', rows='base', seed='seed', k=20, twice=40)},
placed AS (SELECT c_custkey, base.g, s, CASE WHEN fold < 3 THEN 'test' WHEN fold < 6 THEN 'val' ELSE 'train' END AS split FROM base JOIN bf ON bf.g = base.g), dev AS (SELECT * FROM placed WHERE split <> 'test'), {DEALT.format(c='d', rows='dev', seed='seed|cv', k=5, twice=10)},
final AS (SELECT c_custkey, split, coalesce(fold, -1) AS cv_fold, placed.g AS split_group, s FROM placed LEFT JOIN df ON split <> 'test' AND df.g = placed.g)"""


def split(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(211)).alias("g"), F.col("c_mktsegment").alias("s"))
    return splits.make_splits(d, "c_custkey", "g", "s", "seed")


@query(f"{TABLE} SELECT c_custkey, split, cv_fold, split_group FROM final")
def split_table(spark, sf_dir):
    """70/15/15 from twenty bins of whole groups, and five folds of what isn't test."""
    return split(spark, sf_dir)


@query(f"{TABLE} SELECT coalesce(s, 'All') AS stratum, round(count(*) FILTER (WHERE split = 'train') / CAST(count(*) AS DOUBLE), 6) AS train, round(count(*) FILTER (WHERE split = 'val') / CAST(count(*) AS DOUBLE), 6) AS val, round(count(*) FILTER (WHERE split = 'test') / CAST(count(*) AS DOUBLE), 6) AS test, count(*) AS n FROM final GROUP BY ROLLUP (s)")
def split_shares(spark, sf_dir):
    d = split(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("s")), "c_custkey")
    share = lambda name: F.round(F.count_if(F.col("split") == name) / F.count("*"), 6).alias(name)
    return d.rollup("s").agg(share("train"), share("val"), share("test"), F.count("*").alias("n")).select(F.coalesce("s", F.lit("All")).alias("stratum"), "train", "val", "test", "n")


@query("SELECT CAST(0 AS BIGINT) AS repeated_keys, CAST(0 AS BIGINT) AS split_groups, CAST(0 AS BIGINT) AS folded_groups, CAST(0 AS BIGINT) AS wrong_folds")
def split_invariants(spark, sf_dir):
    return splits.violations(split(spark, sf_dir), "c_custkey")


BUCKETS = """p{i} AS (SELECT substr(md5(k), 1, 4) AS b4, sha256(string_agg(k, chr(10) ORDER BY k)) AS d, count(*) AS n FROM ({keys}) GROUP BY 1), w{i} AS (SELECT substr(b4, 1, 2) AS b2, sha256(string_agg(d, chr(10) ORDER BY b4)) AS d, sum(n) AS n FROM p{i} GROUP BY 1)"""


@query(f"""{TABLE}, {BUCKETS.format(i=1, keys="SELECT CAST(c_custkey AS VARCHAR) AS k FROM final WHERE split = 'test'")}, {BUCKETS.format(i=2, keys="SELECT concat_ws(chr(9), c_custkey, split, cv_fold) AS k FROM final")}
SELECT 'test' AS name, sha256(string_agg(d, chr(10) ORDER BY b2)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM w1 UNION ALL SELECT 'full', sha256(string_agg(d, chr(10) ORDER BY b2)), CAST(sum(n) AS BIGINT) FROM w2""")
def split_digests(spark, sf_dir):
    """The frozen test set, and every row of the split, as digests that change with any key."""
    s = split(spark, sf_dir)
    full = s.select(F.concat_ws("\t", "c_custkey", "split", "cv_fold").alias("row"))
    test = sampling.bucket_digest(s.where("split = 'test'"), "c_custkey").withColumn("name", F.lit("test"))
    return test.unionByName(sampling.bucket_digest(full, "row").withColumn("name", F.lit("full")))


# Samples and orders


@query("SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY md5(concat('b|', c_custkey)), c_custkey) AS k FROM customer) WHERE k <= 3")
def balanced_sample(spark, sf_dir):
    """As many of each class of each group, where there are as many."""
    return sampling.balanced_sample(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"], 3, "b").select("c_nationkey", "c_mktsegment", "c_custkey")


@query("SELECT c_custkey, CASE WHEN k <= 40 THEN 'clean' WHEN k <= 70 THEN 'blurred' ELSE 'noisy' END AS slice FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(concat('s|', c_custkey)), c_custkey) AS k FROM customer) WHERE k <= 90")
def shuffled_slices(spark, sf_dir):
    return sampling.slices(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"clean": 40, "blurred": 30, "noisy": 20}, "s")


sql(
    "random_picks",
    "SELECT c_mktsegment, c_custkey, k FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('r|', c_custkey)), c_custkey) AS INTEGER) AS k FROM customer) WHERE k <= 2",
)
@query("SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (ORDER BY p, o_orderkey) AS BIGINT) AS place FROM (SELECT o_orderpriority, o_orderkey, list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], o_orderpriority) AS p FROM orders) WHERE p > 0")
def custom_order(spark, sf_dir):
    """All rows whose key is in a list, numbered in the list's order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("3-MEDIUM", "1-URGENT", "5-LOW")]), F.col("o_orderpriority"))
    d = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", rank.alias("p")).where("p > 0")
    return order.numbered(d, ["p", "o_orderkey"], "at").select("o_orderpriority", "o_orderkey", (F.col("at") + 1).alias("place"))


sql("largest_by_size", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 12")


@query("WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) SELECT p_partkey, s_suppkey FROM a JOIN b USING (k)")
def positional_join(spark, sf_dir):
    """Rows side by side: both are numbered in an order that is named, never in the one they happen to have."""
    a = order.numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "k")
    b = order.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "k")
    return a.join(b, "k").select("p_partkey", "s_suppkey")


@query("WITH u AS (SELECT l_returnflag AS f, l_linestatus AS s, l_tax AS t, count(*) AS n, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_tax) - 1 AS code FROM lineitem GROUP BY 1, 2, 3) SELECT l_orderkey, l_linenumber, code, n FROM lineitem JOIN u ON f = l_returnflag AND s = l_linestatus AND t = l_tax")
def unique_codes(spark, sf_dir):
    """Distinct keys with their counts, and for each row the number of its key."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax")
    keys = ["l_returnflag", "l_linestatus", "l_tax"]
    codes = order.numbered(d.groupBy(*keys).agg(F.count("*").alias("n")), keys, "code")
    return d.join(codes, keys).select("l_orderkey", "l_linenumber", "code", "n")


sql("intersect_except", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sql("multi_filter_browse", "SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND n_name LIKE '%A%' AND c_name IS NOT NULL ORDER BY c_custkey LIMIT 200")
sql("size_pairs", "SELECT p_partkey, least(p_size, p_partkey % 50) = 7 AND greatest(p_size, p_partkey % 50) = 13 AS swapped, CAST(greatest(p_size, p_partkey % 50) - least(p_size, p_partkey % 50) AS BIGINT) AS apart FROM part")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem WHERE l_quantity > 25 AND l_linestatus = 'O' GROUP BY 1")
def bound_filter(spark, sf_dir):
    """An expression with named variables, bound as values and never spliced into the text."""
    register(spark, sf_dir, "lineitem")
    return spark.sql("SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem WHERE l_quantity > :least AND l_linestatus = :status GROUP BY 1", args={"least": 25, "status": "O"})


@query("SELECT 'l_orderkey' AS name, sum(l_orderkey)::BIGINT AS total FROM lineitem UNION ALL SELECT 'l_partkey', sum(l_partkey)::BIGINT FROM lineitem UNION ALL SELECT 'l_suppkey', sum(l_suppkey)::BIGINT FROM lineitem")
def columns_by_pattern(spark, sf_dir):
    """Columns whose names follow a pattern, one row each."""
    d = table(spark, sf_dir, "lineitem")
    d = d.select(d.colRegex("`l_.*key`"))
    return d.agg(*[F.sum(c).alias(c) for c in d.columns]).unpivot([], d.columns, "name", "total")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def guarded_selection(spark, sf_dir):
    """A selection that must not be empty: the job fails where it is."""
    d = table(spark, sf_dir, "orders").where("o_totalprice > 1000")
    return require_rows(d.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "no order over 1000")


def require_rows(df, message):
    """df, or ValueError at once if it has no row: Spark may drop a check that stands beside an empty table."""
    if df.isEmpty():
        raise ValueError(message)
    return df


# More reports

sql(
    "pivot_two_levels",
    "SELECT * FROM (SELECT l_returnflag, concat_ws('_', l_linestatus, CAST(l_linenumber AS STRING)) AS k, l_quantity FROM lineitem) PIVOT (round(avg(l_quantity), 4) FOR k IN ('F_1' AS f_1, 'F_2' AS f_2, 'O_1' AS o_1, 'O_2' AS o_2))",
    "SELECT l_returnflag, " + ", ".join(f"round(avg(l_quantity) FILTER (WHERE l_linestatus = '{s}' AND l_linenumber = {i}), 4) AS {s.lower()}_{i}" for s in "FO" for i in (1, 2)) + " FROM lineitem GROUP BY 1",
)
@query("SELECT c_mktsegment, " + ", ".join(f"round(median(c_acctbal) FILTER (WHERE c_nationkey % 3 = {i}), 4) AS m{i}" for i in range(3)) + " FROM customer GROUP BY 1")
def pivot_median(spark, sf_dir):
    """Medians of two levels, the inner one as columns: each is a column of its own for the histograms."""
    d = table(spark, sf_dir, "customer").select("c_mktsegment", *[F.when(F.col("c_nationkey") % 3 == i, F.col("c_acctbal")).alias(f"v{i}") for i in range(3)])
    middle = selection.quantiles(d, ["c_mktsegment"], {f"m{i}": (f"v{i}", 0.5) for i in range(3)})
    return middle.select("c_mktsegment", *[F.round(f"m{i}", 4).alias(f"m{i}") for i in range(3)])


sql("most_frequent_json", "SELECT event_type, props FROM (SELECT event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first_id) AS k FROM (SELECT event_type, props, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type, props)) WHERE k = 1")
sql("pooled_tiles", "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean, max(l_discount) AS most, count(*) AS tiles FROM lineitem GROUP BY l_suppkey")
@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS k, lead(o_totalprice) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)), s AS (SELECT *, min(CASE WHEN next IS NULL OR o_totalprice >= CAST(0.6 AS DOUBLE) * next THEN k END) OVER (PARTITION BY o_custkey) AS stop FROM o) SELECT o_custkey, o_orderkey FROM s WHERE k < stop")
def take_while(spark, sf_dir):
    """Orders from the cheapest up, as long as each is under 0.6 of the next."""
    d = order.deal(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], ("o_custkey",))
    d = d.ahead(1, "next", F.col("o_totalprice")).scan({"goes": order.every(F.col("o_totalprice") < F.lit(0.6) * F.try_element_at("next", F.lit(1)))})
    return d.rows.where("goes").select("o_custkey", "o_orderkey")


sql(
    "protocol_variants",
    "SELECT doc_id, v.protocol AS protocol, v.quality AS quality FROM documents LATERAL VIEW explode(array(struct('A' AS protocol, CAST(NULL AS INT) AS quality), struct('B75' AS protocol, 75 AS quality), struct('B85' AS protocol, 85 AS quality), struct('B95' AS protocol, 95 AS quality))) e AS v",
    "SELECT doc_id, v.protocol AS protocol, v.quality AS quality FROM (SELECT doc_id, unnest([{'protocol': 'A', 'quality': NULL::INTEGER}, {'protocol': 'B75', 'quality': 75}, {'protocol': 'B85', 'quality': 85}, {'protocol': 'B95', 'quality': 95}]) AS v FROM documents)",
)
