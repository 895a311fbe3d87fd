"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Method: a rule rejects a document whose measure is above a cutoff. In each
stratum (language) the labelled good texts that pass the base are the holdout: a text is
one document, however many copies of it are labelled, since the bound needs
independent ones (near copies are not found here; take them out before). A path of STEPS sets of cutoffs, one cutoff a rule in each, goes from
lenient to strict; it is shaped on other documents than the holdout, the good
ones of all other strata (with one stratum only: on one half, and the other half
is the holdout). A set is certified while the exact (Clopper-Pearson) upper bound
of the rate of good documents that any of its rules rejects is `alpha` or less;
the walk ends at the first set that isn't (fixed-sequence testing, so no further
correction along the path). The error level `delta` is divided by the number of
strata (Bonferroni), so all certified sets of all strata hold at once with
1 - delta, and the one that rejects most of the labelled bad documents is taken,
the most lenient of ties. Without a rejection, about ln(strata / delta) / alpha good
documents certify a set: 437 for 4 strata at 0.05 and 0.01. A stratum without a
certified set rejects nothing beyond the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import bound_batches, materialise, release

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Rules: measures of which high values speak against a document; their cutoffs are LEVELS steps of STEP from 0.
RULES = {"symbol_share": 0.01, "dup_line_share": 0.02, "repeat_share": 0.01, "mark_share": 0.02, "capital_share": 0.02}
LEVELS = 50
#: The path: cutoffs from the shaping documents' levels, as (quantile, factor, more levels), lenient first.
STEPS = [(1.0, 2, 1), (1.0, 1, 1), (1.0, 1, 0), (0.999, 1, 0), (0.998, 1, 0), (0.995, 1, 0), (0.99, 1, 0), (0.98, 1, 0)]
#: Strata whose cutoffs are broadcast: up to so many; more are joined by shuffling.
BROADCAST = 10_000
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_capitals long, n_letters long"


def repeat_words(codes: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(codes) < 4:
        return 0
    a = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (a[:-2] >> np.uint64(29)))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + a[2:] * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(len(mixed), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(len(a), bool)
    covered[:-2] |= found
    covered[1:-1] |= found
    covered[2:] |= found
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # the six white-space bytes
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    codes = np.fromiter(map(hash, words), np.int64, n)
    return (
        n,
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(codes),
        len(lines),
        text.count("!"),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")),
    )


def with_measures(docs: DataFrame, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs without `drop` (a null text counts as empty), with the columns of MEASURED after its own; needs column text."""
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = np.array([measure(t) if t else (0,) * len(names) for t in batch["text"]], np.int64).reshape(-1, len(names))
            yield batch.drop(columns=list(drop)).assign(**dict(zip(names, got.T)))

    bound_batches(docs.sparkSession)
    own = T.StructType([f for f in docs.schema.fields if f.name not in drop])
    return docs.mapInPandas(run, T.StructType([*own.fields, *T._parse_datatype_string(MEASURED).fields]))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def level(rule: str) -> F.Column:
    """How many of the rule's cutoffs the measure is above (0 to LEVELS)."""
    share = {
        "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "mark_share": F.col("n_marks") / F.greatest("n_words", F.lit(1)),
        "capital_share": F.col("n_capitals") / F.greatest("n_letters", F.lit(1)),
    }[rule]
    return F.least(F.ceil(share / F.lit(RULES[rule])), F.lit(LEVELS)).cast("int")


def levels() -> F.Column:
    return F.array(*[level(r) for r in RULES])


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    out = d
    for m in range(1, 100_000):
        change = 1.0
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            change = c * d
            out *= change
        if abs(change - 1) < 1e-15:
            return out
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def upper_bound(rejected: int, n: int, error: float) -> float:
    """The exact binomial upper bound of the rate: the p at which P(at most `rejected` of n) = error."""
    if rejected >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(n - rejected, rejected + 1, 1 - mid) > error else (low, mid)
    return high


def path(counts: dict[str, dict[int, int]]) -> list[list[int]]:
    """STEPS sets of cutoffs, in the order of RULES, from how many shaping documents are at each rule's levels."""
    out = []
    for quantile, factor, more in STEPS:
        cutoffs = []
        for rule in RULES:
            levels = sorted(counts.get(rule, {}).items())
            n, seen, at = sum(k for _, k in levels), 0, LEVELS
            for at, k in levels:
                seen += k
                if seen >= quantile * n:
                    break
            cutoffs.append(min(LEVELS, at * factor + more))
        out.append(cutoffs)
    return out


def certified(good: list[int], bad: list[int], alpha: float, error: float) -> int | None:
    """The chosen step. good, bad: how many holdout documents the steps before each one keep (index: steps that keep them)."""
    n, chosen, caught = sum(good), None, -1
    for k in range(len(STEPS)):
        rejected = sum(good[: k + 1])
        if n == 0 or rejected > alpha * n or upper_bound(rejected, n, error) > alpha:
            break
        if sum(bad[: k + 1]) > caught:
            chosen, caught = k, sum(bad[: k + 1])
    return chosen


def certify(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, cutoffs in the order of RULES) of the strata in which a set of cutoffs is certified."""
    verdicts = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality in (0, 1)")
    half = F.pmod("k1", F.lit(2)).cast("int").alias("half")
    rows = measured.where(~base_failed()).join(verdicts, "doc_id").select(F.coalesce("lang", F.lit("")).alias("stratum"), "quality", "k1", "k2", levels().alias("levels"))
    texts = rows.groupBy("stratum", "k1", "k2").agg(F.min("quality").alias("quality"), F.first("levels").alias("levels"))  # copies say nothing new
    held = materialise(texts.select("stratum", "quality", half, "levels"), "holdout")
    names = F.array(*[F.lit(r) for r in RULES])
    good = held.where("quality = 1").select("stratum", "half", F.explode(F.arrays_zip(names.alias("rule"), F.col("levels").alias("level"))).alias("m"))
    counted = materialise(good.groupBy("stratum", "half", "m.rule", "m.level").agg(F.count("*").alias("n")), "levels")
    total: dict[str, dict[int, int]] = {}
    for r in counted.groupBy("rule", "level").agg(F.sum("n").alias("n")).collect():  # LEVELS + 1 rows a rule at most
        total.setdefault(r["rule"], {})[r["level"]] = r["n"]
    strata = counted.select("stratum").distinct().count()

    def shape(rows: pd.DataFrame) -> pd.DataFrame:
        shaping: dict[str, dict[int, int]] = {rule: dict(by) for rule, by in total.items()}
        which = rows if strata > 1 else rows[rows["half"] == 1]  # the holdout's levels go
        for rule, at, n in which[["rule", "level", "n"]].itertuples(index=False):
            shaping[rule][at] -= n
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "steps": [path({rule: {at: n for at, n in by.items() if n} for rule, by in shaping.items()})]})

    paths = materialise(counted.groupBy("stratum").applyInPandas(shape, "stratum string, steps array<array<int>>"), "paths")
    inside = lambda s: F.forall(F.zip_with("levels", s, lambda a, b: a <= b), lambda x: x)
    holdout = joined(held if strata > 1 else held.where("half = 1"), paths, strata).select("stratum", "quality", F.size(F.filter("steps", inside)).alias("kept"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        by = {q: [int(rows.loc[(rows["quality"] == q) & (rows["kept"] == k), "n"].sum()) for k in range(len(STEPS) + 1)] for q in (0, 1)}
        step = certified(by[1], by[0], alpha, delta / strata)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "step": [-1 if step is None else step]})

    steps = holdout.groupBy("stratum", "quality", "kept").agg(F.count("*").alias("n")).groupBy("stratum").applyInPandas(choose, "stratum string, step int").where("step >= 0")
    return materialise(paths.join(steps, "stratum").select("stratum", F.get("steps", F.col("step")).alias("cutoffs")), "cutoffs")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text, with 128 bits that tell texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "lang", "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def joined(rows: DataFrame, strata: DataFrame, n: int) -> DataFrame:
    """rows with their stratum's row, if it has one."""
    return rows.join(F.broadcast(strata) if n <= BROADCAST else strata, "stratum", "left")


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured with base_failed, the rule that rejects (rejected_by, the first of RULES, else null) and kept."""
    out = joined(measured.withColumn("stratum", F.coalesce("lang", F.lit(""))), cutoffs, cutoffs.count())
    hits = [F.when(level(rule) > F.get("cutoffs", F.lit(k)), F.lit(rule)) for k, rule in enumerate(RULES)]
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.coalesce(*hits))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("stratum", "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """doc_id, lang, measures, base_failed, rejected_by and kept for every row of docs.

    Needs doc_id, text and lang. A null or empty text has no words and fails.
    A null language is a stratum. A document with several labels is good only
    if all of them say so, and so is a text with several documents; without labels nothing is certified and only the
    base rejects. Repeated rows are judged alike; an empty table gives no rows.
    """
    measured = materialise(with_measures(keyed_texts(docs)), "measures")
    return judged(measured, certify(measured, labels.select("doc_id", "quality"), alpha, delta))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns; texts are measured again rather than shuffled. An empty table stays empty."""
    measured = materialise(with_measures(keyed_texts(docs)), "measures")
    cutoffs = certify(measured, labels.select("doc_id", "quality"), alpha, delta)
    release(measured)
    names = {c: c if c in ("doc_id", "text", "lang") else f"_c{k}" for k, c in enumerate(docs.columns)}  # docs may have columns of the measures' names
    found = judged(with_measures(docs.toDF(*names.values()), drop=()), cutoffs).where("kept")
    return found.select(*[F.col(new).alias(c) for c, new in names.items()])
