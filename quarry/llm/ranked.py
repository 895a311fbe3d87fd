"""Ranked lexical search: all documents for each item, with bounds that keep most of them from being scored.

A document is tokenised once, and only the terms of items are kept of it. For
each term the k-th largest impact (what it adds to a document's score) is
stored: k documents score at least that much, so the largest stored impact of an
item's terms bounds its k-th score from below, before any document is scored.
Terms whose largest impacts together stay below that bound cannot bring a
document in by themselves; they generate no candidates. What the other terms
give a document, with the largest that the left-out ones could add, decides
whether it is a candidate; candidates are scored exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import globally_ordered, materialise, release, whole_texts

#: A term: letters and digits of ASCII and every other character.
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: The score's constants: b / 100 of the length, k1 / 1000 and what keeps the quotient whole.
B, SLOPE, WHOLE = 50, 20, 1_000_000_000
#: Terms of items searched in one pass: what a task holds of them, and what is broadcast, is bounded by this.
TERMS_AT_ONCE = 1 << 20
#: Cells (documents by items) that a task scores at once.
CELLS = 1 << 21


def terms_of(text: str) -> Counter:
    return Counter(TERMS.findall(text.translate(LOWER)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term) for the distinct terms of each row of items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, own, t) for i, own, text in zip(batch["item"], batch["item_id"], batch["text"]) for t in terms_of(text)]
            yield pd.DataFrame(out, columns=["item", "item_id", "term"]).astype({"item_id": "Int64"})

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id())
    return materialise(materialise(rows, "items").mapInPandas(run, "item long, item_id long, term string"), "item-terms")


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document: its length in terms, and which of `terms` (by number) it has how often."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for batch in batches:
            out = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                found = terms_of(text)
                own = [(number[t], n) for t, n in found.items() if t in number]
                out.append((i, sum(found.values()), [t for t, _ in own], [n for _, n in own]))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "tf"]).astype({"doc_id": "Int64"})

    texts = whole_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialise(texts.mapInPandas(run, "doc_id long, n long, terms array<int>, tf array<int>"), "postings", "zstd")


def impact(w: object, tf: object, m: object) -> object:
    """What a term of weight w adds to a document that has it tf times."""
    return w * (WHOLE * tf // (1000 * tf + SLOPE * m))


def term_bounds(rows: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, w, most, kth): a term's weight, its largest impact, and its k-th largest (0 where fewer documents have it).

    Documents that have a term equally often in texts of about one length count
    together, so a term that most documents have is few rows.
    """
    m = F.expr(f"{100 - B} + ({B}L * n * {n_docs}L) div {n_terms}L")
    each = rows.select(F.explode(F.arrays_zip("terms", "tf")).alias("t"), m.alias("m")).groupBy(F.col("t.terms").alias("term"), F.col("t.tf").cast("long").alias("tf"), "m").agg(F.count("*").alias("c"))
    whole = F.expr(f"({WHOLE}L * tf) div (1000L * tf + {SLOPE}L * m)")
    below = Window.partitionBy("term").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.select("term", whole.alias("i"), "c").withColumn("up", F.sum("c").over(below))
    found = ranked.groupBy("term").agg(F.sum("c").alias("df"), F.max("i").alias("top"), F.max(F.when(F.col("up") >= k, F.col("i"))).alias("kth"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    return found.select("term", w.alias("w"), (w * F.col("top")).alias("most"), (w * F.coalesce("kth", F.lit(0))).alias("kth"))


def item_bounds(entries: DataFrame, bounds: DataFrame) -> DataFrame:
    """entries (item, term) with w, and for its item: least (the k-th score is as much at least), and whether the term generates candidates.

    Terms are summed from the smallest largest impact up; the first whose sum
    reaches `least`, and all after it, generate. rest is what the others add at most.
    """
    item = Window.partitionBy("item")
    up = item.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.join(bounds, "term").withColumn("least", F.max("kth").over(item)).withColumn("sum", F.sum("most").over(up))
    rows = rows.withColumn("generates", F.col("sum") >= F.col("least"))
    return rows.withColumn("rest", F.sum(F.when(~F.col("generates"), F.col("most")).otherwise(0)).over(item))


class Index:
    """The items of a pass: for each term the items that have it, those it generates candidates for first, and each item's bounds."""

    def __init__(self, rows: pd.DataFrame, n_terms: int):
        self.items, at = np.unique(rows["item"].to_numpy(np.int64), return_inverse=True)
        self.least, self.rest = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        self.least[at], self.rest[at] = rows["least"], rows["rest"]
        self.w = np.zeros(n_terms, np.int64)
        self.w[rows["term"]] = rows["w"]
        self.lists = []
        for part in (rows["generates"].to_numpy(bool), ~rows["generates"].to_numpy(bool)):
            term, item = rows["term"].to_numpy(np.int64)[part], at[part]
            by = np.argsort(term, kind="stable")
            self.lists.append((np.searchsorted(term[by], np.arange(n_terms + 1)), item[by]))

    def pairs(self, which: int, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, gain) for the postings of a batch and the items of the generating (0) or the other (1) terms."""
        start, items = self.lists[which]
        times = start[term + 1] - start[term]
        at = np.repeat(start[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(doc, times), items[at], np.repeat(gain, times)

    def scores(self, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(document, item, score) of those that can be among an item's first, and the number of candidates."""
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        m = 100 - B + B * n * n_docs // max(n_terms, 1)
        gain = impact(self.w[term], tf.astype(np.int64), m[doc])
        d, i, g = self.pairs(0, doc, term, gain)
        total = np.zeros((len(n), len(self.items)), np.int64)
        np.add.at(total, (d, i), g)
        wanted = (total > 0) & (total + self.rest >= self.least)
        d, i, g = self.pairs(1, doc, term, gain)
        own = wanted[d, i]
        np.add.at(total, (d[own], i[own]), g[own])
        d, i = np.nonzero(wanted & (total >= self.least))
        return d, i, total[d, i], int(wanted.sum())


def first_of(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k first rows of each item: by score, then by document, null ids last."""
    rows = rows.sort_values(["item", "score", "doc_id"], ascending=[True, False, True], na_position="last", kind="stable")
    return rows[rows.groupby("item").cumcount() < k]


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each row of items.

    Equal scores go by doc_id, null ids last. Fewer than k documents with a score
    give all. A null text has no terms; documents without any count for nothing.
    Repeated rows of either table are rows like any others. Empty tables give no
    rows. Items are searched in passes of TERMS_AT_ONCE terms, each of which
    reads the documents once.
    """
    spark = docs.sparkSession
    entries = item_terms(items)
    sizes = entries.groupBy("item").agg(F.count("*").alias("terms"))
    dealt, totals = globally_ordered(sizes, "item", sums=("terms",))
    passes = dealt.select("item", F.floor((F.col("end_terms") - 1) / TERMS_AT_ONCE).cast("int").alias("pass"))
    out = None
    for which in range(-(-totals["terms"] // TERMS_AT_ONCE)):
        own = entries.join(passes.where(F.col("pass") == which).select("item"), "item") if totals["terms"] > TERMS_AT_ONCE else entries
        found = searched(docs, own, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def searched(docs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """rank() for items of about TERMS_AT_ONCE terms."""
    spark = docs.sparkSession
    terms = sorted(r["term"] for r in entries.select("term").distinct().collect())  # bounded by the pass
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "name string, number int")
    numbered = materialise(entries.join(numbers, F.col("term") == F.col("name")).select("item", "item_id", F.col("number").alias("term")), "entries")
    rows = postings(docs, terms)
    seen = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = seen["docs"] or 0, seen["terms"] or 0
    bounds = term_bounds(rows, n_docs, max(n_terms, 1), k)
    index = Index(item_bounds(numbered.select("item", "term"), bounds).select("item", "term", "w", "least", "generates", "rest").toPandas(), len(terms))
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, best, held, waiting = shared.value, None, [], 0
        step = max(1, CELLS // max(1, len(index.items)))
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            term, tf, starts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), np.asarray(batch.column(2).offsets)
            starts = starts - starts[0]
            for a in range(0, len(n), step):
                b = min(a + step, len(n))
                at = slice(starts[a], starts[b])
                d, i, s, _ = index.scores(n[a:b], starts[a : b + 1] - starts[a], term[at], tf[at], n_docs, n_terms)
                if len(d):
                    held.append(pd.DataFrame({"item": index.items[i], "doc_id": ids.take(pa.array(d + a)).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "score": s}))
                    waiting += len(d)
                if waiting > 4 * k * len(index.items) + 100_000:
                    held, waiting = [first_of(pd.concat(held), k)], 0
        if held:
            best = first_of(pd.concat(held, ignore_index=True), k)
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    part = materialise(rows.where("n > 0").mapInArrow(run, "item long, doc_id long, score long"), "found")
    release(rows)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
