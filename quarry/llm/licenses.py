"""License scans by diagonal voting.

All rolling k-grams of a document's words are joined to the templates' k-gram
positions. A k-gram's code is exact: its words' numbers in the templates'
vocabulary (0: no word of it) as digits. Hits vote for a diagonal: place in the
document minus place in the template. Neighbouring diagonals are merged; where
they hold enough votes for a notice, the words around each peak are aligned with
the notice (longest common subsequence), and a span is verified if so much of the
notice stands there in order. Of verified spans that overlap, the one with most
words in common wins, then the one with the larger share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import materialise, whole_texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
K = 3
#: Neighbouring diagonals lie so many words apart at most; a span may have so many words more than its notice.
SLACK = 4
#: A span must hold so many of a notice's words, in order.
SHARE = 0.8

#: Phrases that name a license wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public license notices, in their usual wording.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}


#: Words of all templates together, at most: their k-grams are broadcast and each task knows them.
MOST_WORDS = 200_000


class Templates:
    """Phrases, all words of which are needed in order, and notices, as (label, phrase?, words); their vocabulary; and how k-grams are numbered."""

    def __init__(self, notices: list[tuple[str, str]]):
        given = [(label, words) for label, text in notices if (words := WORDS.findall((text or "").translate(LOWER)))]
        self.all = [(label, True, p.split()) for p, label in PHRASES.items()] + [(label, False, words) for label, words in given]
        if (n := sum(len(words) for _, _, words in self.all)) > MOST_WORDS:
            raise ValueError(f"templates have {n} words; {MOST_WORDS} are the most that is broadcast")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, _, words in self.all for w in words}), 1)}
        self.base = len(self.vocabulary) + 1
        self.kind = np.dtype(np.int32 if self.base**K < 2**31 else np.int64)  # MOST_WORDS ** 3 fits

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.vocabulary.get
        return np.array([known(w, 0) for w in words], self.kind)


BUILT_IN = Templates(list(NOTICES.items()))


def given(notices: DataFrame) -> Templates:
    """Templates of a table (label, text), read as documents are; null labels and texts without words are left out. The table is counted before it comes to the driver."""
    rows = notices.where("label is not null and text is not null").select(F.col("label").cast("string").alias("label"), "text")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if size["n"] > MOST_WORDS or (size["chars"] or 0) > 64 * MOST_WORDS:
        raise ValueError(f"{size['n']} templates of {size['chars']} characters are more than is broadcast")
    return Templates(sorted({(r["label"], r["text"]) for r in rows.collect()}))


def grams(ids: np.ndarray, t: Templates = BUILT_IN) -> np.ndarray:
    """All rolling k-grams, one exact number each."""
    if len(ids) < K:
        return np.zeros(0, t.kind)
    code = np.zeros(len(ids) - K + 1, t.kind)
    for j in range(K):
        code = code * t.base + ids[j : len(ids) - K + 1 + j]
    return code.astype(t.kind)


def words_in(codes: np.ndarray, t: Templates = BUILT_IN) -> np.ndarray:
    """The words' numbers, back from all k-grams."""
    if not len(codes):
        return np.zeros(0, t.kind)
    last = codes[-1]
    return np.r_[codes // t.base ** (K - 1), [last // t.base ** (K - 1 - j) % t.base for j in range(1, K)]]


def template_grams(spark: SparkSession, t: Templates) -> DataFrame:
    rows = []
    for k, (_, _, words) in enumerate(t.all):
        rows += [(int(c), k, a) for a, c in enumerate(grams(t.numbers(words), t))]
    return spark.createDataFrame(rows, f"gram {SQL_TYPE[t.kind.itemsize]}, template int, template_at int")


SQL_TYPE = {4: "int", 8: "long"}


def document_grams(docs: DataFrame, t: Templates) -> DataFrame:
    """row (a number of its own), doc_id, n_words, and all rolling k-grams of each document, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = t.numbers(WORDS.findall(text.translate(LOWER)))
                row += 1
                out.append((row, doc_id, len(ids), grams(ids, t)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "n_words", "grams"]).astype({"doc_id": "Int64"})

    return materialise(whole_texts(docs).mapInPandas(run, f"row long, doc_id long, n_words long, grams array<{SQL_TYPE[t.kind.itemsize]}>"), "grams")


def diagonals(written: DataFrame, t: Templates) -> DataFrame:
    """A row for each document, template and diagonal with a vote: votes (a template place votes once)."""
    rows = written.select("row", F.posexplode("grams").alias("at", "gram"))
    hits = rows.join(F.broadcast(template_grams(written.sparkSession, t)), "gram")  # MOST_WORDS rows at most
    return hits.groupBy("row", "template", (F.col("at") - F.col("template_at")).alias("diagonal")).agg(F.count("*").alias("votes"))


def candidates(found: DataFrame, t: Templates) -> DataFrame:
    """For each document the peaks (template, diagonal) of merged diagonals with votes enough for a notice.

    A word that differs costs K votes at most, so a notice of n words of which
    SHARE stand there in order keeps n - K + 1 - K * (1 - SHARE) * n votes.
    """
    rows = [(k, max(1, int(len(words) - K + 1 - K * (1 - SHARE) * len(words)))) for k, (_, phrase, words) in enumerate(t.all) if not phrase]
    notices = found.sparkSession.createDataFrame(rows, "template int, least int")
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    near = w.rangeBetween(-SLACK, SLACK)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > SLACK, F.lit(True))
    merged = found.join(F.broadcast(notices), "template").withColumn("most", F.max("votes").over(near)).withColumn("span", F.sum(apart.cast("int")).over(w))
    peaks = merged.groupBy("row", "template", "span").agg(F.sum("votes").alias("votes"), F.first("least").alias("least"), F.collect_list(F.when(F.col("votes") == F.col("most"), F.col("diagonal"))).alias("peaks"))
    peaks = peaks.where("votes >= least").groupBy("row").agg(F.collect_list(F.struct("template", "peaks")).alias("spans"))
    return peaks


def aligned(notice: list[int], words: list[int]) -> tuple[int, int, int]:
    """Words in common in order (as many as can be), and the first and last place in `words` of one such alignment."""
    table = [[0] * (len(words) + 1)]
    for a in notice:
        above, row = table[-1], [0]
        for k, b in enumerate(words):
            row.append(above[k] + 1 if a == b else max(above[k + 1], row[k]))
        table.append(row)
    i, k, places = len(notice), len(words), []
    while i and k and table[i][k]:
        if notice[i - 1] == words[k - 1]:
            places.append(k - 1)
            i, k = i - 1, k - 1
        elif table[i - 1][k] >= table[i][k - 1]:
            i -= 1
        else:
            k -= 1
    return len(places), places[-1] if places else 0, places[0] if places else 0


def verified(ids: np.ndarray, spans: list[tuple[int, list[int]]], of: Templates = BUILT_IN) -> list[tuple[int, int, int, float]]:
    """(template, first word, last word, share) of the spans that hold; none overlaps a better one."""
    found = set()
    for t, peaks in spans:
        notice = of.numbers(of.all[t][2]).tolist()
        for d in peaks:
            start = max(0, d - SLACK)
            n, first, last = aligned(notice, ids[start : max(0, d + len(notice) + SLACK)].tolist())
            if n >= SHARE * len(notice) and last - first < len(notice) + SLACK:
                found.add((-n, -n / len(notice), t, start + first, start + last))
    out: list[tuple[int, int, int, float]] = []
    for n, share, t, first, last in sorted(found):
        if all(last < b or first > c for _, b, c, _ in out):
            out.append((t, first, last, -share))
    return out


def notices(written: DataFrame, found: DataFrame, t: Templates) -> DataFrame:
    """row, template, first_word, last_word and share of each verified span of a notice."""
    todo = written.select("row", "grams").join(candidates(found, t), "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row, *s) for row, codes, spans in zip(batch["row"], batch["grams"], batch["spans"]) for s in verified(words_in(np.asarray(codes), t), [(s["template"], [int(d) for d in s["peaks"]]) for s in spans], t)]
            yield pd.DataFrame(rows, columns=["row", "template", "first_word", "last_word", "share"])

    return todo.mapInPandas(run, "row long, template int, first_word long, last_word long, share double")


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, a row for each document.

    A null text is empty: no words, no labels, score 0. Repeated rows are
    scanned once each; a null doc_id is carried; an empty table gives no rows.
    score: the largest share of a verified span, 1 with a base label. templates:
    a table (label, text) of notices to look for instead of NOTICES, of MOST_WORDS
    words at most; the phrases of the base labels stay. Aligning a span takes time
    with the square of its notice's length.
    """
    t = BUILT_IN if templates is None else given(templates)
    written = document_grams(docs, t)
    found = materialise(diagonals(written, t), "diagonals")
    whole = {k: len(words) - K + 1 for k, (_, phrase, words) in enumerate(t.all) if phrase}
    labels = F.broadcast(docs.sparkSession.createDataFrame([(k, name) for k, (name, _, _) in enumerate(t.all)], "template int, label string"))
    base = found.where(F.coalesce(*[F.when(F.col("template") == k, F.col("votes") == n) for k, n in whole.items()], F.lit(False)))
    spans = base.select("row", "template", F.col("diagonal").alias("at"), F.lit(1.0).alias("share")).unionByName(
        notices(written, found, t).select("row", "template", F.lit(None).cast("int").alias("at"), "share"))
    spans = spans.join(labels, "template")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = spans.groupBy("row").agg(
        F.count("at").alias("n_base"), F.min("at").cast("long").alias("first_word"), F.max("at").cast("long").alias("last_word"),
        joined(F.when(F.col("at").isNotNull(), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    return written.select("row", "doc_id", "n_words").join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
