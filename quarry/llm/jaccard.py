"""Jaccard join of documents on word shingles by chosen paths.

Sets are split recursively. In run r, a set goes below every bucket of its own
tokens whose hash for this run and depth is under PHI / (LAMBDA * size), so a
pair of at least LAMBDA shares PHI[depth] children or more on average; buckets
of up to SMALL sets are compared by brute force, larger ones are split again, up
to DEPTH times. In a large bucket, sets that agree with one of a few pivots are
connected at once; up to PAIRS sets, what that leaves open is compared by brute
force. Of larger buckets small children are compared on the spot, and children
within one connected cluster are left out, as they hold no new pair. A run's deeper tokens are the same below all its
paths, so a pair at the threshold that stays in large buckets is found in it if
it shares a token at each depth: a chance of (1 - exp(-1.6)) * (1 - exp(-2.2)) ** 2
= 0.631, and RUNS runs miss it with one below 1e-5. What is still large after
DEPTH tokens is compared in blocks.
Comparison in a bucket is on 64 one-byte minhashes, a filter that lets a pair of
LAMBDA pass but for a chance of about 1e-6; what passes is verified on the whole
shingle sets, in blocks, so links are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import components, grouped
from quarry.llm.shared import KEY, heavy_join, keyed, materialise, release

WORD = re.compile(r"\w+")
SHINGLE = 5
LAMBDA, PHI = 0.8, (1.6, 2.2, 2.2)
RUNS, DEPTH, SMALL = 12, 3, 256
HASHES, AGREE = 64, 36
#: Members of a large bucket that a task splits together.
SPLIT = 16_384
#: Pivots of a large bucket, and members up to which a task compares all that its clusters leave open rather than splitting.
PIVOTS, PAIRS = 32, 8192
#: Sets in a block of the exact comparison, and in one of the comparison of minhashes.
BLOCK, WIDE_BLOCK = 512, 1024
CACHE = 200_000
ODD = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]

class Codes(dict):
    """64-bit codes of words; a task keeps its own, up to CACHE of them between texts."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: str, known: Codes) -> np.ndarray:
    """Sorted 64-bit codes of the distinct SHINGLE-word windows of lower-cased words; shorter texts are one window."""
    codes = known.of(WORD.findall(text.lower()))
    n = len(codes)
    if not n:
        return codes
    k = min(SHINGLE, n)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total = (total ^ (codes[j : n - k + 1 + j] * MIX[j])) * MIX[(j + 1) % 5] + (total >> np.uint64(33))
    return np.unique(mixed(total))


def sketch(tokens: np.ndarray) -> tuple[bytes, list[list[int]]]:
    """HASHES one-byte minhashes, and for each run and depth the chosen tokens (32-bit)."""
    limit = np.array([min(2**32 - 1, int(2**32 * PHI[k % DEPTH] / (LAMBDA * len(tokens)))) for k in range(RUNS * DEPTH)], np.uint32)
    least, which, value = None, [], []
    for start in range(0, len(tokens), 4096):
        h = ((tokens[start : start + 4096, None] * ODD[None, :]) >> np.uint64(32)).astype(np.uint32)
        low = h.min(axis=0)
        least = low if least is None else np.minimum(least, low)
        rows, f = np.nonzero(h[:, : RUNS * DEPTH] < limit[None, :])
        which.append(f)
        value.append(h[rows, f])
    f, v = np.concatenate(which), np.concatenate(value)
    chosen = [[] for _ in range(RUNS * DEPTH)]
    for a, b in zip(f.tolist(), v.tolist()):
        chosen[a].append(b)
    return (mixed(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes(), chosen


def child(path: int, token: int) -> int:
    x = ((path ^ (token * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1)
    x ^= x >> 32
    return x - 2**64 if x >= 2**63 else x


def sketches(docs: DataFrame) -> DataFrame:
    """KEY, the 128-bit hash of the shingle set, its size, minhashes, first paths and the tokens for deeper ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Codes()
        for batch in batches:
            out = []
            for *key, text in batch[["doc_id", "d", "k1", "k2", "text"]].itertuples(index=False, name=None):
                tokens = shingles(text, known)
                if not len(tokens):  # without words, only equal texts belong together
                    whole = xxhash.xxh3_128(b"\0" + text.encode()).digest()
                    out.append((*key, *np.frombuffer(whole, np.int64).tolist(), 0, b"", [], []))
                    continue
                whole = xxhash.xxh3_128(tokens.tobytes()).digest()
                least, chosen = sketch(tokens)
                first = [child(r, t) for r in range(RUNS) for t in chosen[r * DEPTH]]
                runs = [r for r in range(RUNS) for _ in chosen[r * DEPTH]]
                deeper = b"".join(np.array([len(c), *c], np.uint32).tobytes() for k, c in enumerate(chosen) if k % DEPTH)
                out.append((*key, *np.frombuffer(whole, np.int64).tolist(), len(tokens), least + deeper, first, runs))
            yield pd.DataFrame(out, columns=["doc_id", "d", "k1", "k2", "h1", "h2", "size", "data", "paths", "runs"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, "doc_id long, d string, k1 long, k2 long, h1 long, h2 long, size int, data binary, paths array<long>, runs array<byte>")


def deeper_tokens(data: bytes, run: int, depth: int) -> list[int]:
    """The tokens chosen in a run at depth 1, 2, ... (0 is in the paths)."""
    words, at = np.frombuffer(data, np.uint32, -1, HASHES), 0
    for _ in range(run * (DEPTH - 1) + depth - 1):
        at += 1 + int(words[at])
    return words[at + 1 : at + 1 + int(words[at])].tolist()


def clusters(least: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the minhashes (rows) of a bucket, each set's cluster, and edges that connect the sets of a cluster, as candidates are.

    Up to PIVOTS sets, each the first that belongs to no cluster, gather those
    that agree with them; a cluster that a pivot agrees with a member of joins
    its own. That only saves work: what isn't gathered is split on.
    """
    label, edges = np.full(len(least), -1), []
    for _ in range(PIVOTS):
        free = np.flatnonzero(label < 0)
        if not len(free):
            break
        pivot = free[0]
        near = (least == least[pivot]).sum(axis=1) >= AGREE
        fresh = near & (label < 0)
        fresh[pivot] = False
        edges += [(k, pivot) for k in np.flatnonzero(fresh).tolist()]
        others, first = np.unique(label[near & (label >= 0)], return_index=True)
        edges += [(k, pivot) for k in np.flatnonzero(near & (label >= 0))[first].tolist()]
        label[fresh] = pivot
        label[pivot] = pivot
        label[np.isin(label, others)] = pivot
    return np.where(label < 0, np.arange(len(least)), label), edges


def split_again(large: DataFrame, depth: int) -> DataFrame:
    """Buckets (path, run, cids) one level deeper, and edges (run -1, cids of two) within them, from rows (path, run, cid, n, data).

    A task splits up to SPLIT members of a bucket together. Members that agree
    with a pivot are connected with it. Where a task has the whole bucket, it
    compares the members outside its largest cluster with all, if there are up to
    PAIRS members (a bucket's sets that are similar on the whole are compared by
    brute force, as the method has it), and needs no child; else it compares children of up to SMALL sets at once, leaves out those of one
    connected cluster, as they hold no new pair, and gives one row for each child
    that is still large; else one row for each child.
    """
    blocks = F.ceil(F.col("n") / F.lit(SPLIT))
    dealt = large.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).select("path", "block", "run", "cid", "size", (blocks == 1).alias("whole"), "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["path", "block"]):
            group = group.sort_values("cid")
            r, whole = int(group["run"].iloc[0]), bool(group["whole"].iloc[0])
            path, cids, sizes, below = int(group["path"].iloc[0]), group["cid"].tolist(), group["size"].to_numpy(), {}
            least = np.frombuffer(b"".join([d[:HASHES] for d in group["data"]]), np.uint8).reshape(-1, HASHES)
            label, edges = clusters(least)
            label = label.tolist()

            def top(k: int) -> int:
                while label[k] != k:
                    label[k] = k = label[label[k]]
                return k

            def join(k: int, i: int) -> None:
                a, b = top(k), top(i)
                if a != b:
                    label[max(a, b)] = min(a, b)
                    edges.append((k, i))

            if whole and len(cids) <= PAIRS:
                for k, near in outside(least, sizes, np.array(label)):
                    join(k, near)
                yield pd.DataFrame([(0, -1, [cids[a], cids[b]]) for a, b in edges], columns=["path", "run", "cids"])
                continue
            for k, data in enumerate(group["data"]):
                for t in deeper_tokens(data, r, depth):
                    below.setdefault(t, []).append(k)
            rows = []
            for t, ks in below.items():
                if whole and len({top(k) for k in ks}) == 1:
                    continue
                if not whole or len(ks) > SMALL:
                    rows.append((child(path, t), r, [cids[k] for k in ks]))
                    continue
                for i, k in enumerate(local_labels(agreeing(least[ks], sizes[ks])).tolist()):
                    join(ks[i], ks[k])
            rows += [(0, -1, [cids[a], cids[b]]) for a, b in edges]
            yield pd.DataFrame(rows, columns=["path", "run", "cids"])

    return materialise(dealt.repartition("path", "block").sortWithinPartitions("path", "block").mapInPandas(run, "path long, run byte, cids array<long>"), "split")


def outside(least: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of sets that may be similar, one of each cluster that a set outside the largest cluster has near it: together with the clusters they connect all there are."""
    largest = np.bincount(label).argmax()
    free = np.flatnonzero(label != largest)
    for start in range(0, len(free), 256):
        block = free[start : start + 256]
        agree = np.zeros((len(block), len(least)), np.uint8)
        for j in range(HASHES):
            agree += least[block, j, None] == least[None, :, j]
        near = (agree >= AGREE) & (np.minimum.outer(sizes[block], sizes) >= LAMBDA * np.maximum.outer(sizes[block], sizes))
        near[np.arange(len(block)), block] = False
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            at = np.flatnonzero(near[i])
            for k in at[np.unique(label[at], return_index=True)[1]].tolist():
                yield int(block[i]), k


def agreeing(least: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sets may be similar: by minhashes and by size."""
    agree = np.zeros((len(least), len(least)), np.uint8)
    for j in range(HASHES):
        agree += least[:, j, None] == least[None, :, j]
    small = np.minimum.outer(sizes, sizes)
    return (agree >= AGREE) & (small >= LAMBDA * np.maximum.outer(sizes, sizes))


def local_labels(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each row is connected with."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_edges(members: DataFrame, block: int) -> DataFrame:
    """Edges (a, b) between sets of a bucket (path, cid, size, data, n) whose minhashes agree and whose sizes allow the similarity.

    A bucket of more than `block` sets is compared in pairs of blocks.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = members.select("path", "cid", "size", F.substring("data", 1, HASHES).alias("least"), blocks.alias("blocks"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    one = rows.where("blocks = 1").withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    many = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other")
    keys = ["path", "x", "y"]
    dealt = one.unionByName(many).select(*keys, "side", "cid", "size", "least").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[int, int]] = set()
        rows: list[tuple[int, int]] = []
        for group in grouped(batches, keys):
            if len(group) < 2:
                continue
            cids, sizes = group["cid"].to_numpy(), group["size"].to_numpy()
            least = np.frombuffer(b"".join(group["least"]), np.uint8).reshape(len(group), HASHES)
            if len(group) == 2:
                if min(sizes) >= LAMBDA * max(sizes) and (least[0] == least[1]).sum() >= AGREE:
                    rows.append((max(cids), min(cids)))
            else:
                near = agreeing(least, sizes)
                if group["x"].iloc[0] != group["y"].iloc[0]:
                    side = group["side"].to_numpy()
                    near &= side[:, None] != side[None, :]
                label = local_labels(near)
                rows += [(max(cids[i], cids[k]), min(cids[i], cids[k])) for i, k in enumerate(label.tolist()) if i != k]
            if len(rows) > 20_000:
                fresh = set(rows) - known
                known = known | fresh if len(known) < CACHE else fresh
                yield pd.DataFrame(list(fresh), columns=["a", "b"], dtype="int64")
                rows = []
        yield pd.DataFrame(list(set(rows) - known), columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(run, "a long, b long")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges between sets that may be similar, over all runs; similar sets are connected but for the chance above."""
    first = classes.where("size > 0").select(F.explode(F.arrays_zip("paths", "runs")).alias("p"), "cid")
    level = first.select(F.col("p.paths").alias("path"), F.col("p.runs").alias("run"), "cid")
    info = classes.select("cid", "size", "data")
    edges = None
    for depth in range(1, DEPTH + 1):
        members = F.count("*") if depth == 1 else F.sum(F.size("cids"))
        counts = level.groupBy("path").agg(members.alias("n")).where("n > 1")
        level = materialise(level.join(counts, "path"), "buckets")
        if depth > 1:
            level = level.select("path", "run", F.explode("cids").alias("cid"), "n")
        most = SMALL if depth < DEPTH else WIDE_BLOCK  # what is still large after DEPTH tokens is compared in blocks
        found = bucket_edges((level.where(F.col("n") <= SMALL) if depth < DEPTH else level).join(info, "cid"), most)
        if depth < DEPTH:
            both = split_again(level.where(F.col("n") > SMALL).join(info, "cid"), depth)
            found = found.union(both.where("run < 0").select(F.get("cids", F.lit(0)).alias("a"), F.get("cids", F.lit(1)).alias("b")))
            level = both.where("run >= 0")
        edges = found if edges is None else edges.union(found)
    return edges


def exact_links(sets: DataFrame) -> DataFrame:
    """From sets (task keys comp, x, y; cid, block, weight, tokens): each set's linked documents in a task, and its smallest connected set there."""

    def overlaps(sets: list[np.ndarray]) -> np.ndarray:
        m = len(sets)
        if m == 2:
            n = len(np.intersect1d(*sets, assume_unique=True))
            return np.array([[len(sets[0]), n], [n, len(sets[1])]], np.float32)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, row = tokens[order], row[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]]
        column = np.cumsum(new) - 1
        common = np.bincount(column)[column] > 1
        row, column = row[common], column[common]
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
        total = np.zeros((m, m), np.float32)
        width = 2048
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (start, start + width))
            x = np.zeros((m, width), np.float32)
            x[row[a:b], column[a:b] - start] = 1
            total += x @ x.T
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in grouped(batches, ["comp", "x", "y"]):
            group = group.drop_duplicates("cid")  # repeated rows
            if len(group) < 2:
                continue
            sets = [np.frombuffer(b, np.uint64) for b in group["tokens"]]
            sizes = np.array([len(s) for s in sets], np.float32)
            both = overlaps(sets)
            near = 10 * both >= 8 * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(near, False)
            if group["x"].iloc[0] != group["y"].iloc[0]:
                side = group["block"].to_numpy()
                near &= side[:, None] != side[None, :]
            if near.any():
                links = near @ group["weight"].to_numpy()
                cids, label = group["cid"].to_numpy(), local_labels(near)
                out += [(cids[i], int(links[i]), cids[label[i]]) for i in np.flatnonzero(near.any(axis=1))]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["cid", "links", "root"])
                out = []
        yield pd.DataFrame(out, columns=["cid", "links", "root"]).astype("int64")

    return sets.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInPandas(run, "cid long, links long, root long")


def with_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Codes()
        for batch in batches:
            yield batch.drop(columns="text").assign(tokens=[shingles(t, known).tobytes() for t in batch["text"]])

    return texts.mapInPandas(run, "cid long, comp long, blocks int, block int, weight long, tokens binary")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, d, k1, k2, label, class_id, n_links and n_copies for every row.

    Two documents are linked if the Jaccard similarity of their sets of
    SHINGLE-word shingles is LAMBDA or more. label: the class's own number, one
    for each set of connected documents. class_id: the smallest doc_id that a
    document is connected with over links; classes without an id share null, and
    classes that one doc_id stands in may share it. n_links: documents that it is
    linked with, of which n_copies have the same set. d, k1, k2: the key of a
    row, see keyed(). A null text is empty; documents without words are linked
    only to equal texts. Repeated rows count as documents. An empty table gives
    no rows.
    """
    texts = keyed(docs.select("doc_id", "text"))
    rows = materialise(sketches(texts), "sketches")
    classes = rows.groupBy("h1", "h2").agg(F.min(F.struct(*KEY)).alias("one"), F.count("*").alias("weight"), F.min("doc_id").alias("first_id")).select("h1", "h2", "weight", "first_id", "one.*")
    reps = rows.select(*KEY, "size", "data", "paths", "runs").dropDuplicates(KEY)
    # A set's number is given once, where the table is written, so no two sets share one.
    full = materialise(classes.join(reps, KEY).withColumn("cid", F.monotonically_increasing_id()), "classes")
    comps = materialise(components(candidate_edges(full)), "candidates")
    sizes = materialise(comps.groupBy(F.col("label").alias("comp")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "sizes")
    members = heavy_join(comps.select(F.col("node").alias("cid"), F.col("label").alias("comp")), sizes, ["comp"], "n").drop("n").join(full.select("cid", "weight", *KEY), "cid")
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    sets = with_sets(texts.join(members, KEY).select("cid", "comp", "blocks", "block", "weight", "text"))
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    found = materialise(exact_links(tasks.select("comp", "x", "y", "cid", "block", "weight", "tokens")), "links")
    labels = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = full.select("h1", "h2", "cid", "weight", "first_id").join(links, "cid", "left").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    named = materialise(named.withColumn("label", F.coalesce("label", "cid")), "named")
    firsts = materialise(named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")), "firsts")
    named = materialise(heavy_join(named, firsts, ["label"], "n").select("h1", "h2", "weight", "label", "class_id", F.coalesce("links", F.lit(0)).alias("links")), "classes-named")
    out = heavy_join(rows.select("doc_id", *KEY, "h1", "h2"), named, ["h1", "h2"], "weight")
    release(comps, full, found)
    return out.select("doc_id", *KEY, "label", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), (F.col("weight") - 1).alias("n_copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, also where classes share a class_id: one whose doc_id names it (of rows that repeat, one).

    A null text is empty, and all empty texts are one class. An empty table stays empty.
    """
    found = linked(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min(F.struct(*KEY)).alias("one")).select("one.*")
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # docs may have columns of the key's names
    rows = keyed(docs.select("*", F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).toDF(*own.values(), "doc_id", "text"), whole=False)
    return rows.join(keep, KEY, "left_semi").dropDuplicates(KEY).select(*[F.col(new).alias(c) for c, new in own.items()])
