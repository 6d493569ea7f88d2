"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

A document is the set of its distinct word 5-grams (the whole sequence, when it has fewer
words). Two permutations make all coordinates of a signature: the first one, sigma, places a
shingle on a circle of 2^32 positions; coordinate k is the minimum of the second one, pi, over
the places shifted by k. BANDS bands of ROWS coordinates give the buckets; a pair with
similarity 0.75 shares none with a probability of (1 - 0.75^5)^51 = 1e-6.

Nothing is compared all with all:

* Documents with equal sets form a class, and its smallest id stands for it.
* In a bucket, the members are checked against its smallest id (the pivot) first. What is
  linked that way is one component; members of a bucket that already share one need no check.
* Only buckets that then hold several components go on. Up to WHOLE members are one cell. In a larger
  bucket, its largest component is cut in blocks of about CELL by hash, and so are the other members; a
  cell is a pair of blocks, but for two of the largest component, which has nothing left to find. So
  members are repeated by the number of those outside it. A cell's task counts what the sets
  share and returns just the pairs that pass, never the pairs it looks at. No pair is dropped.

Every link is confirmed on the full sets. Steps write to scratch, so that a lost executor costs
one step's tasks. Defined results: null or wordless texts have n_shingles 0 and are linked with
nothing; rows with the same id and text are one document; in `linked` a null id is linked with nothing and
kept, while `kept` judges such rows by their text; only doc_id and text are read, whatever other columns there are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import WordHashes, empty, found_in, maybe_in, mixed, row_keyed, stored, words_of

ROWS, BANDS, SHINGLE = 5, 51, 5
CELL = 256  # members of a block of a large bucket; a task compares two blocks at most
WHOLE = 4 * CELL  # members of a bucket that is compared as one
_COLUMNS = 4_096  # values whose owners are compared at once
_BLOCK = 64  # shingles whose coordinates are computed at once
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _shingles(words: np.ndarray, count: int) -> np.ndarray:
    total = np.full(len(words) - count + 1, count, dtype=np.uint64)
    for place in range(count):
        total += mixed(words[place : len(words) - count + 1 + place] ^ _FACTORS[place % 5]) * _FACTORS[place % 5]
    return mixed(total)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words than that make one."""
    return np.unique(_shingles(words, min(size, len(words)))) if len(words) else np.empty(0, dtype=np.uint64)


def shingle_sets_of(texts, hashes: WordHashes, at_once: int = 100_000):
    """A shingle set for each text (Arrow strings), hashed many texts at once."""
    waiting, count = [], 0

    def made():
        if count < SHINGLE:
            yield from map(shingle_set, waiting)
            return
        grams, at = _shingles(np.concatenate(waiting), SHINGLE), 0
        for words in waiting:
            yield np.unique(grams[at : at + len(words) - SHINGLE + 1]) if len(words) >= SHINGLE else shingle_set(words)
            at += len(words)

    for text in texts:
        waiting.append(hashes.of(words_of(text.as_py())))
        count += len(waiting[-1])
        if count >= at_once:
            yield from made()
            waiting, count = [], 0
    yield from made()


class Signer:
    """Computes signatures: minima of pi over the places of a set, shifted by 0, 1, 2 ..."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS):
        self.rows, self.bands = rows, bands
        self.shifts = np.arange(rows * bands, dtype=np.uint32)[None, :]
        self.space = np.empty((_BLOCK, rows * bands), dtype=np.uint32), np.empty((_BLOCK, rows * bands), dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.rows * self.bands, 0xFFFFFFFF, dtype=np.uint32)
        for start in range(0, len(places), _BLOCK):
            part = places[start : start + _BLOCK]
            x, y = self.space[0][: len(part)], self.space[1][: len(part)]
            np.add(part[:, None], self.shifts, out=x)
            x *= np.uint32(0x7FEB352D)
            np.right_shift(x, np.uint32(15), out=y)
            x ^= y
            x *= np.uint32(0x846CA68B)
            np.minimum(least, np.minimum.reduce(x, axis=0), out=least)
        return least

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in range(self.rows):
            key = mixed(key ^ rows[:, row])
        return key.view(np.int64)


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, a key of the set (two 64-bit sums) and the bucket of each band."""

    def sign(batches):
        words, signer = WordHashes(), Signer(rows, bands)
        for batch in batches:
            sizes, keys, found = [], [], []
            for shingles in shingle_sets_of(batch.column(1), words):
                sizes.append(len(shingles))
                if len(shingles):
                    with np.errstate(over="ignore"):
                        keys.append(f"{mixed(shingles).sum():016x}{mixed(shingles ^ _FACTORS[0]).sum():016x}{len(shingles):x}")
                    found.append(signer.buckets(shingles))
                else:
                    keys.append(None)
                    found.append(None)
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key string, buckets array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct shingle hashes of the whole text."""

    def make(batches):
        words = WordHashes()
        for batch in batches:
            sets = [found.view(np.int64) for found in shingle_sets_of(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(make, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    both = pairs.join(other, "b").join(one, "a").withColumn("common", F.size(F.array_intersect("one", "other")))
    return both.where("100L * common >= 75L * (size(one) + size(other) - common)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node that has an edge (a, b).

    Large-star and small-star steps alternate until the edges are stars; each step only takes
    minima by node and joins them back, so no neighbourhood is gathered in one place.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # Stars: every node has one edge, and no centre has one.
        centres = small.select(F.col("b").alias("a")).distinct()
        if empty(small.join(centres, "a", "left_semi")) and empty(small.groupBy("a").count().where("count > 1")):
            break
        now = small
    return small.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centres.select(F.col("a").alias("node"), F.col("a").alias("label")))


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold more than one component."""
    all_members = labelled(members, labels)
    mixed_ones = all_members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return all_members.join(mixed_ones, "bucket", "left_semi")


def _shared(first: np.ndarray, second: np.ndarray, owners: int) -> np.ndarray:
    """How many values each two owners share; first holds values, second whose they are."""
    order = np.argsort(first, kind="stable")
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    sizes = np.diff(np.append(starts, len(first)))
    often = np.repeat(sizes > 1, sizes)
    column = np.repeat(np.cumsum(sizes > 1) - 1, sizes)[often]
    second = second[often]
    total = np.zeros((owners, owners), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + _COLUMNS])
        has = np.zeros((owners, _COLUMNS), dtype=np.float32)
        has[second[lo:hi], column[lo:hi] - start] = 1
        total += has @ has.T
    return total


def dealt_in_cells(members: DataFrame, cell: int = CELL) -> DataFrame:
    """bucket, i and j of the cells of each member, its block there, node and label; see the module."""
    of_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = of_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    # Blocks of the members outside the largest component come first, then that component's own.
    parts = [F.when(F.col("n") <= min(4 * cell, WHOLE), least).otherwise(F.ceil(count / cell)).cast("int") for count, least in ((F.col("n") - F.col("most.n"), 1), (F.col("most.n"), 0))]
    sizes = sizes.select("bucket", F.col("most.label").alias("largest"), parts[0].alias("few"), parts[1].alias("many")).where("few > 0")
    inside = "many > 0 and label = largest"
    block = F.expr(f"cast(if({inside}, few + pmod(xxhash64(node), many), pmod(xxhash64(node), few)) as int)")
    dealt = members.join(sizes, "bucket").withColumn("block", block)
    other = F.explode(F.expr(f"sequence(0, if({inside}, few, few + many) - 1)"))
    dealt = dealt.select("bucket", "node", "label", "block", other.alias("other"))
    return dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")


def pairs_in_cells(members: DataFrame, sets: DataFrame, cell: int = CELL) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, have different labels, and pass by 32-bit hashes."""
    short = sets.select("node", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("short"))
    rows = dealt_in_cells(members, cell)

    def compare(key, cell_rows):
        cell_rows = cell_rows.sort_by("node")
        node, label, block = (cell_rows.column(name).to_numpy() for name in ("node", "label", "block"))
        lists = cell_rows.column("short").combine_chunks()
        lists = lists.chunks[0] if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        common = _shared(lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), sizes), len(node))
        passed = 100 * common >= 75 * (sizes[:, None] + sizes[None, :] - common) - 2
        passed &= (label[:, None] != label[None, :]) & (node[:, None] < node[None, :])
        if key[1].as_py() != key[2].as_py():  # pairs within one block belong to its own cell
            passed &= block[:, None] != block[None, :]
        a, b = np.nonzero(passed)
        return pa.table({"a": node[a], "b": node[b]})

    return rows.join(short, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _labels(docs: DataFrame, signed: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, label) of every node that is linked with another one."""
    of_bands = signed.where("doc_id is not null").join(copies.withColumnRenamed("node", "first"), "set_key", "left").where("first is null or first = doc_id")
    of_bands = of_bands.select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("node"), "n_shingles")
    shared = of_bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("bucket", "pivot")
    members = stored(of_bands.join(shared, "bucket").distinct(), "members")
    named, texts = members.select(F.col("node").alias("doc_id")).distinct(), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_of = maybe_in(texts, "doc_id", named).join(named, "doc_id", "left_semi")
    sets = stored(shingle_sets(text_of).distinct(), "sets")

    size = members.groupBy("node").agg(F.max("n_shingles").alias("n"))
    first = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("n_shingles").alias("n_b")).distinct()
    first = first.join(size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").where("100L * least(n_a, n_b) >= 75L * greatest(n_a, n_b)")
    edges = stored(confirmed(first.select("a", "b"), sets), "links")
    labels = stored(components(edges), "labels")

    rest = stored(open_buckets(members.select("bucket", "node"), labels), "open")
    if not empty(rest):
        found = stored(confirmed(pairs_in_cells(rest, sets), sets), "links")
        known = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = stored(components(known.union(found)), "labels")
    return labels


def linked(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs; see the module."""
    signed = stored(signatures(docs, rows, bands), "signatures")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"))
    copies = stored(classes.where("node < last").select("set_key", "node"), "classes")
    nodes = signed.select("doc_id", "n_shingles", "set_key").join(copies, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    labels = found_in(docs.sparkSession, "labels", lambda: _labels(docs, signed, copies))
    result = nodes.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row of each group, with the columns docs came with: that of its smallest id, a null one last.

    Each row is judged by its own text, so rows that share an id, or have none, and differ in text are documents
    of their own; rows of equal id and text, null or not, are one.
    """
    spark = docs.sparkSession
    keyed, name = row_keyed(docs, "doc_id", "text")

    def duplicates() -> DataFrame:
        found = linked(keyed.select(F.col(name).alias("doc_id"), "text"), rows, bands)
        found = stored(found.select(F.col("doc_id").alias("key"), "component_id").distinct(), "components")
        members = keyed.select(F.col(name).alias("key"), F.col("doc_id").alias("id")).join(found, "key")
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")
        stays = members.groupBy("component_id").agg(first)
        return found.join(stays, "component_id").where("key <> first.key").select(F.col("key").alias(name))

    gone = found_in(spark, "duplicates", duplicates)
    left = keyed.join(gone, name, "left_anti")
    again = found_in(spark, "repeated", lambda: left.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name))
    if empty(again):
        return left.select(*docs.columns)
    once = left.join(again, name, "left_anti").select(*docs.columns)
    first = left.join(again, name, "left_semi").dropDuplicates([name, "text"]).select(*docs.columns)
    return once.union(first)
