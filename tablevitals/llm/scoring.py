"""Scores of texts under a bigram model held in log-frequency Bloom filters.

Training counts of words and word pairs are quantised: level q stands for a count of about
BASE^(q-1). A filter holds, for each n-gram of level q, the n-gram together with 1, 2, ... q, and
nothing else; the level is read back by probing 1, 2, 3 ... until one is missing. An error can
only raise a level, with a probability of about 3 % a probe (8 bits, 4 of one 64-bit block). With
c the dequantised counts, tokens of a text have

    p(w | v) = (1 - WEIGHT) * p(w) + WEIGHT * c(v w) / c(v),    p(w) = (c(w) + 1) / (N + V + 1)

where c(v w) is at most c(v), so that errors can't lift a pair above its context.

Counting is one pass: each task sums pairs and words of a few texts and sends them packed by bucket of
hash; a bucket's task adds them up and returns its blocks of the filter, and for words the counts. The
number of buckets follows the size of the input, so no bucket holds more than a bounded share of n-grams, and
a frequent one arrives summed. Only then a second pass sends which text has which word to its bucket's exact
counts, and back come sums by text for base_score. These postings are dealt by bucket and a salt of the
texts they are from, each salt with its bucket's counts, so those of a word in every text, as the
end token is, spread over as many tasks as there are millions of texts.

The filters are broadcast in parts below FILTER_BYTES. Mostly one part holds all. Otherwise there is a
round for each choice of the parts of v, of w and of v w; it scores the tokens whose words and pair
lie in its parts, and the rounds are added up. No n-gram is left out.

Defined results: a null or empty text has only its end token; a null id counts as remainder 0; each
row of a repeated id is scored for itself; with no training text N and V are 0 and scores are those
of p = 1 a token; only doc_id and text are read.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import WordHashes, id_remainder, mixed, stored, words_of

BASE = 1.5  # of the count levels
BITS, PROBES = 8, 4  # bits an entry, bits set for it in its block
WEIGHT = 0.3  # of what pairs say, against the word alone
FILTER_BYTES = 80_000_000  # of filters broadcast at once
BUCKET_TOKENS = 1_000_000, 2_000_000  # tokens for each bucket of pairs, of words
SALT_TEXTS = 1_000_000  # texts for each salt of a bucket's postings
END = np.uint64(0x51ED270B35D8A2F1)  # the end token, and what stands before the first word
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PAIR_BITS = np.uint64((1 << 48) - 1)  # of a pair's hash; fewer bytes to shuffle


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(level == 0, 0.0, np.maximum(1.0, BASE ** (level - 0.5)))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * _GOLDEN + word) & _PAIR_BITS


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _places(hashes: np.ndarray, level, blocks) -> tuple[np.ndarray, np.ndarray]:
    """The block of an entry and its bits in it."""
    key = mixed(hashes + np.asarray(level, dtype=np.uint64) * _GOLDEN)
    mask = np.zeros(len(key), dtype=np.uint64)
    for probe in range(PROBES):
        mask |= np.uint64(1) << ((key >> np.uint64(6 * probe)) & np.uint64(63))
    return ((key >> np.uint64(32)) % np.asarray(blocks, dtype=np.uint64)).astype(np.int64), mask


def filter_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit blocks that hold every n-gram with its levels."""
    level = levels(counts)
    blocks = np.zeros(max(1, int(level.sum()) * BITS // 64), dtype=np.uint64)
    for at in range(1, int(level.max(initial=0)) + 1):
        place, mask = _places(hashes[level >= at], at, len(blocks))
        np.bitwise_or.at(blocks, place, mask)
    return blocks


class Filter:
    """The filters of some buckets as one array."""

    def __init__(self, blocks: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
        self.blocks, self.sizes, self.starts, self.buckets = blocks, sizes, starts, len(sizes)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=np.int64)
        left = np.flatnonzero(self.sizes[bucket_of(hashes, self.buckets)] > 0)
        at = 1
        while len(left):
            ask = hashes[left]
            bucket = bucket_of(ask, self.buckets)
            place, mask = _places(ask, at, self.sizes[bucket])
            left = left[self.blocks[self.starts[bucket] + place] & mask == mask]
            found[left] = at
            at += 1
        return found


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, dtype=np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def planes(values: np.ndarray, size: int) -> bytes:
    """The lowest bytes of unsigned values, all first bytes together, then all second: these compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplaned(raw: bytes, size: int) -> np.ndarray:
    parts = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1)
    out = np.zeros((parts.shape[1], 8), dtype=np.uint8)
    out[:, :size] = parts.T
    return out.reshape(-1).view("<u8")


_PACKED = "kind int, bucket int, hashes binary, counts binary"
_TOTALS = "kind int, bucket int, blocks binary, tokens long, distinct long, hashes binary, counts binary"
_POSTINGS = "bucket int, source long, hashes binary, counts binary, runs binary, rows binary, ids binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a record batch of a schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _texts(batch, words: WordHashes, at_once: int = 200_000):
    """(first row, hashes of all tokens, ends) of a few texts at a time; an end token follows each text."""
    start, waiting, count = 0, [], 0
    for row, text in enumerate(batch.column("text")):
        waiting.append(np.append(words.of(words_of(text.as_py())), END))
        count += len(waiting[-1])
        if count >= at_once or row == batch.num_rows - 1:
            yield start, np.concatenate(waiting), np.cumsum([len(x) for x in waiting])
            start, waiting, count = row + 1, [], 0


def _before(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first one, the end."""
    before = np.roll(tokens, 1)
    before[0] = END
    before[ends[:-1]] = END
    return before


def _by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, places) of the hashes, their order kept."""
    own = bucket_of(hashes, buckets)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(cuts)):
        yield bucket, order[cuts[bucket] : cuts[bucket + 1]]


def counted(source: DataFrame, pair_buckets: int, word_buckets: int) -> DataFrame:
    """Rows of _TOTALS: the filter of each bucket of pairs (kind 2) and of words (1), these with their counts."""

    def pack(batches):
        words = WordHashes()
        for batch in batches:
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for start, tokens, ends in _texts(batch, words):
                learn = np.repeat(train[start : start + len(ends)], np.diff(ends, prepend=0))
                out, ones = [], np.ones(int(learn.sum()), dtype=np.int64)
                for kind, grams, buckets in ((2, pair_hash(_before(tokens, ends), tokens), pair_buckets), (1, tokens, word_buckets)):
                    grams, counts = _summed(grams[learn], ones)
                    for bucket, part in _by_bucket(grams, buckets):
                        out.append((kind, bucket, planes(grams[part], 6 if kind == 2 else 8), planes(counts[part], 4)))
                yield _batch(out, _PACKED)

    def total(key, packed):
        kind = key[0].as_py()
        hashes = np.concatenate([unplaned(x.as_py(), 6 if kind == 2 else 8) for x in packed.column("hashes")])
        counts = np.concatenate([unplaned(x.as_py(), 4).astype(np.int64) for x in packed.column("counts")])
        hashes, counts = _summed(hashes, counts)
        exact = (hashes.tobytes(), counts.tobytes()) if kind == 1 else (None, None)
        return pa.Table.from_batches([_batch([(kind, key[1].as_py(), filter_of(hashes, counts).tobytes(), int(counts.sum()), len(hashes), *exact)], _TOTALS)])

    return source.select("held_out", "text").mapInArrow(pack, _PACKED).groupBy("kind", "bucket").applyInArrow(total, _TOTALS)


def postings(source: DataFrame, buckets: int) -> DataFrame:
    """Rows of _POSTINGS: by bucket, the words of a few texts, and how often each is in which of these."""

    def pack(batches):
        words = WordHashes()
        for batch in batches:
            row_ids = batch.column("row_id").to_numpy()
            for start, tokens, ends in _texts(batch, words):
                own_ids = row_ids[start : start + len(ends)]
                source_id = int(mixed(own_ids.view(np.uint64)).sum().view(np.int64))
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                order = np.lexsort((row, tokens))
                tokens, row = tokens[order], row[order]
                first = np.flatnonzero(np.append(True, (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])))
                counts = np.diff(np.append(first, len(tokens)))
                tokens, row = tokens[first], row[first]
                out = []
                for bucket, part in _by_bucket(tokens, buckets):
                    heads = np.flatnonzero(np.append(True, tokens[part][1:] != tokens[part][:-1]))
                    own, place = np.unique(row[part], return_inverse=True)
                    runs = np.diff(np.append(heads, len(part)))
                    out.append((bucket, source_id, tokens[part][heads].tobytes(), planes(counts[part], 4), planes(runs, 4), planes(place, 4), own_ids[own].tobytes()))
                yield _batch(out, _POSTINGS)

    return source.select("row_id", "text").mapInArrow(pack, _POSTINGS)


def looked_up(posted: DataFrame, totals: DataFrame, salts: int) -> DataFrame:
    """source, row_ids, sums: what a bucket's exact counts say of the texts of each row of postings."""
    nothing = F.lit(None).cast("binary")
    salted = posted.withColumn("salt", F.pmod("source", F.lit(salts)).cast("int"))
    known = totals.where("kind = 1").select("bucket", F.lit(None).cast("long").alias("source"), "hashes", "counts", *(nothing.alias(c) for c in ("runs", "rows", "ids")), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def look(rows):
        places = np.flatnonzero(rows.column("source").is_null().to_numpy(zero_copy_only=False))
        known, times = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        if len(places):
            known, times = (np.frombuffer(rows.column(name)[int(places[0])].as_py(), dtype=kind) for name, kind in (("hashes", np.uint64), ("counts", np.int64)))
        sources, ids, sums = [], [], []
        for source, *packed in zip(*(rows.column(name) for name in ("source", "hashes", "counts", "runs", "rows", "ids"))):
            if not source.is_valid:
                continue
            head, count, run, place, own = (x.as_py() for x in packed)
            head, (count, run, place) = np.frombuffer(head, dtype=np.uint64), (unplaned(x, 4).astype(np.int64) for x in (count, run, place))
            c = np.zeros(len(head), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                c = np.where(known[at] == head, times[at], 0)
            c = np.repeat(c, run)
            found = [np.bincount(place, weights=x) for x in (count, count * (c > 0), count * np.log10(c + 1.0))]
            sources.append(source.as_py())
            ids.append(own)
            sums.append(np.concatenate(found).tobytes())
        return pa.table({"source": pa.array(sources, pa.int64()), "row_ids": pa.array(ids, pa.binary()), "sums": pa.array(sums, pa.binary())})

    rows = salted.unionByName(known)
    return rows.groupBy("bucket", "salt").applyInArrow(look, "source long, row_ids binary, sums binary")


def by_row(parts: DataFrame) -> DataFrame:
    """The sums over words as rows: all tokens, known ones, and log10(c + 1), of each row_id.

    What the buckets say of one task's few texts meets again by its source, and only then
    becomes rows; so these are as many as texts, whatever the number of buckets.
    """

    def add(parts):
        ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in parts.column("row_ids").to_pylist()])
        sums = np.concatenate([np.frombuffer(x, dtype=np.float64).reshape(3, -1) for x in parts.column("sums").to_pylist()], axis=1)
        own, place = np.unique(ids, return_inverse=True)
        everything, known, logs = (np.bincount(place, weights=x) for x in sums)
        return pa.table({"row_id": own, "all_tokens": np.round(everything).astype(np.int64), "n_known": np.round(known).astype(np.int64), "logs": logs})

    sums = parts.groupBy("source").applyInArrow(add, "row_id long, all_tokens long, n_known long, logs double")
    return sums.groupBy("row_id").agg(F.sum("all_tokens").alias("all_tokens"), F.sum("n_known").alias("n_known"), F.sum("logs").alias("logs"))


def model_sums(source: DataFrame, filters, n: int, v: int, parts: tuple[int, ...], at: tuple[int, ...]) -> DataFrame:
    """Of each row its n_tokens and score, over the tokens whose v, w and v w lie in these parts."""

    def score(batches):
        words = WordHashes()
        befores, unigrams, pairs = (Filter(*part.value) for part in filters)
        for batch in batches:
            sums, sizes = [], []
            for _, tokens, ends in _texts(batch, words):
                before = _before(tokens, ends)
                both = pair_hash(before, tokens)
                distinct, place = np.unique(tokens, return_inverse=True)
                own = count_of(unigrams.levels(distinct))
                context = own if at[0] == at[1] else count_of(befores.levels(distinct))
                own, context = own[place], context[np.searchsorted(distinct, before)]
                seen = np.minimum(count_of(pairs.levels(both)), context)
                logs = np.log10((1 - WEIGHT) * (own + 1) / (n + v + 1) + WEIGHT * seen / np.maximum(context, 1))
                for hashes, part, count, own_part in zip((before, tokens, both), (befores, unigrams, pairs), parts, at):
                    if count > 1:
                        logs[bucket_of(hashes, part.buckets) % count != own_part] = 0
                sums.append(np.add.reduceat(logs, np.append(0, ends[:-1])))
                sizes.append(np.diff(ends, prepend=0))
            none = np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_id"), batch.column("held_out"), pa.array(np.concatenate(sizes or [none]).astype(np.int64)), pa.array(np.concatenate(sums or [none]))], ["doc_id", "row_id", "held_out", "n_tokens", "score"])

    return source.mapInArrow(score, "doc_id long, row_id long, held_out boolean, n_tokens long, score double")


def _parts(totals: DataFrame, kind: int, buckets: int, most: int) -> int:
    """How many parts keep a kind's filters below `most` bytes each, as far as buckets allow."""
    size = totals.where(F.col("kind") == kind).agg(F.sum(F.length("blocks"))).first()[0] or 0
    return min(buckets, -(-size // most) or 1)


def _filter(totals: DataFrame, kind: int, buckets: int, parts: int, part: int) -> tuple[np.ndarray, ...]:
    """A part's blocks, one bucket after the other, with each bucket's size and start."""
    rows = totals.where((F.col("kind") == kind) & (F.col("bucket") % parts == part)).select("bucket", "blocks")
    sizes, starts, found, at = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64), [], 0
    for row in rows.toLocalIterator():
        blocks = np.frombuffer(row.blocks, dtype=np.uint64)
        sizes[row.bucket], starts[row.bucket] = len(blocks), at
        at += len(blocks)
        found.append(blocks)
    return np.concatenate([*found, np.zeros(1, dtype=np.uint64)]), sizes, starts


def scored(docs: DataFrame, held_out=None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The scores of every row of docs; held_out (a boolean Column) marks rows not learnt from."""
    spark = docs.sparkSession
    held_out = id_remainder("doc_id", 7) == 2 if held_out is None else held_out
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_id"), held_out.alias("held_out"), "text")
    characters, texts = source.agg(F.sum(F.length("text")), F.count("*")).first()
    pair_buckets, word_buckets = (max(8, -(-((characters or 0) // 6) // each)) for each in BUCKET_TOKENS)
    totals = stored(counted(source, pair_buckets, word_buckets), "counts")
    looked = stored(looked_up(postings(source, word_buckets), totals, -(-texts // SALT_TEXTS) or 1), "word-sums")
    n, v = (x or 0 for x in totals.where("kind = 1").agg(F.sum("tokens"), F.sum("distinct")).first())

    rounds, kinds = None, ((1, word_buckets), (1, word_buckets), (2, pair_buckets))
    parts = tuple(_parts(totals, kind, buckets, filter_bytes) for kind, buckets in kinds)
    for at in itertools.product(*map(range, parts)):
        filters = [spark.sparkContext.broadcast(_filter(totals, kind, buckets, count, part)) for (kind, buckets), count, part in list(zip(kinds, parts, at))[1:]]
        filters = [filters[0], *filters] if at[0] == at[1] else [spark.sparkContext.broadcast(_filter(totals, 1, word_buckets, parts[0], at[0])), *filters]
        part = model_sums(source, filters, n, v, parts, at)
        part = part if math.prod(parts) == 1 else stored(part, "sums")
        rounds = part if rounds is None else rounds.union(part)
    scores = rounds
    if math.prod(parts) > 1:
        # Rows of one row_id are alike: a round has `copies` of each.
        keys = ["doc_id", "row_id", "held_out", "n_tokens"]
        count = math.prod(parts)
        scores = rounds.groupBy(*keys).agg(F.sum("score").alias("total"), (F.count("*") / count).cast("int").alias("copies"))
        scores = scores.select(*keys, (F.col("total") / F.col("copies")).alias("score"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    base = scores.join(by_row(looked), "row_id")
    # Equal rows were added up; each has its share of tokens.
    share = F.col("n_tokens") / F.col("all_tokens")
    return base.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.round(F.col("n_known") * share).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") * share - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score",
    )
