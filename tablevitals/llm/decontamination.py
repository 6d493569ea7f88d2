"""Passages of a benchmark in documents: SimHash of item-sized windows, then an exact check.

Words are lower-cased runs of letters and digits, so case, punctuation and line breaks don't
hide a passage. An item is the bag of its word 5-grams (its whole sequence, when shorter). A document has a
copy of an item if a window of as many words as the item has a weighted shingle similarity

    sum over shingles of min(count in window, count in item) / sum of max(...)  >=  0.75

* Anchors. An item of m shingles and a window that is similar have at least 0.75 m of them in common (the
  union is no smaller than m), so the window holds at least that many places with a shingle of the item. The
  places come from one join of the documents' shingles with the items'. Of a document's sorted places,
  each run of k = 0.75 m that fits in a window gives the starts that cover it; all starts, in
  whatever order the shingles are, come out once, so this loses nothing.
* Fingerprints. Each such window and each item gets a 64-bit SimHash: the sign, bit by bit, of
  the sum of its shingles' hashes as +1 and -1.
* Multi-index. A fingerprint is cut in BLOCKS blocks. If two differ in at most RADIUS bits, then
  some block differs in at most RADIUS // BLOCKS; each item is listed under all values that near to each of
  its blocks, and a window asks for its own values. So every item within RADIUS is found.
* The weighted similarity of these pairs is then computed from the full shingle counts.

A pair at similarity 0.75 is at an angle of about 0.54 and so at 11 +- 3 bits; with RADIUS 23 it is lost with a
probability of some 3e-5, and of unrelated pairs two in a hundred pass. An item of up to six shingles is only similar to
an equal bag, at 0 bits.

Everything is SQL functions. The benchmark's shingles join by hash, and Spark decides by their size
whether to broadcast them; a shingle that many items share yields one row for each, as it must. A
shingle that very many documents have only meets the items that hold it. Items of equal words are one
until the end, so repeated ones cost no more. The index is never broadcast, and no row of a window holds its text.

Defined results: null, empty or wordless texts or items match nothing; repeated items and rows each
match for themselves; rows with a null key match nothing (`kept` has a key for every row: its text); of several windows the best one is
returned, the first of equal ones; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import found_in, maybe_in, row_keyed, stored

SHINGLE = 5
PERCENT = 75
RADIUS, BLOCKS, BITS = 23, 8, 64


def word_array(text: str) -> Column:
    """Lower-cased runs of letters and digits of a text column, in order."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda word: word != "")


def shingle_hashes(words: str, size: str) -> str:
    """SQL: hashes of the n-grams of an array column, in order; none if it has fewer words than size."""
    grams = ", ".join(f"if({size} > {place}, get({words}, i + {place}), null)" for place in range(SHINGLE))
    return f"if(size({words}) < {size} or size({words}) = 0, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {size}), i -> xxhash64({grams})))"


def simhash(shingles: str) -> str:
    """SQL: the 64-bit sign of the summed hashes of an array of shingle hashes."""
    # Sums of four bits' votes at a time would save little: windows are few and short.
    bit = f"if(2 * aggregate({shingles}, 0, (n, h) -> n + cast(getbit(h, b) as int)) > size({shingles}), shiftleft(1L, b), 0L)"
    return f"aggregate(transform(sequence(0, {BITS - 1}), b -> {bit}), 0L, (f, x) -> f | x)"


def near_masks(bits: int, most: int) -> list[int]:
    """Numbers of a block's width with at most so many bits set."""
    return [mask for mask in range(1 << bits) if mask.bit_count() <= most]


def worded(benchmark: DataFrame) -> DataFrame:
    """item_id, item (one for equal words) and words of each item with words."""
    rows = benchmark.select("item_id", word_array("text").alias("words")).where("size(words) > 0")
    return rows.select("item_id", F.xxhash64("words").alias("item"), "words")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (unique), length in words, n, shingle hashes and fingerprint of each sequence of words, however many items have it."""
    rows = worded(benchmark).groupBy("item").agg(F.first("words").alias("words"))
    rows = rows.withColumn("n", F.least(F.lit(SHINGLE), F.size("words"))).withColumn("shingles", F.expr(shingle_hashes("words", "n")))
    rows = rows.select("item", F.size("words").alias("length"), "n", "shingles")
    return rows.withColumn("fingerprint", F.expr(simhash("shingles")))


def anchors(docs: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """key, start, length, n: the distinct windows that hold enough places of some item's shingles."""
    sizes = sorted(row.n for row in items.select("n").distinct().collect())  # at most SHINGLE numbers
    entries = items.select("item", "length", "n", F.explode(F.array_distinct("shingles")).alias("hash")).distinct()
    words = docs.where(F.col(key).isNotNull()).select(key, word_array("text").alias("words"))
    found = None
    for n in sizes:
        grams = words.select(key, F.posexplode(F.expr(shingle_hashes("words", str(n)))).alias("place", "hash"))
        part = grams.join(entries.where(F.col("n") == n), "hash").select(key, "item", "length", "n", "place")
        found = part if found is None else found.union(part)
    found = found.groupBy(key, "item", "length", "n").agg(F.array_sort(F.collect_set("place")).alias("places"))
    found = found.withColumn("m", F.expr("length - n + 1")).withColumn("k", F.expr(f"cast(({PERCENT} * m + 99) div 100 as int)")).where("size(places) >= k")
    # Starts up to the place before belong to the run before.
    low = "greatest(get(places, i + k - 1) - m + 1, coalesce(get(places, i - 1) + 1, 1 - length))"
    runs = "filter(sequence(0, size(places) - k), i -> get(places, i + k - 1) - get(places, i) < m)"
    starts = F.expr(f"flatten(transform({runs}, i -> sequence({low}, get(places, i))))")
    return found.select(key, F.explode(starts).alias("start"), "length", "n").distinct()


def weighted_similarity(one: str, other: str) -> str:
    """SQL: percent and common weight of two arrays of shingle hashes, as a struct."""
    count = lambda array: f"size(filter({array}, h -> h = x))"
    common = f"aggregate(array_intersect({one}, {other}), 0, (n, x) -> n + least({count(one)}, {count(other)}))"
    return common


def windows_of(texts: DataFrame, key: str, placed: DataFrame) -> DataFrame:
    """key, start, length and own shingle hashes of the windows placed; texts has key and text.

    A text's shingles are hashed once and a window takes its run of them, so no row of a window holds the text.
    """
    with_windows = placed.groupBy(key, "n").agg(F.collect_set(F.struct("start", "length")).alias("windows"))
    # Few documents have any, and the others need not be moved to find that out.
    words = maybe_in(texts, key, placed).join(with_windows, key).select(key, "n", "windows", word_array("text").alias("words"))
    hashes = words.select(key, "n", "windows", F.size("words").alias("n_words"), F.expr(shingle_hashes("words", "n")).alias("hashes"))
    own = "slice(hashes, greatest(w.start, 0) + 1, greatest(least(w.start + w.length, n_words) - greatest(w.start, 0) - n + 1, 0))"
    runs = F.explode(F.expr(f"transform(windows, w -> struct(w.start, w.length, {own} AS own))"))
    return hashes.select(key, runs.alias("w")).select(key, "w.start", "w.length", "w.own").where("size(own) > 0")


def near_items(windows: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """key, start, length, item: the items whose fingerprints are within RADIUS of a window's."""
    width = BITS // BLOCKS
    block = lambda value, i: F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1)
    masks = F.array(*map(F.lit, near_masks(width, RADIUS // BLOCKS)))
    blocks = lambda value: F.array(*(block(F.col(value), i) for i in range(BLOCKS)))
    listed = items.select("item", "length", "fingerprint", F.posexplode(blocks("fingerprint")).alias("block", "value"))
    listed = listed.select("item", "length", "fingerprint", "block", F.explode(F.transform(masks, lambda mask: F.col("value").bitwiseXOR(mask))).alias("value"))
    asked = windows.select(key, "start", "length", "print", F.posexplode(blocks("print")).alias("block", "value"))
    # The rows are hundreds for an item and eight for a window; Spark's estimate for a broadcast, from the files, leaves that out.
    near = asked.join(listed.hint("merge"), ["length", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= RADIUS)
    return near.select(key, "start", "length", "item").distinct()


def similar(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """key, item, best (similarity, back, length): the best window of each document and similar sequence of words."""
    items = stored(items_of(benchmark), "items")
    if not items.take(1):
        return docs.select(key).where(F.lit(False)).selectExpr(f"`{key}`", "cast(null as bigint) AS item", "cast(null as struct<similarity: double, back: int, length: int>) AS best")
    placed = stored(anchors(docs, key, items), "anchors")
    # The windows' own shingles, from the texts of documents that have any.
    windows = windows_of(docs.select(key, "text"), key, placed)
    windows = stored(windows.withColumn("print", F.expr(simhash("own"))), "windows")
    # No broadcast either: the files are much smaller than their rows.
    own = windows.select(key, "start", "length", "own").hint("merge")
    pairs = near_items(windows, key, items).join(own, [key, "start", "length"]).join(items.select("item", "shingles"), "item")
    common = F.expr(weighted_similarity("own", "shingles"))
    scored = pairs.withColumn("common", common).withColumn("whole", F.size("own") + F.size("shingles") - F.col("common")).where(100 * F.col("common") >= PERCENT * F.col("whole"))
    best = F.max(F.struct((F.col("common") / F.col("whole")).alias("similarity"), (-F.col("start")).alias("back"), "length"))
    return scored.groupBy(key, "item").agg(best.alias("best"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item_id, start, length, similarity: the best window of each document and similar item."""
    ids = worded(benchmark).select("item", "item_id").distinct()
    rows = similar(docs, benchmark, key).join(ids, "item")
    return rows.select(key, "item_id", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), F.col("best.similarity").alias("similarity"))


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a copy of an item, with the columns they came with.

    Each row is judged by its own text, whatever its id: rows without one too, and rows that share one apart.
    """
    keyed, name = row_keyed(docs, "text")
    leaks = lambda: similar(keyed.select(name, "text"), benchmark, name).select(name).distinct()
    found = found_in(docs.sparkSession, "leaks", leaks)
    return keyed.join(found, name, "left_anti").select(*docs.columns)
