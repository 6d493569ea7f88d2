"""How the words of each source differ from those of the other sources of its language.

Terms are runs of letters and of characters beyond ASCII. In UTF-8 that is a rule on bytes: one
translate table lowers A-Z and blanks every other ASCII byte, and a split at blanks leaves the
terms. A Counter per document gives its frequencies; a task adds them up per language and source
before anything is shuffled, in a buffer that is emptied when it is full.

* `term_counts`: occurrences and documents of each term of each (language, source), sparse.
* `lexicon`: the terms of a language that enough of its documents hold, each with its sources.
* `over_used`: per (language, source) the terms that it uses most beyond its language's rate.
* `divergences`: for each two sources of a language the sum of f over all kept terms. A task keeps
  one matrix of sums a language (in tiles of sources) and adds a term's whole row to it, so no row
  is made of a term and two sources; the sums of tasks are added by (language, source, source).

The rates are whole numbers: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)). All arithmetic is exact:
decimals in the JVM, and long division by a base of 1000 in numpy (N up to 9e15).

Defined results: null text, language and source are ''; a group without kept terms has N = 0 and the
rate of a count of 0 everywhere; a language of one source has no pairs, one without kept terms has
pairs of value 0; rows count each for itself, repeated or not; an empty table gives no row; no other
column than text, lang and source is read.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import stored

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
TILE = 256  # sources of a side of a matrix of sums
_HELD = 4_000_000  # sums a task holds before it passes them on
_TERMS, _BYTES = 200_000, 32 << 20  # terms, and bytes of them, that a task holds before it passes them on

#: A-Z lowered, a-z and bytes beyond ASCII as they are, all else blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, lower-cased, in their order."""
    return text.translate(_LETTERS).split()


def _counted(batches):
    """(lang, source, term, count, documents); a row without a term for every group met."""
    names = ["lang", "source", "term", "count", "documents"]
    counts, documents, size = {}, {}, 0

    def emptied():
        for (lang, source), count in counts.items():
            holds, terms = documents[lang, source], [None, *count]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()), pa.array([0, *count.values()], pa.int64()),
                 pa.array([0, *map(holds.__getitem__, count)], pa.int64())], names)

    for batch in batches:
        for text, lang, source in zip(*(batch.column(name) for name in ("text", "lang", "source"))):
            group = lang.as_py(), source.as_py()
            own = Counter(terms_of(text.as_py()))
            count, holds = counts.setdefault(group, Counter()), documents.setdefault(group, Counter())
            before = len(count)
            count.update(own)
            holds.update(own.keys())
            # New terms are counted by their number and, at most, by the length of the text they are from.
            size += min(len(text.as_py()), 64 * (len(count) - before))
            if size > _BYTES or sum(map(len, counts.values())) > _TERMS:
                yield from emptied()
                counts, documents, size = {}, {}, 0
    yield from emptied()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and documents; a null term stands for the group itself."""
    plain = docs.select(*(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("text", "lang", "source")))
    found = plain.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(
        _counted, "lang string, source string, term binary, count long, documents long"
    )
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def lexicon(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, count, and found (source and count): the terms in at least so many documents of a language.

    A term's list has at most one entry for each source of its language.
    """
    terms = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("count").alias("count"), F.collect_list(F.struct("source", "count")).alias("found")
    )
    return terms.where(F.col("documents") >= least).select("lang", "term", "count", "found")


def totals(counts: DataFrame, words: DataFrame) -> DataFrame:
    """For each language: its sources in order with their sums N over kept terms, its own N, and V."""
    sums = words.select("lang", F.explode("found").alias("cell")).groupBy("lang", "cell.source").agg(F.sum("cell.count").alias("n"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    own = words.groupBy("lang").agg(F.sum("count").alias("n_lang"), F.count("*").alias("v"))
    return by_lang.join(own, "lang", "left").select("lang", "sources", F.coalesce("n_lang", F.lit(0)).alias("n_lang"), F.coalesce("v", F.lit(0)).alias("v"))


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms))."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 2 * terms).cast("decimal(19,0)")
    return F.call_function("div", above, below) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); rates are below 2^30, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def over_used(words: DataFrame, by_lang: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: terms whose rate in the source is above that in the language."""
    of_source = F.map_from_entries("sources").alias("of_source")
    joined = words.join(by_lang.select("lang", of_source, "n_lang", "v"), "lang")
    cells = joined.select("lang", F.col("term").alias("item"), rate(F.col("count"), F.col("n_lang"), F.col("v")).alias("q"), "of_source", "v", F.explode("found").alias("cell"))
    p = rate(F.col("cell.count"), F.element_at("of_source", F.col("cell.source")), F.col("v"))
    above = cells.select("lang", F.col("cell.source").alias("source"), "item", p.alias("p"), "q").where("p > q")
    valued = above.select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
    # Spark cuts each task's rows of a group at this rank before it shuffles them.
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def rates(counts: np.ndarray, totals: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The same rate over arrays, by long division."""
    below = totals + 2 * terms
    whole, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def _sums(batches):
    """Adds the terms' rows up to matrices of sums, by language and tile."""
    names = ["lang", "i", "j", "value"]
    held, size = {}, 0

    def emptied():
        for (lang, i, j), sums in held.items():
            left, right = np.indices(sums.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * sums.size, pa.string()), pa.array(i * TILE + left), pa.array(j * TILE + right), pa.array(sums.ravel())], names
            )

    def matrix(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)

    for batch in batches:
        for (lang, i, j), rows in _runs(batch):
            v = rows.column("v").to_numpy()[:, None]
            left, right = (rates(matrix(rows.column(f"{side}_count")), matrix(rows.column(f"{side}_n")), v) for side in ("left", "right"))
            if (lang, i, j) not in held:
                held[lang, i, j] = np.zeros((left.shape[1], right.shape[1]), dtype=np.int64)
                size += left.shape[1] * right.shape[1]
            sums = held[lang, i, j]
            for at in range(left.shape[1]):
                p = left[:, at : at + 1]
                sums[at] += ((p - right) ** 2 // (p + right)).sum(axis=0)
            if size > _HELD:
                yield from emptied()
                held, size = {}, 0
    yield from emptied()


def _runs(batch):
    """The rows of a batch by (lang, i, j)."""
    keys = list(zip(*(batch.column(name).to_pylist() for name in ("lang", "i", "j"))))
    places = {}
    for at, key in enumerate(keys):
        places.setdefault(key, []).append(at)
    for key, rows in places.items():
        yield key, batch.take(pa.array(rows))


def divergences(words: DataFrame, by_lang: DataFrame) -> DataFrame:
    """lang, source, item, value: each source with each other one of its language."""
    joined = words.join(by_lang.where("size(sources) > 1"), "lang").withColumn("of_source", F.map_from_entries("found"))
    dense = F.transform("sources", lambda s: F.struct(F.coalesce(F.element_at("of_source", s["source"]), F.lit(0)).alias("count"), s["n"].alias("n")))
    rows = joined.select("lang", "v", dense.alias("cells"), F.expr(f"(size(sources) - 1) div {TILE}").alias("last"))
    tiled = rows.select("lang", "v", "cells", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"))
    tiled = tiled.select("lang", "v", "cells", "i", F.explode(F.sequence("i", "last")).alias("j"))
    side = {f"{name}_{field}": F.expr(f"slice(cells, cast({tile} * {TILE} + 1 as int), {TILE}).{field}") for name, tile in (("left", "i"), ("right", "j")) for field in ("count", "n")}
    sums = tiled.select("lang", "i", "j", "v", *(column.alias(name) for name, column in side.items())).mapInArrow(_sums, "lang string, i long, j long, value long")
    half = sums.where("i < j").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", "j", "i", "value"))
    placed = by_lang.select("lang", F.posexplode("sources.source").alias("i", "source"))
    other = placed.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    pairs = placed.join(other, "lang").where("i <> j")  # the rows of the result
    return pairs.join(both, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module."""
    counts = stored(term_counts(docs), "term-counts")
    words = stored(lexicon(counts, least), "lexicon")
    by_lang = stored(totals(counts, words), "languages")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = divergences(words, by_lang).withColumn("rank", F.row_number().over(place))
    columns = ("lang", "source", "part", "item", "value", "rank")
    parts = (rows.withColumn("part", F.lit(name)).select(*columns) for name, rows in (("pair", pairs), ("term", over_used(words, by_lang, top))))
    return next(parts).union(next(parts))
