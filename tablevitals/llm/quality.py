"""Quality rules whose thresholds come from the data.

Each text gets counts, and from them the ratios in RULES. For every language and source, a
quantile sketch of each ratio is kept: counts by logarithmic bucket (a relative error of 1 % a
value). Sketches are merged by adding counts, so they are one map-side aggregation, and the same
counts merge into sketches of a language and of all. The thresholds of a group are the fences

    q75 + REACH * max(q75 - q25, least spread)    and    q25 - REACH * max(q75 - q25, least spread)

of its own sketch, or of its language's, or of all, whichever is the first with ENOUGH documents.
Documents are joined with their group's fences and rejected outside them. The table of fences has a
row for each language and source; whether it is broadcast is left to Spark's check of its size.

Everything is SQL functions: words and windows stay in arrays of the row, so no window of a text
is shuffled. A 3-word window is one number, its hash above its place; sorted, equal windows are
neighbours.

Defined results: null, empty or wordless texts have counts 0 and fail base; a null language or source
counts as an empty one; a text of two words has no window; repeated rows count each for itself; all
columns of the input come through, whatever their names.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablevitals.llm.common import SPACE_RUN, SPACES, stored

REACH = 5.0
ENOUGH = 200
ACCURACY = 0.01
SMALLEST = 1e-4  # ratios below are one bucket
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: Ratio, whether too low counts as well, and the least spread of its fences.
RULES = {
    "symbol_ratio": ("n_symbols / word_chars", False, 0.004),
    "word_length": ("word_chars / n_words", True, 0.3),
    "upper_ratio": ("n_upper / word_chars", False, 0.02),
    "repeat_ratio": ("n_repeat_words / n_words", False, 0.08),
    "dup_line_ratio": ("n_dup_lines / n_lines", False, 0.09),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def free_name(frame: DataFrame, wish: str) -> str:
    """A column name that the frame does not have."""
    names = {name.lower() for name in frame.columns}
    while wish.lower() in names:
        wish = f"_{wish}"
    return wish


def counted(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column of the counts of each text; quadratic nowhere."""
    text, words, lines, grams, places = (free_name(docs, f"{name}_{x}") for x in ("text", "words", "lines", "grams", "places"))
    space = SPACES.replace("\t", "\\t").replace("\n", "\\n").replace("\u000b", "\\u000b").replace("\f", "\\u000c").replace("\r", "\\r")
    has_word = f"trim(BOTH '{space}' FROM x) <> ''"
    out = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn(words, F.filter(F.split(text, SPACE_RUN), lambda x: x != ""))
    out = out.withColumn(lines, F.expr(f"filter(split(`{text}`, '\\n'), x -> {has_word})"))
    # Bits that a place needs; the hash has the rest.
    bits = f"cast(ceil(log2(size(`{words}`) + 2)) as int)"
    window = f"xxhash64(get(`{words}`, i), get(`{words}`, i + 1), get(`{words}`, i + 2))"
    out = out.withColumn(
        grams,
        F.expr(f"if(size(`{words}`) < 3, cast(array() as array<bigint>), array_sort(transform(sequence(0, size(`{words}`) - 3), i -> shiftleft({window}, {bits}) | cast(i as bigint))))"),
    )
    # Neighbours with one hash; their places, in order.
    same = lambda a, b: f"coalesce(shiftright(get(`{grams}`, {a}), {bits}) = shiftright(get(`{grams}`, {b}), {bits}), false)"
    repeated = f"filter(sequence(0, size(`{grams}`) - 1), k -> {same('k', 'k - 1')} or {same('k', 'k + 1')})"
    out = out.withColumn(
        places,
        F.expr(f"if(size(`{grams}`) = 0, cast(array() as array<bigint>), array_sort(transform({repeated}, k -> get(`{grams}`, k) & (shiftleft(1L, {bits}) - 1))))"),
    )
    covered = f"if(size(`{places}`) = 0, 0L, aggregate(sequence(0, size(`{places}`) - 1), 0L, (done, j) -> done + least(3L, coalesce(get(`{places}`, j + 1) - get(`{places}`, j), 3L))))"
    values = {
        "n_words": f"cast(size(`{words}`) as long)",
        "word_chars": f"cast(length(array_join(`{words}`, '')) as long)",
        "n_symbols": f"cast(length(`{text}`) - length(translate(`{text}`, '#*$%&|<>', '')) as long)",
        "n_dup_lines": f"cast(size(`{lines}`) - size(array_distinct(`{lines}`)) as long)",
        "n_repeat_words": covered,
        "n_lines": f"cast(size(`{lines}`) as long)",
        "n_upper": f"cast(length(regexp_replace(`{text}`, '\\\\P{{Lu}}+', '')) as long)",
    }
    found = "named_struct(" + ", ".join(f"'{key}', {value}" for key, value in values.items()) + ")"
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.expr(found).alias(name))


def ratios(name: str) -> dict[str, Column]:
    """The ratios of a counts column; null where there is nothing to divide by."""
    out = {}
    for rule, (formula, _, _) in RULES.items():
        above, below = formula.split(" / ")
        out[rule] = F.try_divide(F.col(f"`{name}`.{above}").cast("double"), F.col(f"`{name}`.{below}").cast("double"))
    return out


def base_failed(name: str) -> Column:
    words = F.col(f"`{name}`.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"`{name}`.n_repeat_words") > MAX_REPEATED_PERCENT * words)


def sketches(measured: DataFrame, name: str) -> DataFrame:
    """lang, source, rule, bucket, rows: the mergeable sketches of documents that pass base."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    bucket = lambda value: F.when(value < SMALLEST, 0).otherwise(1 + F.floor(F.log(value / SMALLEST) / math.log(gamma))).cast("int")
    values = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*(bucket(value) for value in ratios(name).values())))
    rows = measured.where(~base_failed(name)).select(_group("lang", measured), _group("source", measured), F.explode(values).alias("rule", "bucket"))
    return rows.where("bucket is not null").groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("rows"))


def _group(column: str, frame: DataFrame) -> Column:
    known = column in frame.columns
    return (F.coalesce(F.col(column).cast("string"), F.lit("")) if known else F.lit("")).alias(column)


def fences(parts: DataFrame) -> DataFrame:
    """lang, source and, for each rule, its lower and upper fence."""
    merged = parts.groupingSets([["lang", "source", "rule", "bucket"], ["lang", "rule", "bucket"], ["rule", "bucket"]], "lang", "source", "rule", "bucket")
    merged = merged.agg(F.sum("rows").alias("rows"), F.grouping_id().alias("level"))
    own = Window.partitionBy("level", "lang", "source", "rule")
    ranked = merged.withColumn("upto", F.sum("rows").over(own.orderBy("bucket"))).withColumn("total", F.sum("rows").over(own))
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(gamma), F.col("bucket") - 0.5))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    quantiles = ranked.groupBy("level", "lang", "source", "rule").agg(at(0.25).alias("q25"), at(0.75).alias("q75"), F.max("total").alias("total"))
    least = F.element_at(F.create_map(*(F.lit(x) for rule, (_, _, spread) in RULES.items() for x in (rule, spread))), F.col("rule"))
    reach = REACH * F.greatest(F.col("q75") - F.col("q25"), least)
    sided = F.element_at(F.create_map(*(F.lit(x) for rule, (_, low, _) in RULES.items() for x in (rule, low))), F.col("rule"))
    limits = quantiles.select("level", "lang", "source", "rule", "total", F.when(sided, F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"))
    wide = limits.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *(F.max(F.when(F.col("rule") == rule, F.col(side))).alias(f"{rule}_{side}") for rule in RULES for side in ("low", "high"))
    )
    columns = [f"{rule}_{side}" for rule in RULES for side in ("low", "high")]
    pack = lambda alias: F.struct("total", *columns).alias(alias)
    wide = stored(wide, "fences")
    levels = [row.level for row in wide.select("level").distinct().orderBy("level").collect()]  # at most three
    if not levels:
        return wide.select("lang", "source", *columns)
    by_source = wide.where(F.col("level") == levels[0]).select("lang", "source", pack("a"))
    by_lang = wide.where(F.col("level") == levels[1]).select("lang", pack("b"))
    # The fences of all documents are one row of numbers.
    numbers = wide.where(F.col("level") == levels[2]).select("total", *columns).first()
    of_all = F.struct(*(F.lit(numbers[c]).cast("long" if c == "total" else "double").alias(c) for c in ("total", *columns)))
    joined = by_source.join(by_lang, "lang")
    chosen = F.when(F.col("a.total") >= ENOUGH, F.col("a")).when(F.col("b.total") >= ENOUGH, F.col("b")).otherwise(of_all)
    return joined.select("lang", "source", chosen.alias("limit")).select("lang", "source", *(f"limit.{c}" for c in columns))


def judged(docs: DataFrame, name: str = "quality") -> tuple[DataFrame, str]:
    """docs with a struct column of counts, base_failed and kept, and that column's name."""
    name = free_name(docs, name)
    measured = stored(counted(docs, name), "counts")
    limits = stored(fences(sketches(measured, name)), "fences")
    limits = limits.select(F.struct(*[c for c in limits.columns if c not in ("lang", "source")]).alias("_limit"), F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    key = [free_name(measured, f"{name}_{x}") for x in ("lang", "source", "limit")]
    limits = limits.toDF(key[2], key[0], key[1])
    joined = measured.join(limits, (_unnamed("lang", measured) == limits[key[0]]) & (_unnamed("source", measured) == limits[key[1]]), "left")
    inside = F.lit(True)
    for rule, value in ratios(name).items():
        low, high = (F.col(f"`{key[2]}`.{rule}_{side}") for side in ("low", "high"))
        inside &= F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))
    failed = base_failed(name)
    verdict = F.struct(*(F.col(f"`{name}`.{c}").alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & inside).alias("kept"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias(name)), name


def _unnamed(column: str, frame: DataFrame) -> Column:
    return F.coalesce(frame[column].cast("string"), F.lit("")) if column in frame.columns else F.lit("")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    rows, name = judged(docs)
    return rows.where(F.col(f"`{name}`.kept")).drop(name)
