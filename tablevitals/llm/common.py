"""What several operators share: scratch tables, words as hashes, and input columns."""

import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this subpackage travel with the job; executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["tablevitals.llm"])

#: Distinct words a worker remembers before it starts afresh.
CACHE_WORDS = 300_000

#: White space of the word rule [^\x20\x09-\x0D]+, for SQL's trim and split.
SPACES = " \t\n\u000b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only on a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='llm-')}"
    # A local cluster's executors share the machine's folders; those of another master need not.
    if str(base).startswith("file:") and spark.sparkContext.master.split("[")[0] not in ("local", "local-cluster"):
        raise ValueError(f"{base} is a folder of one machine; executors need one that they all share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once to scratch and read back: later jobs start from there."""
    path = scratch_path(frame.sparkSession, purpose)
    for paths in _temporary.get():
        paths.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_temporary: ContextVar[tuple[list[str], ...]] = ContextVar("temporary", default=())


@contextmanager
def temporary(spark: SparkSession):
    """Deletes, at the end of the block, what `stored` wrote within it; what reads it must be done by then."""
    paths: list[str] = []
    token = _temporary.set((*_temporary.get(), paths))
    try:
        yield
    finally:
        _temporary.reset(token)
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def found_in(spark: SparkSession, purpose: str, made: Callable[[], DataFrame]) -> DataFrame:
    """A small result, stored; what is stored on the way to it is deleted."""
    path = scratch_path(spark, purpose)
    for paths in _temporary.get():
        paths.append(path)
    with temporary(spark):
        rows = made()
        rows.write.parquet(path)
        schema = rows.schema
    return spark.read.schema(schema).parquet(path)


#: Bits of the bitmap below: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def row_keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs with a hash of some of its columns, nulls included, and that column's name."""
    name = "_row"
    while name in {column.lower() for column in docs.columns}:
        name = f"_{name}"
    return docs.withColumn(name, F.xxhash64(*columns)), name


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among those of keys: all that are, and few others while keys are few.

    Keys are marked by their hash in a bitmap of FILTER_BITS bits, which is broadcast. So a join that
    follows need not move the other rows. Null keys are never in.
    """
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    maps = keys.where(F.col(key).isNotNull()).select(slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
    placed = rows.where(F.col(key).isNotNull()).withColumn("_slot", slot())
    placed = placed.withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(maps), "_bucket")
    position = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return placed.where(F.getbit(byte, (position % 8).cast("int")) == 1).select(*rows.columns)


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def empty(frame: DataFrame) -> bool:
    return not frame.take(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased; bytes.split cuts at exactly the rule's white space."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values
