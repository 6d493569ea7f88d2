"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors are compared when their labels are equal, and linked when their cosine is `LIMIT` or more.

* `fitted` learns a rotation of the principal directions of a bounded sample (SAMPLE rows) such that the
  signs of its coordinates lose least: signs and rotation are fitted in turns. A code has 64 bits; vectors of
  fewer dimensions get several rotations. On the same sample it is found out how codes of vectors at exactly the
  limit differ: how many of a code's 8 bytes may be asked to be equal (`same`), and how many bits may
  differ (`radius`), so that a share RECALL of such pairs is a candidate.
* `candidates` looks codes up in one table for each choice of `same` bytes: codes that agree in these
  bytes meet, and go on if they differ in at most `radius` bits. Where more than HOT codes meet, as in a
  large group of near copies, their blocks are paired instead, which are few; so codes make no pairs there.
* Candidates are compared in cells of two blocks of vectors; a block is what shares a code's first bits, cut
  at CELL vectors. A cell has the vectors of its blocks once, whatever number of pairs it compares, and
  returns a count of links for each vector and its smallest companion, never the pairs.

Equal vectors of a label form a class, which is one node with a number of copies, so a vector that a third of all
rows share costs as much as any other. Vectors of other lengths are never compared; shorter ones are filled up
with zeros for their codes only. No candidate is dropped, and the size of the input decides on nothing but the
width of blocks. What is not a candidate is not linked: recall is measured in the tests.

Defined results: rows without a label, and null, empty or zero vectors and those with a null or non-finite
component have n_links 0, are their own component and are kept; rows with the same id, label and vector
are one vector; an id on several vectors stands for each of them; a null id links like any other, and a
component of null ids only has none, its rows being kept; an empty table gives no row; other columns are not read.
"""

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import stored
from tablevitals.llm.minhash import components

LIMIT = 0.98
RECALL = 0.97  # of pairs at exactly the limit
SAMPLE, SAMPLE_VALUES = 10_000, 4_000_000  # rows that the rotation is fitted on, and their components at most
BITS, BYTES, ROUNDS = 64, 8, 50
CELL = 128
HOT = 64  # codes in a place of a table beyond which blocks are paired, not codes
_TRIALS = 4_000


class Quantiser(NamedTuple):
    """Codes are the signs of (unit vector - mean) @ rotation."""

    mean: np.ndarray
    rotation: np.ndarray
    same: int
    radius: int


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def quantised(units: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The code of each row as a 64-bit number."""
    filled = np.pad(units, ((0, 0), (0, len(mean) - units.shape[1])))
    return np.packbits((filled - mean) @ rotation >= 0, axis=1).view(">u8").astype(np.uint64).ravel()


def rotated(sample: np.ndarray, centre: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean (or 0), and BITS directions: principal ones, rotated so that signs are balanced and close."""
    mean = sample.mean(axis=0) if centre else np.zeros(sample.shape[1])
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    principal = directions[:, ::-1][:, :BITS]
    reduced, random, found, width = centred @ principal, np.random.default_rng(seed), [], 0
    while width < BITS:
        rotation = np.linalg.qr(random.standard_normal((principal.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            signs = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ reduced)
            rotation = (left @ right).T
        found.append(principal @ rotation)
        width += principal.shape[1]
    return mean, np.concatenate(found, axis=1)[:, :BITS]


def differing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of two arrays of codes are equal, and how many bits differ."""
    apart = np.bitwise_xor(a, b)
    equal = BYTES - np.count_nonzero(np.ascontiguousarray(apart)[..., None].view(np.uint8), axis=-1)
    return equal, np.bitwise_count(apart)


def measured(sample: np.ndarray, mean: np.ndarray, rotation: np.ndarray, limit: float, recall: float, seed: int) -> Quantiser:
    """How far apart the codes of vectors at exactly the limit are: equal bytes to ask for (0: too few), and bits."""
    random = np.random.default_rng(seed)
    at, other = (sample[random.integers(len(sample), size=_TRIALS)] for _ in range(2))
    worst, radius = [], 0
    # Away from a vector in any direction, and in those in which the data differ.
    for direction in (random.standard_normal(at.shape), other - at):
        across = direction - (direction * at).sum(axis=1, keepdims=True) * at
        length = np.linalg.norm(across, axis=1)
        real = length > 1e-9
        if not real.any():
            continue
        moved = limit * at[real] + np.sqrt(1 - limit**2) * across[real] / length[real, None]
        equal, bits = differing(quantised(at[real], mean, rotation), quantised(moved, mean, rotation))
        worst.append([(equal >= same).mean() for same in range(1, BYTES + 1)])
        radius = max(radius, int(np.quantile(bits, 0.999)))
    shares = np.min(worst, axis=0) if worst else np.ones(BYTES)
    # More than half of the bytes would make as many tables as fewer of them do.
    same = max((n for n in range(1, BYTES // 2 + 1) if shares[n - 1] >= recall), default=0)
    return Quantiser(mean, rotation, same, radius)


def fitted(sample: np.ndarray, limit: float = LIMIT, recall: float = RECALL, seed: int = 7) -> Quantiser:
    """Learns the rotation from rows of length 1.

    Around their mean, as a rule. Where all vectors lie so close together that this parts near ones,
    signs are taken around 0.
    """
    models = [measured(sample, *rotated(sample, centre, seed), limit, recall, seed) for centre in (True, False)]
    best = max(models, key=lambda model: model.same)  # the first of equals
    return best._replace(same=max(best.same, 1))


def comparable() -> str:
    """Whether a row's vector can be compared at all."""
    finite = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return f"label IS NOT NULL AND vector IS NOT NULL AND {finite} AND exists(vector, x -> x <> 0)"


def classes_of(rows: DataFrame) -> DataFrame:
    """node, label, dims, vector, first_id and copies of each distinct comparable vector of a label."""
    once = rows.where(F.expr(comparable())).distinct()
    classes = once.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    return classes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("dims"), "vector", "first_id", "copies")


def _matrix(column, dims: int | None = None) -> np.ndarray:
    """A list column as rows of doubles, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    width = dims or int(sizes.max())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    rows = np.zeros((len(sizes), width))
    rows[np.arange(width) < sizes[:, None]] = flat
    return rows


def sampled(classes: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """About so many vectors, chosen by their hash, as rows of length 1 of the greatest length of all."""
    count, dims = classes.agg(F.count("*"), F.max("dims")).first()
    if not count:
        return np.empty((0, 1))
    rows = max(1, min(rows, SAMPLE_VALUES // dims))
    share = min(1.0, rows / count)
    chosen = classes.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * rows)
    table = chosen.select("vector").toArrow()
    return unit(_matrix(table.column("vector"), dims)) if len(table) else np.eye(dims)


def coded(classes: DataFrame, model: Quantiser) -> DataFrame:
    """The columns of classes, and the code of each vector."""
    names, mean, rotation = classes.columns, model.mean, model.rotation

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                codes = quantised(unit(_matrix(batch.column("vector"), len(mean))), mean, rotation).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], [*names, "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(code, f"{fields}, code long")


def byte_masks(same: int) -> list[int]:
    """One mask for each choice of so many bytes, as signed numbers."""
    masks = (sum(0xFF << (8 * byte) for byte in chosen) for chosen in combinations(range(BYTES), same))
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def candidates(coded_rows: DataFrame, model: Quantiser, width: int) -> DataFrame:
    """Distinct label, dims, one, other: prefixes of codes between which, or within which, there is a candidate pair."""
    prefix = F.shiftrightunsigned("code", BITS - width)
    several = coded_rows.groupBy("label", "dims", "code").agg(F.count("*").alias("n")).where("n > 1").select("label", "dims", prefix.alias("one"), prefix.alias("other"))
    codes = coded_rows.select("label", "dims", "code").distinct()
    keyed = codes.select("label", "dims", "code", F.explode(F.lit(byte_masks(model.same))).alias("mask"))
    keyed = keyed.select("label", "dims", "code", F.xxhash64("mask", F.col("code").bitwiseAND(F.col("mask"))).alias("key"))
    keyed = keyed.withColumn("prefix", F.shiftrightunsigned("code", BITS - width))
    key = ["label", "dims", "key"]
    hot = keyed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*key)

    def met(rows: DataFrame, column: str) -> DataFrame:
        one, other = (rows.select(*key, *(F.col(c).alias(f"{c}_{side}") for c in dict.fromkeys((column, "prefix")))) for side in "ab")
        return one.join(other, key)

    near = met(keyed.join(hot, key, "left_anti"), "code").where((F.col("code_a") < F.col("code_b")) & (F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= model.radius))
    close = met(keyed.join(hot, key, "left_semi").select(*key, "prefix").distinct(), "prefix")
    columns = ("label", "dims", F.least("prefix_a", "prefix_b").alias("one"), F.greatest("prefix_a", "prefix_b").alias("other"))
    return near.select(*columns).union(close.select(*columns)).union(several).distinct()


def compared(coded_rows: DataFrame, pairs: DataFrame, model: Quantiser, width: int, limit: float = LIMIT, cell: int = CELL) -> DataFrame:
    """node, links (copies of the vectors linked with it) and least (a node it is connected with), by cell."""
    same, radius = model.same, model.radius
    prefixed = coded_rows.withColumn("prefix", F.shiftrightunsigned("code", BITS - width))
    sizes = stored(prefixed.groupBy("label", "dims", "prefix").agg(F.ceil(F.count("*") / cell).cast("int").alias("chunks")), "blocks")
    block = ["label", "dims", "prefix"]
    members = prefixed.join(sizes, block).select(*block, F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node", "code", "copies", "vector")

    def chunks_of(rows: DataFrame, side: str, chunk: str) -> DataFrame:
        own = sizes.select("label", "dims", F.col("prefix").alias(side), F.explode(F.expr("sequence(0, chunks - 1)")).alias(chunk))
        return rows.join(own, ["label", "dims", side])

    cells = chunks_of(chunks_of(pairs, "one", "i"), "other", "j").where("one < other OR i <= j")
    key = ["label", "dims", "one", "i", "other", "j"]

    def side_of(rows: DataFrame, prefix: str, chunk: str, second: bool) -> DataFrame:
        own = members.withColumnRenamed("prefix", prefix).withColumnRenamed("chunk", chunk)
        return rows.join(own, ["label", "dims", prefix, chunk]).select(*key, F.lit(second).alias("second"), "node", "code", "copies", "vector")

    rows = side_of(cells, "one", "i", False).union(side_of(cells.where("one <> other OR i <> j"), "other", "j", True))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        second = table.column("second").to_numpy(zero_copy_only=False)
        node, code, copies = (table.column(name).to_numpy() for name in ("node", "code", "copies"))
        units = unit(_matrix(table.column("vector")))
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(node)),) * 2
        equal, bits = differing(code[left].view(np.uint64)[:, None], code[right].view(np.uint64)[None, :])
        linked = (equal >= same) & (bits <= radius) & (units[left] @ units[right].T >= limit)
        if not second.any():
            np.fill_diagonal(linked, False)
        links, least = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        links[left] = linked @ copies[right]
        if second.any():
            links[right] = linked.T @ copies[left]
        while True:  # the least companion reached, over ever longer ways
            before, far = least.copy(), len(node)
            least[left] = np.minimum(least[left], np.where(linked, least[right][None, :], far).min(axis=1, initial=far))
            least[right] = np.minimum(least[right], np.where(linked, least[left][:, None], far).min(axis=0, initial=far))
            if (least == before).all():
                break
        has = links > 0
        return pa.table({"node": node[has], "links": links[has], "least": node[least[has]]})

    return rows.groupBy(*key).applyInArrow(compare, "node long, links long, least long")


def linked(vectors: DataFrame, limit: float = LIMIT, recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
    classes = stored(classes_of(rows), "vectors")
    chosen = sampled(classes, sample)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(chosen):
        return alone
    model = fitted(chosen, limit, recall)
    with_codes = stored(coded(classes, model), "codes")
    # About as many blocks as vectors, eightfold: a few vectors share one where they are spread evenly.
    width = min(32, max(4, with_codes.count().bit_length() - 3))
    pairs = stored(candidates(with_codes, model, width), "candidates")
    cells = stored(compared(with_codes, pairs, model, width, limit, cell), "links")
    links = cells.groupBy("node").agg(F.sum("links").alias("links"))
    labels = stored(components(cells.select(F.col("node").alias("a"), F.col("least").alias("b"))), "labels")
    own = classes.select("node", "label", "vector", "first_id", "copies").join(links, "node", "left").join(labels.withColumnRenamed("label", "root"), "node", "left")
    own = stored(own.select("label", "vector", "first_id", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "found")
    first = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = own.join(first, "root").select("label", "vector", "n_links", "component_id", F.lit(True).alias("compared"))
    result = rows.join(found, ["label", "vector"], "left")
    component = F.when(F.col("compared"), F.col("component_id")).otherwise(F.col("vec_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
