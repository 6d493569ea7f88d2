"""Fill-in-the-middle forms of documents by a piece table.

A document is a list of descriptors over two buffers that never change: its text, in UTF-8, and the
three sentinels. Cutting splits descriptors at two places; an arrangement puts the three parts and the
sentinels before them in another order; nothing is copied until a descriptor's bytes are read, and hashes read
them one by one. An output is restored the other way round: its sentinels are found, its parts become
descriptors over the output, and the inverse order gives the text.

A text that holds a sentinel stays plain. In all others a sentinel of the output can only stand where
it was put: none can overlap with the end or the beginning of a part, as each begins with `<`, ends with
`>`, and has neither inside.

Places and forms come from a hash of the id (sha256 of `seed:id`), so they don't depend on order, partitions or
retries. Defined results: null and empty texts are plain with n = 0; a null id hashes like an id without digits;
rows with equal ids and texts give equal rows; an empty table gives no row; other columns are left out.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 1
FORMED_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: The sentinels, and the order of the parts in each form, each after its sentinel.
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = 0, 1, 2
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
READING_ORDER = (PREFIX, MIDDLE, SUFFIX)
_MARK = 3
_BATCH_BYTES = 64 << 20  # of output texts that leave a task together
TEXT, SENTINEL = 0, 1


class Piece(NamedTuple):
    """A run of bytes of one of the buffers."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over an immutable text and the sentinels."""

    def __init__(self, text: bytes, pieces: tuple[Piece, ...] | None = None):
        self.buffers = memoryview(text), memoryview(SENTINELS)
        self.pieces = (Piece(TEXT, 0, len(text)),) if pieces is None else pieces

    def _with(self, pieces) -> "PieceTable":
        other = object.__new__(PieceTable)
        other.buffers, other.pieces = self.buffers, tuple(pieces)
        return other

    def cut(self, *places: int) -> "PieceTable":
        """One descriptor for each run between these ascending byte places of the text, empty runs included."""
        left, rest = [], self.pieces[0]
        for place in places:
            left.append(Piece(rest.buffer, rest.start, place - rest.start))
            rest = Piece(rest.buffer, place, rest.start + rest.length - place)
        return self._with([*left, rest])

    def permuted(self, order) -> "PieceTable":
        return self._with(self.pieces[at] for at in order)

    def marked(self, order) -> "PieceTable":
        """A sentinel before each part: those of the parts in this order."""
        marks = (Piece(SENTINEL, part * _MARK, _MARK) for part in order)
        return self._with(piece for pair in zip(marks, self.pieces) for piece in pair)

    def unmarked(self) -> "PieceTable":
        return self._with(piece for piece in self.pieces if piece.buffer == TEXT)

    def runs(self) -> Iterator[memoryview]:
        return (self.buffers[p.buffer][p.start : p.start + p.length] for p in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for run in self.runs():
            digest.update(run)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.runs())


def arranged_table(text: bytes, form: str, first: int, second: int) -> PieceTable:
    """The text cut at two byte places and put in a form's order behind sentinels."""
    table = PieceTable(text)
    if form == "plain":
        return table
    order = ORDERS[form]
    parts = table.cut(first, second)  # prefix, middle, suffix
    return parts.permuted(READING_ORDER.index(part) for part in order).marked(order)


def restored_table(output: bytes, form: str) -> PieceTable:
    """The text of an output: its parts, found between sentinels, in the order they had."""
    table = PieceTable(output)
    if form == "plain":
        return table
    order, at, pieces = ORDERS[form], 0, []
    starts = []
    for part in order:
        at = output.index(SENTINELS[part * _MARK : (part + 1) * _MARK], at)
        starts.append(at)
        at += _MARK
    for part, start, end in zip(order, starts, [*starts[1:], len(output)]):
        pieces += [Piece(SENTINEL, part * _MARK, _MARK), Piece(TEXT, start + _MARK, end - start - _MARK)]
    return table._with(pieces).unmarked().permuted(order.index(part) for part in READING_ORDER)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the hash of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in range(0, 16, 4))


class Places:
    """Byte places of a text's code points."""

    def __init__(self, text: bytes):
        self.size = len(text)
        self.starts = None if text.isascii() else np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        self.count = self.size if self.starts is None else len(self.starts)

    def of(self, unit: int) -> int:
        if self.starts is None or unit == self.count:
            return unit if self.starts is None else self.size
        return int(self.starts[unit])


def planned(doc_id: int | None, text: bytes, seed: int, formed: int, suffix_first: int):
    """n, form, code points before the middle and within it, and the middle's byte places."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    places = Places(text)
    marks = (SENTINELS[at : at + _MARK] for at in range(0, len(SENTINELS), _MARK))
    if not text or h3 % 100 >= formed or any(mark in text for mark in marks):
        return places.count, "plain", None, None, 0, 0
    lo, hi = sorted((h1 % (places.count + 1), h2 % (places.count + 1)))
    return places.count, "spm" if h4 % 100 < suffix_first else "psm", lo, hi - lo, places.of(lo), places.of(hi)


def _batches(rows, kinds: dict, size_of):
    """Record batches of rows of bounded size."""
    schema, waiting, size = pa.schema(list(kinds.items())), [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*waiting), schema.types)], schema=schema)

    for row in rows:
        waiting.append(row)
        size += size_of(row) + 128
        if size > _BATCH_BYTES:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()


def transformed(docs: DataFrame, seed: int = SEED, formed: int = FORMED_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (bytes in UTF-8) and its hash, of every row."""

    def form(batches):
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary(), "output_sha256": pa.string()}

        def rows():
            for batch in batches:
                for doc_id, text in zip(*batch.columns):
                    doc_id, text = doc_id.as_py(), text.as_py()
                    n, name, before, within, first, second = planned(doc_id, text, seed, formed, suffix_first)
                    table = arranged_table(text, name, first, second)
                    yield doc_id, n, name, before, within, table.bytes(), table.sha256()

        yield from _batches(rows(), kinds, lambda row: len(row[5]))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(form, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string")


def restored(outputs: DataFrame) -> DataFrame:
    """The columns of outputs, with the text (bytes in UTF-8) rebuilt from output and form, and its hash."""
    names = outputs.columns

    def rebuild(batches):
        for batch in batches:
            texts, hashes, size, done = [], [], 0, 0
            for at, (output, form) in enumerate(zip(batch.column("output"), batch.column("form")), 1):
                table = restored_table(output.as_py(), form.as_py())
                texts.append(table.bytes())
                hashes.append(table.sha256())
                size += len(texts[-1])
                if size > _BATCH_BYTES or at == batch.num_rows:
                    own = batch.slice(done, at - done)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.binary()), pa.array(hashes, pa.string())], [*names, "text", "restored_sha256"])
                    texts, hashes, size, done = [], [], 0, at

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return outputs.mapInArrow(rebuild, f"{fields}, text binary, restored_sha256 string")
