"""Cost-balanced packing of documents into training sequences.

A document is its token ids followed by an end id. Documents longer than a sequence first give
whole sequences of their own; what is left of each is packed. Attention makes a piece cost
linear + quadratic: COST_LINEAR * n + COST_QUADRATIC * n^2. In descending cost, each piece goes
to the sequence with the lowest cost so far that still has room; when none has, it is cut over
those with room. The number of sequences is what the tokens need, so all but the last are full.
The last one is cut at powers of two, which need no padding: padding is 0.

Packing goes by blocks of at most BLOCK_TOKENS of left-over tokens that a task has met, so no
shuffle is needed, a task holds one block, and a lost executor costs its own tasks only. The
result depends on how the input is split, its rules don't. Ids are found by word: the tokenizer drops white space, so a text's ids
are those of its chunks between blanks and line feeds, and a chunk is encoded once.

Defined results: a null or empty text is the end id alone; rows with the same or a null id are
documents of their own; an empty table gives no row; only doc_id and text are read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablevitals.llm.common import CACHE_WORDS

SEQUENCE, END_ID = 2048, 1
BLOCK_TOKENS = 1_000_000
COST_LINEAR, COST_QUADRATIC = 1.0, 1.0 / 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Letters of the plain path, which the tokenizer keeps together and only lower-cases.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"
#: Marks of the plain path; a run of them is one piece for the tokenizer.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


class ChunkIds(dict):
    """Little-endian unsigned 32-bit ids of a chunk without white space, remembered while few.

    Most chunks are a run of letters between marks. For these the tokenizer's normalizer and
    splitter have nothing to do but lower-case and cut off the marks, so the letters go to its BPE
    model at once; all other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.raw = [number.to_bytes(4, "little") for number in range(self.tokenizer.get_vocab_size())]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        lower = {letter: as_bytes.pre_tokenize_str(letter)[0][0] for letter in _LETTERS}
        upper = {letter.upper(): mapped for letter, mapped in lower.items() if len(letter.upper()) == 1 and letter.upper().lower() == letter}
        self.byte_letters = str.maketrans(lower | upper)
        self.plain = frozenset(lower | upper)
        self.runs: dict[str, bytes] = {"": b""}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = chunk.strip(_MARKS)
        if not core or "<" in chunk or not self.plain.issuperset(core):
            ids = self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids) if chunk else b""
        else:
            start = chunk.find(core)
            ids = self._run(chunk[:start], chunk[:start]) + self._run(core, core.translate(self.byte_letters)) + self._run(chunk[start + len(core) :], chunk[start + len(core) :])
        if len(chunk) <= 256:
            self[chunk] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[number] for number in ids])

    def _run(self, run: str, mapped: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) >= CACHE_WORDS:
                self.runs = {"": b""}
            raw = self.raw
            found = b"".join([raw[token.id] for token in self.model.tokenize(mapped)])
            if len(run) <= 256:
                self.runs[run] = found
        return found

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


def cost(tokens: int) -> float:
    return COST_LINEAR * tokens + COST_QUADRATIC * tokens * tokens


def assigned(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for pieces of at most a sequence; see the module.

    Sequences 0, 1, ... have `size` tokens, but for the last, which has what is left.
    """
    total = sum(lengths)
    count = -(-total // size)
    room = [size] * count
    if count:
        room[-1] = total - size * (count - 1)
    room, spent, out = np.array(room, dtype=np.int64), np.zeros(count), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left, start = lengths[piece], 0
        fits = np.where(room >= left, spent, np.inf)
        cheapest = int(fits.argmin())
        # If none has room for all of it: cut it over those with room, cheapest first.
        over = [cheapest] if fits[cheapest] < np.inf else [s for s in np.argsort(spent, kind="stable") if room[s]]
        for s in over:
            take = min(int(room[s]), left)
            out.append((piece, start, take, int(s)))
            room[s] -= take
            spent[s] += cost(take)
            start, left = start + take, left - take
            if not left:
                break
    return out


def powers(tokens: int) -> list[int]:
    """The powers of two that add up to a number, largest first."""
    return [1 << bit for bit in range(tokens.bit_length() - 1, -1, -1) if tokens >> bit & 1]


def packed(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The pieces of every row of docs, and where they lie; size is a power of two."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches):
        chunks = ChunkIds(tokenizer)
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows: list[tuple] = []
        rest: list[tuple] = []  # doc_id, start, ids, tokens of the document
        waiting = 0

        def flush():
            nonlocal next_id, rest, waiting
            placed = [[] for _ in range(-(-waiting // size))]
            for piece, start, length, sequence in assigned([len(ids) // 4 for _, _, ids, _ in rest], size):
                placed[sequence].append((piece, start, length))
            for sequence, pieces in enumerate(placed):
                held = waiting - size * (len(placed) - 1) if sequence == len(placed) - 1 else size
                room = powers(held)
                number, offset = 0, 0
                for piece, start, length in pieces:
                    doc_id, at, ids, tokens = rest[piece]
                    while length:
                        if offset == room[number]:
                            number, offset = number + 1, 0
                        take = min(length, room[number] - offset)
                        rows.append((doc_id, at + start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), tokens, next_id + number, offset))
                        start, length, offset = start + take, length - take, offset + take
                next_id += len(room)
            rest, waiting = [], 0

        def batch_of_rows():
            nonlocal rows
            columns = list(zip(*rows)) or [[]] * 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = chunks.of(text.as_py()) + end
                doc_id, tokens, view = doc_id.as_py(), len(ids) // 4, memoryview(ids)
                whole = tokens - tokens % size
                for start in range(0, whole, size):
                    rows.append((doc_id, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), tokens, next_id, 0))
                    next_id += 1
                if whole < tokens:
                    if waiting + tokens - whole > block_tokens:
                        flush()
                    rest.append((doc_id, whole, bytes(view[4 * whole :]), tokens))
                    waiting += tokens - whole
                if len(rows) >= 20_000:
                    yield batch_of_rows()
        flush()
        yield batch_of_rows()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(pack, SCHEMA)
