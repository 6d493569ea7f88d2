"""Token counts of the sections of documents, by character spans.

A whole document is encoded once. Byte-level tokens have known byte lengths, so the running sum
of lengths gives each token's byte span, and the count of characters begun gives its character
span; both are array operations. The tokens are then joined with the sections as intervals: two
binary searches a section. Sections are sorted, disjoint character ranges [start, end).

A token that lies across a boundary is allocated by a rule: "start" gives it to the section of
its first character, "end" to that of its last one, "share" splits it by characters. Tokens of
no section are left out, so with sections that cover a text, the counts of "start" and "end"
add up to the document's tokens, as do the shares.

Defined results: a null or empty text has no tokens, and its sections 0; a section may be empty
(0 tokens); a character cut in several tokens belongs to all of them; repeated rows are counted
each for itself; only the named columns are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "share")


class SpanEncoder:
    """Ids and character spans of a whole text under a byte-level vocabulary of ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first characters, ends (exclusive) of the tokens of a text."""
        raw = text.encode("utf-8", "replace")
        ids = np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int64)
        stops = np.cumsum(self.sizes[ids])
        starts = stops - self.sizes[ids]
        if len(raw) == len(text):
            return ids, starts, stops
        begun = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        return ids, begun[starts] - 1, begun[stops - 1]


def allocated(first: np.ndarray, stop: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of the sections [start, end) by the rule; first and stop are the tokens' spans."""
    if rule == "start":
        return np.searchsorted(first, end) - np.searchsorted(first, start)
    if rule == "end":
        return np.searchsorted(stop, end, "right") - np.searchsorted(stop, start, "right")
    # A token's share is its part of one token per character; the sum up to a character is linear in between.
    size = np.maximum(stop - first, 1)
    before = np.concatenate([[0.0], np.cumsum(np.ones(len(first)))])

    def up_to(place):
        done = np.searchsorted(stop, place, "right")
        part = np.zeros(len(place))
        inside = done < len(first)
        at = done[inside]
        part[inside] = np.clip(place[inside] - first[at], 0, None) / size[at]
        return before[done] + part

    return up_to(end) - up_to(start)


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First characters and ends of the lines of a text, each with its line feed."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32) == 10) + 1
    starts = np.concatenate([[0], feeds])
    return starts, np.append(feeds, len(text))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start", sections: Column | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, doc_tokens: one row for each section of each document.

    sections is an array of structs (section, start, end), sorted by start, disjoint; by default
    the lines of a text are its sections, numbered from 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    by_line = sections is None
    names = ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"]

    def count(batches):
        encoder = SpanEncoder(ranks_path, pattern)
        for batch in batches:
            out = [[] for _ in names]
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py() or ""
                _, first, stop = encoder.spans(text)
                if by_line:
                    start, end = lines(text)
                    number = np.arange(len(start))
                else:
                    given = batch.column(2)[row].values if batch.column(2)[row].is_valid else batch.column(2).flatten()[:0]
                    number, start, end = (given.field(name).to_numpy(zero_copy_only=False) for name in ("section", "start", "end"))
                doc_id = batch.column(0)[row].as_py()
                for column, values in zip(out[1:], (number, start, end, allocated(first, stop, start, end, rule), np.full(len(start), len(first)))):
                    column.append(values)
                out[0] += [doc_id] * len(start)
            joined = [np.concatenate(column) if column else np.empty(0) for column in out[1:]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            arrays = [pa.array(values.astype(kind.to_pandas_dtype()), kind) for values, kind in zip(joined, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *arrays], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *([] if sections is None else [sections.alias("sections")]))
    return source.mapInArrow(count, "doc_id long, section long, start long, end long, n_tokens double, doc_tokens long")
