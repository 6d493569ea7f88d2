"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters are lexicon entries (a whole word is present) and patterns (a word starts so); each votes
"toxic" where it matches and abstains elsewhere, and one more votes "clean" where none matches.
The entries are mined from all labelled training rows by a likelihood ratio that stands out among all
that were tried; every entry that does is a voter. Entries that match the same labelled rows are one voter,
which votes where any of them matches; a sum of row hashes, kept with the counts, tells which these are.

The label model sees votes only, no labels. Voters that nearly always vote together (a correlation
above SAME) would count one finding many times, so each such group is one source, whose vote is any
of its members'. Rates of vote of each source, given the hidden class, and the class's share are
estimated by expectation maximisation. The posterior of each row is its soft label, and a logistic
regression on the voters is fitted to these.

What is bounded: label model and classifier are fitted on a sample of at most about TRAIN_ROWS labelled rows,
chosen by a hash of the id, and on the MOST_VOTERS strongest voters that have LEAST_SEEN votes in it. All other
voters keep the log-odds of "toxic" among all labelled rows they match, and a row's score is the larger of
the classifier's and that of the strongest such voter. The sample's ids and the model are all that is broadcast by hint.
Mining joins all labels with the texts, and counts in tasks, with a partial sum whenever MOST_COUNTED entries
are held. Scores are one pass over whole texts without a shuffle.

Defined results: null, empty and wordless texts have no votes and get the score of none; a null id
counts as remainder 0, so nothing is learnt from it; with no toxic training row all scores are the
share of toxic rows, which is 0; repeated rows get equal scores; only doc_id and text are read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import CACHE_WORDS, id_remainder, maybe_in, stored, temporary

TRAIN_ROWS = 20_000
MOST_VOTERS = 300
LEAST_SEEN = 20
MOST_COUNTED = 250_000  # entries, and words, that a task remembers while it counts
MARK_BITS = 62  # of the row hashes whose sums tell entries that match the same rows
PREFIXES = range(3, 9)  # lengths of word starts tried
SAME = 0.8
LEAST_LOG_ODDS = 2.5


def plain(word: str) -> str:
    """A word without what stands around its letters."""
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not word[end - 1].isalpha():
        end -= 1
    return word[start:end]


def candidates(word: str) -> list[str]:
    """Entries a word could match: itself as "=word", its starts as "^start"."""
    word = plain(word)
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if n <= len(word))] if word else []


class Matches(dict):
    """The voters that a word matches, as a tuple of numbers; remembered while few."""

    def __init__(self, voters: list[list[str]]):
        super().__init__()
        self.numbers = {entry: number for number, entries in enumerate(voters) for entry in entries}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = tuple(self.numbers[entry] for entry in candidates(word) if entry in self.numbers)
        if len(word) <= 256:
            self[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for found in map(self.__getitem__, set((text or "").lower().split())):
            out.update(found)
        return sorted(out)


def known_labels(labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id and toxic of every labelled row that is not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return known.where(~held_out)


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text, toxic and mark (a hash of MARK_BITS bits) of every labelled row."""
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - MARK_BITS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Texts without a label stay where they are. Labels grow with the documents, so they are never sent to all tasks.
    return maybe_in(texts, "doc_id", known).join(known.hint("merge"), "doc_id").select("text", "toxic", mark.alias("mark"))


def training_sample(docs: DataFrame, known: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The text of about `most` labelled rows."""
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about `most` rows of two numbers: a proven bound.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text")


def mined(rows: DataFrame) -> tuple[list[list[str]], np.ndarray]:
    """The entries that stand out in toxic texts, strongest first, those that match the same rows together; and the log-odds of each."""
    half = MARK_BITS // 2

    def count(batches):
        seen: dict[str, list[int]] = {}
        known: dict[str, list[str]] = {}

        def partial():
            marks = [x[2] % (1 << MARK_BITS) for x in seen.values()]
            columns = [[x[0] for x in seen.values()], [x[1] for x in seen.values()], [m >> half for m in marks], [m % (1 << half) for m in marks]]
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(column, pa.int64()) for column in columns)], ["entry", "clean", "toxic", "high", "low"])

        for batch in batches:
            for text, toxic, mark in zip(batch.column(0), batch.column(1), batch.column(2)):
                side, mark, own = 1 if toxic.as_py() else 0, mark.as_py(), {""}
                for word in set((text.as_py() or "").lower().split()):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= MOST_COUNTED:
                            known.clear()
                        found = known[word] = candidates(word)
                    own.update(found)
                for entry in own:
                    counts = seen.get(entry)
                    if counts is None:
                        counts = seen[entry] = [0, 0, 0]
                    counts[side] += 1
                    counts[2] += mark
                if len(seen) >= MOST_COUNTED:
                    yield partial()
                    seen.clear()
        yield partial()

    sums = [F.sum(column).alias(column) for column in ("clean", "toxic", "high", "low")]
    counts = rows.mapInArrow(count, "entry string, clean long, toxic long, high long, low long").groupBy("entry").agg(*sums)
    counts = stored(counts, "entries")
    all_rows = counts.where("entry = ''").first()
    clean, toxic = (all_rows["clean"], all_rows["toxic"]) if all_rows else (0, 0)
    if not toxic:
        return [], np.empty(0)
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda seen, total, rate: seen * F.log(F.greatest(seen, F.lit(1e-9)) / (rate * total))
    rate = (t + c) / (toxic + clean)
    ratio = 2 * (part(t, toxic, rate) + part(c, clean, rate) + part(toxic - t, toxic, 1 - rate) + part(clean - c, clean, 1 - rate))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    tried = counts.count()
    bar = 2 * math.log(max(tried, 1)) + 4
    # Modulo 2^MARK_BITS, whatever the partial sums were.
    mark = F.pmod(F.pmod("high", F.lit(1 << half)) * (1 << half) + F.col("low"), F.lit(1 << MARK_BITS))
    passed = counts.where("entry <> '' and toxic > 1").select("entry", "clean", "toxic", mark.alias("mark"), ratio.alias("ratio"), odds.alias("odds")).where((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("ratio") >= bar))
    same: dict[tuple, list[str]] = {}
    for row in passed.orderBy(F.desc("ratio"), "entry").collect():
        same.setdefault((row.clean, row.toxic, row.mark), []).append(row.entry)
    return list(same.values()), np.array([math.log((key[1] + 0.5) / (key[0] + 0.5)) for key in same])


def votes(sample: DataFrame, voters: list[list[str]]) -> list[list[int]]:
    """The voters of each row of the sample; the size is bounded by the sample's."""

    def vote(batches):
        matches = Matches(voters)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matches.of(text.as_py()) for text in batch.column(0)], pa.list_(pa.int32()))], ["own"])

    return [row.own for row in sample.mapInArrow(vote, "own array<int>").collect()]


def sources_of(votes_of: np.ndarray) -> list[list[int]]:
    """Groups of voters that vote alike; members of a group correlate with its first above SAME."""
    left, groups = list(range(votes_of.shape[1])), []
    centred = votes_of - votes_of.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-12
    while left:
        near = (centred[:, left].T @ centred[:, left[0]]) / (norm[left] * norm[left[0]])
        group = [voter for voter, r in zip(left, near) if r >= SAME or voter == left[0]]
        groups.append(group)
        left = [voter for voter in left if voter not in set(group)]
    return groups


def posteriors(votes_of: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(toxic) of each row under the generative model of its votes."""
    found = np.column_stack([votes_of[:, group].max(axis=1) for group in sources_of(votes_of)])
    # Start from the count of sources that agree; one is doubtful, none is clean.
    agree = found.sum(axis=1)
    belief = np.clip(1 - 0.4**agree, 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip(belief.mean(), 1e-3, 0.5)
        on = (belief @ found + 0.5) / (belief.sum() + 1)
        off = ((1 - belief) @ found + 0.05) / ((1 - belief).sum() + 1)
        on = np.maximum(on, 2 * off)  # a voter for "toxic" is right more often than not by chance
        on = np.clip(on, 1e-5, 1 - 1e-5)
        logit = math.log(share / (1 - share)) + found @ np.log(on / off) + (1 - found) @ np.log((1 - on) / (1 - off))
        belief = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return belief


def fitted(votes_of: np.ndarray, target: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.column_stack([votes_of, np.ones(len(votes_of))])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-3
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (target - p) - keep * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def model(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Voters, the classifier's weights (the last is the intercept), and the log-odds of voters it doesn't know (else -inf)."""
    with temporary(docs.sparkSession):
        # Stored, so that Spark knows their size when it chooses between broadcasting labels and moving texts.
        return _learnt(docs, stored(known_labels(labels, held_out), "labels"))


def _learnt(docs: DataFrame, known: DataFrame) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    voters, log_odds = mined(training_rows(docs, known))
    weights = np.zeros(len(voters) + 1)
    weights[-1] = -20.0
    if not voters:
        return voters, weights, log_odds
    lists = votes(training_sample(docs, known), voters)
    seen = np.bincount(np.array([voter for own in lists for voter in own], dtype=np.int64), minlength=len(voters))
    chosen = np.flatnonzero(seen >= LEAST_SEEN)[:MOST_VOTERS]
    if len(chosen):
        place = {voter: column for column, voter in enumerate(chosen.tolist())}
        # Rows with votes of other voters only would pass for rows without a vote.
        lists = [[place[voter] for voter in own if voter in place] for own in lists if not own or any(voter in place for voter in own)]
        votes_of = np.zeros((len(lists), len(chosen)), dtype=np.float64)
        for row, own in enumerate(lists):
            votes_of[row, own] = 1
        weights[[*chosen, -1]] = fitted(votes_of, posteriors(votes_of))
        log_odds[chosen] = -np.inf
    return voters, weights, log_odds


def scored(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    held_out = id_remainder("doc_id", 5) == 0 if held_out is None else held_out
    rows, name = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, held_out)
    return rows.select("doc_id", held_out.alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[DataFrame, str]:
    """docs with a column for the score, and that column's name."""
    voters, weights, log_odds = model(docs, labels, held_out)
    name = "score"
    while name.lower() in {column.lower() for column in docs.columns}:
        name = f"_{name}"

    matches = Matches(voters)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            own = [matches.of(text) for text in texts]
            logits = np.array([max(weights[-1] + weights[x].sum(), log_odds[x].max()) if x else weights[-1] for x in own], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col("text"))), name


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with the columns they came with."""
    rows, name = with_score(docs, labels, id_remainder("doc_id", 5) == 0)
    return rows.where(F.col(name) < 0.5).drop(name)
