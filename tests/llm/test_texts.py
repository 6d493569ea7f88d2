"""Quality rules, toxicity, licences, token counts and language-model scores."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tablevitals.llm import attribution, licenses, quality, scoring, toxicity
from tablevitals.llm.common import tokenizer_path, tokenizer_pattern

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "a", "a b", "one two three one two three", "x y z\nx y z\n\nX\n", "#$% <a|b> & *", "É ß  \x0b\x0c q", "w " * 3000]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected_counts(text):
    own = word_list(text)
    lines = [line for line in (text or "").split("\n") if word_list(line)]
    seen = Counter(zip(own, own[1:], own[2:]))
    covered = {p for i in range(len(own) - 2) if seen[tuple(own[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = docs.union(spark.createDataFrame([(-i, t, None if i % 2 else "en", "src0") for i, t in enumerate(ODD, 1)], docs.schema))
    rows = rows.withColumn("quality", F.lit("mine")).withColumn("N_WORDS", F.lit(7))
    judged, name = quality.judged(rows)
    found = judged.select("text", "N_WORDS", F.col(name).alias("v")).collect()
    assert len(found) == rows.count()
    for r in found:
        counts = expected_counts(r.text)
        assert tuple(r.v)[:5] == counts
        assert r.v.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.N_WORDS == 7 and not (r.v.kept and r.v.base_failed)
    kept = quality.kept(rows)
    assert kept.columns == rows.columns
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    by_label = {(r["quality"], r["v"]): r["n"] for r in judged.select("doc_id", F.col(f"{name}.kept").alias("v"), F.col(f"{name}.base_failed").alias("b")).where("not b").join(marks, "doc_id").groupBy("quality", "v").agg(F.count("*").alias("n")).collect()}
    assert by_label.get((1, False), 0) == 0 and by_label.get((0, True), 0) == 0
    empty = quality.judged(rows.limit(0))[0]
    assert empty.count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    extra = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)] + [(None, "idiot moron scum trash")], "doc_id long, text string")
    scored = toxicity.scored(docs.select("doc_id", "text").union(extra), labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = sum(r.predicted == r.toxic for r in rows)
    found = [r for r in rows if r.toxic and r.predicted]
    assert right / len(rows) > 0.96 and len(found) / sum(r.toxic for r in rows) > 0.75
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.02 * len(rows)
    odd = scored.where("doc_id < 0 or doc_id is null").collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in odd)
    assert [r.predicted for r in odd if r.doc_id is None] == [1]
    none = toxicity.scored(docs.limit(5), labels.where("toxic = 0"))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def toxic_rows(spark, words_of, n):
    """Rows 1 to n with a toxic word, from words_of(id), or none; and labels."""
    rows = [(i, f"some plain w{i % 997} words{' ' + own if (own := words_of(i)) else ''}", int(own is not None)) for i in range(1, n + 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def test_toxic_words_that_are_rare_in_a_sample(spark):
    n = 4 * toxicity.TRAIN_ROWS
    rare = [i for i in range(1, n + 1) if crc32(str(i).encode()) % 5 and i % 50][:: n // 16][:12]
    docs, labels = toxic_rows(spark, lambda i: "vilest" if i in rare else "scum" if i % 50 == 0 else None, n)
    new = spark.createDataFrame([(-1, "the vilest of all"), (-2, "the scum of all"), (-3, "the rest of all")], docs.schema)
    found = {r.doc_id: r.predicted for r in toxicity.scored(docs.union(new), labels).where("doc_id < 0").collect()}
    assert found == {-1: 1, -2: 1, -3: 0}


def test_toxic_words_beyond_the_strongest(spark):
    bad = lambda k: f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghijklmnopqrst'[k // 26]}zoxq"
    docs, labels = toxic_rows(spark, lambda i: f"{bad(i // 20 % 320)} {bad((i // 20 + i // 6400 + 1) % 320)}" if i % 20 == 0 else None, 16 * 20 * 320)
    new = spark.createDataFrame([(-k - 1, f"plain words {bad(k)}") for k in range(320)] + [(-1000, "plain words")], docs.schema)
    found = {r.doc_id: r.predicted for r in toxicity.scored(docs.union(new), labels).where("doc_id < 0").collect()}
    assert found == {-1000: 0} | {-k - 1: 1 for k in range(320)}


def test_partial_counts_give_the_same_voters(spark, monkeypatch):
    docs, labels = toxic_rows(spark, lambda i: f"scum vile{'abcdefghi'[i % 9]}" if i % 20 == 0 else None, 3000)
    rows = toxicity.training_rows(docs, toxicity.known_labels(labels, F.lit(False)))
    voters, log_odds = toxicity.mined(rows)
    assert any("=scum" in own for own in voters) and all(any(f"=vile{k}" in own for own in voters) for k in "abcdefghi")
    monkeypatch.setattr(toxicity, "MOST_COUNTED", 10)
    again, log_odds_again = toxicity.mined(rows)
    assert again == voters and log_odds_again.tolist() == log_odds.tolist()


def test_licence_notices(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = ["Released under the MIT License.", "licensed under the apache license, version 2.0", "SPDX-License-Identifier: MPL-2.0",
             "This work is licensed under CC BY-SA 4.0.", "The license of the car is valid in the state", "version 2.0 of the text", "GNU", ""]
    rows = docs.union(spark.createDataFrame([(-i, "Some first line.\n" + t) for i, t in enumerate(lines, 1)] + [(-99, None), (None, lines[0])], docs.schema))
    found = licenses.scanned(rows).collect()
    mine = {r.doc_id: (r.family, r.paragraph, r.confirmed) for r in found if r.doc_id is None or r.doc_id < 0}
    assert mine == {-1: ("mit", 1, True), -2: ("apache", 1, True), -3: ("mpl", 1, True), -4: ("cc-by-sa", 1, True), None: ("mit", 0, True)}
    name = {"gpl": "GNU General Public", "mit": "MIT License", "apache": "Apache License", "cc-by-nc": "BY-NC"}
    expected = {(r.doc_id, at, family) for r in docs.collect() for at, line in enumerate(r.text.split("\n")) for family, words in name.items() if words in line}
    assert {(r.doc_id, r.paragraph, r.family) for r in found if r.doc_id is not None and r.doc_id >= 0} == expected
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_all_documents_calibrate_unknown(spark, monkeypatch):
    monkeypatch.setattr(licenses, "NEGATIVES", 4)
    # One line in twenty is the bare name of a licence, which a few documents would not show.
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 20 = 7, concat('gplv3 x', id), concat('the story of day ', id)) as text")
    vocabulary, weights, intercepts, believed = licenses.trained(docs)
    names = licenses.paragraphs(docs).where("doc_id % 20 = 7 and pmod(xxhash64(words), 4) = 0").select(F.expr(vocabulary.found()).alias("found"))
    reached = [max(row.p[1:]) for row in names.select(F.expr(licenses.probabilities(weights, intercepts)).alias("p")).collect()]
    assert reached and believed == pytest.approx(max(0.5, *reached), abs=2e-6)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts_of_lines(spark, rule):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [*ODD, "é\n\n\nß日本語 \U0001f600x\n", "<|endoftext|>\n\n  two\n three "]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("section", F.lit(1))
    found = {}
    for r in attribution.token_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), rule).collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc_id, text in enumerate(texts):
        text, spans = text or "", whole.encode(text or "", add_special_tokens=False).offsets
        at, expected = 0, []
        for line in text.split("\n"):
            start, end = at, min(at + len(line) + 1, len(text))
            if rule == "start":
                n = sum(start <= a < end for a, _ in spans)
            elif rule == "end":
                n = sum(start < b <= end for _, b in spans)
            else:
                n = sum(max(0, min(b, end) - max(a, start)) / max(b - a, 1) for a, b in spans)
            expected.append((start, end, pytest.approx(n), len(spans)))
            at = end
        rows = sorted(found[doc_id], key=lambda r: r.section)
        assert [(r.start, r.end, r.n_tokens, r.doc_tokens) for r in rows] == expected


def test_token_counts_of_given_sections(spark):
    docs = spark.createDataFrame([(1, "title here\nand a body", [(7, 0, 5), (8, 5, 9)]), (2, None, None), (3, "x", [])], "doc_id long, text string, parts array<struct<section: long, start: long, end: long>>")
    rows = attribution.token_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), "start", F.col("parts")).collect()
    assert [(r.doc_id, r.section, r.n_tokens) for r in rows] == [(1, 7, 1), (1, 8, 1)]
    with pytest.raises(ValueError):
        attribution.token_counts(docs, "", "", "both")


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(3, None), (3, None), (None, "the of the")]
    frame = spark.createDataFrame(rows, docs.schema).withColumn("score", F.lit("x"))
    found = scoring.scored(frame).collect()
    split = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in rows:
        own = split(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        expected[i, held(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert scoring.scored(docs.limit(0)).count() == 0


def test_scores_in_parts_of_the_filters(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(80)))) for i in range(60)] + [(5, "w1 w2")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id, r.n_tokens, round(r.score, 9), round(r.base_score, 9), r.n_known)
    whole = Counter(map(key, scoring.scored(frame).collect()))
    assert Counter(map(key, scoring.scored(frame, filter_bytes=900).collect())) == whole
