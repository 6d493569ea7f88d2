"""Source divergence against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from tablevitals.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string"


def expected(rows, least=10, top=10):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", lang or "", s or "") for t, lang, s in rows):
        terms = Counter(TERM.findall(text.translate(LOWER)))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        documents[lang].update(terms.keys())
    found = set()
    for lang in {lang for lang, _ in groups}:
        kept = {term for term, n in documents[lang].items() if n >= least}
        sources = sorted(source for own, source in groups if own == lang)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 2) // (sum(own[s].values()) + 2 * len(kept)) for t, c in own[s].items()} for s in own}
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-((p[s][t] - p[None][t]) ** 2 // (p[s][t] + p[None][t])), t.encode()) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, listed in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                found |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(listed, 1)}
    return found


def actual(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


WORDS = "alpha Beta GAMMA délta Ünï x 語彙 don't a-b 1two2".split()


def fixture():
    rows = [(" ".join(WORDS[(i * k) % 10] for k in range(i % 7)) + f" rare{i}", "en" if i % 3 else "fr", f"s{i * i % 4}") for i in range(120)]
    rows += [(None, "en", "silent"), ("", None, None), ("Alpha", None, None), ("\x00[`{\x7f 12", "en", "é")]
    rows += [("alpha alpha", "en", "s1")] * 30 + [("only one source", "de", "s0")] * 12 + [("few", "it", "a"), ("words", "it", "b")]
    return rows


def test_equals_plain_python(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert actual(divergence.audited(docs)) == expected(rows)


def test_terms_are_those_of_the_pattern():
    for text in ("", "ABC abc Éa", "a b", "x\x80\x00y", "日本 ＡＢ é" * 3, "@[`{A", "\n\ta1b"):
        assert [t.decode() for t in divergence.terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


def test_small_buffers_and_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_TERMS", 3)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "_HELD", 1)
    rows = fixture()
    assert actual(divergence.audited(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_a_language_without_kept_terms_has_pairs_of_no_difference(spark):
    docs = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y")], SCHEMA)
    assert actual(divergence.audited(docs)) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_rates_are_exact_for_large_counts(spark):
    import numpy as np
    from pyspark.sql import functions as F

    cases = [(10**12 + 7, 3 * 10**14 + 1, 10**7), (0, 0, 1), (9 * 10**14, 9 * 10**14, 3)]
    exact = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    assert list(divergence.rates(*np.array(cases).T)) == exact
    frame = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.rate(F.col("c"), F.col("n"), F.col("v")))
    assert [r[0] for r in frame.collect()] == exact


def test_empty_table_and_other_columns(spark):
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1, "x", [2]) for r in rows], SCHEMA + ", count int, term string, sources array<int>")
    assert actual(divergence.audited(docs)) == expected(rows)


@pytest.mark.parametrize("text", ["w" * 300_000, " ".join(f"w{i}" for i in range(60_000))])
def test_very_long_texts(spark, text):
    text = text.translate({ord(str(d)): chr(ord("a") + d) for d in range(10)})
    rows = [(text, "en", "a"), (text + " more", "en", "b")] * 5
    assert actual(divergence.audited(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
