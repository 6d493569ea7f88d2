"""Scores against plain counts, archives that hold what looks like a member, rows without ids, and scratch."""

import gzip
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablevitals.llm import decontamination, minhash, scoring, sharding, warc
from tablevitals.llm.common import maybe_in, scratch_path

SCHEMA = "doc_id long, text string"


def texts(n=400, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(60)))) for i in range(n)]


def test_score_is_that_of_quantised_exact_counts(spark):
    """Each text's score, with counts in place of filters; a filter's errors move few tokens by one level."""
    rows = texts()
    found = {r.doc_id: r for r in scoring.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [None, *t.split(), None] for i, t in rows}
    words = Counter(w for i, t in tokens.items() if not held(i) for w in t[1:])
    pairs = Counter(p for i, t in tokens.items() if not held(i) for p in zip(t, t[1:]))
    level = lambda c: 0.0 if not c else float(scoring.count_of(scoring.levels(np.array([c])))[0])
    n, v, off = sum(words.values()), len(words), []
    for i, own in tokens.items():
        expected = 0.0
        for before, word in zip(own, own[1:]):
            context = level(words[before])
            seen = min(level(pairs[before, word]), context)
            expected += math.log10((1 - scoring.WEIGHT) * (level(words[word]) + 1) / (n + v + 1) + scoring.WEIGHT * seen / max(context, 1))
        off.append(abs(found[i].score - expected) / (len(own) - 1))
    assert np.mean(off) < 0.03 and np.median(off) < 0.01


def test_salts_of_postings_change_nothing(spark, monkeypatch):
    rows = texts(120) + [(5, "same"), (5, "same"), (None, "w1"), (7, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9))
    whole = Counter(map(key, scoring.scored(frame).collect()))
    monkeypatch.setattr(scoring, "SALT_TEXTS", 9)
    assert Counter(map(key, scoring.scored(frame).collect())) == whole


def test_a_false_member_near_the_end_of_an_archive(spark):
    """A stored last record with the bytes of a member's start in it reads the same from every split."""
    payload = b"x" * 40 + b"\x1f\x8b\x08\x04" + bytes(20) + b"\xff" * 6 + b"\x1f\x8b\x08\x00" + bytes(6)
    page = lambda i, body: gzip.decompress(warc.record(i, "u", body, None))
    packed = []
    for i, body in ((1, b"first"), (2, payload)):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        packed.append(packer.compress(page(i, body)) + packer.flush())
    folder = scratch_path(spark, "false-members")
    path, raw = f"{folder.removeprefix('file://').removeprefix('file:')}.warc.gz", b"".join(packed)
    with open(path, "wb") as f:
        f.write(raw)
    source = warc._Source(f"file://{path}")
    starts = [0, len(packed[0])]
    for cut in range(1, len(raw)):
        found = [at for lo, hi in ((0, cut), (cut, len(raw))) for at, _, _ in warc.records_in(source, lo, hi)]
        assert found == starts, cut
    files = spark.createDataFrame([(f"file://{path}", len(raw), 2)], "path string, size long, records long")
    rows = warc.records(spark, files, 50, with_payload=True).orderBy("page_id").collect()
    assert [(r.page_id, bytes(r.payload), r.digest_ok) for r in rows] == [(1, b"first", True), (2, payload, True)]
    assert rows[0].path == f"file://{path}"


def words(seed, n=80):
    rng = random.Random(seed)
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


def near(own):
    return " ".join([*own[:-1], "changed"])


def test_rows_that_share_an_id_or_have_none_are_judged_apart(spark):
    """Near-dedup and decontamination look at each row's own text; a third of the rows have no id."""
    a, b, c, leak = (words(s) for s in range(4))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(b)), (None, near(a)), (None, " ".join(c)), (None, " ".join(c)), (None, near(c))]
    rows += [(7, " ".join(leak)), (7, " ".join(words(9))), (None, near(leak)), (None, None), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA + ", _row int").repartition(3)
    stays = minhash.kept(docs)
    assert stays.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in stays.collect())
    of_c = [key for key in left if key[1] in (" ".join(c), near(c))]
    assert len(of_c) == 1 and left[of_c[0]] == 1
    of_leak = {(7, " ".join(leak))}
    assert set(left) - set(of_c) == {(1, " ".join(a)), (1, " ".join(b)), (7, " ".join(words(9))), (None, None), (8, ""), (9, None)} | of_leak
    bench = spark.createDataFrame([(1, " ".join(leak[10:50])), (2, None), (3, "")], "item_id long, text string")
    clean = decontamination.kept(docs, bench)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r[1] is None or leak[20] not in r[1])


def test_stages_leave_only_what_their_result_reads(spark):
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).removeprefix("file:")
    before = set(os.listdir(base))
    docs = spark.createDataFrame([(i, " ".join(words(i % 20))) for i in range(60)], SCHEMA)
    assert minhash.kept(docs).count() == 20
    left = {name.rpartition("-")[0].split("-")[0] for name in set(os.listdir(base)) - before}
    assert left <= {"duplicates", "repeated"}


def test_a_hot_row_without_an_id(spark):
    rows = [(None, "the same text of all of these rows " * 4)] * 900 + [(i, " ".join(words(i))) for i in range(50)]
    left = minhash.kept(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert len(left) == 51


def test_bitmap_keeps_every_key(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS doc_id", "id AS n")
    found = maybe_in(rows, "doc_id", spark.range(0, 3000, 3).selectExpr("id AS doc_id"))
    assert found.columns == ["doc_id", "n"]
    ids = {r.doc_id for r in found.collect()}
    assert {i for i in range(0, 3000, 3) if i % 7} <= ids and len(ids) < 1000 and None not in ids
    assert maybe_in(rows, "doc_id", rows.limit(0)).count() == 0


def test_many_equal_rows_spread_over_shards(spark):
    rows = [(None, "w" * 250)] * 1000 + [(i, "x" * (i % 200)) for i in range(2000)] + [(5, "x" * 5)] * 3
    found = sharding.sharded(spark.createDataFrame(rows, SCHEMA).repartition(5), 40).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(t) + 16) for i, t in rows)
    loads = Counter()
    for r in found:
        loads[r.shard] += r.size
    assert len(loads) == 40 and max(loads.values()) < 1.1 * sum(loads.values()) / 40
    for shard in loads:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))


def test_fingerprints_of_similar_bags_are_within_the_radius(spark):
    """Of bags at a similarity of 0.75, or the next above it, hardly any is missed; of unrelated ones most are."""
    rng, rows = random.Random(6), []
    for m in (7, 14, 31, 60):
        common = -(-6 * m // 7)
        for _ in range(1500):
            own = [rng.getrandbits(64) - 2**63 for _ in range(m)]
            rows.append((m, own, own[:common] + [rng.getrandbits(64) - 2**63 for _ in range(m - common)], [rng.getrandbits(64) - 2**63 for _ in range(m)]))
    frame = spark.createDataFrame(rows, "m int, own array<long>, near array<long>, far array<long>").repartition(8)
    prints = frame.selectExpr("m", *(f"{decontamination.simhash(c)} AS {c}" for c in ("own", "near", "far")))
    within = lambda c: f"avg(if(bit_count(own ^ {c}) <= {decontamination.RADIUS}, 1, 0)) AS {c}"
    for row in prints.groupBy("m").agg(*map(F.expr, (within("near"), within("far")))).collect():
        assert row.near >= 0.999 and row.far <= 0.05, row
