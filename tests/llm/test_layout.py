"""Archives, packing, shards, and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, differences
from tablevitals.llm import minhash, packing, sharding, warc
from tablevitals.llm.common import scratch_path, stored, tokenizer_path
from tablevitals.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n", "a", "it's 5 o'clock <|endoftext|> (x)", "é ́a ΣΑΣ", "word " * 5000, "x" * 9000, "same text", "same text"]


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}?a=b c\n", "".join(rng.choice("abc<>é\n") for _ in range(rng.randrange(4000)))) for i in range(40)]
    rows += [(40 + i, None, None if i % 2 else "") for i in range(6)]
    rows += [(100 + i, "u", rows[i % 5][2]) for i in range(25)] + [(100, "u", rows[0][2]), (None, "n", rows[1][2]), (None, None, "alone")]
    return rows


@pytest.mark.parametrize("range_bytes", [700, 1 << 22])
def test_archives_come_back_whole(spark, range_bytes):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).repartition(3)
    files = warc.written(frame, scratch_path(spark, "warc"))
    found = warc.records(spark, files, range_bytes, with_payload=True).collect()
    assert len(found) == len(rows) == files.agg(F.sum("records")).first()[0]
    smallest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            smallest[html or ""] = min(smallest.get(html or "", page_id), page_id)
    expected = defaultdict(int)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = smallest.get(html or "")
        revisit = page_id is not None and first != page_id
        expected[page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw] += 1
    got = defaultdict(int)
    for r in found:
        got[r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)] += 1
        assert r.digest_ok
    assert got == expected
    assert len({(r.path, r.offset) for r in found}) == len(rows)


def test_small_payloads_are_never_revisits(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc.round_trip(frame, least=3).collect()
    assert {r.page_id: r.refers_to for r in rows} == {1: None, 2: None, 3: None, 4: 3}
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_pieces_hold_every_token_once(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.limit(250).collect()] + list(enumerate(TEXTS, 5000)) + [(None, "no id")]
    frame = spark.createDataFrame(rows, docs.schema).withColumn("start", F.lit("x")).repartition(2)
    found = packing.packed(frame, tokenizer_path("word_bpe_49k.json"), block_tokens=40_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and 0 < r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # a power of two: no padding
    assert packing.packed(frame.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.packed(frame, "", size=1000)


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 2048) for _ in range(400)]
    total = [0] * (-(-sum(lengths) // 2048))
    spent = [0.0] * len(total)
    pieces = defaultdict(int)
    for piece, start, length, sequence in packing.assigned(lengths):
        assert start == pieces[piece]
        pieces[piece] += length
        total[sequence] += length
        spent[sequence] += packing.cost(length)
    assert [pieces[i] for i in range(400)] == lengths and all(t == 2048 for t in total[:-1])
    assert sorted(packing.powers(1300)) == [4, 16, 256, 1024]
    assert packing.assigned([]) == []


def test_shards_are_even_and_places_have_no_gap(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9_000_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (-7, None), (-7, None)], docs.schema)
    rows = sharded = sharding.sharded(docs.union(odd).withColumn("shard", F.lit("x"))).collect()
    assert len(sharded) == docs.count() + odd.count()
    size, places = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert set(size) == set(range(40)) and max(size.values()) <= 1.02 * sum(size.values()) / 40
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {r.doc_id: r.text for r in docs.union(odd).collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_maps_are_versions_and_slots_stay_where_they_fit(spark):
    folder = scratch_path(spark, "map")
    rows = sharding.records(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 64)
    sizes = stored(sharding.slot_bytes(rows), "sizes")
    first = sharding.first_map(spark, 4, 64)
    sharding.save_map(first, folder)
    sharding.save_map(sharding.rebalanced(sharding.read_map(spark, folder), sizes, 4), folder)
    sharding.save_map(sharding.rebalanced(sharding.read_map(spark, folder), sizes, 5), folder)
    versions = [sharding.read_map(spark, folder, v) for v in (0, 1, 2)]
    assert [v.count() for v in versions] == [64, 64, 64]
    assert sharding.read_map(spark, folder).first().version == 2
    for version, shards in ((1, 4), (2, 5)):
        load = [r["b"] for r in versions[version].join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
        assert len(load) == shards and max(load) < 1.1 * sum(load) / shards
    assert 0 < sharding.moved(versions[0], versions[1]).count() < 64
    # A record's slot is for good: only the map says where it lies.
    assert rows.agg(F.count_distinct("virtual_slot")).first()[0] <= 64


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "decontamination", "packing"]
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        assert after.exceptAll(docs).count() == 0
        ids.append({r.doc_id for r in after.select("doc_id").collect()})
        docs = after
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] and len(ids[3]) < len(ids[0])
    # Each decision, made again over the stage's own input.
    component = {r.doc_id: r.component_id for r in minhash.linked(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(ids[1])))).collect()}
    assert ids[2] == set(component.values())
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[3]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []
