"""Fill-in-the-middle against plain slices of text."""

import hashlib

import pytest

from tablevitals.llm import infilling

SCHEMA = "doc_id long, text string"


def expected(doc_id, text):
    text, hexed = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or h3 % 100 >= 90 or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", lo, hi - lo, f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "a", "<", "P>", "plain text", "日本語のテキスト", "é😀x" * 7, "<P", "S><", "a<P>b", "<M>", "<<S<M<P", "x\x00y", "\n", "word " * 50_000, "😀" * 30_000]


def test_outputs_and_restored_texts(spark):
    rows = [(i * 7 - 20, text) for i, text in enumerate(TEXTS * 12)] + [(None, "no id"), (5, "same"), (5, "same")]
    found = infilling.restored(infilling.transformed(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    assert len(found) == len(rows)
    seen = {(r.doc_id, bytes(r.text).decode()): r for r in found}
    forms = set()
    for doc_id, text in rows:
        row = seen[doc_id, text or ""]
        n, form, before, within, output = expected(doc_id, text)
        forms.add(form)
        assert (row.n, row.form, row.prefix_chars, row.middle_chars) == (n, form, before, within)
        assert bytes(row.output).decode() == output
        assert row.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert row.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_every_cut_of_a_text_of_near_sentinels_is_restored(form):
    text = "<P<S><<M>S>é<".replace("<S>", "<S").replace("<M>", "<M").encode()
    starts = [at for at in range(len(text) + 1) if at == len(text) or text[at] & 0xC0 != 0x80]
    for first in starts:
        for second in (at for at in starts if at >= first):
            output = infilling.arranged_table(text, form, first, second)
            back = infilling.restored_table(output.bytes(), form)
            assert back.bytes() == text and back.sha256() == hashlib.sha256(text).hexdigest()
            assert output.sha256() == hashlib.sha256(output.bytes()).hexdigest()


def test_pieces_are_not_copied():
    text = b"0123456789"
    table = infilling.arranged_table(text, "psm", 2, 5)
    assert [p for p in table.pieces if p.buffer == infilling.TEXT] == [(0, 0, 2), (0, 5, 5), (0, 2, 3)]
    assert all(run.obj is table.buffers[p.buffer].obj for p, run in zip(table.pieces, table.runs()))


def test_small_batches_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(infilling, "_BATCH_BYTES", 300)
    rows = [(i, "text " * (i % 90)) for i in range(500)]
    found = infilling.restored(infilling.transformed(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id, bytes(r.text).decode()) for r in found) == sorted(rows)


def test_empty_table_and_other_columns(spark):
    assert infilling.restored(infilling.transformed(spark.createDataFrame([], SCHEMA))).count() == 0
    docs = spark.createDataFrame([(1, "abc", "f", 3)], SCHEMA + ", form string, output int")
    assert infilling.transformed(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    assert infilling.transformed(docs).first().n == 3
