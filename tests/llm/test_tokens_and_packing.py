import struct
import zlib

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import fragments
from tidemark.llm.packing import OpenWindows, pack
from tidemark.llm.token_counts import count_tokens

ROOT = "/root/testdata/sf0.001"
MODEL = public.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a  b", "a \n b", "a\n \tb", "▁ b", "x ▁y", "a <|endoftext|> b", "<s> x </s>", "tail ", "tail  ", "\n \n", "ümläut ＡＢ é", "a  b　c", "it's 's 12 3", "x" * 3000, "w " * 3000, None]
BYTES = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def docs(spark, extra="start"):
    own = spark.createDataFrame([(i - 1000, t, "clash") for i, t in enumerate(HARD)] + [(None, "no key", "c"), (-5, "twice", "c"), (-5, "twice", "c")], f"doc_id long, text string, {extra} string")
    return own.unionByName(spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").selectExpr("doc_id", "text", f"'x' AS {extra}"))


def test_counts_are_the_librarys(spark):
    table = docs(spark, "n_tokens")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in table.collect())
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(table, MODEL).collect())
    assert got == want


def test_counts_of_an_empty_table(spark):
    assert count_tokens(docs(spark).limit(0), MODEL).collect() == []


def test_memo_in_little_space_gives_the_same(monkeypatch):
    texts = [t or "" for t in HARD] * 2
    want = fragments.PieceCounter(MODEL).counts(texts)
    monkeypatch.setattr(fragments, "REMEMBERED", 3)
    small = fragments.PieceCounter(MODEL)
    assert [small.counts([t])[0] for t in texts] == want


def check_packing(rows, table, size=2048):
    library = Tokenizer.from_file(BYTES[0])
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    copies = {}
    for r in table.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 1]
        seen = sorted(x for p in pieces for x in range(p.start, p.start + p.length))
        assert seen == sorted([*range(len(ids))] * copies[doc])
        for p in pieces:
            assert p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length]))
    pad = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        total += at
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad, total


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_is_an_exact_round_trip(spark, parts):
    table = docs(spark).coalesce(parts)
    pad, total = check_packing(pack(table, *BYTES).collect(), table)
    assert pad < 2048 + 0.01 * total


def test_packing_merges_leftovers_of_many_tasks(spark):
    table = spark.createDataFrame([(i, f"short text {i}") for i in range(400)], "doc_id long, text string").repartition(80, "doc_id")
    rows = pack(table, *BYTES, merged=16).collect()
    check_packing(rows, table)
    assert len({r.sequence_id for r in rows}) <= 80 / 16 + 2


def test_packing_of_nothing(spark):
    assert pack(docs(spark).limit(0), *BYTES).collect() == []


def test_windows_stay_bounded_and_fit_best():
    w = OpenWindows(8, 2, 0)
    piece = lambda n, i=0: (i, 0, bytes(4 * n), n)
    assert [*w.place(piece(5)), *w.place(piece(6))] == []
    assert [len(x) for x in w.place(piece(2))] == [2]  # into the window of 6
    assert [*w.place(piece(7))] == []
    out = [*w.place(piece(4))]  # fits nowhere: the fullest (7) takes one id and goes
    assert sum(len(p[2]) // 4 for p in out[0]) == 8 and len(w.open) <= 2
