"""Encoding, packing and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinetrace.llm import packing as K
from kinetrace.llm import pieces as S
from kinetrace.llm import token_files as T
from kinetrace.llm.shared import documents
from kinetrace.llm.tokens import Ids

SF = "/root/testdata/sf0.001"


MODEL = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = S.PieceCodec(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab ▁\n\ttheingé漢😀0")))
def test_pieces_equal_the_library(text):
    want = LIBRARY.encode(text, add_eos=True)
    assert CODEC.encode(text).tolist() == want
    assert CODEC.decode(want) == LIBRARY.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=8))
def test_any_ids_decode_as_in_the_library(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_pieces_of_one_long_word():
    rng = random.Random(1)
    for size in (2_000, 20_000):
        text = "".join(rng.choice("theingandofation") for _ in range(size))
        assert CODEC.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)


def test_piece_tables_hold_after_clearing(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 5)
    c = S.PieceCodec(MODEL)
    for text in ("one two three four five six seven", "eight nine ten one two"):
        assert c.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)


def test_piece_operators(spark, awkward):
    e = S.encode_documents(awkward, MODEL)
    d = {(r.doc_id, r.text) for r in S.decode_documents(e, MODEL).collect()}
    assert d == {(r.doc_id, LIBRARY.decode(LIBRARY.encode(r.text or "", add_eos=True))) for r in awkward.collect()}
    assert S.encoding_digests(awkward.limit(0), MODEL).count() == 0
    assert S.op3_sentencepiece(spark, SF).count() == documents(spark, SF).count()


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_equal_the_library(file, kind):
    t = Tokenizer.from_file(P.path(file))
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "the", "Ing", "é", "漢", "1", "23", "'s", "'LL", ".", "!?", "　", "\r", "😀", "Σ", "ΑΣ", "é", "<|endoftext|>", "_", "\x1c", "\x85", "\xa0", "½", "ª"]
    texts = ["", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(3000)] + ["".join(chr(rng.randint(9, 255)) for _ in range(20)) for _ in range(2000)]
    want = [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist() for a in Ids(P.path(file), kind).encode(texts)] == want


def document_ids(rows, file):
    t = Tokenizer.from_file(P.path(file))
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")) for i, x in rows]


def check_pieces(pieces, docs, size=2048):
    assert sum(p.length for p in pieces) == sum(len(a) for _, a in docs)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, a in docs:
        if i is not None and [d for d, _ in docs].count(i) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(a) and p.ids_crc32 == zlib.crc32(a[at : at + p.length].tobytes())
                at += p.length
            assert at == len(a)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing(spark, awkward):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    check_pieces(K.op8_packing(spark, SF).collect(), document_ids(rows, "byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check_pieces(K.pieces(awkward).collect(), document_ids(rows, "byte_bpe_50k.json"))
    assert K.pieces(awkward.limit(0)).count() == 0


def test_sum_of_squares_rule():
    """The chosen level is one of least sum of squares, the fullest of equals."""
    rng, p = random.Random(3), K.Packer(32)
    for _ in range(400):
        n = rng.randint(1, 31)
        counts = [len(x) for x in p.open]

        def squares(level, counts=counts, n=n):
            c = list(counts)
            if level:
                c[level] -= 1
            if level + n < 32:
                c[level + n] += 1
            return sum(v * v for v in c[1:])

        options = {level: squares(level) for level in range(33 - n) if level == 0 or counts[level]}
        best = min(options.values())
        assert p.level(n) == max(level for level, v in options.items() if v == best)
        p.add(1, np.arange(n, dtype="<u4"))
    p.close()
    assert not any(p.open)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 100), st.integers(0, 49_407), st.integers(0, (1 << 64) - 1)), max_size=70), min_size=1, max_size=6))
def test_words_round_trip(blocks):
    lengths = np.array([len(b) for b in blocks])
    words, per_block = T.encode(np.array([v for b in blocks for v in b], dtype=np.uint64), lengths)
    values, starts = T.decode(words, np.r_[0, np.cumsum(per_block)], lengths)
    assert [values[s : s + n].tolist() for s, n in zip(starts, lengths, strict=True)] == blocks


def test_words_are_packed_tightly():
    words, _ = T.encode(np.zeros(600, dtype=np.uint64), np.array([600]))
    assert len(words) == 10
    words, _ = T.encode(np.full(400, 49_407, dtype=np.uint64), np.array([400]))
    assert len(words) == 134


def test_token_files(spark, awkward, tmp_path, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in documents(spark, SF).collect())
    got = {r.doc_id: r for r in T.op9_token_files(spark, SF).collect()}
    at = 0
    for i, a in document_ids(rows, "word_bpe_49k.json"):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(a), zlib.crc32(a.tobytes()))
        at += len(a)
    monkeypatch.setattr(T, "SEGMENT", 100)
    path = str(tmp_path / "t")
    T.write_tokens(awkward, P.path("word_bpe_49k.json"), path)
    out = T.read_tokens(spark, path).collect()
    assert len(out) == awkward.count()
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    names = T.export_segments(spark, path, str(tmp_path / "plain"))
    assert [i for n in names for i in T.read_segment(open(n, "rb").read())[0]] == ids
    T.write_tokens(awkward.limit(0), P.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_segment_is_read_run_by_run():
    import tracemalloc

    lengths = np.full(2000, 1000)
    values = np.arange(2_000_000, dtype=np.uint64) % 49_000
    words, per_block = T.encode(values, lengths)
    image = T.segment(list(range(2000)), lengths, per_block, words.tobytes())
    tracemalloc.start()
    at = 0
    for ids, arrays in T.read_runs(image):
        for i, a in zip(ids, arrays, strict=True):
            assert i == at // 1000 and (a == values[at : at + 1000]).all()
            at += 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == 2_000_000 and peak < 10 << 20


def test_pieces_asked_again_are_kept(monkeypatch):
    from kinetrace.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    made = []
    table = tokens._Table(lambda key: made.append(key) or key.encode())
    for i in range(100):
        assert table["often"] == b"often" and table[f"once{i}"] == f"once{i}".encode()
    assert made.count("often") == 1 and len(table) + len(table.before) <= 8
