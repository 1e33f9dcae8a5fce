"""Packing and byte-pair encoding against the tokenizers library, and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskspark.llm import bpe, packing, tokens
from tests.llm.helpers import ODD, docs_of, prose

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbßÉéÿŸžİıſ'stvremlld 019_-.!?\"<|>\n\t\x0b\x1c½Σςµª…“🙂́", max_size=40))
def test_word_ids_are_the_tokenizers(text):
    known = tokens.WordTokens.load(WORD)
    assert known.packed(text) == known.whole(text)


def test_word_ids_of_real_texts(spark, sf):
    known = tokens.WordTokens.load(WORD)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert known.packed(r["text"]) == known.whole(r["text"])


def test_cuts_are_powers_of_two():
    for n in [*range(1, 300), 2047, 2048, 2049, 5000]:
        parts = packing.cuts(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert parts == sorted(parts, reverse=True)


def test_pieces_hold_every_id_once(spark):
    docs = docs_of(spark, ODD)
    packed = packing.pieces(docs, WORD).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = sorted((str(i), np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ODD)
    rows = {}
    for r in packed:
        rows.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    got = []
    for (doc, total), pieces in rows.items():
        starts = sorted({p["start"] for p in pieces})
        copies = len(pieces) // len(starts)
        one = {p["start"]: bytes(p["ids"]) for p in pieces}
        got += [(str(doc), b"".join(one[s] for s in starts))] * copies
        assert len(b"".join(one.values())) == 4 * total
    assert sorted(got) == want
    assert len({p["sequence_id"] for p in packed}) == len(packed)
    assert all(p["offset"] == 0 and p["length"] == 1 << p["bucket"] for p in packed)


def test_digests_and_buckets(spark, tmp_path):
    packed = packing.pieces(docs_of(spark, ["one two three", None]), WORD)
    for r, d in zip(packed.collect(), packing.digests(packed).collect()):
        assert d["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    packing.write_buckets(packed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == packed.count()


def test_empty_table(spark):
    none = docs_of(spark, ["a"]).limit(0)
    assert packing.digests(packing.pieces(none, WORD)).count() == 0
    assert bpe.digests(bpe.encode(none, RANKS), RANKS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbé'st ve019_.!\n\t\r\x0b\x1c\x85\xa0　½漢🙂<|endoftext|>", max_size=120), st.integers(1, 9))
def test_leaves_join_to_the_whole(text, leaf):
    coder, tokenizer = bpe.Coder.load(RANKS), Tokenizer.from_file(BYTE) if not hasattr(test_leaves_join_to_the_whole, "t") else test_leaves_join_to_the_whole.t
    test_leaves_join_to_the_whole.t = tokenizer
    parts = []
    for data, kind in bpe.leaves(text, coder, leaf):
        if kind == "special":
            parts.append((kind, [bpe.SPECIAL[data.decode()]]))
        else:
            parts.append((kind, coder.bpe.encode_ordinary(data.decode()) if kind in ("text", "more") else coder.piece(data)))
    assert bpe.joined(coder, parts) == tokenizer.encode(text, add_special_tokens=False).ids == coder.encode(text)


def test_white_space_at_the_end_of_a_leaf_keeps_its_pieces(byte_tokenizer):
    coder = bpe.Coder.load(RANKS)
    for text in ("00\xa0\xa00", "ab\u3000\u3000\u3000ab", "!\xa0\xa0ababababab\xa0\xa0!"):
        for leaf in (1, 2, 3, 4):
            parts = [(k, coder.bpe.encode_ordinary(d.decode()) if k in ("text", "more") else coder.piece(d)) for d, k in bpe.leaves(text, coder, leaf)]
            assert bpe.joined(coder, parts) == byte_tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["a", "ab", "the", "aé漢", "=", "0"])
def test_long_piece_without_a_split(letters, byte_tokenizer):
    rng, coder = random.Random(3), bpe.Coder.load(RANKS)
    text = "".join(rng.choice(letters) for _ in range(6000))
    parts = [(k, coder.encode(d.decode()) if k in ("text", "more") else coder.piece(d)) for d, k in bpe.leaves(text, coder, 257)]
    assert len(parts) > 10
    assert bpe.joined(coder, parts) == byte_tokenizer.encode(text, add_special_tokens=False).ids


def test_encode_equals_the_library_and_round_trips(spark, byte_tokenizer):
    texts = [*ODD, (20, prose(1, 400) + " " + "ab" * 900 + "<|endoftext|>" + "!" * 700)]
    found = bpe.decode(bpe.encode(docs_of(spark, texts), RANKS, long_chars=500, leaf=128), RANKS).collect()
    want = sorted((str(i), tuple(byte_tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in texts)
    assert sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["text"]) for r in found) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in found)


def test_decode_keeps_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(np.array([31373], "<u4").tobytes()), "y")], "n int, ids binary, text string")
    assert [(r["n"], r["text"]) for r in bpe.decode(df, RANKS).orderBy("n").collect()] == [(1, None), (2, "hello")]
