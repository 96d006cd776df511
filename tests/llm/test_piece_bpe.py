"""Encoding and decoding against the sentencepiece library itself."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitspark.llm.piece_bpe import PieceModel, default_path, digests, encode_documents


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return PieceModel(default_path()), sentencepiece.SentencePieceProcessor(model_file=default_path())


def same(both, texts):
    m, sp = both
    for t, ids in zip(texts, m.encode(texts)):
        want = sp.encode(t, add_eos=True)
        assert ids.tolist() == want, t
        assert m.decode(want).decode() == sp.decode(want), t


def test_fixed(both):
    same(both, ["", " ", "  ", "a", " a", "a ", "  a  b ", "▁a", "\x00a", "a\tb\nc", "日本語𝒳", "﻿x", "<s>hi</s>", "<0x41>", "ﬁ Ａ é", "x" * 3000, "ab" * 2000, "\n" * 50, "    " * 200, "hello" * 500, "1234567 3.14", "  x", "😀👍🏽" * 20, "]^-\\[" * 9])


def test_random_strings(both):
    rng = random.Random(5)
    pools = ["abcdefghij ", "aab ", "the and ing er\n", "éèàçßäöü ñ ", "()[]{}<>;=+-*/.,\t ", "▁ x"]
    same(both, ["".join(rng.choice(p) for _ in range(rng.randint(0, 400))) for p in pools for _ in range(60)])


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_text(both, t):
    if any(0xD800 <= ord(c) < 0xE000 for c in t):
        return
    same(both, [t])


def test_documents(spark, both):
    import hashlib

    rows = [(1, "Hello  world\n", 5), (1, "Hello  world\n", 5), (2, None, 6), (None, "é" * 40000, 7), (3, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(df, default_path()).collect()), key=str)
    sp = both[1]
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert digests(df.limit(0), default_path()).count() == 0
    assert [r.decoded for r in encode_documents(df.where("doc_id = 1").limit(1), default_path()).collect()] == ["Hello  world\n"]
