"""Encoding and decoding against the tokenizers library itself, and the lookahead against its definition."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitspark.llm.byte_bpe import ByteModel, Decoder, Transducer, decode_documents, default_path, digests, encode_documents, sufficient_lookahead


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return ByteModel(default_path()), Tokenizer.from_file(default_path())


def encoded(m, t):
    return m.ids(t)


def same(both, texts):
    m, lib = both
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert encoded(m, t) == ids, t[:200]
        back = Decoder(m)
        assert "".join(back.feed([i]) for i in ids) + back.finish() == lib.decode(ids, skip_special_tokens=False)


def test_fixed(both):
    same(both, ["", " ", "a", "hello world  ", "don't we'll  x\n\n y", "<|endoftext|>a <|endoftext|>", "a<|endoftext", " x\u0085y\x1cz", "日本語" * 3000, "😀👍🏽" * 50, "ab " * 60000, "՘x՘ 1\U00010940", " \n " * 100])


def test_long_pretokens(both):
    """Unbroken words far longer than a window."""
    rng = random.Random(1)
    same(both, ["a" * 5000, "é" * 4000, "-" * 9000, " " * 5000 + "x", "1" * 700 + "a" * 300_000, "".join(rng.choice("etaoinshrdlu") for _ in range(40_000)), "".join(rng.choice("ab") for _ in range(20_000)), "=-" * 6000])


def test_random_tokens(both):
    rng = random.Random(3)
    words = [s.decode("utf-8", "ignore") for s in both[0].surface.values()]
    same(both, ["".join(rng.choice(words).strip() if k % 2 else rng.choice(words) for _ in range(rng.randint(1, 300))) for k in range(120)])


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_text(both, t):
    if not any(0xD800 <= ord(c) < 0xE000 for c in t):
        same(both, [t])


@given(st.lists(st.integers(0, 50256), max_size=60), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_decoder_on_any_ids(both, ids, step):
    m, lib = both
    back = Decoder(m)
    assert "".join(back.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + back.finish() == lib.decode(ids, skip_special_tokens=False)


def merged(merges, word):
    """Merging by its definition, one pair a step."""
    sym = [bytes([b]) for b in word]
    rank = {m: r for r, m in enumerate(merges)}
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(sym, sym[1:])) if p in rank]
        if not found:
            return sym
        _, k = min(found)
        sym[k : k + 2] = [sym[k] + sym[k + 1]]


def random_merges(rng, letters, n):
    parts, out, made = [bytes([c]) for c in letters], [], set()
    for _ in range(10 * n):
        u, v = rng.choice(parts), rng.choice(parts)
        if u + v not in made and len(u + v) <= 6 and len(out) < n:
            made.add(u + v)
            out.append((u, v))
            parts.append(u + v)
    return out


def test_lookahead_holds():
    """Whatever follows, no token that ends so far before the border changes; and the chain of the first example is reached."""
    rng = random.Random(7)
    for _ in range(60):
        merges = random_merges(rng, b"abc"[: rng.randint(1, 3)], rng.randint(1, 12))
        far = sufficient_lookahead(merges)
        for _ in range(40):
            known = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            ends = []
            for more in (b"", *(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(5))):
                at, cut = 0, []
                for t in merged(merges, known + more):
                    at += len(t)
                    if at <= len(known) - far:
                        cut.append(at)
                ends.append(cut)
            assert all(e == ends[0] for e in ends), (merges, known)
    assert sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2  # "ab|c": c takes b, so that a stays alone
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"ab", b"c")])


def test_window_is_bounded(both):
    m = both[0]
    t, most, rng = Transducer(m), 0, random.Random(5)
    word = bytes(rng.choice(b"etaoin") for _ in range(60_000))
    ids = []
    for k in range(0, len(word), 500):
        ids += t.feed(word[k : k + 500])
        most = max(most, len(t.held))
    assert ids + t.finish() == m.merge(word)
    assert most <= 2 * t.wait + 500


def test_words_together(both):
    """Words merged in flat arrays, among them such with overlapping places of a pair, are as each alone."""
    m, rng = both[0], random.Random(9)
    words = [bytes(rng.choice(b"aeinot =-" if k % 2 else b"ab") for _ in range(rng.randint(1, 60))) for k in range(500)] + [b"=" * 37, b" " * 64, b"x"]
    ids, counts = m.merge_all(words)
    assert ids.tolist() == [i for w in words for i in m.merge(w)] and counts.tolist() == [len(m.merge(w)) for w in words]
    assert [len(x) for x in m.merge_all([])] == [0, 0]


def test_memory_is_bounded(both, monkeypatch):
    from remitspark.llm import byte_bpe as B

    monkeypatch.setattr(B, "MEMORY", 50)
    monkeypatch.setattr(B, "BLOCK", 200)
    rng = random.Random(8)
    same(both, [" ".join("".join(rng.choice("abcdef") for _ in range(rng.choice([1, 5, 90]))) for _ in range(600)) for _ in range(3)])
    assert len(both[0].seen) < 300


def test_documents(spark, both):
    rows = [(1, "Hello  world\n", 5), (1, "Hello  world\n", 5), (2, None, 6), (None, "é" * 40000, 7), (3, "", 8), (4, "x" * 200_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(df, default_path()).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert digests(df.limit(0), default_path()).count() == 0
    back = encode_documents(df, default_path())
    assert sorted((r.doc_id or 0, r.decoded) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.text) for r in decode_documents(back, default_path()).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
