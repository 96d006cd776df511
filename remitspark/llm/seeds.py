"""Winnowed anchors over bytes or words, and the texts that share one: the seeds of both substring operators.

A window of L = k + w - 1 units holds w k-grams; its anchor is the one with the smallest hash (the leftmost, in a
tie). Equal windows have equal anchors at equal places, so any repeated window shares an anchor: joining on
anchors loses no repeat. An anchor's k-gram that occurs at one place only cannot lie in a repeated window.

Exact copies of a text are one text here (``tk``, ``tn``: hash and length); who has copies is known from their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch, text_key

MIX = np.uint64(0x9E3779B97F4A7C15)
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_rng = np.random.default_rng(7)
TABLES = tuple(_rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in BASES)
#: Units (bytes or words) handled at once in a task.
SLICE = 1 << 19


def fmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        m = max(n, SLICE + 1)
        one = np.ones(1, np.uint64)
        inverse = pow(base, -1, 1 << 64)
        got = tuple(np.concatenate([one, np.cumprod(np.full(m, b, np.uint64))]) for b in (base, inverse))
        if m <= 8 * SLICE:
            _powers[base] = got
    return got


class Rolling:
    """Hashes of any range of a sequence of unit values, from prefix sums (arithmetic modulo 2**64)."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]) -> None:
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return fmix((self.sums[b] - self.sums[a]) * self.down[a] + (np.asarray(b) - np.asarray(a)).astype(np.uint64) * MIX)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 1)
        return h


_words = WordHashes()


def units(text: str | None, kind: str) -> np.ndarray:
    """Values of a text's bytes or words for the first hash."""
    raw = (text or "").encode()
    if kind == "bytes":
        return TABLES[0][np.frombuffer(raw, np.uint8)]
    words = raw.split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def second(values: np.ndarray) -> np.ndarray:
    """Other values of the same units, for an independent second hash."""
    return fmix(values + MIX)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, m, cur = len(x) - w + 1, x, 1
    while cur * 2 <= w:
        m = np.minimum(m[:-cur], m[cur:])
        cur *= 2
    return np.minimum(m[:n], m[w - cur : w - cur + n])


def anchors(r: Rolling, size: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end (sizes in units): window starts, each window's anchor, anchors, their hashes."""
    total, span = int(size.sum()), k + w - 1
    none = np.zeros(0, np.int64)
    if total < span:
        return none, none, none, np.zeros(0, np.uint64)
    start = np.arange(total - k + 1)
    h = r.hash(start, start + k)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    low = sliding_min(packed, w) & np.uint64(0xFFFFFFFF)
    end = np.repeat(np.cumsum(size), size)[: len(low)]
    p = np.flatnonzero(np.arange(len(low)) + span <= end)
    of = low[p].astype(np.int64)
    if not len(p):
        return none, none, none, np.zeros(0, np.uint64)
    a = of[np.concatenate([[True], of[1:] != of[:-1]])]
    return p, of, a, h[a]


def slices(values: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    a = n = 0
    for b, v in enumerate(values):
        if n and n + len(v) > SLICE:
            yield a, b
            a, n = b, 0
        n += len(v)
    if a < len(values):
        yield a, len(values)


def gathered(parts: Iterator[dict[str, np.ndarray]], most: int = 100_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``most`` rows from columns that come text by text."""
    held, n = [], 0
    for p in parts:
        size = len(next(iter(p.values())))
        if size:
            held.append(p)
            n += size
        if n >= most:
            yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            held, n = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def anchor_rows(docs: DataFrame, kind: str, k: int, w: int) -> DataFrame:
    """(tk, tn, pos, seed) for every anchor of every text of docs(text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tk, tn, text = b["tk"].to_numpy(), b["tn"].to_numpy(), b["text"].tolist()
            step = 512
            for c in range(0, len(text), step):
                values = [units(t, kind) for t in text[c : c + step]]
                for i, j in slices(values):
                    size = np.array([len(v) for v in values[i:j]])
                    _, _, a, h = anchors(Rolling(np.concatenate(values[i:j])), size, k, w)
                    ends = np.cumsum(size)
                    doc = np.searchsorted(ends, a, "right")
                    yield pd.DataFrame({"tk": tk[c + i : c + j][doc], "tn": tn[c + i : c + j][doc], "pos": (a - (ends - size)[doc]).astype(np.int32), "seed": h.view(np.int64)})

    keyed = docs.select(*text_key(), "text").where(F.col("tn") >= k + w - 1)
    return keyed.mapInPandas(run, "tk long, tn int, pos int, seed long")


def repeated(rows: DataFrame, key: list[str], place: list[str], scratch: Scratch) -> DataFrame:
    """Rows whose key occurs at two or more places (without place columns: twice). The rows are made once and saved;
    the keys' smallest and largest places are combined before their shuffle. The join back is one of two saved tables with
    one row a key on its right, so that Spark splits a frequent key on its left by size."""
    rows = scratch.save(rows)
    scratch.forget()
    if place:
        at = F.xxhash64(*place)
        found = rows.groupBy(*key).agg(F.min(at).alias("lo_"), F.max(at).alias("hi_")).where("lo_ <> hi_").select(*key)
    else:
        found = rows.groupBy(*key).count().where("count > 1").select(*key)
    found = scratch.save(found)
    out = scratch.save(rows.join(found, key, "left_semi"))
    scratch.drop(rows, found)
    scratch.forget()
    return out


def texts_with_seeds(docs: DataFrame, kind: str, k: int, w: int, scratch: Scratch) -> DataFrame:
    """(tk, tn, t, text, seeds): each different text that shares an anchor's k-gram, with their positions; once.

    Only anchors are shuffled in full; texts are combined before their shuffle, so that copies travel once a task.
    """
    seeds = repeated(anchor_rows(docs, kind, k, w), ["seed"], ["tk", "tn", "pos"], scratch)
    per_text = seeds.groupBy("tk", "tn").agg(F.collect_set("pos").alias("seeds"))
    texts = docs.select(*text_key(), "text").where(F.col("tn") >= k + w - 1).groupBy("tk", "tn").agg(F.first("text").alias("text"))
    return texts.join(per_text, ["tk", "tn"]).withColumn("t", F.monotonically_increasing_id())


def copies(docs: DataFrame) -> DataFrame:
    """(tk, tn) of texts that more than one row of docs has."""
    return docs.groupBy("tk", "tn").count().where("count > 1").select("tk", "tn", F.lit(True).alias("copied"))
