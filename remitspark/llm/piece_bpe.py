"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words that no vocabulary piece can cross; unseen words of a batch lie in one flat symbol array.
Each round finds every word's best pair (segmented minimum of pair ranks), merges its leftmost occurrences in
all words at once, and compacts the array; words without a pair leave it. Several occurrences of a word's best
pair merge in one round only where no pair made on the way would have gone first; else just the leftmost does.
Characters outside the vocabulary become their UTF-8 byte pieces.

The model file is only read: pieces, scores and kinds. Its path is a parameter.

Cases: null texts count as empty (an end id alone); repeated rows are encoded row by row; an empty table gives
an empty result; extra columns are ignored by ``encode_documents``; long texts are held one batch at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from remitspark.llm.common import bounded_batches

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Words kept per Python worker between batches, and characters handled at once.
MEMORY, SLICE = 200_000, 1_000_000


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class PieceModel:
    """Tables of one BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.byte = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
        self.surface = [b"" if not p and not sp.is_byte(i) else bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(SPACE, " ").encode() for i, (t, p) in enumerate(zip(pieces, plain))]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.known = n
        ids = {t: i for i, t in enumerate(pieces) if plain[i]}
        longer = [t for t in ids if len(t) > 1]
        if any(SPACE in t.lstrip(SPACE) for t in longer):
            raise ValueError("a piece of this model crosses words")
        self.symbols = dict(ids)  # and the characters that only occur inside longer pieces
        for t in longer:
            for c in t:
                self.symbols.setdefault(c, len(self.symbols) + n)
        order = np.argsort([-sp.get_score(ids[t]) for t in longer], kind="stable")
        rank = {longer[k]: r for r, k in enumerate(order.tolist())}
        self.base = max(self.symbols.values()) + 2
        keys, ranks = [], []
        for t in longer:
            for k in range(1, len(t)):
                a, b = self.symbols.get(t[:k]), self.symbols.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ranks.append(rank[t])
        o = np.argsort(keys)
        self.keys, self.ranks = np.array(keys, np.int64)[o], np.array(ranks, np.int32)[o]
        self.merged = np.array([ids[longer[k]] for k in order.tolist()], np.int32)
        inside = "".join(sorted({c for t in longer for c in t} - {SPACE}))
        m = re.escape(inside)
        self.words = re.compile(f"{SPACE}+[{m}]*|[{m}]+|[^{SPACE}]")
        self.seen: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.seen = {}
        self.flat, self.start = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs, NONE where their string is no piece."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge flat symbols (words contiguous and ascending) until no pair remains."""
        done_s, done_w = [], []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)  # of the pair that starts here
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.pair(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([first, [len(sym)]]))
            best = np.minimum.reduceat(rank, first)
            live = best < NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_s.append(sym[~keep])
                done_w.append(word[~keep])
                sym, word, rank, size, best = sym[keep], word[keep], rank[keep], size[live], best[live]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            each = np.repeat(best, size)
            hit = rank == each
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))  # overlapping hits: every other one
            at = np.flatnonzero(hit)
            at = at[(at - run[np.searchsorted(run, at, "right") - 1]) % 2 == 0]
            owner = np.searchsorted(first, at, "right") - 1
            lead = np.concatenate([[True], owner[1:] != owner[:-1]])
            if not lead.all():
                new = self.merged[best[owner]]
                n = len(sym)
                right = np.minimum(at + 2, n - 1)
                r = np.where((at + 2 < n) & (word[right] == word[at]), self.pair(new, sym[right]), NONE)
                left = np.maximum(at - 1, 0)
                before = np.concatenate([[-9], at[:-1]]) == at - 2
                prev = np.where(before, new, sym[left])
                l = np.where((at > 0) & (word[left] == word[at]), self.pair(prev, new), NONE)
                bad = np.zeros(len(first), bool)
                bad[owner[(r <= best[owner]) | (l <= best[owner])]] = True
                at = at[lead | ~bad[owner]]
                owner = np.searchsorted(first, at, "right") - 1
            sym[at] = self.merged[best[owner]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        s, w = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (done_s, done_w))
        o = np.argsort(w, kind="stable")
        return s[o], w[o]

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before and remember their ids."""
        text = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inv = np.unique(code, return_inverse=True)
        sym = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in kinds.tolist()], np.int32)[inv]
        table = sym.copy()
        table[sym < 0] = self.base - 1  # never part of a pair
        w = np.repeat(np.arange(len(words)), size)
        out, owner = self.merge_rounds(np.where(sym < 0, sym, table), w)
        foreign = (out < 0) | (out >= self.known)
        if foreign.any():
            back = {i: c for c, i in self.symbols.items() if i >= self.known}
            parts = [self.byte[np.frombuffer((chr(-1 - v) if v < 0 else back[v]).encode("utf-8", "surrogatepass"), np.uint8)] for v in out[foreign].tolist()]
            reps = np.ones(len(out), np.int64)
            reps[foreign] = [len(p) for p in parts]
            ids = np.repeat(out, reps)
            ids[np.repeat(foreign, reps)] = np.concatenate(parts)
            out, owner = ids, np.repeat(owner, reps)
        n, at = len(self.seen), int(self.start[-1])
        while at + len(out) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(out)] = out
        self.start = np.concatenate([self.start, at + np.cumsum(np.bincount(owner, minlength=len(words)))])
        self.seen.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.seen) > MEMORY:
            self.reset()
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(self.seen) if split else set()
        if new:
            self.learn(sorted(new))
        out = []
        for words in split:
            k = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
            a = self.start[k]
            size = self.start[k + 1] - a
            ids = np.full(int(size.sum()) + 1, self.end, np.int32)
            ids[:-1] = self.flat[np.repeat(a - np.cumsum(size) + size, size) + np.arange(len(ids) - 1)]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text: pieces joined, the leading space of the dummy prefix dropped."""
        flat = b"".join(map(self.surface.__getitem__, ids))
        if flat[:1] == b" " and self.first_is_space(ids):
            flat = flat[1:]
        return flat.decode("utf-8", "each_byte").encode()

    def first_is_space(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.surface[i] or i == self.unknown), None)
        return first is not None and first != self.unknown and int(self.byte[32]) != first


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every row; the general interface."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for i, j in slices(texts):
                ids = m.encode(texts[i:j])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].to_numpy(), "ids": ids, "decoded": [m.decode(x.tolist()).decode() for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode_documents`` gives, reduced where it is made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        name = [str(i) for i in range(m.known)].__getitem__
        sha = hashlib.sha256
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for i, j in slices(texts):
                ids = [x.tolist() for x in m.encode(texts[i:j])]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[i:j].to_numpy(),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [sha(" ".join(map(name, x)).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [sha(m.decode(x)).hexdigest() for x in ids],
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
