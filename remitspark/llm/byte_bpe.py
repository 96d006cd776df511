"""Byte-level BPE encoding and decoding as streaming transducers of bounded memory.

**Sufficient lookahead.** Read a pre-token up to byte x and stop. Whatever follows, how far to the left of x can it still
change a token? Merges run in the order of their ranks (checked: every part of a merge is a byte or was made by an earlier
merge, and nothing is made twice). What is known and what is not agree up to a border, x at first. Merge (u, v) moves the
border to the left only if u ends at it and v begins behind it, and then by the length of u. The next merge (u', v') that
moves it has a higher rank and needs a v' that begins at the new border, where u lies: so u stands on the left edge of the
tree of v', and is taken up there by a merge that does not rank before (u, v). The longest chain of such merges, counted
in bytes of their left parts, bounds the move: ``sufficient_lookahead`` finds it by one pass over the merges. A token that
ends so many bytes before x is therefore final. ``Transducer`` holds a window of one step and the lookahead, emits what is
final, and goes on from the last border it emitted, whatever the length of the pre-token.

**Around it.** A text is cut at special tokens and into blocks before white space, where no pre-token can cross. Pre-tokens
that end inside a window are final as a whole; those of a block are merged together, in flat arrays, and remembered up to a
bound. As merges run in the order of their ranks, a round may take all places of a word's least pair at once. Ids go on
block by block: to a digest, or to the caller's array.
**Decoding** maps ids to bytes and feeds them to a byte-to-text state machine that holds at most three bytes of an
unfinished character and puts U+FFFD for what is no UTF-8.

The tokenizer file is only read; its path is a parameter. A file that asks for more than byte-level BPE (a normaliser,
dropout, prefixes, special tokens that strip) is refused.

Characters that Unicode has got lately are classed as the tokenizer library classes them; a text that holds one is cut whole.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded row by row; rows without a
doc_id keep their null; an empty table gives an empty result; extra columns are ignored, also such as are named like the
result's; a long text is read once in blocks, an unbroken pre-token of it in windows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from remitspark.llm.common import bounded_batches

#: Fixed value: how the byte-level vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a block, of a pre-token that is remembered, and of a step of the window; pre-tokens remembered by a worker.
BLOCK, SHORT, STEP, MEMORY = 1 << 19, 64, 2048, 400_000
#: The rank of a pair that no merge joins.
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token after which nothing can change it (see above); merges in the order of their ranks."""
    made: dict[bytes, int] = {}
    chains: dict[bytes, tuple[list[int], list[int]]] = {}  # left part -> ranks of its merges, longest chain up to each
    longest = 0
    for rank, (u, v) in enumerate(merges):
        if any(len(part) > 1 and part not in made for part in (u, v)) or u + v in made:
            raise ValueError(f"merge {rank} does not follow from the merges before it")
        before, t, last = 0, v, rank - 1
        while True:
            ranks, best = chains.get(t, ((), ()))
            k = bisect_right(ranks, last)
            before = max(before, best[k - 1] if k else 0)
            if t not in made:
                break
            last = made[t]
            t = merges[last][0]
        ranks, best = chains.setdefault(u, ([], []))
        ranks.append(rank)
        best.append(max(before + len(u), best[-1] if best else 0))
        longest = max(longest, best[-1])
        made[u + v] = rank
    return longest


class ByteModel:
    """Tables of one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if m.get(k)]
        special = spec.get("added_tokens") or []
        odd += [t["content"] for t in special if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd or spec["normalizer"] or m["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"not plain byte-level BPE: {odd or 'normaliser, pre-tokeniser or decoder'}")
        letter = byte_letters()
        raw = lambda t: bytes(letter[c] for c in t)
        pairs = [tuple(x if isinstance(x, list) else x.split(" ")) for x in m["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.lookahead = sufficient_lookahead(merges)
        ids = m["vocab"]
        self.surface: dict[int, bytes] = {i: raw(t) for t, i in ids.items()}
        self.byte = [0] * 256
        for c, b in letter.items():
            self.byte[b] = ids[c]
        self.base = max(ids.values()) + 1
        self.rank = {ids[a] * self.base + ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.keys = np.sort(np.fromiter(self.rank, np.int64, len(self.rank)))
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int32)
        self.made = np.array(self.merged, np.int32)
        self.letters = np.array(self.byte, np.int32)
        self.pairs = self.pair(np.repeat(self.letters, 256), np.tile(self.letters, 256))
        self.longest = max(map(len, self.surface.values()))
        self.special = {t["content"]: t["id"] for t in special}
        for t, i in self.special.items():
            self.surface[i] = raw(t) if all(c in letter for c in t) else t.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.pieces, self.edge = regex.compile(PATTERN), regex.compile(r"(?<=\S)(?=\s)")
        self.stands: dict[int, str] = {}
        self.plain: set[str] = set()
        self.name = {i: str(i) for i in self.surface}
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.start = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def classed(self, text: str) -> str:
        """The text with a letter, a digit or a mark in the place of each character that Unicode has got lately (such as this
        Python's tables do not have): which of them, the tokenizer library says, as the tables of ``regex`` may be of another
        age than its own. Other texts come back as they are."""
        if text.isascii():
            return text
        new = set(text).difference(self.plain)
        odd = [c for c in new if unicodedata.category(c) == "Cn"]
        self.plain |= new.difference(odd)
        if not odd:
            return text
        from tokenizers.pre_tokenizers import ByteLevel

        for c in odd:
            ends = [b for _, (_, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(f"a{c}1")]
            self.stands[ord(c)] = "a" if ends[0] == 2 else "1" if 1 in ends and 2 not in ends else "!"
        return text.translate(self.stands)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word that is held whole: of the pairs with the least rank the leftmost, until there is none."""
        sym = [self.byte[b] for b in word]
        rank, base = self.rank, self.base
        if len(sym) < 24:
            while len(sym) > 1:
                found = [rank.get(a * base + b, 1 << 30) for a, b in zip(sym, sym[1:])]
                best = min(found)
                if best == 1 << 30:
                    break
                k = found.index(best)
                sym[k : k + 2] = [self.merged[best]]
            return sym
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(sym, sym[1:])) if (r := rank.get(a * base + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if sym[k] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            sym[k], sym[j] = self.merged[r], -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (x := rank.get(sym[k] * base + sym[j])) is not None:
                    heapq.heappush(heap, (x, k, sym[k], sym[j]))
            if (i := before[k]) >= 0 and (x := rank.get(sym[i] * base + sym[k])) is not None:
                heapq.heappush(heap, (x, i, sym[i], sym[k]))
        return [s for s in sym if s >= 0]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and special tokens."""
        if self.at_special is None:
            yield text, False
            return
        a = 0
        for hit in self.at_special.finditer(text):
            yield text[a : hit.start()], False
            yield hit[0], True
            a = hit.end()
        yield (text[a:] if a else text), False

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where no merge joins them."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are held whole, one after the other, and how many each has."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym, rank = self.letters[raw], np.full(len(raw), NONE, np.int32)  # rank: of the pair that begins here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.pairs[raw[inner] * 256 + raw[inner + 1]]
        done = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([first, [len(sym)]]))
            best = np.minimum.reduceat(rank, first)
            live = best < NONE
            if not live.all():
                keep = np.repeat(live, size)
                done.append((sym[~keep], word[~keep]))
                sym, word, rank, size, best = sym[keep], word[keep], rank[keep], size[live], best[live]
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))  # equal parts may overlap: every other one
            at = at[(at - np.repeat(at[begins], np.diff(np.concatenate([begins, [len(at)]])))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = NONE
            for left in (at[(at + 1 < len(sym)) & (word[np.minimum(at + 1, len(sym) - 1)] == word[at])], at[(at > 0) & (word[at - 1] == word[at])] - 1):
                rank[left] = self.pair(sym[left], sym[left + 1])
        out, owner = (np.concatenate(x) for x in zip(*done)) if done else (sym, word)
        order = np.argsort(owner, kind="stable")
        return out[order], np.bincount(owner, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Merge pre-tokens not seen before, all together, and remember their ids."""
        out, counts = self.merge_all([w.encode() for w in words])
        n, at = len(self.seen), int(self.start[-1])
        if at + len(out) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(at + 2 * len(out), np.int32)])
        self.flat[at : at + len(out)] = out
        self.start = np.concatenate([self.start, at + np.cumsum(counts)])
        self.seen.update(zip(words, range(n, n + len(words))))

    def parts(self, text: str) -> Iterator[list[str] | list[int]]:
        """A text in order: lists of short pre-tokens, of about a block at most, and lists of ids that are stable already."""
        for stretch, special in self.segments(text):
            if special:
                yield [self.special[stretch]]
                continue
            shape = self.classed(stretch)
            a = 0
            while a < len(stretch):
                edge = self.edge.search(shape, a + BLOCK) if len(stretch) - a > BLOCK else None
                b = edge.start() if edge else len(stretch)
                if shape is stretch and b - a <= 4 * BLOCK:
                    yield from self.short(self.pieces.findall(stretch, a, b))
                else:  # no white space for long, or characters to be classed
                    few: list[str] = []
                    for hit in self.pieces.finditer(shape, a, b):
                        if hit.end() - hit.start() > SHORT:
                            yield few
                            few = []
                            yield from self.windows(stretch, hit.start(), hit.end())
                        else:
                            few.append(stretch[hit.start() : hit.end()])
                            if len(few) >= BLOCK // 4:
                                yield few
                                few = []
                    yield few
                a = b

    def short(self, words: list[str]) -> Iterator[list[str] | list[int]]:
        """The words, long ones by windows."""
        if max(map(len, words), default=0) <= SHORT:
            yield words
            return
        a = 0
        for k, w in enumerate(words):
            if len(w) > SHORT:
                yield words[a:k]
                yield from self.windows(w, 0, len(w))
                a = k + 1
        yield words[a:]

    def windows(self, text: str, a: int, b: int) -> Iterator[list[int]]:
        """Ids of the pre-token at a to b as they become stable."""
        window = Transducer(self)
        for k in range(a, b, STEP):
            yield window.feed(text[k : min(k + STEP, b)].encode())
        yield window.finish()

    def encode(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, further ids of it), texts in order. Words of about a block of text are looked up at once."""
        held: list[tuple[int, list[str] | list[int]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if part:
                    held.append((i, part))
                    size += len(part)
                if size >= BLOCK // 4:
                    yield from self.looked_up(held)
                    held, size = [], 0
        yield from self.looked_up(held)

    def looked_up(self, held: list[tuple[int, list[str] | list[int]]]) -> Iterator[tuple[int, list[int]]]:
        words = [p for _, p in held if isinstance(p[0], str)]
        if len(self.seen) > MEMORY:
            self.forget()
        new = set().union(*words).difference(self.seen)
        if new:
            self.learn(sorted(new))
        for i, part in held:
            if isinstance(part[0], int):
                yield i, part
                continue
            k = np.fromiter(map(self.seen.__getitem__, part), np.int64, len(part))
            a = self.start[k]
            n = self.start[k + 1] - a
            yield i, self.flat[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tolist()

    def text(self, ids: list[int]) -> str:
        back = Decoder(self)
        return "".join([back.feed(ids[k : k + STEP]) for k in range(0, len(ids), STEP)]) + back.finish()

    def ids(self, text: str) -> list[int]:
        return [i for _, run in self.encode([text]) for i in run]


class Transducer:
    """Bytes of one pre-token in, ids out as soon as they are stable; holds one step and the lookahead at most."""

    def __init__(self, model: ByteModel) -> None:
        self.model, self.held = model, b""
        self.wait = model.lookahead + model.longest

    def feed(self, more: bytes) -> list[int]:
        self.held += more
        if len(self.held) <= 2 * self.wait:  # too few stable bytes to be worth a pass
            return []
        out, end, final = [], 0, len(self.held) - self.model.lookahead
        for i in self.model.merge(self.held):
            size = len(self.model.surface[i])
            if end + size > final:
                break
            out.append(i)
            end += size
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.model.merge(self.held), b""
        return out


class Decoder:
    """Ids in, text out; an unfinished character waits for its next bytes."""

    def __init__(self, model: ByteModel) -> None:
        self.model, self.state = model, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """What of the text is certain; ids that the file does not know add nothing."""
        surface = self.model.surface
        try:
            return self.state.decode(b"".join(map(surface.__getitem__, ids)))
        except KeyError:
            return self.state.decode(b"".join([surface.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_models: dict[str, ByteModel] = {}


def model(path: str) -> ByteModel:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = ByteModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every row; the general interface."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            got: list[list[int]] = [[] for _ in range(len(b))]
            for i, ids in m.encode([t or "" for t in b["text"]]):
                got[i].extend(ids)
            yield pd.DataFrame({"doc_id": pd.array(b["doc_id"], "Int64"), "ids": got, "decoded": [m.text(x) for x in got]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row's ids (null: none); ids that the file does not know add nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": pd.array(b["doc_id"], "Int64"), "text": [m.text([] if x is None else list(x)) for x in b["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded text go to the digests as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            got = [(hashlib.sha256(), hashlib.sha256(), Decoder(m)) for _ in range(len(b))]
            n = [0] * len(b)
            for i, ids in m.encode([t or "" for t in b["text"]]):
                written, decoded, back = got[i]
                written.update(("," * (n[i] > 0) + ",".join(map(m.name.__getitem__, ids))).encode())
                decoded.update(back.feed(ids).encode())
                n[i] += len(ids)
            for _, decoded, back in got:
                decoded.update(back.finish().encode())
            yield pd.DataFrame({"doc_id": pd.array(b["doc_id"], "Int64"), "n_tokens": n, "ids_sha256": [g[0].hexdigest() for g in got], "decoded_sha256": [g[1].hexdigest() for g in got]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
