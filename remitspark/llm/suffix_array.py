"""Substring dedup over bytes with a distributed, sampled suffix array.

The difference-cover plan, with a cover that follows the text: the sampled suffixes are those at winnowed anchors
(see ``seeds``). Two equal windows have their anchor at the same place, as two suffixes of a difference cover meet a
sampled suffix at the same distance, so the order of the sampled suffixes decides all others.

1. sample: anchors whose k-gram occurs twice; the k-gram is the first name of a sampled suffix;
2. sort sampled triples: the text that follows, as far as any window can see, is a triple of long characters; the
   different suffixes (equal ones count once) are range-sorted by name and triple over all partitions;
3. compare adjacent prefixes: bytes shared with the suffix before and after; suffixes that share at least D bytes
   form an interval of the order, named by its first suffix, for each depth D that a window can ask for;
4. merge the remaining suffixes: a suffix d bytes before an anchor is known by those d bytes and the interval of
   its anchor at depth ``length`` - d; it is repeated if another has both. Not merged are those that their own anchor
   refutes, those of k-grams that have the same bytes before them everywhere (their interval alone decides), and of
   those that the anchor at or before them proves equal all but the first in the order.

A triple spans all that a window can see, so there are no names left to recurse on: that step of the algorithm for
whole suffixes is not needed here. Equality of k-grams, of whole triples and of leading bytes is that of 64-, 128- and
64-bit hashes; places in the order and depths are compared by byte.

Cases: null and empty texts have no bytes; texts shorter than ``length`` bytes lose nothing, copies or not; copies
of a longer text lose everything, each copy; repeated rows are copies; a null doc_id is a row like any other; an
empty table gives an empty result; extra columns are ignored by ``deduplicated`` and kept by ``cut_repeats``.
Removed runs may cut a UTF-8 character; ``cut_repeats`` then drops the bytes left of it. One text is one task's
work, at most; no group of equal keys is gathered anywhere, and a range of the order may end inside a k-gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch, text_key
from remitspark.llm.seeds import BASES, TABLES, Rolling, anchors, copies, fmix, gathered, repeated, texts_with_seeds

#: The contract's length. PASSAGE: strings of so many bytes, fewer than any likely 50 words have, are reported beside it.
LENGTH, PASSAGE = 400, 200
#: k-grams among which a window's anchor is the smallest; anchors are at most this far apart.
STEP = 101
OPEN = -1


def byte_values(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return TABLES[0][raw], TABLES[1][raw]


class Shape:
    """Sizes that follow from the length: k-gram of an anchor (at most length - STEP + 1), bytes of a sampled suffix that
    matter, its characters."""

    def __init__(self, length: int, gram: int | None = None) -> None:
        self.length, self.gram = length, length - STEP + 1 if gram is None else gram
        self.need = length + STEP
        self.char = -(-(self.need - self.gram) // 3)
        #: depths at which intervals are asked for
        self.depths = np.arange(length - STEP + 1, length)


def sampled(found: DataFrame, shape: Shape) -> DataFrame:
    """(t, pos, seed, c1, c2, left): sampled suffixes with a repeated k-gram, the hash of all that windows can see of
    them, and that of the bytes before them that windows can see."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for b in batches:
            for t, text, seeds in zip(b["t"].tolist(), b["text"], b["seeds"]):
                v1, v2 = byte_values(text)
                a = np.sort(np.asarray(seeds, np.int64))
                end = np.minimum(a + shape.need, len(v1))
                r1 = Rolling(v1)
                c1, c2, seed = r1.hash(a, end), Rolling(v2, BASES[1]).hash(a, end), r1.hash(a, a + shape.gram)
                low = np.maximum(a - (STEP - 1), 0)
                left = r1.hash(low, a) + (a - low).astype(np.uint64)
                yield {"t": np.full(len(a), t), "pos": a.astype(np.int32), "seed": seed.view(np.int64), "c1": c1.view(np.int64), "c2": c2.view(np.int64), "left": left.view(np.int64)}

    return found.select("t", "text", "seeds").mapInPandas(lambda b: gathered(each(b)), "t long, pos int, seed long, c1 long, c2 long, left long")


def triples(found: DataFrame, rows: DataFrame, shape: Shape, scratch: Scratch) -> DataFrame:
    """(seed, x0, x1, x2, c1, c2, shared, alike, t, pos): each different sampled suffix once, its name and triple of
    characters; whether several places have it; whether all places of its k-gram have the same bytes before them; one
    of its places."""
    one = rows.groupBy("c1", "c2", "seed").agg(F.min(F.struct("t", "pos")).alias("m"), (F.count("*") > 1).alias("shared"), F.min("left").alias("lo"), F.max("left").alias("hi"))
    one = scratch.save(one)
    seeds = scratch.save(one.groupBy("seed").agg((F.min("lo") == F.max("hi")).alias("alike")))
    per_text = one.join(seeds, "seed").groupBy("m.t").agg(F.collect_list(F.struct("m.pos", "seed", "c1", "c2", "shared", "alike")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = shape.char
        for b in batches:
            out = []
            for t, text, at in zip(b["t"].tolist(), b["text"], b["at"]):
                raw = text.encode()
                for m in at:
                    s = raw[m["pos"] + shape.gram : m["pos"] + shape.need]
                    out.append((m["seed"], s[:k], s[k : 2 * k], s[2 * k :], m["c1"], m["c2"], m["shared"], m["alike"], t, m["pos"]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = ["seed", "x0", "x1", "x2", "c1", "c2", "shared", "alike", "t", "pos"]
    return found.select("t", "text").join(per_text, "t").mapInPandas(run, "seed long, x0 binary, x1 binary, x2 binary, c1 long, c2 long, shared boolean, alike boolean, t long, pos int")


def in_order(suffixes: DataFrame) -> DataFrame:
    """Sampled suffixes sorted by name and triple over all partitions."""
    return suffixes.orderBy("seed", "x0", "x1", "x2")


def shared_prefixes(seed: np.ndarray, text: np.ndarray, size: np.ndarray, gram: int) -> np.ndarray:
    """Bytes that each row (but the first) shares with the row before it."""
    differ = text[1:] != text[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    return np.where(seed[1:] == seed[:-1], gram + np.minimum(first, np.minimum(size[1:], size[:-1])), 0)


ORDERED = "c1 long, c2 long, mark binary, edge binary"
#: Numbers at the head of a mark: range, bytes shared with the suffix before and after, flags, a place (text, position).
HEAD, SHARED, ALIKE = 6, 1, 2


def marks_of(rows: pd.DataFrame, pid: int, up: np.ndarray, row: np.ndarray, step: np.ndarray) -> list[bytes]:
    """One mark a row: the head, and a number for each step (depth and first row, as ``step_of``); row ascends."""
    n = len(rows)
    size = HEAD + np.bincount(row, minlength=n)
    at = np.cumsum(size) - size
    out = np.empty(size.sum(), np.int64)
    flags = SHARED * rows["shared"].to_numpy(np.int64) + ALIKE * rows["alike"].to_numpy(np.int64)
    for k, x in enumerate((pid, up, np.append(up[1:], -1), flags, rows["t"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64))):
        out[at + k] = x
    first = np.searchsorted(row, np.arange(n))
    out[at[row] + HEAD + np.arange(len(row)) - first[row]] = step
    raw = out.tobytes()
    return [raw[8 * i : 8 * j] for i, j in zip(at.tolist(), (at + size).tolist())]


def step_of(depth: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (depth << 40) + start + 1


def adjacent(batches: Iterator[pd.DataFrame], shape: Shape) -> Iterator[pd.DataFrame]:
    """Marks of one range of the order: bytes shared with both neighbours (-1 beyond the range), and for each depth the
    first row of the interval (``OPEN`` if it may begin in an earlier range), as steps. The last row given has no
    suffix but the edges of the range, for ``joined_edges``."""
    pid, width = TaskContext.get().partitionId(), shape.need - shape.gram
    state = np.full(len(shape.depths), OPEN, np.int64)
    base, last, held, first = 0, None, None, None
    for b in batches:
        if not len(b):
            continue
        raw = [x + y + z for x, y, z in zip(b["x0"], b["x1"], b["x2"])]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in raw), np.uint8).reshape(-1, width)
        seed = b["seed"].to_numpy()
        if last is None:
            first, up = (int(seed[0]), raw[0]), np.concatenate([[-1], shared_prefixes(seed, text, size, shape.gram)])
        else:
            up = shared_prefixes(np.concatenate([[last[0]], seed]), np.vstack([last[1], text]), np.concatenate([[last[2]], size]), shape.gram)
        last = (seed[-1], text[-1], size[-1], raw[-1])
        for i in range(0, len(raw), 2048):
            part, c = up[i : i + 2048], b.iloc[i : i + 2048]
            index = np.arange(base + i, base + i + len(part))
            begins = (part[None, :] < shape.depths[:, None]) & (part[None, :] >= 0)
            starts = np.maximum.accumulate(np.concatenate([state[:, None], np.where(begins, index[None, :], OPEN)], axis=1), axis=1)[:, 1:]
            state = starts[:, -1].copy()
            row, depth = np.nonzero(np.concatenate([np.ones((1, len(part)), bool), starts[1:] != starts[:-1]]).T)
            out = pd.DataFrame({"c1": c["c1"].to_numpy(), "c2": c["c2"].to_numpy(), "mark": marks_of(c, pid, part, row, step_of(shape.depths[depth], starts.T[row, depth])), "edge": None})
            if held is not None:
                mark = np.frombuffer(held["mark"].iloc[0], np.int64).copy()
                mark[2] = part[0]
                held = pd.DataFrame({"c1": held["c1"].to_numpy(), "c2": held["c2"].to_numpy(), "mark": [mark.tobytes()], "edge": None})
                yield pd.concat([held, out.iloc[:-1]], ignore_index=True)
            else:
                yield out.iloc[:-1]
            held = out.iloc[-1:]
        base += len(raw)
    if held is not None:
        yield held
        head = np.array([pid, first[0], last[0], len(first[1]), len(last[3])], np.int64).tobytes()
        yield pd.DataFrame({"c1": [0], "c2": [0], "mark": [None], "edge": [head + state.tobytes() + first[1] + last[3]]})


def joined_edges(ordered: DataFrame, shape: Shape) -> dict[int, tuple[int, int, np.ndarray | None]]:
    """For each range of the order: bytes its first and last suffix share with the ranges beside it, and the intervals
    that its open ones belong to. One row of a few kilobytes a range; texts, names and suffixes stay where they are."""
    n = len(shape.depths)
    ranges = []
    for r in ordered.where("edge is not null").select("edge").collect():
        e = bytes(r.edge)
        pid, s0, s1, n0, n1 = np.frombuffer(e[:40], np.int64).tolist()
        rest = e[40 + 8 * n :]
        ranges.append((pid, s0, rest[:n0], s1, rest[n0 : n0 + n1], np.frombuffer(e[40 : 40 + 8 * n], np.int64)))
    ranges.sort(key=lambda r: r[0])
    out: dict[int, tuple[int, int, np.ndarray | None]] = {}
    before = None
    for pid, s0, x0, s1, x1, state in ranges:
        shared, mine = 0, None
        if before is not None and before[1] == s0:
            common = min(len(before[2]), len(x0))
            a, b = np.frombuffer(before[2][:common], np.uint8), np.frombuffer(x0[:common], np.uint8)
            differ = np.flatnonzero(a != b)
            shared = shape.gram + (int(differ[0]) if len(differ) else common)
            mine = np.where(shape.depths <= shared, before[3], np.int64(pid) << 33)
        if before is not None:
            out[before[0]] = (out[before[0]][0], shared, out[before[0]][2])
        out[pid] = (shared, 0, mine)
        whole = np.where(state == OPEN, (np.int64(pid) << 33) if mine is None else mine, (np.int64(pid) << 33) + state)
        before = (pid, s1, x1, whole)
    return {k: v for k, v in out.items() if v[0] or v[1]}


def suffix_order(found: DataFrame, rows: DataFrame, shape: Shape, scratch: Scratch) -> tuple[DataFrame, dict]:
    own = Scratch(scratch.spark, "order")
    ordered = scratch.save(in_order(own.save(triples(found, rows, shape, own))).mapInPandas(lambda b: adjacent(b, shape), ORDERED))
    own.clear()
    return ordered, joined_edges(ordered, shape)


def intervals(flat: np.ndarray, at: np.ndarray, end: np.ndarray, shape: Shape, edges: dict) -> tuple[np.ndarray, np.ndarray]:
    """For anchors whose marks lie at [at, end) of ``flat``: (anchor << 12) + depth of every step, ascending, and the
    interval that begins there."""
    n = end - at - HEAD
    k = np.repeat(np.arange(len(at)), n)
    steps = flat[np.repeat(at + HEAD, n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)]
    depth, start = steps >> 40, (steps & ((1 << 40) - 1)) - 1
    base = flat[at[k]] << 33
    key, place = (k << 12) + depth, base + start
    open_ = np.flatnonzero(start == OPEN)
    if not len(open_):
        return key, place
    # shallow intervals begin where the ranges before say
    more_key, more_place = [np.delete(key, open_)], [np.delete(place, open_)]
    for i in open_.tolist():
        last = depth[i + 1] if i + 1 < len(k) and k[i + 1] == k[i] else shape.depths[-1] + 1
        deep = shape.depths[: last - shape.depths[0]]
        mine = edges.get(int(base[i] >> 33), (0, 0, None))[2]
        more_key.append((k[i] << 12) + deep)
        more_place.append(np.full(len(deep), base[i]) if mine is None else mine[: len(deep)])
    key, place = np.concatenate(more_key), np.concatenate(more_place)
    order = np.argsort(key, kind="stable")
    return key[order], place[order]


def window_starts(n: int, length: int, r1: Rolling, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a text's windows, the anchor of each, and all anchors."""
    p, of, a, _ = anchors(r1, np.array([n]), gram, STEP)
    fits = p + length <= n
    return p[fits], of[fits], a


def decided(t: int, text: str, marks: list, shape: Shape, edges: dict) -> tuple[np.ndarray, ...]:
    """Starts of windows that the order proves; starts of those to merge, their leading bytes' hash, the interval of
    their anchor; sampled suffixes and the bytes each shares with another."""
    v1, _ = byte_values(text)
    n, r1 = len(v1), Rolling(v1)
    p, of, a = window_starts(n, shape.length, r1, shape.gram)
    marks = sorted(marks, key=lambda m: m["pos"])
    pos, blobs = np.array([m["pos"] for m in marks], np.int64), [m["mark"] for m in marks]
    flat = np.frombuffer(b"".join(blobs), np.int64)
    end = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8)
    at = np.concatenate([[0], end[:-1]])
    up, down, flags = flat[at + 1].copy(), flat[at + 2].copy(), flat[at + 3]
    for side, k in ((up, 0), (down, 1)):
        for i in np.flatnonzero(side < 0).tolist():
            side[i] = edges.get(int(flat[at[i]]), (0, 0, None))[k]
    shared = (flags & SHARED) > 0
    # by anchor of the text; -1 (no anchor) shares nothing
    above, best = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
    later, alike, mark = np.zeros(len(a) + 1, bool), np.zeros(len(a) + 1, bool), np.zeros(len(a) + 1, np.int64)
    j = np.searchsorted(a, pos)
    above[j], best[j] = up, np.where(shared, shape.need, np.maximum(up, down))
    later[j], alike[j], mark[j] = shared & ((flat[at + 4] != t) | (flat[at + 5] != pos)), (flags & ALIKE) > 0, np.arange(len(j))
    z, own, d = np.searchsorted(a, p, "right") - 1, np.searchsorted(a, of), of - p
    reach = p - a[z] + shape.length
    can = (d > 0) & (best[own] >= shape.length - d)
    proven = ((z >= 0) & (best[z] >= reach)) | (can & alike[own])
    ask = can & ~alike[own] & ~((z >= 0) & ((above[z] >= reach) | later[z]))
    s, deep = p[ask], shape.length - d[ask]
    mine, k = np.unique(mark[own[ask]], return_inverse=True)
    key, place = intervals(flat, at[mine], end[mine], shape, edges)
    place = place[np.searchsorted(key, (k << 12) + deep, "right") - 1] if len(s) else np.zeros(0, np.int64)
    return p[proven], s, fmix(r1.hash(s, of[ask]) + deep.astype(np.uint64)), place, pos, np.minimum(best[j], n - pos)


def as_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending starts as runs [from, to)."""
    if not len(s):
        return s, s
    new = np.flatnonzero(np.diff(s) > 1)
    return s[np.concatenate([[0], new + 1])], s[np.concatenate([new, [len(s) - 1]])] + 1


#: What a row says: windows that start in [s, e) are repeated; bytes [s, e) occur elsewhere too.
WINDOWS, BYTES = 0, 1


def merged_windows(texts: DataFrame, shape: Shape, edges: dict) -> DataFrame:
    """(a, b, t, kind, s, e): windows to merge by leading bytes (a) and interval (b); and what the order shows by itself
    (b is -1): runs of windows, and bytes that sampled suffixes share."""
    held = texts.sparkSession.sparkContext.broadcast(edges)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for t, text, marks in zip(batch["t"].tolist(), batch["text"], batch["marks"]):
                known, s, a, b, pos, shared = decided(t, text, marks, shape, held.value)
                (x, y), (u, v) = as_runs(known), united(pos, pos + shared)
                k = len(x) + len(u)
                yield {
                    "a": np.concatenate([np.zeros(k, np.int64), a.view(np.int64)]), "b": np.concatenate([np.full(k, -1), b]), "t": np.full(k + len(s), t),
                    "kind": np.repeat([WINDOWS, BYTES, WINDOWS], [len(x), len(u), len(s)]).astype(np.int32),
                    "s": np.concatenate([x, u, s]).astype(np.int32), "e": np.concatenate([y, v, s + 1]).astype(np.int32),
                }

    return texts.mapInPandas(lambda b: gathered(each(b)), "a long, b long, t long, kind int, s int, e int")


def united(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges with ascending starts, those that touch made one."""
    if not len(s):
        return s, e
    upto = np.maximum.accumulate(e)
    new = np.concatenate([[True], s[1:] > upto[:-1]])
    return s[new], upto[np.append(new[1:], True)]


def repeats(docs: DataFrame, scratch: Scratch, shape: Shape) -> DataFrame:
    """(tk, tn, text, runs): different texts with a sampled suffix that occurs twice, and runs (kind, s, e)."""
    found = scratch.save(texts_with_seeds(docs, "bytes", shape.gram, STEP, scratch))
    scratch.forget()
    rows = scratch.save(sampled(found, shape))
    ordered, edges = suffix_order(found, rows, shape, scratch)
    scratch.forget()
    marks = rows.drop("seed", "left").join(ordered.where("edge is null").drop("edge"), ["c1", "c2"]).groupBy("t").agg(F.collect_list(F.struct("pos", "mark")).alias("marks"))
    windows = scratch.save(merged_windows(found.select("t", "text").join(marks, "t"), shape, edges))
    scratch.drop(rows, ordered)
    scratch.forget()
    # bytes before the anchor and the interval at its depth: two such windows are equal
    again = repeated(windows.where("b >= 0"), ["a", "b"], [], scratch)
    runs = windows.where("b < 0").unionByName(again).groupBy("t").agg(F.collect_list(F.struct("kind", "s", "e")).alias("runs"))
    return found.select("t", "tk", "tn", "text").join(runs, "t").drop("t")


def covered(runs: list, kind: int, length: int, n: int) -> np.ndarray:
    """Bytes that windows of a length, or ranges, cover."""
    d = np.zeros(n + 1, np.int64)
    s, e = (np.array([r[c] for r in runs if r["kind"] == kind], np.int64) for c in "se")
    np.add.at(d, s, 1)
    np.add.at(d, e + (length - 1 if kind == WINDOWS else 0), -1)
    return np.cumsum(d)[:n] > 0


def deduplicated(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for ``length``; n_passage: bytes of strings of
    ``passage`` bytes and more that begin at a sampled place and begin elsewhere too (of a longer repeat up to STEP - 1
    bytes at its left end are not counted). Those are reported and stay, unless ``length`` removes them."""
    scratch = Scratch(docs.sparkSession, "suffix")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tk, tn, text, runs in zip(b["tk"], b["tn"], b["text"], b["runs"]):
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = covered(runs, WINDOWS, length, len(raw))
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out.append((tk, tn, int(gone.sum()), spans, int(covered(runs, BYTES, length, len(raw)).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["tk", "tn", "cut", "spans", "seen", "cut_sha"])

    work = Scratch(docs.sparkSession, "repeats")
    changed = scratch.save(repeats(docs, work, Shape(length, min(passage, length - STEP + 1))).mapInPandas(cut, "tk long, tn int, cut long, spans long, seen long, cut_sha string"))
    work.clear()
    rows = scratch.save(docs.select("doc_id", *text_key(), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")))
    out = rows.join(scratch.save(copies(rows)), ["tk", "tn"], "left").join(changed, ["tk", "tn"], "left")
    again, size = F.coalesce("copied", F.lit(False)), F.col("tn").cast("long")
    whole = again & (size >= length)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", size.alias("n_bytes"),
        F.when(whole, size).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(again & (size >= passage), size).otherwise(F.coalesce("seen", F.lit(0))).alias("n_passage"),
    )


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every repeated string of ``length`` bytes cut from text, in all its places (n_chars follows); rows and
    columns stay."""
    scratch = Scratch(docs.sparkSession, "suffix")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tk, tn, text, runs in zip(b["tk"], b["tn"], b["text"], b["runs"]):
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = covered(runs, WINDOWS, length, len(raw))
                if gone.any():
                    out.append((tk, tn, raw[~gone].tobytes().decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["tk", "tn", "kept_"])

    work = Scratch(docs.sparkSession, "repeats")
    changed = scratch.save(repeats(docs.select("text"), work, Shape(length)).mapInPandas(cut, "tk long, tn int, kept_ string"))
    work.clear()
    keys = docs.select(*text_key())
    whole = copies(keys).where(F.col("tn") >= length).select("tk", "tn", F.lit("").alias("kept_"))
    new = scratch.save(whole.unionByName(changed.join(whole.select("tk", "tn"), ["tk", "tn"], "left_anti")))
    scratch.drop(changed)
    scratch.forget()
    tk, tn = text_key()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), tk, tn)
    out = d.join(new, ["tk", "tn"], "left")
    text = F.when(F.col("kept_").isNotNull(), F.col("kept_")).otherwise(F.col("d.text"))
    chars = F.when(F.col("kept_").isNotNull(), F.char_length("kept_")).otherwise(F.col("d.n_chars")) if "n_chars" in docs.columns else None
    new_cols = {"text": text, "n_chars": chars.cast("long") if chars is not None else None}
    return out.select(*[(new_cols[c] if c in new_cols else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 400 bytes; n_passage beside it says what repeats of about 50 words, which may be shorter, would cover."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
