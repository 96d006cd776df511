"""Substring dedup over words: seed and extend on winnowed anchors.

Texts are joined on the k-grams of their winnowed anchors. Each shared seed is extended both ways: where all that
its windows can hold recurs as a whole, they are repeats; at the ends of matches, where it does not, each window
of ``length`` words around the seed is tried, and a match extends over it exactly if its 128-bit hash occurs at
another place too. Extensions are compared by group, never pair by pair, so that a passage in thousands of
documents costs its occurrences, not their square. Runs of repeated windows are the maximal repeats of at least
``length`` words; their words go.

Cases: null and empty texts have no words; texts shorter than ``length`` words lose nothing, copies or not;
copies of a longer text lose everything, each copy; repeated rows are copies; a null doc_id is a row like any
other; an empty table gives an empty result; extra columns are ignored. Long texts are one task's work, at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch, text_key
from remitspark.llm.seeds import BASES, Rolling, anchors, copies, gathered, repeated, second, texts_with_seeds, units

LENGTH, GRAM = 35, 15


def runs_to_mask(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Units covered by windows of the given length."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d)[:n] > 0


def seed_contexts(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(t, j, seed, ctx): the j-th anchor of a text, if its seed is shared, and the hash of all words that a window
    with this anchor can hold: the seed extended both ways as far as it may matter."""
    w = length - gram + 1

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for t, text, seeds in zip(batch["t"].tolist(), batch["text"], batch["seeds"]):
                v = units(text, "words")
                r = Rolling(v)
                _, _, a, h = anchors(r, np.array([len(v)]), gram, w)
                j = np.flatnonzero(np.isin(a, np.asarray(seeds, np.int64)))
                lo, hi = np.maximum(a[j] - (w - 1), 0), np.minimum(a[j] + gram + w - 1, len(v))
                ctx = r.hash(lo, hi) + (a[j] - lo).astype(np.uint64)
                yield {"t": np.full(len(j), t), "j": j.astype(np.int32), "seed": h[j].view(np.int64), "ctx": ctx.view(np.int64)}

    return found.select("t", "text", "seeds").mapInPandas(lambda b: gathered(each(b)), "t long, j int, seed long, ctx long")


#: What the contexts of a shared seed say: its windows are to be compared, are known repeats, or both (one place
#: for each context that recurs, to compare the others with).
COMPARE, KNOWN, BOTH = 1, 2, 3


def judged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, marks): anchors with a shared seed and what their contexts say. Joins are of saved tables with one row a key on
    one side, so that Spark splits a frequent key on the other by size."""
    place = F.xxhash64("t", "j")
    same = scratch.save(rows.groupBy("seed", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    kinds = scratch.save(same.groupBy("seed").agg(F.count("*").alias("contexts")))
    same = scratch.save(same.join(kinds, "seed"))
    says = F.when(F.col("contexts") == 1, KNOWN).when(F.col("n") == 1, COMPARE).when(F.col("first") == place, BOTH).otherwise(KNOWN)
    return rows.join(same, ["seed", "ctx"]).groupBy("t").agg(F.collect_list(F.struct("j", says.alias("says"))).alias("marks"))


def windows_by_mark(v: np.ndarray, marks: list, length: int, gram: int) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Starts of windows to compare, and of windows known to be repeated."""
    r = Rolling(v)
    p, of, a, _ = anchors(r, np.array([len(v)]), gram, length - gram + 1)
    says = np.zeros(len(a), np.int64)
    says[[m["j"] for m in marks]] = [m["says"] for m in marks]
    mine = says[np.searchsorted(a, of)]
    return r, p[(mine & COMPARE) > 0], p[(mine & KNOWN) > 0]


def extended_windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, b, t, s): hashes of every window to compare, with its text and start."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for t, text, marks in zip(batch["t"].tolist(), batch["text"], batch["marks"]):
                v = units(text, "words")
                r, s, _ = windows_by_mark(v, marks, length, gram)
                a, b = r.hash(s, s + length), Rolling(second(v), BASES[1]).hash(s, s + length)
                yield {"a": a.view(np.int64), "b": b.view(np.int64), "t": np.full(len(s), t), "s": s.astype(np.int32)}

    return texts.select("t", "text", "marks").mapInPandas(lambda b: gathered(each(b)), "a long, b long, t long, s int")


def removals(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(tk, tn, text, marks, starts): different texts with shared seeds, what their contexts say, and where
    compared windows that are repeated start (null: none)."""
    found = scratch.save(texts_with_seeds(docs, "words", gram, length - gram + 1, scratch))
    scratch.forget()
    contexts = scratch.save(seed_contexts(found, length, gram))
    texts = scratch.save(found.select("t", "tk", "tn", "text").join(judged(contexts, scratch), "t"))
    scratch.drop(found, contexts)
    scratch.forget()
    again = repeated(extended_windows(texts, length, gram), ["a", "b"], [], scratch)
    starts = again.groupBy("t").agg(F.collect_list("s").alias("starts"))
    return texts.join(starts, "t", "left").drop("t")


def word_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "substring")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [(t or "").encode().split() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tk": b["tk"], "tn": b["tn"], "n_words": [len(w) for w in words], "sha": [word_digest(w) for w in words]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tk, tn, text, marks, starts in zip(b["tk"], b["tn"], b["text"], b["marks"], b["starts"]):
                words = text.encode().split()
                _, _, known = windows_by_mark(units(text, "words"), marks, length, gram)
                s = known if starts is None else np.union1d(known, np.asarray(starts, np.int64))
                gone = runs_to_mask(s, length, len(words))
                out.append((tk, tn, int(gone.sum()), word_digest([w for w, g in zip(words, gone.tolist()) if not g])))
            yield pd.DataFrame(out, columns=["tk", "tn", "cut", "cut_sha"])

    work = Scratch(docs.sparkSession, "repeats")
    changed = scratch.save(removals(docs, work, length, gram).mapInPandas(cut, "tk long, tn int, cut long, cut_sha string"))
    work.clear()
    rows = docs.select("doc_id", *text_key(), "text").mapInPandas(plain, "doc_id long, tk long, tn int, n_words long, sha string")
    rows = scratch.save(rows)
    out = rows.join(copies(rows), ["tk", "tn"], "left").join(changed, ["tk", "tn"], "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= length)
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(word_digest([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
