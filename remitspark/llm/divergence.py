"""Source divergence audit: how far the words of each source of a language lie from those of the others and of the whole.

**Chunk factorization.** Texts are taken apart at ASCII white space, which no term crosses. A task counts the chunks of its
documents block by block and hands on one row a chunk of a block: how often each group has it, and up to ``LEAST_DOCS``
documents of each language that do. Rows of a chunk meet in one place, where they are added up; so each chunk that occurs
anywhere is split into its terms once, and its counts go on under each of its terms, which joins the terms back without
another copy of the counts. Rows of a term are added up in the same way: occurrences by group, and different documents by
language. Whether a term has ``LEAST_DOCS`` different documents is exact: where a chunk has fewer, all of them are carried,
and where it has as many, those it carries suffice. A chunk has at most one row a block, so that no chunk or term holds a
large share of the rows; what a task holds of one is bounded by the number of groups.

**Divergence.** With p and q in parts of 10^9 as the audit's smoothed shares, f = floor((p - q)^2 / q) a term. Terms that
neither of two sources has add the same f each, so their number suffices; terms that one source alone has are summed up by
their count in it; only terms that both have are joined. All is integer arithmetic.

Cases: null text, language and source count as empty; every row is a document, repeated rows and null or repeated doc_ids
included; a group without terms has rows against the other sources of its language, with value 0 if the language keeps no
term; a lone source has no ``pair`` rows; an empty table gives an empty result; long texts are blocks of their own; extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch

#: A term: letters A to Z of either case and all characters beyond ASCII; chunks hold whole terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text after which a block ends, rows of a batch handed on, bytes of counts added up at once.
BLOCK_BYTES, BATCH, HELD = 24_000_000, 20_000, 8_000_000
#: Parts that shares are counted in, the documents a kept term needs, and the ranks of terms reported.
WHOLE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: What a row carries: occurrences by language and group, and some documents by language.
COUNT, DOC = np.dtype([("l", "<i8"), ("g", "<i8"), ("n", "<i8")]), np.dtype([("l", "<i8"), ("d", "<i8")])
ROW = "word binary, counts binary, docs binary"


def binaries(owner: np.ndarray, entries: np.ndarray, rows: int) -> pa.Array:
    """A binary value for each of so many rows: the entries that it owns, owners ascending."""
    ends = np.searchsorted(owner, np.arange(rows + 1)) * entries.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(entries))])


def starts(*keys: np.ndarray) -> np.ndarray:
    """Places where one of the sorted keys changes."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def ranks(first: np.ndarray, n: int) -> np.ndarray:
    """Of n places the distance to the start of their run."""
    return np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))


def batches_of(words: list[bytes], c_owner: np.ndarray, counts: np.ndarray, d_owner: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(words), BATCH):
        part = words[a : a + BATCH]
        c, d = (slice(*np.searchsorted(o, [a, a + len(part)])) for o in (c_owner, d_owner))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), binaries(c_owner[c] - a, counts[c], len(part)), binaries(d_owner[d] - a, docs[d], len(part))], ["word", "counts", "docs"])


def block_counts(parts: list[np.ndarray], groups: list[tuple[int, int]], base: int, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of a block from its documents' chunk numbers, their (language, group), and the number of the first document."""
    k = len(parts)
    of = np.array(groups, np.int64).reshape(k, 2)
    order = np.lexsort((of[:, 1], of[:, 0]))  # documents by group, so that chunk and document sort by group too
    place = np.empty(k, np.int64)
    place[order] = np.arange(k)
    key, n = np.unique(np.concatenate(parts).astype(np.int64) * k + np.repeat(place, [len(p) for p in parts]), return_counts=True)
    if not len(key):
        return
    chunk, doc = key // k, key % k
    l, g = of[order, 0][doc], of[order, 1][doc]
    at = starts(chunk, l, g)
    counts = np.empty(len(at), COUNT)
    counts["l"], counts["g"], counts["n"] = l[at], g[at], np.add.reduceat(n, at)
    few = np.flatnonzero(ranks(starts(chunk, l), len(key)) < LEAST_DOCS)
    docs = np.empty(len(few), DOC)
    docs["l"], docs["d"] = l[few], base + order[doc[few]]
    yield from batches_of(words, chunk[at], counts, chunk[few], docs)


def chunk_counts(texts: DataFrame) -> DataFrame:
    """word (a chunk), counts, docs of texts(text, l, g), one row a chunk of a block: documents of one task, no further one
    once they have BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        number, parts, groups, size = defaultdict(count().__next__), [], [], 0
        for b in batches:
            for raw, *group in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("l").to_pylist(), b.column("g").to_pylist()):
                words = raw.split()  # of bytes: at ASCII white space alone
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                groups.append(tuple(group))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from block_counts(parts, groups, base, list(number))
                    base += len(parts)
                    number, parts, groups, size = defaultdict(count().__next__), [], [], 0
        if parts:
            yield from block_counts(parts, groups, base, list(number))

    return texts.select("text", "l", "g").mapInArrow(run, ROW)


class Rows:
    """Rows of words, equal words next to each other, added up word by word."""

    def __init__(self, words: list[bytes], counts: list[bytes], docs: list[bytes]) -> None:
        run = np.cumsum(np.fromiter((a != b for a, b in zip(words[1:], words)), np.int64, len(words) - 1))
        run = np.concatenate([[0], run])
        self.words = [words[i] for i in starts(run)]
        flat = lambda x, kind: (np.repeat(run, [len(b) // kind.itemsize for b in x]), np.frombuffer(b"".join(x), kind))
        owner, c = flat(counts, COUNT)
        by = np.lexsort((c["g"], c["l"], owner))
        owner, c = owner[by], c[by]
        at = starts(owner, c["l"], c["g"]) if len(c) else np.zeros(0, np.int64)
        self.c_owner, self.counts = owner[at], c[at]
        if len(c):
            self.counts["n"] = np.add.reduceat(c["n"], at)
        owner, d = flat(docs, DOC)
        by = np.lexsort((d["d"], d["l"], owner))
        owner, d = owner[by], d[by]
        at = starts(owner, d["l"], d["d"]) if len(d) else np.zeros(0, np.int64)
        owner, d = owner[at], d[at]
        if len(d):
            few = ranks(starts(owner, d["l"]), len(d)) < LEAST_DOCS
            owner, d = owner[few], d[few]
        self.d_owner, self.docs = owner, d

    def last(self) -> tuple[bytes, bytes, bytes]:
        """The last word's row, which may go on in the next batch."""
        k = len(self.words) - 1
        return self.words[k], self.counts[self.c_owner == k].tobytes(), self.docs[self.d_owner == k].tobytes()

    def but_last(self) -> Rows:
        k = len(self.words) - 1
        self.words.pop()
        c, d = np.searchsorted(self.c_owner, k), np.searchsorted(self.d_owner, k)
        self.c_owner, self.counts, self.d_owner, self.docs = self.c_owner[:c], self.counts[:c], self.d_owner[:d], self.docs[:d]
        return self


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Whole words of a task's sorted rows; of a word that goes on, its sum so far is carried."""
    words, counts, docs, size = [], [], [], 0
    for b in batches:
        got = [b.column(k).to_pylist() for k in range(3)]
        words += got[0]
        counts += got[1]
        docs += got[2]
        size += b.nbytes
        if size >= HELD:
            rows = Rows(words, counts, docs)
            words, counts, docs = ([x] for x in rows.last())
            size = len(counts[0]) + len(docs[0])
            yield rows.but_last()
    if words:
        yield Rows(words, counts, docs)


def whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in added(batches):
        yield from batches_of(r.words, r.c_owner, r.counts, r.d_owner, r.docs)


def kept_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group of the terms that a language has in enough documents."""
    for r in added(batches):
        at = starts(r.d_owner, r.docs["l"]) if len(r.docs) else np.zeros(0, np.int64)
        enough = at[np.diff(np.concatenate([at, [len(r.docs)]])) >= LEAST_DOCS]
        own = np.empty(len(enough), [("w", "<i8"), ("l", "<i8")])
        own["w"], own["l"] = r.d_owner[enough], r.docs["l"][enough]
        mine = np.empty(len(r.counts), own.dtype)
        mine["w"], mine["l"] = r.c_owner, r.counts["l"]
        keep = np.flatnonzero(np.isin(mine, own))
        for a in range(0, len(keep), BATCH):
            k = keep[a : a + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(r.counts["l"][k]), pa.array(r.counts["g"][k]), pa.array([r.words[i].decode() for i in r.c_owner[k].tolist()]), pa.array(r.counts["n"][k])], ["l", "g", "term", "n"])


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """word (a term), counts, docs: each chunk's row under each of its terms, as often as it holds them."""
    text = F.translate(F.col("word").cast("string"), UPPER, LOWER)
    rows = chunks.select(F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("word"), "counts", "docs")
    return rows.withColumn("word", F.col("word").cast("binary"))


def named(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """texts(text, l, g) with numbers for language and group, and groups(lang, source, l, g). Numbers are hashes under the
    first seed that gives different groups different ones."""
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = scratch.save(d.select("lang", "source").distinct())
    for seed in count():
        l, g = F.xxhash64("lang", F.lit(seed)).alias("l"), F.xxhash64("lang", "source", F.lit(seed)).alias("g")
        found = groups.select("lang", l, g)
        n, ls, gs, langs = found.agg(F.count("*"), F.count_distinct("l"), F.count_distinct("g"), F.count_distinct("lang")).first()
        if (n, langs) == (gs, ls):
            return d.select("text", l, g), groups.select("lang", "source", l, g)


def term_counts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """kept(l, g, term, n): occurrences in a group of each term that its language keeps; and groups(lang, source, l, g)."""
    texts, groups = named(docs, scratch)
    chunks = chunk_counts(texts).repartition("word").sortWithinPartitions("word").mapInArrow(whole_chunks, ROW)
    terms = chunk_terms(chunks).repartition("word").sortWithinPartitions("word")
    return scratch.save(terms.mapInArrow(kept_terms, "l long, g long, term string, n long")), groups


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(WHOLE (count + 1) / (total + kinds)); beyond the reach of 64 bits in decimals."""
    return 1 + F.call_function("div", (count + 1).cast("decimal(25,0)") * F.lit(WHOLE).cast("decimal(10,0)"), (total + kinds).cast("decimal(20,0)"))


def f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): p and q are at most WHOLE + 1, so that squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank; see the module's text for what they are."""
    scratch = Scratch(docs.sparkSession, "divergence")
    found, groups = term_counts(docs, scratch)
    whole = scratch.save(found.groupBy("l", "term").agg(F.sum("n").alias("all_n")))
    langs = whole.groupBy("l").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("kinds"))
    sums = found.groupBy("l", "g").agg(F.sum("n").alias("total"))
    groups = groups.join(sums, ["l", "g"], "left").join(langs, "l", "left").na.fill(0, ["total", "all_total", "kinds"])
    empty = F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds")))  # share of a term that the group lacks
    groups = scratch.save(groups.withColumn("p0", empty))
    kept = found.join(whole, ["l", "term"]).join(groups, ["l", "g"])
    shares = scratch.save(kept.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("kinds")).alias("whole"), "p0"))
    return pairs(groups, shares).unionByName(terms(shares))


def terms(shares: DataFrame) -> DataFrame:
    """The terms that a group has above its language's share, TOP of them by value."""
    t = shares.where(F.col("p") > F.col("whole")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("whole")).alias("value"))
    return ranked(t).where(F.col("rank") <= TOP)


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Each source against each other one of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = groups.join(other, "lang").where(F.col("source") != F.col("item"))  # the rows of the result
    base = both.select("lang", "source", "item", F.when(F.col("kinds") > 0, F.col("kinds") * f(F.col("p0"), F.col("q0"))).otherwise(0).alias("v"))
    # terms of one side, by their share there: f against the other side's absent share, less what base has for them
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("c"))
    ours = alike.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", (F.col("c") * (f(F.col("p"), F.col("q0")) - f(F.col("p0"), F.col("q0")))).alias("v"))
    theirs = alike.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("c") * (f(F.col("q0"), F.col("p")) - f(F.col("q0"), F.col("p0")))).alias("v"))
    # terms that both have: their own f, less what the three sums above have for them
    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    own = f(F.col("p"), F.col("q")) - f(F.col("p"), F.col("q0")) - f(F.col("p0"), F.col("q")) + f(F.col("p0"), F.col("q0"))
    common = a.join(b, ["lang", "term"]).where(F.col("source") != F.col("item")).select("lang", "source", "item", own.alias("v"))
    parts = [t.groupBy("lang", "source", "item").agg(F.sum("v").alias("v")) for t in (ours, theirs, common)]
    for t in parts:
        base = base.unionByName(t)
    t = base.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    return ranked(t.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def ranked(t: DataFrame) -> DataFrame:
    """Ranks in a group by value from the largest, equal ones by item."""
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return t.withColumn("rank", F.row_number().over(order))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
