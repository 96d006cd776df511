"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence has probability p = sigmoid(sum of its words' weights + bias), and
the document is toxic unless every sentence is clean: 1 - prod(1 - p) (noisy-or). Only document labels are
known; the weights are fitted to them, and afterwards the sentences' own p locate what offends. A word's weight
is the sum over its hashed features (the word, and its beginnings), so that unseen forms of a known stem count
too.

The classifier is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` documents of each label and ``BYTES``
of text, the first by a hash of doc_id that fit, each id once, weighted back to the labels' true shares. Rows whose crc32(doc_id) mod 4 is 2 are
never learnt from. Labels, lang, source and doc_id are no inputs of a score. Scoring covers every document.

Cases: a null or empty text has no sentence and scores like one empty sentence; repeated rows score alike; labels
that are null are not learnt from; without labels of both kinds every score is the share of label 1; an empty
table gives an empty result; extra columns are ignored (``reject_toxic`` keeps them); long texts are whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most documents of each label in the training sample, and most bytes of their texts together.
SAMPLE, BYTES = 3000, 16 << 20
#: Hashed features, and the lengths of the beginnings.
DIM, PREFIXES = 1 << 20, (3, 4, 5, 6)
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[.!?\n]+")
ENDS = ".!?\n"


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    out = {crc32(b"=" + word.encode()) % DIM}
    out.update(crc32(b"^%d" % n + word[:n].encode()) % DIM for n in PREFIXES if len(word) > n)
    return sorted(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    """Sparse weights of the features that are not zero, and the sentences' bias."""

    weights: dict[int, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            get = self.weights.get
            got = self.cache[w] = float("nan") if w[0] in ENDS else sum(get(f, 0.0) for f in features(w))
        return got

    def sentences(self, text: str) -> np.ndarray:
        """p of each sentence that has a word; of one empty sentence, if none has."""
        tokens = TOKEN.findall(text.lower())
        z = np.fromiter(map(self.word, tokens), np.float64, len(tokens))
        stop = np.isnan(z)
        z[stop] = 0
        number = np.cumsum(stop)
        words = np.bincount(number, ~stop, number[-1] + 1) if len(z) else np.zeros(1)
        sums = np.bincount(number, z, number[-1] + 1) if len(z) else np.zeros(1)
        sums = sums[words > 0] if (words > 0).any() else np.zeros(1)
        return sigmoid(sums + self.bias)

    def score(self, text: str | None) -> float:
        p = np.minimum(self.sentences(text or ""), 1 - 1e-12)
        return float(-np.expm1(np.log1p(-p).sum()))


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.1, l2: float = 2e-5) -> Model:
    """Full-batch Adam on the noisy-or likelihood of document labels."""
    y = np.asarray(labels, float)
    share = float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    ids: dict[str, int] = {}
    word, sent, doc_of = array("i"), array("i"), array("i")  # compact: millions of words pass here
    s = -1
    for d, t in enumerate(texts):
        s += 1
        doc_of.append(d)
        open_ = False
        for k in TOKEN.findall(t.lower()):
            if k[0] in ENDS:
                if open_:
                    s += 1
                    doc_of.append(d)
                    open_ = False
            else:
                word.append(ids.setdefault(k, len(ids)))
                sent.append(s)
                open_ = True
        if not open_ and len(doc_of) > 1 and doc_of[-2] == d:
            doc_of.pop()
            s -= 1
    word, sent, doc_of = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (word, sent, doc_of))
    flat_, size_ = array("i"), array("i")
    for w in ids:
        f = features(w)
        flat_.extend(f)
        size_.append(len(f))
    n_words = len(ids)
    ids = None
    flat, size = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (flat_, size_))
    owner = np.repeat(np.arange(n_words, dtype=np.int32), size)
    # features seen in fewer than three documents say nothing
    pair = np.unique(doc_of[sent] * np.int64(n_words) + word) if len(word) else np.zeros(0, np.int64)
    n_docs = np.bincount(flat, np.bincount(pair % max(n_words, 1), minlength=n_words)[owner], DIM)
    pair = None
    ok = n_docs[flat] >= 3
    flat, owner = flat[ok], owner[ok]
    used, flat = np.unique(flat, return_inverse=True)
    w, b = np.zeros(len(used)), -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = weight.sum()
    for k in range(1, steps + 1):
        per_word = np.bincount(owner, w[flat], n_words)
        z = np.bincount(sent, per_word[word], len(doc_of)) + b
        soft = np.logaddexp(0, z)  # -log(1 - p)
        clean = np.bincount(doc_of, soft, len(texts))  # -log P(label 0)
        pos = np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-12)
        g_doc = weight * np.where(y > 0, -pos, 1.0) / total
        g_sent = g_doc[doc_of] * sigmoid(z)
        g_word = np.bincount(word, g_sent[sent], n_words)
        g = np.bincount(flat, g_word[owner], len(used)) + l2 * w
        gb = g_sent.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    keep = np.abs(w) > 1e-3
    return Model(dict(zip(used[keep].tolist(), w[keep].tolist())), float(b))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = BYTES) -> Model:
    """Fit on at most ``most`` documents and ``most_bytes`` of text of each label, none of them held out."""
    l = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    shares = {int(r.toxic): r["count"] for r in l.groupBy("toxic").count().collect()}
    h = F.xxhash64("doc_id")
    pick = l.where("toxic = 1").orderBy(h, "doc_id").limit(most).union(l.where("toxic = 0").orderBy(h, "doc_id").limit(most))
    # one text an id, however often the id is repeated; of a text that may not fit only its size comes to the driver
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick.distinct()), "doc_id").groupBy("doc_id", "toxic")
    sizes = chosen.agg(F.min(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).withColumn("h", h).toPandas()  # 2 x most rows
    fits, left = [], {0: most_bytes, 1: most_bytes}
    for r in sizes.sort_values(["h", "doc_id"], kind="stable").itertuples():
        if r.n <= left[int(r.toxic)]:
            left[int(r.toxic)] -= r.n
            fits.append((int(r.doc_id), int(r.toxic)))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    least = docs.sparkSession.createDataFrame(fits, "doc_id long, toxic int")
    whole = docs.select("doc_id", F.struct(size.alias("n"), F.coalesce("text", F.lit("")).alias("text")).alias("x")).join(F.broadcast(least), "doc_id")
    rows = whole.groupBy("doc_id", "toxic").agg(F.min("x").alias("x")).select("doc_id", "x.text", "toxic").toPandas()  # at most 2 x most_bytes
    rows = rows.sort_values(["doc_id", "toxic"], kind="stable")
    y = rows["toxic"].to_numpy(float)
    weight = np.array([shares[int(v)] / max((y == v).sum(), 1) for v in y])
    texts = [t or "" for t in rows["text"]]
    rows = None
    return fit(texts, y, weight)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double) and predicted (int)."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*held.value)
        for s in texts:
            yield pd.Series([m.score(t) for t in s], dtype=float)

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, at_least: float = 0.3) -> DataFrame:
    """doc_id, sentence (number), p of every sentence whose own probability is at least ``at_least``."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*held.value)
        for b in batches:
            out = [(i, k, float(p)) for i, t in zip(b["doc_id"], b["text"]) for k, p in enumerate(m.sentences(t or "")) if p >= at_least]
            yield pd.DataFrame(out, columns=["doc_id", "sentence", "p"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, sentence int, p double")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, columns unchanged."""
    cols = docs.columns
    inner = docs.withColumn("_tox_text", F.col("text"))
    kept = score_documents(inner.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("d"), F.col("_tox_text").alias("text")), train(docs, labels))
    return kept.where("predicted = 0").select("d.*")


def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
