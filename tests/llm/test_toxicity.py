"""Held-out accuracy on the given table, noisy-or arithmetic, edge cases."""

import os

import numpy as np
import pytest

from remitspark.llm.toxicity import Model, fit, offending_sentences, op7_toxicity_mil, reject_toxic, score_documents

SF = "/root/testdata/sf0.1"


def test_noisy_or():
    m = fit(["good day. bad word here.", "good day. fine day.", "bad thing.", "nice."] * 5, np.array([1, 0, 1, 0] * 5), np.ones(20))
    p = m.sentences("good day. bad word here.")
    assert len(p) == 2 and p[1] > 0.5 > p[0]
    assert m.score("good day. bad word here.") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]))
    assert m.score(None) == m.score("") == m.score("...\n")


def test_edges(spark):
    m = fit(["bad thing."] * 5 + ["nice."] * 5, np.array([1] * 5 + [0] * 5), np.ones(10))
    df = spark.createDataFrame([(1, "nice. bad thing.", 0.5), (1, "nice. bad thing.", 0.5), (2, None, 1.0), (None, "", None), (3, "nice " * 50000, 0.0)], "doc_id long, text string, score double")
    got = score_documents(df.drop("score"), m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [(r.doc_id, r.sentence) for r in offending_sentences(df, m, 0.5).collect()] == [(1, 1), (1, 1)]
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert reject_toxic(df, labels).columns == df.columns
    assert reject_toxic(df.limit(0), labels).count() == 0
    assert fit([], np.zeros(0), np.zeros(0)).score("x") < 0.01
    assert isinstance(fit(["x"], np.ones(1), np.ones(1)), Model)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out(spark):
    got = op7_toxicity_mil(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, hit = got["toxic"] == 1, got["predicted"] == 1
    assert (hit & y).sum() / y.sum() > 0.75  # a few hundred positive rows at this size
    assert (hit & ~y).sum() / (~y).sum() < 0.02


def test_sample_is_bounded(spark):
    """A repeated id is learnt from once, and texts that do not fit the bytes are left out, whole."""
    import remitspark.llm.toxicity as T

    rows = [(i, ("vile scum. " if i % 2 else "good day. ") * 3) for i in range(60)] + [(1, "vile scum. " * 3)] * 500 + [(101, "vile " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 101]], "doc_id long, toxic int")
    seen = []
    old = T.fit
    T.fit = lambda texts, y, weight: seen.append((texts, y)) or old(texts, y, weight)
    try:
        model = T.train(docs, labels, 100, 2000)
    finally:
        T.fit = old
    texts, y = seen[0]
    assert all(sum(len(t) for t, v in zip(texts, y) if v == k) <= 2000 for k in (0, 1)) and max(map(len, texts)) < 100
    assert len(texts) <= 60 and model.score("vile scum.") > model.score("good day.")


def test_score_column_of_the_input_is_replaced(spark):
    import remitspark.llm.toxicity as T

    df = spark.createDataFrame([(1, "a b", 7.0, 9)], "doc_id long, text string, score double, predicted int")
    r = T.score_documents(df, T.Model({}, -5.0)).first()
    assert r.score < 0.1 and r.predicted == 0
