"""The stages, one after the other, against what their operators promise, on the smallest table."""

import os
from collections import Counter

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import sentencepiece

    from remitspark.llm.jaccard import similar
    from remitspark.llm.piece_bpe import default_path
    from remitspark.llm.toxicity import score_documents, train

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, cols = {}, docs.columns
    d = docs
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == cols, name
        kept[name] = d = spark.createDataFrame(d.collect(), d.schema)
    before = {r.doc_id: r for r in docs.collect()}
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in score_documents(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == clean
    groups = {}
    for r in similar(kept["toxicity"], 5, 0.8).collect():
        groups.setdefault(r.component, []).append(r.doc_id)
    assert sorted(r.doc_id for r in kept["simhash"].collect()) == sorted(min(g) for g in groups.values())
    cut = kept["suffix_array"].collect()
    assert sorted(r.doc_id for r in cut) == sorted(r.doc_id for r in kept["simhash"].collect())
    # the cut, byte by byte: what lies in a string of PASSAGE bytes that starts at two places goes, everywhere
    texts = {r.doc_id: (r.text or "").encode() for r in kept["simhash"].collect()}
    seen = Counter(w[i : i + P.PASSAGE] for w in texts.values() for i in range(len(w) - P.PASSAGE + 1))
    for r in cut:
        w, gone, end = texts[r.doc_id], set(), 0
        for i in range(len(w) - P.PASSAGE + 1):
            if seen[w[i : i + P.PASSAGE]] > 1:
                gone.update(range(max(i, end), i + P.PASSAGE))
                end = i + P.PASSAGE
        assert r.text == bytes(c for k, c in enumerate(w) if k not in gone).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    assert any(r.text != before[r.doc_id].text for r in cut)
    words = lambda t: len((t or "").split())
    taken = sum(words(r.text) for r in kept["mixing"].collect())
    assert abs(taken - 1.5 * sum(words(r.text) for r in cut)) < 0.05 * taken + 500
    sp = sentencepiece.SentencePieceProcessor(model_file=default_path())
    last = P.STAGES[-1][1](spark, kept["mixing"], SF).collect()
    want = sorted((r.doc_id, len(sp.encode(r.text or "", add_eos=True))) for r in kept["mixing"].collect())
    assert sorted((r.doc_id, r.n_tokens) for r in last) == want
    # the registered query is the same five stages, one after the other
    import __spark_entry__

    whole = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(map(tuple, whole.select(last[0].__fields__).collect())) == sorted(map(tuple, last))


def test_only_saved_tables_are_dropped(spark):
    from remitspark.llm.common import Scratch

    scratch = Scratch(spark, "dropped")
    t = scratch.save(spark.range(3))
    with pytest.raises(ValueError):
        scratch.drop(t.where("id > 0"))
    scratch.drop(t)
    with pytest.raises(Exception):
        t.count()


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from remitspark.llm.jaccard import drop_similar
    from remitspark.llm.mixing import mixed_documents
    from remitspark.llm.piece_bpe import default_path, digests
    from remitspark.llm.suffix_array import cut_repeats
    from remitspark.llm.toxicity import reject_toxic

    for f in (lambda d: reject_toxic(d, labels), drop_similar, cut_repeats, mixed_documents, lambda d: digests(d, default_path())):
        assert f(empty).count() == 0
