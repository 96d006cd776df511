"""License matches against wording, and the store's versions, merges and conflicts."""

import tempfile

import pytest

from remitspark.llm.license_scan import TEMPLATES, scan, scanned
from remitspark.llm.sharding import Conflict, ShardStore, op9_tiered_sharding


def test_every_notice_is_found_as_itself():
    for name, _, notices in TEMPLATES:
        for n in notices:
            got = [m[0] for m in scan(f"Some words before it\n{n}\nand after it.")[1]]
            assert name in got, (name, n, got)


def test_wrapped_and_altered():
    mit = next(n for name, _, n in TEMPLATES if name == "MIT")[0].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    n, found = scan("intro line\n\n" + wrapped + "\n\nlast line")
    assert found[0][0] == "MIT" and found[0][2] > 10 and n >= 1
    assert scan("The driver showed a license at the gate, and nobody asked for another one.")[1] == []
    assert [m[0] for m in scan("This work is licensed under the GNU General Public License, version 2.")[1]] == ["GPL-2.0"]
    assert [m[0] for m in scan("licensed under the APACHE license, version 2.0")[1]] == ["Apache-2.0"]
    assert scan("Copyright 2020 somebody")[1] == []


PROSE = "The harbour crew counted crates of oranges by lantern light while rain drummed on the corrugated roof and nobody spoke".split()


def test_notices_inside_paragraphs():
    """Every notice inside a long line, wrapped anywhere, and with blank lines between its words."""
    import random

    rng = random.Random(4)
    tried = hits = 0
    for name, _, notices in TEMPLATES:
        for n in notices:
            before, after = (" ".join(rng.choice(PROSE) for _ in range(rng.randint(5, 60))) for _ in range(2))
            w = n.split()
            wrapped = "".join(x + ("\n" if k % 7 == 6 else " ") for k, x in enumerate(w))
            spaced = "".join(x + ("\n\n" if k == len(w) // 2 else " ") for k, x in enumerate(w))
            for body in (n, wrapped, spaced):
                tried += 1
                hits += name in [m[0] for m in scan(f"{before} {body} {after}")[1]]
    assert hits == tried
    assert [m[0] for m in scan(" ".join(PROSE * 3) + " Released under the MIT License. " + " ".join(PROSE * 3))[1]] == ["MIT"]


def test_other_licenses_are_not_taken_for_known_ones():
    assert scan("Released under the Llama Community License.")[1] == []
    assert [m[0] for m in scan("Licensed under the GNU Lesser General Public License, version 3.")[1]] == ["LGPL-3.0"]
    assert [m[0] for m in scan("This work is licensed under CC BY-NC 4.0.")[1]] == ["CC-BY-NC-4.0"]
    assert scan("This work is licensed under CC BY-ND 4.0.")[1] == []


def test_ranking_is_that_of_compressed_sizes():
    """The template that confirms is the first confirmed one in the order of sizes, computed here anew."""
    import zstandard as z

    from remitspark.llm.license_scan import confirmed, templates, words

    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = z.ZstdCompressionParameters.from_level(9, **bare)
    text = "Licensed under the Apache License, Version 2.0."
    sizes = {}
    for k, (name, _, notices) in enumerate(TEMPLATES):
        d = z.ZstdCompressionDict("\n".join(notices).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        sizes[k] = len(z.ZstdCompressor(dict_data=d, compression_params=params).compress(text[:-1].encode()))
    order = sorted(sizes, key=lambda k: (sizes[k], TEMPLATES[k][0]))
    tokens = words(text)
    want = next(TEMPLATES[k][0] for k in order if confirmed(tokens, 0, templates()[0][k]))
    assert [m[0] for m in scan(text)[1]] == [want] == ["Apache-2.0"]


def test_long_single_line():
    n, found = scan("license " * 20_000 + "Released under the MIT License.")
    assert n >= 20_000 and [m[0] for m in found] == ["MIT"]


def test_documents(spark):
    rows = [(1, "Released under the MIT License.", 1), (1, "Released under the MIT License.", 1), (2, None, 0), (None, "", 0), (3, "x " * 100000 + "\nLicensed under CC BY-NC 4.0.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = sorted(((r.doc_id, r.n_candidates, r.licenses) for r in scanned(df).collect()), key=str)
    assert got == sorted([(1, 1, ["MIT"]), (1, 1, ["MIT"]), (2, 0, []), (None, 0, []), (3, 1, ["CC-BY-NC-4.0"])], key=str)
    assert scanned(df.limit(0)).count() == 0


def test_store(spark):
    base = tempfile.mkdtemp(prefix="spark-shards-")
    store = ShardStore(spark, "file://" + base, target=20_000, smallest=2_000, fan=3)
    df = spark.range(6000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text", "cast(null as string) as path").repartition(2)
    for k in range(7):
        store.append(df.where(f"doc_id % 7 = {k}"))
        store.compact()
    store.append(df.limit(0))
    runs = store.runs()
    assert all(sum(r.tier == t for r in runs) < 3 for t in {r.tier for r in runs})
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(6000))
    old = store.version() - 3
    before = sorted(map(str, store.read(old).collect()))
    store.vacuum(keep=4)
    assert sorted(map(str, store.read(old).collect())) == before  # a kept version stays readable
    assert store.vacuum() >= 0 and store.read().count() == 6000
    with pytest.raises(Conflict):
        store.commit(store.manifest(), store.version() - 1)
    # a writer that died before its rename leaves a draft, which no reader sees and which blocks nobody
    at = store.version()
    store.fs.create(store.path(f"{store.base}/versions/draft-dead"), False).close()
    assert store.version() == at and store.read().count() == 6000
    assert store.append(df.limit(1)) == at + 1
    store.commit(store.manifest(at), at + 1)
    # repeated rows and nulls are stored as they are
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "y")], "doc_id long, text string, path string")
    store.append(odd)
    assert store.read().count() == 6003


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op9_tiered_sharding(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "sha2(text, 256) as text_sha256")
    assert got.select("doc_id", "text_sha256").exceptAll(docs).count() == 0
    assert docs.exceptAll(got.select("doc_id", "text_sha256")).count() == 0


def test_query_on_odd_tables(spark, tmp_path):
    """Clashing columns, null ids, and no row at all."""
    rows = [(1, "a", 1, "s"), (1, "a", 1, "s"), (None, None, 2, "t"), (2, "", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, arrival0 int, shard string")
    for k, d in enumerate((df, df.limit(0))):
        d.coalesce(1).write.parquet(f"file://{tmp_path}/{k}/documents.parquet")
        got = op9_tiered_sharding(spark, f"file://{tmp_path}/{k}")
        assert got.columns == ["doc_id", "text_sha256", "shard", "shard_rows", "version"]
        assert sorted((str(r.doc_id) for r in got.collect())) == sorted(str(r.doc_id) for r in d.collect())
