"""Uploads that land once, sketches that merge, chunks as a table function."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import chunk
from tessella.operators import sketches
from tessella.plans.kb import KnowledgeBase
from tessella.streaming.landing import Landing, ingest_uploads

SF = "/root/testdata/sf0.01"


def test_uploads_land_once(spark, tmp_path):
    landing = Landing(spark, f"file://{tmp_path}/l")
    make = lambda *rows: spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "name string, content binary")
    assert landing.files().isEmpty()
    first = make(("a.txt", b"one"), ("a.txt", b"two"), ("x/a.txt", b"one"), ("../../etc/pass wd", b"p"), ("..", b"d"), (None, None), ("b\\с é.txt", "é".encode()))
    for _ in range(2):
        landing.land(first, 0)
    got = sorted((r.name[17:], bytes(r.content), r.bytes) for r in landing.files().collect())
    assert got == sorted([("a.txt", b"one", 3), ("a.txt", b"two", 3), ("pass_wd", b"p", 1), ("upload", b"d", 1), ("upload", b"", 0), ("с_é.txt", "é".encode(), 2)])
    assert landing.files().select("name").distinct().count() == 6
    later = landing.land(make(("a.txt", b"one"), ("c.txt", b"one"), ("a.txt", b"three")), 1)
    assert sorted(r.name[17:] for r in later.collect()) == ["a.txt", "c.txt"]
    landing.land(first, 0)  # the first batch again, after the second
    assert landing.files().count() == 8


def test_uploads_are_indexed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a note.txt").write_text("first text")
    (tmp_path / "in" / "b.md").write_text("second text")
    landing, kb = Landing(spark, f"file://{tmp_path}/l"), KnowledgeBase(spark, f"file://{tmp_path}/kb")
    for i in range(2):
        ingest_uploads(spark, str(tmp_path / "in"), landing, kb, f"{tmp_path}/at").awaitTermination()
        if i == 0:
            (tmp_path / "in" / "c.md").write_text("second text")  # other name, same content
    assert sorted(r.doc_key[17:] for r in kb.chunks().collect()) == ["a_note.txt", "b.md", "c.md"]


@pytest.mark.parametrize("keys", [["source"], []])
def test_sketches_within_their_bounds(spark, tmp_path, keys):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "lang", F.md5("text").alias("digest"), "n_chars")
    table = sketches.SketchTable(spark, f"{tmp_path}/s", ["source", "lang"], ["digest"], ["n_chars"])
    for number in (0, 1, 2, 1):  # a batch again
        table.add(docs.where(F.pmod(F.xxhash64("digest"), F.lit(3)) == number), number)
    got = {tuple(r[k] for k in keys): r for r in table.status(*keys, ranks=(0.1, 0.5, 0.9)).collect()}
    rows = {}
    for r in docs.collect():
        rows.setdefault(tuple(r[k] for k in keys), []).append(r)
    assert set(got) == set(rows)
    for key, members in rows.items():
        r, sizes = got[key], sorted(m.n_chars for m in members)
        assert r.n == len(members)
        exact = len({m.digest for m in members})
        assert abs(r.distinct_digest - exact) <= max(1, 4 * 1.04 / math.sqrt(2**sketches.LG) * exact)
        for p in (10, 50, 90):
            rank = sum(s <= r[f"n_chars_p{p}"] for s in sizes) / len(sizes)
            below = sum(s < r[f"n_chars_p{p}"] for s in sizes) / len(sizes)
            assert below - 0.05 <= p / 100 <= rank + 0.05
    plan = table.status(*keys)._jdf.queryExecution().executedPlan().toString()
    assert "hll_digest" in plan and "documents" not in plan  # the rows are not read


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([("a", None, None)], "k string, d string, v double")
    got = sketches.estimates(sketches.sketched(rows, ["k"], ["d"], ["v"])).first()
    assert (got.n, got.distinct_d, got.v_p50) == (1, 0, None)
    assert sketches.merged(sketches.sketched(rows.limit(0), ["k"], ["d"], ["v"]), ["k"]).isEmpty()


def test_chunks_as_a_table_function(spark):
    chunk.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, " \n "), (-3, "short")], docs.schema))
    docs.createOrReplaceTempView("chunk_documents")
    found = spark.sql("SELECT doc_id, pos, chunk FROM chunk_documents, LATERAL recursive_chunks(text, 300, 40)")
    want = docs.select("doc_id", F.posexplode(chunk.chunks(F.col("text"), 300, 40)).alias("pos", "chunk"))
    assert found.count() == want.count() > 1000 and found.exceptAll(want).isEmpty()
    assert spark.sql("SELECT * FROM recursive_chunks('one two')").collect() == [(0, "one two")]
    for bad in ("'a', 0", "'a', 10, -1", "7"):
        with pytest.raises(Exception, match="argument is a text|is a constant"):
            spark.sql(f"SELECT * FROM recursive_chunks({bad})").collect()
