"""Texts of the knowledge base are shuffled no more often than needed."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella import ledger
from tessella.config import EngineConfig
from tessella.plans.kb import KnowledgeBase
from tessella.plans.stored import Sizes

SIZE, COUNT = 20_000, 100


def shuffled(spark) -> int:
    """Bytes that the session's tasks have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    for _ in range(2):  # the counters are brought up to date with later tasks
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.3)
        spark.range(1).count()
    sc.listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in [sc.statusStore().executorList(True).apply(0)])


@pytest.fixture
def base(spark, tmp_path):
    config = EngineConfig(chunk_size=10**9, chunk_overlap=0, embedding_dim=1, embedding_model="sizes")
    return KnowledgeBase(spark, f"file://{tmp_path}/kb", config, Sizes())


def documents(spark, folder, repeated):
    """Texts that can't be compressed much, from a file; with ``repeated`` some documents have one text, and one is given twice."""
    r = random.Random(1)
    texts = [base64.b85encode(r.randbytes(SIZE * 4 // 5 + i)).decode() for i in range(COUNT)]
    rows = [(str(i), t) for i, t in enumerate(texts)]
    if repeated:
        rows = [*rows, *[(f"r{i}", texts[i]) for i in range(3)], rows[0]]
    spark.createDataFrame(rows, "doc_key string, text string").write.parquet(f"{folder}/d")
    return spark.read.parquet(f"{folder}/d").withColumn("metadata", F.create_map(F.lit("source"), F.col("doc_key"))), dict(rows)


def test_documents_that_are_new_are_shuffled_once(spark, base, tmp_path):
    docs, want = documents(spark, tmp_path, False)
    before = shuffled(spark)
    base.add(docs)
    assert shuffled(spark) - before < 1.5 * SIZE * COUNT
    assert {r.doc_key: r.text for r in base.chunks().collect()} == want


@pytest.mark.parametrize("repeated", [False, True])
def test_many_texts_are_embedded_where_they_are(spark, base, tmp_path, monkeypatch, repeated):
    """Joins by key, as of tables that are too large to broadcast."""
    monkeypatch.setattr(ledger, "EVEN", 10)
    docs, want = documents(spark, tmp_path, repeated)
    docs = docs.dropDuplicates(["doc_key"]).repartition(4).localCheckpoint() if repeated else docs
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        base.add(docs)
        assert shuffled(spark) - before < 0.5 * SIZE * COUNT
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert {r.doc_key: (r.text, r.embedding[0]) for r in base.chunks().collect()} == {k: (t, float(len(t))) for k, t in want.items()}
    assert base.ledger.calls("embedding", "array<float>").count() == COUNT


@pytest.mark.parametrize("even", [ledger.EVEN, 10])
def test_repeated_texts_and_rows(spark, base, tmp_path, monkeypatch, even):
    monkeypatch.setattr(ledger, "EVEN", even, raising=False)
    docs, want = documents(spark, tmp_path, True)
    base.add(docs)
    assert sorted((r.doc_key, r.text, r.embedding[0]) for r in base.chunks().collect()) == sorted((k, t, float(len(t))) for k, t in want.items())
    assert base.ledger.answers("embedding", "array<float>").count() == base.ledger.calls("embedding", "array<float>").count() == COUNT
    assert base.add(docs) == base.add(docs.limit(3)) == 1


def test_search_leaves_the_texts_where_they_are(spark, base, tmp_path):
    docs, want = documents(spark, tmp_path, False)
    base.add(docs)
    base.build_index()
    asked = spark.createDataFrame([(i, want[str(i)]) for i in (1, 2)], "query_id long, text string")
    before = shuffled(spark)
    assert sorted((r.query_id, r.content) for r in base.search(asked, 1).collect()) == [(i, want[str(i)]) for i in (1, 2)]
    assert shuffled(spark) - before < 0.5 * SIZE * COUNT
