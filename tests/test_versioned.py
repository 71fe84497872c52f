"""The versioned table and the knowledge base on it: replacement, removal, writers at once, old versions, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from tessella.config import EngineConfig
from tessella.plans import versioned
from tessella.plans.kb import KnowledgeBase
from tessella.plans.versioned import Conflict, VersionedTable
from tessella.sources import files


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", "k string, v long", ["k"])


def put(table, rows, keys=None):
    spark = table.spark
    keys = [(k, "d") for k in (keys or sorted({r[0] for r in rows}))]
    return table.put(spark.createDataFrame(rows, "k string, v long"), spark.createDataFrame(keys, "k string, digest string"))


def read(table, version=None):
    return sorted(tuple(r) for r in table.rows(version).collect())


def test_versions_stay_readable(table, spark):
    assert read(table) == [] and table.manifest()["version"] == 0
    assert put(table, [("a", 1), ("a", 2), ("b", 3), (None, 9)], ["a", "b", None]) == 1
    assert put(table, [("a", 4), ("c", 5)]) == 2
    assert table.remove(spark.createDataFrame([("b",), ("absent",)], "k string")) == 3
    assert put(table, [], ["c"]) == 4  # a key without rows
    before = [(None, 9), ("a", 1), ("a", 2), ("b", 3)]
    versions = [sorted(x, key=repr) for x in (before, [(None, 9), ("a", 4), ("b", 3), ("c", 5)], [(None, 9), ("a", 4), ("c", 5)], [(None, 9), ("a", 4)])]
    for v, rows in enumerate(versions, 1):
        assert sorted((tuple(r) for r in table.rows(v).collect()), key=repr) == rows
    assert sorted(r.k or "" for r in table.live_keys().collect()) == ["", "a", "c"]
    assert table.reset() == 5 and read(table) == [] and table.rows(2).count() == 4
    with pytest.raises(KeyError):
        table.rows(99)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_compaction_and_vacuum(table, spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(versioned, "BROADCAST_ROWS", broadcast_rows)
    for i in range(4):
        put(table, [("a", i), (f"own{i}", i)])
    table.remove(spark.createDataFrame([("own0",)], "k string"))
    want = [("a", 3), ("own1", 1), ("own2", 2), ("own3", 3)]
    assert read(table) == want and table.manifest()["retired"] > 0
    assert table.compact() == 6 and read(table) == want
    assert len(table.manifest()["segments"]) == 1 and table.manifest()["retired"] == 0 and table.compact() == 6
    plan = table.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # nothing is retired, so nothing is joined
    put(table, [("own1", 7)])
    assert read(table) == sorted([*want[:1], ("own1", 7), *want[2:]])
    assert read(table, 5) == want
    table.vacuum(grace=1e9)
    assert table.versions() == [7] and len(list((tmp_path / "t/rows").iterdir())) == 6  # too young to go
    table.vacuum(grace=-10)
    assert len(list((tmp_path / "t/rows").iterdir())) == 2 and read(table)[1] == ("own1", 7)


def test_writers_at_once(table, spark):
    """Writers of different keys lose nothing; those of one key leave one of their versions, whole."""
    errors = []

    def work(n):
        try:
            for i in range(3):
                put(VersionedTable(spark, table.folder, table.schema, table.keys), [(f"w{n}", i), ("shared", 10 * n + i), ("shared", 100 + 10 * n + i)])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and table.versions() == list(range(1, 13))
    rows = read(table)
    assert [r for r in rows if r[0] != "shared"] == [(f"w{n}", 2) for n in range(4)]
    a, b = [v for k, v in rows if k == "shared"]
    assert b == a + 100
    assert table.compact() == 13 and read(table) == rows


def test_compaction_while_others_write(table, spark, monkeypatch):
    """What is committed between reading and placing a compaction stays on top; a second compaction starts anew."""
    put(table, [("a", 1), ("b", 1)])
    put(table, [("a", 2)])
    publish, meant = VersionedTable._publish, []

    def slow(self, manifest):
        if manifest["operation"] == "compact" and not meant:
            meant.append(1)
            put(VersionedTable(spark, table.folder, table.schema, table.keys), [("a", 3), ("c", 3)])
        return publish(self, manifest)

    monkeypatch.setattr(VersionedTable, "_publish", slow)
    assert table.compact() == 4
    assert read(table) == [("a", 3), ("b", 1), ("c", 3)] and table.manifest()["retired"] == 1
    monkeypatch.setattr(VersionedTable, "_publish", lambda self, manifest: False)
    with pytest.raises(Conflict):
        VersionedTable(spark, table.folder, table.schema, table.keys, attempts=2).reset()


def test_segments_of_no_version_are_not_read(table, spark):
    put(table, [("a", 1)])
    table._segment(spark.createDataFrame([("a", 9)], "k string, v long"), spark.createDataFrame([("a", "d")], "k string, digest string"))
    assert read(table) == [("a", 1)]


def docs(spark, *pairs):
    return files.from_rows(spark, [{"text": t, "source": "s"} for _, t in pairs]).drop("doc_key").withColumn(
        "doc_key", F.element_at(F.from_json(F.lit(str({t: k for k, t in pairs}).replace("'", '"')), "map<string, string>"), F.col("text"))
    )


def test_sources_indexed_again(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", EngineConfig(chunk_size=30, chunk_overlap=0))
    long = "alpha beta gamma delta epsilon zeta eta theta"
    first = kb.add(docs(spark, ("x", long), ("y", "stays")))
    assert kb.chunks().where("doc_key = 'x'").count() == 2
    assert kb.add(docs(spark, ("x", long), ("y", "stays"))) == first  # nothing changed, so no version
    second = kb.add(docs(spark, ("x", "short now"), ("z", "new")))
    texts = lambda v=None: sorted((r.doc_key, r.text) for r in kb.chunks(v).collect())
    assert second == first + 1 and texts() == [("x", "short now"), ("y", "stays"), ("z", "new")]
    assert len(texts(first)) == 3
    kb.remove(spark.createDataFrame([("y",)], "doc_key string"))
    assert texts() == [("x", "short now"), ("z", "new")]
    kb.compact()
    assert texts() == [("x", "short now"), ("z", "new")] and kb.status().first().documents == 2
    other = KnowledgeBase(spark, kb.folder, EngineConfig(embedding_model="m2"))
    other.add(docs(spark, ("x", "by another model")))
    assert texts() == [("x", "short now"), ("z", "new")] and other.chunks().count() == 1
    kb.reset()
    assert kb.chunks().isEmpty()


def test_search_by_an_index_of_the_version(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    kb.add(docs(spark, *[(f"k{i}", f"text about subject number {i} and {i * 7}") for i in range(40)]))
    asked = spark.createDataFrame([("q1", "subject number 3"), ("q2", "text 21")], "query_id string, text string")
    rows = lambda: sorted((r.query_id, r["rank"], round(r.distance, 6), r.content) for r in kb.search(asked, 4).collect())
    flat = rows()
    index = kb.build_index()
    assert index.about["rows"] == 40 and rows() == flat
    (tmp_path / "kb_index").rename(tmp_path / "hidden")
    assert rows() == flat
    (tmp_path / "hidden").rename(tmp_path / "kb_index")
    kb.add(docs(spark, ("new", "subject number 3")))
    assert rows()[0][2:] == (0.0, "subject number 3")  # the index of the former version isn't asked
    assert kb.build_index().about["rows"] == 41 and len(list((tmp_path / "kb_index").iterdir())) == 1
    assert rows()[0][2:] == (0.0, "subject number 3") and [r[3] for r in rows()[1:4]] == [r[3] for r in flat[:3]]
