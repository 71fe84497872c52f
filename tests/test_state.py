"""Streaming state: the crawl frontier over batches, sessions as in a table, late rows in a table of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessella.operators import relational as X
from tessella.streaming import state

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.STORE)
    yield
    spark.conf.set(name, before)


def hour(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


def run(spark, tmp_path, build, batches, schema, mode="append"):
    """Feeds batches one by one to a stream; all rows that it gave, in mode complete the last ones."""
    (tmp_path / "in").mkdir(exist_ok=True)
    out = []

    def note(batch, _):
        rows = [tuple(r) for r in batch.collect()]
        out[:] = rows if mode == "complete" else out + rows

    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = build(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.foreachBatch(note).outputMode(mode).option("checkpointLocation", f"{tmp_path}/at").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return out


def test_frontier(spark, store, tmp_path):
    """Intervals follow changes, pages come due, state outlives the query, forgotten pages are new again."""
    visits = "url string, digest string, at timestamp"
    batches = [
        [("a", "1", hour(0)), ("b", "1", hour(0)), ("a", "1", hour(1))], [("a", "2", hour(2)), ("b", "9", hour(-1))], [("c", "1", hour(20))],
        [("c", "1", hour(200))], [("b", "1", hour(201))],
    ]
    hours = 3600.0
    build = lambda s: state.frontier(s, "0 seconds", first=4 * hours, shortest=hours, longest=100 * hours, forget=2)
    got = run(spark, tmp_path, build, batches, visits)
    at = lambda t: None if t is None else (t - hour(0)).total_seconds() / 3600
    told = [(u, e, at(t), at(n)) for u, _, e, t, n in got]
    visits_told = [x for x in told if x[1] != "due"]
    assert [x for x in visits_told if x[0] == "a"] == [("a", "new", 0, 4), ("a", "same", 1, 9), ("a", "changed", 2, 6)]
    assert [x for x in visits_told if x[0] == "b"] == [("b", "new", 0, 4), ("b", "new", 201, 205)]  # the early visit changes nothing
    due = sorted(x for x in told if x[1] == "due")
    assert due[:4] == [("a", "due", 6, 10), ("a", "due", 10, None), ("b", "due", 4, 8), ("b", "due", 8, None)]


def test_sessions_as_in_a_table(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = [tuple(r) for r in events.orderBy("ts").collect()]
    want = sorted((r.user_id, r.first, r.last, r.n) for r in X.sessions(events, "user_id", "ts", 240).collect())
    table = sorted((r.user_id, r.first, r.last, r.n) for r in state.sessions(events, "user_id", "ts", "240 minutes").collect())
    assert table == want
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    got = run(spark, tmp_path, lambda s: state.sessions(s, "user_id", "ts", "240 minutes"), batches, "user_id long, ts timestamp", "complete")
    assert sorted(got) == want


def test_late_rows_have_a_table(spark, tmp_path):
    add = state.split_late(spark, f"file://{tmp_path}/t", "ts", 3600)
    make = lambda *rows: spark.createDataFrame([(i, hour(h)) for i, h in rows], "id long, ts timestamp")
    batches = [make((1, 10), (2, 3)), make((3, 9), (4, 8.9), (5, 20)), make((6, 18), (7, 30)), make()]
    for n in (0, 1, 2, 3, 1):  # the second batch is run again
        add(batches[n], n)
    ids = lambda name: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t/{name}").collect())
    assert ids("on_time") == [1, 2, 3, 5, 7] and ids("late") == [4, 6]
