"""The substring join by rare grams: against plain search, with all widths, hot grams, joins by shuffle, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import grams as G
from tessella.operators import search as S


def plain(needles, texts):
    return sorted((n, i, t) for n in {n for n in needles if n} for i, t in texts if t and n in t)


def run(spark, needles, texts, **more):
    n = spark.createDataFrame([(x,) for x in needles], "k string").repartition(3)
    t = spark.createDataFrame(texts, "id long, t string").repartition(4)
    return sorted(tuple(r) for r in G.containing(n, t, "k", "t", **more).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é世", max_size=30), min_size=1, max_size=8), st.sampled_from([1, 2, 4, 8]))
def test_grams_of_texts(texts, width):
    raw = [t.encode() for t in texts]
    words = np.full(1 << 4, np.uint64(2**64 - 1))
    got = [(int(r), int(g)) for rows, grams in G.found_in(pa.array(texts), [width], words) for r, g in zip(rows, grams)]
    mark = 0 if width == 8 else width << 56
    want = {(i, int.from_bytes(b[p : p + width], "little") | mark) for i, b in enumerate(raw) for p in range(len(b) - width + 1)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("slice_,batch,hot,broadcast_bytes", [(1 << 20, 32 << 20, 20_000, 32 << 20), (40, 64, 3, 0), (1, 1, 0, 0)])
def test_against_plain_search(spark, monkeypatch, slice_, batch, hot, broadcast_bytes):
    monkeypatch.setattr(G, "SLICE", slice_)
    monkeypatch.setattr(G, "BATCH", batch)
    monkeypatch.setattr(G, "HOT", hot)
    rng = random.Random(hot)
    letters = "aab bcé世\U0001f600"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, make(rng.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, "a" * 500), (202, "a" * 500), (203, "x" * 20_000 + "needle at the end")]
    needles = [make(rng.randrange(1, 25)) for _ in range(60)] + [t[3:20] for _, t in texts[:40]] + ["a", "a" * 400, "", None, "a", "nowhere at all", "e at the end", "é", "世"]
    assert run(spark, needles, texts, broadcast_bytes=broadcast_bytes) == plain(needles, texts)


def test_rarest_gram_is_chosen(spark, tmp_path):
    texts = spark.createDataFrame([(i, "common words" + (" and a rareword" if i == 3 else "")) for i in range(50)], "id long, t string")
    wanted = spark.createDataFrame([("common words and a rareword",), ("common words",), ("common wordless",)], "needle string")
    got = {r.needle: r.n for r in G.rarest(wanted, texts, "t", f"file://{tmp_path}/x").collect()}
    assert got == {"common words and a rareword": 1, "common words": 50}  # the third has a gram that no text has


def test_memory_of_workers_is_bounded(spark, monkeypatch):
    """The bit set that workers hold has 16 bits a gram and stops growing at 16 MiB."""
    grams = spark.range(5000).selectExpr("id * 7919 as gram")
    words = G.bit_set(grams, 5000)
    assert words.nbytes == 16_384
    monkeypatch.setattr(G, "BROADCAST_ROWS", 10)
    assert (G.bit_set(grams, 5000) == words).all()  # put together from those of the tasks
    inside = np.arange(5000, dtype=np.int64).view(np.uint64) * np.uint64(7919)
    assert G.has(words, inside).all() and G.has(words, inside + np.uint64(1)).mean() < 0.05
    assert G.bit_set(grams, 10**12).nbytes == 16 << 20


def test_strings_meet_texts_by_equality(spark):
    keys = spark.createDataFrame([("some key",)], "k string")
    texts = spark.createDataFrame([(1, "has some key in it")], "id long, t string")
    plan = S.containing(keys, texts, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
