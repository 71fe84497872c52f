"""Fill-in-the-middle against SQL and an independent version; the lists against plain offsets."""

import hashlib
import random

import numpy as np
import pytest
from brute import awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_corpus import SF, empty, sql

from tessella.llm import fill_middle, queries


def by_hand(doc_id, text, rate=90, first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < first:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def got(rows):
    return sorted((repr(r.doc_id), r.n, r.form, repr(r.prefix_chars), repr(r.middle_chars), r.output) for r in rows)


def wanted(rows, **how):
    made = ((i, *by_hand(i, t, **how)) for i, t in rows)
    return sorted((repr(i), n, form, repr(a), repr(b), out) for i, n, form, a, b, out in made)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_lists_give_offsets(text):
    offsets = [len(text[:i].encode()) for i in range(len(text) + 1)]
    n, *entry = fill_middle.encode(fill_middle.offsets_of(text.encode()))
    assert n == len(text)
    assert [fill_middle.select(i, *entry) for i in range(n + 1)] == offsets


@pytest.mark.parametrize("step", [1, 3, 9, 1000])
def test_lists_of_many_samples(step):
    values = np.cumsum(np.random.default_rng(step).integers(1, step + 1, 30_000))
    n, *entry = fill_middle.encode(values)
    assert all(fill_middle.select(i, *entry) == values[i] for i in (0, 1, 2047, 2048, 2049, 17_000, n))
    assert 8 * (len(entry[1]) + len(entry[2])) < len(values) * (np.log2(step + 1) + 3) + 64


def test_query_against_sql(spark):
    found = queries.op12_fill_middle(spark, SF)
    want = sql(fill_middle.CUTS_SQL).select(*found.columns).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.md5(t), 1, 1).cast("binary")], ids=["sha", "weak"])
def test_odd_rows(spark, docs, broadcast_rows, digest, monkeypatch):
    """Sentinels, pairs of marks at the cuts, copies, texts that share a weak digest, several salts."""
    monkeypatch.setattr(fill_middle, "COPIES", 3)
    rng = random.Random(5)
    rows = awkward() + [(20 + i, "".join(rng.choice("<>PSM é世\U0001f600x") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(200 + i, "copied é text " * 5) for i in range(25)] + [(300, "a <M> b"), (301, "<P>"), (302, "<S")]
    more = {"digest": digest} if digest else {}
    found = fill_middle.fill_in_middle(docs(*rows), broadcast_rows=broadcast_rows, **more)
    assert got(found.collect()) == wanted(rows)
    again = found.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in again) == sorted((repr(i), t or "") for i, t in rows)


def test_rates_and_empty(spark, docs):
    rows = [(i, f"text number {i}") for i in range(60)]
    assert got(fill_middle.fill_in_middle(docs(*rows), rate=100, suffix_first=100).collect()) == wanted(rows, rate=100, first=100)
    assert fill_middle.fill_in_middle(docs(*rows), rate=0).where("form <> 'plain'").isEmpty()
    assert fill_middle.fill_in_middle(empty(docs)).isEmpty()


def test_each_repeated_text_is_listed_once(spark, docs, tmp_path):
    rows = docs(*[(i, f"text {i % 7}") for i in range(700)]).select(F.md5("text").cast("binary").alias("digest"), F.lit(1).cast("long").alias("parts"), "text")
    assert fill_middle.text_index(rows, str(tmp_path)).count() == 7
