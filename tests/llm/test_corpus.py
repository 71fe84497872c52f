"""The corpus operators against brute force, round trips and held-out rows; odd inputs for each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from brute import awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import class_lm, common, decontam, license_scan, line_dedup, minhash, mixing, pq_dedup, quality, queries, secret_scan, suffix_dedup

SF = "/root/testdata/sf0.001"


def pairs(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def empty(docs):
    return docs((1, "x")).limit(0)


def sql(text, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.sql(text)


# 1


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op1_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(right) > 50 and sum(right) / len(right) > 0.95


def test_quality_odd(spark, odd, docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None), (8, 3), (9, 1), (9, 0)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[4]) == 1 and by[1] == by[2]
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty(docs), labels).count() == 0


def test_keep_good_odd(spark, odd, docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None), (8, 3)], "doc_id long, quality int")
    good = {(r.doc_id, r.score) for r in quality.score_quality(odd, labels).collect() if r.predicted}
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in good}
    assert quality.keep_good(odd, labels.limit(0)).count() == len(awkward())
    assert quality.keep_good(empty(docs), labels).count() == 0


def test_ranking_prefers_by_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.NAMES)))
    labels = (x[:, 2] + 0.1 * rng.normal(size=400) > 0.5).astype(int)
    model = quality.fit_pairs(x, labels)
    assert ((model.score(x) >= 0.5) == labels).mean() > 0.95


# 2


def test_licenses(docs):
    mit = license_scan.TEMPLATES["MIT-full"]
    rows = docs(
        (1, "Some text.\nLicensed under the Apache License, Version 2.0."),
        (2, "Licensed under the Apache License, Version 1.1."),
        (3, "words " * 2000 + mit.replace("free of charge", "without charge").replace(" ", "\n", 9) + " words" * 900),
        (4, "He has a license to drive in the city."),
        (5, "This work is licensed under the GNU General Public License, version 2. " + "x " * 3000 + "Released under the MIT License."),
        (6, "Licensed under CC BY-NC 4.0."),
    )
    got = {r.doc_id: r for r in license_scan.scan_licenses(rows).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: "Apache-2.0", 2: "", 3: "MIT-full", 4: "", 5: "GPL-2.0,MIT", 6: "CC-BY-NC-4.0"}
    assert got[3].found[0].lacking == "free of" and got[3].found[0].extra == "without"
    text = rows.where("doc_id = 5").first().text.encode()
    assert b"MIT" in text[got[5].found[1].start : got[5].found[1].end]


def test_licenses_many_in_a_block():
    """A list of third-party notices within one block: templates that raise each other take no place from the others."""
    names = ["MPL-2.0", "GPL-2.0", "CC-BY-4.0", "CC0-1.0", "Apache-2.0"]
    text = "\n".join(license_scan.TEMPLATES[n] for n in names).encode()
    blocks, found = license_scan.Scanner(license_scan.TEMPLATES, tolerance=0.1).scan(text)
    assert blocks == 1 and {x["license"] for x in found} == set(names)


def test_licenses_short_in_long_blocks(docs):
    """An exact notice counts in prose and beside others, however little its template reduces the block."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, f"{prose(200)} {license_scan.TEMPLATES[n]} {prose(300)}") for i, n in enumerate(license_scan.TEMPLATES)]
    rows += [(100, "\n".join(license_scan.TEMPLATES.values())), (101, prose(50) + " all rights are reserved " + prose(50))]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(docs(*rows)).collect()}
    for i, n in enumerate(license_scan.TEMPLATES):
        assert n in got[i].split(",")
    assert set(got[100].split(",")) == set(license_scan.TEMPLATES) and got[101] == ""


def test_licenses_odd(odd, docs):
    assert [r.n_blocks for r in license_scan.scan_licenses(odd).collect()] == [0] * len(awkward())
    assert license_scan.scan_licenses(empty(docs)).count() == 0
    many = license_scan.blocks_of(b"license " * 20_000)
    assert many[0][0] == 0 and many[-1][1] == 160_000 and all(b - a <= license_scan.BLOCK for a, b in many)


# 3


def slow_base(text):
    """Base spans by the plain patterns, character by character for the runs."""
    import re

    found = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for pattern, n, order, kind in (("AKIA[A-Z0-9]+", 20, 1, "access"), ("[0-9a-f]+", 24, 2, "hex")):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= n]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secrets_base(spark):
    texts = dict(pairs(spark, "/root/testdata/sf0.01"))
    rows = queries.op3_secrets(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_assign for r in rows) > 0
    for r in rows:
        want = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", " ", ":", '"', "AKIA", "A", "a1", "0123456789abcdef01234567", "ſecret", "toKen", "x", "\U0001f600", "password"]), max_size=25))
def test_secrets_property(parts):
    text = "".join(parts)
    assert secret_scan.joined(secret_scan.spans_of(text, 300)[0]) == slow_base(text)


def test_secrets_linking():
    alone = "see https://db.example.com/x for more"
    assert secret_scan.spans_of(alone, 300)[1] == []
    assert secret_scan.spans_of("user_id = bob", 300)[1] == []
    linked = "login: bob99 at https://db.example.com/x with password = hunter22"
    kinds = [k for _, _, k in secret_scan.spans_of(linked, 300)[1]]
    assert kinds == ["account", "endpoint", "assign"]
    far = "login: bob99" + " x" * 400 + " password = hunter22"
    assert [k for _, _, k in secret_scan.spans_of(far, 300)[1]] == ["assign"]
    bare = "client_id=acme77 wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY"
    assert [k for _, _, k in secret_scan.spans_of(bare, 300)[1]] == ["account", "bare"]
    assert secret_scan.redact(linked).count("[") == 3 and "hunter22" not in secret_scan.redact(linked)


def test_linked_is_a_join():
    rng = random.Random(3)
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(12)):
            s = rng.randrange(400)
            parts.append((s, s + rng.randrange(1, 30), rng.choice(secret_scan.KINDS)))
        role = secret_scan.ROLE

        def near(p, r, parts=parts):
            return any(role[q[2]] == r and (p[1] <= q[0] <= p[1] + 50 or p[0] - 50 <= q[1] <= p[0]) for q in parts)

        needs = {"account": ("secret",), "bare": ("id",), "endpoint": ("id", "secret")}
        want = [p for p in parts if p[2] in needs and all(near(p, r) for r in needs[p[2]])]
        assert secret_scan.linked(parts, 50) == want


def test_secrets_odd(odd, docs):
    rows = secret_scan.scan_secrets(odd).collect()
    assert len(rows) == len(awkward())
    assert secret_scan.scan_secrets(empty(docs)).count() == 0
    assert secret_scan.redact_secrets(odd).columns == odd.columns
    assert [r.n_hex for r in rows if r.doc_id == 10] == [1]


# 4


@pytest.mark.parametrize("bound", [0, common.BROADCAST_ROWS])
def test_near_duplicates(spark, bound):
    rows = pairs(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k=4, broadcast_rows=bound).collect()}
    assert got == brute.near(rows)


def test_near_duplicates_chains(docs):
    """Groups whose members do not all link with one centre: later rounds and the full one find the rest."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(rng.randrange(4, 16)):
            words[rng.randrange(400)] = f"z{i}_{rng.random()}"
        rows.append((i, " ".join(words)))
    want = brute.near(rows, 5)
    assert len({v[1] for v in want.values()}) > 3
    for options in ({}, {"star_rounds": 0}, {"full_below": 2}, {"star_rounds": 0, "pairs_upto": 1, "tile": 7}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(*rows), 5, 80, **options).collect()}
        assert got == want


def test_near_duplicates_below_the_threshold(spark):
    """800 variants of one text that share bands, few of them similar enough to link."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(800):
        words = list(base)
        for at in rng.sample(range(100), rng.choice((2, 4, 5, 6))):
            words[at] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows, 5)
    for options in ({}, {"star_rounds": 0, "tile": 300}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 5, 80, **options).collect()}
        assert got == want
    assert len({v[1] for v in want.values()}) > 80


def test_near_duplicates_odd(odd, docs):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 4).collect())
    assert got[(4, 4, True)] == 2 and got[(5, 4, False)] == 1 and got[(8, 7, False)] == 1
    assert got[(1, 1, True)] == got[(2, 2, True)] == got[(3, 3, True)] == 1 and got[(None, None, True)] == 2
    kept = minhash.keep_one_of_each(odd, 4)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0)] * 2 + [(True, i) for i in (1, 2, 3, 4, 6, 7, 9, 10, 11)]
    assert minhash.near_duplicates(empty(docs), 4).count() == 0


def test_sequential_test_keeps_similar():
    least = minhash.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (20_000, 128), dtype=np.uint16)
    for share, low, high in ((0.8, 0.9995, 1.0), (0.2, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < share, a, a + 1)
        assert low <= minhash.plausible(a, b, least).mean() <= high


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in common.components(spark, frame, common.scratch(spark)).collect()}
    want = brute.comps({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


# 5


def test_mix_weights(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    for bound in (100_000, 0):
        mixed = mixing.mix_sources(docs, {"big": 1, "s1": 3, "s2": 0}, broadcast_rows=bound)
        shares = {r.source: r["count"] / 40_000 for r in mixed.groupBy("source").count().collect()}
        assert set(shares) == {"big", "s1"} and abs(shares["big"] - 0.25) < 0.02 and abs(shares["s1"] - 0.75) < 0.03
    counts = mixing.mix_sources(docs, {"s1": 1}).groupBy("doc_id").count()
    mean = counts.agg(F.sum("count")).first()[0] / docs.where("source = 's1'").count()
    var = counts.agg(F.sum(F.col("count") ** 2)).first()[0] / docs.where("source = 's1'").count() - mean**2
    assert abs(var / mean - 1) < 0.1  # a Poisson distribution's variance is its mean


def test_mix_large_mean(spark):
    count = lambda mean, u: spark.range(1).select(mixing.poisson_count(F.lit(mean), F.lit(u)).alias("c")).first().c
    assert count(0.0, 0.99) == 0 and count(3.0, 0.0) == 0
    for mean in (0.7, 3.0, 2000.0, 60_000.0):
        low, total, log_p, k = {}, 0.0, -mean, 0
        for u in (0.001, 0.5, 0.999):
            while total + math.exp(log_p) <= u:
                total += math.exp(log_p)
                k += 1
                log_p += math.log(mean) - math.log(k)
            low[u] = k
        assert [count(mean, u) for u in low] == list(low.values())


def test_mix_rare_source(spark):
    """A source of a few rows whose rate is in the thousands."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, "rare").otherwise("rest").alias("source"))
    mixed = mixing.mix_sources(docs).groupBy("source", "doc_id").count().where("source = 'rare'").collect()
    assert len(mixed) == 4 and all(abs(r["count"] - 2500) < 250 for r in mixed)


def test_mix_odd(odd, docs):
    mixed = mixing.mix_sources(odd.withColumn("copy", F.lit("mine")).withColumn("Order_Key", F.lit(1)))
    assert mixed.columns == [*odd.columns, "copy", "order_key"]
    rows = mixed.collect()
    assert all(r["copy"] >= 1 for r in rows)
    assert mixing.mix_sources(empty(docs)).count() == 0 and mixing.mix_sources(odd, {}).count() == 0


# 6


@pytest.mark.parametrize("bound", [0, common.BROADCAST_ROWS])
def test_substrings(spark, bound):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = suffix_dedup.remove_repeats(docs, broadcast_rows=bound).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.repeats(pairs(spark))
    assert {r.doc_id: r.n_repeated for r in rows} == {i: x[1] for i, x in brute.repeats(pairs(spark), 240).items()}


def test_substrings_awkward_overlaps(docs, monkeypatch):
    """Shared parts of all lengths, periodic texts and repeats within a text, over small pieces."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randrange(1, 9)))
    core = "".join(word() for _ in range(900))
    rows = []
    for i in range(40):
        a = rng.randrange(len(core) - 900)
        part = core[a : a + rng.randrange(300, 900)]
        rows.append((i, "".join(word() for _ in range(rng.randrange(200))) + part + "".join(word() for _ in range(rng.randrange(60)))))
    rows += [(100, "ab" * 700), (101, "xab" * 400), (102, "q" * 399), (103, "q" * 400), (104, "q" * 401), (105, core[:400]), (106, core[1:400])]
    rows += [(200 + i, "!" * (i + 1) + core[500 : 500 + n] + "?" * (i + 1)) for i, n in enumerate((239, 240, 241, 271, 272, 383, 399, 400, 401, 431, 432))]
    for size in (suffix_dedup.PIECE, 1000):  # long texts in many pieces
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        found = suffix_dedup.remove_repeats(docs(*rows)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.repeats(rows)
        assert {r.doc_id: r.n_repeated for r in found} == {i: x[1] for i, x in brute.repeats(rows, 240).items()}


def test_substrings_odd(odd, docs):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(awkward())
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id == 4)
    assert all(r.n_bytes == 0 for r in rows if r.doc_id in (1, 2))
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_runs_do_not_depend_on_pieces():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 100, 60_000, dtype=np.uint8))
    old = suffix_dedup.PIECE
    for size in (old, 5000):
        suffix_dedup.PIECE = size
        starts = sorted(a + at - where for data, spots in suffix_dedup.pieces_of([text], 400) for _, at, where in spots for a in range(where, where + min(size, len(text) - at) - 399 * (at + size + 399 > len(text))))
        assert starts[0] == 0 and set(starts) >= set(range(len(text) - 399))
    suffix_dedup.PIECE = old


# 7


def slow_lines(rows, sentence_words=8):
    """Spans, count and words of the units that are cut, by a dictionary of what has been seen."""
    blanks = "[ \t\x0b\x0c\r]"
    units = []
    for i, text in sorted(rows):
        at = 0
        for number, line in enumerate((text or "").split("\n")):
            words = brute.words(line)
            if words:
                units.append((i, at, at + len(line), number, 0, words))
            parts = re.split(f"(?<=[.!?])(?={blanks})", line)
            start = at
            if len(parts) > 1:
                for part in parts:
                    if len(brute.words(part)) >= sentence_words:
                        units.append((i, start, start + len(part), number, 1, brute.words(part)))
                    start += len(part)
            at += len(line) + 1
    seen, gone = set(), set()
    for u in sorted(units, key=lambda u: u[:3]):
        key = " ".join(u[5])
        if key in seen:
            gone.add(u[:5])
        seen.add(key)
    out = {i: ([], 0, 0) for i, _ in rows}
    for i, start, end, number, kind, words in sorted(units, key=lambda u: (u[0], u[1], u[4])):
        line_gone = any(g[0] == i and g[3] == number and g[4] == 0 for g in gone if kind) if (i, start, end, number, kind) in gone else True
        if (i, start, end, number, kind) in gone and not (kind and line_gone):
            spans, n, lost = out[i]
            out[i] = ([*spans, (start, end)], n + 1, lost + len(words))
    return out


def test_lines(spark):
    rows = pairs(spark)[:400]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_lines(rows)
    assert any(want.values())
    for r in line_dedup.dedup_units(docs).collect():
        spans, n, lost = want[r.doc_id]
        assert ([(s.start, s.end) for s in r.spans], r.n_removed, r.words_removed) == (spans, n, lost)
        text, at, kept = dict(rows)[r.doc_id], 0, []
        for a, b in spans:
            kept.append(text[at:a])
            at = b + (text[b : b + 1] == "\n" and (a == 0 or text[a - 1] == "\n"))
        assert r.text == "".join(kept) + text[at:]


def test_lines_find_passages_inside_lines(docs):
    """A passage that starts and ends within other lines is found by its whole sentences."""
    passage = ". ".join(" ".join(f"word{i}x{j}" for j in range(11)) for i in range(6)) + "."
    rows = {r.doc_id: r for r in line_dedup.dedup_units(docs(
        (1, f"A host of its own begins here and then {passage} Then it goes on."),
        (2, f"Short.\nAnother one begins in its own way {passage} And ends otherwise.\nShort."),
        (3, "Nothing in here is said anywhere else. Not this sentence of nine words here either."),
    )).collect()}
    assert (rows[1].n_removed, rows[3].n_removed, rows[1].words_repeated, rows[3].words_repeated) == (0, 0, 55, 0)
    assert (rows[2].n_removed, rows[2].words_removed) == (6, 56)
    assert rows[2].text == "Short.\nAnother one begins in its own way word0x0 word0x1 word0x2 word0x3 word0x4 word0x5 word0x6 word0x7 word0x8 word0x9 word0x10. And ends otherwise.\n"


def test_paragraphs(docs):
    para = "one two three four five\nsix seven eight nine"
    rows = {r.doc_id: r for r in line_dedup.dedup_units(docs((2, f"{para}\n\nrest"), (1, f"start\n\n{para.upper()}"), (3, None)), "paragraph").collect()}
    assert rows[1].n_removed == 0 and rows[2].text == "\nrest" and rows[3].text == ""


def test_lines_odd(odd, docs):
    """Of repeated rows one keeps its units."""
    rows = line_dedup.dedup_units(odd).collect()
    assert len(rows) == len(awkward())
    assert sorted((r.n_units, r.n_removed) for r in rows if r.doc_id == 4) == [(1, 1), (1, 1)]  # the row without id is first
    assert [r.n_removed for r in rows if r.doc_id is None and r.n_units] == [0]
    assert line_dedup.dedup_units(empty(docs)).count() == 0
    twice = line_dedup.dedup_units(docs((4, "a b\nc"), (4, "a b\nc"), (4, "a b\nc"), (5, "c"))).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in twice) == [(4, 0, "a b\nc"), (4, 2, ""), (4, 2, ""), (5, 1, "")]


# 8


def test_lm(spark):
    rows = queries.op8_class_lm(spark, SF).collect()
    texts = dict(pairs(spark))
    tokens = {i: [*brute.words(t), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        assert r.held_out == (r.doc_id not in train)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]), n)
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    size = sum(r.n_tokens for r in held)
    assert 10 ** (-sum(r.score for r in held) / size) < 10 ** (-sum(r.base_score for r in held) / size)


def test_lm_rare_words_by_join(spark, docs):
    """Few words held by workers and many: the same base scores."""
    some = spark.read.parquet(f"{SF}/documents.parquet")
    get = lambda **k: {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in class_lm.score_texts(some, **k).collect()}
    assert get(own=20, frequent=50, classes=4) == get(own=20, frequent=200_000, classes=4) == get(own=20, frequent=0, classes=4)


def test_lm_is_a_distribution():
    """Steps from a class sum to one; so do a class's words and one unknown."""
    rng = np.random.default_rng(0)
    bigrams = rng.poisson(0.3, (40, 40))
    of = class_lm.exchange(bigrams, 6, sweeps=100)
    assert of[-1] == 6 and set(of[:-1]) <= set(range(6))

    def likelihood(of):
        hot = np.eye(7)[of]
        g = hot.T @ bigrams @ hot
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    start = np.append(np.arange(39) % 6, 6)
    best = likelihood(of)
    assert best > likelihood(start)
    for w in range(39):  # no single move is better
        for c in range(6):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= best + 1e-6


def test_lm_sums_to_one(spark, docs):
    """Transitions from each class, and emissions of a class's words and one unseen word, sum to one."""
    grid = np.random.default_rng(2).poisson(3.0, (9, 9)).astype(float)
    assert np.allclose((10 ** class_lm.smoothed(grid)).sum(axis=1), 1)
    rows = docs(*[(i, f"a{i % 7} b{i % 5} c{i % 3} a{i % 2}") for i in range(60)])
    train = rows.where(common.held_out_remainder(7) != 2)
    words = train.select(F.explode(F.split("text", " ")).alias("w")).groupBy(F.col("w").cast("binary").alias("word")).agg(F.count(F.lit(1)).alias("c"))
    model = class_lm.cluster(train.select("text"), words, 6, 12, 4, common.scratch(spark))
    known = {r.word: (r.c, r["class"]) for r in model.lexicon.collect()}
    assert {bytes(r.word): r.c for r in words.collect()} == {bytes(w): c for w, (c, _) in known.items()}
    for k in {x[1] for x in known.values()}:
        own = [c + 1 for c, of in known.values() if of == k]
        assert abs(sum(c / (sum(own) + 1) for c in own) + 1 / (sum(own) + 1) - 1) < 1e-12


def test_lm_classes_of_all_words(spark, docs):
    """Words outside the types get the classes of words used alike, whatever their last bytes; held by workers or not."""
    rng = random.Random(12)
    kinds = [[f"{a}{i}{rng.choice('xyzuvw')}" for i in range(60)] for a in "pqr"]
    rows = [(i, " ".join(rng.choice(kinds[j % 3][:3] if rng.random() < 0.7 else kinds[j % 3]) for j in range(30))) for i in range(300)]
    frame = docs(*rows)
    train = frame.where(common.held_out_remainder(7) != 2).select("text")
    words = Counter(w for r in train.collect() for w in r.text.split())
    vocabulary = spark.createDataFrame([(w.encode(), n) for w, n in words.items()], "word binary, c long")
    seen = []
    for frequent in (9, 1000):
        found = class_lm.cluster(train, vocabulary, 9, frequent, 3, common.scratch(spark))
        got = {bytes(r.word).decode(): r for r in found.lexicon.collect()}
        assert {w: r.c for w, r in got.items()} == words
        best = [Counter(got[w]["class"] for w in ws if w in got).most_common(1)[0] for ws in kinds]
        assert len({c for c, _ in best}) == 3 and sum(n for _, n in best) >= 0.95 * len(words)
        seen.append({r.doc_id: round(r.score, 6) for r in class_lm.score_texts(frame, 9, frequent, 3).collect()})
    assert seen[0] == seen[1]


def test_exchange_ends_when_nothing_moves():
    bigrams = np.random.default_rng(1).poisson(0.3, (300, 300))
    of = class_lm.exchange(bigrams, 12)
    assert (of == class_lm.exchange(bigrams, 12, sweeps=1000)).all() and (of != class_lm.exchange(bigrams, 12, sweeps=6)).any()


def test_lm_odd(odd, docs):
    rows = class_lm.score_texts(odd).collect()
    assert len(rows) == len(awkward()) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert class_lm.score_texts(empty(docs)).count() == 0
    unseen = class_lm.score_texts(docs(*[(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert unseen and all(r.n_known == 0 and r.train_tokens == 0 for r in unseen)


# 9


def test_leaks_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in pairs(spark, sf) for j, x in items if x in t}
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op9_leaks(spark, sf).collect()}
    assert want and got >= want and len(got - want) <= 2
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, shard_items=7).collect()} == got


def test_wand_is_exhaustive():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 25)))) for i in range(150)]
    sets = [set(decontam.tokens_of(t.encode())) for _, t in items]
    df = Counter(t for s in sets for t in s)
    index = decontam.Index(items, df, len(items), 12.0, 0.45)
    hits = 0
    for _ in range(200):
        terms = [w.encode() for w in rng.sample(words, rng.randrange(1, 30))]
        score = Counter()
        for t in terms:
            if t in index.terms:
                for i, w in zip(index.terms[t].items, index.terms[t].weights, strict=True):
                    score[i] += w
        want = {i: round(s, 9) for i, s in score.items() if s >= 0.45 - 1e-9}
        got = {i: round(s, 9) for i, s in index.search(terms)}
        assert got == want
        hits += len(want)
    assert hits > 100


def test_leaks_verification(spark, docs):
    words = [f"term{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, "What is the colour of the northern tower? Answer: deep green"), (3, None), (None, "x y"), (4, "!?")], "item_id long, text string")
    text = lambda ws: "pad " * 300 + " ".join(ws) + " pad" * 300
    rows = docs(
        (1, text(words[:30])), (2, text(w.upper() + "," for w in words[:30])), (3, text(words[:18])), (4, text(sorted(words[:30], reverse=True))),
        (5, "so what is the colour of the northern tower deep green indeed"), (6, "what is the colour of the northern tower"), (7, None),
    )
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(rows, items).collect()}
    assert got == {(1, 1), (2, 1), (5, 2)}
    assert {r.doc_id for r in decontam.remove_leaks(rows, items).collect()} == {3, 4, 6, 7}
    assert decontam.find_leaks(rows, items.limit(0)).count() == 0 and decontam.find_leaks(empty(docs), items).count() == 0


def test_leaks_odd(spark, odd, docs):
    """Repeated rows and items, a very long text, null and wordless ones, clashing columns."""
    words = [f"term{i}" for i in range(30)]
    item = " ".join(words)
    items = spark.createDataFrame([(1, item, "a"), (1, item, "b"), (2, "", "c"), (3, None, "d"), (None, item, "e")], "item_id long, text string, doc_id string")
    long = " ".join([*(f"p{i % 501}" for i in range(40_000)), *words, *(f"q{i % 77}" for i in range(40_000))])
    rows = odd.unionByName(docs((20, item), (20, item), (21, long), (22, "term0"), (None, item)))
    for size in (5_000, 1):
        got = Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(rows, items, shard_items=size).collect())
        assert got == {(20, 1): 4, (21, 1): 2, (None, 1): 2}
        clean = decontam.remove_leaks(rows, items, shard_items=size)
        assert clean.columns == rows.columns
        assert Counter(r.doc_id for r in clean.collect()) == Counter([*(i for i, _ in awkward()), 22])
    assert decontam.remove_leaks(odd, items.where("item_id > 1")).count() == len(awkward())
    assert decontam.remove_leaks(empty(docs), items).count() == 0


def test_leaks_own_text():
    """Every item leaks in its own verbatim text, with its marker and whatever the length of its answer, across passage ends too."""
    texts = [
        "What is the capital city of the French Republic? Answer: Paris",
        "Question: who painted the ceiling of the chapel?\nA: Michelangelo Buonarroti",
        "Which of the four northern rivers is the longest one? ANSWER : b",
        "Name it. Answer: the old stone bridge over the river",
        "How many moons has the fourth planet? two",
        "When did the two crowns unite for the first time? Answer: in March 1603",
    ]
    sets = [set(q + a) for q, a in map(decontam.split_item, texts)]
    df = Counter(t for s in sets for t in s)
    index = decontam.Index(list(enumerate(texts)), df, len(texts), 10.0, 0.6)
    for i, t in enumerate(texts):
        for pad in range(2 * index.longest):
            found = index.leaks([("pad " * pad + t + " pad" * 40).encode()], 0.8)[0]
            assert [(h[0], h[2], h[3]) for h in found] == [(i, 1.0, 1.0)]
    asked = texts[0].replace("Paris", "unknown").encode()
    assert index.leaks([asked], 0.8) == [[]]  # the question alone is no leak


# 10


def test_nearest_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    x, centres = rng.normal(size=(50, 5)), rng.normal(size=(20, 5))
    want = np.argsort(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
    monkeypatch.setattr(pq_dedup, "ROWS", 7)
    for k in (1, 4, 20):
        assert (pq_dedup._nearest(x, centres, k) == want[:, :k]).all()


def test_embeddings_recall_with_unprobed_lists(spark):
    """Clustered vectors in some 300 lists, of which 24 are probed."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(150, 32))
    rows = []
    for i in range(6000):
        base = centre[rng.integers(150)] + 0.45 * rng.normal(size=32) if i % 3 else None
        v = rows[-1][1] + 0.2 * rng.normal(size=32) if base is None and rows else base if base is not None else rng.normal(size=32)
        rows.append((i, np.asarray(v)))
    m = np.array([v / np.linalg.norm(v) for _, v in rows])
    want = {i: int(n) - 1 for i, n in enumerate((m @ m.T >= 0.93).sum(axis=1))}
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in pq_dedup.near_embeddings(frame, per_list=20).collect()}
    assert sum(want.values()) > 2000 and all(got[i] <= want[i] for i in want)
    recall = sum(got.values()) / sum(want.values())
    print("recall", recall)
    assert recall >= 0.97


def near_vectors(n=1500, dim=24, seed=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    x = np.vstack([base, base + 0.12 * rng.normal(size=base.shape), rng.normal(size=(n - 2 * len(base), dim))])
    x[::50] = x[0]
    x[7:300:10] = x[7] + 0.15 * rng.normal(size=(30, dim))
    return x.astype(np.float32)


def test_embeddings_recall(spark):
    x = near_vectors()
    labels = np.arange(len(x)) % 2
    frame = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    want = near.sum(1)
    for options in ({}, {"block": 16}):
        got = {r.vec_id: r.n_links for r in pq_dedup.near_embeddings(frame, per_list=60, **options).collect()}
        counts = np.array([got[i] for i in range(len(x))])
        assert (counts <= want).all() and counts.sum() >= 0.97 * want.sum() > 0


def test_embeddings_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 1.0], 1),
        (8, [float("nan"), 1.0, 1.0], 1), (9, [], 1), (10, [1.0, 2.0], 1), (None, v, 1), (11, [2.0, 4.0, 6.0], 1), (12, [float("inf"), 0.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.near_embeddings(frame).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[None] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert got[i] == (0, i, True)
    assert pq_dedup.near_embeddings(frame.limit(0)).count() == 0


def test_embeddings_extreme_sizes(spark):
    """Finite vectors count whatever their size, and repeated rows as vectors of their own."""
    rows = [
        (1, [1e300, 2e300], 1), (2, [1.0, 2.0], 1), (3, [1e-300, 2e-300], 1), (4, [5e-324, 0.0], 1), (5, [-1e300, -2e300], 1),
        (6, [3.0, 1.0], 2), (6, [3.0, 1.0], 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq_dedup.near_embeddings(frame).collect())
    assert got == [
        (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True)
    ]


# SQL


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(repr, want.select(*got.columns).fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


# Pipeline


def test_redact_odd(odd, docs):
    out = secret_scan.redact_secrets(odd)
    assert out.columns == odd.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    want = [(i, "[hex]" if t == "a" * 3000 else t) for i, t in awkward()]  # 3,000 times a is a hexadecimal run
    assert got == Counter((i, t, None if t is None else len(t)) for i, t in want)
    rows = secret_scan.redact_secrets(docs((1, "password = hunter2secret"), (1, "password = hunter2secret"))).collect()
    assert rows[0].text == rows[1].text and "hunter2secret" not in rows[0].text and rows[0].n_chars == len(rows[0].text)
    assert secret_scan.redact_secrets(empty(docs)).count() == 0


def test_stages_odd(spark, odd, docs):
    """Every stage takes null, empty, repeated and clashing rows, and tables without rows."""
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, empty(docs)):
            out = stage(spark, frame, SF)
            assert out.columns[: len(frame.columns)] == frame.columns, name
            ids = {r.doc_id for r in out.collect()}
            assert ids <= {i for i, _ in awkward()} and (frame is odd) == bool(ids), name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in at.select("doc_id").collect()}
        at = common.keep(stage(spark, at, SF), common.scratch(spark))
        assert at.columns == docs.columns, name
        assert {r.doc_id for r in at.select("doc_id").collect()} <= before
        kept.append(at.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4] > 100
    assert at.where(F.rlike("text", F.lit("token = \"[0-9a-f]{40}"))).isEmpty()
    rest = [(r.doc_id, r.text) for r in at.collect()]
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == [*docs.columns, "copy", "order_key"] and final.count() > 0
    assert {r.doc_id for r in final.select("doc_id").collect()} <= {i for i, _ in rest}
