"""The source audit against SQL and brute force: odd rows, several blocks of sources, ties, the bound search."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_corpus import SF, sql

from tessella.llm import common, divergence, queries

DOCS = "doc_id long, text string, lang string, source string, term string, c string, p string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def far(p, q):
    return (p - q) ** 2 // (p + q)


def by_hand(rows, least=10, k=10):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, every term scored."""
    docs = [(lang or "", source or "", TERM.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, total, groups = Counter(), Counter(), {}
        for own, source, words in docs:
            if own == lang:
                held.update(set(words))
                total.update(words)
                groups.setdefault(source, Counter()).update(words)
        kept = sorted(t for t in held if held[t] >= least)
        share = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept]
        q, p = share(total), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(map(far, p[s], p[o])), o) for o in groups if o != s]
            terms = [(far(x, y), t) for x, y, t in zip(p[s], q, kept, strict=True) if groups[s][t] and x > y]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def got(found):
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, sources=9, docs=160):
    """Sources with their own taste, ties by twin words, nulls, repeated rows, a text of many terms."""
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "été", "世界", "it's", "x1y", "Zeta_eta", "twin1a", "twin1b"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(docs):
        s = rng.randrange(sources)
        taste = words[s : s + 8] * 4 + words
        rows.append((" ".join(rng.choice(taste) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de"]), f"s{s}"))
    rows += [rows[0]] * 12 + [(None, "en", "s1"), ("", None, None), ("alone", None, "x"), ("!!! 12 3", "xx", "b"), (None, "xx", "a"), ("İ \x7f é", "en", "S")]
    return rows + [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(5000)), "en", "long")]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, t, lang, s, "x", "y", "z") for i, (t, lang, s) in enumerate(rows)], DOCS).repartition(5)


def test_terms_follow_the_pattern():
    every = "".join(map(chr, range(0, 0x250))) + "世\U0001f600 A_b É"
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in every)
    assert [t.decode() for t in divergence.terms_of(every.encode())] == TERM.findall(lowered)


def test_probabilities_of_large_counts(spark):
    rows = [(0, 0, 1), (3, 10, 4), (10**12 + 7, 10**13 + 9, 10**7 + 1), (9 * 10**14, 9 * 10**14, 12_345), (1, 9 * 10**14, 10**9)]
    found = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.probability("c", "n", "v").alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in found]


def test_query_against_sql(spark):
    found = queries.op11_divergence(spark, SF)
    want = sql(divergence.AUDIT_SQL).select("lang", "source", "part", "item", "value", "rank").fetchall()
    assert sorted(want) == got(found)
    assert {w[2] for w in want} == {"pair", "term"}


@pytest.mark.parametrize("least,k,block,broadcast_rows", [(10, 10, 128, 1000), (2, 3, 2, 0), (1, 1, 1, 1000)])
def test_odd_rows(frame, monkeypatch, least, k, block, broadcast_rows):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "ROWS", 7)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    rows = corpus(least)
    assert got(divergence.audit_sources(frame(rows), least, k, broadcast_rows)) == by_hand(rows, least, k)


def test_search_leaves_buckets_unread(spark, frame, tmp_path):
    """A group whose few frequent terms stand out is answered without its many rare ones, ties at the end included."""
    rows = [("rare" + chr(97 + i % 26) * (1 + i // 26), "en", s) for i in range(260) for s in ("a", "b")] * 2
    rows += [("own twin " * 300, "en", "a")] * 2 + [("other " * 300, "en", "b")] * 2
    counts = common.keep(divergence.term_counts(frame(rows), 2), f"{tmp_path}/counts")
    groups = common.keep(divergence.groups_of(counts), f"{tmp_path}/groups")
    terms = common.keep(divergence.scored_terms(counts, groups, 100), f"{tmp_path}/terms")
    best = divergence.best_terms(terms, 1, str(tmp_path), 100)
    assert [tuple(r) for r in best.select("source", "term").orderBy("source").collect()] == [("a", "own"), ("b", "other")]
    read = [spark.read.parquet(str(p)) for p in tmp_path.glob("wave*")]
    chosen = read[0].unionByName(read[1])
    scored = terms.join(chosen, ["lang", "source", "b"]).count()
    assert len(read) == 2 and scored < terms.count() / 10


def test_nothing(spark, frame):
    rows = frame([("a", "en", "s")])
    assert divergence.audit_sources(rows.limit(0)).isEmpty()
    assert divergence.audit_sources(rows.where(F.col("doc_id") == 0)).isEmpty()
