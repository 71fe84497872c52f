"""Vector and substring search at their edges, page extraction rules, merging by the last of an id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import html as H
from tessella.operators import search as S
from tessella.operators import verdicts as V


@pytest.mark.parametrize("tile", [2, S.TILE])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_top_k_with_zero_and_null_vectors(spark, monkeypatch, metric, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(7)] + [(100 + i, [0.0] * 4) for i in range(3)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [1.0]), (203, []), (None, [1.0] * 4)]
    base = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame(rows[:3] + rows[7:8], "query_id long, embedding array<double>")
    got = {}
    for r in S.top_k(asked, base, 5, metric).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q, v in rows[:3]:
        x = np.array(v)
        far = lambda y: 1 - x @ y / np.sqrt((x @ x) * (y @ y)) if metric == "cosine" else ((x - y) ** 2).sum()  # noqa: E731,B023
        usable = [(i, np.array(w)) for i, w in rows[: 7 if metric == "cosine" else 10]]
        want = sorted((far(w), i) for i, w in usable)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert (100 in got) == (metric == "l2")


def test_containing_in_several_scans(spark, monkeypatch):
    needles = spark.createDataFrame([("ab",), ("b",), ("zz",), ("",), (None,), ("ab",), ("é",)], "k string")
    texts = spark.createDataFrame([(1, "xabx"), (2, "b"), (3, None), (4, ""), (5, "café")], "id long, t string")
    want = [("ab", 1), ("b", 1), ("b", 2), ("é", 5)]
    for size in (S.NEEDLE_BYTES, 1):
        monkeypatch.setattr(S, "NEEDLE_BYTES", size)
        assert sorted((r.k, r.id) for r in S.containing(needles, texts, "k", "t").collect()) == want
    assert S.containing(needles.where("k is null"), texts, "k", "t").count() == 0


def test_no_nested_loop(spark):
    """Keywords are found in one scan of the urls: neither a nested loop nor a product is planned."""
    keys = spark.createDataFrame([(1, 0, "doc")], "query_id long, kw_ord int, keyword string")
    index = spark.createDataFrame([("a/doc", "http://a/doc", 1)], "path string, url string, ord long")
    found = S.match_keywords(keys, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, "http://a/doc", 1, 1)]


def test_page_rules():
    carried = '<article>short</article><script>var pageData = {"x": "body", "body" : "<p>from \\"script\\"</p>"};</script>'
    assert H.page(carried)["content"] == 'short\n\nfrom "script"'
    assert H.page('<script>{"body": "broken</script><script>{"body": "<p>second</p>"}</script>')["content"] == "second"
    long = "word " * 40
    assert H.page(f'<main>{long}</main><script>{{"body": "no"}}</script>')["content"] == long.strip()
    trail = '<nav class="Breadcrumbs"><a>One</a><a> </a><a>Two</a></nav>'
    assert H.page(f"<h1>Two</h1>{trail}")["breadcrumbs"] == ["One", "Two"]
    assert H.page(f"<h1></h1><title>T</title>{trail}")["title"] == ""
    assert H.page(None) == {"title": "", "breadcrumbs": [], "content": "", "section_path": ""}


def test_last_requirement_of_an_id_counts(spark):
    r = spark.createDataFrame(
        [("d", 1, "s1", "first", "sla", 1), ("d", 1, "s2", "last", "legal", 2)], "document_name string, id int, section string, text string, category string, ord int"
    )
    a = spark.createDataFrame(
        [("d", 1, "match", 0.9, None, None, None, None)] * 2,
        "document_name string, requirement_id int, verdict string, confidence double, reasoning string, evidence string, recommendation string, source_urls array<string>",
    )
    got = V.merge_answers(r, a, "ord").collect()
    assert [(x.section, x.requirement_text, x.category) for x in got] == [("s2", "last", "legal")] * 2


def test_source_label_and_categories(spark):
    rows = [({"url": "https://a/b", "source": "s"},), ({"url": "/local", "source": "s"},), ({},)]
    got = [r.x for r in spark.createDataFrame(rows, "m map<string, string>").select(S.hit_source(F.col("m")).alias("x")).collect()]
    assert got == ["https://a/b", "s", "unknown"]
    r = spark.createDataFrame([("d", "sla"), ("d", "legal"), ("d", "sla")], "document_name string, category string")
    assert V.categories(r, "document_name").first().categories == ["legal", "sla"]
    assert V.in_categories(r, ["sla"]).count() == 2 and V.in_categories(r, []).count() == 3
    done = spark.createDataFrame([(1, 3), (0, 0), (3, 3)], "a int, b int").select(V.percent_done(F.col("a"), F.col("b")).alias("p"))
    assert [x.p for x in done.collect()] == [33, 100, 100]
