"""Catalog queries against their SQL on small tables that hold what the generated ones don't."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessella.plans import catalog, coverage, stored  # noqa: F401  coverage and stored add to the catalog


def same(spark, folder, name, **tables):
    """The query's rows and its SQL's, both sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = catalog.QUERIES[name](spark, str(folder))
    want = con.sql(catalog.ORACLE_SQL[name]).select(*found.columns).fetchall()
    return sorted((tuple(r) for r in found.collect()), key=repr), sorted(want, key=repr)


def test_sessions_to_the_microsecond(spark, tmp_path):
    at = lambda *x: dt.datetime(2024, 1, 1, *x)
    # 3:59:59.2 apart, which whole seconds call 4:00:00; 4:00:00 apart; a microsecond less; 4:00:00.9 apart; no time
    times = [(1, at(0, 0, 0, 900000)), (1, at(4, 0, 0, 100000)), (1, at(8, 0, 0, 100000)), (1, at(12, 0, 0, 99999)), (1, at(16, 0, 0, 999999)), (1, None), (2, at(1))]
    events = pa.table({"user_id": [u for u, _ in times], "ts": pa.array([t for _, t in times], pa.timestamp("us"))})
    got, want = same(spark, tmp_path, "ingest_sessions", events=events)
    assert got == want
    assert [r[2] for r in got if r[0] == 1] == [2, 2, 1, 1]


WORDS = ["where docs storage docs", "table of storage", "none"]


def repeated_pages():
    """Urls that several pages have, urls that differ in case, one absent; html of two lengths."""
    urls = ["https://www.x.org/docs", "https://www.x.org/storage/table", "https://www.x.org/docs", "https://www.x.org/Docs", "https://a.org/docs-storage", None]
    urls += ["https://www.x.org/storage/table", "https://www.x.org/docs"]
    html = [f"<p>{i}</p>" * (400 if i != 2 else 3) for i in range(len(urls))]
    return {"pages": pa.table({"page_id": list(range(len(urls))), "url": urls, "html": html}), "benchmark": pa.table({"item_id": [1, 2, 3], "text": WORDS})}


def test_keywords_of_repeated_urls(spark, tmp_path):
    got, want = same(spark, tmp_path, "keyword_url_match", **repeated_pages())
    assert got == want
    assert (1, "https://www.x.org/docs", 6, 1) in got


def test_prefix_of_repeated_urls(spark, tmp_path):
    got, want = same(spark, tmp_path, "keyword_prefix_match", **repeated_pages())
    assert got == want and got


def test_pages_of_repeated_urls(spark, tmp_path):
    got, want = same(spark, tmp_path, "search_matched_pages", **repeated_pages())
    assert got == want and got


def test_documents_of_repeated_urls(spark, tmp_path):
    got, want = same(spark, tmp_path, "page_documents", pages=repeated_pages()["pages"])
    assert got == want and len(got) == 8


def dotted_pages():
    """Urls and items with a capital that lower() makes two code points of."""
    urls = ["https://İSTANBUL.org/kelvin", "https://x.org/istanbul", "https://x.org/STANBUL"]
    rows = {"page_id": list(range(len(urls))), "url": urls, "html": ["<p>x</p>" * 400] * len(urls)}
    return {"pages": pa.table(rows), "benchmark": pa.table({"item_id": [1, 2], "text": ["İSTANBUL kelvin", "stanbul KİLO"]})}


def test_keywords_with_a_dotted_capital(spark, tmp_path):
    got, want = same(spark, tmp_path, "keyword_url_match", **dotted_pages())
    assert got == want
    assert (1, "https://İSTANBUL.org/kelvin", 2, 1) in got


def test_words_with_a_dotted_capital(spark, tmp_path):
    documents = pa.table({"doc_id": [1, 2], "text": ["İSTANBUL KİLO istanbul", "ЁЛКА İİİİ"]})
    for name in ("doc_keyword_counts", "doc_fallback_keywords"):
        got, want = same(spark, tmp_path, name, documents=documents)
        assert got == want
    got, want = same(spark, tmp_path, "page_url_path", pages=dotted_pages()["pages"])
    assert got == want


def test_pages_with_a_dotted_capital(spark, tmp_path):
    got, want = same(spark, tmp_path, "search_matched_pages", **dotted_pages())
    assert got == want
    assert (1, 1, "https://İSTANBUL.org/kelvin", "page 0") in [r[:4] for r in got]
