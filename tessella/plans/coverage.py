"""More registered queries: sitemaps, links, projections and filters over the benchmark's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model_json as J
from ..functions import text as T
from ..operators import requirements as R
from ..operators import search as S
from ..operators import verdicts as V
from ..sources import pages as P
from .catalog import _HOST, _VERDICTS, ORACLE_SQL, keyword_url_match, query, table, verdict_rows

_DOMAINS = ("example.com", "example.org")
_TRUSTED = "(h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org')"


@query(f"""
WITH p AS (SELECT url, page_id, {_HOST} AS h FROM pages), r AS (SELECT url, row_number() OVER (ORDER BY h, page_id) AS n FROM p)
SELECT url, n FROM r
""")
def page_sitemap_scan(spark, sf_dir):
    """A sitemap index with one sitemap for each host, read in its order."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    p = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("h"), "page_id", F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")).alias("x"))
    sites = p.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("page_id", "x"))).alias("all"))
    own = F.concat(F.lit("<urlset>"), F.array_join(F.transform("all", lambda s: s["x"]), ""), F.lit("</urlset>"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: F.concat(F.lit("<sitemap><loc> "), h, F.lit(" </loc></sitemap>"))), "")
    index = sites.agg(F.concat(F.lit("<sitemapindex>"), names, F.lit("</sitemapindex>")).alias("xml")).select(F.lit("root").alias("url"), "xml")
    found = P.sitemap_urls(sites.select(F.col("h").alias("url"), own.alias("xml")).union(index), "root")
    return found.select("url", F.expr("row_number() over (order by ord)").cast("long").alias("n"))


@query(f"""
WITH m AS ({ORACLE_SQL["keyword_url_match"]})
SELECT query_id, rank, m.url, 'page ' || page_id::varchar AS title, md5(substr(html, 1, 300)) AS snippet, 'docs' AS source_type
FROM m JOIN pages USING (url) WHERE rank <= 3 AND length(html) >= 2000
""")
def search_matched_pages(spark, sf_dir):
    """Matched urls with their cached pages; a page that is too short leaves a gap."""
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    cached = table(spark, sf_dir, "pages").select("url", title.alias("title"), F.col("html").alias("content"))
    found = S.with_pages(keyword_url_match(spark, sf_dir), cached, 3, "docs", min_content=2000)
    return found.select("query_id", "rank", "url", "title", F.md5("snippet").alias("snippet"), "source_type")


@query("""
WITH h AS (SELECT source AS document_name, (doc_id % 5)::int AS requirement_id, doc_id AS rank,
  CASE WHEN doc_id % 3 = 0 THEN 'ftp://x/' ELSE 'https://x/' END || lang AS url FROM documents),
f AS (SELECT document_name, requirement_id, url, min(rank) AS first FROM h WHERE starts_with(url, 'http') GROUP BY ALL)
SELECT document_name, requirement_id, string_agg(url, ' ' ORDER BY first) AS links FROM f GROUP BY ALL
""")
def search_links(spark, sf_dir):
    """Each requirement's searched links, in order, once."""
    scheme = F.when(F.col("doc_id") % 3 == 0, "ftp://x/").otherwise("https://x/")
    hits = table(spark, sf_dir, "documents").select(
        F.col("source").alias("document_name"), (F.col("doc_id") % 5).cast("int").alias("requirement_id"), F.col("doc_id").alias("rank"),
        F.concat(scheme, "lang").alias("url"),
    )
    return V.searched_links(hits).select("document_name", "requirement_id", F.array_join("searched", " ").alias("links"))


@query(f"""
WITH p AS (SELECT page_id, url, {_HOST} AS h FROM pages)
SELECT page_id, CASE WHEN {_TRUSTED} AND starts_with(url, 'http') THEN url || ' ' || url ELSE '' END AS links FROM p
""")
def links_trusted(spark, sf_dir):
    some = F.array(F.col("url"), F.concat(F.lit("ftp://"), F.col("url")), F.lit(None).cast("string"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.trusted_links(some, _DOMAINS), " ").alias("links"))


@query("SELECT page_id, url || ' a b' AS links FROM pages")
def links_merged(spark, sf_dir):
    both = T.merged_links(F.array(F.col("url"), F.lit("a"), F.col("url")), F.array(F.lit("b"), F.lit("a"), F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(both, " ").alias("links"))


@query("SELECT page_id, lower(replace(url, 'https://', '')) AS path FROM pages")
def page_url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_path(F.col("url"), "https://").alias("path"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""
WITH k AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: lower({_TRIM.format("x")})), lambda x: x <> '') AS ks FROM documents)
SELECT doc_id, md5(array_to_string(ks[1:5], '|')) AS keywords FROM k
""")
def keyword_list(spark, sf_dir):
    """A text read as a model's comma-separated list."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.listed_keywords(F.col("text")), "|")).alias("keywords"))


@query(f"SELECT doc_id, md5({_TRIM.format("replace(text, chr(13), '')")}) AS digest FROM documents")
def doc_pdf_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.pdf_safe(F.col("text"))).alias("digest"))


@query("""
SELECT doc_id, md5(text || chr(10) || chr(10) || '[Таблица из ' || source || ']' || chr(10) || '| lang |' || chr(10) || '| --- |' || chr(10) || '| ' || lang || ' |') AS digest
FROM documents
""")
def doc_full_text(spark, sf_dir):
    """A text with its tables after it."""
    one = F.struct(F.col("source").alias("page_or_section"), F.array(F.lit("lang")).alias("headers"), F.array(F.array("lang")).alias("rows"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.full_text(F.col("text"), F.array(one))).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text ELSE text || chr(10) || source END) AS digest FROM documents")
def requirement_query_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("tables", F.when(F.col("lang") == "en", "").otherwise(F.col("source")))
    return d.select("doc_id", F.md5(R.query_text()).alias("digest"))


@query("SELECT doc_id, md5('In ' || source || ': ' || text || ' (' || lang || ')') AS digest FROM documents")
def requirement_prompt(spark, sf_dir):
    """A prompt template with its places filled."""
    prompt = R.filled("In {source}: {text} ({lang})", source=F.col("source"), text=F.col("text"), lang=F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'file' ELSE 'unknown' END AS label FROM pages")
def search_source_label(spark, sf_dir):
    """A hit's url if it is a web address, else its source."""
    m = F.col("page_id") % 3
    pairs = F.when(m == 0, F.create_map(F.lit("url"), F.col("url"))).when(m == 1, F.create_map(F.lit("url"), F.lit("/x"), F.lit("source"), F.lit("file")))
    pairs = F.coalesce(pairs, F.create_map(F.lit("title"), F.lit("t")))
    return table(spark, sf_dir, "pages").select("page_id", S.hit_source(pairs).alias("label"))


@query(f"""
WITH m AS ({ORACLE_SQL["keyword_url_match"].replace("FROM pages),", "FROM pages WHERE starts_with(lower(replace(url, 'https://', '')), 'www')),", 1)})
SELECT * FROM m
""")
def keyword_prefix_match(spark, sf_dir):
    """Keyword matches among the paths under one prefix."""
    return keyword_url_match(spark, sf_dir, "www")


@query("SELECT source AS document_name, array_to_string(list_sort(list(DISTINCT lang)), ',') AS categories FROM documents GROUP BY source")
def requirement_categories(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("document_name"), F.col("lang").alias("category"))
    return V.categories(d, "document_name").select("document_name", F.array_join("categories", ",").alias("categories"))


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY source")
def requirement_category_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("category", F.col("lang"))
    return V.in_categories(d, ["en", "de"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT source, count(*) FILTER (lang = 'en') AS done, count(*) FILTER (lang <> 'xx') AS n FROM documents GROUP BY source)
SELECT source, CASE WHEN n > 0 THEN floor(done * 100.0 / n)::int ELSE 100 END AS percent FROM d
""")
def progress_percent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("done"), F.count("lang").alias("n"))
    return d.select("source", V.percent_done(F.col("done"), F.col("n")).alias("percent"))


@query(f"""
WITH {_VERDICTS}, s AS (SELECT document_name, count(*) FILTER (verdict NOT IN ('match', 'partial', 'mismatch', 'needs_clarification')) AS unknown_count FROM v GROUP BY 1)
SELECT * FROM s
""")
def verdict_unknown_count(spark, sf_dir):
    return V.unknown_count(verdict_rows(spark, sf_dir), "document_name")


@query("""
WITH r AS (SELECT source AS document_name, (doc_id % 50)::int AS id, max(doc_id) AS ord FROM documents GROUP BY ALL)
SELECT r.document_name, r.id AS requirement_id, d.lang AS section, md5(d.text) AS digest, 'needs_clarification' AS verdict FROM r JOIN documents d ON d.doc_id = r.ord
""")
def requirement_last_wins(spark, sf_dir):
    """Of requirements with one id in a document the last counts."""
    d = table(spark, sf_dir, "documents")
    r = d.select(
        F.col("source").alias("document_name"), (F.col("doc_id") % 50).cast("int").alias("id"), F.col("lang").alias("section"), "text",
        F.lit("sla").alias("category"), "doc_id",
    )
    none = spark.createDataFrame(
        [], "document_name string, requirement_id int, verdict string, confidence double, reasoning string, evidence string, recommendation string, source_urls array<string>"
    )
    merged = V.merge_answers(r, none, "doc_id")
    return merged.select("document_name", "requirement_id", "section", F.md5("requirement_text").alias("digest"), "verdict")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 WHEN event_id % 4 = 1 THEN 0.5 ELSE value END::double AS confidence FROM events
""")
def json_confidence(spark, sf_dir):
    """A model's confidence: a number, 0.5 where there is none or it can't be read."""
    m = F.col("event_id") % 4
    said = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "high").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", J.confidence(said).alias("confidence"))


@query("SELECT event_id, event_type AS section, upper(event_type) AS text, event_id::varchar AS tables FROM events")
def json_records(spark, sf_dir):
    """Records in an envelope under other names, as a model gives them."""
    answer = F.concat(
        F.lit('Here: {"requirements": [{"Clause": "'), "event_type", F.lit('", "text": " ", "Requirement": "'), F.upper("event_type"),
        F.lit('", "table": "'), F.col("event_id").cast("string"), F.lit('"}, 7]}'),
    )
    r = table(spark, sf_dir, "events").select("event_id", F.explode(R.records(answer)).alias("r"))
    return r.select("event_id", "r.section", "r.text", "r.tables")


@query("SELECT page_id, url AS doc_key, md5(html) AS digest, 'docs' AS source, 'p' AS title FROM pages WHERE regexp_matches(html, '\\S')")
def page_documents(spark, sf_dir):
    """Crawled pages as documents with their metadata."""
    p = table(spark, sf_dir, "pages")
    crawled = p.select("page_id", "url", F.lit("p").alias("title"), F.lit("s").alias("section_path"), F.col("html").alias("content"))
    d = P.to_documents(crawled, keep=("page_id",))
    return d.select("page_id", "doc_key", F.md5("text").alias("digest"), F.element_at("metadata", "source").alias("source"), F.element_at("metadata", "title").alias("title"))


@query("""
WITH r AS (SELECT source, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM r)
SELECT source, digest, doc_id FROM n WHERE n <= 5
""")
def search_first_results(spark, sf_dir):
    """The first five different results of each query."""
    texts = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("digest"), "doc_id")
    return S.first_seen(texts, ["source", "digest"], ["doc_id"], limit=5)
