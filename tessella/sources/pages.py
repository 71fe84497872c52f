"""Pages: sitemaps, scope, read-through cache, crawl, extraction."""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..functions.html import extracted, page
from ..providers import Fetcher
from ..schemas import CRAWLED_PAGE

_LOC = "/text()"


def sitemap_urls(sitemaps: DataFrame, root: str) -> DataFrame:
    """Urls (ord, url) of a sitemap in landed ``sitemaps`` (url, xml): those of nested sitemaps first.

    Nesting is followed by a recursive query; a sitemap is not followed again below itself, so cycles end. It may
    go as deep and as wide as spark.sql.cteRecursionLevelLimit and cteRecursionRowLimit let it (100 levels, a
    million sitemaps). Order is depth-first, as a recursive reader would give; repeats stay.
    """
    spark = sitemaps.sparkSession
    sm = sitemaps.select(
        F.col("url").alias("at"),
        F.transform(F.xpath("xml", F.lit("/sitemapindex/sitemap/loc" + _LOC)), T.strip).alias("nested"),
        F.transform(F.xpath("xml", F.lit("/*/url/loc" + _LOC)), T.strip).alias("own"),
    )
    view = f"sitemaps_{uuid.uuid4().hex}"
    sm.select("at", F.posexplode("nested").alias("i", "next")).createOrReplaceTempView(view)
    walk = spark.sql(
        f"""
        WITH RECURSIVE walk(at, path, seen) AS (
          SELECT :root, cast(array() AS array<int>), array(:root)
          UNION ALL
          SELECT n.next, array_append(w.path, n.i), array_append(w.seen, n.next)
          FROM walk w JOIN {view} n ON w.at = n.at WHERE NOT array_contains(w.seen, n.next)
        )
        SELECT at, path FROM walk
        """,
        args={"root": root},
    )
    spark.catalog.dropTempView(view)
    # A nested sitemap's entries sort before the parent's own ones, which go by the largest step.
    rows = walk.join(sm, "at").select("path", F.posexplode("own").alias("i", "url"))
    ordered = rows.select(F.concat("path", F.array(F.lit(2**31 - 1), F.col("i"))).alias("path"), "url").orderBy("path")
    return ordered.select(F.monotonically_increasing_id().alias("ord"), "url")


def land_sitemaps(spark: SparkSession, root: str, fetcher: Fetcher, most: int = 10_000) -> DataFrame:
    """Sitemaps (url, xml) from ``root`` on, nested ones too; those that can't be read are left out.

    A site has few sitemaps (of 50,000 pages each by the protocol): the driver fetches them one by one.
    """
    todo, landed = [root], {}
    while todo and len(landed) < most:
        at = todo.pop(0)
        if at in landed:
            continue
        try:
            landed[at] = fetcher.fetch(at) or ""
        except Exception:
            landed[at] = ""
        plain = re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"", "", re.sub(r"^\s*<\?xml[^>]*\?>", "", landed[at]))
        landed[at] = plain.strip()
        if "<sitemapindex" in plain:
            todo += [html.unescape(x.strip()) for x in re.findall(r"<loc>(.*?)</loc>", plain, re.S)]
    rows = [(k, v) for k, v in landed.items() if v]
    return spark.createDataFrame(rows, "url string, xml string")


def seed_urls(spark: SparkSession, sitemaps: list[str], fetcher: Fetcher, bases: list[str], fallback: str) -> DataFrame:
    """Urls (ord, url) of the sitemaps in scope, each once in first order; the fallback if there are none."""
    found = union_of_sitemaps(*[sitemap_urls(land_sitemaps(spark, s, fetcher), s) for s in sitemaps])
    first = in_scope(found, *bases).groupBy("url").agg(F.min(F.struct("part", "ord")).alias("o"))
    listed = first.select(F.row_number().over(W.orderBy("o")).cast("long").alias("ord"), "url")
    if listed.isEmpty():
        return spark.createDataFrame([(1, fallback)], "ord long, url string")
    return listed


def in_scope(urls: DataFrame, *bases: str) -> DataFrame:
    """Urls that start with one of the bases (a plain prefix, which reaches the Parquet reader)."""
    keep = F.lit(False)
    for base in bases:
        keep = keep | F.startswith("url", F.lit(base))
    return urls.where(keep)


def union_of_sitemaps(*parts: DataFrame) -> DataFrame:
    """All urls, repeats included, in order of the parts."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), "ord", "url")
        out = p if out is None else out.unionByName(p)
    return out


def extract_pages(raw: DataFrame, parity: bool = False) -> DataFrame:
    """Crawled pages from ``raw`` (url, html)."""
    return raw.select("url", extracted(F.col("html"), parity).alias("p")).select(
        "url", "p.title", "p.breadcrumbs", "p.content", "p.section_path"
    )


def long_enough(pages: DataFrame, n: int = 50) -> DataFrame:
    return pages.where(F.length("content") >= n)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached pages; corrupt files and pages without content are misses.

    Spark's own files (part-...) hold a page in each line, other ones one page, over as many lines as it takes.
    """
    read = spark.read.schema(CRAWLED_PAGE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    lines = read.option("pathGlobFilter", "part-*").json(folder)
    single = read.option("multiLine", True).option("pathGlobFilter", "{[!p]*,p[!a]*,pa[!r]*,par[!t]*,part[!-]*}").json(folder)
    return lines.unionByName(single).where("_corrupt is null and url is not null and content <> ''").drop("_corrupt")


def write_cache(pages: DataFrame, folder: str) -> None:
    """Appends pages under the md5 of their url."""
    pages.withColumn("key", T.cache_key(F.col("url"))).write.mode("append").json(folder)


def fetched(urls: DataFrame, fetcher: Fetcher, concurrency: int = 10, parity: bool = False) -> DataFrame:
    """``urls`` (ord, url) with the columns of a page and ``error``: what went wrong, null for a page that was read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        columns = ["ord", "url", "title", "breadcrumbs", "content", "section_path", "error"]
        for frame in frames:
            rows = []
            for ord_, url in zip(frame["ord"], frame["url"], strict=True):
                try:
                    raw = fetcher.fetch(url)
                    found = {"error": "no text"} if raw is None else page(raw, parity)
                except Exception as e:
                    found = {"error": f"{type(e).__name__}: {e}"}
                rows.append({"ord": ord_, "url": url, **found})
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    kind = urls.schema["ord"].dataType.simpleString()
    return urls.select("ord", "url").repartition(concurrency).mapInPandas(run, f"ord {kind}, {CRAWLED_PAGE}, error string")


def split_by_cache(urls: DataFrame, cache: DataFrame, max_pages: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hits with their pages and misses among ``urls`` (ord, url), of which ``max_pages`` > 0 takes the first ones."""
    if max_pages > 0:
        urls = urls.orderBy("ord").limit(max_pages)
    keyed = urls.select("ord", "url", T.cache_key(F.col("url")).alias("key"))
    known = cache.where("content <> ''").withColumn("key", T.cache_key(F.col("url"))).dropDuplicates(["key"])
    hits = keyed.join(known.drop("url"), "key").drop("key")
    return hits, keyed.join(known.select("key"), "key", "left_anti").select("ord", "url")


def crawl(urls: DataFrame, cache: DataFrame, fetcher: Fetcher, max_pages: int = 0, concurrency: int = 10, parity: bool = False, least: int = 50) -> DataFrame:
    """Pages of ``urls`` (ord, url): cached ones, the others fetched in ``concurrency`` partitions.

    A failing fetch gives nothing; short pages are left out. Returns ord and the columns of a page. Pages
    are fetched again whenever the result is evaluated; ``read_through`` fetches them once.
    """
    hits, misses = split_by_cache(urls, cache, max_pages)
    read = fetched(misses, fetcher, concurrency, parity).where("error is null").drop("error")
    return long_enough(hits.unionByName(read), least)


def read_through(
    urls: DataFrame, folder: str, fetcher: Fetcher, max_pages: int = 0, concurrency: int = 10, parity: bool = False, least: int = 50,
    metrics: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pages of ``urls`` (ord, url) by the page cache in ``folder``, and the errors (url, error) of those not read.

    What is not cached is fetched once, written to the cache, errors beside it, and read back: evaluating
    the result again fetches nothing. Failures and pages without content are fetched again next time.
    ``metrics`` is given the counts found, cached, fetched and failed, observed in the passes that write.
    """
    spark = urls.sparkSession
    cache = read_cache(spark, folder) if storage.names(spark, folder) else spark.createDataFrame([], CRAWLED_PAGE)
    base = storage.scratch(spark)
    listed, cached, crawled = Observation("listed"), Observation("cached"), Observation("crawled")
    urls = storage.keep(urls.select("ord", "url").observe(listed, F.count(F.lit(1)).alias("found")), f"{base}/urls")
    hits, misses = split_by_cache(urls, cache, max_pages)
    hits = storage.keep(hits.observe(cached, F.count(F.lit(1)).alias("cached")), f"{base}/hits")  # before the cache grows
    counted = [F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed")]
    read = storage.keep(fetched(misses, fetcher, concurrency, parity).observe(crawled, *counted), f"{base}/read")
    if metrics is not None:
        metrics |= listed.get | cached.get | crawled.get
    good = read.where("error is null").drop("error")
    failed = read.where("error is not null").select("url", "error")
    write_cache(good.drop("ord").where("content <> ''"), folder)
    failed.write.mode("append").json(f"{folder.rstrip('/')}/_errors")  # readers pass over names with an underscore
    return long_enough(hits.unionByName(good), least), failed


def to_documents(pages: DataFrame, source: str = "docs", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages as documents (doc_key, text, metadata) with the columns ``keep``; blank ones are left out."""
    pairs = {"source": F.lit(source), "title": F.col("title"), "section_path": F.col("section_path"), "url": F.col("url")}
    metadata = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return pages.where(T.not_blank(F.col("content"))).select(F.col("url").alias("doc_key"), F.col("content").alias("text"), metadata.alias("metadata"), *keep)
