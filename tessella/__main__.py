"""python -m tessella seed --kb DIR (--pages DIR | --sitemap URL --base URL) [--checkpoint DIR] [--max-pages N] [--concurrency N] [--clear]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .clients import HttpFetcher
from .config import EngineConfig
from .plans.engine import Engine
from .sources import pages
from .streaming import ingest


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("command", choices=["seed"])
    p.add_argument("--kb", required=True)
    p.add_argument("--pages", help="Parquet of landed pages (url, html and, for their order, ord)")
    p.add_argument("--sitemap", action="append", default=[], help="address of a sitemap; may be repeated")
    p.add_argument("--base", action="append", default=[], help="start of the addresses in scope; the first is read if no sitemap is")
    p.add_argument("--cache", help="folder of pages read before, which pages read now are added to (default: beside the base)")
    p.add_argument("--checkpoint", help="read only pages that changed since the last run with this folder, a host at a time")
    p.add_argument("--max-pages", type=int, default=0)
    p.add_argument("--concurrency", type=int, default=10)
    p.add_argument("--delay", type=float, default=0.2)
    p.add_argument("--clear", action="store_true")
    a = p.parse_args(args)
    if not a.pages and not (a.sitemap and a.base):
        p.error("either --pages or --sitemap and --base are needed")
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    engine = Engine(spark, a.kb, EngineConfig(crawl_max_pages=a.max_pages, crawl_concurrency=a.concurrency))
    if a.clear:
        engine.kb.reset()
    found: dict = {}
    if a.checkpoint:
        options = {"sitemaps": " ".join(a.sitemap), "base": " ".join(a.base), "delay": str(a.delay)}
        for row in ingest.ingest_site(spark, options, engine.kb, a.checkpoint, report=print):
            found = {k: found.get(k, 0) + v for k, v in row.items() if k != "batch"}
        print({**found, **engine.kb.status().first().asDict()})
        return 0
    if a.pages:
        raw = spark.read.parquet(a.pages)
        if a.max_pages > 0:  # in the order of the sitemap, if the landed pages know it
            raw = raw.orderBy(F.col("ord" if "ord" in raw.columns else "url")).limit(a.max_pages)
        crawled = pages.long_enough(pages.extract_pages(raw.repartition(a.concurrency)))
    else:
        fetcher = HttpFetcher(delay=a.delay)
        urls = pages.seed_urls(spark, a.sitemap, fetcher, a.base, a.base[0])
        cache = a.cache or f"{a.kb.rstrip('/')}_pages"
        crawled, _ = pages.read_through(urls, cache, fetcher, a.max_pages, a.concurrency, metrics=found)
    print({**found, **engine.ingest_pages(crawled)})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
