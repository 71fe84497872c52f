"""Pages of a site as a Spark data source, in batches and as a stream.

    spark.dataSource.register(SitePages)
    spark.read.format("site_pages").option("sitemaps", "https://example.com/sitemap.xml").load()

The pages are those that sitemaps list, nested ones too. All pages of a host are one partition: they are
read one after another, at least ``delay`` seconds apart, while other hosts are read at the same time. A page
that can't be read after ``attempts`` is a row with an error. As a stream a batch has the pages whose
``lastmod`` is later than the offset of the batch before, so a query that starts again reads on where it
ended; pages without lastmod come in the first batch only.

Like every source it is read again with every evaluation of its plan: write a batch before using it twice.

Options: sitemaps (addresses, separated by blanks), base (starts of the addresses in scope, likewise; all by
default), delay (0.2), timeout (30), attempts (3), wait (1 second, times the attempt), parity (false).
"""

from __future__ import annotations

import html
import re
import time
import urllib.parse
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..clients import HttpFetcher
from ..functions.html import page
from ..schemas import CRAWLED_PAGE

SCHEMA = f"ord long, {CRAWLED_PAGE}, lastmod string, error string"

#: Leaf sitemaps at most, of 50,000 pages each by the protocol; a site with more raises.
MOST_SITEMAPS = 100_000


class Listed(InputPartition):
    """The sitemaps of a host, and between which times (exclusive, inclusive) a page must have changed."""

    def __init__(self, host: str, sitemaps: list[tuple[int, str]], after: str | None, until: str | None):
        self.host, self.sitemaps, self.after, self.until = host, sitemaps, after, until


def entries(xml: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Nested sitemaps, and (address, lastmod) of pages, '' for none."""
    plain = re.sub(r"<!--.*?-->", "", xml, flags=re.S)
    loc = lambda block, tag: (re.findall(rf"<{tag}>\s*(.*?)\s*</{tag}>", block, re.S) or [""])[0]
    blocks = lambda tag: re.findall(rf"<{tag}>(.*?)</{tag}>", plain, re.S)
    nested = [html.unescape(loc(b, "loc")) for b in blocks("sitemap")]
    return [n for n in nested if n], [(html.unescape(loc(b, "loc")), loc(b, "lastmod")) for b in blocks("url") if loc(b, "loc")]


class Paced:
    """Fetches from one host, with pauses between requests and retries."""

    def __init__(self, delay: float, timeout: float, attempts: int, wait: float, sleep: Callable[[float], None] = time.sleep):
        self.fetcher, self.delay, self.attempts, self.wait, self.sleep = HttpFetcher(timeout, 0.0), delay, attempts, wait, sleep
        self.last = 0.0

    def get(self, url: str) -> str | None:
        for attempt in range(1, self.attempts + 1):
            pause = self.last + self.delay - time.monotonic()
            if pause > 0:
                self.sleep(pause)
            try:
                return self.fetcher.fetch(url)
            except Exception as e:
                code = getattr(e, "code", None)
                gone = code is not None and code < 500 and code != 429  # asking again won't help
                if gone or attempt == self.attempts:
                    raise
                self.sleep(self.wait * attempt)
            finally:
                self.last = time.monotonic()


class _Reading:
    """What reading in batches and as a stream share."""

    def __init__(self, options: dict):
        self.roots, self.bases = options.get("sitemaps", "").split(), options.get("base", "").split()
        if not self.roots:
            raise ValueError("the option sitemaps is needed")
        self.pace = [float(options.get("delay", 0.2)), float(options.get("timeout", 30)), int(options.get("attempts", 3)), float(options.get("wait", 1.0))]
        self.parity = str(options.get("parity", "false")).lower() == "true"

    def leaves(self) -> list[tuple[str, str]]:
        """(address, xml) of the sitemaps that list pages, each once; one that can't be read raises."""
        todo, seen, found, fetchers = list(self.roots), set(), [], {}
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if len(seen) > MOST_SITEMAPS:
                raise ValueError(f"there are more than {MOST_SITEMAPS} sitemaps")
            host = urllib.parse.urlsplit(at).netloc
            xml = fetchers.setdefault(host, Paced(*self.pace)).get(at) or ""
            nested, pages = entries(xml)
            todo = nested + todo
            if pages:
                found.append((at, xml))
        return found

    def split(self, after: str | None, until: str | None) -> list[Listed]:
        hosts: dict[str, list[tuple[int, str]]] = {}
        for i, (at, _) in enumerate(self.leaves()):
            hosts.setdefault(urllib.parse.urlsplit(at).netloc, []).append((i, at))
        return [Listed(host, maps, after, until) for host, maps in sorted(hosts.items())]

    def pages(self, part: Listed) -> Iterator[tuple]:
        paced, seen = Paced(*self.pace), set()
        for number, sitemap in part.sitemaps:
            for i, (url, lastmod) in enumerate(entries(paced.get(sitemap) or "")[1]):
                if url in seen or self.bases and not url.startswith(tuple(self.bases)):
                    continue
                if part.after is not None and lastmod <= part.after or part.until is not None and lastmod > part.until:
                    continue
                seen.add(url)
                found, error = {"title": None, "breadcrumbs": None, "content": None, "section_path": None}, None
                try:
                    raw = paced.get(url)
                    if raw is None:
                        error = "no text"
                    else:
                        found = page(raw, self.parity)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield (number * 2**32 + i, url, found["title"], found["breadcrumbs"], found["content"], found["section_path"], lastmod, error)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reading = _Reading(options)

    def partitions(self):
        return self.reading.split(None, None)

    def read(self, partition):
        return self.reading.pages(partition)


class PageStreamReader(DataSourceStreamReader):
    """Offsets are times of change as the sitemaps state them, which sort as texts do in one notation."""

    def __init__(self, options: dict):
        self.reading = _Reading(options)

    def initialOffset(self):  # noqa: N802
        return {"until": None}

    def latestOffset(self):  # noqa: N802
        times = [lastmod for _, xml in self.reading.leaves() for _, lastmod in entries(xml)[1]]
        return {"until": max(times, default=None)}

    def partitions(self, start, end):
        return [] if end["until"] is None else self.reading.split(start["until"], end["until"])

    def read(self, partition):
        return self.reading.pages(partition)

    def commit(self, end):
        pass


class SitePages(DataSource):
    @classmethod
    def name(cls):
        return "site_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(dict(self.options))

    def streamReader(self, schema):  # noqa: N802
        return PageStreamReader(dict(self.options))
