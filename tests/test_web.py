"""The site_pages data source against a local server: scope, order, redirects, retries, pace, errors, streams that start again."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessella import __main__ as command
from tessella.plans.kb import KnowledgeBase
from tessella.sources import web
from tessella.streaming.ingest import ingest_site


class Site(BaseHTTPRequestHandler):
    log: list = []
    listed: list = []

    def do_GET(self):
        root = f"http://{self.headers['Host']}"
        self.log.append((time.monotonic(), self.path))
        body, code, more = f"<h1>{self.path}</h1><main>{'word ' * 20}</main>", 200, {}
        if self.path == "/index.xml":
            body = f"<sitemapindex><sitemap><loc>{root}/a.xml</loc></sitemap><sitemap><loc> {root}/index.xml </loc></sitemap></sitemapindex>"
        elif self.path == "/a.xml":
            body = "<urlset>" + "".join(f"<url><loc>{root}{p}</loc>{f'<lastmod>{m}</lastmod>' if m else ''}</url>" for p, m in self.listed) + "</urlset>"
        elif self.path == "/docs/moved":
            code, more = 302, {"Location": f"{root}/docs/target"}
        elif self.path == "/docs/busy" and sum(p == self.path for _, p in self.log) < 3:
            code = 503
        elif self.path == "/docs/gone":
            code = 404
        self.send_response(code)
        for k, v in {"Content-Type": "text/html", **more}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def root(spark):
    Site.log.clear()
    Site.listed[:] = [("/docs/1", "2024-01-01"), ("/docs/moved", "2024-01-02"), ("/other", ""), ("/docs/busy", ""), ("/docs/gone", "2024-01-02"), ("/docs/1", "2024-01-01")]
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(web.SitePages)
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def options(reader, root, **more):
    settings = {"sitemaps": f"{root}/index.xml", "base": f"{root}/docs", "delay": "0", "wait": "0", **more}
    return reader.format("site_pages").options(**settings)


def test_batch(spark, root):
    got = sorted(options(spark.read, root).load().collect(), key=lambda r: r.ord)
    assert [r.url.removeprefix(root) for r in got] == ["/docs/1", "/docs/moved", "/docs/busy", "/docs/gone"]
    assert [r.title for r in got] == ["/docs/1", "/docs/target", "/docs/busy", None]
    assert got[0].content == ("word " * 20).strip() and got[0].lastmod == "2024-01-01"
    assert [r.error for r in got[:3]] == [None] * 3 and "404" in got[3].error
    asked = [p for _, p in Site.log]
    assert asked.count("/docs/busy") == 3 and asked.count("/docs/gone") == 1  # busy is asked again, gone is not
    assert options(spark.read, root, base=f"{root}/none").load().isEmpty()
    failing = options(spark.read, root, attempts="1").load()
    Site.log.clear()
    assert failing.where("url like '%busy' and error like '%503%'").count() == 1


def test_pace(spark, root):
    options(spark.read, root, delay="0.15").load().collect()
    pages = [t for t, p in Site.log if p.startswith("/docs") and p != "/docs/target"]
    assert min(b - a for a, b in zip(pages, pages[1:], strict=False)) > 0.14


def test_unreadable_sitemap(spark, root):
    with pytest.raises(Exception, match="404"):
        options(spark.read, root, sitemaps=f"{root}/docs/gone").load().collect()
    with pytest.raises(Exception, match="sitemaps"):
        spark.read.format("site_pages").load().collect()


def test_stream_starts_again(spark, root, tmp_path):
    def run():
        stream = options(spark.readStream, root).load().writeStream.format("parquet")
        query = stream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.url.removeprefix(root) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = ["/docs/1", "/docs/busy", "/docs/gone", "/docs/moved"]
    assert run() == first
    Site.listed += [("/docs/2", "2024-03-01")]
    Site.listed[1] = ("/docs/moved", "2024-02-01")
    assert run() == sorted([*first, "/docs/2", "/docs/moved"])
    Site.log.clear()
    assert run() == sorted([*first, "/docs/2", "/docs/moved"])
    assert not [p for _, p in Site.log if p.startswith("/docs")]  # nothing changed, no page is read


def test_site_is_indexed_as_it_changes(spark, root, tmp_path):
    """Counts come from the pass that reads; unchanged pages are neither read nor indexed again."""
    kb, reported = KnowledgeBase(spark, f"file://{tmp_path}/kb"), []
    settings = {"sitemaps": f"{root}/index.xml", "base": f"{root}/docs", "delay": "0", "wait": "0"}
    told = ingest_site(spark, settings, kb, f"{tmp_path}/at", reported.append)
    assert told == reported and [{k: r[k] for k in ("found", "crawled", "failed", "short")} for r in told if r["found"]] == [{"found": 4, "crawled": 3, "failed": 1, "short": 0}]
    assert sorted(r.doc_key.removeprefix(root) for r in kb.chunks().collect()) == ["/docs/1", "/docs/busy", "/docs/moved"]
    assert spark.read.json(f"{tmp_path}/at_errors").first().url == f"{root}/docs/gone"
    before = kb.table.manifest()["version"]
    Site.log.clear()
    Site.listed[0] = ("/docs/1", "2025-01-01")
    told = ingest_site(spark, settings, kb, f"{tmp_path}/at")
    assert sum(r["found"] for r in told) == 1 and [p for _, p in Site.log if p.startswith("/docs")] == ["/docs/1"]
    assert kb.table.manifest()["version"] == before  # the page was read, its text is the same


def test_seed_command_by_checkpoint(spark, root, tmp_path, capsys):
    args = ["seed", "--kb", f"{tmp_path}/kb", "--sitemap", f"{root}/index.xml", "--base", f"{root}/docs", "--delay", "0", "--checkpoint", f"{tmp_path}/at"]
    assert command.main(args) == 0
    assert "'found': 4, 'crawled': 3, 'failed': 1" in capsys.readouterr().out
