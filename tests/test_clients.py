"""HTTP providers, sitemap seeding and the seed command against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessella import __main__ as command
from tessella import clients
from tessella.config import EngineConfig
from tessella.plans.engine import Engine
from tessella.plans.kb import KnowledgeBase
from tessella.providers import RuleLLM, completed, embedded
from tessella.sources import files, pages


class Site(BaseHTTPRequestHandler):
    asked: list = []

    def answer(self, body, kind="text/html", code=200, **headers):
        self.send_response(code)
        for k, v in {"Content-Type": kind, **headers}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        root = f"http://127.0.0.1:{self.server.server_port}"
        page = lambda n: f"<h1>Page {n}</h1><main>{'word ' * 30}{n}</main>"
        loc = lambda *paths: "".join(f"<url><loc> {root}{p} </loc></url>" for p in paths)
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
        if self.path == "/index.xml":
            nested = f"<sitemap><loc>{root}/a.xml</loc></sitemap><sitemap><loc>{root}/gone.xml</loc></sitemap>"
            self.answer(f"{head}<sitemapindex {space}>{nested}</sitemapindex>", "application/xml")
        elif self.path == "/a.xml":
            self.answer(f"{head}<urlset {space}>{loc('/docs/1', '/docs/2', '/other', '/docs/1', '/docs/moved', '/docs/short')}</urlset>", "text/xml")
        elif self.path == "/docs/moved":
            self.answer("", code=302, Location=f"{root}/docs/3")
        elif self.path == "/docs/short":
            self.answer("<main>x</main>")
        elif self.path.startswith("/docs"):
            self.answer(page(self.path))
        elif self.path.startswith("/find"):
            self.answer(json.dumps([{"href": "u", "title": "t", "body": self.path}, 3]), "application/json")
        elif self.path == "/binary":
            self.answer("x", "image/png")
        else:
            self.answer("no", code=404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.headers.get("Authorization"), body))
        if self.path == "/v1/embeddings":
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            self.answer(json.dumps({"data": data[::-1]}), "application/json")
        else:
            said = {"content": f"[{body['messages'][-1]['content']}]"} if body["messages"][-1]["content"] != "none" else {"content": None}
            self.answer(json.dumps({"choices": [{"message": said}]}), "application/json")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def root():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetcher(root):
    fetcher = clients.HttpFetcher(delay=0)
    assert "Page /docs/3" in fetcher.fetch(f"{root}/docs/moved") and fetcher.fetch(f"{root}/binary") is None
    with pytest.raises(OSError):
        fetcher.fetch(f"{root}/gone")


def test_models(spark, root, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    chat = clients.ChatModel(f"{root}/v1", "m", "SOME_KEY", system="s", temperature=0.5, max_tokens=7)
    assert chat.complete(["a", "none"]) == ["[a]", ""]
    key, body = Site.asked[-2]
    assert key == "Bearer k" and (body["temperature"], body["max_tokens"], body["messages"][0]["role"]) == (0.5, 7, "system")
    frame = spark.createDataFrame([(1, "bb"), (2, "c")], "id int, text string")
    vectors = embedded(frame, clients.EmbeddingModel(f"{root}/v1", "e", "NO_SUCH_KEY"))
    assert [(r.id, r.embedding) for r in vectors.orderBy("id").collect()] == [(1, [2.0, 1.0]), (2, [1.0, 1.0])]
    asked = completed(frame.withColumnRenamed("text", "prompt"), clients.ChatModel(f"{root}/v1", "m", "NO_SUCH_KEY"))
    assert {r.id: r.answer for r in asked.collect()} == {1: "[bb]", 2: "[c]"}
    assert clients.JsonWebSearch(f"{root}/find").search("x y", 5) == [{"href": "u", "title": "t", "body": "/find?q=x+y&limit=5"}]
    near = clients.JsonWebSearch(f"{root}/find", region="ru-ru")
    assert near.search("x", 1)[0]["body"] == "/find?q=x&limit=1&region=ru-ru" and near.identity != clients.JsonWebSearch(f"{root}/find").identity


def test_url_index_is_read_once(spark, root, tmp_path):
    class Noting(clients.HttpFetcher):
        asked: list = []

        def fetch(self, url):
            self.asked.append(url)
            return super().fetch(url)

    config = EngineConfig(site_root=f"{root}/", sitemap_url=f"{root}/index.xml", docs_base=f"{root}/docs", documents_base=f"{root}/documents")
    engine = Engine(spark, f"file://{tmp_path}/kb", config)
    for _ in range(2):
        got = engine.url_index(Noting(delay=0)).orderBy("ord").collect()
        assert [r.path for r in got] == ["docs/1", "docs/2", "docs/moved", "docs/short"]
    once = len(Noting.asked)
    assert once == 3  # the index, its nested sitemap, the one that is gone
    assert engine.url_index(Noting(delay=0), refresh=True).count() == 4 and len(Noting.asked) == 2 * once


def test_summary_counts_requirements(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": "first text", "b.txt": "second", "c.txt": " "}.items():
        (tmp_path / "in" / name).write_text(text)
    llm = RuleLLM(lambda p: json.dumps([{"text": "one"}, {"text": "two"}]) if "first" in p else "[]")
    engine = Engine(spark, f"file://{tmp_path}/kb", llm=llm)
    found, told = engine.extract_with_summary(f"{tmp_path}/in")
    assert sorted((r.filename, r.text_chars, r.requirements_found) for r in told.collect()) == [("a.txt", 10, 2), ("b.txt", 6, 0), ("c.txt", 1, 0)]
    assert engine.extract(f"{tmp_path}/in").count() == found.count() == 2


def test_seed_urls(spark, root):
    fetcher = clients.HttpFetcher(delay=0)
    urls = pages.seed_urls(spark, [f"{root}/index.xml"], fetcher, [f"{root}/docs"], f"{root}/docs/top")
    got = [(r.ord, r.url.removeprefix(root)) for r in urls.orderBy("ord").collect()]
    assert got == [(1, "/docs/1"), (2, "/docs/2"), (3, "/docs/moved"), (4, "/docs/short")]
    none = pages.seed_urls(spark, [f"{root}/gone.xml"], fetcher, [f"{root}/docs"], f"{root}/docs/top").collect()
    assert [(r.ord, r.url) for r in none] == [(1, f"{root}/docs/top")]


def test_seed_command(spark, root, tmp_path, capsys):
    args = ["seed", "--kb", str(tmp_path / "kb"), "--sitemap", f"{root}/index.xml", "--base", f"{root}/docs", "--delay", "0", "--concurrency", "2"]
    assert command.main(args) == 0
    assert "'crawled': 3, 'indexed': 3" in capsys.readouterr().out
    found = KnowledgeBase(spark, str(tmp_path / "kb")).chunks()
    assert {r.doc_key.removeprefix(root) for r in found.collect()} == {"/docs/1", "/docs/2", "/docs/moved"}
    with pytest.raises(SystemExit):
        command.main(["seed", "--kb", "x"])


def test_uploads(spark, tmp_path):
    for name, data in {"a.md": b"# text", "b.doc": b"broken", "c": b"plain", "d.html": b"<p>x</p>"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r for r in files.read_files(spark, str(tmp_path), files.UPLOADS).collect()}
    assert got["a.md"].text == "# text" and got["c"].text == "plain" and got["d.html"].text == "<p>x</p>"
    assert got["b.doc"].error and "Unsupported" not in got["b.doc"].error
