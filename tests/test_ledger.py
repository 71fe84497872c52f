"""Providers are asked once for each input: counted by calls, over retries, failures, evaluations and runs."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessella import ledger as L
from tessella.operators import requirements as R
from tessella.plans.engine import Engine, requirements_from_json
from tessella.plans.kb import KnowledgeBase
from tessella.providers import completed, embedded, searched
from tessella.sources import files, pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find test modules


class Counting:
    """A provider of every kind that writes down what it is asked; inputs with 'bad' fail until there is a file 'mended'."""

    def __init__(self, folder, identity="counting"):
        self.folder, self.identity = str(folder), identity

    def note(self, kind, text):
        with open(f"{self.folder}/{kind}", "a") as f:
            f.write(json.dumps(text) + "\n")
        if "bad" in text and not Path(f"{self.folder}/mended").exists():
            raise OSError("no answer")

    def complete(self, prompts):
        return [self.note("chat", p) or (None if p == "none" else f"{p}, said") for p in prompts]

    def embed(self, texts):
        return [self.note("embedding", t) or [float(len(t)), 1.0, float(t.count("a"))] for t in texts]

    def search(self, query, limit):
        self.note("web", query)
        return [{"href": f"https://www.example.com/{len(query)}", "title": None}, {"body": "b"}]

    def fetch(self, url):
        self.note("page", url)
        return f"<h1>{url}</h1><main>{'word ' * 30}</main>"

    def asked(self, kind):
        path = Path(f"{self.folder}/{kind}")
        return sorted(json.loads(x) for x in path.read_text().splitlines()) if path.exists() else []


@pytest.fixture
def provider(tmp_path, monkeypatch):
    monkeypatch.setattr("tessella.providers.retried", lambda call, *args: call(*args))
    (tmp_path / "calls").mkdir()
    return Counting(tmp_path / "calls")


@pytest.fixture
def book(spark, tmp_path):
    return L.CallLedger(spark, f"file://{tmp_path}/ledger", 3)


def test_each_input_once(spark, provider, book):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "none")] + [(10 + i, "c") for i in range(40)], "id int, prompt string").repartition(5)
    found = completed(frame, provider, ledger=book)
    for _ in range(3):
        got = {r.id: r.answer for r in found.collect()}
    assert (got[1], got[3], got[2], got[4], got[5], got[49]) == ("a, said", "a, said", "b, said", None, "", "c, said") and len(got) == 45
    again = completed(spark.createDataFrame([(1, "c"), (2, "d")], "id int, prompt string"), provider, ledger=book)
    assert {r.id: r.answer for r in again.collect()} == {1: "c, said", 2: "d, said"}
    assert provider.asked("chat") == ["a", "b", "c", "d", "none"]
    other = completed(frame.where("id = 1"), Counting(provider.folder, "another"), ledger=book)
    assert other.first().answer == "a, said" and provider.asked("chat").count("a") == 2


def test_failures_lose_no_answer(spark, provider, book):
    frame = spark.createDataFrame([(i, f"q{i}") for i in range(9)] + [(9, "bad")], "id int, prompt string").coalesce(1)
    with pytest.raises(L.CallsFailed, match="1 calls of chat failed, the first one: OSError: no answer"):
        completed(frame, provider, ledger=book)
    assert len(provider.asked("chat")) == 10
    Path(provider.folder, "mended").touch()
    assert completed(frame, provider, ledger=book).where("answer like '%said'").count() == 10
    assert provider.asked("chat") == ["bad", "bad", *(f"q{i}" for i in range(9))]
    assert book.calls("chat", "string").where("error is not null").count() == 1


def test_search_and_vectors(spark, provider, book):
    frame = spark.createDataFrame([(7, "x y", "x y"), (8, "bad", "aa")], "query_id long, query string, text string")
    found = searched(frame, provider, 2, "s.example", ledger=book)
    want = [(7, 1, "https://www.example.com/18", "", "", "", "web"), (7, 2, "", "", "b", "b", "web")]
    for _ in range(2):
        assert sorted(tuple(r) for r in found.collect()) == want
    assert provider.asked("web") == ["site:s.example bad", "site:s.example x y"]
    assert sorted(tuple(r) for r in searched(frame, provider, 2, "s.example").collect()) == want  # without a ledger the same
    vectors = embedded(frame, provider, ledger=book).select("query_id", "embedding")
    assert {r.query_id: r.embedding for r in vectors.collect()} == {7: [3.0, 1.0, 0.0], 8: [2.0, 1.0, 2.0]}


def test_two_drivers_and_compaction(spark, provider, book):
    """Both ask at once: the earlier answer counts for all; compacting keeps it and nothing else."""
    frame = spark.createDataFrame([("k", "p")], "id string, prompt string")
    absent = frame.select(F.sha2(F.concat(F.lit("chat\x1fcounting\x1f"), "prompt"), 256).alias("key"), F.col("prompt").alias("input"))
    for answer in ("first", "second"):
        book._add(absent, "chat", "string", lambda _, a=answer: [a], 1)
    book._add(spark.createDataFrame([("x", "y")], "key string, input string"), "chat", "string", lambda _: 1 / 0, 1)
    assert completed(frame, provider, ledger=book).first().answer == "first" and not provider.asked("chat")
    assert book.calls("chat", "string").count() == 3
    book.compact("chat", "string")
    assert book.calls("chat", "string").count() == 1 and completed(frame, provider, ledger=book).first().answer == "first"


def test_nothing_to_ask(spark, provider, book):
    frame = spark.createDataFrame([(1, None)], "id int, prompt string")
    assert completed(frame, provider, ledger=book).first().answer is None
    assert completed(frame.limit(0), provider, ledger=book).isEmpty()


def test_identity():
    from tessella.clients import ChatModel, EmbeddingModel
    from tessella.providers import ReplayLLM

    chat = lambda **more: L.identity(ChatModel("http://x/v1", "m", **more))
    assert chat() == chat(key_variable="OTHER", timeout=3) != chat(temperature=0.9)
    assert L.identity(EmbeddingModel("http://x", "m")) != L.identity(EmbeddingModel("http://x", "n"))
    assert L.identity(ReplayLLM({"a": "b"})) == L.identity(ReplayLLM({"a": "b"})) != L.identity(ReplayLLM({"a": "c"}))


def test_base_embeds_once(spark, provider, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", provider=provider)
    kb.add(files.from_rows(spark, [{"text": "one a"}, {"text": "two aaaa"}, {"text": "one a"}]))
    assert provider.asked("embedding") == ["one a", "two aaaa"]
    asked = spark.createDataFrame([(1, "a query"), (2, "another one")], "query_id long, text string")
    for _ in range(2):
        assert kb.search(asked, 2).count() == 4
    assert provider.asked("embedding") == ["a query", "another one", "one a", "two aaaa"]


def test_live_search_asks_once(spark, provider, tmp_path):
    """Three requirements: one keyword prompt each, one web search for each tier that is reached, however often results are used."""
    engine = Engine(spark, f"file://{tmp_path}/kb", llm=provider, web=provider)
    reqs = requirements_from_json(spark, json.dumps([{"id": i, "document_name": "d", "text": f"text {i}", "category": c} for i, c in enumerate(("sla", "legal", "other"))]))
    index = spark.createDataFrame([("docs/nothing", "https://example.com/docs/nothing", 0)], "path string, url string, ord long")
    cached = spark.createDataFrame([], "url string, title string, content string")
    hits = engine.live_hits(reqs, index, cached)
    for _ in range(2):
        assert {h.source_type for h in hits.collect()} == {"web"}
    assert len(provider.asked("chat")) == 3 and len(provider.asked("web")) == 3
    verdicts = engine.analyze(reqs, "live", hits)
    assert verdicts.count() == 3 and verdicts.count() == 3
    assert len(provider.asked("chat")) == 6
    engine.analyze(reqs, "live", hits).collect()
    engine.live_hits(reqs, index, cached).collect()
    assert len(provider.asked("chat")) == 6 and len(provider.asked("web")) == 3


def test_extraction_and_summary_ask_once(spark, provider, book):
    documents = spark.createDataFrame([("d", "a text"), ("e", "a text")], "document_name string, text string")
    found = R.extract_requirements(documents, provider, ledger=book)
    assert found.count() == 0 and found.count() == 0 and len(provider.asked("chat")) == 1


def test_pages_are_written_through(spark, provider, tmp_path):
    folder = f"file://{tmp_path}/pages"
    urls = spark.createDataFrame([(i, f"https://e.example/{n}") for i, n in enumerate(("a", "b", "bad", "c"))], "ord long, url string")
    got, failed = pages.read_through(urls, folder, provider, concurrency=2)
    for _ in range(2):
        assert [r.ord for r in got.orderBy("ord").collect()] == [0, 1, 3]
    assert [(r.url[-3:], r.error) for r in failed.collect()] == [("bad", "OSError: no answer")]
    assert len(provider.asked("page")) == 4
    more = urls.union(spark.createDataFrame([(9, "https://e.example/d")], urls.schema))
    Path(provider.folder, "mended").touch()
    got, failed = pages.read_through(more, folder, provider, concurrency=2)
    assert [r.ord for r in got.orderBy("ord").collect()] == [0, 1, 2, 3, 9] and failed.isEmpty()
    assert [x.rsplit("/")[-1] for x in provider.asked("page")] == ["a", "b", "bad", "bad", "c", "d"]
    (tmp_path / "pages" / "single.json").write_text(json.dumps({"url": "https://e.example/z", "title": "t", "content": "z" * 60}, indent=2))
    assert pages.read_cache(spark, folder).count() == 6
    counts = {}
    got, _ = pages.read_through(more, folder, provider, max_pages=2, metrics=counts)
    assert counts == {"found": 5, "cached": 2, "fetched": 0, "failed": 0}
    assert [r.ord for r in got.orderBy("ord").collect()] == [0, 1] and len(provider.asked("page")) == 6
