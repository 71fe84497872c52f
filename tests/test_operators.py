import json

import pytest
from pyspark.sql import functions as F

from tessella.config import EngineConfig
from tessella.operators import requirements as R
from tessella.operators import search as S
from tessella.operators import verdicts as V
from tessella.plans.engine import Engine, download_name, reports_to_json, requirements_from_json, settings_from_json, verdicts_from_json
from tessella.plans.kb import KnowledgeBase
from tessella.providers import RuleLLM, TableFetcher, TableWebSearch, retried
from tessella.sinks import report
from tessella.sources import files, pages
from tessella.streaming import ingest

VERDICT = "document_name string, requirement_id int, section string, requirement_text string, category string, verdict string, confidence double, reasoning string, evidence string, recommendation string, source_urls array<string>"


def verdicts(spark, *kinds, **more):
    base = {"section": "1", "requirement_text": "t", "category": "sla", "confidence": 0.5, "reasoning": "r", "evidence": "", "recommendation": "", "source_urls": []} | more
    rows = [("d", i, base["section"], base["requirement_text"], base["category"], k, base["confidence"], base["reasoning"], base["evidence"], base["recommendation"], base["source_urls"]) for i, k in enumerate(kinds, 1)]
    return spark.createDataFrame(rows, VERDICT)


def test_metrics(spark):
    m = V.metrics(verdicts(spark, "partial", *["mismatch"] * 7)).first()
    assert (m.compliance_percentage, m.total, m.score) == (6.2, 8, 1)
    m = V.metrics(verdicts(spark, "unknown", "match")).first()
    assert (m.total, m.match_count, m.score, m.max_score) == (2, 1, 2, 4)
    assert V.unknown_count(verdicts(spark, "unknown", "match"), "document_name").first().unknown_count == 1
    assert V.metrics(verdicts(spark)).count() == 0


def test_decision(spark):
    m = V.metrics(verdicts(spark, "mismatch", "needs_clarification")).select(V.decision().alias("d"))
    assert m.first().d == V.DECISIONS["mismatch"]


def test_priority(spark):
    rows = [("d", 1, "10", "x", "match", 0.5), ("d", 2, "2", "sla", "match", 0.5), ("d", 3, "10", "sla", "match", 0.5), ("d", 4, "9", "sla", "match", 0.9)]
    frame = spark.createDataFrame(rows, "document_name string, requirement_id int, section string, category string, verdict string, confidence double")
    assert [r.requirement_id for r in V.ranked(frame, "document_name").orderBy("rank").collect()] == [4, 3, 2, 1]


def test_merge(spark):
    reqs = spark.createDataFrame([("d", i, "s", "t", "sla") for i in (1, 2, 3)], "document_name string, id int, section string, text string, category string")
    items = spark.createDataFrame([("d", i, "match", 0.9, "", "", "", []) for i in (1, 1, 9, None)], "document_name string, requirement_id int, verdict string, confidence double, reasoning string, evidence string, recommendation string, source_urls array<string>")
    got = sorted((r.requirement_id, r.category, r.confidence) for r in V.merge_answers(reqs, items).collect())
    assert got == [(1, "sla", 0.9), (1, "sla", 0.9), (2, "sla", 0.0), (3, "sla", 0.0), (9, "other", 0.9)]
    assert V.missing_answers(reqs, items).count() == 2


def test_texts(spark):
    for text, reason, want in (("", "why", "[текст не извлечён] why"), (" ", "", "[текст требования не извлечён]"), (" ab ", "x", "ab")):
        assert spark.range(1).select(V.requirement_text(F.lit(text), F.lit(reason)).alias("x")).first().x == want


def test_keyword_match(spark):
    index = spark.createDataFrame([("docs/my-api", "u1", 0), ("docs/object_storage", "u2", 1), ("other/api", "u3", 2)], "path string, url string, ord int")
    words = spark.createDataFrame([(1, 0, "api"), (1, 1, "api"), (2, 0, "obj-ect st"), (2, 1, "-"), (3, 0, "docs")], "query_id int, kw_ord int, keyword string")
    got = {(r.query_id, r.url): (r.score, r.rank) for r in S.match_keywords(words, index).collect()}
    assert got == {(1, "u1"): (2, 1), (1, "u3"): (2, 2), (2, "u2"): (1, 1), (3, "u1"): (1, 1), (3, "u2"): (1, 2)}


def test_url_index_and_dedup(spark):
    urls = spark.createDataFrame([("https://example.com/A", 0), ("https://example.com/b", 1), ("https://example.com/a", 2)], "url string, ord int")
    got = {r.path: (r.url, r.ord) for r in S.url_index(urls, "https://example.com/").collect()}
    assert got["a"] == ("https://example.com/a", 0)
    hits = spark.createDataFrame([(1, u, i) for i, u in enumerate("abac")], "query_id int, url string, rank int")
    assert [r.url for r in S.first_seen(hits, ["query_id", "url"], ["rank"], 2).orderBy("rank").collect()] == ["a", "b"]


def test_top_k_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    x[5] = x[3]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, embedding array<double>")
    asked = base.where("id < 4").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.id for r in S.top_k(asked, base, 3).collect()}
    for q in range(4):
        d = ((x - x[q]) ** 2).sum(1)
        for rank, i in enumerate(np.lexsort((np.arange(200), d))[:3], 1):
            assert got[q, rank] == i
    assert S.top_k(asked.limit(0), base, 3).count() == 0


def test_sitemap(spark):
    loc = lambda u: f"<loc> {u} </loc>"
    maps = [
        ("root", f'<sitemapindex xmlns="http://s"><sitemap>{loc("in")}</sitemap><sitemap>{loc("root")}</sitemap><url>{loc("own")}</url></sitemapindex>'),
        ("in", f'<urlset xmlns="http://s"><url>{loc("a")}</url><url>{loc("a")}</url></urlset>'),
    ]
    frame = spark.createDataFrame(maps, "url string, xml string")
    assert [r.url for r in pages.sitemap_urls(frame, "root").orderBy("ord").collect()] == ["a", "a", "own"]


def test_crawl(spark, tmp_path):
    html = lambda n: f"<h1>t</h1><main>{'x' * n}</main>"
    urls = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "ord long, url string")
    cached = spark.createDataFrame([("u0", "t", ["t"], "c" * 60, "t"), ("u1", "t", ["t"], "", "t")], "url string, title string, breadcrumbs array<string>, content string, section_path string")
    folder = str(tmp_path / "cache")
    pages.write_cache(cached, folder)
    (tmp_path / "cache" / "bad.json").write_text("{")
    fetcher = TableFetcher({"u1": html(50), "u2": html(49), "u4": html(99)})
    got = pages.crawl(urls, pages.read_cache(spark, folder), fetcher, max_pages=4).orderBy("ord").collect()
    assert [(r.url, len(r.content)) for r in got] == [("u0", 60), ("u1", 50)]


def test_office_files(spark, tmp_path):
    rows = [["a", "b"], [None, 2], ["", " "]]
    (tmp_path / "x.xlsx").write_bytes(report.xlsx_bytes({"S1": rows, "empty": []}))
    (tmp_path / "y.docx").write_bytes(report.docx_bytes([("p", "hello"), ("p", " "), ("t", [["h"], ["v"]]), ("t", [["alone"]])]))
    (tmp_path / "z.txt").write_bytes("ok \xff".encode("latin-1"))
    (tmp_path / "w.md").write_text("# no")
    (tmp_path / "v.docx").write_bytes(b"broken")
    got = {r.filename: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["x.xlsx"].text == "a | b\n | 2" and got["x.xlsx"].tables[0].headers == ["a", "b"]
    assert got["y.docx"].text == "hello" and len(got["y.docx"].tables) == 1
    assert got["z.txt"].text == "ok \ufffd"
    assert "Unsupported" in got["w.md"].error and got["v.docx"].error
    docs = {r.doc_key: r.text for r in files.to_documents(files.read_files(spark, str(tmp_path))).collect()}
    assert "[Таблица из таблица 1]" in docs["y.docx"]
    assert [r.text for r in files.read_directory(spark, str(tmp_path), metadata={"source": "s"}).collect()] == ["# no", "ok \ufffd"]
    assert files.from_rows(spark, [{"text": "a", "k": 1}, {"text": " "}]).first().metadata == {"k": "1"}


def test_extraction(spark):
    answer = json.dumps([{"Требование": "first", "category": "SLA"}, {"text": "xx"}, 5, {"requirement": "second", "section": 3}])
    docs = spark.createDataFrame([("d", "a\nb"), ("e", "c")], "document_name string, text string")
    got = R.extract_requirements(docs, RuleLLM(lambda p: answer if "a\nb" in p else '{"raw": "x"}')).orderBy("id").collect()
    assert [(r.id, r.text, r.category, r.section) for r in got] == [(1, "first", "sla", ""), (2, "second", "other", "3")]


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert retried(call, sleep=waits.append) == 7 and waits == [5.0, 10.0]
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, sleep=lambda s: None)


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    base = KnowledgeBase(spark, "file://" + str(tmp_path_factory.mktemp("kb")))
    assert base.chunks().count() == 0
    text = "backup copies are kept for thirty days. " * 30
    base.add(files.from_rows(spark, [{"text": text, "url": "https://example.com/docs/backup", "title": "B"}, {"text": "networks and gateways", "source": "net"}]))
    return base


def test_kb(spark, kb):
    before = kb.chunks().count()
    kb.add(files.from_rows(spark, [{"text": "networks and gateways", "source": "other"}]).withColumn("doc_key", F.lit("1")))
    assert kb.chunks().count() == before  # the same chunk of the same document
    hits = kb.search(spark.createDataFrame([(1, "gateways networks")], "query_id long, text string"), 2).orderBy("rank").collect()
    assert hits[0].content == "networks and gateways" and hits[0].source == "net"
    with pytest.raises(ValueError):
        kb.search(spark.createDataFrame([(1, " ")], "query_id long, text string"))
    assert KnowledgeBase(spark, kb.folder, EngineConfig(embedding_model="other")).chunks().count() == 0


def test_analysis(spark, kb, tmp_path):
    def judge(prompt):
        ids = [int(x.split(" ")[0]) for x in prompt.split("ID=")[1:]]
        return json.dumps([{"requirement_id": i, "verdict": "match", "confidence": "high", "source_urls": ["https://example.com/x", "https://evil.example.info"]} for i in ids if i != 2])

    engine = Engine(spark, kb.folder, llm=RuleLLM(judge), web=TableWebSearch({"site:example.com other thing": [{"href": "https://www.example.com/w", "title": "W", "body": "b"}, {"href": "https://no.info", "title": "", "body": ""}]}))
    reqs = requirements_from_json(spark, json.dumps([
        {"id": 1, "document_name": "d", "text": "backup days", "category": "sla"}, {"id": 2, "document_name": "d", "text": "gateways", "category": "legal"},
        {"id": 3, "document_name": "d", "text": "other thing", "category": "other"}]))
    got = {r.requirement_id: r for r in engine.analyze(reqs).collect()}
    assert got[1].verdict == "match" and got[1].confidence == 0.5
    assert got[1].source_urls[0] == "https://example.com/x" and "https://evil.example.info" not in got[1].source_urls
    assert got[2].confidence == 0.0 and got[2].reasoning == V.MISSED
    index = spark.createDataFrame([("docs/backup", "https://example.com/docs/backup", 0)], "path string, url string, ord long")
    cached = spark.createDataFrame([("https://example.com/docs/backup", "B", "c" * 80)], "url string, title string, content string")
    engine.llm = None
    words = R.search_keywords(reqs.select(F.col("id").alias("query_id"), "text"))
    assert words.count() > 0
    engine.llm = RuleLLM(judge)
    hits = engine.live_hits(reqs, index, cached).collect()
    kinds = {h.requirement_id: h.source_type for h in hits}
    assert kinds == {1: "rag_fallback", 2: "rag_fallback", 3: "web"} or kinds[3] == "web"
    live = {r.requirement_id: r for r in engine.analyze(reqs, "live", spark.createDataFrame(hits)).collect()}
    assert live[1].verdict == "match" and live[2].recommendation == V.BY_HAND and len(live) == 3
    with pytest.raises(ValueError):
        engine.analyze(reqs, "guess")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    v = engine.analyze(reqs)
    for kind in ("md", "docx", "xlsx"):
        f = engine.export(v, kind, at).first()
        assert f.file_name == f"report_d_20240102_030405.{kind}" and len(f.content) > 500
    with pytest.raises(ValueError):
        engine.export(v, "rtf", at)
    (tmp_path / "r.xlsx").write_bytes(bytes(engine.export(v, "xlsx", at).first().content))
    sheets = [t.page_or_section for t in files.read_files(spark, str(tmp_path)).first().tables]
    assert sheets[:2] == ["лист «Сводка»", "лист «Все требования»"]


def test_markdown(spark):
    v = verdicts(spark, "mismatch", "match", "odd", source_urls=["https://example.com/docs/a/ug/b"], recommendation="do")
    md = report.markdown(v, F.lit("2024-01-02 03:04:05").cast("timestamp")).first().markdown
    assert md.startswith("# Отчёт по анализу ТЗ: d\n*Дата анализа: 02.01.2024 03:04*\n\n## Общий процент соответствия: 33.3%")
    assert "**Документация:** [a / b](https://example.com/docs/a/ug/b)" in md
    assert "**Пункт 1**  odd (уверенность: 50%)" in md
    assert md.index("## Несоответствия") < md.index("## Подтверждённые важные соответствия") < md.index("## Детализация")


def test_json_forms(spark):
    frame = spark.createDataFrame([('{"document_name": "d", "verdicts": [{"requirement_id": 1}]}',)], "report string")
    r = verdicts_from_json(frame).first()
    assert (r.verdict, r.category, r.confidence, r.source_urls) == ("needs_clarification", "other", 0.0, [])
    back = verdicts_from_json(reports_to_json(verdicts(spark, "match", "partial"))).orderBy("requirement_id").collect()
    assert [(r.document_name, r.requirement_id, r.verdict, r.confidence) for r in back] == [("d", 1, "match", 0.5), ("d", 2, "partial", 0.5)]
    with pytest.raises(ValueError):
        settings_from_json("[1]")
    with pytest.raises(ValueError):
        settings_from_json("{")
    assert download_name("attachment; filename=\"a.md\"; filename*=UTF-8''%D0%B0.md", "x") == "а.md"
    assert download_name(None, "x") == "x"
    assert EngineConfig().with_overrides(top_k=7, embedding_model="").top_k == 7


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1", f"<h1>t</h1><main>{'word ' * 300}</main>"), (2, "u2", "<main>short</main>")], "page_id long, url string, html string")
    rows.write.parquet(str(tmp_path / "in"))
    streamed, batch = (KnowledgeBase(spark, f"file://{tmp_path}/{n}") for n in ("a", "b"))
    for _ in range(2):
        ingest.ingest_pages(spark, str(tmp_path / "in"), streamed, str(tmp_path / "check")).awaitTermination()
    batch.add(pages.to_documents(pages.long_enough(pages.extract_pages(rows))))
    ids = lambda kb: sorted(r.chunk_id for r in kb.chunks().select("chunk_id").collect())
    assert ids(streamed) == ids(batch) != []


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = ingest.windowed(stream, "6 hours").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("w").select("start", "event_type", "n").collect()))
    assert got == sorted(map(tuple, ingest.windowed(events, "6 hours").select("start", "event_type", "n").collect()))
