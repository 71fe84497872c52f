"""The engine's calls, one for each endpoint of a document-compliance service, over DataFrames."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import EngineConfig
from ..ledger import CallLedger
from ..operators import requirements as R
from ..operators import search as S
from ..operators import verdicts as V
from ..providers import EmbeddingProvider, Fetcher, LLMProvider, ReplayLLM, WebSearchProvider, searched
from ..sinks import report
from ..sources import files, pages
from .kb import KnowledgeBase


class Engine:
    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig(), llm: LLMProvider | None = None, embeddings: EmbeddingProvider | None = None, web: WebSearchProvider | None = None):
        self.spark, self.config, self.llm, self.web = spark, config, llm or ReplayLLM(), web
        self.ledger = CallLedger(spark, f"{folder.rstrip('/')}_ledger")
        self.kb = KnowledgeBase(spark, folder, config, embeddings, self.ledger)

    def status(self) -> dict:
        """Health: settings and the size of the knowledge base."""
        return {"status": "ok", "model": self.config.embedding_model, **self.kb.status().first().asDict()}

    def ingest_pages(self, crawled: DataFrame, source: str = "docs") -> dict:
        """Indexes crawled pages. They are written first, so that neither counts nor a lost executor fetch them again."""
        crawled = storage.keep(crawled, f"{storage.scratch(self.spark)}/crawled")
        documents = pages.to_documents(crawled, source)
        self.kb.add(documents)
        return {"crawled": crawled.count(), "indexed": documents.count(), **self.kb.status().first().asDict()}

    def ingest_files(self, path: str) -> DataFrame:
        """Indexes the files of a folder; returns their summary."""
        parsed = storage.keep(files.read_files(self.spark, path, files.UPLOADS), f"{storage.scratch(self.spark)}/parsed")
        self.kb.add(files.to_documents(parsed))
        return files.summary(parsed)

    def extract(self, path: str) -> DataFrame:
        return self.extract_with_summary(path)[0]

    def extract_with_summary(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Requirements of the files of a folder, and for each file its size and how many were found in it."""
        parsed = storage.keep(files.read_files(self.spark, path), f"{storage.scratch(self.spark)}/parsed")
        documents = files.to_documents(parsed).withColumnRenamed("doc_key", "document_name")
        found = R.extract_requirements(documents, self.llm, self.config.extraction_chunk, self.ledger, f"{self.kb.folder}_quarantine")
        return found, files.summary(parsed, found)

    def url_index(self, fetcher: Fetcher, refresh: bool = False) -> DataFrame:
        """The site's urls by path (path, url, ord), read from its sitemap once and kept beside the base until ``refresh``."""
        folder, c = f"{self.kb.folder}_urls", self.config
        kept = [n for n in storage.names(self.spark, folder) if storage.exists(self.spark, f"{folder}/{n}/_SUCCESS")]
        if refresh or not kept:
            urls = pages.seed_urls(self.spark, [c.sitemap_url], fetcher, [c.docs_base, c.documents_base], c.docs_base)
            kept.append(f"{len(kept):08d}-{uuid.uuid4().hex}")
            S.url_index(urls, c.site_root).write.parquet(f"{folder}/{kept[-1]}")
        return self.spark.read.parquet(f"{folder}/{kept[-1]}")

    def rag_hits(self, requirements: DataFrame) -> DataFrame:
        """The nearest chunks of each requirement."""
        ident = F.md5(F.concat_ws("\x1f", "document_name", F.col("id").cast("string")))
        asked = requirements.select(ident.alias("query_id"), "document_name", F.col("id").alias("requirement_id"), R.query_text().alias("text"))
        found = self.kb.search(asked.select("query_id", "text")).join(asked.drop("text"), "query_id")
        url = F.coalesce(F.element_at("metadata", "url"), F.element_at("metadata", "source"), F.lit(""))
        return found.select("document_name", "requirement_id", "rank", url.alias("url"), "source", "title", "content")

    def live_hits(self, requirements: DataFrame, index: DataFrame, cached: DataFrame, limit: int = 5) -> DataFrame:
        """Routed search: site pages by keyword, else the web, else the knowledge base (see ROUTES)."""
        c = self.config
        ident = F.md5(F.concat_ws("\x1f", "document_name", F.col("id").cast("string")))
        asked = requirements.select(ident.alias("query_id"), "document_name", F.col("id").alias("requirement_id"), "category", R.query_text().alias("text"))
        folder = storage.scratch(self.spark)
        words = storage.keep(R.search_keywords(asked.select("query_id", "text"), self.llm, self.ledger), f"{folder}/words")
        kind = lambda *names: asked.where(F.col("category").isin(*names)).select("query_id")
        none = self.spark.createDataFrame([], "query_id string, rank int, url string, title string, snippet string, content string, source_type string")

        def matched(where: DataFrame, prefix: str, source_type: str) -> DataFrame:
            hits = S.match_keywords(words.join(where, "query_id"), index, limit * 2, prefix)
            return S.with_pages(hits, cached, limit, source_type, c.min_content, c.snippet_chars)

        def documents(where: DataFrame) -> DataFrame:
            narrow = S.match_keywords(words.join(where, "query_id"), index, limit * 2, "documents/")
            narrow = storage.keep(narrow, f"{folder}/narrow")
            rest = where.join(narrow.select("query_id").distinct(), "query_id", "left_anti")
            broad = S.match_keywords(words.join(rest, "query_id"), index, limit * 2).where(F.contains("url", F.lit("/documents/")))
            rank = F.row_number().over(S.W.partitionBy("query_id").orderBy("rank"))
            both = narrow.unionByName(broad.withColumn("rank", rank))
            return S.with_pages(both, cached, limit, "cloud_documents", c.min_content, c.snippet_chars)

        def web(where: DataFrame, scope: str | None, prefix: str = "") -> DataFrame:
            if self.web is None:
                return none
            ask = asked.join(where, "query_id").select("query_id", F.concat(F.lit(prefix), F.substring("text", 1, 200)).alias("query"))
            found = searched(ask, self.web, limit, scope, ledger=self.ledger)
            return found.where(S.T.trusted(F.col("url"), c.trusted_domains))

        def rag(where: DataFrame) -> DataFrame:
            found = self.kb.search(asked.join(where, "query_id").select("query_id", "text"), limit)
            url = F.coalesce(F.element_at("metadata", "url"), F.element_at("metadata", "source"), F.lit(""))
            return found.select("query_id", "rank", url.alias("url"), "title", F.substring("content", 1, c.snippet_chars).alias("snippet"), "content", F.lit("rag_fallback").alias("source_type"))

        site = c.site_domains[0]
        legal, technical, others = ("security", "legal"), ("technical", "sla"), ("commercial", "other")
        tiers = [
            lambda left: documents(left.join(kind(*legal), "query_id")).withColumn("branch", F.lit(0))
            .unionByName(matched(left.join(kind(*legal, *technical), "query_id"), "docs/", "cloud_docs").withColumn("branch", F.lit(1)))
            .unionByName(web(left.join(kind(*others), "query_id"), site).withColumn("branch", F.lit(2))),
            lambda left: web(left.join(kind(*legal, *technical), "query_id"), site).withColumn("branch", F.lit(0))
            .unionByName(web(left.join(kind(*others), "query_id"), None, f"{site} ").withColumn("branch", F.lit(1))),
            lambda left: rag(left).withColumn("branch", F.lit(0)),
        ]
        found = S.route(S.staged(asked.select("query_id"), tiers, folder), limit)
        return found.join(asked.select("query_id", "document_name", "requirement_id"), "query_id").withColumn("source", F.col("url")).drop("query_id", "tier", "branch")

    def analyze(self, requirements: DataFrame, mode: str = "rag", hits: DataFrame | None = None) -> DataFrame:
        if requirements.isEmpty():
            raise ValueError("no requirements")
        return R.analyze(requirements, hits if hits is not None else self.rag_hits(requirements), self.llm, self.config, mode, self.ledger)

    def summarise(self, verdicts: DataFrame) -> DataFrame:
        return R.summaries(verdicts, self.llm, self.ledger)

    def markdown(self, verdicts: DataFrame, generated_at: Column, summaries: DataFrame | None = None) -> DataFrame:
        return report.markdown(verdicts, generated_at, self.config, summaries)

    def export(self, verdicts: DataFrame, kind: str, generated_at: Column, summaries: DataFrame | None = None) -> DataFrame:
        """Report files (document_name, file_name, content) as md, docx, xlsx or pdf."""
        if kind == "md":
            stamp = F.date_format(generated_at, "yyyyMMdd_HHmmss")
            name = F.concat(F.lit("report_"), S.T.safe_name(F.col("document_name")), F.lit("_"), stamp, F.lit(".md"))
            made = self.markdown(verdicts, generated_at, summaries)
            return made.select("document_name", name.alias("file_name"), F.encode("markdown", "UTF-8").alias("content"))
        return report.office(verdicts, kind, generated_at, summaries)


def requirements_from_json(spark: SparkSession, payload: str) -> DataFrame:
    """Requirements of a JSON array; an id is a must, the rest has defaults."""
    rows = json.loads(payload)
    return spark.createDataFrame(
        [(r.get("document_name", ""), int(r["id"]), str(r.get("section", "")), str(r.get("text", "")), str(r.get("category", "other")), str(r.get("tables", ""))) for r in rows],
        "document_name string, id int, section string, text string, category string, tables string",
    )


def verdicts_from_json(reports: DataFrame, column: str = "report") -> DataFrame:
    """Verdicts of JSON reports, with defaults."""
    item = "array<struct<requirement_id: int, section: string, requirement_text: string, category: string, verdict: string, confidence: double, reasoning: string, evidence: string, recommendation: string, source_urls: array<string>>>"
    read = reports.select(F.from_json(column, f"document_name string, summary string, verdicts {item}").alias("r"))
    v = read.select("r.document_name", F.explode("r.verdicts").alias("v")).select("document_name", "v.*")
    blank = {c: "" for c in ("section", "requirement_text", "reasoning", "evidence", "recommendation")}
    v = v.fillna(blank | {"category": "other", "verdict": "needs_clarification", "confidence": 0.0})
    return v.withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))


def reports_to_json(verdicts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One JSON report for each document (document_name, report): metrics, summary and verdicts in order of id."""
    columns = [c for c in verdicts.columns if c != "document_name"]
    ordered = F.array_sort(F.collect_list(F.struct("requirement_id", *[c for c in columns if c != "requirement_id"])))
    m = V.metrics(verdicts).join(verdicts.groupBy("document_name").agg(ordered.alias("verdicts")), "document_name")
    if summaries is not None:
        m = m.join(summaries.select("document_name", "summary"), "document_name", "left")
    else:
        m = m.withColumn("summary", F.lit(""))
    return m.select("document_name", F.to_json(F.struct(*m.columns)).alias("report"))


def settings_from_json(text: str) -> dict:
    """Settings of a request; what isn't a JSON object raises ValueError."""
    found = json.loads(text or "{}")
    if not isinstance(found, dict):
        raise ValueError("settings must be an object")
    return found


def download_name(disposition: str | None, default: str) -> str:
    """File name of a Content-Disposition header: the encoded form first, then the plain one."""
    import re
    from urllib.parse import unquote

    if found := re.search(r"filename\*\s*=\s*(?:UTF-8|utf-8)''([^;]+)", disposition or ""):
        return unquote(found[1].strip())
    if found := re.search(r'filename\s*=\s*"?([^";]+)"?', disposition or ""):
        return found[1].strip()
    return default
