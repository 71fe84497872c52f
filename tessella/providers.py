"""Pluggable models, fetchers and web search, with deterministic offline defaults.

Providers run on executors, in partitions: they must pickle. Retries with linear backoff are part
of ``retried``; a task that fails all the same is retried by Spark. With a ledger each input is
asked once, whatever is evaluated again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StringType, StructField, StructType

from .functions.vectors import hashed_embedding
from .ledger import CallLedger, identity


class LLMProvider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> str | None: ...


class WebSearchProvider(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def retried(call: Callable, *args, attempts: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """Calls up to ``attempts`` times, waiting ``wait`` x attempt seconds between; the last error is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return call(*args)
        except Exception:
            if attempt == attempts:
                raise
            sleep(wait * attempt)


class ReplayLLM:
    """Answers from a table of prompts; others get a fixed answer."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = "[]"):
        self.answers, self.default = answers or {}, default

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, self.default) for p in prompts]


class RuleLLM:
    """Answers by a function of the prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


class TableFetcher:
    """Pages from a dictionary."""

    def __init__(self, pages: dict[str, str]):
        self.pages = pages

    def fetch(self, url: str) -> str | None:
        return self.pages.get(url)


class TableWebSearch:
    """Results from a dictionary of queries."""

    def __init__(self, results: dict[str, list[dict]]):
        self.results = results

    def search(self, query: str, limit: int) -> list[dict]:
        return self.results.get(query, [])[:limit]


def _with(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The frame's schema and one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def completed(df: DataFrame, llm: LLMProvider, prompt: str = "prompt", batch: int = 10, ledger: CallLedger | None = None) -> DataFrame:
    """``df`` with a column ``answer``; a null answer becomes ''.

    With a ledger each distinct prompt is asked once and by itself, so that a failure loses no other
    answer. Without one prompts are asked in batches, again with every evaluation.
    """
    if ledger is not None:
        call = lambda prompts: [a or "" for a in retried(llm.complete, prompts)]
        return ledger.ask(df, prompt, "chat", "string", identity(llm), call)
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            answers: list[str] = []
            for i in range(0, len(frame), batch):
                answers += retried(llm.complete, frame[prompt].iloc[i : i + batch].tolist())
            yield frame[names].assign(answer=[a or "" for a in answers])

    return df.mapInPandas(run, _with(df, "answer", StringType()))


def embedded(df: DataFrame, provider: EmbeddingProvider | None = None, dim: int = 64, batch: int = 50, ledger: CallLedger | None = None) -> DataFrame:
    """``df`` with a column ``embedding`` of its text: by the provider, with a ledger once for each text, else by hashing."""
    if provider is None:
        return df.withColumn("embedding", hashed_embedding(F.coalesce("text", F.lit("")), dim))
    if ledger is not None:
        call = lambda texts: [[float(x) for x in v] for v in retried(provider.embed, texts)]
        return ledger.ask(df, "text", "embedding", "array<float>", identity(provider), call, batch, "embedding")

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for i in range(0, len(frame), batch):
                vectors += retried(provider.embed, frame["text"].iloc[i : i + batch].tolist())
            yield frame.assign(embedding=vectors)

    return df.mapInPandas(run, _with(df, "embedding", ArrayType(FloatType())))


_RESULTS = "array<struct<href: string, title: string, body: string>>"


def searched(
    df: DataFrame, provider: WebSearchProvider, limit: int = 5, scope: str | None = None, query: str = "query", ledger: CallLedger | None = None
) -> DataFrame:
    """Web results of ``df`` (query_id, query): query_id, rank, url, title, snippet, content, source_type.

    A failing search gives nothing, and with a ledger is asked again next time. The snippet is all the
    content there is.
    """

    def one(text: str) -> list[dict]:
        found = provider.search(text, limit)[:limit]
        return [{k: str(r.get(k) or "") for k in ("href", "title", "body")} for r in found]

    scoped = F.concat(F.lit(f"site:{scope} "), F.col(query)) if scope else F.col(query)
    asked = df.select("query_id", scoped.alias("asked"))
    if ledger is not None:
        name = f"{identity(provider)}\x1f{limit}"
        found = ledger.ask(asked, "asked", "web", _RESULTS, name, lambda texts: [one(t) for t in texts], 1, "found", "null")
    else:

        @F.pandas_udf(_RESULTS)
        def run(texts: pd.Series) -> pd.Series:
            out = []
            for text in texts:
                try:
                    out.append(one(text))
                except Exception:
                    out.append([])
            return pd.Series(out, dtype=object)

        found = asked.withColumn("found", run("asked"))
    rows = found.select("query_id", F.posexplode("found").alias("i", "r"))
    return rows.select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("r.href").alias("url"), "r.title", F.col("r.body").alias("snippet"),
        F.col("r.body").alias("content"), F.lit("web").alias("source_type"),
    )
