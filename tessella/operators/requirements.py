"""Requirements from texts and verdicts on them, with model answers from a provider."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..config import EngineConfig
from ..functions import text as T
from ..functions.model_json import confidence, field, items_of, parse
from ..ledger import CallLedger
from ..providers import LLMProvider, completed
from . import answers as A
from . import search as S
from . import verdicts as V

#: The names under which models give a requirement's fields.
ALIASES = {
    "text": ["text", "requirement", "requirement_text", "description", "content", "требование", "текст", "текст_требования"],
    "section": [
        "section", "paragraph", "point", "clause", "пункт", "раздел", "номер", "номер_пункта", "number", "item_number",
        "section_number",
    ],
    "category": ["category", "категория", "type", "тип"],
    "tables": ["tables", "table", "таблица", "таблицы"],
}

EXTRACT = (
    "List every requirement in the text below as a JSON array of objects with the keys section, text, category "
    "(technical, sla, legal, commercial, security or other) and tables.\n\nText:\n{text}"
)
ASSESS = (
    "Judge each requirement against the context. Answer with a JSON array of objects with the keys requirement_id, verdict "
    "(match, partial, mismatch or needs_clarification), confidence (0 to 1), reasoning, evidence, recommendation and "
    "source_urls.\n\nRequirements:\n{requirements}\n\nContext:\n{context}"
)
SUMMARISE = (
    "Sum the report on {name} up: {total} requirements, {match} met, {partial} partly, {mismatch} not, {clarification} open; "
    "compliance {percentage}%.\n\nMismatches:\n{mismatches}"
)
KEYWORDS = "Give 3 to 5 technical search terms for this requirement, separated by commas:\n{text}"

_FIELDS = "array<struct<section: string, text: string, category: string, tables: string>>"


def filled(template: str, **columns):
    """A template with columns in its braces."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def records(answers: Column) -> Column:
    """The requirements in a model's answers, whatever names it gives their fields."""

    @F.pandas_udf(_FIELDS)
    def run(answers: pd.Series) -> pd.Series:
        return pd.Series(
            [[{k: field(x, names) for k, names in ALIASES.items()} for x in items_of(parse(a))] for a in answers], dtype=object
        )

    return run(answers)


def extract_requirements(documents: DataFrame, llm: LLMProvider, size: int = 6000, ledger: CallLedger | None = None, quarantine: str | None = None) -> DataFrame:
    """Requirements of ``documents`` (document_name, text): packed to chunks, asked for, cleaned, numbered.

    Texts under three characters are left out and take no number; unknown categories become 'other'. Answers
    that can't be read are appended to the table ``quarantine`` (document_name, chunk, answer, error), if given.
    """
    parts = documents.select("document_name", F.posexplode(T.packed(F.col("text"), size)).alias("chunk", "part"))
    asked = completed(parts.select("document_name", "chunk", filled(EXTRACT, text=F.col("part")).alias("prompt")), llm, ledger=ledger)
    asked = storage.keep(asked.select("document_name", "chunk", "answer"), f"{storage.scratch(documents.sparkSession)}/asked")
    found, failed = A.records(asked, "answer", ALIASES)
    if quarantine:
        A.quarantine(failed, quarantine)
    good = found.withColumn("category", V.valid_category(F.col("category"))).where(F.length("text") >= 3)
    return numbered(good)


def numbered(records: DataFrame) -> DataFrame:
    """Ids from 1 in each document, in order of chunk and item."""
    ident = F.row_number().over(W.partitionBy("document_name").orderBy("chunk", "item")).cast("int")
    return records.withColumn("id", ident).select("document_name", "id", "section", "text", "category", "tables")


def query_text():
    return F.concat_ws("\n", "text", F.nullif(F.col("tables"), F.lit("")))


_ITEMS = (
    "array<struct<requirement_id: int, verdict: string, confidence: string, reasoning: string, evidence: string, "
    "recommendation: string, source_urls: array<string>>>"
)


def _answers():
    def text_of(value):
        return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    @F.pandas_udf(_ITEMS)
    def run(answers: pd.Series) -> pd.Series:
        out = []
        for a in answers:
            found = parse(a)
            rows = []
            for x in found if isinstance(found, list) else [found]:
                if isinstance(x, dict):
                    ident, urls = x.get("requirement_id"), x.get("source_urls")
                    rows.append(
                        {k: text_of(x.get(k)) for k in ("verdict", "confidence", "reasoning", "evidence", "recommendation")}
                        | {
                            "requirement_id": ident if isinstance(ident, int) and not isinstance(ident, bool) else None,
                            "source_urls": [u for u in urls if isinstance(u, str)] if isinstance(urls, list) else [],
                        }
                    )
            out.append(rows)
        return pd.Series(out, dtype=object)

    return run


def parsed_answers(answered: DataFrame, config: EngineConfig) -> DataFrame:
    """Verdict items of ``answered`` (document_name, ..., answer); links are those to trusted hosts."""
    items = answered.select(*[c for c in answered.columns if c not in ("answer", "prompt")], F.posexplode(_answers()("answer")).alias("item", "x"))
    return items.select(
        *items.columns[:-2], "item", "x.requirement_id", "x.verdict", confidence(F.col("x.confidence")).alias("confidence"),
        "x.reasoning", "x.evidence", "x.recommendation",
        T.trusted_links(F.col("x.source_urls"), config.link_domains).alias("source_urls"),
    )


def analyze(
    requirements: DataFrame, hits: DataFrame, llm: LLMProvider, config: EngineConfig, mode: str = "rag", ledger: CallLedger | None = None
) -> DataFrame:
    """Verdicts on ``requirements``, with ``hits`` (document_name, requirement_id, rank, source, url, title, content).

    In mode 'rag' the requirements of a document are asked in batches with their pooled context, in
    mode 'live' one by one with shortened hits.
    """
    if mode not in ("rag", "live"):
        raise ValueError(f"unknown mode {mode!r}")
    numbered_ = V.batches(requirements, config.requirements_per_batch if mode == "rag" else 1)
    spot = numbered_.select("document_name", F.col("id").alias("requirement_id"), "batch_id")
    pooled = hits.join(spot, ["document_name", "requirement_id"]).withColumn("query_id", F.struct("document_name", "batch_id"))
    pooled = pooled.withColumn("rank", F.struct("requirement_id", "rank"))
    context = S.context(pooled, config.context_chars if mode == "live" else None).select("query_id.*", "context")
    lines = F.array_sort(F.collect_list(F.struct("id", V.requirement_line().alias("line"))))
    blocks = numbered_.groupBy("document_name", "batch_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("requirements"), F.min("id").alias("only")
    )
    asked = blocks.join(context, ["document_name", "batch_id"], "left").withColumn(
        "prompt", filled(ASSESS, requirements=F.col("requirements"), context=F.coalesce("context", F.lit("Nothing found.")))
    )
    answered = completed(asked.select("document_name", "only", "prompt"), llm, ledger=ledger)
    items = parsed_answers(answered, config)
    if mode == "live":  # the answer is about the one requirement asked for, and its first item counts
        first = F.row_number().over(W.partitionBy("document_name", "only").orderBy("item"))
        items = items.withColumn("n", first).where("n = 1").withColumn("requirement_id", F.col("only")).drop("n")
        items = items.withColumn("reasoning", F.coalesce("reasoning", F.lit(V.NO_ANSWER)))
        items = items.withColumn("recommendation", F.coalesce("recommendation", F.lit(V.BY_HAND)))
    merged = V.merge_answers(requirements, items.drop("only", "item"))
    merged = merged.join(V.searched_links(hits), ["document_name", "requirement_id"], "left")
    return merged.withColumn("source_urls", T.merged_links(F.col("source_urls"), F.col("searched"))).drop("searched")


def summaries(verdicts: DataFrame, llm: LLMProvider, ledger: CallLedger | None = None) -> DataFrame:
    """Metrics of each document and a model's summary of them."""
    m = V.metrics(verdicts).join(V.top_mismatches(verdicts, "document_name"), "document_name", "left")
    prompt = filled(
        SUMMARISE, name=F.col("document_name"), total=F.col("total"), match=F.col("match_count"), partial=F.col("partial_count"),
        mismatch=F.col("mismatch_count"), clarification=F.col("clarification_count"), percentage=F.col("compliance_percentage"),
        mismatches=F.coalesce("top_mismatches", F.lit("-")),
    )
    out = completed(m.withColumn("prompt", prompt), llm, ledger=ledger)
    return out.withColumnRenamed("answer", "summary").drop("prompt", "top_mismatches")


def search_keywords(requirements: DataFrame, llm: LLMProvider | None = None, ledger: CallLedger | None = None) -> DataFrame:
    """``requirements`` (query_id, text) as (query_id, kw_ord, keyword): asked for, else words of the text."""
    words = T.fallback_keywords(F.col("text"))
    if llm is not None:
        asked = requirements.withColumn("prompt", filled(KEYWORDS, text=T.truncated(F.col("text"), 500)))
        requirements = completed(asked, llm, ledger=ledger)
        listed = T.listed_keywords(F.col("answer"))
        words = F.when(F.size(listed) > 0, listed).otherwise(words)
    return requirements.select("query_id", F.posexplode(words).alias("kw_ord", "keyword"))
