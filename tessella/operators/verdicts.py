"""Verdicts: merging model answers with requirements, metrics, ranking, report projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CATEGORIES, VERDICTS
from ..functions import text as T

#: Labels and marks of the report, and the order in which categories are checked.
VERDICT_LABELS = {
    "match": "Соответствует",
    "partial": "Частично соответствует",
    "mismatch": "Не соответствует",
    "needs_clarification": "Требует уточнения",
}
VERDICT_ICONS = {"match": "✅", "partial": "🟡", "mismatch": "❌", "needs_clarification": "❓"}
CATEGORY_LABELS = {
    "technical": "Техническое",
    "sla": "SLA",
    "legal": "Юридическое",
    "commercial": "Коммерческое",
    "security": "Информационная безопасность",
    "other": "Прочее",
}
CATEGORY_PRIORITY = {"technical": 0, "sla": 1, "security": 2, "legal": 3, "commercial": 4, "other": 5}
DECISIONS = {
    "mismatch": "Обнаружены несоответствия. Начните проверку отчёта с блокеров ниже.",
    "needs_clarification": "Критичных блокеров не найдено, но есть пункты, требующие ручного уточнения.",
    "partial": "Явных блокеров не найдено, но есть частичные соответствия, требующие доработки.",
    "match": "Явных блокеров не найдено. Достаточно выборочно перепроверить подтверждённые ключевые требования.",
}
NO_ANSWER = "Не удалось получить оценку"
BY_HAND = "Требуется ручная проверка"
MISSED = "Не удалось получить оценку от LLM"


def lookup(values: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def points(verdict: Column) -> Column:
    return F.when(verdict == "match", 2).when(verdict == "partial", 1).otherwise(0)


def metrics(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Counts, score and compliance of the verdicts of each ``keys`` (document_name by default)."""
    count = {"match": "match_count", "partial": "partial_count", "mismatch": "mismatch_count", "needs_clarification": "clarification_count"}
    out = verdicts.groupBy(*(keys or ("document_name",))).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(name) for v, name in count.items()],
        F.sum(points(F.col("verdict"))).alias("score"),
    )
    out = out.withColumn("max_score", F.col("total") * 2)
    return out.withColumn("compliance_percentage", F.bround(F.col("score") / F.col("max_score") * 100, 1))


def unknown_count(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Verdicts outside the four known ones; they are in total only."""
    known = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    return verdicts.groupBy(*keys).agg(F.count_if(~known).alias("unknown_count"))


def decision() -> Column:
    return (
        F.when(F.col("mismatch_count") > 0, DECISIONS["mismatch"])
        .when(F.col("clarification_count") > 0, DECISIONS["needs_clarification"])
        .when(F.col("partial_count") > 0, DECISIONS["partial"])
        .otherwise(DECISIONS["match"])
    )


def traffic_light(percentage: Column) -> Column:
    return F.when(percentage >= 80, "green").when(percentage >= 60, "orange").otherwise("red")


def progress(percentage: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), percentage / 100))


def priority() -> list[Column]:
    """Sort order of report entries: category, most certain first, section, id."""
    return [
        lookup(CATEGORY_PRIORITY, F.col("category"), F.lit(9)),
        F.desc("confidence"),
        F.coalesce("section", F.lit("")),
        F.col("requirement_id"),
    ]


def ranked(verdicts: DataFrame, *keys: str) -> DataFrame:
    return verdicts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*priority())))


def key_matches(verdicts: DataFrame, *keys: str, limit: int = 10) -> DataFrame:
    return ranked(verdicts.where("verdict = 'match'"), *keys).where(F.col("rank") <= limit)


def top_mismatches(verdicts: DataFrame, *keys: str, order: str = "requirement_id", limit: int = 10) -> DataFrame:
    """A line for each of the first mismatches in report order, joined to one text."""
    w = W.partitionBy(*keys).orderBy(order)
    few = verdicts.where("verdict = 'mismatch'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    line = F.concat(F.lit("- ["), "section", F.lit("] "), T.truncated(F.col("requirement_text"), 100), F.lit("... — "), "reasoning")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return few.groupBy(*keys).agg(F.array_join(lines, "\n").alias("top_mismatches"))


def of_verdict(verdicts: DataFrame, verdict: str) -> DataFrame:
    """The verdicts of one kind, which make a section or a sheet of the report."""
    return verdicts.where(F.col("verdict") == verdict)


def in_categories(requirements: DataFrame, chosen: list[str]) -> DataFrame:
    """Requirements of the chosen categories; an empty choice takes all."""
    return requirements.where(F.col("category").isin(*chosen)) if chosen else requirements


def categories(requirements: DataFrame, *keys: str) -> DataFrame:
    """The distinct categories of each ``keys``, sorted."""
    return requirements.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent of work done; nothing to do is all done."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(100).cast("int")


def last_of(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each ``keys``: the last in ``order``, without one that with the greatest other columns."""
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(order, *others) if order else F.struct(*others)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_last"))
    return last.select(*keys, "_last.*")


def merge_answers(requirements: DataFrame, answers: DataFrame, order: str | None = None) -> DataFrame:
    """Full outer join of requirements and a model's items on (document_name, id).

    Of requirements with one id the last counts (``order`` names the column that says which).

    Items without a requirement stay with blank text and category 'other', repeated items stay,
    items without an id go (they are parse failures). Requirements without an item get a default
    verdict of confidence 0.
    """
    r = last_of(requirements, ["document_name", "id"], order).withColumnRenamed("id", "requirement_id")
    a = answers.where("requirement_id is not null").withColumn("_a", F.lit(True))
    both = r.join(a, ["document_name", "requirement_id"], "full_outer")
    answered = F.col("_a").isNotNull()
    blank = lambda c: F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    return both.select(
        "document_name",
        "requirement_id",
        blank("section").alias("section"),
        blank("text").alias("requirement_text"),
        F.coalesce("category", F.lit("other")).alias("category"),
        F.when(answered, F.coalesce("verdict", F.lit("needs_clarification"))).otherwise("needs_clarification").alias("verdict"),
        F.when(answered, F.coalesce("confidence", F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.when(answered, F.coalesce("reasoning", F.lit(""))).otherwise(MISSED).alias("reasoning"),
        F.when(answered, blank("evidence")).otherwise("").alias("evidence"),
        F.when(answered, blank("recommendation")).otherwise(BY_HAND).alias("recommendation"),
        F.when(answered, F.coalesce("source_urls", none)).otherwise(none).alias("source_urls"),
    )


def missing_answers(requirements: DataFrame, answers: DataFrame) -> DataFrame:
    returned = answers.select("document_name", F.col("requirement_id").alias("id"))
    return requirements.join(returned, ["document_name", "id"], "left_anti")


def searched_links(searched: DataFrame) -> DataFrame:
    """Ordered distinct http links of each requirement's hits (document_name, requirement_id, rank, url)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "url")))
    links = searched.where(F.startswith("url", F.lit("http"))).groupBy("document_name", "requirement_id")
    return links.agg(F.array_distinct(F.transform(ordered, lambda x: x["url"])).alias("searched"))


def section_label(section: Column, ident: Column) -> Column:
    trimmed = F.coalesce(T.strip(section), F.lit(""))
    return F.when(trimmed != "", F.concat(F.lit("Пункт "), trimmed)).otherwise(F.concat(F.lit("Требование №"), ident.cast("string")))


def point(section: Column, ident: Column) -> Column:
    """A requirement's place in its document, or its number."""
    return F.when(F.coalesce(section, F.lit("")) != "", section).otherwise(F.concat(F.lit("#"), ident.cast("string")))


def requirement_text(text: Column, reasoning: Column, n: int = 200) -> Column:
    trimmed = F.coalesce(T.strip(text), F.lit(""))
    return (
        F.when(trimmed != "", T.truncated(trimmed, n))
        .when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("[текст не извлечён] "), T.truncated(reasoning, n)))
        .otherwise("[текст требования не извлечён]")
    )


def sheet_rows(verdicts: DataFrame) -> DataFrame:
    """The rows of the spreadsheet report."""
    return verdicts.select(
        "document_name",
        F.col("requirement_id").alias("id"),
        point(F.col("section"), F.col("requirement_id")).alias("section"),
        requirement_text(F.col("requirement_text"), F.col("reasoning"), 1000).alias("text"),
        lookup(CATEGORY_LABELS, F.col("category"), F.col("category")).alias("category"),
        lookup(VERDICT_LABELS, F.col("verdict"), F.col("verdict")).alias("verdict"),
        points(F.col("verdict")).alias("points"),
        T.percent(F.col("confidence")).alias("confidence"),
        "reasoning",
        "evidence",
        "recommendation",
        F.array_join(F.slice("source_urls", 1, 5), "\n").alias("links"),
    )


def column_widths(rows: DataFrame, *columns: str) -> DataFrame:
    """Width of each column in characters: the longest cell or heading and 2 more, 60 at most."""
    longest = [F.greatest(F.max(F.length(F.col(c).cast("string"))), F.lit(len(c))).alias(c) for c in columns]
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns)))
    return rows.agg(*longest).select(pairs.alias("name", "longest")).select(
        "name", F.least(F.col("longest") + 2, F.lit(60)).alias("width")
    )


def valid_category(c: Column) -> Column:
    return F.when(F.lower(c).isin(*CATEGORIES), F.lower(c)).otherwise("other")


def batches(requirements: DataFrame, size: int = 10) -> DataFrame:
    """``requirements`` (document_name, id) in batches of ``size`` in order of id."""
    n = F.row_number().over(W.partitionBy("document_name").orderBy("id"))
    return requirements.withColumn("batch_id", F.floor((n - 1) / size).cast("int"))


def requirement_line() -> Column:
    head = F.concat(
        F.lit("ID="), F.col("id").cast("string"), F.lit(" | Раздел: "), F.coalesce("section", F.lit("")),
        F.lit(" | Категория: "), F.coalesce("category", F.lit("")), F.lit("\nТребование: "), F.coalesce("text", F.lit("")),
    )
    return F.when(F.coalesce("tables", F.lit("")) != "", F.concat(head, F.lit("\nТаблица:\n"), "tables")).otherwise(head)
