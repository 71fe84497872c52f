"""Similarity and keyword search: top-k vector join, substring join, result lists, routed fallback."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import grams
from . import nearest as N

#: Queries that one pass over the base holds; more are answered in further passes.
QUERY_BLOCK = 4096
#: Rows and queries that are compared at once.
TILE = 1024
#: Bytes of search strings that may be broadcast; more are joined by a shuffle.
NEEDLE_BYTES = 32 << 20


def _scan(shared, k: int, metric: str):
    """Partial top-k of a partition: k rows for each query at most."""

    def run(batches):
        asked, x = shared.value
        found = None
        for batch in batches:
            good, y = N.numbers(batch.column(1), x.shape[1])
            ids = N.names(batch.column(0))[good]
            if metric == "cosine":  # a zero vector has no direction
                some = (y * y).sum(1) > 0
                ids, y = ids[some], y[some]
            new = N.nearest(x, y, ids, k, metric, tile=TILE)
            found = new if found is None else N.first_k(*(np.concatenate(z) for z in zip(found, new, strict=True)), k)
        if found is not None and len(found[0]):
            q, d, ids = found
            yield pa.RecordBatch.from_arrays([N.arrow_names(asked[q]), N.arrow_names(ids), pa.array(d)], names=["query_id", "id", "distance"])

    return run


def id_type(df: DataFrame, column: str) -> str:
    """Ids are strings or, if they are any kind of number, longs."""
    return "string" if df.schema[column].dataType.simpleString() == "string" else "long"


def top_k(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "l2") -> DataFrame:
    """The k nearest rows of ``base`` (id, embedding) for each of ``queries`` (query_id, embedding).

    Returns query_id, id, distance (squared L2, or 1 - cosine) and rank; ties go to the lower id. Ids
    are numbers or strings. The base is scanned once for each block of QUERY_BLOCK queries, and a
    partition gives k rows for each query at most; many queries are better asked of a ``VectorIndex``.
    Null vectors and those of another dimension than the block's are left out, and by cosine zero
    vectors too, which have no direction.
    """
    spark = base.sparkSession
    asked_type, base_type = id_type(queries, "query_id"), id_type(base, "id")
    queries = queries.where("embedding is not null and query_id is not null").select(F.col("query_id").cast(asked_type), "embedding")
    if metric == "cosine":
        queries = queries.where(F.exists("embedding", lambda v: v != 0))
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    found = spark.createDataFrame([], f"query_id {asked_type}, id {base_type}, distance double")
    base = base.where("id is not null").select(F.col("id").cast(base_type), "embedding")
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        by_dim: dict[int, list] = {}
        for i, v in enumerate(part["embedding"].to_pylist()):
            by_dim.setdefault(len(v), []).append((i, v))
        ids = N.names(part["query_id"])
        for some in by_dim.values():
            shared = spark.sparkContext.broadcast((ids[[i for i, _ in some]], np.array([v for _, v in some], dtype=np.float64)))
            found = found.union(base.mapInArrow(_scan(shared, k, metric), found.schema))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def url_index(urls: DataFrame, root: str) -> DataFrame:
    """``urls`` (url, ord) by lower-case path: the last url of a path wins, at its first place."""
    keyed = urls.withColumn("path", T.url_path(F.col("url"), root))
    return keyed.groupBy("path").agg(F.max_by("url", "ord").alias("url"), F.min("ord").alias("ord"))


def match_keywords(keywords: DataFrame, index: DataFrame, limit: int = 10, prefix: str | None = None) -> DataFrame:
    """Urls whose path holds keywords: ``keywords`` (query_id, kw_ord, keyword) x ``index`` (path, url, ord).

    Score is the number of keyword entries found; ties go to the earlier keyword, then to the index
    order. Keywords that normalise to nothing match nothing. Returns query_id, url, score, rank. The
    substring join is over distinct normalised keywords, which is the smaller side.
    """
    keys = keywords.withColumn("key", T.keyword_key(F.col("keyword"))).where("key <> ''")
    if prefix:
        index = index.where(F.startswith("path", F.lit(prefix)))
    paths = index.withColumn("flat", T.path_key(F.col("path")))
    hits = containing(keys.select("key").distinct(), paths.select("flat", "url", "ord"), "key", "flat").drop("flat")
    scored = keys.join(hits, "key").groupBy("query_id", "url").agg(
        F.count(F.lit(1)).alias("score"), F.min(F.struct("kw_ord", "ord")).alias("first")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first", "url"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "url", "score", "rank")


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Rows of ``texts`` with each of the distinct ``needles`` that its column ``text`` contains; empty and null ones match nothing.

    Strings meet texts at their rarest gram (see ``grams``), any number of them in the same two passes.
    """
    return grams.containing(needles, texts, needle, text, NEEDLE_BYTES)


def contained(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) of ``items`` (item_id, text) that stand word for word in ``docs`` (doc_id, text)."""
    named = items.select("item_id", F.col("text").alias("item"))
    found = containing(named.select("item"), docs.select("doc_id", "text"), "item", "text").select("item", "doc_id")
    return found.join(named, "item").select("item_id", "doc_id")


def with_pages(matched: DataFrame, pages: DataFrame, max_pages: int, source_type: str, min_content: int = 50, snippet: int = 300) -> DataFrame:
    """Search results from matched urls that are cached; pages too short leave a gap that isn't filled."""
    wanted = matched.where(F.col("rank") <= max_pages)
    joined = wanted.join(pages, "url").where(F.length("content") >= min_content)
    return joined.select(
        "query_id", "rank", "url", "title", T.truncated(F.col("content"), snippet).alias("snippet"), "content",
        F.lit(source_type).alias("source_type"),
    )


def first_seen(results: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """The first row of each ``keys`` in ``order``; with a limit, that many rows for each first key."""
    first = results.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    if limit is None:
        return first
    rank = F.row_number().over(W.partitionBy(keys[0]).orderBy(*order))
    return first.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


#: The search tiers of each category; the first that finds something answers.
ROUTES = {
    "technical": ("docs", "site", "rag"),
    "sla": ("docs", "site", "rag"),
    "security": ("documents+docs", "site", "rag"),
    "legal": ("documents+docs", "site", "rag"),
    "commercial": ("site", "web", "rag"),
    "other": ("site", "web", "rag"),
}


def route(results: DataFrame, limit: int = 5) -> DataFrame:
    """Of ``results`` (query_id, tier, branch, rank, url, ...) the lowest tier of each query, each url once."""
    low = results.groupBy("query_id").agg(F.min("tier").alias("tier"))
    best = results.join(low, ["query_id", "tier"])
    best = first_seen(best, ["query_id", "url"], ["branch", "rank"], None)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("branch", "rank"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def staged(queries: DataFrame, tiers: list, folder: str) -> DataFrame:
    """Runs costly tiers one after another, each only for queries that found nothing before.

    A tier is a function of a frame of queries (query_id, ...) that gives results. Its rows are
    written, so that a provider is asked once.
    """
    spark = queries.sparkSession
    out, left = None, queries
    for i, tier in enumerate(tiers):
        tier(left).withColumn("tier", F.lit(i)).write.parquet(f"{folder}/tier{i}")
        found = spark.read.parquet(f"{folder}/tier{i}")
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
        if left.isEmpty():
            break
    return out


def context(hits: DataFrame, chars: int | None = None) -> DataFrame:
    """Context text of each query's ranked hits (query_id, rank, source, title, content)."""
    body = T.truncated(F.col("content"), chars) if chars else F.col("content")
    block = F.concat(F.lit("[Источник: "), "source", F.lit("]\n[Заголовок: "), "title", F.lit("]\n"), body)
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def hit_source(metadata: Column) -> Column:
    """Where a chunk comes from: its url if that is a web address, else its source, else 'unknown'."""
    url = F.element_at(metadata, "url")
    return F.coalesce(F.when(F.startswith(url, F.lit("http")), url), F.element_at(metadata, "source"), F.lit("unknown"))
