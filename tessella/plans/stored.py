"""More registered queries: those of stored tables, written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..config import EngineConfig
from ..ledger import CallLedger
from ..operators import answers as A
from ..operators import requirements as R
from ..providers import completed
from ..sources import pages as P
from ..streaming import state
from ..streaming.landing import Landing
from .catalog import _KNN, _L2, ORACLE_SQL, query, table
from .kb import KnowledgeBase
from .vector_index import VectorIndex


class Sizes:
    """An embedding for texts of any length: how long they are."""

    identity = "sizes"

    def embed(self, texts):
        return [[float(len(t))] for t in texts]


@query("""
WITH d AS (SELECT doc_id::varchar AS doc_key, source, trim(CASE WHEN lang = 'en' THEN '' ELSE 'again ' END || text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, lang FROM documents)
SELECT doc_key, source, md5(t) AS text_md5 FROM d WHERE lang <> 'es' AND t <> ''
""")
def kb_reindexed(spark, sf_dir):
    """A base after its documents were added, most languages added again with other texts, one unchanged, one removed."""
    base = KnowledgeBase(spark, f"{storage.scratch(spark)}/kb", EngineConfig(chunk_size=10**9, chunk_overlap=0), Sizes())
    metadata = F.create_map(F.lit("source"), F.col("source")).alias("metadata")
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "text", metadata, "lang")
    again = given.where("lang <> 'en'").withColumn("text", F.concat(F.lit("again "), F.col("text")))
    base.add(given)
    base.add(again)
    base.add(again.where("lang = 'de'"))
    base.remove(given.where("lang = 'es'").select("doc_key"))
    return base.chunks().select("doc_key", F.element_at("metadata", "source").alias("source"), F.md5("text").alias("text_md5"))


def _indexed(spark, sf_dir, metric):
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(vectors.withColumnRenamed("vec_id", "id"), f"{storage.scratch(spark)}/index", metric)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(asked, 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(_KNN.format(distance=_L2))
def kb_index_topk_l2(spark, sf_dir):
    """Nearest vectors by the persisted index."""
    return _indexed(spark, sf_dir, "l2")


@query(ORACLE_SQL["kb_topk_cosine"])
def kb_index_topk_cosine(spark, sf_dir):
    return _indexed(spark, sf_dir, "cosine")


@query("""
SELECT event_id, event_type AS section, upper(event_type) AS text, event_id::varchar AS tables FROM events WHERE event_id % 3 <> 2
""")
def json_answer_records(spark, sf_dir):
    """Records of answers of which a third are plain JSON, a third have talk, a fence and a trailing comma, a third can't be read."""
    record = F.to_json(F.struct(F.col("event_type").alias("Clause"), F.lit(" ").alias("text"), F.upper("event_type").alias("Requirement"), F.col("event_id").cast("string").alias("table")))
    m = F.col("event_id") % 3
    said = F.when(m == 0, F.concat(F.lit("["), record, F.lit(", 7]"))).when(m == 1, F.concat(F.lit('Here:\n```json\n{"requirements": ['), record, F.lit(",]}\n```"))).otherwise(F.concat(record, record))
    found, _ = A.records(table(spark, sf_dir, "events").select("event_id", said.alias("answer")), "answer", R.ALIASES)
    return found.select("event_id", "section", "text", "tables")


@query("""
WITH d AS (SELECT doc_id::varchar AS doc_key, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, source FROM documents),
c AS (SELECT *, md5(doc_key || chr(31) || '0' || chr(31) || t) AS id FROM d WHERE t <> ''),
r AS (
  SELECT item_id AS query_id, c.*, ((length(c.t) - length(b.text)) * (length(c.t) - length(b.text)))::double AS distance,
    row_number() OVER (PARTITION BY item_id ORDER BY abs(length(c.t) - length(b.text)), id)::int AS rank
  FROM c, benchmark b
)
SELECT query_id, rank, distance, md5(t) AS content, source, 'title of ' || doc_key AS title FROM r WHERE rank <= 3
""")
def kb_search_endpoint(spark, sf_dir):
    """Whole texts embedded by a provider and added, then searched for benchmark items by the base's index."""
    base = KnowledgeBase(spark, f"{storage.scratch(spark)}/kb", EngineConfig(chunk_size=10**9, chunk_overlap=0, embedding_dim=1, embedding_model="sizes"), Sizes())
    key = F.col("doc_id").cast("string")
    metadata = F.create_map(F.lit("source"), F.col("source"), F.lit("title"), F.concat(F.lit("title of "), key)).alias("metadata")
    base.add(table(spark, sf_dir, "documents").select(key.alias("doc_key"), "text", metadata))
    base.build_index()
    found = base.search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3)
    return found.select("query_id", "rank", "distance", F.md5("content").alias("content"), "source", "title")


class Echo:
    """A model that says what it was asked."""

    identity = "echo"

    def complete(self, prompts):
        return [f"asked: {p}" for p in prompts]


@query("SELECT conv_id, turn, 'asked: ' || role AS answer FROM conversations")
def ledger_answers(spark, sf_dir):
    """Answers by the call ledger: a prompt of many rows is asked once."""
    ledger = CallLedger(spark, f"{storage.scratch(spark)}/ledger")
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"))
    return completed(asked, Echo(), ledger=ledger).select("conv_id", "turn", "answer")


@query("SELECT url, 'page ' || page_id::varchar AS title, md5(html) AS content FROM pages WHERE html <> ''")
def page_cache_roundtrip(spark, sf_dir):
    """Pages written to the cache and read back."""
    folder = f"{storage.scratch(spark)}/cache"
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    found = table(spark, sf_dir, "pages").select("url", title.alias("title"), F.array(title).alias("breadcrumbs"), F.col("html").alias("content"), title.alias("section_path"))
    P.write_cache(found, folder)
    return P.read_cache(spark, folder).select("url", "title", F.md5("content").alias("content"))


@query("""
WITH u AS (SELECT DISTINCT doc_id % 50 AS n, sha256(text) AS sha256, strlen(text)::bigint AS bytes FROM documents)
SELECT substr(sha256, 1, 16) || '_upload_' || n::varchar || '.txt' AS name, sha256, bytes FROM u
""")
def upload_landing(spark, sf_dir):
    """Documents as uploads under fifty names, landed in two batches of which one comes twice."""
    landing = Landing(spark, f"{storage.scratch(spark)}/landing")
    n = (F.col("doc_id") % 50).cast("string")
    given = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("dir/upload "), n, F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    for number in (0, 1, 0):
        landing.land(given.where(F.col("doc_id") % 2 >= number), number)
    return landing.files().select("name", "sha256", "bytes")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 14400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts)::bigint AS session FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session
""")
def ingest_session_windows(spark, sf_dir):
    """Sessions by session windows, as a stream gives them too."""
    found = state.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "240 minutes")
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")
