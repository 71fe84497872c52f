"""Knowledge base: chunk, embed, add, search, status. Chunks are a versioned table, keyed by model and document."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import EngineConfig
from ..functions import text as T
from ..functions.chunk import chunks
from ..ledger import CallLedger
from ..operators import search as S
from ..providers import EmbeddingProvider, embedded
from ..schemas import CHUNK
from .vector_index import VectorIndex
from .versioned import BROADCAST_ROWS, VersionedTable


def chunked(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """Chunks of ``documents`` (doc_key, text, metadata), identified by content, key and position."""
    parts = documents.select("doc_key", "metadata", F.posexplode(chunks(F.col("text"), config.chunk_size, config.chunk_overlap)).alias("pos", "text"))
    ident = F.md5(F.concat_ws("\x1f", "doc_key", F.col("pos").cast("string"), "text"))
    return parts.select(ident.alias("chunk_id"), "doc_key", "pos", "text", "metadata")


def status_of(chunks_: DataFrame) -> DataFrame:
    """Vectors and documents of a chunk table, and whether it can be searched."""
    counted = chunks_.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("doc_key").alias("documents"))
    return counted.withColumn("ready", F.col("vectors") > 0)


def digests(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """(doc_key, digest) of what the chunks of each document depend on: its texts, in any order of rows, and settings.

    Metadata are not part of it: a document with the same texts keeps those that it was added with.
    """
    how = f"{config.chunk_size}:{config.chunk_overlap}"
    row = F.md5(F.concat_ws("\x1f", F.lit(how), F.col("text")))
    half = lambda at: F.bit_xor(F.conv(F.substring("row", at, 15), 16, 10).cast("long"))
    rows = documents.select("doc_key", row.alias("row")).distinct()
    return rows.groupBy("doc_key").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1).cast("string"), half(17).cast("string")).alias("digest"))


class KnowledgeBase:
    """A folder of chunks, by embedding model and document; a document that is added again replaces its former chunks.

    With a ``ledger`` a provider embeds each text once, in whatever run.
    """

    def __init__(
        self, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig(), provider: EmbeddingProvider | None = None,
        ledger: CallLedger | None = None,
    ):
        self.spark, self.folder, self.config, self.provider = spark, folder.rstrip("/"), config, provider
        self.ledger = ledger if ledger is not None or provider is None else CallLedger(spark, f"{self.folder}_ledger")
        self.table = VersionedTable(spark, self.folder, CHUNK + ", model string", ["model", "doc_key"])

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("model") == self.config.embedding_model).drop("model")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks of the configured model in a version (by default the last); an absent base is an empty table."""
        return self._own(self.table.rows(version))

    def add(self, documents: DataFrame) -> int:
        """Chunks, embeds and adds ``documents`` (doc_key, text, metadata); returns the version that has them.

        Documents that are there unchanged are left alone. A document whose text is blank now has no chunks.
        """
        model = F.lit(self.config.embedding_model).alias("model")
        columns = [documents["doc_key"].cast("string").alias("doc_key"), "text", "metadata"]
        given = storage.keep(documents.select(*columns).where("doc_key is not null"), f"{storage.scratch(self.spark)}/given")
        there = self._own(self.table.live_keys()).select("doc_key", "digest")
        keys = storage.keep(digests(given, self.config).join(there, ["doc_key", "digest"], "left_anti"), f"{storage.scratch(self.spark)}/keys")
        many = keys.count()
        if not many:
            return self.table.manifest()["version"]
        changed = given.where(T.not_blank(F.col("text")))
        if many == given.count():  # all documents are changed and each is one row: no text needs a shuffle
            new = chunked(changed, self.config)
        else:  # one shuffle, by document, serves both
            new = chunked(changed.join(keys.select("doc_key"), "doc_key", "left_semi"), self.config).dropDuplicates(["doc_key", "chunk_id"])
        new = storage.keep(new, f"{storage.scratch(self.spark)}/chunks")  # texts are cut once, and not in the tasks that embed
        rows = embedded(new, self.provider, self.config.embedding_dim, self.config.embedding_batch, self.ledger)
        return self.table.put(rows.withColumn("model", model), keys.withColumn("model", model))

    def remove(self, documents: DataFrame) -> int:
        """Removes the chunks of ``documents`` (doc_key)."""
        return self.table.remove(documents.select("doc_key", F.lit(self.config.embedding_model).alias("model")))

    def compact(self) -> int:
        return self.table.compact()

    def reset(self) -> int:
        """Empties the base; former versions stay readable until ``table.vacuum``."""
        return self.table.reset()

    def status(self) -> DataFrame:
        return status_of(self.chunks())

    def _index_folder(self) -> str:
        """Where an index of the last version is: a change of the base or of the model leads elsewhere."""
        c = self.config
        model = hashlib.md5(f"{c.embedding_model}:{c.embedding_dim}".encode()).hexdigest()[:12]
        return f"{self.folder}_index/{model}-{self.table.manifest()['version']:020d}"

    def build_index(self) -> VectorIndex:
        """Indexes the vectors of the last version; ``search`` uses the index until the base changes. Indexes of former versions go."""
        folder = self._index_folder()
        if not storage.exists(self.spark, f"{folder}/about.json"):
            storage.delete(self.spark, folder)  # what an interrupted build left
            VectorIndex.build(self.chunks().select(F.col("chunk_id").alias("id"), "embedding"), folder, dim=self.config.embedding_dim)
        parent, name = folder.rsplit("/", 1)
        for other in storage.names(self.spark, parent):
            if other[:13] == name[:13] and other < name:
                storage.delete(self.spark, f"{parent}/{other}")
        return VectorIndex(self.spark, folder)

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The k nearest chunks of ``queries`` (query_id, text): rank, distance, content, metadata, source, title.

        With an index of the last version only blocks in reach are read, else all chunks; the rows are the same.
        """
        if not queries.where(~T.not_blank(F.col("text"))).isEmpty():
            raise ValueError("a query is empty")
        asked = embedded(queries.select("query_id", "text"), self.provider, self.config.embedding_dim, ledger=self.ledger)
        asked = storage.keep(asked.select("query_id", "embedding"), f"{storage.scratch(self.spark)}/asked")
        base, k, folder = self.chunks().withColumnRenamed("chunk_id", "id"), k or self.config.top_k, self._index_folder()
        indexed = storage.exists(self.spark, f"{folder}/about.json")
        hits = VectorIndex(self.spark, folder).search(asked, k) if indexed else S.top_k(asked, base.select("id", "embedding"), k)
        hits = storage.keep(hits, f"{storage.scratch(self.spark)}/hits")
        if hits.count() <= BROADCAST_ROWS:  # the texts stay where they are
            hits = F.broadcast(hits)
        joined = base.select("id", "text", "metadata").join(hits, "id")
        return joined.select(
            "query_id", "rank", "distance", F.col("text").alias("content"), "metadata", S.hit_source(F.col("metadata")).alias("source"),
            F.coalesce(F.element_at("metadata", "title"), F.lit("")).alias("title"),
        )
