"""Uploads land once: under safe, unique names, whole or not at all, whatever is run again.

A batch of uploads (name, content) is written to a folder of its own with the digest of each content. A name
loses its directories and what is not safe in a file name; the head of the digest in front makes it unique,
so two files of one name both stay, and one file that comes twice is one. Contents that earlier batches
have under the same name are left out. A batch that is run again writes the same rows to the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..plans.kb import KnowledgeBase
from ..sources import files

LANDED = "name string, original string, sha256 string, bytes long, content binary"


def safe_upload_name(name, digest):
    """``<16 digits of the digest>_<last part of the name>``; names of dots or nothing count as 'upload'."""
    last = F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    plain = F.substring(T.safe_name(F.regexp_replace(last, r"^\.+", "")), -150, 150)
    return F.concat(F.substring(digest, 1, 16), F.lit("_"), F.when(plain == "", "upload").otherwise(plain))


class Landing:
    """A table of uploads below a folder, in folders of batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def files(self) -> DataFrame:
        """What has landed: name, original name, sha256, bytes, content, batch."""
        schema = LANDED + ", batch long"
        if not storage.exists(self.spark, self.folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder)

    def land(self, uploads: DataFrame, batch: int) -> DataFrame:
        """Lands ``uploads`` (name, content) as a batch and returns its files. Null contents are empty files."""
        content = F.coalesce("content", F.lit(b""))
        digest = F.sha2(content, 256)
        named = uploads.select(
            safe_upload_name(F.col("name"), digest).alias("name"), F.col("name").alias("original"), digest.alias("sha256"),
            F.octet_length(content).cast("long").alias("bytes"), content.alias("content"),
        ).dropDuplicates(["name", "sha256"])
        before = self.files().where(F.col("batch") < batch).select("name", "sha256")
        path = f"{self.folder}/batch={batch}"
        named.join(before, ["name", "sha256"], "left_anti").select("name", "original", "sha256", "bytes", "content").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(LANDED).parquet(path)


def ingest_uploads(spark: SparkSession, folder: str, landing: Landing, kb: KnowledgeBase, checkpoint: str):
    """A query that lands the files of a folder as they come and indexes them, each once."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def add(batch: DataFrame, number: int) -> None:
        name = F.url_decode(F.element_at(F.split("path", "/"), -1))
        landed = landing.land(batch.select(name.alias("name"), "content"), number)
        kb.add(files.to_documents(files.parse_files(landed.select(F.col("name").alias("path"), "content"), files.UPLOADS)))

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
