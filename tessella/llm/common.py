"""Shared helpers of the corpus operators: scratch tables, row identity, words, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after its rows have been counted; more go through a shuffle.
BROADCAST_ROWS = 500_000

_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local session gets a temporary folder and a cluster
    a folder below its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            if not _local:
                _local.append(tempfile.mkdtemp(prefix="tessella-"))
                atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
            base = "file://" + _local[0]
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that no later plan reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    The cleaner acts on garbage collections of the driver, which are rare while little runs there.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_hash() -> Column:
    """With doc_id the identity of a row: rows equal in both are the same document, repeated."""
    return F.xxhash64(F.col("text"))


def id_and_text(docs: DataFrame) -> list[Column]:
    """The two columns that operators read, in their fixed types."""
    return [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]


def hashed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, the hash that tells texts with one id apart."""
    return docs.select(*id_and_text(docs)).withColumn("th", text_hash())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def held_out_remainder(modulus: int) -> Column:
    """crc32 of the decimal doc_id; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows (views, no copies), so that a worker unpacks little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns what Arrow's pool no longer uses to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z in lower case; other bytes stay."""
    return text.lower().split()


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=count)


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes x in place."""
    x ^= x >> np.uint64(32)
    x *= _Q
    x ^= x >> np.uint64(29)
    return x


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the k-word shingles; fewer words make one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out *= _P
        out += hashes[i : n - k + 1 + i]
        out ^= out >> np.uint64(31)
    out += np.uint64(k)
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def fingerprint(spark: SparkSession, df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return row.n, row.x


def components(spark: SparkSession, edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the least node.

    Alternates large-star and small-star steps; each round is written to the shared folder.
    Only joins and min-aggregates, so no neighbour list is gathered. Nodes without edges are absent;
    null ends are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = keep(e, f"{folder}/cc0")
    seen = fingerprint(spark, e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for i in range(1, most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small_.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/cc{i}")
        now = fingerprint(spark, e)
        drop(spark, f"{folder}/cc{i - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", F.col("v").alias("component")).distinct()
    )
