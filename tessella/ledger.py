"""A ledger of provider calls: what was asked once is read, not asked again.

An answer is kept under the digest of the provider and its input. The digests of a frame of inputs are
anti-joined with the ledger, only what is absent is asked, each input once however many rows have it;
answers are appended and all rows read theirs from the ledger. So a plan that is evaluated again, a later run and
a lost executor after the write cost no call.

Few inputs are dealt out evenly. Many, most of them new and in one row each, are asked where they are:
rows are written with their answers beside them, which are then appended, and no input is shuffled. The
rest, of inputs that several rows have or that were answered before, is marked by 64-bit hashes and goes
the way of few inputs.

A call that fails after its retries gives a row with an error instead of failing its task, so the
answers beside it are kept; it is asked again next time. Two drivers that ask the same at once both
append, and every reader takes the earlier answer.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

#: Distinct inputs up to which each partition asks equally many; more are asked where they are or dealt by their digests.
EVEN = 10_000
#: Inputs of several rows or with answers that may be broadcast, as hashes; with more of them all are dealt.
BROADCAST_ROWS = 500_000


class CallsFailed(RuntimeError):
    """Some inputs have no answer; those that have one are in the ledger."""


def identity(provider) -> str:
    """What tells providers apart: their own ``identity``, else their class and state."""
    named = getattr(provider, "identity", None)
    if named is not None:
        return named
    state = hashlib.sha256(cloudpickle.dumps(provider)).hexdigest()
    return f"{type(provider).__module__}.{type(provider).__qualname__}:{state}"


def _tried(call: Callable[[list[str]], list], inputs: list[str]) -> tuple[list, str | None]:
    """Answers to some inputs, or nulls and what went wrong."""
    try:
        got = list(call(inputs))
        if len(got) != len(inputs):
            raise ValueError(f"{len(got)} answers for {len(inputs)} inputs")
        return got, None
    except Exception as e:
        return [None] * len(inputs), f"{type(e).__name__}: {e}"


class CallLedger:
    """A folder of answers, one table for each kind of call (key, value, error, asked_at).

    At most ``concurrency`` partitions ask at a time (by default as many as the session has cores).
    """

    def __init__(self, spark: SparkSession, folder: str, concurrency: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.concurrency = concurrency or spark.sparkContext.defaultParallelism

    def calls(self, kind: str, value: str) -> DataFrame:
        """All rows of a kind of call, errors too; a kind that was never asked is an empty table."""
        schema = f"key string, value {value}, error string, asked_at double, round string"
        path = f"{self.folder}/{kind}"
        if not storage.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def answers(self, kind: str, value: str, keys: DataFrame | None = None) -> DataFrame:
        """(key, value): the earliest answer of each key, or of each of ``keys`` (key)."""
        good = self.calls(kind, value).where("error is null")
        if keys is not None:
            good = good.join(keys, "key", "left_semi")
        return good.groupBy("key").agg(F.min_by("value", F.struct("asked_at", "round")).alias("value"))

    def ask(
        self, df: DataFrame, column: str, kind: str, value: str, provider: str, call: Callable[[list[str]], list], batch: int = 1,
        out: str = "answer", failing: str = "raise",
    ) -> DataFrame:
        """``df`` with the answers to its text ``column`` as ``out``.

        ``call`` answers a list of inputs of up to ``batch``; ``provider`` names it. Null inputs get null.
        With ``failing`` 'raise' inputs that can't be answered raise CallsFailed after the others were
        kept; with 'null' they get null.
        """
        found, *failures = self._ask(df, column, kind, value, provider, call, batch, out)
        failed = [f for f in failures if f]
        if failed and failing == "raise":
            raise CallsFailed(f"{sum(n for n, _ in failed)} calls of {kind} failed, the first one: {failed[0][1]}")
        return found

    def _ask(
        self, df: DataFrame, column: str, kind: str, value: str, provider: str, call: Callable, batch: int, out: str, staying: bool = True
    ) -> tuple:
        """The frame of ``ask``, then what failed each time that it asked; with ``staying`` many inputs are asked where they are, if they can be."""
        key = F.sha2(F.concat(F.lit(f"{kind}\x1f{provider}\x1f"), F.col(column)), 256)
        keyed = df.withColumn("_key", key)
        folder = storage.scratch(self.spark)
        placed = keyed.where("_key is not null").select(F.col("_key").alias("key"), F.spark_partition_id().alias("at"))
        wanted = storage.keep(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")), f"{folder}/wanted")
        absent = storage.keep(wanted.join(self.answers(kind, value).select("key"), "key", "left_anti"), f"{folder}/absent")
        told = absent.agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("single"), F.count_distinct("at").alias("parts")).first()
        given = wanted.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
        if staying and told.keys > EVEN and 2 * told.single >= given.rows and given.keys - told.single <= BROADCAST_ROWS and 2 * told.parts >= self.concurrency:
            others = wanted.join(absent.where("n = 1").select("key"), "key", "left_anti").select("key")
            done = storage.keep(self._stay(keyed, others, column, value, call, batch), f"{folder}/done")
            asked = done.where("_told.asked_at is not null").select(F.col("_key").alias("key"), "_told.value", "_told.error", "_told.asked_at")
            failed = self._append(asked, kind, value)
            found = done.where("_other is null").select(*df.columns, F.col("_told.value").alias(out))
            if given.keys == told.single:
                return found, failed
            rest, more = self._ask(done.where("_other").select(*df.columns), column, kind, value, provider, call, batch, out, False)
            return found.unionByName(rest), failed, more
        inputs = keyed.where("_key is not null").select(F.col("_key").alias("key"), F.col(column).alias("input"))
        if told.keys < given.keys:
            inputs = inputs.join(absent.select("key"), "key", "left_semi")
        one = F.first("input").alias("input")
        if not told.keys or told.most == 1:
            inputs = inputs.repartition(self.concurrency)
        elif told.keys > EVEN:  # one shuffle finds equal inputs and deals them to the partitions that ask
            inputs = inputs.repartition(self.concurrency, "key").groupBy("key").agg(one)
        else:
            inputs = inputs.groupBy("key").agg(one).repartition(self.concurrency)
        failed = self._add(inputs, kind, value, call, batch) if told.keys else None
        found = self.answers(kind, value, wanted.select("key")).select(F.col("key").alias("_key"), F.col("value").alias(out))
        return keyed.join(found, "_key", "left").select(*df.columns, out), failed

    def _stay(self, keyed: DataFrame, others: DataFrame, column: str, value: str, call: Callable, batch: int) -> DataFrame:
        """``keyed`` with _told (value, error, asked_at), null for rows of ``others`` (key), which are marked (_other)."""

        @F.pandas_udf(f"struct<value: {value}, error: string, asked_at: double>")
        def run(inputs: pd.Series) -> pd.DataFrame:
            told = pd.DataFrame({"value": None, "error": None, "asked_at": None}, index=range(len(inputs)), dtype=object)
            asked = np.flatnonzero(inputs.notna())
            for i in range(0, len(asked), batch):
                places = asked[i : i + batch]
                got, error = _tried(call, inputs.iloc[places].tolist())
                for place, answer in zip(places, got, strict=True):
                    told.iat[place, 0] = answer
                told.iloc[places, 1], told.iloc[places, 2] = error, time.time()
            return told

        hashes = others.select(F.xxhash64("key").alias("_hash")).distinct().withColumn("_other", F.lit(True))
        marked = keyed.join(F.broadcast(hashes), F.xxhash64("_key") == F.col("_hash"), "left").drop("_hash")
        return marked.coalesce(self.concurrency).withColumn("_told", run.asNondeterministic()(F.when(F.col("_other").isNull(), F.col(column))))

    def _add(self, absent: DataFrame, kind: str, value: str, call: Callable, batch: int) -> tuple[int, str] | None:
        """Asks what is absent, in the partitions that it has, and appends it; how many failed and how."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for frame in frames:
                keys, inputs = frame["key"].tolist(), frame["input"].tolist()
                for i in range(0, len(frame), batch):
                    got, error = _tried(call, inputs[i : i + batch])
                    yield pd.DataFrame({"key": keys[i : i + batch], "value": got, "error": error, "asked_at": time.time()})

        return self._append(absent.mapInPandas(run, f"key string, value {value}, error string, asked_at double"), kind, value)

    def _append(self, asked: DataFrame, kind: str, value: str) -> tuple[int, str] | None:
        """Appends answers (key, value, error, asked_at); how many calls failed and how."""
        name = uuid.uuid4().hex
        asked.write.parquet(f"{self.folder}/{kind}/round={name}")
        errors = self.calls(kind, value).where((F.col("round") == name) & F.col("error").isNotNull())
        told = errors.agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("first")).first()
        return (told.n, told.first) if told.n else None

    def compact(self, kind: str, value: str) -> None:
        """One round of the answers in place of all rounds; errors and repeats go. Not while others ask."""
        path = f"{self.folder}/{kind}"
        old = storage.names(self.spark, path)
        good = self.calls(kind, value).where("error is null")
        first = good.groupBy("key").agg(F.min(F.struct("asked_at", "round")).alias("f"), F.min_by("value", F.struct("asked_at", "round")).alias("value"))
        kept = first.select("key", "value", F.lit(None).cast("string").alias("error"), F.col("f.asked_at").alias("asked_at"))
        kept.write.parquet(f"{path}/round={uuid.uuid4().hex}")
        for name in old:
            storage.delete(self.spark, f"{path}/{name}")
