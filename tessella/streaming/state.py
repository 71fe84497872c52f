"""State over streams: when a page is to be read again, sessions that close, rows that come too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import storage

#: The store that transformWithState needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_VISITS = "url string, digest string, event string, at timestamp, next_visit timestamp"


class Frontier(StatefulProcessor):
    """For each url its last digest and how long it may go unread; a timer says when that is over.

    A visit with another digest halves the interval, one with the same doubles it, between ``shortest`` and
    ``longest`` seconds. Rows: event 'new', 'changed' or 'same' for a visit, 'due' when the timer goes. A page that
    is due ``forget`` times without a visit is forgotten. Visits of a batch count in order of their times; one
    that is earlier than the last known visit changes nothing.
    """

    def __init__(self, first: float = 86_400.0, shortest: float = 3600.0, longest: float = 30 * 86_400.0, forget: int = 3):
        self.first, self.shortest, self.longest, self.forget = first, shortest, longest, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "digest string, seen double, interval double, missed int")

    def _wait(self, interval: float, at: float) -> float:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        until = at + interval
        self.handle.registerTimer(int(until * 1000))
        return until

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["url", "digest", "event", "at", "next_visit"])
        for c in ("at", "next_visit"):
            frame[c] = pd.to_datetime(frame[c], unit="s", utc=True)
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        visits = pd.concat(list(rows)).sort_values(["seen", "digest"], kind="stable")
        out = []
        for digest, at in zip(visits["digest"], visits["seen"], strict=True):
            if not self.page.exists():
                event, interval = "new", self.first
            else:
                old, seen, interval, _ = self.page.get()
                if at < seen:
                    continue
                event = "same" if old == digest else "changed"
                interval = min(self.longest, interval * 2) if event == "same" else max(self.shortest, interval / 2)
            self.page.update((digest, float(at), float(interval), 0))
            out.append((key[0], digest, event, at, self._wait(interval, at)))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        digest, seen, interval, missed = self.page.get()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if missed + 1 >= self.forget:
            self.page.clear()
            yield self._frame([(key[0], digest, "due", at, None)])
        else:
            self.page.update((digest, seen, interval, missed + 1))
            yield self._frame([(key[0], digest, "due", at, self._wait(interval, at))])

    def close(self) -> None:
        pass


def frontier(visits: DataFrame, late: str = "1 hour", **settings) -> DataFrame:
    """What each visit of a stream ``visits`` (url, digest, at timestamp) tells, and which pages are due: see Frontier.

    Timers go with the watermark, ``late`` behind the latest visit, so a run over the same batches gives the same
    rows. The session must use the RocksDB state store (``STORE``).
    """
    timed = visits.select("url", "digest", F.col("at").alias("at"), F.unix_micros("at").cast("double").alias("micros"))
    timed = timed.select("url", "digest", "at", (F.col("micros") / 1e6).alias("seen")).withWatermark("at", late)
    grouped = timed.groupBy("url")
    return grouped.transformWithStateInPandas(Frontier(**settings), _VISITS, "Append", "EventTime")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "2 hours") -> DataFrame:
    """Runs of a key's ``events`` that are less than ``gap`` apart: key, first, last, n. Works on streams and on tables.

    A stream gives a session once the watermark has passed its end, or all of them in mode complete.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    found = timed.groupBy(key, F.session_window("_ts", gap).alias("w"))
    return found.agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def split_late(spark: SparkSession, folder: str, ts: str, late_seconds: float):
    """A function for foreachBatch that writes a batch's rows to the tables ``on_time`` and ``late`` below the folder.

    Late are rows more than ``late_seconds`` behind the latest one of earlier batches. Each batch writes its
    own folders and looks at those of lower numbers only, so a batch that is run again gives the same.
    """
    folder = folder.rstrip("/")

    def add(batch: DataFrame, number: int) -> None:
        mark = None
        if storage.exists(spark, f"{folder}/marks"):
            marks = spark.read.schema("latest timestamp, batch long").parquet(f"{folder}/marks")
            mark = marks.where(F.col("batch") < number).agg(F.max("latest").alias("m")).first().m
        when = F.col(ts).cast("timestamp")
        is_late = when < F.lit(mark) - F.make_dt_interval(secs=F.lit(late_seconds)) if mark else F.lit(False)
        rows = storage.keep(batch, f"{storage.scratch(spark)}/batch")
        split = rows.withColumn("_late", F.coalesce(is_late, F.lit(False)))
        for name, part in (("on_time", split.where("not _late")), ("late", split.where("_late"))):
            part.drop("_late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        rows.agg(F.max(when).alias("latest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return add
