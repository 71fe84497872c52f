"""A versioned table of Parquet segments, for tables that several writers change by key.

A write makes a segment of rows, and beside it the keys that it speaks for; then it commits a
manifest that lists the segments of the next version. The manifest's file is put in place only if
none of its number is there, so of two writers one comes second: it reads the other's version and
commits on top. Of a key the segment of the latest version counts, so indexing a source again retires
its former rows, and removing it is a segment of keys without rows. Versions stay readable until
``vacuum``; ``compact`` writes the rows that count as one segment.

Atomic placement needs a file system whose rename or link fails if the target is there: local and
mounted folders, HDFS. Segments of failed or interrupted writers are in no manifest and never read.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Retired (key, segment) pairs that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class Conflict(RuntimeError):
    """Other writers came first each time."""


class VersionedTable:
    """Rows of a fixed schema (DDL) with key columns; keys carry a digest of what they were written from."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], attempts: int = 50):
        self.spark, self.folder, self.schema, self.keys, self.attempts = spark, folder.rstrip("/"), schema, keys, attempts
        kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
        self.key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", digest string"

    # Manifests

    def _path(self, version: int) -> str:
        return f"{self.folder}/versions/{version:020d}.json"

    def versions(self) -> list[int]:
        """Committed versions that are still there."""
        return [int(n[:20]) for n in storage.names(self.spark, f"{self.folder}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """What a version (by default the last) holds; before the first one nothing."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "operation": "create", "segments": [], "retired": 0}
        if version not in known:
            raise KeyError(f"there is no version {version}")
        return json.loads(self.spark.read.option("wholetext", True).text(self._path(version)).first().value)

    def _publish(self, manifest: dict) -> bool:
        """Puts a manifest in place if its version is still free."""
        text = json.dumps(manifest, ensure_ascii=False).encode()
        fs, target = storage.file_system(self.spark, self._path(manifest["version"]))
        fs.mkdirs(target.getParent())
        draft = f"{self.folder}/versions/_{uuid.uuid4().hex}"
        fs, draft = storage.file_system(self.spark, draft)
        out = fs.create(draft, False)
        out.write(bytearray(text))
        out.close()
        try:
            if fs.getScheme() == "file":  # a local rename would replace the other's file, a link does not
                try:
                    os.link(draft.toUri().getPath(), target.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(target) and bool(fs.rename(draft, target))
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)

    def _commit(self, build) -> int:
        """Commits what ``build`` makes of the last version, again on top of others that came first."""
        for attempt in range(self.attempts):
            last = self.manifest()
            if self._publish(new := build(last) | {"version": last["version"] + 1}):
                return new["version"]
            time.sleep(0.02 * attempt)
        raise Conflict(f"{self.attempts} attempts to commit to {self.folder} failed")

    # Reading

    def _read(self, kind: str, segments: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/segment={s['name']}" for s in segments if kind == "keys" or s["rows"]]
        if not paths:
            return self.spark.createDataFrame([], schema + ", segment string")
        return self.spark.read.schema(schema + ", segment string").option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _all_keys(self, segments: list[dict]) -> DataFrame:
        """Keys of segments with the number of the version that added them."""
        at = self.spark.createDataFrame([(s["name"], s["seq"]) for s in segments], "segment string, seq long")
        return self._read("keys", segments, self.key_schema).join(F.broadcast(at), "segment")

    def live_keys(self, version: int | None = None, removed: bool = False) -> DataFrame:
        """Each key with the digest and segment that count; removed keys only if asked for."""
        return self._live(self.manifest(version)["segments"], removed)

    def _live(self, segments: list[dict], removed: bool = False) -> DataFrame:
        newest = self._all_keys(segments).groupBy(*self.keys).agg(F.max_by(F.struct("segment", "digest"), "seq").alias("n"))
        found = newest.select(*self.keys, "n.digest", "n.segment")
        return found if removed else found.where("digest is not null")

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Only if keys were written twice is anything joined."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict) -> DataFrame:
        rows = self._read("rows", manifest["segments"], self.schema)
        if not manifest["retired"]:
            return rows.drop("segment")
        keys = self._all_keys(manifest["segments"])
        newest = keys.groupBy(*self.keys).agg(F.max("seq").alias("newest"))
        retired = keys.join(newest, self.keys).where("seq < newest").select(*self.keys, "segment")
        if manifest["retired"] <= BROADCAST_ROWS:
            retired = F.broadcast(retired)
        return rows.join(retired, [*self.keys, "segment"], "left_anti").select(*[f.name for f in rows.schema if f.name != "segment"])

    # Writing

    def _segment(self, rows: DataFrame | None, keys: DataFrame) -> dict | None:
        """Writes a segment that no version has yet; None if it speaks for no key."""
        name = uuid.uuid4().hex
        keys.select(*self.keys, "digest").dropDuplicates(self.keys).write.parquet(f"{self.folder}/keys/segment={name}")
        many = self._read("keys", [{"name": name}], self.key_schema).count()
        if not many:
            return None
        count = 0
        if rows is not None:
            rows.write.parquet(f"{self.folder}/rows/segment={name}")
            count = self._read("rows", [{"name": name, "rows": 1}], self.schema).count()
        return {"name": name, "rows": count, "keys": many}

    def _add(self, segment: dict | None, operation: str) -> int:
        if segment is None:
            return self.manifest()["version"]

        def build(last: dict) -> dict:
            own = self._read("keys", [segment], self.key_schema).select(*self.keys)
            again = own.join(self._all_keys(last["segments"]).select(*self.keys), self.keys, "left_semi").count() if last["segments"] else 0
            placed = segment | {"seq": last["version"] + 1}
            return {"operation": operation, "segments": [*last["segments"], placed], "retired": last["retired"] + again}

        return self._commit(build)

    def put(self, rows: DataFrame, keys: DataFrame) -> int:
        """Writes ``rows`` in place of all that ``keys`` (key columns, digest) had; the version that has them."""
        return self._add(self._segment(rows, keys), "put")

    def remove(self, keys: DataFrame) -> int:
        """Removes the rows of ``keys`` (key columns)."""
        return self._add(self._segment(None, keys.withColumn("digest", F.lit(None).cast("string"))), "remove")

    def reset(self) -> int:
        """An empty version; former ones stay readable."""
        return self._commit(lambda last: {"operation": "reset", "segments": [], "retired": 0})

    def compact(self) -> int:
        """One segment of the rows that count in place of all segments; what others add meanwhile stays on top."""
        for _ in range(self.attempts):
            base = self.manifest()
            if len(base["segments"]) < 2 and not base["retired"]:
                return base["version"]
            made = self._segment(self._rows(base), self._live(base["segments"]))
            top = max(s["seq"] for s in base["segments"])
            merged = [made | {"seq": top}] if made else []
            old = {s["name"] for s in base["segments"]}
            last = self.manifest()
            while old <= {s["name"] for s in last["segments"]}:  # else another compaction or a reset came first
                rest = [s for s in last["segments"] if s["name"] not in old]
                new = {"version": last["version"] + 1, "operation": "compact", "segments": merged + rest, "retired": last["retired"] - base["retired"]}
                if self._publish(new):
                    return new["version"]
                last = self.manifest()
        raise Conflict(f"{self.attempts} attempts to compact {self.folder} failed")

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> None:
        """Forgets all but the last ``keep`` versions, and segments of none that are older than ``grace`` seconds."""
        known = self.versions()
        kept = known[-keep:]
        named = {s["name"] for v in kept for s in self.manifest(v)["segments"]}
        for v in known[:-keep]:
            storage.delete(self.spark, self._path(v))
        for kind in ("rows", "keys"):
            for folder in storage.names(self.spark, f"{self.folder}/{kind}"):
                path = f"{self.folder}/{kind}/{folder}"
                fs, target = storage.file_system(self.spark, path)
                old = fs.getFileStatus(target).getModificationTime() / 1000 <= time.time() - grace
                if folder.startswith("segment=") and folder[8:] not in named and old:
                    storage.delete(self.spark, path)
