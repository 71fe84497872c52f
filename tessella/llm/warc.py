"""WARC archives in seekable Zstandard bundles.

Pages become WARC 1.1 records. Equal payloads are stored once: the record with the largest page_id
is the response and the others are revisits that refer to it. Each task groups its records into
independent Zstandard frames and appends them to bundles (``.warc.zst``); a bundle ends with a
skippable frame that holds the seek table, so a reader finds any frame from the last nine bytes. An
index table maps each record to (bundle, frame, offset and length within the frame).

Bundles are written by tasks under names of their own attempt to the shared folder, by the file
systems that Arrow knows (mounted folders, object stores, HDFS). Spark commits the index alone: a
bundle counts if the index names it, so those that a lost or repeated task leaves are never read.

Rows: a null html is an empty payload, a null url about:blank. A null page_id is the smallest. Of rows
that share the largest page_id the greatest url is the response, and of rows equal in that too one.
Repeated rows give a record each. Empty tables give no bundle and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payloads below this many bytes are always stored.
LEAST = 1000
#: Bytes of records that close a frame, and compressed bytes that close a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Frames that one reading task takes.
FRAMES_A_TASK = 32

# Fixed values of the seekable Zstandard format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed value of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORDS = "page_id bigint, url string, record_id string, type string, refers_to string, html binary, payload_bytes bigint, sha1 string"
_INDEX = "record_id string, page_id bigint, type string, bundle string, frame int, start bigint, length bigint"
_READ = "record_id string, page_id bigint, type string, url string, payload_bytes bigint, sha1 string, refers_to string, refers_page bigint, payload binary"


def deduplicated(pages: DataFrame, least: int = LEAST, broadcast_rows: int = C.BROADCAST_ROWS) -> DataFrame:
    """The records of ``pages`` (page_id, url, html): which are responses, which revisit which.

    Payloads are equal if their lengths, SHA-1 and SHA-256 are. Digests that repeat are counted; up to
    ``broadcast_rows`` of them are broadcast, more are joined by a shuffle.
    """
    spark = pages.sparkSession
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    base = base.select(
        "*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("sha1"),
        F.concat(F.unhex(F.sha2("html", 256)), F.unhex(F.sha1(F.col("html").cast("binary")))).alias("key"),
    )
    rows = base.where(F.col("payload_bytes") >= least).groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    held = rows.groupBy("key").agg(F.max(F.struct("page_id", "url", "n")).alias("h"), F.sum("n").alias("all")).where("all > 1")
    held = C.keep(held.select("key", "h"), f"{C.scratch(spark)}/held")
    joined = base.join(C.small(held, held.count(), broadcast_rows), "key", "left")
    # What a revisit refers to: the response's name is known before anything is written.
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("h.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("sha1"))
    own = F.col("page_id").eqNullSafe(F.col("h.page_id")) & F.col("url").eqNullSafe(F.col("h.url"))
    part = F.when(F.col("h").isNull(), "single").when(~own, "revisit").when(F.col("h.n") > 1, "tied").otherwise("held")
    joined = joined.select("*", name.alias("name"), part.alias("part"))

    def records(rows: DataFrame, response) -> DataFrame:
        return rows.select(
            "page_id", "url", F.when(response & F.col("h").isNotNull(), F.col("name")).alias("record_id"),
            F.when(response, "response").otherwise("revisit").alias("type"), F.when(~response, F.col("name")).alias("refers_to"),
            F.when(response, F.col("html").cast("binary")).alias("html"), "payload_bytes", "sha1",
        )

    told = records(joined.where("part <> 'tied'"), F.col("part") != "revisit")
    # Rows that nothing tells apart: one is the response, the others are counted out as revisits.
    tied = joined.where("part = 'tied'").groupBy("key", "h", "name", "payload_bytes", "sha1").agg(F.first("html").alias("html"))
    lots = tied.withColumn("lot", F.explode(F.expr("sequence(0, (h.n - 1) div 100000)")))
    lots = lots.withColumn("i", F.explode(F.expr("sequence(lot * 100000, least(h.n, (lot + 1) * 100000) - 1)")))
    return told.unionByName(records(lots.select("*", "h.page_id", "h.url"), F.col("i") == 0))


def record_of(row: dict, name: str, date: str) -> bytes:
    """One WARC record; characters that would end a header line are escaped."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] if row["url"] is not None else "about:blank")
    lines = [
        "WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['sha1'])).decode()}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    block = b""
    if row["type"] == "response":
        payload = row["html"] or b""
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        lines.append("Content-Type: application/http;msgtype=response")
    else:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """The records of a frame: (offset, length, headers with lower-case names, block)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = end + 4 + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has another length than it states")
        yield at, stop + 4 - at, headers, data[end + 4 : stop]
        at = stop + 4


class BundleWriter:
    """Appends records to frames and frames to a file; ``close`` appends the seek table."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.file, self.frame_bytes = file, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.buffer, self.entries, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        place = len(self.entries), len(self.buffer)
        self.buffer += record
        if len(self.buffer) >= self.frame_bytes:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.buffer:
            data = bytes(self.buffer)
            frame = self.compressor.compress(data)
            self.file.write(frame)
            self.entries.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.written += len(frame)
            self.buffer = bytearray()

    def close(self) -> None:
        self.end_frame()
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file, size: int) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("not a seekable bundle")
    file.seek(size - 9 - 12 * count - 8)
    head = file.read(8 + 12 * count)
    if struct.unpack_from("<II", head) != (SKIPPABLE, 12 * count + 9):
        raise ValueError("the seek table is damaged")
    at, found = 0, []
    for compressed, plain, check in struct.iter_unpack("<III", head[8:]):
        found.append((at, compressed, plain, check))
        at += compressed
    return found


def read_frame(file, entry: tuple[int, int, int, int]) -> bytes:
    """One frame, without a look at any other; its length and checksum must be as stated."""
    at, compressed, plain, check = entry
    file.seek(at)
    data = zstandard.ZstdDecompressor().decompress(file.read(compressed), max_output_size=plain)
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame is damaged")
    return data


def _write(folder: str, date: str, frame_bytes: int, bundle_bytes: int):
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        writer = name = None
        for batch in C.slices(batches, 200):
            rows = []
            for row in batch.to_pylist():
                if writer is None:
                    name, serial = uuid.uuid4().hex, 0
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}.warc.zst", compression=None), frame_bytes)
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:bundle:{name}>\r\nWARC-Date: {date}\r\n"
                    writer.add(info.encode() + b"Content-Type: application/warc-fields\r\nContent-Length: 22\r\n\r\nformat: WARC/1.1 zstd\n\r\n\r\n")
                serial += 1
                ident = "" if row["page_id"] is None else row["page_id"]
                own = row["record_id"] or f"urn:page:{ident}:{row['sha1']}:{name}.{serial}"
                record = record_of(row, own, date)
                rows.append((own, row["page_id"], row["type"], f"{folder}/{name}.warc.zst", *writer.add(record), len(record)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                names=["record_id", "page_id", "type", "bundle", "frame", "start", "length"],
            )
        if writer is not None:
            writer.close()
        C.give_back()

    return run


def write_bundles(
    records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Writes records to bundles below ``folder`` (a URI that driver and executors share); returns their index.

    A record longer than ``frame_bytes`` has a frame to its end; a bundle is closed once it is longer than
    ``bundle_bytes``, so neither grows with the corpus.
    """
    folder = folder if re.match(r"\w+:", folder) else f"file://{folder}"
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/bundles", recursive=True)
    made = records.mapInArrow(_write(f"{folder}/bundles", date, frame_bytes, bundle_bytes), _INDEX)
    return C.keep(made, f"{folder}/index")


def _page(name: str) -> int | None:
    ident = name.split(":")[2]
    return int(ident) if ident else None


def _row(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    """What a record says; the payload of a response must have the digest and the length that it states."""
    ident = headers["warc-record-id"][1:-1]
    sha1 = base64.b32decode(headers["warc-payload-digest"].split(":")[1]).hex()
    length, refers, body = int(headers["x-payload-length"]), None, None
    if headers["warc-type"] == "response":
        body = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha1(body).hexdigest() != sha1 or len(body) != length:
            raise ValueError(f"the payload of {ident} is damaged")
    else:
        refers = headers["warc-refers-to"][1:-1]
    return ident, _page(ident), headers["warc-type"], headers["warc-target-uri"], length, sha1, refers, refers and _page(refers), body if payload else None


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    text, number = pa.string(), pa.int64()
    kinds = (text, number, text, text, number, text, text, number, pa.binary())
    names = [c.split()[0] for c in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


class _Frames:
    """Frames of bundles, the last file and frame kept open: rows come sorted by both."""

    def __init__(self):
        self.bundle = self.frame = None

    def get(self, bundle: str, frame: int) -> bytes:
        if bundle != self.bundle:
            fs, path = pyarrow.fs.FileSystem.from_uri(bundle)
            self.file = fs.open_input_file(path)
            self.table, self.bundle, self.frame = seek_table(self.file, self.file.size()), bundle, None
        if frame != self.frame:
            self.data, self.frame = read_frame(self.file, self.table[frame]), frame
        return self.data


def read_bundles(index: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the bundles that ``index`` names, read from the bundles, frame by frame in parallel."""
    frames = index.select("bundle", "frame").distinct()
    tasks = max(1, -(-frames.count() // FRAMES_A_TASK))

    def run(batches):
        frames = _Frames()
        for batch in C.slices(batches, 1):
            (row,) = batch.to_pylist()
            data = frames.get(row["bundle"], row["frame"])
            yield _batch(_row(h, block, payload) for _, _, h, block in parsed(data) if h["warc-type"] != "warcinfo")
        C.give_back()

    dealt = frames.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(run, _READ)


def fetch(index: DataFrame, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``wanted`` (record_id): only their frames are read, and in those only their bytes."""
    found = index.join(wanted.select("record_id").distinct(), "record_id").select("bundle", "frame", "start", "length")

    def run(batches):
        frames = _Frames()
        for batch in C.slices(batches, 100):
            rows = []
            for r in batch.to_pylist():
                data = frames.get(r["bundle"], r["frame"])[r["start"] : r["start"] + r["length"]]
                rows += [_row(h, block, payload) for _, _, h, block in parsed(data)]
            yield _batch(rows)

    return found.sortWithinPartitions("bundle", "frame", "start").mapInArrow(run, _READ)


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits (grouped by what they refer to) whose response is absent or has another digest or length."""
    asked = records.where("type = 'revisit'").groupBy("refers_to", "sha1", "payload_bytes").agg(F.count(F.lit(1)).alias("revisits"))
    held = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), "sha1", "payload_bytes")
    return asked.join(held, ["refers_to", "sha1", "payload_bytes"], "left_anti")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to bundles below the folder and returns the index."""
    return write_bundles(deduplicated(pages, least), folder or C.scratch(spark))


#: The rows of the registered query in DuckDB SQL.
RECORDS_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS held FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> held THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> held THEN held END AS refers_to
FROM g
"""
