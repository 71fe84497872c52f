"""Exact substring dedup by bucket-pointer refinement over sampled suffixes.

Only sampled suffixes become rows. The anchor of a string is the leftmost position in its first
``short`` bytes whose q-gram identifier is least; equal strings have the same anchor, so strings
are compared only within the q-gram bucket of their anchors. Successive starts with the same
anchor are one run. Runs of equal bytes collapse into one that stands for them (all are repeated);
the others in buckets that hold several different runs are refined:

1. Suffixes are sampled every 48 bytes before and after the anchor. Their initial buckets are 96-byte
   q-grams. A bucket is named by a pointer, its least suffix; suffixes alone in theirs are done.
2. Each round groups suffixes by their pointer and the pointer of the suffix at a later offset, +96
   and then +144, both as the round before has left them: depth 96, 192, 336. New buckets get new
   pointers, which are written back and read by the next round.
3. A cell is the 48 starts before a sampled suffix. In a bucket of depth 192 (``short``) or 336
   (``length``) thirds of cells with equal bytes collapse like runs; what is left differs from its
   bucket within a few bytes on either side, and its strings are counted one by one.

Bytes are compared as 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text that are worked on at once; below 2^20, as positions take 20 bits.
PIECE = 1 << 18
CELL, PART, GRAM = 48, 16, 96
#: Later offsets whose pointers refine the buckets, and the depth reached.
LATER = ((96, 192), (144, 336))
#: Bytes of the longest strings that are told apart.
LONGEST = 8192
#: Parts of a cell.
PARTS = CELL // PART
_TABLE = np.random.default_rng(977).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)


def packing(length: int, short: int, q: int) -> tuple[int, int]:
    """Sampled suffixes and starts of a run, at most: a pointer is run x the one + index.

    An anchor is within ``short - q`` bytes of each of its run's starts, so a run has no more starts than that and one.
    """
    starts = short - q + 1
    return (starts - 1 + length - GRAM) // CELL + 1, starts


def gram_ids(raw: np.ndarray, q: int) -> np.ndarray:
    """64-bit identifiers of the q-grams at all positions, by doubling; q is a power of two."""
    ids, have = _TABLE[raw], 1
    while have < q:
        if len(ids) <= have:
            return ids[:0]
        out = ids[:-have] * _K
        out += ids[have:]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        ids, have = out, 2 * have
    return ids


def _least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` keys, by block-wise prefix and suffix minima."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs_of(raw: np.ndarray, ends: np.ndarray, short: int, q: int):
    """Runs of starts with one anchor: arrays (first, last, anchor, q-gram bucket).

    ``ends`` gives for every byte where its text ends; strings of ``short`` bytes that cross an end
    don't count.
    """
    ids = gram_ids(raw, q)
    count = len(raw) - short + 1
    if count <= 0:
        return None
    position = np.arange(len(ids), dtype=np.uint64)
    least = _least_in_windows((ids & ~_LOW) | position, short - q + 1)[:count]
    anchor = (least & _LOW).astype(np.int64)
    inside = np.arange(count) + short <= ends[:count]
    anchor[~inside] = -1
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [count])) - 1
    good = anchor[first] >= 0
    first, last = first[good], last[good]
    anchor = anchor[first]
    return first, last, anchor, ids[anchor]


def pieces_of(texts: list[bytes], short: int):
    """Texts gathered to pieces of about PIECE bytes: (bytes, [(text, offset in the text, start in the piece)]).

    Longer texts are divided with an overlap of short - 1, so that every string is in one piece.
    """
    parts, where, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) < short:
            continue
        for at in range(0, len(text) - short + 1, PIECE):
            part = text[at : at + PIECE + short - 1]
            if size and size + len(part) > PIECE + short:
                yield b"".join(parts), where
                parts, where, size = [], [], 0
            where.append((i, at, size))
            parts.append(part)
            size += len(part)
    if parts:
        yield b"".join(parts), where


def _digests(parts: list[bytes]) -> pa.Array:
    offsets = np.arange(len(parts) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(parts))])


def _find_runs(length: int, short: int, q: int):
    """Runs with the digest of all bytes of their strings of ``length`` (of ``short`` near the text's end)."""

    def run(batches):
        for batch in C.slices(batches):
            texts = C.texts_as_bytes(batch.column(1))
            for data, where in pieces_of(texts, short):
                starts = np.array([w[2] for w in where] + [len(data)])
                ends = np.repeat(starts[1:], np.diff(starts))
                found = runs_of(np.frombuffer(data, np.uint8), ends, short, q)
                if found is None:
                    continue
                first, last, anchor, bucket = found
                part = np.searchsorted(starts, first, side="right") - 1
                index = np.array([w[0] for w in where])[part]
                shift = np.array([w[1] - w[2] for w in where])[part]
                size = np.array([len(x) for x in texts])[index]
                at, more, ahead = first + shift, last - first, anchor - first
                end = np.minimum(at + more + length, size)  # up to the last whole string
                end = np.where(size - at >= length, end, at + more + short)
                keys = [
                    xxhash.xxh3_128_digest(texts[i][a:b], s)
                    for i, a, b, s in zip(index.tolist(), at.tolist(), end.tolist(), (ahead * 2**20 + more).tolist(), strict=True)
                ]
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(at.astype(np.int64)),
                     pa.array(more.astype(np.int32)), pa.array(ahead.astype(np.int32)),
                     pa.array(np.minimum(size - at, 1 << 16).astype(np.int32)), pa.array(bucket.view(np.int64)), _digests(keys)],
                    names=["doc_id", "th", "first", "more", "ahead", "rest", "bucket", "key"],
                )

    return run


def _contexts(length: int):
    """The bytes of every run that a text is asked for."""

    def run(batches):
        for batch in C.slices(batches):
            columns: list[list] = [[], [], [], [], [], []]
            index = []
            texts = C.texts_as_bytes(batch.column(2))
            for i, (text, asked) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                for r in asked:
                    index.append(i)
                    for column, name in zip(columns, ("first", "more", "ahead", "bucket", "done"), strict=False):
                        column.append(r[name])
                    columns[5].append(text[r["first"] : r["first"] + r["more"] + length])
            index = pa.array(index, pa.int32())
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index),
                 *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "th", "first", "more", "ahead", "bucket", "done", "bytes"],
            )

    return run


def _grams(points: int):
    """The initial buckets: digests of the q-grams at the sampled suffixes, by their distance to the anchor."""

    def run(batches):
        for batch in C.slices(batches):
            runs, ahead, bucket = (batch.column(n).to_pylist() for n in ("run", "ahead", "bucket"))
            places, keys = [], []
            for r, near, b, data in zip(runs, ahead, bucket, batch.column("bytes").to_pylist(), strict=True):
                for i, at in enumerate(range(near % CELL, len(data) - GRAM + 1, CELL)):
                    places.append(r * points + i)
                    keys.append(xxhash.xxh3_128_digest(data[at : at + GRAM], (b + near // CELL - i) & (2**64 - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), _digests(keys)], names=["point", "gram"])

    return run


def _cell_of(ahead: int, more: int, cell: int) -> range:
    """Starts of a part of the cell (the last is the nearest) before suffix ``cell // PARTS`` of a run."""
    at = ahead % CELL + CELL * (cell // PARTS) - PART * (PARTS - 1 - cell % PARTS)
    return range(max(0, at - PART + 1), min(at, more) + 1)


def _cells(sizes: tuple[int, int], points: int):
    """Cells of the suffixes in buckets, for strings of both sizes: first start, number of starts, digest."""

    def run(batches):
        for batch in C.slices(batches, 200):
            columns: list[list] = [[], [], [], [], [], []]
            keys = []
            rows = (batch.column(n).to_pylist() for n in ("run", "ahead", "more", "bytes", "done", "short", "long"))
            for r, ahead, more, data, done, *buckets in zip(*rows, strict=True):
                for level, (size, found) in enumerate(zip(sizes, buckets, strict=True)):
                    for x in found or ():
                        for part in range(PARTS):
                            own = _cell_of(ahead, min(more, len(data) - size), PARTS * x["i"] + part)
                            if len(own):
                                key = data[own[0] : own[-1] + size]
                                keys.append(xxhash.xxh3_128_digest(key, own[0] - ahead & 0xFFFF | len(own) << 16))
                                cell = (level, PARTS * (r * points + x["i"]) + part, PARTS * x["to"] + part, own[0], len(own), done)
                                for column, value in zip(columns, cell, strict=True):
                                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), _digests(keys)],
                names=["level", "cell", "to", "start", "starts", "done", "key"],
            )

    return run


def _strings(sizes: tuple[int, int], starts: int):
    """Digests of the single strings of the cells asked for; ``at`` is (2 run + level) x starts + start."""

    def run(batches):
        for batch in C.slices(batches, 200):
            done, ats, keys = [], [], []
            rows = (batch.column(n).to_pylist() for n in ("run", "ahead", "more", "bytes", "cells"))
            for r, ahead, more, data, asked in zip(*rows, strict=True):
                for x in asked:
                    size = sizes[x["level"]]
                    for at in _cell_of(ahead, min(more, len(data) - size), x["cell"]):
                        done.append(x["done"])
                        ats.append((2 * r + x["level"]) * starts + at)
                        # Equal strings have one bucket, so it may be part of the digest; the size is, should both be one.
                        keys.append(xxhash.xxh3_128_digest(data[at : at + size], 2 * x["to"] + x["level"] & 2**64 - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ats, pa.int64()), pa.array(done, pa.bool_()), _digests(keys)], names=["at", "done", "key"]
            )

    return run


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal spans of each row: (offsets by row, starts, ends); spans that touch are one."""
    far = int(b.max(initial=0)) + 2
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order] + row[order] * far, b[order] + row[order] * far
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))[: len(a)]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(a)]))[: len(at)] - 1
    offsets = np.searchsorted(row[at], np.arange(rows + 1))
    return offsets, a[at] - row[at] * far, reach[last] - row[at] * far


def _merge(batches):
    """Spans of a document as two lists: strings of ``length`` bytes and of ``short``."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    for batch in C.slices(batches):
        column = batch.column(2)
        flat = column.flatten()
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        a = flat.field(0).to_numpy()
        out = []
        for at in (1, 2):
            b = flat.field(at).to_numpy()
            here = b > 0
            offsets, start, end = merged(row[here], a[here], b[here], len(column))
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], fields=list(kind))
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["doc_id", "th", "spans", "shorter"])


def _apply(batches):
    for batch in C.slices(batches):
        columns: list[list] = [[], [], [], [], []]
        rows = zip(C.texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        for text, spans, shorter in rows:
            at, kept, removed = 0, hashlib.sha256(), 0
            for s in spans or ():
                kept.update(text[at : s["a"]])
                removed += s["b"] - s["a"]
                at = s["b"]
            kept.update(text[at:])
            found = (len(text), removed, len(spans or ()), sum(s["b"] - s["a"] for s in shorter or ()), kept.hexdigest())
            for column, x in zip(columns, found, strict=True):
                column.append(x)
        kinds = (*[pa.int64()] * 4, pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(2)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256", "spans"],
        )


_RUN = "doc_id long, th long, first long, more int, ahead int, rest int, bucket long, key binary"
_CONTEXT = "doc_id long, th long, first long, more int, ahead int, bucket long, done boolean, bytes binary"
_SPANS = "array<struct<a: bigint, b: bigint>>"


def _refined(points: DataFrame, by: list[str], most: int, path: str) -> DataFrame:
    """One round: rows (run, buckets) with the new pointers ``to`` of the suffixes (index i) that share
    a bucket, that is, all columns ``by``, with others. The pointer of a bucket is its least suffix."""
    least = points.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.min("point").alias("least")).where("c > 1").drop("c")
    named = points.join(least, by).select(
        F.expr(f"point div {most}").alias("run"), F.expr(f"cast(point % {most} as int)").alias("i"), F.col("least").alias("to")
    )
    # A run has at most that many suffixes.
    return C.keep(named.groupBy("run").agg(F.collect_list(F.struct("i", "to")).alias("buckets")), path)


def _later(found: DataFrame, offset: int, most: int) -> DataFrame:
    """Rows (point, to, later): suffixes with their pointer and that of the suffix ``offset`` bytes on."""
    ahead = found.withColumn("by", F.map_from_entries("buckets")).select("run", "by", F.explode("buckets").alias("x"))
    later = F.element_at("by", F.col("x.i") + offset // CELL)
    return ahead.select(
        (F.col("run") * most + F.col("x.i")).alias("point"), F.col("x.to").alias("to"), later.alias("later")
    ).where("later is not null")


def _counted(context: DataFrame, found: DataFrame, sizes: tuple[int, int], pack: tuple[int, int], folder: str) -> DataFrame:
    """Rows (run, level, start, starts): repeated strings of either size of runs that have suffixes in buckets."""
    spark = context.sparkSession
    points, starts = pack
    kinds = "level int, cell long, to long, start int, starts int, done boolean, key binary"
    cells = C.keep(context.join(found, "run").mapInArrow(_cells(sizes, points), kinds), f"{folder}/cells")
    groups = cells.groupBy("level", "to", "key").agg(
        F.count(F.lit(1)).alias("c"), F.min("cell").alias("one"), F.max("done").alias("done")
    )
    groups = C.keep(groups, f"{folder}/equal")
    C.release(spark)
    again = groups.where("c > 1").select("level", "to", "key")
    whole = cells.where("not done").join(again, ["level", "to", "key"])
    whole = whole.select(F.expr(f"cell div {PARTS * points}").alias("run"), "level", "start", "starts")
    known = F.col("done") | (F.col("c") > 1)
    open_ = groups.groupBy("level", "to").agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("all"))
    asked = groups.join(open_.where("n > 1 and not all").select("level", "to"), ["level", "to"]).select(
        F.expr(f"one div {PARTS * points}").alias("run"),
        F.struct("level", F.expr(f"cast(one % {PARTS * points} as int)").alias("cell"), "to", known.alias("done")).alias("cell"),
    )
    asked = asked.groupBy("run").agg(F.collect_list("cell").alias("cells"))
    strings = context.join(asked, "run").mapInArrow(_strings(sizes, starts), "at long, done boolean, key binary")
    strings = C.keep(strings, f"{folder}/strings")
    twice = strings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    single = strings.where("not done").join(twice, "key").select(
        F.expr(f"at div {2 * starts}").alias("run"), F.expr(f"cast(at % {2 * starts} div {starts} as int)").alias("level"),
        F.expr(f"cast(at % {starts} as int)").alias("start"), F.lit(1).alias("starts"),
    )
    spans = C.keep(whole.union(single), f"{folder}/spans")
    for x in ("cells", "equal", "strings"):
        C.drop(spark, f"{folder}/{x}")
    return spans


def repeated_spans(
    docs: DataFrame, length: int = 400, short: int = 240, q: int = 64, broadcast_rows: int = C.BROADCAST_ROWS
) -> DataFrame:
    """Rows (doc_id, th, spans, shorter): the maximal byte runs of ``docs`` covered by strings of
    ``length`` bytes, and by strings of ``short``, that start anywhere else too.

    q < short <= length, a power of two; short >= 239 and length >= 383, so that the depths of the
    refinement fit in, and length <= 8192.
    """
    if short < LATER[0][1] + CELL - 1 or length < LATER[1][1] + CELL - 1 or not q < short <= length:
        raise ValueError("strings are too short for the depths of the refinement")
    if length > LONGEST:
        raise ValueError(f"strings are longer than {LONGEST} bytes")
    pack = packing(length, short, q)
    spark = docs.sparkSession
    kept = C.scratch(spark)
    folder = f"{kept}/work"
    source = C.hashed_texts(docs)
    runs = C.keep(source.mapInArrow(_find_runs(length, short, q), _RUN), f"{folder}/runs")
    hot = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    met = C.keep(runs.join(C.keep(hot, f"{folder}/hot"), "bucket").select(*runs.columns), f"{folder}/met")
    C.drop(spark, f"{folder}/runs")
    groups = met.groupBy("bucket", "key").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "first", "more", "ahead")).alias("one")
    )
    groups = C.keep(groups, f"{folder}/groups")
    begin, more = F.col("first"), F.col("more")
    whole = met.join(groups.where("c > 1").select("bucket", "key"), ["bucket", "key"]).select(
        "doc_id", "th", begin.alias("a"),
        F.when(F.col("rest") >= length, begin + F.least(more + length, "rest")).otherwise(0).alias("b"),
        (begin + more + short).alias("s"),
    )
    open_ = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"))
    open_ = open_.where("n > 1 and low = 1").select("bucket")
    asked = groups.join(open_, "bucket").select("one.*", "bucket", (F.col("c") > 1).alias("done"))
    asked = asked.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("first", "more", "ahead", "bucket", "done")).alias("asked")
    )
    asked = C.keep(asked, f"{folder}/asked")
    whole = C.keep(whole, f"{folder}/whole")
    del hot, runs, met, groups, open_
    C.drop(spark, f"{folder}/met")
    C.release(spark)
    n = asked.agg(F.sum(F.size("asked")).alias("n")).first().n or 0
    same = F.expr("d.th = a.th and d.doc_id <=> a.doc_id")
    texts = source.alias("d").join(C.small(asked, n, broadcast_rows).alias("a"), same)
    context = texts.select("d.doc_id", "d.th", "d.text", "a.asked").mapInArrow(_contexts(length), _CONTEXT)
    # Repeated rows are asked twice; what stands for them is done, so that their strings only mark others.
    context = C.keep(context.withColumn("run", F.monotonically_increasing_id()), f"{folder}/context")
    found = [_refined(context.mapInArrow(_grams(pack[0]), "point long, gram binary"), ["gram"], pack[0], f"{folder}/round0")]
    for i, (offset, _) in enumerate(LATER):
        found.append(_refined(_later(found[-1], offset, pack[0]), ["to", "later"], pack[0], f"{folder}/round{i + 1}"))
    C.release(spark)
    both = found[1].withColumnRenamed("buckets", "short").join(found[2].withColumnRenamed("buckets", "long"), "run", "left")
    spans = _counted(context, both, (short, length), pack, folder).join(context.select("run", "doc_id", "th", "first"), "run")
    start, end = F.col("first") + F.col("start"), F.col("first") + F.col("start") + F.col("starts") - 1
    spans = whole.union(
        spans.select(
            "doc_id", "th", start.alias("a"), F.when(F.col("level") == 1, end + length).otherwise(0).alias("b"),
            F.when(F.col("level") == 0, end + short).otherwise(0).alias("s"),
        )
    )
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b", "s")).alias("spans"))
    spans = C.keep(spans.mapInArrow(_merge, f"doc_id long, th long, spans {_SPANS}, shorter {_SPANS}"), f"{kept}/all")
    C.drop(spark, folder)
    return spans


def remove_repeats(
    docs: DataFrame, length: int = 400, short: int = 240, q: int = 64, broadcast_rows: int = C.BROADCAST_ROWS
) -> DataFrame:
    """Removes from ``docs`` (doc_id, text) each byte covered by a repeated string of ``length`` bytes.

    Returns a row per document: doc_id, n_bytes, n_removed, n_spans, n_repeated (bytes covered by
    repeated strings of ``short`` bytes, about fifty short words; none is removed for it),
    kept_sha256 and spans (a, b in UTF-8 bytes). Strings never cross documents and are judged on
    the input. A null text counts as empty. Repeated rows are repeats of each other: with ``length``
    bytes or more they lose all. Rows that share an id only are different documents. Further columns
    are ignored; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length, short, q, broadcast_rows)
    n = spans.agg(F.sum(F.size("spans") + F.size("shorter")).alias("n")).first().n or 0
    source = C.hashed_texts(docs).alias("d")
    joined = source.join(
        C.small(spans, n, broadcast_rows).alias("s"), F.expr("d.th = s.th and d.doc_id <=> s.doc_id"), "left"
    )
    return joined.select("d.doc_id", "d.text", "s.spans", "s.shorter").mapInArrow(
        _apply, f"doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept_sha256 string, spans {_SPANS}"
    )
