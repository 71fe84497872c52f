"""Substring join by the rarest gram of each search string.

A string that a text contains has all its grams in that text, so it is enough to meet the text at one
of them: the rarest. Grams are runs of 8 bytes (4, 2 or 1 for shorter strings), as numbers, so they are
exact. One pass over the texts counts in how many of them each gram of a string occurs; a string probes
by its rarest one. A second pass gives each text's probing grams, an equi-join brings strings and texts
together, and the whole string is looked for in what meets. Both passes serve any number of strings.

A worker holds no strings, only a bit set of the grams that are looked for (16 bits a gram, 16 MiB at
most): what passes it by chance meets nothing in the join. Grams that very many texts have are dealt
over salts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .. import storage

#: Texts beyond which a gram is dealt over salts, and the salts.
HOT, SALTS = 20_000, 64
#: Distinct hot grams that tasks are told of; with more of them only the hotter ones are dealt.
MOST_HOT = 1_000_000
#: Bytes of texts that are cut to grams at once, and bytes of text in a batch of candidates.
SLICE, BATCH = 1 << 17, 32 << 20
#: Rows of search strings that may be broadcast.
BROADCAST_ROWS = 200_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def width_of(size: int) -> int:
    """Bytes of the grams of a string of ``size`` bytes."""
    return next(w for w in (8, 4, 2, 1) if w <= size)


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """The run of ``width`` bytes from each position as a number, the width in its top byte unless it fills all."""
    v, w = data.astype(np.uint64), 1
    while w < width:
        v = v[: max(len(v) - w, 0)] | (v[w:] << np.uint64(8 * w))
        w *= 2
    return v if width == 8 else v | np.uint64(width << 56)


def _places(bits: int, grams: np.ndarray):
    for m in _MIX:
        h = (grams ^ (grams >> np.uint64(29))) * m
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


def has(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether each gram may be in the bit set."""
    bits = int(len(words) * 64).bit_length() - 1
    out = np.ones(len(grams), dtype=bool)
    for at in _places(bits, grams):
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return out


def _fill(words: np.ndarray, grams: np.ndarray) -> None:
    bits = int(len(words) * 64).bit_length() - 1
    for at in _places(bits, grams):
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))


def bit_set(grams: DataFrame, count: int) -> np.ndarray:
    """A bit set of ``count`` grams (gram); its size is bounded. Of many, tasks make it and it is put together by words."""
    bits = min(27, max(10, int(16 * count - 1).bit_length()))
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if count <= BROADCAST_ROWS:
        _fill(words, grams.select("gram").toArrow()["gram"].to_numpy().view(np.uint64))
        return words

    def run(batches):
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            _fill(words, batch.column(0).to_numpy().view(np.uint64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64))], names=["i", "word"])

    found = grams.select("gram").mapInArrow(run, "i long, word long").groupBy("i").agg(F.bit_or("word").alias("word")).toArrow()
    words[found["i"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return words


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, kind)
    return offsets.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)


def found_in(column: pa.Array, widths: list[int], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, grams): each text's distinct grams that may be in the bit set, for slices of bounded size."""
    offsets, data = _buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        ends = offsets[first : last + 1]
        part = data[ends[0] : ends[-1]]
        ends = ends - ends[0]
        rows, grams = [], []
        for width in widths:
            values = windows(part, width)
            at = np.flatnonzero(has(words, values))
            row = np.searchsorted(ends, at, side="right") - 1
            inside = at + width <= ends[row + 1]
            rows.append(row[inside])
            grams.append(values[at[inside]])
        row, gram = np.concatenate(rows), np.concatenate(grams)
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        yield row[new] + first, gram[new]
        first = last


def _key_grams(batches):
    """(needle, pos, gram) for each position of each search string."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            keys, index, places, grams = batch.column(0)[at : at + 1000], [], [], []
            for i, key in enumerate(keys.cast(pa.binary()).to_pylist()):
                values = windows(np.frombuffer(key, dtype=np.uint8), width_of(len(key)))
                index.append(np.full(len(values), i))
                places.append(np.arange(len(values)))
                grams.append(values)
            if index:
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(np.concatenate(index))), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(grams).view(np.int64))],
                    names=["needle", "pos", "gram"],
                )


def _frequencies(shared, widths: list[int]):
    """(gram, n): in how many texts of the task each gram occurs."""

    def run(batches):
        words = shared.value
        held, size = [], 0

        def out():
            grams, counts = np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held])
            values, back = np.unique(grams, return_inverse=True)
            total = np.zeros(len(values), dtype=np.int64)
            np.add.at(total, back, counts)
            return values, total

        def rows(values, total):
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(total)], names=["gram", "n"])

        for batch in batches:
            for _, grams in found_in(batch.column(0), widths, words):
                held.append(np.unique(grams, return_counts=True))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [out()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*out())

    return run


def _probes(shared, widths: list[int], text: str):
    """Rows of texts, once for each probing gram that they may have."""

    def run(batches: Iterable[pa.RecordBatch]):
        words, hot = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            offsets, _ = _buffers(column)
            sizes = np.diff(offsets)
            for row, gram in found_in(column, widths, words):
                grams = gram.view(np.int64)
                place = np.searchsorted(hot, grams)
                is_hot = np.zeros(len(grams), dtype=bool)
                if len(hot):
                    is_hot = hot[np.minimum(place, len(hot) - 1)] == grams
                salt = np.where(is_hot, row % SALTS, 0)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes[row]) // BATCH)) + 1
                for r, g, s in zip(np.split(row, cuts), np.split(grams, cuts), np.split(salt, cuts), strict=True):
                    take = pa.array(r, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(take) for c in batch.columns), pa.array(g), pa.array(s, pa.int32())], names=[*batch.schema.names, "_gram", "_salt"]
                    )

    return run


def _widths():
    size = F.octet_length("needle")
    return F.collect_set(F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)).alias("widths")


def rarest(wanted: DataFrame, texts: DataFrame, text: str, folder: str) -> DataFrame | None:
    """(needle, pos, gram, n) of each search string (needle): its rarest gram, in n texts; None if there are no strings.

    Strings with a gram that no text has are not among them.
    """
    keys = storage.keep(wanted.mapInArrow(_key_grams, "needle string, pos int, gram long"), f"{folder}/grams")
    told = keys.agg(F.count(F.lit(1)).alias("grams"), _widths()).first()
    if not told.grams:
        return None
    shared = texts.sparkSession.sparkContext.broadcast(bit_set(keys, told.grams))
    counted = texts.select(text).mapInArrow(_frequencies(shared, told.widths), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    known = keys.join(counted, "gram", "left").select("needle", "pos", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    best = known.groupBy("needle").agg(F.min(F.struct("n", "pos", "gram")).alias("b"))
    return storage.keep(best.select("needle", "b.pos", "b.gram", "b.n").where("n > 0"), f"{folder}/rarest")


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``texts`` with each of the distinct ``needles`` that its column ``text`` contains.

    Empty and null strings match nothing. Strings are broadcast up to BROADCAST_ROWS rows of
    ``broadcast_bytes`` together, both counted; more meet the texts by a shuffle of the candidates.
    """
    spark = texts.sparkSession
    schema = StructType([f for f in needles.schema.fields if f.name == needle] + texts.schema.fields)
    wanted = needles.where(F.length(needle) > 0).select(F.col(needle).alias("needle")).distinct()
    best = rarest(wanted, texts, text, storage.scratch(spark))
    if best is None:
        return spark.createDataFrame([], schema)
    size = F.octet_length("needle")
    told = best.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), _widths()).first()
    if not told.rows:
        return spark.createDataFrame([], schema)
    few = told.rows <= BROADCAST_ROWS and told.bytes <= broadcast_bytes
    hot, least = np.zeros(0, dtype=np.int64), HOT
    if not few:  # what is broadcast is not dealt by grams
        hottest = best.select("gram", "n").distinct()
        while (found := hottest.where(F.col("n") > least).select("gram")).count() > MOST_HOT:
            least *= 4
        hot = np.sort(found.toArrow()["gram"].to_numpy())
    shared = spark.sparkContext.broadcast((bit_set(best, told.rows), hot))
    probing = StructType([*texts.schema.fields, StructField("_gram", LongType()), StructField("_salt", IntegerType())])
    probes = texts.mapInArrow(_probes(shared, told.widths, text), probing)
    sought = best.select(F.col("needle").alias("_needle"), F.col("gram").alias("_gram"), "n")
    if few:
        met = probes.join(F.broadcast(sought), "_gram")
    else:
        salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        met = probes.join(sought.withColumn("_salt", F.explode(salts)), ["_gram", "_salt"])
    met = met.where(F.contains(F.col(text), F.col("_needle")))
    return met.select(F.col("_needle").alias(needle), *[F.col(f"`{c}`") for c in texts.columns])
