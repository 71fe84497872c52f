"""Substring dedup by hashing normalised lines, their sentences, or paragraphs.

Units are normalised (A-Z in lower case, runs of ASCII blanks as one space, ends trimmed) and
hashed to 128 bits. Digests are counted globally; the earliest occurrence by (doc_id, text hash,
offset) stays and the others are cut, with their original offsets (code points) retained.

A line of several sentences is a unit, and so is each of its longer sentences: a passage that was
put into other lines is found by the sentences that are whole. If a line is cut, its sentences go
with it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNITS = {"line": re.compile(rb"[^\n]+"), "paragraph": re.compile(rb"(?:[^\n]|\n(?!\s*\n))+")}
#: A sentence ends with one of these, before a blank.
_SENTENCE = re.compile(rb"(?<=[.!?])(?=[\x20\x09-\x0D])")


def pieces_of(text: bytes, unit: str = "line", min_words: int = 1, sentence_words: int | None = 8):
    """(start, end, words) of the units in bytes; a line comes before its sentences.

    Lines (paragraphs) have ``min_words`` words or more, sentences of a line with several of them
    ``sentence_words`` or more; None: no sentences.
    """
    for m in UNITS[unit].finditer(text):
        start, line = m.start(), m[0]
        words = C.words_of(line)
        if len(words) >= min_words:
            yield start, m.end(), words
        if sentence_words is None or len(words) <= sentence_words:
            continue
        parts = _SENTENCE.split(line)
        if len(parts) > 1:
            for part in parts:
                words = C.words_of(part)
                if len(words) >= sentence_words:
                    yield start, start + len(part), words
                start += len(part)


def _explode(unit: str, min_words: int, sentence_words: int | None):
    def run(batches):
        for batch in C.slices(batches):
            index, starts, ends, digests = [], [], [], []
            for i, text in enumerate(C.texts_as_bytes(batch.column(1))):
                for start, end, words in pieces_of(text, unit, min_words, sentence_words):
                    index.append(i)
                    starts.append(start)
                    ends.append(end)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            index = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(2).take(index), pa.array(starts, pa.int64()),
                 pa.array(ends, pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "th", "start", "end", "digest"],
            )

    return run


def cut(text: bytes, found: dict[tuple[int, int], bool], unit: str, min_words: int, sentence_words: int | None, whole: bool = False):
    """Units, removed units, words of removed and of all repeated ones, removed spans in code points, text that is left.

    ``found`` has (start, end) of the repeated units and whether they stay; ``whole`` cuts all. The
    line end of a line goes with it.
    """
    count, removed, lost, common, spans, kept, at, chars, past = 0, 0, 0, 0, [], [], 0, 0, 0
    for start, end, words in pieces_of(text, unit, min_words, sentence_words):
        count += 1
        stays = found.get((start, end))
        if start >= past and (whole or stays is not None):
            common += len(words)
            past = end
        if start < at or not (whole or stays is False):
            continue
        before = text[at:start].decode("utf-8", "replace")
        body = text[start:end].decode("utf-8", "replace")
        kept.append(before)
        chars += len(before)
        spans.append((chars, chars + len(body)))
        chars += len(body)
        removed += 1
        lost += len(words)
        at = end
        if text[at : at + 1] == b"\n" and (start == 0 or text[start - 1 : start] == b"\n"):
            at += 1
            chars += 1
    kept.append(text[at:].decode("utf-8", "replace"))
    return count, removed, lost, common, spans, "".join(kept)


def _cut(unit: str, min_words: int, sentence_words: int | None):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in C.slices(batches):
            columns: list[list] = [[], [], [], [], [], []]
            rows = zip(C.texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for text, found, whole in rows:
                found = {(g["start"], g["end"]): g["stays"] for g in found or ()}
                *counts, spans, rest = cut(text, found, unit, min_words, sentence_words, bool(whole))
                spans = [{"start": a, "end": b} for a, b in spans]
                for column, value in zip(columns, (*counts, spans, rest), strict=True):
                    column.append(value)
            kinds = (*[pa.int64()] * 4, kind, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_units", "n_removed", "words_removed", "words_repeated", "spans", "text"],
            )

    return run


def dedup_units(
    docs: DataFrame,
    unit: str = "line",
    min_words: int = 1,
    sentence_words: int | None = 8,
) -> DataFrame:
    """Cuts every occurrence but the first of each repeated unit of ``docs`` (doc_id, text).

    Units are lines ("paragraph": up to a blank line) of ``min_words`` words or more and the
    sentences of ``sentence_words`` or more in lines that have several (None: no sentences).
    Returns a row per document: doc_id, n_units, n_removed, words_removed, words_repeated (words of
    units that occur elsewhere too, cut or not), spans (start, end of the cut units in the original
    text, code points) and text (what is left). Units inside a cut one are not counted as removed. A null text counts as empty, a null doc_id ranks first. Of repeated
    rows (equal in doc_id and text) one keeps its units, the others lose all. Further columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = C.scratch(spark)
    source = C.hashed_texts(docs)
    units = source.mapInArrow(
        _explode(unit, min_words, sentence_words), "doc_id long, th long, start long, end long, digest binary"
    )
    units = C.keep(units, f"{folder}/units")
    first = units.groupBy("digest").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "start", "end")).alias("first")
    )
    repeated = C.keep(first.where("c > 1").select("digest", "first"), f"{folder}/repeated")
    found = units.join(repeated, "digest").withColumn("stays", F.expr("struct(doc_id, th, start, end) <=> first"))
    found = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end", "stays")).alias("found"))
    same = "d.th = g.th and d.doc_id <=> g.doc_id"
    # Shuffled at every size: what is found grows with the texts.
    joined = source.alias("d").join(found.alias("g"), F.expr(same), "left")
    joined = joined.select("d.doc_id", "d.text", "g.found", F.lit(False).alias("whole"), "d.th")
    copies = source.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = C.keep(copies, f"{folder}/copies")
    if not copies.isEmpty():
        one = joined.alias("d").join(copies.alias("g"), F.expr(same)).select("d.*", "g.c").dropDuplicates(["doc_id", "th"])
        more = one.withColumn("whole", F.explode(F.array_repeat(F.lit(True), (F.col("c") - 1).cast("int"))))
        rest = joined.alias("d").join(copies.alias("g"), F.expr(same), "left_anti")
        joined = rest.union(one.drop("c")).union(more.drop("c").select(joined.columns))
    return joined.drop("th").mapInArrow(
        _cut(unit, min_words, sentence_words),
        "doc_id long, n_units long, n_removed long, words_removed long, words_repeated long, "
        "spans array<struct<start: bigint, end: bigint>>, text string",
    )
