"""Fill-in-the-middle transformation over an index of distinct texts.

Texts are grouped by SHA-256 and then by content, byte by byte, so a digest alone never decides.
Where code points begin is a growing list of byte offsets; it is kept in Elias-Fano form, some 2 to
4 bits a code point, and is made once for each distinct text. A document draws its two cuts from a
hash of its id, selects their offsets in its text's list and slices the bytes there: no text is cut
by counting characters again for each of its copies.

The index is a written table with the texts that occur more than once; their documents are joined
to it on digest and content, and a text with thousands of documents is dealt over salts. A text of
one document has its list made beside that document, as an entry would have this one reader only.

Rows: null texts count as empty. An empty text, and one that holds a sentinel, stays plain. A null
doc_id draws as the empty id; repeated rows give repeated rows. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Documents of one text that one task joins; texts with more are dealt over several.
COPIES = 2000
#: One count of set bits is kept for so many bytes of the upper bits.
SAMPLE = 256

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)

_LIST = "n bigint, shift int, lower binary, upper binary, counts binary"


def offsets_of(text: bytes) -> np.ndarray:
    """Byte offsets at which code points begin, and the end of the text."""
    data = np.frombuffer(text, dtype=np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def encode(offsets: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """Elias-Fano form of a growing list: (entries - 1, shift, lower bits, upper bits, set bits before each sample).

    The lower ``shift`` bits of each entry are packed; of the rest entry i sets bit (entry >> shift) + i.
    """
    m, top = len(offsets), int(offsets[-1])
    shift = max(((top + 1) // m).bit_length() - 1, 0)
    upper = np.zeros((top >> shift) + m, dtype=np.uint8)
    upper[(offsets >> shift) + np.arange(m)] = 1
    upper = np.packbits(upper, bitorder="little")
    lower = b""
    if shift:
        bits = (offsets[:, None] >> np.arange(shift)) & 1
        lower = np.packbits(bits.astype(np.uint8), axis=None, bitorder="little").tobytes()
    ones = np.add.reduceat(_ONES[upper].astype(np.int64), np.arange(0, len(upper), SAMPLE))
    counts = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<i8")
    return m - 1, shift, lower, upper.tobytes(), counts.tobytes()


def select(i: int, shift: int, lower: bytes, upper: bytes, counts: bytes) -> int:
    """Entry i of an encoded list: its upper bits from the place of the i-th set bit, found from a sample."""
    sums = np.frombuffer(counts, dtype="<i8")
    block = int(np.searchsorted(sums, i, side="right")) - 1
    part = np.frombuffer(upper, dtype=np.uint8)[block * SAMPLE : (block + 1) * SAMPLE]
    place = np.flatnonzero(np.unpackbits(part, bitorder="little"))[i - int(sums[block])]
    value = (block * SAMPLE * 8 + int(place) - i) << shift
    if shift:
        first = i * shift
        word = int.from_bytes(lower[first // 8 : (first + shift - 1) // 8 + 1], "little") >> (first % 8)
        value |= word & ((1 << shift) - 1)
    return value


def draws(seed: int) -> Column:
    """The first four numbers of eight hex digits of the SHA-256 of ``seed:doc_id``."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256)
    return F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _cut(rate: int, suffix_first: int):
    """Lists from the index, or made here, and the output of each document."""
    p, s, m = (x.encode() for x in SENTINELS)

    def run(batches):
        for batch in C.slices(batches, 500):
            texts = C.texts_as_bytes(batch.column("text"))
            numbers = batch.column("draws").to_pylist()
            entries = [batch.column(c).to_pylist() for c in ("n", "shift", "lower", "upper", "counts")]
            forms, prefixes, middles, sizes, outputs = [], [], [], [], []
            for text, (h1, h2, h3, h4), n, *rest in zip(texts, numbers, *entries, strict=True):
                if n is None:
                    n, *rest = encode(offsets_of(text))
                sizes.append(n)
                if not n or h3 % 100 >= rate or p in text or s in text or m in text:
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                first, last = select(a, *rest), select(b, *rest)
                prefix, middle, suffix = text[:first], text[first:last], text[last:]
                prefixes.append(a)
                middles.append(b - a)
                if h4 % 100 < suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, prefix, s, suffix, m, middle)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(outputs, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )
        C.give_back()

    return run


def _entries(batches):
    """Index entries: the list of each text."""
    for batch in C.slices(batches, 500):
        made = list(zip(*[encode(offsets_of(t)) for t in C.texts_as_bytes(batch.column("text"))], strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = [batch.column(c) for c in ("digest", "parts", "text")]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)],
            names=["digest", "parts", "text", "n", "shift", "lower", "upper", "counts"],
        )


def _first_seen(batches):
    """Drops rows whose text came before in the batch, so that fewer copies are shuffled."""
    for batch in C.slices(batches, 2000):
        seen: dict[bytes, bytes] = {}
        stay = []
        for i, (digest, text) in enumerate(zip(batch.column("digest").to_pylist(), C.texts_as_bytes(batch.column("text")), strict=True)):
            if seen.get(digest) != text:
                seen.setdefault(digest, text)
                stay.append(i)
        yield batch.take(pa.array(stay, pa.int32()))


def text_index(rows: DataFrame, folder: str) -> DataFrame:
    """The written index of texts of several documents: (digest, parts, text, n, shift, lower, upper, counts).

    ``rows`` has digest, parts and text. Texts that share a digest but differ have an entry each.
    """
    few = rows.select("digest", "parts", "text").mapInArrow(_first_seen, "digest binary, parts bigint, text string")
    distinct = few.dropDuplicates(["digest", "text"])
    return C.keep(distinct.mapInArrow(_entries, f"digest binary, parts bigint, text string, {_LIST}"), f"{folder}/texts")


def fill_in_middle(
    docs: DataFrame,
    rate: int = 90,
    suffix_first: int = 20,
    seed: int = 1,
    broadcast_rows: int = C.BROADCAST_ROWS,
    digest=lambda text: F.unhex(F.sha2(text, 256)),
) -> DataFrame:
    """``docs`` (doc_id, text, ...) as fill-in-the-middle examples: doc_id, n, form, prefix_chars, middle_chars, output.

    ``rate`` of 100 documents are cut, ``suffix_first`` of 100 of those put the suffix first (spm), the
    others the prefix (psm). n is the text's length and the other two its parts' in code points, null if
    plain. Digests of repeated texts are broadcast up to ``broadcast_rows`` counted rows and joined by a
    shuffle beyond. ``digest`` only proposes groups (a weak one gives the same rows).
    """
    spark = docs.sparkSession
    folder = C.scratch(spark)
    ident, text = C.id_and_text(docs)
    base = docs.select(ident, F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    counted = base.where("text <> ''").groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    parts = F.ceil(F.col("copies") / COPIES).cast("long").alias("parts")
    repeated = C.keep(counted.select("digest", parts), f"{folder}/repeated")
    known = base.join(C.small(repeated, repeated.count(), broadcast_rows), "digest", "left").withColumn("draws", draws(seed))
    copies = known.where("parts is not null")
    index = text_index(copies, folder)
    # Each document of a text meets the entry at one of its salts; content decides, not the digest alone.
    entries = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    entries = entries.select("digest", "salt", F.col("text").alias("whole"), "n", "shift", "lower", "upper", "counts")
    salted = copies.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    joined = salted.join(entries, ["digest", "salt"]).where("text = whole")
    alone = known.where("parts is null")
    for name, kind in (c.split() for c in _LIST.split(", ")):
        alone = alone.withColumn(name, F.lit(None).cast(kind))
    columns = ["doc_id", "text", "draws", "n", "shift", "lower", "upper", "counts"]
    both = alone.select(*columns).unionByName(joined.select(*columns))
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    made = both.mapInArrow(_cut(rate, suffix_first), schema)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of: no sentinel occurs in the parts, so the first of each ends a part."""
    body = F.substring(output, len(SENTINELS[0]) + 1, 2**31 - 1)
    p, s, m = SENTINELS
    psm, spm = F.split(body, f"{s}|{m}", 3), F.split(body, f"{p}|{m}", 3)
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )


#: The rows of the registered query in DuckDB SQL.
CUTS_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::bigint AS n,
    sha256('1:' || coalesce(doc_id::varchar, '')) AS x FROM documents
),
d AS (
  SELECT *, ('0x' || substr(x, 1, 8))::bigint % (n + 1) AS a, ('0x' || substr(x, 9, 8))::bigint % (n + 1) AS b,
    ('0x' || substr(x, 17, 8))::bigint % 100 AS c, ('0x' || substr(x, 25, 8))::bigint % 100 AS e FROM h
),
f AS (
  SELECT doc_id, text, n, least(a, b) AS a, greatest(a, b) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
      WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
