"""Source divergence audit: how far the words of each source are from its language and from other sources.

Each language keeps the terms of at least ``least_docs`` of its documents. A group (lang, source) and
the language give each kept term a smoothed probability in billionths, and f(p, q) = (p - q)^2 / (p + q),
rounded down, tells how far two of them are apart. All arithmetic is on integers.

The part ``term`` is an upper-bound search. A group's terms are in buckets of like count; the largest
p and the least q of a bucket bound f for all its terms. Buckets are read best bound first, in
waves, until the bounds of the unread ones are strictly below the group's k-th value, so most of a
group's terms are never scored, and ties at the end are.

The part ``pair`` sums f over all kept terms for every two sources of a language, from postings: a sum
over terms that a group lacks depends on its size alone, so it follows from a histogram of the other
group's probabilities, and only terms that both groups have are looked at. Sources of a language are
dealt over blocks; a task adds the postings of two blocks into one small matrix, so no pairs of a
term's sources are emitted.

Rows: null text, lang and source count as ''. Repeated rows are documents of their own. Every group
that occurs has its pairs, also without terms. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Sources of a language in one block, about.
BLOCK = 128
#: Entries of a task's dictionaries, and cells of its matrices, before it passes them on.
ENTRIES, CELLS = 300_000, 4_000_000
#: Joined rows whose pairs are laid out at once.
ROWS = 2000

_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
#: A-Z in lower case, other ASCII characters than letters as blanks, the rest as it is.
TABLE = bytes(_LETTERS[c] + 32 if 65 <= c <= 90 else (c if c > 127 else _LETTERS[c]) for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters; every byte beyond ASCII is part of one."""
    return text.translate(TABLE).split()


def probability(count: str, size: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (size + 2 terms)), by long division in thousands: no product leaves the range of longs."""
    whole, rest, quotient = f"({size} + 2 * {terms})", f"({count} + 2)", "0L"
    for _ in range(3):
        quotient = f"({quotient} * 1000 + ({rest} * 1000) div {whole})"
        rest = f"(({rest} * 1000) % {whole})"
    return F.expr(f"1 + {quotient}")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _counted(batches):
    """Occurrences and documents of the terms of each (lang, source), added up in the task; '' marks the group."""
    found: dict[tuple, tuple[Counter, Counter]] = {}
    entries = 0

    def out():
        for (lang, source), (total, docs) in found.items():
            n = len(total) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([b"", *total], pa.binary()),
                 pa.array([0, *total.values()], pa.int64()), pa.array([0, *(docs[t] for t in total)], pa.int64())],
                names=["lang", "source", "term", "c", "docs"],
            )

    for batch in C.slices(batches):
        texts = C.texts_as_bytes(batch.column(2))
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            total, docs = found.setdefault((lang, source), (Counter(), Counter()))
            terms, before = terms_of(text), len(total)
            total.update(terms)
            docs.update(set(terms))
            entries += len(total) - before
        if entries > ENTRIES:
            yield from out()
            found, entries = {}, 0
    yield from out()
    C.give_back()


def term_counts(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, source, term, c, lc, first): kept terms of each group with its and its language's count.

    ``first`` marks one row of each kept term. A term '' with count 0 stands for each group that occurs.
    """
    blank = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    raw = docs.select(*blank).mapInArrow(_counted, "lang string, source string, term binary, c bigint, docs bigint")
    # One exchange serves the counts of the groups and those of the languages.
    dealt = raw.select("lang", "source", F.col("term").cast("string").alias("term"), "c", "docs").repartition("lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    counts = counts.select(
        "lang", "source", "term", "c", F.sum("c").over(term).alias("lc"), F.sum("docs").over(term).alias("docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("first"),
    )
    return counts.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs")


def groups_of(counts: DataFrame) -> DataFrame:
    """(lang, source, n, v, ln, p0, block, idx): sizes of the groups and their languages, and where their postings go."""
    sized = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = counts.groupBy("lang").agg(
        F.count_if(F.col("first") & (F.col("term") != "")).alias("v"), F.coalesce(F.sum(F.when(F.col("first"), F.col("lc"))), F.lit(0)).alias("ln"),
        F.count_if(F.col("term") == "").alias("sources"),
    )
    joined = sized.join(langs, "lang")
    block = F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / BLOCK)).cast("int")
    placed = joined.select("lang", "source", "n", "v", "ln", F.when(F.col("v") > 0, probability("0", "n", "v")).alias("p0"), block.alias("block"))
    return placed.withColumn("idx", F.row_number().over(W.partitionBy("lang", "block").orderBy("source")) - 1)


def scored_terms(counts: DataFrame, groups: DataFrame, broadcast_rows: int) -> DataFrame:
    """Postings with the group's p, the language's q and the count bucket (four to an octave)."""
    own = C.small(groups, groups.count(), broadcast_rows)
    joined = counts.where("term <> ''").select("lang", "source", "term", "c", "lc").join(own, ["lang", "source"])
    bucket = F.floor(F.log2("c") * 4).cast("int")
    return joined.select(
        "lang", "source", "term", "block", "idx", "p0", probability("c", "n", "v").alias("p"), probability("lc", "ln", "v").alias("q"), bucket.alias("b")
    )


def best_terms(terms: DataFrame, k: int, folder: str, broadcast_rows: int) -> DataFrame:
    """The ``k`` terms of each group with the greatest f among those with p > q: (lang, source, term, value, rank).

    A wave reads the buckets of the next best bounds of every group whose k-th value does not exceed them yet.
    """
    bounds = terms.groupBy("lang", "source", "b").agg(F.max("p").alias("p"), F.min("q").alias("q")).where("p > q")
    bounds = bounds.select("lang", "source", "b", distance("p", "q").alias("bound"))
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("bound"), "b"))
    bounds = C.keep(bounds.withColumn("place", order), f"{folder}/bounds")
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    top, seen, wave = None, 0, 1
    while True:
        chosen = bounds.where(f"place > {seen} and place <= {wave}")
        if top is not None:
            last = top.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("last"))
            chosen = chosen.join(last, ["lang", "source"], "left").where("last is null or bound >= last")
        chosen = C.keep(chosen.select("lang", "source", "b"), f"{folder}/wave{wave}")
        rows = chosen.count()
        if top is not None and not rows:
            return top
        read = terms.join(C.small(chosen, rows, broadcast_rows), ["lang", "source", "b"]).where("p > q")
        found = read.select("lang", "source", "term", distance("p", "q").alias("value"))
        if top is not None:
            found = found.unionByName(top.drop("rank"))
        top = C.keep(found.withColumn("rank", ranked).where(F.col("rank") <= k), f"{folder}/top{wave}")
        seen, wave = wave, wave * 4


class _Sums:
    """Sums for pairs of places of two blocks; those of few blocks are held at a time."""

    def __init__(self):
        self.cells, self.found = 0, {}

    def add(self, key: tuple, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> None:
        high, wide = int(i.max()) + 1, int(j.max()) + 1
        held = self.found.get(key)
        if held is None or held.shape[0] < high or held.shape[1] < wide:
            old = held if held is not None else np.zeros((0, 0), dtype=np.int64)
            held = np.zeros((max(high, old.shape[0]), max(wide, old.shape[1])), dtype=np.int64)
            held[: old.shape[0], : old.shape[1]] = old
            self.cells += held.size - old.size
            self.found[key] = held
        np.add.at(held, (i, j), values)

    def out(self):
        """Rows for both orders of two different groups."""
        for (lang, a, b), held in self.found.items():
            i, j = np.nonzero(held)
            if a == b:
                stay = i != j
                i, j = i[stay], j[stay]
            v, n = held[i, j], len(i)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array(np.full(n, a), pa.int32()), pa.array(i, pa.int32()),
                     pa.array(np.full(n, b), pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.int64())],
                    names=["lang", "ba", "ia", "bb", "ib", "v"],
                )
        self.cells, self.found = 0, {}


_SUMS = "lang string, ba int, ia int, bb int, ib int, v bigint"


def _groups(batch: pa.RecordBatch) -> list[tuple[tuple, np.ndarray]]:
    """Rows of the batch by (lang, ba, bb)."""
    rows: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "ba", "bb")), strict=True)):
        rows.setdefault(key, []).append(at)
    return [(key, np.array(at)) for key, at in rows.items()]


def _alone(batches):
    """For each probability of a group, f against the other group's p0, beyond f of both p0."""
    sums = _Sums()
    for batch in C.slices(batches, ROWS):
        i, p, p0, n = (batch.column(c).to_numpy() for c in ("ia", "p", "p0", "n"))
        others = batch.column("others")
        for key, at in _groups(batch):
            q = np.array(others[int(at[0])].as_py(), dtype=np.int64)[None]
            values = n[at, None] * (_far(p[at, None], q) - _far(p0[at, None], q))
            grid = np.broadcast_to(np.arange(q.shape[1]), values.shape)
            sums.add(key, np.repeat(i[at], q.shape[1]), grid.ravel(), values.ravel())
        if sums.cells > CELLS:
            yield from sums.out()
    yield from sums.out()


def _lists(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Offsets and the three fields of a column of posting lists."""
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(sizes))), *(flat.field(c).to_numpy() for c in ("idx", "p", "p0"))


def _shared(batches):
    """For each term that two groups have, f of their probabilities, less what was added for each of them alone."""
    sums = _Sums()
    for batch in C.slices(batches, ROWS):
        (a, ia, pa_, za), (b, ib, pb, zb) = _lists(batch.column("left")), _lists(batch.column("right"))
        for key, rows in _groups(batch):
            # Every entry of a left list with every entry of the right one of its row.
            na, nb = a[rows + 1] - a[rows], b[rows + 1] - b[rows]
            size = na * nb
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(nb, size)
            x, y = np.repeat(a[rows], size) + within // wide, np.repeat(b[rows], size) + within % wide
            p, q, z, w = pa_[x], pb[y], za[x], zb[y]
            sums.add(key, ia[x], ib[y], _far(p, q) - _far(p, w) - _far(z, q) + _far(z, w))
        if sums.cells > CELLS:
            yield from sums.out()
    yield from sums.out()


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways."""
    blocks = groups.where("v > 0").groupBy("lang", F.col("block").alias("bb")).agg(F.array_sort(F.collect_list(F.struct("idx", "p0"))).alias("o"))
    blocks = blocks.select("lang", "bb", F.col("o.p0").alias("others"))
    histogram = terms.groupBy("lang", F.col("block").alias("ba"), F.col("idx").alias("ia"), "p0", "p").agg(F.count(F.lit(1)).alias("n"))
    alone = histogram.join(blocks, "lang").mapInArrow(_alone, _SUMS)
    lists = terms.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("idx", "p", "p0")).alias("list"))
    left = lists.select("lang", "term", F.col("block").alias("ba"), F.col("list").alias("left"))
    right = lists.select("lang", "term", F.col("block").alias("bb"), F.col("list").alias("right"))
    both = left.join(right, ["lang", "term"]).where("ba <= bb").select("lang", "ba", "bb", "left", "right").mapInArrow(_shared, _SUMS)
    # alone has each order of two groups with its own sum; both has blocks in one order, which counts for the other too.
    turned = lambda x: x.select("lang", F.col("bb").alias("ba"), F.col("ib").alias("ia"), F.col("ba").alias("bb"), F.col("ia").alias("ib"), "v")
    sums = alone.unionByName(turned(alone)).unionByName(both).unionByName(turned(both.where("ba < bb")))
    sums = sums.groupBy("lang", "ba", "ia", "bb", "ib").agg(F.sum("v").alias("s"))
    mine = groups.select("lang", "source", "v", "p0", F.col("block").alias("ba"), F.col("idx").alias("ia"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("block").alias("bb"), F.col("idx").alias("ib"))
    pairs = mine.join(other, "lang").where("source <> item").join(sums, ["lang", "ba", "ia", "bb", "ib"], "left")
    base = F.when(F.col("v") > 0, F.col("v") * distance("p0", "q0")).otherwise(F.lit(0))
    return pairs.select("lang", "source", "item", (base + F.coalesce("s", F.lit(0))).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 10, k: int = 10, broadcast_rows: int = C.BROADCAST_ROWS) -> DataFrame:
    """The audit of ``docs`` (text, lang, source): lang, source, part, item, value, rank.

    ``pair``: every other source of the language, all ranks. ``term``: the ``k`` terms that a group uses more
    than its language by the greatest values. Ranks count from 1, by value descending, then item.
    """
    folder = C.scratch(docs.sparkSession)
    counts = C.keep(term_counts(docs, least_docs), f"{folder}/counts")
    groups = C.keep(groups_of(counts), f"{folder}/groups")
    terms = C.keep(scored_terms(counts, groups, broadcast_rows), f"{folder}/terms")
    best = best_terms(terms, k, folder, broadcast_rows)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(terms, groups).withColumn("rank", rank)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(best)


#: The rows of the registered query in DuckDB SQL, by scoring every kept term of every group.
AUDIT_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lc)::bigint AS ln FROM kept GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::bigint AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (n + 2 * v) AS p,
    1 + 1000000000 * (lc + 2) // (ln + 2 * v) AS q
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term
),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
