"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. One scan turns every text into its class key (128-bit hash of the word sequence), the size of
   its shingle set and 128 minima of 16 bits; four minima make one of 32 band keys. Texts with the
   same words collapse into one class, so groups of copies cost nothing afterwards.
2. Classes that share a band are candidates. A star joins each bucket to one centre per round, so
   a bucket of m classes makes m - 1 pairs; buckets whose members are already in one component
   are done. In what remains every two components are compared: small buckets as pairs, larger
   ones tile by tile in memory, which gives a forest of links and never a row for each pair.
3. A pair is compared 16 minima at a time and dropped as soon as the posterior probability of a
   similarity of at least the threshold (uniform prior) falls below ``miss``.
4. Survivors are confirmed on their full shingle sets; links are joined to components.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 5e-8.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

HASHES, ROWS, STEP = 128, 4, 16
BANDS = HASHES // ROWS

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(sh: np.ndarray) -> np.ndarray:
    """The 32 band keys of a shingle set, each holding four minima of 16 bits."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] * _A
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
    return (low & np.uint32(0xFFFF)).astype(np.uint16).view(np.int64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For 16, 32, ... compared minima: the fewest equal ones that keep a pair.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Sequential test of signature rows (pairs x 128): which pairs survive every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for i, need in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= need]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _scan(k: int):
    def run(batches):
        for batch in C.slices(batches):
            keys, sizes, bands = [], [], []
            for text in C.texts_as_bytes(batch.column(1)):
                words = C.words_of(text)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sh = C.shingles(C.word_hashes(words, len(words)), k)
                sizes.append(len(sh))
                bands.append(signature(sh) if len(sh) else None)
            full = [x for x in bands if x is not None]
            offsets = np.cumsum([0] + [0 if x is None else BANDS for x in bands])
            column = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.concatenate(full) if full else np.zeros(0, np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), column],
                names=["doc_id", "th", "key", "n_shingles", "bands"],
            )
        C.give_back()

    return run


def _sets(k: int):
    def run(batches):
        for batch in C.slices(batches):
            out = []
            for text in C.texts_as_bytes(batch.column(1)):
                words = C.words_of(text)
                out.append(C.shingles(C.word_hashes(words, len(words)), k).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "sh"])
        C.give_back()

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint16).reshape(-1, HASHES)


def _sequential(threshold: float, miss: float):
    def run(batches):
        least = least_matches(threshold, miss)
        for batch in C.slices(batches):
            good = plausible(_signatures(batch.column(2)), _signatures(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"]
            )

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in C.slices(batches, 200):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"]
            )

    return run


class _Verifier:
    """Confirms candidate pairs of classes; keeps its tables in the shared folder."""

    def __init__(self, spark, docs, rows, classes, k, percent, miss, folder, broadcast_rows):
        self.spark, self.docs, self.rows, self.classes, self.folder = spark, docs, rows, classes, folder
        self.k, self.percent, self.miss, self.bound, self.calls = k, percent, miss, broadcast_rows, 0

    def __call__(self, pairs: DataFrame) -> DataFrame:
        at, self.calls = f"{self.folder}/v{self.calls}", self.calls + 1
        sig = self.classes.select("key", "bands")
        joined = (
            pairs.join(sig.select(F.col("key").alias("a"), F.col("bands").alias("ba")), "a")
            .join(sig.select(F.col("key").alias("b"), F.col("bands").alias("bb")), "b")
            .select("a", "b", "ba", "bb")
        )
        alive = C.keep(joined.mapInArrow(_sequential(self.percent / 100, self.miss), "a binary, b binary"), at + "p")
        sets = self.sets(alive.select(F.col("a").alias("key")).union(alive.select("b")).distinct(), at)
        full = (
            alive.join(sets.select(F.col("key").alias("a"), F.col("sh").alias("sa")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("sh").alias("sb")), "b")
            .select("a", "b", "sa", "sb")
        )
        links = C.keep(full.mapInArrow(_confirm(self.percent), "a binary, b binary"), at + "l")
        for x in "pes":
            C.drop(self.spark, at + x)
        return links

    def sets(self, keys: DataFrame, at: str) -> DataFrame:
        """The shingle sets (key, sh) of classes, from the texts that stand for them."""
        ends = C.keep(keys.join(self.classes.select("key", "rep"), "key").select("key", "rep.*"), at + "e")
        need = C.small(ends, ends.count(), self.bound)
        docs = C.hashed_texts(self.docs).alias("d")
        found = docs.join(need.alias("e"), F.expr("d.th = e.th and d.doc_id <=> e.doc_id"))
        sets = found.select("e.key", "d.text").mapInArrow(_sets(self.k), "key binary, sh binary")
        return C.keep(sets.dropDuplicates(["key"]), at + "s")


def _spread(labels: DataFrame, links: DataFrame, hops: int = 3) -> DataFrame:
    """Labels (key, component) after each took the least one of its neighbours, ``hops`` times.

    A label is always a class of the same component, so equal labels prove that a pair needs no test.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    for _ in range(hops):
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        labels = labels.join(near.withColumnRenamed("a", "key"), "key", "left")
        labels = labels.select("key", F.least("component", "near").alias("component"))
    return labels


def _plausible_sizes(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of x and o in different components, by sizes similar enough."""
    return (
        pairs.where("x.component <> o.component")
        .where(f"100 * least(x.n, o.n) >= {percent} * greatest(x.n, o.n)")
        .select(F.least("x.key", "o.key").alias("a"), F.greatest("x.key", "o.key").alias("b"))
        .distinct()
    )


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others, a few million elements at a time."""
    out = np.zeros(len(others), dtype=np.int64)
    sizes = np.cumsum([0] + [len(x) for x in others])
    at = 0
    while at < len(others):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + (1 << 21), side="right")) - 1)
        flat = np.concatenate(others[at:end])
        found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        out[at:end] = np.add.reduceat(found, sizes[at:end] - sizes[at])
        at = end
    return out


def compare_tiles(rows: pa.Table, percent: int, miss: float) -> list[tuple[bytes, bytes]]:
    """Links between the members of two tiles of a bucket (of one, if both are the same).

    ``rows`` has key, component, i (the bucket's band), n, bands, sh and tile, t1, t2. Each pair of
    different components takes the sequential test; survivors that share no earlier band (there they
    are compared too) are confirmed on their sets. Linked components merge at once, so a forest of
    links comes out, whatever the number of pairs.
    """
    least = least_matches(percent / 100, miss)
    rows = rows.sort_by("key")
    keys, tiles = rows["key"].to_pylist(), rows["tile"].to_numpy()
    labels = np.unique(np.array(rows["component"].to_pylist(), dtype=object), return_inverse=True)[1]
    sizes, band = rows["n"].to_numpy(), rows["i"].to_numpy()
    bands = rows["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), BANDS)
    minima = np.ascontiguousarray(bands).view(np.uint16)
    sets = [np.frombuffer(x, np.uint64) for x in rows["sh"].to_pylist()]
    t1, t2 = rows["t1"][0].as_py(), rows["t2"][0].as_py()
    theirs = np.flatnonzero(tiles == t2)
    links = []
    for x in np.flatnonzero(tiles == t1).tolist():
        y = theirs[theirs > x] if t1 == t2 else theirs
        y = y[(labels[y] != labels[x]) & (100 * np.minimum(sizes[y], sizes[x]) >= percent * np.maximum(sizes[y], sizes[x]))]
        equal = np.zeros(len(y), dtype=np.int64)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            equal += (minima[y, part] == minima[x, part]).sum(axis=1)
            y, equal = y[equal >= need], equal[equal >= need]
        y = y[~(bands[y, : band[x]] == bands[x, : band[x]]).any(axis=1)]
        both = _shared(sets[x], [sets[j] for j in y])
        for j in y[100 * both >= percent * (sizes[x] + sizes[y] - both)].tolist():
            if labels[j] != labels[x]:
                links.append((keys[x], keys[j]))
                labels[labels == labels[j]] = labels[x]
    return links


def _tiles(percent: int, miss: float):
    def run(rows: pa.Table) -> pa.Table:
        links = compare_tiles(rows, percent, miss)
        return pa.table({name: pa.array([x[i] for x in links], pa.binary()) for i, name in enumerate("ab")})

    return run


def _across(verify: _Verifier, left: DataFrame, spread: DataFrame, step: int, pairs_upto: int, tile: int) -> list[DataFrame]:
    """Links between the components that are left in the open buckets.

    Buckets of up to ``pairs_upto`` classes give rows of pairs, fewer than that for each member.
    Larger ones are dealt to tiles of about ``tile`` classes (and 64 times as many KB of sets);
    every two tiles meet in one task, which compares their members in memory and returns a forest.
    """
    spark, folder, percent = verify.spark, verify.folder, verify.percent
    side = left.join(C.keep(spread.select("h", "c"), f"{folder}/open"), "h")
    side = C.keep(side.join(verify.classes.select("key", "bands"), "key"), f"{folder}/side")
    few = side.where(F.col("c") <= pairs_upto)
    same = "zip_with(slice(x.bands, 1, x.i), slice(o.bands, 1, x.i), (p, q) -> p = q)"
    pairs = few.alias("x").join(few.alias("o"), "h").where("x.key < o.key").where(f"not exists({same}, z -> z)")
    links = [verify(_plausible_sizes(pairs, percent))]
    many = side.where(F.col("c") > pairs_upto)
    if many.isEmpty():
        return links
    sets = verify.sets(many.select("key").distinct(), f"{folder}/many")
    sizes = many.groupBy("h").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / (tile * 8192))).cast("int").alias("tiles")
    )
    sizes = C.keep(sizes, f"{folder}/sizes")
    dealt = many.join(sizes, "h").withColumn("tile", F.pmod(F.xxhash64("key", F.lit(step)), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "h", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile",
        "key", "component", "i", "n", "bands",
    )
    met = dealt.join(sets, "key").groupBy("h", "t1", "t2").applyInArrow(_tiles(percent, verify.miss), "a binary, b binary")
    return [*links, C.keep(met.distinct(), f"{folder}/forest")]


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    miss: float = 1e-5,
    star_rounds: int = 2,
    full_below: int = 32,
    pairs_upto: int = 8,
    tile: int = 2048,
    broadcast_rows: int = C.BROADCAST_ROWS,
) -> DataFrame:
    """Groups ``docs`` (doc_id, text) by k-word shingle sets with Jaccard similarity >= percent/100.

    Returns a row per document: doc_id, th (xxhash64 of the text), n_shingles, component_id, group
    (the component's own key, null if it has none) and kept. Further columns are ignored. Null and
    blank texts and rows without doc_id link with nothing: their component_id is their doc_id.
    Repeated rows are copies of each other like any others. An empty table gives no rows.
    Star rounds go on while a bucket has ``full_below`` rows or more; ``pairs_upto`` and ``tile`` say
    how what is left is compared, never whether.
    """
    spark = docs.sparkSession
    kept = C.scratch(spark)
    folder = f"{kept}/work"
    source = C.hashed_texts(docs)
    rows = C.keep(
        source.mapInArrow(_scan(k), "doc_id long, th long, key binary, n_shingles long, bands array<long>"),
        f"{kept}/rows",
    )
    classes = (
        rows.where("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(
            F.min("n_shingles").alias("n"),
            F.min("doc_id").alias("first"),
            F.min(F.struct("doc_id", "th")).alias("rep"),
            F.min("bands").alias("bands"),
        )
    )
    classes = C.keep(classes, f"{folder}/classes")
    bands = classes.select("key", "n", F.posexplode("bands").alias("i", "h")).select(
        "key", "n", "i", F.xxhash64("i", "h").alias("h")
    )
    hot = bands.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = C.keep(bands.join(C.keep(hot, f"{folder}/hot"), "h"), f"{folder}/buckets")
    # The text that others were made from shares bands with all of them, they with each other only some.
    central = buckets.groupBy("key").agg(F.sum("c").alias("met"))
    buckets = C.keep(buckets.drop("c").join(C.keep(central, f"{folder}/central"), "key"), f"{folder}/candidates")
    verify = _Verifier(spark, docs, rows, classes, k, percent, miss, folder, broadcast_rows)
    links = []
    left = buckets.select("h", "key", "n", "i", "met", F.col("key").alias("component"))
    for step in range(star_rounds + 1):
        # The first centre is the member with the most neighbours, later ones are drawn by hash.
        order = F.struct("met", "key") if step == 0 else F.struct(F.xxhash64("key", F.lit(step)), "key")
        spread = left.groupBy("h").agg(
            F.count(F.lit(1)).alias("c"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.max_by(F.struct("key", "n", "component"), order).alias("o"),
        )
        spread = spread.where("low <> high")
        most = spread.agg(F.max("c")).first()[0]
        if most is None:
            break
        if step == star_rounds or most < full_below:
            links += _across(verify, left, spread, step, pairs_upto, tile)
            break
        pairs = left.alias("x").join(spread.select("h", "o"), "h").where("x.key <> o.key")
        links.append(verify(_plausible_sizes(pairs, percent)))
        labels = C.keep(_spread(left.select("key", "component").distinct(), links[-1]), f"{folder}/labels{step}")
        left = left.drop("component").join(labels, "key")
        left = C.keep(left.select("h", "key", "n", "i", "met", "component"), f"{folder}/left{step}")
    groups = None
    if links:
        edges = links[0]
        for more in links[1:]:
            edges = edges.union(more)
        groups = C.components(spark, edges, f"{folder}/groups")
    if groups is not None:
        classes = classes.join(groups.withColumnRenamed("node", "key"), "key", "left")
        classes = classes.select("key", "first", F.coalesce("component", "key").alias("component"))
    else:
        classes = classes.select("key", "first", F.col("key").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = C.keep(classes.join(least, "component").select("key", "component", "component_id"), f"{kept}/named")
    C.drop(spark, folder)
    out = rows.join(named, (rows.key == named.key) & rows.doc_id.isNotNull(), "left").select(
        "doc_id",
        "th",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("component").alias("group"),
    )
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, one document of each group, columns unchanged.

    Repeated rows leave one. Texts without words and rows without an id all stay.
    """
    spark = docs.sparkSession
    bound = options.get("broadcast_rows", C.BROADCAST_ROWS)
    found = C.keep(near_duplicates(docs, k, percent, **options), C.scratch(spark))
    gone = found.where(~F.col("kept")).select("doc_id", "th").distinct()
    mark = C.fresh(docs, "th")
    same = F.expr(f"d.{mark} = g.th and d.doc_id <=> g.doc_id")
    marked = docs.withColumn(mark, C.text_hash())
    rest = marked.alias("d").join(C.small(gone, gone.count(), bound).alias("g"), same, "left_anti")
    grouped = found.where("kept and group is not null")
    repeated = grouped.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("c"), F.min("th").alias("first"))
    repeated = repeated.where("c > 1")
    if not repeated.isEmpty():  # rows that share an id: the text with the least hash stays, once
        others = grouped.join(repeated, ["doc_id", "group"]).where("th <> first").select("doc_id", "th").distinct()
        rest = rest.alias("d").join(others.alias("g"), same, "left_anti")
        once = repeated.select("doc_id", F.col("first").alias("th")).alias("g")
        single = rest.alias("d").join(once, same, "left_semi").dropDuplicates(["doc_id", mark])
        rest = rest.alias("d").join(once, same, "left_anti").union(single)
    return rest.drop(mark)
