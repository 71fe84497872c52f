"""Near-duplicate embeddings by product quantisation.

Vectors of equal bytes collapse into one class. A coarse quantiser, fitted on a bounded sample,
puts every class into one inverted list of its label and gives it the nearest lists to probe.
Within a list, residual codes of eight subspaces give asymmetric distances by table lookup. The
distance of each vector to its own code bounds their error, so a pair is only passed over if
its cosine is certainly below the threshold; the others are decided by exact cosine in double
precision. A pair is found if either vector probes the list of the other.

Lists are dealt out in blocks of bounded size, and a block pair gives one count per vector and a
spanning forest of its links, so a group of n near copies makes no n^2 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTS, CODES = 8, 64
#: Rows whose distances to all centres are held at once.
ROWS = 1024


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centres, nearest first; ties go to the lower index."""
    norms = (centres * centres).sum(axis=1)
    out = np.empty((len(x), min(k, len(centres))), dtype=np.int64)
    for at in range(0, len(x), ROWS):  # a block of the distance matrix at a time
        d = norms - 2 * x[at : at + ROWS] @ centres.T
        if k == 1:
            out[at : at + ROWS, 0] = d.argmin(axis=1)
        else:
            out[at : at + ROWS] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centres and one codebook for each part of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0] + [b.shape[1] for b in self.books])

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Index:
        """``sample``: unit vectors of one dimension, at least one."""
        centres = k_means(sample, lists)
        residual = sample - centres[_nearest(sample, centres, 1)[:, 0]]
        parts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        return cls(centres, [k_means(residual[:, p], CODES, seed=2 + i) for i, p in enumerate(parts)])

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector to what its code stands for."""
        residual = x - self.centres[lists]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        error = np.zeros(len(x))
        for i, book in enumerate(self.books):
            part = residual[:, self.cuts[i] : self.cuts[i + 1]]
            codes[:, i] = _nearest(part, book, 1)[:, 0]
            error += ((part - book[codes[:, i]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of one list, by table lookup."""
        residual = x - self.centres[at]
        total = np.zeros((len(x), len(codes)))
        for i, book in enumerate(self.books):
            part = residual[:, self.cuts[i] : self.cuts[i + 1]]
            tables = (part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)
            total += tables[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _in_range(x: np.ndarray) -> np.ndarray:
    """A finite vector other than zero, times a power of two where its squares would leave the range of doubles.

    That changes no cosine.
    """
    top = np.abs(x).max()
    return x if 1e-100 <= top <= 1e100 else np.ldexp(x, -np.frexp(top)[1])


def _prepare(batches):
    """Key, double bytes and dimension of the vectors that can link."""
    for batch in C.slices(batches):
        keys, data, dims = [], [], []
        for v, label in zip(batch.column(1).to_pylist(), batch.column(2).is_valid().to_pylist(), strict=True):
            x = None
            if label and v and None not in v:
                x = np.asarray(v, dtype=np.float64)
                x = _in_range(x) if np.isfinite(x).all() and x.any() else None
            data.append(None if x is None else x.tobytes())
            keys.append(None if x is None else xxhash.xxh3_128_digest(data[-1]))
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())],
            names=["vec_id", "cell", "key", "dim", "vector"],
        )


def _matrix(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _assign(shared, probes: int):
    def run(batches):
        indexes = shared.value
        for batch in C.slices(batches):
            dims = batch.column(3).to_numpy()
            n = batch.num_rows
            lists, probed, codes, errors = np.zeros(n, np.int32), [None] * n, [None] * n, np.zeros(n)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                index, x = indexes[int(dim)], unit_rows(_matrix(batch.column(4).take(pa.array(at))))
                near = _nearest(x, index.centres, probes)
                code, error = index.encode(x, near[:, 0])
                lists[at], errors[at] = near[:, 0], error
                for i, row in enumerate(at):
                    probed[row], codes[row] = near[i].tolist(), code[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), batch.column(5), pa.array(lists), pa.array(probed, pa.list_(pa.int32())),
                 pa.array(codes, pa.binary()), pa.array(errors)],
                names=["cell", "key", "first", "dim", "vector", "many", "list", "probes", "code", "error"],
            )

    return run


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between positions."""
    root = list(range(size))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = x, y
        while root[u] != u:
            root[u] = root[root[u]]
            u = root[u]
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _search(shared, least: float):
    """Counts (key, more) and links (key, other) of pairs of a block of queries and a block of a list."""
    radius = np.sqrt(2 - 2 * least) + 1e-6

    def run(batches):
        indexes = shared.value
        for batch in C.slices(batches, 4):
            for dim, at, queries, members in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                index = indexes[dim]
                x = np.frombuffer(b"".join(q["vector"] for q in queries), np.float64).reshape(len(queries), -1)
                y = np.frombuffer(b"".join(m["vector"] for m in members), np.float64).reshape(len(members), -1)
                codes = np.frombuffer(b"".join(m["code"] for m in members), np.uint8).reshape(len(members), -1)
                error = np.array([m["error"] for m in members])
                maybe = index.distances(unit_rows(x), at, codes) - error <= radius
                q, m = np.nonzero(maybe)
                dots = np.einsum("ij,ij->i", x[q], y[m])
                norms = np.sqrt(np.einsum("ij,ij->i", x, x))[q] * np.sqrt(np.einsum("ij,ij->i", y, y))[m]
                keys = [r["key"] for r in queries] + [r["key"] for r in members]
                names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                ids = np.array([names[k] for k in keys])
                near = (dots / norms >= least) & (ids[q] != ids[len(queries) + m])
                q, m = q[near], m[near]
                if not len(q):
                    continue
                home = np.array([r["list"] for r in queries])
                back = np.zeros((len(members), len(index.centres)), dtype=bool)
                for i, r in enumerate(members):
                    back[i, r["probes"]] = True
                more = np.zeros(len(names), dtype=np.int64)
                np.add.at(more, ids[q], np.array([r["many"] for r in members])[m])
                alone = ~back[m, home[q]]  # the member does not find the query by itself
                np.add.at(more, ids[len(queries) + m[alone]], np.array([r["many"] for r in queries])[q[alone]])
                links = _forest(ids[q], ids[len(queries) + m], len(names))
                order = list(names)
                counted = np.flatnonzero(more)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([order[i] for i in counted] + [order[a] for a, _ in links], pa.binary()),
                     pa.array([None] * len(counted) + [order[b] for _, b in links], pa.binary()),
                     pa.array(more[counted].tolist() + [0] * len(links), pa.int64())],
                    names=["key", "other", "more"],
                )

    return run


def near_embeddings(
    vectors: DataFrame, least: float = 0.93, probes: int = 24, sample: int = 20_000, per_list: int = 200, block: int = 512
) -> DataFrame:
    """Links ``vectors`` (vec_id, embedding, label) of equal labels with cosine >= ``least``.

    Returns a row per vector: vec_id, n_links, component_id, kept. Vectors that are null, empty or
    zero, hold null or non-finite components or have no label link with nothing; vectors of
    different dimension don't link; finite components of any size count. Equal vectors are links of
    each other, whatever their number, and so are repeated rows, which count as vectors of their own.
    Rows without vec_id are linked but name no component (null if all of it lacks ids). The index
    is fitted on at most ``sample`` vectors of each dimension, chosen by hash; every vector is
    indexed. There is a list for about ``per_list`` vectors, at most 4,096. Further columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = C.scratch(spark)
    folder = f"{kept}/work"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", F.xxhash64("label").alias("cell")).mapInArrow(
        _prepare, "vec_id long, cell long, key binary, dim int, vector binary"
    )
    rows = C.keep(rows, f"{kept}/rows")
    classes = rows.where("key is not null").groupBy("cell", "key").agg(
        F.min("vec_id").alias("first"),
        F.min("dim").alias("dim"),
        F.min("vector").alias("vector"),
        F.count(F.lit(1)).alias("many"),
    )
    classes = C.keep(classes.select("cell", "key", "first", "dim", "vector", "many"), f"{folder}/classes")
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    indexes = {}
    for dim, n in sorted(sizes.items()):
        some = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "cell").limit(sample)
        x = unit_rows(_matrix(some.select("vector").toArrow()["vector"]))
        indexes[dim] = Index.fit(x, max(1, min(4096, round(n / per_list))))
    shared = spark.sparkContext.broadcast(indexes)
    # The same vector under two labels is two classes.
    classes = classes.withColumn("key", F.concat("key", F.substring(F.unhex(F.md5(F.col("cell").cast("string"))), 1, 8)))
    placed = classes.mapInArrow(
        _assign(shared, probes),
        "cell long, key binary, first long, dim int, vector binary, many long, list int, probes array<int>, "
        "code binary, error double",
    )
    placed = C.keep(placed, f"{folder}/placed")
    where = ["cell", "dim", "list"]

    def blocks(df: DataFrame, name: str, *columns: str) -> DataFrame:
        """Rows of each list in blocks of about ``block`` rows, dealt by hash."""
        wanted = df.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        dealt = df.join(wanted, where).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        return dealt.groupBy(*where, "block").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("block")

    members = blocks(placed, "members", "key", "vector", "many", "probes", "code", "error")
    asking = placed.select("cell", "dim", "key", "vector", "many", F.col("list").alias("home"), F.explode("probes").alias("list"))
    queries = blocks(asking, "queries", "key", "vector", "many", F.col("home").alias("list"))
    found = queries.join(members, where).select("dim", "list", "queries", "members")
    found = C.keep(found.mapInArrow(_search(shared, least), "key binary, other binary, more long"), f"{folder}/found")
    counts = found.groupBy("key").agg(F.sum("more").alias("more"))
    groups = C.components(spark, found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), f"{folder}/g")
    known = placed.select("cell", "key", "first", "many").join(counts, "key", "left")
    known = known.join(groups.withColumnRenamed("node", "key"), "key", "left")
    known = known.select("key", "first", "many", "more", F.coalesce("component", "key").alias("component"))
    least_id = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least_id, "component").select(
        "key", (F.coalesce("more", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"
    )
    known = C.keep(known, f"{kept}/known")
    C.drop(spark, folder)
    named = F.concat(rows["key"], F.substring(F.unhex(F.md5(rows["cell"].cast("string"))), 1, 8))
    out = rows.withColumn("_key", named).drop("key").join(known, F.col("_key") == F.col("key"), "left")
    out = out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))


#: The same rows in DuckDB SQL, by brute force.
LINKS_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v)
    / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, n.component_id,
       e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON n.a = e.vec_id
"""
