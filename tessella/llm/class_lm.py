"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions.

Every word of the training rows is counted. The most frequent words are types of their own and
all others share types by their last two bytes; bigrams of types are counted over all training
rows, and exchange clustering moves types between classes while the likelihood of the class
bigrams grows. Then every other word of the training rows is counted by the classes before and
after it, and gets the class under which its own tokens are likeliest. A text's probability is the
product over its tokens of the smoothed transition between classes and of the word's smoothed share
in its class. Classes and counts of words outside the bounded table of frequent ones reach the
texts by a join.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Types of rare words, by their last two bytes, before they get their own classes.
GROUPS = 63
#: Words and contexts that a worker counts before it gives them out.
WINDOW_WORDS, WINDOW_CONTEXTS = 400_000, 4_000_000


def group_of(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % GROUPS


def groups_of(words: list[bytes]) -> np.ndarray:
    """``group_of`` each word, from the bytes of all of them."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    return (raw[ends - 1] * 31 + np.where(sizes > 1, raw[ends - 2], 0)) % GROUPS


def _looked_up(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    """The index of each word, -1 where it has none."""
    return np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def _count_words(batches):
    """Word counts, given out whenever the table gets large."""

    def out(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"]
        )

    counts: Counter = Counter()
    for batch in C.slices(batches):
        for text in C.texts_as_bytes(batch.column(0)):
            counts.update(C.words_of(text))
            if len(counts) > 400_000:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


@dataclass(frozen=True)
class Types:
    """The frequent words with their counts, and the type of each: one of its own for the first ``own``."""

    words: list[bytes]
    counts: np.ndarray
    own: int

    @property
    def end(self) -> int:
        return self.own + GROUPS

    @property
    def size(self) -> int:
        return self.own + GROUPS + 1

    def of_words(self) -> np.ndarray:
        return np.array([i if i < self.own else self.own + group_of(w) for i, w in enumerate(self.words)], dtype=np.int64)


def _ids(words: list[bytes], index: dict[bytes, int], types: np.ndarray, own: int):
    """Index in the table of frequent words (-1: not there), and type, of each word."""
    ids = _looked_up(words, index)
    kinds = types[ids] if len(types) else np.zeros(len(ids), np.int64)
    rare = np.flatnonzero(ids < 0)
    if len(rare):
        kinds[rare] = own + groups_of([words[i] for i in rare.tolist()])
    return ids, kinds, rare


def _count_bigrams(shared, own: int):
    def run(batches):
        words, types = shared.value
        index = {w: i for i, w in enumerate(words)}
        size, end = own + GROUPS + 1, own + GROUPS
        total = np.zeros(size * size, dtype=np.int64)
        parts, held = [], 0
        for batch in C.slices(batches):
            for text in C.texts_as_bytes(batch.column(0)):
                path = np.concatenate(([end], _ids(C.words_of(text), index, types, own)[1], [end]))
                parts.append(path[:-1] * size + path[1:])
                held += len(path)
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(parts), minlength=len(total))
                    parts, held = [], 0
        if parts:
            total += np.bincount(np.concatenate(parts), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "c"])

    return run


def _count_contexts(shared, own: int, of: np.ndarray):
    """Classes before and after each word without a type of its own: (word, contexts).

    A context is 2^32 times its code (the class before, or k and the class after) and its count, in 8 bytes.
    """

    def run(batches):
        words, types = shared.value
        index, end, k = {w: i for i, w in enumerate(words)}, own + GROUPS, int(of[-1]) + 1
        local: dict[bytes, int] = {}
        parts: list[np.ndarray] = []

        def out():
            # Frequent words go by their index, the others after them by their place in ``local``.
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            word = code // (2 * k)
            packed = (code % (2 * k) << 32) + n
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            offsets = (np.append(first, len(word)) * 8).astype(np.int32)
            contexts = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            others = list(local)
            names = [words[i] if i < len(words) else others[i - len(words)] for i in word[first].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), contexts], names=["word", "contexts"])

        held = 0
        for batch in C.slices(batches):
            for text in C.texts_as_bytes(batch.column(0)):
                tokens = C.words_of(text)
                ids, kinds, rare = _ids(tokens, index, types, own)
                at = np.flatnonzero((ids < 0) | (ids >= own))
                if not len(at):
                    continue
                ids[rare] = [len(words) + local.setdefault(tokens[i], len(local)) for i in rare.tolist()]
                path = of[np.concatenate(([end], kinds, [end]))]
                base = ids[at] * (2 * k)
                parts += [base + path[at], base + k + path[at + 2]]
                held += 2 * len(at)
                if len(local) > WINDOW_WORDS or held > WINDOW_CONTEXTS:
                    yield out()
                    local, parts, held = {}, [], 0
        if parts:
            yield out()

    return run


def _assign(likely: np.ndarray, share: np.ndarray):
    """The class under which a word's contexts are likeliest, of (word, list of contexts); ties go to the lowest."""

    def run(batches):
        size = len(likely)
        for batch in C.slices(batches, 5000):
            lists = batch.column(1)
            flat = lists.flatten()
            offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] // 8
            packed = np.frombuffer(flat.buffers()[2], np.int64, offsets[-1])[offsets[0] :]
            per_row = np.add.reduceat(np.diff(offsets), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())[:-1])))
            row = np.repeat(np.arange(len(lists)), per_row)
            found = np.bincount(row * size + (packed >> 32), packed & 0xFFFFFFFF, len(lists) * size).reshape(-1, size)
            c = found[:, size // 2 :].sum(axis=1)
            best = np.argmax(np.round(found @ likely - c[:, None] * share, 6), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(c.astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "c", "class"]
            )

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """Classes of types by exchange clustering; the last type, the end, keeps the last class for itself.

    Each type moves to the class that gives the class bigrams the highest likelihood, until a sweep
    moves none or ``sweeps`` are done. Ties go to the lowest class, so equal counts give equal classes.
    """
    size = len(bigrams)
    mass = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-mass[:-1], kind="stable")
    of = np.zeros(size, dtype=np.int64)
    of[order] = np.arange(size - 1) % classes
    of[-1] = classes
    k = classes + 1
    onehot = np.zeros((size, k))
    onehot[np.arange(size), of] = 1
    counts = bigrams.astype(float)
    out_of, into = counts @ onehot, counts.T @ onehot  # from each type to the classes; from the classes to each type
    grid = onehot.T @ out_of
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for w in order:
            if not mass[w]:
                continue
            a, right, left, own = of[w], out_of[w].copy(), into[w].copy(), counts[w, w]
            right[a] -= own
            left[a] -= own
            # without w in class a
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            rows, cols = grid.sum(axis=1) + left, grid.sum(axis=0) + right
            gain = (_xlogx(grid + right) - _xlogx(grid)).sum(axis=1) + (_xlogx(grid.T + left) - _xlogx(grid.T)).sum(axis=1)
            d = np.diag(grid)
            gain += _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            b = int(np.argmax(np.round(gain[:classes], 6)))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                out_of[:, a] -= counts[:, w]
                out_of[:, b] += counts[:, w]
                into[:, a] -= counts[w]
                into[:, b] += counts[w]
        if not moved:
            break
    return of


def smoothed(grid: np.ndarray) -> np.ndarray:
    """Transitions between classes (log10, from row to column)."""
    prior, strength = (grid.sum(axis=0) + 1) / (grid.sum() + len(grid)), 10.0
    return np.log10((grid + strength * prior) / (grid.sum(axis=1, keepdims=True) + strength))


@dataclass(frozen=True)
class Clustering:
    """Classes of types by exchange, all words of the training rows with theirs, and those that workers hold."""

    types: Types
    of: np.ndarray
    lexicon: DataFrame
    least: int | None
    held: tuple[list[bytes], np.ndarray, np.ndarray]
    train_tokens: int
    train_words: int
    train_rows: int


def cluster(docs: DataFrame, vocabulary: DataFrame, own: int, frequent: int, classes: int, folder: str) -> Clustering:
    """Counts over all rows of ``docs`` (text); ``vocabulary`` (word, c) counts its words.

    The driver gets at most ``frequent`` words and (own + 64)^2 bigram counts.
    """
    spark = docs.sparkSession
    n_rows = docs.count()
    bins = vocabulary.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")
    )
    total, tokens, least = 0, 0, None
    for r in sorted(bins.collect(), key=lambda r: -r.bin):
        total += r.n
        tokens += r.c
        if total <= frequent:
            least = r.least
    top = vocabulary.where(F.col("c") >= least).toArrow() if least is not None else None
    pairs = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0])) if top else []
    types = Types([w for w, _ in pairs], np.array([c for _, c in pairs], dtype=np.int64), min(own, len(pairs)))
    shared = spark.sparkContext.broadcast((types.words, types.of_words()))
    size = types.size
    found = docs.select("text").mapInArrow(_count_bigrams(shared, types.own), "code long, c long")
    found = found.groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    bigrams = np.zeros(size * size, dtype=np.int64)
    bigrams[found["code"].to_numpy()] = found["c"].to_numpy()
    bigrams = bigrams.reshape(size, size)
    of = exchange(bigrams, min(classes, size - 1))
    k = int(of[-1]) + 1
    onehot = np.zeros((size, k))
    onehot[np.arange(size), of] = 1
    grid = onehot.T @ bigrams @ onehot
    step = smoothed(grid)
    likely = np.vstack((step, step.T))[:, :-1]  # of a class before, of a class after; no word shares the end's class
    contexts = docs.select("text").mapInArrow(_count_contexts(shared, types.own, of), "word binary, contexts binary")
    contexts = contexts.groupBy("word").agg(F.collect_list("contexts").alias("contexts"))
    kind = "word binary, c long, class int"
    lexicon = contexts.mapInArrow(_assign(likely, np.log10(grid.sum(axis=0) + 1)[:-1]), kind)
    mine = [(w, int(types.counts[i]), int(of[i])) for i, w in enumerate(types.words[: types.own])]
    lexicon = C.keep(lexicon.union(spark.createDataFrame(mine, kind)), f"{folder}/lexicon")
    held = lexicon.where(F.col("c") >= least).toArrow() if least is not None else None
    held = (held["word"].to_pylist(), held["c"].to_numpy(), held["class"].to_numpy()) if held else ([], np.zeros(0, np.int64), np.zeros(0, np.int32))
    return Clustering(types, of, lexicon, least, held, int(tokens + n_rows), int(total + (n_rows > 0)), n_rows)


def _encode(shared, k: int, end_log: float, known_end: int):
    """Texts as classes of held words, k for others, which are listed with their order."""

    def run(batches):
        words, counts, classes = shared.value
        index, logs = {w: i for i, w in enumerate(words)}, np.log10(counts + 1.0)
        kinds = np.append(classes, k).astype(np.min_scalar_type(k))  # the last one for words not held
        for batch in C.slices(batches):
            columns: list[list] = [[], [], [], [], []]
            for text in C.texts_as_bytes(batch.column(1)):
                tokens = C.words_of(text)
                ids = _looked_up(tokens, index)
                rare = np.flatnonzero(ids < 0)
                columns[0].append(len(tokens) + 1)
                columns[1].append(len(tokens) - len(rare) + known_end)
                columns[2].append(logs[ids[ids >= 0]].sum() + end_log)
                columns[3].append(kinds[ids].tobytes())
                columns[4].append([tokens[i] for i in rare.tolist()])
            types = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))],
                names=["doc_id", "held_out", "uid", "n_tokens", "n_known", "logs", "path", "rare"],
            )

    return run


def _fill(k: int, fallback: np.ndarray):
    """Puts the classes of words not held into the texts; unseen words get their last bytes' class."""

    def run(batches):
        kind = np.min_scalar_type(k)
        for batch in C.slices(batches):
            known, logs, paths = [], [], []
            rows = (batch.column(i).to_pylist() for i in range(3, 8))
            for n, log, path, rare, found in zip(*rows, strict=True):
                if rare:
                    path = np.frombuffer(path, kind).copy()
                    mine = fallback[groups_of(rare)]
                    for x in found or ():
                        mine[x["at"]] = x["class"]
                    path[path == k] = mine
                    n, log, path = n + len(found or ()), log + sum(np.log10(x["c"] + 1.0) for x in found or ()), path.tobytes()
                known.append(n)
                logs.append(log)
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(paths, pa.binary())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "path"],
            )

    return run


def _paths(column: pa.Array, k: int):
    """Each text's classes with the end, k - 1, before and after."""
    for path in column.to_pylist():
        yield np.concatenate(([k - 1], np.frombuffer(path, np.min_scalar_type(k)).astype(np.int64), [k - 1]))


def _count_steps(k: int):
    def run(batches):
        total = np.zeros(k * k, dtype=np.int64)
        for batch in C.slices(batches):
            for path in _paths(batch.column(0), k):
                total += np.bincount(path[:-1] * k + path[1:], minlength=k * k)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "c"])

    return run


def _score(step: np.ndarray, divisor: np.ndarray):
    def run(batches):
        for batch in C.slices(batches):
            rest = [step[p[:-1], p[1:]].sum() - divisor[p[1:]].sum() for p in _paths(batch.column(5), len(step))]
            columns = [*(batch.column(i) for i in range(5)), pa.array(rest, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "rest"])

    return run


def score_texts(docs: DataFrame, own: int = 960, frequent: int = 200_000, classes: int = 64) -> DataFrame:
    """Scores ``docs`` (doc_id, text), having learnt from the rows with crc32(doc_id) mod 7 other than 2.

    Returns a row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10,
    add-one unigram) and score (log10 probability under the class model). ``own`` words get types of
    their own for the exchange, all others a class by their own contexts; at most ``frequent`` are held
    by every worker (ties in count are all in or all out), ``classes`` is the number of word classes. A null text counts as empty: only the end token. A
    null doc_id counts as ''. Repeated rows are counted and scored each; further columns are
    ignored; an empty table gives no rows. Without training rows every count is 0.
    """
    spark = docs.sparkSession
    folder = C.scratch(spark)
    train = docs.where(C.held_out_remainder(7) != 2).select("text")
    vocabulary = train.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocabulary = C.keep(vocabulary, f"{folder}/words")
    model = cluster(train, vocabulary, own, frequent, classes, folder)
    k = int(model.of[-1]) + 1
    source = docs.select(
        *C.id_and_text(docs), (C.held_out_remainder(7) == 2).alias("held_out"), F.monotonically_increasing_id().alias("uid")
    )
    encoded = source.mapInArrow(
        _encode(spark.sparkContext.broadcast(model.held), k, float(np.log10(model.train_rows + 1.0)), int(model.train_rows > 0)),
        "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, logs double, path binary, rare array<binary>",
    )
    encoded = C.keep(encoded, f"{folder}/encoded")  # from here on uid names a row
    rare = encoded.select("uid", F.posexplode("rare").alias("at", "word"))
    beyond = model.lexicon if model.least is None else model.lexicon.where(F.col("c") < model.least)
    found = rare.join(beyond, "word").groupBy("uid").agg(F.collect_list(F.struct("at", "class", "c")).alias("found"))
    filled = encoded.join(found, "uid", "left")
    filled = filled.select("doc_id", "held_out", "n_tokens", "n_known", "logs", "path", "rare", "found")
    filled = filled.mapInArrow(
        _fill(k, model.of[model.types.own : model.types.end]),
        "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, path binary",
    )
    filled = C.keep(filled, f"{folder}/filled")
    steps = filled.where("not held_out").select("path").mapInArrow(_count_steps(k), "code long, c long")
    steps = steps.groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    grid = np.zeros(k * k)
    grid[steps["code"].to_numpy()] = steps["c"].to_numpy()
    emitted = np.zeros(k)
    for r in model.lexicon.groupBy("class").agg((F.sum("c") + F.count(F.lit(1))).alias("n")).collect():
        emitted[r["class"]] = r.n
    emitted[-1] = model.train_rows + (model.train_rows > 0)
    out = filled.mapInArrow(
        _score(smoothed(grid.reshape(k, k)), np.log10(emitted + 1)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, rest double",
    )
    below = float(np.log10(model.train_tokens + model.train_words + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * below).alias("base_score"),
        (F.col("logs") + F.col("rest")).alias("score"),
    )
