"""Benchmark decontamination: BM25 inverted index of test items with block-max WAND.

Items are indexed with their BM25 weights, each divided by the item's score of itself, so one
threshold in shares of that score serves all. Posting lists are divided into blocks that keep
their highest weight. Every text is cut into overlapping passages, long enough that an item
lies within one of them, and every passage is a query: a passage whose summed term bounds stay
below the threshold is passed over, the others go through block-max WAND, which retrieves all
items above the threshold. Retrieved pairs are verified by the ordered overlap of the question
and of the answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: ASCII letters in lower case, other ASCII signs as blanks; bytes above stay.
_TABLE = bytes(
    i if i >= 128 or chr(i).isdigit() or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256)
)
_ANSWER = re.compile(r"(?:\banswer|\n\s*a)\s*:\s*", re.I)
#: Items in a block, and bytes of text that are looked through at once.
BLOCK, GROUP = 4, 200_000
K1, B = 1.2, 0.75


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: at 'Answer:', else after the last '?', else the last third of the words."""
    mark = None
    for mark in _ANSWER.finditer(text):
        pass
    if mark:
        parts = text[: mark.start()], text[mark.end() :]
    elif "?" in text:
        at = text.rindex("?") + 1
        parts = text[:at], text[at:]
    else:
        words = tokens_of(text.encode())
        at = len(words) - len(words) // 3
        return words[:at], words[at:]
    return tokens_of(parts[0].encode()), tokens_of(parts[1].encode())


@dataclass
class Postings:
    items: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    highest: float = 0.0
    blocks: list[int] = field(default_factory=list)  # the blocks of BLOCK items that the list has items in
    maxima: list[float] = field(default_factory=list)  # the highest weight in each


class Index:
    """Inverted index of items [(id, text)]; ``df`` counts the items, of all ``n``, that hold a token."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean: float, least: float):
        self.least = least
        # Like items stand together, so that block maxima are near their items' weights.
        parts = [(i, *split_item(t)) for i, t in items]
        self.items = sorted(parts, key=lambda x: (sorted(set(x[1] + x[2]), key=lambda t: (-df[t], t))[:6], x[0]))
        self.longest = max([len(q) + len(a) for _, q, a in self.items], default=0)
        self.terms: dict[bytes, Postings] = {}
        for at, (_, question, answer) in enumerate(self.items):
            counts = Counter(question + answer)
            size = len(question) + len(answer)
            weights = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean))
                for t, c in counts.items()
            }
            own = sum(weights.values())
            for t, w in weights.items():
                p = self.terms.setdefault(t, Postings())
                p.items.append(at)
                p.weights.append(w / own)
        for p in self.terms.values():
            p.highest = max(p.weights)
            first = [i for i in range(len(p.items)) if i == 0 or p.items[i] // BLOCK != p.items[i - 1] // BLOCK]
            p.blocks = [p.items[i] // BLOCK for i in first]
            p.maxima = [max(p.weights[i:j]) for i, j in zip(first, [*first[1:], len(p.items)], strict=True)]
        self.number = {t: i for i, t in enumerate(self.terms)}
        lists = list(self.terms.values())
        self.bounds = np.array([p.highest for p in lists])
        self.pointer = np.cumsum([0] + [len(p.blocks) for p in lists])
        self.block_of = np.array([b for p in lists for b in p.blocks], dtype=np.int64)
        self.block_max = np.array([m for p in lists for m in p.maxima])

    def search(self, terms: list[bytes], low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All items from ``low`` to before ``high`` that score ``least`` or more: (position, score).

        Document-at-a-time WAND over the lists of the distinct ``terms``, with block maxima.
        """
        high = len(self.items) if high is None else high
        slack = self.least - 1e-9
        lists = [[p, bisect_left(p.items, low)] for p in (self.terms.get(t) for t in terms) if p]
        out = []
        while True:
            lists = [x for x in lists if x[1] < len(x[0].items) and x[0].items[x[1]] < high]
            lists.sort(key=lambda x: x[0].items[x[1]])
            total, pivot = 0.0, None
            for i, (p, _) in enumerate(lists):
                total += p.highest
                if total >= slack:
                    pivot = i
                    break
            if pivot is None:
                return out
            item = lists[pivot][0].items[lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0].items[lists[pivot + 1][1]] == item:
                pivot += 1
            block, bound = item // BLOCK, 0.0
            for p, _ in lists[: pivot + 1]:
                here = bisect_left(p.blocks, block)
                if here < len(p.blocks) and p.blocks[here] == block:
                    bound += p.maxima[here]
            if bound >= slack:
                score = 0.0
                for x in lists[: pivot + 1]:
                    x[1] = bisect_left(x[0].items, item, x[1])
                    if x[1] < len(x[0].items) and x[0].items[x[1]] == item:
                        score += x[0].weights[x[1]]
                        x[1] += 1
                if score >= slack:
                    out.append((item, score))
            else:  # nothing before the block's end or the next list can do better
                stop = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    stop = min(stop, lists[pivot + 1][0].items[lists[pivot + 1][1]])
                for x in lists[: pivot + 1]:
                    x[1] = bisect_left(x[0].items, max(stop, item + 1), x[1])

    def overlap(self, at: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of question and answer that stand in the passage in order, in runs of three words or more.

        A question or answer of fewer words is a run by itself: a marker such as 'Answer:' may stand between the two.
        """
        _, question, answer = self.items[at]
        want = question + answer
        found = np.zeros(len(want), dtype=bool)
        cut, short = len(question), min(3, len(want))
        for m in SequenceMatcher(None, want, passage, autojunk=False).get_matching_blocks():
            for low, high in ((0, cut), (cut, len(want))):
                a, b = max(m.a, low), min(m.a + m.size, high)
                if a < b and (m.size >= short or b - a >= min(3, high - low)):
                    found[a:b] = True
        return (float(found[:cut].mean()) if cut else 1.0), (float(found[cut:].mean()) if len(want) > cut else 1.0)

    def leaks(self, texts: list[bytes], overlap: float) -> list[list[tuple[int, float, float, float]]]:
        """Items in each text: (item id, best score, question overlap, answer overlap)."""
        out: list[list] = []
        some: list[bytes] = []
        for text in texts:
            some.append(text)
            if sum(map(len, some)) > GROUP:
                out += self._leaks(some, overlap)
                some = []
        return out + (self._leaks(some, overlap) if some else [])

    def _leaks(self, texts: list[bytes], overlap: float) -> list[list[tuple[int, float, float, float]]]:
        """Passage k of a text holds the words from k x step to (k + 2) x step, step being the longest item."""
        words = [tokens_of(t) for t in texts]
        if not self.items or not any(words):
            return [[] for _ in texts]
        get, size, step, slack = self.number.get, len(self.number), max(1, self.longest), self.least - 1e-9
        sizes = np.array([len(w) for w in words])
        ids = np.array([get(w, size) for ws in words for w in ws], dtype=np.int64)
        firsts = np.cumsum(np.concatenate(([0], sizes // step + 1)))  # of each text's passages
        place = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // step
        known = ids < size
        ids, place, home = ids[known], place[known], np.repeat(firsts[:-1], sizes)[known]
        code = (home + place) * size + ids
        code = np.unique(np.concatenate((code, code[place > 0] - size)))
        passage, term = code // size, code % size
        # The bounds of whole lists, then those of blocks: only blocks that can reach the threshold are searched.
        good = np.bincount(passage, self.bounds[term], firsts[-1]) >= slack
        passage, term = passage[good[passage]], term[good[passage]]
        count = self.pointer[term + 1] - self.pointer[term]
        at = np.arange(count.sum()) + np.repeat(self.pointer[term] - (np.cumsum(count) - count), count)
        blocks = -(-len(self.items) // BLOCK)
        cell, where = np.unique(np.repeat(passage, count) * blocks + self.block_of[at], return_inverse=True) if blocks > 64 else (None, np.repeat(passage, count) * blocks + self.block_of[at])
        bound = np.bincount(where, self.block_max[at])
        hits = np.flatnonzero(bound >= slack)
        hits = hits if cell is None else cell[hits]
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for p, block in zip((hits // blocks).tolist(), (hits % blocks).tolist(), strict=True):
            text = int(np.searchsorted(firsts, p, side="right")) - 1
            begin = (p - int(firsts[text])) * step
            part = words[text][begin : begin + 2 * step]
            terms = list(dict.fromkeys(w for w in part if w in self.terms))
            for item, score in self.search(terms, block * BLOCK, (block + 1) * BLOCK):
                question, answer = self.overlap(item, part)
                if question >= overlap and answer >= overlap:
                    found = (self.items[item][0], score, question, answer)
                    best[text][item] = max(best[text].get(item, found), found, key=lambda x: x[1:])
        return [[b[item] for item in sorted(b)] for b in best]


def _tokens(column: str) -> Column:
    @F.pandas_udf("array<binary>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([tokens_of(x.encode("utf-8", "replace")) for x in text], dtype=object)

    return run(column)


def shards(items: DataFrame, least: float, shard_items: int) -> list:
    """Broadcast indexes of about ``shard_items`` items each; null or wordless items are left out.

    Token statistics are those of all items, whatever the shard.
    """
    spark = items.sparkSession
    split = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("t", _tokens("text"))
    split = C.keep(split.where("size(t) > 0"), C.scratch(spark))
    whole = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean")).first()
    count = -(-whole.n // shard_items)
    counts = split.select(F.explode(F.array_distinct("t")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    out = []
    for i in range(count):
        part = split.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        rows = sorted((r.item_id, r.text) for r in part.select("item_id", "text").collect())
        words = part.select(F.explode("t").alias("w")).distinct()
        df = {bytes(r.w): r.df for r in counts.join(words, "w").collect()}
        out.append(spark.sparkContext.broadcast(Index(rows, df, whole.n, whole.mean, least)))
    return out


_LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _find(shared, overlap: float):
    def run(batches):
        index = shared.value
        for batch in C.slices(batches):
            rows: list[int] = []
            found: list[tuple] = []
            for i, hits in enumerate(index.leaks(C.texts_as_bytes(batch.column(1)), overlap)):
                rows += [i] * len(hits)
                found += hits
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, least: float = 0.6, overlap: float = 0.8, shard_items: int = 5_000
) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and the ``items`` (item_id, text) that they give away.

    Returns a row per pair: doc_id, item_id, score (BM25, in shares of the item's score of itself),
    question_overlap and answer_overlap. Pairs have a score of ``least`` and overlaps of ``overlap``
    or more in one passage. Items are indexed in shards of about ``shard_items``, each broadcast on
    its own and put to all texts. Null texts and items without id or words give nothing; repeated
    rows give repeated pairs, repeated items one pair each; further columns are ignored; an empty
    table gives no rows.
    """
    out = docs.sparkSession.createDataFrame([], _LEAK)
    for shared in shards(items, least, shard_items):
        out = out.union(docs.select(*C.id_and_text(docs)).mapInArrow(_find(shared, overlap), _LEAK))
    return out


def remove_leaks(docs: DataFrame, items: DataFrame, least: float = 0.6, overlap: float = 0.8, shard_items: int = 5_000) -> DataFrame:
    """The rows of ``docs`` that give no item away (see find_leaks), columns unchanged.

    Rows with null or empty texts stay, whatever their doc_id. Repeated rows share their fate; repeated
    items count once; without items that have an id and words all rows stay. An empty table gives no rows.
    """

    def clean_under(shared):
        @F.pandas_udf("boolean")
        def clean(text: pd.Series) -> pd.Series:
            good = []
            for at in range(0, len(text), 1000):
                raw = [(x or "").encode("utf-8", "replace") for x in text.iloc[at : at + 1000]]
                good += [not hits for hits in shared.value.leaks(raw, overlap)]
            C.give_back()
            return pd.Series(good, dtype=bool)

        return clean

    for shared in shards(items, least, shard_items):
        docs = docs.where(clean_under(shared)(F.col("text")))
    return docs
