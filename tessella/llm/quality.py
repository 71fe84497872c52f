"""Quality classifier: Bradley-Terry ranking from preference pairs, thresholded by score quantile.

Every text becomes a short vector of style features. Preference pairs (a document labelled 1
over one labelled 0) are drawn from a bounded sample of labelled rows; logistic loss on the
feature differences gives the strengths. The threshold is a quantile of the sample's strengths,
and a document's score is the probability that it is preferred to a document at the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import starmap
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_STOP = b".,;:?'\"()-"
_MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_BLANK = b" \t\n\r\x0b\x0c"
_END = re.compile(rb"[.!?]+(?=\s|$)")

NAMES = (
    "log_bytes", "log_words", "upper", "digit", "stop", "marks", "bang", "bar", "other", "word_length",
    "distinct", "commonest", "repeated_next", "log_lines", "line_words", "distinct_lines", "sentences",
    "capital_words", "marked_words", "word_pairs",
)


def features(text: str | None) -> list[float]:
    """Style features of a whole text; an empty text gives zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [0.0] * len(NAMES)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    lower, upper, blank = share(_LOWER), share(_UPPER), share(_BLANK)
    digit, stop, marks = share(_DIGIT), share(_STOP), share(_MARKS)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, w - 1)
    return [
        np.log1p(n), np.log1p(w), upper, digit, stop, marks, raw.count(b"!") / w, raw.count(b"|") / w,
        max(0.0, 1 - lower - upper - blank - digit - stop - marks), min(n * (1 - blank) / w, 40.0) / 10,
        len(counts) / w, max(counts.values()) / w, sum(starmap(eq, zip(words, words[1:], strict=False))) / w,
        np.log1p(len(lines)), min(w / len(lines), 200.0) / 100, len(set(lines)) / len(lines),
        len(_END.findall(raw)) / w, sum(map(bytes.isupper, words)) / w,
        sum(x[-1] in _MARKS for x in words) / w, pairs if w > 1 else 1.0,
    ]


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Standardised features and steps at the sample's quantiles, for effects that aren't linear."""
    steps = (x[:, :, None] > cuts[None]).reshape(len(x), cuts.size).astype(float)
    return np.hstack([np.clip((x - mean) / scale, -5, 5), steps])


@dataclass(frozen=True)
class Ranking:
    """Bradley-Terry strengths of documents by their features."""

    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _expand(x, self.mean, self.scale, self.cuts) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being preferred to a document at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -30, 30)))


def fit_pairs(
    x: np.ndarray, labels: np.ndarray, pairs: int = 100_000, penalty: float = 2e-4, steps: int = 400, seed: int = 5
) -> Ranking:
    """Learns strengths from preference pairs. Without both labels all strengths are equal (score 0.5)."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    cuts = np.quantile(x, np.arange(0.1, 1, 0.1), axis=0).T if len(x) else np.zeros((len(NAMES), 9))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    z = _expand(x, mean, scale, cuts)
    weights = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, scale, cuts, weights, 0.0)
    rng = np.random.default_rng(seed)
    pairs = min(pairs, 20 * len(x))
    over, under = rng.choice(good, pairs), rng.choice(bad, pairs)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for i in range(1, steps + 1):  # Adam on blocks of pairs
        block = rng.integers(0, pairs, min(pairs, 4096))
        d = z[over[block]] - z[under[block]]
        slope = -(d.T @ (1 / (1 + np.exp(np.clip(d @ weights, -30, 30))))) / len(block) + penalty * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights = weights - 0.05 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    strength = z @ weights
    levels = np.quantile(strength, np.linspace(0, 1, 401))
    levels = (levels[1:] + levels[:-1]) / 2
    right = [((strength >= t) == (labels == 1)).mean() for t in levels]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return Ranking(mean, scale, cuts, weights, float(levels[best[len(best) // 2]]))


def _features(column: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in text], dtype=object)

    return run(column)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` labelled ids outside the held-out third, by a hash of the id; conflicts and nulls go."""
    marked = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(C.held_out_remainder(3) != 1)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
        .where("low = quality")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
        .limit(most)
    )
    marked = C.keep(marked, C.scratch(docs.sparkSession))
    # At most ``most`` rows of two numbers: bounded by the parameter.
    return docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 12_000) -> Ranking:
    """Fits on at most ``most_labels`` labelled documents, chosen by a hash of their ids."""
    rows = labelled_sample(docs, labels, most_labels).select("doc_id", "quality", _features("text").alias("x"))
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, list(r.x)))
    x = np.array([r.x for r in rows]).reshape(len(rows), len(NAMES))
    return fit_pairs(x, np.array([r.quality for r in rows], dtype=int))


def scorer(ranking: Ranking):
    """A function of a text column that gives scores."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text]).reshape(len(text), len(NAMES))
        C.give_back()
        return pd.Series(ranking.score(x))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, most_labels: int = 12_000) -> DataFrame:
    """Scores ``docs`` (doc_id, text), having learnt from ``labels`` (doc_id, quality).

    Returns a row per document: doc_id, held_out, score (0 to 1), predicted. A null text scores as
    an empty one. Labels that are null, neither 0 nor 1 or contradict each other are ignored; with
    only one label in the sample every score is 0.5. Rows with a null doc_id are scored and never
    learnt from. Rows are scored one by one, so ties and repeated rows get equal scores. Further
    columns are ignored; an empty table gives no rows.
    """
    score: Column = scorer(fit(docs, labels, most_labels))(F.col("text"))
    out = docs.select("doc_id", (C.held_out_remainder(3) == 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, most_labels: int = 12_000) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more (see score_quality), columns unchanged.

    A null text is judged as an empty one, and rows with a null doc_id by their texts alone. Ties and
    repeated rows share their fate. Without labels of both kinds all rows stay; an empty table gives
    no rows.
    """
    return docs.where(scorer(fit(docs, labels, most_labels))(F.col("text")) >= 0.5)
