"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic unit vector: counts of lower-case words in md5 buckets."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim)
    zero = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(
        buckets, zero, lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v))
    )
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.transform(counts, lambda v: F.when(norm > 0, v / norm).otherwise(v).cast("float"))
