"""Inversion of Poisson distributions of any mean, against high precision, and copies dealt over tasks."""

import time
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing


def exact(mean, us):
    """Counts by decimal arithmetic: terms from far below the mean on, the first one by Stirling's series with many digits."""
    getcontext().prec = 50
    m = Decimal(mean)
    k = max(0, int(m - 14 * m.sqrt() - 40))
    if k:
        x = Decimal(k)
        pi = Decimal("3.14159265358979323846264338327950288419716939937511")
        log_factorial = x * x.ln() - x + (2 * pi * x).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
        p = (x * m.ln() - m - log_factorial).exp()
    else:
        p = (-m).exp()
    total, out = Decimal(0), []
    for u in us:
        while total + p <= Decimal(u):
            total += p
            k += 1
            p *= m / k
        out.append(k)
    return out


@pytest.mark.parametrize("mean", [1e-3, 0.7, 999.9, 1000.1, 4321.5, 1e6, 1e7])
def test_counts_are_exact(spark, mean):
    us = [2.0**-52, 1e-9, 0.001, 0.25, 0.5, 0.75, 0.999, 1 - 1e-9]
    found = spark.createDataFrame([(u,) for u in us], "u double").select("u", mixing.poisson_count(F.lit(mean), F.col("u")).alias("c"))
    got = {r.u: r.c for r in found.collect()}
    assert [got[u] for u in us] == exact(mean, us)


def test_largest_means(spark):
    began = time.time()
    found = spark.range(1).select(*[mixing.poisson_count(F.lit(1e10), F.lit(u)).alias(n) for u, n in ((0.5, "half"), (0.0, "none"))]).first()
    # The median of a Poisson distribution is between mean - ln 2 and mean + 1/3.
    assert found.half == 10**10 and found.none == 0
    assert time.time() - began < 120


def test_heavy_sources_are_dealt(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("rest").alias("source"))
    plain = sorted(tuple(r) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "HEAVY", 5.0)
    monkeypatch.setattr(mixing, "LOT", 7)
    mixed = mixing.mix_sources(docs)
    assert sorted(tuple(r) for r in mixed.collect()) == plain and mixed.schema["copy"].dataType.simpleString() == "int"
