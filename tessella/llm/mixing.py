"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate, target share x rows / rows of the source. A document's
number of copies inverts the Poisson distribution with that mean at a number in [0, 1) that a
hash of its id draws, so the same seed gives the same corpus on any cluster. Copies are exploded
and dealt out by a hash of id and copy: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Digits of md5 that make a uniform number; 16^13 = 2^52 is exact in a double.
DIGITS = 13
#: Means up to which terms are added from 0 on.
SMALL_MEAN = 1000.0
#: Rate from which on the copies of a document are dealt over tasks before they are made, and copies of a lot.
HEAVY, LOT = 1_000_000.0, 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def poisson_count(mean: Column, u: Column) -> Column:
    """The Poisson distribution with this mean, inverted at u: how many of P(X <= 0), P(X <= 1), ... are at most u. A long.

    The terms go as far as a double can tell from 1. One fold, without sums of logarithms where they would drift:
    up to SMALL_MEAN from 0 on, beyond from twelve standard deviations below the mean, each term by itself. So a
    document takes some 24 sqrt(mean) steps at most, fewer than the copies that it makes.
    """
    return F.when(u <= 0, F.lit(0)).when(mean <= 0, F.lit(0)).when(mean <= SMALL_MEAN, _from_zero(mean, u)).otherwise(_from_below(mean, u)).cast("long")


def _from_zero(mean: Column, u: Column) -> Column:
    terms = F.sequence(F.lit(0), (mean + 12 * F.sqrt(mean) + 30).cast("int"))
    # What all steps share stands in the accumulator, so that it is evaluated once for a document.
    start = F.struct(
        F.lit(0.0).alias("log_p"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), u.alias("u"), F.ln(mean).alias("log_mean")
    )

    def step(acc, k):
        now = F.when(k == 0, -mean).otherwise(acc["log_p"] + acc["log_mean"] - F.ln(k.cast("double")))
        total = acc["sum"] + F.exp(now)
        n = acc["n"] + F.when(total <= acc["u"], 1).otherwise(0)
        return F.struct(now.alias("log_p"), total.alias("sum"), n.alias("n"), acc["u"].alias("u"), acc["log_mean"].alias("log_mean"))

    return F.aggregate(terms, start, step, lambda acc: acc["n"])


def _term(k: Column, mean: Column) -> Column:
    """P(X = k) for a large k near the mean, by Stirling's series and the deviance, whose leading parts cancel in no subtraction."""
    d = k - mean
    v = d / (k + mean)
    series, square = F.lit(0.0), v * v
    for j in range(12, 0, -1):
        series = square * (F.lit(1.0 / (2 * j + 1)) + series)
    deviance = d * v + 2 * k * v * series
    rest = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    return F.exp(-rest - deviance) / F.sqrt(2 * F.pi() * k)


def _from_below(mean: Column, u: Column) -> Column:
    """The terms below the first one together are less than any u above 0 that a double hash can draw."""
    reach = 12 * F.sqrt(mean) + 30
    first = F.floor(mean - reach).cast("long")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"), first.alias("n"), u.alias("u"), mean.alias("mean"))

    def step(acc, k):
        # The sum carries what its roundings lose.
        term = _term(k.cast("double"), acc["mean"]) - acc["low"]
        total = acc["sum"] + term
        n = acc["n"] + F.when(total <= acc["u"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(total.alias("sum"), ((total - acc["sum"]) - term).alias("low"), n.alias("n"), acc["u"].alias("u"), acc["mean"].alias("mean"))

    return F.aggregate(F.sequence(first, F.ceil(mean + reach).cast("long")), start, step, lambda acc: acc["n"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows (source, n, rate). Without weights every source gets the same share of the rows.

    Weights are shares up to a factor; sources not named get 0 and leave the mixture. A null
    source counts as the source ''.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    sizes = C.keep(sizes.withColumn("w", weight), C.scratch(docs.sparkSession))
    total = sizes.agg(F.sum("n").cast("double").alias("n"), F.sum("w").alias("w")).first()
    if not total.w:
        return sizes.select("source", "n", F.lit(0.0).alias("rate"))
    return sizes.select("source", "n", (F.col("w") / total.w * total.n / F.col("n")).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = 17,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Replicates ``docs`` (doc_id, source, ...) to the target weights and shuffles the copies.

    Returns the columns of docs and copy (1, 2, ..., an int, or a long if a source's rate is beyond 1e9)
    and order_key (a double in [0, 1); ascending within every partition). Copies of documents whose rate
    is beyond HEAVY are dealt over tasks in lots before they are made. Rows that share a doc_id get the same count. A null doc_id counts as
    ''. Columns of docs with the names copy and order_key are replaced. The rates are broadcast up to
    ``broadcast_rows`` sources; beyond, rates are joined over 64 salts of each source. An empty
    table gives no rows.
    """
    found = rates(docs, weights).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.coalesce("source", F.lit("")).alias("__key"),
        ident.alias("__id"),
    )
    told = found.agg(F.count(F.lit(1)).alias("n"), F.max("__rate").alias("most")).first()
    most = told.most or 0.0
    if told.n <= broadcast_rows:
        joined = marked.join(F.broadcast(found), F.expr("__key = __source"))
    else:
        marked = marked.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(64)))
        salted = found.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = marked.join(salted, F.expr("__key = __source and __salt = __part"))
    u = uniform(F.lit(str(seed)), F.col("__id"))
    kind = "int" if most < 1e9 else "long"

    def counted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__n", poisson_count(F.col("__rate"), u).cast(kind)).where("__n > 0")

    if most <= HEAVY:
        copies = counted(joined).withColumn("copy", F.explode(F.sequence(F.lit(1).cast(kind), F.col("__n"))))
    else:
        light = counted(joined.where(F.col("__rate") <= HEAVY)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast(kind), F.col("__n"))))
        lots = counted(joined.where(F.col("__rate") > HEAVY)).withColumn("__lot", F.explode(F.expr(f"sequence(0L, ({LOT} + __n - 1) div {LOT} - 1)")))
        lots = lots.repartition("__id", "__lot")
        own_lot = F.expr(f"sequence(cast(__lot * {LOT} + 1 as {kind}), cast(least(__n, (__lot + 1) * {LOT}) as {kind}))")
        copies = light.unionByName(lots.withColumn("copy", F.explode(own_lot)).drop("__lot"))
    copies = copies.withColumn("order_key", uniform(F.lit(str(seed)), F.col("__id"), F.col("copy").cast("string")))
    own = [F.col(f"__row.`{c}`") for c in docs.columns if c.lower() not in ("copy", "order_key")]
    copies = copies.select(*own, "copy", "order_key")
    return copies.repartition(F.xxhash64("order_key", F.lit(seed))).sortWithinPartitions("order_key")


#: The same rows in DuckDB SQL, for the default weights and seed.
MIX_SQL = """
WITH sizes AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
total AS (SELECT sum(n)::double AS all_n, count(*)::double AS all_w FROM sizes),
rates AS (SELECT s, 1.0::double / all_w * all_n / n AS rate FROM sizes, total),
terms AS (
  SELECT s, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, (rate + 12 * sqrt(rate) + 30)::int + 1)) AS k)
),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 AS u
  FROM documents d
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM cdf c WHERE c.s = coalesce(d.source, '') AND c.c <= d.u) AS n
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, copy::int AS copy,
       ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || copy::varchar), 1, 13))::bigint
         / 4503599627370496.0 AS order_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""
