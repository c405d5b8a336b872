"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Up to this many sources their rates are broadcast; beyond, the join shuffles and AQE splits hot sources.
BROADCAST_SOURCES = 100_000
#: What a null source is counted under.
NO_SOURCE = "∅"


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def _log_factorial(k: Column) -> Column:
    """ln k!: a sum of logarithms below 64, Stirling's series beyond, which has all digits of a double there."""
    x = k.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(k < 64, logs).otherwise(series)


def poisson_first(rate: Column) -> Column:
    """The least number with a probability that counts: below it lie under 1e-30."""
    return F.greatest(F.lit(0.0), F.floor(rate - 12 * F.sqrt(rate))).cast("int")


def poisson_weights(rate: Column) -> Column:
    """Probabilities of Poisson(rate) at poisson_first() and on, as far as a double tells their sum from 1. Their number grows
    with the root of the rate."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    at = F.transform(F.sequence(poisson_first(rate), last), lambda k: F.exp(k * F.log(rate) - rate - _log_factorial(k)))
    return F.when(rate > 0, at).otherwise(F.array(F.lit(1.0)))


def poisson_count(first: Column, weights: Column, u: Column) -> Column:
    """How many of the sums of the weights are at most u: the distribution inverted."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(s, w):
        total = s["sum"] + w
        return F.struct(total.alias("sum"), (s["n"] + (total <= u).cast("int")).alias("n"))

    return F.aggregate(weights, zero, step, lambda s: s["n"]) + F.when(u > 0, first).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: float) -> DataFrame:
    """A row per source (``name``): the mean number of copies of each of its documents (``rate``)."""
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("name")).agg(F.count("*").alias("n"))
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        raw = F.coalesce(given[F.col("name")].cast("double"), F.lit(0.0))
    else:
        raw = F.pow(F.col("n").cast("double"), F.lit(temperature))
    counts = counts.withColumn("raw", raw)
    sums = counts.agg(F.sum("raw").alias("all_raw"), F.sum("n").alias("all_n"))
    return counts.crossJoin(F.broadcast(sums)).select(  # one row: the totals
        "name",
        (F.lit(total) * F.col("all_n") * F.col("raw") / F.col("all_raw") / F.col("n")).alias("rate"),
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    total: float = 1.0,
    seed: str = "mix-1",
) -> DataFrame:
    """Replicate documents so that the sources' shares approach target weights, and shuffle them globally.

    weights: source to share (others get none); without them each source's share is its row count to the power
    ``temperature``. A document of source s gets Poisson(rate_s) copies, rate_s = total * all rows * share_s / rows_s,
    by inverting the distribution at a uniform number hashed from (seed, doc_id), so a rerun gives the same copies.
    All columns of docs come back, whatever their names, with ``copy_no`` (from 1) and ``shuffle_key`` (columns of these
    names in docs are replaced). Rows are dealt to partitions and sorted in them by the hash of (seed, doc_id, copy_no).
    Null source: a source of its own. Null doc_id: hashed as empty. Repeated rows: as many copies each. Null or empty
    text, and a text of any length, is a document like any other. An empty table gives an empty table.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    names = docs.columns
    own, first, pmf, u, n = (unused(docs, c) for c in ("mix_name", "mix_first", "mix_weights", "mix_u", "mix_n"))
    rates = source_rates(docs, weights, temperature, total)
    rates = rates.select(F.col("name").alias(own), poisson_first(F.col("rate")).alias(first), poisson_weights(F.col("rate")).alias(pmf))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = (
        docs.withColumn(own, F.coalesce(F.col("source"), F.lit(NO_SOURCE)))
        .join(rates, own)
        .withColumn(u, hash_uniform(F.lit(seed), F.col("doc_id")))
        .withColumn(n, poisson_count(F.col(first), F.col(pmf), F.col(u)))
        .where(F.col(n) > 0)
        .select(*names, F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy_no"))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy_no").cast("string"))))
    )
    return drawn.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle(table: str = "documents", temperature: float = 0.5, total: float = 1.0, seed: str = "mix-1") -> str:
    """The same rows in DuckDB SQL (default weights)."""
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, '{NO_SOURCE}') AS s FROM {table}),
c AS (SELECT s, count(*) AS n FROM d GROUP BY s),
r AS (SELECT s, {total} * (SELECT sum(n) FROM c)::DOUBLE * pow(n::DOUBLE, {temperature})
        / (SELECT sum(pow(n::DOUBLE, {temperature})) FROM c) / n AS rate FROM c),
p(s, rate, k, logp, cum) AS (
  SELECT s, rate, 0, -rate, exp(-rate) FROM r
  UNION ALL
  SELECT s, rate, k + 1, logp + ln(rate / (k + 1)), cum + exp(logp + ln(rate / (k + 1))) FROM p
  WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT *, ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM d),
m AS (SELECT doc_id, (SELECT count(*) FROM p WHERE p.s = u.s AND p.cum <= u.u) AS n FROM u)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k.copy_no::INTEGER AS copy_no,
       md5('{seed}:' || d.doc_id::VARCHAR || ':' || k.copy_no::VARCHAR) AS shuffle_key
FROM d JOIN m ON m.doc_id = d.doc_id JOIN (SELECT unnest(range(1, (SELECT coalesce(max(n), 0) + 1 FROM m))) AS copy_no) k ON k.copy_no <= m.n"""
