"""Vectorized rule screens: variants cross closes, windows per variant and series."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .draws import BROADCAST_DRAWS, drawn
from .features import forward_fill, full_frame


def _by(series: str):
    return W.partitionBy("variant_id", series).orderBy("event_time_ns")


def signals(bars: DataFrame, variants: DataFrame, family: str, series: str = "instrument_id", lookbacks: list[int] | None = None) -> DataFrame:
    """(variant_id, series, event_time_ns, close, ret, signal). variants is a small table and is broadcast: every series
    is screened under each variant. Rolling frames end at the row before."""
    x = bars.select(series, "event_time_ns", "close").crossJoin(F.broadcast(variants))  # a variant is a parameter set
    w = _by(series)
    x = x.withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    if family == "buy_hold":
        return x.withColumn("signal", F.lit(1.0))
    lookbacks = lookbacks or [r[0] for r in variants.select("lookback").distinct().collect()]
    raw = F.lit(None).cast("double")
    for n in lookbacks:  # a frame's width is part of the plan, so each lookback has a branch
        frame = w.rowsBetween(-n, -1)
        mine = F.col("lookback") == n
        if family == "donchian":
            hi, lo = full_frame(F.max("close").over(frame), frame, n), full_frame(F.min("close").over(frame), frame, n)
            raw = F.when(mine, F.when(F.col("close") > hi, 1.0).when(F.col("close") < lo, -1.0)).otherwise(raw)
        elif family == "mean_reversion":
            mean, sd = full_frame(F.avg("close").over(frame), frame, n), full_frame(F.stddev_pop("close").over(frame), frame, n)
            z = (F.col("close") - mean) / F.when(sd > 1e-12 * F.abs(mean), sd)
            raw = F.when(mine, F.when(z <= -F.col("entry_z"), 1.0).when(z >= F.col("entry_z"), -1.0).otherwise(0.0)).otherwise(raw)
        else:
            raise ValueError(f"unknown family: {family}")
    x = x.withColumn("signal", raw)
    if family == "donchian":
        x = x.withColumn("signal", F.coalesce(forward_fill("signal", ["variant_id", series], ["event_time_ns"]), F.lit(0.0)))
    return x


def score(x: DataFrame, fee_bps: float = 10.0, series: str = "instrument_id") -> DataFrame:
    """Per variant and series: gross, costs, net, turnover and annualized Sharpe of holding yesterday's signal."""
    w = _by(series)
    prev = F.lag("signal").over(w)
    x = x.select("variant_id", series, (F.coalesce(prev, F.lit(0.0)) * F.col("ret")).alias("gross"), F.abs(F.col("signal") - F.coalesce(prev, F.lit(0.0))).alias("turn"))
    x = x.withColumn("net", F.col("gross") - F.col("turn") * (fee_bps / 10_000))
    out = x.groupBy("variant_id", series).agg(
        F.count("*").alias("observations"),
        F.sum("gross").alias("gross_return"),
        (F.sum("turn") * (fee_bps / 10_000)).alias("cost_return"),
        F.sum("net").alias("net_return"),
        F.sum("turn").alias("turnover"),
        F.avg("net").alias("_m"),
        F.stddev_pop("net").alias("_s"),
    )
    return out.withColumn("sharpe", F.when(F.col("_s") > 1e-15, F.col("_m") / F.nullif("_s", F.lit(0.0)) * math.sqrt(252))).drop("_m", "_s")


def random_signals(bars: DataFrame, seeds: list[int], rows: int, series: str = "instrument_id") -> DataFrame:
    """Seeded random positions: a seed's numbers are made on executors, in pieces, and joined by row number."""
    spark = bars.sparkSession

    def numbers(k: int):
        def unit(rng, first, count):
            return {"variant_id": np.full(count, k, np.int32), "idx": np.arange(first, first + count), "signal": np.array([-1.0, 0.0, 1.0])[rng.integers(0, 3, size=count)]}

        return unit

    tables = [drawn(spark, s, rows, 1, numbers(k), "variant_id int, idx long, signal double") for k, s in enumerate(seeds)]
    w = W.partitionBy(series).orderBy("event_time_ns")
    b = bars.select(series, "event_time_ns", "close", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)).alias("ret"))
    table = functools.reduce(DataFrame.unionByName, tables)
    table = F.broadcast(table) if rows * len(seeds) <= BROADCAST_DRAWS else table
    return b.join(table, "idx").select("variant_id", series, "event_time_ns", "close", "ret", "signal")


def synthetic_bars(spark, count: int = 96, profile: str = "trend", instrument: str = "SYNTH") -> DataFrame:
    """The deterministic test tape: a bar a minute from 2024-01-01, in exact decimals."""
    i = F.col("id")
    change = {
        "trend": F.when(i % 13 != 0, F.lit("0.35")).otherwise("-0.80").cast("decimal(20,8)"),
        "mean_reversion": ((i % 8 - 4) * 5).cast("decimal(20,8)") * F.lit("0.01").cast("decimal(4,2)"),
        "flat": ((i % 5 - 2) * 2).cast("decimal(20,8)") * F.lit("0.01").cast("decimal(4,2)"),
    }[profile].cast("decimal(20,8)")
    w = W.orderBy("id").rowsBetween(W.unboundedPreceding, 0)  # a generator of ``count`` rows
    close = (F.lit(100).cast("decimal(20,8)") + F.sum(change).over(w)).cast("decimal(20,8)")
    b = spark.range(count).select("id", change.alias("change"), close.alias("close"))
    opening = (F.col("close") - F.col("change")).cast("decimal(20,8)")
    tenth = F.lit("0.10").cast("decimal(20,8)")
    t = F.lit(1_704_067_200_000_000_000) + i * 60_000_000_000
    return b.select(
        F.lit(instrument).alias("instrument_id"), t.alias("event_time_ns"), (t + 1_000_000).alias("receive_time_ns"), i.alias("sequence"),
        opening.alias("open"), (F.greatest(opening, "close") + tenth).cast("decimal(20,8)").alias("high"),
        (F.least(opening, "close") - tenth).cast("decimal(20,8)").alias("low"), "close", (100 + i % 17).cast("decimal(20,8)").alias("volume"),
    )


def complement_books(spark, count: int = 48) -> DataFrame:
    """Yes and no asks of a binary market, in cents to stay exact."""
    i = F.col("id")
    return spark.range(count).select(i.alias("idx"), (48 + i % 5).alias("yes_cents"), (49 + (i + 2) % 4).alias("no_cents"))


def complement_scan(books: DataFrame) -> DataFrame:
    """Moments at which buying both outcomes costs less than their payoff of 1."""
    total = F.col("yes_cents") + F.col("no_cents")
    return books.where(total < 100).select("idx", (total / 100.0).alias("ask_sum"), ((100 - total) / 100.0).alias("gross_edge"))
