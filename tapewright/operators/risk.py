"""Stress scenarios, risk reports, divergence from expectation, locked caps, sizing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import drawn
from .features import expected_shortfall
from .scans import fold

#: Scenario, multiples of fees, slippage and funding, and of missed fills on top.
MULTIPLIERS = (
    ("fees_x1_5", 1.5, 1.0, 1.0, 0.0), ("slippage_x2", 1.0, 2.0, 1.0, 0.0), ("latency_x2", 1.0, 1.5, 1.0, 1.0),
    ("depth_x0_5", 1.0, 2.0, 1.0, 1.0), ("depth_x0_25", 1.0, 4.0, 1.0, 2.0),
    ("maker_fill_probability_x0_5", 1.0, 1.0, 1.0, 2.0), ("funding_worst_decile", 1.0, 1.0, 2.0, 0.0),
)
#: Scenario and the loss that it takes from the inputs.
LOSSES = (("exchange_outage", "outage_loss"), ("missing_interval", "outage_loss"), ("correlated_gap", "gap_loss"), ("forced_deleverage", "deleverage_loss"))
COSTS = ("fees", "spread", "slippage", "funding", "impact", "borrow", "roll", "other", "missed")


def _grown(ret: Column) -> Column:
    """One return as a stretch of wealth that begins at 1: what is left of it, its highest and lowest, its deepest fall and rise,
    and its deepest fall as a share of the height before it."""
    w = 1 + ret
    return F.struct(w.alias("w"), w.alias("high"), w.alias("low"), F.lit(0.0).alias("fall"), F.lit(0.0).alias("rise"), F.lit(0.0).alias("dd"))


def _after(a: Column, b: Column) -> Column:
    """Two neighbouring stretches as one: the later one is scaled by what the earlier one left, and turned over if that is a debt."""
    debt = a["w"] < 0
    high = a["w"] * F.when(debt, b["low"]).otherwise(b["high"])
    low = a["w"] * F.when(debt, b["high"]).otherwise(b["low"])
    share = lambda x: F.when(a["high"] > 0, (a["high"] - x) / F.nullif(a["high"], F.lit(0.0))).otherwise(0.0)
    return F.struct(
        (a["w"] * b["w"]).alias("w"),
        F.greatest(a["high"], high).alias("high"),
        F.least(a["low"], low).alias("low"),
        F.greatest(a["fall"], F.abs(a["w"]) * F.when(debt, b["rise"]).otherwise(b["fall"]), a["high"] - low).alias("fall"),
        F.greatest(a["rise"], F.abs(a["w"]) * F.when(debt, b["fall"]).otherwise(b["rise"]), high - a["low"]).alias("rise"),
        F.greatest(a["dd"], b["dd"], share(low)).alias("dd"),
    )


def _wealth(returns: DataFrame, keys: list[str], place: str, count: int) -> DataFrame:
    """(keys, state): each series as one stretch, merged block by block."""
    return fold(returns, keys, place, count, lambda _: _grown(F.col("ret").cast("double")), _after)


def compounded(returns: DataFrame, keys: list[str]) -> DataFrame:
    """prod(1 + r) - 1 in the order of obs (from 0), the least return, and the deepest absolute fall of the compounded wealth.

    Blocks are merged, so that no series is an array."""
    last = returns.agg(F.max("obs")).first()[0]
    a = _wealth(returns, keys, "obs", (last or 0) + 1)
    worst = returns.groupBy(*keys).agg(F.min("ret").alias("worst"))
    z = a.join(worst, keys) if keys else a.crossJoin(worst)  # without keys one row each
    return z.select(*keys, (F.col("state.w") - 1).alias("total"), "worst", F.greatest(F.lit(0.0), "state.fall", 1 - F.col("state.low")).alias("fall"))


def stress_inputs(returns: DataFrame, costs: DataFrame, keys: list[str]) -> DataFrame:
    """Money inputs of the scenarios: losses of the returns scaled to the gross result. costs: keys, gross_pnl, COSTS."""
    c = compounded(returns, keys).join(costs, keys)
    scale = F.when(F.col("total") != 0, F.abs(F.col("gross_pnl") / F.nullif("total", F.lit(0.0)))).otherwise(F.greatest(F.abs("gross_pnl"), F.lit(1.0)))
    c = c.withColumn("scale", scale).withColumn("outage_loss", F.greatest(F.lit(0.0), -F.col("worst")) * F.col("scale"))
    return c.select(*keys, "gross_pnl", *COSTS, "outage_loss", (F.col("outage_loss") * 2).alias("gap_loss"), (F.col("fall") * F.col("scale")).alias("deleverage_loss"))


def stress_suite(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Eleven scenarios per row of inputs: net result and whether it stays positive."""
    fixed = F.col("spread") + F.col("impact") + F.col("borrow") + F.col("roll") + F.col("other")
    nets = [
        F.struct(F.lit(name).alias("scenario"), (F.col("gross_pnl") - F.col("fees") * fee - fixed - F.col("slippage") * slip - F.col("funding") * fund - F.col("missed") * (1 + extra)).alias("net_pnl"))
        for name, fee, slip, fund, extra in MULTIPLIERS
    ]
    base = F.col("gross_pnl") - F.col("fees") - fixed - F.col("slippage") - F.col("funding") - F.col("missed")
    nets += [F.struct(F.lit(name).alias("scenario"), (base - F.col(loss)).alias("net_pnl")) for name, loss in LOSSES]
    out = inputs.select(*keys, F.explode(F.array(*nets)).alias("x")).select(*keys, "x.scenario", "x.net_pnl")
    return out.withColumn("status", F.when(F.col("net_pnl") > 0, "pass").otherwise("blocked"))


def risk_report(returns: DataFrame, n: int, paths: int = 500, seed: int = 7, keys: list[str] = ()) -> DataFrame:
    """Observed and resampled drawdowns, ruin share and expected shortfall of each series (keys, obs, ret). Returns are -1 at least.

    The resampled index is paths * n numbers of a seeded generator, the same for all series, made on executors; blocks of a path
    are walked apart and merged, so that neither a path nor a series is an array."""
    spark, keys = returns.sparkSession, list(keys)

    def unit(rng, first, count):
        path = np.repeat(np.arange(first, first + count, dtype=np.int32), n)
        return {"path": path, "place": np.tile(np.arange(n, dtype=np.int64), count), "obs": rng.integers(0, n, size=count * n)}

    kept = returns.select(*keys, F.col("obs").cast("long").alias("obs"), F.when(F.col("ret") < -1, F.raise_error(F.lit("a return under -1 has no drawdown"))).otherwise(F.col("ret")).alias("ret"))
    picks = kept.join(drawn(spark, seed, paths, n, unit, "path int, place long, obs long"), "obs").select(*keys, "path", "place", "ret")
    own = kept.select(*keys, F.lit(-1).alias("path"), F.col("obs").alias("place"), "ret")
    walks = _wealth(picks.unionByName(own), [*keys, "path"], "place", n)
    dd = walks.select(*keys, "path", F.greatest(F.lit(0.0), "state.dd", 1 - F.col("state.low")).alias("dd"))
    sim = F.when(F.col("path") >= 0, F.col("dd"))
    out = dd.groupBy(*keys).agg(F.max(F.when(F.col("path") < 0, F.col("dd"))).alias("observed_max"), F.percentile(sim, 0.5).alias("bootstrap_median"), F.percentile(sim, 0.95).alias("bootstrap_p95"), F.avg((sim >= 0.5).cast("double")).alias("risk_of_ruin"))
    if keys:
        return out.join(expected_shortfall(returns, keys), keys)
    worst = returns.orderBy("ret").limit(max(1, -(-n * 5 // 100)))  # a top-k, not a sort of all
    return out.crossJoin(worst.agg(F.abs(F.avg("ret")).alias("expected_shortfall")))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column per share: exact quantiles, linear between neighbours."""
    return rows.groupBy(*keys).agg(*[F.percentile(value, p).alias(name) for name, p in shares.items()])


def divergence(expected: DataFrame, observed: DataFrame, key: str, limit: float) -> DataFrame:
    """abs(observed - expected) / max(abs(expected), 1) per key and whether it is within the limit."""
    j = expected.select(key, F.col("value").alias("expected")).join(observed.select(key, F.col("value").alias("observed")), key)
    d = F.abs(F.col("observed") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1.0))
    return j.withColumn("divergence", d).withColumn("status", F.when(F.col("divergence") <= limit, "pass").otherwise("blocked"))


def locked_caps(accounts: DataFrame) -> DataFrame:
    """Caps of the first live stages: a fixed amount or a small share of equity, whichever is less."""
    return accounts.select("account", "equity", F.least(F.lit(100.0), F.col("equity") * 0.0025).alias("max_capital"), F.least(F.lit(25.0), F.col("equity") * 0.001).alias("max_daily_loss"))


def sizes(rows: DataFrame, max_units: float, fraction: float, target_vol: float) -> DataFrame:
    """Fixed-fraction and volatility-target sizes (both capped) and the Kelly upper bound. rows: equity, price, vol, p, b."""
    fixed = F.least(F.lit(max_units), F.col("equity") * fraction / F.col("price"))
    vol = F.least(F.lit(max_units), F.col("equity") * target_vol / F.col("vol") / F.col("price"))
    return rows.withColumns({"fixed_fraction": fixed, "vol_target": vol, "kelly": F.greatest(F.lit(0.0), F.col("p") - (1 - F.col("p")) / F.col("b"))})
