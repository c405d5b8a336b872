"""Performance metrics of equity curves as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import drawdowns

#: The metrics.
NAMES = (
    "pnl", "total_return", "annualized_return", "volatility", "downside_volatility", "sharpe", "sortino", "calmar", "max_drawdown", "average_drawdown",
    "drawdown_duration", "win_rate", "payoff_ratio", "expectancy", "turnover", "average_holding_period", "expected_shortfall", "capacity_estimate",
)


def metric_pack(curve: DataFrame, fills: DataFrame | None, keys: list[str], initial_cash: float, periods_per_year: float) -> DataFrame:
    """Eighteen metrics per run. curve: keys, event_time_ns, equity; fills: keys, event_time_ns, notional.

    A run with an equity of 0 or less has no metrics. Ratios without a spread, and the capacity, are null."""
    w = W.partitionBy(*keys).orderBy("event_time_ns")
    c = drawdowns(curve, keys).withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(w), F.lit(0.0)) - 1)
    down, up = F.when(F.col("ret") < 0, F.col("ret")), F.when(F.col("ret") > 0, F.col("ret"))
    tail = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ret").asc_nulls_last(), "event_time_ns"))
    c = c.withColumn("_tail", tail).withColumn("_n", F.count("ret").over(W.partitionBy(*keys)))
    in_tail = F.when(F.col("_tail") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.05)), F.col("ret"))
    a = c.groupBy(*keys).agg(
        F.min("equity").alias("least"), F.max_by("equity", "event_time_ns").alias("final"), F.count("ret").alias("n"), F.avg("ret").alias("mean"),
        F.stddev_pop("ret").alias("sd"), F.count(down).alias("n_down"), F.stddev_pop(down).alias("sd_down"), F.avg(down).alias("mean_down"),
        F.count(up).alias("n_up"), F.avg(up).alias("mean_up"), F.max("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("average_drawdown"),
        F.max("run").alias("drawdown_duration"), F.avg(in_tail).alias("tail"),
    )
    year = periods_per_year**0.5
    ratio = lambda x, y: F.when(F.col(y) != 0, F.col(x) / F.nullif(y, F.lit(0.0)))
    total = F.col("pnl") / initial_cash
    a = a.withColumn("pnl", F.col("final") - initial_cash).withColumn("total_return", total)
    a = a.withColumns(
        {
            "annualized_return": F.when(F.col("total_return") > -1, F.expm1(F.log1p(F.col("total_return")) * periods_per_year / F.col("n"))).when(F.col("total_return") == -1, -1.0),
            "volatility": F.when(F.col("n") > 1, F.col("sd") * year),
            "downside_volatility": F.when(F.col("n_down") > 1, F.col("sd_down") * year),
            "sharpe": F.when(F.col("n") > 1, ratio("mean", "sd") * year),
            "sortino": F.when(F.col("n_down") > 1, ratio("mean", "sd_down") * year),
            "win_rate": F.col("n_up") / F.nullif(F.col("n").cast("double"), F.lit(0.0)),
            "payoff_ratio": F.col("mean_up") / F.abs("mean_down"),
            "expectancy": F.col("mean") * initial_cash,
            "expected_shortfall": F.abs("tail"),
            "capacity_estimate": F.lit(None).cast("double"),
        }
    ).withColumn("calmar", ratio("annualized_return", "max_drawdown"))
    if fills is not None:
        fw = W.partitionBy(*keys).orderBy("event_time_ns")
        f = fills.withColumn("gap", F.col("event_time_ns") - F.lag("event_time_ns").over(fw))
        f = f.groupBy(*keys).agg((F.sum("notional") / initial_cash).alias("turnover"), (F.avg("gap") / 1e9).alias("average_holding_period"))
        a = a.join(f, keys, "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    else:
        a = a.withColumns({"turnover": F.lit(0.0), "average_holding_period": F.lit(None).cast("double")})
    valid = F.col("least") > 0
    return a.select(*keys, valid.alias("promotable"), *[F.when(valid, F.col(n)).alias(n) for n in NAMES])


def periodic_returns(curve: DataFrame, final: DataFrame, keys: list[str], cash: float) -> DataFrame:
    """(keys, idx, ret) of a sampled curve: the cash comes first, the final equity last if the curve does not end with it;
    a return on an equity of 0 is skipped. curve: keys, event_time_ns, equity; final: keys, final."""
    w = W.partitionBy(*keys).orderBy("event_time_ns")
    c = curve.select(*keys, "event_time_ns", "equity", F.lead("equity").over(w).alias("_next")).join(final.select(*keys, "final"), keys)
    ends = F.when(F.col("_next").isNull() & (F.col("equity") != F.col("final")), F.array("equity", "final")).otherwise(F.array("equity"))
    c = c.select(*keys, "event_time_ns", F.posexplode(ends).alias("_k", "equity"))
    o = W.partitionBy(*keys).orderBy("event_time_ns", "_k")
    c = c.withColumns({"idx": F.row_number().over(o) - 1, "_prev": F.coalesce(F.lag("equity").over(o), F.lit(cash))})
    return c.where("_prev <> 0").select(*keys, "idx", (F.col("equity") / F.col("_prev") - 1).alias("ret"))


def waterfall(runs: DataFrame) -> DataFrame:
    """gross = net + every cost that left cash. runs: run_id, net_pnl, fees, spread, slippage, impact, funding, borrow, roll."""
    parts = ["fees", "spread", "slippage", "impact", "funding", "borrow", "roll"]
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    return runs.withColumn("total_costs", total).withColumn("gross_pnl", F.col("net_pnl") + F.col("total_costs"))
