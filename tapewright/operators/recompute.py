"""Recomputing what a report claims: each check returns the rows on which claim and recomputation differ."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oos
from .consistency import close

#: Metrics that a promotion needs as numbers, gross and net.
PROMOTION_METRICS = ("pnl", "total_return", "sharpe", "max_drawdown", "turnover", "expectancy")


def differing_rows(claimed: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one side has, counted with their copies: ``side`` says which."""
    names = claimed.columns
    both = claimed.select(*names, F.lit(1).alias("_n")).unionByName(derived.select(*names, F.lit(-1).alias("_n")))
    left = both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return left.select(*names, F.when(F.col("_n") > 0, "claimed").otherwise("derived").alias("side"), F.abs("_n").alias("times"))


def double_run(first: DataFrame, second: DataFrame) -> DataFrame:
    """Result rows that two fresh runs of the same cells do not share: none if runs are deterministic."""
    return differing_rows(first, second)


def matrix_problems(claimed: DataFrame, returns: DataFrame, digits: int = 12) -> DataFrame:
    """Cells (obs, variant) of an out-of-sample matrix that the aligned test returns do not give, by ``digits`` decimals."""
    shape = lambda df: df.select("obs", "variant", F.round("ret", digits).alias("ret"))
    return differing_rows(shape(claimed), shape(returns))


def stitched_problems(claimed: DataFrame, returns: DataFrame, winners: DataFrame, digits: int = 12) -> DataFrame:
    """Rows of the selected series (fold, obs, ret) that the winners' test returns (fold, obs, variant, ret) do not give."""
    derived = returns.join(winners.select("fold", "variant"), ["fold", "variant"]).select("fold", "obs", F.round("ret", digits).alias("ret"))
    return differing_rows(claimed.select("fold", "obs", F.round("ret", digits).alias("ret")), derived)


def statistics(returns: DataFrame, trials: int) -> DataFrame:
    """(variant, name, value) of the statistics a report carries per variant: moments, effective rows, PSR and DSR."""
    lag = oos_autocorrelation(returns)
    p = oos.psr(returns, ["variant"], effective=lag.select("variant", "effective_n"))
    d = oos.dsr(returns, ["variant"], trials).select("variant", "dsr")
    j = p.join(d, "variant")
    names = ["mean", "sd", "skew", "kurt", "sharpe", "effective_n", "psr", "dsr"]
    return j.select("variant", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("variant", "x.name", "x.value")


def oos_autocorrelation(returns: DataFrame) -> DataFrame:
    """variant and effective_n: n (1 - r) / (1 + r) for the lag-1 autocorrelation r, kept between 2 and n."""
    from .features import autocorrelation

    return autocorrelation(returns, ["variant"])


def statistics_problems(claimed: DataFrame, derived: DataFrame, keys: list[str], rel: float = 1e-9) -> DataFrame:
    """(keys, name, claimed, derived) of values that differ, or that one side lacks."""
    a = claimed.select(*keys, "name", F.col("value").alias("claimed"), F.lit(True).alias("_a"))
    b = derived.select(*keys, "name", F.col("value").alias("derived"), F.lit(True).alias("_b"))
    j = a.join(b, [*keys, "name"], "full_outer")
    same = F.coalesce(close(F.col("claimed"), F.col("derived"), rel), F.col("claimed").isNull() & F.col("derived").isNull())
    return j.where(F.col("_a").isNull() | F.col("_b").isNull() | ~same).select(*keys, "name", "claimed", "derived")


def promotion_problems(metrics: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, problem) of runs that lack what a promotion needs.

    metrics: key, side (gross or net), name, value; runs: key, trades, periods_per_year. Six metrics must be finite on both
    sides, there must be a trade, and an annualization. A run's metrics become the bits of one number before they meet the run;
    both sides are as long as the runs, so neither is broadcast, however small its estimated size."""
    needed = [(s, n) for s in ("gross", "net") for n in PROMOTION_METRICS]
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    bit = F.coalesce(*[F.when((F.col("side") == s) & (F.col("name") == n), F.lit(1 << k)) for k, (s, n) in enumerate(needed)])
    has = metrics.where(finite).groupBy(key).agg(F.bit_or(bit).alias("_has"))
    judged = runs.select(key, "trades", "periods_per_year").join(has.hint("merge"), key, "left")
    rule = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    rules = [rule(F.col("_has").bitwiseAND(1 << k) != 0, f"{s}.{n}") for k, (s, n) in enumerate(needed)]
    rules += [rule(F.col("trades") >= 1, "trades"), rule(F.col("periods_per_year") > 0, "periods_per_year")]
    return judged.select(key, F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def promotion_flag_problems(runs: DataFrame, conditions: list[str], key: str) -> DataFrame:
    """(key, claimed, derived) where promotion_eligible is not the conjunction of the conditions; a null one fails."""
    derived = F.lit(True)
    for c in conditions:
        derived = derived & F.coalesce(F.col(c), F.lit(False))
    r = runs.select(key, F.col("promotion_eligible").alias("claimed"), derived.alias("derived"))
    return r.where(~F.col("claimed").eqNullSafe(F.col("derived")))


def prefix_problems(earlier: DataFrame, later: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """(keys, ordinal) of rows of an earlier, cumulative result that a later one does not repeat at the same place."""
    names = [c for c in earlier.columns if c not in (*keys, ordinal)]
    a = earlier.select(*keys, ordinal, F.struct(*names).alias("_a"))
    b = later.select(*keys, ordinal, F.struct(*names).alias("_b"))
    return a.join(b, [*keys, ordinal], "left").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, ordinal)


def fold_problems(splits: list[tuple[int, int]], rows: int) -> list[str]:
    """What is wrong with explicit test intervals (start, end): they need two rows before the first, order, and no overlap."""
    out, end = [], 0
    for k, (a, b) in enumerate(splits):
        if a < 2 or a < end or b <= a or b > rows:
            out.append(f"split {k}: [{a}, {b}) of {rows} rows after {end}")
        end = max(end, b)
    return out


def explicit_folds(spark, splits: list[tuple[int, int]], rows: int) -> DataFrame:
    """Anchored folds from explicit test intervals, in the shape of walk_forward()."""
    if problems := fold_problems(splits, rows):
        raise ValueError("; ".join(problems))
    data = [(k, 0, a, a, b) for k, (a, b) in enumerate(splits)]
    return spark.createDataFrame(data, "fold long, train_start long, train_end long, test_start long, test_end long")


def complete(value: float | None) -> bool:
    """Whether a reported number is there and finite."""
    return value is not None and math.isfinite(value)
