"""Assertion queries over results: each returns the rows that break a rule, and none if it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .risk import compounded

COMPONENTS = ("fees", "spread", "slippage", "impact")


def close(a, b, rel: float = 1e-9, absolute: float = 1e-12):
    """Two doubles agree up to a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b)))


def compounding(returns: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose net return is not what their periodic returns compound to."""
    c = compounded(returns, keys).select(*keys, "total")
    return cells.join(c, keys).where(~close(F.col("net_return"), F.col("total"), 1e-10)).select(*keys, "net_return", "total")


def waterfall(runs: DataFrame, key: str) -> DataFrame:
    """Runs whose net is not gross less costs."""
    costs = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    return runs.where(~close(F.col("net_pnl"), F.col("gross_pnl") - costs)).select(key)


def costs_present(runs: DataFrame, key: str) -> DataFrame:
    """(key, component) of costs that are not there or negative."""
    bad = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0), F.lit(c)) for c in COMPONENTS]))).alias("component")
    return runs.select(key, bad)


def intervals(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem): start < end, sample within coverage, holdout within sample."""
    rule = lambda ok, name: F.when(~ok, F.lit(name))
    why = [rule(F.col(f"{n}_start") < F.col(f"{n}_end"), f"{n}_empty") for n in ("coverage", "sample", "holdout")]
    for a, b in (("sample", "coverage"), ("holdout", "sample")):
        why.append(rule((F.col(f"{a}_start") >= F.col(f"{b}_start")) & (F.col(f"{a}_end") <= F.col(f"{b}_end")), f"{a}_outside_{b}"))
    return rows.select(key, F.explode(F.array_compact(F.array(*why))).alias("problem"))


def fold_policy(folds: DataFrame, purge: int, embargo: int) -> DataFrame:
    """Folds whose purge differs from the policy, or whose test begins before the last one's end and embargo."""
    prev = F.lag("test_end").over(W.orderBy("fold"))  # control data
    f = folds.withColumn("prev", prev)
    return f.where((F.col("test_start") - F.col("train_end") != purge) | (F.col("test_start") < F.col("prev") + embargo + purge)).select("fold")


def null_is_flat(cells: DataFrame, returns: DataFrame, variant: str) -> DataFrame:
    """Periods in which the flat control has a return other than exactly 0."""
    return returns.where((F.col("variant") == variant) & (F.col("ret") != 0.0))


def attempts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Registrations whose attempt number is not one more than the last one's, per group in ledger order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy("ordinal"))
    return entries.withColumn("expected", n).where("attempt <> expected").select(*keys, "ordinal", "attempt", F.col("expected").cast("long").alias("expected"))


def laps(rows: DataFrame, key: str) -> DataFrame:
    """Laps that do not count up from 1, or the second of two without progress."""
    w = W.partitionBy(key).orderBy("lap")
    r = rows.select(key, "lap", "progress", F.row_number().over(w).alias("n"), F.lag("progress").over(w).alias("before"))
    return r.where((F.col("lap") != F.col("n")) | (~F.col("progress") & ~F.coalesce("before", F.lit(True)))).select(key, "lap")


def null_metrics(metrics: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """Null metrics without a reason, and metrics that are not finite. metrics and reasons: key, name, value / reason."""
    j = metrics.join(reasons, [key, "name"], "left")
    return j.where((F.col("value").isNull() & F.col("reason").isNull()) | F.isnan("value") | (F.abs("value") == float("inf"))).select(key, "name")
