"""Time-series features: returns, rolling frames, drawdowns, rolls, sampling, autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DAY_NS
from .lookups import order_free_digest
from .rolls import volume_roll  # noqa: F401
from .scans import HOUR_NS, scan


def bar_returns(bars: DataFrame, digest: str | None = None) -> DataFrame:
    """close / previous close - 1 per instrument, null for its first bar. With the digest of the bars that were meant
    (order_free_digest of their sorted columns), other bars are refused."""
    if digest is not None and order_free_digest(bars, sorted(bars.columns)).first()["digest"] != digest:
        raise ValueError("the bars are not those that the fingerprint names")
    w = W.partitionBy("instrument_id").orderBy("event_time_ns")
    return bars.withColumn("return_1", F.col("close") / F.lag("close").over(w) - 1)


def prior_frame(keys: list[str], order: list[str], rows: int):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)


def full_frame(value: Column, frame, rows: int) -> Column:
    """value over the frame, null until the frame holds all its rows."""
    return F.when(F.count(F.lit(1)).over(frame) == rows, value)


def forward_fill(column: str, keys: list[str], order: list[str]) -> Column:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(column, ignorenulls=True).over(w)


def filled(rows: DataFrame, column: str, keys: list[str], order: list[str], width: int = HOUR_NS) -> DataFrame:
    """rows whose nulls in a column are the last value before them, by key."""
    return scan(rows, keys, order, {"_filled": ("last", F.col(column))}, width).withColumn(column, F.col("_filled")).drop("_filled")


def drawdowns(curve: DataFrame, keys: list[str], order: str = "event_time_ns", value: str = "equity", width: int = HOUR_NS * 24) -> DataFrame:
    """Running peak, drawdown as a share of it, and the length of the current run below it."""
    c = scan(curve, keys, [order], {"peak": ("max", F.col(value))}, width)
    c = c.withColumn("drawdown", (F.col("peak") - F.col(value)) / F.col("peak"))
    c = scan(c, keys, [order], {"_rows": ("sum", F.lit(1))}, width)
    c = scan(c, keys, [order], {"_rows_at_top": ("last", F.when(F.col("drawdown") <= 0, F.col("_rows")))}, width)
    return c.withColumn("run", F.col("_rows") - F.coalesce("_rows_at_top", F.lit(0))).drop("_rows", "_rows_at_top")


def worst_windows(returns: DataFrame, keys: list[str], width: int = 5, top: int = 3) -> DataFrame:
    """The windows of ``width`` neighbours with the least sums; ties go to the earlier start."""
    w = W.partitionBy(*keys).orderBy("obs")
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    s = returns.select(*keys, "obs", F.sum("ret").over(w.rowsBetween(0, width - 1)).alias("total"), F.count(F.lit(1)).over(w.rowsBetween(0, width - 1)).alias("k"), F.least(n, F.lit(width)).alias("need"))
    s = s.where("k = need")
    return s.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("total", "obs"))).where(F.col("place") <= top).select(*keys, "place", "obs", "total")


def expected_shortfall(returns: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """Absolute mean of the smallest max(1, ceil(share * n)) returns."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    r = returns.select(*keys, "ret", F.row_number().over(W.partitionBy(*keys).orderBy("ret", "obs")).alias("rn"), F.greatest(F.lit(1), F.ceil(n * share)).alias("k"))
    return r.where("rn <= k").groupBy(*keys).agg(F.abs(F.avg("ret")).alias("expected_shortfall"))


def autocorrelation(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Lag-1 autocorrelation clamped to +-0.99 (0 under three rows or without spread) and the effective sample size."""
    w = W.partitionBy(*keys).orderBy("obs")
    r = returns.select(*keys, "ret", F.lag("ret").over(w).alias("prev"))
    n = F.count("ret")
    rho = F.least(F.lit(0.99), F.greatest(F.lit(-0.99), F.coalesce(F.when(n >= 3, F.corr("ret", "prev")), F.lit(0.0))))
    a = r.groupBy(*keys).agg(n.alias("n"), rho.alias("rho"))
    a = a.withColumn("rho", F.when(F.isnan("rho"), 0.0).otherwise(F.col("rho")))
    return a.withColumn("effective_n", F.least(F.col("n").cast("double"), F.greatest(F.lit(2.0), F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho")))))


def sampled(curve: DataFrame, every: int, order: str = "event_time_ns", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose number from 0 is a multiple of ``every``, and the last row."""
    w = W.partitionBy(*keys).orderBy(order)
    last = F.count(F.lit(1)).over(W.partitionBy(*keys)) - 1
    c = curve.withColumn("idx", F.row_number().over(w) - 1).withColumn("_last", last)
    return c.where((F.col("idx") % every == 0) | (F.col("idx") == F.col("_last"))).drop("_last")


def day_baseline(curve: DataFrame, value: str = "equity", keys: tuple[str, ...] = ()) -> DataFrame:
    """The first value of each UTC day beside every row of the day."""
    c = curve.withColumn("utc_day", F.expr(f"event_time_ns div {DAY_NS}"))
    return c.withColumn("day_start", F.first(value).over(W.partitionBy(*keys, "utc_day").orderBy("event_time_ns")))


def periods_per_year(times: DataFrame, continuous: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median interval between distinct times and how many of them a year of trading holds."""
    seconds = 365.25 * 86_400 if continuous else 252 * 6.5 * 3_600
    t = times.select(*keys, "event_time_ns").distinct()
    gap = t.withColumn("gap", F.col("event_time_ns") - F.lag("event_time_ns").over(W.partitionBy(*keys).orderBy("event_time_ns"))).where("gap IS NOT NULL")
    med = gap.groupBy(*keys).agg(F.percentile("gap", 0.5).alias("median_ns"))
    return med.withColumn("periods", F.lit(seconds * 1e9) / F.col("median_ns"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True, width: int = DAY_NS) -> DataFrame:
    """Latest right row of the same key before each left row (at its time too unless strict). Times are whole numbers.

    Union and the last right row so far: no range join, and a hot key is dealt by time. Right rows at the left row's time come
    after it if strict, before it if not."""
    side = F.lit(1 if strict else 0)
    keep = [c for c in left.columns if c not in by]
    lrow = left.select(*by, F.col(left_time).alias("_t"), (F.lit(0) if strict else F.lit(1)).alias("_side"), F.struct(*keep).alias("_left"), F.lit(None).cast(right.select(F.struct(*values, F.col(right_time).alias("as_of_time")).alias("z")).schema["z"].dataType).alias("_right"))
    rrow = right.select(*by, F.col(right_time).alias("_t"), side.alias("_side"), F.lit(None).cast(lrow.schema["_left"].dataType).alias("_left"), F.struct(*values, F.col(right_time).alias("as_of_time")).alias("_right"))
    u = scan(lrow.unionByName(rrow), by, ["_t", "_side"], {"_hit": ("last", F.col("_right"))}, width).where("_left IS NOT NULL")
    return u.select(*by, "_left.*", *[F.col(f"_hit.{c}").alias(f"as_of_{c}") for c in values], F.col("_hit.as_of_time"))
