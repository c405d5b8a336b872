"""Out-of-sample statistics: folds, Sharpe probabilities, overfit probability, bootstrap tests."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normal
from .draws import drawn

EULER = 0.5772156649015329


def walk_forward(spark, n: int, train: int, test: int, purge: int = 0, embargo: int = 0, anchored: bool = True) -> DataFrame:
    """Purged folds in closed form: fold k's cursor is train + k * (purge + test + embargo)."""
    step = purge + test + embargo
    folds = (n - train - purge - test) // step + 1 if n >= train + purge + test else 0
    if folds <= 0:
        raise ValueError("no fold fits")
    cursor = F.lit(train) + F.col("id") * step
    begin = F.lit(0).cast("long") if anchored else cursor - train
    return spark.range(folds).select(F.col("id").alias("fold"), begin.alias("train_start"), cursor.alias("train_end"), (cursor + purge).alias("test_start"), (cursor + purge + test).alias("test_end"))


def moments(returns: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sample deviation, unbiased skewness and (Pearson) kurtosis; 0 and 3 where too few rows define them."""
    n = F.col("n").cast("double")
    m = returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    skew = F.when((n > 2) & (F.col("sd") > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")).otherwise(0.0)
    kurt = F.when((n > 3) & (F.col("sd") > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6) + 3).otherwise(3.0)
    return m.select(*keys, "n", "mean", "sd", skew.alias("skew"), kurt.alias("kurt"))


def psr(returns: DataFrame, keys: list[str], benchmark: float = 0.0, effective: DataFrame | None = None) -> DataFrame:
    """Probability that the true Sharpe ratio exceeds a benchmark; without spread 1 or 0 by the mean.

    effective: keys and effective_n, to count autocorrelated rows for what they are worth."""
    m = moments(returns, keys).withColumn("sharpe", F.col("mean") / F.nullif("sd", F.lit(0.0)))
    rows = F.col("n").cast("double")
    if effective is not None:
        m, rows = m.join(effective.select(*keys, "effective_n"), keys), F.col("effective_n")
    var = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2
    z = (F.col("sharpe") - benchmark) * F.sqrt(rows - 1.0) / F.sqrt(F.greatest(var, F.lit(1e-12)))
    flat = F.when(F.col("mean") > benchmark, 1.0).otherwise(0.0)
    return m.withColumn("z", F.when(F.col("sd") > 0, z)).withColumn("psr", F.when(F.col("sd") > 0, normal.cdf(F.col("z"))).otherwise(flat))


def dsr_factor(trials: int) -> float:
    """Expected maximum of that many standard normal Sharpe ratios."""
    return (1 - EULER) * normal.quantile(1 - 1 / trials) + EULER * normal.quantile(1 - 1 / (trials * math.e))


def dsr(returns: DataFrame, keys: list[str], trials: int, trial_sharpes: list[float] | None = None) -> DataFrame:
    """Deflated: the benchmark is what the best of the trials would reach by luck, given the spread of their ratios (those
    of the series themselves unless trial_sharpes names them)."""
    m = moments(returns, keys).withColumn("sharpe", F.col("mean") / F.nullif("sd", F.lit(0.0)))
    spread = m.agg((F.stddev_samp("sharpe") * dsr_factor(trials)).alias("benchmark"))  # one row
    if trial_sharpes is not None:
        spread = returns.sparkSession.range(1).select(F.lit(float(np.std(trial_sharpes, ddof=1)) * dsr_factor(trials)).alias("benchmark"))
    m = m.crossJoin(spread)
    var = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2
    z = (F.col("sharpe") - F.col("benchmark")) * F.sqrt(F.col("n") - 1.0) / F.sqrt(F.greatest(var, F.lit(1e-12)))
    return m.withColumn("z", z).withColumn("dsr", normal.cdf(F.col("z")))


def block_of(obs, n: int, blocks: int):
    """Number of the block that an even split puts an observation into; the first n mod blocks hold one more."""
    size, extra = divmod(n, blocks)
    head = extra * (size + 1)
    return F.when(obs < head, F.floor(obs / (size + 1))).otherwise(extra + F.floor((obs - head) / max(size, 1))).cast("int")


def pbo_splits(returns: DataFrame, n: int, blocks: int = 8) -> DataFrame:
    """(split, variant, rank, relative rank, logit) of the in-sample winner of every way to choose half of the blocks.

    Sums per block and variant are made once; the table of splits (70 rows for 8 blocks) is joined to them. Ties: the
    first variant wins; ranks go by (score, variant)."""
    spark = returns.sparkSession
    parts = returns.withColumn("block", block_of(F.col("obs"), n, blocks)).groupBy("block", "variant").agg(F.sum("ret").alias("s"), F.count("*").alias("k"))
    splits = [(i, b, b in chosen) for i, chosen in enumerate(itertools.combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    table = spark.createDataFrame(splits, "split int, block int, train boolean")
    j = parts.join(F.broadcast(table), "block").groupBy("split", "variant", "train").agg((F.sum("s") / F.sum("k")).alias("m"))
    j = j.groupBy("split", "variant").agg(F.max(F.when(F.col("train"), F.col("m"))).alias("inside"), F.max(F.when(~F.col("train"), F.col("m"))).alias("outside"))
    best = F.row_number().over(W.partitionBy("split").orderBy(F.desc("inside"), "variant"))
    rank = F.row_number().over(W.partitionBy("split").orderBy("outside", "variant"))
    count = F.count(F.lit(1)).over(W.partitionBy("split"))
    j = j.select("split", "variant", best.alias("best"), rank.alias("rank"), count.alias("v")).where("best = 1")
    rel = F.col("rank") / (F.col("v") + 1)
    return j.select("split", "variant", "rank", rel.alias("relative_rank"), F.log(rel / (1 - rel)).alias("logit"))


def pbo(returns: DataFrame, n: int, blocks: int = 8) -> DataFrame:
    s = pbo_splits(returns, n, blocks)
    return s.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("combinations"))


def _starts(spark, n: int, samples: int, seed: int, block: int, last: int) -> DataFrame:
    """(draw, start, tail) of the blocks of each resample: starts below ``last``; the block with ``tail`` is cut short."""
    per = -(-n // block)

    def unit(rng, first, count):
        draw = np.repeat(np.arange(first, first + count, dtype=np.int32), per)
        return {"draw": draw, "start": rng.integers(0, last, size=count * per), "tail": np.tile(np.arange(per) == per - 1, count)}

    return drawn(spark, seed, samples, per, unit, "draw int, start long, tail boolean")


def block_sums(series: DataFrame, keys: list[str], value: str, n: int, block: int) -> DataFrame:
    """keys, start, whole, cut: the sum of the ``block`` observations from each start on, around the end of the series, and
    that of as many as a last block has. A resample is then a sum over its starts, not over its observations."""
    cut = n - block * (-(-n // block) - 1)
    x = series.select(*keys, "obs", F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_k"))
    x = x.withColumn("start", F.pmod(F.col("obs") - F.col("_k"), F.lit(n)))
    return x.groupBy(*keys, "start").agg(F.sum("_v").alias("whole"), F.sum(F.when(F.col("_k") < cut, F.col("_v"))).alias("cut"))


def _block_of_root(n: int) -> int:
    return max(1, math.ceil(n ** (1 / 3)))


def _at_least(a: str, b: str):
    """a >= b, sums taken in another order included."""
    return F.sum((F.col(a) >= F.col(b) - 1e-12 * F.abs(F.col(b))).cast("int"))


def reality_check(returns: DataFrame, n: int, samples: int = 500, seed: int = 7) -> DataFrame:
    """p-values of the best mean, and of the best studentized mean, against centred circular block resamples."""
    spark, block = returns.sparkSession, _block_of_root(n)
    stats = returns.groupBy("variant").agg(F.avg("ret").alias("m"), (F.stddev_samp("ret") / math.sqrt(n)).alias("se"))
    x = returns.join(stats, "variant").select("variant", "obs", (F.col("ret") - F.col("m")).alias("c"))
    sums = block_sums(x, ["variant"], "c", n, block)
    part = F.when(F.col("tail"), F.col("cut")).otherwise(F.col("whole"))
    means = sums.join(_starts(spark, n, samples, seed, block, n), "start").groupBy("draw", "variant").agg((F.sum(part) / n).alias("m")).join(stats.select("variant", "se"), "variant")
    ratio = F.max(F.when(F.col("se") > 0, F.col("m") / F.nullif("se", F.lit(0.0))))
    maxima = means.groupBy("draw").agg(F.max("m").alias("best"), F.coalesce(ratio, F.lit(0.0)).alias("spa"))
    seen = stats.agg(F.max("m").alias("obs_best"), F.coalesce(ratio, F.lit(0.0)).alias("obs_spa"))  # one row
    p = lambda a, b: ((1 + _at_least(a, b)) / (samples + 1))
    return maxima.crossJoin(seen).agg(p("best", "obs_best").alias("reality_check_pvalue"), p("spa", "obs_spa").alias("spa_pvalue")).withColumn("block_length", F.lit(block))


def sign_flip(pairs: DataFrame, n: int, samples: int = 2000, seed: int = 7) -> DataFrame:
    """One-sided paired test: signs of circular blocks of differences are flipped. pairs: obs, selected, baseline."""
    spark, block = pairs.sparkSession, _block_of_root(n)
    per = -(-n // block)

    def unit(rng, first, count):
        start, sign = np.zeros((count, per), np.int64), np.zeros((count, per))
        for d in range(count):
            start[d] = (rng.integers(0, n) + block * np.arange(per)) % n
            sign[d] = rng.choice((-1.0, 1.0), size=per)
        draw = np.repeat(np.arange(first, first + count, dtype=np.int32), per)
        return {"draw": draw, "start": start.ravel(), "sign": sign.ravel(), "tail": np.tile(np.arange(per) == per - 1, count)}

    draws = drawn(spark, seed, samples, per, unit, "draw int, start long, sign double, tail boolean")
    x = pairs.select("obs", (F.col("selected") - F.col("baseline")).alias("d"))
    part = F.when(F.col("tail"), F.col("cut")).otherwise(F.col("whole"))
    means = block_sums(x, [], "d", n, block).join(draws, "start").groupBy("draw").agg((F.sum(F.col("sign") * part) / n).alias("m"))
    seen = x.agg((F.sum("d") / n).alias("observed"))  # one row
    return means.crossJoin(seen).agg(((1 + _at_least("m", "observed")) / (samples + 1)).alias("pvalue")).withColumn("block_length", F.lit(block))


def block_bootstrap(returns: DataFrame, n: int, block: int, samples: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """(keys, draw, mean) of non-circular block resamples of each series (keys, obs, ret)."""
    draws = _starts(returns.sparkSession, n, samples, seed, block, n - block + 1)
    part = F.when(F.col("tail"), F.col("cut")).otherwise(F.col("whole"))
    return block_sums(returns, list(keys), "ret", n, block).join(draws, "start").groupBy(*keys, "draw").agg((F.sum(part) / n).alias("mean"))


def regime_statistics(rows: DataFrame) -> DataFrame:
    """Count, mean and share of positive values per regime."""
    return rows.groupBy("regime").agg(F.count("*").alias("observations"), F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("win_rate"))


def sensitivity(results: DataFrame, selected: float) -> DataFrame:
    """How much worse the neighbours of the selected parameter do. results: parameter, metric (control data)."""
    w = W.orderBy("parameter")
    r = results.select("parameter", "metric", F.lag("metric").over(w).alias("below"), F.lead("metric").over(w).alias("above")).where(F.col("parameter") == selected)
    worst = F.greatest(F.col("metric") - F.col("below"), F.col("metric") - F.col("above"))
    return r.select("parameter", F.col("metric").alias("selected_metric"), F.coalesce(worst, F.lit(0.0)).alias("max_neighbor_degradation"))


def train_winners(cells: DataFrame, excluded: list[str]) -> DataFrame:
    """The best variant of each fold's training cells; the lowest variant among equals; some never win."""
    t = cells.where((F.col("phase") == "train") & ~F.col("variant").isin(excluded))
    w = W.partitionBy("fold").orderBy(F.desc("score"), "variant")
    return t.select("fold", "variant", "score", F.row_number().over(w).alias("rn")).where("rn = 1").drop("rn")
