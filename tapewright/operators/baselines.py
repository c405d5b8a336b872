"""Named baselines: what any strategy has to beat, each with its tape, its registered search space and its verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics, replay, screen
from .strategies import BuyHold, Breakout, Reversion, SeededRandom

CASH = 100_000
#: Fixed value: units of the underlying that a contract of the synthetic future stands for.
MULTIPLIER = 50
#: Fixed value: synthetic bars are a minute apart, so many are in a year of days that all trade.
PERIODS = 365.25 * 24 * 60


@dataclass(frozen=True)
class Baseline:
    """A strategy over a synthetic tape. ``variants`` is the search space that is registered before the run."""

    name: str
    instrument: str
    profile: str
    make: object
    family: str
    variants: tuple[dict, ...] = ({},)
    selected: int = 0
    asset_class: str = "crypto_spot"
    verdict: str = "blocked"
    future: bool = False
    screened: dict = field(default_factory=dict)


#: Instruments, tapes, search spaces and verdicts of the baselines.
BASELINES = {
    b.name: b
    for b in (
        Baseline("buy_hold", "BTCUSDT", "trend", BuyHold, "buy_hold"),
        Baseline("seeded_random", "BTCUSDT", "flat", SeededRandom, "random", ({"seed": 7},), verdict="kill"),
        Baseline("donchian_momentum", "BTCUSDT", "trend", Breakout, "donchian", ({"lookback": 5}, {"lookback": 10}, {"lookback": 20}), 1),
        Baseline("mean_reversion", "ETHUSDT", "mean_reversion", Reversion, "mean_reversion", ({"lookback": 8, "entry_z": 0.8}, {"lookback": 12, "entry_z": 1.0}, {"lookback": 20, "entry_z": 1.2}), 1),
        Baseline("futures_trend", "ES_CONT", "trend", Breakout, "donchian", ({"lookback": 10}, {"lookback": 20}), 0, "futures", future=True),
    )
}
COMPLEMENT = "prediction_complement"
NAMES = (*BASELINES, COMPLEMENT)


def tape(spark: SparkSession, names: list[str] | None = None, count: int = 96) -> DataFrame:
    """Events of the baselines' runs: run_id is the baseline's name. A future's definition comes before its bars."""
    out = None
    for b in (BASELINES[n] for n in names or BASELINES):
        bars = screen.synthetic_bars(spark, count, b.profile, b.instrument)
        money = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")]
        e = bars.select(F.lit(b.name).alias("run_id"), "instrument_id", F.lit("bar").alias("event_type"), "event_time_ns", "receive_time_ns", "sequence", F.format_string("%s-%06d", F.lit(b.instrument), F.col("sequence")).alias("ingest_id"), *money, F.lit(None).cast("string").alias("instrument_type"), F.lit(None).cast("string").alias("multiplier"))
        if b.future:
            none = [F.lit(None).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")]
            start = bars.agg(F.min("event_time_ns").alias("t")).select((F.col("t") - 1).alias("t"))
            d = start.select(F.lit(b.name).alias("run_id"), F.lit(b.instrument).alias("instrument_id"), F.lit("instrument_definition").alias("event_type"), F.col("t").alias("event_time_ns"), F.col("t").alias("receive_time_ns"), F.lit(0).cast("long").alias("sequence"), F.lit(f"{b.instrument}-definition").alias("ingest_id"), *none, F.lit("future").alias("instrument_type"), F.lit(str(MULTIPLIER)).alias("multiplier"))
            e = d.unionByName(e)
        out = e if out is None else out.unionByName(e)
    return out


def run(spark: SparkSession, names: list[str] | None = None, rules: replay.Rules = replay.Rules()) -> DataFrame:
    """Replay the named baselines (all that have a strategy) side by side."""
    make = {n: b.make for n, b in BASELINES.items()}
    return replay.replay(tape(spark, names), lambda name: make[name](), rules)


def report(runs: DataFrame) -> DataFrame:
    """Per run: the eighteen metrics, net, with fills, refusals, costs and the gross result."""
    curve = runs.where("kind = 'equity'").select("run_id", "idx", "event_time_ns", F.col("equity").cast("double").alias("equity"))
    multiple = F.when(F.col("run_id").isin([n for n, b in BASELINES.items() if b.future]), MULTIPLIER).otherwise(1)
    notional = F.col("price").cast("double") * F.col("quantity").cast("double") * multiple
    fills = runs.where("kind = 'fill'").select("run_id", "event_time_ns", notional.alias("notional"))
    m = metrics.metric_pack(curve, fills, ["run_id"], float(CASH), PERIODS)
    amount = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "fill", F.col(c).cast("decimal(38,18)"))), F.lit(0)).cast("double")
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("fill", "fills"), ("rejected", "rejected"), ("missed", "missed"))]
    costs = runs.groupBy("run_id").agg(*counts, *[amount(c).alias(n) for c, n in (("fee", "fees"), ("spread", "spread"), ("slippage", "slippage"), ("impact", "impact"))])
    j = m.join(costs, "run_id")
    return j.withColumn("gross_pnl", F.col("pnl") + F.col("fees") + F.col("spread") + F.col("slippage") + F.col("impact"))


def complements(spark: SparkSession, count: int = 48) -> DataFrame:
    """The baseline without a strategy: moments at which both outcomes of a synthetic market cost less than the payoff."""
    return screen.complement_scan(screen.complement_books(spark, count))
