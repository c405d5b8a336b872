"""Sweeps: folds x variants x {train, test} as independent replays, winners chosen on training cells only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import replay


def name_of(variant: tuple[str, int]) -> str:
    return f"{variant[0]}-{variant[1]}"


def strategy_of(variant: str) -> replay.Strategy:
    family, lookback = variant.rsplit("-", 1)
    make = replay.FAMILIES[family]
    return make(int(lookback)) if int(lookback) else make()


def lengths(tape: DataFrame) -> DataFrame:
    """Bars of each series: one row per series."""
    return tape.groupBy("series").agg(F.count("*").alias("length"))


def run_cells(tape: DataFrame, folds: DataFrame, variants: list[tuple[str, int]], rules: replay.Rules) -> DataFrame:
    """Replay every cell: the bars of a series whose place lies in a fold's phase, under one variant.

    tape: series and event columns, sequence from 1. Folds are those of the longest series; a series has the folds that end
    within it. Phases and bars meet by stretches of places as long as the shortest phase, so a bar is compared with the phases
    near it and not with all; a cell is a group, so the cells of all series run side by side. run_id is series|fold|phase|variant."""
    spark = tape.sparkSession
    phases = folds.select("fold", F.explode(F.array(F.struct(F.lit("train").alias("phase"), F.col("train_start").alias("a"), F.col("train_end").alias("b")), F.struct(F.lit("test").alias("phase"), F.col("test_start").alias("a"), F.col("test_end").alias("b")))).alias("x"), "test_end").select("fold", "test_end", "x.*")
    names = spark.createDataFrame([(name_of(v),) for v in variants], "variant string")
    step = max(1, phases.agg(F.min(F.col("b") - F.col("a"))).first()[0] or 1)
    cells = phases.crossJoin(names).where("a < b").withColumn("stretch", F.explode(F.sequence(F.expr(f"a div {step}"), F.expr(f"(b - 1) div {step}"))))
    inside = (F.col("sequence") - 1 >= F.col("a")) & (F.col("sequence") - 1 < F.col("b")) & (F.col("test_end") <= F.col("length"))
    tape = tape.join(lengths(tape), "series").withColumn("stretch", F.expr(f"(sequence - 1) div {step}"))
    rows = tape.join(cells, "stretch").where(inside).withColumn("run_id", F.concat_ws("|", "series", F.col("fold").cast("string"), "phase", "variant"))
    rows = rows.drop("series", "fold", "phase", "variant", "a", "b", "test_end", "length", "stretch")
    return replay.replay(rows, lambda run_id: strategy_of(run_id.rsplit("|", 1)[1]), rules)


def cell_results(runs: DataFrame, cash: float) -> DataFrame:
    """Per cell: bars, compounded net return and the score (mean over deviation of the periodic returns, 0 without one)."""
    curve = runs.where("kind = 'equity'").select("run_id", "idx", F.col("equity").cast("double").alias("equity"))
    w = W.partitionBy("run_id").orderBy("idx")
    c = curve.withColumn("ret", F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(cash)) - 1)
    a = c.groupBy("run_id").agg(F.count("*").alias("bars"), (F.max_by("equity", "idx") / cash - 1).alias("net_return"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"))
    part = F.split("run_id", "\\|")
    score = F.when(F.col("s") > 0, F.col("m") / F.nullif("s", F.lit(0.0))).otherwise(0.0)
    return a.select(part[0].alias("series"), part[1].cast("long").alias("fold"), part[2].alias("phase"), part[3].alias("variant"), "bars", "net_return", score.alias("score"))


def stitched(cells: DataFrame, excluded: list[str]) -> DataFrame:
    """Each fold's training winner (lowest name among equals, some excluded) and what it did in the fold's test."""
    t = cells.where((F.col("phase") == "train") & ~F.col("variant").isin(excluded))
    w = W.partitionBy("series", "fold").orderBy(F.desc(F.round("score", 12)), "variant")  # sums of other order tie
    win = t.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("series", "fold", "variant", F.col("score").alias("train_score"))
    test = cells.where("phase = 'test'").select("series", "fold", "variant", F.col("net_return").alias("test_return"))
    return win.join(test, ["series", "fold", "variant"], "left")


def cover_problems(cells: DataFrame, folds: DataFrame, variants: list[tuple[str, int]], lengths: DataFrame) -> DataFrame:
    """(series, fold, variant, phase, n) where a planned cell is not there exactly once, or one is there unplanned.

    lengths: series and length; planned are the folds that end within the series."""
    spark = cells.sparkSession
    names = spark.createDataFrame([(name_of(v), p) for v in variants for p in ("train", "test")], "variant string, phase string")
    plan = lengths.crossJoin(folds.select("fold", "test_end")).where("test_end <= length").select("series", "fold").crossJoin(names).withColumn("planned", F.lit(True))  # control data
    have = cells.groupBy("series", "fold", "variant", "phase").agg(F.count("*").alias("n"))
    j = plan.join(have, ["series", "fold", "variant", "phase"], "full_outer")
    return j.where("planned IS NULL OR n IS NULL OR n <> 1").select("series", "fold", "variant", "phase", F.coalesce("n", F.lit(0)).alias("n"))


def promotion(stats: dict[str, float], stresses: DataFrame, thresholds: dict[str, tuple[str, float]]) -> tuple[bool, list[str]]:
    """Whether every statistic keeps its threshold and every stress passes, and what does not. Control data."""
    broken = [f"{k} {op} {limit}" for k, (op, limit) in thresholds.items() if not (stats[k] >= limit if op == ">=" else stats[k] <= limit)]
    broken += [r["scenario"] for r in stresses.where("status <> 'pass'").select("scenario").collect()]
    return not broken, broken


def promotions(stats: DataFrame, stresses: DataFrame, thresholds: dict[str, tuple[str, float]], key: str) -> DataFrame:
    """promotion() of many candidates: (key, promoted, broken).

    stats: key, name, value; stresses: key, scenario, status. A statistic that is missing or not a number breaks its threshold; a
    candidate without stresses is not promoted. ``broken`` has the thresholds, then the scenarios, each in text order."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(op).alias("op"), F.lit(float(limit)).alias("limit"), F.lit(f"{n} {op} {limit}").alias("text")) for n, (op, limit) in sorted(thresholds.items())])
    held = stats.where("value IS NOT NULL AND NOT isnan(value)").groupBy(key, "name").agg(F.max("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("held"))
    failed = stresses.groupBy(key).agg(F.count("*").alias("scenarios"), F.array_sort(F.collect_set(F.when(~F.coalesce(F.col("status") == "pass", F.lit(False)), F.col("scenario")))).alias("failed"))
    j = held.join(failed, key, "full_outer")

    def kept(r):
        value = F.try_element_at("held", r["name"])
        return F.coalesce(F.when(r["op"] == ">=", value >= r["limit"]).otherwise(value <= r["limit"]), F.lit(False))

    below = F.transform(F.filter(rules, lambda r: ~kept(r)), lambda r: r["text"])
    untried = F.when(F.coalesce("scenarios", F.lit(0)) == 0, F.array(F.lit("no stress"))).otherwise(F.col("failed"))
    return j.select(key, F.concat(below, untried).alias("broken")).select(key, (F.size("broken") == 0).alias("promoted"), "broken")
