"""The continuous series of the contract with the most volume: a prefix over transition maps of time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DAY_NS
from ..tables import saved, scratch

#: Maps that are put together in a group.
FAN = 1_024
_CLOSES = "map<string,double>"
STATE = "struct<held:string,challenger:string,wins:int,lost:struct<at:bigint,held:string,top:string>,rolls:array<struct<at:bigint,from:string,to:string,gap:double>>>"


def _state(held: Column, challenger: Column | None = None, wins: Column | None = None) -> Column:
    """A state of the machine before any time; ``lost`` is set where the held contract is missing, and nothing follows it."""
    challenger, wins = challenger if challenger is not None else F.lit(None), wins if wins is not None else F.lit(0)
    return F.struct(held.alias("held"), challenger.alias("challenger"), wins.alias("wins"), F.lit(None).alias("lost"), F.array().alias("rolls")).cast(STATE)


def _step(persistence: int):
    """One time: a contract with strictly more volume than the held one wins; ``persistence`` wins in a row of the same one take
    over. Only the contract with the most volume can be that contract, so nothing else of a time matters but the held one."""

    def step(s: Column, t: Column) -> Column:
        held, top = s["held"], t["top"]
        missing = held.isNotNull() & F.element_at(t["volumes"], held).isNull() & ~F.array_contains(F.map_keys(t["volumes"]), held)
        beaten = F.coalesce((top != held) & (F.element_at(t["volumes"], top) > F.element_at(t["volumes"], held)), F.lit(False))
        wins = F.when(~beaten, 0).when(s["challenger"] == top, s["wins"] + 1).otherwise(1)
        takes = wins >= persistence
        roll = F.struct(t["at"].alias("at"), held.alias("from"), top.alias("to"), (F.element_at(t["closes"], held) - F.element_at(t["closes"], top)).alias("gap"))
        moved = F.struct(
            F.when(held.isNull() | takes, top).otherwise(held).alias("held"),
            F.when(beaten & ~takes, top).alias("challenger"),
            F.when(takes, 0).otherwise(wins).alias("wins"),
            F.lit(None).alias("lost"),
            F.when(takes, F.concat(s["rolls"], F.array(roll))).otherwise(s["rolls"]).alias("rolls"),
        ).cast(STATE)
        gone = F.struct(held.alias("held"), F.lit(None).alias("challenger"), F.lit(0).alias("wins"), F.struct(t["at"].alias("at"), held.alias("held"), top.alias("top")).alias("lost"), s["rolls"].alias("rolls")).cast(STATE)
        return F.when(s["lost"].isNotNull(), s).when(missing, gone).otherwise(moved)

    return step


def _key(held: Column, wins: Column) -> Column:
    return F.concat(wins.cast("string"), F.lit("|"), F.coalesce(held, F.lit("")))


def _enter(s: Column, first_top: Column) -> Column:
    """Which of a bucket's start states a state is: a challenger counts if it is the bucket's first top."""
    return _key(s["held"], F.when(s["challenger"] == first_top, s["wins"]).otherwise(0))


def _through(s: Column, bucket: Column) -> Column:
    """The state after a bucket, by its map; without rolls, which are found again where they are needed. A held contract that the
    map doesn't know is missing at the bucket's first time."""
    after = F.element_at(bucket["ends"], _enter(s, bucket["first_top"]))
    gone = F.struct(s["held"].alias("held"), F.lit(None).alias("challenger"), F.lit(0).alias("wins"), F.struct(bucket["first_at"].alias("at"), s["held"].alias("held"), bucket["first_top"].alias("top")).alias("lost"), F.array().alias("rolls")).cast(STATE)
    return F.when(s["lost"].isNotNull(), s).otherwise(F.coalesce(after, gone))


def _sorted(rows: Column, by: str) -> Column:
    return F.array_sort(rows, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def _starts(maps: DataFrame) -> DataFrame:
    """(series, idx, start): the state with which each bucket begins. maps: series, idx from 0, bucket. FAN neighbours are composed
    to one map, level by level; states come back down the same way."""
    groups = maps.groupBy("series", F.expr(f"idx div {FAN}").alias("group")).agg(_sorted(F.collect_list(F.struct("idx", "bucket")), "idx").alias("all"))
    if (maps.agg(F.max("idx")).first()[0] or 0) < FAN:
        began = groups.withColumn("start", _state(F.lit(None)))
    else:
        first = F.col("all")[0]["bucket"]
        ends = F.transform_values(first["ends"], lambda k, s: F.aggregate(F.slice("all", 2, FAN), s, lambda a, x: _through(a, x["bucket"])))
        wider = saved(groups.select("series", F.col("group").alias("idx"), F.struct(first["first_at"].alias("first_at"), first["first_top"].alias("first_top"), ends.alias("ends")).alias("bucket")), "roll-maps")
        began = groups.join(_starts(wider).withColumnRenamed("idx", "group"), ["series", "group"])
    each = F.aggregate("all", F.struct(F.col("start").alias("now"), F.array().cast(f"array<struct<idx:bigint,start:{STATE}>>").alias("out")), lambda a, x: F.struct(_through(a["now"], x["bucket"]).alias("now"), F.concat(a["out"], F.array(F.struct(x["idx"].cast("long").alias("idx"), a["now"].alias("start")))).alias("out")))
    return began.select("series", F.explode(each["out"]).alias("x")).select("series", "x.idx", "x.start")


@scratch
def volume_roll(bars: DataFrame, persistence: int = 2, width: int = DAY_NS) -> DataFrame:
    """The continuous series of the contract with the most volume, with hysteresis.

    bars: series, instrument_id, event_time_ns, close, volume, a row for each series, time and contract. A challenger takes over
    after beating the incumbent strictly at ``persistence`` times in a row; a tie resets it; a missing incumbent is an error.
    Closes before and after a roll differ by the roll's gap; gaps add up to the adjustment.

    A bucket of ``width`` is walked from each state it may begin with (a held contract and its challenger's wins); these maps are
    composed, so that each bucket's true start is known, and it is walked once more. No task sees a series.
    """
    name = F.when(F.col("series").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("series")))  # joins lose nulls
    b = bars.select(name.alias("series"), "instrument_id", "event_time_ns", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("instrument_id", c)))
    times = b.groupBy("series", "event_time_ns").agg(F.max(F.struct("volume", "instrument_id"))["instrument_id"].alias("top"), entry("volume").alias("volumes"), entry("close").alias("closes"))
    time = F.struct(F.col("event_time_ns").alias("at"), "top", "volumes", "closes")
    buckets = times.groupBy("series", F.expr(f"event_time_ns div {width}").alias("bucket")).agg(_sorted(F.collect_list(time), "at").alias("times"))
    buckets = saved(buckets.withColumn("idx", F.row_number().over(W.partitionBy("series").orderBy("bucket")) - 1), "roll-buckets")  # a row per bucket
    first = F.col("times")[0]
    walk = lambda s: F.aggregate("times", s, _step(persistence))
    held = F.map_keys(first["volumes"])
    fresh = F.transform(held, lambda c: F.struct(_key(c, F.lit(0)).alias("k"), walk(_state(c)).alias("s")))
    pressed = [F.transform(held, lambda c: F.struct(_key(c, F.lit(w)).alias("k"), walk(_state(c, first["top"], F.lit(w))).alias("s"))) for w in range(1, persistence)]
    nothing = F.array(F.struct(_key(F.lit(None).cast("string"), F.lit(0)).alias("k"), walk(_state(F.lit(None))).alias("s")))
    ends = F.transform_values(F.map_from_entries(F.concat(nothing, fresh, *pressed)), lambda k, s: s.withField("rolls", F.array().cast("array<struct<at:bigint,from:string,to:string,gap:double>>")))
    maps = saved(buckets.select("series", F.col("idx").cast("long").alias("idx"), F.struct(first["at"].alias("first_at"), first["top"].alias("first_top"), ends.alias("ends")).alias("bucket")), "roll-maps")
    done = buckets.join(_starts(maps), ["series", "idx"]).withColumn("end", walk(F.col("start").withField("rolls", F.array().cast("array<struct<at:bigint,from:string,to:string,gap:double>>"))))
    lost = F.col("end.lost")
    why = F.concat(F.lit("incumbent contract "), lost["held"], F.lit(" missing while challenger "), F.coalesce(lost["top"], F.lit("<none>")), F.lit(" was evaluated at timestamp "), lost["at"].cast("string"))
    done = done.withColumn("begin", F.coalesce("start.held", first["top"])).withColumn("rolls", F.when(lost.isNotNull(), F.raise_error(why)).otherwise(F.col("end.rolls")))
    total = F.aggregate("rolls", F.lit(0.0), lambda a, r: a + r["gap"])
    done = done.select("series", "times", "begin", "rolls", "idx", F.coalesce(F.sum(total).over(W.partitionBy("series").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # a row per bucket
    rows = done.select("series", "begin", "before", "rolls", F.explode("times").alias("t"))
    past = F.filter("rolls", lambda r: r["at"] <= F.col("t.at"))
    rows = rows.withColumn("_past", past).withColumn("instrument_id", F.when(F.size("_past") > 0, F.element_at("_past", -1)["to"]).otherwise(F.col("begin")))
    close = F.element_at("t.closes", F.col("instrument_id"))
    adjustment = F.col("before") + F.aggregate("_past", F.lit(0.0), lambda a, r: a + r["gap"])
    series = F.when(F.col("series") != "-", F.substring("series", 2, 2**31 - 1))
    return rows.select(series.alias("series"), F.col("t.at").alias("event_time_ns"), "instrument_id", close.alias("raw_close"), F.exists("rolls", lambda r: r["at"] == F.col("t.at")).alias("rolled"), adjustment.alias("roll_adjustment"), (close + adjustment).alias("signal_close"))
