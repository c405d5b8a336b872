"""Order books from snapshots and deltas, as scans over an instrument's tape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import saved, scratch
from .scans import scan

#: Events of an instrument that are windowed together.
DEAL = 65_536
#: Places that a node covers are a power of this.
SPREAD = 4


def covering_nodes(first: Column, end: Column, levels: int) -> Column:
    """The fewest nodes whose places are first .. end - 1: an array of (level, node), node n of level l being the SPREAD^l places
    from n * SPREAD^l on. Both ends are rounded inwards level by level; what rounding leaves behind are nodes of the level below."""

    def at(level: int) -> Column:
        unit = SPREAD**level
        up = lambda u: first + F.pmod(-first, F.lit(u))
        down = lambda u: end - F.pmod(end, F.lit(u))
        run = lambda a, b: F.when(a < b, F.sequence(a, b - unit, F.lit(unit).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        inner, outer = (up(unit * SPREAD), down(unit * SPREAD)), (up(unit), down(unit))
        places = F.when(inner[0] < inner[1], F.concat(run(outer[0], inner[0]), run(inner[1], outer[1]))).otherwise(run(*outer))
        return F.transform(places, lambda p: F.struct(F.lit(level).alias("level"), F.shiftright(p, 2 * level).alias("node")))

    return F.flatten(F.array(*[at(level) for level in range(levels)]))


def _verdicts(events: DataFrame) -> DataFrame:
    """Each event with ``segment`` (the place of the snapshot it builds on), whether it was accepted, whether a snapshot is needed,
    and ``take``, the changes of it that count."""
    is_snapshot = F.col("event_type") == "book_snapshot"
    e = scan(
        saved(events, "book-events"),
        ["instrument_id"],
        ["ord"],
        {
            "segment": ("last", F.when(is_snapshot, F.col("ord"))),
            "_prev": ("last_before", F.struct("sequence")),
            "_mark": ("last_before", F.when(is_snapshot | F.col("hash").isNotNull(), F.struct("hash"))),
        },
        DEAL,
    )
    first_bad = F.array_position(F.transform(F.coalesce("changes", F.array().cast(events.schema["changes"].dataType)), lambda c: ~F.coalesce(c["side"].isin("bid", "ask") & (c["size"] >= 0), F.lit(False))), True)
    gap = F.coalesce(F.col("sequence") != F.col("_prev.sequence") + 1, F.lit(False))
    other = F.coalesce(F.col("previous_hash") != F.col("_mark.hash"), F.lit(False))
    e = e.withColumns({"_off": ~is_snapshot & (gap | other), "_bad_at": F.when(is_snapshot, 0).otherwise(first_bad)})
    e = e.withColumn("_broke", F.when(F.col("_off") | (F.col("_bad_at") > 0), F.col("ord")))
    e = scan(saved(e, "book-checks"), ["instrument_id"], ["ord"], {"_last": ("last", F.col("_broke")), "_before": ("last_before", F.col("_broke"))}, DEAL)
    broken = F.col("segment").isNull() | F.coalesce(F.col("_last") > F.col("segment"), F.lit(False))
    stopped = F.col("segment").isNull() | F.coalesce(F.col("_before") > F.col("segment"), F.lit(False)) | F.col("_off")
    n = F.when(is_snapshot | stopped, 0).when(F.col("_bad_at") > 0, F.col("_bad_at") - 1).otherwise(F.size(F.coalesce("changes", F.array().cast(events.schema["changes"].dataType))))
    return e.select("instrument_id", "ord", "segment", (~broken).alias("accepted"), broken.alias("resync"), F.when(is_snapshot, F.col("bids")).alias("bids"), F.when(is_snapshot, F.col("asks")).alias("asks"), F.slice("changes", F.lit(1), n.cast("int")).alias("take"))


@scratch
def book_states(events: DataFrame) -> DataFrame:
    """Snapshots and deltas folded per instrument: after each event the best levels, how many there are, whether it was accepted,
    and whether a new snapshot is needed.

    events: instrument_id, ord (a whole number that orders an instrument's events, without gaps best), sequence, event_type, hash,
    previous_hash, bids and asks (snapshots), changes (deltas: side, price, size). A delta must follow on the sequence and the
    hash; size 0 removes a level; a negative or missing size or an unknown side stops the book until a snapshot, with the changes
    before it applied.

    A snapshot cuts the tape: what comes before it does not matter. In a segment an event counts if none up to it is broken, and a
    level lasts from the change that sets it to the next change of its price. Levels that last to the segment's end are a running
    maximum (minimum for asks); the others are dealt to nodes of places, and an event asks the nodes above its place. So neither
    an instrument, a segment nor a price is one task.
    """
    named = events.withColumn("instrument_id", F.when(F.col("instrument_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("instrument_id"))))  # joins lose nulls
    e = saved(_verdicts(named), "book-verdicts")
    update = "array<struct<side:string,price:double,k:bigint,on:boolean>>"

    def level(side: Column, x: Column, k: Column, on: Column) -> Column:
        return F.struct(side.alias("side"), x["price"].cast("double").alias("price"), k.cast("long").alias("k"), on.alias("on"))

    changes = [
        F.transform("bids", lambda x, k: level(F.lit("bid"), x, k, F.lit(True))),
        F.transform("asks", lambda x, k: level(F.lit("ask"), x, k, F.lit(True))),
        F.transform("take", lambda x, k: level(x["side"], x, k, x["size"] > 0)),
    ]
    all_of = F.concat(*[F.coalesce(c.cast(update), F.array().cast(update)) for c in changes])
    updates = e.select("instrument_id", "segment", "ord", F.explode(all_of).alias("u"))
    key = ["instrument_id", "segment", "side", "price"]
    updates = updates.groupBy("instrument_id", "segment", F.col("u.side").alias("side"), F.col("u.price").alias("price"), "ord").agg(F.max_by("u.on", "u.k").alias("on"))
    spans = scan(saved(updates.withColumn("_back", -F.col("ord")), "book-updates"), key, ["_back"], {"end": ("last_before", F.col("ord"))}, DEAL)
    spans = saved(spans.where("on").select(*key, "ord", "end"), "book-levels")

    bid, ask = F.when(F.col("side") == "bid", F.col("price")), F.when(F.col("side") == "ask", F.col("price"))
    lasting = F.col("end").isNull()
    begins = spans.groupBy("instrument_id", "segment", "ord").agg(F.count("*").alias("more"), F.max(F.when(lasting, bid)).alias("bid"), F.min(F.when(lasting, ask)).alias("ask"))
    ends = spans.where("end IS NOT NULL").groupBy("instrument_id", "segment", F.col("end").alias("ord")).agg((-F.count("*")).alias("more"))
    at = begins.unionByName(ends, allowMissingColumns=True).groupBy("instrument_id", "segment", "ord").agg(F.sum("more").alias("more"), F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    on = ["instrument_id", "segment", "ord"]
    rows = saved(e.select(*on, "accepted", "resync").join(at, on, "left"), "book-rows")
    rows = scan(rows, ["instrument_id", "segment"], ["ord"], {"levels": ("sum", F.col("more")), "_bid": ("max", F.col("bid")), "_ask": ("min", F.col("ask"))}, DEAL)

    closed = spans.where("end IS NOT NULL")
    longest = closed.agg(F.max(F.col("end") - F.col("ord"))).first()[0] or 0
    depth = next(k for k in range(1, 33) if SPREAD**k > longest)
    nodes = closed.select("instrument_id", "segment", "side", "price", F.explode(covering_nodes(F.col("ord"), F.col("end"), depth)).alias("x"))
    nodes = nodes.groupBy("instrument_id", "segment", "x").agg(F.max(bid).alias("bid"), F.min(ask).alias("ask"))
    asked = rows.where("segment IS NOT NULL").select(*on, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("ord", 2 * k).alias("node")) for k in range(depth)])).alias("x"))
    best = asked.join(nodes, ["instrument_id", "segment", "x"]).groupBy(*on).agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    out = rows.drop("bid", "ask").join(best, on, "left")
    name = F.when(F.col("instrument_id") != "-", F.substring("instrument_id", 2, 2**31 - 1))
    return out.select(name.alias("instrument_id"), "ord", "accepted", "resync", F.greatest("_bid", "bid").alias("best_bid"), F.least("_ask", "ask").alias("best_ask"), F.coalesce("levels", F.lit(0)).cast("int").alias("levels"))
