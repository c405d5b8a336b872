"""Fourteen data-quality checks and their roll-up; every check is a DataFrame of the rows it hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DAY_NS, MARKET_KEY, order_key, ordered_lag
from .scans import scan

#: Checks and their severities.
SEVERITY = {
    "timestamp_disorder": "error", "receive_time_inversion": "error", "duplicates": "error", "timezone": "critical",
    "negative_receive_latency": "critical", "invalid_price_size": "critical", "crossed_book": "critical",
    "sequence_gaps": "error", "missing_intervals": "error", "session_gaps": "warning", "roll_gaps": "warning",
    "stale_book": "error", "outliers": "warning", "provider_truncation": "error",
}
#: Fields in which zero is a value like any other.
ZERO_ALLOWED = ("volume", "size")
STREAM = ("instrument_id", "event_type")
#: Allowed intervals that are written into a plan.
LITERALS = 64


def timestamp_disorder(events: DataFrame, block: int = 100_000) -> DataFrame:
    """Rows whose canonical key is below that of the row that arrived before. Arrival order is dealt in blocks; the first
    row of a block is compared with the last of the block before."""
    e = events.select("arrival_ord", "ingest_id", order_key().alias("k"), F.expr(f"arrival_ord div {block}").alias("b"))
    w = W.partitionBy("b").orderBy("arrival_ord", "ingest_id")
    e = e.select("*", F.lag("k").over(w).alias("prev"), F.row_number().over(w).alias("rn"))
    last = e.groupBy("b").agg(F.max(F.struct("arrival_ord", "ingest_id", "k")).alias("z"))
    edge = last.select(F.col("b").alias("eb"), F.lag("z.k").over(W.orderBy("b")).alias("edge"))  # one row per block
    e = e.join(edge, e["b"] == edge["eb"], "left")
    return e.where(F.col("k") < F.when(F.col("rn") == 1, F.col("edge")).otherwise(F.col("prev"))).select("arrival_ord", "ingest_id")


def receive_time_inversion(events: DataFrame) -> DataFrame:
    """Rows received before the row that precedes them in canonical order, over all instruments."""
    return ordered_lag(events, ["receive_time_ns"]).where("receive_time_ns < prev_receive_time_ns").select("arrival_ord", "ingest_id")


def duplicates(events: DataFrame) -> DataFrame:
    """Second and later occurrences of a market event, with the ingest id of the first. ingest_id is not part of the key."""
    w = W.partitionBy(*MARKET_KEY).orderBy("receive_time_ns", "ingest_id", "arrival_ord")
    e = events.select("*", F.row_number().over(w).alias("rn"), F.first("ingest_id").over(w).alias("first_ingest_id"))
    return e.where("rn > 1").select("arrival_ord", "ingest_id", "first_ingest_id")


def timezone(events: DataFrame) -> DataFrame:
    """Rows without an event or receive time; times are nanoseconds of UTC, so nothing else can go wrong with their zone."""
    return events.where("event_time_ns IS NULL OR receive_time_ns IS NULL").select("arrival_ord", "ingest_id")


def negative_receive_latency(events: DataFrame) -> DataFrame:
    return events.where("receive_time_ns < event_time_ns").select("arrival_ord", "ingest_id")


def invalid_price_size(events: DataFrame, fields: tuple[str, ...] = ("price", "size", "open", "high", "low", "close", "volume")) -> DataFrame:
    """One row per field that is present and not a finite number, or negative, or zero where that is not allowed."""
    have = [f for f in fields if f in events.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in have])).alias("x")
    e = events.select("arrival_ord", "ingest_id", pairs).select("arrival_ord", "ingest_id", "x.field", "x.v")
    bad = F.isnan("v") | (F.abs("v") == float("inf")) | (F.col("v") < 0) | ((F.col("v") == 0) & ~F.col("field").isin(*ZERO_ALLOWED))
    return e.where(F.col("v").isNotNull() & bad).select("arrival_ord", "ingest_id", "field")


def crossed_book(books: DataFrame) -> DataFrame:
    """Books whose best bid reaches the best ask; locked counts."""
    return books.where(F.array_max("bids") >= F.array_min("asks"))


def sequence_gaps(events: DataFrame) -> DataFrame:
    e = ordered_lag(events, ["sequence"], STREAM)
    return e.where("sequence > prev_sequence + 1").select("instrument_id", "arrival_ord", "ingest_id", F.col("prev_sequence").alias("prev"), "sequence")


def interval_gaps(bars: DataFrame, interval_ns: int, sessions: list[tuple[int, int]] = (), rolls: list[tuple[int, int]] = ()) -> DataFrame:
    """Gaps over the expected interval between an instrument's bars, and what explains them.

    sessions and rolls: (start, end) of allowed intervals, part of the policy. A gap that one contains is a session gap,
    else a roll gap, else a missing interval. Up to LITERALS intervals are part of the plan; a longer calendar is a table, in
    which a gap lies inside an interval if it ends no later than the latest end of those that begin no later."""
    w = W.partitionBy("instrument_id").orderBy("event_time_ns")
    g = bars.select("instrument_id", "event_time_ns", F.lag("event_time_ns").over(w).alias("prev")).where(f"event_time_ns - prev > {interval_ns}")

    def marked(gaps: DataFrame, name: str, allowed) -> DataFrame:
        if len(allowed) <= LITERALS:
            if not allowed:
                return gaps.withColumn(name, F.lit(False))
            rows = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a, b in allowed])
            return gaps.withColumn(name, F.exists(rows, lambda x: (F.col("prev") >= x["a"]) & (F.col("event_time_ns") <= x["b"])))
        rows = gaps.select(F.col("prev").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct("*").alias("_row"))
        days = gaps.sparkSession.createDataFrame([(int(a), int(b)) for a, b in allowed], "_at long, _end long")
        both = rows.unionByName(days.select("_at", F.lit(0).alias("_kind"), "_end", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
        seen = scan(both, [], ["_at", "_kind"], {"_latest": ("max", F.col("_end"))}, DAY_NS).where("_kind = 1")
        return seen.select("_row.*", F.coalesce(F.col("_row.event_time_ns") <= F.col("_latest"), F.lit(False)).alias(name))

    g = marked(marked(g, "_session", sessions), "_roll", rolls)
    code = F.when(F.col("_session"), "session_gaps").when(F.col("_roll"), "roll_gaps").otherwise("missing_intervals")
    return g.select("instrument_id", "prev", "event_time_ns", code.alias("code"))


def stale_book(events: DataFrame, stale_after_ns: int, kinds: tuple[str, ...] = ("book_snapshot", "book_delta", "quote")) -> DataFrame:
    e = ordered_lag(events.where(F.col("event_type").isin(*kinds)), ["receive_time_ns"], STREAM)
    return e.where(f"receive_time_ns - prev_receive_time_ns > {stale_after_ns}").select("instrument_id", "arrival_ord", "ingest_id")


def outliers(bars: DataFrame, limit: float = 0.5) -> DataFrame:
    w = W.partitionBy("instrument_id").orderBy("event_time_ns")
    b = bars.select("instrument_id", "event_time_ns", "close", F.lag("close").over(w).alias("prev"))
    return b.where((F.col("prev") != 0) & (F.abs(F.col("close") / F.nullif("prev", F.lit(0.0)) - 1) > limit)).select("instrument_id", "event_time_ns")


def provider_truncation(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """(stream, side) of streams whose first event is after the requested start or whose last is before the end."""
    s = events.groupBy("source", "venue", "instrument_id").agg(F.min("event_time_ns").alias("lo"), F.max("event_time_ns").alias("hi"))
    sides = F.explode(F.array_compact(F.array(F.when(F.col("lo") > start_ns, F.lit("start")), F.when(F.col("hi") < end_ns, F.lit("end"))))).alias("side")
    return s.select("instrument_id", sides)


def half_open_end(end_ns: int, interval_ns: int) -> int:
    """The last time that a point-labelled bar of a half-open request can have."""
    return end_ns - interval_ns


EVENT_LEVEL = ("timestamp_disorder", "receive_time_inversion", "duplicates", "timezone", "negative_receive_latency", "invalid_price_size", "sequence_gaps", "stale_book")


def event_counts(events: DataFrame, stale_after_ns: int, kinds: tuple[str, ...], block: int = 100_000, bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """(code, n) of the checks of single events and of neighbours.

    Rows are shuffled once by time bucket, for the order over all instruments, within streams and for duplicates (equal
    events lie in one bucket), and once by block of arrival. A task counts what it sees inside its buckets and blocks and
    keeps their first and last rows; what two neighbouring buckets or blocks do to each other is counted on these: a row per
    bucket and stream, or per block."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    row = F.struct(order_key().alias("k"), "arrival_ord", "sequence", "receive_time_ns")
    b = events.withColumn("_bucket", F.coalesce(F.expr(f"event_time_ns div {bucket_ns}"), F.lit(-1))).withColumn("_row", row)
    market, stream = W.partitionBy("_bucket").orderBy("_row"), W.partitionBy("_bucket", *STREAM).orderBy("_row")
    copies = W.partitionBy("_bucket", *MARKET_KEY).orderBy("receive_time_ns", "ingest_id", "arrival_ord")
    e = b.withColumn("_rn", F.row_number().over(copies)).withColumn("_m", F.lag("receive_time_ns").over(market)).withColumn("_s", F.lag(F.struct("sequence", "receive_time_ns")).over(stream))
    fields = [f for f in ("price", "size", "open", "high", "low", "close", "volume") if f in events.columns]
    bad = sum((F.coalesce(F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")) | (F.col(f) < 0) | ((F.col(f) == 0) & F.lit(f not in ZERO_ALLOWED)), F.lit(False)).cast("long") for f in fields), F.lit(0))
    book = F.col("event_type").isin(*kinds)
    inside = e.groupBy("_bucket", *STREAM).agg(
        count(F.col("receive_time_ns") < F.col("_m")).alias("receive_time_inversion"),
        count(F.col("_rn") > 1).alias("duplicates"),
        count(F.col("event_time_ns").isNull() | F.col("receive_time_ns").isNull()).alias("timezone"),
        count(F.col("receive_time_ns") < F.col("event_time_ns")).alias("negative_receive_latency"),
        F.sum(bad).cast("long").alias("invalid_price_size"),
        count(F.col("sequence") > F.col("_s.sequence") + 1).alias("sequence_gaps"),
        count(book & (F.col("receive_time_ns") - F.col("_s.receive_time_ns") > stale_after_ns)).alias("stale_book"),
        F.min("_row").alias("_first"),
        F.max("_row").alias("_last"),
    )
    before = lambda c: F.lag(F.col(f"_last.{c}")).over(W.partitionBy(*STREAM).orderBy("_bucket"))
    edges = inside.withColumns({
        "sequence_gaps": F.col("sequence_gaps") + F.coalesce((F.col("_first.sequence") > before("sequence") + 1).cast("long"), F.lit(0)),
        "stale_book": F.col("stale_book") + F.coalesce((book & (F.col("_first.receive_time_ns") - before("receive_time_ns") > stale_after_ns)).cast("long"), F.lit(0)),
    })
    names = EVENT_LEVEL[2:]
    buckets = edges.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in ("receive_time_inversion", *names)], F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    turned = F.coalesce((F.col("_first.receive_time_ns") < F.lag("_last.receive_time_ns").over(W.orderBy("_bucket"))).cast("long"), F.lit(0))  # a row per bucket
    counts = buckets.withColumn("receive_time_inversion", F.col("receive_time_inversion") + turned).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("receive_time_inversion", *names)])
    counts = counts.unpivot([], ["receive_time_inversion", *names], "code", "n")

    came = events.select(F.expr(f"arrival_ord div {block}").alias("_b"), F.struct("arrival_ord", "ingest_id").alias("_at"), order_key().alias("k"))
    came = came.withColumn("_prev", F.lag("k").over(W.partitionBy("_b").orderBy("_at")))
    blocks = came.groupBy("_b").agg(count(F.col("k") < F.col("_prev")).alias("n"), F.min(F.struct("_at", "k")).alias("_first"), F.max(F.struct("_at", "k")).alias("_last"))
    fell = F.coalesce((F.col("_first.k") < F.lag("_last.k").over(W.orderBy("_b"))).cast("long"), F.lit(0))  # a row per block
    disorder = blocks.select((F.col("n") + fell).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("timestamp_disorder").alias("code"), "n")
    return counts.unionByName(disorder)


def quality_summary(events: DataFrame, bars: DataFrame, gaps: DataFrame, books: DataFrame, requested: tuple[int, int], stale_after_ns: int, kinds: tuple[str, ...]) -> DataFrame:
    """(code, severity, n, verdict) of all fourteen checks, with 0 for those without hits; ``verdict`` is of the whole:
    an error or a critical hit blocks, warnings alone make it diagnostic only. gaps: interval_gaps() of the fixed-interval
    bars."""
    tally = lambda code, rows: rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    found = event_counts(events, stale_after_ns, kinds).unionByName(gaps.groupBy("code").agg(F.count("*").alias("n")))
    for code, rows in (("crossed_book", crossed_book(books)), ("outliers", outliers(bars)), ("provider_truncation", provider_truncation(events, *requested))):
        found = found.unionByName(tally(code, rows))
    row = found.agg(*[F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0)).alias(c) for c in SEVERITY])
    total = lambda kind: sum((F.col(c) for c, s in SEVERITY.items() if (s == "warning") == kind), F.lit(0))
    verdict = F.when(total(False) > 0, "blocked").when(total(True) > 0, "diagnostic_only").otherwise("none")
    codes = [F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.col(c).cast("long").alias("n")) for c, s in SEVERITY.items()]
    return row.select(F.explode(F.array(*codes)).alias("x"), verdict.alias("verdict")).select("x.*", "verdict")
