"""The canonical event: schema, order and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of event.
EVENT_TYPES = (
    "instrument_definition", "bar", "trade", "quote", "book_snapshot", "book_delta", "funding", "open_interest",
    "settlement", "decision", "simulated_order", "fill", "portfolio_snapshot",
)
#: A null sequence sorts after every number.
NO_SEQUENCE = 2**63 - 1
DAY_NS = 86_400_000_000_000

MONEY = T.DecimalType(38, 18)
LEVELS = T.ArrayType(T.StructType([T.StructField("price", MONEY), T.StructField("size", MONEY)]))
EVENT_SCHEMA = T.StructType(
    [T.StructField("schema_version", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "venue", "asset_class", "instrument_id", "event_type")]
    + [T.StructField(n, T.LongType()) for n in ("event_time_ns", "receive_time_ns", "sequence")]
    + [T.StructField(n, T.StringType()) for n in ("ingest_id", "raw_fingerprint", "payload_json")]
    + [T.StructField(n, MONEY) for n in ("price", "size", "open", "high", "low", "close", "volume")]
    + [T.StructField("bids", LEVELS), T.StructField("asks", LEVELS), T.StructField("arrival_ord", T.LongType())]
)
#: Keys of the two notions of identity: what a market event is, and what one ingested row is.
MARKET_KEY = ("source", "venue", "instrument_id", "event_type", "event_time_ns", "sequence")
ROW_KEY = (*MARKET_KEY, "ingest_id")


def canonical_order(arrival: bool = True) -> list[Column]:
    """Event time, then sequence (nulls last), receive time, ingest id; arrival order breaks what ties are left."""
    cols = [F.col("event_time_ns"), F.col("sequence").asc_nulls_last(), F.col("receive_time_ns"), F.col("ingest_id")]
    return cols + ([F.col("arrival_ord")] if arrival else [])


def order_key() -> Column:
    return F.struct("event_time_ns", F.coalesce("sequence", F.lit(NO_SEQUENCE)).alias("sequence"), "receive_time_ns", "ingest_id")


def validate_events(events: DataFrame) -> DataFrame:
    """Adds ``violations``: the names of the rules that a row breaks."""

    def rule(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(name))

    rules = [rule(f"empty_{c}", F.length(c) == 0) for c in ("source", "venue", "instrument_id", "ingest_id")]
    rules += [rule(f"negative_{c}", F.col(c) < 0) for c in ("event_time_ns", "receive_time_ns")]
    rules.append(F.when(F.col("sequence") < 0, F.lit("negative_sequence")))
    rules.append(rule("unknown_event_type", ~F.col("event_type").isin(*EVENT_TYPES)))
    if "raw_fingerprint" in events.columns:
        rules.append(rule("bad_fingerprint", ~F.col("raw_fingerprint").rlike("^[0-9a-f]{64}$")))
    return events.withColumn("violations", F.array_compact(F.array(*rules)))


def ordered_lag(events: DataFrame, columns: list[str], keys: tuple[str, ...] = (), bucket_ns: int = 3_600_000_000_000, prefix: str = "prev_") -> DataFrame:
    """Adds ``<prefix><column>`` of the event before in canonical order, of the same keys or (without keys) of all.

    A window over a key alone puts a hot instrument, and without keys the whole tape, into one task. Time buckets are
    windowed apart instead, and the first row of each takes what the last row of the bucket before it of the same key
    has: a summary of one row per key and bucket."""
    from pyspark.sql import Window as W

    b = events.withColumn("_bucket", F.expr(f"event_time_ns div {bucket_ns}"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*canonical_order("arrival_ord" in events.columns))
    lagged = b.select("*", F.row_number().over(inside).alias("_rn"), *[F.lag(c).over(inside).alias(f"_in_{c}") for c in columns])
    last = b.groupBy(*keys, "_bucket").agg(F.max(F.struct(order_key().alias("k"), *columns)).alias("z"))
    over = W.partitionBy(*keys).orderBy("_bucket")  # one row per key and bucket
    edge = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), *[F.lag(F.col(f"z.{c}")).over(over).alias(f"_edge_{c}") for c in columns])
    same = lagged["_bucket"] == edge["_b"]
    for k in keys:
        same = same & lagged[k].eqNullSafe(edge[f"_k_{k}"])
    out = lagged.join(edge, same, "left")
    value = lambda c: F.when(F.col("_rn") == 1, F.col(f"_edge_{c}")).otherwise(F.col(f"_in_{c}")).alias(f"{prefix}{c}")
    return out.select(*events.columns, *[value(c) for c in columns])
