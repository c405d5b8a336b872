"""The driver's tables as canonical shapes: clean and corrupted events, bars, ladders, books, returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_NS, DAY_NS = 3_600_000_000_000, 86_400_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades of the instrument event_type, received a millisecond later; without sequence numbers."""
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(
        F.lit("synthetic").alias("source"),
        F.lit("web").alias("venue"),
        F.col("event_type").alias("instrument_id"),
        F.lit("trade").alias("event_type"),
        ns.alias("event_time_ns"),
        (ns + 1_000_000).alias("receive_time_ns"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ingest_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("arrival_ord"),
        F.col("user_id"),
    )


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tape() with a sequence number per instrument, counted from 1.

    Rows are numbered in days of an instrument, and a day begins behind the count of the days before it: a row per
    instrument and day. So a hot instrument is no single task."""
    t = tape(spark, sf_dir).withColumn("_day", F.expr(f"event_time_ns div {DAY_NS}"))
    days = t.groupBy("instrument_id", "_day").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("instrument_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    offset = days.select("instrument_id", "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("instrument_id", "_day").orderBy("event_time_ns", "arrival_ord"))
    numbered = t.withColumn("_in", inside).join(offset, ["instrument_id", "_day"])
    return numbered.select("source", "venue", "instrument_id", "event_type", "event_time_ns", "receive_time_ns", (F.col("_before") + F.col("_in")).cast("long").alias("sequence"), "ingest_id", "price", "size", "arrival_ord", "user_id")


CANON_SQL = """
SELECT 'synthetic' AS source, 'web' AS venue, event_type AS instrument_id, 'trade' AS event_type,
  epoch_us(ts) * 1000 AS event_time_ns, epoch_us(ts) * 1000 + 1000000 AS receive_time_ns,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sequence,
  lpad(event_id::VARCHAR, 12, '0') AS ingest_id, value AS price, (props->>'$.k')::DOUBLE AS size,
  event_id AS arrival_ord, user_id
FROM events"""


def canon_dirty(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """canon with gaps, duplicates, inversions, stale receipts, zero prices and disorder, by the event id's residues. A row
    gives itself and perhaps a copy: the tape is read and numbered once; who needs no sequence leaves the numbering out."""
    c = (canon(spark, sf_dir) if numbered else tape(spark, sf_dir)).where(F.col("arrival_ord") % 97 != 0)
    i = F.col("arrival_ord")
    receive = F.when(i % 89 == 0, F.col("event_time_ns") - 1).when(i % 79 == 0, F.col("event_time_ns") + 3 * HOUR_NS).otherwise(F.col("receive_time_ns"))
    changed = {"receive_time_ns": receive, "price": F.when(i % 83 == 0, 0.0).otherwise(F.col("price")), "arrival_ord": F.when(i % 73 == 0, i + 5).otherwise(i), "ingest_id": F.col("ingest_id")}
    copied = {n: F.col(n) for n in changed} | {"ingest_id": F.lpad((i + 1_000_000).cast("string"), 12, "0")}
    row = lambda values: F.struct(*[v.alias(n) for n, v in values.items()])
    rows = F.when(i % 101 == 0, F.array(row(changed), row(copied))).otherwise(F.array(row(changed)))
    out = c.withColumn("_x", F.explode(rows))
    return out.select(*[F.col(f"_x.{n}").alias(n) if n in changed else F.col(n) for n in c.columns])


DIRTY_SQL = f"""
SELECT source, venue, instrument_id, event_type, event_time_ns,
  CASE WHEN arrival_ord % 89 = 0 THEN event_time_ns - 1 WHEN arrival_ord % 79 = 0 THEN event_time_ns + {3 * HOUR_NS}
       ELSE receive_time_ns END AS receive_time_ns,
  sequence, ingest_id, CASE WHEN arrival_ord % 83 = 0 THEN 0.0 ELSE price END AS price, size,
  CASE WHEN arrival_ord % 73 = 0 THEN arrival_ord + 5 ELSE arrival_ord END AS arrival_ord, user_id
FROM canon WHERE arrival_ord % 97 <> 0
UNION ALL
SELECT source, venue, instrument_id, event_type, event_time_ns, receive_time_ns, sequence,
  lpad((arrival_ord + 1000000)::VARCHAR, 12, '0'), price, size, arrival_ord, user_id
FROM canon WHERE arrival_ord % 97 <> 0 AND arrival_ord % 101 = 0"""


def bars(spark: SparkSession, sf_dir: str, width_ns: int) -> DataFrame:
    """Bars of canon by instrument and time bucket."""
    c = tape(spark, sf_dir).withColumn("t", F.expr(f"event_time_ns div {width_ns} * {width_ns}"))
    key = F.struct("event_time_ns", "arrival_ord")
    return c.groupBy("instrument_id", F.col("t").alias("event_time_ns")).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trades"),
    )


def bars_sql(width_ns: int) -> str:
    return f"""
SELECT instrument_id, event_time_ns // {width_ns} * {width_ns} AS event_time_ns,
  arg_min(price, (event_time_ns, arrival_ord)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (event_time_ns, arrival_ord)) AS close, sum(size) AS volume, count(*) AS trades
FROM canon GROUP BY 1, 2"""


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask levels per part: a lineitem row is a level."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("book_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best levels of a book per instrument and hour: bids are the values of even events, asks those of odd ones."""
    c = tape(spark, sf_dir).withColumn("t", F.expr(f"event_time_ns div {HOUR_NS} * {HOUR_NS}"))
    even = F.col("arrival_ord") % 2 == 0
    return c.groupBy("instrument_id", F.col("t").alias("event_time_ns")).agg(F.array_compact(F.array(F.max(F.when(even, F.col("price"))))).alias("bids"), F.array_compact(F.array(F.min(F.when(~even, F.col("price"))))).alias("asks"))


def returns_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of the mean value: obs is the day's number from 0, variant the instrument."""
    c = tape(spark, sf_dir).withColumn("day", F.expr(f"event_time_ns div {DAY_NS}"))
    d = c.groupBy("instrument_id", "day").agg(F.avg("price").alias("m"))
    w = W.partitionBy("instrument_id").orderBy("day")
    d = d.withColumns({"ret": F.col("m") / F.lag("m").over(w) - 1, "obs": F.row_number().over(w) - 2})
    return d.where("ret IS NOT NULL").select("obs", F.col("instrument_id").alias("variant"), "ret")


RETURNS_SQL = f"""
SELECT obs, variant, ret FROM (
  SELECT instrument_id AS variant, row_number() OVER w - 2 AS obs, m / lag(m) OVER w - 1 AS ret
  FROM (SELECT instrument_id, event_time_ns // {DAY_NS} AS day, avg(price) AS m FROM canon GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY instrument_id ORDER BY day)) WHERE ret IS NOT NULL"""


def sql(body: str, *views: str) -> str:
    """Oracle text: the named views, then the body."""
    texts = {
        "canon": CANON_SQL,
        "dirty": DIRTY_SQL,
        "bars_h": bars_sql(HOUR_NS),
        "bars_d": bars_sql(DAY_NS),
        "rets": RETURNS_SQL,
    }
    names = ["canon"] * any(v in ("dirty", "bars_h", "bars_d", "rets") for v in views) + [v for v in views if v != "canon"]
    names = (["canon"] if "canon" in views and "canon" not in names else []) + names
    return ("WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in names) + "\n" if names else "") + body.strip()
