"""Reading: filtered Parquet scans, JSON-lines events, archives, and the normalizers of three kinds of feed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import EVENT_TYPES, order_key

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def scan(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("*",), where: str | None = None, parameters: tuple = ()) -> DataFrame:
    """Parquet with projection and a predicate with positional parameters; both reach the scan."""
    if not paths:
        raise ValueError("a scan needs at least one path")
    if columns != ("*",) and not all(IDENTIFIER.match(c) for c in columns):
        raise ValueError("columns must be simple identifiers")
    if where and ";" in where:
        raise ValueError("a predicate is one expression")
    df = spark.read.parquet(*paths)
    if where:
        df = spark.sql(f"SELECT * FROM {{rows}} WHERE {where}", args=list(parameters), rows=df)
    return df.select(*columns)


def _broken_line():
    return F.raise_error(F.concat(F.lit("invalid event line: "), F.col("value"))).cast("string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a broken one fails with its text, an empty file is an error (seen by the
    files' sizes, without a second read)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    sizes = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if not sizes:
        raise ValueError(f"{path} holds no events")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.withColumn("_ok", F.when(F.col("x._bad").isNotNull(), _broken_line())).where("_ok IS NULL").select("x.*").drop("_bad")


def read_ordered_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict]:
    """Events of a JSON-lines file that must lie in canonical order, and the proof: rows, instruments and a digest that
    depends on the order of lines.

    Lines are compared with the one before in their split of the file, and the first line of a split with the last of the
    split before (a row per split). A line below its predecessor, and a file without lines, fail."""
    text = spark.read.text(path).where(F.trim("value") != "")
    at = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"))
    parsed = at.select("*", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    rows = parsed.withColumn("_ok", F.when(F.col("x._bad").isNotNull(), _broken_line())).where("_ok IS NULL").select("value", "_file", "_split", "_line", "x.*").drop("_bad")
    rows = rows.withColumn("_k", order_key())
    inside = W.partitionBy("_file", "_split").orderBy("_line")
    rows = rows.withColumns({"_prev": F.lag("_k").over(inside), "_in": F.row_number().over(inside)})
    ends = rows.groupBy("_file", "_split").agg(F.max_by("_k", "_line").alias("_last"), F.min_by("_k", "_line").alias("_first"), F.count("*").alias("_n"))
    files_ = W.orderBy("_file", "_split")  # a row per split
    ends = ends.select("_file", "_split", "_first", F.lag("_last").over(files_).alias("_edge"), F.coalesce(F.sum("_n").over(files_.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    j = rows.join(ends.select("_file", "_split", "_edge", "_before"), ["_file", "_split"])
    h = F.sha2(F.concat((F.col("_before") + F.col("_in")).cast("string"), F.lit("|"), F.col("value")), 256)
    below = F.col("_k") < F.when(F.col("_in") == 1, F.col("_edge")).otherwise(F.col("_prev"))
    proof = j.agg(
        F.count("*").alias("rows"),
        F.count(F.when(below, 1)).alias("disorder"),
        F.array_sort(F.collect_set("instrument_id")).alias("instruments"),
        F.sum(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"),
    ).first()
    if not proof["rows"]:
        raise ValueError(f"{path} holds no events")
    if proof["disorder"]:
        raise ValueError(f"{path}: {proof['disorder']} lines are below the line before them")
    return rows.drop("value", "_file", "_split", "_line", "_k", "_prev", "_in"), {k: proof[k] for k in ("rows", "instruments", "digest")}


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars: timestamp, open, high, low, close, volume."""
    return spark.read.schema("timestamp string, open double, high double, low double, close double, volume double").option("header", True).csv(path)


def in_range(rows: DataFrame, start_ns: int, end_ns: int, time: str = "event_time_ns") -> DataFrame:
    """start <= time < end."""
    return rows.where((F.col(time) >= start_ns) & (F.col(time) < end_ns))


def of_types(rows: DataFrame, *kinds: str) -> DataFrame:
    """Events of the given types."""
    if unknown := set(kinds) - set(EVENT_TYPES):
        raise ValueError(f"no such event types: {', '.join(sorted(unknown))}")
    return rows.where(F.col("event_type").isin(*kinds))


def point_in_time(rows: DataFrame, decision: Column | int) -> DataFrame:
    """What had been received when the decision was made: the receive time counts, not the event time."""
    return rows.where(F.col("receive_time_ns") <= decision)


def read_archive(spark: SparkSession, path: str, instrument: str, start_ns: int, end_ns: int, limit: int, lines: bool = False) -> DataFrame:
    """A JSON array of futures events (``lines``: an object a line, which many tasks can read): one instrument, a half-open
    range, the first ``limit`` rows in time order."""
    schema = "event_type string, venue string, instrument_id string, event_time_ns long, receive_time_ns long, sequence long, payload map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return in_range(rows.where(F.col("instrument_id") == instrument), start_ns, end_ns).orderBy("event_time_ns", "sequence").limit(limit)


def normalize_archive(rows: DataFrame, default_receive_ns: int | None = None) -> DataFrame:
    """Payload numbers as decimals, a receive time, and an ingest id from the row's hash."""
    money = lambda c: F.col("payload")[c].cast("decimal(38,18)").alias(c)
    text = F.to_json(F.struct("event_time_ns", "event_type", "instrument_id", "payload", "sequence", "venue"))
    receive = F.coalesce("receive_time_ns", F.lit(default_receive_ns).cast("long"))
    return rows.select(F.lit("archive").alias("source"), "venue", "instrument_id", "event_type", "event_time_ns", receive.alias("receive_time_ns"), "sequence", F.substring(F.sha2(text, 256), 1, 24).alias("ingest_id"), F.sha2(text, 256).alias("raw_fingerprint"), *[money(c) for c in ("open", "high", "low", "close", "volume", "price", "size")])


def normalize_klines(rows: DataFrame, instrument: str | Column, receive_ns: int) -> DataFrame:
    """Positional kline arrays (``k``, text) as bars; a bar that closes after it was received is dropped."""
    at = lambda i: F.col("k")[i]
    money = lambda i, n: at(i).cast("decimal(38,18)").alias(n)
    b = rows.select((F.lit(instrument) if isinstance(instrument, str) else instrument).alias("instrument_id"), F.lit("bar").alias("event_type"), (at(0).cast("long") * 1_000_000).alias("event_time_ns"), money(1, "open"), money(2, "high"), money(3, "low"), money(4, "close"), money(5, "volume"), (at(6).cast("long") * 1_000_000).alias("close_time_ns"), money(7, "quote_volume"), at(8).cast("long").alias("trades"))
    return b.withColumn("receive_time_ns", F.lit(receive_ns)).where("close_time_ns <= receive_time_ns")


def normalize_trades(rows: DataFrame, instrument: str, receive_ns: int) -> DataFrame:
    """Aggregate trades (a, p, q, T, m) as trade events; the trade number is the sequence."""
    return rows.select(F.lit(instrument).alias("instrument_id"), F.lit("trade").alias("event_type"), (F.col("T") * 1_000_000).alias("event_time_ns"), F.lit(receive_ns).alias("receive_time_ns"), F.col("a").alias("sequence"), F.concat(F.lit(f"trade-{instrument}-"), F.col("a").cast("string")).alias("ingest_id"), F.col("p").cast("decimal(38,18)").alias("price"), F.col("q").cast("decimal(38,18)").alias("size"), F.col("m").alias("buyer_maker"))


def normalize_depth(rows: DataFrame, instrument: str, receive_ns: int) -> DataFrame:
    """Depth responses (lastUpdateId, bids, asks as text pairs) as book snapshots at the receive time."""
    levels = lambda c: F.transform(c, lambda x: F.struct(x[0].cast("decimal(38,18)").alias("price"), x[1].cast("decimal(38,18)").alias("size"))).alias(c)
    return rows.select(F.lit(instrument).alias("instrument_id"), F.lit("book_snapshot").alias("event_type"), F.lit(receive_ns).alias("event_time_ns"), F.lit(receive_ns).alias("receive_time_ns"), F.col("lastUpdateId").alias("sequence"), F.concat(F.lit(f"book-{instrument}-"), F.col("lastUpdateId").cast("string")).alias("ingest_id"), levels("bids"), levels("asks"))


def futures_definitions(rows: DataFrame) -> DataFrame:
    """Definition rows as the instrument dimension; tick, lot and multiplier must be positive."""
    money = lambda c: F.col(c).cast("decimal(38,18)").alias(c)
    d = rows.select("instrument_id", "symbol", "venue", money("tick_size"), money("lot_size"), money("multiplier"), "quote_currency", "expiry", "margin_mode")
    bad = (F.col("tick_size") <= 0) | (F.col("lot_size") <= 0) | (F.col("multiplier") <= 0)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("invalid instrument "), "instrument_id")).cast("string")).otherwise(F.col("instrument_id"))
    return d.withColumn("instrument_id", checked)


def normalize_prediction(rows: DataFrame, receive_ns: int) -> DataFrame:
    """Prediction-market history: times below 1e15 are milliseconds; a time before 2020 or over a day ahead fails."""
    ns = F.when(F.col("t") < 10**15, F.col("t") * 1_000_000).otherwise(F.col("t"))
    bad = (ns < 1_577_836_800_000_000_000) | (ns > receive_ns + 86_400_000_000_000)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("timestamp out of range: "), F.col("t").cast("string"))).cast("long")).otherwise(ns)
    return rows.select("instrument_id", checked.alias("event_time_ns"), F.lit(receive_ns).alias("receive_time_ns"), F.col("p").cast("decimal(38,18)").alias("price"))


def trading_symbols(info: DataFrame) -> DataFrame:
    """Instruments of an exchange's listing: those that trade, with tick and lot from their filters."""
    pick = lambda kind, field: F.get(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(0))[field].cast("decimal(38,18)")
    return info.where("status = 'TRADING'").select(F.col("symbol").alias("instrument_id"), pick("PRICE_FILTER", "tickSize").alias("tick_size"), pick("LOT_SIZE", "stepSize").alias("lot_size"))


def outcome_tokens(markets: DataFrame) -> DataFrame:
    """A row per outcome of markets whose outcome and token lists are JSON in text."""
    z = F.arrays_zip(F.from_json("clobTokenIds", "array<string>").alias("token"), F.from_json("outcomes", "array<string>").alias("outcome"))
    return markets.select("market", F.explode(z).alias("z")).select("market", F.col("z").getField("token").alias("instrument_id"), F.col("z").getField("outcome").alias("outcome"))


class _Chunk(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class KlineReader(DataSourceReader):
    """A partition per time chunk; pages go on a millisecond after the last opening time; rows at or after the end go."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        start, end, chunk = (int(self.options[k]) for k in ("start_ms", "end_ms", "chunk_ms"))
        return [_Chunk(s, min(s + chunk, end)) for s in range(start, end, chunk)]

    def read(self, partition) -> Iterator[tuple]:
        page, cursor = int(self.options.get("page", "1000")), partition.start
        rows = self._fixture()
        while cursor < partition.end:
            got = [r for r in rows if cursor <= r[0]][:page]
            if not got:
                return
            for r in got:
                if r[0] < partition.end:
                    yield ([str(v) for v in r],)
            cursor = got[-1][0] + 1

    def _fixture(self) -> list[list]:
        """Offline: a JSON array in a file. A client for a live endpoint overrides this with a paged, rate-limited GET."""
        with open(self.options["path"]) as f:
            return sorted(json.load(f), key=lambda r: r[0])


class KlineSource(DataSource):
    """spark.read.format("klines"): options path, start_ms, end_ms, chunk_ms, page."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "k array<string>"

    def reader(self, schema) -> DataSourceReader:
        return KlineReader(self.options)
