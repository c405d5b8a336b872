"""Registry of the engine's queries over the driver's tables, each with DuckDB SQL for the same rows.

Every query runs over its whole tables. Constants are parameters of the operators, written once and put into both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables, values
from ..model import canonical_order
from ..operators import baselines, consistency, features, fills, gates, lookups, metrics, oos, quality, recompute, replay, risk, rowprint, screen, sweep
from ..sources import feeds, files
from ..sources import views as V
from ..streaming import observe
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = V.HOUR_NS, V.DAY_NS
#: The requested interval of the event tables: 30 days from 2024-01-01.
START = 1_704_067_200_000_000_000
END = START + 30 * DAY
INSTRUMENTS = 5


def query(oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function's name; ``oracle`` is SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = V.sql(oracle, *views)
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


# ---- scans, filters, plans ----


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01'")
def scan_filter(spark, d):
    return files.scan(spark, [f"{d}/lineitem.parquet"], ("l_orderkey", "l_partkey", "l_quantity"), "l_quantity > ? AND l_returnflag = ? AND l_shipdate >= timestamp '1995-01-01'", (30.0, "R"))


@query(f"SELECT instrument_id, ingest_id, event_time_ns FROM canon WHERE receive_time_ns <= {START + 10 * DAY}", ("canon",))
def point_in_time(spark, d):
    return files.point_in_time(V.tape(spark, d), F.lit(START + 10 * DAY)).select("instrument_id", "ingest_id", "event_time_ns")


@query(f"SELECT ingest_id, event_time_ns FROM canon WHERE event_time_ns >= {START + DAY} AND event_time_ns < {START + 3 * DAY}", ("canon",))
def half_open_range(spark, d):
    return files.in_range(V.tape(spark, d), START + DAY, START + 3 * DAY).select("ingest_id", "event_time_ns")


@query("SELECT ingest_id, event_time_ns, price FROM canon WHERE instrument_id = 'purchase' ORDER BY event_time_ns, sequence LIMIT 100", ("canon",))
def archive_limit(spark, d):
    return V.tape(spark, d).where("instrument_id = 'purchase'").orderBy("event_time_ns", "arrival_ord").select("ingest_id", "event_time_ns", "price").limit(100)


@query("SELECT ingest_id, event_time_ns, instrument_id, price FROM dirty", ("dirty",))
def canonical_sort(spark, d):
    """The tape in canonical order: sampled ranges of time, each sorted by itself."""
    return V.canon_dirty(spark, d).orderBy(*canonical_order()).select("ingest_id", "event_time_ns", "instrument_id", "price")


@query("SELECT instrument_id, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d') AS date, count(*) AS rows FROM canon GROUP BY 1, 2", ("canon",))
def parquet_commit(spark, d):
    """The tape as immutable partitions, and the rows that each of them has when it is read back."""
    import uuid

    from ..session import local_dir
    from ..sources import sinks

    root = f"{local_dir(spark)}/tape-{uuid.uuid4().hex}"
    sinks.write_events(V.canon(spark, d), root)
    return spark.read.parquet(root).groupBy("instrument_id", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("rows"))


@query("SELECT DISTINCT instrument_id FROM canon", ("canon",))
def distinct_instruments(spark, d):
    return V.tape(spark, d).select("instrument_id").distinct()


@query("SELECT event_type AS kind, count(*) AS n FROM dirty GROUP BY 1 UNION ALL SELECT instrument_id, count(*) FROM dirty GROUP BY 1", ("dirty",))
def event_histogram(spark, d):
    c = V.canon_dirty(spark, d, numbered=False)
    two = c.groupingSets([["event_type"], ["instrument_id"]], "event_type", "instrument_id").agg(F.count("*").alias("n"))
    return two.select(F.coalesce("event_type", "instrument_id").alias("kind"), "n")


ROW = ["source", "venue", "instrument_id", "event_type", "event_time_ns", "sequence", "ingest_id", "receive_time_ns", "price", "size"]


def _twice(spark, d):
    c = V.canon_dirty(spark, d)
    return c.unionByName(c.where("arrival_ord % 7 = 0"))


@query("SELECT ingest_id, event_time_ns, price, (1 + (arrival_ord % 7 = 0)::INT)::BIGINT AS copies FROM dirty", ("dirty",))
def dedup_identity(spark, d):
    kept, _ = lookups.dedup_rows(_twice(spark, d), ROW)
    return kept.select("ingest_id", "event_time_ns", "price", "copies")


@query("SELECT ingest_id, 2::BIGINT AS variants FROM dirty WHERE arrival_ord % 11 = 0", ("dirty",))
def dedup_conflicts(spark, d):
    c = V.canon_dirty(spark, d)
    _, bad = lookups.dedup_rows(c.unionByName(c.where("arrival_ord % 11 = 0").withColumn("price", F.col("price") + 1)), ROW)
    return bad.select("ingest_id", "variants")


@query(f"SELECT 'chunk-' || lpad(i::VARCHAR, 6, '0') AS chunk_id, {START} + i * {7 * HOUR} AS start_ns, least({START} + (i + 1) * {7 * HOUR}, {END}) AS end_ns FROM range({math.ceil(30 * DAY / (7 * HOUR))}) t(i)")
def chunk_plan(spark, d):
    return lookups.chunk_plan(spark, START, END, 7 * HOUR)


@query(f"SELECT 'chunk-' || lpad(i::VARCHAR, 6, '0') AS chunk_id, {START} + i * {DAY} AS start_ns, {START} + (i + 1) * {DAY} AS end_ns FROM range(30) t(i) WHERE i IN (4, 10, 30)")
def dataset_cover(spark, d):
    plan = lookups.chunk_plan(spark, START, END, DAY)
    return lookups.cover_problems(plan.where("chunk_id NOT IN ('chunk-000003', 'chunk-000009')"), START, END)


@query(
    f"""SELECT chunk_id, CASE WHEN start_ns IS NULL THEN 'unplanned' WHEN r.n IS NULL THEN 'missing' ELSE 'different' END AS problem
FROM (SELECT 'chunk-' || lpad(i::VARCHAR, 6, '0') AS chunk_id, {START} + i * {DAY} AS start_ns,
        (SELECT count(*) FROM canon WHERE event_time_ns // {DAY} = {START // DAY} + i) AS n FROM range(30) t(i)) p
FULL JOIN (SELECT 'chunk-' || lpad((event_time_ns // {DAY} - {START // DAY})::VARCHAR, 6, '0') AS chunk_id, count(*) AS n FROM canon WHERE arrival_ord % 997 <> 0 GROUP BY 1) r USING (chunk_id)
WHERE r.n IS DISTINCT FROM p.n""",
    ("canon",),
)
def chunk_receipts(spark, d):
    c = V.tape(spark, d).withColumn("chunk_id", F.format_string("chunk-%06d", F.expr(f"event_time_ns div {DAY} - {START // DAY}")))
    plan = lookups.chunk_plan(spark, START, END, DAY).join(c.groupBy("chunk_id").agg(F.count("*").alias("rows")), "chunk_id", "left").fillna({"rows": 0})
    return lookups.chunk_receipts(plan, c.where("arrival_ord % 997 <> 0").groupBy("chunk_id").agg(F.count("*").alias("rows")))


@query("SELECT source, count(*) AS n, min(event_time_ns) AS first_ns, max(event_time_ns) AS last_ns, count(DISTINCT instrument_id) AS instruments FROM dirty GROUP BY 1", ("dirty",))
def coverage_manifest(spark, d):
    return lookups.coverage(V.canon_dirty(spark, d, numbered=False))


@query("""SELECT count(*) AS n, sum(('0x' || substr(sha256('{"ingest_id":"' || ingest_id || '","event_time_ns":' || event_time_ns::VARCHAR || '}'), 1, 15))::HUGEINT)::VARCHAR AS digest FROM dirty""", ("dirty",))
def order_free_digest(spark, d):
    return lookups.order_free_digest(V.canon_dirty(spark, d, numbered=False), ["ingest_id", "event_time_ns"])


@query("SELECT o_orderkey, o_totalprice AS old, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 END AS new FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 9 = 0")
def key_diff(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    after = o.where("NOT (o_orderkey % 9 = 0 AND o_orderkey % 5 <> 0)").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return lookups.key_diff(o, after, "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def subset_missing(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey")
    return lookups.missing_from(c, V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def prior_gate(spark, d):
    passed = V.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    o = V.table(spark, d, "orders")
    return o.join(passed, o["o_orderkey"] == passed["l_orderkey"], "left_semi").select("o_orderkey")


# ---- sources and normalizers ----


def _scratch(spark, name):
    import uuid

    from ..session import local_dir

    return f"{local_dir(spark)}/{name}-{uuid.uuid4().hex}"


LINE = "source string, venue string, instrument_id string, event_type string, event_time_ns long, receive_time_ns long, sequence long, ingest_id string, price double, size double"


@query("SELECT instrument_id, event_type, event_time_ns, receive_time_ns, sequence, ingest_id, price, size FROM canon", ("canon",))
def jsonl_events(spark, d):
    """The tape as JSON lines, read back."""
    path = _scratch(spark, "lines")
    V.canon(spark, d).select(*[c.split()[0] for c in LINE.split(", ")]).write.json(path)
    return files.read_jsonl(spark, path, LINE).drop("source", "venue")


@query("SELECT count(*) AS rows, array_to_string(list_sort(list(DISTINCT instrument_id)), ',') AS instruments FROM canon", ("canon",))
def jsonl_order_proof(spark, d):
    """Rows and instruments of files that are in canonical order one after the other; a tape that is not fails."""
    path = _scratch(spark, "ordered")
    V.canon(spark, d).select(*[c.split()[0] for c in LINE.split(", ")]).orderBy(*canonical_order(False)).write.json(path)
    rows, proof = files.read_ordered_jsonl(spark, path, LINE)
    return rows.agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("instrument_id")), ",").alias("instruments")).where((F.col("rows") == proof["rows"]) & (F.col("instruments") == ",".join(proof["instruments"])))


@query("SELECT instrument_id, ingest_id, event_time_ns FROM canon WHERE event_type = 'trade' AND instrument_id IN ('view', 'click') AND event_time_ns >= " + str(START + DAY), ("canon",))
def event_type_filter(spark, d):
    t = files.of_types(V.tape(spark, d).where(F.col("instrument_id").isin("view", "click")), "trade")
    return files.in_range(t, START + DAY, 2**62).select("instrument_id", "ingest_id", "event_time_ns")


@query(f"SELECT instrument_id, event_time_ns, round(open, 6) AS open, round(close, 6) AS close, volume, trades FROM bars_h WHERE event_time_ns + {HOUR} - 1000000 <= {START + 20 * DAY}", ("bars_h",))
def spot_bars(spark, d):
    """Positional klines as bars; those that were not closed when they were received are dropped."""
    ms = lambda c: F.expr(f"({c}) div 1000000").cast("string")
    text = lambda c: F.col(c).cast("string")
    k = V.bars(spark, d, HOUR).select("instrument_id", F.array(ms("event_time_ns"), text("open"), text("high"), text("low"), text("close"), text("volume"), ms(f"event_time_ns + {HOUR} - 1000000"), F.lit("0"), text("trades")).alias("k"))
    out = files.normalize_klines(k, F.col("instrument_id"), START + 20 * DAY)
    return out.select("instrument_id", "event_time_ns", *r6("open", "close"), F.col("volume").cast("double").alias("volume"), "trades")


@query("SELECT 'trade-X-' || event_id AS ingest_id, event_id AS sequence, epoch_us(ts) // 1000 * 1000000 AS event_time_ns, value AS price, (props->>'$.k')::DOUBLE AS size, event_id % 2 = 0 AS buyer_maker FROM events")
def spot_trades(spark, d):
    e = V.tape(spark, d).select(F.col("arrival_ord").alias("a"), F.col("price").cast("string").alias("p"), F.col("size").cast("string").alias("q"), F.expr("event_time_ns div 1000000").alias("T"), (F.col("arrival_ord") % 2 == 0).alias("m"))
    return files.normalize_trades(e, "X", START).select("ingest_id", "sequence", "event_time_ns", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), "buyer_maker")


@query("SELECT 'book-X-' || p_partkey AS ingest_id, p_partkey AS sequence, 900.0 + p_size AS best_bid, 901.5 + p_size AS best_ask, 3.0::DOUBLE AS ask_size FROM part")
def spot_books(spark, d):
    pair = lambda price, size: F.array(F.format_string("%.2f", price), F.lit(size))
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("lastUpdateId"), F.array(pair(F.col("p_size") + 900.0, "1"), pair(F.col("p_size") + 899.0, "2")).alias("bids"), F.array(pair(F.col("p_size") + 901.5, "3")).alias("asks"))
    b = files.normalize_depth(rows, "X", START)
    return b.select("ingest_id", "sequence", F.col("bids")[0]["price"].cast("double").alias("best_bid"), F.col("asks")[0]["price"].cast("double").alias("best_ask"), F.col("asks")[0]["size"].cast("double").alias("ask_size"))


@query("SELECT instrument_id, CASE WHEN arrival_ord % 2 = 0 THEN event_time_ns // 1000000 * 1000000 ELSE event_time_ns END AS event_time_ns, price FROM canon", ("canon",))
def prediction_prices(spark, d):
    """Times in milliseconds or nanoseconds, told apart by their size."""
    t = V.tape(spark, d).select("instrument_id", F.when(F.col("arrival_ord") % 2 == 0, F.expr("event_time_ns div 1000000")).otherwise(F.col("event_time_ns")).alias("t"), F.col("price").alias("p"))
    return files.normalize_prediction(t, END + DAY).select("instrument_id", "event_time_ns", F.col("price").cast("double").alias("price"))


@query("SELECT 'P' || p_partkey AS instrument_id, 0.01::DOUBLE AS tick_size, p_size / 1000.0 AS lot_size FROM part WHERE p_partkey % 3 = 0")
def spot_symbols(spark, d):
    """Listed instruments that trade, with tick and lot from their lists of filters."""
    f = lambda kind, tick, step: F.struct(F.lit(kind).alias("filterType"), tick.alias("tickSize"), step.alias("stepSize"))
    none, lot = F.lit(None).cast("string"), F.format_string("%.3f", F.col("p_size") / 1000.0)
    rows = V.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.when(F.col("p_partkey") % 3 == 0, "TRADING").otherwise("BREAK").alias("status"), F.array(f("LOT_SIZE", none, lot), f("PRICE_FILTER", F.lit("0.01"), none)).alias("filters"))
    return files.trading_symbols(rows).select("instrument_id", F.col("tick_size").cast("double").alias("tick_size"), F.col("lot_size").cast("double").alias("lot_size"))


@query("SELECT 'm' || n_nationkey AS market, n_nationkey || side AS instrument_id, outcome FROM nation, (VALUES ('y', 'Yes'), ('n', 'No')) t(side, outcome)")
def prediction_outcomes(spark, d):
    """A row per outcome of markets that list tokens and outcomes as JSON in text."""
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    return files.outcome_tokens(n.select(F.concat(F.lit("m"), "k").alias("market"), F.format_string('["%sy","%sn"]', "k", "k").alias("clobTokenIds"), F.lit('["Yes","No"]').alias("outcomes")))


@query("SELECT 'F' || p_partkey AS instrument_id, 0.25::DOUBLE AS tick_size, 50.0 + p_size AS multiplier FROM part")
def futures_dimension(spark, d):
    p = V.table(spark, d, "part").select(F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("instrument_id"), F.lit("ES").alias("symbol"), F.lit("X").alias("venue"), F.lit("0.25").alias("tick_size"), F.lit("1").alias("lot_size"), (F.col("p_size") + 50).cast("string").alias("multiplier"), F.lit("USD").alias("quote_currency"), F.lit(None).cast("string").alias("expiry"), F.lit(None).cast("string").alias("margin_mode"))
    return files.futures_definitions(p).select("instrument_id", F.col("tick_size").cast("double").alias("tick_size"), F.col("multiplier").cast("double").alias("multiplier"))


@query(f"SELECT event_time_ns, sequence, price, size FROM canon WHERE instrument_id = 'view' AND event_time_ns >= {START + DAY} AND event_time_ns < {START + 9 * DAY} ORDER BY event_time_ns, sequence LIMIT 500", ("canon",))
def futures_archive(spark, d):
    """A JSON archive of futures trades: one instrument, a half-open range, the first rows in order (the limit is the
    source's own)."""
    path = _scratch(spark, "archive")
    payload = F.create_map(F.lit("price"), F.col("price").cast("string"), F.lit("size"), F.col("size").cast("string"))
    V.canon(spark, d).select("event_type", "venue", "instrument_id", "event_time_ns", "receive_time_ns", "sequence", payload.alias("payload")).write.json(path)
    rows = files.normalize_archive(files.read_archive(spark, path, "view", START + DAY, START + 9 * DAY, 500, lines=True))
    return rows.select("event_time_ns", "sequence", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))


@query("SELECT count(*) AS event_count, 0::BIGINT AS problems FROM canon WHERE instrument_id = 'purchase'", ("canon",))
def ingest_bundle(spark, d):
    """A bundle that is published whole, and what its validation finds: nothing."""
    from ..sources import ingest

    path = _scratch(spark, "bundle")
    e = V.canon(spark, d).where("instrument_id = 'purchase'")
    receipt = ingest.publish(path, [], {"instrument": "purchase"}, e, spark.createDataFrame([("duplicates", 0)], "code string, n long"))
    return spark.range(1).select(F.lit(receipt["event_count"]).cast("long").alias("event_count"), F.lit(len(ingest.bundle_problems(spark, path))).cast("long").alias("problems"))


# ---- quality ----


@query(
    """SELECT arrival_ord, ingest_id FROM (SELECT *, lag(e) OVER w AS pe, lag(s) OVER w AS ps, lag(r) OVER w AS pr, lag(ingest_id) OVER w AS pi
  FROM (SELECT *, event_time_ns AS e, sequence AS s, receive_time_ns AS r FROM dirty) WINDOW w AS (ORDER BY arrival_ord, ingest_id))
WHERE pe IS NOT NULL AND (e, s, r, ingest_id) < (pe, ps, pr, pi)""",
    ("dirty",),
)
def quality_timestamp_disorder(spark, d):
    return quality.timestamp_disorder(V.canon_dirty(spark, d), block=4096)


@query(
    """SELECT arrival_ord, ingest_id FROM (SELECT *, lag(receive_time_ns) OVER (ORDER BY event_time_ns, sequence, receive_time_ns, ingest_id, arrival_ord) AS p FROM dirty) WHERE receive_time_ns < p""",
    ("dirty",),
)
def quality_receive_time_inversion(spark, d):
    return quality.receive_time_inversion(V.canon_dirty(spark, d))


@query(
    """SELECT arrival_ord, ingest_id, first_ingest_id FROM (SELECT *, row_number() OVER w AS rn, first(ingest_id) OVER w AS first_ingest_id FROM dirty
  WINDOW w AS (PARTITION BY source, venue, instrument_id, event_type, event_time_ns, sequence ORDER BY receive_time_ns, ingest_id, arrival_ord)) WHERE rn > 1""",
    ("dirty",),
)
def quality_duplicates(spark, d):
    return quality.duplicates(V.canon_dirty(spark, d))


@query("SELECT arrival_ord, ingest_id FROM dirty WHERE arrival_ord % 103 = 0 OR arrival_ord % 107 = 0", ("dirty",))
def quality_timezone(spark, d):
    """Rows without a time in nanoseconds: here those that lost one of theirs."""
    lost = lambda c, k: F.when(F.col("arrival_ord") % k != 0, F.col(c))
    c = V.canon_dirty(spark, d, numbered=False)
    return quality.timezone(c.withColumns({"event_time_ns": lost("event_time_ns", 103), "receive_time_ns": lost("receive_time_ns", 107)}))


@query("SELECT arrival_ord, ingest_id FROM dirty WHERE receive_time_ns < event_time_ns", ("dirty",))
def quality_negative_receive_latency(spark, d):
    return quality.negative_receive_latency(V.canon_dirty(spark, d, numbered=False))


@query("SELECT arrival_ord, ingest_id, 'price' AS field FROM dirty WHERE price <= 0 UNION ALL SELECT arrival_ord, ingest_id, 'size' FROM dirty WHERE size < 0", ("dirty",))
def quality_invalid_price_size(spark, d):
    return quality.invalid_price_size(V.canon_dirty(spark, d, numbered=False))


@query(
    f"""SELECT instrument_id, event_time_ns FROM (SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS event_time_ns,
  max(price) FILTER (arrival_ord % 2 = 0) AS bid, min(price) FILTER (arrival_ord % 2 = 1) AS ask FROM canon GROUP BY 1, 2) WHERE bid >= ask""",
    ("canon",),
)
def quality_crossed_book(spark, d):
    return quality.crossed_book(V.books(spark, d)).select("instrument_id", "event_time_ns")


W_STREAM = "WINDOW w AS (PARTITION BY instrument_id, event_type ORDER BY event_time_ns, sequence, receive_time_ns, ingest_id, arrival_ord)"


@query(f"SELECT instrument_id, arrival_ord, ingest_id, prev, sequence FROM (SELECT *, lag(sequence) OVER w AS prev FROM dirty {W_STREAM}) WHERE sequence > prev + 1", ("dirty",))
def quality_sequence_gaps(spark, d):
    return quality.sequence_gaps(V.canon_dirty(spark, d))


GAPS = f"""SELECT instrument_id, prev, event_time_ns, CASE
  WHEN (prev - {START}) // {DAY} % 7 IN (5, 6) AND (event_time_ns - {START}) // {DAY} % 7 IN (5, 6) AND (event_time_ns - {START}) // {7 * DAY} = (prev - {START}) // {7 * DAY} THEN 'session_gaps'
  WHEN prev >= {START + 8 * DAY} AND event_time_ns <= {START + 10 * DAY} THEN 'roll_gaps' ELSE 'missing_intervals' END AS code
FROM (SELECT *, lag(event_time_ns) OVER (PARTITION BY instrument_id ORDER BY event_time_ns) AS prev FROM (SELECT * FROM bars_h WHERE trades % 3 <> 1)) WHERE event_time_ns - prev > {HOUR}"""


def _gaps(spark, d, bars=None):
    sessions = [(START + (7 * k + 5) * DAY, START + (7 * k + 7) * DAY - 1) for k in range(5)]
    bars = V.bars(spark, d, HOUR) if bars is None else bars
    return quality.interval_gaps(bars.where("trades % 3 <> 1"), HOUR, sessions, [(START + 8 * DAY, START + 10 * DAY)])


for _code in ("missing_intervals", "session_gaps", "roll_gaps"):

    def _gap_query(spark, d, code=_code):
        return _gaps(spark, d).where(F.col("code") == code)

    _gap_query.__name__ = f"quality_{_code}"
    query(f"SELECT * FROM ({GAPS}) WHERE code = '{_code}'", ("bars_h",))(_gap_query)


@query(f"SELECT instrument_id, arrival_ord, ingest_id FROM (SELECT *, lag(receive_time_ns) OVER w AS p FROM dirty {W_STREAM}) WHERE receive_time_ns - p > {2 * HOUR}", ("dirty",))
def quality_stale_book(spark, d):
    return quality.stale_book(V.canon_dirty(spark, d), 2 * HOUR, ("trade",))


@query("SELECT instrument_id, event_time_ns FROM (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY event_time_ns) AS p FROM bars_h) WHERE p <> 0 AND abs(close / p - 1) > 0.5", ("bars_h",))
def quality_outliers(spark, d):
    return quality.outliers(V.bars(spark, d, HOUR))


@query(f"SELECT instrument_id, side FROM (SELECT instrument_id, min(event_time_ns) AS lo, max(event_time_ns) AS hi FROM dirty GROUP BY 1), (VALUES ('start'), ('end')) t(side) WHERE (side = 'start' AND lo > {START}) OR (side = 'end' AND hi < {END - HOUR})", ("dirty",))
def quality_provider_truncation(spark, d):
    return quality.provider_truncation(V.canon_dirty(spark, d, numbered=False), START, quality.half_open_end(END, HOUR))


@query()
def quality_summary(spark, d):
    events, bars = V.canon_dirty(spark, d), V.bars(spark, d, HOUR)
    requested = (START, quality.half_open_end(END, HOUR))
    return quality.quality_summary(events, bars, _gaps(spark, d, bars), V.books(spark, d), requested, 2 * HOUR, ("trade",))


def _summary_oracle() -> str:
    """Counts of the single checks' oracles."""
    whole = "SELECT 1 FROM (SELECT 1) WHERE false"  # the tape itself has all times
    parts = [f"SELECT '{c}' AS code, '{s}' AS severity, (SELECT count(*) FROM ({whole if c == 'timezone' else ORACLES[f'quality_{c}']})) AS n" for c, s in quality.SEVERITY.items()]
    return f"SELECT *, CASE WHEN sum(n) FILTER (severity <> 'warning') OVER () > 0 THEN 'blocked' WHEN sum(n) OVER () > 0 THEN 'diagnostic_only' ELSE 'none' END AS verdict FROM ({' UNION ALL '.join(parts)})"


ORACLES["quality_summary"] = _summary_oracle()


# ---- features ----


@query("SELECT instrument_id, event_time_ns, round(close / lag(close) OVER (PARTITION BY instrument_id ORDER BY event_time_ns) - 1, 6) AS return_1 FROM bars_h", ("bars_h",))
def bar_features(spark, d):
    return features.bar_returns(V.bars(spark, d, HOUR)).select("instrument_id", "event_time_ns", *r6("return_1"))


LOOKBACKS = (5, 10, 20)


def _screen_sql(signal: str, variants: str) -> str:
    return f""", x AS (SELECT v.variant_id, v.lookback, v.entry_z, instrument_id, event_time_ns, close,
    coalesce(close / lag(close) OVER w - 1, 0) AS ret, row_number() OVER w AS rn FROM bars_h, {variants} WINDOW w AS (PARTITION BY v.variant_id, instrument_id ORDER BY event_time_ns)),
s AS ({signal}),
t AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS prev FROM s WINDOW w AS (PARTITION BY variant_id, instrument_id ORDER BY event_time_ns)),
n AS (SELECT variant_id, instrument_id, prev * ret AS gross, abs(signal - prev) AS turn, prev * ret - abs(signal - prev) * 0.001 AS net FROM t)
SELECT variant_id, instrument_id, count(*) AS observations, round(sum(gross), 6) AS gross_return, round(sum(turn) * 0.001, 6) AS cost_return,
  round(sum(net), 6) AS net_return, round(sum(turn), 6) AS turnover, round(avg(net) / nullif(stddev_pop(net), 0) * sqrt(252), 6) AS sharpe FROM n GROUP BY 1, 2"""


def _framed(f: str, column: str = "close") -> str:
    return " ".join(f"WHEN {n} THEN CASE WHEN rn > {n} THEN {f}({column}) OVER (PARTITION BY variant_id, instrument_id ORDER BY event_time_ns ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END" for n in LOOKBACKS)


DONCHIAN = f"""SELECT * REPLACE (coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY variant_id, instrument_id ORDER BY event_time_ns), 0) AS signal) FROM (
  SELECT *, CASE WHEN close > hi THEN 1.0 WHEN close < lo THEN -1.0 END::DOUBLE AS signal FROM (
    SELECT *, CASE lookback {_framed('max')} END AS hi, CASE lookback {_framed('min')} END AS lo FROM x))"""
REVERSION = f"""SELECT *, coalesce(CASE WHEN z <= -entry_z THEN 1.0 WHEN z >= entry_z THEN -1.0 ELSE 0.0 END, 0.0)::DOUBLE AS signal FROM (
  SELECT *, (close - m) / nullif(sd, 0) AS z FROM (SELECT *, CASE lookback {_framed('avg')} END AS m, CASE lookback {_framed('stddev_pop')} END AS sd FROM x))"""


def _scored(x):
    return screen.score(x).select("variant_id", "instrument_id", "observations", *r6("gross_return", "cost_return", "net_return", "turnover", "sharpe"))


def _variants(spark, rows):
    return spark.createDataFrame(rows, "variant_id int, lookback int, entry_z double")


def _screen_oracle(signal, rows):
    values = ", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, b, c in rows)
    body = _screen_sql(signal, f"(VALUES {values}) v(variant_id, lookback, entry_z)")
    return "WITH canon AS (" + V.CANON_SQL + "), bars_h AS (" + V.bars_sql(HOUR) + ")" + body


DONCHIAN_ROWS = [(0, 5, 0.0), (1, 10, 0.0), (2, 20, 0.0)]
REVERSION_ROWS = [(0, 5, 1.0), (1, 10, 1.0), (2, 20, 1.5)]


@query()
def screen_donchian(spark, d):
    return _scored(screen.signals(V.bars(spark, d, HOUR), _variants(spark, DONCHIAN_ROWS), "donchian", lookbacks=list(LOOKBACKS)))


@query()
def screen_mean_reversion(spark, d):
    return _scored(screen.signals(V.bars(spark, d, HOUR), _variants(spark, REVERSION_ROWS), "mean_reversion", lookbacks=list(LOOKBACKS)))


@query()
def screen_buy_hold(spark, d):
    return _scored(screen.signals(V.bars(spark, d, HOUR), _variants(spark, [(0, 0, 0.0)]), "buy_hold"))


ORACLES |= {
    "screen_donchian": _screen_oracle(DONCHIAN, DONCHIAN_ROWS),
    "screen_mean_reversion": _screen_oracle(REVERSION, REVERSION_ROWS),
    "screen_buy_hold": _screen_oracle("SELECT *, 1.0::DOUBLE AS signal FROM x", [(0, 0, 0.0)]),
}


@query()
def screen_random(spark, d):
    b = V.bars(spark, d, HOUR)
    longest = b.groupBy("instrument_id").count().agg(F.max("count")).first()[0] or 0
    return _scored(screen.random_signals(b, [7, 8], longest))


ORACLES["screen_random"] = V.sql(
    f"""SELECT variant_id, instrument_id, count(*) AS observations, round(sum(gross), 6) AS gross_return, round(sum(turn) * 0.001, 6) AS cost_return, round(sum(gross - turn * 0.001), 6) AS net_return,
  round(sum(turn), 6) AS turnover, round(avg(gross - turn * 0.001) / nullif(stddev_pop(gross - turn * 0.001), 0) * sqrt(252), 6) AS sharpe FROM (
  SELECT variant_id, instrument_id, coalesce(lag(signal) OVER w, 0) * ret AS gross, abs(signal - coalesce(lag(signal) OVER w, 0)) AS turn
  FROM (SELECT instrument_id, row_number() OVER w - 1 AS j, coalesce(close / lag(close) OVER w - 1, 0) AS ret FROM bars_h WINDOW w AS (PARTITION BY instrument_id ORDER BY event_time_ns)) JOIN ({O.random_signals([7, 8])}) USING (j)
  WINDOW w AS (PARTITION BY variant_id, instrument_id ORDER BY j)) GROUP BY 1, 2""",
    "bars_h",
)


def _curve(spark, d):
    """Equity of holding one unit of each instrument's daily close, as a share of its first."""
    b = V.bars(spark, d, DAY)
    w = W.partitionBy("instrument_id").orderBy("event_time_ns")
    return b.select("instrument_id", "event_time_ns", (F.lit(1000.0) * F.col("close") / F.first("close").over(w)).alias("equity"))


CURVE = "curve AS (SELECT instrument_id, event_time_ns, 1000.0 * close / first(close) OVER (PARTITION BY instrument_id ORDER BY event_time_ns) AS equity FROM bars_d)"


@query()
def drawdown_curve(spark, d):
    return features.drawdowns(_curve(spark, d), ["instrument_id"]).select("instrument_id", "event_time_ns", *r6("peak", "drawdown"), "run")


DRAWDOWN = f"""dd AS (SELECT *, (peak - equity) / peak AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY instrument_id ORDER BY event_time_ns ROWS UNBOUNDED PRECEDING) AS peak FROM curve)),
runs AS (SELECT *, sum((drawdown > 0)::INT) OVER (PARTITION BY instrument_id, g ORDER BY event_time_ns ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, sum((drawdown <= 0)::INT) OVER (PARTITION BY instrument_id ORDER BY event_time_ns ROWS UNBOUNDED PRECEDING) AS g FROM dd))"""
_D = "WITH canon AS (" + V.CANON_SQL + "), bars_d AS (" + V.bars_sql(DAY) + "), " + CURVE
ORACLES["drawdown_curve"] = f"{_D}, {DRAWDOWN} SELECT instrument_id, event_time_ns, round(peak, 6) AS peak, round(drawdown, 6) AS drawdown, run FROM runs"


@query(
    """SELECT variant, place, obs, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY total, obs) AS place FROM (
  SELECT variant, obs, sum(ret) OVER w AS total, count(*) OVER w AS k FROM rets WINDOW w AS (PARTITION BY variant ORDER BY obs ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5) WHERE place <= 3""",
    ("rets",),
)
def worst_windows(spark, d):
    return features.worst_windows(V.returns_long(spark, d), ["variant"]).select("variant", "place", "obs", *r6("total"))


@query(
    """SELECT variant, round(abs(avg(ret)), 6) AS expected_shortfall FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ret, obs) AS rn, count(*) OVER (PARTITION BY variant) AS n FROM rets)
WHERE rn <= greatest(1, ceil(n * 0.05)) GROUP BY 1""",
    ("rets",),
)
def expected_shortfall(spark, d):
    return features.expected_shortfall(V.returns_long(spark, d), ["variant"]).select("variant", *r6("expected_shortfall"))


@query(
    """SELECT variant, n, round(rho, 6) AS rho, round(least(n, greatest(2.0, n * (1 - rho) / (1 + rho))), 6) AS effective_n FROM (
  SELECT variant, count(ret) AS n, least(0.99, greatest(-0.99, corr(ret, prev))) AS rho FROM (SELECT *, lag(ret) OVER (PARTITION BY variant ORDER BY obs) AS prev FROM rets) GROUP BY 1)""",
    ("rets",),
)
def autocorr_ess(spark, d):
    return features.autocorrelation(V.returns_long(spark, d), ["variant"]).select("variant", "n", *r6("rho", "effective_n"))


@query()
def equity_sampling(spark, d):
    return features.sampled(_curve(spark, d), 7, keys=("instrument_id",)).select("instrument_id", "event_time_ns", F.col("idx").cast("long").alias("idx"), *r6("equity"))


ORACLES["equity_sampling"] = f"""{_D} SELECT instrument_id, event_time_ns, idx, round(equity, 6) AS equity FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY event_time_ns) - 1 AS idx, count(*) OVER (PARTITION BY instrument_id) - 1 AS l FROM curve) WHERE idx % 7 = 0 OR idx = l"""


@query(f"SELECT instrument_id, event_time_ns, event_time_ns // {DAY} AS utc_day, round(close, 6) AS close, round(first(close) OVER (PARTITION BY instrument_id, event_time_ns // {DAY} ORDER BY event_time_ns), 6) AS day_start FROM bars_h", ("bars_h",))
def utc_day_baseline(spark, d):
    b = V.bars(spark, d, HOUR).select("instrument_id", "event_time_ns", "close")
    return features.day_baseline(b, "close", ("instrument_id",)).select("instrument_id", "event_time_ns", "utc_day", *r6("close", "day_start"))


@query(f"SELECT instrument_id, round(median(gap) / 1e9, 5) AS median_s, round({365.25 * 86400 * 1e9} / median(gap), 3) AS periods FROM (SELECT instrument_id, event_time_ns - lag(event_time_ns) OVER (PARTITION BY instrument_id ORDER BY event_time_ns) AS gap FROM (SELECT DISTINCT instrument_id, event_time_ns FROM canon)) WHERE gap IS NOT NULL GROUP BY 1", ("canon",))
def periods_per_year(spark, d):
    return features.periods_per_year(V.tape(spark, d), keys=("instrument_id",)).select("instrument_id", F.round(F.col("median_ns") / 1e9, 5).alias("median_s"), F.round("periods", 3).alias("periods"))


@query(
    """SELECT p.user_id, p.ingest_id, p.event_time_ns, v.ingest_id AS as_of_ingest_id, v.event_time_ns AS as_of_time
FROM (SELECT * FROM canon WHERE instrument_id = 'purchase') p ASOF LEFT JOIN (SELECT * FROM canon WHERE instrument_id = 'view') v ON p.user_id = v.user_id AND p.event_time_ns > v.event_time_ns""",
    ("canon",),
)
def asof_mark(spark, d):
    c = V.tape(spark, d)
    left = c.where("instrument_id = 'purchase'").select("user_id", "ingest_id", "event_time_ns")
    right = c.where("instrument_id = 'view'").select("user_id", "ingest_id", "event_time_ns")
    return features.as_of(left, right, ["user_id"], "event_time_ns", "event_time_ns", ["ingest_id"])


def _contracts(spark, d):
    """Daily bars of two contracts of a series (a customer tier): the volumes of the events' hours stand for contracts."""
    b = V.bars(spark, d, HOUR).where(F.col("instrument_id").isin("purchase", "view"))
    both = W.partitionBy("event_time_ns")
    b = b.withColumn("k", F.count(F.lit(1)).over(both)).where("k = 2")
    return b.select(F.lit("web").alias("series"), "instrument_id", "event_time_ns", "close", "volume")


@query()
def volume_roll(spark, d):
    return features.volume_roll(_contracts(spark, d)).select("series", "event_time_ns", "instrument_id", "rolled", *r6("raw_close"))


@query()
def back_adjust(spark, d):
    return features.volume_roll(_contracts(spark, d)).select("series", "event_time_ns", *r6("roll_adjustment", "signal_close"))


ROLL = f"""WITH RECURSIVE canon AS ({V.CANON_SQL}), bars_h AS ({V.bars_sql(HOUR)}),
t AS (SELECT event_time_ns, row_number() OVER (ORDER BY event_time_ns) AS i,
    max(close) FILTER (instrument_id = 'purchase') AS cp, max(close) FILTER (instrument_id = 'view') AS cv,
    max(volume) FILTER (instrument_id = 'purchase') AS vp, max(volume) FILTER (instrument_id = 'view') AS vv
  FROM bars_h WHERE instrument_id IN ('purchase', 'view') GROUP BY 1 HAVING count(*) = 2),
m(i, cur, wins, rolled, adj) AS (
  SELECT 1::BIGINT, CASE WHEN vp > vv THEN 'purchase' ELSE 'view' END, 0, false, 0.0::DOUBLE FROM t WHERE i = 1
  UNION ALL
  SELECT t.i, CASE WHEN beat AND wins = 1 THEN other ELSE cur END, CASE WHEN beat AND wins = 0 THEN 1 ELSE 0 END, beat AND wins = 1,
    adj + CASE WHEN beat AND wins = 1 THEN CASE cur WHEN 'view' THEN cv - cp ELSE cp - cv END ELSE 0 END
  FROM (SELECT t.*, m.cur, m.wins, m.adj, CASE m.cur WHEN 'view' THEN 'purchase' ELSE 'view' END AS other,
          CASE m.cur WHEN 'view' THEN vp > vv ELSE vv > vp END AS beat FROM t JOIN m ON t.i = m.i + 1) t)
SELECT 'web' AS series, event_time_ns, {{}} FROM m JOIN t USING (i)"""
ORACLES["volume_roll"] = ROLL.format("cur AS instrument_id, rolled, round(CASE cur WHEN 'view' THEN cv ELSE cp END, 6) AS raw_close")
ORACLES["back_adjust"] = ROLL.format("round(adj, 6) AS roll_adjustment, round(CASE cur WHEN 'view' THEN cv ELSE cp END + adj, 6) AS signal_close")


# ---- joins and lookups ----


@query(
    f"""SELECT count(*) AS matches, round(max(abs(close / m - 1) * 10000), 6) AS max_bps, CASE WHEN max(abs(close / m - 1) * 10000) <= 10 THEN 'pass' ELSE 'warning' END AS status
FROM bars_d JOIN (SELECT instrument_id, event_time_ns // {DAY} * {DAY} AS event_time_ns, avg(price) AS m FROM canon GROUP BY 1, 2) USING (instrument_id, event_time_ns)""",
    ("bars_d",),
)
def cross_check_bps(spark, d):
    ref = V.tape(spark, d).groupBy("instrument_id", F.expr(f"event_time_ns div {DAY} * {DAY}").alias("event_time_ns")).agg(F.avg("price").alias("close"), F.lit(0).alias("ord"))
    return lookups.cross_check_bps(V.bars(spark, d, DAY), ref, ["instrument_id", "event_time_ns"]).select("matches", *r6("max_bps"), "status")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * coalesce(p_size, 1), 6) AS notional FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def multiplier_lookup(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("price"), F.lit(1.0).alias("quantity"))
    parts = V.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("multiplier"))
    return lookups.multiplier_notional(li, parts, "p_partkey").select("l_orderkey", "l_linenumber", *r6("notional"))


@query(
    """SELECT o_orderkey AS intent_id, epoch_us(o_orderdate) * 1000 AS decision_ns, min(epoch_us(l_shipdate) * 1000) FILTER (l_shipdate > o_orderdate) AS receive_ns,
  (min(epoch_us(l_shipdate) * 1000) FILTER (l_shipdate > o_orderdate)) - epoch_us(o_orderdate) * 1000 AS latency_ns FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def first_evidence(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("intent_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("decision_ns"))
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("receive_ns"), F.col("l_linenumber").alias("evidence_id"), F.col("l_extendedprice").alias("price"))
    return fills.first_evidence(o, li, "k").select("intent_id", "decision_ns", "receive_ns", "latency_ns")


@query(
    """SELECT o_orderpriority, latency_ns AS p95_ns FROM (SELECT o_orderpriority, latency_ns, row_number() OVER (PARTITION BY o_orderpriority ORDER BY latency_ns) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM (SELECT o_orderpriority, epoch_us(l_shipdate) * 1000 - epoch_us(o_orderdate) * 1000 AS latency_ns FROM orders JOIN lineitem ON l_orderkey = o_orderkey)) WHERE rn - 1 = floor(0.95 * (n - 1))::BIGINT"""
)
def latency_p95(spark, d):
    o = V.table(spark, d, "orders")
    li = V.table(spark, d, "lineitem")
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderpriority", (ns("l_shipdate") - ns("o_orderdate")).alias("latency_ns"))
    return lookups.nearest_low(j, ["o_orderpriority"], "latency_ns", 0.95).select("o_orderpriority", F.col("latency_ns").alias("p95_ns"))


@query("SELECT start_ns, end_ns FROM (SELECT event_time_ns AS start_ns, receive_time_ns AS end_ns FROM dirty) WHERE " + " OR ".join(f"(start_ns >= {START + k * DAY} AND end_ns <= {START + k * DAY + 6 * HOUR})" for k in range(0, 30, 5)), ("dirty",))
def interval_containment(spark, d):
    allowed = spark.createDataFrame([(START + k * DAY, START + k * DAY + 6 * HOUR) for k in range(0, 30, 5)], "start_ns long, end_ns long")
    return lookups.contained_in(V.canon_dirty(spark, d, numbered=False).select(F.col("event_time_ns").alias("start_ns"), F.col("receive_time_ns").alias("end_ns")), allowed)


@query()
def cost_asof(spark, d):
    costs = V.tape(spark, d).where("arrival_ord % 3 = 0").select("instrument_id", "event_time_ns", (F.col("price") * 0.001).alias("amount"))
    return lookups.cumulative_costs(_curve(spark, d), costs, ["instrument_id"]).select("instrument_id", "event_time_ns", *r6("costs", "gross_equity"))


ORACLES["cost_asof"] = f"""{_D} SELECT instrument_id, event_time_ns, round(costs, 6) AS costs, round(equity + costs, 6) AS gross_equity FROM (
SELECT c.instrument_id, c.event_time_ns, any_value(c.equity) AS equity, coalesce(sum(k.price * 0.001), 0) AS costs FROM curve c LEFT JOIN (SELECT * FROM canon WHERE arrival_ord % 3 = 0) k
ON k.instrument_id = c.instrument_id AND k.event_time_ns <= c.event_time_ns GROUP BY 1, 2)"""


# ---- fills and costs ----

LADDER = "SELECT l_partkey AS book_id, l_extendedprice / l_quantity AS price, l_quantity AS size, l_orderkey, l_linenumber FROM lineitem"
WALK = f"""w AS (SELECT *, greatest(0, least(size, 100 - coalesce(sum(size) OVER (PARTITION BY book_id ORDER BY price, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS fill FROM ({LADDER}))"""


def _walked(spark, d):
    return fills.depth_walk(V.ladder(spark, d), 100.0, ties=("l_orderkey", "l_linenumber"))


@query(f"WITH {WALK} SELECT book_id, round(sum(fill), 6) AS filled, round(100 - sum(fill), 6) AS remaining, round(sum(fill * price) / sum(fill), 6) AS vwap, count(*) AS levels, CASE WHEN 100 - sum(fill) <= 1e-9 THEN 'filled' ELSE 'partial_rejected' END AS status FROM w WHERE fill > 0 GROUP BY 1")
def depth_walk(spark, d):
    return fills.walk_summary(_walked(spark, d), 100.0).select("book_id", *r6("filled", "remaining", "vwap"), "levels", "status")


@query(f"WITH {WALK}, m AS (SELECT book_id, min(price) AS best FROM w GROUP BY 1) SELECT book_id, l_orderkey, l_linenumber, round(abs(price * fill) * 0.001, 9) AS fee, round(greatest(0, (price - best) * fill), 9) AS spread, 0.0::DOUBLE AS slippage, round(abs(price * fill) * 5 / 10000, 9) AS impact FROM w JOIN m USING (book_id) WHERE fill > 0")
def cost_model(spark, d):
    f = _walked(spark, d)
    f = f.withColumn("best", F.min("price").over(W.partitionBy("book_id")))
    c = fills.linear_costs(F.col("price"), F.col("fill"), F.col("best"), F.lit(True), impact_bps=5.0)
    return f.select("book_id", "l_orderkey", "l_linenumber", *[F.round(v, 9).alias(k) for k, v in c.items()])


@query(
    f"""WITH {WALK}, m AS (SELECT book_id, min(price) AS best FROM w GROUP BY 1), c AS (SELECT sum(price * fill) * 0.001 AS fees, sum(greatest(0, (price - best) * fill)) AS spread, 0.0::DOUBLE AS slippage, sum(price * fill) * 0.0005 AS impact,
  sum(price * fill * 0.0001) FILTER (l_orderkey % 3 = 0) AS funding, sum(fill * 0.01) FILTER (l_orderkey % 5 = 0) AS borrow, 0.0::DOUBLE AS roll, sum((size - fill) * 0.001) AS rejects_or_missed_fills FROM w JOIN m USING (book_id) WHERE fill > 0)
SELECT component, round(total, 2) AS total FROM c UNPIVOT (total FOR component IN ({', '.join(fills.COMPONENTS)}))"""
)
def cost_totals(spark, d):
    f = _walked(spark, d).withColumn("best", F.min("price").over(W.partitionBy("book_id")))
    c = fills.linear_costs(F.col("price"), F.col("fill"), F.col("best"), F.lit(True), impact_bps=5.0)
    rows = f.select(c["fee"].alias("fees"), c["spread"].alias("spread"), c["slippage"].alias("slippage"), c["impact"].alias("impact"), F.when(F.col("l_orderkey") % 3 == 0, F.col("price") * F.col("fill") * 0.0001).alias("funding"), F.when(F.col("l_orderkey") % 5 == 0, F.col("fill") * 0.01).alias("borrow"), ((F.col("size") - F.col("fill")) * 0.001).alias("rejects_or_missed_fills"))
    return fills.component_totals(rows).select("component", F.round("total", 2).alias("total"))


@query(
    """SELECT instrument_id, event_time_ns, round(no * 1.0005, 6) AS price, round(coalesce(least(20, nv * 0.1), 0), 6) AS filled, round(20 - coalesce(least(20, nv * 0.1), 0), 6) AS remaining,
  round(abs(no * 1.0005 - no) * coalesce(least(20, nv * 0.1), 0), 6) AS slippage, round(no * 1.0005 * coalesce(least(20, nv * 0.1), 0) * 0.001, 6) AS fee,
  CASE WHEN no IS NULL THEN 'no subsequent fill evidence' WHEN nv = 0 THEN 'bar volume is zero' WHEN least(20, nv * 0.1) < 20 THEN 'bar participation cap' ELSE '' END AS reason
FROM (SELECT *, lead(open) OVER w AS no, lead(volume) OVER w AS nv FROM bars_h WINDOW w AS (PARTITION BY instrument_id ORDER BY event_time_ns))""",
    ("bars_h",),
)
def next_bar_fill(spark, d):
    return fills.next_bar_fill(V.bars(spark, d, HOUR), 20.0).select("instrument_id", "event_time_ns", *r6("price", "filled", "remaining", "slippage", "fee"), "reason")


@query(
    f"""SELECT book_id, round(lp, 6) AS price, round(a, 6) AS available, round(least(10, a * 0.375), 6) AS filled, round(10 - least(10, a * 0.375), 6) AS remaining, CASE WHEN a <= 0 THEN 'no evidence' WHEN least(10, a * 0.375) >= 10 THEN 'filled' ELSE 'partial' END AS status
FROM (SELECT book_id, lp, coalesce(sum(size) FILTER (price <= lp), 0) AS a FROM (SELECT *, p_retailprice AS lp FROM ({LADDER}) JOIN (SELECT p_partkey, p_size + 900.0 AS p_retailprice FROM part) ON p_partkey = book_id) GROUP BY 1, 2)"""
)
def limit_fill(spark, d):
    limits = V.table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), (F.col("p_size") + 900.0).alias("limit_price"))
    return fills.limit_fill(V.ladder(spark, d), limits, 10.0).select("book_id", *r6("price", "available", "filled", "remaining"), "status")


@query(
    f"""SELECT instrument_id, event_time_ns, round((bid + ask) / 2, 6) AS price, 3.0 AS filled, round((bid + ask) / 2 * 0.003, 6) AS fee, false AS promotable FROM (
  SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS event_time_ns, max(price) FILTER (arrival_ord % 2 = 0) AS bid, min(price) FILTER (arrival_ord % 2 = 1) AS ask FROM canon GROUP BY 1, 2) WHERE bid > 0 AND ask > bid""",
    ("canon",),
)
def midpoint_fill(spark, d):
    return fills.midpoint_fill(V.books(spark, d), 3.0).select("instrument_id", "event_time_ns", *r6("price"), "filled", *r6("fee"), "promotable")


@query("SELECT i AS idx, (48 + i % 5 + 49 + (i + 2) % 4) / 100.0 AS ask_sum, (100 - (48 + i % 5 + 49 + (i + 2) % 4)) / 100.0 AS gross_edge FROM range(48) t(i) WHERE 48 + i % 5 + 49 + (i + 2) % 4 < 100")
def complement_scan(spark, d):
    return screen.complement_scan(screen.complement_books(spark))


@query(
    f"""SELECT a.event_time_ns, round((a.best + b.best) / 500, 6) AS ask_sum FROM (SELECT event_time_ns // {HOUR} AS event_time_ns, min(price) AS best FROM canon WHERE instrument_id = 'view' GROUP BY 1) a
JOIN (SELECT event_time_ns // {HOUR} AS event_time_ns, min(price) AS best FROM canon WHERE instrument_id = 'purchase' GROUP BY 1) b USING (event_time_ns) WHERE (a.best + b.best) / 500 < 1""",
    ("canon",),
)
def book_complement(spark, d):
    best = V.tape(spark, d).groupBy(F.expr(f"event_time_ns div {HOUR}").alias("event_time_ns")).agg(F.min(F.when(F.col("instrument_id") == "view", F.col("price"))).alias("a"), F.min(F.when(F.col("instrument_id") == "purchase", F.col("price"))).alias("b"))
    total = (F.col("a") + F.col("b")) / 500
    return best.where(total < 1).select("event_time_ns", F.round(total, 6).alias("ask_sum"))


# ---- replay ----


def _tape(spark, d):
    b = V.bars(spark, d, HOUR)
    w = W.partitionBy("instrument_id").orderBy("event_time_ns")
    return b.select(F.col("instrument_id").alias("run_id"), "instrument_id", F.lit("bar").alias("event_type"), "event_time_ns", (F.col("event_time_ns") + 1_000_000).alias("receive_time_ns"), F.row_number().over(w).cast("long").alias("sequence"), F.col("event_time_ns").cast("string").alias("ingest_id"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])


@query(O.REPLAY_FILLS)
def replay_fills(spark, d):
    return _fills(replay.replay(_tape(spark, d), lambda run: replay.donchian(10)))


@query(O.REPLAY_EQUITY)
def replay_equity(spark, d):
    out = replay.replay(_tape(spark, d), lambda run: replay.buy_hold())
    return out.where("kind = 'equity'").select("run_id", "event_time_ns", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("cash", "equity", "unrealized")])


def _fills(out):
    return out.where("kind = 'fill'").select("run_id", "event_time_ns", "side", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("quantity", "price", "fee", "slippage")])


@query(O.RESUMED_FILLS)
def replay_resumed(spark, d):
    """Runs that are stopped after every 50 bars, and taken up from their exported state."""
    return _fills(replay.replay(_tape(spark, d), lambda run: replay.donchian(10), open_end=True, restart_every=50))


@query(O.RESUMED_ROWS)
def replay_parity(spark, d):
    """How many rows a run without a stop makes, and how many of them differ from one that is stopped and taken up: none."""
    runs = [replay.replay(_tape(spark, d), lambda run: replay.donchian(10), open_end=True, restart_every=k) for k in (0, 37)]
    n = runs[0].agg(F.count("*").alias("rows"))
    return n.crossJoin(recompute.differing_rows(*runs).agg(F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("differing")))  # one row each


#: Published results of the baselines (net and gross result, fills).
GOLDEN = {"buy_hold": (24.515137425, 24.85, 2), "seeded_random": (-5.41784016, -0.32, 22), "donchian_momentum": (21.009885675, 21.35, 2), "mean_reversion": (-2.145125925, -1.85, 2), "futures_trend": (1061.604510675, 1061.944625, 2)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}::DOUBLE, {g}::DOUBLE, {f}::BIGINT)" for k, (n, g, f) in GOLDEN.items()) + ") t(run_id, pnl, gross_pnl, fills)")
def baseline_runs(spark, d):
    """The named baselines on their synthetic tapes."""
    return baselines.report(baselines.run(spark)).select("run_id", F.round("pnl", 9).alias("pnl"), F.round("gross_pnl", 9).alias("gross_pnl"), "fills")


@query(O.EVENT_REPLAY)
def event_replay(spark, d):
    """Buy and hold over every event of the tape, each a bar by itself."""
    money = [F.col("price").cast("string").alias(c) for c in ("open", "high", "low", "close")]
    tape = V.canon(spark, d).select(F.col("instrument_id").alias("run_id"), "instrument_id", F.lit("bar").alias("event_type"), "event_time_ns", "receive_time_ns", "sequence", "ingest_id", *money, F.col("size").cast("string").alias("volume"))
    out = replay.replay(tape, lambda run: replay.buy_hold()).where("kind = 'equity'")
    return out.groupBy("run_id").agg(F.count("*").alias("events"), F.round(F.max_by(F.col("equity").cast("double"), "idx"), 6).alias("equity"))


def _rounded_metrics(m, key):
    return m.select(key, *[F.col(c).cast("long").alias(c) if c == "drawdown_duration" else F.round(c, 6).alias(c) for c in metrics.NAMES])


@query(O.REPLAY_METRICS)
def replay_metrics(spark, d):
    out = replay.replay(_tape(spark, d), lambda run: replay.buy_hold())
    curve = out.where("kind = 'equity'").select("run_id", "event_time_ns", F.col("equity").cast("double").alias("equity"))
    f = out.where("kind = 'fill'").select("run_id", "event_time_ns", (F.col("price").cast("double") * F.col("quantity").cast("double")).alias("notional"))
    return _rounded_metrics(metrics.metric_pack(curve, f, ["run_id"], 100_000.0, 365.25 * 24), "run_id")


@query()
def metric_pack(spark, d):
    trades = V.tape(spark, d).where("arrival_ord % 50 = 0").select("instrument_id", "event_time_ns", F.col("price").alias("notional"))
    return _rounded_metrics(metrics.metric_pack(_curve(spark, d), trades, ["instrument_id"], 1000.0, 365.25), "instrument_id")


ORACLES["metric_pack"] = f"""{_D.replace(CURVE, CURVE.replace('instrument_id, event_time_ns, 1000.0', 'instrument_id AS key, event_time_ns, 1000.0', 1))},
trade AS (SELECT instrument_id AS key, event_time_ns, price AS notional FROM canon WHERE arrival_ord % 50 = 0), {O.METRICS.format(cash='1000.0', year='365.25', key='instrument_id')}"""


# ---- out of sample ----


@query("SELECT i AS fold, 96 + i * 36 - 96 AS train_start, 96 + i * 36 AS train_end, 98 + i * 36 AS test_start, 130 + i * 36 AS test_end FROM range(6) t(i)")
def wf_splits(spark, d):
    return oos.walk_forward(spark, 320, 96, 32, 2, 2, anchored=False)


@query("SELECT i AS fold, 0::BIGINT AS train_start, 96 + i * 36 AS train_end, 98 + i * 36 AS test_start, 130 + i * 36 AS test_end FROM range(6) t(i)")
def wf_splits_anchored(spark, d):
    return oos.walk_forward(spark, 320, 96, 32, 2, 2)


@query("SELECT variant, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(skewness(ret), 6) AS skew, round(kurtosis(ret) + 3, 6) AS kurt FROM rets GROUP BY 1", ("rets",))
def sample_moments(spark, d):
    return oos.moments(V.returns_long(spark, d), ["variant"]).select("variant", "n", *r6("mean", "sd", "skew", "kurt"))


@query(f"SELECT variant, n, round(sharpe, 6) AS sharpe, round(z, 6) AS z, round({O.normal_cdf('z')}, 9) AS psr FROM (SELECT *, sharpe * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM (SELECT variant, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM rets GROUP BY 1))", ("rets",))
def psr(spark, d):
    return oos.psr(V.returns_long(spark, d), ["variant"]).select("variant", "n", *r6("sharpe", "z"), F.round("psr", 9).alias("psr"))


@query(f"SELECT variant, round(z, 6) AS z, round({O.normal_cdf('z')}, 9) AS dsr FROM (SELECT variant, (sharpe - b) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM (SELECT *, stddev_samp(sharpe) OVER () * {oos.dsr_factor(INSTRUMENTS)!r} AS b FROM (SELECT variant, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM rets GROUP BY 1)))", ("rets",))
def dsr(spark, d):
    return oos.dsr(V.returns_long(spark, d), ["variant"], INSTRUMENTS).select("variant", *r6("z"), F.round("dsr", 9).alias("dsr"))


def _matrix(spark, d):
    """All returns, and the number of observations of the longest series."""
    r = V.returns_long(spark, d)
    last = r.agg(F.max("obs")).first()[0]
    return r, 0 if last is None else last + 1


def _with(body: str, *views: str) -> str:
    """Oracle text whose own CTEs follow the views'."""
    return V.sql("", *views).rstrip() + ",\n" + body


@query(_with(f"{O.pbo_splits()} SELECT split, variant, rank, round(relative_rank, 6) AS relative_rank FROM split", "rets"))
def pbo_splits(spark, d):
    return oos.pbo_splits(*_matrix(spark, d)).select(F.col("split").cast("long").alias("split"), "variant", F.col("rank").cast("long").alias("rank"), *r6("relative_rank"))


@query(_with(f"{O.pbo_splits()} SELECT avg((ln(relative_rank / (1 - relative_rank)) <= 0)::INT) AS pbo, count(*) AS combinations FROM split", "rets"))
def pbo(spark, d):
    return oos.pbo(*_matrix(spark, d))


@query(_with(f"{O.STAT} {O.REALITY}", "rets"))
def reality_check(spark, d):
    return oos.reality_check(*_matrix(spark, d))


@query(O.sign_flip(), ("rets",))
def sign_flip(spark, d):
    r, n = _matrix(spark, d)
    m = r.groupBy("obs").agg(F.max(F.when(F.col("variant") == "view", F.col("ret"))).alias("selected"), F.max(F.when(F.col("variant") == "click", F.col("ret"))).alias("baseline"))
    return oos.sign_flip(m.fillna(0.0), n)


@query(O.block_bootstrap(4, 200, 7), ("rets",))
def block_bootstrap(spark, d):
    r, n = _matrix(spark, d)
    return oos.block_bootstrap(r, n, 4, 200, 7, keys=["variant"]).select("variant", F.col("draw").cast("long").alias("draw"), *r6("mean"))


@query(
    """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1"""
)
def linear_quantiles(spark, d):
    return risk.quantiles(V.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"median": 0.5, "p95": 0.95}).select("o_orderpriority", *r6("median", "p95"))


@query("SELECT variant, obs, round(ret, 6) AS ret FROM (SELECT variant, obs, wealth / lag(wealth, 1, 1.0) OVER (PARTITION BY variant ORDER BY obs) - 1 AS ret FROM (SELECT variant, obs, product(1 + ret) OVER (PARTITION BY variant ORDER BY obs) AS wealth FROM rets)) WHERE ret IS NOT NULL", ("rets",))
def periodic_returns(spark, d):
    """Returns of equity curves that begin with the cash and end with the final equity: those that made the curves."""
    r = V.returns_long(spark, d)
    w = W.partitionBy("variant").orderBy("obs").rowsBetween(W.unboundedPreceding, 0)
    curve = r.select("variant", F.col("obs").alias("event_time_ns"), (100.0 * F.product(1 + F.col("ret")).over(w)).alias("equity"))
    last = curve.groupBy("variant").agg(F.max_by("equity", "event_time_ns").alias("final"))
    return metrics.periodic_returns(curve, last, ["variant"], 100.0).select("variant", F.col("idx").cast("long").alias("obs"), *r6("ret"))


@query("SELECT l_orderkey, round(g, 4) AS gross_pnl, round(c, 4) AS total_costs FROM (SELECT l_orderkey, sum(l_extendedprice) AS n, sum(l_extendedprice * l_discount) + sum(l_tax) + 1.5 AS c, sum(l_extendedprice) + sum(l_extendedprice * l_discount) + sum(l_tax) + 1.5 AS g FROM lineitem GROUP BY 1)")
def cost_waterfall(spark, d):
    """Gross is net and every cost that left cash."""
    r = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("net_pnl"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("fees"), F.sum("l_tax").alias("spread"))
    r = r.withColumns({"slippage": F.lit(1.0), "impact": F.lit(0.5), "funding": F.lit(0.0), "borrow": F.lit(0.0), "roll": F.lit(0.0)})
    return metrics.waterfall(r).select("l_orderkey", F.round("gross_pnl", 4).alias("gross_pnl"), F.round("total_costs", 4).alias("total_costs"))


@query("SELECT instrument_id, instrument_id NOT IN ('view', 'error') AS promotable, CASE WHEN instrument_id NOT IN ('view', 'error') THEN round(arg_max(close, event_time_ns) / arg_min(close, event_time_ns) * 1000 - 1000, 6) END AS pnl FROM bars_d GROUP BY 1", ("bars_d",))
def metric_pack_ruined(spark, d):
    """A run whose equity was ever 0 or less has no metrics and cannot be promoted."""
    ruined = (F.col("instrument_id") == "view") & (F.row_number().over(W.partitionBy("instrument_id").orderBy("event_time_ns")) == 7)
    c = _curve(spark, d).withColumn("ruined", ruined).withColumn("equity", F.when(F.col("ruined"), 0.0).when((F.col("instrument_id") == "error") & (F.col("event_time_ns") == START + 9 * DAY), -5.0).otherwise(F.col("equity")))
    return metrics.metric_pack(c.drop("ruined"), None, ["instrument_id"], 1000.0, 365.25).select("instrument_id", "promotable", *r6("pnl"))


@query("SELECT lang AS regime, count(*) AS observations, round(avg(quality), 6) AS mean, round(avg((quality > 0)::INT), 6) AS win_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def regime_stats(spark, d):
    j = V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id")
    return oos.regime_statistics(j.select(F.col("lang").alias("regime"), F.col("quality").cast("double").alias("value"))).select("regime", "observations", *r6("mean", "win_rate"))


@query("SELECT parameter, round(metric, 6) AS selected_metric, round(coalesce(greatest(metric - below, metric - above), 0), 6) AS max_neighbor_degradation FROM (SELECT *, lag(metric) OVER (ORDER BY parameter) AS below, lead(metric) OVER (ORDER BY parameter) AS above FROM (SELECT p_size::DOUBLE AS parameter, count(*)::DOUBLE AS metric FROM part GROUP BY 1)) WHERE parameter = 25")
def sensitivity(spark, d):
    r = V.table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("parameter")).agg(F.count("*").cast("double").alias("metric"))
    return oos.sensitivity(r, 25.0).select("parameter", *r6("selected_metric", "max_neighbor_degradation"))


def _cells(spark, d):
    r = V.returns_long(spark, d)
    fold = F.expr("obs div 7")
    phase = F.when(F.col("obs") % 7 < 5, "train").otherwise("test")
    return r.groupBy(fold.alias("fold"), phase.alias("phase"), "variant").agg(F.avg("ret").alias("score"), F.sum("ret").alias("total"))


@query("SELECT fold, variant, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, variant) AS rn FROM (SELECT obs // 7 AS fold, variant, avg(ret) AS score FROM rets WHERE obs % 7 < 5 AND variant <> 'click' GROUP BY 1, 2)) WHERE rn = 1", ("rets",))
def train_winner(spark, d):
    return oos.train_winners(_cells(spark, d), ["click"]).select("fold", "variant", *r6("score"))


@query(
    """SELECT w.fold, w.variant, round(c.total, 6) AS test_total, c2.variant IS NOT NULL AS has_null FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, variant) AS rn FROM (SELECT obs // 7 AS fold, variant, avg(ret) AS score FROM rets WHERE obs % 7 < 5 AND variant <> 'click' GROUP BY 1, 2)) w
JOIN (SELECT obs // 7 AS fold, variant, sum(ret) AS total FROM rets WHERE obs % 7 >= 5 GROUP BY 1, 2) c ON c.fold = w.fold AND c.variant = w.variant
LEFT JOIN (SELECT DISTINCT obs // 7 AS fold, variant FROM rets WHERE obs % 7 >= 5 AND variant = 'click') c2 ON c2.fold = w.fold WHERE w.rn = 1""",
    ("rets",),
)
def selected_cells(spark, d):
    cells = _cells(spark, d)
    test = cells.where("phase = 'test'")
    win = oos.train_winners(cells, ["click"]).select("fold", "variant")
    null = test.where("variant = 'click'").select("fold", F.lit(True).alias("has_null"))
    j = win.join(test.select("fold", "variant", "total"), ["fold", "variant"]).join(null, "fold", "left")
    return j.select("fold", "variant", F.round("total", 6).alias("test_total"), F.coalesce("has_null", F.lit(False)).alias("has_null"))


SWEEP = [("donchian", 5), ("donchian", 10), ("mean_reversion", 12), ("reversion", 12), ("flat", 0)]


def _sweep_tape(spark, d):
    """All hourly bars of each instrument, and the folds that fit the longest of them."""
    tape = _tape(spark, d).withColumnRenamed("run_id", "series")
    longest = sweep.lengths(tape).agg(F.max("length")).first()[0] or 0
    return tape, oos.walk_forward(spark, longest, 80, 30, 2, 2, anchored=False)


def _swept(spark, d):
    """A sweep over all hourly bars of each instrument."""
    return sweep.run_cells(*_sweep_tape(spark, d), SWEEP, replay.Rules())


@query(O.sweep(SWEEP, "SELECT series, fold, variant, phase, bars, round(net_return, 6) AS net_return, round(score, 6) AS score FROM cell"))
def sweep_cells(spark, d):
    c = sweep.cell_results(_swept(spark, d), 100_000.0)
    return c.select("series", "fold", "variant", "phase", "bars", *r6("net_return", "score"))


@query(
    O.sweep(
        SWEEP,
        """SELECT w.series, w.fold, w.variant, round(w.score, 6) AS train_score, round(c.net_return, 6) AS test_return FROM (
SELECT *, row_number() OVER (PARTITION BY series, fold ORDER BY round(score, 12) DESC, variant) AS rn FROM cell WHERE phase = 'train' AND variant <> 'flat-0') w
LEFT JOIN (SELECT * FROM cell WHERE phase = 'test') c ON c.series = w.series AND c.fold = w.fold AND c.variant = w.variant WHERE w.rn = 1""",
    )
)
def sweep_winners(spark, d):
    cells = sweep.cell_results(_swept(spark, d), 100_000.0)
    return sweep.stitched(cells, excluded=["flat-0"]).select("series", "fold", "variant", *r6("train_score", "test_return"))


_VARIANTS = ", ".join(f"('{f}-{n}')" for f, n in SWEEP)
PLANNED = f"plan AS (SELECT instrument_id AS series, fold, variant, phase FROM (SELECT instrument_id, count(*) AS size FROM bars_h GROUP BY 1) JOIN fold ON ends <= size, (VALUES {_VARIANTS}) v(variant))"


@query(O.sweep(SWEEP, f", {PLANNED} SELECT series, fold, variant, phase, coalesce(n, 0) AS n FROM plan FULL JOIN (SELECT series, fold, variant, phase, count(*) AS n FROM cell GROUP BY 1, 2, 3, 4) USING (series, fold, variant, phase) WHERE n IS DISTINCT FROM 1").replace("\n, plan", ",\nplan"))
def sweep_cover(spark, d):
    """Cells that the plan has and the results lack, or the other way round: none."""
    tape, folds = _sweep_tape(spark, d)
    cells = sweep.cell_results(sweep.run_cells(tape, folds, SWEEP, replay.Rules()), 100_000.0)
    return sweep.cover_problems(cells, folds, SWEEP, sweep.lengths(tape))


@query(
    _with(
        f"""{O.FOLDS},\n{PLANNED} SELECT *, CASE WHEN fold = 1 THEN 0 ELSE 2 END AS n FROM plan WHERE (fold = 1 AND variant = 'flat-0' AND phase = 'test') OR (fold = 0 AND variant = 'donchian-5' AND phase = 'train')
UNION ALL SELECT DISTINCT series, 99999, variant, phase, 1 FROM plan WHERE fold = 2 AND variant = 'flat-0'""",
        "bars_h",
    )
)
def sweep_cover_faults(spark, d):
    """The same check of results in which cells are lost, doubled and renamed."""
    tape, folds = _sweep_tape(spark, d)
    cells = sweep.cell_results(sweep.run_cells(tape, folds, SWEEP, replay.Rules()), 100_000.0).select("series", "fold", "variant", "phase")
    one = cells.where("NOT (fold = 1 AND variant = 'flat-0' AND phase = 'test')")
    twice = cells.where("fold = 0 AND variant = 'donchian-5' AND phase = 'train'")
    unplanned = cells.where("fold = 2 AND variant = 'flat-0'").withColumn("fold", F.lit(99999).cast("long"))
    return sweep.cover_problems(one.unionByName(twice).unionByName(unplanned), folds, SWEEP, sweep.lengths(tape))


# ---- stress and risk ----


def _costs(spark, d):
    c = V.tape(spark, d).groupBy(F.col("instrument_id").alias("variant")).agg((F.sum("price") / 100).alias("gross_pnl"), (F.sum("price") / 2000).alias("fees"), (F.sum("size") / 100).alias("slippage"))
    return c.select("variant", "gross_pnl", "fees", F.lit(1.0).alias("spread"), "slippage", F.lit(2.0).alias("funding"), F.lit(0.5).alias("impact"), F.lit(0.0).alias("borrow"), F.lit(0.25).alias("roll"), F.lit(0.0).alias("other"), F.lit(3.0).alias("missed"))


INPUTS = """c AS (SELECT instrument_id AS variant, sum(price) / 100 AS gross_pnl, sum(price) / 2000 AS fees, sum(size) / 100 AS slippage FROM canon GROUP BY 1),
p AS (SELECT variant, obs, ret, product(1 + ret) OVER (PARTITION BY variant ORDER BY obs) AS wealth FROM rets),
g AS (SELECT variant, arg_max(wealth, obs) - 1 AS total, min(ret) AS worst, max(peak - wealth) AS fall FROM (SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY variant ORDER BY obs ROWS UNBOUNDED PRECEDING)) AS peak FROM p) GROUP BY 1),
i AS (SELECT variant, gross_pnl, fees, slippage, greatest(0, -worst) * abs(gross_pnl / total) AS outage_loss, greatest(0, -worst) * abs(gross_pnl / total) * 2 AS gap_loss, fall * abs(gross_pnl / total) AS deleverage_loss FROM c JOIN g USING (variant))"""


@query()
def stress_inputs(spark, d):
    return risk.stress_inputs(V.returns_long(spark, d), _costs(spark, d), ["variant"]).select("variant", *[F.round(c, 4).alias(c) for c in ("gross_pnl", "fees", "outage_loss", "gap_loss", "deleverage_loss")])


@query()
def stress_suite(spark, d):
    return risk.stress_suite(risk.stress_inputs(V.returns_long(spark, d), _costs(spark, d), ["variant"]), ["variant"]).select("variant", "scenario", F.round("net_pnl", 4).alias("net_pnl"), "status")


_rows = [f"('{n}', {a}, {b}, {c}, {e}, 0, 0, 0)" for n, a, b, c, e in risk.MULTIPLIERS] + [f"('{n}', 1, 1, 1, 0, {int(v == 'outage_loss')}, {int(v == 'gap_loss')}, {int(v == 'deleverage_loss')})" for n, v in risk.LOSSES]
ORACLES["stress_inputs"] = _with(f"{INPUTS} SELECT variant, round(gross_pnl, 4) AS gross_pnl, round(fees, 4) AS fees, round(outage_loss, 4) AS outage_loss, round(gap_loss, 4) AS gap_loss, round(deleverage_loss, 4) AS deleverage_loss FROM i", "rets")
ORACLES["stress_suite"] = _with(
    f"{INPUTS}, n AS (SELECT variant, scenario, gross_pnl - fees * f - 1.75 - slippage * s - 2 * u - 3 * (1 + e) - outage_loss * x - gap_loss * y - deleverage_loss * z AS net_pnl FROM i, (VALUES {', '.join(_rows)}) t(scenario, f, s, u, e, x, y, z)) SELECT variant, scenario, round(net_pnl, 4) AS net_pnl, CASE WHEN net_pnl > 0 THEN 'pass' ELSE 'blocked' END AS status FROM n",
    "rets",
)


@query("SELECT variant, round(arg_max(wealth, obs) - 1, 6) AS total FROM (SELECT variant, obs, product(1 + ret) OVER (PARTITION BY variant ORDER BY obs) AS wealth FROM rets) GROUP BY 1", ("rets",))
def compounded_return(spark, d):
    return risk.compounded(V.returns_long(spark, d), ["variant"]).select("variant", *r6("total"))


@query(_with(O.risk_report(), "rets"))
def risk_report(spark, d):
    """Of every variant, the deepest fall first."""
    names = ["observed_max", "bootstrap_median", "bootstrap_p95", "risk_of_ruin", "expected_shortfall"]
    return risk.risk_report(*_matrix(spark, d), keys=["variant"]).select("variant", *r6(*names)).orderBy(F.desc("observed_max"))


@query(
    """SELECT o_orderpriority, round(e, 4) AS expected, round(o, 4) AS observed, round(abs(o - e) / greatest(abs(e), 1), 6) AS divergence, CASE WHEN abs(o - e) / greatest(abs(e), 1) <= 0.1 THEN 'pass' ELSE 'blocked' END AS status
FROM (SELECT o_orderpriority, sum(o_totalprice) AS e FROM orders GROUP BY 1) JOIN (SELECT o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) USING (o_orderpriority)"""
)
def divergence(spark, d):
    o, li = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    expected = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("value"))
    observed = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderpriority").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    return risk.divergence(expected, observed, "o_orderpriority", 0.1).select("o_orderpriority", F.round("expected", 4).alias("expected"), F.round("observed", 4).alias("observed"), *r6("divergence"), "status")


@query("SELECT c_custkey AS account, round(c_acctbal, 6) AS equity, round(least(100, c_acctbal * 0.0025), 6) AS max_capital, round(least(25, c_acctbal * 0.001), 6) AS max_daily_loss FROM customer")
def locked_caps(spark, d):
    return risk.locked_caps(V.table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("equity"))).select("account", *r6("equity", "max_capital", "max_daily_loss"))


@query("SELECT o_orderkey, round(least(50, o_totalprice * 0.02 / 17), 6) AS fixed_fraction, round(least(50, o_totalprice * 0.1 / 0.4 / 17), 6) AS vol_target, round(greatest(0, p - (1 - p) / 1.5), 6) AS kelly FROM (SELECT *, 0.2 + (o_orderkey % 7) / 10.0 AS p FROM orders)")
def sizing(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("equity"), F.lit(17.0).alias("price"), F.lit(0.4).alias("vol"), (0.2 + F.col("o_orderkey") % 7 / 10.0).alias("p"), F.lit(1.5).alias("b"))
    return risk.sizes(o, 50.0, 0.02, 0.1).select("o_orderkey", *r6("fixed_fraction", "vol_target", "kelly"))


# ---- cross-checks of feeds and registries ----


@query("SELECT count(DISTINCT instrument_id) AS contracts, CASE WHEN bool_or(arrival_ord % 1000 = 7) THEN 'fail' ELSE 'pass' END AS status FROM canon", ("canon",))
def futures_cross_check(spark, d):
    return lookups.futures_cross_check(V.tape(spark, d).withColumn("back_adjusted", F.col("arrival_ord") % 1000 == 7))


@query("SELECT sha256(arg_max(ingest_id, (event_time_ns, sequence))) = sha256(lpad((SELECT max(event_id) FROM events)::VARCHAR, 12, '0')) AS hash_match, CASE WHEN sha256(arg_max(ingest_id, (event_time_ns, sequence))) = sha256(lpad((SELECT max(event_id) FROM events)::VARCHAR, 12, '0')) THEN 'pass' ELSE 'warning' END AS status FROM canon", ("canon",))
def book_cross_check(spark, d):
    import hashlib

    c = V.canon(spark, d)
    last = f"{V.table(spark, d, 'events').agg(F.max('event_id')).first()[0]:012d}"
    return lookups.book_cross_check(c.withColumn("hash", F.sha2("ingest_id", 256)), hashlib.sha256(last.encode()).hexdigest(), (0.52, 0.49))


@query(
    """SELECT id, unnest(CASE WHEN r IS NULL THEN ['unregistered'] WHEN n IS NULL THEN ['no note'] ELSE list_filter([CASE WHEN rq IS DISTINCT FROM nq THEN 'quality' END, CASE WHEN rt IS DISTINCT FROM nt THEN 'toxic' END], lambda x: x IS NOT NULL) END) AS problem
FROM (SELECT doc_id AS id, quality AS rq, toxic AS rt, 1 AS r FROM labels WHERE doc_id % 11 <> 0) a
FULL JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS nq, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS nt, 1 AS n FROM labels WHERE doc_id % 13 <> 0) b USING (id)"""
)
def registry_notes(spark, d):
    l = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    notes = l.where("id % 13 <> 0").select("id", F.expr("CASE WHEN id % 7 = 0 THEN 1 - quality ELSE quality END").alias("quality"), F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE toxic END").alias("toxic"))
    return lookups.registry_disagreements(l.where("id % 11 <> 0"), notes, ["quality", "toxic"])


# ---- consistency of results ----


@query("SELECT variant, total + 0.5 AS net_return, total FROM (SELECT variant, arg_max(wealth, obs) - 1 AS total FROM (SELECT variant, obs, product(1 + ret) OVER (PARTITION BY variant ORDER BY obs) AS wealth FROM rets) GROUP BY 1) WHERE variant IN ('click', 'view')".replace("total + 0.5 AS net_return, total", "round(total + 0.5, 6) AS net_return, round(total, 6) AS total"), ("rets",))
def check_compounding(spark, d):
    r = V.returns_long(spark, d)
    cells = risk.compounded(r, ["variant"]).select("variant", F.when(F.col("variant").isin("click", "view"), F.col("total") + 0.5).otherwise(F.col("total")).alias("net_return"))
    return consistency.compounding(r, cells, ["variant"]).select("variant", *r6("net_return", "total"))


@query("SELECT l_orderkey FROM (SELECT l_orderkey, sum(l_extendedprice) AS g, sum(l_extendedprice * l_discount) AS fees, sum(l_extendedprice * l_tax) AS slippage FROM lineitem GROUP BY 1) WHERE l_orderkey % 101 = 0")
def check_waterfall(spark, d):
    r = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("gross_pnl"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("fees"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("slippage"))
    r = r.withColumns({"spread": F.lit(1.0), "impact": F.lit(0.0)})
    net = F.col("gross_pnl") - F.col("fees") - F.col("slippage") - 1.0
    return consistency.waterfall(r.withColumn("net_pnl", F.when(F.col("l_orderkey") % 101 == 0, net + 1).otherwise(net)), "l_orderkey")


@query("SELECT o_orderkey, 'fees' AS component FROM orders WHERE o_orderkey % 19 = 0 UNION ALL SELECT o_orderkey, 'impact' FROM orders WHERE o_orderkey % 23 = 0")
def check_costs(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 19 = 0 THEN -1.0D ELSE 1.0D END").alias("fees"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("slippage"), F.expr("CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 1.0D END").alias("impact"))
    return consistency.costs_present(o, "o_orderkey")


@query(
    """SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT s < e THEN 'sample_empty' END, CASE WHEN NOT (s >= 0 AND e <= 100) THEN 'sample_outside_coverage' END, CASE WHEN NOT (50 >= s AND 60 <= e) THEN 'holdout_outside_sample' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT o_orderkey, o_orderkey % 70 - 5 AS s, o_orderkey % 113 AS e FROM orders)"""
)
def check_intervals(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.lit(0).alias("coverage_start"), F.lit(100).alias("coverage_end"), (F.col("o_orderkey") % 70 - 5).alias("sample_start"), (F.col("o_orderkey") % 113).alias("sample_end"), F.lit(50).alias("holdout_start"), F.lit(60).alias("holdout_end"))
    return consistency.intervals(o, "o_orderkey")


@query("SELECT i AS fold FROM range(6) t(i) WHERE i IN (2, 4, 5)")
def check_folds(spark, d):
    f = oos.walk_forward(spark, 320, 96, 32, 2, 2)
    f = f.withColumn("test_start", F.when(F.col("fold") == 2, F.col("test_start") - 1).otherwise(F.col("test_start"))).withColumn("test_end", F.when(F.col("fold") == 3, F.col("test_end") + 9).otherwise(F.col("test_end")))
    return consistency.fold_policy(f.withColumn("train_end", F.when(F.col("fold") == 5, F.col("train_end") - 3).otherwise(F.col("train_end"))), 2, 2)


@query("SELECT conv_id, turn AS ordinal, turn + 2 AS attempt, turn + 1 AS expected FROM conversations WHERE conv_id % 9 = 0 AND turn >= 1")
def check_attempts(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.expr("turn + 1 + CASE WHEN conv_id % 9 = 0 AND turn >= 1 THEN 1 ELSE 0 END").alias("attempt"))
    return consistency.attempts(c, ["conv_id"])


@query("SELECT conv_id, lap FROM (SELECT conv_id, turn + 1 AS lap, length(text) % 3 = 0 AS p, lag(length(text) % 3 = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE NOT p AND NOT coalesce(b, true)")
def check_laps(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("lap"), (F.length("text") % 3 == 0).alias("progress"))
    return consistency.laps(c, "conv_id")


@query("SELECT o_orderkey, 'm' AS name FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 2 = 1")
def check_null_metrics(spark, d):
    o = V.table(spark, d, "orders")
    m = o.select("o_orderkey", F.lit("m").alias("name"), F.expr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END").alias("value"))
    return consistency.null_metrics(m, o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("m").alias("name"), F.lit("few rows").alias("reason")), "o_orderkey")


def _earning(spark, d, variant):
    runs = _swept(spark, d).where("kind = 'equity'").select("run_id", F.split("run_id", "\\|")[3].alias("variant"), (F.col("equity").cast("double") / 100_000.0 - 1).alias("ret"))
    return consistency.null_is_flat(None, runs, variant).groupBy("run_id").agg(F.count("*").alias("n"))


def _earning_sql(variant):
    return O.sweep(SWEEP, f"SELECT run AS run_id, count(*) AS n FROM step WHERE run LIKE '%|{variant}' AND {O.EQUITY} <> 10000000000000000000000 GROUP BY 1")


@query(_earning_sql("flat-0"))
def check_flat_null(spark, d):
    """Runs of the sweep's flat variant, and in how many periods they earned or lost anything: none."""
    return _earning(spark, d, "flat-0")


@query(_earning_sql("donchian-5"))
def check_flat_null_faults(spark, d):
    """The same check of a variant that trades."""
    return _earning(spark, d, "donchian-5")


@query(O.sweep(SWEEP, "SELECT count(*) AS rows, 0::BIGINT AS differing FROM cell"))
def sweep_double_run(spark, d):
    """Cells of the sweep, and those that a second, fresh run of it gives otherwise: none."""
    runs = [sweep.cell_results(_swept(spark, d), 100_000.0) for _ in range(2)]
    n = runs[0].agg(F.count("*").alias("rows"))
    return n.crossJoin(recompute.double_run(*runs).agg(F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("differing")))  # one row each


@query(
    """SELECT obs, variant, round(round(ret, 12) + 0.5, 6) AS ret, 'claimed' AS side, 1::BIGINT AS times FROM rets WHERE obs % 7 = 3 AND variant = 'view'
UNION ALL SELECT obs, variant, round(ret, 6), 'derived', 1 FROM rets WHERE (obs % 7 = 3 AND variant = 'view') OR (obs = 5 AND variant = 'click')""",
    ("rets",),
)
def check_oos_matrix(spark, d):
    r = V.returns_long(spark, d)
    claimed = r.where("NOT (obs = 5 AND variant = 'click')").withColumn("ret", F.when((F.col("obs") % 7 == 3) & (F.col("variant") == "view"), F.col("ret") + 0.5).otherwise(F.col("ret")))
    return recompute.matrix_problems(claimed, r).select("obs", "variant", *r6("ret"), "side", "times")


@query()
def check_stitched(spark, d):
    r = V.returns_long(spark, d).where("obs % 7 >= 5").withColumn("fold", F.expr("obs div 7"))
    win = oos.train_winners(_cells(spark, d), ["click"])
    selected = r.join(win.select("fold", "variant"), ["fold", "variant"]).select("fold", "obs", "ret")
    claimed = selected.withColumn("ret", F.when(F.col("fold") == 2, F.col("ret") + 1).otherwise(F.col("ret")))
    return recompute.stitched_problems(claimed, r, win).select("fold", "obs", *r6("ret"), "side", "times")


ORACLES["check_stitched"] = _with(
    """win AS (SELECT fold, variant FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, variant) AS rn FROM (SELECT obs // 7 AS fold, variant, avg(ret) AS score FROM rets WHERE obs % 7 < 5 AND variant <> 'click' GROUP BY 1, 2)) WHERE rn = 1),
sel AS (SELECT obs // 7 AS fold, obs, ret FROM rets r JOIN win w ON w.fold = obs // 7 AND w.variant = r.variant WHERE obs % 7 >= 5)
SELECT fold, obs, round(ret + 1, 6) AS ret, 'claimed' AS side, 1::BIGINT AS times FROM sel WHERE fold = 2 UNION ALL SELECT fold, obs, round(ret, 6), 'derived', 1 FROM sel WHERE fold = 2""",
    "rets",
)

_MOMENTS = "SELECT variant, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM rets GROUP BY 1"


@query(
    _with(
        f"""mom AS ({_MOMENTS}), eff AS (SELECT variant, least(count(*), greatest(2, count(*) * (1 - least(0.99, greatest(-0.99, corr(ret, prev)))) / (1 + least(0.99, greatest(-0.99, corr(ret, prev)))))) AS e FROM (SELECT *, lag(ret) OVER (PARTITION BY variant ORDER BY obs) AS prev FROM rets) GROUP BY 1),
z AS (SELECT variant, sharpe * sqrt(e - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS zp, (sharpe - b) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS zd FROM (SELECT *, stddev_samp(sharpe) OVER () * {oos.dsr_factor(INSTRUMENTS)!r} AS b FROM mom) JOIN eff USING (variant))
SELECT variant, 'psr' AS name, round({O.normal_cdf('zp')} + 0.001, 9) AS claimed, round({O.normal_cdf('zp')}, 9) AS derived FROM z WHERE variant = 'click' UNION ALL SELECT variant, 'dsr', NULL, round({O.normal_cdf('zd')}, 9) FROM z WHERE variant = 'view'""",
        "rets",
    )
)
def check_statistics(spark, d):
    derived = recompute.statistics(V.returns_long(spark, d), INSTRUMENTS)
    wrong = (F.col("variant") == "click") & (F.col("name") == "psr")
    claimed = derived.where("NOT (variant = 'view' AND name = 'dsr')").withColumn("value", F.when(wrong, F.col("value") + 0.001).otherwise(F.col("value")))
    return recompute.statistics_problems(claimed, derived, ["variant"]).select("variant", "name", F.round("claimed", 9).alias("claimed"), F.round("derived", 9).alias("derived"))


@query("SELECT o_orderkey, problem FROM orders, (VALUES ('gross.sharpe', 17), ('net.turnover', 19), ('trades', 23), ('periods_per_year', 29)) t(problem, k) WHERE o_orderkey % k = 0")
def check_promotion_metrics(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("name")) for s in ("gross", "net") for n in recompute.PROMOTION_METRICS]))
    m = o.select("o_orderkey", "value", sides.alias("x")).select("o_orderkey", "x.side", "x.name", "value")
    lost = F.when((F.col("o_orderkey") % 17 == 0) & (F.col("side") == "gross") & (F.col("name") == "sharpe"), F.lit(None)).when((F.col("o_orderkey") % 19 == 0) & (F.col("side") == "net") & (F.col("name") == "turnover"), F.lit(float("nan")))
    kept = F.when(((F.col("o_orderkey") % 17 == 0) & (F.col("side") == "gross") & (F.col("name") == "sharpe")) | ((F.col("o_orderkey") % 19 == 0) & (F.col("side") == "net") & (F.col("name") == "turnover")), lost).otherwise(F.col("value"))
    runs = o.select("o_orderkey", F.when(F.col("o_orderkey") % 23 == 0, 0).otherwise(3).alias("trades"), F.when(F.col("o_orderkey") % 29 != 0, 252.0).alias("periods_per_year"))
    return recompute.promotion_problems(m.withColumn("value", kept), runs, "o_orderkey")


@query("SELECT o_orderkey, true AS claimed, false AS derived FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' AND o_orderkey % 31 = 0")
def check_promotion_flags(spark, d):
    rich, settled = F.col("o_totalprice") > 1000, F.col("o_orderstatus") != "P"
    o = V.table(spark, d, "orders").select("o_orderkey", rich.alias("rich"), settled.alias("settled"), F.when(F.col("o_orderkey") % 31 != 0, True).alias("reviewed"), (rich & settled).alias("promotion_eligible"))
    return recompute.promotion_flag_problems(o, ["rich", "settled", "reviewed"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 41 = 2 OR (o_orderkey % 43 = 1 AND o_orderkey % 3 < 2)")
def check_prefix(spark, d):
    """Rows of an earlier result that a later one changed or lost; rows that came later do not matter."""
    o = V.table(spark, d, "orders").select(F.lit(1).alias("run"), "o_orderkey", "o_totalprice", "o_orderstatus")
    earlier = o.where("o_orderkey % 3 < 2 OR o_orderkey % 41 = 2")
    later = o.where("o_orderkey % 43 <> 1 OR o_orderkey % 41 = 2").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 41 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return recompute.prefix_problems(earlier, later, ["run"], "o_orderkey").select("o_orderkey")


# ---- values ----


@query(
    """SELECT count(*) AS n, sum(('0x' || substr(sha256(no || '|{"ingest_id":"' || ingest_id || '","event_time_ns":' || event_time_ns || '}'), 1, 15))::HUGEINT)::VARCHAR AS digest
FROM (SELECT *, row_number() OVER (ORDER BY event_time_ns, sequence, receive_time_ns, ingest_id, arrival_ord) AS no FROM dirty)""",
    ("dirty",),
)
def ordered_digest(spark, d):
    return lookups.ordered_digest(V.canon_dirty(spark, d), ["ingest_id", "event_time_ns"])


@query("SELECT l_orderkey, l_linenumber, printf('%.11e', l_extendedprice * l_discount / 7)::DOUBLE AS fee FROM lineitem")
def rounded_metrics(spark, d):
    """Twelve significant digits."""
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", values.round12_column(F.col("l_extendedprice") * F.col("l_discount") / 7).alias("fee"))


KEYS = ("API-Key", "token", "token_id", "My Refresh Token", "secretary", "db.password", "Wallet  Key!", "seed phrase", "note", "client_secret_hint")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey % {len(KEYS)} IN ({', '.join(str(i) for i, k in enumerate(KEYS) if k in ('API-Key', 'token', 'My Refresh Token', 'db.password', 'Wallet  Key!', 'seed phrase'))})")
def secret_keys(spark, d):
    """Rows whose key names a credential."""
    names = F.array(*[F.lit(k) for k in KEYS])
    o = V.table(spark, d, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % len(KEYS)).cast("int")).alias("key"))
    return o.where(values.is_secret_column(F.col("key"))).select("o_orderkey")


# ---- ledger ----


def _ledger(spark, d):
    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("ledger"), F.col("turn").alias("ordinal"), "text")
    w = W.partitionBy("ledger").orderBy("ordinal")
    c = c.withColumn("entry_hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("previous_hash", F.lag("entry_hash").over(w))
    broken = F.when((F.col("ledger") % 13 == 0) & (F.col("ordinal") == 1), F.lit("0" * 64)).otherwise(F.col("previous_hash"))
    return c.withColumn("previous_hash", broken).withColumn("text", F.when((F.col("ledger") % 17 == 0) & (F.col("ordinal") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query("SELECT conv_id AS ledger, turn AS ordinal, CASE WHEN conv_id % 17 = 0 AND turn = 2 THEN 'hash' ELSE 'link' END AS problem FROM conversations WHERE (conv_id % 17 = 0 AND turn = 2) OR (conv_id % 13 = 0 AND turn = 1)")
def ledger_chain(spark, d):
    return lookups.ledger_problems(_ledger(spark, d))


@query("SELECT CASE p_partkey % 5 WHEN 0 THEN 'full_text' WHEN 1 THEN 'abstract' WHEN 2 THEN 'metadata' WHEN 3 THEN 'full_text' ELSE 'other' END AS scope, count(*) AS n FROM part GROUP BY 1")
def evidence_scopes(spark, d):
    """Sources by what their classification's words allow them to support."""
    words = F.get(F.array(*[F.lit(w) for w in ("Full Text", "ABSTRACT only", "metadata record", "text of the full paper", "note")]), (F.col("p_partkey") % 5).cast("int"))
    return V.table(spark, d, "part").select(lookups.evidence_scope(words, F.lit("seen")).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS variants, count(*) + 1 AS next_attempt FROM conversations WHERE role = 'user' GROUP BY 1")
def trial_count(spark, d):
    c = V.table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("variants"), (F.count("*") + 1).alias("next_attempt"))


@query("SELECT count(*) AS experiments, round(sum(value), 4) AS pnl, sum(size)::BIGINT AS trades FROM (SELECT value, (props->>'$.k')::DOUBLE AS size FROM events)")
def dashboard_summary(spark, d):
    return V.tape(spark, d).agg(F.count("*").alias("experiments"), F.round(F.sum("price"), 4).alias("pnl"), F.sum("size").cast("long").alias("trades"))


# ---- observation ----

NOW = START + 29 * DAY


@query(
    f"""SELECT code, n FROM (SELECT (count(*) = 0)::BIGINT AS no_data, count(*) FILTER (receive_time_ns > {NOW}) AS future_data,
  ({NOW} - arg_max(receive_time_ns, (event_time_ns, sequence, receive_time_ns, ingest_id)) > {HOUR})::BIGINT AS stale_data, count(*) FILTER (abs(receive_time_ns - event_time_ns) > {HOUR}) AS clock_skew,
  count(*) FILTER (receive_time_ns - p > {2 * HOUR}) AS outage_gap FROM (SELECT *, lag(receive_time_ns) OVER (PARTITION BY source, venue, instrument_id, event_type ORDER BY event_time_ns, sequence, receive_time_ns, ingest_id, arrival_ord) AS p FROM dirty))
UNPIVOT (n FOR code IN (no_data, future_data, stale_data, clock_skew, outage_gap))""",
    ("dirty",),
)
def observe_monitor(spark, d):
    return observe.monitor(V.canon_dirty(spark, d), NOW, HOUR, HOUR, 2 * HOUR)


@query(_with(O.BOOK, "canon"))
def book_state(spark, d):
    c = V.canon(spark, d)
    kind = F.when(F.col("sequence") % 50 == 1, "book_snapshot").otherwise("book_delta")
    level = F.array(F.struct(F.round("price", 0).alias("price"), F.coalesce("size", F.lit(1.0)).alias("size")))
    none = F.lit(None).cast("array<struct<price:double,size:double>>")
    change = F.array(F.struct(F.when(F.col("arrival_ord") % 2 == 0, "bid").otherwise("ask").alias("side"), F.round("price", 0).alias("price"), F.when(F.col("arrival_ord") % 5 == 0, 0.0).otherwise(F.col("size")).alias("size")))
    e = c.select("instrument_id", F.col("sequence").alias("ord"), F.when(F.col("arrival_ord") % 211 == 0, F.col("sequence") + 1).otherwise(F.col("sequence")).alias("sequence"), kind.alias("event_type"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("previous_hash"), F.when(kind == "book_snapshot", level).otherwise(none).alias("bids"), none.alias("asks"), F.when(kind == "book_delta", change).alias("changes"))
    return observe.book_states(e)


@query("SELECT instrument_id, count(*) AS n, round(sum(price), 4) AS total, round(arg_max(price, (event_time_ns, ingest_id)), 6) AS last FROM canon GROUP BY 1", ("canon",))
def stream_parity(spark, d):
    """The state that a stream of the tape's files ends with: the last row that each key emitted."""
    import uuid

    from ..session import local_dir

    root = local_dir(spark)
    path = f"{root}/stream-{uuid.uuid4().hex}"
    tape = V.tape(spark, d).select("instrument_id", "event_time_ns", "ingest_id", "price")
    tape.repartitionByRange(4, "event_time_ns").write.parquet(path)
    name = f"parity_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 2).parquet(path)
    q = observe.running_counts(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{root}/ckpt-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table(name).groupBy("instrument_id").agg(F.max(F.struct("n", "total", "last")).alias("x"))
    return out.select("instrument_id", "x.n", F.round("x.total", 4).alias("total"), F.round("x.last", 6).alias("last"))


# ---- feeds, fingerprints of rows, gates ----


@query(f"SELECT instrument_id, event_time_ns // 1000000 AS time_ms, round(open, 6) AS open, round(close, 6) AS close FROM bars_h WHERE instrument_id IN ('view', 'click') AND event_time_ns >= {START + 3 * DAY} AND event_time_ns < {START + 20 * DAY}", ("bars_h",))
def feed_klines(spark, d):
    """Hourly bars landed by instrument and day and read as a feed: filters on the instrument and the time make the partitions,
    and each reads its own days."""
    path = _scratch(spark, "feed")
    b = V.bars(spark, d, HOUR)
    ms = F.expr("event_time_ns div 1000000")
    k = F.array(*[F.col(c).cast("string") for c in ("ms", "open", "high", "low", "close", "volume", "end", "volume", "trades")])
    b = b.withColumns({"ms": ms, "end": ms + 3_599_999})
    b.select(k.alias("k"), F.col("instrument_id").alias("i"), F.expr("ms div 86400000").alias("d")).repartition("i", "d").write.partitionBy("i", "d").json(path)
    feed = feeds.read_feed(spark, kind="klines", client="tapewright.sources.feeds:landed_days_client", landed=path.removeprefix("file://"), instruments="click,purchase,view", start_ms=START // 1_000_000, end_ms=END // 1_000_000, chunk_ms=5 * 86_400_000)
    rows = feed.where(F.col("instrument_id").isin("view", "click") & (F.col("time_ms") >= (START + 3 * DAY) // 1_000_000) & (F.col("time_ms") < (START + 20 * DAY) // 1_000_000))
    k = F.from_json("payload", "array<string>")
    return rows.select("instrument_id", "time_ms", F.round(k[1].cast("double"), 6).alias("open"), F.round(k[4].cast("double"), 6).alias("close"))


_ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":"' || o_totalprice::DECIMAL(18, 2) || '"}'"""


def _exact_orders(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderpriority")


@query(f"SELECT o_orderkey, sha256({_ORDER_JSON}) AS fingerprint FROM orders")
def row_fingerprints(spark, d):
    return rowprint.fingerprints(_exact_orders(spark, d)).select("o_orderkey", "fingerprint")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 3 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 211 = 3 OR o_orderkey % 97 = 5 UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 301 = 7")
def changed_rows(spark, d):
    """Orders that differ between two states of the table, found by the branches of their hash trees."""
    o = _exact_orders(spark, d)
    after = o.where("o_orderkey % 211 <> 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 5, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return rowprint.changed_rows(o, after.unionByName(o.where("o_orderkey % 301 = 7").withColumn("o_orderkey", -F.col("o_orderkey"))), ["o_orderkey"])


@query(
    """SELECT k AS package_id, 'research_gate' AS gate, s1 AS status, n1 AS reasons FROM g3 UNION ALL SELECT k, 'paper_gate', s2, n2 FROM g3 UNION ALL SELECT k, 'risk_review', s3, n3 FROM g3
UNION ALL SELECT k, 'live_gate', 'block', 1 + (s3 <> 'pass')::INT FROM g3"""
)
def gate_decisions(spark, d):
    """Orders as packages: what their lines and status say, put to the standard gates."""
    li = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("a"), F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), 1)).alias("r"))
    j = V.table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    given = {
        "verdict": F.when(F.col("o_orderstatus") == "F", "paper_candidate").when(F.col("o_orderstatus") == "O", "kill"),
        "paper_plan_status": F.when(F.col("o_orderpriority") != "5-LOW", "paper_ready").otherwise("draft"),
        "divergence_status": F.when(F.col("a") < 3, "risk_review_candidate").otherwise("stop"),
        "blocking_breaches": F.col("r").cast("string"), "observed_days": F.col("n").cast("string"), "minimum_days": F.lit("2"),
        "signals": F.col("q").cast("string"), "minimum_signals": F.when(F.col("o_orderkey") % 10 != 0, "60"),
        "risk_verdict": F.when(F.col("o_totalprice") > 50_000, "pass").otherwise("blocked"), "approval_status": F.lit("packaged"),
        "approval_config_hash": F.col("o_orderpriority"), "config_after_hash": F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("o_orderpriority")), "open_blockers": F.lit(""),
    }
    facts = j.select(F.col("o_orderkey").alias("package_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("value")) for k, v in given.items()])).alias("x")).select("package_id", "x.*")
    return gates.decisions(facts, gates.standard_rules(spark)).select("package_id", "gate", "status", F.size("reasons").cast("long").alias("reasons"))


ORACLES["gate_decisions"] = f"""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity)::BIGINT AS q, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 49) AS r FROM lineitem GROUP BY 1),
rules AS (SELECT o_orderkey AS k, [CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END] AS r1,
  [o_orderpriority <> '5-LOW', coalesce(a < 3, false), r <= 0, n >= 2, q >= CASE WHEN o_orderkey % 10 <> 0 THEN 60 END] AS r2,
  [o_totalprice > 50000, true, o_orderkey % 7 <> 0, true] AS r3 FROM orders LEFT JOIN l ON k = o_orderkey),
n AS (SELECT k, len(list_filter(r1, lambda x: NOT x)) AS f1, len(list_filter(r1, lambda x: x IS NULL)) AS u1, len(list_filter(r2, lambda x: NOT x)) AS f2, len(list_filter(r2, lambda x: x IS NULL)) AS u2,
  len(list_filter(r3, lambda x: NOT x)) AS f3, len(list_filter(r3, lambda x: x IS NULL)) AS u3 FROM rules),
g1 AS (SELECT *, f1 + u1 AS n1, CASE WHEN f1 > 0 THEN 'block' WHEN u1 > 0 THEN 'unknown' ELSE 'pass' END AS s1 FROM n),
g2 AS (SELECT *, f2 + u2 + (s1 <> 'pass')::INT AS n2, CASE WHEN f2 > 0 OR s1 = 'block' THEN 'block' WHEN u2 > 0 OR s1 = 'unknown' THEN 'unknown' ELSE 'pass' END AS s2 FROM g1),
g3 AS (SELECT *, f3 + u3 + (s2 <> 'pass')::INT AS n3, CASE WHEN f3 > 0 OR s2 = 'block' THEN 'block' WHEN u3 > 0 OR s2 = 'unknown' THEN 'unknown' ELSE 'pass' END AS s3 FROM g2)
{ORACLES["gate_decisions"]}"""


# ---- queries whose checks find something ----


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def subset_missing_faults(spark, d):
    """Customers without an urgent order that was filled."""
    urgent = V.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return lookups.missing_from(V.table(spark, d, "customer").select("c_custkey"), urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT instrument_id, count(*) AS event_count, CASE instrument_id WHEN 'click' THEN 'events' WHEN 'view' THEN 'quality.json' WHEN 'purchase' THEN 'missing COMMITTED' ELSE '' END AS problems FROM canon GROUP BY 1", ("canon",))
def ingest_bundle_faults(spark, d):
    """A bundle an instrument; of some the events, a document or the marker is lost or changed afterwards."""
    from ..sources import ingest
    from ..sources.fs import Folder

    tape, out = tables.saved(V.canon(spark, d), "bundle-tape"), []
    for name in sorted(r.instrument_id for r in tape.select("instrument_id").distinct().collect()):  # a bundle each
        path = _scratch(spark, f"bundle-{name}")
        receipt = ingest.publish(path, [], {"instrument": name}, tape.where(F.col("instrument_id") == name), spark.createDataFrame([("duplicates", 0)], "code string, n long"))
        if name == "click":
            tape.where(F.col("instrument_id") == name).limit(1).write.mode("append").parquet(f"{path}/events")
        elif name == "view":
            Folder(spark, path).write("quality.json", "[]")
        elif name == "purchase":
            Folder(spark, path).delete("COMMITTED")
        out.append((name, receipt["event_count"], ", ".join(ingest.bundle_problems(spark, path))))
    return spark.createDataFrame(out, "instrument_id string, event_count long, problems string")


@query(
    """SELECT c_custkey, coalesce(n >= 8, false) AND coalesce(lo <= 100000, false) AND coalesce(f = 0, false) AS promoted,
  (NOT coalesce(n >= 8, false))::INT + (NOT coalesce(lo <= 100000, false))::INT + CASE WHEN n IS NULL THEN 1 ELSE f END::BIGINT AS broken
FROM (SELECT c_custkey FROM customer) c LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lo FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) FILTER (most > 450000) AS f FROM (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS most FROM orders GROUP BY 1, 2) GROUP BY 1) s ON c_custkey = s.o_custkey"""
)
def promotion_decisions(spark, d):
    """Customers as candidates: their orders give the statistics, a scenario is a priority and fails with a very large order."""
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_totalprice")
    given = o.groupBy("c_custkey").agg(F.count("*").cast("double").alias("n"), F.min("o_totalprice").alias("lo")).unpivot(["c_custkey"], ["n", "lo"], "name", "value")
    stats = given.unionByName(V.table(spark, d, "customer").select("c_custkey", F.lit("n").alias("name"), F.lit(None).cast("double").alias("value")))
    stresses = o.groupBy("c_custkey", F.col("o_orderpriority").alias("scenario")).agg(F.when(F.max("o_totalprice") > 450_000, "blocked").otherwise("pass").alias("status"))
    out = sweep.promotions(stats, stresses, {"n": (">=", 8), "lo": ("<=", 100_000)}, "c_custkey")
    everyone = V.table(spark, d, "customer").select("c_custkey").join(out, "c_custkey", "left")
    return everyone.select("c_custkey", F.coalesce("promoted", F.lit(False)).alias("promoted"), F.coalesce(F.size("broken"), F.lit(3)).cast("long").alias("broken"))
