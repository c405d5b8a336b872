"""Clients of public market feeds: paged reads, reads of one document by kind, and streams that reconnect and archive.

They are given the function that reads (url, parameters) and answers (status, body), so that tests and backfills read from
files and nothing here opens a connection by itself."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..operators import lookups
from . import files
from .fs import Folder
from .ingest import get_json

Get = Callable[[str, dict | None], tuple[int, str]]
#: Rows of a page at most.
PAGE = 1_000


def spot_rows(get: Get, base: str, kind: str, symbol: str, start_ms: int | None = None, end_ms: int | None = None, interval: str = "1m", limit: int = PAGE) -> list:
    """Klines, aggregated trades or a depth document of a spot market.

    With both ends, pages follow each other until one is short or reaches the end: klines go on a millisecond after the last
    opening time, trades with the number after the last one's. Rows at or after the end are dropped."""
    path = {"klines": "/api/v3/klines", "trades": "/api/v3/aggTrades", "book": "/api/v3/depth"}
    if kind not in path:
        raise ValueError(f"unknown kind of read: {kind}")
    if not symbol:
        raise ValueError("a read needs a symbol")
    size = min(limit, PAGE)
    ask: dict = {"symbol": symbol, "limit": size} | ({"interval": interval} if kind == "klines" else {})
    if start_ms is not None:
        ask["startTime"] = start_ms
    if end_ms is not None:
        ask["endTime"] = end_ms - 1
    if kind == "book" or start_ms is None or end_ms is None:
        return get_json(get, base + path[kind], ask)
    at = (lambda row: int(row[0])) if kind == "klines" else (lambda row: int(row["T"]))
    out: list = []
    while True:
        page = get_json(get, base + path[kind], ask)
        if not isinstance(page, list):
            raise TypeError("a page must be a list")
        out += [row for row in page if at(row) < end_ms]
        if len(page) < size or at(page[-1]) + (kind == "klines") >= end_ms:  # trades share a millisecond, klines do not
            return out
        ask = ask | {"startTime": at(page[-1]) + 1} if kind == "klines" else {"symbol": symbol, "limit": size, "fromId": int(page[-1]["a"]) + 1}


def prediction_document(get: Get, catalogue: str, book: str, kind: str, token: str | None = None, parameters: dict | None = None):
    """Markets of the catalogue, or the book, fee rate or price history of an outcome's token."""
    if kind == "markets":
        return get_json(get, f"{catalogue}/markets", parameters)
    if not token:
        raise ValueError("reads of a book need a token")
    reads = {"book": ("/book", {"token_id": token}), "fee_rate": (f"/fee-rate/{token}", None), "price_history": ("/prices-history", {"market": token} | (parameters or {}))}
    if kind not in reads:
        raise ValueError(f"unknown kind of read: {kind}")
    path, ask = reads[kind]
    return get_json(get, book + path, ask)


def reconnecting(connect: Callable[[], Iterator[str]], archive: Callable[[int, str], None], budget: int = 5, sleep: Callable[[float], None] = time.sleep, notes: dict | None = None) -> Iterator[dict]:
    """Messages of a stream that is connected again when it breaks, ``budget`` times, after 2, 4, 8 ... 30 seconds.

    Every message is archived before it is handed on. notes counts connections, messages and reconnects and lists errors."""
    notes = {} if notes is None else notes
    notes |= {"connections": 0, "messages": 0, "reconnects": 0, "errors": []}
    while True:
        try:
            notes["connections"] += 1
            for text in connect():
                message = json.loads(text)
                archive(time.time_ns(), text)
                notes["messages"] += 1
                yield message
        except Exception as error:  # noqa: BLE001  whatever breaks a stream
            notes["errors"].append(type(error).__name__)
            if notes["reconnects"] >= budget:
                raise RuntimeError(f"the stream broke {notes['reconnects'] + 1} times") from error
            notes["reconnects"] += 1
            sleep(min(2 ** notes["reconnects"], 30))
            continue
        return


def landing(spark: SparkSession, root: str) -> Callable[[int, str], None]:
    """An archive whose files a file stream can read: one message a file, named by its receive time and hash, written once."""
    at = Folder(spark, root)
    at.make()

    def archive(received_ns: int, text: str) -> None:
        at.write(f"{received_ns:020d}-{hashlib.sha256(text.encode()).hexdigest()}.json", text, create_only=True)

    return archive


def landed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The stream of archived messages."""
    return spark.readStream.schema(schema).json(root)


class Adapter:
    """What every feed offers, read-only: instruments, raw rows, events, a comparison with another source, a manifest, and
    what trading there costs. Subclasses fill in what their feed has; get answers requests, spark makes tables."""

    name = ""
    kinds: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, get: Get):
        self.spark, self.get = spark, get

    def discover(self) -> DataFrame:
        raise NotImplementedError(f"{self.name} lists no instruments")

    def fetch(self, kind: str, instrument: str, start_ms: int | None = None, end_ms: int | None = None, **more) -> list:
        raise NotImplementedError(f"{self.name} reads nothing")

    def normalize(self, kind: str, raw: list, instrument: str, receive_ns: int) -> DataFrame:
        raise NotImplementedError(f"{self.name} makes no events")

    def cross_check(self, primary: DataFrame, reference: DataFrame) -> DataFrame:
        return lookups.cross_check_bps(primary, reference, ["event_time_ns"])

    def manifest(self, events: DataFrame) -> DataFrame:
        return lookups.coverage(events)

    def costs(self, instrument: str) -> dict[str, str]:
        """Fee rate and slippage as decimals in text."""
        return {"fee_rate": "0.001", "slippage_bps": "5"}


class SpotAdapter(Adapter):
    name, kinds = "spot", ("klines", "trades", "book")

    def __init__(self, spark: SparkSession, get: Get, base: str = "https://spot.example"):
        super().__init__(spark, get)
        self.base = base

    def discover(self) -> DataFrame:
        rows = [(s["symbol"], s["status"], [(f["filterType"], f.get("tickSize"), f.get("stepSize")) for f in s["filters"]]) for s in get_json(self.get, f"{self.base}/api/v3/exchangeInfo")["symbols"]]
        return files.trading_symbols(self.spark.createDataFrame(rows, "symbol string, status string, filters array<struct<filterType:string,tickSize:string,stepSize:string>>"))

    def fetch(self, kind, instrument, start_ms=None, end_ms=None, **more):
        got = spot_rows(self.get, self.base, kind, instrument, start_ms, end_ms, **more)
        return got if isinstance(got, list) else [got]

    def normalize(self, kind, raw, instrument, receive_ns):
        if kind == "klines":
            return files.normalize_klines(self.spark.createDataFrame([([str(v) for v in r],) for r in raw], "k array<string>"), instrument, receive_ns)
        if kind == "trades":
            rows = [(int(r["a"]), r["p"], r["q"], int(r["T"]), bool(r["m"])) for r in raw]
            return files.normalize_trades(self.spark.createDataFrame(rows, "a long, p string, q string, T long, m boolean"), instrument, receive_ns)
        rows = [(int(r["lastUpdateId"]), r["bids"], r["asks"]) for r in raw]
        return files.normalize_depth(self.spark.createDataFrame(rows, "lastUpdateId long, bids array<array<string>>, asks array<array<string>>"), instrument, receive_ns)


class PredictionAdapter(Adapter):
    name, kinds = "prediction", ("markets", "book", "fee_rate", "price_history")

    def __init__(self, spark: SparkSession, get: Get, catalogue: str = "https://catalogue.example", book: str = "https://book.example"):
        super().__init__(spark, get)
        self.catalogue, self.book = catalogue, book

    def discover(self) -> DataFrame:
        rows = [(str(m["id"]), m["clobTokenIds"], m["outcomes"]) for m in self.fetch("markets", "")]
        return files.outcome_tokens(self.spark.createDataFrame(rows, "market string, clobTokenIds string, outcomes string"))

    def fetch(self, kind, instrument, start_ms=None, end_ms=None, **more):
        got = prediction_document(self.get, self.catalogue, self.book, kind, instrument or None, more or None)
        return got if isinstance(got, list) else got.get("history", [got])

    def normalize(self, kind, raw, instrument, receive_ns):
        if kind != "price_history":
            raise ValueError(f"{kind} gives no prices")
        rows = [(instrument, int(r["t"]), float(r["p"])) for r in raw]
        return files.normalize_prediction(self.spark.createDataFrame(rows, "instrument_id string, t long, p double"), receive_ns)

    def costs(self, instrument):
        basis = self.fetch("fee_rate", instrument)[0].get("base_fee", 0)
        return {"fee_rate": format(Decimal(str(basis)) / 10_000, "f"), "slippage_bps": "0"}
