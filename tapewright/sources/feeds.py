"""Market feeds as Spark sources: one partitioned reader of all bounded reads, and a stream that replays from its archive.

What reaches a feed is a client: ``client`` names a factory as module:function, which is called with the options where it is
needed (on executors for reads, in the stream's own process for streams). For reads it returns get(url, parameters) -> (status,
body); for streams connect(attempt) -> an iterator of texts, with None where nothing is there just now."""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401  pa.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThan

from .markets import prediction_document, spot_rows

#: Kinds of read, and whether a range of time cuts them into chunks.
KINDS = {"klines": True, "trades": True, "price_history": True, "book": False, "depth": False, "fee_rate": False, "markets": False}
SPOT = ("klines", "trades", "depth")
SCHEMA = "kind string, instrument_id string, time_ms long, payload string"
ARROW = pa.schema([("kind", pa.string()), ("instrument_id", pa.string()), ("time_ms", pa.int64()), ("payload", pa.string())])


def client_of(options: dict):
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class Range(InputPartition):
    def __init__(self, kind: str, instrument: str | None, start: int | None, end: int | None):
        self.kind, self.instrument, self.start, self.end = kind, instrument, start, end


class Paced:
    """A client's share of the feed's rate: ``rate`` reads a second over all tasks, of which ``tasks`` run at a time."""

    def __init__(self, get, rate: float, tasks: int, sleep=time.sleep, clock=time.monotonic):
        self.get, self.pause, self.sleep, self.clock, self.next = get, tasks / rate if rate else 0.0, sleep, clock, 0.0

    def __call__(self, url, parameters=None):
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.pause
        return self.get(url, parameters)


class FeedReader(DataSourceReader):
    """A partition per instrument and chunk of time. Filters on the instrument and on the time are pushed: partitions outside
    them are not made, and reads ask for their own range only."""

    def __init__(self, options: dict):
        self.options = options
        self.instruments = [s for s in options.get("instruments", "").split(",") if s] or [None]
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start_ms", "end_ms"))

    def pushFilters(self, filters):  # noqa: N802 the interface's name
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column == "instrument_id" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.instruments = [i for i in self.instruments if i in wanted]
            elif column == "time_ms" and isinstance(f, GreaterThanOrEqual) and self.start is not None:
                self.start = max(self.start, int(f.value))
                continue
            elif column == "time_ms" and isinstance(f, LessThan) and self.end is not None:
                self.end = min(self.end, int(f.value))
                continue
            yield f  # Spark tests what is left, and a pruned instrument once more

    def partitions(self):
        kind = self.options["kind"]
        if kind not in KINDS:
            raise ValueError(f"unknown kind of read: {kind}")
        if not KINDS[kind] or self.start is None or self.end is None:
            return [Range(kind, i, self.start, self.end) for i in self.instruments]
        chunk = int(self.options.get("chunk_ms", "86400000"))
        return [Range(kind, i, s, min(s + chunk, self.end)) for i in self.instruments for s in range(self.start, self.end, chunk)] or [Range(kind, None, 0, 0)]

    def _rows(self, p: Range) -> list[tuple]:
        get = Paced(client_of(self.options), float(self.options.get("rate", "0")), int(self.options.get("tasks", "1")))
        base = self.options.get("base", "https://feed.example")
        if p.kind in SPOT:
            rows = spot_rows(get, base, "book" if p.kind == "depth" else p.kind, p.instrument, p.start, p.end, self.options.get("interval", "1m"), int(self.options.get("page", "1000")))
            at = {"klines": lambda r: int(r[0]), "trades": lambda r: int(r["T"]), "depth": lambda r: None}[p.kind]
            return [(at(r), r) for r in (rows if isinstance(rows, list) else [rows]) if p.start is None or at(r) is None or p.start <= at(r) < p.end]
        if p.kind == "markets":
            return [(None, m) for m in prediction_document(get, base, base, "markets")]
        if p.kind == "price_history":
            rows = prediction_document(get, base, base, p.kind, p.instrument, None if p.start is None else {"startTs": p.start // 1000, "endTs": -(-p.end // 1000)})["history"]
            in_ms = lambda t: int(t) if t >= 10**11 else int(t) * 1000
            return [(in_ms(r["t"]), r) for r in rows if p.start is None or p.start <= in_ms(r["t"]) < p.end]
        return [(None, prediction_document(get, base, base, p.kind, p.instrument))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start is not None and partition.start == partition.end:
            return
        rows = self._rows(partition)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(partition.kind, partition.instrument, t, json.dumps(r)) for t, r in rows]), ARROW)], schema=ARROW)


class Archive:
    """Segments of messages as JSON lines, in a folder that the stream's process and executors reach: numbered from 0 without gaps,
    each whole or not there."""

    def __init__(self, uri: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        self.fs.create_dir(self.root, recursive=True)

    def _path(self, k: int) -> str:
        return f"{self.root}/segment-{k:012d}.jsonl"

    def count(self) -> int:
        names = [f.base_name for f in self.fs.get_file_info(pa.fs.FileSelector(self.root)) if f.base_name.startswith("segment-")]
        return max((int(n[8:20]) + 1 for n in names), default=0)

    def add(self, k: int, records: list[dict]) -> None:
        temp = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write("".join(json.dumps(r) + "\n" for r in records).encode())
        self.fs.move(temp, self._path(k))

    def read(self, k: int) -> list[dict]:
        with self.fs.open_input_stream(self._path(k)) as f:
            return [json.loads(line) for line in f.read().decode().splitlines()]


class FeedStream(DataSourceStreamReader):
    """Messages of a connection, archived before any batch sees them: an offset is a number of segments, and a batch replays its
    segments. So a restart neither loses nor repeats what was archived; what a new connection sends again is told by its
    sequence. A broken connection is made again, ``budget`` times in a row without a message, after 2, 4, 8 .. 30 seconds."""

    def __init__(self, options: dict, sleep=time.sleep):
        self.options, self.sleep = options, sleep
        self.batch, self.budget = int(options.get("batch", "1000")), int(options.get("budget", "5"))
        self.messages, self.attempt, self.broke, self.ended = None, 0, 0, False
        self.archive, self.segments, self.last = None, 0, None

    def _open(self) -> Archive:
        if self.archive is None:
            self.archive = Archive(self.options["archive"])
            self.segments = self.archive.count()
            if self.segments:
                self.last = self.archive.read(self.segments - 1)[-1]["sequence"]
        return self.archive

    def initialOffset(self) -> dict:  # noqa: N802 the interface's name
        return {"segments": 0}

    def _drain(self) -> list[dict]:
        """What the connection has now, up to a batch."""
        got: list[dict] = []
        name = self.options.get("sequence", "sequence")
        while len(got) < self.batch and not self.ended:
            try:
                if self.messages is None:
                    self.messages = client_of(self.options)(self.attempt)
                text = next(self.messages)
            except StopIteration:
                self.ended = True
                break
            except Exception as error:  # noqa: BLE001  whatever breaks a stream
                self.messages, self.attempt, self.broke = None, self.attempt + 1, self.broke + 1
                if self.broke > self.budget:
                    raise RuntimeError(f"the stream broke {self.broke} times in a row") from error
                self.sleep(min(2**self.broke, float(self.options.get("longest_pause", "30"))))
                continue
            if text is None:
                break
            sequence = int(json.loads(text)[name])
            if self.last is None or sequence > self.last:
                got.append({"sequence": sequence, "received_ns": time.time_ns(), "payload": text, "sha256": hashlib.sha256(text.encode()).hexdigest()})
                self.last, self.broke = sequence, 0
        return got

    def latestOffset(self) -> dict:  # noqa: N802
        archive = self._open()
        if records := self._drain():
            archive.add(self.segments, records)
            self.segments += 1
        return {"segments": self.segments}

    def partitions(self, start: dict, end: dict):
        return [Range("segment", self.options["archive"], k, k + 1) for k in range(start["segments"], end["segments"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for r in Archive(partition.instrument).read(partition.start):
            yield (r["sequence"], r["received_ns"], r["payload"], r["sha256"])


class FeedSource(DataSource):
    """spark.read.format("feed"): kind, client, instruments (commas between), start_ms, end_ms, chunk_ms, page, interval, base, rate
    and tasks (reads a second in all, and how many tasks share them). Needs spark.sql.python.filterPushdown.enabled for filters.

    spark.readStream.format("feed"): client, archive, sequence (the field that orders messages), batch, budget."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA if "kind" in self.options else "sequence long, received_ns long, payload string, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FeedStream(self.options)


def landed_client(options: dict):
    """A client of pages that were landed as files: ``landed``/<instrument>.json holds an instrument's rows in time order, of
    which it answers those that are asked for. What was asked is noted in ``notes``, if that is given."""
    fs, root = pa.fs.FileSystem.from_uri(options["landed"] if "://" in options["landed"] else f"file://{options['landed']}")

    def get(url: str, asked: dict | None) -> tuple[int, str]:
        asked = asked or {}
        with fs.open_input_stream(f"{root}/{asked.get('symbol') or asked.get('market')}.json") as f:
            rows = json.loads(f.read().decode())
        at = (lambda r: r[0]) if isinstance(rows[0], list) else (lambda r: r.get("T", r.get("t")))
        low, high = asked.get("startTime", 0), asked.get("endTime", 2**62)
        page = [r for r in rows if low <= at(r) <= high and ("fromId" not in asked or r["a"] >= asked["fromId"])]
        if "notes" in options:
            with fs.open_output_stream(f"{options['notes'].removeprefix('file://')}/{uuid.uuid4().hex}") as f:
                f.write(json.dumps({"url": url, **asked, "rows": len(page[: asked.get('limit', len(page))])}).encode())
        return 200, json.dumps(page[: asked.get("limit", len(page))])

    return get


def landed_days_client(options: dict):
    """A client of klines that Spark landed by instrument and day: ``landed``/i=<instrument>/d=<day>/*.json, a row {"k": [..]} a
    line. A read opens the days that it asks for."""
    fs, root = pa.fs.FileSystem.from_uri(options["landed"] if "://" in options["landed"] else f"file://{options['landed']}")
    day_ms = 86_400_000

    def get(url: str, asked: dict | None) -> tuple[int, str]:
        rows = []
        for day in range(asked["startTime"] // day_ms, asked["endTime"] // day_ms + 1):
            folder = f"{root}/i={asked['symbol']}/d={day}"
            for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)):
                if f.base_name.endswith(".json"):
                    with fs.open_input_stream(f.path) as stream:
                        rows += [json.loads(line)["k"] for line in stream.read().decode().splitlines()]
        page = sorted((r for r in rows if asked["startTime"] <= int(r[0]) <= asked["endTime"]), key=lambda r: int(r[0]))
        return 200, json.dumps(page[: asked["limit"]])

    return get


def read_feed(spark, **options):
    """A bounded read as rows (kind, instrument_id, time_ms, payload as JSON)."""
    spark.dataSource.register(FeedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("feed").options(**{k: str(v) for k, v in options.items()}).load()

