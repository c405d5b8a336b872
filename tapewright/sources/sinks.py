"""Writing: immutable partitions, create-only archives, ledgers, small reports."""

from __future__ import annotations

import fcntl
import hashlib
import html
import json
import os
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import canonical_order
from ..operators.lookups import order_free_digests
from ..values import canonical_json  # noqa: F401  part of this module's names
from .fs import Folder

SEGMENT = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
LAYOUT = ["source", "venue", "instrument_id", "date"]


class PartitionExists(Exception):
    pass


#: Partitions that are published at a time: each takes a few calls to the file system.
PUBLISHERS = 32


def write_events(events: DataFrame, root: str) -> list[tuple]:
    """Append partitions source/venue/instrument/date, each once and whole.

    Rows are made once: they go to a hidden folder, clustered by partition and in canonical order, zstd, and the fingerprints
    are those of the rows that were written. A partition is then claimed by a file that only one writer can create; if any is
    there already, nothing is published and the claims of this call are given back. Claims and renames run side by side. A
    failed job leaves no half partition. Hidden names are not read as data."""
    spark = events.sparkSession
    dated = events.withColumn("date", F.date_format(F.timestamp_micros(F.expr("event_time_ns div 1000")), "yyyy-MM-dd"))
    base = Folder(spark, root)
    base.make("_claims")
    stage, claimed, moved = f"_stage-{uuid.uuid4().hex}", [], []
    try:
        dealt = dated.repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, *canonical_order("arrival_ord" in events.columns))
        dealt.write.option("compression", "zstd").partitionBy(*LAYOUT).parquet(base.path(stage))
        written = spark.read.schema(dated.schema).parquet(base.path(stage)) if base.matching(f"{stage}/*=*") else dated.limit(0)
        marks = {tuple(r[c] for c in LAYOUT): f"{r['n']}:{r['digest']}" for r in order_free_digests(written, LAYOUT, events.columns).collect()}  # a partition a row
        for row in marks:
            if not all(v is not None and SEGMENT.match(str(v)) for v in row):
                raise ValueError(f"unsafe partition value in {row}")
        place = {row: "/".join(f"{c}={v}" for c, v in zip(LAYOUT, row)) for row in marks}
        there = base.matching("/".join(f"{c}=*" for c in LAYOUT))
        if taken := sorted(there & set(place.values())):
            raise PartitionExists(taken[0])

        def claim(path: str) -> None:
            name = f"_claims/{hashlib.sha256(path.encode()).hexdigest()}"
            if not base.claim(name, path):
                raise PartitionExists(path)
            claimed.append(name)

        def publish(row: tuple) -> None:
            base.put(f"{stage}/{place[row]}/_fingerprint.sha256", hashlib.sha256(marks[row].encode()).hexdigest())
            base.move(f"{stage}/{place[row]}", place[row])
            moved.append(place[row])

        with ThreadPoolExecutor(PUBLISHERS) as pool:
            for step, items in ((claim, sorted(place.values())), (publish, sorted(place))):
                for done in [pool.submit(step, x) for x in items]:
                    done.result()
    except BaseException:
        for path in moved:
            base.delete(path)
        for name in claimed:
            base.delete(name)
        raise
    finally:
        base.delete(stage)
    return sorted(marks)


def write_atomic(path: str, text: str, create_only: bool = False) -> None:
    """A whole file or none. create_only: the same text again is fine, another text is an error."""
    if create_only and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return
        raise FileExistsError(path)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def archive_raw(root: str, received_ns: int, body: str) -> str:
    """Keep a response under its receive time and hash."""
    path = os.path.join(root, f"{received_ns}-{hashlib.sha256(body.encode()).hexdigest()}.json")
    write_atomic(path, body, create_only=True)
    return path


def _last_line(f) -> bytes:
    """The last line of a binary file that holds one, read from its end."""
    end = f.seek(0, os.SEEK_END)
    size = 4096
    while True:
        begin = max(0, end - size)
        f.seek(begin)
        lines = [x for x in f.read(end - begin).split(b"\n") if x.strip()]
        if not begin or len(lines) > 1:
            return lines[-1] if lines else b""
        size *= 2


def append_ledger(path: str, entry: dict) -> dict:
    """Add an entry that names the hash of the one before it and has its own. The file is locked meanwhile, so that two
    writers can't name the same predecessor, and only its end is read."""
    with open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        last = _last_line(f)
        body = {k: v for k, v in entry.items() if k not in ("previous_hash", "entry_hash")} | {"previous_hash": json.loads(last)["entry_hash"] if last else None}
        body["entry_hash"] = hashlib.sha256(canonical_json(body).encode()).hexdigest()
        f.write(canonical_json(body).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())
    return body


def html_report(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """A static page of small result tables."""
    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(limit).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)
