"""Bounded reads and their evidence: retried GETs, and bundles that are published whole or not at all."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import canonical_order
from ..operators.lookups import coverage, order_free_digest
from ..values import canonical_json, fingerprint
from .fs import Folder

FILES = ("raw.json", "request.json", "events", "quality.json", "manifest.json", "receipt.json", "COMMITTED")


def get_json(get: Callable[[str, dict | None], tuple[int, str]], url: str, params: dict | None = None, attempts: int = 3, pause: float = 0.1, evidence: list | None = None):
    """A GET with retries: 429, 5xx and errors of the transport are tried again after 0.1, 0.2, 0.4 ... seconds. get
    returns (status, body); every attempt is noted in ``evidence``."""
    last: Exception | None = None
    for k in range(attempts):
        note = {"url": url, "attempt": k + 1, "received_at_ns": time.time_ns()}
        try:
            status, body = get(url, params)
            if status == 429 or status >= 500:
                raise RuntimeError(f"temporary status {status}")
            if status >= 400:
                raise PermissionError(f"status {status}")
            if evidence is not None:
                evidence.append(note | {"status": status, "fingerprint": hashlib.sha256(body.encode()).hexdigest()})
            return json.loads(body)
        except Exception as error:  # noqa: BLE001  any failure of an idempotent read may be tried again
            last = error
            if evidence is not None:
                evidence.append(note | {"error": type(error).__name__})
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
    raise RuntimeError(f"read failed after {attempts} attempt(s): {last}") from last


def _events_digest(events: DataFrame) -> str:
    return "|".join(map(str, order_free_digest(events, sorted(events.columns)).first()))


def publish(target: str, raw, request: dict, events: DataFrame, quality: DataFrame) -> dict:
    """Write a bundle beside the target and rename it when it is whole: raw response, request, canonical events as Parquet
    in canonical order, quality counts, coverage, a receipt that fingerprints them, and a marker with the receipt's own.
    The folder may be on any file system that Spark writes to."""
    spark = events.sparkSession
    parent, _, name = target.rstrip("/").rpartition("/")
    base = Folder(spark, parent or ".")
    if base.exists(name):
        raise FileExistsError(target)
    if events.isEmpty():
        raise ValueError("no canonical events")
    stage = f"_stage-{uuid.uuid4().hex}"
    base.make(stage)
    try:
        events.orderBy(*canonical_order("arrival_ord" in events.columns)).write.option("compression", "zstd").parquet(base.path(f"{stage}/events"))
        documents = {"raw.json": raw, "request.json": request, "quality.json": [r.asDict() for r in quality.orderBy("code").collect()], "manifest.json": [r.asDict() for r in coverage(events).collect()]}
        for file, value in documents.items():
            base.write(f"{stage}/{file}", canonical_json(value))
        receipt = {file.split(".")[0]: fingerprint(value) for file, value in documents.items()} | {"events": _events_digest(events), "event_count": events.count()}
        receipt["receipt"] = fingerprint(receipt)
        base.write(f"{stage}/receipt.json", canonical_json(receipt))
        base.write(f"{stage}/COMMITTED", receipt["receipt"])
        if problems := bundle_problems(spark, base.path(stage)):
            raise ValueError(f"bundle is not whole: {problems}")
        base.move(stage, name)
    finally:
        base.delete(stage)
    return receipt


def bundle_problems(spark, path: str) -> list[str]:
    """Parts of a bundle that are missing or have other fingerprints than its receipt says."""
    at = Folder(spark, path)
    missing = [n for n in FILES if not at.exists(n)]
    if missing:
        return [f"missing {n}" for n in missing]
    receipt = json.loads(at.read("receipt.json"))
    out = [n for n in ("raw.json", "request.json", "quality.json", "manifest.json") if fingerprint(json.loads(at.read(n))) != receipt[n.split(".")[0]]]
    events = spark.read.parquet(at.path("events"))
    if _events_digest(events) != receipt["events"] or events.count() != receipt["event_count"]:
        out.append("events")
    if not at.read("COMMITTED") == receipt["receipt"] == fingerprint({k: v for k, v in receipt.items() if k != "receipt"}):
        out.append("receipt.json")
    return out
