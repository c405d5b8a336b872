"""Feeds as Spark sources."""

import json
import os

import pytest

from tapewright.sources import feeds

CHUNK = 1000


@pytest.fixture
def landed(tmp_path):
    os.makedirs(tmp_path / "landed")
    os.makedirs(tmp_path / "notes")
    for name, n in (("AAA", 50), ("BBB", 20)):
        (tmp_path / "landed" / f"{name}.json").write_text(json.dumps([[t * 100, "1", "2", "0.5", str(t), "9", t * 100 + 99, "8", 3] for t in range(n)]))
    (tmp_path / "landed" / "TTT.json").write_text(json.dumps([{"a": i, "p": "1", "q": "2", "T": i // 3 * 100, "m": True} for i in range(90)]))
    return {"client": "tapewright.sources.feeds:landed_client", "landed": str(tmp_path / "landed"), "notes": str(tmp_path / "notes"), "start_ms": 0, "end_ms": 5000, "chunk_ms": CHUNK, "page": 4}


def notes(options):
    return [json.loads(open(f"{options['notes']}/{n}").read()) for n in os.listdir(options["notes"])]


def test_partitions_read_their_own_range(spark, landed):
    df = feeds.read_feed(spark, kind="klines", instruments="AAA,BBB", **landed)
    assert df.rdd.getNumPartitions() == 10
    rows = df.collect()
    assert sorted((r.instrument_id, r.time_ms) for r in rows) == [("AAA", t * 100) for t in range(50)] + [("BBB", t * 100) for t in range(20)]
    asked = notes(landed)
    assert all(a["rows"] <= 4 and a["startTime"] // CHUNK == min(a["endTime"], 4999) // CHUNK for a in asked)


def test_filters_make_fewer_partitions(spark, landed):
    df = feeds.read_feed(spark, kind="klines", instruments="AAA,BBB", **landed).where("instrument_id = 'AAA' AND time_ms >= 1500 AND time_ms < 2500")
    assert sorted(r.time_ms for r in df.collect()) == list(range(1500, 2500, 100))
    asked = notes(landed)
    assert {a["symbol"] for a in asked} == {"AAA"} and min(a["startTime"] for a in asked) >= 1500 and max(a["endTime"] for a in asked) < 2500


def test_trades_page_by_number(spark, landed):
    rows = feeds.read_feed(spark, kind="trades", instruments="TTT", **landed).collect()
    assert sorted(json.loads(r.payload)["a"] for r in rows) == list(range(90))


def test_a_shared_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    get = feeds.Paced(lambda url, p: (200, "[]"), rate=10, tasks=4, sleep=sleep, clock=lambda: now[0])
    for _ in range(5):
        get("u")
    assert now[0] == pytest.approx(1.6) and len(slept) == 4  # four tasks at 2.5 reads a second each


def test_a_stream_survives_breaks_and_restarts(spark, tmp_path):
    steps = [0, 1, 2, "break", 3, 4, "pause", 5, 6, 7, "break", "break", 8, "pause", 9, 10, 11, 12]
    (tmp_path / "script.json").write_text(json.dumps(steps))
    spark.dataSource.register(feeds.FeedSource)
    options = {"client": "tests.feed_fixture:connect", "script": str(tmp_path / "script.json"), "archive": str(tmp_path / "archive"), "batch": "4", "longest_pause": "0.01"}

    def run():
        q = spark.readStream.format("feed").options(**options).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    (tmp_path / "script.json").write_text(json.dumps(steps[:8]))
    run()
    archive = feeds.Archive(str(tmp_path / "archive"))
    archive.add(archive.count(), [{"sequence": 6, "received_ns": 1, "payload": json.dumps({"sequence": 6, "text": "m6"}), "sha256": ""}])  # archived, then the process died
    (tmp_path / "script.json").write_text(json.dumps(steps))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.sequence for r in got) == list(range(13))
    assert all(json.loads(r.payload)["text"] == f"m{r.sequence}" for r in got)


def test_a_stream_gives_up(tmp_path):
    (tmp_path / "script.json").write_text(json.dumps([0] + ["break"] * 9))
    pauses = []
    stream = feeds.FeedStream({"client": "tests.feed_fixture:connect", "script": str(tmp_path / "script.json"), "archive": str(tmp_path / "a"), "budget": "3"}, sleep=pauses.append)
    with pytest.raises(RuntimeError, match="4 times"):
        for _ in range(20):
            stream.latestOffset()
    assert pauses == [2, 4, 8]
