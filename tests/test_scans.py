"""Scans, folds, books, rolls and draws against plain Python, with deals so small that every key is split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import books, draws, features, lookups, risk, rolls, scans
from tapewright.streaming import observe


def rows_of(df, *by):
    return sorted(df.collect(), key=lambda r: [(r[c] is not None, r[c]) for c in by])


# --- scans


def test_scan_of_a_hot_key(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 9 + ["b", None]), t, rng.choice([None, rng.randrange(-9, 9)])) for t in range(400)]
    df = spark.createDataFrame(data, "k string, t long, v long").repartition(5)
    kinds = ["sum", "max", "min", "last", "sum_before", "last_before"]
    got = scans.scan(df, ["k"], ["t"], {k: (k, F.col("v")) for k in kinds}, width=7)
    seen: dict = {}
    for r in rows_of(got, "t"):
        before = [v for v in seen.setdefault(r.k, []) if v is not None]
        seen[r.k].append(r.v)
        now = before + [r.v] * (r.v is not None)
        assert r["sum"] == (sum(now) if now else None) and r["sum_before"] == (sum(before) if before else None)
        assert r["max"] == max(now, default=None) and r["min"] == min(now, default=None)
        assert r["last"] == (now[-1] if now else None) and r["last_before"] == (before[-1] if before else None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_deal" in plan and got.count() == len(data)


def test_scan_counts_equal_times(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 9, 4.0)], "k string, t long, v double")
    got = scans.scan(df, ["k"], ["t"], {"s": ("sum", F.col("v"))}, width=2, ties=True)
    assert [r.s for r in rows_of(got, "t", "v")] == [3.0, 3.0, 7.0]


def test_filled(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([None, 1.0, None, None, 2.0, None])], "k string, t long, v double")
    assert [r.v for r in rows_of(features.filled(df, "v", ["k"], ["t"], 2), "t")] == [None, 1.0, 1.0, 1.0, 2.0, 2.0]


def test_drawdowns_cross_deals(spark):
    rng = random.Random(4)
    values = [100.0]
    for _ in range(300):
        values.append(max(1.0, values[-1] + rng.choice([-2, -1, 0, 1, 2])))
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(values)], "k string, event_time_ns long, equity double")
    peak, run = 0.0, 0
    for r in rows_of(features.drawdowns(df, ["k"], width=10), "event_time_ns"):
        peak = max(peak, r.equity)
        run = run + 1 if r.equity < peak else 0
        assert (r.peak, r.run) == (peak, run) and r.drawdown == pytest.approx((peak - r.equity) / peak)


def test_as_of_and_costs_cross_deals(spark):
    rng = random.Random(5)
    left = [(rng.randrange(500), i) for i in range(100)]
    right = {rng.randrange(500): float(i) for i in range(80)}
    l = spark.createDataFrame([("k", *x) for x in left], "key string, t long, id long")
    r = spark.createDataFrame([("k", *x) for x in right.items()], "key string, t long, v double")
    for strict in (True, False):
        for x in features.as_of(l, r, ["key"], "t", "t", ["v"], strict, width=11).collect():
            hit = max((t for t in right if t < x.t or (t == x.t and not strict)), default=None)
            assert (x.as_of_time, x.as_of_v) == (hit, right.get(hit))
    day = 86_400_000_000_000
    curve = spark.createDataFrame([("k", t * day, 1.0) for t in range(6)], "k string, event_time_ns long, equity double")
    costs = spark.createDataFrame([("k", 0, 2.0), ("k", 2 * day, 3.0), ("k", 2 * day, 4.0)], "k string, event_time_ns long, amount double")
    assert [x.gross_equity for x in rows_of(lookups.cumulative_costs(curve, costs, ["k"]), "event_time_ns")] == [3.0, 3.0, 10.0, 10.0, 10.0, 10.0]


# --- folds of wealth


@pytest.mark.parametrize("least", [-0.5, -1.0, -1.7])
def test_compounding_in_blocks(spark, monkeypatch, least):
    rng = np.random.default_rng(3)
    series = {k: rng.uniform(least, 0.6, n) for k, n in (("a", 200), ("b", 1), ("c", 37))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, obs long, ret double").repartition(5)
    monkeypatch.setattr(risk, "fold", lambda *a: scans.fold(*a, fan=4))
    for r in risk.compounded(df, ["k"]).collect():
        w = np.concatenate(([1.0], np.cumprod(1 + series[r.k])))
        assert r.total == pytest.approx(w[-1] - 1) and r.worst == series[r.k].min()
        assert r.fall == pytest.approx((np.maximum.accumulate(w) - w).max())


def test_risk_report_in_blocks(spark, monkeypatch):
    values = np.random.default_rng(5).normal(0, 0.03, 50)
    values[7] = -1.0
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "obs long, ret double")
    whole = risk.risk_report(df, 50, paths=40).first()
    monkeypatch.setattr(risk, "fold", lambda *a: scans.fold(*a, fan=3))
    monkeypatch.setattr(draws, "CHUNK", 120)
    split = risk.risk_report(df, 50, paths=40).first()
    assert list(whole) == pytest.approx(list(split)) and split.observed_max == 1.0
    with pytest.raises(Exception, match="under -1"):
        risk.risk_report(spark.createDataFrame([(0, -1.5)], "obs long, ret double"), 1).collect()


# --- draws


def test_draws_are_the_generator_s(spark, monkeypatch):
    def unit(rng, first, count):
        return {"d": np.repeat(np.arange(first, first + count), 3), "x": rng.integers(0, 29, size=count * 3)}

    rng = np.random.default_rng(11)
    want = [(d, int(rng.integers(0, 29))) for d in range(50) for _ in range(3)]
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(draws, "CHUNK", chunk)
        kept = draws.checkpoints(11, 50, 3, unit)
        assert len(kept) == (1 if chunk > 7 else 25) and all(len(s) < 300 for *_, s in kept)
        assert sorted(map(tuple, draws.drawn(spark, 11, 50, 3, unit, "d long, x long").collect())) == sorted(want)


# --- books

BOOK = "instrument_id string, ord long, sequence long, event_type string, hash string, previous_hash string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>, changes array<struct<side:string,price:double,size:double>>"


def plain_books(rows):
    out = []
    for name in {r[0] for r in rows}:
        bids, asks, sequence, mark, resync = {}, {}, None, None, True
        for _, o, number, kind, h, prev, b, a, changes in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            if kind == "book_snapshot":
                bids, asks, sequence, mark, resync, good = dict(b or []), dict(a or []), number, h, False, True
            else:
                good = not resync and (None in (sequence, number) or number == sequence + 1) and (None in (prev, mark) or prev == mark)
                for side, price, size in (changes or []) if good else []:
                    if side not in ("bid", "ask") or size is None or size < 0:
                        good = False
                        break
                    book = bids if side == "bid" else asks
                    book[price] = size
                    if size == 0:
                        del book[price]
                if good:
                    sequence, mark = number, h or mark
                else:
                    resync = True
            out.append((name, o, good, resync, max(bids, default=None), min(asks, default=None), len(bids) + len(asks)))
    return sorted(out, key=repr)


def random_tape(seed):
    rng, rows = random.Random(seed), []
    for name, n in (("A", 300), ("B", 80), (None, 40), ("C", 2)):
        number, mark = 5, "h"
        price = lambda: float(rng.randrange(1, 25))
        levels = lambda: [(price(), float(rng.randrange(4))) for _ in range(rng.randrange(5))] if rng.random() < 0.9 else None
        for o in range(n):
            number += 1 if rng.random() < 0.97 else 2
            h = rng.choice([f"h{o}", f"h{o}", None])
            if rng.random() < 0.06:
                rows.append((name, o, rng.choice([number, number, None]), "book_snapshot", h, None, levels(), levels(), None))
                mark = h
            else:
                changes = [(rng.choice(["bid", "ask"] * 30 + ["x", None]), price(), rng.choice([0.0, 0.0, 1.0, 2.0] * 15 + [-1.0, None])) for _ in range(rng.randrange(4))] if rng.random() < 0.95 else None
                rows.append((name, o, rng.choice([number] * 20 + [None]), "book_delta", h, rng.choice([mark] * 30 + [None] * 10 + ["zz"]), None, None, changes))
                mark = h or mark
    return rows


@pytest.mark.parametrize("seed,deal", [(1, 5), (2, 65_536)])
def test_books(spark, monkeypatch, seed, deal):
    monkeypatch.setattr(books, "DEAL", deal)
    rows = random_tape(seed)
    got = books.book_states(spark.createDataFrame(rows, BOOK).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_books(rows)
    assert books.book_states(spark.createDataFrame([], BOOK)).collect() == []


def test_nodes_cover_places(spark):
    df = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a + 1, 140, 7)], "a long, b long")
    got = df.withColumn("n", books.covering_nodes(F.col("a"), F.col("b"), 5)).collect()
    for r in got:
        places = [p for x in r.n for p in range(x.node * 4**x.level, (x.node + 1) * 4**x.level)]
        assert sorted(places) == list(range(r.a, r.b)) and len(r.n) <= 24


def test_a_stream_of_books_ends_alike(spark, tmp_path):
    rows = [r for r in random_tape(3) if r[0] is not None]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 300 // 100 == k], BOOK).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # a restart between batches
            stream = spark.readStream.schema(BOOK).parquet(*[f"{tmp_path}/in/*"]) if k == 2 else spark.readStream.schema(BOOK).parquet(f"{tmp_path}/in/[0-{k}]")
            q = observe.running_books(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr) == plain_books(rows)


# --- rolls


def plain_roll(bars, persistence):
    out = []
    for series in {b[0] for b in bars}:
        held = challenger = None
        wins, total = 0, 0.0
        for t in sorted({b[2] for b in bars if b[0] == series}):
            at = {b[1]: (b[4], b[3]) for b in bars if b[0] == series and b[2] == t}
            top, before = max(at, key=lambda c: (at[c][0], c)), held
            if held is None:
                held = top
            elif top == held or at[top][0] <= at[held][0]:
                challenger, wins = None, 0
            else:
                wins = wins + 1 if top == challenger else 1
                challenger = top
                if wins >= persistence:
                    held, challenger, wins = top, None, 0
            rolled = before is not None and before != held
            total += at[before][1] - at[held][1] if rolled else 0.0
            out.append((series, t, held, at[held][1], rolled, total, at[held][1] + total))
    return sorted(out, key=repr)


@pytest.mark.parametrize("persistence,fan", [(1, 3), (2, 3), (3, 2), (2, 1024)])
def test_rolls_in_buckets(spark, monkeypatch, persistence, fan):
    monkeypatch.setattr(rolls, "FAN", fan)
    rng, bars = random.Random(persistence), []
    for series, n, k in (("A", 300, 3), (None, 90, 2), ("C", 1, 1)):
        volume = [rng.randrange(1, 9) for _ in range(k)]
        for t in range(n):
            for c in range(k):
                volume[c] = rng.randrange(1, 9) if rng.random() < 0.4 else volume[c]
                bars.append((series, f"c{c}", t * 7, float(rng.randrange(100)), float(volume[c])))
    df = spark.createDataFrame(bars, "series string, instrument_id string, event_time_ns long, close double, volume double")
    got = rolls.volume_roll(df.repartition(4), persistence, width=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_roll(bars, persistence)


def test_a_missing_incumbent_stops_the_roll(spark):
    bars = [("A", "x", t, 1.0, 9.0) for t in range(0, 60) if t != 41] + [("A", "y", t, 1.0, 2.0) for t in range(0, 60)]
    df = spark.createDataFrame(bars, "series string, instrument_id string, event_time_ns long, close double, volume double")
    with pytest.raises(Exception, match="incumbent contract x missing while challenger y was evaluated at timestamp 41"):
        rolls.volume_roll(df, width=8).collect()


# --- costs and promotions


def test_undated_costs_are_refused(spark):
    curve = spark.createDataFrame([("k", 1, 1.0)], "k string, event_time_ns long, equity double")
    costs = spark.createDataFrame([("k", 1, 2.0), ("k", None, 3.0)], "k string, event_time_ns long, amount double")
    with pytest.raises(Exception, match="without a time"):
        lookups.cumulative_costs(curve, costs, ["k"]).collect()
    total = lambda x: spark.createDataFrame([("k", x)], "k string, total double")
    assert lookups.cumulative_costs(curve, costs.where("event_time_ns = 1"), ["k"], total(2.0)).first().gross_equity == 3.0
    with pytest.raises(ValueError, match="not all dated"):
        lookups.cumulative_costs(curve, costs.where("event_time_ns = 1"), ["k"], total(5.0))


def test_promotions_of_many(spark):
    from tapewright.operators import sweep

    stats = spark.createDataFrame([("a", "psr", 0.99), ("a", "pbo", 0.1), ("b", "psr", 0.5), ("b", "pbo", 0.1), ("c", "psr", float("nan")), ("d", "psr", 0.99), ("d", "pbo", 0.2)], "k string, name string, value double")
    stresses = spark.createDataFrame([("a", "x", "pass"), ("b", "x", "pass"), ("b", "y", "blocked"), ("c", "x", "pass"), ("e", "x", None)], "k string, scenario string, status string")
    got = {r.k: (r.promoted, r.broken) for r in sweep.promotions(stats, stresses, {"psr": (">=", 0.95), "pbo": ("<=", 0.2)}, "k").collect()}
    assert got == {"a": (True, []), "b": (False, ["psr >= 0.95", "y"]), "c": (False, ["pbo <= 0.2", "psr >= 0.95"]), "d": (False, ["no stress"]), "e": (False, ["pbo <= 0.2", "psr >= 0.95", "x"])}


def test_long_calendars_explain_the_same_gaps(spark, monkeypatch):
    from tapewright.operators import quality

    rng, day = random.Random(6), 86_400_000_000_000
    bars = spark.createDataFrame([(k, t * day // 24) for k in ("A", "B") for t in sorted(rng.sample(range(2000), 900))], "instrument_id string, event_time_ns long")
    sessions = [(d * day, d * day + rng.randrange(1, 3) * day) for d in range(0, 84, 5)]
    rolls = [(d * day + day // 2, d * day + 2 * day) for d in range(3, 84, 9)]
    short = quality.interval_gaps(bars, day // 24, sessions, rolls).collect()
    monkeypatch.setattr(quality, "LITERALS", 3)
    assert sorted(quality.interval_gaps(bars, day // 24, sessions, rolls).collect()) == sorted(short)
    assert {r.code for r in short} == {"session_gaps", "roll_gaps", "missing_intervals"}
