"""Golden values and small fixtures of the engine's operators."""

import itertools
import json
import math
import random
from decimal import Decimal as D
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tapewright.functions import normal
from tapewright.model import validate_events
from tapewright.operators import features, fills, lookups, metrics, oos, quality, replay, risk, screen
from tapewright.sources import files, sinks
from tapewright.streaming import observe

MINUTE = 60_000_000_000


def bars(spark, profile="trend", count=96):
    return screen.synthetic_bars(spark, count, profile)


def events_of(rows):
    return [{"event_type": "bar", "ingest_id": f"{r['sequence']:04d}", **r} for r in rows]


def run(strategy, rows, rules=replay.Rules()):
    r = replay.Run(strategy, rules, len(rows))
    for e in rows:
        r.feed(e)
    return r, r.end()


@pytest.mark.parametrize("profile, strategy, pnl, n", [("trend", replay.buy_hold, "24.515137425", 2), ("trend", lambda: replay.donchian(10), "21.009885675", 2), ("mean_reversion", replay.mean_reversion, "-2.145125925", 2), ("flat", replay.seeded_random, "-5.41784016", 22)])
def test_baseline_results(spark, profile, strategy, pnl, n):
    rows = events_of([r.asDict() for r in bars(spark, profile).orderBy("sequence").collect()])
    _, out = run(strategy(), rows)
    assert out[-1]["equity"] - 100_000 == D(pnl)
    assert sum(r["kind"] == "fill" for r in out) == n


def test_futures_multiplier(spark):
    rows = events_of([r.asDict() for r in bars(spark, "trend").orderBy("sequence").collect()])
    definition = {"event_type": "instrument_definition", "instrument_id": "SYNTH", "instrument_type": "future", "multiplier": "50", "event_time_ns": 0, "receive_time_ns": 0, "sequence": None, "ingest_id": "d"}
    r, out = run(replay.donchian(10), [definition, *rows])
    assert r.book.contract("SYNTH") == (True, 50)
    assert out[-1]["equity"] - 100_000 == D("1061.604510675")


def test_replay_groups_equal_single_runs(spark):
    tape = bars(spark).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run_id"), F.lit("bar").alias("event_type"), F.col("sequence").cast("string").alias("ingest_id"), "*")
    out = replay.replay(tape.orderBy(F.rand(3)), lambda _: replay.buy_hold())
    last = out.where("kind = 'equity'").groupBy("run_id").agg(F.max_by("equity", "idx").alias("e")).collect()
    assert {r.run_id: D(r.e) for r in last} == {"a": D("100024.515137425"), "b": D("100024.515137425")}


def book_event(t, **more):
    return {"event_type": "book_snapshot", "instrument_id": "X", "event_time_ns": t, "receive_time_ns": t, "sequence": t, "ingest_id": str(t), **more}


def once(*order):
    sent = []

    def strategy(e, index, total, book):
        if sent:
            return []
        sent.append(1)
        return list(order)

    return strategy


def test_depth_walk_takes_levels_and_rejects_the_rest():
    rows = [book_event(1, bids=[(99, 9)], asks=[(100, 9)]), book_event(2, bids=[(99, 9)], asks=[(101, 1), (100, 1)])]
    _, out = run(once((1, 3, "market")), rows)
    got = [(r["quantity"], r["price"]) for r in out if r["kind"] == "fill"]
    assert got == [(1, 100), (1, 101)]
    assert [(r["quantity"], r["reason"]) for r in out if r["kind"] == "rejected"] == [(1, "insufficient opposing depth")]
    assert sum(r["fee"] for r in out if r["kind"] == "fill") == D("0.201")


def test_limit_haircut_needs_later_evidence():
    trade = lambda t, p, s: {**book_event(t), "event_type": "trade", "price": p, "size": s}
    _, out = run(once((1, 10, "limit", 100)), [trade(1, 99, 10), trade(2, 99, 10)])
    assert [(r["quantity"], r["price"]) for r in out if r["kind"] == "fill"] == [(D("3.75"), 100)]
    rules = replay.Rules(queue=D("0.5"), adverse=D("0.5"))
    _, out = run(once((1, 10, "limit", 100)), [trade(1, 99, 10), trade(2, 99, 10)], rules)
    assert [r["quantity"] for r in out if r["kind"] == "fill"] == [D("2.5")]
    assert [r["quantity"] for r in out if r["kind"] == "missed"] == [D("7.5")]


def bar(t, opened, volume, close=None):
    return {"event_type": "bar", "instrument_id": "X", "event_time_ns": t, "receive_time_ns": t, "sequence": t, "ingest_id": str(t), "open": opened, "close": close or opened, "volume": volume}


def test_bar_fills_share_one_volume_budget():
    _, out = run(once((1, 10), (1, 10)), [bar(1, 100, 100), bar(2, 100, 100)])
    assert [(r["quantity"], r["price"]) for r in out if r["kind"] == "fill"] == [(10, D("100.05"))]
    assert [(r["quantity"], r["reason"]) for r in out if r["kind"] == "missed"] == [(10, "bar participation cap")]
    _, out = run(once((1, 20)), [bar(1, 100, 50), bar(2, 100, 50)])
    assert [r["quantity"] for r in out if r["kind"] == "fill"] == [5]
    _, out = run(once((1, 20)), [bar(1, 100, 50), bar(2, 100, 0)])
    assert [r["reason"] for r in out if r["kind"] == "missed"] == ["bar volume is zero"]


def test_book_round_trip_and_futures_lifecycle():
    b = replay.Book(D(100_000))
    b.fill("S", D(1), D(100), D(1), D(0))
    b.marks["S"] = D(110)
    assert b.equity() == 100_009
    b.fill("S", D(-1), D(110), D(1), D(0))
    assert b.equity() == 100_008
    f = replay.Book(D(100_000), contracts={"F": (True, D(50))})
    f.fill("F", D(2), D(100), D(0), D(0))
    f.marks["F"] = D(110)
    assert f.equity() == 101_000
    f.carry("funding", f.quantity["F"] * D(110) * 50 * D("0.01"))
    assert f.costs["funding"] == 110
    assert f.settle("F", D(105)) == 500 and f.equity() == 100_390
    s = replay.Book(D(100_000))
    s.fill("S", D(-2), D(100), D(0), D(0))
    s.carry("funding", s.quantity["S"] * D(100) * D("0.01"))
    assert s.costs["funding"] == -2 and s.equity() == 100_002
    p = replay.Book(D(100))
    p.fill("P", D(1), D("0.4"), D(0), D(0))
    p.settle("P", D(1))
    assert p.equity() == D("100.6")


def test_risk_limits():
    rules = replay.Rules(max_units=D(1), max_notional=D(1000), max_daily_loss=D(20))
    b = replay.Book(D(1000))
    assert replay.allowed(replay.Order(1, "X", 1, D(2), 0), b, rules) == "max_position_units"
    assert replay.allowed(replay.Order(1, "X", 1, D(1), 0), b, rules) == "missing_reference_price"
    b.marks["X"] = D(100)
    assert replay.allowed(replay.Order(1, "X", 1, D(1), 0), b, rules) == ""
    b.cash -= 20
    assert replay.allowed(replay.Order(1, "X", 1, D(1), 0), b, rules) == "max_daily_loss"
    b.new_day(86_400_000_000_000)
    assert replay.allowed(replay.Order(1, "X", 1, D(1), 0), b, rules) == ""


def test_receive_inversion_fails():
    rows = [bar(1, 100, 1), bar(2, 100, 1)]
    rows[0]["receive_time_ns"] = 9
    with pytest.raises(ValueError, match="receive_time_inversion"):
        run(replay.buy_hold(), rows)


def test_screen_golden(spark):
    variants = spark.createDataFrame([(0, 5, 0.0), (1, 10, 0.0), (2, 20, 0.0)], "variant_id int, lookback int, entry_z double")
    b = bars(spark).withColumn("close", F.col("close").cast("double"))
    got = {r.variant_id: r for r in screen.score(screen.signals(b, variants, "donchian")).collect()}
    for k, net in enumerate((0.2084576517232264, 0.19124130645946846, 0.1685355375479548)):
        assert got[k].net_return == pytest.approx(net, abs=1e-12) and got[k].turnover == 1.0


RET = [0.01, -0.02, 0.015, 0.005, -0.01, 0.02]


def long(spark, matrix):
    return spark.createDataFrame([(i, v, float(x)) for i, row in enumerate(matrix) for v, x in enumerate(row)], "obs long, variant int, ret double")


def test_sharpe_probabilities(spark):
    r = long(spark, [[x] for x in RET])
    assert oos.psr(r, ["variant"]).first().psr == pytest.approx(0.673220253522502, abs=1e-12)
    assert oos.dsr(r, ["variant"], 4, [-0.2, 0.0, 0.1, 0.3]).first().dsr == pytest.approx(0.49806536196993634, abs=1e-12)


@pytest.mark.parametrize(
    "matrix, value",
    [
        ([[-1, 0, 5], [9, -9, -7], [6, 9, -5], [-2, 12, 19]], 1.0),
        ([[3, 2, 1], [4, 2, 0], [5, 1, 0], [6, 2, 1]], 0.0),
        ([[2, 0, -3], [3, 1, 1], [-9, -4, 9], [-1, -1, 4]], 0.5),
    ],
)
def test_pbo(spark, matrix, value):
    assert tuple(oos.pbo(long(spark, matrix), 4, blocks=4).first()) == (value, 6)


def test_reality_check_and_sign_flip(spark):
    m = [[0.01, -0.01, 0.002], [-0.02, 0.01, -0.003], [0.015, -0.005, 0.004], [0.005, 0.002, -0.001], [-0.01, 0.003, 0.002], [0.02, -0.004, 0.005]]
    assert tuple(oos.reality_check(long(spark, m), 6, 100, 11).first()) == (28 / 101, 9 / 101, 2)
    assert tuple(oos.reality_check(long(spark, [[0, 0]] * 4), 4, 20, 3).first()) == (1.0, 1.0, 2)
    pairs = spark.createDataFrame([(i, 1.0, 0.0) for i in range(4)], "obs long, selected double, baseline double")
    assert tuple(oos.sign_flip(pairs, 4, 20, 3).first()) == (pytest.approx(1 / 3), 2)


def test_normal_cdf(spark):
    z = [-9.0, -3.3, -1.0, -0.4, 0.0, 0.2, 0.66, 1.5, 4.0, 7.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal.cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(NormalDist().cdf(r.z), rel=1e-12, abs=1e-18)


def test_sweep_covers_whole_series(spark, monkeypatch):
    from tapewright.plans import catalog

    def tape(spark, d):
        rows = [(s, s, "bar", i * 10, i * 10 + 1, i, str(i), *(str(100 + i % 9),) * 4, "5") for s, n in (("long", 320), ("short", 145), ("none", 111)) for i in range(1, n + 1)]
        return spark.createDataFrame(rows, "run_id string, instrument_id string, event_type string, event_time_ns long, receive_time_ns long, sequence long, ingest_id string, open string, high string, low string, close string, volume string")

    monkeypatch.setattr(catalog, "_tape", tape)
    monkeypatch.setattr(catalog, "SWEEP", [("donchian", 5), ("flat", 0)])
    cells = catalog.sweep_cells(spark, "").collect()
    assert {(r.phase, r.bars) for r in cells} == {("train", 80), ("test", 30)}
    assert sorted((r.series, r.fold) for r in cells if r.phase == "test" and r.variant == "flat-0") == [("long", k) for k in range(7)] + [("short", 0)]
    assert catalog.sweep_winners(spark, "").count() == 8
    assert catalog.sweep_cover(spark, "").count() == 0
    assert catalog.check_flat_null(spark, "").count() == 0


def test_statistics_take_all_observations(spark, monkeypatch):
    from tapewright.plans import catalog

    flat = [[0.001 * (i % 3 - 1), 0.0] for i in range(28)]
    one = [(i, v, float(x)) for i, row in enumerate([*flat, [-0.9, 0.5], [0.0, 0.0]]) for v, x in zip(("view", "click"), row)]
    returns = spark.createDataFrame(one, "obs long, variant string, ret double")
    monkeypatch.setattr(catalog.V, "returns_long", lambda spark, d: returns)
    assert catalog.risk_report(spark, "").first().observed_max > 0.89
    assert any(abs(r["mean"]) > 0.02 for r in catalog.block_bootstrap(spark, "").collect())
    assert catalog.sign_flip(spark, "").first().block_length == 4
    r, n = catalog._matrix(spark, "")
    assert (r.count(), n) == (60, 30)

    bars = spark.createDataFrame([("a", i * 10, 100.0 + i % 7) for i in range(800)], "instrument_id string, event_time_ns long, close double")
    monkeypatch.setattr(catalog.V, "bars", lambda spark, d, width: bars)
    monkeypatch.setattr(catalog, "_scored", lambda signals: signals)
    assert catalog.screen_random(spark, "").count() == 1600


def test_walk_forward(spark):
    folds = oos.walk_forward(spark, 320, 96, 32, 2, 2).collect()
    assert len(folds) == 6 and all(f.train_start == 0 and f.test_start - f.train_end == 2 for f in folds)
    assert all(b.test_start >= a.test_end + 2 for a, b in itertools.pairwise(folds))
    with pytest.raises(ValueError):
        oos.walk_forward(spark, 100, 96, 32)


EVENT = "source string, venue string, instrument_id string, event_type string, event_time_ns long, receive_time_ns long, sequence long, ingest_id string, close double, arrival_ord long"


def test_quality_mutations(spark):
    rows = [("s", "v", "X", "bar", 100, 101, 1, "a", 100.0, 0), ("s", "v", "X", "bar", 400, 399, 3, "c", 200.0, 1), ("s", "v", "X", "bar", 100, 101, 1, "b", 100.0, 2)]
    e = spark.createDataFrame(rows, EVENT)
    assert quality.timestamp_disorder(e).count() == 1
    assert quality.duplicates(e).collect()[0].first_ingest_id == "a"
    assert quality.negative_receive_latency(e).count() == 1
    assert quality.sequence_gaps(e).count() == 1
    b = e.select("instrument_id", "event_time_ns", "close").distinct()
    gaps = quality.interval_gaps(b, 100)
    assert [r.code for r in gaps.collect()] == ["missing_intervals"]
    assert quality.outliers(b).count() == 1
    assert sorted(r.side for r in quality.provider_truncation(e, 0, 500).collect()) == ["end", "start"]
    books = spark.createDataFrame([([0.6], [0.59])], "bids array<double>, asks array<double>")
    assert quality.crossed_book(books).count() == 1
    both = quality.quality_summary(e, b, gaps, books, (0, 500), 10, ("quote",)).collect()
    assert len(both) == 14 and {r.verdict for r in both} == {"blocked"}
    found = {r.code: r.n for r in both}
    assert found["duplicates"] == found["timestamp_disorder"] == found["crossed_book"] == 1 and found["timezone"] == 0
    assert [r.code for r in quality.interval_gaps(b, 100, [(50, 450)]).collect()] == ["session_gaps"]
    assert [r.code for r in quality.interval_gaps(b, 100, [], [(50, 450)]).collect()] == ["roll_gaps"]


def test_receive_inversion_across_buckets(spark):
    hour = 3_600_000_000_000
    rows = [("s", "v", "X" if k % 2 else "Y", "bar", k * hour // 3, k * hour // 3 + (200 if k == 4 else 1) * (1 + hour * (k == 4)), k, str(k), 1.0, k) for k in range(9)]
    got = {r.ingest_id for r in quality.receive_time_inversion(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"5"}


def test_validation(spark):
    rows = [("s", "v", "X", "bar", 1, 1, 1, "a", 1.0, 0), ("", "v", "X", "nonsense", -1, 1, -2, None, 1.0, 0)]
    v = [sorted(r.violations) for r in validate_events(spark.createDataFrame(rows, EVENT)).collect()]
    assert v == [[], ["empty_ingest_id", "empty_source", "negative_event_time_ns", "negative_sequence", "unknown_event_type"]]


def test_volume_roll(spark):
    def series(volumes, closes=None):
        rows = [("F", c, 100 * (i + 1), float((closes or [(0, 0)] * 9)[i][k]), float(v[k])) for i, v in enumerate(volumes) for k, c in enumerate(("ESU6", "ESZ6")) if v[k] is not None]
        df = spark.createDataFrame(rows, "series string, instrument_id string, event_time_ns long, close double, volume double")
        return features.volume_roll(df).orderBy("event_time_ns").collect()

    got = series([(10, 5), (4, 12), (3, 13)], [(5000, 5010), (5002, 5012), (5005, 5015)])
    assert [r.instrument_id for r in got] == ["ESU6", "ESU6", "ESZ6"]
    assert (got[2].roll_adjustment, got[2].signal_close) == (-10, 5005)
    assert {r.instrument_id for r in series([(10, 5), (4, 12), (11, 6), (3, 13)])} == {"ESU6"}
    assert {r.instrument_id for r in series([(10, 5), (4, 12), (8, 8), (4, 12)])} == {"ESU6"}
    with pytest.raises(Exception, match="ESU6 missing while challenger ESZ6"):
        series([(10, 5), (None, 12)])


def test_returns_do_not_depend_on_order(spark):
    rows = [("X", 2, 110.0), ("X", 1, 100.0)]
    for order in (rows, rows[::-1]):
        got = features.bar_returns(spark.createDataFrame(order, "instrument_id string, event_time_ns long, close double")).orderBy("event_time_ns").collect()
        assert got[0].return_1 is None and got[1].return_1 == pytest.approx(0.1)


def test_stress_all_blocked(spark):
    r = spark.createDataFrame([("a", 0, 0.1), ("a", 1, -0.2)], "k string, obs int, ret double")
    costs = spark.createDataFrame([("a", 10.0, 0.0, 0.0, 0.0, 0.0, 11.0, 0.0, 0.0, 0.0, 0.0)], "k string, gross_pnl double, " + ", ".join(f"{c} double" for c in risk.COSTS))
    got = risk.stress_suite(risk.stress_inputs(r, costs, ["k"]), ["k"]).collect()
    assert len(got) == 11 and {x.status for x in got} == {"blocked"}
    inputs = risk.stress_inputs(r, costs, ["k"]).first()
    scale = abs(10 / (1.1 * 0.8 - 1))
    assert inputs.outage_loss == pytest.approx(0.2 * scale) and inputs.deleverage_loss == pytest.approx(0.22 * scale)


def test_risk_report(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 0.02) for _ in range(30)]
    got = risk.risk_report(long(spark, [[v] for v in values]).select("obs", "ret"), 30).first()
    import numpy as np

    def fall(path):
        w = np.cumprod(1 + np.asarray(path))
        peak = np.maximum(1, np.maximum.accumulate(w))
        return max(0, ((peak - w) / peak).max())

    gen = np.random.default_rng(7)
    dd = [fall(gen.choice(np.array(values), size=30, replace=True)) for _ in range(500)]
    assert got.observed_max == pytest.approx(fall(values)) and got.bootstrap_p95 == pytest.approx(np.quantile(dd, 0.95))
    assert got.expected_shortfall == pytest.approx(abs(np.mean(sorted(values)[:2])))


def test_zero_equity_has_no_metrics(spark):
    curve = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 0.0)], "run_id string, event_time_ns long, equity double")
    m = metrics.metric_pack(curve, None, ["run_id"], 100.0, 252.0).first()
    assert not m.promotable and m.pnl is None and m.sharpe is None


def test_turnover_uses_multipliers(spark):
    f = spark.createDataFrame([("X", 1, 100.0, 2.0)], "instrument_id string, event_time_ns long, price double, quantity double")
    dim = spark.createDataFrame([("X", 50.0)], "instrument_id string, multiplier double")
    n = lookups.multiplier_notional(f, dim, "instrument_id").select(F.lit("a").alias("run_id"), "event_time_ns", "notional")
    curve = spark.createDataFrame([("a", 1, 100_000.0), ("a", 2, 100_001.0)], "run_id string, event_time_ns long, equity double")
    assert metrics.metric_pack(curve, n, ["run_id"], 100_000.0, 252.0).first().turnover == pytest.approx(0.1)


def test_book_state(spark):
    schema = "instrument_id string, ord long, sequence long, event_type string, hash string, previous_hash string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>, changes array<struct<side:string,price:double,size:double>>"
    rows = [
        ("X", 1, 10, "book_snapshot", "h1", None, [(1.0, 5.0)], [(2.0, 5.0)], None),
        ("X", 2, 11, "book_delta", "h2", "h1", None, None, [("bid", 1.5, 1.0), ("ask", 2.0, 0.0)]),
        ("X", 3, 13, "book_delta", "h3", "h2", None, None, [("bid", 1.6, 1.0)]),
        ("X", 4, 14, "book_delta", "h4", "h3", None, None, [("bid", 1.7, 1.0)]),
        ("X", 5, 20, "book_snapshot", "h9", None, [(1.0, 5.0)], [], None),
        ("X", 6, 21, "book_delta", "h10", "bad", None, None, []),
    ]
    got = observe.book_states(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert [(r.accepted, r.resync) for r in got] == [(True, False), (True, False), (False, True), (False, True), (True, False), (False, True)]
    assert (got[1].best_bid, got[1].levels) == (1.5, 2)


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 7, "b"), ("j", 1, "c")], "key string, t long, id string")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 6, 2.0)], "key string, t long, v double")
    got = {r.id: r.as_of_v for r in features.as_of(left, right, ["key"], "t", "t", ["v"]).collect()}
    assert got == {"a": None, "b": 2.0, "c": None}
    got = {r.id: r.as_of_v for r in features.as_of(left, right, ["key"], "t", "t", ["v"], strict=False).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": None}


def test_sources(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.read_jsonl(spark, str(path), "a long").collect()] == [1, 2]
    path.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="invalid event line"):
        files.read_jsonl(spark, str(path), "a long").collect()
    path.write_text("")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(path), "a long")
    with pytest.raises(ValueError):
        files.scan(spark, [])
    with pytest.raises(ValueError):
        files.scan(spark, ["x"], ("a; b",))


def test_klines(spark, tmp_path):
    page = [[t, "1", "2", "0.5", "1.5", "10", t + 59_999, "15", 3] for t in range(0, 600_000, 60_000)]
    path = tmp_path / "k.json"
    path.write_text(json.dumps(page))
    spark.dataSource.register(files.KlineSource)
    raw = spark.read.format("klines").options(path=str(path), start_ms=60_000, end_ms=540_000, chunk_ms=200_000, page=2).load()
    b = files.normalize_klines(raw, "BTC", 400_000 * 1_000_000).orderBy("event_time_ns").collect()
    assert [r.event_time_ns // (MINUTE) for r in b] == [1, 2, 3, 4, 5]  # the bar of minute 6 closes after it was received
    assert b[0].open == 1 and b[0].trades == 3


def test_normalizers(spark):
    info = spark.createDataFrame([("A", "TRADING", [("PRICE_FILTER", "0.01", None), ("LOT_SIZE", None, "0.1")]), ("B", "HALT", [])], "symbol string, status string, filters array<struct<filterType:string,tickSize:string,stepSize:string>>")
    assert [(r.instrument_id, float(r.tick_size), float(r.lot_size)) for r in files.trading_symbols(info).collect()] == [("A", 0.01, 0.1)]
    m = spark.createDataFrame([("m", '["1","2"]', '["Yes","No"]')], "market string, clobTokenIds string, outcomes string")
    assert [(r.instrument_id, r.outcome) for r in files.outcome_tokens(m).collect()] == [("1", "Yes"), ("2", "No")]
    p = spark.createDataFrame([("x", 1_700_000_000_000, "0.5")], "instrument_id string, t long, p string")
    assert files.normalize_prediction(p, 1_700_000_100_000_000_000).first().event_time_ns == 1_700_000_000_000_000_000
    with pytest.raises(Exception, match="out of range"):
        files.normalize_prediction(p.withColumn("t", F.lit(5).cast("long")), 1_700_000_100_000_000_000).collect()


def test_immutable_partitions(spark, tmp_path):
    e = bars(spark, count=30).select(F.lit("s").alias("source"), F.lit("v").alias("venue"), F.lit("x").alias("ingest_id"), "*")
    assert len(sinks.write_events(e, str(tmp_path / "tape"))) == 1
    with pytest.raises(sinks.PartitionExists):
        sinks.write_events(e, str(tmp_path / "tape"))
    assert spark.read.parquet(str(tmp_path / "tape")).count() == 30
    a = sinks.archive_raw(str(tmp_path), 5, "{}")
    assert sinks.archive_raw(str(tmp_path), 5, "{}") == a
    with pytest.raises(FileExistsError):
        sinks.write_atomic(a, "other", create_only=True)
    first = sinks.append_ledger(str(tmp_path / "l.jsonl"), {"kind": "run"})
    assert sinks.append_ledger(str(tmp_path / "l.jsonl"), {"kind": "gate"})["previous_hash"] == first["entry_hash"]
    assert "<table>" in sinks.html_report("r", {"t": e.limit(2)})


def test_journal_freezes(spark, tmp_path):
    j = observe.Journal(str(tmp_path / "j"))
    one = spark.createDataFrame([("a", 1.0)], "ingest_id string, price double")
    assert j.commit(one, 0) == "committed" and j.commit(one, 0) == "duplicate"
    assert j.commit(spark.createDataFrame([("b", 2.0)], "ingest_id string, price double"), 1) == "committed"
    assert j.history(spark).count() == 2
    with pytest.raises(observe.Frozen):
        j.commit(one, 2)
    with pytest.raises(observe.Frozen):
        j.commit(spark.createDataFrame([("c", 2.0)], "ingest_id string, price double"), 3)


def test_stream_goes_on_where_a_batch_ended(spark, tmp_path):
    tape = bars(spark).select(F.lit("a").alias("run_id"), F.lit("bar").alias("event_type"), F.lpad(F.col("sequence").cast("string"), 4, "0").alias("ingest_id"), "instrument_id", "event_time_ns", "receive_time_ns", "sequence", *[F.col(c).cast("string").alias(c) for c in ("open", "close", "volume")])
    for k in range(4):
        tape.where(F.col("sequence") % 96 >= 24 * k).where(F.col("sequence") < 24 * (k + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files_in = spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = observe.resumable_replay(files_in, lambda run: replay.Run(replay.donchian(10), replay.Rules(), -1, run), [c for c in tape.columns if c != "run_id"])
    q = out.writeStream.format("memory").queryName("resumed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = events_of([r.asDict() for r in bars(spark).orderBy("sequence").collect()])
    whole = replay.Run(replay.donchian(10), replay.Rules(), -1)
    for e in rows:
        whole.feed(e)
    want = [(f["event_time_ns"], f["side"], f["quantity"]) for f in whole.rows if f["kind"] == "fill"]
    assert [(r.event_time_ns, r.side, D(r.quantity)) for r in spark.table("resumed").orderBy("event_time_ns").collect()] == want and want


def test_fill_operators(spark):
    levels = spark.createDataFrame([(1, 100.0, 1.0), (1, 101.0, 1.0)], "book_id long, price double, size double")
    s = fills.walk_summary(fills.depth_walk(levels, 3.0), 3.0).first()
    assert (s.filled, s.remaining, s.vwap, s.status) == (2.0, 1.0, 100.5, "partial_rejected")
    assert math.isclose(fills.limit_fill(levels, spark.createDataFrame([(1, 100.0)], "book_id long, limit_price double"), 10.0).first().filled, 0.375)
    assert screen.complement_scan(screen.complement_books(spark)).count() == 15


def test_bundles_are_whole_or_not_there(spark, tmp_path):
    from tapewright.sources import ingest

    e = bars(spark, count=30).select(F.lit("s").alias("source"), F.lit("x").alias("ingest_id"), "*")
    counts = spark.createDataFrame([("outliers", 0)], "code string, n long")
    target = str(tmp_path / "bundle")
    receipt = ingest.publish(target, [1, 2], {"kind": "bars"}, e, counts)
    assert receipt["event_count"] == 30 and ingest.bundle_problems(spark, target) == []
    with pytest.raises(FileExistsError):
        ingest.publish(target, [1, 2], {"kind": "bars"}, e, counts)
    (tmp_path / "bundle" / "raw.json").write_text("[3]")
    assert ingest.bundle_problems(spark, target) == ["raw.json"]
    with pytest.raises(ValueError):
        ingest.publish(str(tmp_path / "none"), [], {}, e.limit(0), counts)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bundle"]


def test_reads_are_retried(tmp_path):
    from tapewright.sources import ingest

    answers = iter([(500, ""), (429, ""), (200, "[1]")])
    notes = []
    assert ingest.get_json(lambda u, p: next(answers), "u", pause=0, evidence=notes) == [1]
    assert [n.get("error", "ok") for n in notes] == ["RuntimeError", "RuntimeError", "ok"]
    with pytest.raises(RuntimeError):
        ingest.get_json(lambda u, p: (503, ""), "u", pause=0)


def test_more_normalizers(spark):
    t = spark.createDataFrame([(7, "1.5", "2", 1000, True)], "a long, p string, q string, T long, m boolean")
    r = files.normalize_trades(t, "BTC", 5).first()
    assert (r.sequence, r.price, r.event_time_ns) == (7, D("1.5"), 1_000_000_000)
    k = spark.createDataFrame([(9, [["1", "2"]], [["3", "4"]])], "lastUpdateId long, bids array<array<string>>, asks array<array<string>>")
    assert files.normalize_depth(k, "BTC", 5).first().asks[0].price == 3
    fd = spark.createDataFrame([("ESZ6", "ES", "X", "0.25", "1", "50", "USD", None, None), ("BAD", "ES", "X", "0", "1", "50", "USD", None, None)], "instrument_id string, symbol string, venue string, tick_size string, lot_size string, multiplier string, quote_currency string, expiry string, margin_mode string")
    assert files.futures_definitions(fd.where("instrument_id = 'ESZ6'")).first().multiplier == 50
    with pytest.raises(Exception, match="invalid instrument BAD"):
        files.futures_definitions(fd).collect()
