"""Strategies that go on, run configuration, packages, market clients and recomputation."""

import json
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tapewright import config, values
from tapewright.operators import baselines, features, lookups, recompute, replay, strategies
from tapewright.sources import files, markets, package
from tapewright.sources.fs import AlreadyThere, Folder
from tapewright.streaming import observe

EVENT = "instrument_id string, event_type string, event_time_ns long, receive_time_ns long, sequence long, ingest_id string, open string, close string, volume string"


def walk(seed, n=96, step=0.8):
    """A random tape; volumes are small enough for orders to wait."""
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        opened, price = price, max(1.0, price + rng.gauss(0, step))
        out.append({"event_type": "bar", "instrument_id": "X", "event_time_ns": i * 10, "receive_time_ns": i * 10 + 1, "sequence": i, "ingest_id": f"{i:04d}", "open": f"{opened:.4f}", "close": f"{price:.4f}", "volume": str(rng.choice([0, 3, 8, 50, 200]))})
    return out


def whole(make, rows, total):
    r = replay.Run(make(), replay.Rules(), total)
    for e in rows:
        r.feed(e)
    return r


MAKERS = [strategies.BuyHold, strategies.SeededRandom, strategies.Breakout, lambda: strategies.Breakout(3), strategies.Reversion, lambda: strategies.Reversion(5, 0.7, 9.0), strategies.Flat]


@pytest.mark.parametrize("make", MAKERS)
@pytest.mark.parametrize("seed", range(4))
def test_runs_go_on_where_they_stopped(make, seed):
    rows = walk(seed, step=0.1 if seed % 2 else 1.5)
    one = whole(make, rows, -1)
    state, made = None, []
    for k in range(0, 96, 24):
        r = replay.Run(make(), replay.Rules(), -1)
        if state:
            r.import_state(json.loads(state))
        for e in rows[k : k + 24]:
            r.feed(e)
        made += r.drain()
        state = json.dumps(r.export_state())
    assert made == one.rows
    assert json.loads(state) == json.loads(json.dumps(one.export_state()))


def plain_target(rows, judge):
    """Wanted positions from lists of all closes so far."""
    return [judge(rows, i) for i in range(len(rows))]


@pytest.mark.parametrize("seed", range(6))
def test_strategies_against_plain_windows(seed):
    import statistics

    rows = walk(seed, 300, 0.4)
    book = replay.Book(D(0))
    closes = [D(r["close"]) for r in rows]
    b = strategies.Breakout(7)
    v = strategies.Reversion(9, 0.8, 0.004)
    for i, e in enumerate(rows):
        got, past = b(e, i, 300, book), closes[max(0, i - 7) : i]
        want = None if i < 7 else 1 if closes[i] > max(past) else -1 if closes[i] < min(past) else None
        want = 0 if i == 298 else None if i == 299 else want
        assert got == ([] if not want else [(want, D(1), "bar")])
        got, x = v(e, i, 300, book), [float(c) for c in closes[max(0, i - 9) : i]]
        want = None
        if i >= 9 and statistics.pstdev([q / p - 1 for p, q in zip(x, x[1:])]) <= 0.004:
            z = (float(closes[i]) - statistics.mean(x)) / statistics.pstdev(x)
            want = 1 if z <= -0.8 else -1 if z >= 0.8 else 0 if abs(z) < 0.25 else None
        want = 0 if i == 298 else None if i == 299 else want
        assert got == ([] if not want else [(want, D(1), "bar")])


@pytest.mark.parametrize("seed, make", [(1, "donchian"), (2, "reversion"), (3, "seeded_random")])
def test_streamed_replay_equals_a_whole_one(spark, tmp_path, seed, make):
    rows = walk(seed, 96, 1.2)
    family = strategies.FAMILIES[make]
    df = spark.createDataFrame([("a", *(r[c] for c in ("instrument_id", "event_type", "event_time_ns", "receive_time_ns", "sequence", "ingest_id", "open", "close", "volume"))) for r in rows], "run_id string, " + EVENT)
    for k in range(4):
        df.where(f"sequence >= {24 * k} AND sequence < {24 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"resumed_{make}"
    q = observe.resumable_replay(stream, lambda run: replay.Run(family(), replay.Rules(), -1, run), [c for c in df.columns if c != "run_id"]).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    one = whole(family, rows, -1)
    want = [(f["event_time_ns"], f["side"], f["quantity"]) for f in one.rows if f["kind"] == "fill"]
    assert [(r.event_time_ns, r.side, D(r.quantity)) for r in spark.table(name).orderBy("event_time_ns").collect()] == want and len(want) > 5
    out = replay.replay(df, lambda run: family(), open_end=True, restart_every=7).where("kind = 'fill'").collect()
    assert sorted((r.event_time_ns, r.side, D(r.quantity)) for r in out) == sorted(want)


def test_replay_streams_long_runs_in_batches(spark):
    rows = [("a" if i % 3 else "b", "X", "bar", i, i, i, f"{i:06d}", "100", str(100 + i % 7), "1000") for i in range(9000)]
    df = spark.createDataFrame(rows, "run_id string, " + EVENT)
    out = replay.replay(df, lambda run: strategies.Breakout(3), replay.Rules(sample_every=100))
    by = {r.run_id: r for r in out.groupBy("run_id").agg(F.count(F.when(F.col("kind") == "equity", 1)).alias("points"), F.max_by("equity", "idx").alias("last"), F.max("idx").alias("idx")).collect()}
    one = [dict(zip(["instrument_id", "event_type", "event_time_ns", "receive_time_ns", "sequence", "ingest_id", "open", "close", "volume"], r[1:])) for r in rows if r[0] == "a"]
    r = replay.Run(strategies.Breakout(3), replay.Rules(sample_every=100), len(one))
    for e in one:
        r.feed(e)
    assert D(by["a"].last) == r.end()[-1]["equity"] and by["a"].points == sum(x["kind"] == "equity" for x in r.rows)


def test_journal_is_durable(spark, tmp_path):
    root = str(tmp_path / "j")
    batch = lambda *ids: spark.createDataFrame([(i, 1.0) for i in ids], "ingest_id string, price double")
    assert observe.Journal(root).commit(batch("a", "b"), 0) == "committed"
    assert observe.Journal(root).commit(batch("a", "b"), 0) == "duplicate"
    assert observe.Journal(root).commit(batch("c"), 1) == "committed"
    with pytest.raises(observe.Frozen):
        observe.Journal(root).commit(batch("b", "d"), 2)
    with pytest.raises(observe.Frozen):  # another process finds it frozen
        observe.Journal(root).commit(batch("e"), 3)
    assert observe.Journal(root).history(spark).count() == 3


# ---- values and configuration ----


def test_values():
    assert values.canonical_json({"b": D("1.50"), "a": [True, None, "é"]}) == '{"a":[true,null,"\\u00e9"],"b":"1.50"}'
    with pytest.raises(TypeError):
        values.canonical_json({"a": 0.5}, floats=False)
    for bad in (float("nan"), D("Infinity")):
        with pytest.raises(ValueError):
            values.canonical_value(bad, floats=True)
    with pytest.raises(TypeError):
        values.canonical_value({1: 2})
    assert values.round12(123456.789012345678) == 123456.789012 and str(values.round12(-0.0)) == "0.0" and values.round12(None) is None
    assert [k for k in ("API-Key", "token_id", "access_token", "tokens", "x.password", "secretary") if values.is_secret_key(k)] == ["API-Key", "access_token", "x.password"]
    assert values.redacted({"a": [{"auth token": 5, "b": 1}]}) == {"a": [{"auth token": "***", "b": 1}]}
    assert values.secret_paths({"a": [{"auth token": 5}]}, "config") == ["config.a[0].auth token"]


def test_round12_and_secret_columns_agree_with_python(spark):
    x = [0.1 + 0.2, 1e300 / 3, -1 / 3, 5e-9, 0.0, -0.0, 123456789012345.6]
    got = spark.createDataFrame([(v,) for v in x], "v double").select("v", values.round12_column(F.col("v")).alias("r")).collect()
    assert all(r.r == values.round12(r.v) for r in got)
    keys = ["API-Key", "token_id", "access__token", "tokens", "db.password", "Seed Phrase", "token", "_secret_", "wallet key"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", values.is_secret_column(F.col("k")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: values.is_secret_key(k) for k in keys}


STRATEGY = """
class Mine:
    strategy_id = "mine"
    def __init__(self, config): self.n = config["n"]
    def __call__(self, e, index, total, book): return []
    def export_state(self): return {"n": self.n}
    def import_state(self, state): self.n = state["n"]
def build_strategy(config): return Mine(config)
"""


def described(tmp_path, text=STRATEGY, **more):
    (tmp_path / "mine.py").write_text(text)
    return {"schema_version": 1, "strategy_id": "mine", "strategy_file": "mine.py", "config": {"n": 3}, "asset_class": "futures", "owner": "me"} | more


def test_descriptors(tmp_path):
    d = config.descriptor(described(tmp_path), str(tmp_path))
    assert config.load_strategy(d).n == 3 and config.load_strategy(d, {"n": 9}).n == 9
    assert d.fingerprint != config.descriptor(described(tmp_path, config={"n": 4}), str(tmp_path)).fingerprint
    for bad in ({"strategy_file": "../mine.py"}, {"config": {"api_key": 1}}, {"config": {"n": float("inf")}}, {"asset_class": "art"}, {"factory": "a b"}, {"schema_version": True}, {"owner": " "}, {"more": 1}):
        with pytest.raises(ValueError):
            config.descriptor(described(tmp_path) | bad, str(tmp_path))
    os.symlink("/etc/hostname", tmp_path / "out.py")
    with pytest.raises(ValueError):
        config.descriptor(described(tmp_path, strategy_file="out.py"), str(tmp_path))
    (tmp_path / "mine.py").write_text(STRATEGY + "\n# changed")
    with pytest.raises(ValueError):
        config.load_strategy(d)


def test_import_fence(tmp_path):
    for line in ("import socket", "import urllib.request", "from http import client", "import tapewright.sources.files"):
        d = config.descriptor(described(tmp_path, line + STRATEGY), str(tmp_path))
        with pytest.raises(ImportError):
            config.load_strategy(d)
    import socket  # noqa: F401  free again outside

    other = STRATEGY.replace('"mine"', '"other"')
    with pytest.raises(ValueError):
        config.load_strategy(config.descriptor(described(tmp_path, other), str(tmp_path)))
    bare = STRATEGY.replace("export_state", "something")
    d = config.descriptor(described(tmp_path, bare), str(tmp_path))
    assert config.load_strategy(d)
    with pytest.raises(ValueError):
        config.load_strategy(d, resumable=True)


EXECUTION = {"schema_version": 1, "initial_cash": "1000", "fill_model": "bar_next_open", "fee_rate": "0.001", "slippage_bps": "5"}


def test_execution_configs():
    e = config.execution(EXECUTION)
    assert (e.rules.cash, e.rules.slippage_bps, e.promotable) == (1000, 5, True)
    two = EXECUTION | {"schema_version": 2, "minimum_latency_ns": 7, "participation_rate": "0.25", "impact_bps": "10", "equity_sampling_interval": 4}
    assert (config.execution(two).rules.latency_ns, config.execution(two).rules.sample_every) == (7, 4)
    assert not config.execution(EXECUTION | {"fill_model": "diagnostic_midpoint"}).promotable
    for bad in ({"initial_cash": 1000}, {"initial_cash": "0"}, {"fee_rate": "-1"}, {"fill_model": "magic"}, {"queue_haircut": "0.5"}, {"schema_version": 3}, {"extra": "1"}):
        with pytest.raises(ValueError):
            config.execution(EXECUTION | bad)
    with pytest.raises(ValueError):
        config.execution(two | {"participation_rate": "1.5"})


def test_fill_models_fill_by_their_rules():
    """The same intents under each model: the model, not the strategy, says what evidence fills them."""
    bar = {"instrument_id": "X", "event_type": "bar", "event_time_ns": 2, "receive_time_ns": 2, "open": "100", "close": "100", "volume": "10"}
    book = {"instrument_id": "X", "event_type": "book_snapshot", "event_time_ns": 2, "receive_time_ns": 2, "bids": [("99", "8")], "asks": [("101", "8")]}
    two = EXECUTION | {"schema_version": 2, "minimum_latency_ns": 0, "participation_rate": "0.5", "impact_bps": "0", "equity_sampling_interval": 1}

    def filled(document, limit=None):
        e = config.execution(document)
        o = replay.Order(1, "X", 1, D(20), 1, e.rules.fill_as, limit)
        fills, out = replay.Fills(e.rules), {}
        for event in (bar, book):
            fills.begin(event)
            out[event["event_type"]] = [(q, p) for q, p, _ in fills.of(o, event)[0]]
        return out

    assert filled(EXECUTION) == {"bar": [(1, D("100.05"))], "book_snapshot": []}  # a tenth of the volume in version 1
    assert filled(two) == {"bar": [(5, D("100.05"))], "book_snapshot": []}
    assert filled(two | {"fill_model": "market_depth"}) == {"bar": [], "book_snapshot": [(4, D(101))]}
    assert filled(two | {"fill_model": "limit_evidence"}, D(102)) == {"bar": [], "book_snapshot": [(D("1.5"), D(102))]}
    assert filled(two | {"fill_model": "limit_evidence", "queue_haircut": "1"}, D(102)) == {"bar": [], "book_snapshot": [(3, D(102))]}
    assert filled(two | {"fill_model": "diagnostic_midpoint"}) == {"bar": [], "book_snapshot": [(20, D(100))]}
    run = replay.Run(lambda e, book, rules: None, config.execution(two | {"fill_model": "market_depth"}).rules, -1)
    assert run.rules.fill_as == "market"


def test_execution_fingerprints_are_of_what_holds():
    mark = lambda **more: config.execution(EXECUTION | more).fingerprint
    limit = {"fill_model": "limit_evidence"}
    assert mark(**limit) == mark(**limit, queue_haircut="0.5", adverse_selection_haircut="0.75")
    assert mark(**limit) != mark(**limit, queue_haircut="0.6") != mark()
    core = {"schema_version": 1, "initial_cash": "1000", "fill_model": "bar_next_open", "fee_rate": "0.001", "slippage_bps": "5"}
    assert mark() == values.fingerprint(core)


def test_the_fence_reads_the_text():
    assert config.refused_imports("import math\nfrom decimal import Decimal") == []
    for text in ("def f():\n    import socket", "from tapewright import sources", "__import__('socket')", "import importlib", "exec('import ssl')", "from urllib import request as r", "import os, http.client"):
        assert config.refused_imports(text), text


def test_policies():
    document = {"policy_version": "p1", "created_at": "2024-01-01", "global": {"sizing": {}, "limits": {"max_position_units": 2, "max_notional": 500, "max_daily_loss": 20}, "stress": {}}, "asset_classes": {"futures": {"pbo": 0.1}}}
    a = config.policy_artifact(document, "futures")
    p = config.policy(a)
    assert (p.max_units, p.policy_id) == (2, "p1-futures") and p.applied(replay.Rules()).max_notional == 500
    with pytest.raises(ValueError):
        config.policy(a | {"limits": {"max_position_units": 9, "max_notional": 500, "max_daily_loss": 20}})
    with pytest.raises(ValueError):
        config.policy_artifact(document, "art")


def test_documents(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    assert config.read_document(str(tmp_path / "a.json")) == {"x": 1}
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.txt").write_text("{}")
    for n in ("b.json", "c.txt"):
        with pytest.raises(ValueError):
            config.read_document(str(tmp_path / n))


# ---- folders, packages, reports ----


def test_folders(spark, tmp_path):
    at = Folder(spark, str(tmp_path / "f"))
    at.make()
    assert at.claim("x", "1") and not at.claim("x", "2") and at.read("x") == "1"
    at.write("d/y", "é")
    at.write("d/y", "ü")
    assert at.matching("*/y") == {"d/y"} and at.matching("q=*") == set()
    assert at.read("d/y") == "ü" and at.names("d") == ["y"] and at.names("none") == []
    at.write("z", "1", create_only=True)
    at.write("z", "1", create_only=True)
    with pytest.raises(AlreadyThere):
        at.write("z", "2", create_only=True)
    at.move("d/y", "e/y")
    with pytest.raises(AlreadyThere):
        at.move("z", "e/y")


def test_ledger_of_several_writers(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tapewright.sources import sinks

    path = str(tmp_path / "l.jsonl")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: sinks.append_ledger(path, {"k": k, "pad": "x" * (k * 300)}), range(40)))
    rows = [json.loads(x) for x in open(path, encoding="utf-8")]
    assert sorted(r["k"] for r in rows) == list(range(40))
    assert [r["previous_hash"] for r in rows] == [None, *[r["entry_hash"] for r in rows[:-1]]]


def test_packages(spark, tmp_path):
    runs = baselines.run(spark, ["buy_hold"])
    tape = baselines.tape(spark, ["buy_hold"])
    m = baselines.report(runs).drop("run_id", "promotable").first().asDict()
    assert (m["pnl"], m["gross_pnl"], m["fills"]) == (pytest.approx(24.515137425, abs=1e-9), pytest.approx(24.85, abs=1e-9), 2)
    quality = [{"code": "duplicates", "severity": "error", "n": 0}, {"code": "outliers", "severity": "warning", "n": 2}]
    args = dict(spec={"strategy_id": "buy_hold", "family": "buy_hold"}, space={"variants": [{}]}, metrics=m)
    path = str(tmp_path / "p")
    package.register_search_space(spark, path, {"variants": [{}]})
    with pytest.raises(package.Blocked):
        package.write_package(runs, tape, path, quality=[{"code": "duplicates", "severity": "error", "n": 1}], **args)
    with pytest.raises(AlreadyThere):
        package.write_package(runs, tape, path, quality=quality, **(args | {"space": {"variants": [{"other": 1}]}}))
    package.write_package(runs, tape, path, quality=quality, **args)
    assert package.package_problems(spark, path) == []
    with pytest.raises(FileExistsError):
        package.write_package(runs, tape, path, quality=quality, **args)
    text = (tmp_path / "p" / "metrics_report.json").read_text()
    (tmp_path / "p" / "metrics_report.json").write_text(text.replace("24.515137425", "25.515137425"))
    assert package.package_problems(spark, path) == ["metrics_report.json"]
    assert "| pnl | 24.515137425 |" in (tmp_path / "p" / "run_report.md").read_text()
    with pytest.raises(ValueError):
        package.write_package(runs, tape, str(tmp_path / "q"), quality=quality, **(args | {"spec": {"family": "random"}}))


def test_baselines_and_dashboard(spark):
    r = {x.run_id: x for x in baselines.report(baselines.run(spark)).collect()}
    assert set(r) | {baselines.COMPLEMENT} == set(baselines.NAMES)
    assert baselines.complements(spark).count() == 15
    page = package.dashboard("t", {"runs": baselines.report(baselines.run(spark)), "quality": spark.createDataFrame([("<x>", "error", 1)], "code string, severity string, n long")})
    assert page.count("<section") == 9 and "&lt;x&gt;" in page and "futures_trend" in page and page.count("nothing recorded") == 7
    with pytest.raises(ValueError):
        package.dashboard("t", {"quality": spark.range(2000).withColumnRenamed("id", "n")})
    with pytest.raises(ValueError):
        package.dashboard("t", {"art": spark.range(1)})


# ---- sources ----


def test_ordered_json_lines(spark, tmp_path):
    line = lambda i, t: json.dumps({"instrument_id": f"i{i % 3}", "event_time_ns": t, "receive_time_ns": t, "sequence": None if i % 5 == 0 else i, "ingest_id": f"{i:05d}"})
    schema = "instrument_id string, event_time_ns long, receive_time_ns long, sequence long, ingest_id string"
    path = tmp_path / "e.jsonl"
    path.write_text("\n".join(line(i, i * 10) for i in range(500)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, proof = files.read_ordered_jsonl(spark, str(path), schema)
        assert rows.count() == proof["rows"] == 500 and proof["instruments"] == ["i0", "i1", "i2"]
        same = files.read_ordered_jsonl(spark, str(path), schema)[1]
        path.write_text("\n".join(line(i, i * 10) for i in range(499)) + "\n" + line(499, 4991))
        assert files.read_ordered_jsonl(spark, str(path), schema)[1]["digest"] != proof["digest"] == same["digest"]
        swapped = [line(i, i * 10) for i in range(500)]
        for k in (1, 77, 250, 499):
            other = list(swapped)
            other[k - 1], other[k] = other[k], other[k - 1]
            path.write_text("\n".join(other))
            with pytest.raises(ValueError):
                files.read_ordered_jsonl(spark, str(path), schema)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text("\n")
    with pytest.raises(ValueError):
        files.read_ordered_jsonl(spark, str(path), schema)


def test_spot_pages():
    klines, trades = [[t, "1"] for t in range(0, 50, 2)], [{"a": 100 + k, "T": k // 3} for k in range(60)]
    asked = []

    def get(url, p):
        asked.append(dict(p))
        if url.endswith("klines"):
            got = [k for k in klines if p["startTime"] <= k[0] <= p["endTime"]]
        elif url.endswith("aggTrades"):
            got = [t for t in trades if (t["a"] >= p["fromId"] if "fromId" in p else p["startTime"] <= t["T"] <= p["endTime"])]
        else:
            return 200, json.dumps({"bids": [], "asks": []})
        return 200, json.dumps(got[: p["limit"]])

    assert markets.spot_rows(get, "b", "klines", "X", 0, 41, limit=4) == [k for k in klines if k[0] < 41]
    assert [a["startTime"] for a in asked[:3]] == [0, 7, 15]
    assert markets.spot_rows(get, "b", "trades", "X", 2, 9, limit=5) == [t for t in trades if 2 <= t["T"] < 9]
    assert "fromId" in asked[-1] and "startTime" not in asked[-1]
    assert markets.spot_rows(get, "b", "book", "X") == {"bids": [], "asks": []}
    for bad in (("art", "X"), ("klines", "")):
        with pytest.raises(ValueError):
            markets.spot_rows(get, "b", *bad)


def test_prediction_documents():
    get = lambda url, p: (200, json.dumps([url, p]))
    read = lambda *a: markets.prediction_document(get, "c", "k", *a)
    assert read("markets") == ["c/markets", None]
    assert read("book", "7") == ["k/book", {"token_id": "7"}]
    assert read("fee_rate", "7") == ["k/fee-rate/7", None]
    assert read("price_history", "7", {"interval": "1d"}) == ["k/prices-history", {"market": "7", "interval": "1d"}]
    for bad in (("book", None), ("art", "7")):
        with pytest.raises(ValueError):
            read(*bad)


def test_adapters(spark):
    answers = {
        "exchangeInfo": {"symbols": [{"symbol": "AB", "status": "TRADING", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.10"}, {"filterType": "LOT_SIZE", "stepSize": "0.5"}]}, {"symbol": "CD", "status": "BREAK", "filters": []}]},
        "klines": [[0, "1", "2", "0.5", "1.5", "9", 59, "0", 3], [60, "1", "2", "0.5", "1.6", "9", 5000, "0", 3]],
        "aggTrades": [{"a": 1, "p": "2", "q": "3", "T": 4, "m": True}],
        "depth": {"lastUpdateId": 5, "bids": [["1", "2"]], "asks": []},
        "markets": [{"id": 7, "clobTokenIds": '["a","b"]', "outcomes": '["Yes","No"]'}],
        "prices-history": {"history": [{"t": 1_700_000_000_000, "p": 0.25}]},
        "fee-rate": {"base_fee": 15},
    }
    get = lambda url, p: (200, json.dumps(next(v for k, v in answers.items() if k in url)))
    spot = markets.SpotAdapter(spark, get)
    assert [(r.instrument_id, r.lot_size) for r in spot.discover().collect()] == [("AB", D("0.5"))]
    bars = spot.normalize("klines", spot.fetch("klines", "AB", 0, 100), "AB", 1_000_000_000)
    assert [r.close for r in bars.collect()] == [D("1.5")]
    assert spot.normalize("trades", spot.fetch("trades", "AB"), "AB", 9).first().size == 3
    assert spot.normalize("book", spot.fetch("book", "AB"), "AB", 9).first().bids[0].price == 1
    other = bars.selectExpr("event_time_ns", "close", "1 AS ord")
    assert spot.cross_check(bars.select("event_time_ns", "close"), other).first().status == "pass"
    assert spot.manifest(bars.withColumn("source", F.lit("s"))).first().n == 1
    prediction = markets.PredictionAdapter(spark, get)
    assert sorted(r.instrument_id for r in prediction.discover().collect()) == ["a", "b"]
    assert prediction.normalize("price_history", prediction.fetch("price_history", "a"), "a", 1_700_000_100_000_000_000).first().price == D("0.25")
    assert prediction.costs("a")["fee_rate"] == "0.0015"
    with pytest.raises(NotImplementedError):
        markets.Adapter(spark, get).discover()


def test_models_can_be_replaced(spark):
    class Generous(replay.Fills):
        def of(self, o, e):
            return ([(o.quantity, D(1), D(0))], "wait", "") if e["receive_time_ns"] > o.decided else ([], "wait", "")

    models = replay.Models(fills=Generous, costs=lambda *a: (D(1), D(0), D(0)), risk=lambda o, book, r: "closed" if o.side < 0 else "")
    df = spark.createDataFrame([("a", *(r[c] for c in ("instrument_id", "event_type", "event_time_ns", "receive_time_ns", "sequence", "ingest_id", "open", "close", "volume"))) for r in walk(3, 20)], "run_id string, " + EVENT)
    out = replay.replay(df, lambda run: strategies.BuyHold(), models=models).collect()
    assert [(r.price, r.fee) for r in out if r.kind == "fill"] == [("1", "1")]
    assert [r.reason for r in out if r.kind == "rejected"] == ["closed"]


def test_streams_reconnect_and_land(spark, tmp_path):
    tries = iter([['{"a": 1}', "broken"], ['{"a": 2}'], None])

    def connect():
        rows = next(tries)
        if rows is None:
            raise ConnectionError
        yield from rows

    waits, notes = [], {}
    root = str(tmp_path / "raw")
    archive = markets.landing(spark, root)
    assert [m["a"] for m in markets.reconnecting(connect, archive, sleep=waits.append, notes=notes)] == [1, 2]
    assert waits == [2] and notes["messages"] == 2 and notes["errors"] == ["JSONDecodeError"]
    q = markets.landed(spark, root, "a long").writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.a for r in spark.table("landed").collect()) == [1, 2]

    def never():
        raise ConnectionError
        yield

    waits.clear()
    with pytest.raises(RuntimeError):
        list(markets.reconnecting(never, archive, sleep=waits.append))
    assert waits == [2, 4, 8, 16, 30]


# ---- recomputation ----


def test_explicit_folds(spark):
    folds = recompute.explicit_folds(spark, [(10, 20), (20, 30)], 30).collect()
    assert [(f.train_start, f.train_end, f.test_start, f.test_end) for f in folds] == [(0, 10, 10, 20), (0, 20, 20, 30)]
    for bad in ([(1, 5)], [(10, 20), (19, 30)], [(10, 10)], [(10, 31)]):
        with pytest.raises(ValueError):
            recompute.explicit_folds(spark, bad, 30)


def test_promotion_problems_of_odd_rows(spark):
    """Runs without a key or twice, metrics repeated, unasked for, of unknown runs, not finite, missing."""
    sides = [(s, n) for s in ("gross", "net") for n in recompute.PROMOTION_METRICS]
    odd = {(1, "gross", "pnl"): [float("nan"), None], (1, "net", "pnl"): [float("inf")], (1, "net", "sharpe"): [float("nan"), 0.0], (3, "net", "turnover"): []}
    rows = [(k, s, n, v) for k in (1, 2, 3, 9, None) for s, n in sides for v in odd.get((k, s, n), [1.5, 1.5])]
    rows += [(4, "gross", "capacity", 1.0), (4, None, "pnl", 1.0), (4, "net", None, 1.0)]
    runs = [(1, 3, 252.0), (2, 1, 12.0), (3, None, 0.0), (3, 0, None), (4, 3, 252.0), (5, 3, 252.0), (None, 3, 252.0)]
    metrics = spark.createDataFrame(rows, "run long, side string, name string, value double")
    got = recompute.promotion_problems(metrics, spark.createDataFrame(runs, "run long, trades long, periods_per_year double"), "run")
    want = [(1, "gross.pnl"), (1, "net.pnl")] + [(3, p) for p in ("net.turnover", "trades", "periods_per_year")] * 2 + [(k, f"{s}.{n}") for k in (4, 5, None) for s, n in sides]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_promotion_problems_broadcast_nothing(spark):
    """Twelve metrics a run look as small as the runs they are made from; held by the driver, they ended the query by its memory."""
    runs = spark.range(20_000).select(F.col("id").alias("run"), F.lit(3).alias("trades"), F.lit(252.0).alias("periods_per_year"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("name")) for s in ("gross", "net") for n in recompute.PROMOTION_METRICS]))
    metrics = runs.select("run", sides.alias("x")).select("run", "x.side", "x.name", F.when(F.col("run") != 7, 1.0).alias("value"))
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")
    try:
        assert {r.run for r in recompute.promotion_problems(metrics, runs, "run").collect()} == {7}
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def test_features_refuse_other_bars(spark):
    b = spark.createDataFrame([("X", 1, 100.0), ("X", 2, 110.0)], "instrument_id string, event_time_ns long, close double")
    digest = lookups.order_free_digest(b, sorted(b.columns)).first()["digest"]
    assert [r.return_1 for r in features.bar_returns(b, digest).orderBy("event_time_ns").collect()] == [None, pytest.approx(0.1)]
    with pytest.raises(ValueError):
        features.bar_returns(b.withColumn("close", F.col("close") + 1), digest)


def test_identity_is_not_fooled_by_separators(spark):
    cols = "source string, venue string, instrument_id string, event_type string, event_time_ns long, sequence long, ingest_id string, a string, b string"
    same = ("s", "v", "i", "t", 1, 1, "x")
    df = spark.createDataFrame([(*same, "a|b", "c"), (*same, "a", "b|c")], cols)
    assert lookups.dedup_rows(df, ["a", "b"])[1].first().variants == 2


def test_multipliers_cover_every_fill(spark):
    f = spark.createDataFrame([("X", 2.0, 3.0), ("Y", 1.0, 1.0)], "instrument_id string, price double, quantity double")
    none = spark.createDataFrame([], "instrument_id string, multiplier double")
    assert [r.notional for r in lookups.multiplier_notional(f, none, "instrument_id").orderBy("instrument_id").collect()] == [6.0, 1.0]
    some = spark.createDataFrame([("X", 50.0)], "instrument_id string, multiplier double")
    with pytest.raises(Exception, match="no multiplier for Y"):
        lookups.multiplier_notional(f, some, "instrument_id").collect()


def test_containment_with_many_allowed_intervals(spark, monkeypatch):
    rng = random.Random(4)
    day = 86_400_000_000_000
    allowed = [(a, a + rng.randint(1, 3 * day)) for a in (rng.randint(0, 9 * day) for _ in range(40))]
    asked = [(a, a + rng.randint(0, day)) for a in (rng.randint(0, 11 * day) for _ in range(300))] + [allowed[0], (allowed[1][0], allowed[1][1] + 1)]
    x = spark.createDataFrame([(a, b, "k") for a, b in asked], "start_ns long, end_ns long, name string")
    y = spark.createDataFrame(allowed, "start_ns long, end_ns long")
    want = sorted((a, b) for a, b in asked if any(s <= a and b <= e for s, e in allowed))
    for bound in (10_000, 5):
        monkeypatch.setattr(lookups, "BROADCAST_INTERVALS", bound)
        assert sorted((r.start_ns, r.end_ns) for r in lookups.contained_in(x, y).collect()) == want
