"""DuckDB SQL for operators that loop or draw: replays as recursive queries, resampling tests over the generators' numbers.

The numbers that seeded generators give are written into the SQL as literals, for the OBSERVATIONS days of returns and the
HOURS bars that the event tables hold."""

from __future__ import annotations

import math

import numpy as np

from ..sources import views as V

HOUR, DAY = V.HOUR_NS, V.DAY_NS
OBSERVATIONS, HOURS = 29, 720

# ---- replay ----

#: A run's bars in order: run, i from 0, n bars, t, open, close, volume, and the position wanted (null: as it is). Prices are
#: whole millionths, quantities and volumes ten-thousandths, money 1e-17: nothing is rounded before the end.
RUN_COLUMNS = "round(open * 1000000)::HUGEINT AS open, round(close * 1000000)::HUGEINT AS close, round(volume * 10000)::HUGEINT AS volume"
_LIST = "STRUCT(s INTEGER, q HUGEINT)[]"


def _sum(values: str) -> str:
    return f"coalesce(list_sum({values}), 0)::HUGEINT"


def money(v: str, unit: int = 10**17) -> str:
    """Money rounded half up to six digits."""
    half, whole = unit // 2_000_000, unit // 1_000_000
    return f"((CASE WHEN {v} >= 0 THEN ({v} + {half}) // {whole} ELSE -(({half} - ({v})) // {whole}) END)::DOUBLE / 1000000)"


def steps(wanted: str, open_end: bool = False) -> str:
    """CTEs ``bar`` and ``step``: after every bar of a run its position, cash, waiting orders and what was filled.

    Orders wait first come, first served for a tenth of a later bar's volume, at its open and five basis points; the fee is a
    thousandth. The difference between what is wanted and held is ordered, but not at the last bar (of a run without an open end)."""
    going = "true" if open_end else "i < n - 1"
    return f"""bar AS MATERIALIZED ({wanted}),
step(run, i, t, open, close, held, cash, bought, paid, waiting, done) AS (
  SELECT run, i, t, open, close, 0::HUGEINT, 10000000000000000000000::HUGEINT, 0::HUGEINT, 0::DOUBLE,
    CASE WHEN want <> 0 AND {going} THEN [{{'s': sign(want)::INTEGER, 'q': (abs(want) * 10000)::HUGEINT}}] ELSE [] END::{_LIST}, []::{_LIST}
  FROM bar WHERE i = 0
  UNION ALL
  SELECT run, i, t, open, close, held2, cash2, bought + gain, paid + gain::DOUBLE / 1e4 * open::DOUBLE / 1e6 * 1.0005,
    CASE WHEN want * 10000 <> held2 AND {going} THEN list_append(rest, {{'s': sign(want * 10000 - held2)::INTEGER, 'q': abs(want * 10000 - held2)::HUGEINT}}) ELSE rest END::{_LIST}, done
  FROM (
    SELECT *, held + {_sum("list_transform(done, lambda x: x.s * x.q)")} AS held2,
      cash - {_sum("list_transform(done, lambda x: x.q * open * (10000 + 5 * x.s) * (1000 * x.s + 1))")} AS cash2,
      {_sum("list_transform(done, lambda x: CASE WHEN x.s > 0 THEN x.q ELSE 0 END)")} AS gain,
      list_filter(list_transform(waiting, lambda x, k: {{'s': x.s, 'q': x.q - done[k].q}}), lambda x: x.q > 0) AS rest
    FROM (
      SELECT b.*, s.held, s.cash, s.bought, s.paid, s.waiting,
        list_transform(s.waiting, lambda x, k: {{'s': x.s, 'q': greatest(0, least(x.q, coalesce(b.volume, 0) // 10 - {_sum("list_transform(s.waiting[1:k - 1], lambda y: y.q)")}))}}) AS done
      FROM step s JOIN bar b ON b.run = s.run AND b.i = s.i + 1)))"""


#: Equity in units of 1e-17, and as a number.
EQUITY = "(cash + held * close * 10000000)"


HOURLY = "row_number() OVER (PARTITION BY instrument_id ORDER BY event_time_ns) - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n"
BUY_HOLD = f"SELECT *, CASE i WHEN n - 2 THEN 0 WHEN 0 THEN 1 END AS want FROM (SELECT instrument_id AS run, {HOURLY}, event_time_ns AS t, {RUN_COLUMNS} FROM bars_h)"
DONCHIAN = f"""SELECT *, CASE WHEN i = n - 2 THEN 0 WHEN i >= 10 THEN CASE WHEN close > max(close) OVER w THEN 1 WHEN close < min(close) OVER w THEN -1 END END AS want
FROM (SELECT instrument_id AS run, {HOURLY}, event_time_ns AS t, {RUN_COLUMNS} FROM bars_h) WINDOW w AS (PARTITION BY run ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def recursive(body: str, *views: str) -> str:
    return V.sql(body, *views).replace("WITH ", "WITH RECURSIVE ", 1)


def _replay(wanted: str, select: str, open_end: bool = False) -> str:
    base = V.sql("", "bars_h").rstrip()
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + steps(wanted, open_end) + "\n" + select


_FILLS = f"""SELECT run AS run_id, t + 1000000 AS event_time_ns, CASE WHEN x.s > 0 THEN 'buy' ELSE 'sell' END AS side, x.q::DOUBLE / 10000 AS quantity, {money("open * (10000 + 5 * x.s)", 10**10)} AS price,
  {money("x.q * open * (10000 + 5 * x.s)", 10**17)} AS fee, {money("x.q * open * 5", 10**14)} AS slippage FROM (SELECT run, t, open, unnest(done) AS x FROM step) WHERE x.q > 0"""
REPLAY_FILLS = _replay(DONCHIAN, _FILLS)
RESUMED_FILLS = _replay(DONCHIAN.replace("WHEN i = n - 2 THEN 0 ", ""), _FILLS, open_end=True)
RESUMED_ROWS = _replay(DONCHIAN.replace("WHEN i = n - 2 THEN 0 ", ""), "SELECT (SELECT count(*) FROM step) + (SELECT count(*) FROM (SELECT unnest(done) AS x FROM step) WHERE x.q > 0) AS rows, 0::BIGINT AS differing", open_end=True)
REPLAY_EQUITY = _replay(
    BUY_HOLD,
    f"""SELECT run AS run_id, t + 1000000 AS event_time_ns, {money("cash")} AS cash, {money(EQUITY)} AS equity,
  round(CASE WHEN held = 0 THEN 0 ELSE held::DOUBLE / 1e4 * (close::DOUBLE / 1e6 - paid / (bought::DOUBLE / 1e4)) END, 6) AS unrealized FROM step""",
)

#: Every event as a bar of its own: buy and hold over the whole tape.
EVENT_REPLAY = V.sql("", "canon").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + steps(
    """SELECT *, CASE i WHEN n - 2 THEN 0 WHEN 0 THEN 1 END AS want FROM (SELECT instrument_id AS run, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n, event_time_ns AS t,
  round(price * 1000000)::HUGEINT AS open, round(price * 1000000)::HUGEINT AS close, round(size * 10000)::HUGEINT AS volume FROM canon WINDOW w AS (PARTITION BY instrument_id ORDER BY event_time_ns, sequence))"""
) + f"\nSELECT run AS run_id, count(*) AS events, {money('arg_max(' + EQUITY + ', i)')} AS equity FROM step GROUP BY run"

#: The eighteen metrics of ``curve`` (key, event_time_ns, equity) and ``trade`` (key, event_time_ns, notional).
METRICS = """dd AS (SELECT *, (peak - equity) / peak AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY key ORDER BY event_time_ns ROWS UNBOUNDED PRECEDING) AS peak FROM curve)),
runs AS (SELECT *, sum((drawdown > 0)::INT) OVER (PARTITION BY key, g ORDER BY event_time_ns ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, sum((drawdown <= 0)::INT) OVER (PARTITION BY key ORDER BY event_time_ns ROWS UNBOUNDED PRECEDING) AS g FROM dd)),
r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY key ORDER BY event_time_ns) - 1 AS ret FROM runs),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ret NULLS LAST, event_time_ns) AS rn, count(ret) OVER (PARTITION BY key) AS n FROM r),
a AS (SELECT key, arg_max(equity, event_time_ns) - {cash} AS pnl, (arg_max(equity, event_time_ns) - {cash}) / {cash} AS total_return, count(ret) AS n,
  stddev_pop(ret) AS sd, stddev_pop(ret) FILTER (ret < 0) AS sd_down, count(*) FILTER (ret < 0) AS n_down, avg(ret) AS mean,
  max(drawdown) AS max_drawdown, avg(drawdown) AS average_drawdown, max(run) AS drawdown_duration, count(*) FILTER (ret > 0) / count(ret) AS win_rate,
  avg(ret) FILTER (ret > 0) / abs(avg(ret) FILTER (ret < 0)) AS payoff_ratio, abs(avg(ret) FILTER (rn <= greatest(1, ceil(n * 0.05)))) AS expected_shortfall FROM k GROUP BY 1),
f AS (SELECT key, sum(notional) / {cash} AS turnover, avg(gap) / 1e9 AS average_holding_period FROM (SELECT key, notional, event_time_ns - lag(event_time_ns) OVER (PARTITION BY key ORDER BY event_time_ns) AS gap FROM trade) GROUP BY 1),
y AS (SELECT *, exp(ln(1 + total_return) * {year} / n) - 1 AS annualized_return FROM a)
SELECT key AS {key}, round(pnl, 6) AS pnl, round(total_return, 6) AS total_return, round(annualized_return, 6) AS annualized_return, round(sd * sqrt({year}), 6) AS volatility,
  CASE WHEN n_down > 1 THEN round(sd_down * sqrt({year}), 6) END AS downside_volatility, round(mean / nullif(sd, 0) * sqrt({year}), 6) AS sharpe,
  CASE WHEN n_down > 1 THEN round(mean / nullif(sd_down, 0) * sqrt({year}), 6) END AS sortino, round(annualized_return / nullif(max_drawdown, 0), 6) AS calmar,
  round(max_drawdown, 6) AS max_drawdown, round(average_drawdown, 6) AS average_drawdown, drawdown_duration, round(win_rate, 6) AS win_rate, round(payoff_ratio, 6) AS payoff_ratio,
  round(mean * {cash}, 6) AS expectancy, round(coalesce(turnover, 0), 6) AS turnover, round(average_holding_period, 6) AS average_holding_period, round(expected_shortfall, 6) AS expected_shortfall,
  NULL::DOUBLE AS capacity_estimate FROM y LEFT JOIN f USING (key)"""
REPLAY_METRICS = _replay(
    BUY_HOLD,
    f", curve AS (SELECT run AS key, t AS event_time_ns, {EQUITY}::DOUBLE / 1e17 AS equity FROM step),\n"
    "trade AS (SELECT run AS key, t AS event_time_ns, (x.q * open * (10000 + 5 * x.s))::DOUBLE / 1e14 AS notional FROM (SELECT run, t, open, unnest(done) AS x FROM step) WHERE x.q > 0),\n"
    + METRICS.format(cash="100000.0", year=repr(365.25 * 24), key="run_id"),
).replace("\n, curve", ",\ncurve", 1)

# ---- sweeps ----

#: Folds of 80 and 30 bars with 2 between and 2 after, that fit the longest series.
TRAIN, TEST, PURGE, EMBARGO = 80, 30, 2, 2
_STEP = TEST + PURGE + EMBARGO


def _cells(variants: list[tuple[str, int]]) -> str:
    names = ", ".join(f"('{f}-{n}')" for f, n in variants)
    wanted = []
    for family, n in variants:
        if family == "donchian":
            frame = f"OVER (PARTITION BY run ORDER BY i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            wanted.append(f"WHEN variant = '{family}-{n}' AND i >= {n} THEN CASE WHEN close > max(close) {frame} THEN 1 WHEN close < min(close) {frame} THEN -1 END")
        elif family in ("mean_reversion", "reversion"):
            frame = f"OVER (PARTITION BY run ORDER BY i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            moves = f"OVER (PARTITION BY run ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING)"
            z = f"(close::DOUBLE - avg(close::DOUBLE) {frame}) / nullif(stddev_pop(close::DOUBLE) {frame}, 0)"
            calm = f" AND stddev_pop(move) {moves} <= 0.03" if family == "mean_reversion" else ""
            wanted.append(f"WHEN variant = '{family}-{n}' AND i >= {n}{calm} THEN CASE WHEN {z} <= -1 THEN 1 WHEN {z} >= 1 THEN -1 WHEN abs({z}) < 0.25 THEN 0 END")
        elif family == "flat":
            wanted.append(f"WHEN variant = '{family}-{n}' THEN 0")
    return f"""SELECT run, variant, i, n, t, open, close, volume, CASE WHEN i = n - 2 THEN 0 {' '.join(wanted)} END AS want FROM (
  SELECT *, close::DOUBLE / lag(close::DOUBLE) OVER (PARTITION BY run ORDER BY i) - 1 AS move FROM (
    SELECT instrument_id || '|' || fold || '|' || phase || '|' || variant AS run, variant, p - a AS i, z - a AS n, t, open, close, volume
    FROM (SELECT instrument_id, event_time_ns AS t, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY instrument_id) AS size, {RUN_COLUMNS} FROM bars_h WINDOW w AS (PARTITION BY instrument_id ORDER BY event_time_ns))
    JOIN fold ON p >= a AND p < z AND ends <= size, (VALUES {names}) v(variant)))"""


FOLDS = f"""fold AS (SELECT k AS fold, phase, CASE phase WHEN 'train' THEN k * {_STEP} ELSE k * {_STEP} + {TRAIN + PURGE} END AS a,
  CASE phase WHEN 'train' THEN k * {_STEP} + {TRAIN} ELSE k * {_STEP} + {TRAIN + PURGE + TEST} END AS z, k * {_STEP} + {TRAIN + PURGE + TEST} AS ends
  FROM range(100000) t(k), (VALUES ('train'), ('test')) p(phase) WHERE k * {_STEP} + {TRAIN + PURGE + TEST} <= (SELECT max(c) FROM (SELECT count(*) AS c FROM bars_h GROUP BY instrument_id)))"""
CELL = """cell AS (SELECT split_part(run, '|', 1) AS series, split_part(run, '|', 2)::BIGINT AS fold, split_part(run, '|', 4) AS variant, split_part(run, '|', 3) AS phase, count(*) AS bars,
  arg_max(equity, i) / 100000.0 - 1 AS net_return, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) ELSE 0 END AS score
  FROM (SELECT run, i, equity, equity / lag(equity, 1, 100000.0) OVER (PARTITION BY run ORDER BY i) - 1 AS ret FROM (SELECT run, i, (cash + held * close * 10000000)::DOUBLE / 1e17 AS equity FROM step)) GROUP BY run)"""


def sweep(variants: list[tuple[str, int]], select: str) -> str:
    base = V.sql("", "bars_h").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{base},\n{FOLDS},\n{steps(_cells(variants))},\n{CELL}\n{select}"


# ---- the normal distribution ----


def normal_cdf(z: str) -> str:
    """P(Z <= z) by the series of z^(2k+1) / (2k+1)!!."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: {term})))"


# ---- resampling ----


def _numbers(values) -> str:
    """A table x(j, v) of numbers, j from 0."""
    text = ",".join(str(int(v)) for v in values)
    return f"(SELECT unnest(range({len(list(values))})) AS j, unnest(string_split('{text}', ','))::BIGINT AS v)"


def _starts(samples: int, seed: int, block: int, circular: bool = True) -> tuple[list[int], int]:
    rng, n = np.random.default_rng(seed), OBSERVATIONS
    per = math.ceil(n / block)
    return [int(rng.integers(0, n if circular else n - block + 1)) for _ in range(samples * per)], per


def _resampled(samples: int, seed: int, block: int, circular: bool = True) -> str:
    """draw, obs of block resamples."""
    starts, per = _starts(samples, seed, block, circular)
    return f"(SELECT j // {per} AS draw, (v + k) % {OBSERVATIONS} AS obs FROM {_numbers(starts)}, range({block}) t(k) WHERE j % {per} * {block} + k < {OBSERVATIONS})"


BLOCK = max(1, math.ceil(OBSERVATIONS ** (1 / 3)))
REALITY = f"""SELECT (1 + count(*) FILTER (best >= obs_best - 1e-15)) / 501 AS reality_check_pvalue, (1 + count(*) FILTER (spa >= obs_spa - 1e-12)) / 501 AS spa_pvalue, {BLOCK}::INTEGER AS block_length FROM (
  SELECT draw, max(m) AS best, max(m / nullif(se, 0)) AS spa FROM (
    SELECT draw, variant, sum(ret - mean) / {OBSERVATIONS} AS m, any_value(se) AS se FROM {_resampled(500, 7, BLOCK)} JOIN rets USING (obs) JOIN stat USING (variant) GROUP BY 1, 2) GROUP BY 1),
  (SELECT max(mean) AS obs_best, max(mean / nullif(se, 0)) AS obs_spa FROM stat)"""
STAT = f"stat AS (SELECT variant, avg(ret) AS mean, stddev_samp(ret) / sqrt({OBSERVATIONS}) AS se FROM rets GROUP BY 1)"


def _flips(samples: int, seed: int, block: int) -> tuple[list[int], list[int], int]:
    rng, n = np.random.default_rng(seed), OBSERVATIONS
    count = math.ceil(n / block)
    offsets, signs = [], []
    for _ in range(samples):
        offsets.append(int(rng.integers(0, n)))
        signs += [int(s) for s in rng.choice((-1.0, 1.0), size=count)]
    return offsets, signs, count


def sign_flip(samples: int = 2000, seed: int = 7) -> str:
    offsets, signs, count = _flips(samples, seed, BLOCK)
    d = "(SELECT obs, coalesce(max(ret) FILTER (variant = 'view'), 0) - coalesce(max(ret) FILTER (variant = 'click'), 0) AS d FROM rets GROUP BY 1)"
    return f"""SELECT (1 + count(*) FILTER (m >= observed - 1e-15)) / {samples + 1} AS pvalue, {BLOCK}::INTEGER AS block_length FROM (
  SELECT o.j, avg(d * s.v) AS m FROM {d}, {_numbers(offsets)} o JOIN {_numbers(signs)} s ON s.j // {count} = o.j
  WHERE s.j % {count} = least(((obs - o.v) % {OBSERVATIONS} + {OBSERVATIONS}) % {OBSERVATIONS} // {BLOCK}, {count - 1}) GROUP BY 1), (SELECT avg(d) AS observed FROM {d})"""


def block_bootstrap(block: int, samples: int, seed: int) -> str:
    return f"SELECT variant, draw, round(avg(ret), 6) AS mean FROM {_resampled(samples, seed, block, circular=False)} JOIN rets USING (obs) GROUP BY 1, 2"


def pbo_splits(blocks: int = 8) -> str:
    """CTE ``split``: the in-sample winner of every choice of half of the blocks, with its rank outside."""
    n, size, extra = OBSERVATIONS, *divmod(OBSERVATIONS, blocks)
    head = extra * (size + 1)
    return f"""split AS (SELECT split, variant, rank, rank / (v + 1.0) AS relative_rank FROM (
SELECT *, row_number() OVER (PARTITION BY split ORDER BY inside DESC, variant) AS best, row_number() OVER (PARTITION BY split ORDER BY outside, variant) AS rank, count(*) OVER (PARTITION BY split) AS v FROM (
  SELECT split, variant, sum(s) FILTER (train) / sum(k) FILTER (train) AS inside, sum(s) FILTER (NOT train) / sum(k) FILTER (NOT train) AS outside FROM (
    SELECT sp.split, variant, s, k, list_contains(chosen, block) AS train FROM (SELECT variant, CASE WHEN obs < {head} THEN obs // {size + 1} ELSE {extra} + (obs - {head}) // {size} END AS block, sum(ret) AS s, count(*) AS k FROM rets WHERE obs < {n} GROUP BY 1, 2),
      (SELECT row_number() OVER (ORDER BY a, b, c, e) - 1 AS split, [a, b, c, e] AS chosen FROM range({blocks}) x(a), range({blocks}) y(b), range({blocks}) z(c), range({blocks}) v(e) WHERE a < b AND b < c AND c < e) sp) GROUP BY 1, 2)) WHERE best = 1)"""


def risk_report(paths: int = 500, seed: int = 7) -> str:
    rng, n = np.random.default_rng(seed), OBSERVATIONS
    draws = [int(o) for _ in range(paths) for o in rng.choice(np.arange(n), size=n, replace=True)]
    return f"""fall AS (SELECT variant, path, max((peak - wealth) / peak) AS dd FROM (SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY variant, path ORDER BY place ROWS UNBOUNDED PRECEDING)) AS peak FROM (
  SELECT variant, path, place, product(1 + ret) OVER (PARTITION BY variant, path ORDER BY place ROWS UNBOUNDED PRECEDING) AS wealth FROM (
    SELECT variant, j // {n} AS path, j % {n} AS place, ret FROM {_numbers(draws)} JOIN rets ON obs = v UNION ALL SELECT variant, -1, obs, ret FROM rets))) GROUP BY 1, 2)
SELECT variant, round(max(dd) FILTER (path < 0), 6) AS observed_max, round(quantile_cont(dd, 0.5) FILTER (path >= 0), 6) AS bootstrap_median, round(quantile_cont(dd, 0.95) FILTER (path >= 0), 6) AS bootstrap_p95,
  round(avg((dd >= 0.5)::INT) FILTER (path >= 0), 6) AS risk_of_ruin, any_value(es) AS expected_shortfall
FROM fall JOIN (SELECT variant, round(abs(avg(ret) FILTER (rn <= greatest(1, ceil(n * 0.05)))), 6) AS es FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ret) AS rn, count(*) OVER (PARTITION BY variant) AS n FROM rets) GROUP BY 1) USING (variant) GROUP BY 1"""


def random_signals(seeds: list[int]) -> str:
    """Variant and signal of each place in a series."""
    parts = [f"SELECT {k}::INTEGER AS variant_id, j, v::DOUBLE AS signal FROM {_numbers(np.random.default_rng(s).choice([-1.0, 0.0, 1.0], size=HOURS))}" for k, s in enumerate(seeds)]
    return " UNION ALL ".join(parts)


# ---- book state ----

#: Snapshots at every 50th event; what follows is applied until the first number that does not follow on.
BOOK = """e AS (SELECT instrument_id, sequence AS ord, CASE WHEN arrival_ord % 211 = 0 THEN sequence + 1 ELSE sequence END AS number, sequence % 50 = 1 AS snapshot, (sequence - 1) // 50 AS seg,
    CASE WHEN sequence % 50 = 1 OR arrival_ord % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, round(price, 0) AS price, CASE WHEN sequence % 50 <> 1 AND arrival_ord % 5 = 0 THEN 0.0 ELSE size END AS size FROM canon),
g AS (SELECT *, NOT snapshot AND number <> lag(number) OVER (PARTITION BY instrument_id, seg ORDER BY ord) + 1 AS bad FROM e),
h AS (SELECT *, max(bad::INT) OVER (PARTITION BY instrument_id, seg ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM g),
level AS (SELECT instrument_id, ord, side, price, arg_max(size, c) AS size, arg_max(snapshot, c) AS snapshot FROM (
  SELECT a.instrument_id, a.ord, b.side, b.price, b.size, b.snapshot, b.ord AS c FROM h a JOIN h b ON a.instrument_id = b.instrument_id AND a.seg = b.seg AND b.ord <= a.ord AND NOT b.stopped) GROUP BY 1, 2, 3, 4)
SELECT instrument_id, ord, NOT stopped AS accepted, stopped AS resync, max(l.price) FILTER (l.side = 'bid') AS best_bid, min(l.price) FILTER (l.side = 'ask') AS best_ask, count(l.price)::INTEGER AS levels
FROM h LEFT JOIN (SELECT * FROM level WHERE size <> 0 OR snapshot) l USING (instrument_id, ord) GROUP BY 1, 2, stopped"""
