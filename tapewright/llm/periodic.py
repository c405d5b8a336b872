"""Periodic runs: stretches of a text whose words repeat with a period, found by bit-parallel lags."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, release
from .merkle import crc32_sql, crc_table_sql

#: A run is as long as this many words and this many periods at least.
LEAST, TIMES = 24, 3
#: Lags from this size on are tried on every second, fourth .. word first: a stretch as long as they need covers as many of those.
SPARSE = 512
#: Planes that are compared before the rest.
FIRST = 2


def planes(ids: np.ndarray, most: int) -> list[int]:
    """Bit b of every id, one big integer per b below ``most``: word i is bit i."""
    bits = range(min(most, max(1, int(ids.max(initial=0)).bit_length())))
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in bits]


def stretches(ones: int, length: int) -> int:
    """The places where ``length`` ones begin: ANDs of the bits with themselves, shifted by what is known already."""
    have = 1
    while have < length and ones:
        step = min(have, length - have)
        ones &= ones >> step
        have += step
    return ones


def span(a: int, b: int) -> int:
    """Ones at a .. b - 1."""
    return ((1 << (b - a)) - 1) << a if b > a else 0


class Lags:
    """The words of a text as bit planes, whole and of every 2^k-th word from each start."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.whole = planes(ids, 64)
        self.sparse: dict[int, list[list[int]]] = {}

    def mismatch(self, lag: int, ones: slice) -> int:
        out = 0
        for p in self.whole[ones]:
            out |= p ^ (p >> lag)
        return out

    def may_hold(self, lag: int, need: int, gone: list[tuple[int, int]]) -> bool:
        """Whether the every 2^k-th words let a stretch of ``need`` equal words at this lag be; never wrong when it says no."""
        k = lag.bit_length() - SPARSE.bit_length() + 1
        if k < 1:
            return True
        step = 1 << k
        if step not in self.sparse:
            self.sparse = {step: [planes(self.ids[r::step], FIRST) for r in range(step)]}
        shift, r = divmod(lag, step)
        here, there = self.sparse[step][0], self.sparse[step][r]
        out = 0
        for i in range(max(len(here), len(there))):
            out |= (here[i] if i < len(here) else 0) ^ ((there[i] >> shift) if i < len(there) else 0)
        equal = ~out & span(0, -(-(self.n - lag) // step))
        for a, b in gone:
            equal &= ~span(-(-a // step), -(-(b - lag) // step))
        return stretches(equal, need // step) != 0

    def at(self, lag: int, need: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(first, last + 1) of the stretches of ``need`` words and more that equal those a lag later. ``gone``: runs whose
        period divides the lag; their stretches are not of this period."""
        if not self.may_hold(lag, need, gone):
            return []
        keep = span(0, self.n - lag)
        for a, b in gone:
            keep &= ~span(a, b - lag)
        different = self.mismatch(lag, slice(0, FIRST))
        if len(self.whole) > FIRST:
            if not stretches(~different & keep, need):
                return []
            different |= self.mismatch(lag, slice(FIRST, None))
        begins = stretches(~different & keep, need)
        out, passed = [], 0
        while begins:
            low = (begins & -begins).bit_length() - 1
            begins >>= low
            ones = (begins ^ (begins + 1)).bit_length() - 1
            begins >>= ones
            out.append((passed + low, passed + low + ones - 1 + need))
            passed += low + ones
        return out


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period.

    For each lag the planes are XORed with themselves shifted by it and the differences ORed; zeros are words that equal those
    a lag later, and ``max(least - lag, (times - 1) * lag)`` zeros in a row, found by shift-doubling ANDs, are a run. Two runs
    whose periods divide each other overlap by less than the larger one, so stretches of known runs are cleared from multiples
    of their periods, and each run appears at its smallest period. ``times`` is 2 at least.
    """
    n = len(words)
    if n < least or n < times:
        return []
    number: dict = {}
    lags = Lags(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n))
    found: list[tuple[int, int, int]] = []
    if len(number) == n:
        return found
    gone: dict[int, list[tuple[int, int]]] = {}
    for lag in range(1, n // times + 1):
        known = gone.pop(lag, [])
        for a, b in lags.at(lag, max(least - lag, (times - 1) * lag), known):
            end = b + lag
            found.append((a, end - a, lag))
            for m in range(2 * lag, (end - a) // times + 1, lag):
                gone.setdefault(m, []).append((a, end))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return words if stays.all() else [w for w, s in zip(words, stays.tolist()) if s]


def repeat_tail(key: int | None, words: list[bytes], every: int = 10) -> list[bytes]:
    """Words for one key of ``every`` (by the CRC-32 of its decimal digits) with a periodic tail whose place and period follow
    from the key; a null key keeps its words."""
    h = crc32(str(key).encode()) if key is not None else 1
    if h % every or not words:
        return words
    g, n = h // every, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: (id column, n_words, runs array<struct<start, length, period>>, collapsed binary).

    Words are what stands between space, tab, line feed, vertical tab, form feed and carriage return. A run is a stretch of
    words with smallest period q and a length of max(least, times * q) words or more that no neighbour extends. ``collapsed``
    is the text without words that a run holds after its first q words, joined by single spaces. ``prepare`` may change the
    words of a row first. Null and empty texts have no words; texts of any length are read whole, in one task each: the time
    for n words is about n log n bit operations and n / 3 lags. Repeated rows come back as often as they are there; other
    columns are not read.
    """

    def batch_runs(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = (body or b"").split()
                    if prepare:
                        words = prepare(key, words)
                    found = find_runs(words, least, times)
                    rows.append((key, len(words), [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(kept_words(words, found))))
                run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                types = (part.schema.field(0).type, pa.int64(), pa.list_(run), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "n_words", "runs", "collapsed"])
        release()

    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("key"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(batch_runs, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary").withColumnRenamed("key", id_column)


def best_run(found: str = "runs") -> Column:
    """The run with the greatest length/period; ties go to the smallest start, then period. Null without runs."""
    better = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    return F.aggregate(found, F.element_at(F.col(found), F.when(F.size(found) > 0, 1)), lambda b, r: F.when(better(r, b), r).otherwise(b))


def report(docs: DataFrame) -> DataFrame:
    """Runs of texts of which a tenth gets a periodic tail: doc_id, n_runs, the best run, digests of all runs and of what is left."""
    found = runs(docs, prepare=repeat_tail)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best_run()).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB SQL. Every run has 16 words in a row that stand again a period later, so all pairs of equal
    strings of 16 words in a text are made, and consecutive pairs of a distance are stretches; of one place and length the
    smallest distance is the period."""
    return f"""
WITH RECURSIVE {crc_table_sql()},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({crc32_sql('doc_id::VARCHAR')}, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM {table}, crc_table),
g AS (SELECT *, h // 10 AS g, len(w) AS n FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
grams AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS m FROM (SELECT r, w, unnest(range(0, n - 15)) AS i FROM t)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.m = y.m AND x.i < y.i),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs),
stretch AS (SELECT r, q, min(i) AS s, count(*) + 15 + q AS l FROM isle GROUP BY r, q, k),
runs AS (SELECT r, s, l, min(q) AS q FROM stretch WHERE l >= greatest({LEAST}, {TIMES} * q) GROUP BY r, s, l),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS x FROM (SELECT r, unnest(w) AS x, unnest(range(0, n)) AS i FROM t) ANTI JOIN gone USING (r, i) GROUP BY r),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min(struct_pack(s, l, q), (-(l::DOUBLE) / q, s, q)) AS b FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, b.l * 1000 // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)"""
