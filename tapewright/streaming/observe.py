"""Continuing observation: idempotent micro-batches, monitors, book state, and a replay that goes on across batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import NO_SEQUENCE, ordered_lag
from ..operators.books import book_states  # noqa: F401
from ..operators.lookups import order_free_digest
from ..sources.fs import Folder
from .seen import Seen


def monitor(events: DataFrame, now_ns: int, stale_ns: int, skew_ns: int, outage_ns: int) -> DataFrame:
    """(code, n) of what makes a feed unfit: no or future or stale data, clock skew, gaps of a stream."""
    e = ordered_lag(events, ["receive_time_ns"], ("source", "venue", "instrument_id", "event_type"))
    count = lambda c: F.sum(c.cast("long"))
    latest = F.max_by("receive_time_ns", F.struct("event_time_ns", F.coalesce("sequence", F.lit(2**63 - 1)), "receive_time_ns", "ingest_id"))
    a = e.agg(
        F.count("*").alias("rows"),
        count(F.col("receive_time_ns") > now_ns).alias("future_data"),
        F.when(F.lit(now_ns) - latest > stale_ns, 1).otherwise(0).cast("long").alias("stale_data"),
        count(F.abs(F.col("receive_time_ns") - F.col("event_time_ns")) > skew_ns).alias("clock_skew"),
        F.coalesce(count(F.col("receive_time_ns") - F.col("prev_receive_time_ns") > outage_ns), F.lit(0)).cast("long").alias("outage_gap"),
    )
    a = a.withColumn("no_data", (F.col("rows") == 0).cast("long"))
    codes = ["no_data", "future_data", "stale_data", "clock_skew", "outage_gap"]
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for c in codes])).alias("x")).select("x.code", "x.n")


class Frozen(Exception):
    """A feed that contradicted itself is observed no further."""


class Journal:
    """Batches committed so far: their fingerprints, and a freeze that is terminal, as files under ``root`` beside the
    batches, so that another process goes on where this one stopped. A batch again with the same content is a duplicate;
    with other content, with a row twice or with a row seen before, it freezes the feed. What earlier batches held is looked
    up in an index of hashed ids (16 bytes a row) by hash prefix and Bloom filter, not in the batches; a commit opens its own
    mark and no other."""

    def __init__(self, root: str):
        self.root = root

    def _folder(self, spark) -> Folder:
        return Folder(spark, self.root)

    def seen(self, spark) -> Seen:
        return Seen(spark, f"{self.root}/_ids")

    def frozen(self, spark) -> str:
        at = self._folder(spark)
        return at.read("_frozen") if at.exists("_frozen") else ""

    def committed(self, spark) -> list[int]:
        return sorted(int(n) for n in self._folder(spark).names("_marks") if not n.startswith("."))

    def commit(self, batch: DataFrame, batch_id: int) -> str:
        spark, at = batch.sparkSession, self._folder(batch.sparkSession)
        if why := self.frozen(spark):
            raise Frozen(why)
        mark = "|".join(map(str, order_free_digest(batch, sorted(batch.columns)).first()))
        if at.exists(f"_marks/{batch_id}"):
            if at.read(f"_marks/{batch_id}") == mark:
                return "duplicate"
            self.freeze(spark, f"batch {batch_id} changed")
        seen, name = self.seen(spark), f"batch-{batch_id}"
        ids = seen.hashed(batch, "ingest_id")
        n, different = ids.agg(F.count("*"), F.count_distinct("h0", "h1")).first()
        if n != different:
            self.freeze(spark, f"batch {batch_id} holds a row twice")
        if seen.any_of(ids, but=name):
            self.freeze(spark, f"batch {batch_id} repeats rows")
        seen.add(name, ids, n)
        batch.write.mode("overwrite").parquet(at.path(f"batch={batch_id}"))
        at.write(f"_marks/{batch_id}", mark, create_only=True)  # from here on the batch counts
        seen.merge()
        return "committed"

    def freeze(self, spark, why: str) -> None:
        self._folder(spark).claim("_frozen", why)
        raise Frozen(self.frozen(spark))

    def history(self, spark) -> DataFrame:
        return spark.read.parquet(*[f"{self.root}/batch={k}" for k in self.committed(spark)])


def observe(stream: DataFrame, journal: Journal, checkpoint: str):
    """Commit every micro-batch of a stream; late rows are never dropped silently, they fail the receive-time check."""
    return stream.writeStream.foreachBatch(lambda df, k: journal.commit(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame) -> DataFrame:
    """Per instrument: rows, sum and last price, kept in the state store across micro-batches."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        n, total, last_t, last = state.get if state.exists else (0, 0.0, -1, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["price"].sum())
            top = pdf.sort_values(["event_time_ns", "ingest_id"]).iloc[-1]
            if int(top["event_time_ns"]) >= last_t:
                last_t, last = int(top["event_time_ns"]), float(top["price"])
        state.update((n, total, last_t, last))
        yield pd.DataFrame({"instrument_id": [key[0]], "n": [n], "total": [total], "last": [last]})

    out, kept = "instrument_id string, n long, total double, last double", "n long, total double, last_t long, last double"
    return stream.groupBy("instrument_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def resumable_replay(stream: DataFrame, run: Callable, columns: list[str]) -> DataFrame:
    """Replay runs batch by batch; the state between batches is the run's and its strategy's exported state, as JSON.
    run(run_id) makes a fresh Run whose total is unknown (-1). Emits the fills of each batch. A batch of a run that begins
    before the last one ended fails, as it does in a whole replay."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        r = run(str(key[0]))
        if state.exists:
            r.import_state(json.loads(state.get[0]))
        rows = pd.concat(list(batches))[columns].astype(object)
        rows = rows.where(rows.notna(), None).to_dict("records")
        rows.sort(key=lambda e: (e["event_time_ns"], e["sequence"] if e.get("sequence") is not None else NO_SEQUENCE, e["receive_time_ns"], e.get("ingest_id") or ""))
        for e in rows:
            r.feed(e)
        made = [x for x in r.drain() if x["kind"] == "fill"]
        state.update((json.dumps(r.export_state()),))
        names = ["run_id", "event_time_ns", "side", "quantity", "price"]
        yield pd.DataFrame([{n: f[n] if n in ("event_time_ns", "side") else str(f[n]) for n in names} for f in made], columns=names)

    return stream.groupBy("run_id").applyInPandasWithState(step, "run_id string, event_time_ns long, side string, quantity string, price string", "state string", "append", GroupStateTimeout.NoTimeout)


BOOK_OUT = "instrument_id string, ord long, accepted boolean, resync boolean, best_bid double, best_ask double, levels int"


class BookKeeper(StatefulProcessor):
    """One instrument's book between batches: a map entry per level, and what a delta must follow on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.last = handle.getValueState("last", "sequence long, hash string, resync boolean")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802 the interface's name
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        sequence, mark, resync = self.last.get() if self.last.exists() else (None, None, True)
        book = {tuple(k): v[0] for k, v in self.levels.iterator()}
        was, out = dict(book), []
        for e in pd.concat(frames).sort_values("ord").to_dict("records"):
            number = None if pd.isna(e["sequence"]) else int(e["sequence"])
            if e["event_type"] == "book_snapshot":
                book = {(s, float(x["price"])): float(x["size"]) for s, c in (("bid", "bids"), ("ask", "asks")) for x in (e[c] if e[c] is not None else [])}
                sequence, mark, resync, good = number, e["hash"], False, True
            else:
                follows = (sequence is None or number is None or number == sequence + 1) and (e["previous_hash"] is None or mark is None or e["previous_hash"] == mark)
                good = follows and not resync
                for c in (e["changes"] if e["changes"] is not None else []) if good else []:
                    good = c["side"] in ("bid", "ask") and c["size"] is not None and c["size"] >= 0
                    if not good:
                        break
                    if c["size"] == 0:
                        book.pop((c["side"], float(c["price"])), None)
                    else:
                        book[c["side"], float(c["price"])] = float(c["size"])
                if good:
                    sequence, mark = number, e["hash"] if e["hash"] is not None else mark
                else:
                    resync = True
            bids, asks = ([p for s, p in book if s == side] for side in ("bid", "ask"))
            out.append((key[0], e["ord"], good, resync, max(bids, default=None), min(asks, default=None), len(book)))
        for k in was.keys() - book.keys():
            self.levels.removeKey(k)
        for k, v in book.items():
            if was.get(k) != v:
                self.levels.updateValue(k, (v,))
        self.last.update((sequence, mark, resync))
        yield pd.DataFrame(out, columns=["instrument_id", "ord", "accepted", "resync", "best_bid", "best_ask", "levels"]).astype({"best_bid": "float64", "best_ask": "float64", "levels": "int32"})

    def close(self) -> None:
        pass


def running_books(stream: DataFrame) -> DataFrame:
    """book_states() of a stream whose batches come in an instrument's order; needs the RocksDB state store. A task holds the
    levels of one book and the events of a batch, state is written level by level."""
    return stream.groupBy("instrument_id").transformWithStateInPandas(BookKeeper(), BOOK_OUT, "append", "none")
