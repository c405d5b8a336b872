"""Fill and cost models as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear_costs(price: Column, quantity: Column, mid: Column | None, buy: Column, fee_rate: Column | float = 0.001, impact_bps: float = 0.0) -> dict[str, Column]:
    """fee, spread (paid against the mid, never negative), slippage and impact of a fill."""
    notional = F.abs(price * quantity)
    side = F.when(buy, 1.0).otherwise(-1.0)
    spread = F.greatest(F.lit(0.0), side * (price - mid) * quantity) if mid is not None else F.lit(0.0)
    fee = fee_rate if isinstance(fee_rate, Column) else F.lit(fee_rate)
    return {"fee": notional * fee, "spread": F.coalesce(spread, F.lit(0.0)), "slippage": F.lit(0.0), "impact": notional * impact_bps / 10_000}


def depth_walk(levels: DataFrame, quantity: float, book: str = "book_id", ties: tuple[str, ...] = (), participation: float = 1.0, ascending: bool = True) -> DataFrame:
    """Fills of a market order that takes a ladder's levels from the best one on: per level min(size * participation, what
    the levels before have left). A running sum per book; books are independent."""
    order = [F.col("price") if ascending else F.col("price").desc(), *[F.col(t) for t in ties]]
    before = W.partitionBy(book).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    avail = F.col("size") * participation
    l = levels.withColumn("fill", F.greatest(F.lit(0.0), F.least(avail, F.lit(quantity) - F.coalesce(F.sum(avail).over(before), F.lit(0.0)))))
    return l.where("fill > 0")


def walk_summary(fills: DataFrame, quantity: float, book: str = "book_id") -> DataFrame:
    left = F.lit(quantity) - F.sum("fill")
    out = fills.groupBy(book).agg(F.sum("fill").alias("filled"), left.alias("remaining"), (F.sum(F.col("fill") * F.col("price")) / F.sum("fill")).alias("vwap"), F.count("*").alias("levels"))
    return out.withColumn("status", F.when(F.col("remaining") <= 1e-9, "filled").otherwise("partial_rejected"))


def first_evidence(intents: DataFrame, evidence: DataFrame, key: str, latency_ns: int = 0) -> DataFrame:
    """The first evidence of the same key strictly after each decision plus latency (null without any).

    intents: key, intent_id, decision_ns; evidence: key, receive_ns, evidence_id, price."""
    e = evidence.select(key, "receive_ns", "evidence_id", "price")
    j = intents.join(e, key, "left")
    late = F.col("receive_ns") > F.col("decision_ns") + latency_ns
    first = F.min(F.when(late, F.struct("receive_ns", "evidence_id", "price")))
    out = j.groupBy(key, "intent_id", "decision_ns").agg(first.alias("f"))
    return out.select(key, "intent_id", "decision_ns", F.col("f.receive_ns").alias("receive_ns"), F.col("f.evidence_id").alias("evidence_id"), F.col("f.price").alias("price"), (F.col("f.receive_ns") - F.col("decision_ns")).alias("latency_ns"))


def next_bar_fill(bars: DataFrame, quantity: float, slippage_bps: float = 5.0, participation: float = 0.1, fee_rate: float = 0.001, buy: bool = True) -> DataFrame:
    """A non-competing order decided at each bar and filled at the next one's open, worsened by slippage, up to a share of
    that bar's volume."""
    w = W.partitionBy("instrument_id").orderBy("event_time_ns")
    b = bars.select("instrument_id", "event_time_ns", F.lead("open").over(w).alias("next_open"), F.lead("volume").over(w).alias("next_volume"))
    side = 1.0 if buy else -1.0
    price = F.col("next_open") * (1 + side * slippage_bps / 10_000)
    filled = F.coalesce(F.least(F.lit(quantity), F.col("next_volume") * participation), F.lit(0.0))
    reason = F.when(F.col("next_open").isNull(), "no subsequent fill evidence").when(F.col("next_volume").isNull(), "bar volume is missing").when(F.col("next_volume") == 0, "bar volume is zero").when(filled < quantity, "bar participation cap").otherwise("")
    return b.select("instrument_id", "event_time_ns", price.alias("price"), filled.alias("filled"), (F.lit(quantity) - filled).alias("remaining"), (F.abs(price - F.col("next_open")) * filled).alias("slippage"), (price * filled * fee_rate).alias("fee"), reason.alias("reason"))


def limit_fill(levels: DataFrame, limits: DataFrame, quantity: float, queue: float = 0.5, adverse: float = 0.75, participation: float = 1.0, book: str = "book_id") -> DataFrame:
    """A buy limit order per book against the levels at its limit or better: the sum of their sizes, cut by the share taken,
    the queue ahead and adverse selection, at the limit price. limits: book, limit_price."""
    avail = F.sum(F.when(F.col("price") <= F.col("limit_price"), F.col("size")))
    j = levels.join(limits, book).groupBy(book, "limit_price").agg(F.coalesce(avail, F.lit(0.0)).alias("available"))
    filled = F.least(F.lit(quantity), F.col("available") * (participation * queue * adverse))
    status = F.when(F.col("available") <= 0, "no evidence").when(filled >= quantity, "filled").otherwise("partial")
    return j.select(book, F.col("limit_price").alias("price"), "available", filled.alias("filled"), (F.lit(quantity) - filled).alias("remaining"), status.alias("status"))


def midpoint_fill(books: DataFrame, quantity: float, fee_rate: float = 0.001) -> DataFrame:
    """Whole quantity at the mid of uncrossed books; never evidence for promotion."""
    bid, ask = F.array_max("bids"), F.array_min("asks")
    b = books.where((bid > 0) & (ask > bid)).withColumn("price", (bid + ask) / 2)
    return b.select("instrument_id", "event_time_ns", "price", F.lit(quantity).alias("filled"), (F.col("price") * quantity * fee_rate).alias("fee"), F.lit(False).alias("promotable"))


#: What a run's costs are made of.
COMPONENTS = ("fees", "spread", "slippage", "impact", "funding", "borrow", "roll", "rejects_or_missed_fills")


def component_totals(rows: DataFrame) -> DataFrame:
    """(component, total) of all eight components over rows that have some of them; the others are 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(c) if c in rows.columns else F.lit(0.0).alias(c) for c in COMPONENTS]
    return rows.agg(*sums).unpivot([], list(COMPONENTS), "component", "total")
