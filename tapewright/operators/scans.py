"""Running values over keys of any size: rows are dealt by time, and each deal goes on from one row per deal before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000


@dataclass(frozen=True)
class Kind:
    """A value over a frame, over a whole deal, over deals, and the last two together."""

    frame: Callable[[Column], Column]
    deal: Callable[[Column, Column], Column]
    deals: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def _either(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.coalesce(f(a, b), a, b)


_SUM = Kind(F.sum, lambda v, _: F.sum(v), F.sum, _either(lambda a, b: a + b))
_LAST = Kind(lambda v: F.last(v, ignorenulls=True), lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a))
KINDS = {
    "sum": _SUM,
    "max": Kind(F.max, lambda v, _: F.max(v), F.max, lambda a, b: F.greatest(a, b)),
    "min": Kind(F.min, lambda v, _: F.min(v), F.min, lambda a, b: F.least(a, b)),
    "last": _LAST,
}


def scan(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], width: int = HOUR_NS, ties: bool = False) -> DataFrame:
    """Adds columns: for each ``name: (kind, value)`` the sum, greatest, least or last value that is not null over the key's rows
    up to this one in ``order`` (with ``ties``, and rows equal in it). Kinds that end in ``_before`` leave the row itself out.

    A window over a key alone puts a hot key into one task. Deals of ``width`` units of the first column of ``order`` (a whole
    number) are windowed apart instead; what comes before a deal follows from one row per key and deal. ``rows`` is read twice:
    cut its lineage first where it is dear. Columns of ``order`` hold no nulls; keys may be null.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)  # structs of nulls are equal, and joins find them where windows left them
    dealt = rows.withColumns({"_key": key, "_deal": F.expr(f"{order[0]} div {width}")})
    inside = W.partitionBy("_key", "_deal").orderBy(*order)
    frames = {False: inside if ties else inside.rowsBetween(W.unboundedPreceding, 0), True: inside.rowsBetween(W.unboundedPreceding, -1)}
    kind = {name: KINDS[k.removesuffix("_before")] for name, (k, _) in values.items()}
    within = dealt.select("*", *[kind[n].frame(v).over(frames[k.endswith("_before")]).alias(f"_in_{n}") for n, (k, v) in values.items()])
    sums = dealt.groupBy("_key", "_deal").agg(*[kind[n].deal(v, F.struct(*order)).alias(f"_of_{n}") for n, (_, v) in values.items()])
    earlier = W.partitionBy("_key").orderBy("_deal").rowsBetween(W.unboundedPreceding, -1)  # one row per key and deal
    carry = sums.select("_key", "_deal", *[kind[n].deals(F.col(f"_of_{n}")).over(earlier).alias(f"_up_{n}") for n in values])
    out = within.join(carry, ["_key", "_deal"])
    return out.select(*rows.columns, *[kind[n].both(F.col(f"_up_{n}"), F.col(f"_in_{n}")).alias(n) for n in values])


#: Rows that fold() puts together at a time.
FAN = 1_024


def fold(rows: DataFrame, keys: list[str], place: str, count: int, lift: Callable[[str], Column], merge: Callable[[Column, Column], Column], fan: int = FAN) -> DataFrame:
    """(keys, state): the states of a key's rows merged in the order of ``place``, which are whole numbers from 0 and below ``count``.

    ``lift`` makes a row's state, ``merge`` puts two neighbours together and is associative. ``fan`` places are merged in a
    group, then as many of these, until one is left: no group grows with the key."""
    now = rows.select(*keys, F.col(place).cast("long").alias("_p"), lift(place).alias("state"))
    while True:
        now = now.groupBy(*keys, F.expr(f"_p div {fan}").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("_p", "state"))).alias("_all"))
        now = now.select(*keys, "_p", F.aggregate(F.slice("_all", 2, fan), F.col("_all")[0]["state"], lambda s, x: merge(s, x["state"])).alias("state"))
        count = -(-count // fan)
        if count <= 1:
            return now.select(*keys, "state")
