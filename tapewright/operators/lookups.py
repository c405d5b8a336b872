"""Join-shaped operators: cross-checks, lookups, containment, diffs, existence, deduplication and cover checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DAY_NS, ROW_KEY, canonical_order
from .scans import scan

#: Allowed intervals that are broadcast at most (16 bytes each).
BROADCAST_INTERVALS = 10_000


def cross_check_bps(primary: DataFrame, reference: DataFrame, on: list[str], limit_bps: float = 10.0) -> DataFrame:
    """Matched closes and the largest distance in basis points; the reference's last duplicate (by ord) counts."""
    ref = reference.groupBy(*on).agg(F.max_by("close", "ord").alias("ref_close"))
    bps = F.abs(F.col("close") / F.col("ref_close") - 1) * 10_000
    out = primary.join(ref, on).agg(F.count("*").alias("matches"), F.coalesce(F.max(bps), F.lit(0.0)).alias("max_bps"))
    return out.withColumn("status", F.when((F.col("matches") > 0) & (F.col("max_bps") <= limit_bps), "pass").otherwise("warning"))


def book_cross_check(events: DataFrame, reference_hash: str, best_asks: tuple[float, float] | None) -> DataFrame:
    """Whether the last book of a feed has the reference's hash and the complementary asks cost at least the payoff."""
    last = events.agg(F.max_by("hash", F.struct("event_time_ns", "sequence")).alias("hash"))
    enough = F.lit(best_asks is None or sum(best_asks) >= 1)
    return last.select(F.coalesce(F.col("hash") == reference_hash, F.lit(False)).alias("hash_match")).withColumn("status", F.when(F.col("hash_match") & enough, "pass").otherwise("warning"))


def futures_cross_check(events: DataFrame) -> DataFrame:
    """Executions on back-adjusted prices fail; how many concrete contracts there are."""
    bad = F.bool_or((F.col("event_type") == "trade") & F.coalesce("back_adjusted", F.lit(False)))
    return events.agg(F.countDistinct("instrument_id").alias("contracts"), F.when(bad, "fail").otherwise("pass").alias("status"))


def registry_disagreements(registry: DataFrame, notes: DataFrame, fields: list[str]) -> DataFrame:
    """Ids that only one side has, and fields on which the two differ (null-safe)."""
    r = registry.select("id", *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("in_registry"))
    n = notes.select("id", *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("in_notes"))
    j = r.join(n, "id", "full_outer")
    differ = [F.when(~F.col(f"r_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(f)) for f in fields]
    why = F.when(F.col("in_registry").isNull(), F.array(F.lit("unregistered"))).when(F.col("in_notes").isNull(), F.array(F.lit("no note"))).otherwise(F.array_compact(F.array(*differ)))
    return j.select("id", F.explode(why).alias("problem"))


def evidence_scope(classification, status):
    """Scope of a source from its classification's words; only full text can support a claim by itself."""
    words = F.lower(F.concat_ws(" ", classification, status))
    return F.when(words.contains("full") & words.contains("text"), "full_text").when(words.contains("abstract"), "abstract").when(words.contains("metadata"), "metadata").otherwise("other")


def multiplier_notional(fills: DataFrame, instruments: DataFrame, key: str) -> DataFrame:
    """price * quantity * multiplier. Without any instrument the multiplier is 1; a dimension that has rows must cover every
    fill, which fails where it does not. The dimension joins as its size allows."""
    if instruments.isEmpty():
        return fills.withColumn("multiplier", F.lit(1.0)).withColumn("notional", F.col("price") * F.col("quantity"))
    unknown = F.raise_error(F.concat(F.lit("no multiplier for "), F.col(key).cast("string"))).cast("double")
    j = fills.join(instruments.select(key, "multiplier"), key, "left")
    return j.withColumn("notional", F.col("price") * F.col("quantity") * F.coalesce("multiplier", unknown))


def contained_in(intervals: DataFrame, allowed: DataFrame) -> DataFrame:
    """Intervals (start_ns, end_ns) that lie inside an allowed one.

    An interval lies inside some allowed one if it does in that which, of those that begin no later, ends last. Up to
    BROADCAST_INTERVALS allowed ones are joined as they are; of more, the running latest end is looked up by a union in the
    order of starts, dealt by time and stitched by a row per deal."""
    a = allowed.select(F.col("start_ns").alias("_s"), F.col("end_ns").alias("_e"))
    if a.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS:
        return intervals.join(F.broadcast(a), (F.col("start_ns") >= F.col("_s")) & (F.col("end_ns") <= F.col("_e")), "left_semi")
    names = intervals.columns
    rows = intervals.select(F.col("start_ns").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_e"), F.struct(*names).alias("_row"))
    both = rows.unionByName(a.select(F.col("_s").alias("_at"), F.lit(0).alias("_kind"), F.col("_e").cast("long").alias("_e"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    both = both.withColumn("_deal", F.expr(f"_at div {DAY_NS}"))
    inside = W.partitionBy("_deal").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    ends = both.groupBy("_deal").agg(F.max("_e").alias("_last"))
    before = ends.select(F.col("_deal").alias("_d"), F.max("_last").over(W.orderBy("_deal").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))  # a row per day
    j = both.withColumn("_run", F.max("_e").over(inside)).join(before, F.col("_deal") == F.col("_d"))
    return j.where((F.col("_kind") == 1) & (F.col("_row.end_ns") <= F.greatest("_run", "_before"))).select("_row.*")


def key_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value changed, appeared or went."""
    b, a = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    return b.join(a, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def missing_from(subset: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that break "subset is part of whole"; none if it holds."""
    return subset.join(whole, keys, "left_anti")


def dedup_rows(rows: DataFrame, compared: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per identity (with ingest_id), and the identities that occur with different contents, which block."""
    h = rows.withColumn("_h", F.sha2(F.to_json(F.struct(*compared)), 256))
    groups = h.groupBy(*ROW_KEY).agg(F.countDistinct("_h").alias("variants"), F.count("*").alias("copies"), F.min(F.struct(*compared)).alias("row"))
    kept = groups.select(*ROW_KEY, *[F.col(f"row.{c}").alias(c) for c in compared if c not in ROW_KEY], "copies")
    return kept, groups.where("variants > 1").select(*ROW_KEY, "variants")


def chunk_plan(spark, start_ns: int, end_ns: int, chunk_ns: int) -> DataFrame:
    """Half-open chunks that cover [start, end); the last may be shorter."""
    n = -(-(end_ns - start_ns) // chunk_ns)
    begin = F.lit(start_ns) + F.col("id") * chunk_ns
    return spark.range(n).select(F.format_string("chunk-%06d", F.col("id")).alias("chunk_id"), begin.alias("start_ns"), F.least(begin + chunk_ns, F.lit(end_ns)).alias("end_ns"))


def cover_problems(chunks: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Chunks that do not begin where the one before ends, or that miss the interval's ends. A plan is control data."""
    w = W.orderBy("start_ns")
    c = chunks.select("chunk_id", "start_ns", "end_ns", F.lag("end_ns").over(w).alias("prev"), F.lead("start_ns").over(w).alias("next"))
    first, last = F.col("prev").isNull() & (F.col("start_ns") != start_ns), F.col("next").isNull() & (F.col("end_ns") != end_ns)
    return c.where((F.col("start_ns") != F.col("prev")) | first | last | (F.col("start_ns") >= F.col("end_ns"))).select("chunk_id", "start_ns", "end_ns")


def chunk_receipts(chunks: DataFrame, receipts: DataFrame) -> DataFrame:
    """Chunks and receipts one to one; anything else is a row with its reason."""
    j = chunks.join(receipts.withColumnRenamed("rows", "receipt_rows"), "chunk_id", "full_outer")
    why = F.when(F.col("start_ns").isNull(), "unplanned").when(F.col("receipt_rows").isNull(), "missing").when(F.col("receipt_rows") != F.col("rows"), "different")
    return j.withColumn("problem", why).where("problem IS NOT NULL").select("chunk_id", "problem")


def coverage(events: DataFrame) -> DataFrame:
    """Rows, time range and instruments, per source."""
    return events.groupBy("source").agg(F.count("*").alias("n"), F.min("event_time_ns").alias("first_ns"), F.max("event_time_ns").alias("last_ns"), F.countDistinct("instrument_id").alias("instruments"))


def _part_of_hash(h):
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")


def order_free_digests(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, digest): a fingerprint of each set of rows that does not depend on their order: sums of row hashes."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    return rows.select(*keys, h.alias("_h")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(_part_of_hash("_h")).cast("string").alias("digest"))


def order_free_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """order_free_digests() of all rows: one row."""
    return order_free_digests(rows, [], columns)


def ordered_digest(rows: DataFrame, columns: list[str], deal_ns: int = DAY_NS) -> DataFrame:
    """A fingerprint of rows in canonical order: every row is hashed with its number.

    Rows are numbered inside deals of time, behind the count of the deals before: a row per deal. The sum of the hashes
    is one aggregate, so no task sees the whole text."""
    r = rows.withColumn("_deal", F.expr(f"event_time_ns div {deal_ns}"))
    sizes = r.groupBy("_deal").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.orderBy("_deal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per deal
    offsets = sizes.select(F.col("_deal").alias("_d"), before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_deal").orderBy(*canonical_order("arrival_ord" in rows.columns)))
    r = r.withColumn("_in", inside).join(offsets, F.col("_deal") == F.col("_d")).withColumn("_no", F.col("_before") + F.col("_in"))
    h = F.sha2(F.concat(F.col("_no").cast("string"), F.lit("|"), F.to_json(F.struct(*columns))), 256)
    return r.select(h.alias("_h")).agg(F.count("*").alias("n"), F.sum(_part_of_hash("_h")).cast("string").alias("digest"))


def cumulative_costs(curve: DataFrame, costs: DataFrame, keys: list[str], totals: DataFrame | None = None) -> DataFrame:
    """Costs up to and including each row's time: union and running sum, a hot key dealt by time.

    A cost without a time is an error. So is a key whose dated costs are not all it paid, if ``totals`` (keys, total) says what
    that was: a gross curve can't be rebuilt then."""
    if totals is not None:
        dated = costs.groupBy(*keys).agg(F.sum("amount").alias("dated"))
        j = totals.join(dated, keys, "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("total", "dated")})
        if lost := j.where("abs(total - dated) > 1e-9 * greatest(1, abs(total))").first():
            raise ValueError(f"costs of {[lost[k] for k in keys]} are not all dated: {lost['dated']} of {lost['total']}")
    time = F.when(F.col("event_time_ns").isNull(), F.raise_error(F.lit("a cost without a time")).cast("long")).otherwise(F.col("event_time_ns"))
    costs = costs.select(*keys, time.alias("event_time_ns"), "amount")
    c = curve.select(*keys, "event_time_ns", F.lit(0.0).alias("amount"), F.lit(True).alias("is_row"), "equity")
    k = costs.select(*keys, "event_time_ns", "amount", F.lit(False).alias("is_row"), F.lit(None).cast("double").alias("equity"))
    u = scan(c.unionByName(k), keys, ["event_time_ns"], {"costs": ("sum", F.col("amount"))}, DAY_NS, ties=True).where("is_row")
    return u.select(*keys, "event_time_ns", "equity", "costs", (F.col("equity") + F.col("costs")).alias("gross_equity"))


def ledger_problems(ledger: DataFrame) -> DataFrame:
    """Entries that do not name the entry before them, or whose hash is not that of their text, per ledger."""
    w = W.partitionBy("ledger").orderBy("ordinal")
    l = ledger.withColumns({"_prev": F.lag("entry_hash").over(w), "_rn": F.row_number().over(w)})
    link = ~F.col("previous_hash").eqNullSafe(F.col("_prev"))
    text = F.sha2(F.col("text").cast("binary"), 256) != F.col("entry_hash")
    return l.where(link | text).select("ledger", "ordinal", F.when(text, "hash").otherwise("link").alias("problem"))


def nearest_low(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value): the value at index floor(share * (n - 1)) of each key's values in order.

    Values are counted first, where they lie: a key's rows meet as one row per different value, and only these are put in
    order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    w = W.partitionBy(*keys)
    upto = F.sum("_k").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    at = counts.select(*keys, value, "_k", upto.alias("_upto"), F.sum("_k").over(w).alias("_n"))
    index = F.floor(share * (F.col("_n") - 1))
    return at.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_k") <= index)).select(*keys, value)
