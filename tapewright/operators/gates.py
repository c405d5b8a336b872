"""Gates as decision tables: rules are rows, facts are rows, and what isn't known is neither a pass nor a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comparisons that a rule can make; numbers are compared as decimals, the rest as text.
OPS = ("eq", "ne", "ge", "le", "gt", "lt", "is_empty", "same_as", "at_least_fact", "never")
RULES = "gate string, ordinal int, needs string, rule string, fact string, op string, value string, reason string"
#: The gates in their order, and what each asks of a package. ``needs`` is the gate that must have passed.
STANDARD = [
    ("research_gate", 1, None, "verdict", "verdict", "eq", "paper_candidate", "no candidate for paper trading"),
    ("paper_gate", 2, "research_gate", "plan", "paper_plan_status", "eq", "paper_ready", "the plan is not ready"),
    ("paper_gate", 2, "research_gate", "divergence", "divergence_status", "eq", "risk_review_candidate", "divergence does not ask for a risk review"),
    ("paper_gate", 2, "research_gate", "breaches", "blocking_breaches", "le", "0", "a breach blocks promotion"),
    ("paper_gate", 2, "research_gate", "window", "observed_days", "at_least_fact", "minimum_days", "observed for fewer days than planned"),
    ("paper_gate", 2, "research_gate", "signals", "signals", "at_least_fact", "minimum_signals", "fewer signals than planned"),
    ("risk_review", 3, "paper_gate", "report", "risk_verdict", "eq", "pass", "the risk report does not pass"),
    ("risk_review", 3, "paper_gate", "pack", "approval_status", "eq", "packaged", "the approval pack is incomplete"),
    ("risk_review", 3, "paper_gate", "config", "approval_config_hash", "same_as", "config_after_hash", "approved for another configuration"),
    ("risk_review", 3, "paper_gate", "blockers", "open_blockers", "is_empty", None, "open blockers"),
    ("live_gate", 4, "risk_review", "locked", "verdict", "never", None, "locked"),
]


def standard_rules(spark) -> DataFrame:
    return spark.createDataFrame(STANDARD, RULES)


def decisions(facts: DataFrame, rules: DataFrame, key: str = "package_id") -> DataFrame:
    """(key, gate, status, reasons) of every package and gate: pass, block or unknown.

    facts: key, fact, value (text; a fact that is null or absent is unknown; of several the greatest counts). rules: a decision
    table as RULES, control data of a few dozen rows, which is broadcast. A gate blocks if a rule fails, is unknown if none fails
    but one can't be told, and passes else; it also needs the gate named in ``needs``: blocked or unknown there is blocked or
    unknown here. Reasons are those of the rules that fail, then of those unknown (with a question mark), each in text order.
    """
    known = rules.select("op").distinct().collect()
    if unknown := {r.op for r in known} - set(OPS):
        raise ValueError(f"no such comparisons: {', '.join(sorted(map(str, unknown)))}")
    held = facts.groupBy(key, "fact").agg(F.max("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("fact", "value"))).alias("facts"))
    asked = held.crossJoin(F.broadcast(rules))  # a decision table
    have, other = F.try_element_at("facts", F.col("fact")), F.try_element_at("facts", F.col("value"))
    number = lambda c: F.expr(f"try_cast({c} AS DECIMAL(38,12))")
    asked = asked.withColumns({"_have": have, "_other": other})
    a, b, c = number("_have"), number("value"), number("_other")
    said = {
        "eq": F.col("_have") == F.col("value"), "ne": F.col("_have") != F.col("value"), "ge": a >= b, "le": a <= b, "gt": a > b, "lt": a < b,
        "is_empty": F.col("_have") == "", "same_as": F.col("_have") == F.col("_other"), "at_least_fact": a >= c, "never": F.lit(False),
    }
    holds = F.lit(None).cast("boolean")
    for op, column in said.items():
        holds = F.when(F.col("op") == op, column).otherwise(holds)
    asked = asked.withColumn("_holds", holds)
    failed = F.array_sort(F.collect_set(F.when(~F.col("_holds"), F.col("reason"))))
    untold = F.array_sort(F.collect_set(F.when(F.col("_holds").isNull(), F.concat("reason", F.lit("?")))))
    own = asked.groupBy(key, "ordinal", "gate").agg(F.max("needs").alias("needs"), failed.alias("failed"), untold.alias("untold"))
    rows = own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "gate", "needs", "failed", "untold"))).alias("rows"))
    out = "array<struct<gate:string,status:string,reasons:array<string>>>"

    def decide(done, r):
        before = F.get(F.filter(done, lambda x: x["gate"] == r["needs"]), F.lit(0))["status"]
        lacks = F.when(r["needs"].isNotNull() & F.coalesce(before == "block", F.lit(True)), F.array(F.concat(F.lit("no passed "), r["needs"]))).otherwise(F.array().cast("array<string>"))
        doubts = F.when(before == "unknown", F.array(F.concat(F.lit("no passed "), r["needs"], F.lit("?")))).otherwise(F.array().cast("array<string>"))
        failed, untold = F.concat(lacks, r["failed"]), F.concat(doubts, r["untold"])
        status = F.when(F.size(failed) > 0, "block").when(F.size(untold) > 0, "unknown").otherwise("pass")
        return F.concat(done, F.array(F.struct(r["gate"].alias("gate"), status.alias("status"), F.concat(failed, untold).alias("reasons"))))

    told = rows.select(key, F.explode(F.aggregate("rows", F.array().cast(out), decide)).alias("x"))
    return told.select(key, "x.gate", "x.status", "x.reasons")
