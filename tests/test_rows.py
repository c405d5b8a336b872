"""Canonical rows and their hash trees, and gates as decision tables."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapewright import values
from tapewright.operators import gates, rowprint

TEXTS = [None, "", "plain", 'quo"te\\', "tab\t\n\r\f\b\x01\x7f", "é ñ 日本 🤷🏽  ", "\x00", "a/b"]
DECIMALS = ["0", "0.000000000000000001", "-0.0000001", "12345678901234567890.5", "-1", "1.10"]
SCHEMA = "id int, t string, b boolean, d decimal(38,18), n long, a array<string>, m map<string,int>, z struct<y:string,x:decimal(5,2)>"


def test_fingerprints_are_those_of_plain_values(spark):
    rng, rows = random.Random(1), []
    for k in range(200):
        pair = (rng.choice(TEXTS), Decimal("2.5")) if rng.random() < 0.8 else None
        rows.append((k, rng.choice(TEXTS), rng.choice([None, True, False]), Decimal(rng.choice(DECIMALS)), rng.choice([None, -5, 2**63 - 1]), rng.choice([None, [], ["x", None, "é"]]), rng.choice([None, {}, {"b": 1, "a": None, "é": 3}]), pair))
    df = spark.createDataFrame(rows, SCHEMA)
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            for r in rowprint.fingerprints(df).withColumn("_json", rowprint.canonical_row(df)).collect():
                plain = r.asDict(recursive=True)
                mark, text = plain.pop("fingerprint"), plain.pop("_json")
                assert text == values.canonical_json(plain) and mark == values.fingerprint(plain)
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("kind", ["double", "timestamp", "binary", "array<float>"])
def test_what_has_no_canonical_form(spark, kind):
    with pytest.raises(TypeError, match="canonical"):
        rowprint.canonical_row(spark.createDataFrame([], f"x {kind}"))


def test_changed_rows_by_their_branch(spark, monkeypatch):
    monkeypatch.setattr(rowprint, "LEAF", 4)
    before = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    more = spark.createDataFrame([(-1, "x"), (5, "v5"), (None, "n")], "id long, v string")
    after = before.where("id % 1000 <> 7").withColumn("v", F.when(F.col("id") % 900 == 1, "new").otherwise(F.col("v"))).unionByName(more)
    got = {r.id: r.change for r in rowprint.changed_rows(before, after, ["id"]).collect()}
    assert got == {-1: "added", None: "added", 5: "changed"} | {k: "changed" for k in (1, 901, 1801, 2701)} | {k: "removed" for k in (7, 1007, 2007)}
    assert rowprint.changed_rows(before, before.repartition(5), ["id"]).collect() == []
    assert rowprint.depth_for(3000) == 3 and rowprint.depth_for(4) == 0
    roots = [rowprint.hash_tree(x, ["id"], 2).where("prefix = ''").first().digest for x in (before, before.repartition(7), after)]
    assert roots[0] == roots[1] != roots[2]


FACTS = dict(verdict="paper_candidate", paper_plan_status="paper_ready", divergence_status="risk_review_candidate", blocking_breaches="0", observed_days="30", minimum_days="30", signals="12", minimum_signals="10", risk_verdict="pass", approval_status="packaged", approval_config_hash="h", config_after_hash="h", open_blockers="")


def decided(spark, **packages):
    facts = [(p, k, v) for p, f in packages.items() for k, v in f.items()]
    out = {}
    for r in gates.decisions(spark.createDataFrame(facts, "package_id string, fact string, value string"), gates.standard_rules(spark)).collect():
        out.setdefault(r.package_id, {})[r.gate] = (r.status, r.reasons)
    return out


def test_gates_follow_each_other(spark):
    got = decided(spark, good=FACTS, few=FACTS | {"signals": "9"}, unknown={k: v for k, v in FACTS.items() if k != "minimum_days"}, null=FACTS | {"risk_verdict": None}, text=FACTS | {"observed_days": "many"}, kill=FACTS | {"verdict": "kill"})
    assert [got["good"][g][0] for g in ("research_gate", "paper_gate", "risk_review", "live_gate")] == ["pass", "pass", "pass", "block"]
    assert got["good"]["live_gate"][1] == ["locked"]
    assert got["few"]["paper_gate"] == ("block", ["fewer signals than planned"]) and got["few"]["risk_review"] == ("block", ["no passed paper_gate"])
    assert got["unknown"]["paper_gate"] == ("unknown", ["observed for fewer days than planned?"]) and got["unknown"]["risk_review"] == ("unknown", ["no passed paper_gate?"])
    assert got["null"]["paper_gate"][0] == "pass" and got["null"]["risk_review"][0] == "unknown"
    assert got["text"]["paper_gate"][0] == "unknown" and got["kill"]["research_gate"][0] == "block" and got["kill"]["paper_gate"][0] == "block"
    assert all(g["live_gate"][0] == "block" for g in got.values())


def test_gates_refuse_unknown_comparisons(spark):
    rules = spark.createDataFrame([("g", 1, None, "r", "f", "around", "1", "why")], gates.RULES)
    with pytest.raises(ValueError, match="around"):
        gates.decisions(spark.createDataFrame([("p", "f", "1")], "package_id string, fact string, value string"), rules)


def test_scratch_tables_go(spark):
    import os

    from tapewright import tables

    made = []

    def kept(df, name):
        made.append(tables.saved(df, name))
        return made[-1]

    @tables.scratch
    def inner(fail):
        kept(spark.range(3), "inner-part")
        if fail:
            raise ValueError("no")
        return spark.range(5)

    @tables.scratch
    def outer():
        kept(spark.range(2), "outer-part")
        return inner(False).where("id > 1")

    files = lambda df: [f.removeprefix("file://") for f in df.inputFiles()]
    with pytest.raises(ValueError, match="no"):
        inner(True)
    assert tables._OPEN == []
    out = outer()
    assert out.count() == 3 and all(os.path.exists(f) for f in files(out))
    for df in made:
        with pytest.raises(Exception):
            df.count()
