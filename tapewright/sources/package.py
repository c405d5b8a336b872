"""Run packages: everything a run's result rests on, written once into a folder, and validated from it."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import order_free_digest, ordered_digest
from ..operators.metrics import NAMES
from ..values import canonical_json, fingerprint, round12
from .fs import Folder

#: Documents of a package, in the order in which a reader wants them.
DOCUMENTS = ("experiment_spec.json", "search_space.json", "data_manifest.json", "quality_report.json", "metrics_report.json", "run_report.md", "package.json")


class Blocked(ValueError):
    """A run on data that its quality report blocks has no package."""


def register_search_space(spark, path: str, space: dict) -> str:
    """Write the search space before the run; another one later is refused."""
    at = Folder(spark, path)
    at.make()
    at.write("search_space.json", canonical_json(space), create_only=True)
    return fingerprint(space)


def write_package(runs: DataFrame, events: DataFrame, path: str, spec: dict, space: dict, metrics: dict, quality: list[dict], seed: int | None = None) -> dict:
    """Write fills, refusals and the sampled curve as Parquet and the documents as canonical JSON.

    The search space must be the registered one; quality rows (code, severity, n) with a hit of an error or critical check
    refuse the package. The receipt names every document's fingerprint and those of events and results."""
    if hits := [q["code"] for q in quality if q["severity"] != "warning" and q["n"]]:
        raise Blocked(f"data is blocked by {', '.join(sorted(hits))}")
    if seed is None and "random" in spec.get("family", ""):
        raise ValueError("a random strategy needs its seed in the package")
    spark = runs.sparkSession
    at = Folder(spark, path)
    register_search_space(spark, path, space)
    if at.exists("package.json"):
        raise FileExistsError(path)
    for kind, name in (("fill", "fills"), ("equity", "curve")):
        runs.where(F.col("kind") == kind).write.mode("overwrite").parquet(at.path(name))
    runs.where(~F.col("kind").isin("fill", "equity")).write.mode("overwrite").parquet(at.path("refusals"))
    span = events.agg(F.count("*").alias("n"), F.min("event_time_ns").alias("first"), F.max("event_time_ns").alias("last"), F.array_sort(F.collect_set("instrument_id")).alias("instruments")).first()
    digest = ordered_digest(events, ["event_time_ns", "instrument_id", "event_type", "ingest_id"]).first()
    documents = {
        "experiment_spec.json": spec | {"search_space": fingerprint(space), "seed": seed},
        "data_manifest.json": {"rows": span["n"], "first_ns": span["first"], "last_ns": span["last"], "instruments": span["instruments"], "digest": digest["digest"]},
        "quality_report.json": sorted(quality, key=lambda q: q["code"]),
        "metrics_report.json": {k: round12(v) if isinstance(v, float) else v for k, v in metrics.items()},
    }
    for name, value in documents.items():
        at.write(name, canonical_json(value))
    at.write("run_report.md", run_report(spec, documents["metrics_report.json"], quality))
    results = order_free_digest(runs, sorted(runs.columns)).first()
    receipt = {name: fingerprint(value) for name, value in documents.items()} | {"search_space.json": fingerprint(space), "results": results["digest"], "result_rows": results["n"]}
    receipt["receipt"] = fingerprint(receipt)
    at.write("package.json", canonical_json(receipt))  # last: a package without it is none
    return receipt


def package_problems(spark, path: str) -> list[str]:
    """What of a package is missing, changed or at odds with itself."""
    at = Folder(spark, path)
    if missing := [n for n in DOCUMENTS if not at.exists(n)]:
        return [f"missing {n}" for n in missing]
    receipt = json.loads(at.read("package.json"))
    read = {n: json.loads(at.read(n)) for n in DOCUMENTS if n.endswith(".json") and n != "package.json"}
    out = [n for n, value in read.items() if fingerprint(value) != receipt[n]]
    runs = spark.read.parquet(at.path("fills")).unionByName(spark.read.parquet(at.path("curve"))).unionByName(spark.read.parquet(at.path("refusals")))
    found = order_free_digest(runs, sorted(runs.columns)).first()
    if (found["digest"], found["n"]) != (receipt["results"], receipt["result_rows"]):
        out.append("results")
    if fingerprint({k: v for k, v in receipt.items() if k != "receipt"}) != receipt["receipt"]:
        out.append("package.json")
    if read["experiment_spec.json"]["search_space"] != fingerprint(read["search_space.json"]):
        out.append("search_space is not the registered one")
    if any(q["n"] and q["severity"] != "warning" for q in read["quality_report.json"]):
        out.append("quality blocks")
    return out


def run_report(spec: dict, metrics: dict, quality: list[dict]) -> str:
    """A page of Markdown: what was run, what came out, what the data's checks say."""
    lines = [f"# {spec.get('strategy_id', 'run')}", "", *[f"- {k}: {v}" for k, v in sorted(spec.items())], "", "| metric | value |", "|---|---|"]
    lines += [f"| {n} | {'not defined' if metrics.get(n) is None else metrics[n]} |" for n in NAMES if n in metrics]
    lines += ["", "| check | severity | hits |", "|---|---|---|", *[f"| {q['code']} | {q['severity']} | {q['n']} |" for q in sorted(quality, key=lambda q: q["code"])]]
    return "\n".join(lines) + "\n"


#: The dashboard's views and the columns that each shows of its table.
VIEWS = {
    "overview": ("experiments", "pnl", "trades"), "data": ("source", "n", "first_ns", "last_ns", "instruments"), "quality": ("code", "severity", "n"),
    "runs": ("run_id", "fills", "pnl", "gross_pnl"), "costs": ("run_id", "fees", "spread", "slippage", "impact"), "metrics": ("run_id", *NAMES),
    "robustness": ("variant", "name", "value"), "risk": ("variant", "observed_max", "bootstrap_p95", "risk_of_ruin"), "ledger": ("ledger", "ordinal", "problem"),
}


def dashboard(title: str, tables: dict[str, DataFrame], most: int = 1_000) -> str:
    """A static page with a section per view; a view without a table says so. Tables are results of a row per run, check or
    variant; one of more than ``most`` rows is refused, not cut."""
    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    if unknown := set(tables) - set(VIEWS):
        raise ValueError(f"no such views: {', '.join(sorted(unknown))}")
    for view, columns in VIEWS.items():
        parts.append(f"<section id='{view}'><h2>{view}</h2>")
        if view not in tables:
            parts.append("<p>nothing recorded</p></section>")
            continue
        shown = [c for c in columns if c in tables[view].columns]
        rows = tables[view].select(*shown).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{view}: a page shows {most} rows at most")
        cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
        parts.append("<table>" + cells(shown, "th") + "".join(cells(r, "td") for r in sorted(rows, key=repr)) + "</table></section>")
    return "\n".join(parts)
