"""Ids seen so far, as generations of hashed ids: each in parts by a hash prefix, with a Bloom filter a part."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fs import Folder

#: Generations of a level that are merged to one of the next.
MERGE = 4
#: Ids of a part, about; bits of its filter for each of them, and places that an id sets.
PART, BITS, PLACES = 100_000, 24, 8
#: Prefixes of a batch up to which the filters are read by prefix.
LISTED = 1_000


def _places(h0: np.ndarray, h1: np.ndarray, size: int) -> np.ndarray:
    """Bits of ids in a filter of ``size`` bits: PLACES by double hashing."""
    with np.errstate(over="ignore"):
        return (h0.astype(np.uint64)[:, None] + (h1.astype(np.uint64) | np.uint64(1))[:, None] * np.arange(PLACES, dtype=np.uint64)) % np.uint64(size)


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(table.column(c).combine_chunks()).view(np.uint64) for c in ("h0", "h1"))


def _filter(table: pa.Table) -> pa.Table:
    """The Bloom filter of one part: about PART ids."""
    bits = np.zeros(8 * -(-max(64, BITS * table.num_rows) // 8), bool)
    bits[_places(*_hashes(table), len(bits)).ravel().astype(np.int64)] = True
    return pa.table({"p": table.column("p").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _hits(ids: pa.Table, filters: pa.Table) -> pa.Table:
    """The ids of a part that its filter does not rule out."""
    if not ids.num_rows or not filters.num_rows:
        return ids.slice(0, 0)
    bits = np.unpackbits(np.frombuffer(filters.column("bits")[0].as_py(), np.uint8)).astype(bool)
    return ids.filter(pa.array(bits[_places(*_hashes(ids), len(bits)).astype(np.int64)].all(axis=1)))


class Seen:
    """The index below a folder. A generation is a folder that a small file names; one that replaces others counts instead of
    them from the moment its file is there, so a merge that fails half way changes nothing.

    Generations are merged MERGE at a time, so there are about MERGE of them per power of MERGE of the batches; a lookup reads
    the filters of the prefixes that it asks for, and only parts whose filter does not rule the batch out."""

    def __init__(self, spark, root: str):
        self.spark, self.at = spark, Folder(spark, root)
        #: Parts that the last lookup opened.
        self.opened: list[str] = []

    def generations(self) -> dict[str, dict]:
        """Those that count, by name."""
        found = {n.removesuffix(".json"): json.loads(self.at.read(f"generations/{n}")) for n in self.at.names("generations") if n.endswith(".json") and not n.startswith(".")}
        gone = {r for g in found.values() for r in g["replaces"]}
        return {n: g for n, g in found.items() if n not in gone}

    @staticmethod
    def hashed(ids: DataFrame, column: str) -> DataFrame:
        return ids.select(F.xxhash64(column).alias("h0"), F.xxhash64(F.lit(1), F.col(column)).alias("h1"))

    def _write(self, name: str, ids: DataFrame, n: int, level: int, replaces: list[str]) -> None:
        depth = max(0, (max(n, 1) - 1) // PART).bit_length()  # 2^depth parts
        parts = ids.withColumn("p", F.shiftrightunsigned("h0", 64 - depth) if depth else F.lit(0).cast("long"))
        parts.repartition("p").write.mode("overwrite").partitionBy("p").parquet(self.at.path(f"{name}/ids"))
        back = self.spark.read.schema("h0 long, h1 long, p long").parquet(self.at.path(f"{name}/ids"))
        filters = back.groupBy("p").applyInArrow(_filter, "p long, bits binary")
        filters.repartitionByRange("p").sortWithinPartitions("p").write.mode("overwrite").parquet(self.at.path(f"{name}/filters"))
        self.at.write(f"generations/{name}.json", json.dumps({"depth": depth, "level": level, "n": n, "replaces": replaces}))

    def add(self, name: str, ids: DataFrame, n: int) -> None:
        """A generation of the n ids (h0, h1) of a batch; the same name again overwrites it."""
        self._write(name, ids, n, 0, [])

    def merge(self) -> None:
        """Merge full levels, and delete what was replaced."""
        while True:
            now = self.generations()
            level = next((v for v in sorted({g["level"] for g in now.values()}) if sum(g["level"] == v for g in now.values()) >= MERGE), None)
            if level is None:
                break
            old = sorted(n for n, g in now.items() if g["level"] == level)
            ids = self.spark.read.schema("h0 long, h1 long").option("recursiveFileLookup", "true").parquet(*[self.at.path(f"{n}/ids") for n in old])
            self._write(f"merged-{uuid.uuid4().hex}", ids, sum(now[n]["n"] for n in old), level + 1, old)
        now = self.generations()
        for name in self.at.names():
            if name != "generations" and name not in now and self.at.exists(f"generations/{name}.json"):
                self.at.delete(name)

    def any_of(self, ids: DataFrame, but: str = "") -> bool:
        """Whether one of the ids (h0, h1) was seen in a generation other than ``but``."""
        self.opened = []
        asked = None
        for name, g in self.generations().items():
            if name == but:
                continue
            mine = ids.withColumn("p", F.shiftrightunsigned("h0", 64 - g["depth"]) if g["depth"] else F.lit(0).cast("long")).distinct()
            filters = self.spark.read.schema("p long, bits binary").parquet(self.at.path(f"{name}/filters"))
            few = [r.p for r in mine.select("p").distinct().limit(LISTED + 1).collect()] if g["depth"] else []
            if 0 < len(few) <= LISTED:
                filters = filters.where(F.col("p").isin(few))
            hit = mine.groupBy("p").cogroup(filters.groupBy("p")).applyInArrow(_hits, "h0 long, h1 long, p long").withColumn("g", F.lit(name))
            asked = hit if asked is None else asked.unionByName(hit)
        if asked is None:
            return False
        suspects = asked.select("g", "p").distinct().collect()  # a row a generation and part at most
        if not suspects:
            return False
        self.opened = [f"{r.g}/ids/p={r.p}" for r in suspects]
        held = self.spark.read.schema("h0 long, h1 long").option("recursiveFileLookup", "true").parquet(*[self.at.path(x) for x in self.opened])
        return not ids.join(held, ["h0", "h1"], "left_semi").isEmpty()
