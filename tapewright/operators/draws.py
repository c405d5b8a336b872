"""Numbers of a seeded generator, made where they are used: the driver keeps the generator's state at intervals."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers between two kept states: a task makes as many at least.
CHUNK = 1 << 20
#: Rows of draws that are broadcast at most (12 bytes each); more are joined by a shuffle.
BROADCAST_DRAWS = 2_000_000

Unit = Callable[[np.random.Generator, int, int], dict[str, np.ndarray]]


def checkpoints(seed: int, units: int, numbers: int, unit: Unit) -> list[tuple[int, int, str]]:
    """(first, count, state): the generator's state before every so many units. The driver runs through all numbers, as how many
    words of the generator one takes isn't known beforehand, but holds those of one chunk at a time."""
    rng = np.random.default_rng(seed)
    step = max(1, CHUNK // max(1, numbers))
    out = []
    for first in range(0, units, step):
        count = min(step, units - first)
        out.append((first, count, json.dumps(rng.bit_generator.state)))
        if first + count < units:
            unit(rng, first, count)
    return out


def drawn(spark, seed: int, units: int, numbers: int, unit: Unit, schema: str) -> DataFrame:
    """The table that ``unit(generator, first, count)`` makes of the units first .. first + count - 1, of ``numbers`` rows each;
    published results depend on the generator's order, so units are made from kept states, on executors.

    Up to BROADCAST_DRAWS rows it is marked for broadcast."""
    names = [f.split()[0] for f in schema.split(", ")]

    def make(batches):
        for batch in batches:
            for first, count, state in zip(*[c.to_pylist() for c in batch.columns]):
                rng = np.random.default_rng()
                rng.bit_generator.state = json.loads(state)
                made = unit(rng, first, count)
                yield pa.RecordBatch.from_pydict({n: pa.array(made[n]) for n in names})

    kept = checkpoints(seed, units, numbers, unit)
    states = spark.createDataFrame(kept, "first long, count long, state string").repartition(max(1, min(len(kept), spark.sparkContext.defaultParallelism * 4)), "first")
    out = states.mapInArrow(make, schema)
    return F.broadcast(out) if units * numbers <= BROADCAST_DRAWS else out
