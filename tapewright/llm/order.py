"""Places in a global order: rows are range-sorted, each partition sums its own, and one row per partition carries on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved

#: Up to this many sums of (partition, group) are broadcast; beyond, the join shuffles and AQE splits hot pairs.
BROADCAST_SUMS = 100_000


def _sums(weight: str | None, own: tuple[str, str, str]):
    part, at, w = own

    def walk(batches):
        from pyspark import TaskContext

        me, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            weights = np.asarray(batch.column(batch.schema.get_field_index(weight))).astype(np.int64) if weight else np.ones(batch.num_rows, np.int64)
            upto = before + np.cumsum(weights)
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            columns |= {part: pa.array(np.full(batch.num_rows, me, np.int64)), at: pa.array(upto - weights), w: pa.array(weights)}
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_pydict(columns)

    return walk


def placed(df: DataFrame, order: list[str], place: str, total: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """df with ``place``, the sum of ``weight`` (1 without one; never null or negative) over the rows before it, and ``total``,
    the sum over all rows; both within ``group`` if one is given. Rows stand by (group, order), nulls first, strings by their
    UTF-8 bytes; rows that are equal in all of them stand in any order, so add columns until such rows are alike.

    No key is held by one task: the range partitions cut a hot group by ``order``. Partitions are as many as
    spark.sql.shuffle.partitions; their sums (one row for each partition and group in it) are what is windowed.
    """
    part, at, w, least = (f"__{place}_{x}" for x in ("part", "at", "weight", "least"))
    keys = ([group] if group else []) + order
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.LongType()) for c in (part, at, w)])
    rows = saved(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).mapInArrow(_sums(weight, (part, at, w)), schema), "placed")
    by = [F.col(group)] if group else []
    sums = saved(rows.groupBy(part, *by).agg(F.min(at).alias(least), F.sum(w).alias(w)), "placed-sums")
    whole = Window.partitionBy(*by)
    sums = sums.select(F.col(part).alias(part + "_"), *[c.alias("__group_") for c in by], least,
                       (F.sum(w).over(whole.orderBy(part)) - F.col(w)).alias("__base_"), F.sum(w).over(whole).alias(total))
    if sums.count() <= BROADCAST_SUMS:
        sums = F.broadcast(sums)
    same = F.col(part) == F.col(part + "_")
    if group:
        same &= F.col(group).eqNullSafe(F.col("__group_"))
    joined = rows.join(sums, same)
    return joined.select(*df.columns, (F.col("__base_") + F.col(at) - F.col(least)).alias(place), F.col(total))
