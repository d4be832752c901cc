"""Numbers in order within a group, by many tasks however large the group is."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", kind: str = "int") -> DataFrame:
    """Adds ``name``, a row's number of type ``kind`` from 1 within its group by ``order`` (columns with a direction).

    Rows are sorted by range over all tasks, so a group lies in as many neighbouring partitions as it fills. Each
    partition numbers its own rows; a group's offset in a partition is the sum of its rows in those before it: a
    window over one row for each partition and group. Sorted rows are written to the shared folder, since both
    steps must see the same partitions. Rows that are equal in ``order`` are numbered in any order.
    """
    ranged = rows.repartitionByRange(*[F.col(g).asc() for g in group], *order).sortWithinPartitions(*[F.col(g).asc() for g in group], *order)
    mono = F.monotonically_increasing_id()
    path = f"{shared_dir(rows.sparkSession)}/numbered-{uuid.uuid4().hex}"
    ranged.withColumns({"_part": F.shiftright(mono, 33), "_at": mono.bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    placed = rows.sparkSession.read.schema(ranged.select("*", F.lit(0).cast("long").alias("_part"), F.lit(0).cast("long").alias("_at")).schema).parquet(path)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    shifts = runs.select("_part", *group, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    found = placed.join(shifts, ["_part", *group])
    return found.withColumn(name, (F.col("_at") + F.col("_shift")).cast(kind)).select(*rows.columns, name)
