"""Consecutive numbers for the rows of a table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OWN_BITS = 33  # of a task's own count in Spark's row numbers


def numbered(df: DataFrame, order: Sequence[Column | str], where: str, name: str = "nth") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 … in the given order.

    Range-partitioned tasks number their own rows, and that table is written to ``where`` once:
    the tasks' counts, one row each, come from the written rows, so rows and counts cannot
    disagree, however the plan is run or a task is repeated.  No task sees all rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed.write.parquet(where)
    written = df.sparkSession.read.schema(placed.schema).parquet(where)
    task, own = F.shiftright(name, _OWN_BITS), F.col(name).bitwiseAND(F.lit((1 << _OWN_BITS) - 1))
    counts = written.groupBy(task.alias("_of")).agg((F.max(own) + 1).alias("_n"))
    before = counts.select("_of", (F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")).alias("_before"))
    return written.join(F.broadcast(before), task == F.col("_of")).withColumn(name, F.col("_before") + own).drop("_of", "_before")
