"""Places of rows in the order of a whole table, by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

_POSITION = 33  # bits of an id of Spark's that count the rows of a partition


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Add `name`: the row's place, from 1, in the given order, which should leave no ties (ties fall anyhow).

    Rows are dealt to ranges of the order and sorted within; a row's place is its place in its range after the rows of
    the ranges before. Those are counted, a row a range, so nothing but a list of ranges goes to one task. The result
    is staged.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = staged(dealt, "ranked")
    part = F.shiftright("_id", _POSITION)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # as many rows as partitions
    found = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    own = F.col("_id").bitwiseAND(F.lit((1 << _POSITION) - 1))
    return found.withColumn(name, F.col("_base") + own + 1).drop("_id", "_part", "_base")
