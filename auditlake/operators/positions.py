"""Global row positions without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_position(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with its place from 1 on in the order, a range of rows per task.

    The rows are dealt by ranges and sorted within them; a place is the one
    inside its range plus the rows of the ranges before, a number per range.
    The ranged rows are written once, as their split must not change between
    counting and numbering.
    """
    ranged = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("long")
    return ranged.join(sizes, part == F.col("_part")).withColumn(name, place).drop("_id", "_part", "_first", "_before")
