"""Scans in an order over all rows at once: what came before a row, and the most so far, without a task that sees them all.

Rows are sorted by ranges.  Each range says what it hands on (its last value, its
largest), a running value over the ranges (a row each) makes of that what each is
handed, and within a range a window does the rest: the way in which
:func:`tallymark.operators.content.ranked` numbers rows, for other values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed


def _placed(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """``rows`` sorted by ranges, with _v (the value, in a struct, so that a null is a value too), _id (ascending in the order) and _part."""
    placed = rows.withColumn("_v", F.struct(value.alias("v"))).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    return checkpointed(placed)  # what is handed on holds for one sort only


def _handed(placed: DataFrame, summary: Column, running) -> DataFrame:
    """(_part, _c): what each range is handed; a row for each."""
    sums = placed.groupBy("_part").agg(summary.alias("_s"))
    return sums.select("_part", running(Window.orderBy("_part")).alias("_c"))


def before(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the value of the row before, in ``order``; null for the first.  The order should be total."""
    placed = _placed(rows, order, value)
    handed = _handed(placed, F.max_by("_v", "_id"), lambda w: F.lag("_s").over(w))
    own = F.lag("_v").over(Window.partitionBy("_part").orderBy("_id"))
    j = placed.withColumn("_l", own).join(F.broadcast(handed), "_part")  # a row for each range
    return j.withColumn(name, F.coalesce("_l", "_c")["v"]).select(*rows.columns, name)


def largest_so_far(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the largest value up to and with each, in ``order``; nulls are smaller than all."""
    placed = _placed(rows, order, value)
    handed = _handed(placed, F.max("_v"), lambda w: F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.max("_v").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    j = placed.withColumn("_m", own).join(F.broadcast(handed), "_part")  # a row for each range
    return j.withColumn(name, F.when(F.col("_c") > F.col("_m"), F.col("_c")).otherwise(F.col("_m"))["v"]).select(*rows.columns, name)
