"""Positions of rows in an order, without bringing a group together in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.storage import materialize


def positions(df: DataFrame, group: str, order: Sequence[Column], position: str = "position", members: str | None = None) -> DataFrame:
    """df with the place of each row in its group, from 0, and on request the group's rows.

    Rows are dealt by ranges of (group, *order), sorted and written once, so a
    group of any size lies in as many tasks as it fills; a range's rows count
    on from those of the ranges before it.  Only a count for each group and
    range passes through a window.  Rows equal in group and order get
    consecutive places in no set order.  Null groups are one group.  Columns
    of df called part_, at_, first_ or rows_ are not allowed; no rows give no
    rows.
    """
    placed = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    # the part's number in the high bits, the row's in the low 33
    placed = materialize(placed.withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", 33)), "ranges")
    runs = placed.groupBy("part_", F.col(group).alias("of_")).agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    before = F.coalesce(F.sum("rows_").over(W.partitionBy("of_").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("part_").alias("run_"), "of_", (before - F.col("first_")).alias("shift_"), F.sum("rows_").over(W.partitionBy("of_")).alias("of_rows_"))
    joined = placed.join(runs, (F.col("part_") == F.col("run_")) & F.col(group).eqNullSafe(F.col("of_")))
    own = [F.col(f"`{c}`") for c in df.columns]
    more = [F.col("of_rows_").alias(members)] if members else []
    return joined.select(*own, (F.col("at_") + F.col("shift_")).alias(position), *more)
