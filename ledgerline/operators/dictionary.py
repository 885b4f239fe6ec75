"""Expressions over values that come again and again, worked out once for each value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values up to which they are listed, and the longest ones listed.
VALUES, LONGEST = 10_000, 300


def listed(df: DataFrame, columns: Sequence[str], most: int = VALUES) -> DataFrame | None:
    """The distinct values of text columns, if they are ``most`` at most and none is longer than LONGEST; nothing beyond those bounds comes to the driver."""
    values = df.select(*columns)
    rows = values.select(*(F.substring(c, 1, LONGEST + 1).alias(c) for c in columns)).distinct().limit(most + 1).collect()
    if len(rows) > most or any(len(v) > LONGEST for r in rows for v in r if v is not None):
        return None
    return df.sparkSession.createDataFrame(rows, values.schema)


def per_value(df: DataFrame, columns: Sequence[str], facts: Mapping[str, Column]) -> DataFrame:
    """df with facts, deterministic expressions over the text ``columns`` alone.

    Labels and units are few however many rows have them, so what they say is
    worked out for each distinct one and joined by a broadcast.  Of more than
    VALUES, or of longer ones than LONGEST, it is worked out row by row; nothing
    beyond those bounds comes to the driver.  df is read once more for this.
    """
    if df.isStreaming:
        return df.withColumns(dict(facts))
    values = listed(df, columns)
    if values is None:
        return df.withColumns(dict(facts))
    named = {c: f"value_{i}_" for i, c in enumerate(columns)}
    known = values.select(*(F.col(c).alias(n) for c, n in named.items()), *(v.alias(k) for k, v in facts.items()))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    # a left join, as every value is listed and no row may be lost
    return df.join(F.broadcast(known), same, "left").drop(*named.values())
