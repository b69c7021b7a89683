"""Rows dealt into ranges of an ordered column, so that running sums need no window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges for each shuffle partition.
RANGES = 4


def range_of(df: DataFrame, column: str) -> Column:
    """The number of the range in which a row's value of a whole-number column lies: about as many rows in each, equal values together. Nulls come first."""
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n)).first()[0]  # n numbers
    if ends is None:
        return F.lit(0)
    ends = sorted(set(ends))
    bounds = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")  # folded once
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(ends).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) < F.col(column), at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))
