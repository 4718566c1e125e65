"""As-of join of two tables: each left row meets the last right row of its key at or before its time.

Both sides are cut into time ranges, so a key with most of the rows is spread over as many tasks as it has
ranges. Inside a range the right row is carried along by one window over the union of both sides; what was last before the
range comes over its edge from the ranges before: the last right row of every (key, range), one row each, is carried over
the key's ranges first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], width: float, tie: str | None = None,
              found: str = "found_at") -> DataFrame:
    """``left`` with ``found`` (the time of the right row met, null if none) and the right row's ``values``.

    ``time`` is a number on both sides, a range is ``width`` of it. Right rows without a time are left out, left rows
    without a time meet none; of several right rows at one time the one with the largest ``tie`` counts."""
    own = [c for c in left.columns if c not in (key, time)]
    span = F.floor(F.col(time) / F.lit(width)).cast("long").alias("_range")
    row = F.struct(F.col(time).alias("at"), *([F.col(tie).alias("tie")] if tie else []), *[F.col(v).alias(f"v_{v}") for v in values])
    r = right.where(F.col(time).isNotNull()).select(key, time, span, row.alias("_right"))
    ends = r.groupBy(key, "_range").agg(F.max("_right").alias("_right"))
    l = left.select(key, time, span, F.struct(*own, F.lit(1).alias("_is_left")).alias("_left"))
    # the last right row before each range that has left rows
    spine = l.select(key, "_range").distinct().unionByName(ends, allowMissingColumns=True)
    seen = Window.partitionBy(key).orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    edge = (spine.withColumn("_edge", F.last("_right", ignorenulls=True).over(seen)).where(F.col("_right").isNull() & F.col("_edge").isNotNull())
            .select(key, "_range", F.col("_edge").alias("_right")).distinct())
    both = (l.withColumn("_order", F.lit(2)).unionByName(r.withColumn("_order", F.lit(1)), allowMissingColumns=True)
            .unionByName(edge.withColumn("_order", F.lit(0)), allowMissingColumns=True))
    # edges come first, then by time; at one time right rows come before left rows
    along = Window.partitionBy(key, "_range").orderBy((F.col("_order") > 0).cast("int"), F.col(time), "_order", F.col("_right")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_met", F.last("_right", ignorenulls=True).over(along)).where(F.col("_left").isNotNull())
    met = met.withColumn("_met", F.when(F.col(time).isNotNull(), F.col("_met")))
    return met.select(key, time, *[F.col(f"_left.{c}").alias(c) for c in own], F.col("_met.at").alias(found), *[F.col(f"_met.v_{v}").alias(v) for v in values])
