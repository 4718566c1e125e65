"""Order-dependent aggregates over large groups without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` plans ``Exchange SinglePartition``: one task
sorts everything. The helpers here split the order key into value ranges (bounds from
``approxQuantile``, a bounded list), compute per-range totals (<= ranges x groups rows),
prefix-sum those, broadcast them back and finish with a window partitioned by range.
Range assignment is a pure function of the value, so a lost executor recomputes the same
ranges (no reliance on partition ids).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, ensure_checkpoint_dir, literal_broadcast, literal_table

_BUCKET = "_range_id"


def wallclock_seconds(col: str):
    """Seconds since 1970-01-01 of a wall-clock (TIMESTAMP_NTZ) value as a double, without any
    time-zone conversion, so it is monotone in the timestamp in every session zone."""
    c = F.col(col)
    return (F.unix_date(F.to_date(c)).cast("double") * 86400.0 + F.hour(c) * 3600.0 + F.minute(c) * 60.0
            + F.date_part(F.lit("SECOND"), c).cast("double"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written under the reliable checkpoint folder (the shared folder
    named by ``spark.checkpoint.dir``): one write pass, later passes read columnar files, and a
    lost executor does not recompute the upstream plan. (``Dataset.checkpoint`` would compute
    the plan twice unless it were cached first.)"""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _range_ids(df: DataFrame, order_col: str, n_ranges: int, rel_err: float) -> DataFrame:
    bounds = []
    if n_ranges > 1:
        probs = [i / n_ranges for i in range(1, n_ranges)]
        # one aggregate (partial percentile sketches per task, merged once): a bounded list
        row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs,
                                         int(max(1.0 / rel_err, 100))).alias("b")).first()
        bounds = (row["b"] or []) if row else []
    splits = sorted({float(b) for b in bounds if b is not None and not math.isnan(b) and not math.isinf(b)})
    splits = [-math.inf] + splits + [math.inf]
    tmp = "_range_key"
    keyed = df.withColumn(tmp, F.col(order_col).cast("double"))
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol=_BUCKET, handleInvalid="keep").transform(keyed)
    return out.drop(tmp).withColumn(_BUCKET, F.col(_BUCKET).cast("int"))


def running_totals(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    n_ranges: int | None = None,
    rel_err: float = 0.001,
    prefix: str = "cum_",
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ascending ``order_col`` within ``group_cols``.

    Meant for a few large groups (global, per class, per model). ``order_col`` values should be
    unique within a group (pre-aggregate ties first); ties are otherwise ordered arbitrarily.
    Rows with a null ``order_col`` are excluded.
    """
    group_cols = list(group_cols)
    n = n_ranges or default_parallelism(df.sparkSession)
    base = df.where(F.col(order_col).isNotNull())
    ranged = _range_ids(base, order_col, n, rel_err)
    totals = ranged.groupBy(*group_cols, _BUCKET).agg(*[F.sum(c).alias(c) for c in sum_cols])
    if group_cols:
        # offsets hold <= groups x ranges rows; the planner decides on the join by their measured size
        before = Window.partitionBy(*group_cols).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*group_cols, _BUCKET, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    else:
        # one group: at most n_ranges + 1 rows are summed up on the driver and joined as a literal table
        acc, rows = [0] * len(sum_cols), []
        for r in sorted(totals.collect(), key=lambda r: r[_BUCKET]):
            rows.append((r[_BUCKET], *acc))
            acc = [a + (r[c] or 0) for a, c in zip(acc, sum_cols)]
        names = [_BUCKET, *[f"_off_{c}" for c in sum_cols]]
        offsets = literal_broadcast(literal_table(df.sparkSession, rows or [(-1, *acc)], names))
    joined = ranged.join(offsets, [*group_cols, _BUCKET])
    upto = (Window.partitionBy(*group_cols, _BUCKET).orderBy(order_col, *tie_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.sum(c).over(upto) + F.col(f"_off_{c}"))
    return out.drop(_BUCKET, *[f"_off_{c}" for c in sum_cols])


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probs: Sequence[float] = (0.5,),
    group_cols: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/numpy default), nulls skipped.

    Ranks are located with range-split running totals: no task ever holds more than one value range.
    Values are first collapsed to (value, multiplicity), so a hot value costs one row.
    Returns one row per group with one column per probability.
    """
    group_cols = list(group_cols)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    counted = (df.where(F.col(value_col).isNotNull())
               .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))
    # the distinct-value table is read three times (range bounds, range totals, final pass):
    # write it once to the reliable checkpoint folder instead of recomputing the input plan
    counted = checkpointed(counted)
    cum = running_totals(counted, value_col, ["_n"], group_cols)
    sizes = counted.groupBy(*group_cols).agg(F.sum("_n").alias("_total"))
    ranks = []
    for i, p in enumerate(probs):
        k = F.lit(p) * (F.col("_total") - 1)
        ranks += [F.floor(k).alias(f"_lo{i}"), F.ceil(k).alias(f"_hi{i}"), (k - F.floor(k)).alias(f"_fr{i}")]
    sized = sizes.select(*group_cols, "_total", *ranks)
    if group_cols:
        joined = cum.join(sized, group_cols)  # one row per group; AQE broadcasts it at runtime
    else:
        # single global group: carry its size and ranks as literals (one tiny row)
        row = sized.first()
        joined = cum
        for i, _ in enumerate(probs):
            joined = (joined.withColumn(f"_lo{i}", F.lit(row[f"_lo{i}"] if row else None))
                      .withColumn(f"_hi{i}", F.lit(row[f"_hi{i}"] if row else None))
                      .withColumn(f"_fr{i}", F.lit(row[f"_fr{i}"] if row else None)))
    start = F.col("cum__n") - F.col("_n")
    aggs = []
    for i, _ in enumerate(probs):
        lo_hit = (start <= F.col(f"_lo{i}")) & (F.col(f"_lo{i}") < F.col("cum__n"))
        hi_hit = (start <= F.col(f"_hi{i}")) & (F.col(f"_hi{i}") < F.col("cum__n"))
        aggs += [F.max(F.when(lo_hit, F.col(value_col))).alias(f"_vlo{i}"),
                 F.max(F.when(hi_hit, F.col(value_col))).alias(f"_vhi{i}"),
                 F.max(f"_fr{i}").alias(f"_f{i}")]
    picked = joined.groupBy(*group_cols).agg(*aggs)
    outs = [
        (F.col(f"_vlo{i}").cast("double")
         + (F.col(f"_vhi{i}").cast("double") - F.col(f"_vlo{i}").cast("double")) * F.col(f"_f{i}")).alias(nm)
        for i, nm in enumerate(names)
    ]
    return picked.select(*group_cols, *outs)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.5,),
                     group_cols: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles of several numeric columns in one pass: the columns are unpivoted to
    (column, value) and ``column`` becomes one more group key. One row per (column, group)."""
    group_cols = list(group_cols)
    cast_cols = [F.col(c).cast("double").alias(c) for c in cols]
    long = df.select(*group_cols, *cast_cols).unpivot(group_cols, list(cols), "column", "value")
    return exact_quantiles(long, "value", probs, ["column", *group_cols], names)


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Global exact medians of several columns, returned as a small dict (one value per column)."""
    rows = column_quantiles(df, cols, (0.5,), names=["m"]).collect()  # one row per column
    found = {r["column"]: r["m"] for r in rows}
    return {c: found.get(c) for c in cols}


def sequential_index(df: DataFrame, order_col: str, name: str = "seq") -> DataFrame:
    """1-based row number in ascending ``order_col`` (any type, nulls last): a distributed sort, whose
    partitions' row counts give each partition its first number. The sorted table is written, so a
    lost executor cannot change the numbers."""
    at = checkpointed(df.orderBy(F.col(order_col).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    numbered = at.withColumn("_part", F.shiftright("_at", 33))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    first = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(first, "_part").withColumn(name, F.col("_first") + place).drop("_at", "_part", "_first")
