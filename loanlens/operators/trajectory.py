"""Forward PD trajectories: each borrower x 12 scenario months, rescored in one projection.

The borrower x month product is ``explode(sequence(0, 11))`` — a fixed fan-out of 12 per row
(Generate, no join, no shuffle) — and the scorer is a column expression applied to the
modified feature columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import clip, risk_band

MONTHS = 12


def scenario_spine(df: DataFrame) -> DataFrame:
    """Borrower rows x month_idx 0..11 with the deterioration scale s = i / 11."""
    return (df.withColumn("month_idx", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
            .withColumn("s", F.col("month_idx") / float(MONTHS - 1))
            .withColumn("month", F.element_at(F.array(*[F.lit(m) for m in K.SCENARIO_MONTHS]), F.col("month_idx") + 1)))


def msme_scenarios(df: DataFrame) -> DataFrame:
    s = F.col("s")
    return (scenario_spine(df)
            .withColumn("revolving_utilization", clip(F.col("revolving_utilization") * (0.5 + 0.5 * s), 0.01, 0.99))
            .withColumn("gst_compliance_score", clip(F.col("gst_compliance_score") * (1.1 - 0.2 * s), 0.0, 1.0))
            .withColumn("payment_history_score", clip(F.col("payment_history_score") * (1.05 - 0.15 * s), 0.0, 1.0))
            .withColumn("cashflow_stress_ratio", F.col("cashflow_stress_ratio") * (0.6 + 0.6 * s)))


def consumer_scenarios(df: DataFrame) -> DataFrame:
    s = F.col("s")
    return (scenario_spine(df)
            .withColumn("loan_int_rate", clip(F.col("loan_int_rate") * (0.95 + 0.18 * s), None, 24.0))
            .withColumn("loan_percent_income", clip(F.col("loan_percent_income") * (0.9 + 0.4 * s), None, 0.83))
            .withColumn("person_emp_length", clip(F.col("person_emp_length") * (1 - 0.1 * s), 0.0, None)))


def trajectory(scenarios: DataFrame, scorer: Callable[[], Column], key: str = "company_id") -> DataFrame:
    return scenarios.select(key, "month_idx", "month", scorer().alias("pd")).withColumn("band", risk_band("pd"))


def folded(months: DataFrame, key: str, name: str) -> DataFrame:
    """key, ``name``: neighbouring rows of a key become one row with their other columns as an array of structs. The months of
    a borrower are made side by side, so a shuffle moves one row a borrower instead of twelve; where the end of a batch
    parts them there are two, which whoever groups by the key puts together."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    own = [c for c in months.columns if c != key]

    def run(batches):
        for batch in batches:
            n, keys = batch.num_rows, batch.column(0)
            if not n:
                continue
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, dtype=bool)
            at = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]]).astype(np.int32)
            rows = pa.StructArray.from_arrays(batch.columns[1:], names=own)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[:-1])), pa.ListArray.from_arrays(pa.array(at), rows)], names=[key, name])

    kinds = {f.name: f.dataType.simpleString() for f in months.schema.fields}
    row = ", ".join(f"{c}: {kinds[c]}" for c in own)
    return months.select(key, *own).mapInArrow(run, f"{key} {kinds[key]}, {name} array<struct<{row}>>")


def migration(traj: DataFrame, current: DataFrame, key: str = "company_id") -> DataFrame:
    """Band at scenario month 0 versus the band of the current PD: of ``traj`` only the rows of that month are scored and grouped."""
    start = traj.where(F.col("month_idx") == 0).groupBy(key).agg(F.min_by("band", "month_idx").alias("start_band"))
    return (current.select(key, risk_band("pd").alias("end_band")).join(start, key)
            .withColumn("migrated", F.col("start_band") != F.col("end_band")))
