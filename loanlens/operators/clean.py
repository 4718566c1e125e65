"""Record cleaning: validity filters, outlier filters, audits, dedup, lookups, domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .ordered import exact_medians


def valid_applicant(age: str = "person_age", emp: str = "person_emp_length",
                    max_age: int = 100, max_emp: float = 60) -> Column:
    """Drop impossible records: age <= 100 (null age fails) and tenure <= 60 with null tenure kept."""
    return (F.col(age) <= max_age) & (F.coalesce(F.col(emp), F.lit(0)) <= max_emp)


def outlier_rules(bounds: Mapping[str, tuple[str, float]]) -> Column:
    """Conjunction of ``coalesce(col, 0) <op> bound`` rules, e.g. {'income': ('<', 3e6)}."""
    out = None
    for c, (op, v) in bounds.items():
        x = F.coalesce(F.col(c), F.lit(0))
        cond = {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]
        out = cond if out is None else out & cond
    return out


def filter_valid(df: DataFrame, rule: Column) -> DataFrame:
    return df.where(rule)


def cleaning_audit(df: DataFrame, rule: Column, label: str) -> DataFrame:
    """Rows and label rate before and after a filter, in one scan (conditional aggregates)."""
    keep = F.coalesce(rule, F.lit(False))
    y = F.col(label).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_after"),
        F.avg(y).alias("rate_before"),
        F.avg(F.when(keep, y)).alias("rate_after"),
    )


def dedup(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full-row distinct (nulls compare equal); hash aggregate with map-side combine."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def lookup_ids(df: DataFrame, requested: DataFrame, key: str, found: bool = True) -> DataFrame:
    """Batch point lookup: requested ids that exist (left semi) or do not (left anti)."""
    return requested.join(df.select(key), key, "left_semi" if found else "left_anti")


def category_domains(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values of categorical columns: a row (column, value) each, so a column of any
    number of levels stays distributed."""
    rows = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            .where(F.col("value").isNotNull()) for c in cols]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.distinct()


def median_impute(df: DataFrame, cols: Sequence[str], medians: Mapping[str, float] | None = None,
                  approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Fill nulls with column medians (fitted once, applied as literals): exact by default,
    or ``percentile_approx`` in one aggregate when ``approx`` is set."""
    if medians is None and approx:
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in cols]).first()
        medians = {c: row[c] for c in cols}
    if medians is None:
        medians = exact_medians(df, cols)
    out = df
    for c in cols:
        if medians.get(c) is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(float(medians[c]))))
    return out


def status_label(status: str = "loan_status", defaults: Sequence[str] = K.DEFAULT_STATUSES) -> Column:
    """1 when the lower-cased status is in the default list, else 0 (null -> 0)."""
    return F.coalesce(F.lower(F.col(status)).isin(list(defaults)), F.lit(False)).cast("int")
