"""Whole records: everything known of a borrower as one row with nested arrays.

Sources of several rows a borrower (scenario months, events, the note) become one tagged union and are
grouped by the key in one pass, however many sources there are, instead of a chain of joins. What a row of the base
table holds already (features, drivers, actions) is nested in place, without a shuffle. Every
nested array is bounded by construction: 12 months, ``SHOWN`` latest events, the model's features, the ladder's steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .attribution import narrative
from .scorecard import zscore

SHOWN = 50  # latest events of a record; ``journey.journey_to_date`` reads all


def gather(base: DataFrame, parts: Mapping[str, DataFrame], key: str, every: Mapping[str, str] | None = None, tasks: int = 0) -> DataFrame:
    """``base`` (one row a key) with one array column for each part: the part's rows of that key as
    structs, in the order of their fields. Rows of keys that ``base`` lacks are left out. Where ``base`` repeats a key one of its
    rows stays; ``every`` (new name: column of ``base``) keeps a column's known values of all of them, in order. With ``tasks`` the
    rows are first dealt out to so many: where a key has few rows, grouping before the shuffle sorts them for nothing, and
    many small rows after it, put together by their packed size, may not fit a task's memory."""
    own, every = [c for c in base.columns if c != key], dict(every or {})
    tagged = [base.select(key, F.struct(*own).alias("_base"))]
    tagged += [part.select(key, F.struct(*[c for c in part.columns if c != key]).alias(name)) for name, part in parts.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    grouped = (union.repartition(tasks, key) if tasks else union).groupBy(key).agg(
        F.first("_base", ignorenulls=True).alias("_base"), *(F.array_sort(F.collect_list(n)).alias(n) for n in parts),
        *(F.array_sort(F.collect_list(F.col("_base")[c])).alias(n) for n, c in every.items()))
    return grouped.where(F.col("_base").isNotNull()).select(key, "_base.*", *parts, *every)


def latest_rows(df: DataFrame, owner: str, order: Sequence[str], n: int = SHOWN) -> DataFrame:
    """The latest ``n`` rows of each owner: every task keeps ``n`` an owner before the shuffle."""
    w = Window.partitionBy(owner).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")


def feature_values(features: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])


def linear_drivers(stats: Mapping[str, tuple[float, float]], weights: Mapping[str, float] = K.SCORECARD_WEIGHTS, k: int = K.DRIVERS_CONTEXT) -> Column:
    """The ``k`` largest impacts of a closed-form scorecard in a row, with sentences (ties by feature name, unknown values last)."""
    facts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), (F.lit(float(w)) * zscore(f, stats)).alias("impact")) for f, w in weights.items()])
    ranked = F.transform(facts, lambda x: F.struct(F.coalesce(-F.round(F.abs(x["impact"]), 12), F.lit(float("inf"))).alias("order"), x["feature"].alias("feature"),
                                                   x["value"].alias("value"), x["impact"].alias("impact")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["impact"].alias("impact"),
                                                                                 narrative(x["feature"], x["value"]).alias("narrative")))


def actions(band: Column | str, ladder: Mapping[str, list] = K.ACTION_LADDER_MSME) -> Column:
    """The band's actions in order; an unknown band has none."""
    b = F.col(band) if isinstance(band, str) else band
    out = None
    for name, steps in ladder.items():
        nested = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"), F.lit(d).alias("detail")) for p, a, d in steps])
        out = F.when(b == name, nested) if out is None else out.when(b == name, nested)
    return F.coalesce(out, F.array().cast("array<struct<priority: string, action: string, detail: string>>"))
