"""Portfolio reports over a scored borrower table (one row per borrower with ``pd``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.scalars import map_lookup, risk_band, risk_score
from ..session import literal_broadcast, literal_table


def round_doubles(df: DataFrame, places: int = 6, overrides: Mapping[str, int] | None = None) -> DataFrame:
    """Round every double column (``overrides`` per column), for stable output comparison."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), overrides.get(f.name, places)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def with_risk(df: DataFrame, pd_col: str = "pd") -> DataFrame:
    return df.withColumn("band", risk_band(pd_col)).withColumn("risk_score", risk_score(pd_col))


def with_lgd(df: DataFrame, key: str = "sector", lgd_map: Mapping[str, float] = K.LGD_FIXTURE,
             default: float = K.LGD_FIXTURE_DEFAULT) -> DataFrame:
    """LGD from a fixed literal map (folded into the projection; no join needed)."""
    return df.withColumn("lgd", map_lookup(key, lgd_map, default).cast("double"))


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default=None) -> DataFrame:
    """Left equi-join against a dimension frame; the planner broadcasts it below its byte threshold."""
    joined = df.join(dim.select(on, value), on, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def dim_from_mapping(spark, mapping: Mapping, key: str, value: str, value_type: str = "double") -> DataFrame:
    return literal_table(spark, [(k, float(v) if value_type == "double" else v) for k, v in mapping.items()],
                         [key, value])


def with_expected_loss(df: DataFrame, pd_col: str = "pd", ead_col: str = "outstanding_loan",
                       lgd_col: str = "lgd") -> DataFrame:
    el = F.col(pd_col) * F.col(ead_col) * F.col(lgd_col)
    return df.withColumn("expected_loss", el).withColumn("potential_recovery", F.col(ead_col) - el)


def sector_analytics(scored: DataFrame, key: str = "sector") -> DataFrame:
    """Per-sector exposure, mean PD, expected loss and count, ordered by EL (null keys dropped
    like a pandas groupby)."""
    return (scored.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.sum("outstanding_loan").alias("exposure"),
                 F.avg("pd").alias("avg_pd"),
                 F.sum("expected_loss").alias("expected_loss"),
                 F.count(F.lit(1)).alias("borrower_count"))
            .orderBy(F.desc("expected_loss")))


def portfolio_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total_borrowers"),
                      F.avg("pd").alias("avg_pd"),
                      F.sum("outstanding_loan").alias("total_exposure"),
                      F.sum("expected_loss").alias("total_expected_loss"))


def band_distribution(scored: DataFrame) -> DataFrame:
    """Band histogram completed with zero counts over the fixed band domain."""
    spark = scored.sparkSession
    bands = literal_broadcast(literal_table(spark, [(i, b) for i, b in enumerate(K.BANDS)], ["band_order", "band"]))
    counts = scored.where(F.col("band").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return (bands.join(counts, "band", "left")
            .select("band", "band_order", F.coalesce("n", F.lit(0)).alias("borrowers")))


def upload_summary(input_rows: DataFrame, scored: DataFrame, threshold: float = K.HIGH_RISK_PD) -> DataFrame:
    """rows ingested (input rows) vs borrowers scored, mean PD and high-risk count."""
    rows_in = input_rows.agg(F.count(F.lit(1)).alias("rows_ingested"))
    s = scored.agg(F.count(F.lit(1)).alias("borrowers_scored"), F.avg("pd").alias("avg_pd"),
                   F.count_if(F.col("pd") >= threshold).alias("high_risk_count"))
    return _one_row_concat(rows_in, s)


def _one_row_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side concatenation of two single-row aggregates (equi-join on a constant key)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def top_borrowers(scored: DataFrame, n: int = 50, cols: Sequence[str] = ("company_id", "sector", "loan_type",
                                                                            "pd", "outstanding_loan"),
                  extra: bool = True, places: int = 6, by: str = "margin") -> DataFrame:
    """Top-n by PD with an id tie-break. The order is that of the log-odds (``by``), which still tells
    apart borrowers whose PD is 1 to the last digit; only the printed PD is rounded.

    Plans as TakeOrderedAndProject: each partition keeps its own top-n, then one merge of
    n x partitions rows — no full sort.
    """
    extras = [risk_band("pd").alias("risk_band"), risk_score("pd").alias("risk_score")] if extra else []
    out = scored.select(*cols, *extras, *([by] if by not in cols else [])).orderBy(F.desc(by), F.asc("company_id")).limit(n)
    return round_doubles(out if by in cols else out.drop(by), places, {"outstanding_loan": 2})


def append_portfolio(current: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union by column name; columns missing on either side become null."""
    return current.unionByName(new, allowMissingColumns=True)


def refresh_summary(current: DataFrame, batch: DataFrame, threshold: float = K.HIGH_RISK_PD) -> DataFrame:
    total = current.agg(F.count(F.lit(1)).alias("prior"))
    new = batch.agg(F.count(F.lit(1)).alias("added"),
                    F.count_if(F.col("pd") >= threshold).alias("new_high_risk"),
                    F.avg("pd").alias("new_avg_pd"))
    return _one_row_concat(total, new).select(
        "added", (F.col("prior") + F.col("added")).alias("total_borrowers"), "new_high_risk", "new_avg_pd")


def class_balance(df: DataFrame, label: str = "default") -> DataFrame:
    y = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(y).cast("long").alias("n_default"),
                  F.avg(y.cast("double")).alias("default_rate"),
                  F.count_if(y == 0).alias("n_healthy"),
                  F.avg((y == 0).cast("double")).alias("healthy_rate"))


def class_weight(df: DataFrame, label: str = "default") -> DataFrame:
    """Imbalance weight neg/pos, plus the balanced per-class weights n / (2 * n_class)."""
    y = F.col(label)
    agg = df.agg(F.count_if(y == 0).alias("n_neg"), F.count_if(y == 1).alias("n_pos"))
    return agg.select("n_neg", "n_pos",
                      F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("scale_pos_weight"),
                      F.try_divide((F.col("n_neg") + F.col("n_pos")).cast("double"), 2 * F.col("n_neg")).alias("w_neg"),
                      F.try_divide((F.col("n_neg") + F.col("n_pos")).cast("double"), 2 * F.col("n_pos")).alias("w_pos"))


def action_plan(df: DataFrame, ladder: Mapping[str, list] = K.ACTION_LADDER_MSME, band_col: str = "band") -> DataFrame:
    """One row per (borrower, action): inner join with the fixed band ladder (literal, broadcast)."""
    spark = df.sparkSession
    rows = [(b, i + 1, p, a, d) for b, acts in ladder.items() for i, (p, a, d) in enumerate(acts)]
    dim = literal_broadcast(literal_table(spark, rows, ["band", "seq", "priority", "action", "detail"]))
    return df.join(dim, df[band_col] == dim.band, "inner").drop(dim.band)


def assign_ids(df: DataFrame, order_col: str, fmt: str = "UP-%04d", name: str = "upload_id") -> DataFrame:
    """Sequential formatted ids in ``order_col`` order, without a single-partition window."""
    from .ordered import sequential_index
    return sequential_index(df, order_col, "_seq").withColumn(name, F.format_string(fmt, F.col("_seq"))).drop("_seq")
