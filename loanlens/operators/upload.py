"""Portfolio uploads: rows that do not fit the contract go to a quarantine with their reasons, the rest becomes the
new version of the portfolio in one step.

The file is read once, as text; a projection finds every reason why a row does not fit, and the staged
rows are written under the new version's folder as ``accepted`` and ``quarantine``. Publishing the version makes both
visible together; an upload that fails before (wrong file, missing columns, no rows, a failing job) leaves the
version before as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions as VS
from ..sources.tables import add_defaults, require_columns, trim_headers
from .ordered import checkpointed, sequential_index

LINE = "_line"
BROKEN = "_broken"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column as text under its trimmed name, with the row's place in the upload and, in
    ``_broken``, the whole line where its number of fields is not the header's."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("Please upload a .csv file")
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names) + f", `{BROKEN}` string"
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(path)
    return checkpointed(trim_headers(raw).withColumn(LINE, F.monotonically_increasing_id()))


def _value(name: str, kind: str) -> Column:
    text = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
    if kind == "string":
        return text
    number = text.try_cast(kind)
    return F.when(~F.isnan(number), number) if kind in ("double", "float") else number


def reasons(contract: Mapping[str, str], filled: Sequence[str] = ()) -> Column:
    """Why a row does not fit: a broken line, a value that is not of its column's type, or a blank in a column
    that has to be filled. A blank elsewhere is a missing value, which models impute."""
    found = [F.when(F.col(BROKEN).isNotNull(), F.lit("broken line"))]
    for name, kind in contract.items():
        text = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        if kind != "string":
            found.append(F.when(F.col(BROKEN).isNull() & text.isNotNull() & text.try_cast(kind).isNull(), F.lit(f"not a number: {name}")))
        if name in filled:
            found.append(F.when(F.col(BROKEN).isNull() & text.isNull(), F.lit(f"blank: {name}")))
    return F.array_compact(F.array(*found))


def split_rows(raw: DataFrame, contract: Mapping[str, str], filled: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted with contract types, quarantined with ``reasons`` and the row as JSON text)."""
    require_columns(raw, list(contract))
    judged = raw.withColumn("reasons", reasons(contract, filled))
    good = judged.where(F.size("reasons") == 0).select(LINE, *[_value(n, k).alias(n) for n, k in contract.items()])
    own = [c for c in raw.columns if c not in (LINE, BROKEN)]
    bad = judged.where(F.size("reasons") > 0).select(LINE, "reasons", F.coalesce(BROKEN, F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))).alias("row"))
    return good, bad


def with_ids(df: DataFrame, name: str = "company_id", fmt: str = "UP-%04d") -> DataFrame:
    """Ids in upload order, only when the upload has none."""
    if name in df.columns:
        return df
    return sequential_index(df, LINE, "_seq").withColumn(name, F.format_string(fmt, F.col("_seq"))).drop("_seq")


def ingest(spark: SparkSession, path: str, root: str, contract: Mapping[str, str], filled: Sequence[str] = (), optional: Mapping[str, str] | None = None,
           defaults: Mapping[str, object] | None = None, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> str:
    """Upload ``path`` as the new version of the portfolio under ``root``. ``optional`` columns are taken over where the file has
    them, ``defaults`` are added where it has not, ``finish`` (for example scoring) runs on the accepted rows. Returns the version's folder."""
    raw = read_text_csv(spark, path)
    if raw.isEmpty():
        raise ValueError("the upload has no rows")
    taken = dict(contract) | {c: k for c, k in (optional or {}).items() if c in raw.columns}
    good, bad = split_rows(raw, taken, filled)
    good = finish(add_defaults(with_ids(good), defaults or {})).drop(LINE)

    def write(folder: str) -> None:
        good.write.parquet(f"{folder}/accepted")
        bad.drop(LINE).write.parquet(f"{folder}/quarantine")

    return VS.publish(spark, root, write)


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) of the current version."""
    folder = VS.current(spark, root)
    if folder is None:
        raise ValueError("nothing has been uploaded")
    return spark.read.parquet(f"{folder}/accepted"), spark.read.parquet(f"{folder}/quarantine")
