"""Table sources and sinks: driver tables, CSV uploads, schema contracts, JSON reports."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of one driver table; ``columns`` prunes at the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             corrupt_col: str | None = None) -> DataFrame:
    """CSV with header. An explicit schema avoids an inference pass over the data."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        if corrupt_col:
            schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def rename_positional(df: DataFrame, names: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Drop index-like columns, then rename the rest by position."""
    kept = df.drop(*drop) if drop else df
    if len(kept.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, got {len(kept.columns)}")
    return kept.toDF(*names)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Plan-time contract check (no job runs)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"CSV missing columns: {missing}")


def add_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each defaulted column only when it is absent."""
    out = df
    for c, v in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, v if isinstance(v, F.Column) else F.lit(v))
    return out


def coerce_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = None) -> DataFrame:
    """try_cast to double (bad values -> null, ANSI-safe), NaN -> null, optional fill."""
    out = df
    for c in cols:
        if c not in out.columns:
            continue
        v = F.expr(f"try_cast(`{c}` as double)")
        v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        out = out.withColumn(c, F.coalesce(v, F.lit(float(fill))) if fill is not None else v)
    return out


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None,
            required: Sequence[str] = ()) -> DataFrame:
    """Trim names, check the required set, add defaulted columns, try_cast every column to
    its contract type and project in contract order."""
    out = trim_headers(df)
    require_columns(out, required)
    out = add_defaults(out, defaults or {})
    cols = []
    for f in schema.fields:
        if f.name in out.columns:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.expr(f"try_cast(`{f.name}` as double)")
                c = F.when(F.isnan(c), F.lit(None)).otherwise(c).cast(f.dataType)
            elif not isinstance(f.dataType, T.StringType):
                c = F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})")
            else:
                c = c.cast("string")
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return out.select(*cols)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                fmt: str = "parquet") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small report (metric rows) as JSON lines; one file since reports are tiny by construction."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON metadata: one pretty-printed document per file (``multi_line``) or JSON lines
    (reports from ``write_report``). An absent path yields an empty frame instead of failing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([]))
    return spark.read.option("multiLine", multi_line).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def stamp(spark: SparkSession, sf_dir: str, names: Sequence[str] = TABLES) -> str:
    """Digest of the tables' files (path, length, time): what is kept for a session is kept by it, so a table that
    changes within the session is read anew."""
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), hashlib.sha1()
    for name in names:
        jpath = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = jpath.getFileSystem(conf)
        files = fs.listStatus(jpath) if fs.exists(jpath) else []
        for s in sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files):
            seen.update(s.encode())
    return seen.hexdigest()[:16]


_MATERIALISED: dict[tuple[str, str], str] = {}


def materialise(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per session under the checkpoint folder and read it back.

    Used for shared intermediate tables (the scored portfolio, the monthly panel): later
    reports scan the written table instead of recomputing joins, and lineage is cut.
    """
    app = spark.sparkContext.applicationId
    slot = (app, key)
    path = _MATERIALISED.get(slot)
    if path is None or not _exists(spark, path):
        root = ensure_checkpoint_dir(spark).rstrip("/")
        digest = hashlib.sha1(key.encode()).hexdigest()[:16]
        path = f"{root}/tables/{digest}-{os.getpid()}"
        build().write.mode("overwrite").parquet(path)
        _MATERIALISED[slot] = path
    return spark.read.parquet(path)
