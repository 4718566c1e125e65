"""Written tables that cut lineage, and a documents reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import sequential_index
from ..session import ensure_checkpoint_dir


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared folder of ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return written(df)[0]


def drop_written(spark: SparkSession, path: str) -> None:
    """Remove a table made by ``written`` once nothing reads it any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def long_ids(df: DataFrame, name: str, number: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with a long column ``number`` that orders like the id column ``name``, null for null: integer ids
    as they are; ids of other types are numbered in their order, and (number, id) comes as a second table."""
    if isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(number, F.col(f"`{name}`").cast("long")), None
    distinct = df.select(F.col(f"`{name}`").alias("_id")).where("_id is not null").distinct()
    ids = cut(sequential_index(distinct, "_id", "_number").select("_number", "_id"))
    known = ids.select(F.col("_number").alias(number), F.col("_id").alias(f"{number}_id"))
    return df.join(known, F.col(f"`{name}`") == F.col(f"{number}_id"), "left").drop(f"{number}_id"), ids
