"""Session helpers: local builder for tests/bench, checkpoint location, literal tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loanlens") -> SparkSession:
    """Local session used by tests and bench; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("LOANLENS_TZ", "UTC"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOANLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting wins.
    Only a local-mode session without one gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="loanlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def literal_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a frame built from a fixed literal table (size known at build time)."""
    return F.broadcast(df)


def default_parallelism(spark: SparkSession) -> int:
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present
        n = 200
    return max(1, n)


def literal_table(spark: SparkSession, rows, names) -> DataFrame:
    """Small fixed table built inside the JVM (``inline`` of a literal array of structs):
    no Python worker round trip, size known at build time, safe to broadcast."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
