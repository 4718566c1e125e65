"""Structured Streaming forms of the portfolio refresh: file-source micro-batches, scoring,
idempotent per-batch appends, running band counts, windowed event counts with a watermark,
and redelivery dedup.

Sinks are exactly-once: each micro-batch overwrites its own ``batch_id=N`` folder, so a
replayed batch after a failure rewrites the same files. Checkpoints and outputs live under
the session's reliable checkpoint folder (shared storage on a cluster).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import risk_band
from ..operators.ordered import checkpointed, wallclock_seconds
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def stage_files(df: DataFrame, path: str, files: int, order_col: str | None = None) -> None:
    """Simulate a producer dropping batches into a folder: ``files`` appends, in ``order_col``
    order when given, so the file source sees them arrive in that order."""
    if not order_col:
        df.repartition(files).write.mode("overwrite").parquet(path)
        return
    for _ in arrivals(df, path, files, order_col):
        pass


def arrivals(df: DataFrame, path: str, slices: int, order_col: str) -> Iterator[int]:
    """Append ``df`` to ``path`` in ``order_col`` order, one distributed write per slice (bounds from
    approxQuantile), and yield after each. Rows without a key are a slice of their own, the first.

    The files of a slice are in no order among themselves: a stream with a watermark shorter than a
    slice has to take each slice in one trigger (``replay``)."""
    key = F.col(order_col).cast("double") if not isinstance(df.schema[order_col].dataType,
                                                            (T.TimestampType, T.TimestampNTZType)) \
        else wallclock_seconds(order_col)
    keyed = df.withColumn("_order", key)
    bounds = sorted(set(keyed.approxQuantile("_order", [i / slices for i in range(1, slices)], 0.001)))
    number = F.lit(1)
    for lo in bounds:
        number = number + (F.col("_order") >= lo).cast("int")
    sliced = checkpointed(keyed.withColumn("_slice", F.coalesce(number, F.lit(0))).drop("_order"))
    present = sorted(r["_slice"] for r in sliced.select("_slice").distinct().collect())
    for i in present or [0]:  # one append a slice, each by many tasks, from the written table
        sliced.where(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
        yield i


def replay(df: DataFrame, path: str, slices: int, order_col: str, run: Callable[[DataFrame], None]) -> None:
    """Let ``df`` arrive slice by slice and ``run`` the stream over ``path`` after each, from the same
    checkpoint: a slice is one trigger, judged by the watermark of the slices before it, which its
    rows are not behind."""
    for _ in arrivals(df, path, slices, order_col):
        run(read_stream(df.sparkSession, path, df.schema, max_files=None))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = 1) -> DataFrame:
    """File-source stream with a fixed schema and ``max_files`` files a trigger (None: all that are there)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def append_batches(stream: DataFrame, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Score each micro-batch and write it to ``sink/batch_id=N`` (replay-safe overwrite)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def band_counts(stream: DataFrame, pd_col: str = "pd") -> DataFrame:
    return stream.withColumn("band", risk_band(pd_col)).groupBy("band").agg(F.count(F.lit(1)).alias("borrowers"))


def event_time(stream: DataFrame, ts: str = "ts", name: str = "event_time") -> DataFrame:
    """Watermarks need a TIMESTAMP column; wall-clock (NTZ) times are converted once."""
    return stream.withColumn(name, F.col(ts).cast("timestamp"))


def windowed_event_counts(stream: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Per-day (wall-clock day of ``ts``) counts by event type over a tumbling window of the
    watermarked column, so days older than the watermark leave the state.

    The event time is the wall clock read as UTC: windows are wall-clock days in any session zone."""
    timed = stream.withColumn("event_time", F.timestamp_seconds(wallclock_seconds(ts)))
    counts = (timed.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day").alias("w"), "event_type")
              .agg(F.count(F.lit(1)).alias("n")))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return counts.select(day.alias("day"), "event_type", "n")


def undated_event_counts(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts by event type of the rows without a time, which belong to no window: day is null."""
    counts = stream.where(F.col(ts).isNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit(None).cast("date").alias("day"), "event_type", "n")


def run_updates(stream_df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregate stream in update mode to completion: each micro-batch writes its changed
    keys to its own folder (see ``latest``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    (stream_df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start()).awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The table written by ``run_updates``: a key's row is that of its latest batch."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def dedup_redelivery(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop redelivered records with the same key within the watermark delay."""
    return event_time(stream, ts).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key]) \
        .drop("event_time")


def run_to_table(stream_df: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Run an aggregate stream in complete mode to completion (availableNow) and keep the final
    result as parquet: every micro-batch overwrites the table with the current view."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    q = (stream_df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def top_board(stream: DataFrame, group: str, key: str, value: str, k: int, expire: str | None = None) -> DataFrame:
    """Running board of the ``k`` rows of largest ``value`` in each group (ties by smaller key): after every trigger, the boards
    of the groups that got rows, as (group, rank, key, value).

    The state of a group is its board, k rows whatever has arrived; a trigger's rows are merged batch by batch, so a group with
    most of the rows needs no more memory. A redelivered key keeps its place once. With ``expire`` (such as "1 hour") a group
    without new rows for so long is dropped by a timer."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (group, key, value)}
    out = f"{group} {kinds[group]}, rank int, {key} {kinds[key]}, {value} {kinds[value]}"

    def update(name, batches, state):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        board = pd.DataFrame(dict(zip((key, value), state.get))) if state.exists else pd.DataFrame({key: [], value: []})
        for rows in batches:
            board = pd.concat([b for b in (board, rows[[key, value]].dropna(subset=[value])) if len(b)] or [board])
            board = board.drop_duplicates(key).sort_values([value, key], ascending=[False, True]).head(k)
        state.update((board[key].tolist(), board[value].tolist()))
        if expire:
            state.setTimeoutDuration(expire)
        yield pd.DataFrame({group: [name[0]] * len(board), "rank": range(1, len(board) + 1), key: board[key].to_numpy(), value: board[value].to_numpy()})

    return stream.groupBy(group).applyInPandasWithState(update, out, f"keys array<{kinds[key]}>, top array<{kinds[value]}>", "update",
                                                        "ProcessingTimeTimeout" if expire else "NoTimeout")


def latest_boards(spark: SparkSession, path: str, group: str) -> DataFrame:
    """Boards written by ``run_updates``: of each group, the one of its latest batch."""
    boards = spark.read.parquet(path)
    last = boards.groupBy(group).agg(F.max("batch_id").alias("_last"))
    return boards.join(last, group).where(F.col("batch_id") == F.col("_last")).drop("batch_id", "_last")
