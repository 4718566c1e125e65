"""Journey events: JSON (de)serialisation, keyed dedup keeping first occurrence, running views.

Everything is keyed by the journey owner (``user_id``): dedup is a window partitioned by
(owner, date, desc) — tiny groups — and running columns are windows partitioned by owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("date", T.DateType()), T.StructField("type", T.StringType()),
                      T.StructField("desc", T.StringType())])
JOURNEY = T.ArrayType(EVENT)


def journey_view(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "ts", F.to_date("ts").alias("date"),
                         F.col("event_type").alias("type"), F.col("props").alias("desc"))


def serialise(df: DataFrame) -> DataFrame:
    return df.withColumn("event_json", F.to_json(F.struct("date", "type", "desc")))


def parse_events(text_col: str, schema: T.DataType = JOURNEY):
    """from_json with malformed or null text -> empty journey."""
    return F.coalesce(F.from_json(F.col(text_col), schema), F.array().cast(schema))


def dedup_first(df: DataFrame, owner: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """Keep the first occurrence of each (date, desc) per owner, in event order.

    A hash aggregate with ``min_by`` (partial aggregation on the map side), so a key repeated
    millions of times is collapsed before the shuffle instead of sorted in one task."""
    rest = [c for c in df.columns if c not in (owner, "date", "desc")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(owner, "date", "desc").agg(first).select(owner, "date", "desc", "_first.*")


RANK_BLOCK = 1024


def journey_log(df: DataFrame, owner: str = "user_id", order: str = "ts", tie: str = "event_id", block: int = RANK_BLOCK) -> DataFrame:
    """The journeys as a log: every event with its 1-based ``rank`` in its owner's journey, the running number of errors, and its
    rank ``block``. The journey to any date is a prefix of ranks, read by a range of blocks; no list grows with the
    history. Ranks come from running counts over event-time ranges, so one owner with a third of all events is spread."""
    keyed = df.withColumn("_one", F.lit(1)).withColumn("_err", (F.col("type") == "error").cast("long"))
    keyed = keyed.withColumn("_ord", F.struct(F.col(order).alias("ts"), F.col(tie).alias("tie")))
    ranked = _running_by_struct(keyed, owner).withColumnRenamed("events_to_date", "rank")
    return ranked.withColumn("block", F.floor((F.col("rank") - 1) / block).cast("long"))


def journey_to_date(log: DataFrame, points: DataFrame, owner: str = "user_id", block: int = RANK_BLOCK) -> DataFrame:
    """For ``points`` (owner, ``upto``, more columns): one row per event of the prefix of ``upto`` events, with the point's columns.

    A point asks for its blocks by number, so the join is on (owner, block): a long journey's blocks lie in different tasks, and
    only the last block of a prefix needs the test of the rank."""
    asked = points.where(F.col("upto") > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upto") - 1) / block).cast("long"))))
    return asked.join(log, [owner, "block"]).where(F.col("rank") <= F.col("upto")).drop("block")


def running_journey(df: DataFrame, owner: str = "user_id", order: str = "ts", tie: str = "event_id", last_n: int = 3,
                    block: int = RANK_BLOCK) -> DataFrame:
    """Running counts per owner plus the types of the last ``last_n`` events, for display; the whole journey to
    a date is ``journey_to_date``.

    The last events of a rank block are handed on to the next block, so the types are a window inside (owner, block):
    one shuffle, and no owner in one task."""
    log = journey_log(df, owner, order, tie, block)
    edge = (F.col("rank") - 1) % block >= block - (last_n - 1)
    copies = F.when(edge, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    spread = log.withColumn("_own", F.col("block")).withColumn("block", F.explode(copies))
    w = Window.partitionBy(owner, "block").orderBy("rank")
    before = [F.lag("type", k).over(w) for k in range(last_n - 1, 0, -1)]
    recent = spread.withColumn("recent_types", F.concat_ws(">", *before, "type")).where(F.col("block") == F.col("_own"))
    return recent.withColumnRenamed("rank", "events_to_date").drop("block", "_own")


def _running_by_struct(df: DataFrame, owner: str) -> DataFrame:
    """events_to_date / errors_to_date per owner in (ts, event_id) order via range splitting."""
    from .ordered import running_totals, wallclock_seconds
    keyed = df.withColumn("_key", wallclock_seconds("_ord.ts"))
    # ties on the timestamp are ordered by the tie-break inside each range window
    tot = running_totals(keyed, "_key", ["_one", "_err"], [owner], tie_cols=["_ord"])
    return (tot.withColumnRenamed("cum__one", "events_to_date").withColumnRenamed("cum__err", "errors_to_date")
            .drop("_one", "_err", "_ord", "_key"))
