"""Registered journey queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import journey as J
from ..operators.ordered import checkpointed
from ..sources import tables as TB
from .registry import register

JV = """WITH jv AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS date, event_type AS type, props AS "desc" FROM events)
"""


def journey(spark, sf):
    return J.journey_view(TB.read_table(spark, sf, "events", ["event_id", "user_id", "ts", "event_type", "props"]))


@register("journey_parse", JV + """
SELECT event_id, date, type, "desc", CAST(json_extract(CAST("desc" AS JSON), '$.k') AS INTEGER) AS k FROM jv""")
def q_journey_parse(spark, sf):
    j = J.serialise(journey(spark, sf))
    parsed = j.withColumn("e", F.from_json("event_json", J.EVENT))
    props = F.from_json(F.col("desc"), T.StructType([T.StructField("k", T.IntegerType())]))
    return parsed.select("event_id", F.col("e.date").alias("date"), F.col("e.type").alias("type"),
                         F.col("e.desc").alias("desc"), props["k"].alias("k"))


@register("journey_dedup", JV + """
SELECT user_id, event_id, date, type, "desc" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, date, "desc" ORDER BY ts, event_id) AS rn FROM jv) WHERE rn = 1""")
def q_journey_dedup(spark, sf):
    return J.dedup_first(journey(spark, sf)).select("user_id", "event_id", "date", "type", "desc")


@register("running_journey", JV + """
SELECT user_id, event_id,
       count(*) OVER w AS events_to_date,
       count(*) FILTER (WHERE type = 'error') OVER w AS errors_to_date,
       array_to_string(list(type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '>') AS recent_types
FROM jv WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_journey(spark, sf):
    return J.running_journey(journey(spark, sf)).select("user_id", "event_id", "events_to_date", "errors_to_date",
                                                        "recent_types")


_LOG = JV + """, log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, CAST((dayofmonth(date) - 1) // 7 AS INT) AS week FROM jv)
"""


@register("journey_to_date", _LOG + """, points AS (SELECT user_id, week, max(rank) AS upto FROM log GROUP BY ALL)
SELECT p.user_id, p.week, p.upto, l.rank, l.event_id, l.date, l.type, l."desc" FROM points p JOIN log l ON l.user_id = p.user_id AND l.rank <= p.upto""")
def q_journey_to_date(spark, sf):
    """The whole journey of every user at the end of each week with events: all events to date, in order."""
    log = checkpointed(J.journey_log(journey(spark, sf)))
    week = F.floor((F.dayofmonth("date") - 1) / 7).cast("int")
    points = log.groupBy("user_id", week.alias("week")).agg(F.max("rank").alias("upto"))
    return J.journey_to_date(log, points).select("user_id", "week", "upto", "rank", "event_id", "date", "type", "desc")


@register("journey_text", JV + """
, txt AS (SELECT user_id, event_id, date, type, "desc", CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '[{' || "desc" ELSE 'ok' END AS bad FROM jv)
SELECT user_id, event_id, CASE WHEN bad = 'ok' THEN 1 ELSE 0 END AS n_events, CASE WHEN bad = 'ok' THEN date END AS date, CASE WHEN bad = 'ok' THEN type END AS type FROM txt""")
def q_journey_text(spark, sf):
    """Journeys kept as JSON text, some rows null and some cut off: a malformed journey is an empty one."""
    j = journey(spark, sf)
    good = F.to_json(F.array(F.struct("date", "type", "desc")))
    text = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("[{"), F.col("desc"))).otherwise(good)
    parsed = j.withColumn("journey", text).withColumn("events", J.parse_events("journey"))
    return parsed.select("user_id", "event_id", F.size("events").alias("n_events"), F.get("events", F.lit(0))["date"].alias("date"), F.get("events", F.lit(0))["type"].alias("type"))
