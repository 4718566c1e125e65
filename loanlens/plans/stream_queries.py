"""Registered streaming queries: each runs a Structured Streaming job to completion
(availableNow) over files derived from the driver tables and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.portfolio import round_doubles
from ..sources import tables as TB
from ..streaming import stream as ST
from . import sql_views as S
from .portfolio_queries import V_SCORED, scored
from .registry import register


@register("stream_ingest", S.with_views(V_SCORED, body=f"""
SELECT company_id, sector, round(pd, 6) AS pd, {S.band('pd')} AS band FROM v_scored"""))
def q_stream_ingest(spark, sf):
    """New-loan batches of all segments are scored and appended per micro-batch."""
    batch = scored(spark, sf).select("company_id", "sector", "pd")
    src, sink, ck = ST.scratch(spark, "src"), ST.scratch(spark, "sink"), ST.scratch(spark, "ck")
    ST.stage_files(batch, src, 4, "company_id")
    stream = ST.read_stream(spark, src, batch.schema, max_files=2)
    q = ST.append_batches(stream, sink, ck, lambda b: b.withColumn("band", ST.risk_band("pd")))
    q.awaitTermination()
    return round_doubles(spark.read.parquet(sink).select("company_id", "sector", "pd", "band"))


@register("stream_band_counts", S.with_views(V_SCORED, body="""
SELECT band, count(*) AS borrowers FROM v_scored WHERE band IS NOT NULL GROUP BY band"""))
def q_stream_band_counts(spark, sf):
    """Band counts that follow appends: complete-mode streaming aggregate over portfolio files."""
    s = scored(spark, sf).select("company_id", "pd")
    src, out, ck = ST.scratch(spark, "src"), ST.scratch(spark, "out"), ST.scratch(spark, "ck")
    ST.stage_files(s, src, 4, "company_id")
    counts = ST.band_counts(ST.read_stream(spark, src, s.schema, max_files=1)).where(F.col("band").isNotNull())
    ST.run_to_table(counts, "complete", out, ck)
    return spark.read.parquet(out)


@register("stream_event_windows", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def q_stream_event_windows(spark, sf):
    """Daily event counts per type with a one-day watermark, events arriving in time order."""
    ev = TB.read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    src, out, ck = ST.scratch(spark, "src"), ST.scratch(spark, "out"), ST.scratch(spark, "ck")
    ST.replay(ev, src, 4, "ts", lambda stream: ST.run_updates(ST.windowed_event_counts(stream), out, ck))
    undated, ck = ST.scratch(spark, "out"), ST.scratch(spark, "ck")
    ST.run_updates(ST.undated_event_counts(ST.read_stream(spark, src, ev.schema, max_files=None)), undated, ck)
    keys = ["day", "event_type"]
    return ST.latest(spark, out, keys, "n").unionByName(ST.latest(spark, undated, keys, "n"))


@register("stream_dedup", """
SELECT DISTINCT event_id, ts, user_id, event_type FROM events""")
def q_stream_dedup(spark, sf):
    """Redelivered events (the same event id twice) are dropped within the watermark."""
    ev = TB.read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    src, sink, ck = ST.scratch(spark, "src"), ST.scratch(spark, "sink"), ST.scratch(spark, "ck")
    # every event arrives twice, its second copy ten minutes after the first
    twice = (ev.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("_k", ST.wallclock_seconds("ts") + F.col("_again") * 600))
    ST.replay(twice, src, 6, "_k", lambda stream: ST.append_batches(
        ST.dedup_redelivery(stream, "event_id", "ts", "2 hours"), sink, ck, lambda b: b).awaitTermination())
    return spark.read.parquet(sink).select("event_id", "ts", "user_id", "event_type")


BOARD = 5


@register("stream_board", S.with_views(V_SCORED, body=f"""
SELECT sector, CAST(rank AS INT) AS rank, company_id, round(margin, 6) AS margin FROM (
  SELECT sector, company_id, margin, row_number() OVER (PARTITION BY sector ORDER BY round(margin, 9) DESC, company_id) AS rank FROM v_scored
  WHERE sector IS NOT NULL AND margin IS NOT NULL) WHERE rank <= {BOARD}"""))
def q_stream_board(spark, sf):
    """New loans ordered by PD: they arrive in batches, and a board in the stream's state keeps the riskiest five of each sector (by
    log-odds, which order like the PD)."""
    new = scored(spark, sf).select("company_id", "sector", F.round("margin", 9).alias("margin")).where(F.col("sector").isNotNull())
    src, out, ck = ST.scratch(spark, "src"), ST.scratch(spark, "out"), ST.scratch(spark, "ck")
    ST.stage_files(new, src, 4, "company_id")
    ST.run_updates(ST.top_board(ST.read_stream(spark, src, new.schema, max_files=1), "sector", "company_id", "margin", BOARD), out, ck)
    return round_doubles(ST.latest_boards(spark, out, "sector").select("sector", "rank", "company_id", "margin"))
