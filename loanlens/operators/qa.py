"""Template question answering over borrower context records (batch: one row per question).

Routing is substring-based on the lower-cased question (so "does" routes to the action
answer, as in the reference). Borrower context is joined on ``company_id``; a question with
no matching borrower gets the portfolio-level attention answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import contains_any
from .attribution import _num
from .records import actions, linear_drivers


def route(question: Column | str) -> Column:
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    return (F.when(contains_any(q, K.ROUTE_ACTION_WORDS), F.lit("action"))
            .when(contains_any(q, K.ROUTE_TREND_WORDS), F.lit("trend"))
            .otherwise(F.lit("why")))


def money(v: Column) -> Column:
    """Whole currency units with thousands separators."""
    return F.format_number(F.bround(v, 0), 0)


def context(scored: DataFrame, stats: Mapping[str, tuple[float, float]], k: int = K.DRIVERS_ANSWER, key: str = "company_id") -> DataFrame:
    """One context row per borrower: PD, band, EAD, LGD, EL, top-k drivers and the action list, and both as text. Everything
    is nested in the borrower's own row: no join, no shuffle."""
    nested = scored.select(key, "sector", "pd", "band", F.col("outstanding_loan").alias("ead"), "lgd", "expected_loss",
                           linear_drivers(stats, k=k).alias("drivers"), actions("band").alias("actions"))
    return (nested.withColumn("drivers_text", F.array_join(F.transform("drivers", lambda x: x["narrative"]), "; "))
            .withColumn("actions_text", F.nullif(F.array_join(F.transform("actions", lambda x: x["action"]), ", "), F.lit(""))))


NOT_FOUND = "Borrower not found"  # fixed text


def attention_text(top: Sequence) -> str:
    lines = [f"• {r['company_id']} ({r['sector']}) — PD {r['pd_pct']}%, {r['band']}" for r in top]
    return "Borrowers requiring immediate attention (highest PD):\n" + "\n".join(lines)


def answer(questions: DataFrame, ctx: DataFrame, portfolio_text: str, key: str = "company_id",
           text: str = "question") -> DataFrame:
    j = questions.join(ctx.withColumn("_known", F.lit(True)), key, "left")
    none = F.col(key).isNull()  # no borrower was asked for
    unknown = ~none & F.col("_known").isNull()
    cid = F.col(key).cast("string")
    pd_pct = _num(F.col("pd") * 100, 1)
    drivers = F.coalesce(F.nullif(F.col("drivers_text"), F.lit("")), F.lit("no dominant signals"))
    acts = F.coalesce(F.nullif(F.col("actions_text"), F.lit("")), F.lit("Continue standard monitoring"))
    r = route(text)
    action = F.concat(cid, F.lit(" is in the "), F.col("band"), F.lit(" band (PD "), pd_pct,
                      F.lit("%). Recommended interventions: "), acts, F.lit("."))
    trend = F.concat(F.lit("Over the observation window the dominant deteriorating signals for "), cid,
                     F.lit(" are: "), drivers, F.lit(". This drove the PD to "), pd_pct, F.lit("% ("),
                     F.col("band"), F.lit(" risk)."))
    why = F.concat(cid, F.lit(" ("), F.col("sector"), F.lit(") carries a "), pd_pct,
                   F.lit("% probability of default ("), F.col("band"), F.lit(" band). Key drivers: "), drivers,
                   F.lit(". Projected expected loss is ₹"), money(F.col("expected_loss")),
                   F.lit(" (PD × EAD ₹"), money(F.col("ead")), F.lit(" × LGD "), _num(F.col("lgd") * 100, 0),
                   F.lit("%)."))
    body = F.when(none, F.lit(portfolio_text)).when(unknown, F.lit(NOT_FOUND)).when(r == "action", action).when(r == "trend", trend) \
        .otherwise(why)
    return j.select("*", F.when(none, F.lit("portfolio")).when(unknown, F.lit("unknown")).otherwise(r).alias("route"),
                    body.alias("answer")).drop("_known")
