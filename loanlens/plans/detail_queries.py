"""Registered borrower-detail queries: attribution, drivers, narratives, trajectories,
migration, risk-factor groups, context records and template answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import flag, grade_decode, grade_encode, risk_band, risk_score, title_case
from ..operators import attribution as AT
from ..operators import consumer as CO
from ..operators import features as FE
from ..operators import journey as J
from ..operators import portfolio as P
from ..operators import qa as QA
from ..operators import records as RC
from ..operators import trajectory as TR
from ..operators.portfolio import round_doubles
from ..operators.scorecard import margin
from ..functions.scalars import sigmoid
from ..session import default_parallelism, literal_broadcast, literal_table
from ..sources import tables as TB
from ..sources import views as V
from . import sql_views as S
from .consumer_queries import _STRESS, consumer, scorer, stressed
from .journey_queries import journey
from .portfolio_queries import V_SCORED, scored
from .registry import register


# ---------------------------------------------------------------- SQL helpers ----------
def num_sql(v: str, places: int) -> str:
    return (f"CAST(CAST(round_even(CAST(CAST(({v}) AS VARCHAR) AS DECIMAL(38,18)), {places}) "
            f"AS DECIMAL(18,{places})) AS VARCHAR)")


def money_sql(v: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST(CAST(({v}) AS VARCHAR) AS DECIMAL(38,18)), 0) AS HUGEINT))"


def narrative_sql(f: str, v: str, rules=K.NARRATIVES_MSME, places: int = 3) -> str:
    whens = []
    for name, (template, tiers, other) in rules.items():
        tier = None
        if tiers:
            conds = " ".join(f"WHEN ({v}) {'=' if op == '==' else op} {b} THEN '{w}'" for op, b, w in tiers)
            tier = f"(CASE WHEN ({v}) IS NULL THEN NULL {conds} ELSE '{other}' END)"
        parts, rest = [], template
        while rest:
            i = rest.find("{")
            if i < 0:
                parts.append("'" + rest.replace("'", "''") + "'")
                break
            if i:
                parts.append("'" + rest[:i].replace("'", "''") + "'")
            j = rest.index("}", i)
            tok = rest[i + 1:j]
            parts.append({"pct": num_sql(f"{v} * 100", 0), "v0": num_sql(v, 0), "v1": num_sql(v, 1), "v2": num_sql(v, 2), "money": money_sql(v),
                          "grade": f"coalesce(chr(CASE WHEN round_even({v}, 0) BETWEEN 1 AND 7 THEN CAST(64 + round_even({v}, 0) AS INT) END), '?')",
                          "int": f"CAST(CAST(trunc({v}) AS BIGINT) AS VARCHAR)", "tier": tier}[tok])
            rest = rest[j + 1:]
        whens.append(f"WHEN '{name}' THEN {' || '.join(parts)}")
    return f"(CASE {f} {' '.join(whens)} ELSE {f} || ': ' || {num_sql(v, places)} END)"


def _case_map(col: str, mapping: dict) -> str:
    return "(CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END)"


FEATS = K.MSME_FEATURES
ATTR = V_SCORED + f""",
att_long AS (
  SELECT company_id, feature, value FROM (SELECT company_id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATS)} FROM v_borrower)
  UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(FEATS)}))),
att AS (
  SELECT a.company_id, a.feature, a.value,
         {_case_map('a.feature', K.SCORECARD_WEIGHTS)} *
         ((a.value - (CASE a.feature {" ".join(f"WHEN '{f}' THEN z.m_{f}" for f in FEATS)} END))
          / ((CASE a.feature {" ".join(f"WHEN '{f}' THEN z.s_{f}" for f in FEATS)} END) + {K.ZSCORE_EPS})) AS impact
  FROM att_long a CROSS JOIN bz z),
drv AS (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY round(abs(impact), 12) DESC, feature ASC) AS rank FROM att),
acts AS (
  SELECT s.company_id, l.seq, l.action FROM v_scored s
  JOIN (VALUES {", ".join("('{}', {}, '{}')".format(b, i + 1, a) for b, acts in K.ACTION_LADDER_MSME.items() for i, (_, a, _d) in enumerate(acts))}) AS l(band, seq, action)
    ON s.band = l.band)"""


def dsql(body: str, *extra: str) -> str:
    return S.with_views(ATTR, *extra, body=body)


def attribution(spark, sf):
    return AT.linear_attribution(V.borrowers(spark, sf), V.borrower_stats(spark, sf))


# ---------------------------------------------------------------- attribution ----------
@register("linear_attribution", dsql("""
SELECT company_id, feature, round(value, 8) AS value, round(impact, 6) AS impact FROM att"""))
def q_linear_attribution(spark, sf):
    return round_doubles(attribution(spark, sf), 6, {"value": 8})


@register("top_drivers", dsql("""
SELECT company_id, rank, feature, round(impact, 6) AS impact FROM drv WHERE rank <= 8"""))
def q_top_drivers(spark, sf):
    return round_doubles(AT.top_drivers(attribution(spark, sf), K.DRIVERS_EXPLAIN)
                         .select("company_id", "rank", "feature", "impact"))


@register("global_importance", dsql("""
SELECT feature, round(avg(abs(impact)), 6) AS mean_abs_impact FROM att GROUP BY feature"""))
def q_global_importance(spark, sf):
    return round_doubles(AT.global_importance(attribution(spark, sf)))


@register("importance_head", dsql("""
SELECT feature, round(m, 6) AS mean_abs_impact, CAST(rank AS INT) AS rank FROM (
  SELECT feature, m, row_number() OVER (ORDER BY round(m, 9) DESC, feature) AS rank FROM (SELECT feature, avg(abs(impact)) AS m FROM att GROUP BY feature)) WHERE rank <= 8"""))
def q_importance_head(spark, sf):
    """The eight features of largest mean absolute impact, in order."""
    head = AT.importance_head(AT.global_importance(attribution(spark, sf)), 8)
    return round_doubles(head.select("feature", "mean_abs_impact", "rank"))


@register("driver_narratives", dsql(f"""
SELECT company_id, rank, feature, {narrative_sql('feature', 'value')} AS narrative FROM drv WHERE rank <= 8"""))
def q_driver_narratives(spark, sf):
    top = AT.top_drivers(attribution(spark, sf), K.DRIVERS_EXPLAIN)
    return top.select("company_id", "rank", "feature", AT.narrative("feature", "value").alias("narrative"))


# ---------------------------------------------------------------- trajectories ---------
def _traj_sql() -> str:
    u = S.clip("b.revolving_utilization * (0.5 + 0.5 * s)", 0.01, 0.99)
    g = S.clip("b.gst_compliance_score * (1.1 - 0.2 * s)", 0.0, 1.0)
    h = S.clip("b.payment_history_score * (1.05 - 0.15 * s)", 0.0, 1.0)
    c = "(b.cashflow_stress_ratio * (0.6 + 0.6 * s))"
    sub = {"revolving_utilization": u, "gst_compliance_score": g, "payment_history_score": h,
           "cashflow_stress_ratio": c}
    terms = [f"({w}) * (({sub.get(f, 'b.' + f)} - z.m_{f}) / (z.s_{f} + {K.ZSCORE_EPS}))"
             for f, w in K.SCORECARD_WEIGHTS.items()]
    m = " + ".join(terms) + f" + ({K.FIXTURE_INTERCEPT})"
    months = "[" + ", ".join(f"'{x}'" for x in K.SCENARIO_MONTHS) + "]"
    return f"""
traj AS (
  SELECT company_id, month_idx, {months}[month_idx + 1] AS month, {S.sigmoid(m)} AS pd
  FROM (SELECT b.*, r.month_idx, r.month_idx / 11.0 AS s FROM v_borrower b CROSS JOIN range(12) AS r(month_idx)) b
  CROSS JOIN bz z)"""


def msme_trajectory(spark, sf):
    stats = V.borrower_stats(spark, sf)
    sc = TR.msme_scenarios(V.borrowers(spark, sf))
    return TR.trajectory(sc, lambda: sigmoid(margin(stats, K.SCORECARD_WEIGHTS, K.FIXTURE_INTERCEPT)))


@register("pd_trajectory_panel", dsql(f"""
SELECT company_id, month_idx, month, round(pd, 6) AS pd, {S.band('pd')} AS band FROM traj""", _traj_sql()))
def q_pd_trajectory_panel(spark, sf):
    t = msme_trajectory(spark, sf).withColumn("band", risk_band("pd"))
    return round_doubles(t.withColumn("month_idx", F.col("month_idx").cast("long")))


@register("risk_migration", dsql(f"""
SELECT s.company_id, {S.band('t.pd')} AS start_band, s.band AS end_band,
       {S.band('t.pd')} <> s.band AS migrated
FROM v_scored s JOIN traj t ON s.company_id = t.company_id AND t.month_idx = 0""", _traj_sql()))
def q_risk_migration(spark, sf):
    t = msme_trajectory(spark, sf).withColumn("band", risk_band("pd"))
    return TR.migration(t, V.borrowers(spark, sf)).select("company_id", "start_band", "end_band", "migrated")


def _consumer_traj_sql() -> str:
    rate = S.clip("loan_int_rate * (0.95 + 0.18 * s)", None, 24.0)
    burden = S.clip("loan_percent_income * (0.9 + 0.4 * s)", None, 0.83)
    tenure = S.clip("person_emp_length * (1 - 0.1 * s)", 0.0, None)
    return f"""
ctraj AS (
  SELECT loan_id, month_idx, {rate} AS loan_int_rate, {burden} AS loan_percent_income, {tenure} AS person_emp_length,
         (ascii(loan_grade) - 64) AS g, CAST(coalesce(cb_person_default_on_file = 'Y', false) AS INTEGER) AS f
  FROM (SELECT a.*, r.month_idx, r.month_idx / 11.0 AS s FROM v_applications a CROSS JOIN range(12) AS r(month_idx)))"""


@register("pd_trajectory", S.with_views(S.V_APPLICATIONS, _consumer_traj_sql(), body=f"""
SELECT loan_id, month_idx, round(loan_int_rate, 6) AS loan_int_rate, round(loan_percent_income, 6) AS loan_percent_income,
       round(person_emp_length, 6) AS person_emp_length,
       round({S.clip('0.30 * g / 7.0 + 0.30 * least(loan_percent_income / 0.5, 1.0) + 0.25 * (loan_int_rate - 7) / 15.0 + 0.15 * f', 0.0, 1.0)}, 6) AS pd
FROM ctraj"""))
def q_pd_trajectory(spark, sf):
    a = V.applications(spark, sf).select("loan_id", "loan_int_rate", "loan_percent_income", "person_emp_length",
                                         grade_encode("loan_grade").alias("loan_grade_ord"),
                                         flag("cb_person_default_on_file").alias("default_flag"))
    sc = TR.consumer_scenarios(a)
    out = sc.select("loan_id", F.col("month_idx").cast("long").alias("month_idx"), "loan_int_rate",
                    "loan_percent_income", "person_emp_length", FE.risk_proxy_consumer().alias("pd"))
    return round_doubles(out)


@register("risk_factor_groups", S.with_views(S.V_APPLICATIONS, _STRESS, body=f"""
SELECT loan_id, grp AS factor_group, feature, round(value, 6) AS value, {narrative_sql('feature', 'value', K.NARRATIVES_FACTORS, 2)} AS narrative FROM (
  SELECT * FROM (SELECT loan_id,
                  CAST(CAST(coalesce(cb_person_default_on_file = 'Y', false) AS INTEGER) AS DOUBLE) AS default_flag,
                  CAST(cb_person_cred_hist_length AS DOUBLE) AS cb_person_cred_hist_length,
                  CAST(ascii(loan_grade) - 64 AS DOUBLE) AS loan_grade_ord,
                  loan_percent_income, loan_int_rate, loan_amnt,
                  CAST(person_age AS DOUBLE) AS person_age, person_income, person_emp_length,
                  CAST(coalesce(stress_index, 0.5) AS DOUBLE) AS note_stress_index
           FROM v_applications LEFT JOIN cx ON v_applications.company_id = cx.doc_id) src
  UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(f for fs in K.RISK_FACTOR_GROUPS_CONSUMER.values() for f in fs)}))) u
JOIN (VALUES {", ".join(f"('{g}', '{f}')" for g, fs in K.RISK_FACTOR_GROUPS_CONSUMER.items() for f in fs)}) AS m(grp, feat)
  ON u.feature = m.feat"""))
def q_risk_factor_groups(spark, sf):
    """Risk factors of every application by group, each with its sentence; the text factor is the stress index of the
    applicant's note (0.5 without one)."""
    groups = [(g, f) for g, fs in K.RISK_FACTOR_GROUPS_CONSUMER.items() for f in fs]
    a = consumer(spark, sf).select("loan_id", *[F.col(f).cast("double").alias(f) for _, f in groups])
    dim = literal_table(spark, groups, ["factor_group", "feature"])
    long = a.unpivot(["loan_id"], [f for _, f in groups], "feature", "value")
    # the group map is a fixed literal table (10 rows): broadcast by construction
    told = long.join(literal_broadcast(dim), "feature").withColumn("narrative", AT.narrative("feature", "value", K.NARRATIVES_FACTORS, 2))
    return round_doubles(told.select("loan_id", "factor_group", "feature", "value", "narrative"))


# ---------------------------------------------------------------- context / detail -----
def _context(spark, sf, k, only=None):
    """Context records; ``only`` (a frame of company ids) restricts the work to those borrowers with a semi join,
    so answering a few questions does not explain the whole portfolio."""
    s = scored(spark, sf)
    if only is not None:
        s = s.join(only, "company_id", "left_semi")
    return QA.context(s, V.borrower_stats(spark, sf), k)


def _notes(spark, sf):
    """Officer notes by company: text and stress index."""
    return stressed(spark, sf).select(F.col("doc_id").alias("company_id"), "text", "stress_index")


CTX = """
ctx AS (
  SELECT s.company_id, s.sector, s.pd, s.band, s.outstanding_loan AS ead, s.lgd, s.expected_loss,
         (SELECT string_agg(n.narrative, '; ' ORDER BY n.rank) FROM nar n WHERE n.company_id = s.company_id AND n.rank <= {k}) AS drivers_text,
         (SELECT string_agg(a.action, ', ' ORDER BY a.seq) FROM acts a WHERE a.company_id = s.company_id) AS actions_text
  FROM v_scored s)"""


def _nar() -> str:
    return f"nar AS (SELECT company_id, rank, {narrative_sql('feature', 'value')} AS narrative FROM drv)"


_NOTE = """
note AS (SELECT d.doc_id AS company_id, coalesce(d.text, '') AS officer_notes, cx.stress_index FROM documents d JOIN cx ON d.doc_id = cx.doc_id)"""


@register("borrower_context", dsql(f"""
SELECT ctx.company_id, sector, round(pd, 6) AS pd, band, round(ead, 2) AS ead, lgd, round(expected_loss, 2) AS expected_loss,
       drivers_text, actions_text,
       (SELECT string_agg(feature || ' ' || {num_sql('impact', 6)}, '; ' ORDER BY rank) FROM drv WHERE drv.company_id = ctx.company_id AND rank <= {K.DRIVERS_CONTEXT}) AS impacts_text,
       coalesce(note.officer_notes, '') AS officer_notes, round(note.stress_index, 6) AS note_stress_index
FROM ctx LEFT JOIN note USING (company_id)""", _nar(), CTX.format(k=K.DRIVERS_CONTEXT), _STRESS, _NOTE))
def q_borrower_context(spark, sf):
    """Context record: scores, drivers with impacts and sentences, actions, the officer's note and its stress index."""
    c = RC.gather(_context(spark, sf, K.DRIVERS_CONTEXT), {"note": _notes(spark, sf)}, "company_id")
    c = c.withColumn("note", F.get("note", F.lit(0)))
    impacts = F.transform("drivers", lambda x: F.concat(x["feature"], F.lit(" "), AT._num(x["impact"], 6)))
    out = c.select("company_id", "sector", "pd", "band", "ead", "lgd", "expected_loss", "drivers_text", "actions_text", F.array_join(impacts, "; ").alias("impacts_text"),
                   F.coalesce("note.text", F.lit("")).alias("officer_notes"), F.col("note.stress_index").alias("note_stress_index"))
    return round_doubles(out, 6, {"ead": 2, "expected_loss": 2})


def detail(spark, sf):
    """Full record of every borrower: one tagged union of scenario months, events and notes, grouped once."""
    features = V.borrowers(spark, sf)
    base = (scored(spark, sf).withColumn("raw_features", RC.feature_values(FEATS)).withColumn("action_ladder", RC.actions("band"))
            .select("company_id", "sector", "loan_type", "outstanding_loan", "lgd", "expected_loss", "potential_recovery", "pd", "risk_score", "band",
                    "raw_features", "action_ladder"))
    months = TR.trajectory(TR.msme_scenarios(features), lambda: sigmoid(margin(V.borrower_stats(spark, sf), K.SCORECARD_WEIGHTS, K.FIXTURE_INTERCEPT)))
    events = J.dedup_first(journey(spark, sf))
    shown = RC.latest_rows(events, "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("company_id"), "ts", "event_id", "date", "type", "desc")
    counts = events.groupBy(F.col("user_id").alias("company_id")).agg(F.count(F.lit(1)).alias("n"))
    return RC.gather(base, {"timeline": months.select("company_id", "month_idx", "month", "pd", "band"), "journey_events": shown, "n_events": counts,
                            "note": _notes(spark, sf)}, "company_id")


_DETAIL = f"""
jv AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS date, event_type AS type, props AS "desc" FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), props ORDER BY ts, event_id) = 1),
jn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM jv),
jt AS (SELECT user_id AS company_id, max(n) AS n_events, string_agg(CASE WHEN back <= {RC.SHOWN} THEN strftime(date, '%Y-%m-%d') || ' ' || type || ' ' || "desc" END, '; ' ORDER BY ts, event_id) AS journey
       FROM jn GROUP BY 1),
tl AS (SELECT company_id, string_agg(month || ' ' || coalesce({num_sql('pd', 6)}, 'unknown'), '; ' ORDER BY month_idx) AS timeline FROM traj GROUP BY 1),
rf AS (SELECT company_id, string_agg(feature || '=' || coalesce({num_sql('value', 9)}, 'null'), '; ' ORDER BY list_position([{", ".join(f"'{f}'" for f in FEATS)}], feature)) AS raw FROM att_long GROUP BY 1),
al AS (SELECT band, string_agg(priority || '|' || action || '|' || detail, '; ' ORDER BY seq) AS ladder
       FROM (VALUES {", ".join("('{}', {}, '{}', '{}', '{}')".format(b, i + 1, p, a, d) for b, acts in K.ACTION_LADDER_MSME.items() for i, (p, a, d) in enumerate(acts))}) AS l(band, seq, priority, action, detail)
       GROUP BY 1)"""


@register("borrower_detail", dsql(f"""
SELECT s.company_id, s.sector, s.loan_type, round(s.outstanding_loan, 2) AS outstanding_loan, s.lgd AS lgd_pct,
       round(s.expected_loss, 2) AS expected_loss, round(s.potential_recovery, 2) AS potential_recovery,
       round(s.pd, 6) AS current_pd, s.risk_score, s.band AS risk_band, {S.band('t.pd')} AS start_band, s.band AS end_band,
       (SELECT count(*) FROM acts a WHERE a.company_id = s.company_id) AS n_actions,
       tl.timeline, coalesce(jt.journey, '') AS journey_events, coalesce(jt.n_events, 0) AS n_events, coalesce(note.officer_notes, '') AS officer_notes,
       round(note.stress_index, 6) AS note_stress_index, rf.raw AS raw_features, coalesce(al.ladder, '') AS action_ladder
FROM v_scored s JOIN traj t ON s.company_id = t.company_id AND t.month_idx = 0 JOIN tl ON tl.company_id = s.company_id JOIN rf ON rf.company_id = s.company_id
LEFT JOIN jt ON jt.company_id = s.company_id LEFT JOIN note ON note.company_id = s.company_id LEFT JOIN al ON al.band = s.band""", _traj_sql(), _STRESS, _NOTE, _DETAIL))
def q_borrower_detail(spark, sf):
    """Full record of every borrower; the nested arrays of ``detail`` are written out as text."""
    d = detail(spark, sf)
    join = lambda c, f: F.array_join(F.transform(c, f), "; ")
    out = d.select(
        "company_id", "sector", "loan_type", "outstanding_loan", F.col("lgd").alias("lgd_pct"), "expected_loss", "potential_recovery", F.col("pd").alias("current_pd"),
        "risk_score", F.col("band").alias("risk_band"), F.get("timeline", F.lit(0))["band"].alias("start_band"), F.col("band").alias("end_band"),
        F.size("action_ladder").cast("long").alias("n_actions"),
        join("timeline", lambda x: F.concat(x["month"], F.lit(" "), F.coalesce(AT._num(x["pd"], 6), F.lit("unknown")))).alias("timeline"),
        join("journey_events", lambda x: F.concat(x["date"].cast("string"), F.lit(" "), x["type"], F.lit(" "), x["desc"])).alias("journey_events"),
        F.coalesce(F.get("n_events", F.lit(0))["n"], F.lit(0)).alias("n_events"), F.coalesce(F.get("note", F.lit(0))["text"], F.lit("")).alias("officer_notes"),
        F.get("note", F.lit(0))["stress_index"].alias("note_stress_index"),
        join("raw_features", lambda x: F.concat(x["feature"], F.lit("="), F.coalesce(AT._num(x["value"], 9), F.lit("null")))).alias("raw_features"),
        join("action_ladder", lambda x: F.concat_ws("|", x["priority"], x["action"], x["detail"])).alias("action_ladder"))
    return round_doubles(out, 6, {"outstanding_loan": 2, "expected_loss": 2, "potential_recovery": 2})


# ---------------------------------------------------------------- consumer record ------
FACTORS = [(g, f) for g, fs in K.RISK_FACTOR_GROUPS_CONSUMER.items() for f in fs]
RAW = [*CO.NUMERIC, CO.TEXT]


def consumer_detail(spark, sf):
    """Full record of every application, scored by the trained model: loss, bands, twelve scenario months, note, risk factors by
    group with sentences, raw features, actions. Months come in one grouped pass, twelve as one row; it moves raw values, the
    rest is nested in place afterwards. A note is moved once an applicant, not once an application: the records join it last."""
    model, rows = scorer(spark, sf), consumer(spark, sf)
    values = [(g, f, F.col(f).cast("double")) for g, f in FACTORS]
    factors = F.array(*[F.struct(F.lit(g).alias("factor_group"), F.lit(f).alias("feature"), v.alias("value"),
                                 AT.narrative(F.lit(f), v, {f: K.NARRATIVES_FACTORS[f]}, 2).alias("narrative")) for g, f, v in values])
    raw = dict.fromkeys([*RAW, *[f for _, f in FACTORS], "loan_intent"])
    base = model.score(rows).select("loan_id", "company_id", "pd", *raw)
    months = TR.folded(model.score(TR.consumer_scenarios(rows)).select("loan_id", "month_idx", "pd"), "loan_id", "part").select("loan_id", "part")
    held = (_notes(spark, sf).select("company_id", "text").join(rows.select("company_id").distinct(), "company_id", "left_semi")
            .groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("text"))).alias("held")))
    # an id that several applicants share has the notes of all of them
    loan = Window.partitionBy("loan_id")
    shared = (rows.select("loan_id", "company_id", F.min("company_id").over(loan).alias("lo"), F.max("company_id").over(loan).alias("hi"))
              .where("lo < hi").select("loan_id", "company_id"))
    notes = shared.join(held, "company_id").select("loan_id", F.inline("held"))
    found = RC.gather(base, {"parts": months, "note": notes}, "loan_id", {"owners": "company_id"}, default_parallelism(spark))
    owner = F.when(F.array_min("owners") == F.array_max("owners"), F.get("owners", F.lit(0)))
    # two plain arrays take a third of the room of structs
    turn, pds = (F.flatten(F.transform("parts", f)) for f in (lambda x: x["part"]["month_idx"], lambda x: x["part"]["pd"]))
    found = found.select("loan_id", "company_id", "pd", *raw, turn.cast("array<tinyint>").alias("turn"), pds.alias("pds"), "note", owner.alias("owner"), F.size("owners").alias("times"))
    found = found.join(held.withColumnRenamed("company_id", "owner"), "owner", "left")
    note = F.when(F.col("owner").isNull(), F.col("note")).otherwise(F.coalesce(F.array_sort(F.flatten(F.array_repeat("held", F.col("times")))), F.col("note")))
    month = F.array(*[F.lit(m) for m in K.SCENARIO_MONTHS])
    turns = F.array_sort(F.zip_with("turn", "pds", lambda i, p: F.struct(i.cast("int").alias("month_idx"), p.alias("pd"))))
    timeline = F.transform(turns, lambda x: F.struct(x["month_idx"].alias("month_idx"), F.element_at(month, x["month_idx"] + 1).alias("month"),
                                                     x["pd"].alias("pd"), risk_band(x["pd"]).alias("band")))
    s = P.with_lgd(found.withColumn("band", risk_band("pd")), "loan_intent", K.LGD_CONSUMER, K.LGD_CONSUMER_DEFAULT)
    s = P.with_expected_loss(s.withColumn("outstanding_loan", F.col("loan_amnt") * K.CONSUMER_EXPOSURE_SCALE))
    return s.select("loan_id", "company_id", title_case("loan_intent").alias("sector"), grade_decode("loan_grade_ord").alias("loan_type"), "outstanding_loan", "lgd",
                    "expected_loss", "potential_recovery", "pd", risk_score("pd").alias("risk_score"), "band", CO.TEXT, factors.alias("risk_factors"),
                    RC.feature_values(RAW).alias("raw_features"), RC.actions("band", K.ACTION_LADDER_CONSUMER).alias("action_ladder"),
                    timeline.alias("timeline"), note.alias("note"))


@register("consumer_record", S.with_views(S.V_APPLICATIONS, _STRESS, _NOTE, f"""
cr AS (SELECT a.*, CAST(ascii(loan_grade) - 64 AS DOUBLE) AS loan_grade_ord, CAST(CAST(coalesce(cb_person_default_on_file = 'Y', false) AS INT) AS DOUBLE) AS default_flag,
              coalesce(note.stress_index, 0.5) AS note_stress_index, note.officer_notes
       FROM v_applications a LEFT JOIN note USING (company_id))""", body=f"""
SELECT loan_id, {S.title_case('loan_intent')} AS sector, 'Grade ' || coalesce(loan_grade, '?') AS loan_type, round(loan_amnt * 100, 2) AS outstanding_loan,
       CAST({K.LGD_CONSUMER_DEFAULT} AS DOUBLE) AS lgd_pct, true AS losses_fit, true AS migration_fits, true AS actions_fit,
       {"'" + ", ".join(K.SCENARIO_MONTHS) + "'"} AS months, coalesce(officer_notes, '') AS officer_notes, round(note_stress_index, 6) AS note_stress_index,
       {" || '; ' || ".join(f"'{f}=' || coalesce({num_sql(f'CAST({f} AS DOUBLE)', 9)}, 'null')" for f in RAW)} AS raw_features,
       {" || '; ' || ".join(f"'{g}: ' || coalesce({narrative_sql(repr(f), f'CAST({f} AS DOUBLE)', {f: K.NARRATIVES_FACTORS[f]}, 2)}, 'unknown')" for g, f in FACTORS)} AS risk_factors
FROM cr"""))
def q_consumer_record(spark, sf):
    """Record of every application. What depends on the trained PD is stated as facts: losses are PD x exposure x LGD, the
    migration goes from the first month's band to the current one, actions are those of the band."""
    d = consumer_detail(spark, sf)
    loss = F.col("pd") * F.col("outstanding_loan") * F.col("lgd")
    steps = F.create_map(*[x for b, a in K.ACTION_LADDER_CONSUMER.items() for x in (F.lit(b), F.lit(len(a)))])
    join = lambda c, f: F.array_join(F.transform(c, f), "; ")
    out = d.select(
        "loan_id", "sector", "loan_type", "outstanding_loan", F.col("lgd").alias("lgd_pct"),
        ((F.abs(F.col("expected_loss") - loss) < 1e-6) & (F.abs(F.col("potential_recovery") + loss - F.col("outstanding_loan")) < 1e-6)).alias("losses_fit"),
        ((F.get("timeline", F.lit(0))["band"] == risk_band(F.get("timeline", F.lit(0))["pd"])) & (F.col("band") == risk_band("pd"))).alias("migration_fits"),
        (F.size("action_ladder") == F.try_element_at(steps, F.col("band"))).alias("actions_fit"),
        F.array_join(F.transform("timeline", lambda x: x["month"]), ", ").alias("months"), F.coalesce(F.get("note", F.lit(0))["text"], F.lit("")).alias("officer_notes"),
        F.col(CO.TEXT), join("raw_features", lambda x: F.concat(x["feature"], F.lit("="), F.coalesce(AT._num(x["value"], 9), F.lit("null")))).alias("raw_features"),
        join("risk_factors", lambda x: F.concat(x["factor_group"], F.lit(": "), F.coalesce(x["narrative"], F.lit("unknown")))).alias("risk_factors"))
    return round_doubles(out, 6, {"outstanding_loan": 2})


# ---------------------------------------------------------------- questions ------------
def _route_sql(q: str) -> str:
    a = " OR ".join(f"contains(lower({q}), '{w}')" for w in K.ROUTE_ACTION_WORDS)
    t = " OR ".join(f"contains(lower({q}), '{w}')" for w in K.ROUTE_TREND_WORDS)
    return f"(CASE WHEN {a} THEN 'action' WHEN {t} THEN 'trend' ELSE 'why' END)"


def questions(spark, sf):
    conv = TB.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("conv_id").alias("company_id"),
                                                      F.col("text").alias("question"))


@register("question_routing", f"""
SELECT conv_id, turn, {_route_sql('text')} AS route FROM conversations WHERE role = 'user'""")
def q_question_routing(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", QA.route("question").alias("route"))


_PCT1 = num_sql("pd * 100", 1)
_DRV = "coalesce(nullif(drivers_text, ''), 'no dominant signals')"
_ACT = "coalesce(nullif(actions_text, ''), 'Continue standard monitoring')"
_ANSWER = f"""
qs AS (SELECT conv_id, turn, conv_id AS company_id, text AS question FROM conversations WHERE role = 'user'),
att5 AS (SELECT company_id, sector, v_scored.margin AS raw, {num_sql('round(pd, 6) * 100', 1)} AS p, band FROM v_scored ORDER BY v_scored.margin DESC NULLS LAST, company_id LIMIT 5),
ptxt AS (SELECT 'Borrowers requiring immediate attention (highest PD):' || chr(10) ||
                string_agg('• ' || company_id || ' (' || sector || ') — PD ' || p || '%, ' || band, chr(10) ORDER BY rn) AS t
         FROM (SELECT *, row_number() OVER (ORDER BY raw DESC NULLS LAST, company_id) AS rn FROM att5))"""


@register("answer_questions", dsql(f"""
SELECT q.conv_id, q.turn, q.company_id,
       CASE WHEN q.company_id IS NULL THEN 'portfolio' WHEN c.company_id IS NULL THEN 'unknown' ELSE {_route_sql('q.question')} END AS route,
       CASE WHEN q.company_id IS NULL THEN (SELECT t FROM ptxt) WHEN c.company_id IS NULL THEN 'Borrower not found'
            WHEN {_route_sql('q.question')} = 'action' THEN
              CAST(q.company_id AS VARCHAR) || ' is in the ' || c.band || ' band (PD ' || {_PCT1} || '%). Recommended interventions: ' || {_ACT} || '.'
            WHEN {_route_sql('q.question')} = 'trend' THEN
              'Over the observation window the dominant deteriorating signals for ' || CAST(q.company_id AS VARCHAR) || ' are: ' || {_DRV}
              || '. This drove the PD to ' || {_PCT1} || '% (' || c.band || ' risk).'
            ELSE CAST(q.company_id AS VARCHAR) || ' (' || c.sector || ') carries a ' || {_PCT1} || '% probability of default ('
              || c.band || ' band). Key drivers: ' || {_DRV} || '. Projected expected loss is ₹' || {money_sql('c.expected_loss')}
              || ' (PD × EAD ₹' || {money_sql('c.ead')} || ' × LGD ' || {num_sql('c.lgd * 100', 0)} || '%).'
       END AS answer
FROM qs q LEFT JOIN ctx c ON q.company_id = c.company_id""", _nar(), CTX.format(k=K.DRIVERS_ANSWER), _ANSWER))
def q_answer_questions(spark, sf):
    qs = questions(spark, sf)
    ctx = _context(spark, sf, K.DRIVERS_ANSWER, only=qs.select("company_id").distinct())
    top = (P.top_borrowers(scored(spark, sf), K.ATTENTION_TOP, ("company_id", "sector", "pd", "band"), extra=False)
           .withColumn("pd_pct", AT._num(F.col("pd") * 100, 1)).collect())  # five rows
    text = QA.attention_text(top)
    out = QA.answer(qs, ctx, text)
    return out.select("conv_id", "turn", "company_id", "route", "answer")
