"""What the plans of the consumer and panel queries move: rows no wider and no more of them than the answer needs."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from loanlens.functions import constants as K
from loanlens.operators import records as RC
from loanlens.operators import trajectory as TR
from loanlens.plans import consumer_queries as CQ
from loanlens.plans import detail_queries as DQ
from loanlens.sources import views as V

from .conftest import SF


def nodes(df, name):
    """Nodes of that name in the optimised plan."""
    out, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        out += [node] if node.nodeName() == name else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def columns(node):
    return {node.output().apply(i).name(): node.output().apply(i).dataType().simpleString() for i in range(node.output().size())}


def test_attribution_check_joins_no_arrays(spark):
    (join,) = nodes(E.queries()["consumer_attribution_check"](spark, SF), "Join")
    assert not any("array" in kind for side in (join.left(), join.right()) for kind in columns(side).values())


def test_record_gathers_raw_values_and_one_row_of_months(spark):
    (union,) = nodes(DQ.consumer_detail(spark, SF), "Union")
    kinds = columns(union)
    assert "array" not in kinds["_base"] and kinds["parts"] == "struct<part:array<struct<month_idx:int,pd:double>>>"


def test_record_has_twelve_months_in_turn(spark):
    got = DQ.consumer_detail(spark, SF).select("loan_id", "timeline").limit(50).collect()
    for r in got:
        assert [x["month_idx"] for x in r["timeline"]] == list(range(12)) and [x["month"] for x in r["timeline"]] == list(K.SCENARIO_MONTHS)


def test_record_moves_a_note_once_an_applicant(spark, monkeypatch):
    """Where no applicants share an id, no note goes through the grouping of applications."""
    gather, seen = RC.gather, {}
    monkeypatch.setattr(RC, "gather", lambda base, parts, *a, **b: seen.update(parts) or gather(base, parts, *a, **b))
    d = DQ.consumer_detail(spark, SF)
    assert d.where(F.size("note") == 1).count() > 0
    assert seen["parts"].count() > 0 and seen["note"].count() == 0


def test_record_has_the_notes_of_all_applicants_of_an_id(spark, monkeypatch):
    pairs = [(1, 10), (1, 11), (2, 10), (2, 10), (3, None), (None, 10), (None, 11), (4, 11), (4, None), (5, 12), (6, 11), (7, 13), (7, 14), (7, 13), (8, 12), (8, 10)]
    texts = [(10, "b"), (10, "a"), (11, None), (13, ""), (14, "c"), (99, "z"), (None, "y")]
    real = CQ.consumer(spark, SF)
    mine = [{**r.asDict(), "loan_id": loan, "company_id": company} for r, (loan, company) in zip(real.orderBy("loan_id").limit(len(pairs)).collect(), pairs)]
    monkeypatch.setattr(DQ, "consumer", lambda *_: spark.createDataFrame([tuple(r[c] for c in real.columns) for r in mine], real.schema))
    monkeypatch.setattr(DQ, "_notes", lambda *_: spark.createDataFrame([(c, t, 0.5) for c, t in texts], "company_id long, text string, stress_index double"))
    got = DQ.consumer_detail(spark, SF).select("loan_id", "note", F.size("timeline").alias("months")).collect()
    want = {loan: [t for o, c in pairs if o == loan and c is not None for d, t in texts if d == c] for loan, _ in pairs}
    assert len(got) == len(want)
    for r in got:
        assert [x["text"] for x in r["note"]] == sorted(want[r["loan_id"]], key=lambda t: (t is not None, t or "")), r
        assert r["months"] == 12 * sum(loan == r["loan_id"] for loan, _ in pairs)


def test_folded_puts_neighbours_together(spark):
    rows = [(k, m) for k in (7, 7, 3, None, None, 9) for m in range(4)]
    df = spark.createDataFrame(rows, "k long, m int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = TR.folded(df, "k", "part").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["k"]), x["m"]) for r in got for x in r["part"]) == sorted((str(k), m) for k, m in rows)
    whole = TR.folded(spark.createDataFrame([(k, m) for k in (5, 6) for m in range(12)], "k long, m int").coalesce(1), "k", "part").collect()
    assert [(r["k"], [x["m"] for x in r["part"]]) for r in whole] == [(5, list(range(12))), (6, list(range(12)))]


def test_migration_scores_the_first_month_alone(spark):
    spine = TR.scenario_spine(spark.createDataFrame([(1, 0.9), (2, 0.1)], "company_id int, pd double"))
    band = F.when(F.col("month_idx") == 0, F.lit(K.BAND_TOP)).otherwise(F.raise_error(F.lit("another month was scored")))
    got = TR.migration(spine.select("company_id", "month_idx", band.alias("band")), spine.select("company_id", "pd").distinct()).collect()
    assert {r["company_id"]: (r["start_band"], r["migrated"]) for r in got} == {1: (K.BAND_TOP, False), 2: (K.BAND_TOP, True)}


def test_trajectory_check_joins_no_months(spark):
    joins = nodes(E.queries()["consumer_trajectory_check"](spark, SF), "Join")
    assert len(joins) == 3 and not any("month_idx" in columns(side) for j in joins for side in (j.left(), j.right()))


def test_applications_and_split_are_written_once(spark):
    for make in (CQ.consumer, CQ._split):
        a, b = make(spark, SF), make(spark, SF)
        assert sorted(a.inputFiles()) == sorted(b.inputFiles()) and not nodes(a, "Join")


def test_panel_lines_meet_before_they_are_summed(spark):
    df = V.panel_monthly(spark, SF)
    assert len(nodes(df, "Aggregate")) == 1 and len(nodes(df, "RepartitionByExpression")) == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    # partial sums (the lower of the two aggregates) stand above the exchange by account and month
    assert plan.index("partial_sum") < plan.index("REPARTITION_BY_COL")
