"""Panel operators on hand-written rows, including missing months and the floored balance."""

import random

from loanlens.operators import panel as PN


def test_floored_balance_matches_loop(spark):
    random.seed(3)
    rows, expected = [], {}
    for cid in range(5):
        b = random.uniform(0, 100)
        bal = b
        for m in range(1, 13):
            i, o = round(random.uniform(0, 100), 2), round(random.uniform(0, 130), 2)
            bal = max(0.0, bal + i - o)
            rows.append((cid, m, round(b, 2), i, o))
            expected[(cid, m)] = bal
    # the loop above used the unrounded opening balance; recompute with the rounded one
    for cid in range(5):
        bal = [r for r in rows if r[0] == cid][0][2]
        for r in [r for r in rows if r[0] == cid]:
            bal = max(0.0, bal + r[3] - r[4])
            expected[(cid, r[1])] = bal
    df = spark.createDataFrame(rows, "company_id int, month int, opening double, inflow double, outflow double")
    out = PN.floored_balance(df, "opening", "inflow", "outflow").collect()
    for r in out:
        assert abs(r["floored_balance"] - expected[(r["company_id"], r["month"])]) < 1e-6


def test_asof_carries_forward_missing_months(spark):
    rows = [(1, 5, 10.0), (1, 8, 20.0), (2, 7, 5.0)]
    df = spark.createDataFrame(rows, "company_id int, month int, v double")
    got = {(r["company_id"], r["month"]): (r["observed_month"], r["v"])
           for r in PN.asof_snapshots(df, ["v"]).collect()}
    assert got[(1, 6)] == (5, 10.0) and got[(1, 7)] == (5, 10.0) and got[(1, 8)] == (8, 20.0)
    assert got[(1, 12)] == (8, 20.0)
    assert got[(2, 6)] == (None, None) and got[(2, 7)] == (7, 5.0)


def test_latest_snapshot(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "company_id int, month int, s string")
    r = PN.latest_snapshot(df).first()
    assert (r["month"], r["s"]) == (3, "c")


def test_monthly_collapse_single_row_volatility_zero(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 80.0, 60.0)],
                               "company_id int, month int, monthly_sales double, monthly_inflow double, monthly_outflow double")
    r = PN.monthly_collapse(df).first()
    assert r["cashflow_volatility"] == 0.0 and r["revenue_trend_index"] == 1.0
    assert abs(r["cashflow_stress_ratio"] - 1.5) < 1e-12
