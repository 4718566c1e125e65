"""Model-quality metrics: brute-force checks, invariants and the reference's golden counts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators import metrics as MT


def scores_df(spark, y, p, model="m"):
    return spark.createDataFrame([(model, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "model string, id long, y_true int, prob double")


def brute_auc(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, size=300)
    p = np.round(np.clip(0.3 * y + rng.normal(0.4, 0.2, size=300), 0, 1), 2)  # many ties
    return y.tolist(), p.tolist()


def test_auc_matches_pair_count(spark, data):
    y, p = data
    got = MT.roc_auc(scores_df(spark, y, p)).first()["roc_auc"]
    assert abs(got - brute_auc(y, p)) < 1e-12


def test_auc_complement(spark, data):
    y, p = data
    a = MT.roc_auc(scores_df(spark, y, p)).first()["roc_auc"]
    b = MT.roc_auc(scores_df(spark, y, [1 - v for v in p])).first()["roc_auc"]
    assert abs(a + b - 1) < 1e-12


def test_average_precision(spark, data):
    y, p = data
    got = MT.average_precision(scores_df(spark, y, p)).first()["average_precision"]
    assert abs(got - brute_ap(y, p)) < 1e-12


def test_threshold_counts_sum_to_n(spark, data):
    y, p = data
    rows = MT.threshold_counts(scores_df(spark, y, p), MT.linspace()).collect()
    assert len(rows) == 91
    for r in rows:
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == len(y)
        t = r["threshold"]
        assert r["tp"] == sum(1 for a, b in zip(y, p) if a == 1 and b >= t)


def test_grid_edge_value_counts_at_095(spark):
    df = scores_df(spark, [1, 0], [0.95, 0.94])
    r = [x for x in MT.threshold_counts(df, MT.linspace()).collect() if x["threshold"] == 0.95][0]
    assert r["tp"] == 1 and r["fp"] == 0


def test_best_f1_lowest_threshold_on_ties(spark):
    sw = spark.createDataFrame([("m", 0.3, 0.5), ("m", 0.2, 0.5), ("m", 0.4, 0.1)], "model string, threshold double, f1 double")
    assert MT.best_f1_threshold(sw).first()["threshold"] == 0.2


def test_recall_floor_fallback(spark):
    sw = spark.createDataFrame([("m", 0.3, 0.9, 0.5), ("m", 0.4, 0.9, 0.84)],
                               "model string, threshold double, precision double, recall double")
    r = MT.recall_floor_threshold(sw).first()
    assert r["threshold"] == 0.30 and not r["recall_met"]


@pytest.mark.parametrize("counts,acc,prec,rec,f1", [
    ((5283, 945, 251, 1021), 0.8405333333333334, 0.5193285859613428, 0.8026729559748428, 0.6306361951822113),
    ((6223, 5, 0, 1272), 0.9993333333333333, 0.9960845732184808, 1.0, 0.9980384464495881),
])
def test_golden_confusion_arithmetic(spark, counts, acc, prec, rec, f1):
    df = spark.createDataFrame([("m", 0.5) + counts], "model string, threshold double, tn long, fp long, fn long, tp long")
    r = MT.classification_metrics(df).first()
    assert abs(r["accuracy"] - acc) < 1e-12 and abs(r["precision"] - prec) < 1e-12
    assert abs(r["recall"] - rec) < 1e-12 and abs(r["f1"] - f1) < 1e-12


def test_golden_rounded_report(spark):
    df = spark.createDataFrame([("m", 0.5, 7035, 437, 375, 1153)],
                               "model string, threshold double, tn long, fp long, fn long, tp long")
    r = MT.classification_metrics(df).first()
    assert (round(r["accuracy"], 4), round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4)) == \
        (0.9098, 0.7252, 0.7546, 0.7396)


def test_auc_invariant_under_monotone_map(spark, data):
    y, p = data
    a = MT.roc_auc(scores_df(spark, y, p)).first()["roc_auc"]
    b = MT.roc_auc(scores_df(spark, y, [v ** 3 + 2 for v in p])).first()["roc_auc"]
    assert abs(a - b) < 1e-12


def test_null_scores_are_no_predictions(spark, data):
    y, p = data
    full = scores_df(spark, y, p)
    some = full.unionByName(spark.createDataFrame([("m", -i, i % 2, None) for i in range(1, 4)], full.schema))
    assert MT.roc_auc(some).collect() == MT.roc_auc(full).collect()
    assert MT.threshold_counts(some, [0.5]).collect() == MT.threshold_counts(full, [0.5]).collect()
