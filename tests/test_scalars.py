"""Scalar functions and the parity traps around nulls, rounding and substring semantics."""

from pyspark.sql import functions as F

from loanlens.functions import scalars as X


def one(spark, expr, schema="x double", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(expr.alias("o")).collect()]


def test_clip_preserves_null(spark):
    assert one(spark, X.clip("x", 0.0, 1.0), rows=[(None,), (-1.0,), (0.5,), (3.0,)]) == [None, 0.0, 0.5, 1.0]


def test_safe_divide_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(X.safe_divide("a", "b", 0.0)).collect()] == [0.0, 0.0, 1.5]


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([("Y",), ("N",), (None,)], "f string")
    assert [r[0] for r in df.select(X.flag("f")).collect()] == [1, 0, 0]


def test_risk_band_boundaries(spark):
    vals = [(0.0,), (0.1999,), (0.2,), (0.4999,), (0.5,), (0.7499,), (0.75,), (1.0,), (None,)]
    assert one(spark, X.risk_band("x"), rows=vals) == ["Low", "Low", "Medium", "Medium", "High", "High",
                                                       "Critical", "Critical", None]


def test_risk_score_half_even(spark):
    assert one(spark, X.risk_score("x"), rows=[(0.125,), (0.135,), (0.5,), (0.994,)]) == [12, 14, 50, 99]


def test_title_case(spark):
    df = spark.createDataFrame([("MIDDLE EAST",), ("household",)], "s string")
    assert [r[0] for r in df.select(X.title_case("s")).collect()] == ["Middle East", "Household"]


def test_substring_count_matches_python(spark):
    texts = ["delayed delay", "late related", "aaaa", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in ["delay", "late", "aa"]:
        got = [r[0] for r in df.select(X.substring_count("t", term)).collect()]
        assert got == [(t or "").count(term) for t in texts]


def test_routing_is_substring_based(spark):
    from loanlens.operators.qa import route
    qs = ["What does this borrower need?", "How has the trend changed?", "Why is it risky?",
          "Give me six reasons", "RECOMMEND something"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert [r[0] for r in df.select(route("q")).collect()] == ["action", "trend", "why", "trend", "action"]


def test_grade_encode_decode(spark):
    df = spark.createDataFrame([("A",), ("G",), ("Z",), (None,)], "g string")
    enc = [r[0] for r in df.select(X.grade_encode("g")).collect()]
    assert enc == [1, 7, None, None]
    df2 = spark.createDataFrame([(1,), (7,), (9,)], "o int")
    assert [r[0] for r in df2.select(X.grade_decode("o")).collect()] == ["Grade A", "Grade G", "Grade ?"]


def test_linspace_last_value_exact():
    from loanlens.operators.metrics import linspace
    g = linspace()
    assert len(g) == 91 and g[0] == 0.05 and g[-1] == 0.95


def test_csv_contract_and_positional_rename(spark, tmp_path):
    from pyspark.sql import types as T

    from loanlens.sources import tables as TB
    path = str(tmp_path / "upload.csv")
    with open(path, "w") as fh:
        fh.write(",a , b\n0,1.5,x\n1,oops,y\n2,,z\n")
    raw = spark.read.option("header", True).csv(path)
    renamed = TB.rename_positional(raw, ["amount", "label"], drop=["_c0"])
    assert renamed.columns == ["amount", "label"]
    contract = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("label", T.StringType()),
                             T.StructField("note_stress_index", T.DoubleType())])
    out = TB.conform(renamed, contract, defaults={"note_stress_index": 0.5}, required=["amount"])
    assert [tuple(r) for r in out.orderBy("label").collect()] == [(1.5, "x", 0.5), (None, "y", 0.5), (None, "z", 0.5)]
    import pytest
    with pytest.raises(ValueError):
        TB.require_columns(renamed, ["missing_col"])


def test_read_metadata_tolerates_absence(spark, tmp_path):
    from loanlens.sources import tables as TB
    assert TB.read_metadata(spark, str(tmp_path / "nope")).count() == 0
