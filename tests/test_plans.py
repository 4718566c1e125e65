"""Physical-plan properties the scale design relies on (pushdown, pruning, no global sorts)."""

from loanlens.operators import attribution as AT
from loanlens.operators import metrics as MT
from loanlens.operators import portfolio as P
from loanlens.sources import views as V

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_reads_every_line_and_prunes_columns(spark):
    p = plan(V.panel_monthly(spark, SF))
    scan = next(line for line in p.split("\n") if "FileScan parquet" in line and "l_shipdate" in line)
    assert "l_comment" not in scan and "GreaterThanOrEqual" not in scan
    lines = V.panel_monthly(spark, SF).agg({"_lines": "sum"}).first()[0]
    assert lines == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_borrower_view_prunes_lineitem_columns(spark):
    p = plan(V.borrower_features(spark, SF))
    scans = [line for line in p.split("\n") if "FileScan parquet" in line and "lineitem" in line]
    assert scans
    for s in scans:
        assert "l_extendedprice" not in s and "l_comment" not in s


def test_rank_metrics_have_no_single_partition_exchange(spark):
    assert "SinglePartition" not in plan(MT.roc_auc(V.scores(spark, SF)))
    assert "SinglePartition" not in plan(MT.average_precision(V.scores(spark, SF)))


def test_top_n_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(P.top_borrowers(V.borrowers(spark, SF), 50))


def test_top_drivers_uses_group_limit(spark):
    attr = AT.linear_attribution(V.borrowers(spark, SF), V.borrower_stats(spark, SF))
    assert "WindowGroupLimit" in plan(AT.top_drivers(attr, 8))


def test_trajectory_is_a_generate_not_a_join(spark):
    from loanlens.operators import trajectory as TR
    p = plan(TR.msme_scenarios(V.borrowers(spark, SF)))
    assert "Generate" in p and "Join" not in p
