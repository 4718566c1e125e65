"""Every registered query of the package and the pipeline against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from loanlens.llm import queries as Q

from .helpers import AWKWARD, corpus, make

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.ORACLE:
        want = duck.execute(Q.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        table, key = ("pages", "page_id") if "page_id" in got else ("documents", "doc_id")
        assert len(got) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0] == got[key].nunique()


def test_pipeline(spark, duck):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(corpus_pipeline.ORACLE_SQL).df())


def test_stages_handle_awkward_documents(spark):
    docs = make(spark, corpus() + [r + (None,) * 2 for r in AWKWARD])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
