"""The driver's contract, with and without the optional text operators; SQL agreement of the queries on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("NULL" if v is None or v is pd.NA or v != v else f"{v + 0.0:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def entry():
    import __spark_entry__ as e

    return e


def names():
    return sorted(entry().oracle_sql()) if os.path.isdir(SF) else []


@needs_data
@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, duck, name):
    got = entry().queries()[name](spark, SF).toPandas()
    want = duck.sql(entry().oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_data
def test_entry_runs(spark):
    assert entry().entry(spark).count() > 0


def test_library_stands_without_the_text_operators(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'strip_islands' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
