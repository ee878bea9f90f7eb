"""Every query against its SQL, and reports on literal rows."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchwork.operators import logs, reports
from parchwork.plans import catalogue

TABLES = "documents pages conversations benchmark labels embeddings".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    shown = lambda v: None if v is None or v is pd.NaT or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(map(shown, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["word", "pos"] and df.count() > 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_log_file(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("001.html   0.5\n\n002.html   x\n003.html   ERROR  (msg)\ntotal: 7 s\n")
    lines = logs.read_lines(spark, str(path))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 3, 4, 5]
    assert [tuple(r) for r in logs.timings(lines).collect()] == [(1, "001.html", 0.5)]
    assert [tuple(r) for r in logs.totals(lines).collect()] == [("total", "7")]
    assert [tuple(r) for r in logs.totals(lines, first_token=False).where("key = 'total'").collect()] == [("total", "7 s")]


def test_reports_of_no_rows(spark):
    none = spark.createDataFrame([], "path string, seconds double, error string, empty boolean")
    assert reports.open_log(none).count() == 0 and reports.timing_report(none).count() == 0
    assert tuple(reports.status_counts(none).first()) == (0, 0, 0, 0)


def test_overhead_is_not_negative(spark):
    row = spark.range(1).select(reports.overhead(F.lit(1.0), F.lit(8.0), F.lit(2)).alias("a"), reports.overhead(F.lit(5.0), F.lit(8.0), F.lit(2), F.lit(0.5)).alias("b")).first()
    assert tuple(row) == (0.0, 0.5)
