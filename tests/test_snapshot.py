"""The monthly snapshot: values as known, partial refresh by late filings, pruned reads."""

import datetime as dt
from pathlib import Path

import pytest

from tidewater.operators import snapshot as s

METRICS = ["net_income", "equity"]
SCHEMA = "company string, filing_date date, version int, filing_id int, net_income double, equity double"


@pytest.fixture
def world(spark):
    d = dt.date
    filings = [("A", d(2020, 1, 15), 1, 1, 10.0, None), ("A", d(2020, 4, 10), 1, 2, None, 100.0), ("A", d(2020, 4, 10), 2, 3, 12.0, None), ("B", d(2020, 2, 1), 1, 4, 7.0, 70.0)]
    months = [(d(2020 + k // 12, k % 12 + 1, 1),) for k in range(30)]
    ends = spark.createDataFrame(months, "m date").selectExpr("last_day(m) as period")
    return filings, ends, spark.createDataFrame([("A", "AAAA3")], "company string, ticker string")


def test_values_as_known(spark, world):
    filings, ends, tickers = world
    got = {(r.month_end, r.ticker): (r.net_income, r.equity) for r in s.snapshot(spark.createDataFrame(filings, SCHEMA), ends, METRICS, tickers).collect()}
    assert got[dt.date(2020, 1, 31), "AAAA3"] == (10.0, None)
    assert got[dt.date(2020, 4, 30), "AAAA3"] == (12.0, 100.0)  # of one day's filings the highest version, each metric on its own
    assert got[dt.date(2020, 2, 29), "B"] == (7.0, 70.0)  # no ticker: its own key
    assert (dt.date(2021, 4, 30), "B") not in got and got[dt.date(2021, 4, 30), "AAAA3"] == (12.0, 100.0)  # stale after 400 days
    assert (dt.date(2021, 5, 31), "AAAA3") not in got


def test_a_restatement_rewrites_its_months_alone(spark, world, tmp_path):
    filings, ends, tickers = world
    path = str(tmp_path / "snapshot")
    s.write_snapshot(s.snapshot(spark.createDataFrame(filings, SCHEMA), ends, METRICS, tickers), path)
    files = lambda: {p.parent.name: p.name for p in Path(path).glob("month_end=*/*.parquet")}
    before = files()
    late = [("B", dt.date(2020, 11, 5), 2, 9, 8.0, None)]
    every = spark.createDataFrame(filings + late, SCHEMA)
    s.refresh(every, spark.createDataFrame(late, SCHEMA), ends, METRICS, tickers, path)
    after = files()
    assert {m for m in before if before[m] != after[m]} == {m for m in before if m >= "month_end=2020-11-30"}
    assert set(after) == set(before) | {f"month_end={m}" for m in ("2021-05-31", "2021-06-30", "2021-07-31", "2021-08-31", "2021-09-30", "2021-10-31", "2021-11-30")}
    whole = s.snapshot(every, ends, METRICS, tickers).select("month_end", "ticker", *METRICS)
    assert sorted(map(tuple, s.read_metrics(spark, path, METRICS).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_readers_prune_months_and_columns(spark, world, tmp_path):
    filings, ends, tickers = world
    path = str(tmp_path / "snapshot")
    s.write_snapshot(s.snapshot(spark.createDataFrame(filings, SCHEMA), ends, METRICS, tickers), path)
    one = s.read_metric(spark, path, "equity", "2020-02-01", "2020-04-30")
    assert sorted(map(tuple, one.collect())) == [(dt.date(2020, 2, 29), "B", 70.0), (dt.date(2020, 3, 31), "B", 70.0), (dt.date(2020, 4, 30), "AAAA3", 100.0), (dt.date(2020, 4, 30), "B", 70.0)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "net_income" not in plan and "PartitionFilters: [isnotnull(month_end" in plan
