"""Correlations by date against the long form."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import discovery as d
from tidewater.plans import adapters as a
from tidewater.plans import discovery_queries as q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_centred_ranks_average_ties():
    got = d.centred_ranks(np.array([3.0, 1.0, 3.0, 2.0]))
    assert list(got) == [2.0, -3.0, 2.0, -1.0] and not d.centred_ranks(np.full(7, 0.1)).any() and len(d.centred_ranks(np.array([]))) == 0


def test_correlations_by_date_equal_the_long_form(spark):
    r = random.Random(3)
    rows = []
    for day in range(4):
        for t in range(30):
            v = lambda: r.choice([None, float(r.randint(0, 9)), r.random()])
            rows.append((dt.date(2020, 1, 1 + day), t, v() if day else 1.0, v() if t < 8 else None, v(), v()))
    wide = spark.createDataFrame(rows, "date date, ticker int, x double, few double, f4 double, f13 double")
    listed = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("forward")) for h in (4, 13)))
    forward = wide.select("date", "ticker", F.explode(listed).alias("e")).select("date", "ticker", "e.*").filter("forward is not null")
    expected = {(r.feature, r.horizon, r.date): r.ic for r in d.ic_series(d.to_long(wide, ["x", "few"]), forward).collect()}
    got = {(r.feature, r.horizon, r.date): r.ic for r in d.ic_by_date(wide, ["x", "few"], {4: "f4", 13: "f13"}).collect()}
    assert got.keys() == expected.keys() and len(got) == 6 and all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_a_correlation_needs_one_look_at_the_panel(spark):
    """Before, features and returns each had a panel and met in a join, one row a feature, horizon and name."""
    assert plan(q.ic(spark, SF)).count("lineitem") <= plan(a.panel(spark, SF)).count("lineitem")
    assert "Generate explode(array(struct(feature" not in plan(q.ic(spark, SF))
