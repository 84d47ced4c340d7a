"""The dense grid against brute force, and without a shuffle of dense rows."""

import datetime as dt
import random

from tidewater.operators.grid import densify


def test_the_grid_equals_brute_force(spark):
    r = random.Random(5)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = [(t, day(k), r.choice([None, r.random()]), r.choice([None, r.random()])) for t in ("a", "b", "c") for k in range(20) if r.random() < 0.4]
    rows += [("d", day(19), 1.0, 2.0), ("e", None, 3.0, 4.0), ("a", None, 5.0, 6.0), (None, day(3), 7.0, 8.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    dates, expected = sorted({d for _, d, _, _ in rows if d}), []
    for t in ("a", "b", "c", "d", "e", None):
        own, last = {d: (x, y) for k, d, x, y in rows if k == t and t and d}, None
        for d in dates:
            x, y = own.get(d, (None, None))
            last = x if x is not None else last
            expected.append((d, t, last, y))
    got = [tuple(v) for v in densify(bars, ["x", "y"], ["x"]).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_dense_rows_are_not_joined(spark):
    bars = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("b", dt.date(2020, 1, 3), 2.0)], "ticker string, date date, x double").repartition("ticker", "date")
    plan = densify(bars, ["x"], ["x"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = lambda word: next(i for i, line in enumerate(plan) if word in line)
    assert all(i > below("Generate explode") for i, line in enumerate(plan) if "Join" in line or "Window" in line)
