"""Bounded weights, index constituents and the volatility overlay against plain versions."""

import datetime as dt
import math
import random
import statistics

import pytest

from tidewater.operators import index, portfolio
from tidewater.plans import sleeve_queries as sleeves


def filled(scores, low, high):
    """Weights between the bounds that sum to one, the common level found by bisection."""
    n = len(scores)
    low, high = min(low, 1 / n), max(high, 1 / n)
    scores = scores if sum(scores) > 0 else [1.0] * n
    clip = lambda level: [min(max(w * level, low), high) for w in scores]
    a, b = 0.0, 1e12
    for _ in range(300):
        m = (a + b) / 2
        a, b = (m, b) if sum(clip(m)) <= 1 else (a, m)
    out = clip(a)
    zeros = [i for i, w in enumerate(scores) if w == 0]
    for i in zeros:
        out[i] = min(out[i] + max(1 - sum(clip(a)), 0) / len(zeros), high)
    return out


@pytest.mark.parametrize(("low", "high"), [(0.0, 0.6), (0.1, 0.8), (0.2, 0.5), (0.05, 0.12), (0.4, 0.45)])
def test_bounded_weights_equal_bisection(spark, low, high):
    r = random.Random(int(low * 100 + high * 1000))
    cases = [[r.choice([0.0, r.random(), r.random() * 10, 1.0]) for _ in range(r.randint(1, 12))] for _ in range(60)] + [[0.0, 0.0], [0.0], [5.0], [1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(d, f"s{i}", w) for d, case in enumerate(cases) for i, w in enumerate(case)], "date int, sleeve string, weight double")
    got = {(x.date, x.sleeve): x.weight for x in portfolio.bounded_weights(df, low, high).collect()}
    for d, case in enumerate(cases):
        want = filled(case, low, high)
        assert [got[d, f"s{i}"] for i in range(len(case))] == pytest.approx(want, abs=1e-9), case


DAY = dt.date(2020, 9, 30)


def members(spark, quotes, filings, actions=(), **floors):
    q = spark.createDataFrame([(DAY, *x) for x in quotes], "date date, ticker string, close double, median_volume double")
    c = spark.createDataFrame([(t, t[:4], t[4:]) for t, *_ in quotes], "ticker string, root string, share_class string")
    f = spark.createDataFrame(
        filings, "root string, filing_date date, version int, filing_id int, period_end date, net_income double, equity double, shares double, shares_common double, shares_preferred double"
    )
    a = spark.createDataFrame(list(actions), "ticker string, ex_date date, factor double")
    return {x.root: x for x in index.constituents(q, c, f, a, **({"min_cap": 1e9, "min_volume": 2e6} | floors)).collect()}


def filing(root, income=100_000.0, equity=1e6, shares=1e9, common=None, preferred=None, filed=dt.date(2020, 5, 15), n=1):
    return (root, filed, n, n, dt.date(2020, 3, 31), income, equity, shares, common, preferred)


def test_constituents_pass_and_fail_by_each_rule(spark):
    roots = {"GOOD": {}, "LOSS": {"income": -1.0}, "DEBT": {"equity": -5.0}, "TINY": {"shares": 1e6}, "OLD1": {"filed": dt.date(2019, 1, 1)}, "HUGE": {"shares": 1e14}}
    quotes = [(f"{r}3", 10.0, 5e6) for r in roots] + [("THIN3", 10.0, 1e6), ("NONE3", 10.0, 5e6)]
    got = members(spark, quotes, [filing(r, **k) for r, k in roots.items()] + [filing("THIN")])
    assert set(got) == {"GOOD"}
    assert got["GOOD"].market_cap == pytest.approx(1e10) and got["GOOD"].roe == pytest.approx(0.1)
    assert set(members(spark, quotes, [filing("LOSS", income=-1.0)], earnings=False)) == {"LOSS"}


def test_classes_count_at_their_own_prices(spark):
    quotes = [("BOTH3", 10.0, 3e6), ("BOTH4", 8.0, 9e6), ("UNIT11", 30.0, 9e6), ("UNIT3", 9.0, 3e6), ("TIED3", 5.0, 4e6), ("TIED5", 6.0, 4e6)]
    half = {"common": 6e8, "preferred": 4e8}
    got = members(spark, quotes, [filing("BOTH", **half), filing("UNIT", **half), filing("TIED")], [("BOTH4", dt.date(2020, 6, 1), 2.0), ("BOTH4", dt.date(2020, 1, 1), 3.0), ("BOTH3", dt.date(2020, 7, 1), 5.0)])
    assert got["BOTH"].ticker == "BOTH4" and got["BOTH"].market_cap == pytest.approx(2 * (6e8 * 10 + 4e8 * 8))  # events since the period's end, of the chosen class
    assert got["UNIT"].ticker == "UNIT11" and got["UNIT"].market_cap == pytest.approx(1e9 * 9)  # the missing class at its sibling's price
    assert got["TIED"].ticker == "TIED5" and got["TIED"].market_cap == pytest.approx(1e9 * 6)  # no split of the count: all at the chosen class


def test_exposure_meets_the_target(spark):
    r = random.Random(5)
    start, names = dt.date(2020, 1, 1), ("A", "B")
    rets = {n: [r.gauss(0, 0.02) for _ in range(200)] for n in names}
    days = spark.createDataFrame([(n, k + 1, start + dt.timedelta(k), rets[n][k]) for n in names for k in range(200)], "ticker string, k int, date date, ret double")
    seen = start + dt.timedelta(150)
    book = spark.createDataFrame([(start + dt.timedelta(181), seen, n, w) for n, w in zip(names, (0.7, 0.3))], "date date, seen date, ticker string, weight double")
    daily = [0.7 * rets["A"][k] + 0.3 * rets["B"][k] for k in range(150 - 62, 151)]
    want = 0.12 / (statistics.stdev(daily) * math.sqrt(252))
    assert sleeves.exposure(book, days, 0.12).first().share == pytest.approx(want, abs=1e-9)
    assert sleeves.exposure(book, days, 9.0).first().share == 1.0


def test_two_legs_rank_within_themselves(spark):
    d = DAY
    kind = "date date, ticker string, market_cap double, net_income double, equity double, roe double, ebitda double, net_debt double, revenue double, period_end date"
    fresh, old = dt.date(2020, 6, 30), dt.date(2020, 1, 31)
    rows = [
        ("CHEAP", 1e8, 2e4, 1e5, 0.2, 5e4, 0.0, 1e5, fresh), ("DEAR", 1e8, 1e4, 1e5, 0.1, 2e4, None, 1e5, fresh), ("DEBT", 1e8, 1e4, 1e5, 0.1, 5e4, 1e6, 1e5, fresh),  # yields of 0.5, 0.2 and 0.045
        ("BANK", 1e8, 2e4, 2e5, 0.1, None, 0.0, 1e5, fresh), ("HOLD", 1e8, 1e4, 1e5, 0.1, 9e4, 0.0, 0.0, fresh),  # no EBITDA, and no revenue: both by multiples
        ("STALE", 1e8, 2e4, 1e5, 0.2, 9e4, 0.0, 1e5, old), ("LOSS", 1e8, -2e4, 1e5, -0.2, 9e4, 0.0, 1e5, fresh), ("MARGIN", 1e8, 2e4, 1e5, 0.2, -1.0, 0.0, 1e5, fresh), ("TRAP", 1e8, 4e3, 1e5, 0.04, 8e4, 0.0, 1e5, fresh),
    ]
    got = {r.ticker: (r.leg, r.place, r.cheap) for r in index.two_legs(spark.createDataFrame([(d, *x) for x in rows], kind)).collect()}
    assert set(got) == {"CHEAP", "DEAR", "DEBT", "BANK", "HOLD"}  # a low return is ranked, so it takes the top of its leg, but not chosen
    assert got["CHEAP"] == ("yield", 2, pytest.approx(0.75)) and got["DEAR"][2] == pytest.approx(0.5) and got["DEBT"][2] == pytest.approx(0.25)
    assert got["BANK"] == ("book", 1, pytest.approx(1.0)) and got["HOLD"][0] == "book" and got["HOLD"][2] == pytest.approx(0.5)
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1][1])] == ["BANK", "CHEAP", "DEAR", "HOLD", "DEBT"]
