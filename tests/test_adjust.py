"""Splits, dividends, validation and point-in-time rules on hand-made bars."""

import datetime as dt

import pytest

from tidewater.operators import adjust, fundamentals


def day(n):
    return dt.date(2020, 1, 2) + dt.timedelta(days=n)


def bars(spark, closes, ticker="ABCD3"):
    rows = [(ticker, day(i), x, x, x, x, 1e6, 1) for i, x in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, quotation_factor int")


def actions(spark, rows):
    return spark.createDataFrame([("ABCD3", day(n), a, f) for n, a, f in rows], "ticker string, ex_date date, action string, factor double")


def closes(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_factor_applies_only_before_the_ex_date(spark):
    out = adjust.back_adjust(bars(spark, [100.0, 100.0, 50.0, None]), adjust.split_factors(actions(spark, [(2, "STOCK_SPLIT", 2.0)])))
    assert closes(out, "split_adj_close") == [50.0, 50.0, 50.0, None]


def test_cumulative_factor_is_clamped_at_every_step(spark):
    out = adjust.back_adjust(bars(spark, [1.0, 1.0]), adjust.split_factors(actions(spark, [(n, "STOCK_SPLIT", 1000.0) for n in (2, 3)] + [(1, "REVERSE_SPLIT", 0.001)])))
    assert closes(out, "split_product") == pytest.approx([1e-2, 1e-5])


def test_bonus_and_bounds(spark):
    f = {r.factor: r.split_factor for r in adjust.split_factors(actions(spark, [(1, "BONUS_SHARES", 10.0), (2, "STOCK_SPLIT", 5000.0), (3, "STOCK_SPLIT", -1.0)])).collect()}
    assert f == {10.0: pytest.approx(1 / 1.1)}


def test_dividend_factor_uses_the_close_strictly_before(spark):
    cash = spark.createDataFrame([("ABCD3", day(1), 10.0), ("ABCD3", day(2), 95.0), ("ABCD3", day(0), 1.0)], "ticker string, ex_date date, value double")
    got = adjust.dividend_factors(cash, bars(spark, [100.0, 80.0, 80.0])).collect()
    assert [(r.ex_date, r.dividend_factor) for r in got] == [(day(1), pytest.approx(0.9))]
    total = adjust.total_adjust(bars(spark, [100.0, 80.0, 80.0]), actions(spark, []), cash)
    assert closes(total, "adj_close") == pytest.approx([90.0, 80.0, 80.0])


def test_total_adjustment_checks_its_actions(spark):
    no_cash = spark.createDataFrame([], "ticker string, ex_date date, value double")
    halved = bars(spark, [100.0] * 4 + [50.0] * 4)
    kept = adjust.total_adjust(halved, actions(spark, [(4, "STOCK_SPLIT", 2.0)]), no_cash)
    assert closes(kept, "adj_close") == pytest.approx([50.0] * 8)
    corrected = adjust.total_adjust(halved, actions(spark, [(4, "STOCK_SPLIT", 10.0)]), no_cash)  # the prices halve, so the factor does too
    assert closes(corrected, "adj_close") == pytest.approx([50.0] * 8)
    dropped = adjust.total_adjust(bars(spark, [100.0] * 8), actions(spark, [(4, "STOCK_SPLIT", 2.0)]), no_cash)  # no price moves
    assert closes(dropped, "adj_close") == pytest.approx([100.0] * 8)
    rows = [("ABCD3", day(i), x, x, x, x, 1e6, q) for i, (x, q) in enumerate([(100.0, 1)] * 4 + [(50.0, 2)] * 4)]
    factor_changed = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, quotation_factor int")
    redundant = adjust.total_adjust(factor_changed, actions(spark, [(4, "STOCK_SPLIT", 2.0)]), no_cash)  # the quotation factor says it already
    assert closes(redundant, "adj_close") == pytest.approx([100.0] * 4 + [50.0] * 4)


def test_detection(spark):
    b = bars(spark, [100.0] * 5 + [50.0] * 5)
    (r,) = adjust.detect_splits(b, actions(spark, [])).collect()
    assert (r.ex_date, r.action, r.factor) == (day(5), "STOCK_SPLIT", 2.0)
    assert adjust.detect_splits(b, actions(spark, [(2, "STOCK_SPLIT", 2.0)])).count() == 0  # an action within five bars explains it
    assert adjust.detect_splits(bars(spark, [100.0, None, 50.0]), actions(spark, [])).count() == 1


def test_validation(spark):
    b = bars(spark, [100.0] * 5 + [50.0] * 3)
    verdict = lambda rows: [(r.verdict, r.factor) for r in adjust.validate(actions(spark, rows), b).orderBy("ex_date").collect()]
    assert verdict([(5, "STOCK_SPLIT", 2.0)]) == [("KEEP", 2.0)]
    assert verdict([(3, "STOCK_SPLIT", 2.0)]) == [("DROP", 2.0)]
    assert verdict([(5, "STOCK_SPLIT", 10.0)]) == [("CORRECTED", 2.0)]


def test_share_multiplier(spark):
    rows = spark.createDataFrame([("ABCD3", day(0), day(9)), ("ABCD3", day(3), day(9)), ("X", day(0), day(9))], "ticker string, a date, b date")
    got = {(r.ticker, r.a): r.multiplier for r in adjust.share_multiplier(rows, actions(spark, [(3, "STOCK_SPLIT", 2.0), (5, "STOCK_SPLIT", 3.0)]), "a", "b").collect()}
    assert got == {("ABCD3", day(0)): pytest.approx(6.0), ("ABCD3", day(3)): pytest.approx(3.0), ("X", day(0)): 1.0}


def test_redundant_actions_go(spark):
    rows = [("ABCD3", day(i), 1.0, 1 if i < 3 else 1000) for i in range(6)]
    b = spark.createDataFrame(rows, "ticker string, date date, close double, quotation_factor int")
    assert [r.factor for r in adjust.drop_redundant(actions(spark, [(4, "STOCK_SPLIT", 1000.0), (4, "STOCK_SPLIT", 2.0)]), b).collect()] == [2.0]


def test_unrecorded_split_is_repaired(spark):
    rows = [("A", day(i), 100.0 if i < 30 else 50.0, 100.0 if i < 30 else 50.0, 1e6) for i in range(45)]
    p = spark.createDataFrame(rows, "ticker string, date date, close double, raw_close double, volume double")
    out = adjust.repair_unrecorded(p).orderBy("date").collect()
    assert {r.repaired for r in out} == {50.0} and sum(r.split_here for r in out) == 1


def filings(spark, rows):
    return spark.createDataFrame([("c", dt.date(*d), v, i, x) for i, (d, v, x) in enumerate(rows)], "company string, filing_date date, version int, filing_id int, net_income double")


def test_restatement_is_invisible_before_its_filing(spark):
    f = filings(spark, [((2020, 4, 1), 1, 10.0), ((2020, 4, 1), 2, 11.0), ((2020, 8, 1), 3, 20.0)])
    dates = spark.createDataFrame([("c", dt.date(2020, 3, 31)), ("c", dt.date(2020, 7, 31)), ("c", dt.date(2020, 8, 1)), ("c", dt.date(2021, 12, 31))], "company string, date date")
    got = [r.net_income for r in fundamentals.known_on(dates, f, ["net_income"]).orderBy("date").collect()]
    assert got == [None, 11.0, 20.0, None]


def test_trailing_twelve_months(spark):
    rows = [("c", 2019, None, dt.date(2020, 3, 1), 1, 100.0), ("c", 2019, 1, dt.date(2019, 5, 1), 1, 20.0), ("c", 2020, 1, dt.date(2020, 5, 1), 1, 30.0), ("c", 2021, 1, dt.date(2021, 5, 1), 1, 9.0)]
    f = spark.createDataFrame(rows, "company string, fiscal_year int, quarter int, filing_date date, version int, net_income double")
    assert {(r.fiscal_year, r.quarter): r.ttm for r in fundamentals.trailing_twelve_months(f).collect()} == {(2019, None): 100.0, (2019, 1): None, (2020, 1): 110.0, (2021, 1): None}


def test_negative_over_negative_does_not_pass(spark):
    df = spark.createDataFrame([(10.0, 5.0, -1.0, -2.0)], "close double, shares double, net_income double, equity double")
    wide = df.selectExpr("*", "cast(null as double) net_debt", "cast(null as double) ebitda", "cast(null as double) total_assets", "cast(null as double) revenue")
    r = fundamentals.quality_ratios(fundamentals.valuation(wide)).first()
    assert (r.pe, r.pb, r.roe) == (None, None, None)
