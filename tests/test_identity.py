"""Identity, calendars, books and Sharpe sleeves on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import discovery, identity, portfolio
from tidewater.plans import spec_queries


def test_classes_and_isins(spark):
    t = spark.createDataFrame([("PETR3",), ("PETR4",), ("VALE5",), ("KLBN11",), ("XXXX9",)], "ticker string")
    got = {r.ticker: (r.c, r.p) for r in t.select("ticker", identity.share_class("ticker").alias("c"), identity.is_primary("ticker").alias("p")).collect()}
    assert got == {"PETR3": ("ON", True), "PETR4": ("PN", False), "VALE5": ("PNA", False), "KLBN11": ("UNIT", False), "XXXX9": (None, False)}
    isins = spark.createDataFrame([("BRPETRACNOR9",), ("BRPETRACNPR6",), ("BRKLBNCDAM18",), ("BRVALEACNOR0",), ("short",), ("BRNONEACNOR1",)], "isin string")
    assert {tuple(r) for r in identity.isin_tickers(isins, t).collect()} == {("BRPETRACNOR9", "PETR3"), ("BRPETRACNPR6", "PETR4"), ("BRKLBNCDAM18", "KLBN11"), ("BRVALEACNOR0", "VALE5")}


def test_bulk_update(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 6)], "k int, x string, y int")
    source = spark.createDataFrame([(1, "z", 7, 2), (1, "old", 9, 1), (1, None, None, 2), (3, "w", None, 1)], "k int, x string, y int, at int")
    update = lambda **o: {tuple(r) for r in identity.bulk_update(target, source, ["k"], ["x", "y"], ["at"], **o).collect()}
    assert update() == {(1, "z", 7), (2, "b", 5), (3, "w", 6)} and update(keep_known=True) == {(1, "a", 7), (2, "b", 5), (3, "w", 6)}


def test_scales_and_versions(spark):
    x = spark.createDataFrame([(5000.0, "01"), (5.0, "02"), (5.0, None)], "v double, code string")
    got = [tuple(r) for r in x.select(identity.scaled("v", "code"), identity.scaled_quantity("v", "code")).collect()]
    assert got == [(5.0, 5000.0), (5.0, 5000.0), (5.0, 5.0)]
    assert spark.sql("select date'2020-03-31' d").select(identity.version_of("d")).first()[0] == 20200331


def test_calendars(spark):
    days = spark.createDataFrame([(dt.date(2020, m, d),) for m in range(1, 11) for d in (3, 16, 28)], "date date")
    assert sorted(r[0] for r in identity.completed_quarters(days).collect()) == [dt.date(2020, 3, 28), dt.date(2020, 6, 28), dt.date(2020, 9, 28)]
    assert sorted(r[0] for r in identity.mid_quarter_dates(days).collect()) == [dt.date(2020, m, 16) for m in (4, 6, 9)]


def months(spark, signal, adtv=40_000.0):
    rows = [(dt.date(2020, 1 + i, 28), i, t, t // 2, 50.0, adtv, signal(i, t)) for i in range(6) for t in range(12)]
    return spark.createDataFrame(rows, "date date, i int, ticker int, root int, px double, adtv double, s double")


def regime(spark, calm=lambda i: True):
    return spark.createDataFrame([(dt.date(2020, 1 + i, 28), i, calm(i)) for i in range(6)], "date date, i int, calm boolean")


def book(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.date.month - 1, {})[r.asset] = r.weight
    return out


def test_books_read_the_month_before_and_hold_five(spark):
    got = book(spec_queries.books(months(spark, lambda i, t: float(t) if i != 3 else -float(t)), regime(spark), spec_queries.Spec("s", 1)))
    assert sorted(got) == [1, 2, 3, 4, 5] and set(got[1]) == {"11", "10", "9", "8", "7"} and set(got[4]) == {"0", "1", "2", "3", "4"} and got[1]["11"] == 0.2


def test_books_park_stick_and_filter(spark):
    signal = lambda i, t: float(t) if i != 2 or t > 8 else None
    panel = months(spark, signal)
    assert 3 not in book(spec_queries.books(panel, regime(spark), spec_queries.Spec("s", 1)))  # three names only
    stuck = book(spec_queries.books(panel, regime(spark), spec_queries.Spec("s", 1, sticky=True)))
    assert stuck[3] == stuck[2]
    parked = book(spec_queries.books(panel, regime(spark, lambda i: i != 5), spec_queries.Spec("s", 1, regime=(("calm", 0.5, False), ("true", None, True)))))
    assert parked[3] == {"cash": 1.0} and parked[5] == {"cash": 1.0} and len(parked[1]) == 6
    banded = book(spec_queries.books(panel, regime(spark), spec_queries.Spec("s", 1, low=2.0, high=7.0, one_class=True, min_names=1, top_n=2)))
    assert set(banded[1]) == {"6", "4"}  # one class a company, the smaller ticker of equals
    small = months(spark, lambda i, t: float(t)).withColumn("adtv", F.col("ticker") * 10_000.0)
    assert set(book(spec_queries.books(small, regime(spark), spec_queries.Spec("s", 1, small=True, min_names=1, top_n=2)))[1]) == {"7", "6"}  # of tickers 3 to 11 at most the median


def test_sharpe_sleeves(spark):
    day = lambda n: dt.date(2020, 1, n)
    rows = [(day(n), "a", 0.02 if n % 2 else 0.01) for n in range(1, 9)] + [(day(n), "b", -0.02 if n % 2 else -0.01) for n in range(1, 9)]
    weights = lambda df: {(r.date.day, r.sleeve): round(r.weight, 6) for r in portfolio.rolling_sharpe_sleeves(df).collect()}
    got = weights(spark.createDataFrame(rows, "date date, sleeve string, ret double"))
    assert got[1, "a"] == got[3, "b"] == 0.5 and got[6, "a"] == 1.0 and got[6, "b"] == 0.0
    fallen = weights(spark.createDataFrame([(d, s, -abs(r)) for d, s, r in rows], "date date, sleeve string, ret double"))
    assert fallen[6, "cash"] == 1.0 and fallen[6, "a"] == 0.0


def test_prune_quality_and_cap(spark):
    m = spark.createDataFrame([("a", 0.1, 0.0), ("b", 0.9, 0.0), ("c", 0.1, 0.9)], "feature string, nan_rate double, flat_rate double")
    assert [r.feature for r in discovery.prune_quality(m).collect()] == ["a"]
    s = spark.createDataFrame([("a", -0.9), ("b", 0.5), ("c", 0.9)], "feature string, ic_ir double")
    assert [r.feature for r in discovery.capped(s, 2).collect()] == ["a", "c"]
