"""Running-sum windows and composed exponential moments against pandas."""

import numpy as np
import pytest

from tidewater.functions.ewm import ewm, ewm_all
from tidewater.functions.prefix import Rolling
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def series(spark):
    """Returns and prices, with gaps, a long silence and a level far above its spread."""
    rng = np.random.default_rng(3)
    rows = []
    for t, gap in enumerate((0.0, 0.1, 0.5)):
        x, missing = rng.normal(0, 0.05, 900).round(6), rng.random(900) < gap
        if t == 1:
            missing[300:520] = True
        price = (1000 + rng.normal(0, 0.01, 900).cumsum()).round(6)
        price[100:140] = price[100]
        rows += [(t, k, None if missing[k] else float(x[k]), float(price[k])) for k in range(900)]
    return spark.createDataFrame(rows, "ticker int, date int, x double, price double")


def by_ticker(df):
    frame = df.toPandas().sort_values(["ticker", "date"])
    return [g.astype(float) for _, g in frame.groupby("ticker")]


def close(got, expected, digits):
    assert (got.isna().to_numpy() == expected.isna().to_numpy()).all()
    assert np.nanmax(np.abs(got.to_numpy() - expected.to_numpy()), initial=0) < digits


@pytest.mark.parametrize("span", [5, 14, 40, 252])
def test_exponential_moments_equal_pandas(series, span):
    for g in by_ticker(ewm(series, "x", span)):
        e = g.x.ewm(span=span, adjust=True, min_periods=span)
        close(g.x_ewm_mean, e.mean(), 1e-12)
        if g.x.isna().mean() == 0:  # over long gaps the deviation of one heavy value is noise in either
            close(g.x_ewm_std, e.std(), 1e-12)


def test_exponential_moments_of_a_high_level(series):
    for g in by_ticker(ewm_all(series, {"a": ("price", 20), "b": ("x", 20)})):
        close(g.a_mean, g.price.ewm(span=20, adjust=True, min_periods=20).mean(), 1e-9)
        close(g.a_std, g.price.ewm(span=20, adjust=True, min_periods=20).std(), 1e-9)
        close(g.b_mean, g.x.ewm(span=20, adjust=True, min_periods=20).mean(), 1e-12)


def test_rolling_measures_equal_pandas(series):
    r = Rolling(series, {"x": F.col("x"), "p": F.col("price"), "a": F.when(F.col("x").isNotNull(), F.col("price"))}, [("x", "a")], ["x"], ["p", "a"])
    made = {
        "sum": r.sum("x", 20, 3), "mean": r.mean("x", 20), "std": r.std("x", 20, 5), "var": r.var("p", 30), "level": r.mean("p", 200, 100),
        "cov": r.cov("x", "a", 30, 10), "skew": r.skew("x", 20, 10), "kurt": r.kurt("x", 20, 10),
    }
    for g in by_ticker(r.select("ticker", "date", "x", "price", *(c.alias(k) for k, c in made.items()))):
        close(g["sum"], g.x.rolling(20, min_periods=3).sum(), 1e-12)
        close(g["mean"], g.x.rolling(20).mean(), 1e-12)
        close(g["std"], g.x.rolling(20, min_periods=5).std(), 1e-12)
        close(g["level"], g.price.rolling(200, min_periods=100).mean(), 1e-9)
        close(g["var"], g.price.rolling(30).apply(np.var, kwargs={"ddof": 1}, raw=True), 1e-9)
        close(g["cov"], g.x.rolling(30, min_periods=10).cov(g.price.where(g.x.notna())), 1e-9)
        close(g["skew"], g.x.rolling(20, min_periods=10).skew(), 1e-9)
        close(g["kurt"], g.x.rolling(20, min_periods=10).kurt(), 1e-9)


def test_no_spread_is_exactly_none(series):
    r = Rolling(series, {"p": F.col("price")}, exact=["p"])
    flat = r.select("ticker", "date", "price", r.std("p", 10).alias("std")).filter("date between 109 and 139")
    assert {x.std for x in flat.collect()} == {0.0}


def test_rolling_of_an_empty_panel(spark):
    empty = spark.createDataFrame([], "ticker int, date int, x double")
    r = Rolling(empty, {"x": F.col("x")})
    assert r.select("ticker", r.mean("x", 3).alias("m")).collect() == [] and ewm(empty, "x", 3).collect() == []




def test_moments_around_a_return_of_thousands(spark):
    """Fourth powers that fill more than 38 digits; what comes after one, and what a large first value leaves behind, keeps its digits."""
    rng = np.random.default_rng(5)
    rows = []
    for t, jumps in enumerate(((30, 31, 32), (0,))):
        x = rng.normal(0, 0.3, 120).round(6)
        x[list(jumps)] = (4000.0, 3900.5, 5200.25)[: len(jumps)]
        x[80:] = 0.0 if t else x[80:]
        rows += [(t, k, float(v)) for k, v in enumerate(x)]
    r = Rolling(spark.createDataFrame(rows, "ticker int, date int, x double"), {"x": F.col("x")}, moments=["x"], exact=["x"])
    made = {"std": r.std("x", 20, 5), "skew": r.skew("x", 20, 10), "kurt": r.kurt("x", 20, 10)}
    for g in by_ticker(r.select("ticker", "date", "x", *(c.alias(k) for k, c in made.items()))):
        frames = g.x.rolling(20, min_periods=10)
        flat = (frames.max() == frames.min()).to_numpy()
        assert (g["std"].to_numpy()[flat] == 0.0).all() and g["skew"][flat].isna().all() and g["kurt"][flat].isna().all()
        for name in ("skew", "kurt"):
            each = frames.apply(lambda v, name=name: getattr(v, name)(), raw=False)  # pandas' own sliding sums lose digits after a jump
            close(g[name][~flat], each[~flat], 1e-7)


def test_a_ratio_of_sums_at_a_half_goes_up(spark):
    """Mean prices with seven digits after the point, the last a five: doubles sent some of them down."""
    rng = np.random.default_rng(6)
    pieces = 2 ** rng.integers(0, 7, 4000) * 10000 // 2 ** rng.integers(0, 7, 4000) + 1
    cents = rng.integers(90000, 10**7, 4000)
    half = [(int(c), 20000) for c in cents if c % 2 and c % 5]  # c / 100 / 20000 ends in a five at the seventh digit
    rows = [(k, 0, c / 100, float(q)) for k, (c, q) in enumerate(half + list(zip(cents.tolist(), pieces.tolist())))]
    r = Rolling(spark.createDataFrame(rows, "ticker int, date int, paid double, pieces double"), {"paid": F.col("paid"), "pieces": F.col("pieces")})
    got = {x.ticker: x.price for x in r.select("ticker", r.ratio("paid", "pieces", 63, 1).alias("price")).collect()}
    expected = {k: (2 * round(c * 100) * 10**4 + int(q)) // (2 * int(q)) / 1e6 for k, _, c, q in rows}
    assert got == expected and len(half) > 1000
