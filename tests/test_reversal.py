"""Month-end levels of the mean-reversion scores, from a ticker's bars."""

import numpy as np
import pandas as pd
import pytest

from tidewater.plans import reversal_queries as q


def brute(bars, starts, days):
    b = bars.set_index("_k").reindex(range(days))
    close = b.close.ffill()
    price = (b.volume.rolling(63, min_periods=1).sum() / (b.volume / close).rolling(63, min_periods=1).sum()).ffill().round(6)
    ret, span = (price / price.shift() - 1).round(9), ((b.high.ffill() - b.low.ffill()) / close).round(9)
    auto = lambda n: ret.rolling(n, min_periods=n // 2).cov(ret.shift()) / ret.where(ret.shift().notna()).rolling(n, min_periods=n // 2).apply(lambda v: ret[v.index].var(), raw=False)
    hlr, wr, atr = span.rolling(20, min_periods=10).mean().shift(), (ret > 0).astype(float).rolling(20, min_periods=10).mean(), ret.abs().ewm(span=14, min_periods=14).mean()
    vol = {n: ret.rolling(n, min_periods=n // 2).apply(np.std, kwargs={"ddof": 1}, raw=False).shift() for n in (20, 60)}
    own = lambda x: x / x.rolling(60, min_periods=30).mean()
    made = pd.DataFrame({"vol20": vol[20], "hlr": hlr, "vol_ratio": vol[60] / vol[20], "ret60": price / price.shift(60) - 1, "ac20": auto(20).shift(), "range_ratio": own(hlr), "wins": own(wr), "swings": own(atr)})
    month = pd.Series(np.searchsorted(starts, np.arange(days), side="right") - 1)
    return made.groupby(month).last().assign(px=price.groupby(month).nth(-1).to_numpy(), adtv=b.volume.groupby(month).mean())


def test_month_levels_equal_pandas():
    rng = np.random.default_rng(2)
    days, k = 700, np.sort(rng.choice(np.arange(40, 700), 330, replace=False))
    quantity, paid = rng.integers(1, 51, 330), rng.uniform(900, 1500, 330).round(2)
    bars = pd.DataFrame({"_k": k, "high": paid / quantity * 1.2, "low": paid / quantity * rng.uniform(0.5, 1, 330), "close": paid / quantity, "volume": paid})
    starts = np.arange(0, days, 30)
    got, expected = pd.DataFrame(q.month_levels(bars, starts, days)), brute(bars, starts, days)
    for name in expected:
        x, y = got[name].to_numpy(), expected[name].to_numpy()
        assert (np.isnan(x) == np.isnan(y)).all(), name
        assert np.allclose(x, y, rtol=2e-6, atol=2e-4 if name == "adtv" else 2e-6, equal_nan=True), name


def test_halves_are_told_by_whole_numbers():
    """Half a unit of the last digit goes up and what is just under it does not, though a double cannot tell; so before, prices went either way."""
    a, b = np.array([2 * 10**12 + 1, 2 * 10**15 - 1, 7]), np.array([2 * 10**6, 2 * 10**15, 0])
    assert q.whole_ratio(a, b, 6, b != 0)[:2].tolist() == [1000000.000001, 1.0] and np.isnan(q.whole_ratio(a, b, 6, b != 0)[2])
    halves = np.arange(1, 2001, 2) * 10**4 + 5 * 10**3
    assert (q.whole_ratio(halves, np.full(1000, 10**10), 6, np.full(1000, True)) == (np.arange(1, 2001, 2) + 1) / 1e6).all()


def test_flat_prices_do_not_vary():
    bars = pd.DataFrame({"_k": [0], "high": [7.0], "low": [7.0], "close": [7.0], "volume": [700.0]})
    got = q.month_levels(bars, np.arange(0, 300, 30), 300)
    assert got["vol20"][-1] == 0.0 and all(np.isnan(got[x]).all() for x in ("vol_ratio", "ac20", "ac60", "range_ratio", "swings"))


@pytest.mark.parametrize("size", [3e9, 8e11])
def test_variance_keeps_its_digits_after_a_jump(size):
    x = np.random.default_rng(4).normal(0, 1e7, 300).round()
    x[100] = size
    x[200:] = 12345.0
    got, expected = q.variance(x, 20), pd.Series(x).rolling(20, min_periods=10).apply(np.var, kwargs={"ddof": 1}, raw=False).to_numpy()
    assert np.allclose(got, expected, rtol=1e-9, equal_nan=True) and (got[219:] == 0.0).all()


def test_dense_days_are_no_rows(spark, tmp_path):
    """A ticker's days without a bar are made and used up in its own step: nothing is spread over the calendar."""
    spark.sql("select timestamp'2000-01-03' + make_interval(0, 0, 0, int(i)) as l_shipdate, i % 3 as l_suppkey, i as l_orderkey, 1 as l_linenumber, 2D as l_quantity, 100D + i as l_extendedprice from (select explode(sequence(0L, 400L)) as i)").write.parquet(f"{tmp_path}/lineitem.parquet")
    levels = q.levels(spark, str(tmp_path))
    assert "explode" not in levels._jdf.queryExecution().optimizedPlan().toString()
    assert levels.count() == 3 * 14
