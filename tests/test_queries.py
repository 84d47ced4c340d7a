"""Registered queries against their SQL in DuckDB, on the smallest given tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
NAMES = ["momentum_rank", "rolling_basic", "beta_autocorr", "cross_section", "calendar_ends", "pit_metrics", "trailing_twelve_months", "split_adjusted_bars", "detected_splits", "portfolio_multifactor", "capped_cap_weights", "tax_carry_forward", "ic_summary", "two_leg_value", "upserted_orders",
         "portfolio_adaptive_low_vol", "portfolio_low_pe", "portfolio_teva_ivvb_cdi", "rolling_sharpe_books", "regime_budgets", "signal_guard", "mean_reversion_composite", "drifted_nav", "ic_decay", "feature_pairs",
         "identity_map", "isin_tickers", "merged_statements", "rebalance_calendars", "index_constituents", "reversal_gates",
         "level0_sweep", "sweep_level2", "portfolio_qdl", "portfolio_qdl_ivvb_cdi_thirds", "portfolio_baseline_thirds", "portfolio_low_vol_index", "portfolio_mean_reversion", "portfolio_tilt_absorb", "portfolio_tilt_floor", "portfolio_besst",
         "portfolio_teva_ivvb_cdi", "cap_weighted_index", "nav_metric_row", "feature_correlations", "ewma_volatility", "bounded_sleeves"]


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object and df[c].map(lambda v: hasattr(v, "isoformat")).any() or str(df[c].dtype).startswith("datetime"):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d")
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float) + 0.0
    df = df.astype(object).where(df.notna(), None)
    return sorted(map(tuple, df.itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    expected = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_all_feature_pairs_equal_brute_force(spark):
    from tidewater.plans import discovery_queries as q

    f = q.features(spark, str(DATA)).toPandas()
    value = {name: part.set_index(["date", "ticker"]).value.to_dict() for name, part in f.groupby("feature")}
    expected = {}
    for a in q.CATEGORY:
        for b in q.CATEGORY:
            if a < b and q.CATEGORY[a] != q.CATEGORY[b]:
                for k in value[a].keys() & value[b].keys():
                    x, y = value[a][k], value[b][k]
                    made = {"ratio": x / y if y else None, "product": x * y, "diff": x - y}
                    expected |= {(f"{op}__{a}__{b}", *k): v for op, v in made.items() if v is not None}
    got = __spark_entry__.queries()["feature_pairs"](spark, str(DATA)).toPandas()
    assert dict(zip(zip(got.feature, got.date, got.ticker), got.value)) == expected and len(got) == len(expected)
    assert got.feature.nunique() == 39 and (got.value.abs() >= 1e6).any()


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_capped_weights_of_all_dates_equal_brute_force(spark):
    from tidewater.plans import portfolio_queries as q

    s = q.signals(spark, str(DATA)).filter("adtv > 0").select("date", "ticker", "adtv").toPandas()
    expected = {}
    for date, part in s.groupby("date"):
        part = part.sort_values(["adtv", "ticker"], ascending=[False, True])
        w = list(part.adtv / part.adtv.sum())
        scale = lambda k: (1 - 0.02 * k) / (1 - sum(w[:k]))
        first = next((k for k in range(len(w)) if 0.02 * k <= 1 and sum(w[:k]) < 1 and w[k] * scale(k) <= 0.02 * (1 + 1e-12)), len(w))
        expected |= {(date, t): 0.02 if k < first else w[k] * scale(first) for k, t in enumerate(part.ticker)}
    got = __spark_entry__.queries()["capped_cap_weights"](spark, str(DATA)).toPandas()
    found = dict(zip(zip(got.date, got.ticker), got.weight))
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-6 for k in found)
    assert str(got.date.min()) < "1996-01-01"
