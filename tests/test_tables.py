"""Small table operations: admission of quotes, catalogues, readers of sector histories and filing indexes, value returns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import columns as c
from tidewater.operators import fundamentals, identity, merge, metrics
from tidewater.sources import filings


def test_quotes_are_admitted_by_the_rules_that_count_rejects(spark):
    rows = [("ok", 10.0, 5.0, 11.0, 9.0, None), ("no close", None, 5.0, 11.0, 9.0, "X"), ("no high", 10.0, 5.0, None, 9.0, "X"), ("idle", 10.0, 0.0, 11.0, 9.0, "X"), ("outside", 12.0, 5.0, 11.0, 9.0, "X"), ("crossed", 10.0, 5.0, 9.0, 11.0, "X")]
    bars = spark.createDataFrame(rows, "name string, close double, volume double, high double, low double, isin string")
    assert [(r.name, r.isin) for r in merge.admit_quotes(bars).collect()] == [("ok", "UNKNOWN")]
    assert {r.reason: r["count"] for r in merge.reject_counts(bars).collect()} == {"close": 1, "volume": 1, "range": 2, "close_outside": 2}


def test_catalog_ranks_by_the_best_score(spark):
    scored = spark.createDataFrame([("a", 5, 0.1, 0.5, 0.6), ("a", 20, 0.1, -0.9, 0.4), ("b", 5, 0.2, 0.7, 0.7)], "feature string, horizon int, mean_ic double, ic_ir double, pct_positive double")
    got = {r.feature: r for r in merge.catalog(scored).collect()}
    assert (got["a"]["rank"], got["b"]["rank"]) == (1, 2) and got["a"].horizons["20"].ic_ir == -0.9 and set(got["b"].horizons) == {"5"}


def test_sector_history_keeps_the_last_row_of_a_date(spark):
    raw = spark.createDataFrame([("12345678000190", "2020-01-31", "Power "), ("12.345.678/0001-90", "2020-01-31", "Water"), ("12345678000190", "2021-01-31", "nan"), ("bad", "2020-01-31", "Power")], "CNPJ_Companhia string, Data_Referencia string, Setor_Atividade string")
    assert [tuple(r) for r in filings.sector_history(raw).collect()] == [("12345678000190", dt.date(2020, 1, 31), "Water")]


def test_filing_index_falls_back(spark):
    raw = spark.createDataFrame([("12345678000190", "2020-03-31", None, None, "ITR"), ("12345678000190", "2020-03-31", "2020-05-10", "1", "ITR"), ("12345678000190", "2020-06-30", "2020-08-10", "2", "ITR")], "CNPJ_Companhia string, Data_Referencia string, Data_Entrega string, Versao string, Categoria string")
    got = sorted((r.filing_id, r.filing_date, r.version) for r in filings.filing_index(raw).collect())
    assert got == [("12345678000190_ITR_2020-03-31_1", dt.date(2020, 3, 31), 1), ("12345678000190_ITR_2020-06-30_2", dt.date(2020, 8, 10), 2)]
    assert filings.companies(filings.filing_index(raw), filings.filing_index(raw)).count() == 1


def test_standard_lots_and_company_figures(spark):
    t = spark.createDataFrame([("ABCD3", "ABCD"), ("ABCD11", "ABCD"), ("ABCD3F", "ABCD"), ("ABCD34", "ABCD"), ("EFGH4", "EFGH")], "ticker string, root string")
    lots = t.filter(c.standard_lot("ticker"))
    assert sorted(r.ticker for r in lots.collect()) == ["ABCD11", "ABCD3", "EFGH4"]
    figures = spark.createDataFrame([("ABCD", 7.0)], "root string, equity double")
    assert sorted((r.ticker, r.equity) for r in fundamentals.spread_to_tickers(figures, lots).collect()) == [("ABCD11", 7.0), ("ABCD3", 7.0)]


def test_value_returns_leave_contributions_out(spark):
    v = spark.createDataFrame([("s", 1, 100.0, None), ("s", 2, 121.0, 10.0), ("s", 3, 121.0, None)], "strategy string, date int, value double, contribution double")
    got = [r.ret for r in metrics.value_returns(v).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.11, 0.0])


def test_ever_members_by_one_pattern_and_by_several(spark):
    h = spark.createDataFrame([("a", "Water Supply"), ("b", None), ("c", "banks"), ("c", "POWER")], "company string, sector string")
    assert {r.company for r in identity.ever_member(h, ["water"]).collect()} == {"a"}
    assert {r.company for r in identity.ever_member(h, ["water", "Power"]).collect()} == {"a", "c"}


def test_versions_are_not_written_over(spark, tmp_path):
    path = str(tmp_path / "t")
    assert [merge.replace_table(spark.range(n), path) for n in (3, 5)] == [1, 2]
    assert merge.current_table(spark, path).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        spark.range(1).withColumn("x", F.lit(1)).write.mode("error").parquet(f"{path}/version=2")
