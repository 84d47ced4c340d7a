"""Raw files written by the test, read by the sources."""

import datetime as dt
import json
import zipfile

from tidewater.operators import merge
from tidewater.sources import corporate_events, filings, quotes


def line(date="20200102", ticker="ABCD3", record="01", lot="02", market="010", close=1000, factor=1, isin="BRABCDACNOR1", length=245):
    s = [" "] * length
    for at, text in ((0, record), (2, date), (10, lot), (12, ticker), (24, market), (56, f"{close:013d}"), (69, f"{close + 100:013d}"), (82, f"{close - 100:013d}"), (108, f"{close:013d}"), (170, f"{123456:018d}"), (210, f"{factor:07d}"), (230, isin)):
        s[at : at + len(text)] = text
    return "".join(s)[:length]


def test_quotes(spark, tmp_path):
    kept = [line(), line(ticker="abcd4", factor=1000, close=50000), line(ticker="EFGH3", factor=0)]
    dropped = [line(record="00"), line(lot="96"), line(market="020"), line(date="20201340"), line(ticker=""), line()[:240]]
    (tmp_path / "q2019.txt").write_text("\n".join(kept + dropped), encoding="latin-1")
    (tmp_path / "q2020.txt").write_text(line(close=2000), encoding="latin-1")
    got = {r["ticker"]: r for r in quotes.read_quotes(spark, str(tmp_path)).collect()}
    assert set(got) == {"ABCD3", "ABCD4", "EFGH3"}
    assert got["ABCD3"]["close"] == 20.0 and got["ABCD3"]["date"] == dt.date(2020, 1, 2)  # the later file wins
    assert got["ABCD4"]["close"] == 0.5 and got["ABCD4"]["volume"] == 1234.56 and got["EFGH3"]["quotation_factor"] == 1


def write(path, header, rows):
    path.write_text("\n".join(";".join(map(str, r)) for r in [header, *rows]), encoding="latin-1")
    return str(path)


def test_statements(spark, tmp_path):
    header = ["CNPJ_CIA", "DT_REFER", "DT_RECEB", "VERSAO", "ORDEM_EXERC", "CD_CONTA", "DS_CONTA", "VL_CONTA", "DT_INI_EXERC"]
    c = "12.345.678/0001-90"
    rows = [
        [c, "2020-06-30", "2020-08-10", 1, "ÚLTIMO", "3.01", "Receita", 100, "2020-01-01"], [c, "2020-06-30", "2020-08-10", 1, "ÚLTIMO", "3.01", "Receita", 60, "2020-04-01"],
        [c, "2020-06-30", "2020-08-10", 1, "PENÚLTIMO", "3.01", "Receita", 1, "2019-01-01"], [c, "2020-06-30", "2020-08-10", 1, "ÚLTIMO", "3.11", "Lucro/Prejuízo  do Período", 7, "2020-01-01"],
        [c, "2020-06-30", "2020-08-10", 1, "ÚLTIMO", "2.01.04", "Empréstimos", 30, ""], ["bad", "2020-06-30", "", 1, "ÚLTIMO", "3.01", "Receita", 5, ""],
    ]
    out = filings.statements(filings.read_delimited(spark, write(tmp_path / "s.csv", header, rows)), "ITR").collect()
    assert len(out) == 1
    r = out[0]
    assert (r["cnpj"], r["revenue"], r["net_income"], r["net_debt"], r["quarter"], r["version"]) == ("12345678000190", 100.0, 7.0, 30.0, 2, 1)
    assert r["filing_date"] == dt.date(2020, 8, 10) and r["filing_id"] == "12345678000190_ITR_2020-06-30_1"


def test_share_capital_and_validity(spark, tmp_path):
    c = "12345678000190"
    header = ["CNPJ_Companhia", "Data_Referencia", "Versao", "Tipo_Capital", "Data_Autorizacao_Aprovacao", "Quantidade_Total_Acoes", "Quantidade_Acoes_Ordinarias", "Quantidade_Acoes_Preferenciais"]
    rows = [[c, "2020-12-31", 1, "Integralizado", "2020-01-01", 5, 5, 0], [c, "2020-12-31", 2, "Emitido", "2020-01-01", 6, 6, 0], [c, "2020-12-31", 2, "Integralizado", "2019-01-01", 0, 4, 3], [c, "2020-12-31", 2, "Outro", "2021-01-01", 99, 9, 9]]
    (r,) = filings.share_capital(filings.read_delimited(spark, write(tmp_path / "f.csv", header, rows))).collect()
    assert (r["shares"], r["common"], r["preferred"]) == (7.0, 4.0, 3.0)
    header = ["CNPJ_Companhia", "CODIGO_NEGOCIACAO", "Mercado", "Data_Inicio_Negociacao", "Data_Fim_Negociacao"]
    v = filings.ticker_validity(filings.read_delimited(spark, write(tmp_path / "v.csv", header, [[c, "abcd3", "Bolsa", "01/02/2010", ""], [c, "toolong33", "", "", ""]]))).collect()
    assert [(r["ticker"], r["root"], r["start"]) for r in v] == [("ABCD3", "ABCD", dt.date(2010, 2, 1))]
    header = ["CNPJ_CIA", "CD_CVM", "DENOM_SOCIAL", "DT_REG", "DT_CANCEL", "SIT"]
    (g,) = filings.register(filings.read_delimited(spark, write(tmp_path / "r.csv", header, [[c, "123", "X ", "2001-01-01", "", " ativo "]]))).collect()
    assert g["is_active"] and g["code"] == "000123"


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"label": "DIVIDENDO", "rate": "1.234,50", "isinCode": "X", "lastDatePrior": "05/03/2020"}, {"label": "DIVIDENDO", "rate": "0", "isinCode": "X", "lastDatePrior": "05/03/2020"}, {"label": "JRS CAP PROPRIO", "valueCash": "0,5", "lastDatePrior": "05/03/2020", "typeStock": "PN", "tradingName": "ABCD"}]))
    isins = spark.createDataFrame([("ABCD4", "Y")], "ticker string, isin string")
    got = {(r["isin"], r["event_type"], r["value"]) for r in corporate_events.cash_events(corporate_events.read_events(spark, str(tmp_path / "e.json")), isins).collect()}
    assert got == {("X", "CASH_DIVIDEND", 1234.5), ("Y", "JCP", 0.5)}
    (tmp_path / "s.json").write_text(json.dumps([{"label": k, "factor": f, "isinCode": "X", "lastDatePrior": "05/03/2020"} for k, f in (("DESDOBRAMENTO", "2"), ("BONIFICAÇÃO", "10"), ("GRUPAMENTO", "0,00001"), ("RESG TOTAL RV", "1"), ("CISAO", "1"), ("OTHER", "1"))]))
    got = {r["label"]: (r["action"], r["reason"]) for r in corporate_events.classify_share_events(corporate_events.read_events(spark, str(tmp_path / "s.json"))).collect()}
    assert got["DESDOBRAMENTO"] == ("STOCK_SPLIT", None) and got["BONIFICACAO"] == ("BONUS_SHARES", None) and got["GRUPAMENTO"][1] == "extreme_factor"
    assert (got["RESG TOTAL RV"][1], got["CISAO"][1], got["OTHER"][1]) == ("delisting_event", "needs_manual_review", "unrecognized_label")


def test_fallback_and_parsers(spark):
    con, ind = spark.createDataFrame([("a", 1)], "cnpj string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "cnpj string, v int")
    assert {(r.cnpj, r.v) for r in filings.with_fallback(con, ind, "cnpj").collect()} == {("a", 1), ("b", 3)}
    d = spark.createDataFrame([("2020-01-02",), ("02/01/2020",), ("20200102",), ("00000000",), ("x",)], "d string")
    assert [r[0] for r in d.select(filings.parse_date(d["d"])).collect()] == [dt.date(2020, 1, 2)] * 3 + [None, None]


def test_feature_store_and_replace(spark, tmp_path):
    f = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "feature string, date int, value double")
    merge.write_features(f, str(tmp_path / "f"))
    assert [r["value"] for r in merge.read_features(spark, str(tmp_path / "f"), ["b"]).collect()] == [2.0]
    path = str(tmp_path / "t")
    assert merge.replace_table(f, path) == 1
    assert merge.replace_table(merge.current_table(spark, path).filter("feature = 'a'"), path) == 2  # reads what it replaces
    assert [tuple(r) for r in merge.current_table(spark, path).collect()] == [("a", 1, 1.0)]


def test_zipped_quotes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q2020.zip", "w") as archive:
        archive.writestr("a.txt", "\r\n".join([line(close=1000), line(close=3000), line(ticker="EFGH3")]).encode("latin-1"))
        archive.writestr("b.txt", line(ticker="EFGH3", close=7000).encode("latin-1"))
    got = {r["ticker"]: r["close"] for r in quotes.read_zipped_quotes(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {"ABCD3": 30.0, "EFGH3": 70.0}  # the later line of a file, the later file of an archive


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("f", 4, 1, 0.1), ("f", 4, 2, 0.2)], "feature string, horizon int, date int, ic double")
    new = spark.createDataFrame([("f", 4, 2, 0.9), ("g", 4, 2, 0.3)], old.schema)
    assert {tuple(r) for r in merge.append_ic(old, new).collect()} == {("f", 4, 1, 0.1), ("f", 4, 2, 0.9), ("g", 4, 2, 0.3)}
    merge.write_results(spark.createDataFrame([("nav", 1, 1.0)], "series string, date int, value double"), {"name": "x"}, str(tmp_path / "r"), "run1")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "r" / "series")).collect()] == [("nav", 1, 1.0, "run1")]
    merge.write_importances(spark.createDataFrame([("a", 0.7, 1)], "feature string, importance double, place int"), spark.createDataFrame([(0.5,)], "auc double"), str(tmp_path / "i"))
    assert spark.read.option("header", True).csv(str(tmp_path / "i" / "importances")).first()["feature"] == "a" and spark.read.json(str(tmp_path / "i" / "measures")).first()["auc"] == 0.5
    quotes_ = spark.createDataFrame([("A3", "i", 1, 9.0), ("B3", "i", 1, 8.0)], "ticker string, isin string, date int, close double")
    back = merge.write_back(quotes_, spark.createDataFrame([("A3", "i", 1, 4.5, 1.5)], "ticker string, isin string, date int, close double, adj double"), ["close", "adj"])
    assert {(r["ticker"], r["close"], r["adj"]) for r in back.collect()} == {("A3", 4.5, 1.5), ("B3", 8.0, None)}
    bad = spark.createDataFrame([(1.0, 0.0, 2.0, 0.5), (5.0, 1.0, 2.0, 0.5), (None, 1.0, 1.0, 2.0)], "close double, volume double, high double, low double")
    assert dict(map(tuple, merge.reject_counts(bad).collect())) == {"close": 1, "volume": 1, "range": 1, "close_outside": 1}
