"""Regulator filings: delimited Latin-1 files of strings, as statements, share counts, validity, register and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import keep_one

# Legal deadlines in days, capital types by rank, account codes.
DEADLINE = {"ITR": 45, "DFP": 90, "FRE": 90}
CAPITAL_RANK = {"Emitido": 0, "Subscrito": 1, "Integralizado": 2}
INCOME_CODES, INCOME_LABELS = "3.", "LUCRO.*(CONSOLIDADO )?DO PERIODO|LUCRO/PREJUIZO.*PERIODO"
ACCOUNTS = {"3.01": "revenue", "3.05": "ebit", "1": "total_assets", "2.03": "equity", "1.01.01": "cash", "2.01.04": "debt_short", "2.02.01": "debt_long"}
ACCENTS = ("ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN")


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.csv(paths, sep=";", encoding="ISO-8859-1", header=True, inferSchema=False)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first column that is there, whatever the case; NULL if none is."""
    at = {c.upper(): c for c in df.columns}
    found = next((at[n.upper()] for n in names if n.upper() in at), None)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def tax_id(c: Column) -> Column:
    """Fourteen digits, or NULL."""
    digits = F.regexp_replace(c, "\\D", "")
    return F.when(F.length(digits) == 14, digits)


def parse_date(c: Column) -> Column:
    """ISO, dd/mm/yyyy or yyyymmdd; anything else, and 00000000, is NULL."""
    one = lambda f: F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date")
    return F.coalesce(one("yyyy-MM-dd"), one("dd/MM/yyyy"), one("yyyyMMdd"))


def local_number(c: Column) -> Column:
    """Text such as 1.234,56; what is no number counts as zero."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(c), "\\.", ""), ",", ".").try_cast("double"), F.lit(0.0))


def quarter_of(d: Column) -> Column:
    """1 to 3 for quarters that end in March, June, September; NULL for year ends and odd months."""
    return F.when(F.month(d) == 3, 1).when(F.month(d) == 6, 2).when(F.month(d) == 9, 3)


def account_label(c: Column) -> Column:
    """Accents off, upper case, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.upper(c), *ACCENTS), "\\s+", " "))


def with_fallback(consolidated: DataFrame, individual: DataFrame, key: str) -> DataFrame:
    """Consolidated rows, and individual ones of companies that have none."""
    return consolidated.unionByName(individual.join(consolidated.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def statements(raw: DataFrame, doc_type: str) -> DataFrame:
    """One row per filing version: identity, dates and one column per account, from long statement rows.

    Only rows of the latest exercise count; of several periods of one account the one that starts first (year to date).
    """
    x = raw.filter(F.upper(first_of(raw, "ORDEM_EXERC")).rlike("^[UÚ]LTIMO$")).select(
        tax_id(first_of(raw, "CNPJ_CIA")).alias("cnpj"), parse_date(first_of(raw, "DT_REFER")).alias("period_end"), first_of(raw, "VERSAO").try_cast("int").alias("version"),
        parse_date(first_of(raw, "DT_RECEB")).alias("filing_date"), parse_date(first_of(raw, "DT_INI_EXERC")).alias("start"),
        first_of(raw, "CD_CONTA").alias("code"), account_label(first_of(raw, "DS_CONTA")).alias("label"), first_of(raw, "VL_CONTA").try_cast("double").alias("value"),
    ).filter("cnpj is not null and period_end is not null")
    keys = ["cnpj", "period_end", "version"]
    x = x.withColumn("_first", F.min("start").over(Window.partitionBy(*keys))).filter("start is null or start = _first")
    by_code = F.create_map(*(F.lit(v) for kv in ACCOUNTS.items() for v in kv))[F.col("code")]
    income = F.col("code").startswith(INCOME_CODES) & F.col("label").rlike(INCOME_LABELS)
    x = x.withColumn("metric", F.coalesce(by_code, F.when(income, "net_income"))).filter("metric is not null")
    wide = x.groupBy(*keys).pivot("metric", [*ACCOUNTS.values(), "net_income"]).agg(F.max_by("value", "code"))
    dates = x.groupBy(*keys).agg(F.min("filing_date").alias("filing_date"))
    debts = [F.col(c) for c in ("debt_short", "debt_long", "cash")]
    net = F.when(debts[0].isNotNull() | debts[1].isNotNull() | debts[2].isNotNull(), F.coalesce(debts[0], F.lit(0.0)) + F.coalesce(debts[1], F.lit(0.0)) - F.coalesce(debts[2], F.lit(0.0)))
    out = wide.join(dates, keys)
    return out.select(
        F.concat_ws("_", "cnpj", F.lit(doc_type), F.date_format("period_end", "yyyy-MM-dd"), "version").alias("filing_id"), *keys, F.lit(doc_type).alias("doc_type"),
        F.coalesce("filing_date", F.date_add("period_end", DEADLINE[doc_type])).alias("filing_date"), F.year("period_end").alias("fiscal_year"), quarter_of(F.col("period_end")).alias("quarter"),
        "revenue", "ebit", "net_income", "total_assets", "equity", net.alias("net_debt"),
    )


def share_capital(raw: DataFrame) -> DataFrame:
    """One row per company and period: total, common and preferred shares of the latest version, best capital type, latest authorisation."""
    num = lambda n: first_of(raw, n).try_cast("double")
    rank = F.create_map(*(F.lit(v) for kv in CAPITAL_RANK.items() for v in kv))[first_of(raw, "Tipo_Capital")]
    x = raw.select(
        tax_id(first_of(raw, "CNPJ_Companhia")).alias("cnpj"), parse_date(first_of(raw, "Data_Referencia")).alias("period_end"), first_of(raw, "Versao").try_cast("int").alias("version"), rank.alias("rank"),
        parse_date(first_of(raw, "Data_Autorizacao_Aprovacao")).alias("authorised"), num("Quantidade_Total_Acoes").alias("total"), num("Quantidade_Acoes_Ordinarias").alias("common"), num("Quantidade_Acoes_Preferenciais").alias("preferred"),
    ).filter("cnpj is not null and period_end is not null")
    typed = x.agg(F.max(F.col("rank").isNotNull()).alias("_typed"))  # one row: whether any row has a known type
    x = x.crossJoin(F.broadcast(typed)).filter("rank is not null or not _typed")
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(F.coalesce("common", F.lit(0.0)) + F.coalesce("preferred", F.lit(0.0)))
    best = Window.partitionBy("cnpj", "period_end").orderBy(F.desc("version"), F.desc_nulls_last("rank"), F.desc_nulls_last("authorised"))
    one = x.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    positive = lambda c: F.when(c > 0, c)
    return one.select("cnpj", "period_end", "version", positive(total).alias("shares"), positive(F.col("common")).alias("common"), positive(F.col("preferred")).alias("preferred"))


def ticker_validity(raw: DataFrame) -> DataFrame:
    """(cnpj, ticker, root, market, start, end): valid tickers only, the last row of each (cnpj, ticker, start)."""
    x = raw.select(
        tax_id(first_of(raw, "CNPJ_Companhia", "CNPJ_CIA")).alias("cnpj"), F.upper(F.trim(first_of(raw, "Codigo_Negociacao"))).alias("ticker"), first_of(raw, "Mercado").alias("market"),
        parse_date(first_of(raw, "Data_Inicio_Negociacao")).alias("start"), parse_date(first_of(raw, "Data_Fim_Negociacao")).alias("end"), F.monotonically_increasing_id().alias("_row"),
    ).filter(F.col("cnpj").isNotNull() & F.col("ticker").rlike("^[A-Z]{4}\\d{1,2}$"))
    return keep_one(x, ["cnpj", "ticker", "start"], ["_row"]).select("cnpj", "ticker", F.substring("ticker", 1, 4).alias("root"), "market", "start", "end")


def sector_history(raw: DataFrame) -> DataFrame:
    x = raw.select(tax_id(first_of(raw, "CNPJ_Companhia", "CNPJ_CIA")).alias("cnpj"), parse_date(first_of(raw, "Data_Referencia")).alias("ref_date"), F.trim(first_of(raw, "Setor_Atividade")).alias("sector"), F.monotonically_increasing_id().alias("_row"))
    return keep_one(x.filter("cnpj is not null and sector <> '' and lower(sector) <> 'nan'"), ["cnpj", "ref_date"], ["_row"]).drop("_row")


def register(raw: DataFrame) -> DataFrame:
    return raw.select(
        tax_id(first_of(raw, "CNPJ_CIA")).alias("cnpj"), F.lpad(F.trim(first_of(raw, "CD_CVM")), 6, "0").alias("code"), F.trim(first_of(raw, "DENOM_SOCIAL")).alias("name"),
        parse_date(first_of(raw, "DT_REG")).alias("listing_date"), parse_date(first_of(raw, "DT_CANCEL")).alias("delisting_date"), (F.upper(F.trim(first_of(raw, "SIT"))) == "ATIVO").alias("is_active"),
    ).filter("cnpj is not null")


def filing_index(raw: DataFrame) -> DataFrame:
    """Filings without figures: the date falls back to the period's end, the version to 1; the first row of an id stays."""
    x = raw.select(tax_id(first_of(raw, "CNPJ_Companhia", "CNPJ_CIA")).alias("cnpj"), parse_date(first_of(raw, "Data_Referencia", "DT_REFER")).alias("period_end"), parse_date(first_of(raw, "Data_Entrega", "DT_RECEB")).alias("_d"), first_of(raw, "Versao").try_cast("int").alias("_v"), first_of(raw, "Categoria").alias("category"), F.monotonically_increasing_id().alias("_row"))
    x = x.filter("cnpj is not null and period_end is not null").withColumns({"filing_date": F.coalesce("_d", "period_end"), "version": F.coalesce("_v", F.lit(1))})
    x = x.withColumn("filing_id", F.concat_ws("_", "cnpj", "category", F.col("period_end").cast("string"), "version"))
    return keep_one(x, ["filing_id"], ["_row"], last=False).select("filing_id", "cnpj", "category", "period_end", "filing_date", "version")


def companies(*tables: DataFrame) -> DataFrame:
    """Distinct companies of several tables."""
    out = tables[0].select("cnpj")
    for t in tables[1:]:
        out = out.union(t.select("cnpj"))
    return out.distinct()
