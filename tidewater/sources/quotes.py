"""Fixed-width daily quote files as bars."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import keep_one

# Fixed values of the file layout: first character (from 0) and end.
FIELDS = {"record": (0, 2), "date": (2, 10), "class": (10, 12), "ticker": (12, 24), "market": (24, 27), "open": (56, 69), "high": (69, 82), "low": (82, 95), "close": (108, 121), "volume": (170, 188), "factor": (210, 217), "isin": (230, 242)}
MARKETS = ("010", "011", "012", "013", "014", "015")
SHORTEST = 245


def field(name: str) -> Column:
    a, b = FIELDS[name]
    return F.substring("value", a + 1, b - a)


def implied_decimal(name: str) -> Column:
    """Digits with two implied decimals."""
    return F.try_divide(F.trim(field(name)).try_cast("long").cast("double"), F.lit(100.0))


def parse_quotes(lines: DataFrame) -> DataFrame:
    """Bars from raw lines (value, file): round-lot cash-market records with a valid date and a ticker; prices per unit of the quotation factor."""
    factor = F.trim(field("factor")).try_cast("int")
    factor = F.when(factor > 0, factor).otherwise(1)
    kept = lines.filter((F.length("value") >= SHORTEST) & (field("record") == "01") & (field("class") == "02") & field("market").isin(*MARKETS))
    bars = kept.select(
        F.try_to_timestamp(field("date"), F.lit("yyyyMMdd")).cast("date").alias("date"), F.upper(F.trim(field("ticker"))).alias("ticker"), F.trim(field("isin")).alias("isin"),
        *((implied_decimal(c) / factor).alias(c) for c in ("open", "high", "low", "close")), implied_decimal("volume").alias("volume"), factor.alias("quotation_factor"), "file",
    )
    return bars.filter("date is not null and ticker <> ''")


def read_quotes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bars of quote files in Latin-1; where a (ticker, date) repeats, the file whose name sorts last wins, and within it the later line."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.option("encoding", "ISO-8859-1").text(paths).select("value", place.alias("file"))
    return keep_one(parse_quotes(lines), ["ticker", "date"], ["file"]).drop("file")


def read_zipped_quotes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """As read_quotes, for ZIP archives of one or more quote files; an archive is one task's work."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        with archive.open(name) as member:
                            lines = io.TextIOWrapper(member, encoding="latin-1")
                            for n, block in enumerate(iter(lambda: list(itertools.islice(lines, 50_000)), [])):
                                yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in block], "path": path, "name": name, "line": range(50_000 * n, 50_000 * n + len(block))})

    made = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(unpack, "value string, path string, name string, line bigint")
    lines = made.select("value", F.struct("path", "name", "line").alias("file"))
    return keep_one(parse_quotes(lines), ["ticker", "date"], ["file"]).drop("file")
