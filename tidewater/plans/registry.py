"""The registered queries and the SQL that checks them.

Engines round halves differently, and prices have halves at the last digit; so both sides round by the same
arithmetic, floor(x * 10^n + 0.5) / 10^n.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def half_up(x: str | Column, n: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * float(10**n) + 0.5) / float(10**n)


def same_rounding(sql: str) -> str:
    """SQL with every round(x, n) written as half_up does it."""
    while m := re.search(r"\bround\(", sql):
        depth, comma, i = 1, None, m.end()
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        n = int(sql[comma + 1 : i - 1])
        sql = f"{sql[: m.start()]}(floor(({sql[m.end() : comma]}) * 1e{n} + 0.5) / 1e{n}){sql[i:]}"
    return sql


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = same_rounding(sql)
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded to six digits."""
    kinds = dict(df.dtypes)
    return df.select(*(half_up(c).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))
