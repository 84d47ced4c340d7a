"""Rolling sums, means, deviations and covariances as differences of running sums.

A sliding frame is summed again for every row, so its cost is rows times width.  Running sums cost one addition a row, and every width is then
one look-back, all under the same order: one shuffle and one sort serve any number of widths.

Values are counted in whole units (a millionth unless given) held in doubles, so that their running sums are exact up to 2^53 units and a
difference loses nothing to what lies before the frame; each counts from its series' first one, which keeps them small.  Cubes and fourth
powers, and the squares of values that are large against their spread, are summed as decimals for the same reason.  A fourth power of a return
of some thousands fills more than a decimal's 38 digits, so powers are summed in two parts; values with such moments count from zero, lest one large first value be in all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1e-6
WHOLE, HUGE = "decimal(18,0)", "decimal(38,0)"
PART = "1e20D"  # units of a power's upper part


class Rolling:
    """Rolling measures of ``df``: the methods give columns, ``select`` computes what they need and selects them.

    Every method takes a value's name, the rows of the frame, and how many known values it needs (all rows unless given).  Expressions are
    written in SQL: a wide sweep has thousands of parts, and building each as an object takes longer than running it.
    """

    def __init__(self, df: DataFrame, values: dict[str, Column | tuple[Column, float]], products: Iterable[tuple[str, str]] = (), moments: Iterable[str] = (), exact: Iterable[str] = (), key: str = "ticker", time: str = "date"):
        """``values``: name to column, or to column and unit.  ``products``: pairs to have covariances of, both missing where either is.
        ``moments``: values around zero, such as returns, to have skewness and kurtosis of.  ``exact``: values that are large against their spread, such as prices, or some of which are large against others."""
        self.unit = {x: v[1] if isinstance(v, tuple) else UNIT for x, v in values.items()}
        self.over, self.exact = f"OVER (PARTITION BY `{key}` ORDER BY `{time}`", frozenset(exact)
        self.needed: dict[str, str] = {}
        history = f"{self.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        df = df.withColumns({f"_u_{x}": F.rint((v[0] if isinstance(v, tuple) else v).cast("double") / self.unit[x]) for x, v in values.items()})
        moments = tuple(moments)
        df = df.withColumns({f"_b_{x}": F.lit(0.0) if x in moments else F.expr(f"first(_u_{x}, true) {history}") for x in values})
        df = df.withColumns({f"_u_{x}": F.expr(f"_u_{x} - _b_{x}") for x in values})
        sums = {}
        for x in values:
            u = f"_u_{x}"
            square = f"CAST({u} AS {WHOLE}) * CAST({u} AS {WHOLE})" if x in self.exact else f"{u} * {u}"
            sums |= {f"_n_{x}": f"CASE WHEN {u} IS NOT NULL THEN 1D END", f"_s_{x}": u, f"_q_{x}": square}
        sums |= {f"_p_{x}_{y}": f"_u_{x} * _u_{y}" for x, y in products}
        for x in moments:
            for k in (3, 4):
                upper = f"rint(pow(_u_{x}, {k}) / {PART})"
                sums |= {f"_{k}h_{x}": f"CAST({upper} AS {HUGE})", f"_{k}l_{x}": f"CAST(pow(_u_{x}, {k}) - {upper} * {PART} AS {HUGE})"}
        self.df = df.withColumns({name: F.expr(f"sum(coalesce({v}, {self._zero(name)})) {history}") for name, v in sums.items()})

    def _zero(self, name: str) -> str:
        wide = name[1] in "34" or name[1] == "q" and name[3:] in self.exact
        return f"CAST(0 AS {HUGE})" if wide else "0D"

    def select(self, *columns: str | Column) -> DataFrame:
        """The columns, among them any of this object's measures made so far."""
        return self.df.withColumns({k: F.expr(e) for k, e in self.needed.items()}).select(*columns) if self.needed else self.df.select(*columns)

    def _sum(self, name: str, n: int, exact: bool = False) -> str:
        """The name of the column that has the sum over the last n rows."""
        out = f"_d{name}_{n}{'_exact' if exact else ''}"
        difference = f"{name} - coalesce(lag({name}, {n}) {self.over}), {self._zero(name)})"
        self.needed[out] = difference if exact else f"CAST({difference} AS DOUBLE)"
        return out

    def _if(self, x: str, n: int, least: int | None, value: str) -> Column:
        return F.expr(f"CASE WHEN {self._sum(f'_n_{x}', n)} >= {n if least is None else least} THEN {value} END")

    def _total(self, x: str, n: int) -> str:
        return f"({self._sum(f'_s_{x}', n)} + {self._sum(f'_n_{x}', n)} * coalesce(_b_{x}, 0D))"

    def sum(self, x: str, n: int, least: int | None = None) -> Column:
        return self._if(x, n, least, f"{self._total(x, n)} * {self.unit[x]!r}")

    def mean(self, x: str, n: int, least: int | None = None) -> Column:
        return self._if(x, n, least, f"try_divide({self._total(x, n)}, {self._sum(f'_n_{x}', n)}) * {self.unit[x]!r}")

    def ratio(self, x: str, y: str, n: int, least: int, digits: int = 6) -> Column:
        """Sum of x over sum of y, of values not below zero, rounded half up to digits; exact where doubles cannot tell a half from what is next to it."""
        a, b, scale = self._total(x, n), self._total(y, n), round(self.unit[x] / self.unit[y] * 10**digits)
        near, top, base = f"({a} / nullif({b}, 0D) * {scale}D)", f"CAST({a} AS {WHOLE}) * {2 * scale}", f"CAST({b} AS {WHOLE})"
        value = f"CASE WHEN abs({near} - floor({near}) - 0.5D) < 1e-4D + {near} * 1e-14D THEN CAST(({top} + {base}) div (2 * {base}) AS DOUBLE) ELSE CAST(floor({near} + 0.5D) AS DOUBLE) END / {10**digits}D"
        return F.expr(f"CASE WHEN {self._sum(f'_n_{x}', n)} >= {least} AND {self._sum(f'_n_{y}', n)} >= {least} AND {b} <> 0 THEN {value} END")

    def _square(self, x: str, n: int) -> str:
        """Count times the sum of squared deviations, in units; exactly zero where all values are alike."""
        k, s = self._sum(f"_n_{x}", n), self._sum(f"_s_{x}", n)
        if x in self.exact:
            return f"CAST(CAST({k} AS decimal(9,0)) * {self._sum(f'_q_{x}', n, True)} - CAST({s} AS {WHOLE}) * CAST({s} AS {WHOLE}) AS DOUBLE)"
        return f"greatest({k} * {self._sum(f'_q_{x}', n)} - {s} * {s}, 0D)"

    def _var(self, x: str, n: int) -> str:
        k = self._sum(f"_n_{x}", n)
        return f"(try_divide({self._square(x, n)}, nullif({k} * ({k} - 1), 0D)) * {self.unit[x] ** 2!r})"

    def var(self, x: str, n: int, least: int | None = None) -> Column:
        return self._if(x, n, least, self._var(x, n))

    def std(self, x: str, n: int, least: int | None = None) -> Column:
        return self._if(x, n, least, f"sqrt({self._var(x, n)})")

    def cov(self, x: str, y: str, n: int, least: int | None = None) -> Column:
        """Sample covariance of values that are missing together."""
        k, s, t, p = (self._sum(name, n) for name in (f"_n_{x}", f"_s_{x}", f"_s_{y}", f"_p_{x}_{y}"))
        return self._if(x, n, least, f"try_divide({k} * {p} - {s} * {t}, nullif({k} * ({k} - 1), 0D)) * {self.unit[x] * self.unit[y]!r}")

    def _central(self, x: str, n: int) -> tuple[str, str, str, str]:
        """Count and the mean squared, cubed and fourth deviations."""
        k, s, q = (self._sum(f"_{p}_{x}", n) for p in ("n", "s", "q"))
        c, f = (f"({self._sum(f'_{p}h_{x}', n)} * {PART} + {self._sum(f'_{p}l_{x}', n)})" for p in "34")
        m = f"({s} / nullif({k}, 0D))"
        return (
            k, f"(try_divide({self._square(x, n)}, {k} * {k}))", f"(({c} - 3 * {m} * {q} + 3 * {m} * {m} * {s} - {k} * {m} * {m} * {m}) / nullif({k}, 0D))",
            f"(({f} - 4 * {m} * {c} + 6 * {m} * {m} * {q} - 4 * {m} * {m} * {m} * {s} + {k} * {m} * {m} * {m} * {m}) / nullif({k}, 0D))",
        )

    def skew(self, x: str, n: int, least: int) -> Column:
        """Unbiased sample skewness; NULL without spread."""
        k, m2, m3, _ = self._central(x, n)
        return self._if(x, n, max(least, 3), f"try_divide({m3}, nullif(pow({m2}, 1.5D), 0D)) * sqrt({k} * ({k} - 1)) / ({k} - 2)")

    def kurt(self, x: str, n: int, least: int) -> Column:
        """Unbiased excess kurtosis; NULL without spread."""
        k, m2, _, m4 = self._central(x, n)
        excess = f"(try_divide({m4}, nullif({m2} * {m2}, 0D)) - 3)"
        return self._if(x, n, max(least, 4), f"({k} - 1) / (({k} - 2) * ({k} - 3)) * (({k} + 1) * {excess} + 6)")
