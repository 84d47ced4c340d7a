"""Exponentially weighted moments, per instrument, with adjusted weights.

Weights decay without end, so no bounded frame is exact.  A run of rows is summed up as (sum, weight, ...) at its last row, and two
runs that follow each other compose: the earlier one's sums times the decay over the later one's length, plus the later
one's.  Rows are cut into blocks over which weights fall by 20 digits; within a block running sums of values over their decay are such sums, and of the
blocks before only the last two that hold any value still count in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 20


def ewm(df: DataFrame, x: str, span: int, key: str = "ticker", time: str = "date") -> DataFrame:
    """``df`` plus x_ewm_mean and x_ewm_std: NULL with fewer than ``span`` values so far."""
    return ewm_all(df, {f"{x}_ewm": (x, span)}, key, time)


def ewm_all(df: DataFrame, wanted: dict[str, tuple[str, int]], key: str = "ticker", time: str = "date") -> DataFrame:
    """``df`` plus name_mean and name_std for each name -> (column, span).  All go through the same steps, each with a block length of its own."""
    order = f"PARTITION BY `{key}` ORDER BY `{time}`"
    history, earlier = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    columns = sorted({x for x, _ in wanted.values()})
    keep = {name: 1 - 2 / (span + 1) for name, (_, span) in wanted.items()}
    size = {name: math.ceil(DIGITS * math.log(10) / -math.log(k)) if k > 0 else 1 for name, k in keep.items()}
    parts = ("s", "q", "w", "v")  # weighted values, their squares, weights, squared weights
    step = lambda df, made: df.withColumns({k: F.expr(e) for k, e in made.items()})
    out = step(df, {"_k": f"row_number() OVER ({order}) - 1"} | {f"_base_{x}": f"first(`{x}`, true) {history}" for x in columns} | {f"_known_{x}": f"count(`{x}`) {history}" for x in columns})
    out = step(out, {f"_dev_{x}": f"`{x}` - _base_{x}" for x in columns} | {f"_block_{n}": f"_k div {n}" for n in set(size.values())})
    sums = {}
    for name, (x, _) in wanted.items():
        local = f"OVER (PARTITION BY `{key}`, _block_{size[name]} ORDER BY `{time}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        up = f"CASE WHEN _dev_{x} IS NOT NULL THEN pow({1 / keep[name] if keep[name] > 0 else 1.0!r}D, _k % {size[name]}) END"
        down = f"pow({keep[name]!r}D, _k % {size[name]})"
        values = {"s": (f"({up}) * _dev_{x}", down), "q": (f"({up}) * _dev_{x} * _dev_{x}", down), "w": (up, down), "v": (f"pow({up}, 2D)", f"{down} * {down}")}
        sums |= {f"_{p}_{name}": f"coalesce(sum({v}) {local} * {scale}, 0D)" for p, (v, scale) in values.items()}
    out = step(out, sums)
    full = {name: f"_k % {size[name]} = {size[name] - 1} AND _w_{name} > 0" for name in wanted}
    state = {name: f"named_struct('k', _k, {', '.join(f"'{p}', _{p}_{name}" for p in parts)})" for name in wanted}
    out = step(out, {f"_last_{name}": f"last(CASE WHEN {full[name]} THEN {state[name]} END, true) {earlier}" for name in wanted})
    out = step(out, {f"_before_{name}": f"last(CASE WHEN {full[name]} THEN _last_{name} END, true) {earlier}" for name in wanted})

    def total(name: str, p: str) -> str:
        """The part over all rows: this block's own and what two blocks before it add; where this one has no value yet, as of the last block's end."""
        end = f"CASE WHEN _w_{name} > 0 THEN _k ELSE _last_{name}.k END"
        old = lambda c: f"coalesce({c}_{name}.{p} * pow({keep[name]!r}D, {2 if p == 'v' else 1} * ({end} - {c}_{name}.k)), 0D)"
        return f"_{p}_{name} + {old('_last')} + {old('_before')}"

    out = out.select(*df.columns, *(f"_{n}_{x}" for n in ("base", "known") for x in columns), *(F.expr(total(name, p)).alias(f"_{p}_{name}") for name in wanted for p in parts))
    results = []
    for name, (x, span) in wanted.items():
        s, q, weight, square = (f"_{p}_{name}" for p in parts)
        mean = f"try_divide({s}, {weight})"
        spread = f"greatest(try_divide({q}, {weight}) - {mean} * {mean}, 0D)"
        std = f"sqrt(try_divide({spread} * {weight} * {weight}, nullif({weight} * {weight} - {square}, 0D)))"
        results += [F.expr(f"CASE WHEN _known_{x} >= {span} THEN {mean} + _base_{x} END").alias(f"{name}_mean"), F.expr(f"CASE WHEN _known_{x} >= {max(span, 2)} THEN {std} END").alias(f"{name}_std")]
    return out.select(*df.columns, *results)
