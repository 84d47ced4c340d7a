"""The buy-and-hold index: members that start late."""

import datetime as dt

import pytest

from tidewater.operators import portfolio

D = [dt.date(2020, 1, k) for k in (6, 13, 20)]


def test_a_member_counts_from_the_first_cut_by_which_it_has_a_price(spark):
    """b stops on the first day; c, half of the weight, has its first price on the second."""
    p = [("a", D[0], 10.0), ("a", D[1], 11.0), ("a", D[2], 12.0), ("b", D[0], 5.0), ("c", D[1], 2.0), ("c", D[2], 3.0)]
    prices = spark.createDataFrame([("q", *r) for r in p], "period string, ticker string, date date, close double")
    members = spark.createDataFrame([("q", "a", 0.3), ("q", "b", 0.2), ("q", "c", 0.5)], "period string, ticker string, weight double")
    got = portfolio.index_level(prices, members).collect()
    first = (0.3 + 0.2) / (0.3 + 0.2)
    second = (0.3 * 1.2 + 0.5 * 1.5) / (0.3 + 0.5)
    assert len(got) == 1 and got[0].growth == pytest.approx(first * second)
