"""Pairs, turnover and the research matrix without joins of long features."""

import pytest

from tidewater.plans import composed_queries, discovery_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, joins", [(discovery_queries.feature_pairs, 0), (composed_queries.research_matrix, 0), (discovery_queries.feature_turnover, 1)])
def test_features_do_not_meet_each_other_in_joins(spark, query, joins):
    """A panel may join its grid; beyond that, only the dates before are looked up."""
    panel = lambda text: text.count("lineitem")
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    one = discovery_queries.a.panel(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert panel(plan) <= (joins + 1) * panel(one) and plan.count("Join") <= (joins + 1) * one.count("Join") + joins
