"""The models' input: written once, the same rows as a pivot of the long features."""

from pyspark.sql import functions as F

from tidewater.operators import discovery as d
from tidewater.plans import adapters as a
from tidewater.plans import discovery_queries as q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_models_read_what_was_written_once(spark):
    table = q.modelled(spark, SF, *q.TARGETS)
    assert "LogicalRDD" in plan(table) and "Window" not in plan(table)
    long = q.features(spark, SF).groupBy("date", "ticker").pivot("feature", q.MODEL_FEATURES).agg(F.first("value")).dropna()
    for target, horizon in q.TARGETS.items():
        y = d.binary_targets(d.forward_returns(a.panel(spark, SF), [horizon])).select("date", "ticker", F.col(target.removesuffix("_13")).cast("double").alias("y"))
        expected = sorted(map(tuple, long.join(y, ["date", "ticker"]).select("date", "ticker", *q.MODEL_FEATURES, "y").collect()))
        train, test = q.split(table, target)
        assert sorted(map(tuple, train.union(test).collect())) == expected and expected
