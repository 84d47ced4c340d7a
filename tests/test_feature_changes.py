"""Changes and ratios to means of features: by name alone, as by feature and name."""

from pyspark.sql import functions as F

from tidewater.operators import discovery as d
from tidewater.plans import discovery_queries as q


def test_changes_equal_those_by_feature(spark):
    rows = [(k, t, float((7 * k + t) % 11) if k > t else None, None if (k * (t + 1)) % 3 == 0 else round((k - 9.5) / 7, 9)) for t in range(3) for k in range(40)]
    wide = spark.createDataFrame(rows, "date int, ticker int, a double, b double")
    long = d.to_long(wide, ["a", "b"])
    key = lambda df: sorted((*r[:3], round(r[3], 6)) for r in df.select("feature", "date", "ticker", "value").collect())
    for shift, n in ((4, 10), (12, 3)):
        assert key(d.changes_of(wide, ["a", "b"], shift, n)) == key(d.deltas(long, shift).union(d.ratios_to_mean(long, n)))


def test_level_two_is_not_sorted_by_feature(spark, tmp_path):
    """Each value as a row of its own made a task's sort several times the panel."""
    items = spark.range(60).select(F.expr("timestamp'2000-01-03' + make_interval(0, 0, int(id))").alias("l_shipdate"), (F.col("id") % 3).alias("l_suppkey"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), (F.col("id") + 100.0).alias("l_extendedprice"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = q.features_level2(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort [ticker" in plan and "Sort [feature" not in plan
    assert made.count() > 0
