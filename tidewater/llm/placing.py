"""Positions of rows in the order of their group, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut


def positions(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place from 0 of a row in its group, and ``total``, the rows of the group.

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over tasks; a row's place is its place in
    its task plus what earlier tasks hold of its group.  ``group`` has no nulls.  Rows that tie in ``order`` come in any order.
    """
    sorted_rows = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    counts = sorted_rows.groupBy("task", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tasks = Window.partitionBy(group)
    spans = counts.select("task", group, (F.sum("n").over(tasks.orderBy("task")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(tasks).alias("total"))
    return sorted_rows.join(spans, ["task", group]).withColumn("pos", F.col("at") + F.col("shift")).drop("task", "at", "shift")
