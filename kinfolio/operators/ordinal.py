"""Positions in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def with_ordinal(rows: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds the position of each row, from 0: rows are dealt by ranges of the order and numbered inside each range.

    The dealt rows are written first, as ranges are drawn anew each time they are computed.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordinal")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(F.broadcast(offsets.drop("_n")), "_part").withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset")).drop("_part", "_offset")
