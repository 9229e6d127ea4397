"""Ranks over a whole table without a window over a single partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def global_rank(df: DataFrame, lead: str, ties: Sequence[Column], descending: bool = True, name: str = "rank") -> DataFrame:
    """Number the rows from 1 by ``lead`` (nulls last), then ``ties``.

    Sampled splitters over (``lead``, ``ties``) cut the rows into ordered ranges of like size, whatever values tie; a row's
    number is its place in its range plus the rows of the ranges before, of which there is one count each. The same input
    gives the same ranks in every run if ``ties`` decides between all rows.
    """
    order = [F.col(lead).desc_nulls_last() if descending else F.col(lead).asc_nulls_last(), *ties]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("__range").count().select("__range", F.coalesce(before, F.lit(0)).alias("__start"))  # a row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    ranked = placed.withColumn(name, place).join(F.broadcast(starts), "__range")
    return ranked.withColumn(name, (F.col(name) + F.col("__start")).cast("long")).drop("__range", "__start")
