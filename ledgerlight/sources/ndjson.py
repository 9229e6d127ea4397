"""Line-delimited JSON: tolerant reading and line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_ndjson(spark: SparkSession, path: str, on_error: str = "keep") -> DataFrame:
    """Lines of NDJSON files: ``path, value, record`` (VARIANT). Blank lines go.

    ``on_error``: ``keep`` leaves broken lines in with a null record, ``drop`` removes them, ``fail`` stops the job.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    if on_error == "fail":
        return lines.withColumn("record", F.parse_json("value"))
    rows = lines.withColumn("record", F.try_parse_json("value"))
    if on_error == "drop":
        return rows.where(F.col("record").isNotNull())
    if on_error != "keep":
        raise ValueError("on_error is keep, drop or fail")
    return rows


def with_line_no(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, value``: 1-based line numbers per file, blank lines counted.

    Lines are numbered inside each file split and then shifted by the lines of the splits before; the shifts are a row
    per split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value",
        F.monotonically_increasing_id().alias("at"),
    )
    sizes = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("path", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("path", "split").orderBy("at")
    return lines.withColumn("n", F.row_number().over(inside)).join(shifts, ["path", "split"]).select(
        "path", (F.col("n") + F.col("shift")).alias("line_no"), "value"
    )
