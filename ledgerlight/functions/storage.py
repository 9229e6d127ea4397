"""Tables that are written once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, as in tests, a temporary one is taken in local mode; a cluster has to name it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerlight-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder; its lineage is cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
