"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write once to the checkpoint folder that all executors share, and read back.
shared_checkpoint = stored


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``__key``: (identifier, row number), so that rows that share an identifier can be told apart.

    ``docs`` has to be a table on disk, so that every reading numbers its rows alike.
    """
    return docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, parts: int = 1000) -> DataFrame:
    """Join each row with its group by ``key`` (a column or several), with no task for all rows of a very large group.

    ``size`` is the group's number of rows, so fewer than ``parts`` groups can hold more than one part in ``parts`` of
    all rows: that bounds the broadcast, whatever the input. The rows of those groups stay where they are, the others
    are shuffled. Both inputs are read twice and should be tables; every row has to have a group, no key is null.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.broadcast(groups.where(F.col(size) * parts > total))
    cold = groups.where(F.col(size) * parts <= total)
    rest = rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text`` as LONG; null counts as empty.

    A sentinel word is appended so that white space alone is consumed as well; every word
    and the space around it becomes one character.
    """
    padded = F.concat(F.coalesce(text, F.lit("")), F.lit(" x"))
    packed = F.regexp_replace(padded, rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    return (F.length(packed) - 1).cast("long")
