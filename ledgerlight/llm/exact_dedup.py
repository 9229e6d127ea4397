"""Exact duplicate documents by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, shared_checkpoint, shuffle_partitions

#: Characters of the text's start and end that the sampled splitters see. Splitters are drawn from samples
#: that pass through the driver, so the sampled key has to be short whatever the texts are.
LEAD_CHARS = 64


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", lead_chars: int = LEAD_CHARS,
    parts: int | None = None,
) -> DataFrame:
    """Group equal texts (equal after lower-casing A-Z only) and choose the row of each group that stays.

    Texts are range-partitioned by sampled splitters over (leading characters, length, last characters, salt). Each
    partition is sorted by whole normalised texts, on disk if need be, and neighbours are compared in full: a run of equal
    texts is a group. Only keys with more than one part in ``parts`` of all rows (default: a quarter of a partition's
    share), of which there are fewer than ``parts``, have a salt (from the identifier), so that one very frequent text
    spreads over many partitions; its runs, one row each, are joined end to end by comparing whole texts again.

    Returns one row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    * null text counts as the empty text; all empty texts are one group;
    * a null identifier ranks below every other; of rows that tie on the identifier one stays;
    * an empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    n = shuffle_partitions(docs)
    parts = parts or 4 * n
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = [ascii_lower(F.substring("text", 1, lead_chars)), F.octet_length("text"), ascii_lower(F.right("text", F.lit(lead_chars)))]
    rows = rows.select("id", "text", key[0].alias("lead"), key[1].alias("size"), key[2].alias("tail"))
    place = F.xxhash64("lead", "size", "tail")
    counts = shared_checkpoint(rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("copies")))
    total = counts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = counts.where(F.col("copies") * parts > total).select("place", F.lit(True).alias("hot"))  # fewer than ``parts`` rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.col("id")), F.lit(n)))
    salted = rows.join(F.broadcast(hot), place == F.col("place"), "left").withColumn("salt", salt)
    best = (lambda c: F.max(c)) if keep == "largest" else (lambda c: F.min(c))
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    dealt = ("lead", "size", "tail", "salt")
    whole = Window.partitionBy(*dealt, "norm")
    placed = salted.select("id", "text", *dealt).repartitionByRange(n, *dealt).withColumn("norm", ascii_lower(F.col("text")))
    runs = placed.select(
        "id", "salt", "norm",
        F.row_number().over(whole.orderBy(order)).alias("nth"),
        best("id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
    )
    runs = shared_checkpoint(runs.select(
        "id", "salt", (F.col("nth") == 1).alias("first"), "keep_id", "group_size",
        F.when(F.col("salt").isNotNull() & (F.col("nth") == 1), F.col("norm")).alias("norm"),
        F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"),
    ))
    alone = runs.where(F.col("salt").isNull()).select("id", "first", "keep_id", "group_size", "digest")
    merged = shared_checkpoint(runs.where(F.col("norm").isNotNull()).groupBy("norm").agg(
        best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("digest").alias("digest")
    ).drop("norm"))
    spread = join_groups(runs.where(F.col("salt").isNotNull()).select("id", "first", "digest"), merged, "digest", "group_size")
    return alone.unionByName(spread).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("first") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
