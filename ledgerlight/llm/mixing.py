"""Mix sources to target weights by hash-random order and exact word budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, word_count

#: Hex digits of the random key that name a range, at least, and rows that a range may hold on average: larger tables have
#: more ranges, with the same result.
RANGE_DIGITS, RANGE_ROWS = 3, 50_000
WEIGHTS = (5, 2, 1)


def random_key(id_col: Column, text_col: Column, seed: int) -> Column:
    """32 hex digits, the same for the same identifier (the same text, where that is null) and seed in every run."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text_col, F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """Targets per source from ``(source, source_size)``, one row a source.

    Sources take ``weights`` in turn, in code point order with null last, and share the sum of all
    sizes in proportion. A target stops at ``max_repeat`` times the source's size and the excess goes
    to the others by weight until none is above: target = min(cap, level * weight), where the level is
    found from running sums over the sources in the order in which they reach their caps. The windows
    below run over one row per source.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("reach", F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.alias("weight")).select(
        "*", (F.col("source_size") * F.lit(float(max_repeat))).alias("cap")
    )
    caps = caps.withColumn("reach", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    levels = caps.withColumn(
        "level",
        (
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        )
        / F.sum("weight").over(after),
    )
    # The first source that the level does not lift to its cap fixes the level of all the others.
    fixed = F.min(F.when(F.col("level") < F.col("reach"), F.struct("reach", "level"))).over(everything)
    levels = levels.withColumn("fixed", fixed["level"])
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("fixed") * F.col("weight"))
    )
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    max_repeat: float = 3.0,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Words that a mix takes from each document.

    Each document gets a hash-random key. Its source is cut into ranges of that key (4096, more for large tables), the ranges'
    word counts give the words before each range, and a window inside each range gives the words
    before each document: no window spans a whole source. A source's budget is its target rounded to
    whole words: as many whole epochs as fit, then documents in key order up to the exact word, so the
    document at the cut gives a part of its words.

    Returns one row per input row: ``id_col, source_col, size, source_size, target, taken`` and the columns of
    ``carry``.

    * null text has size 0 and gives nothing; a null source is a source of its own, the last in order;
    * rows that tie on the identifier are ordered by size, then by a hash of the text, so reruns agree; rows with a null
      identifier have a key of their text;
    * an empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        random_key(F.col(id_col), F.col(text_col), seed).alias("key"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"),
    )
    # Null sources need an equi-join key of their own.
    sized = shared_checkpoint(sized.withColumn("pool", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    digits = max(RANGE_DIGITS, math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16)))
    sized = sized.withColumn("range", F.substring("key", 1, digits))

    ranges = sized.groupBy("pool", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    ranges = shared_checkpoint(ranges)
    sources = ranges.groupBy("pool").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    targets = source_targets(sources.select("source", "source_size"), weights, max_repeat).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("pool"), "source_size", "target"
    )
    earlier = Window.partitionBy("pool").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "pool", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start")
    ).join(targets, "pool")

    inside = Window.partitionBy("pool", "range").orderBy("key", "size", "tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.join(offsets, ["pool", "range"]).withColumn(
        "start", F.col("range_start") + F.sum("size").over(inside) - F.col("size")
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )
