"""Match positions with SQL functions only.

Spark's regular expression functions return matched strings, not positions. ``pieces`` marks every
match in the text, splits at the marks and keeps the lengths: even pieces are gaps, odd pieces matches.
``positions`` turns the lengths into offsets with a window over the pieces of one row and kind, so the
work is linear in the number of matches and no array grows while it is being built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "\x01"
INNER = "\x02"
CONTEXT = 32


def unmarked(text: Column) -> Column:
    """``text`` (null: empty) with the two mark characters replaced, so lengths stay the same."""
    text = F.coalesce(text, F.lit(""))
    dirty = text.contains(MARK) | text.contains(INNER)
    return F.when(dirty, F.translate(text, MARK + INNER, "\x03\x03")).otherwise(text)


def split_at(text: Column, pattern: str, marked: str = "$0") -> Column:
    """Gaps and matches in turn; null where nothing matches. ``marked`` may hold ``INNER`` between groups."""
    found = F.regexp_replace(text, pattern, f"{MARK}{marked}{MARK}")
    return F.when(found.contains(MARK), F.split(found, MARK))


def pieces(kind: str, parts: Column) -> Column:
    """ARRAY of (kind, place, size, found, before) for the parts of one row; empty where nothing matches."""
    found = F.transform(
        parts,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("place"),
            F.length(F.replace(x, F.lit(INNER), F.lit(""))).alias("size"),
            F.when(i % 2 == 1, x).alias("found"),
            F.when(i % 2 == 1, F.right(F.element_at(parts, i), F.lit(CONTEXT))).alias("before"),
        ),
    )
    return F.coalesce(found, F.expr("cast(array() as array<struct<kind:string,place:int,size:int,found:string,before:string>>)"))


def positions(rows: DataFrame, uid: str = "uid", column: str = "pieces") -> DataFrame:
    """One row per match: uid, kind, start, end (code points, end exclusive), found, before."""
    each = rows.select(uid, F.explode(column).alias("p")).select(uid, "p.*")
    until = Window.partitionBy(uid, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        each.withColumn("end", F.sum("size").over(until).cast("long"))
        .where(F.col("found").isNotNull())
        .select(uid, "kind", (F.col("end") - F.col("size")).alias("start"), "end", "found", "before")
    )


def joined(condition: Column, order: dict[str, int]) -> Column:
    """Aggregate: ``kind:start:end`` of the rows that meet ``condition``, by start, then kind as listed, joined by commas."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    item = F.struct(F.col("start"), rank[F.col("kind")].alias("rank"), F.col("end"), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.when(condition, item)))
    return F.array_join(
        F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
