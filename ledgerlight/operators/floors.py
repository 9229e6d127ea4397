"""Guaranteed floors of payouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_bounds(stats: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Coverage per provider: the last override (0 to 1), else ``topk_rate``, else ``topk`` / 100, else 1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    choices = [clamp(F.col("topk_rate"))] if "topk_rate" in stats.columns else []
    choices += [clamp(F.col("topk") / 100)] if "topk" in stats.columns else []
    rows = stats.select("provider_id", F.coalesce(*choices, F.lit(1.0)).alias("derived"))
    if overrides is None:
        return rows.select("provider_id", F.col("derived").alias("coverage_bound"), F.lit(False).alias("overridden"))
    last = overrides.groupBy("provider_id").agg(clamp(F.max_by("coverage_bound", "line_no")).alias("chosen"))
    return rows.join(last, "provider_id", "left").select(
        "provider_id", F.coalesce("chosen", "derived").alias("coverage_bound"), F.col("chosen").isNotNull().alias("overridden")
    )


def join_registry(coverage: DataFrame, registry: DataFrame) -> DataFrame:
    """Add eligibility (true where the registry has no entry), tier, status and name."""
    known = registry.select("provider_id", F.col("eligible").alias("listed"), "kyc_tier", "status", "display_name")
    return coverage.join(known, "provider_id", "left").withColumn("eligible", F.coalesce("listed", F.lit(True))).drop("listed")


def floors(coverage: DataFrame, budget: float) -> DataFrame:
    """Floor of each eligible provider: budget * max(0, 1 - coverage of the others).

    Without any override, a total coverage under 1 means full coverage for all; with overrides it is infeasible and
    the floors are null.
    """
    rows = coverage.where("eligible")
    sums = rows.agg(F.sum("coverage_bound").alias("total"), F.max("overridden").alias("any_override"), F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("full", (F.col("total") < 1 - 1e-9) & ~F.col("any_override"))
    sums = sums.withColumn("total", F.when(F.col("full"), F.col("n").cast("double")).otherwise(F.col("total")))
    rows = rows.crossJoin(F.broadcast(sums))
    bound = F.when(F.col("full"), 1.0).otherwise(F.col("coverage_bound"))
    left = F.greatest(F.lit(0.0), 1 - (F.col("total") - bound))
    floor = F.when(F.col("total") >= 1 - 1e-9, F.when(left < 1e-14, 0.0).otherwise(left) * float(budget))
    return rows.select("provider_id", bound.alias("coverage_bound"), floor.alias("floor"))


def check_floors(payouts: DataFrame, floors_: DataFrame) -> DataFrame:
    """Compare payouts (summed per provider) with floors, in both directions."""
    paid = payouts.groupBy("provider_id").agg(F.sum(F.col("amount").cast("double")).alias("payout"))
    joined = paid.join(floors_.select("provider_id", "floor").withColumn("listed", F.lit(True)), "provider_id", "full_outer")
    status = (
        F.when(F.col("payout").isNotNull() & F.col("floor").isNull(), "NO_FLOOR")
        .when(F.col("payout") + 1e-9 < F.col("floor"), "BELOW_FLOOR")
        .when(F.col("payout").isNotNull(), "OK")
        .when(F.coalesce("floor", F.lit(0.0)) <= 0, "NO_PAYOUT")
        .otherwise("BELOW_FLOOR_NOPAYOUT")
    )
    return joined.select("provider_id", "payout", "floor", status.alias("status"))
