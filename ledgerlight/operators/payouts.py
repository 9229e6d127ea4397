"""Monthly payouts from receipts, with caps, rounding to a budget and minimum amounts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..functions.storage import stored

TOLERANCE, EPS, ROUNDS = 0.02, 1e-12, 10
#: The largest weights that capping can ever freeze: the top three, and four more a round.
SELECTED = 3 + 4 * ROUNDS
MONEY = "decimal(18,2)"


def in_period(timestamp: Column, period: str) -> Column:
    """Whether an ISO timestamp falls in ``YYYY-MM``; unparsable ones do not."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", period):
        raise ValueError("period is YYYY-MM")
    start = F.lit(f"{period}-01").cast("timestamp")
    parsed = F.try_to_timestamp(timestamp)
    return F.coalesce((parsed >= start) & (parsed < F.add_months(start, 1).cast("timestamp")), F.lit(False))


def usable_receipts(receipts: DataFrame) -> DataFrame:
    """Royalty receipts with their valid entries (a provider, a shard, a share of 0 or more) and the sum of those shares; receipts
    without a positive, finite sum go. One rule for batches and streams."""
    entries = F.filter("top_k", lambda e: (e["share"] >= 0) & e["provider_id"].isNotNull() & e["shard_id"].isNotNull())
    rows = receipts.where(F.col("schema") == "royalty_receipt.v1").withColumn("entries", entries)
    rows = rows.withColumn("sum_share", F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["share"]))
    return rows.where((F.col("sum_share") > 0) & (F.col("sum_share") < float("inf")))


def balanced_receipts(receipts: DataFrame) -> DataFrame:
    """Usable receipts whose shares sum to 1, give or take TOLERANCE."""
    return usable_receipts(receipts).where(F.abs(F.col("sum_share") - 1) <= TOLERANCE)


def _usable(receipts: DataFrame, period: str) -> DataFrame:
    return usable_receipts(receipts.where(in_period(F.col("timestamp"), period)))


def provider_weights(receipts: DataFrame, period: str) -> DataFrame:
    """Shares per provider, each receipt normalised to 1; receipts whose shares miss 1 by over 0.02 are skipped.

    What follows reads this table several times: it is stored, so that the receipts are read once.
    """
    rows = balanced_receipts(receipts.where(in_period(F.col("timestamp"), period)))
    each = rows.select("sum_share", F.explode("entries").alias("e"))
    return stored(each.groupBy(F.col("e.provider_id").alias("provider_id")).agg(F.sum(F.col("e.share") / F.col("sum_share")).alias("weight")))


def payout_audit(receipts: DataFrame, period: str) -> DataFrame:
    """Receipts used and skipped for their sum, by number of entries."""
    rows = _usable(receipts, period).withColumn("n_entries", F.size("entries"))
    good = F.abs(F.col("sum_share") - 1) <= TOLERANCE
    return rows.groupBy("n_entries").agg(F.count_if(good).alias("receipts"), F.count_if(~good).alias("skipped_bad_sum"))


def normalize_weights(weights: DataFrame) -> DataFrame:
    """Weights over the sum of the positive ones."""
    total = weights.agg(F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("total"))
    share = F.when((F.col("weight") > 0) & (F.col("total") > 0), F.col("weight") / F.col("total")).otherwise(0.0)
    return weights.crossJoin(F.broadcast(total)).withColumn("weight", share).drop("total")


def _with_policies(weights: DataFrame) -> DataFrame:
    if "policies" in weights.columns:
        return weights
    return weights.withColumn("policies", F.expr("cast(array() as array<string>)"))


def apply_exclusions(weights: DataFrame, excluded: DataFrame) -> DataFrame:
    """Excluded providers get weight 0 and a policy; the others are normalised again."""
    marked = _with_policies(weights).join(excluded.select("provider_id").distinct().withColumn("out", F.lit(True)), "provider_id", "left")
    out = F.coalesce("out", F.lit(False))
    marked = marked.withColumn("weight", F.when(out, 0.0).otherwise(F.col("weight"))).withColumn(
        "policies", F.when(out, F.array_append("policies", F.lit("excluded"))).otherwise(F.col("policies"))
    )
    return normalize_weights(marked.drop("out"))


def _leading(weights: dict[str, float], n: int) -> list[str]:
    """Names of the largest weights; weights that agree in 11 digits tie and go by name."""
    return sorted(weights, key=lambda p: (-float(f"{weights[p]:.11g}"), p))[:n]


def solve_caps(weights: dict[str, float], rest: float, n_rest: int, cap_top1: float | None, cap_top3: float | None):
    """Capped weights of the selected providers, the factor of all others, and the policies.

    The others are never capped, so each round only multiplies them by one factor.
    """
    weights, factor = dict(weights), 1.0
    frozen: set[str] = set()
    policies: dict[str, list[str]] = {p: [] for p in weights}

    def spread(excess: dict[str, float]) -> None:
        nonlocal rest, factor
        for p, x in excess.items():
            weights[p] -= x
        free = {p for p, w in weights.items() if p not in frozen and w > 0}
        room = sum(weights[p] for p in free) + rest
        if room > 0:
            scale = 1 + sum(excess.values()) / room
            for p in free:
                weights[p] *= scale
        else:
            total = sum(w for w in weights.values() if w > 0)
            if total <= 0:
                return
            scale = 1 / total
            for p, w in weights.items():
                if w > 0:
                    weights[p] = w / total
        rest, factor = rest * scale, factor * scale

    for _ in range(ROUNDS):
        changed = False
        if cap_top1 is not None and weights:
            top = _leading(weights, 1)[0]
            if weights[top] > cap_top1 + EPS:
                frozen.add(top)
                policies[top].append(f"cap_top1_{cap_top1}")
                spread({top: weights[top] - cap_top1})
                changed = True
        if cap_top3 is not None and len(weights) + n_rest >= 3:
            top = _leading(weights, 3)
            total = sum(weights[p] for p in top)
            if total > cap_top3 + EPS:
                frozen.update(top)
                for p in top:
                    if f"cap_top3_{cap_top3}" not in policies[p]:
                        policies[p].append(f"cap_top3_{cap_top3}")
                spread({p: weights[p] / total * (total - cap_top3) for p in top})
                changed = True
        if not changed:
            break
        total = sum(w for w in weights.values() if w > 0) + rest
        if total > 0:
            weights = {p: max(w, 0.0) / total for p, w in weights.items()}
            rest, factor = rest / total, factor / total
    return weights, factor, policies


def apply_caps(weights: DataFrame, cap_top1: float | None = None, cap_top3: float | None = None) -> DataFrame:
    """Cap the largest provider and the largest three, and spread the excess over the free ones, in up to 10 rounds.

    At most 43 providers can be frozen: these come to the driver, all others are multiplied by one factor.
    """
    weights = _with_policies(weights)
    top = weights.orderBy(F.desc("weight"), "provider_id").limit(SELECTED).select("provider_id", "weight").collect()
    chosen = {r["provider_id"]: r["weight"] for r in top}
    others = ~F.col("provider_id").isin(list(chosen)) if chosen else F.lit(True)
    rest, n_rest = weights.where(others & (F.col("weight") > 0)).agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.count(F.lit(1))).first()
    solved, factor, policies = solve_caps(chosen, rest, n_rest, cap_top1, cap_top3)
    if not solved:
        return weights
    rows = [(p, w, policies[p]) for p, w in solved.items()]
    table = weights.sparkSession.createDataFrame(rows, "provider_id string, capped double, added array<string>")
    joined = weights.join(F.broadcast(table), "provider_id", "left")  # at most SELECTED rows
    return joined.select(
        "provider_id",
        F.coalesce("capped", F.col("weight") * factor).alias("weight"),
        F.when(F.col("added").isNull(), F.col("policies")).otherwise(F.concat("policies", "added")).alias("policies"),
    )


def _settle(rows: DataFrame, budget) -> DataFrame:
    """Give the difference between the budget and the amounts to the largest amount."""
    budget = F.lit(str(budget)).cast(MONEY)
    gap = rows.agg((budget - F.sum("amount")).cast(MONEY).alias("gap"), F.max(F.struct("amount", "provider_id")).alias("top"))
    gap = gap.select("gap", F.col("top.amount").alias("top_amount"))
    first = rows.join(F.broadcast(gap), rows["amount"] == gap["top_amount"]).agg(F.min("provider_id").alias("payee"), F.first("gap").alias("gap"))
    paid = F.when(F.col("provider_id") == F.col("payee"), F.col("amount") + F.col("gap")).otherwise(F.col("amount"))
    return rows.crossJoin(F.broadcast(first)).withColumn("amount", paid.cast(MONEY)).drop("payee", "gap")


def round_to_budget(weights: DataFrame, budget: float) -> DataFrame:
    """Amounts in cents (half up) that add up to the budget; the largest amount takes the difference."""
    rows = _with_policies(weights).withColumn("amount", (F.col("weight") * F.lit(float(budget))).cast(MONEY))
    return _settle(rows, budget)


def min_amount(amounts: DataFrame, least: float, budget: float, reconcile: bool = False) -> DataFrame:
    """Amounts under ``least`` become 0 and are kept as ``rollover``; with ``reconcile`` the others share them."""
    small = (F.col("amount") > 0) & (F.col("amount") < F.lit(str(least)).cast(MONEY))
    rows = amounts.withColumn("rollover", F.when(small, F.col("amount")).otherwise(F.lit(0).cast(MONEY)))
    rows = rows.withColumn("policies", F.when(small, F.array_append("policies", F.lit("min_amount"))).otherwise(F.col("policies")))
    rows = rows.withColumn("amount", F.when(small, F.lit(0).cast(MONEY)).otherwise(F.col("amount")))
    if not reconcile:
        return rows
    sums = rows.agg(F.sum("rollover").alias("freed"), F.sum("amount").alias("left"))
    more = F.when(F.col("amount") > 0, F.col("amount") / F.col("left") * F.col("freed")).otherwise(0)
    rows = rows.crossJoin(F.broadcast(sums)).withColumn("amount", (F.col("amount") + more).cast(MONEY)).drop("freed", "left")
    return _settle(rows, budget)


def payout_rows(amounts: DataFrame, period: str, gross: float, currency: str = "EUR") -> DataFrame:
    """Rows of the published table; order them by (amount descending, provider) at the sink."""
    return amounts.select(
        "provider_id", F.lit(period).alias("period"), F.lit(currency).alias("currency"), F.lit(str(gross)).cast(MONEY).alias("gross_revenue"),
        F.round("weight", 8).alias("share_agg"), "amount", F.array_join("policies", ",").alias("policies_applied"),
    )


def concentration(weights: DataFrame) -> DataFrame:
    """HHI and Gini coefficient, and the share of the ten largest."""
    ranked = global_rank(weights, "weight", [F.col("provider_id")], descending=False)
    sums = ranked.agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("rank") * F.col("weight")).alias("ranked"))
    ten = weights.orderBy(F.desc("weight"), "provider_id").limit(10).agg(F.sum("weight").alias("top10"))
    squares = weights.agg(F.sum(F.col("weight") * F.col("weight")).alias("squares"))
    one = sums.crossJoin(squares).crossJoin(ten)  # one row each
    return one.select(
        (F.col("squares") / (F.col("s") * F.col("s"))).alias("hhi"),
        (2 * F.col("ranked") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"),
        (F.col("top10") / F.col("s")).alias("top10_share"),
    )


def share_curve(weights: DataFrame) -> DataFrame:
    """Cumulative share by rank from the largest: running sums per bucket of ranks plus the buckets before."""
    from pyspark.sql import Window

    ranked = global_rank(weights, "weight", [F.col("provider_id")]).withColumn("part", F.floor(F.col("rank") / 100_000))
    total = weights.agg(F.sum("weight").alias("total"))
    sums = ranked.groupBy("part").agg(F.sum("weight").alias("part_sum"))
    sums = sums.withColumn("before", F.sum("part_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("weight").over(Window.partitionBy("part").orderBy("rank"))
    return ranked.join(F.broadcast(sums), "part").crossJoin(F.broadcast(total)).select(
        "provider_id", "rank", ((inside + F.coalesce("before", F.lit(0.0))) / F.col("total")).alias("cum_share")
    )
