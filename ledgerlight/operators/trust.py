"""Provider trust from attribution receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..functions.storage import stored


def _entries(receipts: DataFrame) -> DataFrame:
    return receipts.where(F.size("top_k") > 0).select("output_id", "epsilon_dp", "low_confidence", F.explode("top_k").alias("e")).select(
        "output_id", "epsilon_dp", F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"), "e.*"
    ).where(F.col("provider_id").isNotNull() & (F.col("provider_id") != ""))


def receipt_provider_shares(receipts: DataFrame) -> DataFrame:
    """Sum of shares per (receipt, provider); null and negative shares are skipped."""
    usable = _entries(receipts).where(F.col("share") >= 0)
    return usable.groupBy("output_id", "provider_id").agg(F.sum("share").alias("share"))


def _tallies(receipts: DataFrame) -> DataFrame:
    """Everything the scores need per provider, in one pass over the receipts, stored.

    Invalid entries are under a null provider. ``n_first`` counts receipts at their first entry, so that totals over
    receipts can be taken from this table too.
    """
    named = lambda e: F.coalesce(e["provider_id"], F.lit("")) != ""
    usable = F.exists("top_k", lambda e: named(e) & F.coalesce(e["share"] >= 0, F.lit(False)))
    rows = receipts.select("output_id", "epsilon_dp", F.coalesce("low_confidence", F.lit(False)).alias("low"), usable.alias("usable"), F.posexplode_outer("top_k").alias("place", "e"))
    rows = rows.select("*", F.when(named(F.col("e")), F.col("e.provider_id")).alias("provider_id"), F.when(F.col("e.share") >= 0, F.col("e.share")).alias("share"), "e.rank", "e.share_ci95_low")
    first = F.col("usable") & (F.col("rank") == 1)
    each = rows.groupBy("provider_id", "output_id").agg(
        F.sum("share").alias("share"), F.count_if("usable").alias("n_topk"), F.count_if(first).alias("n_top1"), F.count_if(first & F.col("low")).alias("n_low_conf_top1"),
        F.count_if(F.col("usable") & (F.col("share_ci95_low") > 0)).alias("n_conf_pos"), F.collect_set(F.when(first, F.col("epsilon_dp"))).alias("eps"),
        F.count_if(F.col("place") == 0).alias("n_first"), F.min("epsilon_dp").alias("eps_low"), F.max("epsilon_dp").alias("eps_high"),
    )
    return stored(each.groupBy("provider_id").agg(
        F.sum("share").alias("total_share"), F.max("share").alias("max_share"), F.count_if(F.col("share").isNotNull()).alias("n_outputs"),
        *[F.sum(c).alias(c) for c in ("n_topk", "n_top1", "n_low_conf_top1", "n_conf_pos", "n_first")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("eps")))).alias("dp_eps"), F.min("eps_low").alias("eps_low"), F.max("eps_high").alias("eps_high"),
    ))


def _stats(tallies: DataFrame, min_outputs: int) -> DataFrame:
    kept = tallies.where(F.col("provider_id").isNotNull() & (F.col("n_outputs") >= max(1, min_outputs)))
    return kept.select("provider_id", "n_topk", "n_top1", "n_low_conf_top1", "n_conf_pos", "dp_eps", "total_share", "max_share", "n_outputs")


def provider_stats(receipts: DataFrame, min_outputs: int = 1) -> DataFrame:
    """Appearances, low-confidence and positive-confidence counts, shares and privacy budgets per provider.

    Distinct outputs are counted exactly. Receipts without a usable share contribute nothing.
    """
    return _stats(_tallies(receipts), min_outputs)


def trust_scores(receipts: DataFrame, min_outputs: int = 1) -> DataFrame:
    """Trust, risk and priority per provider, on totals that travel as one row. The receipts are read once."""
    tallies = _tallies(receipts)
    stats = _stats(tallies, min_outputs)
    n_eps = F.when(F.min("eps_low") < F.max("eps_high"), 2).otherwise(1)  # one or several budgets
    totals = tallies.agg(F.coalesce(F.sum("n_first"), F.lit(0)).alias("n_total"), n_eps.alias("n_eps")).crossJoin(stats.agg(F.sum("total_share").alias("all_share")))
    rows = stats.crossJoin(F.broadcast(totals))
    total = F.greatest(F.col("n_total"), F.lit(1)).cast("double")
    rows = rows.withColumns({
        "top1_rate": F.col("n_top1") / total,
        "topk_rate": F.col("n_outputs") / total,
        "conf_rate": F.col("n_conf_pos") / F.greatest(F.col("n_outputs"), F.lit(1)),
        "low_conf_rate": F.when(F.col("n_top1") > 0, F.col("n_low_conf_top1") / F.col("n_top1")).otherwise(0.0),
        "dp_factor": F.when(F.col("n_eps") < 2, 1.0).when(F.size("dp_eps") >= 2, 1.05).when(F.size("dp_eps") == 1, 0.95).otherwise(1.0),
    })
    core = 0.5 * F.col("top1_rate") + 0.3 * F.col("topk_rate") + 0.2 * F.col("conf_rate")
    rows = rows.withColumn("trust", core * F.greatest(F.lit(0.0), 1 - F.col("low_conf_rate")) * F.col("dp_factor"))
    rows = rows.withColumn("risk", 0.5 * F.col("low_conf_rate") + 0.5 * (1 - F.col("conf_rate")))
    raw = 0.4 * F.col("trust") + 0.2 * F.col("conf_rate") + 0.2 * F.col("topk_rate") - 0.2 * F.col("risk")
    return rows.withColumn("priority", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).withColumn(
        "global_share", F.col("total_share") / F.col("all_share")
    ).drop("n_total", "n_eps", "all_share", "dp_factor")


def priority_band(scores: DataFrame) -> DataFrame:
    """HIGH for the first fifth by trust, MED for the first half, LOW for the rest; ties by provider."""
    ranked = global_rank(scores, "trust", [F.col("provider_id")])
    n = scores.agg(F.count(F.lit(1)).alias("n"))
    share = F.col("rank") / F.col("n")
    return ranked.crossJoin(F.broadcast(n)).withColumn(
        "band", F.when(share <= 0.2, "HIGH").when(share <= 0.5, "MED").otherwise("LOW")
    ).drop("n")


def top_providers(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.orderBy(F.desc("trust"), "provider_id").limit(n)
