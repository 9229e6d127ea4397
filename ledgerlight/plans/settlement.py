"""Queries over trust, payouts and floors, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import floors as fl
from ..operators import payouts as p
from ..operators import trust as t
from ..sources import views as v

PERIOD, BUDGET = "1997-06", 1_000_000


def rounded(df, digits=6):
    """Doubles rounded for comparison; float sums depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _weights(spark, sf):
    return p.provider_weights(v.receipts(spark, sf), PERIOD)


def _excluded(spark, sf):
    return v.providers(spark, sf).where("status = 'suspended'").select("provider_id")


def _amounts(spark, sf):
    w = p.apply_exclusions(p.normalize_weights(_weights(spark, sf)), _excluded(spark, sf))
    return p.round_to_budget(w, BUDGET)


def _coverage(spark, sf):
    scores = t.trust_scores(v.receipts(spark, sf)).select("provider_id", "topk_rate")
    return fl.join_registry(fl.coverage_bounds(scores, v.coverage_overrides(spark, sf)), v.providers(spark, sf))


def _floors(spark, sf):
    small = _coverage(spark, sf).withColumn("coverage_bound", F.col("coverage_bound") / 8)
    return fl.floors(small, BUDGET)


QUERIES = {
    "t1_receipt_provider_shares": lambda s, d: rounded(t.receipt_provider_shares(v.receipts(s, d))),
    "t2_provider_stats": lambda s, d: rounded(t.provider_stats(v.receipts(s, d), 2)),
    "t3_trust_scores": lambda s, d: rounded(t.trust_scores(v.receipts(s, d)).select(
        "provider_id", "trust", "risk", "priority", "top1_rate", "topk_rate", "conf_rate", "low_conf_rate", "global_share")),
    "t4_priority_band": lambda s, d: t.priority_band(t.trust_scores(v.receipts(s, d)).withColumn("trust", F.round("trust", 9))).select(
        "provider_id", "rank", "band"),
    "t5_top_providers": lambda s, d: rounded(t.top_providers(t.trust_scores(v.receipts(s, d)).withColumn("trust", F.round("trust", 9)), 20)
                                             .select("provider_id", "trust", "n_outputs")),
    "b1_in_period": lambda s, d: v.receipts(s, d).where(p.in_period(F.col("timestamp"), PERIOD)).select("output_id", "timestamp"),
    "p1_provider_weights": lambda s, d: rounded(_weights(s, d)),
    "p2_payout_audit": lambda s, d: p.payout_audit(v.receipts(s, d), PERIOD),
    "p3_normalize_weights": lambda s, d: rounded(p.normalize_weights(_weights(s, d)), 9),
    "p3_apply_exclusions": lambda s, d: rounded(p.apply_exclusions(p.normalize_weights(_weights(s, d)), _excluded(s, d)), 9),
    "p4_apply_caps": lambda s, d: rounded(p.apply_caps(p.normalize_weights(_weights(s, d)), 0.02, 0.05), 9),
    "p5_round_to_budget": lambda s, d: p.round_to_budget(p.normalize_weights(_weights(s, d)), BUDGET).select("provider_id", "amount"),
    "p6_min_amount": lambda s, d: p.min_amount(p.round_to_budget(p.normalize_weights(_weights(s, d)), BUDGET), 9000, BUDGET, True).select(
        "provider_id", "amount", "rollover"),
    "p7_payout_rows": lambda s, d: p.payout_rows(_amounts(s, d), PERIOD, BUDGET),
    "p8_concentration": lambda s, d: rounded(p.concentration(_weights(s, d))),
    "p8_share_curve": lambda s, d: rounded(p.share_curve(_weights(s, d).withColumn("weight", F.round("weight", 9)))),
    "f1_coverage_bounds": lambda s, d: rounded(fl.coverage_bounds(
        t.trust_scores(v.receipts(s, d)).select("provider_id", "topk_rate"), v.coverage_overrides(s, d))),
    "f2_join_registry": lambda s, d: rounded(_coverage(s, d)),
    "f3_floors": lambda s, d: rounded(_floors(s, d), 3),
    "f4_check_floors": lambda s, d: rounded(fl.check_floors(_amounts(s, d).where("amount > 9000"), _floors(s, d)), 3),
}

_STATS = f"""
WITH {v.ENTRIES},
shares AS (SELECT output_id, provider_id, sum(share) AS share FROM entries WHERE share >= 0 GROUP BY ALL),
a AS (SELECT provider_id, sum(share) AS total_share, max(share) AS max_share, count(*) AS n_outputs FROM shares GROUP BY 1),
b AS (SELECT provider_id, count(*) AS n_topk, count(*) FILTER (rank = 1) AS n_top1, count(*) FILTER (rank = 1 AND low_confidence) AS n_low_conf_top1,
        count(*) FILTER (ci_low > 0) AS n_conf_pos, coalesce(list_sort(list(DISTINCT eps) FILTER (rank = 1 AND eps IS NOT NULL)), []) AS dp_eps
      FROM entries GROUP BY 1),
stats AS (SELECT * FROM a JOIN b USING (provider_id)),
n AS (SELECT count(DISTINCT output_id)::DOUBLE AS n_total, count(DISTINCT eps) AS n_eps FROM entries),
r AS (SELECT stats.*, n_top1 / n_total AS top1_rate, n_outputs / n_total AS topk_rate, n_conf_pos / n_outputs AS conf_rate,
        CASE WHEN n_top1 > 0 THEN n_low_conf_top1 / n_top1 ELSE 0 END AS low_conf_rate,
        CASE WHEN n_eps < 2 THEN 1.0 WHEN len(dp_eps) >= 2 THEN 1.05 WHEN len(dp_eps) = 1 THEN 0.95 ELSE 1.0 END AS f,
        total_share / sum(total_share) OVER () AS global_share FROM stats, n),
u AS (SELECT *, ((0.5 * top1_rate + 0.3 * topk_rate + 0.2 * conf_rate) * (1 - low_conf_rate) * f)::DOUBLE AS trust,
        0.5 * low_conf_rate + 0.5 * (1 - conf_rate) AS risk FROM r),
scores AS (SELECT *, greatest(0, least(1, 0.4 * trust + 0.2 * conf_rate + 0.2 * topk_rate - 0.2 * risk)) AS priority FROM u)
"""
_WEIGHT_TABLES = f"""
w AS (SELECT provider_id, sum(share / tot) AS weight FROM (SELECT *, sum(share) OVER (PARTITION BY order_key) AS tot FROM entries
      WHERE strftime(ts, '%Y-%m') = '{PERIOD}') WHERE abs(tot - 1) <= 0.02 GROUP BY 1),
nw AS (SELECT provider_id, weight / sum(weight) OVER () AS weight FROM w),
out_ AS (SELECT provider_id FROM providers WHERE status = 'suspended'),
xw AS (SELECT provider_id, x / sum(x) OVER () AS weight, policies FROM (
  SELECT provider_id, CASE WHEN o.provider_id IS NULL THEN weight ELSE 0 END AS x,
         CASE WHEN o.provider_id IS NULL THEN []::VARCHAR[] ELSE ['excluded'] END AS policies
  FROM nw LEFT JOIN out_ o USING (provider_id)))
"""
_WEIGHTS = f"WITH {v.ENTRIES}, {v.PROVIDERS}, {_WEIGHT_TABLES}"


def _settled(table: str, out: str) -> str:
    return f"""
{out}0 AS (SELECT *, (weight * {BUDGET}.0::DOUBLE)::DECIMAL(18,2) AS amount FROM {table}),
{out}1 AS (SELECT {BUDGET}::DECIMAL(18,2) - sum(amount) AS gap FROM {out}0),
{out}2 AS (SELECT min(provider_id) AS payee FROM {out}0 WHERE amount = (SELECT max(amount) FROM {out}0)),
{out} AS (SELECT * REPLACE (CASE WHEN provider_id = payee THEN amount + gap ELSE amount END::DECIMAL(18,2) AS amount) FROM {out}0, {out}1, {out}2)
"""


_COVER = f"""
{_STATS}, {v.PROVIDERS},
ov AS (SELECT provider_id, 1.5 AS c, supp_key * 2 AS l FROM providers WHERE supp_key % 10 = 3
       UNION ALL SELECT provider_id, 0.25, supp_key * 2 + 1 FROM providers WHERE supp_key % 20 = 3),
lo AS (SELECT provider_id, greatest(0, least(1, arg_max(c, l))) AS c FROM ov GROUP BY 1),
cov AS (SELECT s.provider_id, coalesce(c, greatest(0, least(1, topk_rate)))::DOUBLE AS coverage_bound, c IS NOT NULL AS overridden
        FROM scores s LEFT JOIN lo USING (provider_id)),
reg AS (SELECT cov.*, coalesce(eligible, true) AS eligible, kyc_tier, status, display_name FROM cov LEFT JOIN providers USING (provider_id)),
el AS (SELECT *, coverage_bound / 8 AS cb FROM reg WHERE eligible),
su AS (SELECT sum(cb) AS tot, bool_or(overridden) AS anyo, count(*) AS n FROM el),
flo AS (SELECT provider_id, CASE WHEN tot < 1 - 1e-9 AND NOT anyo THEN 1.0 ELSE cb END AS coverage_bound,
          CASE WHEN tot < 1 - 1e-9 AND NOT anyo THEN {BUDGET} * greatest(0, 1 - (n - 1.0))
               WHEN tot >= 1 - 1e-9 THEN {BUDGET} * CASE WHEN greatest(0, 1 - (tot - cb)) < 1e-14 THEN 0 ELSE greatest(0, 1 - (tot - cb)) END END AS floor
        FROM el, su)
"""

SQL = {
    "t1_receipt_provider_shares": f"{_STATS} SELECT output_id, provider_id, round(share, 6) AS share FROM shares",
    "t2_provider_stats": f"""{_STATS} SELECT provider_id, n_topk, n_top1, n_low_conf_top1, n_conf_pos, dp_eps, round(total_share, 6) AS total_share,
        round(max_share, 6) AS max_share, n_outputs FROM stats WHERE n_outputs >= 2""",
    "t3_trust_scores": _STATS + "SELECT provider_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in (
        "trust", "risk", "priority", "top1_rate", "topk_rate", "conf_rate", "low_conf_rate", "global_share")) + " FROM scores",
    "t4_priority_band": f"""{_STATS}, k AS (SELECT provider_id, row_number() OVER (ORDER BY round(trust, 9) DESC, provider_id) AS rank, count(*) OVER () AS n FROM scores)
        SELECT provider_id, rank, CASE WHEN rank / n <= 0.2 THEN 'HIGH' WHEN rank / n <= 0.5 THEN 'MED' ELSE 'LOW' END AS band FROM k""",
    "t5_top_providers": f"{_STATS} SELECT provider_id, round(trust, 6) AS trust, n_outputs FROM scores ORDER BY round(scores.trust, 9) DESC, provider_id LIMIT 20",
    "b1_in_period": f"""WITH {v.ENTRIES} SELECT DISTINCT output_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM entries
        WHERE strftime(ts, '%Y-%m') = '{PERIOD}'""",
    "p1_provider_weights": f"{_WEIGHTS} SELECT provider_id, round(weight, 6) AS weight FROM w",
    "p2_payout_audit": f"""WITH {v.ENTRIES}, g AS (SELECT order_key, count(*) AS n, sum(share) AS s FROM entries WHERE strftime(ts, '%Y-%m') = '{PERIOD}' GROUP BY 1)
        SELECT n AS n_entries, count(*) FILTER (abs(s - 1) <= 0.02) AS receipts, count(*) FILTER (abs(s - 1) > 0.02) AS skipped_bad_sum FROM g GROUP BY 1""",
    "p3_normalize_weights": f"{_WEIGHTS} SELECT provider_id, round(weight, 9) AS weight FROM nw",
    "p3_apply_exclusions": f"{_WEIGHTS} SELECT provider_id, round(weight, 9) AS weight, policies FROM xw",
    "p5_round_to_budget": f"{_WEIGHTS}, {_settled('nw', 'am')} SELECT provider_id, amount FROM am",
    "p6_min_amount": f"""{_WEIGHTS}, {_settled('nw', 'am')},
        q AS (SELECT provider_id, CASE WHEN amount < 9000 AND amount > 0 THEN amount ELSE 0 END::DECIMAL(18,2) AS rollover,
                CASE WHEN amount < 9000 THEN 0 ELSE amount END::DECIMAL(18,2) AS amount FROM am),
        q1 AS (SELECT provider_id, rollover, (amount + amount / (sum(amount) OVER ()) * (sum(rollover) OVER ()))::DECIMAL(18,2) AS amount FROM q),
        q2 AS (SELECT {BUDGET}::DECIMAL(18,2) - sum(amount) AS gap FROM q1),
        q3 AS (SELECT min(provider_id) AS payee FROM q1 WHERE amount = (SELECT max(amount) FROM q1))
        SELECT provider_id, CASE WHEN provider_id = payee THEN amount + gap ELSE amount END::DECIMAL(18,2) AS amount, rollover FROM q1, q2, q3""",
    "p7_payout_rows": f"""{_WEIGHTS}, {_settled('xw', 'am')} SELECT provider_id, '{PERIOD}' AS period, 'EUR' AS currency, {BUDGET}::DECIMAL(18,2) AS gross_revenue,
        round(weight, 8) AS share_agg, amount, array_to_string(policies, ',') AS policies_applied FROM am""",
    "p8_concentration": f"""{_WEIGHTS}, k AS (SELECT weight, row_number() OVER (ORDER BY weight, provider_id) AS i, row_number() OVER (ORDER BY weight DESC, provider_id) AS j FROM w)
        SELECT round(sum(weight * weight) / (sum(weight) * sum(weight)), 6) AS hhi,
               round(2 * sum(i * weight) / (count(*) * sum(weight)) - (count(*) + 1) / count(*), 6) AS gini,
               round(sum(weight) FILTER (j <= 10) / sum(weight), 6) AS top10_share FROM k""",
    "p8_share_curve": f"""{_WEIGHTS}, k AS (SELECT provider_id, round(weight, 9) AS weight FROM w)
        SELECT provider_id, row_number() OVER (ORDER BY weight DESC, provider_id) AS rank,
               round(sum(weight) OVER (ORDER BY weight DESC, provider_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (), 6) AS cum_share FROM k""",
    "f1_coverage_bounds": f"{_COVER} SELECT provider_id, round(coverage_bound, 6) AS coverage_bound, overridden FROM cov",
    "f2_join_registry": f"{_COVER} SELECT * REPLACE (round(coverage_bound, 6) AS coverage_bound) FROM reg",
    "f3_floors": f"{_COVER} SELECT provider_id, round(coverage_bound, 3) AS coverage_bound, round(floor, 3) AS floor FROM flo",
    "f4_check_floors": f"""{_COVER}, {_WEIGHT_TABLES}, {_settled('xw', 'am')},
        pay AS (SELECT provider_id, sum(amount)::DOUBLE AS payout FROM am WHERE amount > 9000 GROUP BY 1)
        SELECT provider_id, round(payout, 3) AS payout, round(floor, 3) AS floor,
               CASE WHEN payout IS NOT NULL AND floor IS NULL THEN 'NO_FLOOR' WHEN payout + 1e-9 < floor THEN 'BELOW_FLOOR' WHEN payout IS NOT NULL THEN 'OK'
                    WHEN coalesce(floor, 0) <= 0 THEN 'NO_PAYOUT' ELSE 'BELOW_FLOOR_NOPAYOUT' END AS status
        FROM pay FULL OUTER JOIN flo USING (provider_id)""",
}
