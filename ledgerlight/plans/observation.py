"""Queries over disclosure snapshots and observations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosure as d
from ..sources import views as v

NOW = "2024-01-31 00:00:00"


def _day_before(s, sf):
    return v.snapshots(s, sf).withColumn("day", F.date_add("day", 1))


def _schemas(s, sf):
    return v.snapshots(s, sf).withColumn("schema", F.when(F.col("downloads") % 4 == 0, "ddf_snapshot.v2").otherwise(F.col("schema")))


def _evidence(s, sf):
    """Observations whose evidence has findings beside the number."""
    i = F.col("observation_id")
    found = F.concat(F.lit(', "oracle": {"violations": ["NEC#'), (i % 20 + 1).cast("string"), F.lit('", ""], "proof_hashes": ["'), F.upper("receipt_hash"), F.lit('", "sha256:ab", "bad"]}}'))
    return v.observations(s, sf).withColumn("evidence_text", F.when(i % 3 == 0, F.concat(F.regexp_replace("evidence_text", r"\}\s*$", ""), found)).otherwise(F.col("evidence_text")))


def _latest(s, sf):
    return v.snapshots(s, sf).groupBy("target_id").agg(F.max_by(F.struct("license", "http_status", "has_training_section", "downloads", "declared_datasets"), "observed_at").alias("s")).select("target_id", "s.*")


def _changes(s, sf):
    return d.timeline_changes(v.snapshots(s, sf))


def _api(s, sf):
    return v.cards(s, sf).select("target_id", F.col("lang").alias("license"), F.array(F.lit("t:b"), F.concat(F.lit("t:"), F.col("source"))).alias("tags"),
                                 F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("fr"), F.lit("en"), F.lit("fr"))).alias("languages"),
                                 F.array(F.concat(F.lit("org/set"), (F.col("doc_id") % 5).cast("string"))).alias("datasets"),
                                 F.when(F.col("doc_id") % 6 == 0, 403).when(F.col("doc_id") % 6 == 1, 404).when(F.col("doc_id") % 6 == 2, 500).when(F.col("doc_id") % 6 > 3, 200).alias("http_status"))


def _hashed(s, sf, shift):
    k = F.col("doc_id")
    return v.cards(s, sf).select("target_id", F.sha2(F.when(k % 3 == shift, F.lit("x")).otherwise("same"), 256).alias("card_hash"), (k % 2 == shift).alias("has_training_section"))


def _licenses(s, sf):
    return v.table(s, sf, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 20).cast("string")).alias("dataset"), F.date_format("l_shipdate", "yyyy-MM").alias("period"),
                                             F.when(F.col("l_linenumber") % 4 > 0, F.when(F.col("l_linenumber") == 5, "Unknown").otherwise(F.concat("l_returnflag", "l_linestatus"))).alias("license"),
                                             F.when(F.col("l_linenumber") % 3 == 0, "high").when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).alias("confidence"))


def _unanswered(s, f):
    """Snapshots of which some have no status."""
    return v.snapshots(s, f).withColumn("http_status", F.when(F.col("downloads") % 5 > 0, F.col("http_status")))


QUERIES = {
    "d1_disclosure_snapshot": lambda s, f: d.disclosure_snapshot(_api(s, f), v.cards(s, f).where("doc_id % 5 <> 4").select("target_id", "card", F.when(F.col("doc_id") % 2 == 0, 200).otherwise(404).alias("readme_status"))),
    "d2_fingerprint": lambda s, f: v.snapshots(s, f).select("target_id", "day", d.fingerprint(["schema", "license", "http_status"]).alias("fp")),
    "d3_reuse_unchanged": lambda s, f: d.reuse_unchanged(_hashed(s, f, 0), _hashed(s, f, 1)).select("target_id", "has_training_section", "reused"),
    "d4_drift_events": lambda s, f: d.drift_events(_day_before(s, f), v.snapshots(s, f), ("target_id", "day")),
    "d5_drift_quality": lambda s, f: d.drift_quality(_unanswered(s, f)).select("target_id", "day", "http_status", "quality_ok"),
    "d6_timeline_changes": lambda s, f: _changes(s, f).select("target_id", "observed_at"),
    "d7_prune_window": lambda s, f: d.prune_window(_schemas(s, f), NOW, 10, schema="ddf_snapshot.v3").select("target_id", "observed_at"),
    "d8_timeline_index": lambda s, f: d.timeline_index(v.snapshots(s, f), _changes(s, f)),
    "d9_disclosure_index": lambda s, f: d.disclosure_index(_latest(s, f), _changes(s, f), NOW),
    "d10_org_disclosure": lambda s, f: d.org_disclosure(_latest(s, f)),
    "d11_movers": lambda s, f: d.movers(_changes(s, f)),
    "d11_undocumented_tops": lambda s, f: d.undocumented_tops(_latest(s, f)),
    "d11_latest_events": lambda s, f: d.latest_events(_changes(s, f), NOW),
    "d11_top_downloads": lambda s, f: d.top_downloads(_latest(s, f)),
    "d11_gated_share": lambda s, f: d.gated_share(_latest(s, f)),
    "d12_temporal_metrics": lambda s, f: d.temporal_metrics(v.observations(s, f)),
    "d12_with_metrics": lambda s, f: d.with_metrics(v.observations(s, f)).select("observation_id", "target_id", "days", "n", "absence_days"),
    "d13_public_evidence": lambda s, f: d.public_evidence(_evidence(s, f)),
    "d14_license_snapshot": lambda s, f: d.license_snapshot(_licenses(s, f)),
    "d15_license_drift": lambda s, f: d.license_drift(d.license_snapshot(_licenses(s, f))),
    "b5_migrate_timeline": lambda s, f: d.migrate_timeline(v.snapshots(s, f)).select("target_id", "day", "training_state", "access"),
    "a8_read_observations": lambda s, f: v.observations(s, f).select("observation_id", "target_id", "observation_type", F.coalesce(F.to_json(F.try_parse_json("evidence_text")), F.lit("{}")).alias("evidence")),
}

_ACCESS = "CASE WHEN http_status BETWEEN 200 AND 299 THEN 'ok' WHEN http_status IN (401, 403) THEN 'forbidden' WHEN http_status = 404 THEN 'not_found' WHEN http_status IS NULL THEN 'unknown' ELSE 'error' END"
_S = f"""
WITH {v.SNAPSHOTS},
lat AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY observed_at DESC) = 1),
f0 AS (SELECT *, [schema, license, declared_datasets::VARCHAR, has_training_section::VARCHAR, http_status::VARCHAR]::VARCHAR AS fp FROM snapshots),
f1 AS (SELECT *, lag(fp) OVER (PARTITION BY target_id ORDER BY observed_at) AS lfp, lag(observed_at) OVER (PARTITION BY target_id ORDER BY observed_at) AS lat_ FROM f0),
ch AS (SELECT * FROM f1 WHERE lfp IS NULL OR lat_ < observed_at - INTERVAL 30 DAY OR fp <> lfp)
"""
_L = """
WITH r AS (SELECT 'd' || (l_suppkey % 20) AS dataset, strftime(l_shipdate, '%Y-%m') AS period, CASE WHEN l_linenumber = 5 OR l_linenumber % 4 = 0 THEN 'unknown' ELSE lower(l_returnflag || l_linestatus) END AS license,
  CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN l_returnflag ELSE 'unknown' END AS confidence FROM lineitem),
cf AS (SELECT dataset, period, list_transform(list_sort(list({'o': -n, 'x': confidence})), lambda x: x.x || ':' || (-x.o)) AS confidences FROM (SELECT dataset, period, confidence, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1, 2),
c AS (SELECT dataset, period, license, count(*) AS n FROM r GROUP BY 1, 2, 3),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset, period) AS p FROM c),
e AS (SELECT dataset, period, sum(n)::BIGINT AS rows, round(-sum(p * log2(p)), 4) AS entropy, round(coalesce(sum(p) FILTER (license = 'unknown'), 0), 4) AS unknown_ratio,
  list_transform(list_sort(list({'o': -n, 'license': license}))[1:20], lambda x: x.license || ':' || (-x.o)) AS top FROM p GROUP BY 1, 2)
"""

SQL = {
    "d1_disclosure_snapshot": f"""WITH {v.CARDS}, a AS (SELECT target_id, doc_id, lang AS license, list_sort(['t:b', 't:' || source]) AS tags,
          CASE WHEN doc_id % 6 = 0 THEN 403 WHEN doc_id % 6 = 1 THEN 404 WHEN doc_id % 6 = 2 THEN 500 WHEN doc_id % 6 > 3 THEN 200 END AS http_status, card FROM cards)
        SELECT target_id, license, CASE WHEN doc_id % 3 > 0 THEN 2 END::INTEGER AS languages_count, CASE WHEN doc_id % 3 > 0 THEN ['en', 'fr'] END AS languages_sample,
          CASE WHEN doc_id % 3 > 0 THEN sha256('en,fr') END AS languages_hash, 1 AS datasets_count, ['org/set' || (doc_id % 5)] AS datasets_sample, sha256('org/set' || (doc_id % 5)) AS datasets_hash,
          CASE WHEN doc_id % 5 = 4 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'not_found' END AS readme_access,
          CASE WHEN doc_id % 5 <> 4 THEN sha256(regexp_replace(card, '(?s)\\A---\\n.*?\\n---\\n', '')) END AS readme_hash, 2 AS tags_count, tags AS tags_sample, sha256(array_to_string(tags, ',')) AS tags_hash,
          doc_id % 5 <> 4 AND regexp_matches(card, '(?im)^##\\s+training\\b') AS has_training_section, {_ACCESS} AS access,
          CASE WHEN doc_id % 5 <> 4 THEN sha256(card) END AS card_hash FROM a""",
    "d2_fingerprint": f"""{_S} SELECT target_id, day, sha256('{{"http_status":' || http_status || ',"license":' || coalesce('"' || license || '"', 'null') || ',"schema":"' || schema || '"}}') AS fp
        FROM snapshots""",
    "d3_reuse_unchanged": f"""WITH {v.CARDS} SELECT target_id, CASE WHEN doc_id % 3 = 2 THEN doc_id % 2 = 1 ELSE doc_id % 2 = 0 END AS has_training_section, doc_id % 3 = 2 AS reused FROM cards""",
    "d4_drift_events": f"""{_S}, b AS (SELECT *, {_ACCESS} AS access, CASE WHEN has_training_section THEN 'PRESENT' ELSE 'ABSENT' END AS training FROM f0), a AS (SELECT * REPLACE (day + 1 AS day) FROM b)
        SELECT target_id, b.day::DATE AS day, list_filter([CASE WHEN a.declared_datasets <> b.declared_datasets THEN 'declared_datasets' END,
            CASE WHEN a.has_training_section <> b.has_training_section THEN 'has_training_section' END, CASE WHEN a.http_status <> b.http_status THEN 'http_status' END,
            CASE WHEN a.license IS DISTINCT FROM b.license THEN 'license' END], lambda x: x IS NOT NULL) AS changed,
          a.license AS license_before, b.license AS license_after, a.training AS training_before, b.training AS training_after, a.access AS access_before, b.access AS access_after,
          len(a.declared_datasets)::INTEGER AS datasets_before, len(b.declared_datasets)::INTEGER AS datasets_after,
          list_sort(list_filter(b.declared_datasets, lambda x: NOT list_contains(a.declared_datasets, x))) AS datasets_added,
          list_sort(list_filter(a.declared_datasets, lambda x: NOT list_contains(b.declared_datasets, x))) AS datasets_removed,
          a.downloads AS downloads_before, b.downloads AS downloads_after, b.downloads - a.downloads AS downloads_delta
        FROM a JOIN b USING (target_id, day) WHERE a.fp <> b.fp AND b.http_status = 200 AND b.fetch_error IS NULL""",
    "d5_drift_quality": f"""{_S}, u AS (SELECT * REPLACE (CASE WHEN downloads % 5 > 0 THEN http_status END AS http_status) FROM snapshots)
        SELECT target_id, day, http_status, coalesce(http_status = 200 AND readme_status IN (200, 404), false) AS quality_ok FROM u
        WHERE NOT coalesce(http_status <> 200, false) AND NOT coalesce(lower(fetch_error) LIKE '%timeout%' OR lower(fetch_error) LIKE '%connection%', false)""",
    "d6_timeline_changes": f"{_S} SELECT target_id, observed_at FROM ch",
    "d7_prune_window": f"{_S} SELECT target_id, observed_at FROM snapshots WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND downloads % 4 <> 0",
    "d8_timeline_index": f"""{_S}, x AS (SELECT target_id, max(observed_at) AS changed_at, count(*) AS changes FROM ch GROUP BY 1)
        SELECT target_id, license, http_status, observed_at AS seen_at, changed_at, coalesce(changes, 0) AS changes FROM lat LEFT JOIN x USING (target_id)""",
    "d9_disclosure_index": f"""{_S} SELECT count(*) AS targets, count(license) AS with_license, round(100.0 * count(license) / count(*), 1) AS license_pct,
          count(*) FILTER (has_training_section) AS with_training, count(*) FILTER (http_status = 200) AS access_ok, count(*) FILTER (http_status = 403) AS access_forbidden,
          count(*) - count(license) AS without_license, count(*) FILTER (NOT has_training_section) AS without_training, round(avg(downloads), 2) AS mean_downloads,
          count(*) FILTER (http_status = 404) AS access_not_found, count(*) FILTER (http_status IS NULL) AS access_unknown, 0::BIGINT AS access_error,
          (SELECT count(*) FROM ch WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS events_7d,
          (SELECT count(*) FROM ch WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS events_30d, (SELECT count(DISTINCT target_id) FROM ch) AS changed_targets,
          strftime(TIMESTAMP '{NOW}', '%G-W%V') AS week_id, count(*) FILTER (len(declared_datasets) > 0) AS with_declaration, round(100.0 * count(*) FILTER (len(declared_datasets) > 0) / count(*), 1) AS declaration_pct,
          (SELECT count(DISTINCT target_id) FROM ch WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS changed_targets_30d,
          (SELECT round(count(*) / greatest(count(DISTINCT target_id), 1), 2) FROM ch WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS changes_per_target_30d FROM lat""",
    "d10_org_disclosure": f"{_S} SELECT split_part(target_id, '/', 1) AS org, count(*) AS targets, round(100.0 * count(license) / count(*), 1) AS license_pct FROM lat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "d11_movers": f"{_S} SELECT target_id, count(*) AS events FROM ch GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "d11_undocumented_tops": f"{_S} SELECT target_id, downloads FROM lat WHERE downloads > 10000 AND NOT has_training_section ORDER BY 2 DESC, 1 LIMIT 15",
    "d11_latest_events": f"""{_S}, f2 AS (SELECT *, lag(license) OVER w AS l1, lag(declared_datasets) OVER w AS l2, lag(has_training_section) OVER w AS l3, lag(http_status) OVER w AS l4 FROM f1
          WINDOW w AS (PARTITION BY target_id ORDER BY observed_at))
        SELECT target_id, observed_at, CASE WHEN lfp IS NOT NULL THEN list_filter([CASE WHEN declared_datasets <> l2 THEN 'declared_datasets' END, CASE WHEN has_training_section <> l3 THEN 'has_training_section' END,
          CASE WHEN http_status <> l4 THEN 'http_status' END, CASE WHEN license IS DISTINCT FROM l1 THEN 'license' END], lambda x: x IS NOT NULL) END AS changed
        FROM f2 WHERE (lfp IS NULL OR lat_ < observed_at - INTERVAL 30 DAY OR fp <> lfp) AND observed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY ORDER BY observed_at DESC, target_id LIMIT 20""",
    "d11_top_downloads": f"{_S} SELECT target_id, downloads FROM lat WHERE downloads > 0 ORDER BY 2 DESC, 1 LIMIT 15",
    "d11_gated_share": f"{_S} SELECT round(100.0 * count(*) FILTER (http_status = 403) / count(*), 1) AS gated_pct FROM lat",
    "d12_with_metrics": f"""WITH {v.OBSERVATIONS}, a AS (SELECT target_id, min(observation_timestamp) AS f, max(observation_timestamp) AS l, count(*) AS n,
            max(observation_timestamp) FILTER (observation_type <> 'absence') AS lp FROM observations GROUP BY 1),
        b AS (SELECT o.target_id, min(observation_timestamp) AS since FROM observations o JOIN a USING (target_id) WHERE observation_type = 'absence' AND (lp IS NULL OR observation_timestamp > lp) GROUP BY 1)
        SELECT observation_id, target_id, date_diff('day', f::DATE, l::DATE) + 1 AS days, n, coalesce(date_diff('day', since::DATE, l::DATE) + 1, 0) AS absence_days
        FROM observations JOIN a USING (target_id) LEFT JOIN b USING (target_id)""",
    "d12_temporal_metrics": f"""WITH {v.OBSERVATIONS}, a AS (SELECT target_id, min(observation_timestamp) AS first_seen, max(observation_timestamp) AS last_seen, count(*) AS n,
            max(observation_timestamp) FILTER (observation_type <> 'absence') AS lp FROM observations GROUP BY 1),
        b AS (SELECT o.target_id, min(observation_timestamp) AS since FROM observations o JOIN a USING (target_id) WHERE observation_type = 'absence' AND (lp IS NULL OR observation_timestamp > lp) GROUP BY 1)
        SELECT target_id, first_seen, last_seen, date_diff('day', first_seen::DATE, last_seen::DATE) + 1 AS days, n,
               coalesce(date_diff('day', since::DATE, last_seen::DATE) + 1, 0) AS absence_days FROM a LEFT JOIN b USING (target_id)""",
    "d13_public_evidence": f"WITH {v.OBSERVATIONS} SELECT observation_id, 'sha256:' || receipt_hash AS proof, (evidence_text::JSON->>'$.k')::INTEGER AS evidence,"
        " CASE WHEN observation_id % 3 = 0 THEN ['NEC#' || (observation_id % 20 + 1)] ELSE []::VARCHAR[] END AS violations,"
        " CASE WHEN observation_id % 3 = 0 THEN ['sha256:' || upper(receipt_hash), 'sha256:ab'] ELSE []::VARCHAR[] END AS proofs FROM observations",
    "d14_license_snapshot": f"{_L} SELECT * FROM e JOIN cf USING (dataset, period)",
    "d15_license_drift": f"""{_L}, g AS (SELECT dataset, period, round(0.6 * abs(entropy - lag(entropy) OVER w) + 0.4 * abs(unknown_ratio - lag(unknown_ratio) OVER w), 6) AS drift FROM e
        WINDOW w AS (PARTITION BY dataset ORDER BY period))
        SELECT *, CASE WHEN drift < 0.05 THEN 'low' WHEN drift < 0.15 THEN 'medium' ELSE 'high' END AS level FROM g WHERE drift IS NOT NULL""",
    "b5_migrate_timeline": f"{_S} SELECT target_id, day, CASE WHEN has_training_section THEN 'PRESENT' ELSE 'ABSENT' END AS training_state, upper({_ACCESS}) AS access FROM snapshots",
    "a8_read_observations": f"WITH {v.OBSERVATIONS} SELECT observation_id, target_id, observation_type, replace(evidence_text, ' ', '') AS evidence FROM observations",
}
