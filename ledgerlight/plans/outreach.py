"""Queries over outreach, with DuckDB SQL written from the rules of the log, not from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosure as d
from ..operators import outreach as o
from ..operators import registry as r
from ..sources import views as v

NOW = "2024-01-31 00:00:00"


def _overrides(s, f):
    """Manual lines for some targets; a later line of a target counts."""
    k = F.col("record_no")
    return v.outreach_log(s, f).where(k % 9 == 0).select(
        F.coalesce("target_id", "repo_id").alias("key"), k.alias("line_no"), F.when(k % 4 == 0, "closed").when(k % 4 == 1, "not_planned").when(k % 4 == 2, "replied").alias("status"),
        F.when(k % 2 == 0, "by hand").alias("public_note"), F.when(k % 5 == 0, k % 90).alias("completeness_score"))


def _named(column):
    k = F.col(column)
    return F.concat(F.lit("org"), (k % 5).cast("string"), F.lit("/m"), k.cast("string"))


def _links(s, f):
    """Repositories of one organisation stand for models of another key."""
    k = F.col("part_key")
    return v.reports(s, f).where(k % 5 == 2).select(_named("part_key").alias("target_id"), F.concat(F.lit("org"), ((k + 1) % 5).cast("string"), F.lit("/m"), (k + 1).cast("string")).alias("model_id"))


def _facts(s, f):
    return o.report_facts(v.reports(s, f).where("part_key % 3 > 0").withColumn("model_id", _named("part_key")))


def _compliance(s, f):
    return v.reports(s, f).where("part_key % 4 = 0").select(_named("part_key").alias("model_id"), "score")


def _records(s, f):
    return o.outreach_records(v.outreach_log(s, f), _overrides(s, f), _links(s, f), _facts(s, f), _compliance(s, f), NOW)


def _status(s, f):
    return o.outreach_status(_records(s, f))


def _older(s, f):
    """A second register: other writing of the names, other states, records that only it has."""
    k = F.length("target_id") + F.col("messages")
    older = _status(s, f).where(k % 3 > 0).withColumns({
        "target_id": F.when(k % 2 == 0, F.concat(F.lit("gh:"), F.upper("target_id"))).otherwise(F.concat(F.lit("old/"), "target_id")), "completeness_score": F.lit(55.0), "public_note": F.lit("older"),
    })
    return older


def _merged(s, f):
    return o.merge_outreach(_status(s, f), _older(s, f))


def _answers(s, f):
    k = F.col("record_no")
    return v.outreach_log(s, f).where(F.coalesce("repo_id", "target_id").isNotNull()).groupBy(F.coalesce("repo_id", "target_id").alias("repo_id"), "number").agg(
        F.max(k).alias("k")).where("k % 4 < 3").select("repo_id", "number", F.when(F.col("k") % 4 == 0, "merged").when(F.col("k") % 4 == 1, "closed").otherwise("open").alias("discussion"), (F.col("k") % 3).alias("events"))


def _followed(s, f):
    return o.answered(v.outreach_log(s, f), _answers(s, f), NOW)


def _drift(s, f):
    return d.timeline_changes(v.snapshots(s, f))


def _timeline(s, f):
    return o.outreach_timeline(o.last_messages(v.outreach_log(s, f)), _drift(s, f), _facts(s, f))


def _correlations(s, f):
    last = o.last_messages(v.outreach_log(s, f)).withColumn("message_id", F.lit(0))
    return r.drift_after_outreach(last, _drift(s, f), 24)


def _candidates(s, f):
    seen = v.snapshots(s, f).select("target_id").distinct().withColumn("package", F.concat(F.lit("p"), (F.length("target_id") % 3).cast("string")))
    return seen.unionByName(v.reports(s, f).where("part_key % 9 = 0").select(F.concat(F.lit("new"), F.col("model_id")).alias("target_id"), F.lit("p0").alias("package")))


#: Fields of a status record; all but the list are compared as they are.
_PLAIN = ["target_id", "platform", "status", "completeness_score", "offer_date", "days_pending", "discussion_url", "has_report", "linked_model_id", "provenance", "documentation", "missing",
          "highest_severity", "absent_count", "observed_at", "public_note", "messages"]

QUERIES = {
    "r7_outreach_status": lambda s, f: _status(s, f).select(*_PLAIN),
    "r7_longest_pending": lambda s, f: o.longest_pending(_status(s, f)).select("target_id", "days_pending", "completeness_score"),
    "r8_outreach_stats": lambda s, f: o.outreach_stats(_status(s, f)),
    "r9_merge_outreach": lambda s, f: _merged(s, f),
    "r9_merged_stats": lambda s, f: o.merged_stats(_merged(s, f)),
    "r12_outreach_timeline": lambda s, f: _timeline(s, f),
    "r12_timeline_stats": lambda s, f: o.timeline_stats(_timeline(s, f), _drift(s, f), _correlations(s, f)),
    "r17_answered": lambda s, f: _followed(s, f),
    "r17_response_rates": lambda s, f: o.response_rates(_followed(s, f)),
    "r17_response_by_org": lambda s, f: o.response_by_org(_followed(s, f)),
    "r17_top_acceptors": lambda s, f: o.top_acceptors(o.response_by_org(_followed(s, f))),
    "r18_sync_status": lambda s, f: o.sync_status(v.outreach_log(s, f), _followed(s, f)).select("record_no", "status", "updated"),
    "r19_cooldown_reasons": lambda s, f: o.cooldown_reasons(_candidates(s, f), v.outreach_log(s, f), NOW, 3, scope="repo").select("target_id", "package", "reason"),
    "r19_cooldown_filter": lambda s, f: o.cooldown_filter(_candidates(s, f), v.outreach_log(s, f), "2024-01-30 12:00:00", 1).select("target_id", "package", "org"),
}

_NAMED = "'org' || (part_key % 5) || '/m' || part_key"
_STATUS = f"""WITH {v.OUTREACH_LOG}, {v.REPORTS},
ovl AS (SELECT coalesce(target_id, repo_id) AS tid, record_no AS line_no, CASE record_no % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'not_planned' WHEN 2 THEN 'replied' END AS o_status,
          CASE WHEN record_no % 2 = 0 THEN 'by hand' END AS o_note, CASE WHEN record_no % 5 = 0 THEN record_no % 90 END AS o_score FROM olog WHERE record_no % 9 = 0),
ov AS (SELECT * FROM ovl WHERE tid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY line_no DESC) = 1),
rec AS (SELECT *, coalesce(repo_id, target_id, 'unknown') AS tid FROM olog WHERE status IN ('sent', 'acknowledged', 'merged', 'accepted', 'closed', 'replied', 'not_planned', 'blocked', 'access_restricted', 'restricted')),
mer AS (SELECT rec.* REPLACE (coalesce(o_status, status) AS status, coalesce(o_note, public_note) AS public_note, coalesce(o_score, completeness_score) AS completeness_score) FROM rec LEFT JOIN ov USING (tid)),
sta AS (SELECT *, CASE
    WHEN status IN ('access_restricted', 'blocked', 'restricted') THEN 'access_restricted' WHEN status IN ('acknowledged', 'merged', 'accepted', 'replied') THEN 'acknowledged'
    WHEN status IN ('closed', 'not_planned') THEN 'closed' WHEN response_type IN ('access_restricted', 'blocked', 'restricted') THEN 'access_restricted'
    WHEN response_type IN ('merged', 'acknowledged', 'accepted') THEN 'acknowledged' WHEN response_type IN ('closed', 'not_planned') THEN 'closed' ELSE 'pending' END AS state FROM mer),
lnk AS (SELECT {_NAMED} AS tid, 'org' || ((part_key + 1) % 5) || '/m' || (part_key + 1) AS model FROM reports WHERE part_key % 5 = 2),
fct AS (SELECT {_NAMED} AS model, severity, reported_on::VARCHAR AS seen, len(list_filter(observations, lambda o: o.status = 'PRESENT')) AS p, len(list_filter(observations, lambda o: o.status = 'ABSENT')) AS a,
          observations[1].status AS first, list_transform(list_filter(observations, lambda o: o.status = 'ABSENT'), lambda o: o.nec_id)[1:3] AS gone FROM reports WHERE part_key % 3 > 0),
cmp AS (SELECT {_NAMED} AS model, score AS c_score, true AS scored FROM reports WHERE part_key % 4 = 0),
lkd AS (SELECT sta.*, CASE WHEN platform = 'github' THEN lnk.model END AS linked FROM sta LEFT JOIN lnk USING (tid)),
ful AS (SELECT l.*, fct.*, c_score, scored, greatest(0, coalesce(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(sent_at))) / 86400), 0))::BIGINT AS days FROM lkd l LEFT JOIN fct ON fct.model = coalesce(linked, tid) LEFT JOIN cmp ON cmp.model = coalesce(linked, tid)),
st AS (
  SELECT tid AS target_id, platform, state AS status, CASE WHEN scored THEN coalesce(c_score, 0) WHEN p IS NOT NULL THEN floor(p::DOUBLE / (p + a) * 100) ELSE coalesce(completeness_score, 0) END::DOUBLE AS completeness_score,
    coalesce(strftime(sent_at, '%Y-%m-%d'), '') AS offer_date, days AS days_pending,
    coalesce(discussion_url, CASE WHEN number > 0 AND platform = 'github' THEN 'https://github.com/' || repo_id || '/issues/' || number WHEN number > 0 THEN 'https://huggingface.co/' || repo_id || '/discussions/' || number END) AS discussion_url,
    p IS NOT NULL AS has_report, linked AS linked_model_id, CASE first WHEN 'PRESENT' THEN 'present' WHEN 'ABSENT' THEN 'missing' ELSE 'unknown' END AS provenance,
    CASE WHEN p IS NULL THEN 'unknown' WHEN a = 0 THEN 'complete' ELSE 'partial' END AS documentation, coalesce(gone, []) AS missing, severity AS highest_severity, a AS absent_count,
    coalesce(seen, '') AS observed_at, coalesce(public_note, '') AS public_note, count(*) OVER (PARTITION BY tid) AS messages
  FROM ful QUALIFY row_number() OVER (PARTITION BY tid ORDER BY CASE state WHEN 'access_restricted' THEN 4 WHEN 'acknowledged' THEN 3 WHEN 'closed' THEN 2 ELSE 1 END DESC,
    coalesce(sent_at, TIMESTAMP '1970-01-01') DESC, platform DESC, record_no) = 1)"""
_MERGED = f"""{_STATUS},
old AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN 'gh:' || upper(target_id) ELSE 'old/' || target_id END AS target_id, 55.0::DOUBLE AS completeness_score, 'older' AS public_note)
        FROM (SELECT *, length(target_id) + messages AS k FROM st) WHERE k % 3 > 0),
mg AS (
  SELECT coalesce(lower(a.target_id), CASE WHEN b.target_id LIKE 'gh:%' THEN lower(b.target_id[4:]) ELSE lower(b.target_id) END) AS key, coalesce(a.target_id, b.target_id) AS target_id,
    CASE WHEN a.target_id IS NULL OR b.status IN ('closed', 'acknowledged', 'access_restricted', 'replied') THEN b.status ELSE a.status END AS status,
    CASE WHEN coalesce(a.completeness_score, 0) = 0 THEN coalesce(b.completeness_score, 0) ELSE a.completeness_score END AS completeness_score, coalesce(a.absent_count, b.absent_count, 0) AS absent_count,
    coalesce(a.days_pending, b.days_pending) AS days_pending, coalesce(a.provenance, b.provenance) AS provenance, coalesce(a.documentation, b.documentation) AS documentation,
    coalesce(a.highest_severity, b.highest_severity, '') AS highest_severity, CASE WHEN coalesce(a.observed_at, '') = '' THEN coalesce(b.observed_at, '') ELSE a.observed_at END AS observed_at,
    CASE WHEN coalesce(a.public_note, '') = '' THEN coalesce(b.public_note, '') ELSE a.public_note END AS public_note, '' AS event_type,
    coalesce(CASE WHEN a.target_id IS NULL THEN b.discussion_url ELSE a.discussion_url END, '') AS discussion_url, coalesce(a.offer_date, b.offer_date) AS offer_date, coalesce(a.platform, b.platform) AS platform,
    coalesce(a.has_report, false) OR coalesce(b.has_report, false) AS has_report, CASE WHEN len(coalesce(a.missing, [])) = 0 THEN coalesce(b.missing, []) ELSE a.missing END AS missing, a.target_id IS NULL AS older_only
  FROM st a FULL OUTER JOIN old b ON b.target_id = 'gh:' || upper(a.target_id))"""
_FOLLOWED = f"""WITH {v.OUTREACH_LOG},
tr AS (SELECT coalesce(repo_id, target_id, '') AS repo_id, number, sent_at FROM olog WHERE status IN ('sent', 'acknowledged', 'closed', 'merged', 'accepted') AND number > 0
       QUALIFY row_number() OVER (PARTITION BY coalesce(repo_id, target_id, ''), number ORDER BY record_no DESC) = 1),
an AS (SELECT coalesce(repo_id, target_id) AS repo_id, number, max(record_no) AS k FROM olog WHERE coalesce(repo_id, target_id) IS NOT NULL GROUP BY 1, 2 HAVING max(record_no) % 4 < 3),
rs AS (SELECT tr.*, CASE WHEN k % 4 = 0 THEN 'merged' WHEN k % 4 = 1 THEN 'closed' WHEN k % 4 = 2 AND k % 3 > 1 THEN 'acknowledged' ELSE 'none' END AS response_type,
         greatest(0, coalesce(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(sent_at))) / 86400), 0))::BIGINT AS days_since_sent FROM tr LEFT JOIN an USING (repo_id, number)),
fo AS (SELECT *, CASE response_type WHEN 'merged' THEN 'accepted' WHEN 'closed' THEN 'declined' ELSE CASE WHEN response_type = 'none' AND days_since_sent > 14 THEN 'no_response' ELSE 'pending' END END AS status FROM rs),
og AS (SELECT CASE WHEN contains(repo_id, '/') THEN split_part(repo_id, '/', 1) ELSE 'unknown' END AS org, count(*) AS sent, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'declined') AS declined FROM fo GROUP BY 1)"""
_TIMELINE = f"""WITH {v.OUTREACH_LOG}, {v.SNAPSHOTS}, {v.REPORTS},
f0 AS (SELECT *, [schema, license, declared_datasets::VARCHAR, has_training_section::VARCHAR, http_status::VARCHAR]::VARCHAR AS fp FROM snapshots),
f1 AS (SELECT *, lag(fp) OVER w AS lfp, lag(observed_at) OVER w AS la, declared_datasets <> lag(declared_datasets) OVER w OR has_training_section <> lag(has_training_section) OVER w AS means
  FROM f0 WINDOW w AS (PARTITION BY target_id ORDER BY observed_at)),
ch AS (SELECT * FROM f1 WHERE lfp IS NULL OR la < observed_at - INTERVAL 30 DAY OR fp <> lfp),
lm AS (SELECT coalesce(repo_id, target_id) AS target_id, sent_at, response_type FROM olog WHERE status IN ('sent', 'acknowledged', 'merged', 'accepted') AND sent_at IS NOT NULL AND coalesce(repo_id, target_id) IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY coalesce(repo_id, target_id) ORDER BY record_no DESC) = 1),
dr AS (SELECT target_id, count(*) FILTER (observed_at > sent_at) AS n FROM ch JOIN lm USING (target_id) GROUP BY 1),
tl AS (SELECT lm.target_id, sent_at::DATE AS outreach_date, coalesce(n, 0) AS drift_count, coalesce(n, 0) > 0 AS has_post_drift, n IS NOT NULL AS any_drift, r.severity IS NOT NULL AS has_report,
         coalesce(r.severity, '') AS severity, coalesce(response_type = 'acknowledged', false) AS responded
       FROM lm LEFT JOIN dr USING (target_id) LEFT JOIN (SELECT {_NAMED} AS target_id, severity FROM reports WHERE part_key % 3 > 0) r USING (target_id))"""
_STATES = "count(*) FILTER (status = 'access_restricted') AS access_restricted, count(*) FILTER (status = 'acknowledged') AS acknowledged, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'pending') AS pending"
_CANDIDATES = """cd AS (SELECT DISTINCT target_id, 'p' || (length(target_id) % 3) AS package FROM snapshots
  UNION ALL SELECT 'new' || lower(replace(p_brand, '#', '')) || '/m' || p_partkey, 'p0' FROM part WHERE p_partkey % 9 = 0)"""

SQL = {
    "r7_outreach_status": f"{_STATUS} SELECT * FROM st",
    "r7_longest_pending": f"{_STATUS} SELECT target_id, days_pending, completeness_score FROM st ORDER BY days_pending DESC, completeness_score DESC, target_id LIMIT 100",
    "r8_outreach_stats": f"""{_STATUS} SELECT platform, count(*) AS total_offered, {_STATES}, round(avg(days_pending), 1) AS avg_days_pending, round(avg(completeness_score), 1) AS avg_completeness,
        count(*) FILTER (has_report) AS with_report, sum(messages)::BIGINT AS messages, grouping(platform)::INTEGER AS is_total FROM st GROUP BY ROLLUP (platform)""",
    "r9_merge_outreach": f"{_MERGED} SELECT * FROM mg",
    "r9_merged_stats": f"""{_MERGED} SELECT platform, count(*) AS total_offered, {_STATES}, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("no_response", "sent", "failed", "skipped", "blocked"))},
        round(avg(days_pending), 1) AS avg_days_pending, round(avg(completeness_score), 1) AS avg_completeness, count(*) FILTER (has_report) AS with_report, grouping(platform)::INTEGER AS is_total FROM mg GROUP BY ROLLUP (platform)""",
    "r12_outreach_timeline": f"{_TIMELINE} SELECT * FROM tl",
    "r12_timeline_stats": f"""{_TIMELINE} SELECT count(*) AS total_outreach, count(*) FILTER (any_drift) AS outreach_with_drift, count(*) FILTER (responded) AS acknowledged_responses, count(*) FILTER (has_report) AS models_with_report,
        (SELECT count(*) FROM ch) AS total_drift_events, (SELECT count(*) FROM lm JOIN ch USING (target_id) WHERE means AND observed_at BETWEEN sent_at + INTERVAL 24 HOUR AND sent_at + INTERVAL 30 DAY) AS post_outreach_correlations,
        round(100.0 * count(*) FILTER (any_drift) / greatest(count(*), 1), 1) AS correlation_rate FROM tl""",
    "r17_answered": f"{_FOLLOWED} SELECT * FROM fo",
    "r17_response_rates": f"""{_FOLLOWED}, c AS (SELECT count(*) AS total_sent, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'declined') AS declined, count(*) FILTER (status = 'pending') AS pending,
        count(*) FILTER (status = 'no_response') AS no_response FROM fo) SELECT *, CASE WHEN accepted + declined > 0 THEN round(100.0 * accepted / (accepted + declined), 1) ELSE 0 END AS acceptance_rate_pct,
        CASE WHEN total_sent > 0 THEN round(100.0 * (accepted + declined) / total_sent, 1) ELSE 0 END AS response_rate_pct FROM c""",
    "r17_response_by_org": f"{_FOLLOWED} SELECT * FROM og",
    "r17_top_acceptors": f"{_FOLLOWED} SELECT org, accepted FROM og WHERE accepted > 0 ORDER BY accepted DESC, org LIMIT 10",
    "r18_sync_status": f"""{_FOLLOWED}, sy AS (SELECT record_no, olog.status AS old, CASE WHEN fo.status = 'accepted' AND response_type IN ('merged', 'acknowledged') THEN 'acknowledged' WHEN fo.status = 'pending' AND fo.response_type = 'acknowledged' THEN 'acknowledged'
        WHEN fo.status = 'declined' AND fo.response_type = 'closed' THEN 'closed' WHEN fo.repo_id IS NOT NULL THEN coalesce(olog.status, 'sent') ELSE olog.status END AS status
        FROM (SELECT * EXCLUDE (response_type) FROM olog) olog LEFT JOIN fo ON fo.repo_id = coalesce(olog.repo_id, olog.target_id, '') AND fo.number = olog.number)
        SELECT record_no, status, status IS DISTINCT FROM old AS updated FROM sy""",
    "r19_cooldown_reasons": f"""WITH {v.OUTREACH_LOG}, {v.SNAPSHOTS}, {_CANDIDATES}, rc AS (SELECT * FROM olog WHERE status = 'sent' AND repo_id IS NOT NULL AND sent_at > TIMESTAMP '{NOW}' - INTERVAL 3 DAY)
        SELECT target_id, package, CASE WHEN target_id IN (SELECT repo_id FROM rc) THEN 'repository' WHEN (target_id, package) IN (SELECT (repo_id, package) FROM rc) THEN 'package' END AS reason FROM cd""",
    "r19_cooldown_filter": f"""WITH {v.OUTREACH_LOG}, {v.SNAPSHOTS}, {_CANDIDATES}, rc AS (SELECT * FROM olog WHERE status = 'sent' AND repo_id IS NOT NULL AND sent_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY)
        SELECT target_id, package, split_part(target_id, '/', 1) AS org FROM cd WHERE split_part(target_id, '/', 1) NOT IN (SELECT split_part(repo_id, '/', 1) FROM rc)""",
}
