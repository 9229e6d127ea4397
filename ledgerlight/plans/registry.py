"""Queries over reports, outreach, lineage and targets, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosure as d
from ..operators import lineage as g
from ..operators import outreach as o
from ..operators import registry as r
from ..sources import views as v

NOW = "2024-01-31 00:00:00"


def _full_reports(s, f):
    """Reports with descriptions, evidence and jurisdictions."""
    k = F.col("part_key")
    seen = F.transform("observations", lambda o: F.struct(o["nec_id"], F.concat(F.lit("name of "), o["nec_id"]).alias("name"), F.lit("text").alias("description"), o["status"],
                                                          F.when(o["status"] == "ABSENT", 70).otherwise(0).alias("severity"), F.lit("secret").alias("evidence")))
    places = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("J"), i.cast("string")).alias("code"), F.lit("place").alias("name"), F.lit(6).alias("total_elements"), (k % 4).alias("present"), (k % 2).alias("absent"),
        (6 - k % 4 - k % 2).alias("partial"), (k % 4 * 10).alias("score_pct"), F.array(F.lit("art10")).alias("missing_articles")))
    return v.reports(s, f).withColumns({"observations": seen, "jurisdictions": places})


def _lines(part):
    return F.transform(part, lambda x: F.concat_ws("|", *[x[n].cast("string") for n in r.PUBLIC[part]]))


def _written(s, f):
    return v.reports(s, f).where("part_key % 4 = 0").select("model_id")


def _after(s, f):
    sent = v.outreach(s, f).where(F.col("status").isin(*o.SENT))
    return r.drift_after_outreach(sent, d.timeline_changes(v.snapshots(s, f)), 24)


def _facts(s, f):
    """Reports of the targets that messages go to."""
    k = F.col("part_key")
    named = F.concat(F.lit("org"), (k % 5).cast("string"), F.lit("/m"), k.cast("string"))
    return o.report_facts(v.reports(s, f).where(k % 3 > 0).withColumn("model_id", named))


def _after_with_report(s, f):
    sent = v.outreach(s, f).where(F.col("status").isin(*o.SENT))
    return r.drift_after_outreach(sent, d.timeline_changes(v.snapshots(s, f)), 24, facts=_facts(s, f))


def _summarised(s, f):
    """Reports of which some have a summary, with or without counts and a label."""
    k = F.col("part_key")
    count = lambda n: F.when(k % 5 > 0, k % n)
    summary = F.struct(F.when(k % 7 > 0, k % 1000 / 8.0).alias("score"), F.when(k % 4 == 0, "MODERATE").when(k % 4 == 1, "").alias("label"), count(11).alias("present"),
                       count(6).alias("absent"), count(3).alias("partial"), F.when(k % 2 > 0, F.lit(18)).alias("total"))
    return v.reports(s, f).withColumn("summary", F.when(k % 3 > 0, summary))


def _report_targets(s, f):
    k = F.col("part_key")
    return v.reports(s, f).where(k % 3 == 0).select(F.when(k % 2 == 0, F.col("model_id")).otherwise(F.concat(F.lit("fork/m"), k.cast("string"))).alias("target_id"))


def _packs(s, f):
    rep = v.reports(s, f)
    count = lambda status: F.size(F.filter("observations", lambda o: o["status"] == status))
    return r.warranty_packs(
        rep.where("part_key % 2 = 0").select("model_id", count("PRESENT").alias("present"), count("ABSENT").alias("absent")), rep.where("part_key % 3 = 0").select("model_id", "score", "severity"),
        rep.where("part_key % 5 = 0").select("model_id", F.lit("sent").alias("status"), F.lit("hub").alias("platform")),
        rep.where("part_key % 7 = 0").select("model_id", (F.col("score") / 100).alias("provenance_score")))


def _claims(s, f):
    """Claims of the packs' sources, with proofs, gaps, notices and sets to support them."""
    rep, k = v.reports(s, f), F.col("part_key")
    count = lambda status: F.size(F.filter("observations", lambda o: o["status"] == status))
    sets = F.transform(F.sequence(F.lit(1), (k % 8 + 1).cast("int")), lambda i: F.concat(F.lit("ds"), i.cast("string")))
    return r.warranty_claims(
        rep.where(k % 2 == 0).select("model_id", F.sha2("model_id", 256).alias("proof_id"), F.when(k % 4 == 0, F.sha2(k.cast("string"), 256)).alias("anchor"), F.col("reported_on").alias("observed_at"), count("PRESENT").alias("present"), count("ABSENT").alias("absent")),
        rep.where(k % 3 == 0).select("model_id", F.col("score").cast("long").alias("score"), "severity", F.transform("gaps", lambda g: g["gap_id"]).alias("gaps")),
        rep.where(k % 5 == 0).select("model_id", F.lit("hub").alias("platform"), F.lit("closed").alias("status"), (k % 30).alias("days_pending")),
        rep.where(k % 7 == 0).select("model_id", F.when(k % 2 == 0, "mit").alias("license"), sets.alias("declared")))


def _comparisons(s, f):
    """Two runs over some models: with a fork, and some with themselves."""
    rep, k = v.reports(s, f).where("part_key % 10 = 0"), F.col("part_key")
    pair = lambda run, left, right, says: rep.select(F.lit(run).alias("run"), left.alias("left_id"), right.alias("right_id"), F.lit(says).alias("relationship"), (k % 7 / 8).alias("confidence"),
                                                     F.sha2(F.concat(F.lit(says), k.cast("string")), 256).alias("comparison_hash"))
    fork = F.concat(F.lit("fork/m"), k.cast("string"))
    return pair(2, F.col("model_id"), fork, "derived").unionByName(pair(1, fork, F.col("model_id"), "equal").where("confidence > 0.5")).unionByName(
        pair(3, F.col("model_id"), F.col("model_id"), "self"))


def _filed(s, f):
    """Two files of each report, the older one with another score."""
    rep = v.reports(s, f).withColumn("file_name", F.lit("2024-02.json"))
    return rep.unionByName(rep.withColumns({"file_name": F.lit("2024-01.json"), "score": F.lit(-1.0), "reported_on": F.lit("2020-01-01").cast("date")}))


def _shown(s, f):
    """Provenance of some of the models."""
    k = F.col("part_key")
    return v.reports(s, f).where(k % 3 == 0).select("model_id", F.transform(F.sequence(F.lit(1), (k % 8 + 1).cast("int")), lambda i: F.concat(F.lit("ds"), i.cast("string"))).alias("declared"), (k % 10 / 10).alias("provenance_score"))


def _edges(s, f):
    return g.lineage_edges(v.chains(s, f), _trained(s, f))


def _trained(s, f):
    """Mentions of the cards with their confidence, and declared sets."""
    chains = v.chains(s, f)
    mentions = chains.select("model_id", F.explode(F.array_distinct("datasets")).alias("dataset"), (F.when(F.col("key") % 3 == 0, 0.9).when(F.col("key") % 3 == 1, 0.7).otherwise(0.5)).alias("confidence"))
    return g.trained_on(mentions, g.dataset_sets(v.model_signals(s, f).withColumn("value", F.upper("value"))))


def _provenance(s, f):
    return g.provenance(v.chains(s, f), v.model_signals(s, f))


def _graph(s, f):
    """Claims, receipts and messages of a ledger, chains, and an earlier graph; the ledger writes some names in capitals."""
    chains, k = v.chains(s, f), F.col("key")
    name = lambda n: F.concat(F.lit("org"), (n % 7).cast("string"), F.lit("/m"), n.cast("string"))
    half = F.floor(k / 2).cast("long")
    claims = chains.where(k % 3 == 0).select(F.when(k % 2 == 0, F.upper(name(k))).otherwise(name(k)).alias("target_id"), F.when(k % 5 > 0, name(half)).alias("parent"))
    receipts = chains.where(k % 4 == 0).select(name(k).alias("target_id"), (k % 9).cast("int").alias("absent_count"), F.lit("HIGH").alias("severity"))
    outreach = chains.where(k % 5 == 0).select(F.initcap(name(k)).alias("target_id"), F.lit("closed").alias("status"), F.lit("hub").alias("platform"))
    sonar = chains.where(k % 2 == 0).select(name(k).alias("model_id"), F.when(k % 8 > 0, name(half)).otherwise("bare").alias("base_model"), F.col("datasets").alias("declared"), F.col("score").alias("provenance_score"))
    old_nodes = chains.where(k % 6 == 0).select(F.concat(F.lit("M-"), k.cast("string")).alias("id"), F.lit("model").alias("type"), F.upper(name(k)).alias("label")).unionByName(
        chains.where(k <= 13).select(F.concat(F.lit("X-"), k.cast("string")).alias("id"), F.when(k < 5, "org").when(k < 12, "dataset").otherwise("shadow").alias("type"), F.concat(F.lit("ds"), k.cast("string")).alias("label")))
    old_edges = chains.where(k % 6 == 0).select(F.concat(F.lit("M-"), k.cast("string")).alias("source"), F.concat(F.lit("X-"), (k % 17).cast("string")).alias("target"), F.when(k % 4 == 0, "trained_on").otherwise("owns").alias("type"))
    return g.resolve_graph(claims, receipts, outreach, sonar, old_nodes, old_edges)


def _known(s, f):
    return v.targets(s, f).where("source = 'registry'")


QUERIES = {
    "r1_compliance_index": lambda s, f: r.compliance_index(_summarised(s, f)),
    "b3_redact_reports": lambda s, f: r.redact_reports(_full_reports(s, f)).select(
        "model_id", "severity", "total_gaps", F.transform("gaps", lambda x: F.concat_ws("|", x["gap_id"], F.size(x["articles"]).cast("string"))).alias("gaps"),
        *[_lines(c).alias(c) for c in ("observations", "jurisdictions")]),
    "r2_model_ranking": lambda s, f: r.model_ranking(v.reports(s, f)).select("model_id", "rank", "score"),
    "r3_org_ranking": lambda s, f: r.org_ranking(v.reports(s, f)),
    "r4_ranking_stats": lambda s, f: r.ranking_stats(r.model_ranking(v.reports(s, f))),
    "r5_latest_reports": lambda s, f: r.latest_reports(_filed(s, f), _written(s, f), 700, _shown(s, f)).select("model_id", "written", "reported_on", "score", "file_name", "declared", "provenance_score", "has_provenance"),
    "r6_report_metrics": lambda s, f: r.report_metrics(v.reports(s, f)),
    "r10_enrich_with_report": lambda s, f: r.enrich_with_report(_report_targets(s, f), v.reports(s, f)),
    "r11_drift_after_outreach": lambda s, f: _after_with_report(s, f).withColumn("changes", F.array_sort("changes")),
    "r13_verified_findings": lambda s, f: r.verified_findings(_after(s, f)),
    "r14_warranty_packs": lambda s, f: _packs(s, f),
    "r14_warranty_claims": lambda s, f: _claims(s, f).withColumn("support", F.array_sort(F.transform(F.map_entries("support"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))),
    "r15_warranty_index": lambda s, f: r.warranty_index(_packs(s, f)),
    "r16_passports": lambda s, f: r.passports(v.reports(s, f), _comparisons(s, f)),
    "g1_lineage_edges": lambda s, f: _edges(s, f),
    "g1_lineage_nodes": lambda s, f: g.lineage_nodes(v.chains(s, f)),
    "g2_merge_graph": lambda s, f: g.merge_graph(_edges(s, f).where("type = 'owns'"), _edges(s, f).withColumn("weight", F.lit(0.1))),
    "g2_resolved_nodes": lambda s, f: _graph(s, f)[0],
    "g2_resolved_edges": lambda s, f: _graph(s, f)[1],
    "g3_graph_counts": lambda s, f: g.graph_counts(g.lineage_nodes(v.chains(s, f)), _edges(s, f)),
    "g3_graph_rates": lambda s, f: g.graph_rates(v.chains(s, f)),
    "g4_shared_datasets": lambda s, f: g.shared_datasets(v.chains(s, f)),
    "g5_opacity_cascades": lambda s, f: g.opacity_cascades(v.chains(s, f)),
    "g5_most_depended": lambda s, f: g.most_depended(v.chains(s, f)),
    "g6_org_means": lambda s, f: g.org_means(_provenance(s, f).join(v.chains(s, f).select("model_id", "org", F.when(F.col("key") % 7 > 0, 100 * F.col("score")).alias("compliance_score")), "model_id")),
    "g6_score_distribution": lambda s, f: g.score_distribution(v.chains(s, f)),
    "b4_redact_graph": lambda s, f: g.redact_graph(v.chains(s, f)),
    "n10_inherited_signals": lambda s, f: g.inherited_signals(v.model_signals(s, f), v.chains(s, f)).withColumn("confidence", F.round("confidence", 6)),
    "n11_provenance_score": lambda s, f: _provenance(s, f),
    "n12_ancestors": lambda s, f: g.ancestors(v.chains(s, f)),
    "n12_base_chain": lambda s, f: g.base_chain(v.chains(s, f)),
    "n13_best_and_worst": lambda s, f: g.best_and_worst(v.chains(s, f)),
    "n13_scan_summary": lambda s, f: g.scan_summary(v.chains(s, f)),
    "b6_select_targets": lambda s, f: g.select_targets(v.targets(s, f), 1000, 100),
    "b7_normalize_target_id": lambda s, f: v.targets(s, f).select("target_id", "source", g.normalize_target_id(F.concat(F.lit("hf:model: "), "target_id")).alias("id"),
        g.target_org(F.when(F.col("downloads") % 5 == 0, F.lit("gh:bare")).otherwise(F.col("target_id"))).alias("org")),
    "m1_merge_targets": lambda s, f: g.merge_targets(v.targets(s, f)),
    "m2_new_targets": lambda s, f: g.new_targets(v.targets(s, f).where("source <> 'registry'"), _known(s, f)),
    "m3_one_per_org": lambda s, f: g.one_per_org(v.targets(s, f), s.createDataFrame([("org3",)], "org string"), 100, 25),
    "m3_allowed_orgs": lambda s, f: g.one_per_org(v.targets(s, f), s.createDataFrame([("org3",)], "org string"), 100, 25, v.targets(s, f).where("downloads % 2 = 0").select(F.split("target_id", "/")[0].alias("org")).distinct()),
    "m4_search_targets": lambda s, f: g.search_targets(v.targets(s, f), v.targets(s, f).where("downloads % 2 = 0").select(F.col("target_id").alias("model_id"))),
}

_R = f"WITH {v.REPORTS}, sv(severity, o) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)), rs AS (SELECT * REPLACE (coalesce(score, 0) AS score) FROM reports JOIN sv USING (severity)), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, o DESC, downloads DESC, model_id) AS rank FROM rs)"
_REPORTS_ONLY = f"WITH {v.REPORTS} SELECT * FROM reports"
_D = f"""WITH {v.OUTREACH}, {v.SNAPSHOTS},
f0 AS (SELECT *, [schema, license, declared_datasets::VARCHAR, has_training_section::VARCHAR, http_status::VARCHAR]::VARCHAR AS fp FROM snapshots),
f1 AS (SELECT *, lag(fp) OVER w AS lfp, lag(observed_at) OVER w AS la, lag(declared_datasets) OVER w AS lds, lag(has_training_section) OVER w AS lts, declared_datasets <> lag(declared_datasets) OVER w OR has_training_section <> lag(has_training_section) OVER w AS means
  FROM f0 WINDOW w AS (PARTITION BY target_id ORDER BY observed_at)),
ch AS (SELECT * FROM f1 WHERE lfp IS NULL OR la < observed_at - INTERVAL 30 DAY OR fp <> lfp),
me AS (SELECT * FROM outreach),
af AS (SELECT message_id, target_id, observed_at, (epoch(date_trunc('second', observed_at))::BIGINT - epoch(date_trunc('second', sent_at))::BIGINT) // 3600 AS hours_after FROM me JOIN ch USING (target_id)
  WHERE means AND status IN ('sent', 'accepted') AND observed_at BETWEEN sent_at + INTERVAL 24 HOUR AND sent_at + INTERVAL 30 DAY)"""
_P = f"""{_R}, sr AS (SELECT *, part_key % 2 = 0 AS p, part_key % 3 = 0 AS c, part_key % 5 = 0 AS n, part_key % 7 = 0 AS s, len(list_filter(observations, lambda o: o.status = 'PRESENT')) AS present,
  len(list_filter(observations, lambda o: o.status = 'ABSENT')) AS absent FROM reports),
pk AS (SELECT model_id, org AS organization, CASE WHEN p AND c AND n THEN 'WARRANTY_PREP_READY' WHEN p AND c THEN 'EVIDENCE_PACK_READY' WHEN p OR c OR n THEN 'PARTIAL_RAIL' ELSE 'INSUFFICIENT_EVIDENCE' END AS state,
  CASE WHEN p AND c THEN 'HIGH' WHEN p OR c OR n THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  list_filter([CASE WHEN p THEN 'documentation_observation' END, CASE WHEN c THEN 'compliance_gap_map' END, CASE WHEN n THEN 'notice_trail' END, CASE WHEN s THEN 'provenance_support' END], lambda x: x IS NOT NULL) AS claims,
  list_filter([CASE WHEN NOT p THEN 'no_proof' END, CASE WHEN NOT c THEN 'no_compliance' END, CASE WHEN NOT s THEN 'no_provenance' END], lambda x: x IS NOT NULL) AS exclusions,
  CASE WHEN p AND present + absent > 0 THEN round(100.0 * present / (present + absent), 1) END AS completeness_pct, CASE WHEN c THEN score END AS compliance_score, CASE WHEN c THEN severity END AS severity,
  CASE WHEN s THEN score / 100 END AS provenance_score, CASE WHEN n THEN 'sent' END AS status, CASE WHEN n THEN 'hub' END AS platform FROM sr WHERE p OR c OR n OR s)"""


def _id(kind: str, name: str) -> str:
    return f"'{kind[0]}_' || substr(sha256('{kind}:' || lower({name})), 1, 12)"


_CHAIN = """LEFT JOIN LATERAL (SELECT base_model AS c1 FROM chains WHERE model_id = c0.model_id AND base_model <> c0.model_id) ON true
        LEFT JOIN LATERAL (SELECT base_model AS c2 FROM chains WHERE model_id = c1 AND base_model NOT IN (c0.model_id, c1)) ON true
        LEFT JOIN LATERAL (SELECT base_model AS c3 FROM chains WHERE model_id = c2 AND base_model NOT IN (c0.model_id, c1, c2)) ON true
        LEFT JOIN LATERAL (SELECT base_model AS c4 FROM chains WHERE model_id = c3 AND base_model NOT IN (c0.model_id, c1, c2, c3)) ON true
        LEFT JOIN LATERAL (SELECT base_model AS c5 FROM chains WHERE model_id = c4 AND base_model NOT IN (c0.model_id, c1, c2, c3, c4)) ON true"""
_G = f"""WITH {v.CHAINS},
{v.MODEL_SIGNALS},
mnt AS (SELECT DISTINCT model_id, unnest(datasets) AS d, CASE key % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM chains),
trn AS (SELECT * FROM mnt UNION ALL SELECT DISTINCT model_id, value, 0.95 FROM msig m WHERE signal IN ('tag', 'readme_dataset') AND confidence >= 0.7 AND NOT EXISTS (SELECT 1 FROM mnt WHERE mnt.model_id = m.model_id AND lower(d) = lower(value))),
inh AS (SELECT DISTINCT c.model_id, 'inherited_' || signal AS signal, value, confidence * 0.8 AS confidence, 'base_model:' || base_model AS source FROM chains c JOIN msig b ON b.model_id = c.base_model WHERE signal IN ('readme_dataset', 'known_dataset') AND c.base_model <> c.model_id),
als AS (SELECT model_id, signal, value, confidence FROM msig UNION ALL SELECT model_id, signal, value, confidence FROM inh),
pvs AS (SELECT model_id, list_sort(coalesce(list(DISTINCT value) FILTER (signal IN ('tag', 'readme_dataset') AND confidence >= 0.7), [])) AS declared,
  list_sort(coalesce(list(DISTINCT value) FILTER (signal IN ('known_dataset', 'inherited_readme_dataset', 'inherited_known_dataset')), [])) AS inferred, bool_or(signal = 'training_section') AS has_training FROM als GROUP BY 1),
pvc AS (SELECT c.model_id, base_model, license, coalesce(declared, []) AS declared, coalesce(inferred, []) AS inferred, coalesce(p.has_training, false) AS has_training, c.org, c.key, c.score FROM chains c LEFT JOIN pvs p USING (model_id)),
prv AS (SELECT *, round(least(1.0, CASE WHEN has_training THEN 0.3 ELSE 0 END + least(0.3, 0.1 * len(declared)) + CASE WHEN license IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN base_model IS NOT NULL THEN 0.1 ELSE 0 END
  + least(0.2, 0.05 * len(inferred))), 6)::DOUBLE AS provenance_score FROM pvc),
stp AS (SELECT DISTINCT bases[i] AS base_from, bases[i + 1] AS base_to FROM (SELECT bases, unnest(range(1, len(bases))) AS i FROM (
  SELECT list_filter([c1, c2, c3, c4, c5], lambda x: x IS NOT NULL) AS bases FROM chains c0 {_CHAIN}))),
ed AS (
  SELECT {_id('org', 'org')} AS source, {_id('model', 'model_id')} AS target, 'owns' AS type, 1.0::DOUBLE AS weight FROM chains
  UNION SELECT {_id('model', 'model_id')}, {_id('dataset', 'd')}, 'trained_on', max(confidence) FROM trn GROUP BY 1, 2
  UNION SELECT {_id('model', 'model_id')}, {_id('model', 'base_model')}, 'finetuned_from', 0.99 FROM chains WHERE base_model IS NOT NULL
  UNION SELECT {_id('model', 'base_from')}, {_id('model', 'base_to')}, 'finetuned_from', 0.95 FROM stp
  UNION SELECT {_id('model', 'model_id')}, {_id('dataset', "'undocumented'")}, 'undocumented_source', 0.5 FROM chains WHERE len(datasets) = 0
  UNION SELECT {_id('model', 'a.model_id')}, {_id('model', 'a.base_model')}, 'inherited_opacity', 0.9 FROM chains a LEFT JOIN chains b ON a.base_model = b.model_id WHERE a.base_model IS NOT NULL AND a.score < 0.3 AND coalesce(b.score, 0) < 0.3),
chn AS (SELECT c0.model_id, list_filter([c1, c2, c3, c4, c5], lambda x: x IS NOT NULL) AS bases FROM chains c0 {_CHAIN}),
nd AS (SELECT {_id('model', 'model_id')} AS id, 'model' AS type, lower(model_id) AS label FROM chains UNION SELECT {_id('org', 'org')}, 'org', lower(org) FROM chains
  UNION SELECT {_id('dataset', 'd')}, 'dataset', lower(d) FROM (SELECT unnest(datasets) AS d FROM chains))"""
_NM = "'org' || ({0} % 7) || '/m' || ({0})"
_RG = f"""WITH {v.CHAINS},
cl AS (SELECT CASE WHEN key % 2 = 0 THEN upper({_NM.format('key')}) ELSE {_NM.format('key')} END AS t, CASE WHEN key % 5 > 0 THEN {_NM.format('(key // 2)')} END AS parent FROM chains WHERE key % 3 = 0),
rc AS (SELECT {_NM.format('key')} AS t, (key % 9)::INTEGER AS absent FROM chains WHERE key % 4 = 0),
om AS (SELECT upper(left({_NM.format('key')}, 1)) || substr({_NM.format('key')}, 2) AS t FROM chains WHERE key % 5 = 0),
sn AS (SELECT {_NM.format('key')} AS m, CASE WHEN key % 8 > 0 THEN {_NM.format('(key // 2)')} ELSE 'bare' END AS base, datasets, score FROM chains WHERE key % 2 = 0),
on_ AS (SELECT 'M-' || key AS id, 'model' AS type, upper({_NM.format('key')}) AS label FROM chains WHERE key % 6 = 0
  UNION ALL SELECT 'X-' || key, CASE WHEN key < 5 THEN 'org' WHEN key < 12 THEN 'dataset' ELSE 'shadow' END, 'ds' || key FROM chains WHERE key <= 13),
oe AS (SELECT 'M-' || key AS s, 'X-' || (key % 17) AS t, CASE WHEN key % 4 = 0 THEN 'trained_on' ELSE 'owns' END AS type FROM chains WHERE key % 6 = 0),
nm AS (SELECT t AS name, 0 AS pr FROM cl UNION ALL SELECT parent, 1 FROM cl WHERE parent IS NOT NULL UNION ALL SELECT t, 2 FROM rc UNION ALL SELECT t, 3 FROM om UNION ALL SELECT m, 4 FROM sn
  UNION ALL SELECT base, 5 FROM sn WHERE contains(base, '/') UNION ALL SELECT label, 6 FROM on_ WHERE type = 'model'),
cn AS (SELECT lower(name) AS low, name AS id FROM nm QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY pr, name) = 1),
md AS (SELECT id, low, CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE 'unknown' END AS org FROM cn),
mp AS (SELECT on_.id, CASE type WHEN 'model' THEN md.id WHEN 'org' THEN 'O-' || substr(sha256(label), 1, 12) WHEN 'dataset' THEN 'D-' || substr(sha256(label), 1, 12) ELSE on_.id END AS node FROM on_ LEFT JOIN md ON type = 'model' AND low = lower(label)),
e0 AS (SELECT a.id AS source, b.id AS target, 'finetuned_from' AS type, 0.95 AS confidence, 0 AS pl FROM cl JOIN md a ON a.low = lower(t) JOIN md b ON b.low = lower(parent)
  UNION ALL SELECT a.id, 'D-' || substr(sha256(d), 1, 12), 'trained_on', 0.9, 1 FROM (SELECT m, unnest(datasets) AS d FROM sn) JOIN md a ON a.low = lower(m)
  UNION ALL SELECT a.id, b.id, 'finetuned_from', 0.85, 1 FROM sn JOIN md a ON a.low = lower(m) JOIN md b ON b.low = lower(base) WHERE contains(base, '/')
  UNION ALL SELECT a.id, 'S-' || substr(sha256('shadow-' || a.id), 1, 12), 'undocumented_source', 0.7, 1 FROM sn JOIN md a ON a.low = lower(m) WHERE len(datasets) = 0 AND score < 0.3
  UNION ALL SELECT a.node, b.node, type, 0.8, 2 FROM oe JOIN mp a ON a.id = s JOIN mp b ON b.id = t
  UNION ALL SELECT id, 'O-' || substr(sha256(org), 1, 12), 'belongs_to', 1.0, 3 FROM md),
re AS (SELECT source, target, type, confidence::DOUBLE AS confidence FROM e0 QUALIFY row_number() OVER (PARTITION BY source, target, type ORDER BY pl) = 1),
rn AS (SELECT md.id, coalesce(absent, 0) AS absent_count, CASE WHEN rc.t IS NOT NULL THEN 'HIGH' END AS severity, rc.t IS NOT NULL AS has_report, CASE WHEN om.t IS NOT NULL THEN 'closed' END AS outreach_status,
    CASE WHEN om.t IS NOT NULL THEN 'hub' END AS outreach_platform, sn.score AS provenance_score, org, 'model' AS type, md.id AS label
  FROM md LEFT JOIN rc ON lower(rc.t) = low LEFT JOIN om ON lower(om.t) = low LEFT JOIN sn ON lower(sn.m) = low
  UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, min(type), min(label) FROM (SELECT 'O-' || substr(sha256(org), 1, 12) AS id, 'org' AS type, org AS label FROM md
    UNION ALL SELECT 'D-' || substr(sha256(d), 1, 12), 'dataset', d FROM (SELECT unnest(datasets) AS d FROM sn) UNION ALL SELECT target, 'shadow', 'Undocumented data (' || source || ')' FROM re WHERE type = 'undocumented_source'
    UNION ALL SELECT node, type, label FROM on_ JOIN mp USING (id) WHERE type <> 'model') GROUP BY 1)"""
_T = f"WITH {v.TARGETS}"

SQL = {
    "r1_compliance_index": f"""WITH {v.REPORTS}, s AS (SELECT *, part_key % 3 > 0 AS has, CASE WHEN part_key % 3 > 0 AND part_key % 5 > 0 THEN part_key % 11 ELSE 0 END AS sp, CASE WHEN part_key % 3 > 0 AND part_key % 5 > 0 THEN part_key % 6 ELSE 0 END AS sa,
          CASE WHEN part_key % 3 > 0 AND part_key % 5 > 0 THEN part_key % 3 ELSE 0 END AS st, round_even(coalesce(CASE WHEN part_key % 3 > 0 AND part_key % 7 > 0 THEN part_key % 1000 / 8.0::DOUBLE END, score, 0), 0)::BIGINT AS sc FROM reports),
        c AS (SELECT *, sp = 0 AND sa = 0 AS none FROM s),
        l AS (SELECT *, CASE WHEN has AND part_key % 4 = 0 THEN 'MODERATE' WHEN sc >= 80 THEN 'EXCELLENT' WHEN sc >= 60 THEN 'LOW' WHEN sc >= 40 THEN 'MODERATE' WHEN sc >= 20 THEN 'HIGH' ELSE 'CRITICAL' END AS label FROM c)
        SELECT model_id, sc AS score, CASE WHEN none THEN len(list_filter(observations, lambda x: x.status = 'PRESENT')) ELSE sp END AS present,
          CASE WHEN none THEN len(list_filter(observations, lambda x: x.status = 'ABSENT')) ELSE sa END AS absent, CASE WHEN none THEN len(list_filter(observations, lambda x: x.status = 'PARTIAL')) ELSE st END AS partial,
          CASE WHEN none THEN len(observations) WHEN has AND part_key % 2 > 0 THEN 18 ELSE 20 END::BIGINT AS total_elements, label,
          CASE label WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS worst, reported_on FROM l""",
    "b3_redact_reports": f"""{_R} SELECT model_id, severity, len(gaps) AS total_gaps, list_transform(gaps[1:3], lambda x: x.gap_id || '|0') AS gaps,
        list_transform(observations, lambda o: concat_ws('|', o.nec_id, 'name of ' || o.nec_id, 'text', o.status, CASE WHEN o.status = 'ABSENT' THEN 70 ELSE 0 END)) AS observations,
        list_transform(range(1, part_key % 3 + 2), lambda i: concat_ws('|', 'J' || i, 'place', 6, part_key % 4, part_key % 2, 6 - part_key % 4 - part_key % 2, part_key % 4 * 10)) AS jurisdictions FROM reports""",
    "r2_model_ranking": f"{_R} SELECT model_id, rank, score FROM rk",
    "r3_org_ranking": f"""{_R}, o AS (SELECT org, count(*) AS models, round(avg(score), 1) AS mean_score, arg_min(severity, o) AS worst, sum(downloads)::BIGINT AS downloads,
        count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low FROM rs GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY mean_score DESC, models DESC, org) AS rank FROM o""",
    "r4_ranking_stats": f"""{_R} SELECT count(*) AS n, round(avg(score), 4) AS mean, count(*) FILTER (score = 0) AS zeros, count(*) FILTER (score >= 95) AS top,
        (SELECT score FROM rk WHERE rank = (SELECT count(*) - count(*) // 2 FROM rk)) AS median FROM rk""",
    "r5_latest_reports": f"""WITH {v.REPORTS}, k AS (SELECT *, part_key % 4 = 0 AS written, row_number() OVER (PARTITION BY part_key % 4 = 0 ORDER BY reported_on DESC, model_id) AS i,
        count(*) FILTER (part_key % 4 = 0) OVER () AS w FROM reports) SELECT model_id, written, reported_on, score, '2024-02.json' AS file_name,
        CASE WHEN part_key % 3 = 0 THEN list_transform(range(1, least(part_key % 8 + 1, 5) + 1), lambda i: 'ds' || i) END AS declared, CASE WHEN part_key % 3 = 0 THEN part_key % 10 / 10 END AS provenance_score, part_key % 3 = 0 AS has_provenance
        FROM k WHERE written OR i <= greatest(0, 700 - w)""",
    "r6_report_metrics": f"""WITH {v.REPORTS}, k AS (SELECT *, len(list_filter(observations, lambda o: o.status = 'PRESENT')) AS p, len(list_filter(observations, lambda o: o.status = 'ABSENT')) AS a FROM reports)
        SELECT model_id, floor(p::DOUBLE / (p + a) * 100)::INTEGER AS completeness, CASE observations[1].status WHEN 'PRESENT' THEN 'present' WHEN 'ABSENT' THEN 'missing' ELSE 'unknown' END AS provenance,
          CASE WHEN a = 0 THEN 'complete' ELSE 'partial' END AS documentation, list_transform(list_filter(observations, lambda o: o.status = 'ABSENT'), lambda o: o.nec_id)[1:3] AS missing FROM k""",
    "r10_enrich_with_report": f"""WITH {v.REPORTS}, t AS (SELECT CASE WHEN part_key % 2 = 0 THEN model_id ELSE 'fork/m' || part_key END AS target_id, model_id FROM reports WHERE part_key % 3 = 0),
        x AS (SELECT *, list_transform(list_filter(observations, lambda o: o.status = 'ABSENT'), lambda o: o.nec_id) AS absent, list_transform(list_filter(observations, lambda o: o.status <> 'ABSENT'), lambda o: o.nec_id) AS there FROM reports)
        SELECT t.target_id, t.model_id, severity, len(gaps) AS n_gaps, len(absent) AS absent_count, absent[1:5] AS missing, CASE WHEN list_contains(there, 'NEC#1') THEN 'present' ELSE 'missing' END AS provenance,
          CASE WHEN list_has_any(there, ['NEC#3', 'NEC#4']) THEN 'partial' ELSE 'minimal' END AS documentation, round_even(100.0 * len(there) / len(observations), 0)::BIGINT AS completeness, true AS has_report FROM t JOIN x USING (model_id)""",
    "r11_drift_after_outreach": f"""{_D}, fa AS (SELECT 'org' || (part_key % 5) || '/m' || part_key AS target_id, severity, len(list_filter(observations, lambda o: o.status = 'ABSENT')) AS absent FROM ({_REPORTS_ONLY}) WHERE part_key % 3 > 0),
        mc AS (SELECT target_id, observed_at, list_filter([CASE WHEN lds <> declared_datasets THEN 'declared_datasets' END, CASE WHEN lts <> has_training_section THEN 'has_training_section' END], lambda x: x IS NOT NULL) AS changes FROM ch)
        SELECT af.*, changes, coalesce(severity, '') AS severity, coalesce(absent, 0) AS absent_count, fa.target_id IS NOT NULL AS has_report FROM af JOIN mc USING (target_id, observed_at) LEFT JOIN fa USING (target_id)""",
    "r13_verified_findings": f"""{_D} SELECT observed_at::DATE AS day, count(DISTINCT split_part(target_id, '/', 1)) AS orgs, count(*) AS changes, min(hours_after) AS min_hours,
        CASE WHEN min(hours_after) >= 72 THEN 'high' WHEN min(hours_after) >= 24 THEN 'medium' ELSE 'low' END AS confidence FROM af GROUP BY 1""",
    "r14_warranty_packs": f"{_P} SELECT * FROM pk",
    "r14_warranty_claims": f"""WITH {v.REPORTS}, x AS (SELECT *, len(list_filter(observations, lambda o: o.status = 'PRESENT')) AS p, len(list_filter(observations, lambda o: o.status = 'ABSENT')) AS a FROM reports),
        c AS (SELECT model_id, 'documentation_observation' AS claim, 'cryptographic_observation' AS tier, 'HIGH' AS confidence, ['proof_id=' || sha256(model_id), CASE WHEN part_key % 4 = 0 THEN 'anchor=' || sha256(part_key::VARCHAR) END,
            'observed_at=' || reported_on, 'completeness_pct=' || round(100.0 * p / (p + a), 1)::DOUBLE] AS s FROM x WHERE part_key % 2 = 0
          UNION ALL SELECT model_id, 'compliance_gap_map', 'structured_public_analysis', 'MEDIUM', ['score=' || score::BIGINT, 'severity=' || severity, 'gaps=' || array_to_string(list_transform(gaps, lambda g: g.gap_id)[1:3], ',')] FROM x WHERE part_key % 3 = 0
          UNION ALL SELECT model_id, 'notice_trail', 'documentary_notice', 'MEDIUM', ['platform=hub', 'status=closed', 'days_pending=' || (part_key % 30)] FROM x WHERE part_key % 5 = 0
          UNION ALL SELECT model_id, 'provenance_support', 'heuristic_support', 'LOW', [CASE WHEN part_key % 2 = 0 THEN 'license=mit' END,
            'declared=' || array_to_string(list_transform(range(1, least(part_key % 8 + 1, 5) + 1), lambda i: 'ds' || i), ',')] FROM x WHERE part_key % 7 = 0)
        SELECT model_id, claim, tier, confidence, list_sort(list_filter(s, lambda y: y IS NOT NULL)) AS support FROM c""",
    "r15_warranty_index": f"{_P} SELECT state, confidence, count(*) AS models, round(avg(len(claims)), 4) AS mean_claims FROM pk GROUP BY 1, 2",
    "r16_passports": f"""{_R}, x AS (SELECT *, part_key % 10 = 0 AS c, part_key % 10 = 0 AND part_key % 7 / 8 > 0.5 AS e FROM rk)
        SELECT model_id, rank, score, severity, CASE WHEN e THEN 3 WHEN c THEN 2 ELSE 0 END AS comparisons, c AS compared, CASE WHEN e THEN 'equal' WHEN c THEN 'derived' END AS relationship,
          CASE WHEN c THEN part_key % 7 / 8 END AS confidence, CASE WHEN c THEN 'fork/m' || part_key END AS primary_match, CASE WHEN e THEN sha256('equal' || part_key) WHEN c THEN sha256('derived' || part_key) END AS evidence_hash FROM x""",
    "g1_lineage_edges": f"{_G} SELECT * FROM ed",
    "g1_lineage_nodes": f"{_G} SELECT * FROM nd",
    "g2_merge_graph": f"{_G} SELECT DISTINCT source, target, type, CASE WHEN type = 'owns' THEN 1.0 ELSE 0.1 END::DOUBLE AS weight, CASE WHEN type = 'owns' THEN 0 ELSE 1 END AS from_source FROM ed",
    "g2_resolved_nodes": f"{_RG} SELECT * FROM rn",
    "g2_resolved_edges": f"{_RG} SELECT source, target, type, confidence FROM re",
    "g3_graph_counts": f"{_G} SELECT 'node' AS what, type, count(*) AS n FROM nd GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM ed GROUP BY 2",
    "g4_shared_datasets": f"{_G} SELECT d AS dataset, count(DISTINCT org) AS orgs, count(DISTINCT model_id) AS models FROM (SELECT org, model_id, unnest(datasets) AS d FROM chains) GROUP BY 1 HAVING count(DISTINCT org) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20",
    "g5_opacity_cascades": f"{_G} SELECT a.base_model, b.score AS base_score, count(*) AS models, count(DISTINCT a.org) AS orgs FROM chains a JOIN chains b ON a.base_model = b.model_id WHERE b.score < 0.4 GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20",
    "g6_score_distribution": f"{_G} SELECT least(floor(score / 0.2::DOUBLE + 1e-9), 4)::INTEGER AS bucket, count(*) AS models, round(avg(score), 6) AS mean_score FROM chains GROUP BY 1",
    "b4_redact_graph": f"{_G} SELECT model_id, org, CASE WHEN score >= 0.7 THEN 'transparent' WHEN score >= 0.4 THEN 'partial' WHEN score > 0 THEN 'opaque' END AS transparency FROM chains",
    "n10_inherited_signals": f"{_G} SELECT model_id, signal, value, round(confidence, 6)::DOUBLE AS confidence, source FROM inh",
    "n11_provenance_score": f"{_G} SELECT model_id, base_model, license, declared, inferred, has_training, provenance_score FROM prv",
    "n12_ancestors": f"""WITH RECURSIVE {v.CHAINS}, an(model_id, ancestor, distance, path) AS (
        SELECT model_id, base_model, 1, [model_id, base_model] FROM chains WHERE base_model IS NOT NULL AND base_model <> model_id
        UNION ALL SELECT an.model_id, base_model, distance + 1, list_append(path, base_model) FROM an JOIN chains c ON c.model_id = ancestor WHERE base_model IS NOT NULL AND NOT list_contains(path, base_model))
        SELECT model_id, ancestor, distance FROM an""",
    "n12_base_chain": f"{_G} SELECT model_id, bases FROM chn",
    "n13_best_and_worst": f"""{_G} SELECT 'best' AS "end", model_id, score FROM (SELECT * FROM chains ORDER BY score DESC, model_id LIMIT 10)
        UNION ALL SELECT 'worst', model_id, score FROM (SELECT * FROM chains ORDER BY score, model_id LIMIT 10)""",
    "g3_graph_rates": f"""{_G} SELECT count(*) AS models, count(*) FILTER (len(datasets) = 0) AS undocumented, round(100.0 * count(*) FILTER (len(datasets) = 0) / count(*), 1) AS undocumented_rate,
        count(base_model) AS with_base, round(100 * avg(score), 1) AS mean_score FROM chains""",
    "g5_most_depended": f"{_G} SELECT base_model, count(*) AS dependents FROM (SELECT unnest(bases) AS base_model FROM chn) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "g6_org_means": f"""{_G} SELECT org, round(avg(CASE WHEN key % 7 > 0 THEN 100 * score ELSE 0 END), 1) AS mean_compliance, round(sum(round(provenance_score * 1000000)::BIGINT) FILTER (provenance_score > 0) / (10000 * count(*) FILTER (provenance_score > 0)), 1)::DOUBLE AS mean_provenance, count(*) AS models,
        count(*) FILTER (provenance_score > 0) AS with_provenance FROM prv GROUP BY 1""",
    "n13_scan_summary": f"""{_G} SELECT count(*) AS models, count(*) FILTER (has_training) AS with_training, count(*) FILTER (len(datasets) > 0) AS with_datasets, count(base_model) AS with_base,
        count(license) AS with_license, round(avg(score), 6) AS mean_score FROM chains""",
    "b6_select_targets": f"{_T} SELECT target_id, max(downloads) AS downloads FROM targets WHERE downloads >= 1000 AND NOT private GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "b7_normalize_target_id": f"{_T} SELECT target_id, source, lower(target_id) AS id, CASE WHEN downloads % 5 = 0 THEN 'unknown' ELSE lower(split_part(target_id, '/', 1)) END AS org FROM targets",
    "m1_merge_targets": f"""{_T} SELECT lower(target_id) AS id, type, source, downloads, private FROM targets QUALIFY row_number() OVER (PARTITION BY lower(target_id), type
        ORDER BY CASE source WHEN 'registry' THEN 0 WHEN 'models' THEN 1 ELSE 2 END, downloads DESC) = 1""",
    "m2_new_targets": f"{_T} SELECT DISTINCT lower(target_id) AS id FROM targets WHERE source <> 'registry' AND lower(target_id) NOT IN (SELECT lower(target_id) FROM targets WHERE source = 'registry')",
    "m3_one_per_org": f"""{_T} SELECT split_part(target_id, '/', 1) AS org, target_id, downloads FROM targets WHERE downloads >= 100 AND contains(target_id, '/') AND split_part(target_id, '/', 1) <> 'org3'
        QUALIFY row_number() OVER (PARTITION BY split_part(target_id, '/', 1) ORDER BY downloads DESC, target_id) = 1 ORDER BY downloads DESC, org LIMIT 25""",
    "m3_allowed_orgs": f"""{_T} SELECT split_part(target_id, '/', 1) AS org, target_id, downloads FROM targets WHERE downloads >= 100 AND contains(target_id, '/') AND split_part(target_id, '/', 1) <> 'org3'
          AND split_part(target_id, '/', 1) IN (SELECT split_part(target_id, '/', 1) FROM targets WHERE downloads % 2 = 0)
        QUALIFY row_number() OVER (PARTITION BY split_part(target_id, '/', 1) ORDER BY downloads DESC, target_id) = 1 ORDER BY downloads DESC, org LIMIT 25""",
    "m4_search_targets": f"{_T}, h AS (SELECT DISTINCT lower(target_id) AS id FROM targets WHERE downloads % 2 = 0) SELECT type, h.id IS NOT NULL AS has_report, count(*) AS targets FROM targets LEFT JOIN h ON lower(target_id) = h.id GROUP BY 1, 2",
}
