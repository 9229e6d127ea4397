"""Compliance registry joins, rankings and outreach analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_rank

SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}  # worst first
#: Labels of compliance scores, worst first.
LABELS = {"CRITICAL": 0, "HIGH": 1, "MODERATE": 2, "LOW": 3, "EXCELLENT": 4}


def _order_column(column: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for name, place in order.items():
        out = F.when(column == name, place).otherwise(out)
    return out


def _order(column: str, order: dict[str, int]) -> Column:
    return _order_column(F.col(column), order)


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "EXCELLENT").when(score >= 60, "LOW").when(score >= 40, "MODERATE").when(score >= 20, "HIGH").otherwise("CRITICAL")
    )


def compliance_index(reports: DataFrame, elements: int = 20) -> DataFrame:
    """Score, counts and label per report, from its ``summary``, else from its own score and its observations.

    ``summary`` may be null, and so may its fields ``score, label, present, absent, partial, total``. Counts come from the
    observations where the summary has neither present nor absent ones; a label that is missing comes from the score.
    ``worst`` orders the index at the sink: worst label first, then by model.
    """
    count = lambda s: F.coalesce(F.size(F.filter("observations", lambda o: F.lower(o["status"]) == s)), F.lit(0))
    of = lambda c, other: F.coalesce(F.col(f"summary.{c}"), F.lit(other))
    score = F.bround(F.coalesce("summary.score", "score", F.lit(0.0)), 0).cast("long")
    rows = reports.withColumns({"__score": score, "__none": (of("present", 0) == 0) & (of("absent", 0) == 0)})
    counted = lambda c: F.when(F.col("__none"), count(c)).otherwise(of(c, 0)).cast("long").alias(c)
    observed = F.coalesce(F.size("observations"), F.lit(0))
    total = F.when(F.col("__none"), F.when(observed > 0, observed).otherwise(elements)).otherwise(of("total", elements))
    label = F.when(F.length("summary.label") > 0, F.col("summary.label")).otherwise(score_label(F.col("__score")))
    return rows.select("model_id", F.col("__score").alias("score"), *[counted(c) for c in ("present", "absent", "partial")], total.cast("long").alias("total_elements"),
                       label.alias("label"), _order_column(label, LABELS).alias("worst"), "reported_on")


#: Fields of a report's parts that its public view keeps.
PUBLIC = {
    "observations": ("nec_id", "name", "description", "status", "severity"),
    "jurisdictions": ("code", "name", "total_elements", "present", "absent", "partial", "score_pct"),
    "gaps": ("gap_id", "severity"),
}


def redact_reports(reports: DataFrame, keep: int = 3) -> DataFrame:
    """Public view: observations and jurisdictions without their evidence, the first gaps without their articles, and the
    number of all gaps. Parts that a table does not have are left out."""
    empty = F.expr("cast(array() as array<string>)")
    narrow = lambda c: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in PUBLIC[c]]))
    public = F.transform(F.slice("gaps", 1, keep), lambda g: F.struct(*[g[f].alias(f) for f in PUBLIC["gaps"]], empty.alias("articles")))
    parts = [narrow(c).alias(c) for c in ("observations", "jurisdictions") if c in reports.columns]
    return reports.select("model_id", "severity", *parts, public.alias("gaps"), F.size("gaps").alias("total_gaps"))


def model_ranking(reports: DataFrame) -> DataFrame:
    """Rank by score, severity (worst last), downloads, then model."""
    rows = reports.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return global_rank(rows, "score", [_order("severity", SEVERITY).desc(), F.desc("downloads"), F.col("model_id")])


def org_ranking(reports: DataFrame) -> DataFrame:
    """Models, mean score, worst severity and downloads per organisation, ranked by mean score."""
    order = _order("severity", SEVERITY)
    rows = reports.groupBy("org").agg(
        F.count(F.lit(1)).alias("models"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 1).alias("mean_score"), F.min_by("severity", order).alias("worst"),
        F.sum("downloads").alias("downloads"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY],
    )
    return global_rank(rows, "mean_score", [F.desc("models"), F.col("org")])


def ranking_stats(ranked: DataFrame) -> DataFrame:
    """Mean, upper median (row n // 2 from the lowest), zeros and near-perfect scores."""
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.count_if(F.col("score") == 0).alias("zeros"), F.count_if(F.col("score") >= 95).alias("top"))
    middle = ranked.crossJoin(F.broadcast(sums.select("n"))).where(F.col("rank") == F.col("n") - F.floor(F.col("n") / 2)).select(F.col("score").alias("median"))
    return sums.crossJoin(middle)  # one row each


def latest_reports(reports: DataFrame, outreach: DataFrame, maximum: int, provenance: DataFrame | None = None) -> DataFrame:
    """The newest report of each model (last by ``file_name``): all of models that were written to, filled up to ``maximum`` with
    the most recent of the others.

    ``provenance(model_id, base_model, license, has_training, declared, provenance_score)`` adds its fields, of the declared
    datasets the first five.
    """
    kept = [c for c in reports.columns if c != "model_id"]
    # a column each, so that a reader of few columns does not sort whole reports; all of them take the same row
    newest = reports.groupBy("model_id").agg(*[F.max_by(c, "file_name").alias(c) for c in kept])
    flagged = newest.join(outreach.select("model_id").distinct().withColumn("written", F.lit(True)), "model_id", "left")
    flagged = flagged.withColumn("written", F.coalesce("written", F.lit(False)))
    first = flagged.where("written")
    room = max(0, maximum - first.count())
    rest = flagged.where(~F.col("written")).orderBy(F.desc("reported_on"), "model_id").limit(room)
    chosen = first.unionByName(rest)
    if provenance is None:
        return chosen
    found = provenance.withColumn("declared", F.slice("declared", 1, 5)).withColumn("has_provenance", F.lit(True))
    return chosen.join(found, "model_id", "left").withColumn("has_provenance", F.coalesce("has_provenance", F.lit(False)))


def report_metrics(reports: DataFrame) -> DataFrame:
    """Completeness (present of present and absent elements, in whole percent), provenance by the first NEC#1, documentation, and
    the first three absent elements."""
    names = lambda s: F.coalesce(F.transform(F.filter("observations", lambda o: o["status"] == s), lambda o: o["nec_id"]), F.expr("cast(array() as array<string>)"))
    present, absent = F.size(names("PRESENT")), F.size(names("ABSENT"))
    total = present + absent
    first = F.get(F.filter("observations", lambda o: o["nec_id"] == "NEC#1"), 0)["status"]
    return reports.select(
        "model_id", F.when(total > 0, F.floor(present / total * 100)).otherwise(0).cast("int").alias("completeness"),
        F.when(first == "PRESENT", "present").when(first == "ABSENT", "missing").otherwise("unknown").alias("provenance"),
        F.when((total > 0) & (absent == 0), "complete").when(total > 0, "partial").otherwise("unknown").alias("documentation"), F.slice(names("ABSENT"), 1, 3).alias("missing"),
    )



def enrich_with_report(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """Report by exact id (lower case, no ``gh:``), else by the last part of the path (smallest id of those that share it), and what a
    status record takes from it: absent elements and the first five, provenance, documentation, completeness."""
    plain = lambda c: F.regexp_replace(F.lower(c), "^gh:", "")
    base = lambda c: F.element_at(F.split(F.lower(c), "/"), -1)
    exact = reports.groupBy(F.lower("model_id").alias("id")).agg(F.min("model_id").alias("by_id"))
    short = reports.groupBy(base("model_id").alias("base")).agg(F.min("model_id").alias("by_base"))
    rows = targets.withColumns({"id": plain("target_id"), "base": F.when(F.col("target_id").contains("/"), base("target_id"))})
    rows = rows.join(exact, "id", "left").join(short, "base", "left")
    chosen = rows.select("target_id", F.coalesce("by_id", "by_base").alias("model_id"))
    names = lambda keep: F.transform(F.filter("observations", keep), lambda o: o["nec_id"])
    absent, there = names(lambda o: o["status"] == "ABSENT"), names(lambda o: o["status"] != "ABSENT")
    facts = reports.select(
        "model_id", "severity", F.size("gaps").alias("n_gaps"), F.size(absent).alias("absent_count"), F.slice(absent, 1, 5).alias("missing"),
        F.when(F.array_contains(there, "NEC#1"), "present").otherwise("missing").alias("provenance"),
        F.when(F.arrays_overlap(there, F.array(F.lit("NEC#3"), F.lit("NEC#4"))), "partial").otherwise("minimal").alias("documentation"),
        F.bround(100.0 * F.size(there) / F.greatest(F.size("observations"), F.lit(1)), 0).cast("long").alias("completeness"), F.lit(True).alias("has_report"),
    )
    return chosen.join(facts, "model_id", "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


#: Fields whose change can be an answer to a message: licences are often found automatically.
MEANINGFUL = ("declared_datasets", "has_training_section")


def drift_after_outreach(messages: DataFrame, drift: DataFrame, hours: int = 24, days: int = 30, facts: DataFrame | None = None) -> DataFrame:
    """Meaningful changes of a target (``changed``) from ``hours`` to ``days`` after each message of ``messages(message_id, target_id, sent_at)``.

    Times are cut into buckets of ``days``; a message's interval touches two at most, a change lies in one. Targets meet by bucket, so
    that one with very many messages and changes over the years is not one task's pairs. ``facts`` adds its report.
    """
    width = days * 86400
    meaning = F.array_intersect("changed", F.array(*[F.lit(c) for c in MEANINGFUL]))
    later = drift.select("target_id", "observed_at", meaning.alias("changes"), F.floor(F.unix_timestamp("observed_at") / width).alias("bucket")).where(F.size("changes") > 0)
    wait = lambda n, unit: F.col("sent_at") + F.expr(f"INTERVAL {n} {unit}")
    bucket = lambda t: F.floor(F.unix_timestamp(t) / width)
    sent = messages.where("sent_at is not null").select("message_id", "target_id", "sent_at", F.explode(F.sequence(bucket(wait(hours, "HOURS")), bucket(wait(days, "DAYS")))).alias("bucket"))
    pairs = sent.join(later, ["target_id", "bucket"]).where(F.col("observed_at").between(wait(hours, "HOURS"), wait(days, "DAYS")))
    waited = F.floor((F.unix_timestamp("observed_at") - F.unix_timestamp("sent_at")) / 3600)
    rows = pairs.select("message_id", "target_id", "observed_at", waited.alias("hours_after"), "changes")
    if facts is None:
        return rows.drop("changes")
    facts = facts.select(F.col("model_id").alias("target_id"), F.col("highest_severity").alias("severity"), "absent_count", F.lit(True).alias("has_report"))
    return rows.join(facts, "target_id", "left").withColumns({
        "severity": F.coalesce("severity", F.lit("")), "absent_count": F.coalesce("absent_count", F.lit(0)), "has_report": F.coalesce("has_report", F.lit(False)),
    })


def verified_findings(after: DataFrame) -> DataFrame:
    """By day of change: organisations, changes, and confidence by the shortest wait."""
    rows = after.groupBy(F.to_date("observed_at").alias("day")).agg(
        F.count_distinct(F.split("target_id", "/")[0]).alias("orgs"), F.count(F.lit(1)).alias("changes"), F.min("hours_after").alias("min_hours")
    )
    return rows.withColumn("confidence", F.when(F.col("min_hours") >= 72, "high").when(F.col("min_hours") >= 24, "medium").otherwise("low"))


#: The claim that each source of evidence supports.
CLAIMS = {"proof": "documentation_observation", "compliance": "compliance_gap_map", "notice": "notice_trail", "provenance": "provenance_support"}


def warranty_packs(proofs: DataFrame, compliance: DataFrame, notices: DataFrame, provenance: DataFrame) -> DataFrame:
    """Evidence of four sources per model: claims they support, what the pack excludes, its state, and scores.

    ``proofs(model_id, present, absent)``, ``compliance(model_id, score, severity)``, ``notices(model_id, status, platform)``,
    ``provenance(model_id, provenance_score)``, each with one row a model. Any of the sources makes a pack.
    """
    sources = dict(zip(CLAIMS, (proofs, compliance, notices, provenance), strict=True))
    rows = None
    for name, df in sources.items():
        df = df.withColumn(f"has_{name}", F.lit(True))
        rows = df if rows is None else rows.join(df, "model_id", "full_outer")
    has = {name: F.coalesce(f"has_{name}", F.lit(False)) for name in sources}
    state = F.when(has["proof"] & has["compliance"] & has["notice"], "WARRANTY_PREP_READY").when(has["proof"] & has["compliance"], "EVIDENCE_PACK_READY")
    state = state.when(has["proof"] | has["compliance"] | has["notice"], "PARTIAL_RAIL").otherwise("INSUFFICIENT_EVIDENCE")
    confidence = F.when(has["proof"] & has["compliance"], "HIGH").when(has["proof"] | has["compliance"] | has["notice"], "MEDIUM").otherwise("LOW")
    seen = F.col("present") + F.col("absent")
    return rows.select(
        "model_id", F.split("model_id", "/")[0].alias("organization"), state.alias("state"), confidence.alias("confidence"),
        F.array_compact(F.array(*[F.when(has[n], F.lit(claim)) for n, claim in CLAIMS.items()])).alias("claims"),
        F.array_compact(F.array(*[F.when(~has[n], F.lit(f"no_{n}")) for n in ("proof", "compliance", "provenance")])).alias("exclusions"),
        F.when(seen > 0, F.round(100 * F.col("present") / seen, 1)).alias("completeness_pct"), F.col("score").alias("compliance_score"), "severity",
        "provenance_score", "status", "platform",
    )


#: Tier and confidence of each claim, and the fields of its source that support it; lists are cut.
TIERS = {"proof": ("cryptographic_observation", "HIGH"), "compliance": ("structured_public_analysis", "MEDIUM"), "notice": ("documentary_notice", "MEDIUM"), "provenance": ("heuristic_support", "LOW")}
SUPPORT = {
    "proof": ("proof_id", "root", "anchor", "observed_at"),
    "compliance": ("score", "severity", "gaps"),
    "notice": ("platform", "status", "offer_date", "days_pending", "discussion_url"),
    "provenance": ("provenance_score", "license", "base_model", "declared", "inferred"),
}
FIRST = {"gaps": 3, "declared": 5, "inferred": 5}


def warranty_claims(proofs: DataFrame, compliance: DataFrame, notices: DataFrame, provenance: DataFrame) -> DataFrame:
    """``model_id, claim, tier, confidence, support``: a row for each claim of a pack, with the fields of its source by name.

    Fields that a source does not have, or that are null, are left out; a proof has its completeness in percent as well.
    """
    out = []
    for name, df in zip(CLAIMS, (proofs, compliance, notices, provenance), strict=True):
        kinds = dict(df.dtypes)
        text = lambda c: F.concat_ws(",", F.slice(c, 1, FIRST[c])) if kinds[c].startswith("array") else F.col(c).cast("string")  # noqa: B023, E731
        fields = [(c, text(c)) for c in SUPPORT[name] if c in kinds]
        if name == "proof":
            seen = F.col("present") + F.col("absent")
            fields.append(("completeness_pct", F.when(seen > 0, F.round(100 * F.col("present") / seen, 1)).cast("string")))
        entries = F.array(*[F.struct(F.lit(c).alias("k"), v.alias("v")) for c, v in fields])
        support = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
        tier, confidence = TIERS[name]
        out.append(df.select("model_id", F.lit(CLAIMS[name]).alias("claim"), F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"), support.alias("support")))
    return reduce(DataFrame.unionByName, out)


def warranty_index(packs: DataFrame) -> DataFrame:
    """Packs by state and confidence, with their mean number of claims."""
    return packs.groupBy("state", "confidence").agg(F.count(F.lit(1)).alias("models"), F.round(F.avg(F.size("claims")), 4).alias("mean_claims"))


def passports(reports: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Rank and report of every model, and the evidence of its comparisons with other models.

    ``comparisons(run, left_id, right_id, relationship, confidence, comparison_hash)`` count for both their members; the first of the
    runs (then by its hash) gives relationship, match and evidence.
    """
    fields = ("relationship", "confidence", "comparison_hash")
    sides = F.array(*[F.struct(F.col(a).alias("model_id"), F.col(b).alias("match")) for a, b in (("left_id", "right_id"), ("right_id", "left_id"))])
    members = comparisons.withColumn("side", F.explode(F.array_distinct(sides))).select("side.*", "run", *fields)
    found = members.groupBy("model_id").agg(F.count(F.lit(1)).alias("comparisons"), F.min_by(F.struct("relationship", "confidence", "match", "comparison_hash"), F.struct("run", "comparison_hash", "match")).alias("c"))
    rows = model_ranking(reports).join(found, "model_id", "left")
    return rows.select("model_id", "rank", "score", "severity", F.coalesce("comparisons", F.lit(0)).alias("comparisons"), F.col("c").isNotNull().alias("compared"), "c.relationship", "c.confidence",
                       F.col("c.match").alias("primary_match"), F.col("c.comparison_hash").alias("evidence_hash"))