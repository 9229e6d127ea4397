"""Outreach to targets: states of messages, answers, timelines and cool-downs.

A log has one row per message: ``record_no`` (order of the log), ``platform`` (huggingface or github), ``repo_id, target_id, status,
response_type, sent_at, number`` (of the discussion), ``completeness_score, discussion_url, public_note, event_type``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import report_metrics

# Statuses that a log row may have, the state that a status or else an answer stands for, and the rank of states.
VALID = ("sent", "acknowledged", "merged", "accepted", "closed", "replied", "not_planned", "blocked", "access_restricted", "restricted")
STATE_OF_STATUS = {
    "access_restricted": "access_restricted", "blocked": "access_restricted", "restricted": "access_restricted",
    "acknowledged": "acknowledged", "merged": "acknowledged", "accepted": "acknowledged", "replied": "acknowledged",
    "closed": "closed", "not_planned": "closed",
}
STATE_OF_RESPONSE = {
    "access_restricted": "access_restricted", "blocked": "access_restricted", "restricted": "access_restricted",
    "merged": "acknowledged", "acknowledged": "acknowledged", "accepted": "acknowledged",
    "closed": "closed", "not_planned": "closed",
}
RANK = {"access_restricted": 4, "acknowledged": 3, "closed": 2, "pending": 1}

#: Statuses of messages whose discussion is followed, and the log status that (state, response) of a discussion gives.
TRACKED = ("sent", "acknowledged", "closed", "merged", "accepted")
SYNCED = {
    ("accepted", "merged"): "acknowledged",
    ("accepted", "acknowledged"): "acknowledged",
    ("pending", "acknowledged"): "acknowledged",
    ("declined", "closed"): "closed",
}
#: Statuses of messages that later changes are set against, and statuses that a merge prefers.
SENT = ("sent", "acknowledged", "merged", "accepted")
RICH = ("closed", "acknowledged", "access_restricted", "replied")

#: Fields of a record that a manual override may set.
OVERRIDABLE = ("status", "response_type", "sent_at", "completeness_score", "discussion_url", "public_note", "event_type")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def message_state(status: Column, response: Column) -> Column:
    """State of a message by its own status, else by the answer to it, else pending."""
    return F.coalesce(_looked_up(STATE_OF_STATUS, status), _looked_up(STATE_OF_RESPONSE, response), F.lit("pending"))


def organisation(target: Column) -> Column:
    return F.split(target, "/")[0]


def days_since(sent_at: Column, now: str) -> Column:
    """Whole days from ``sent_at`` to ``now``, 0 where there is no time or it lies ahead."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(sent_at)
    return F.greatest(F.lit(0), F.coalesce(F.floor(seconds / 86400), F.lit(0))).cast("long")


def report_facts(reports: DataFrame) -> DataFrame:
    """``model_id`` and what a status record takes from its report."""
    count = lambda s: F.size(F.filter("observations", lambda o: o["status"] == s))
    facts = reports.select("model_id", F.col("severity").alias("highest_severity"), count("ABSENT").alias("absent_count"), F.col("reported_on").cast("string").alias("observed_at"))
    return report_metrics(reports).join(facts, "model_id")


def outreach_records(log: DataFrame, overrides: DataFrame, links: DataFrame, facts: DataFrame, compliance: DataFrame, now: str) -> DataFrame:
    """Every valid message as a status record.

    ``overrides(key, line_no, ...)`` may have any of the fields ``OVERRIDABLE``; the last line of a key counts, its fields replace
    those of the record before the state is decided. ``links(target_id, model_id)`` leads from a repository of github to a
    model. ``compliance(model_id, score)`` is looked up first, then the report of ``facts``, then the record's own score, then 0;
    a compliance score that is there but null counts as 0. A message without any target belongs to ``unknown``.
    """
    rows = log.where(F.col("status").isin(*VALID)).withColumn("target_id", F.coalesce("repo_id", "target_id", F.lit("unknown")))
    fields = [c for c in OVERRIDABLE if c in overrides.columns]
    last = overrides.where("key is not null").groupBy(F.col("key").alias("target_id")).agg(F.max_by(F.struct(*fields), "line_no").alias("o"))
    rows = rows.join(last, "target_id", "left").withColumns({c: F.coalesce(F.col(f"o.{c}"), F.col(c)) for c in fields}).drop("o")
    linked = links.select("target_id", F.col("model_id").alias("linked")).dropDuplicates(["target_id"])
    rows = rows.join(linked, "target_id", "left").withColumn("linked", F.when((F.col("platform") == "github") & (F.col("linked") != F.col("target_id")), F.col("linked")))
    rows = rows.withColumn("model_id", F.coalesce("linked", "target_id"))
    rows = rows.join(facts, "model_id", "left").join(compliance.select("model_id", "score", F.lit(True).alias("scored")), "model_id", "left")
    score = F.when(F.col("scored"), F.coalesce("score", F.lit(0.0))).otherwise(F.coalesce(F.col("completeness").cast("double"), F.col("completeness_score").cast("double"), F.lit(0.0)))
    text = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    return rows.select(
        "target_id", "platform", "record_no", "sent_at", message_state(F.col("status"), F.col("response_type")).alias("status"), score.alias("completeness_score"),
        F.coalesce(F.date_format("sent_at", "yyyy-MM-dd"), F.lit("")).alias("offer_date"), days_since(F.col("sent_at"), now).alias("days_pending"),
        F.coalesce("discussion_url", F.when((F.col("platform") == "github") & (F.col("number") > 0), F.concat(F.lit("https://github.com/"), "repo_id", F.lit("/issues/"), F.col("number").cast("string"))).when(
            F.col("number") > 0, F.concat(F.lit("https://huggingface.co/"), "repo_id", F.lit("/discussions/"), F.col("number").cast("string")))).alias("discussion_url"),
        F.col("completeness").isNotNull().alias("has_report"), F.col("linked").alias("linked_model_id"), text("provenance", "unknown"), text("documentation", "unknown"),
        F.coalesce("missing", F.expr("cast(array() as array<string>)")).alias("missing"), "highest_severity", "absent_count", text("observed_at", ""), text("public_note", ""), text("event_type", ""),
    )


def outreach_status(records: DataFrame) -> DataFrame:
    """The best record of each target: highest state, then newest, then the first of the logs (huggingface before github)."""
    first = F.struct((F.col("platform") == "huggingface").alias("a"), (-F.col("record_no")).alias("b"))
    rank = _looked_up({k: str(v) for k, v in RANK.items()}, F.col("status")).cast("int")
    order = F.struct(rank.alias("rank"), F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(0)).alias("at"), first.alias("first"))
    kept = [c for c in records.columns if c != "target_id"]
    best = records.groupBy("target_id").agg(F.max_by(F.struct(*kept), order).alias("r"), F.count(F.lit(1)).alias("messages"))
    return best.select("target_id", *[f"r.{c}" for c in kept if c not in ("record_no", "sent_at")], "messages")


def longest_pending(status: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` targets that have waited longest, of those the most complete."""
    return status.orderBy(F.desc("days_pending"), F.desc("completeness_score"), "target_id").limit(n)


def outreach_stats(status: DataFrame) -> DataFrame:
    """Targets, means and states, in total (platform null) and by platform."""
    state = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.rollup("platform").agg(
        F.count(F.lit(1)).alias("total_offered"), *[state(s) for s in RANK], F.round(F.avg("days_pending"), 1).alias("avg_days_pending"),
        F.round(F.avg("completeness_score"), 1).alias("avg_completeness"), F.count_if("has_report").alias("with_report"), F.sum("messages").alias("messages"),
        F.grouping("platform").cast("int").alias("is_total"),
    )


def answered(log: DataFrame, answers: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Discussions that are followed, with their state: accepted, declined, pending, or no_response after ``days``.

    One row per repository and discussion number (the last message of the log). ``answers(repo_id, number, discussion, events)``: a
    merged discussion is accepted, a closed one declined, an open one with more than its first event acknowledged.
    """
    rows = log.where(F.col("status").isin(*TRACKED) & (F.col("number") > 0)).withColumn("repo_id", F.coalesce("repo_id", "target_id", F.lit("")))
    rows = rows.groupBy("repo_id", "number").agg(F.max_by("sent_at", "record_no").alias("sent_at"))
    got = answers.groupBy("repo_id", "number").agg(F.max_by(F.struct("discussion", "events"), "events").alias("a"))
    rows = rows.join(got, ["repo_id", "number"], "left")
    discussion = F.col("a.discussion")
    response = F.when(discussion == "merged", "merged").when(discussion == "closed", "closed").when(discussion.isNotNull() & (F.col("a.events") > 1), "acknowledged").otherwise("none")
    rows = rows.select("repo_id", "number", "sent_at", response.alias("response_type"), days_since(F.col("sent_at"), now).alias("days_since_sent"))
    late = (F.col("response_type") == "none") & (F.col("days_since_sent") > days)
    state = F.when(F.col("response_type") == "merged", "accepted").when(F.col("response_type") == "closed", "declined").when(late, "no_response").otherwise("pending")
    return rows.withColumn("status", state)


def _state_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "declined", "pending", "no_response")]


def response_rates(followed: DataFrame) -> DataFrame:
    """Totals, acceptance (of what was answered) and response in percent, 0 where nothing was answered or sent."""
    rows = followed.agg(F.count(F.lit(1)).alias("total_sent"), *_state_counts())
    replied = F.col("accepted") + F.col("declined")
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a * 100.0, b), 1), F.lit(0.0))
    return rows.withColumns({"acceptance_rate_pct": rate(F.col("accepted"), replied), "response_rate_pct": rate(replied, F.col("total_sent"))})


def response_by_org(followed: DataFrame) -> DataFrame:
    """Followed discussions by organisation; a repository without one belongs to ``unknown``."""
    org = F.when(F.col("repo_id").contains("/"), organisation(F.col("repo_id"))).otherwise("unknown")
    return followed.groupBy(org.alias("org")).agg(F.count(F.lit(1)).alias("sent"), *_state_counts()[:2])


def top_acceptors(by_org: DataFrame, n: int = 10) -> DataFrame:
    """The organisations that accepted most."""
    return by_org.where("accepted > 0").orderBy(F.desc("accepted"), "org").limit(n).select("org", "accepted")


def sync_status(log: DataFrame, followed: DataFrame) -> DataFrame:
    """Log rows with the status that their discussion gives; rows without number, discussion or rule keep theirs (sent if null)."""
    keys = ["__repo", "number"]
    got = followed.select(F.col("repo_id").alias("__repo"), "number", F.concat_ws("/", "status", "response_type").alias("__pair"))
    rows = log.withColumn("__repo", F.coalesce("repo_id", "target_id", F.lit(""))).join(got, keys, "left")
    new = _looked_up({"/".join(k): v for k, v in SYNCED.items()}, F.col("__pair"))
    status = F.coalesce(new, F.when(F.col("__pair").isNotNull(), F.coalesce("status", F.lit("sent"))), F.col("status"))
    return rows.withColumn("updated", ~status.eqNullSafe(F.col("status"))).withColumn("status", status).drop("__pair", "__repo")


def cooldown_reasons(candidates: DataFrame, log: DataFrame, now: str, days: int, scope: str = "org", by_package: bool = True) -> DataFrame:
    """Candidates ``(target_id, package)`` with ``reason``: why they are not written to now, null if they may be.

    Only messages with status sent, a repository and a time count, and only within the last ``days`` (none if that is 0 or less). In
    scope ``org`` a message to any repository of the organisation counts; in scope ``repo`` one to the repository.
    """
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {max(days, 0)} DAYS")
    recent = log.where((F.col("status") == "sent") & F.col("repo_id").isNotNull() & (F.col("sent_at") > since)).where(F.lit(days > 0))
    rows = candidates.withColumn("org", organisation(F.col("target_id")))
    found = []
    for name, reason, columns in (("org", "organisation", ["org"]), ("repo", "repository", ["target_id"]), ("package", "package", ["target_id", "package"])):
        if (name == "org" and scope != "org") or (name == "package" and not by_package):
            continue
        keys = {"org": organisation(F.col("repo_id")), "target_id": F.col("repo_id"), "package": F.col("package")}
        seen = recent.select(*[keys[c].alias(c) for c in columns], F.lit(reason).alias(f"__{name}")).distinct()
        rows = rows.join(seen, columns, "left")
        found.append(f"__{name}")
    return rows.withColumn("reason", F.coalesce(*found)).drop(*found)


def cooldown_filter(candidates: DataFrame, log: DataFrame, now: str, days: int, scope: str = "org", by_package: bool = True) -> DataFrame:
    """Candidates that may be written to."""
    return cooldown_reasons(candidates, log, now, days, scope, by_package).where("reason is null").drop("reason")


def last_messages(log: DataFrame) -> DataFrame:
    """The last sent message of each target in the order of the log; messages without target or time do not count."""
    rows = log.where(F.col("status").isin(*SENT)).withColumn("target_id", F.coalesce("repo_id", "target_id"))
    rows = rows.where("target_id is not null and sent_at is not null")
    last = rows.groupBy("target_id").agg(F.max_by(F.struct("sent_at", "discussion_url", "response_type"), "record_no").alias("m"))
    return last.select("target_id", "m.*")


def outreach_timeline(messages: DataFrame, drift: DataFrame, facts: DataFrame) -> DataFrame:
    """Per target with a message: changes after it, report, and whether it was acknowledged.

    Changes are counted per target and time before they meet the messages, so a target with very many changes is cheap.
    """
    times = drift.groupBy("target_id", "observed_at").agg(F.count(F.lit(1)).alias("n"))
    later = times.join(messages.select("target_id", "sent_at"), "target_id").groupBy("target_id").agg(
        F.sum(F.when(F.col("observed_at") > F.col("sent_at"), F.col("n")).otherwise(0)).alias("drift_count"), F.lit(True).alias("any_drift")
    )
    rows = messages.join(later, "target_id", "left").join(facts.select(F.col("model_id").alias("target_id"), F.col("highest_severity").alias("severity"), F.lit(True).alias("r")), "target_id", "left")
    return rows.select(
        "target_id", F.to_date("sent_at").alias("outreach_date"), F.coalesce("drift_count", F.lit(0)).alias("drift_count"), (F.coalesce("drift_count", F.lit(0)) > 0).alias("has_post_drift"),
        F.coalesce("any_drift", F.lit(False)).alias("any_drift"), F.coalesce("r", F.lit(False)).alias("has_report"), F.coalesce("severity", F.lit("")).alias("severity"),
        F.coalesce(F.col("response_type") == "acknowledged", F.lit(False)).alias("responded"),
    )


def timeline_stats(timeline: DataFrame, drift: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row: targets, changes, targets with any change, correlated changes, acknowledgements, reports, and the rate in percent."""
    total = timeline.agg(
        F.count(F.lit(1)).alias("total_outreach"), F.count_if("any_drift").alias("outreach_with_drift"), F.count_if("responded").alias("acknowledged_responses"),
        F.count_if("has_report").alias("models_with_report"),
    )
    rate = F.round(F.col("outreach_with_drift") * 100.0 / F.greatest("total_outreach", F.lit(1)), 1)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = total.crossJoin(count(drift, "total_drift_events")).crossJoin(count(correlations, "post_outreach_correlations"))  # one row each
    return rows.withColumn("correlation_rate", rate)


def merge_outreach(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Status records of two registers by normalised id (lower case, no ``gh:``).

    A rich status of the older register wins; its other fields fill fields of the newer one that are empty; records that only the
    older one has are added; what is left empty gets its default.
    """
    numbers = {"completeness_score": 0.0, "absent_count": 0, "days_pending": 0}
    texts = {"provenance": "not tracked", "documentation": "not tracked", "highest_severity": "", "observed_at": "", "public_note": "", "event_type": "", "discussion_url": "", "offer_date": "", "platform": "unknown"}
    filled = ("completeness_score", "provenance", "documentation", "has_report", "highest_severity", "absent_count", "observed_at", "public_note", "event_type", "missing")
    key = lambda df: df.withColumn("key", F.regexp_replace(F.lower(F.trim("target_id")), "^gh:", ""))
    both = key(newer).alias("a").join(key(older).alias("b"), "key", "full_outer")
    only_b = F.col("a.target_id").isNull()

    def value(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in numbers:
            empty = F.coalesce(a, F.lit(0)) == 0
        elif c == "missing":
            empty = F.coalesce(F.size(a), F.lit(0)) <= 0
        elif c == "has_report":
            empty = ~F.coalesce(a, F.lit(False))
        else:
            empty = F.coalesce(a, F.lit("")).isin("", "not tracked")
        taken = F.when(only_b | (empty if c in filled else F.lit(False)), F.coalesce(b, a)).otherwise(a)
        other = F.expr("cast(array() as array<string>)") if c == "missing" else F.lit(numbers.get(c, texts.get(c, False)))
        return F.coalesce(taken, other).alias(c)

    status = F.when(F.col("b.status").isin(*RICH) | only_b, F.col("b.status")).otherwise(F.col("a.status"))
    return both.select("key", F.coalesce("a.target_id", "b.target_id").alias("target_id"), F.coalesce(status, F.lit("unknown")).alias("status"),
                       *[value(c) for c in (*numbers, *texts, "has_report", "missing")], only_b.alias("older_only"))


def merged_stats(merged: DataFrame) -> DataFrame:
    """Records, means, reports and states of a merged register, in total (platform null) and by platform."""
    states = ("acknowledged", "closed", "no_response", "pending", "sent", "failed", "skipped", "blocked", "access_restricted")
    return merged.rollup("platform").agg(
        F.count(F.lit(1)).alias("total_offered"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.round(F.avg("days_pending"), 1).alias("avg_days_pending"),
        F.round(F.avg("completeness_score"), 1).alias("avg_completeness"), F.count_if("has_report").alias("with_report"), F.grouping("platform").cast("int").alias("is_total"),
    )
