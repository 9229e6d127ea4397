"""Rules of outreach on small plain fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import disclosure, outreach, registry

NOW = "2024-03-01 00:00:00"
LOG = (
    "record_no long, platform string, repo_id string, target_id string, status string, response_type string, sent_at timestamp, number long, "
    "completeness_score long, discussion_url string, public_note string, event_type string, package string"
)


def day(month, number):
    return dt.datetime(2024, month, number)


def line(no, repo, status, response=None, sent=day(2, 1), number=1, platform="huggingface", score=None, target=None, package="p"):
    return (no, platform, repo, target, status, response, sent, number, score, None, None, None, package)


@pytest.fixture(scope="module")
def nothing(spark):
    links = spark.createDataFrame([], "target_id string, model_id string")
    overrides = spark.createDataFrame([], "key string, line_no long, status string")
    facts = spark.createDataFrame([], "model_id string, completeness int, provenance string, documentation string, missing array<string>, highest_severity string, absent_count int, observed_at string")
    return overrides, links, facts, spark.createDataFrame([], "model_id string, score double")


@pytest.mark.parametrize("status,response,state", [
    ("sent", None, "pending"), ("sent", "merged", "acknowledged"), ("sent", "not_planned", "closed"), ("sent", "restricted", "access_restricted"), ("sent", "replied", "pending"),
    ("replied", "closed", "acknowledged"), ("closed", "merged", "closed"), ("blocked", "merged", "access_restricted"), ("not_planned", None, "closed"),
])
def test_states(spark, nothing, status, response, state):
    log = spark.createDataFrame([line(1, "a/b", status, response)], LOG)
    assert [r.status for r in outreach.outreach_records(log, *nothing, NOW).collect()] == [state]


def test_invalid_statuses_are_no_record(spark, nothing):
    log = spark.createDataFrame([line(1, "a/b", "error"), line(2, "a/b", None), line(3, "a/b", "dry_run")], LOG)
    assert outreach.outreach_records(log, *nothing, NOW).count() == 0
    assert outreach.outreach_status(outreach.outreach_records(log, *nothing, NOW)).count() == 0


def test_best_record_of_a_target(spark, nothing):
    rows = [line(1, "a/b", "sent", sent=day(2, 20)), line(2, "a/b", "closed", sent=day(1, 1)), line(3, "a/b", "closed", sent=day(1, 5)),
            line(4, "a/b", "closed", sent=day(1, 5)), line(5, "c/d", "sent", sent=None), line(6, "c/d", "sent", sent=None, platform="github"), line(7, None, "sent", target=None)]
    got = {r.target_id: r for r in outreach.outreach_status(outreach.outreach_records(spark.createDataFrame(rows, LOG), *nothing, NOW)).collect()}
    assert (got["a/b"].status, got["a/b"].offer_date, got["a/b"].days_pending, got["a/b"].messages) == ("closed", "2024-01-05", 56, 4)
    assert (got["c/d"].platform, got["c/d"].days_pending, got["c/d"].offer_date) == ("huggingface", 0, "")
    assert got["unknown"].status == "pending"


def test_overrides_come_before_the_state_and_scores_fall_back(spark, nothing):
    rows = [line(1, "a/b", "sent", score=7), line(2, "c/d", "sent", score=8), line(3, "e/f", "sent", score=9, platform="github"), line(4, "g/h", "sent", score=10)]
    overrides = spark.createDataFrame([("a/b", 1, "closed"), ("a/b", 2, "replied"), ("c/d", 1, None)], "key string, line_no long, status string")
    links = spark.createDataFrame([("e/f", "m/x"), ("g/h", "m/x")], "target_id string, model_id string")
    reports = spark.createDataFrame([("m/x", [("NEC#1", "PRESENT"), ("NEC#2", "ABSENT"), ("NEC#3", "ABSENT")], "high", "d")], "model_id string, observations array<struct<nec_id string, status string>>, severity string, reported_on string")
    compliance = spark.createDataFrame([("c/d", None), ("g/h", 61.5)], "model_id string, score double")
    got = {r.target_id: r for r in outreach.outreach_records(spark.createDataFrame(rows, LOG), overrides, links, outreach.report_facts(reports), compliance, NOW).collect()}
    assert (got["a/b"].status, got["a/b"].completeness_score) == ("acknowledged", 7.0)
    assert (got["c/d"].status, got["c/d"].completeness_score) == ("pending", 0.0)  # a score that is there but null
    assert (got["e/f"].completeness_score, got["e/f"].linked_model_id, got["e/f"].provenance, got["e/f"].documentation, got["e/f"].missing) == (33.0, "m/x", "present", "partial", ["NEC#2", "NEC#3"])
    assert (got["g/h"].completeness_score, got["g/h"].linked_model_id, got["g/h"].has_report) == (61.5, None, False)  # links are for the other platform


def test_answers_rates_and_sync(spark):
    rows = [line(1, "a/b", "sent", number=1), line(2, "a/b", "sent", number=2), line(3, "a/c", "closed", number=1), line(4, None, "sent", target="x", number=1, sent=day(2, 28)), line(5, "a/d", "sent", number=0),
            line(6, "a/d", "blocked", number=3), line(7, "b/e", "sent", number=9, sent=day(1, 1))]
    log = spark.createDataFrame(rows, LOG)
    answers = spark.createDataFrame([("a/b", 1, "merged", 1), ("a/b", 2, "open", 3), ("a/c", 1, "closed", 1), ("b/e", 9, "open", 1)], "repo_id string, number long, discussion string, events long")
    followed = outreach.answered(log, answers, NOW)
    assert {(r.repo_id, r.number): (r.status, r.response_type) for r in followed.collect()} == {
        ("a/b", 1): ("accepted", "merged"), ("a/b", 2): ("pending", "acknowledged"), ("a/c", 1): ("declined", "closed"), ("x", 1): ("pending", "none"), ("b/e", 9): ("no_response", "none"),
    }
    assert tuple(outreach.response_rates(followed).first()) == (5, 1, 1, 2, 1, 50.0, 40.0)
    assert tuple(outreach.response_rates(followed.where("false")).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)
    assert {r.org: r.sent for r in outreach.response_by_org(followed).collect()} == {"a": 3, "unknown": 1, "b": 1}
    assert [tuple(r) for r in outreach.top_acceptors(outreach.response_by_org(followed)).collect()] == [("a", 1)]
    synced = {r.record_no: (r.status, r.updated) for r in outreach.sync_status(log, followed).collect()}
    assert synced == {1: ("acknowledged", True), 2: ("acknowledged", True), 3: ("closed", False), 4: ("sent", False), 5: ("sent", False), 6: ("blocked", False), 7: ("sent", False)}


def test_cooldown(spark):
    rows = [line(1, "a/b", "sent", sent=day(2, 28), package="p1"), line(2, "c/d", "sent", sent=dt.datetime(2020, 1, 1), package="p1"), line(3, "e/f", "accepted", sent=day(2, 28)), line(4, None, "sent", target="g/h", sent=day(2, 28)),
            line(5, "i/j", "sent", sent=None)]
    log = spark.createDataFrame(rows, LOG)
    cand = spark.createDataFrame([("a/b", "p2"), ("a/z", "p1"), ("c/d", "p1"), ("e/f", "p"), ("g/h", "p"), ("i/j", "p"), ("bare", None)], "target_id string, package string")
    why = lambda **k: {r.target_id: r.reason for r in outreach.cooldown_reasons(cand, log, NOW, k.pop("days", 7), **k).collect()}
    free = dict.fromkeys(["c/d", "e/f", "g/h", "i/j", "bare"])
    assert why() == {"a/b": "organisation", "a/z": "organisation", **free}
    assert why(scope="repo") == {"a/b": "repository", "a/z": None, **free}
    assert set(why(days=0).values()) == {None}
    assert {r.target_id for r in outreach.cooldown_filter(cand, log, NOW, 7).collect()} == set(free)


def test_timeline_and_drift_in_buckets(spark):
    log = spark.createDataFrame([line(1, "a/b", "sent", sent=day(1, 1)), line(2, "a/b", "merged", "acknowledged", sent=day(2, 1)), line(3, "c/d", "closed", sent=day(1, 1)), line(4, "e/f", "sent", sent=None)], LOG)
    last = outreach.last_messages(log)
    assert [(r.target_id, r.sent_at) for r in last.collect()] == [("a/b", day(2, 1))]
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k) for k in range(400)]
    drift = spark.createDataFrame([("a/b", t, ["license", "declared_datasets"] if n % 2 else ["license"]) for n, t in enumerate(times)], "target_id string, observed_at timestamp, changed array<string>")
    facts = spark.createDataFrame([("a/b", "high", 3)], "model_id string, highest_severity string, absent_count int")
    row = outreach.outreach_timeline(last, drift, facts).first()
    assert (row.drift_count, row.responded, row.has_report, row.severity) == (sum(t > day(2, 1) for t in times), True, True, "high")
    sent = spark.createDataFrame([(n, "a/b", dt.datetime(2024, 1, 1) + dt.timedelta(days=n)) for n in range(60)], "message_id long, target_id string, sent_at timestamp")
    for hours, days in ((24, 30), (1, 2), (48, 5)):
        want = {(n, t) for n in range(60) for k, t in enumerate(times) if k % 2 and dt.timedelta(hours=hours) <= t - (dt.datetime(2024, 1, 1) + dt.timedelta(days=n)) <= dt.timedelta(days=days)}
        got = registry.drift_after_outreach(sent, drift, hours, days, facts)
        rows = got.collect()
        assert len(rows) == len(want) and {(r.message_id, r.observed_at) for r in rows} == want and {(r.severity, r.absent_count, r.has_report) for r in rows} == {("high", 3, True)}


def test_merge_prefers_rich_states_and_fills_gaps(spark):
    schema = ("target_id string, status string, completeness_score double, absent_count int, days_pending long, provenance string, documentation string, highest_severity string, observed_at string, "
              "public_note string, event_type string, discussion_url string, offer_date string, platform string, has_report boolean, missing array<string>")  # fmt: skip
    rec = lambda t, status, score, note, missing: (t, status, score, None, 3, "not tracked", None, "", None, note, "", "", "", "hub", False, missing)
    newer = spark.createDataFrame([rec("A/b", "sent", 0.0, "", []), rec("c/d", "no_response", 5.0, "mine", ["x"])], schema)
    older = spark.createDataFrame([rec("gh:a/B", "closed", 40.0, "theirs", ["y"]), rec("c/D", "pending", 50.0, "theirs", ["y"]), rec("e/f", None, None, None, None)], schema)
    got = {r.key: r for r in outreach.merge_outreach(newer, older).collect()}
    assert (got["a/b"].status, got["a/b"].completeness_score, got["a/b"].public_note, got["a/b"].missing, got["a/b"].target_id) == ("closed", 40.0, "theirs", ["y"], "A/b")
    assert (got["c/d"].status, got["c/d"].completeness_score, got["c/d"].public_note, got["c/d"].missing) == ("no_response", 5.0, "mine", ["x"])
    assert (got["e/f"].status, got["e/f"].completeness_score, got["e/f"].provenance, got["e/f"].missing, got["e/f"].older_only) == ("unknown", 0.0, "not tracked", [], True)


def test_compliance_index_falls_back(spark):
    schema = "model_id string, score double, reported_on string, summary struct<score double, label string, present long, absent long, partial long, total long>, observations array<struct<nec_id string, status string>>"
    obs = [("1", "present"), ("2", "ABSENT"), ("3", "partial")]
    rows = [("a", 12.5, "d", (80.4, "", 3, 0, 1, 18), obs), ("b", 59.5, "d", None, obs), ("c", None, "d", (None, "HIGH", 0, 0, 7, None), []), ("e", 60.5, "d", (None, None, None, None, None, None), None)]
    got = {r.model_id: tuple(r)[1:8] for r in registry.compliance_index(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (80, 3, 0, 1, 18, "EXCELLENT", 4), "b": (60, 1, 1, 1, 3, "LOW", 3), "c": (0, 0, 0, 0, 20, "HIGH", 1), "e": (60, 0, 0, 0, 20, "LOW", 3)}


def test_drift_quality_keeps_absent_statuses(spark):
    rows = [("a", None, None, 200), ("b", 404, None, 200), ("c", 200, None, 404), ("d", 500, None, 200), ("e", 200, "Connection reset", 200), ("f", 200, "other", 500)]
    got = disclosure.drift_quality(spark.createDataFrame(rows, "target_id string, http_status int, fetch_error string, readme_status int"))
    assert {r.target_id: r.quality_ok for r in got.collect()} == {"a": False, "c": True, "f": False}


def test_report_metrics_of_nothing(spark):
    got = registry.report_metrics(spark.createDataFrame([("a", None), ("b", [])], "model_id string, observations array<struct<nec_id string, status string>>")).collect()
    assert {tuple(r)[1:4] for r in got} == {(0, "unknown", "unknown")}
    assert all(r.missing == [] for r in got)


def test_enrichment_by_id_then_by_name(spark):
    reports = spark.createDataFrame([("Org/M", [("NEC#1", "ABSENT"), ("NEC#3", "PRESENT")], "high", []), ("x/other", [("NEC#1", "PARTIAL")], "low", [])],
                                    "model_id string, observations array<struct<nec_id string, status string>>, severity string, gaps array<string>")
    targets = spark.createDataFrame([("gh:org/m",), ("fork/OTHER",), ("other",), ("none/none",)], "target_id string")
    got = {r.target_id: (r.model_id, r.provenance, r.documentation, r.completeness, r.has_report) for r in registry.enrich_with_report(targets, reports).collect()}
    assert got["gh:org/m"] == ("Org/M", "missing", "partial", 50, True)
    assert got["fork/OTHER"] == ("x/other", "present", "minimal", 100, True)
    assert got["other"][0] is None and got["none/none"] == (None, None, None, None, False)
    assert registry.enrich_with_report(targets.where(F.lit(False)), reports).count() == 0
