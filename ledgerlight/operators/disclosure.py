"""Disclosure snapshots, their drift and observation time series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STABLE = ("schema", "license", "declared_datasets", "has_training_section", "http_status")


def access_state(status: Column) -> Column:
    """Access by HTTP status."""
    return (
        F.when(status.between(200, 299), "ok").when(status.isin(401, 403), "forbidden").when(status == 404, "not_found")
        .when(status.isNull(), "unknown").otherwise("error")
    )


#: Sets of names that a snapshot counts, samples and hashes.
SETS, SAMPLE = ("tags", "languages", "datasets"), 25


def disclosure_snapshot(api: DataFrame, cards: DataFrame) -> DataFrame:
    """Join fetched registry rows ``(target_id, license, http_status`` and sets of names``)`` with cards ``(target_id, card,
    readme_status)``; sets and columns that a table does not have are left out."""
    joined = api.join(cards, "target_id", "left")
    sets = []
    for name in (n for n in SETS if n in api.columns):
        names = F.array_sort(F.array_distinct(name))
        sets += [F.size(names).alias(f"{name}_count"), F.slice(names, 1, SAMPLE).alias(f"{name}_sample"), F.sha2(F.array_join(names, ","), 256).alias(f"{name}_hash")]
    readme = [access_state(F.col("readme_status")).alias("readme_access")] if "readme_status" in cards.columns else []
    return joined.select(
        "target_id", "license", *sets, *readme,
        F.coalesce(F.col("card").rlike(r"(?im)^##\s+training\b"), F.lit(False)).alias("has_training_section"),
        access_state(F.col("http_status")).alias("access"), F.sha2("card", 256).alias("card_hash"),
        F.sha2(F.regexp_replace("card", r"(?s)\A---\n.*?\n---\n", ""), 256).alias("readme_hash"),
    )


def fingerprint(columns=STABLE) -> Column:
    """Digest of the fields that do not change by themselves."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def reuse_unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep the previous fields of targets whose card hash has not changed."""
    old = previous.select("target_id", F.col("card_hash").alias("old_hash"), F.col("has_training_section").alias("old_training"))
    joined = current.join(old, "target_id", "left").withColumn("reused", F.coalesce(F.col("card_hash") == F.col("old_hash"), F.lit(False)))
    return joined.withColumn("has_training_section", F.when(F.col("reused"), F.col("old_training")).otherwise(F.col("has_training_section"))).drop("old_hash", "old_training")


def presence(flag: Column) -> Column:
    return F.when(flag, "PRESENT").when(~flag, "ABSENT").otherwise("UNKNOWN")


def failed_fetch(status: Column, error: Column) -> Column:
    """Whether a snapshot says more about the fetch than about its target."""
    return F.coalesce(error.rlike("(?i)timeout|connection"), F.lit(False)) | F.coalesce(status != 200, F.lit(False))


def drift_events(previous: DataFrame, current: DataFrame, on: tuple[str, ...] = ("target_id",)) -> DataFrame:
    """Targets whose fingerprint differs between two snapshots of one schema, with what changed.

    Snapshots whose fetch failed are no event. Each field comes with its state before and after; sets also with their
    counts and what was added and removed.
    """
    pairs = previous.withColumn("fp", fingerprint()).alias("a").join(current.withColumn("fp", fingerprint()).alias("b"), list(on))
    pairs = pairs.where((F.col("a.schema") == F.col("b.schema")) & (F.col("a.fp") != F.col("b.fp")) & ~failed_fetch(F.col("b.http_status"), F.col("b.fetch_error")))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in sorted(STABLE)]))
    both = lambda name, column, of=lambda c: c: [of(F.col(f"a.{column}")).alias(f"{name}_before"), of(F.col(f"b.{column}")).alias(f"{name}_after")]
    return pairs.select(
        *on, changed.alias("changed"), *both("license", "license"), *both("training", "has_training_section", presence), *both("access", "http_status", access_state),
        *both("datasets", "declared_datasets", lambda c: F.size(F.array_distinct(c))),
        F.array_sort(F.array_except("b.declared_datasets", "a.declared_datasets")).alias("datasets_added"),
        F.array_sort(F.array_except("a.declared_datasets", "b.declared_datasets")).alias("datasets_removed"),
        *both("downloads", "downloads"), (F.col("b.downloads") - F.col("a.downloads")).alias("downloads_delta"),
    )


def drift_quality(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose fetch did not fail (a status that is absent is no failure), with ``quality_ok``: the interface answered 200 and
    the readme 200 or 404."""
    rows = snapshots.where(~failed_fetch(F.col("http_status"), F.col("fetch_error")))
    return rows.withColumn("quality_ok", F.coalesce((F.col("http_status") == 200) & F.col("readme_status").isin(200, 404), F.lit(False)))


def timeline_changes(snapshots: DataFrame, days: int = 30) -> DataFrame:
    """Snapshots whose fingerprint differs from the target's last one within ``days``; ``changed`` has the fields that differ
    from the last one (null at the first)."""
    by = Window.partitionBy("target_id").orderBy("observed_at")
    rows = snapshots.withColumn("fp", fingerprint())
    last = {f"last_{c}": F.lag(c).over(by) for c in ("fp", "observed_at", *STABLE)}
    rows = rows.withColumns(last)
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"last_{c}")), F.lit(c)) for c in sorted(STABLE)]))
    rows = rows.withColumn("changed", F.when(F.col("last_fp").isNotNull(), differ))
    fresh = F.col("last_observed_at") >= F.col("observed_at") - F.expr(f"INTERVAL {days} DAYS")
    return rows.where(F.col("last_fp").isNull() | ~fresh | (F.col("fp") != F.col("last_fp"))).drop("fp", *last)


def prune_window(rows: DataFrame, now: str, days: int = 30, column: str = "observed_at", schema: str | None = None) -> DataFrame:
    """Rows of the last ``days``; rows without a time stay. Rows of another ``schema``, if one is given, all go."""
    if schema is not None:
        rows = rows.where(F.col("schema") == schema)
    return rows.where(F.col(column).isNull() | (F.col(column) >= F.expr(f"TIMESTAMP'{now}' - INTERVAL {days} DAYS")))


def timeline_index(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest state of each target and when it last changed."""
    latest = snapshots.groupBy("target_id").agg(F.max_by(F.struct("license", "http_status"), "observed_at").alias("s"), F.max("observed_at").alias("seen_at"))
    last = changes.groupBy("target_id").agg(F.max("observed_at").alias("changed_at"), F.count(F.lit(1)).alias("changes"))
    return latest.join(last, "target_id", "left").select("target_id", "s.license", "s.http_status", "seen_at", "changed_at", F.coalesce("changes", F.lit(0)).alias("changes"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1))


def disclosure_index(latest: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """One row of headline counts: ISO week, fields present and absent, access, mean downloads, changes of 7 and 30 days, changed
    targets and the changes of each."""
    n = F.count(F.lit(1))
    year, week, _ = datetime.fromisoformat(now).isocalendar()
    declared = F.count_if(F.coalesce(F.size("declared_datasets"), F.lit(0)) > 0)
    state = latest.agg(
        F.lit(f"{year}-W{week:02d}").alias("week_id"), n.alias("targets"), declared.alias("with_declaration"), _percent(declared, n).alias("declaration_pct"), F.count("license").alias("with_license"), _percent(F.count("license"), n).alias("license_pct"),
        F.count_if("has_training_section").alias("with_training"), (n - F.count("license")).alias("without_license"),
        F.count_if(~F.coalesce("has_training_section", F.lit(False))).alias("without_training"), F.round(F.avg("downloads"), 2).alias("mean_downloads"),
        *[F.count_if(access_state(F.col("http_status")) == x).alias(f"access_{x}") for x in ("ok", "forbidden", "not_found", "unknown", "error")],
    )
    since = lambda d: F.col("observed_at") >= F.expr(f"TIMESTAMP'{now}' - INTERVAL {d} DAYS")
    events = changes.agg(F.count_if(since(7)).alias("events_7d"), F.count_if(since(30)).alias("events_30d"), F.count_distinct("target_id").alias("changed_targets"), F.count_distinct(F.when(since(30), F.col("target_id"))).alias("changed_targets_30d"))
    events = events.withColumn("changes_per_target_30d", F.round(F.col("events_30d") / F.greatest("changed_targets_30d", F.lit(1)), 2))
    return state.crossJoin(events)  # one row each


def org_disclosure(latest: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` organisations with most targets: counts and share with a licence."""
    org = F.split("target_id", "/")[0]
    rows = latest.groupBy(org.alias("org")).agg(F.count(F.lit(1)).alias("targets"), _percent(F.count("license"), F.count(F.lit(1))).alias("license_pct"))
    return rows.orderBy(F.desc("targets"), "org").limit(n)


def latest_events(changes: DataFrame, now: str, n: int = 20, days: int = 7) -> DataFrame:
    """The last ``n`` changes of the last ``days``."""
    recent = changes.where(F.col("observed_at") >= F.expr(f"TIMESTAMP'{now}' - INTERVAL {days} DAYS"))
    return recent.orderBy(F.desc("observed_at"), "target_id").limit(n).select("target_id", "observed_at", "changed")


def gated_share(latest: DataFrame) -> DataFrame:
    """Share of targets whose access is forbidden, in percent."""
    return latest.agg(_percent(F.count_if(access_state(F.col("http_status")) == "forbidden"), F.count(F.lit(1))).alias("gated_pct"))


def movers(changes: DataFrame, n: int = 10) -> DataFrame:
    """Targets with most change events."""
    return changes.groupBy("target_id").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "target_id").limit(n)


def top_downloads(latest: DataFrame, n: int = 15) -> DataFrame:
    """Most downloaded targets; those without downloads do not count."""
    return latest.where("downloads > 0").orderBy(F.desc("downloads"), "target_id").limit(n).select("target_id", "downloads")


def undocumented_tops(latest: DataFrame, n: int = 15, downloads: int = 10_000) -> DataFrame:
    """Most downloaded targets without a training section."""
    rows = latest.where((F.col("downloads") > downloads) & ~F.coalesce("has_training_section", F.lit(False)))
    return rows.orderBy(F.desc("downloads"), "target_id").limit(n).select("target_id", "downloads")


def temporal_metrics(observations: DataFrame) -> DataFrame:
    """First and last sight, days (inclusive), number, and days of the trailing run of absences, per target.

    ``with_metrics`` adds them to each observation.
    """
    absent = F.col("observation_type") == "absence"
    first = observations.groupBy("target_id").agg(
        F.min("observation_timestamp").alias("first_seen"), F.max("observation_timestamp").alias("last_seen"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(~absent, F.col("observation_timestamp"))).alias("last_present"),
    )
    joined = observations.where(absent).join(first.select("target_id", "last_present"), "target_id")
    after = joined.where(F.col("last_present").isNull() | (F.col("observation_timestamp") > F.col("last_present")))
    runs = after.groupBy("target_id").agg(F.min("observation_timestamp").alias("absent_since"))
    return first.join(runs, "target_id", "left").select(
        "target_id", "first_seen", "last_seen", (F.datediff("last_seen", "first_seen") + 1).alias("days"), "n",
        F.coalesce(F.datediff("last_seen", "absent_since") + 1, F.lit(0)).alias("absence_days"),
    )


def with_metrics(observations: DataFrame) -> DataFrame:
    """Every observation with the metrics of its target."""
    return observations.join(temporal_metrics(observations), "target_id")


def _proof(value: Column) -> Column:
    """``sha256:`` and 64 hex digits, with or without the prefix before; null for anything else."""
    return F.when(value.startswith("sha256:"), value).when(value.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("sha256:"), value))


def public_evidence(observations: DataFrame) -> DataFrame:
    """The receipt's proof, and from the evidence its number, the ids of violations and the proofs that are well formed."""
    evidence = F.try_parse_json("evidence_text")
    listed = lambda name: F.coalesce(F.try_variant_get(evidence, f"$.oracle.{name}", "array<string>"), F.expr("cast(array() as array<string>)"))
    return observations.select(
        "observation_id", _proof(F.col("receipt_hash")).alias("proof"), F.try_variant_get(evidence, "$.k", "int").alias("evidence"),
        F.filter(listed("violations"), lambda x: x != "").alias("violations"), F.array_compact(F.transform(listed("proof_hashes"), _proof)).alias("proofs"),
    )


def license_snapshot(rows: DataFrame) -> DataFrame:
    """Licence entropy (bits), share of unknown licences, the 20 most frequent licences and all levels of confidence with their
    counts, per (dataset, period). Licences are lower case; no licence is ``unknown``, and so is no ``confidence``."""
    rows = rows.withColumns({"license": F.lower(F.coalesce("license", F.lit("unknown"))), "confidence": F.coalesce("confidence", F.lit("unknown"))})
    counts = rows.groupBy("dataset", "period", "license").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("dataset", "period")
    counts = counts.withColumn("p", F.col("n") / F.sum("n").over(total))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(name).alias("x")))), lambda x: F.concat(x["x"], F.lit(":"), (-x["o"]).cast("string")))
    licences = counts.groupBy("dataset", "period").agg(
        F.sum("n").alias("rows"), F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"),
        F.round(F.coalesce(F.sum(F.when(F.col("license") == "unknown", F.col("p"))), F.lit(0.0)), 4).alias("unknown_ratio"), F.slice(listed("license"), 1, 20).alias("top"),
    )
    levels = rows.groupBy("dataset", "period", "confidence").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset", "period").agg(listed("confidence").alias("confidences"))
    return licences.join(levels, ["dataset", "period"])


def license_drift(snapshots: DataFrame) -> DataFrame:
    """Change of entropy and unknown share against the dataset's period before: low, medium or high."""
    by = Window.partitionBy("dataset").orderBy("period")
    drift = 0.6 * F.abs(F.col("entropy") - F.lag("entropy").over(by)) + 0.4 * F.abs(F.col("unknown_ratio") - F.lag("unknown_ratio").over(by))
    rows = snapshots.select("dataset", "period", F.round(drift, 6).alias("drift")).where(F.col("drift").isNotNull())
    return rows.withColumn("level", F.when(F.col("drift") < 0.05, "low").when(F.col("drift") < 0.15, "medium").otherwise("high"))


def migrate_timeline(rows: DataFrame) -> DataFrame:
    """Version 1 to 2: booleans become PRESENT, ABSENT or UNKNOWN, access states upper case."""
    state = F.when(F.col("has_training_section"), "PRESENT").when(~F.col("has_training_section"), "ABSENT").otherwise("UNKNOWN")
    return rows.withColumn("training_state", state).withColumn("access", F.upper(access_state(F.col("http_status")))).drop("has_training_section")
