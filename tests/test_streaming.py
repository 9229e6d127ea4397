"""Streams against batches: order inside the watermark, one rule for receipts, late rows."""

import datetime as dt
import random
import uuid

import pytest

from ledgerlight.functions.storage import shared_folder
from ledgerlight.operators import disclosure, payouts
from ledgerlight.streaming import jobs

SNAPSHOT = "target_id string, observed_at timestamp, schema string, license string, declared_datasets array<string>, has_training_section boolean, http_status int"


def fresh(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def in_batches(spark, batches, schema):
    """A stream that takes one batch a time, in order."""
    path = fresh(spark)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/n={n:03d}")
    files = spark.read.parquet(path)
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(path).drop("n")


def finished(spark, stream, mode="append"):
    path = fresh(spark)
    jobs.to_table(stream, path, mode)
    return spark.read.parquet(f"{path}/rows")


def snapshot(target, at, licence):
    return (target, at, "v3", licence, ["a"], True, 200)


def test_late_rows_inside_the_watermark_are_compared_in_their_order(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [snapshot(f"t{k % 5}", start + dt.timedelta(minutes=40 * k), rng.choice("xy")) for k in range(200)]
    rows += [snapshot("gap", start, "x"), snapshot("gap", start + dt.timedelta(days=2), "x")]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 20)))  # up to 20 hours late, the watermark waits a day
    end = [snapshot("end", start + dt.timedelta(days=90), "x")]
    batches = [late[k : k + 40] for k in range(0, len(late), 40)] + [end, [snapshot("end", start + dt.timedelta(days=95), "x")]]
    got = finished(spark, jobs.stream_changes(in_batches(spark, batches, SNAPSHOT))).where("target_id <> 'end'")
    want = disclosure.timeline_changes(spark.createDataFrame(rows, SNAPSHOT))
    pairs = lambda df: sorted((r.target_id, r.observed_at) for r in df.select("target_id", "observed_at").collect())
    assert pairs(got) == pairs(want) and len(pairs(want)) > 50


RECEIPT = "schema string, timestamp string, top_k array<struct<provider_id string, shard_id string, share double>>"


def receipts():
    good = [("royalty_receipt.v1", f"2024-01-{d:02d}T00:00:00", [("a", "s", 0.5), ("b", "s", 0.5)]) for d in range(1, 9)]
    odd = [("royalty_receipt.v1", "2024-01-09T00:00:00", x) for x in (
        [("a", "s", None), ("b", "s", 1.0)], [("a", "s", -0.5), ("b", "s", 1.0)], [(None, "s", 0.5), ("b", "s", 1.0)], [("a", None, 3.0), ("b", "s", 1.0)], [("a", "s", 0.4)], [], None)]
    return [*good, *odd, ("other", "2024-01-09T00:00:00", [("a", "s", 1.0)]), ("royalty_receipt.v1", None, [("a", "s", 1.0)]), ("royalty_receipt.v1", "broken", [("a", "s", 1.0)])]


def test_streams_and_batches_weigh_the_same_receipts(spark):
    rows = receipts()
    stream = finished(spark, jobs.stream_weights(in_batches(spark, [rows[:6], rows[6:]], RECEIPT)), "update")
    last = jobs.monthly_weights(stream)
    want = {r.provider_id: r.weight for r in payouts.provider_weights(spark.createDataFrame(rows, RECEIPT), "2024-01").collect()}
    assert {r.provider_id: r.weight for r in last.collect()} == pytest.approx(want) and want == pytest.approx({"a": 4.0, "b": 8.0})


def test_late_receipts_are_counted(spark):
    rows = [("royalty_receipt.v1", t, [("a", "s", 1.0)]) for t in ("2024-06-01T00:00:00", "2024-06-02T00:00:00", "2024-01-01T00:00:00", "2024-05-30T00:00:00")]
    listener = jobs.LateRows()
    spark.streams.addListener(listener)
    try:
        finished(spark, jobs.stream_weights(in_batches(spark, [rows[:1], rows[1:2], rows[2:]], RECEIPT), "7 days"), "update")
        import time

        for _ in range(50):
            if listener.rows:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    path = fresh(spark)
    listener.to_table(spark, path)
    listener.to_table(spark, path)
    assert sum(r.dropped for r in spark.read.parquet(path).collect()) == 1
