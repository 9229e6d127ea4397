"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.disclosure import fingerprint
from ..operators.payouts import balanced_receipts
from ..operators.validation import classify_records


def to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run what is available now; each micro-batch overwrites its own folder, so a repeated batch does no harm."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def to_valid_and_quarantine(stream: DataFrame, folder: str) -> None:
    """Run what is available now; rows without an error go to ``valid``, the others to ``quarantine``. A batch is computed
    once for both, and overwrites its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            bad = F.col("status") == "ERROR"
            for name, chosen in (("valid", ~bad), ("quarantine", bad)):
                batch.where(chosen).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={number}")
        finally:
            batch.unpersist()

    stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def stream_validate(lines: DataFrame) -> DataFrame:
    """Classified lines; ``to_valid_and_quarantine`` parts them by ``status``."""
    return classify_records(lines).select("value", "status", F.transform("issues", lambda i: i["code"]).alias("codes"))


def stream_weights(receipts: DataFrame, delay: str = "400 days") -> DataFrame:
    """Provider weights per day, in update mode, of the receipts and entries that count in a batch as well; ``monthly_weights``
    sums them. Days are windows of event time, so that days before the watermark leave the state and their rows are dropped,
    which ``LateRows`` counts. Receipts without a time are left out."""
    rows = receipts.withColumn("at", F.try_to_timestamp("timestamp")).where("at is not null").withWatermark("at", delay)
    rows = balanced_receipts(rows).select("at", "sum_share", F.explode("entries").alias("e"))
    days = rows.groupBy(F.window("at", "1 day").alias("w"), F.col("e.provider_id").alias("provider_id")).agg(F.sum(F.col("e.share") / F.col("sum_share")).alias("weight"))
    return days.select(F.to_date("w.start").alias("day"), "provider_id", "weight")


def monthly_weights(days: DataFrame) -> DataFrame:
    """Weights per month from rows ``(batch_id, day, provider_id, weight)``; of a day the last batch counts."""
    last = days.groupBy("day", "provider_id").agg(F.max_by("weight", "batch_id").alias("weight"))
    return last.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "provider_id").agg(F.sum("weight").alias("weight"))


class LateRows(StreamingQueryListener):
    """Rows that streaming queries dropped as later than their watermark, by query, run, batch and stateful operator."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for place, operator in enumerate(p.stateOperators):
            if operator.numRowsDroppedByWatermark:
                self.rows.append((p.name, str(p.id), str(p.runId), p.batchId, place, operator.numRowsDroppedByWatermark))

    def to_table(self, spark: SparkSession, folder: str) -> None:
        """Append what was counted since the last call: a row per batch that dropped any."""
        taken, self.rows = self.rows, []
        schema = "name string, query_id string, run_id string, batch_id long, operator int, dropped long"
        spark.createDataFrame(taken, schema).coalesce(1).write.mode("append").parquet(folder)


def stream_changes(snapshots: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Snapshots whose fingerprint differs from the target's last one within ``days``, in the order of their times.

    A target's rows wait until the watermark has passed them; then they are compared in order, whatever batch they came in. A
    timer releases them where no other row of the target comes. State: last hash and time, and the rows of ``delay`` that
    wait; it goes when a target has had no row for ``days``.
    """
    rows = snapshots.withWatermark("observed_at", delay).select("target_id", "observed_at", fingerprint().alias("fp"))
    limit = days * 86_400_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, waiting = state.get if state.exists else (None, 0, [])
        waiting = [(int(w[0]), w[1]) for w in waiting]
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip((batch["observed_at"].astype("int64") // _unit(batch["observed_at"])).tolist(), batch["fp"].tolist(), strict=True)
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        found, kept = [], []
        for now, fp in waiting:
            if now > mark * 1000:
                kept.append((now, fp))
                continue
            if last is None or now - at > limit or fp != last:
                found.append((key[0], pd.Timestamp(now, unit="us")))
            last, at = fp, now
        if state.hasTimedOut and not kept and at + limit <= mark * 1000:
            state.remove()
        else:
            state.update((last, at, kept))
            # event time: a clock of its own would keep an availableNow query running
            state.setTimeoutTimestamp(max((kept[0][0] if kept else at + limit) // 1000, mark + 1))
        yield pd.DataFrame(found, columns=["target_id", "observed_at"])

    return rows.groupBy("target_id").applyInPandasWithState(
        step, "target_id string, observed_at timestamp", "fp string, at long, waiting array<struct<at:long,fp:string>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def _unit(times: pd.Series) -> int:
    """Parts of a microsecond in which a column of times counts."""
    return {"ns": 1000, "us": 1}[times.dt.unit]


def stream_drift_windows(changes: DataFrame, size: str = "7 days", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Changes per window, in update mode."""
    return changes.withWatermark("observed_at", delay).groupBy(F.window("observed_at", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("w.start", "w.end", "changes")


def stream_drift_after_outreach(messages: DataFrame, changes: DataFrame, hours: int = 24, days: int = 30) -> DataFrame:
    """Changes from ``hours`` to ``days`` after a message to the target; the upper bound lets state go."""
    m = messages.select("message_id", F.col("target_id").alias("to_id"), "sent_at").withWatermark("sent_at", "1 day")
    c = changes.select("target_id", "observed_at").withWatermark("observed_at", "1 day")
    inside = (F.col("observed_at") >= F.col("sent_at") + F.expr(f"INTERVAL {hours} HOURS")) & (F.col("observed_at") <= F.col("sent_at") + F.expr(f"INTERVAL {days} DAYS"))
    return m.join(c, (F.col("to_id") == F.col("target_id")) & inside).select("message_id", "target_id", "observed_at")
