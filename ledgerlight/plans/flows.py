"""Queries over adapters, sinks and streams. Files between steps go to the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..operators import disclosure as d
from ..operators import validation as val
from ..sources import adapters as a
from ..sources import ndjson
from ..sources import views as v
from ..streaming import jobs
from .evidence import dirty
from .settlement import _amounts, rounded
from ..operators import payouts as p


def folder(spark) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stored(df, kind="parquet"):
    path = folder(df.sparkSession)
    getattr(df.write, kind)(path)
    return path


def _streamed(df):
    """A stream over the rows of ``df``; watermarks need instants, so local timestamps become UTC ones."""
    df = df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
    return df.sparkSession.readStream.schema(df.schema).parquet(_stored(df))


def _closed(s, f):
    """Snapshots, and two of a target of its own from years later that let the watermark pass them all."""
    rows = v.snapshots(s, f)
    last = rows.orderBy(F.desc("observed_at")).limit(1).withColumn("target_id", F.lit("end"))
    later = lambda years: last.withColumn("observed_at", F.col("observed_at") + F.expr(f"INTERVAL {years} YEARS"))
    return rows.unionByName(later(1)).unionByName(later(2))


def _finished(stream, mode="append"):
    path = folder(stream.sparkSession)
    jobs.to_table(stream, path, mode)
    rows = stream.sparkSession.read.parquet(f"{path}/rows")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"})


def _validated(s, f):
    path = folder(s)
    jobs.to_valid_and_quarantine(jobs.stream_validate(s.readStream.text(_stored(dirty(s, f).select("value"), "text"))), path)
    read = lambda name: s.read.parquet(f"{path}/{name}").withColumn("sink", F.lit(name))
    return read("valid").unionByName(read("quarantine"))


def _wide(s, f):
    r = v.receipts(s, f)
    cols = [F.try_element_at("top_k", F.lit(i))[c].alias(f"{c}{i}") for i in (3, 1, 2) for c in ("provider_id", "shard_id", "share")]
    k = F.col("order_key")
    licences = [F.when(k % 3 == 0, " mit ").alias("license_id1"), F.when(k % 2 == 0, "cc-by").alias("license_id2"), F.when(k % 4 == 0, "mit").otherwise(" ").alias("license_id9")]
    return r.select("output_id", "model_id", "timestamp", *cols, *licences)


def _usage(s, f):
    u = F.col("user_id")
    name = lambda n: F.concat(F.lit("p"), (u % n).cast("string"))
    return v.table(s, f, "events").select(F.when(F.col("event_id") % 11 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
                                          F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("model_id"), F.array(name(7), name(5), name(7)).alias("providers"))


def _collections(s, f):
    k = F.col("p_partkey")
    name = F.concat(F.lit("ds"), k.cast("string"))
    licences = F.when(k % 4 == 0, F.concat(F.lit('[{"License": "'), F.col("p_type"), F.lit('", "License URL": "u"}, "mit"]'))).when(k % 4 == 1, F.concat(F.lit('["'), F.col("p_type"), F.lit('"]'))).when(
        k % 4 == 2, F.concat(F.lit('[{"spdx_id": "'), F.col("p_type"), F.lit('", "href": "h"}, {"url": "x"}]')))
    key = F.when(k % 5 == 0, "Dataset Name").otherwise("Unique Dataset Identifier")
    entry = F.concat(F.lit('{"'), key, F.lit('": "'), name, F.lit('", "Domain": "d'), (k % 7).cast("string"), F.lit('", "License'), F.when(k % 4 == 3, F.concat(F.lit('": "'), F.col("p_type"), F.lit('"'))).otherwise(
        F.concat(F.lit('s": '), licences)), F.lit("}"))
    body = F.when(k % 3 == 0, F.concat(F.lit("["), entry, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('{"datasets":['), entry, F.lit("]}"))).otherwise(F.concat(F.lit('{"x":'), entry, F.lit("}")))
    return v.table(s, f, "part").select(F.concat(F.when(k % 17 == 0, "_").otherwise("p/"), k.cast("string")).alias("path"), body.alias("body"))


def _changes(s, f):
    return d.timeline_changes(v.snapshots(s, f)).select("target_id", "observed_at")


def _lines(s, f):
    path = _stored(dirty(s, f).select("value"), "text")
    return ndjson.with_line_no(s, path).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.count_distinct("line_no").alias("distinct"))


def _latest_batch(df, *keys):
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in rest])


def _written_payouts(s, f):
    path = folder(s)
    a.write_payouts(p.payout_rows(_amounts(s, f), "1997-06", 1_000_000), path)
    return s.read.csv(f"{path}/csv", header=True).select("provider_id", "amount", "period")


def _written_snapshots(s, f):
    path = folder(s)
    for _ in range(2):  # a repeated run
        a.write_snapshot(v.snapshots(s, f), path)
    count = lambda part: s.read.parquet(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count("history").unionByName(count("latest"))


def _store(s, f):
    k = F.col("part_key")
    body = F.to_json(F.struct(F.when(k % 2 == 0, F.col("model_id")).alias("model_id"), "score"))
    path = folder(s)
    a.write_report_store(v.reports(s, f).select(F.col("model_id").alias("name"), body.alias("value")), path)
    return a.read_report_store(s, path, packed=True)


QUERIES = {
    "a2_with_line_no": lambda s, f: _lines(s, f).agg(F.sum("n").alias("lines"), F.count_if((F.col("n") == F.col("last")) & (F.col("n") == F.col("distinct"))).alias("files_ok"), F.count(F.lit(1)).alias("files")).select(
        "lines", (F.col("files_ok") == F.col("files")).alias("ok")),
    "a3_receipts_from_wide": lambda s, f: a.receipts_from_wide(_wide(s, f), 3).select("output_id", "period", F.transform("top_k", lambda e: e["provider_id"]).alias("providers"), F.size("top_k").alias("n"), "license_refs"),
    "a4_receipts_from_collections": lambda s, f: a.receipts_from_collections(_collections(s, f)).select(
        "path", "provider_id", "share", F.transform("license_refs", lambda x: F.concat_ws("|", x["license_id"], x["url"])).alias("licenses"), F.col("meta.dataset_name").alias("name"), F.col("meta.domain").alias("domain")),
    "a5_receipts_from_events": lambda s, f: a.receipts_from_events(_usage(s, f)).select("model_id", "timestamp", "output_id", F.transform("top_k", lambda e: e["provider_id"]).alias("providers")),
    "a6_spider_receipts": lambda s, f: a.spider_receipts(v.table(s, f, "pages").withColumnRenamed("url", "URL"), "crawl", "2024-01").select("receipt_id", "content_id"),
    "a7_read_report_store": _store,
    "a9_write_payouts": _written_payouts,
    "a10_write_snapshot": _written_snapshots,
    "v8_check_spider_receipts": lambda s, f: val.check_spider_receipts(a.spider_receipts(v.table(s, f, "pages"), "crawl", "2024-01").withColumn(
        "receipt_id", F.when(F.col("content_id").endswith("0"), "bad").otherwise(F.col("receipt_id")))),
    "s1_stream_validate": lambda s, f: _validated(s, f).groupBy("sink", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("codes") > 0).alias("with_codes")),
    "s2_stream_weights": lambda s, f: rounded(jobs.monthly_weights(_finished(jobs.stream_weights(_streamed(v.receipts(s, f))), "update"))),
    "s3_stream_changes": lambda s, f: _finished(jobs.stream_changes(_streamed(_closed(s, f)))).where("target_id <> 'end'").select("target_id", "observed_at"),
    "s4_stream_drift_windows": lambda s, f: _latest_batch(_finished(jobs.stream_drift_windows(_streamed(_changes(s, f))), "update"), "start", "end"),
    "s4_stream_drift_sliding": lambda s, f: _latest_batch(_finished(jobs.stream_drift_windows(_streamed(_changes(s, f)), "30 days", "1 day"), "update"), "start", "end"),
    "s5_stream_drift_after_outreach": lambda s, f: _finished(jobs.stream_drift_after_outreach(
        _streamed(v.outreach(s, f)), _streamed(_changes(s, f)))).drop("batch_id"),
}

from .evidence import _DIRTY  # noqa: E402
from .observation import _S  # noqa: E402
from .registry import _D  # noqa: E402
from .settlement import SQL as _SETTLED  # noqa: E402

SQL = {
    "a2_with_line_no": f"WITH {v.ENTRIES} SELECT count(DISTINCT order_key) AS lines, true AS ok FROM entries",
    "a3_receipts_from_wide": f"""WITH {v.ENTRIES} SELECT output_id, strftime(any_value(ts), '%Y-%m') AS period, list(provider_id ORDER BY share DESC, CASE rank WHEN 3 THEN 3 ELSE rank END) AS providers,
        count(*) AS n, any_value(list_distinct_in_order) AS license_refs
        FROM (SELECT *, CASE WHEN order_key % 12 = 0 OR order_key % 6 = 0 THEN ['mit', 'cc-by'] WHEN order_key % 3 = 0 THEN ['mit'] WHEN order_key % 4 = 0 THEN ['cc-by', 'mit'] WHEN order_key % 2 = 0 THEN ['cc-by'] ELSE []::VARCHAR[] END AS list_distinct_in_order
          FROM entries) WHERE rank <= 3 GROUP BY 1""",
    "a4_receipts_from_collections": """SELECT 'p/' || p_partkey AS path, 'ds' || p_partkey AS provider_id, 1.0::DOUBLE AS share,
        CASE p_partkey % 4 WHEN 0 THEN [p_type || '|u', 'mit'] WHEN 2 THEN [p_type || '|h'] ELSE [p_type] END AS licenses,
        CASE WHEN p_partkey % 5 = 0 THEN 'ds' || p_partkey END AS name, 'd' || (p_partkey % 7) AS domain FROM part WHERE p_partkey % 17 <> 0""",
    "a5_receipts_from_events": """WITH e AS (SELECT 'm' || event_id AS model_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
          CASE WHEN user_id % 7 = user_id % 5 THEN ['p' || (user_id % 7)] ELSE ['p' || (user_id % 7), 'p' || (user_id % 5)] END AS providers FROM events WHERE event_id % 11 > 0)
        SELECT model_id, timestamp, providers, substr(sha256(model_id || '|' || timestamp || '|' || array_to_string(providers, ',')), 1, 12) AS output_id FROM e""",
    "a6_spider_receipts": """WITH u AS (SELECT 'cid:url_sha256:' || sha256(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/$', '')) AS content_id FROM pages)
        SELECT 'sr_sha256:' || sha256('crawl|2024-01|' || content_id) AS receipt_id, content_id FROM u""",
    "a7_read_report_store": None,
    "a9_write_payouts": f"SELECT provider_id, amount::VARCHAR AS amount, period FROM ({_SETTLED['p7_payout_rows']})",
    "a10_write_snapshot": f"{_S} SELECT 'history' AS part, count(*) AS n FROM snapshots UNION ALL SELECT 'latest', count(*) FROM snapshots WHERE day = (SELECT max(day) FROM snapshots)",
    "v8_check_spider_receipts": """WITH u AS (SELECT sha256(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/$', '')) AS h FROM pages)
        SELECT count(*) FILTER (NOT ends_with(h, '0')) AS ok, count(*) FILTER (ends_with(h, '0')) AS failed FROM u""",
    "s1_stream_validate": f"{_DIRTY} SELECT CASE status WHEN 'ERROR' THEN 'quarantine' ELSE 'valid' END AS sink, status, count(*) AS n, count(*) FILTER (len(codes) > 0) AS with_codes FROM k GROUP BY 1, 2",
    "s2_stream_weights": f"""WITH {v.ENTRIES} SELECT strftime(ts, '%Y-%m') AS month, provider_id, round(sum(share), 6) AS weight FROM entries GROUP BY 1, 2""",
    "s3_stream_changes": f"{_S} SELECT target_id, observed_at FROM ch",
    "s4_stream_drift_windows": f"{_S} SELECT time_bucket(INTERVAL 7 DAY, observed_at, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 7 DAY, observed_at, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS \"end\", count(*) AS changes FROM ch GROUP BY 1, 2",
    "s4_stream_drift_sliding": f"""{_S}, w AS (SELECT date_trunc('day', observed_at) - INTERVAL 1 DAY * unnest(range(0, 30)) AS start FROM ch)
        SELECT start, start + INTERVAL 30 DAY AS "end", count(*) AS changes FROM w GROUP BY 1, 2""",
    "s5_stream_drift_after_outreach": f"""{_D} SELECT message_id, target_id, observed_at FROM me JOIN ch USING (target_id)
        WHERE observed_at BETWEEN sent_at + INTERVAL 24 HOUR AND sent_at + INTERVAL 30 DAY""",
}
SQL = {name: sql for name, sql in SQL.items() if sql}
