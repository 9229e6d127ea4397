"""Queries over validation and integrity, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..operators import integrity as h
from ..operators import validation as val
from ..sources import views as v

CHUNK = 50


def dirty(spark, sf):
    """Receipts as JSON lines, damaged by the remainder of their key by 20."""
    rows = v.receipts(spark, sf).withColumn("m", F.col("order_key") % 20)
    rows = rows.withColumn("top_k", F.transform("top_k", lambda e, i: F.struct(
        F.when(F.col("m") == 8, F.size("top_k") - i).otherwise(e["rank"]).alias("rank"), e["provider_id"].alias("provider_id"), e["shard_id"].alias("shard_id"),
        F.when((F.col("m") == 6) & (i == 0), -e["share"]).when(F.col("m") == 7, e["share"] * 2).otherwise(e["share"]).alias("share"))))
    rows = rows.withColumn("top_k", F.when(F.col("m") == 4, F.slice("top_k", 1, 0)).otherwise(F.col("top_k")))
    body = F.to_json(F.struct(
        F.when(F.col("m") == 2, "other.v9").otherwise(F.col("schema")).alias("schema"), F.when(F.col("m") != 3, F.col("output_id")).alias("output_id"),
        "model_id", "timestamp", "attribution_scope", "top_k", "hash_model", "hash_data_index", F.when(F.col("m") > 12, F.lit("sig")).alias("signature")))
    data = F.to_json(F.struct(F.lit(val.DATA).alias("schema"), F.col("output_id").alias("id"), F.when(F.col("m") == 9, "prov").otherwise(" ").alias("provider_id"),
                              F.lit("cid").alias("content_id"), "timestamp", F.lit("2024-01").alias("period")))
    value = (
        F.when(F.col("m") == 0, F.substring(body, 1, 40)).when(F.col("m") == 1, F.lit("[1, 2]"))
        .when(F.col("m") == 5, F.regexp_replace(body, '"share":([0-9.E-]+)', '"share":"$1"')).when(F.col("m").isin(9, 10), data).otherwise(body)
    )
    return val.once(rows, value=value).select(F.col("order_key").alias("line_no"), "value", "m")


_DIRTY = f"""
WITH {v.ENTRIES},
d AS (SELECT order_key AS line_no, order_key % 20 AS m, count(*) AS n FROM entries GROUP BY 1),
c AS (SELECT line_no, m, n, CASE m
  WHEN 0 THEN ['JSON_DECODE_ERROR'] WHEN 1 THEN ['RECORD_NOT_OBJECT'] WHEN 2 THEN ['SCHEMA_VALIDATE_ERROR'] WHEN 3 THEN ['SCHEMA_VALIDATE_ERROR']
  WHEN 4 THEN ['SCHEMA_VALIDATE_ERROR'] WHEN 5 THEN ['SCHEMA_VALIDATE_ERROR'] WHEN 6 THEN ['SCHEMA_VALIDATE_ERROR'] WHEN 7 THEN ['SUM_SHARE_NOT_1']
  WHEN 8 THEN list_transform(range(1, n), lambda x: 'RANK_NOT_MONOTONE') WHEN 10 THEN ['MISSING_PROVIDER_ID'] ELSE []::VARCHAR[] END AS codes FROM d),
k AS (SELECT *, CASE WHEN len(codes) = 0 THEN 'VALID' WHEN m = 7 THEN 'WARN' ELSE 'ERROR' END AS status FROM c)
"""


def _manifests(s, d):
    """A manifest per report, with something wrong by its key."""
    k = F.col("part_key")
    rest = '"receipts": "r.ndjson", "validate_report": "v.json", '
    head = F.when(k % 5 == 1, '{"schema": "x", "contract": "CRC-1"').when(k % 5 == 2, '{"schema": "a.manifest.v1"').otherwise('{"schema": "a.manifest.v1", "contract": "CRC-1"')
    names = F.when(k % 4 == 0, rest + '"hashchain": "h.txt", "trust_bundle": "t.json"').when(k % 4 == 1, rest + '"hashchain": "../h.txt", "trust_bundle": 7').when(k % 4 == 2, '"receipts": "/r", "other": " "')
    body = F.concat(head, F.when(k % 4 == 3, ', "artifacts": []}').otherwise(F.concat(F.lit(', "artifacts": {'), names, F.lit("}}"))))
    return v.reports(s, d).select(F.col("model_id").alias("bundle"), F.when(k % 7 == 0, "{broken").otherwise(body).alias("body"))


def _classified(s, d):
    return val.classify_records(dirty(s, d))


def _objects(s, d):
    return val.parse(dirty(s, d)).where("kind = 'OBJECT'")


def _artifacts(s, d):
    """A text artifact for each report, and what its manifest declares of it: some with a wrong size or digest, some missing."""
    k = F.col("part_key")
    value = F.concat(F.lit("artifact of "), "model_id", F.lit(" "), F.repeat(F.col("type"), (k % 50).cast("int")))
    rows = v.reports(s, d).select(F.replace("model_id", F.lit("/"), F.lit("__")).alias("bundle"), k, value.alias("value"))
    rows = rows.withColumns({"bundle": F.concat(F.lit("bundle="), "bundle"), "path": F.lit("artifact"), "body": F.concat("value", F.lit("\n"))})
    root = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    h.write_files(rows.where(k % 9 > 0), root)
    declared = rows.select("bundle", "path", (F.octet_length("body") + F.when(k % 5 == 0, 1).otherwise(0)).cast("long").alias("bytes"),
                           F.sha2(F.concat("body", F.when(k % 7 == 0, "x").otherwise("")), 256).alias("sha256"))
    return h.verify_artifacts(declared, h.declared_files(declared, root))


def _chain_lines(s, d):
    rows = v.table(s, d, "lineitem")
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key"), F.row_number().over(order).cast("long").alias("line_no"),
                       F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("value"))


def _tampered(s, d):
    chains = h.hash_chains(_chain_lines(s, d), "key", "line_no", "value", CHUNK)
    n = F.substring("key", 2, 9).cast("int")
    bad = chains.withColumn("digest", F.when((n % 7 == 3) & (F.col("block") == 1), F.sha2("digest", 256)).otherwise(F.col("digest")))
    bad = bad.withColumn("digest", F.when((n % 7 == 5) & (F.col("block") == 2), F.lit("zz")).otherwise(F.col("digest")))
    return bad


def _ledger(s, d):
    return v.table(s, d, "documents").where("doc_id % 9 <> 0").select(
        F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 10 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))


def _payloads(s, d):
    return v.table(s, d, "documents").where("doc_id % 8 <> 0").select(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))


def _declared(s, d):
    k = F.col("doc_id")
    rows = v.table(s, d, "documents")
    text = F.when(k % 7 == 1, F.concat("text", F.lit("!"))).when(k % 7 == 2, F.regexp_replace("text", "^.", "#")).otherwise(F.col("text"))
    return rows.select(F.concat(F.lit("b"), (k % 50).cast("string")).alias("bundle"),
                       F.concat(F.when(k % 11 == 0, "../").otherwise("f/"), k.cast("string")).alias("path"),
                       F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


def _stored(s, d):
    k = F.col("doc_id")
    return v.table(s, d, "documents").where(k % 13 != 0).select(
        F.concat(F.lit("b"), (k % 50).cast("string")).alias("bundle"), F.concat(F.lit("f/"), k.cast("string")).alias("path"),
        F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("digest"))


def _codes(s, d, keep):
    return keep.select("line_no", F.transform("issues", lambda i: i["code"]).alias("codes"))


QUERIES = {
    "a1_read_ndjson": lambda s, d: val.parse(dirty(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "v1_check_contract": lambda s, d: val.check_contract(_objects(s, d), val.ROYALTY).select(
        "line_no", F.array_sort(F.array_distinct(F.transform("contract_issues", lambda i: F.concat(i["path"], F.lit(" "), i["rule"])))).alias("issues")),
    "v2_royalty_issues": lambda s, d: _codes(s, d, val.once(_objects(s, d), issues=val.royalty_issues(F.col("record")))),
    "v3_data_receipt_issues": lambda s, d: _codes(s, d, _objects(s, d).where("m in (9, 10)").withColumn("issues", val.data_receipt_issues(F.col("record")))),
    "v4_classify_records": lambda s, d: _classified(s, d).select("line_no", "status", F.transform("issues", lambda i: i["code"]).alias("codes")),
    "v5_validation_summary": lambda s, d: val.validation_summary(_classified(s, d)),
    "v5_issue_counts": lambda s, d: val.issue_counts(_classified(s, d)),
    "v6_bad_sample": lambda s, d: val.bad_sample(_classified(s, d), 20),
    "v7_qa_receipts": lambda s, d: val.qa_receipts(v.receipts(s, d)),
    "v9_profile_records": lambda s, d: val.profile_records(dirty(s, d)),
    "v10_check_tables": lambda s, d: val.check_tables({
        "reports": (v.reports(s, d), ["model_id", "score", "badge"]), "snapshots": (v.snapshots(s, d), ["target_id", "license"])}),
    "b2_refine_receipts": lambda s, d: val.refine_receipts(
        v.receipts(s, d).withColumn("top_k", F.when(F.col("order_key") % 3 == 0, F.transform("top_k", lambda e: e.withField("share", e["share"] * 3)))
                                    .otherwise(F.reverse("top_k")))).select(
        "output_id", "fixed_sum", F.transform("top_k", lambda e: e["rank"]).alias("ranks"),
        F.transform("top_k", lambda e: F.floor(e["share"] * 1e6 + 0.5001)).alias("shares")),
    "h1_hash_chains": lambda s, d: h.hash_chains(_chain_lines(s, d), "key", "line_no", "value", CHUNK),
    "h2_verify_chains": lambda s, d: h.verify_chains(_chain_lines(s, d), _tampered(s, d), CHUNK),
    "h3_canonical_hash": lambda s, d: v.providers(s, d).select("provider_id", h.canonical_hash(["provider_id", "eligible", "kyc_tier"]).alias("digest")),
    "h4_verify_artifacts": lambda s, d: h.verify_artifacts(_declared(s, d), _stored(s, d)),
    "h4_stored_files": lambda s, d: _artifacts(s, d),
    "h4_manifest_issues": lambda s, d: h.manifest_issues(_manifests(s, d)),
    "h5_evidence_status": lambda s, d: h.evidence_status(
        v.reports(s, d).select(F.col("org").alias("bundle"), F.concat(F.lit("r"), F.when(F.col("part_key") % 2 == 0, ".json").otherwise(".bin")).alias("name")),
        v.reports(s, d).where("part_key % 6 = 0").select(F.col("org").alias("bundle"), F.explode("gaps").alias("g")).select("bundle", "g.severity")),
    "h6_table_parity": lambda s, d: h.table_parity(
        v.providers(s, d).select("provider_id", "status", "kyc_tier"),
        v.providers(s, d).select("provider_id", F.when(F.col("supp_key") % 5 == 0, "x").otherwise(F.col("status")).alias("status"), F.lit("t").alias("kyc_tier")),
        ["kyc_tier"]).groupBy("n_left", "n_right").agg(F.count(F.lit(1)).alias("n")),
    "h7_reconcile_ledger": lambda s, d: h.reconcile_ledger(_ledger(s, d), _payloads(s, d)),
    "b8_sign_records": lambda s, d: h.sign_records(dirty(s, d), key="example").select("line_no", "signature"),
    "b9_record_identity": lambda s, d: v.reports(s, d).select("model_id", h.record_identity(F.lit("model"), F.col("model_id"), F.col("org"), F.col("type")).alias("cid"),
                                                              h.binding_hash(F.col("model_id"), F.col("org")).alias("binding")),
}

SQL = {
    "a1_read_ndjson": f"{_DIRTY} SELECT CASE m WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'ARRAY' ELSE 'OBJECT' END AS kind, count(*) AS n FROM d GROUP BY 1",
    "v1_check_contract": f"""{_DIRTY} SELECT line_no, CASE WHEN m = 2 THEN []::VARCHAR[] WHEN m = 3 THEN ['output_id required'] WHEN m = 4 THEN ['top_k items']
        WHEN m = 5 THEN ['top_k[].share type'] WHEN m = 6 THEN ['top_k[].share min']
        WHEN m IN (9, 10) THEN ['attribution_scope required', 'hash_data_index required', 'hash_model required', 'model_id required', 'output_id required', 'top_k required']
        ELSE []::VARCHAR[] END AS issues FROM d WHERE m > 1""",
    "v2_royalty_issues": f"""{_DIRTY} SELECT line_no, CASE WHEN m IN (2, 9, 10) THEN ['BAD_SCHEMA'] WHEN m = 3 THEN ['MISSING_OUTPUT_ID'] WHEN m = 4 THEN ['MISSING_TOPK']
        WHEN m = 5 THEN list_transform(range(0, n), lambda x: 'MISSING_SHARE') WHEN m = 6 THEN ['NEGATIVE_SHARE', 'SUM_SHARE_NOT_1'] WHEN m = 7 THEN ['SUM_SHARE_NOT_1']
        WHEN m = 8 THEN codes ELSE []::VARCHAR[] END AS codes FROM c WHERE m > 1""",
    "v3_data_receipt_issues": f"{_DIRTY} SELECT line_no, CASE WHEN m = 10 THEN ['MISSING_PROVIDER_ID'] ELSE []::VARCHAR[] END AS codes FROM d WHERE m IN (9, 10)",
    "v4_classify_records": f"{_DIRTY} SELECT line_no, status, codes FROM k",
    "v5_validation_summary": f"""{_DIRTY} SELECT count(*) AS total, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'ERROR') AS errors,
        count(*) FILTER (status = 'WARN') AS warns, 'D' AS health FROM k""",
    "v5_issue_counts": f"{_DIRTY} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM k) GROUP BY 1",
    "v6_bad_sample": f"""{_DIRTY} SELECT line_no, (i - 1)::INTEGER AS place, codes[i] AS code, CASE WHEN codes[i] = 'SUM_SHARE_NOT_1' THEN 'WARN' ELSE 'ERROR' END AS level
        FROM (SELECT line_no, codes, unnest(range(1, len(codes) + 1)) AS i FROM k) ORDER BY line_no, i LIMIT 20""",
    "v7_qa_receipts": f"WITH {v.ENTRIES} SELECT count(DISTINCT output_id) AS receipts, 0 AS bad_sum, 0 AS negative, 0 AS unsorted FROM entries",
    "v9_profile_records": f"""{_DIRTY},
        f AS (SELECT m, n, CASE WHEN m IN (9, 10) THEN ['schema', 'id', 'provider_id', 'content_id', 'timestamp', 'period']
          WHEN m = 3 THEN ['schema', 'model_id', 'timestamp', 'attribution_scope', 'top_k', 'hash_model', 'hash_data_index']
          WHEN m > 12 THEN ['schema', 'output_id', 'model_id', 'timestamp', 'attribution_scope', 'top_k', 'hash_model', 'hash_data_index', 'signature']
          ELSE ['schema', 'output_id', 'model_id', 'timestamp', 'attribution_scope', 'top_k', 'hash_model', 'hash_data_index'] END AS fs FROM d WHERE m > 1)
        SELECT 'line' AS what, CASE WHEN m = 0 THEN 'broken' ELSE 'parsed' END AS name, count(*) AS n FROM d GROUP BY 2
        UNION ALL SELECT 'schema', CASE WHEN m = 2 THEN 'other.v9' WHEN m IN (9, 10) THEN 'data_receipt.v1' ELSE 'royalty_receipt.v1' END, count(*) FROM d WHERE m > 1 GROUP BY 2
        UNION ALL SELECT 'signed', CASE WHEN m > 12 THEN 'yes' ELSE 'no' END, count(*) FROM d WHERE m > 1 GROUP BY 2
        UNION ALL SELECT 'field', unnest(fs), count(*) FROM f GROUP BY 2""",
    "v10_check_tables": f"""WITH {v.REPORTS}, {v.SNAPSHOTS}
        SELECT 'reports' AS table_name, (SELECT count(*) FROM reports) AS rows, 'model_id' AS column, true AS present, (SELECT count(*) FROM reports WHERE model_id IS NULL) AS nulls
        UNION ALL SELECT 'reports', (SELECT count(*) FROM reports), 'score', true, (SELECT count(*) FROM reports WHERE score IS NULL)
        UNION ALL SELECT 'reports', (SELECT count(*) FROM reports), 'badge', false, NULL
        UNION ALL SELECT 'snapshots', (SELECT count(*) FROM snapshots), 'target_id', true, 0
        UNION ALL SELECT 'snapshots', (SELECT count(*) FROM snapshots), 'license', true, (SELECT count(*) FROM snapshots WHERE license IS NULL)""",
    "b2_refine_receipts": f"""WITH {v.ENTRIES} SELECT output_id, any_value(order_key % 3 = 0) AS fixed_sum, list(rank::INTEGER ORDER BY rank) AS ranks,
        list(floor(CASE WHEN order_key % 3 = 0 THEN round(share, 8) ELSE share END * 1e6::DOUBLE + 0.5001)::BIGINT ORDER BY rank) AS shares FROM entries GROUP BY 1""",
    "h2_verify_chains": f"""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
        b AS (SELECT 's' || l_suppkey AS key, l_suppkey AS k, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS block FROM c)
        SELECT key, block, CASE WHEN k % 7 = 5 AND block = 2 THEN 'MISSING' WHEN k % 7 = 3 AND block IN (1, 2) THEN 'DIGEST_MISMATCH'
          WHEN k % 7 = 5 AND block = 3 THEN 'DIGEST_MISMATCH' ELSE 'OK' END AS status FROM b""",
    "h3_canonical_hash": f"""WITH {v.PROVIDERS} SELECT provider_id, sha256('{{"eligible":' || eligible || ',"kyc_tier":"' || kyc_tier || '","provider_id":"' || provider_id || '"}}') AS digest
        FROM providers""",
    "h4_verify_artifacts": """
        SELECT 'b' || (doc_id % 50) AS bundle, CASE WHEN doc_id % 11 = 0 THEN '../' ELSE 'f/' END || doc_id AS path,
          CASE WHEN doc_id % 11 = 0 THEN 'OUTSIDE_BUNDLE' WHEN doc_id % 13 = 0 THEN 'MISSING' WHEN doc_id % 7 = 1 THEN 'SIZE_AND_HASH_MISMATCH'
            WHEN doc_id % 7 = 2 THEN CASE WHEN strlen(regexp_replace(text, '^.', '#')) <> strlen(text) THEN 'SIZE_AND_HASH_MISMATCH' ELSE 'HASH_MISMATCH' END
            ELSE 'OK' END AS status FROM documents""",
    "h4_stored_files": f"""WITH {v.REPORTS} SELECT 'bundle=' || replace(model_id, '/', '__') AS bundle, 'artifact' AS path, CASE WHEN part_key % 9 = 0 THEN 'MISSING' WHEN part_key % 35 = 0 THEN 'SIZE_AND_HASH_MISMATCH'
        WHEN part_key % 5 = 0 THEN 'SIZE_MISMATCH' WHEN part_key % 7 = 0 THEN 'HASH_MISMATCH' ELSE 'OK' END AS status FROM reports""",
    "h4_manifest_issues": f"""WITH {v.REPORTS} SELECT model_id AS bundle, CASE WHEN part_key % 7 = 0 THEN ['invalid JSON'] ELSE
        CASE part_key % 5 WHEN 1 THEN ['schema'] WHEN 2 THEN ['contract'] ELSE []::VARCHAR[] END
        || CASE part_key % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['path of hashchain', 'path of trust_bundle'] WHEN 3 THEN ['artifacts']
           ELSE ['missing validate_report', 'missing hashchain', 'missing trust_bundle', 'path of other', 'path of receipts'] END END AS issues FROM reports""",
    "h5_evidence_status": f"""WITH {v.REPORTS}, a AS (SELECT org AS bundle, count(*) FILTER (part_key % 2 = 0) AS artifacts FROM reports GROUP BY 1),
        g AS (SELECT org AS bundle, count(*) FILTER (x.severity >= 0.8) AS severe FROM (SELECT org, unnest(gaps) AS x FROM reports WHERE part_key % 6 = 0) GROUP BY 1)
        SELECT bundle, artifacts, coalesce(severe, 0) AS severe, CASE WHEN artifacts = 0 THEN 'RED' WHEN coalesce(severe, 0) = 0 THEN 'GREEN' ELSE 'YELLOW' END AS status
        FROM a LEFT JOIN g USING (bundle)""",
    "h6_table_parity": """WITH c AS (SELECT count(*) FILTER (s_suppkey % 5 = 0) AS n FROM supplier)
        SELECT 1 AS n_left, 0 AS n_right, n FROM c UNION ALL SELECT 0, 1, n FROM c""",
    "h7_reconcile_ledger": """SELECT 'p/' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'ORPHAN' WHEN doc_id % 8 = 0 THEN 'MISSING' WHEN doc_id % 10 = 1 THEN 'HASH_MISMATCH'
        ELSE 'OK' END AS status FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 8 <> 0""",
    "b9_record_identity": f"""WITH {v.REPORTS} SELECT model_id, 'cidv1:' || sha256('{{"extra":"' || type || '","name":"' || model_id || '","source":"' || org || '","type":"model"}}') AS cid,
        sha256(model_id || '::' || org) AS binding FROM reports""",
}
