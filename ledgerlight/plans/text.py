"""Queries over cards and vectors, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import cards as c
from ..operators import similarity as sim
from ..sources import views as v

def _licensed(s, f):
    return v.cards(s, f).withColumn("license", F.when(F.col("doc_id") % 6 > 0, "mit"))


def _sourced(s, f):
    k = F.col("doc_id")
    tags = F.array(F.concat(F.lit("dataset:org/set"), (k % 5).cast("string")), F.concat(F.lit("base_model:org/b"), (k % 4).cast("string")), F.lit("task:text"))
    config = F.when(k % 3 > 0, F.to_json(F.struct(F.when(k % 3 == 1, "org/parent").otherwise("parent").alias("_name_or_path"), F.when(k % 4 > 0, "gpt2").alias("model_type"))))
    return v.cards(s, f).withColumn("tags", F.when(k % 7 > 0, tags)).withColumn("config", config)


def _truth(s, f):
    """A status per labelled card and element."""
    n = F.col("doc_id") + 2 * F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) + F.col("i")
    rows = v.table(s, f, "labels").select("doc_id", "quality", "toxic", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    return rows.select("doc_id", F.concat(F.lit("NEC#"), F.col("i").cast("string")).alias("nec"), F.when(n % 3 == 0, "PRESENT").when(n % 3 == 1, "PARTIAL").otherwise("ABSENT").alias("status"))


def _omission(s, f):
    k = F.col("key")
    return v.chains(s, f).select("model_id", (F.size("datasets") > 0).alias("has_datasets"), "license", (k % 2 == 0).alias("has_use"), F.when(k % 7 > 0, "2024").alias("created"), F.when(k % 9 > 0, "me").alias("author"))


def _vectors(s, f, name):
    return v.table(s, f, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vec"))


def _matches(s, f):
    return sim.top_m_similar(_vectors(s, f, "query_id").where("query_id % 50 = 0"), _vectors(s, f, "shard_id"), 8)


def _calibrated(s, f):
    """The sharpness is fitted to every vector's matches, not to those of a search's queries, in all steps."""
    matches = stored(sim.top_m_similar(_vectors(s, f, "query_id"), _vectors(s, f, "shard_id"), 8))
    return sim.attribution_shares(matches, sim.calibrate_alpha(matches, 0.35, 5), 5)


def _sketches(s, f):
    return sim.shard_sketch(v.table(s, f, "lineitem").select(F.concat(F.lit("prov_"), F.col("l_suppkey").cast("string")).alias("provider_id"), F.concat(F.lit("shard_"), (F.col("l_partkey") % 50).cast("string")).alias("shard_id")).distinct(), 8)


QUERIES = {
    "n1_card_sections": lambda s, f: c.card_sections(v.cards(s, f)),
    "n2_section_flags": lambda s, f: c.section_flags(_licensed(s, f)),
    "n3_keyword_flags": lambda s, f: c.keyword_flags(v.cards(s, f)),
    "n4_dataset_mentions": lambda s, f: c.dataset_mentions(v.cards(s, f)),
    "n5_front_matter": lambda s, f: c.front_matter(v.cards(s, f)),
    "n6_omission_score": lambda s, f: c.omission_score(_omission(s, f)),
    "n7_nec_mapper": lambda s, f: c.nec_mapper(v.cards(s, f)),
    "n8_nec_audit": lambda s, f: c.nec_audit(c.nec_mapper(v.cards(s, f)), _truth(s, f)),
    "n9_provenance_signals": lambda s, f: c.provenance_signals(_sourced(s, f)),
    "n14_checklist_impact": lambda s, f: c.checklist_impact(c.section_flags(_licensed(s, f))),
    "n15_repo_links": lambda s, f: c.repo_links(v.cards(s, f)),
    "n16_response_affinity": lambda s, f: c.response_affinity(v.table(s, f, "conversations").where("role = 'assistant'")),
    "c1_shard_sketch": lambda s, f: _sketches(s, f).select("provider_id", "shard_id", F.transform("sketch", lambda x: F.round(x, 6)).alias("sketch")),
    "c2_top_m_similar": lambda s, f: _matches(s, f).select("query_id", "rank", "shard_id", F.round("score", 5).alias("score")),
    "c3_attribution_shares": lambda s, f: sim.attribution_shares(_matches(s, f), 8.0, 5).select("query_id", "shard_id", "rank", F.round("share", 5).alias("share")),
    "c4_attribution_receipts": lambda s, f: sim.attribution_receipts(sim.attribution_shares(_matches(s, f), 8.0, 5, epsilon=50.0), 50.0),
    "c5_calibrate_alpha": lambda s, f: _calibrated(s, f).groupBy("rank").agg(F.round(F.avg("share"), 3).alias("mean_share")),
}

_C = f"WITH {v.CARDS}, l AS (SELECT doc_id, card, lower(card) AS low FROM cards)"
_FLAGS = f"""{_C}, k AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN 'mit' END AS license, """ + ", ".join(
    f"regexp_matches(low, '{'|'.join(p)}') AS {n}" for n, p in c.SECTIONS.items()
) + """ FROM l),
fl AS (SELECT *, list_filter([CASE WHEN NOT (training OR dataset) THEN 'Training data' END, CASE WHEN license IS NULL THEN 'License' END, CASE WHEN NOT evaluation THEN 'Evaluation metrics' END,
  CASE WHEN NOT limitations THEN 'Limitations/risks' END, CASE WHEN NOT intended_use THEN 'Intended use' END, CASE WHEN NOT bias THEN 'Bias/fairness analysis' END], lambda x: x IS NOT NULL) AS missing FROM k),
fc AS (SELECT *, ((6 - len(missing)) / 6 * 100)::DOUBLE AS p FROM fl)"""
_SEC = f"""{_C}, ln AS (SELECT doc_id, unnest(string_split(card, E'\\n')) AS line, generate_subscripts(string_split(card, E'\\n'), 1) AS place FROM l),
sx AS (SELECT *, regexp_matches(line, '{c.HEADING}') AS h, sum(regexp_matches(line, '{c.HEADING}')::INTEGER) OVER (PARTITION BY doc_id ORDER BY place)::BIGINT AS section FROM ln),
se AS (SELECT doc_id, section, max(CASE WHEN h THEN trim(regexp_extract(line, '{c.HEADING}', 1)) END) AS heading, count(*) FILTER (NOT h) AS n_lines,
  coalesce(string_agg(line, E'\\n' ORDER BY place) FILTER (NOT h), '') AS body FROM sx GROUP BY 1, 2)"""


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_DETECTED = " UNION ALL ".join(
    f"""SELECT doc_id, '{nec}' AS nec, 4 * coalesce(list_bool_or(list_transform(heads, lambda h: h.chars >= {least} AND ({" OR ".join(f"contains(h.heading, '{x}')" for x in hints)}))), false)::INTEGER
  + 3 * {_has(words)}::INTEGER + 3 * ({" OR ".join("(" + " AND ".join(f"contains(low, '{w}')" for w in g) + ")" for g in groups)})::INTEGER AS tenths FROM hd"""
    for nec, hints, words, groups, least in c.detectors()
)
_NEC = f"""{_SEC}, lh AS (SELECT doc_id, lower(heading) AS heading, arg_max(length(trim(body)), section) AS chars FROM se WHERE heading IS NOT NULL AND n_lines > 0 GROUP BY 1, 2),
hd AS (SELECT l.doc_id, any_value(low) AS low, list({{'heading': heading, 'chars': chars}}) FILTER (heading IS NOT NULL) AS heads FROM l LEFT JOIN lh USING (doc_id) GROUP BY 1),
nt AS ({_DETECTED}),
np AS (SELECT doc_id, nec, (tenths / 10)::DOUBLE AS score, CASE WHEN tenths >= 6 THEN 'PRESENT' WHEN tenths >= 3 THEN 'PARTIAL' ELSE 'ABSENT' END AS status FROM nt)"""


def _around(text: str, found: str) -> str:
    start = f"greatest(1, instr({text}, {found}) - 50)"
    return f"substr(trim(replace(substr({text}, {start}, instr({text}, {found}) + length({found}) + 50 - {start}), E'\\n', ' ')), 1, 200)"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches_sql(patterns) -> str:
    return " UNION ALL ".join(
        f"""SELECT doc_id, card, {i} AS p, unnest(regexp_extract_all(card, '{_quoted(x)}', {g}, 'i')) AS raw, unnest(regexp_extract_all(card, '{_quoted(x)}', 0, 'i')) AS whole,
        generate_subscripts(regexp_extract_all(card, '{_quoted(x)}', 0, 'i'), 1) AS i FROM sr""" for i, (x, g) in enumerate(patterns)
    )


_STRIPPED = r"""regexp_replace(regexp_replace(raw, '^[`"''\[\]]+', ''), '[`"''\[\]]+$', '')"""
_SIGNALS = f"""{_C}, sr AS (SELECT *, CASE WHEN doc_id % 7 > 0 THEN ['dataset:org/set' || (doc_id % 5), 'base_model:org/b' || (doc_id % 4)] ELSE [] END AS tags FROM l),
dm AS (SELECT doc_id, {_STRIPPED} AS value, {_around("card", "whole")} AS context, p, i FROM ({_matches_sql(c.DATASET_SIGNALS)})),
d1 AS (SELECT * FROM dm WHERE length(value) > 2 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY p, i) = 1),
bm AS (SELECT doc_id, {_STRIPPED} AS value, {_around("card", "whole")} AS context FROM ({_matches_sql(c.BASE_SIGNALS)})),
kn AS (SELECT doc_id, low, unnest({list(c.KNOWN_NAMES)}) AS name FROM l)
SELECT doc_id, CASE WHEN starts_with(t, 'dataset:') THEN 'tag' ELSE 'base_model_tag' END AS signal, regexp_replace(t, '^[a-z_]+:', '') AS value, CASE WHEN starts_with(t, 'dataset:') THEN 0.95 ELSE 0.99 END::DOUBLE AS confidence,
  'Tag: ' || t AS context FROM (SELECT doc_id, unnest(tags) AS t FROM sr)
UNION ALL SELECT doc_id, 'readme_dataset', value, CASE WHEN contains(value, '/') THEN 0.8 ELSE 0.6 END, context FROM d1
UNION ALL SELECT doc_id, 'readme_base_model', value, 0.85, context FROM bm WHERE contains(value, '/')
UNION ALL SELECT doc_id, 'known_dataset', name, 0.7, {_around("low", "name")} FROM kn WHERE contains(low, name)
UNION ALL SELECT doc_id, 'training_section', 'present', 1.0, 'Training section found in README' FROM l WHERE regexp_matches(card, '{c.TRAINING_SIGNAL}', 'i')
UNION ALL SELECT doc_id, 'config_base', 'org/parent', 0.9, '_name_or_path: org/parent' FROM l WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'model_type', 'gpt2', 0.5, 'model_type: gpt2' FROM l WHERE doc_id % 3 > 0 AND doc_id % 4 > 0"""
_KNOWN = ", ".join(f"('{n}', '{t}', '{k}')" for n, (t, k) in c.KNOWN_DATASETS.items())
# \\b of DuckDB knows ASCII letters only: other letters become x
_MENTIONS = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(regexp_replace(low, '[^\\P{{L}}a-z]', 'x', 'g'), '{p}', 1)) AS n, 1 AS k FROM l" for p in c.MENTIONS)
_M = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT vec_id AS shard_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT query_id, shard_id, round(list_cosine_similarity(q.v, s.v), 9) AS score FROM q, s),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard_id)::INTEGER AS rank FROM m QUALIFY rank <= 8)"""

SQL = {
    "n1_card_sections": f"{_SEC} SELECT * FROM se",
    "n2_section_flags": f"{_FLAGS} SELECT doc_id, {', '.join(c.SECTIONS)}, missing, floor(p)::INTEGER AS completeness FROM fc",
    "n3_keyword_flags": f"{_C} SELECT doc_id, " + ", ".join("(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + f") AS kw_{n}" for n, ws in c.KEYWORDS.items()) + " FROM l",
    "n4_dataset_mentions": f"""{_C}, kd(dataset, t, lc) AS (VALUES {_KNOWN}), y AS (SELECT doc_id, regexp_extract(unnest(string_split(regexp_extract(card, '(?s)\\A---\\n(.*?)\\n---', 1), E'\\n')), '^\\s*-\\s+(\\S+)', 1) AS n FROM l),
        x AS (SELECT doc_id, n, 0 AS k FROM y WHERE contains(n, '/') OR length(n) > 3 UNION ALL {_MENTIONS}),
        z AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(n)), '[\\s_-]+', '_', 'g'), '^the_', '') AS dataset, k FROM x),
        u AS (SELECT doc_id, dataset, min(k) AS k FROM z WHERE k = 0 OR length(dataset) > 2 GROUP BY 1, 2)
        SELECT doc_id, u.dataset, CASE k WHEN 0 THEN 'yaml_metadata' ELSE 'text_pattern' END AS source, CASE WHEN k = 0 THEN 0.9 WHEN t IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
          CASE WHEN k = 1 THEN coalesce(t, 'unknown') END AS dataset_type, CASE WHEN k = 1 THEN coalesce(lc, 'unknown') END AS license_clarity FROM u LEFT JOIN kd USING (dataset)""",
    "n5_front_matter": """SELECT doc_id, 'license' AS name, [CASE WHEN doc_id % 3 = 0 THEN 'mit' ELSE 'apache-2.0' END] AS values FROM documents
        UNION ALL SELECT doc_id, 'tags', ['base_model:org/b' || (doc_id % 4), 'task:text'] FROM documents""",
    "n6_omission_score": f"""WITH {v.CHAINS}, b AS (SELECT model_id, list_sort(list_filter([CASE WHEN len(datasets) = 0 THEN 'NEC#1' END, CASE WHEN license IS NULL THEN 'NEC#2' END, CASE WHEN key % 2 <> 0 THEN 'NEC#7' END,
          CASE WHEN key % 7 = 0 THEN 'NEC#10' END, CASE WHEN key % 9 = 0 THEN 'NEC#13' END], lambda x: x IS NOT NULL)) AS violations,
          100 - floor(0.15 * (CASE WHEN len(datasets) = 0 THEN 75 ELSE 0 END + CASE WHEN license IS NULL THEN 80 ELSE 0 END + CASE WHEN key % 2 <> 0 THEN 45 ELSE 0 END + CASE WHEN key % 7 = 0 THEN 40 ELSE 0 END
            + CASE WHEN key % 9 = 0 THEN 70 ELSE 0 END))::INTEGER AS score FROM chains)
        SELECT *, CASE WHEN score >= 90 THEN 'GOLD' WHEN score >= 75 THEN 'SILVER' WHEN score >= 60 THEN 'BRONZE' ELSE 'UNVERIFIED' END AS badge,
          substr(sha256(model_id || ':' || score || ':' || array_to_string(violations, ',')), 1, 16) AS evidence FROM b""",
    "n7_nec_mapper": f"{_NEC} SELECT * FROM np",
    "n8_nec_audit": f"""{_NEC}, tn AS (SELECT doc_id, i, (doc_id + 2 * coalesce(quality, 0) + coalesce(toxic, 0) + i) % 3 AS m FROM (SELECT *, unnest(range(1, 21)) AS i FROM labels)),
        tr AS (SELECT doc_id, 'NEC#' || i AS nec, CASE m WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'PARTIAL' ELSE 'ABSENT' END AS truth FROM tn),
        au AS (SELECT doc_id, grouping(doc_id) = 1 AS total, count(*) AS n, count(*) FILTER (status = truth) AS correct, count(*) FILTER (status = 'PRESENT' AND truth = 'ABSENT') AS false_positive,
          count(*) FILTER (status = 'ABSENT' AND truth = 'PRESENT') AS false_negative, round(avg((status = truth)::INTEGER), 6) AS accuracy FROM np JOIN tr USING (doc_id, nec) GROUP BY ROLLUP (doc_id))
        SELECT *, n - correct - false_positive - false_negative AS other FROM au""",
    "n9_provenance_signals": _SIGNALS,
    "n14_checklist_impact": f"{_FLAGS} SELECT count(*) AS cards, count(*) FILTER (len(missing) = 0) AS full, count(*) FILTER (len(missing) BETWEEN 1 AND 5) AS partial, round(avg(floor(p)), 6) AS mean_score, "
    + ", ".join(f"round(avg(floor(p)) + {x / 100}::DOUBLE * sum(100 - floor(p)) / count(*), 6) AS mean_if_{x}" for x in (5, 10, 20)) + " FROM fc",
    "n15_repo_links": "SELECT doc_id, ['acme/eval'] AS links FROM documents WHERE doc_id % 5 = 0",
    "n16_response_affinity": """WITH t AS (SELECT conv_id, unnest(list_distinct(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')), ' +'))) AS token FROM conversations WHERE role = 'assistant'),
        n AS (SELECT conv_id, token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1, 2) SELECT conv_id, round(count(*) FILTER (n >= 2) / count(*), 6) AS affinity, count(*) AS tokens FROM n GROUP BY 1""",
    "c2_top_m_similar": f"{_M} SELECT query_id, rank, shard_id, round(score, 5) AS score FROM t",
    "c3_attribution_shares": f"""{_M}, w AS (SELECT *, exp(8.0 * (score - max(score) OVER (PARTITION BY query_id))) AS w FROM t WHERE rank <= 5), s2 AS (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS s FROM w)
        SELECT query_id, shard_id, rank, round(s * (1 - s) / sum(s * (1 - s)) OVER (PARTITION BY query_id), 5) AS share FROM s2""",
}
