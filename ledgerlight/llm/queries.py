"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality, sql
from .common import SPACE, table
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .extraction import extract_text
from .mixing import mix_sources
from .neighbours import nearest
from .pii import BASE, find_pii
from .runs import find_runs
from .secrets import find_secrets
from .simhash import simhash_components
from .substrings import remove_repeats
from .trie import prefix_trie, turn_steps, with_shared_openings


def held_out(remainder: int, parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == remainder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(2, 4)), "text", "lang")
    return langid.identify(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out(1, 3)).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    scored = quality.score_quality(docs, quality.fit(labelled))
    return scored.select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "exact").distinct()


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added", "n_spans"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3.0, seed=42)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _with_periods(docs: DataFrame) -> DataFrame:
    """``documents``, where one in ten repeats a stretch of its words to its end, as the contract of op12 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[^{SPACE}]+"), F.lit(0))
    n, g = F.size("__words").cast("long"), F.floor(F.col("__h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    at = F.sequence(F.lit(0).cast("long"), n - 1)
    changed = F.array_join(F.transform(at, lambda i: F.element_at("__words", (place(i) + 1).cast("int"))), " ")
    rows = docs.select("doc_id", "text", h.alias("__h")).withColumn("__words", F.when(F.col("__h") % 10 == 0, words))
    return rows.select("doc_id", F.when(F.size("__words") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_with_periods(table(spark, sf_dir, "documents")), least=6, exponent=4)
    by_length = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", F.array_min(by_length))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_openings(turn_steps(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op3_quality": op3_quality,
        "op2_secrets": op2_secrets,
        "op4_simhash": op4_simhash,
        "op5_extraction": op5_extraction,
        "op6_decontaminate": op6_decontaminate,
        "op7_pii": op7_pii,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_substrings": op9_substrings,
        "op10_mix_sources": op10_mix_sources,
        "op11_neighbours": op11_neighbours,
        "op12_runs": op12_runs,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": sql.EXACT_DEDUP,
        "op10_mix_sources": sql.MIX_SOURCES,
        "op11_neighbours": sql.NEIGHBOURS,
        "op13_prefix_trie": sql.PREFIX_TRIE,
    }
