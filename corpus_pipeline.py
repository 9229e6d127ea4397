"""A training corpus from ``documents``: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage reads the Parquet table that the stage before it has written, and keeps or drops whole rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import langid
from ledgerlight.llm.common import shared_folder, table, with_row_key
from ledgerlight.llm.decontaminate import without_leaks
from ledgerlight.llm.exact_dedup import exact_dedup
from ledgerlight.llm.mixing import mix_sources
from ledgerlight.llm.simhash import simhash_components

#: Texts whose language is less certain than this are rejected; with four languages a guess has 0.25.
MIN_LANGUAGE_SCORE = 0.4
#: Columns that the last stage adds.
MIXED = ("size", "source_size", "target", "taken")
#: Share of the fingerprints' bits that near duplicates have in common at least, the seeds of the fingerprints, and the
#: positional bytes that near duplicates share in one of them.
NEAR_SIMILARITY, NEAR_SEEDS, NEAR_BYTES = 0.8, (42, 43, 44, 45), 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified. The model learns from the labelled rows of the table.

    Null and empty texts and texts without a letter have no language and go; without a labelled row all go.
    """
    return langid.accepted(docs, langid.fit(docs, "text", "lang"), min_score=MIN_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, one row where identifiers tie; null counts as the empty text."""
    keyed = with_row_key(docs)
    kept = exact_dedup(keyed, id_col="__key", keep="largest").where("kept").select("__key")
    kept = kept.select(F.col("__key.row").alias("__row"))
    return keyed.join(kept, keyed["__key.row"] == kept["__row"], "left_semi").drop("__key")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the row with the smallest doc_id.

    Near duplicates have fingerprints of five-word shingles with a similarity of 0.8 or more: of the 256 bits of four
    fingerprints a fifth differ at most. So many bits can touch every byte, so that no count of shared bytes is guaranteed;
    two bytes of one fingerprint are asked for, which pairs of texts with a similarity of 0.8 miss once in a hundred times,
    closer ones less often. Null and empty texts are copies of one another; where identifiers tie the row that comes first
    in the table stays.
    """
    keyed = with_row_key(docs)
    found = simhash_components(keyed, id_col="__key", words=5, distance=int(64 * len(NEAR_SEEDS) * (1 - NEAR_SIMILARITY)),
                               seeds=NEAR_SEEDS, share=NEAR_BYTES)
    kept = found.where(F.col("__key.row") == F.col("component_id.row")).select(F.col("__key.row").alias("__row"))
    return keyed.join(kept, keyed["__key.row"] == kept["__row"], "left_semi").drop("__key")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage; null and empty texts hold none, an empty benchmark drops nothing."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes words from, with the number of words; texts without words go, a null source is one of its own.

    Rows with one identifier are told apart by their place in the table. Columns that have a name of the result's give way.
    """
    keyed = with_row_key(docs.drop(*MIXED))
    taken = mix_sources(keyed, weights=(5, 2, 1), max_repeat=3.0, seed=42, carry=["__key"]).where("taken > 0")
    taken = taken.select(F.col("__key.row").alias("__row"), *MIXED)
    return keyed.join(taken, keyed["__key.row"] == taken["__row"]).drop(taken["__row"]).drop("__key")


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminated),
    ("mix", mixed),
]

#: SQL expresses neither the language model nor the fingerprints; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; tables between stages go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
