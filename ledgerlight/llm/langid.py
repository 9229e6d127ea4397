"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the model: labelled documents of each language it is fitted on; words, and n-grams of each length, kept for it,
#: in equal shares for the languages.
LANGUAGE_ROWS, MAX_WORDS, MAX_GRAMS = 2_000, 60_000, 10_000
GRAMS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Letters and digits of other kinds than 0-9; what is no letter is dealt with word by word.
_WORD = re.compile(r"[^\W\d_]+")
JAVA_WORD = r"\p{L}+"
_PLACES = 1 << 40


def _sampled(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, language_rows: int) -> DataFrame:
    """At most ``language_rows`` rows of each language, those with the least hashes of identifier and text."""
    hashed = [F.col(c) for c in (id_col, text_col) if c in labelled.columns]
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(*hashed), F.lit(_PLACES)).alias("key"))
    # a little more than is needed, from which the least keys are taken
    share = F.least(F.lit(1.0), (language_rows + 5 * language_rows**0.5) / F.count(F.lit(1)))
    shares = rows.groupBy("lang").agg(F.ceil(share * _PLACES).alias("below"))  # a row a language
    low = rows.join(F.broadcast(shares), "lang").where(F.col("key") < F.col("below"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return low.withColumn("nth", nth).where(F.col("nth") <= language_rows).select("lang", "text")


def fit(labelled: DataFrame, text_col: str, lang_col: str, language_rows: int = LANGUAGE_ROWS,
        max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, id_col: str = "doc_id") -> dict:
    """Log frequencies per language of words and character n-grams (words padded by a space on both sides).

    Fitted on at most ``language_rows`` labelled documents of each language, chosen by a hash of identifier and text, and
    about ``max_words`` words and ``max_grams`` n-grams of each length, the most frequent ones of each language in equal
    shares: a rare language has as many as a frequent one. The counting runs on the executors, in one pass.
    """
    sample = _sampled(labelled, text_col, lang_col, id_col, language_rows)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({JAVA_WORD})"))).alias("value"))
    words = words.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), F.col("value"), F.lit(" "))

    def cut(k: int):
        places = F.sequence(F.lit(1), F.greatest(F.length("value") + 3 - k, F.lit(1)))
        return F.transform(places, lambda i: F.struct(F.lit(k).alias("size"), F.substr(padded, i, F.lit(k)).alias("value")))

    whole = F.array(F.struct(F.lit(0).alias("size"), F.col("value").alias("value")))
    each = words.select("lang", "n", F.explode(F.concat(whole, *[cut(k) for k in GRAMS])).alias("x"))
    counts = each.groupBy("x.size", "x.value", "lang").agg(F.sum("n").alias("n"))
    # all languages of a value are in one row
    counts = counts.groupBy("size", "value").agg(F.collect_list(F.struct("lang", "n")).alias("langs")).persist()
    try:
        names = counts.select(F.explode("langs.lang").alias("lang")).distinct().collect()
        langs = sorted(r["lang"] for r in names)
        limit = F.when(F.col("size") == 0, max(1, max_words // max(1, len(langs)))).otherwise(max(1, max_grams // max(1, len(langs))))
        ranked = counts.select("size", "value", F.explode("langs").alias("of"))
        nth = F.row_number().over(Window.partitionBy("size", "of.lang").orderBy(F.desc("of.n"), "value"))
        kept = ranked.withColumn("nth", nth).where(F.col("nth") <= limit).select("size", "value").distinct()
        rows = counts.join(kept, ["size", "value"]).orderBy("size", "value").collect()
    finally:
        counts.unpersist()
    at = {lang: i for i, lang in enumerate(langs)}
    names, scores = [], []
    for k in (0, *GRAMS):
        chosen = [r for r in rows if r["size"] == k]
        name = {r["value"]: i for i, r in enumerate(chosen)}
        counted = np.zeros((len(name), len(langs)))
        for r in chosen:
            for x in r["langs"]:
                counted[name[r["value"]], at[x["lang"]]] += x["n"]
        log = np.log((counted + 0.5) / (counted.sum(0) + 0.5 * (len(name) + 1)))
        # relative to the other languages, so that n-grams of different length add up
        scores.append(log - log.mean(1, keepdims=True) if len(langs) else log)
        names.append(name)
    grams, start = [], 0
    for name in names[1:]:
        grams.append({v: start + i for v, i in name.items()})
        start += len(name)
    return {"langs": langs, "words": names[0], "word_scores": scores[0], "grams": dict(zip(GRAMS, grams, strict=True)),
            "gram_scores": np.concatenate(scores[1:])}


def words_of(text: str) -> Counter:
    """How often each word, a row of letters in lower case, is in the text."""
    words = Counter(_WORD.findall(text.lower()))
    for odd in [w for w in words if not w.isalpha()]:
        n = words.pop(odd)
        for word in "".join(c if c.isalpha() else " " for c in odd).split():
            words[word] += n
    return words


def backoff(word: str, grams: dict[int, dict[str, int]]) -> list[int]:
    """Of an unseen word: for every place the longest known n-gram that starts there."""
    g4, g3, g2, g1 = (grams[k].get for k in GRAMS)
    word = f" {word} "
    found = []
    for i in range(len(word) - 1):
        at = g4(word[i : i + 4])
        if at is None and (at := g3(word[i : i + 3])) is None and (at := g2(word[i : i + 2])) is None:
            at = g1(word[i])
        if at is not None:
            found.append(at)
    return found


def predict(text: str | None, model: dict) -> tuple[str, float]:
    """(language, score); ``und`` with score 0 for a text without letters, null or without a model."""
    words = words_of(text or "")
    if not words or not model["langs"]:
        return UNKNOWN, 0.0
    known = model["words"].get
    rows, times, unseen = [], [], []
    for word, n in words.items():
        at = known(word)
        if at is None:
            unseen.append((word, n))
        else:
            rows.append(at)
            times.append(n)
    total = np.array(times, float) @ model["word_scores"][rows] if rows else np.zeros(len(model["langs"]))
    if unseen:
        # an unseen word counts as the mean over its places
        places, weights = [], []
        for word, n in unseen:
            found = backoff(word, model["grams"])
            places += found
            weights += [n / len(found)] * len(found) if found else []
        if places:
            total = total + np.array(weights) @ model["gram_scores"][places]
    best = int(total.argmax())
    # Words of one text depend on each other: the posterior is taken at the square root of the evidence.
    odds = np.exp((total - total[best]) / math.sqrt(sum(words.values())))
    return model["langs"][best], float(1 / odds.sum())


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``id_col, lang_pred, score``.

    Only the text is read. Null texts and texts without a letter (numerals such as a half are none) are ``und`` with score
    0; so is everything when no labelled row existed. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [predict(t.as_py(), shared.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())],
                ["id", "lang_pred", "score"],
            )

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {ids}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Fit on ``labelled`` and identify ``docs``; see ``fit`` and ``identify``."""
    return identify(docs, fit(labelled, text_col, lang_col, id_col=id_col, **bounds), id_col, text_col)


def accepted(docs: DataFrame, model: dict, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with ``min_score`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (predict(t.as_py(), shared.value) for t in batch.column(text_col))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
