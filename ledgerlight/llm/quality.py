"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit: labelled rows, hashed words, rank of the pairwise interactions, passes.
SAMPLE_ROWS, WORD_BINS, RANK, EPOCHS = 6_000, 1 << 14, 8, 12
#: Structure statistics and the upper ends of the steps they are cut at; each step is one feature.
STATISTICS = {
    "words": (5, 20, 60, 150, 400, 1000, 3000),
    "word_length": (2.5, 3.5, 4.5, 5.5, 7, 9, 12),
    "symbols": (0.01, 0.03, 0.06, 0.1, 0.2, 0.35),
    "digits": (0.001, 0.01, 0.03, 0.08, 0.2),
    "capitals": (0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "line_words": (2, 4, 8, 20, 60),
    "repeated_lines": (0.001, 0.1, 0.2, 0.35, 0.6),
    "repeated_words": (0.2, 0.35, 0.5, 0.65, 0.8),
    "end_marks": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "top_word": (0.03, 0.06, 0.1, 0.2, 0.4),
    "bytes_per_char": (1.001, 1.02, 1.05, 1.1, 1.3, 2),
}
_OFFSETS = {}
_at = WORD_BINS
for _name, _ends in STATISTICS.items():
    _OFFSETS[_name] = _at
    _at += len(_ends) + 1
#: Bins of the metadata, numbers beside the text: each is cut at the powers of two.
METADATA, META_BINS = ("n_chars",), 256
_META = _at
DIMENSIONS = _at + META_BINS
_ENDS = (".", "!", "?", ":", ";", ",")


def statistics(text: str) -> dict[str, float]:
    """Structure of a text."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), len(text)
    counts = Counter(words)
    once = max(1, chars)
    ascii_text = text.encode("ascii", "replace")
    digits = sum(ascii_text.count(d) for d in b"0123456789")
    capitals = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(ascii_text.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n.,?"))
    return {
        "words": n,
        "word_length": sum(map(len, words)) / max(1, n),
        "symbols": symbols / once,
        "digits": digits / once,
        "capitals": capitals / once,
        "line_words": n / max(1, len(lines)),
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "repeated_words": 1 - len(counts) / max(1, n),
        "end_marks": sum(w.endswith(_ENDS) for w in counts) / max(1, len(counts)),
        "top_word": max(counts.values(), default=0) / max(1, n),
        "bytes_per_char": len(text.encode("utf-8", "surrogatepass")) / once,
    }


def features(text: str | None, metadata: Sequence[tuple[str, float | None]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words share a unit length, every statistic and every item of metadata gives one step."""
    text = text or ""
    words = set(text.lower().split())
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % WORD_BINS
    steps = [_OFFSETS[k] + int(np.searchsorted(STATISTICS[k], v)) for k, v in statistics(text).items()]
    for name, number in metadata:
        power = "none" if number is None or not math.isfinite(number) else int(math.log2(1 + max(0.0, number)))
        steps.append(_META + zlib.crc32(f"{name}:{power}".encode()) % META_BINS)
    values = np.full(len(words), 1 / np.sqrt(max(1, len(words))))
    return np.concatenate([hashed, steps]), np.concatenate([values, np.full(len(steps), 0.5)])


def _sums(model: dict, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores by the sum-of-squares identity, linear in the features: sum over pairs of <v_i, v_j> x_i x_j is
    half of (sum v_i x_i)^2 - sum (v_i x_i)^2, per rank."""
    starts = np.searchsorted(row, np.arange(n))
    each = model["v"][index] * value[:, None]
    summed = np.add.reduceat(each, starts)
    score = model["b"] + np.add.reduceat(model["w"][index] * value, starts)
    score = score + 0.5 * (summed**2 - np.add.reduceat(each**2, starts)).sum(1)
    return score, summed


def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(i) for i, _ in rows]
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), sizes)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK,
          rate: float = 0.05, decay: float = 1e-5, seed: int = 42, batch: int = 128) -> dict:
    """AdaGrad on the logistic loss; the same rows give the same model."""
    random = np.random.default_rng(seed)
    model = {"b": 0.0, "w": np.zeros(DIMENSIONS), "v": np.zeros((DIMENSIONS, rank))}
    if not rows:
        return model
    model["v"] = random.normal(0, 0.05, (DIMENSIONS, rank))
    past_b, past_w, past_v = 1e-6, np.full(DIMENSIONS, 1e-6), np.full((DIMENSIONS, rank), 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            index, value, row = _flat([rows[i] for i in chosen])
            score, summed = _sums(model, index, value, row, len(chosen))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[chosen]) / len(chosen)
            model["b"] -= rate * error.sum() / np.sqrt(past_b := past_b + error.sum() ** 2)
            used, back = np.unique(index, return_inverse=True)
            slope = np.bincount(back, error[row] * value, len(used)) + decay * model["w"][used]
            past_w[used] += slope**2
            model["w"][used] -= rate * slope / np.sqrt(past_w[used])
            pair = (error[row] * value)[:, None] * (summed[row] - model["v"][index] * value[:, None])
            slope = np.stack([np.bincount(back, pair[:, k], len(used)) for k in range(rank)], 1) + decay * model["v"][used]
            past_v[used] += slope**2
            model["v"][used] -= rate * slope / np.sqrt(past_v[used])
    return model


def _with_metadata(df: DataFrame, text_col: str, metadata: Sequence[str], *others: Column) -> DataFrame:
    """``text``, the metadata that ``df`` has as ``meta_<name>`` (null where it is no number), and other columns."""
    found = [F.col(c).cast("string").try_cast("double").alias(f"meta_{c}") for c in metadata if c in df.columns]
    return df.select(F.col(text_col).alias("text"), *found, *others)


def _features_of(batch: pa.RecordBatch, at: int, to: int) -> list[tuple[np.ndarray, np.ndarray]]:
    names = [c for c in batch.schema.names if c.startswith("meta_")]
    numbers = [batch.column(c)[at:to].to_pylist() for c in names]
    metadata = zip(*numbers, strict=True) if names else [()] * (to - at)
    return [features(t.as_py(), tuple(zip(names, m, strict=True))) for t, m in zip(batch.column("text")[at:to], metadata, strict=True)]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
        id_col: str = "doc_id", metadata: Sequence[str] = METADATA, **options) -> dict:
    """Fit on at most ``sample_rows`` labelled rows, chosen by a hash of identifier and text: an enforced bound.

    Copies of a text with different identifiers are chosen one by one. Either side of the label gets its share of the rows,
    but a tenth at least where it has them. The executors compute the features of the sample; the driver fits the model from
    them. Rows without a label are left out. Without labelled rows the model scores 0.5.
    """
    # of the document's columns only, so that the choice goes before the join with the labels and whole texts do not move
    hashed = [F.col(c) for c in (id_col, text_col) if c in labelled.columns]
    rows = _with_metadata(labelled.where(F.col(label_col).isNotNull()), text_col, metadata,
                          F.col(label_col).cast("double").alias("label"), F.xxhash64(*hashed).alias("key"))
    side = F.col("label") >= 0.5
    sizes = {r["side"]: r["count"] for r in rows.groupBy(side.alias("side")).count().collect()}
    total, kept = sum(sizes.values()), {}
    for k, n in sorted(sizes.items(), key=lambda x: x[1]):  # the smaller side first, the larger takes what is left
        kept[k] = min(n, sample_rows - sum(kept.values()), max(sample_rows // 10, round(sample_rows * n / total)))
    # a little more than is needed, from which the least keys are taken
    share = {k: min(1.0, (kept[k] + 5 * kept[k] ** 0.5) / n) for k, n in sizes.items()}
    low = {k: F.pmod(F.col("key"), F.lit(1 << 40)) < round(x * (1 << 40)) for k, x in share.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features_of(batch, 0, batch.num_rows)
            index = pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32()))
            value = pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([index, value, batch.column("label"), batch.column("key")], ["index", "value", "label", "key"])

    got = []
    for k, n in kept.items():
        chosen = rows.where((side == k) & low[k]).mapInArrow(run, "index array<int>, value array<float>, label double, key long")
        table = chosen.orderBy(F.pmod(F.col("key"), F.lit(1 << 40)), "key").limit(n).toArrow()
        got += [(i.values.to_numpy(), v.values.to_numpy().astype(float), y) for i, v, y in
                zip(table["index"], table["value"], table["label"].to_pylist(), strict=True)]
    got.sort(key=lambda x: (len(x[0]), x[0].tobytes(), x[2]))
    return train([(i, v) for i, v, _ in got], np.array([y for *_, y in got]), **options)


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                  metadata: Sequence[str] = METADATA) -> DataFrame:
    """``id_col, score`` (0 to 1) for every whole text.

    Only the text and those columns of ``metadata`` that exist are read; what is no number there counts as missing. Null and empty texts are scored as texts without words. Repeated rows give repeated rows;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 64):
                rows = _features_of(batch, at, min(batch.num_rows, at + 64))
                index, value, row = _flat(rows)
                score, _ = _sums(shared.value, index, value, row, len(rows))
                scores.append(1 / (1 + np.exp(-np.clip(score, -30, 30))))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    ids = docs.schema[id_col].dataType.simpleString()
    rows = _with_metadata(docs, text_col, metadata, F.col(id_col).alias("id"))
    return rows.mapInArrow(run, f"id {ids}, score double").withColumnRenamed("id", id_col)
