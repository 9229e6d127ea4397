"""Nearest neighbours by cosine: randomly rotated one-bit codes select what is compared in full.

Equal vectors are one class, found before anything is compared, so that a vector that a third of all rows share is coded,
searched and looked for once. A class keeps its ``k`` + 1 smallest identifiers: ties go to smaller ones, so no other can win.

1. *Index.* A bounded sample gives up to ``CELLS`` centres. Every class gets its nearest centre and the code of its difference
   from it: continued by zeros to ``bits`` places, rotated, one sign a place, with two correction scalars (length of the
   difference, inner product of code and difference).
2. *Scan.* Inner products are estimated from packed bits and scalars, queries in blocks against codes in blocks. A query first
   meets the cells nearest to it; the best estimates are compared in full, and the k-th exact score is a bound that the
   true k-th score cannot be under.
3. *Rest.* All cells are scanned but those of which no member can reach the bound (angle to the centre less the cell's
   radius). Whatever may reach the query's bound by estimate and error bound is compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, shared_table, shuffle_partitions

#: Centres and sampled vectors at most; both are on the driver and in every task.
CELLS, SAMPLE = 1024, 8192
#: Vectors a centre, as long as there are fewer than CELLS.
PER_CELL = 2000
#: Codes and queries of a block.
CODES, QUERIES = 50_000, 2_000
#: Standard deviations of an estimate's error: one neighbour in 30,000 is missed.
EPSILON = 4.0
#: Cells that a query meets first, and estimates that are compared in full there.
FIRST_CELLS, FIRST_BEST = 8, 32


def valid(vec: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles; shorter ones are continued by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # else squares may overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows in double precision, components summed from the first to the last."""
    a, b = (x / 2.0 ** np.frexp(np.abs(x).max(axis=1, keepdims=True))[1] for x in (a, b))  # exact: a power of two
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _centres(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Spherical k-means, five rounds."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:n]]
    for _ in range(5):
        cell = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


class _Space:
    """What every task has to know: length of the vectors, rotation, centres."""

    def __init__(self, sample: np.ndarray, cells: int, bits: int, seed: int):
        self.dim = sample.shape[1]
        self.bits = max(bits, -(-self.dim // 8) * 8)
        self.centres = _centres(sample, cells, seed).astype(np.float32)
        # of a vector continued by zeros only the first rows of the rotation matter
        normal = np.random.default_rng(seed).standard_normal((self.bits, self.dim))
        self.rotation = np.linalg.qr(normal)[0].T.astype(np.float32)

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cell, packed code, length of the difference, its inner product with the code, cosine to the centre."""
        near = unit @ self.centres.T
        cell = near.argmax(axis=1)
        rest = unit - self.centres[cell]
        length = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.maximum(length, 1e-12)[:, None]) @ self.rotation
        fit = np.abs(turned).sum(axis=1) / math.sqrt(self.bits)
        return cell, np.packbits(turned > 0, axis=1), length, np.where(length > 1e-6, fit, 1.0), near[np.arange(len(cell)), cell]


def _encode(space: _Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, code, length, fit, near = space.codes(_unit(_padded(batch.column("vec"), space.dim)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array(cell, pa.int32()), pa.array([x.tobytes() for x in code], pa.binary()),
                 *[pa.array(x, pa.float32()) for x in (length, fit, near)]],
                ["uid", "cell", "code", "length", "fit", "near"],
            )

    return run


def _route(space: _Space, radius: np.ndarray, first: bool):
    """Cells of each query: the nearest ones, or all that its bound does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_padded(batch.column("vec"), space.dim)).astype(np.float32)
            near = np.where(radius < 0, -2, np.clip(unit @ space.centres.T, -1, 1))  # an empty cell has no radius
            if first:
                bound = np.full(len(unit), -2.0)
                nearest = np.argpartition(-near, min(FIRST_CELLS, near.shape[1]) - 1, axis=1)[:, :FIRST_CELLS]
                chosen = np.zeros(near.shape, bool)
                np.put_along_axis(chosen, nearest, True, axis=1)
            else:
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                best = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius))
                chosen = best + 1e-5 >= bound[:, None]
            chosen &= near > -2
            row, cell = np.nonzero(chosen)
            kind = pa.list_(pa.float32())
            values = pa.array(unit[row].reshape(-1), pa.float32())
            offsets = pa.array(np.arange(len(row) + 1) * space.dim, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(pa.array(row)), pa.array(cell, pa.int32()), pa.ListArray.from_arrays(offsets, values, type=kind),
                 pa.array(bound[row], pa.float64())],
                ["query", "cell", "unit", "bound"],
            )

    return run


def _scan(space: _Space, first: bool):
    """Pairs of a block of queries and a block of codes of one cell that have to be compared in full."""

    def run(key: tuple, queries: pa.Table, codes: pa.Table) -> pa.Table:
        names, kinds = ["query", "uid", "estimate"], [pa.int64(), pa.int64(), pa.float32()]
        if not queries.num_rows or not codes.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        unit = queries["unit"].combine_chunks().flatten().to_numpy().reshape(-1, space.dim)
        bound = queries["bound"].to_numpy().astype(np.float32)[:, None]
        centre = unit @ space.centres[key[0].as_py()]
        turned = unit @ space.rotation
        query, uid = queries["query"].to_numpy(), codes["uid"].to_numpy()
        length, fit = codes["length"].to_numpy(), codes["fit"].to_numpy()
        packed = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(uid), -1)
        error = EPSILON * length * np.sqrt(np.maximum(0, 1 - fit * fit) / max(1, space.bits - 1)) / fit + 1e-4
        found, best = [], None
        for at in range(0, len(uid), 2048):
            part = slice(at, at + 2048)
            signs = np.unpackbits(packed[part], axis=1, count=space.bits).astype(np.float32) * 2 - 1
            estimate = (turned @ signs.T) * (length[part] / (fit[part] * math.sqrt(space.bits))) + centre[:, None]
            if first:  # the best estimates so far
                both = estimate if best is None else np.concatenate([best[0], estimate], axis=1)
                ids = np.broadcast_to(uid[part], estimate.shape)
                ids = ids if best is None else np.concatenate([best[1], ids], axis=1)
                top = np.argpartition(-both, min(FIRST_BEST, both.shape[1]) - 1, axis=1)[:, :FIRST_BEST]
                best = np.take_along_axis(both, top, axis=1), np.take_along_axis(ids, top, axis=1)
            else:
                row, col = np.nonzero(estimate + error[part] >= bound)
                found.append((query[row], uid[at + col], estimate[row, col]))
        if first:
            found.append((np.repeat(query, best[1].shape[1]), best[1].reshape(-1), best[0].reshape(-1)))
        return pa.table([pa.array(np.concatenate(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return run


def _score(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = cosine(_padded(batch.column("query_vec"), dim), _padded(batch.column("vec"), dim))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query"), batch.column("uid"), batch.column("members"), pa.array(score, pa.float64())],
                    ["query", "uid", "members", "score"],
                )

    return run


def _in_full(pairs: DataFrame, classes: DataFrame, dim: int) -> DataFrame:
    """Exact cosines of pairs of classes: ``query, uid, members, score``."""
    asked = classes.where("n_asking > 0").select(F.col("uid").alias("query"), F.col("vec").alias("query_vec"))
    rows = pairs.join(classes.select("uid", "vec", "members"), "uid").join(asked, "query")
    return rows.select("query", "uid", "members", "vec", "query_vec").mapInArrow(
        _score(dim), "query long, uid long, members array<long>, score double"
    )


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: ``uid`` (smallest identifier), ``k1, k2`` (hashes), ``vec``, ``members`` (the ``k`` + 1 smallest)."""
    least = Window.partitionBy("k1", "k2").orderBy("id")
    rows = vectors.withColumn("place", F.dense_rank().over(least)).where(F.col("place") <= k + 1)  # limited before the shuffle
    grouped = rows.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("members"))
    return grouped.withColumn("uid", F.col("members")[0])


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, bits: int = 512,
            seed: int = 42) -> DataFrame:
    """The ``k`` rows nearest to each row that satisfies ``queries``, by cosine, among all rows but its own.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``: ties go to the smaller identifier, the score is the cosine of the
    original vectors in double precision. Fewer rows than ``k`` give fewer ranks.

    * vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null identifiers;
    * a vector that is shorter than others counts as continued by zeros;
    * rows with one identifier are one row to one another (none is the other's neighbour); copies of a vector under other
      identifiers are neighbours with score 1;
    * an empty table, or one without a query, gives an empty result.
    """
    n = shuffle_partitions(vectors)
    rows = vectors.where(valid(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    asking = shared_table(rows.where("asks").select("id", "k1", "k2").distinct())
    asked = asking.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_asking"))
    classes = shared_table(_classes(rows, k).join(asked, ["k1", "k2"], "left"))

    many, dim = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    most = max(1, min(SAMPLE, (1 << 26) // dim))  # half a GB of doubles at most
    sample = classes.select("uid", "vec").orderBy(F.xxhash64("uid"), "uid").limit(most).toArrow()["vec"].combine_chunks()
    sample = _unit(_padded(sample, dim)) if len(sample) else np.eye(1, dim)
    space = _Space(sample, min(CELLS, max(1, many // PER_CELL)), bits, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(space)  # rotation and centres: dim x (bits + CELLS) floats

    def on_space(make, *args):
        return lambda batches: make(shared.value, *args)(batches)

    index = shared_table(classes.select("uid", "vec").mapInArrow(
        on_space(_encode), "uid long, cell int, code binary, length float, fit float, near float"
    ))
    cells = len(space.centres)
    radius, blocks = np.full(cells, -1.0), [1] * cells
    for cell, near, size in index.groupBy("cell").agg(F.min("near"), F.count(F.lit(1))).collect():  # a row a cell
        radius[cell] = math.acos(max(-1.0, min(1.0, near))) + 1e-4
        blocks[cell] = -(-size // CODES)
    blocks = F.array(*[F.lit(b) for b in blocks])
    codes = index.withColumn("block", F.pmod(F.xxhash64("uid"), blocks[F.col("cell")]).cast("int"))

    def compared(asking: DataFrame, first: bool) -> DataFrame:
        routes = shared_table(asking.mapInArrow(
            on_space(_route, radius, first), "query long, cell int, unit array<float>, bound double"
        ))
        by_cell = F.broadcast(routes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")))  # a row a cell
        left = routes.join(by_cell, "cell").withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks[F.col("cell")] - 1).cast("int"))))
        right = codes.join(by_cell, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["cell", "block", "part"]
        pairs = left.select(*keys, "query", "unit", "bound").groupBy(*keys).cogroup(
            right.select(*keys, "uid", "code", "length", "fit").groupBy(*keys)
        ).applyInArrow(lambda key, a, b: _scan(shared.value, first)(key, a, b), "query long, uid long, estimate float")
        pairs = pairs.where("query <> uid")
        if first:
            by_estimate = Window.partitionBy("query").orderBy(F.col("estimate").desc(), "uid")
            pairs = pairs.withColumn("place", F.row_number().over(by_estimate)).where(F.col("place") <= FIRST_BEST)
        return _in_full(pairs, classes, dim)

    asking_classes = classes.where("n_asking > 0").select("uid", "vec", "members")
    head = shared_table(compared(asking_classes, True))
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "uid")
    bounds = head.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k).select(F.col("query").alias("uid"), "score")
    bounded = asking_classes.join(bounds, "uid", "left").select("uid", "vec", F.coalesce(F.col("score") - 1e-6, F.lit(-2.0)).alias("bound"))
    others = compared(bounded, False)
    own = _in_full(asking_classes.select(F.col("uid").alias("query"), "uid"), classes, dim)
    # of classes with one score the smallest members come first, so the k + 1 best rows are in the k + 1 best classes
    found = others.unionByName(own).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    found = found.select("query", "score", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    lists = classes.where("n_asking > 0").select("k1", "k2", "n_asking", F.col("uid").alias("query")).join(lists, "query")
    answers = join_groups(asking, shared_table(lists.select("k1", "k2", "n_asking", "best")), ["k1", "k2"], "n_asking")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    answers = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
