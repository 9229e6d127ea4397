"""Near-duplicate documents: SimHash fingerprints and a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_groups, shared_checkpoint, shuffle_partitions
from .components import components

SEED = 42
BYTES, BITS = 8, 64
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose bits are counted at a time, and fingerprints of one posting compared in one task.
BLOCK, POSTING_MAX = 1 << 15, 20_000
#: Rows of postings whose pairs are compared at once.
PAIRED = 24
#: Tasks over which the rows of each long posting are dealt.
SALTS = 64


def fingerprints(text: str | None, words: int = 4, seeds: Sequence[int] = (SEED,)) -> list[int]:
    """64-bit SimHashes, one a seed, of the word shingles of ``text`` (A-Z lowered); 0 without words.

    A bit is 1 where more than half of the shingles' hashes have it. Whole texts, repeats included. The first seed's hash is
    XXH64; those of further seeds are mixed from it, so a shingle is hashed once.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return [0] * len(seeds)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(words, len(tokens)) - 1
    starts, ends = starts[: len(tokens) - reach], ends[reach:]
    ones = np.zeros((len(seeds), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        cut = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        first = np.array([digest(line[a:z], seeds[0]) for a, z in cut], np.uint64)
        for k, seed in enumerate(seeds):
            hashes = _mixed(first, seed) if k else first
            ones[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int(np.packbits(one * 2 > len(starts), bitorder="little").view(np.int64)[0]) for one in ones]


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same values: the finishing steps of SplitMix64 after adding multiples of its constant."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forest(links: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The links that join parts not joined before: as many as nodes at most, the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def _close(rows: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Which columns of ``rows`` (a fingerprint a row, a node a column) differ from ``at`` in few enough bits."""
    differing = np.bitwise_count(np.ascontiguousarray(rows).view(np.uint64) ^ at.view(np.uint64))
    return differing.sum(0, dtype=np.int64) <= distance


def _walk(ids: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one posting: every node is reached once."""
    while len(ids):
        queue, ids, prints = [(ids[0], prints[:, :1])], ids[1:], prints[:, 1:]
        while queue and len(ids):
            node, at = queue.pop()
            near = _close(prints, at, distance)
            found = np.flatnonzero(near)
            queue.extend((ids[i], prints[:, i : i + 1]) for i in found)
            yield from ((int(node), int(ids[i])) for i in found)
            ids, prints = ids[~near], prints[:, ~near]


def _posting_links(columns: int, distance: int, posting_max: int):
    """Over rows sorted by (code, key): links inside each posting; a posting over ``posting_max`` gives its key instead."""

    def emit(links: list, long: list) -> pa.RecordBatch:
        kept = list(_forest(links))
        a = [x for x, _ in kept] + [k for k, _ in long]
        b = [y for _, y in kept] + [m for _, m in long]
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([False] * len(kept) + [True] * len(long), pa.bool_())],
            ["a", "b", "long"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((columns, 0), np.int64)]  # the rows of the posting that is still open
        size = 0
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
            if not rows.shape[1]:
                continue
            links, long = [], []
            head = next((h for h in held if h.shape[1]), None)
            new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            joins = head is not None and (rows[:2, 0] == head[:2, -1]).all()
            first = (new[0] if len(new) else rows.shape[1]) if joins else 0
            if first:
                size += first
                held.append(rows[:, :first] if size <= posting_max else rows[:, :1])
            if first < rows.shape[1]:  # the open posting has ended
                _posting(held, size, links, long, distance, posting_max)
                last = new[-1] if len(new) else 0
                last = max(last, first)
                _short(rows[:, first:last], links, long, distance, posting_max)
                held, size = [rows[:, last:]], rows.shape[1] - last
            if links or long:
                yield emit(links, long)
        links, long = [], []
        _posting(held, size, links, long, distance, posting_max)
        yield emit(links, long)

    return run


def _prints(rows: np.ndarray) -> np.ndarray:
    """The fingerprints of index rows: after the node, or the node itself."""
    return np.ascontiguousarray(rows[3:] if len(rows) > 3 else rows[2:])


def _posting(held: list, size: int, links: list, long: list, distance: int, posting_max: int) -> None:
    if size > posting_max:
        head = next(h for h in held if h.shape[1])
        long.append((int(head[1, 0]), int(head[0, 0])))
    elif size > 1:
        rows = np.concatenate(held, axis=1)
        links.extend(_walk(rows[2], _prints(rows), distance))


def _short(rows: np.ndarray, links: list, long: list, distance: int, posting_max: int) -> None:
    """All whole postings of a batch: those of up to PAIRED rows at once, neighbours by neighbours, longer ones one by one."""
    if rows.shape[1] < 2:
        return
    new = np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, rows.shape[1]))
    left = np.repeat(np.where(sizes <= PAIRED, starts + sizes, 0), sizes) - np.arange(rows.shape[1])  # rows to the posting's end
    prints = _prints(rows)
    for step in range(1, PAIRED):
        at = np.flatnonzero(left > step)
        if not len(at):
            break
        near = at[_close(prints[:, at], np.ascontiguousarray(prints[:, at + step]), distance)]
        links.extend(zip(rows[2, near].tolist(), rows[2, near + step].tolist(), strict=True))
    for start, size in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
        _posting([rows[:, start : start + size]], size, links, long, distance, posting_max)


def fingerprint_links(nodes: DataFrame, distance: int = 4, posting_max: int = POSTING_MAX, prints: Sequence[str] = ("fp",),
                      node: str = "fp", share: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes whose fingerprints differ in ``distance`` bits or fewer, all ``prints`` together.

    Nodes share ``share`` positional bytes of one fingerprint at least; for one fingerprint the guaranteed count is
    8 - distance, and then no link is lost. Over several fingerprints a distance may touch every byte; then ``share``
    decides which links are found (see the pipeline's near-dedup stage). Postings of single bytes grow with the square of the corpus when pairs are
    tallied over them, so the index holds the intersections of ``share`` postings (of 4: the 70 choices of 4 byte
    positions). Sharing one of them is the same as reaching the count; each pair found there is then verified. Of a
    dense posting only a spanning forest of links is given. Postings over ``posting_max`` are cut into blocks, and every
    pair of blocks is compared in a task of its own.
    """
    share = max(1, BYTES - distance) if share is None else share
    masks = [sum(0xFF << 8 * p for p in ps) for ps in combinations(range(BYTES), share)]
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    columns = ["code", "key", node, *[p for p in prints if p != node]]
    each = [
        F.struct(F.lit(i * len(masks) + j).cast("long").alias("code"), F.col(p).bitwiseAND(F.lit(m)).alias("key"))
        for i, p in enumerate(prints) for j, m in enumerate(masks)
    ]
    index = nodes.select(*columns[2:], F.explode(F.array(*each)).alias("at")).select("at.*", *columns[2:])
    n = shuffle_partitions(nodes)
    found = (
        index.repartition(n, "code", "key")
        .sortWithinPartitions("code", "key")
        .mapInArrow(_posting_links(len(columns), distance, posting_max), "a long, b long, long boolean")
    )
    found = shared_checkpoint(found)
    links = found.where(~F.col("long")).select("a", "b")
    long = found.where("long").select(F.col("a").alias("key"), F.col("b").alias("code"))
    if long.isEmpty():
        return links
    # rows of a long posting are dealt over SALTS tasks before they meet it, and counted where they are
    salted = index.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int"))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sizes = salted.join(spread(long.distinct()), ["code", "key", "salt"]).groupBy("code", "key").count()
    sizes = sizes.select("code", "key", F.ceil(F.col("count") / posting_max).cast("int").alias("blocks"))
    rows = salted.join(spread(shared_checkpoint(sizes)), ["code", "key", "salt"]).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select(*columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(group):
        table = np.stack([group[c].to_numpy() for c in columns])
        here = group["block"].to_numpy() == group["i"].to_numpy()
        left, right = table[:, here], table[:, ~here]
        left, right = left[:, np.argsort(left[2])], right[:, np.argsort(right[2])]
        if not right.shape[1]:
            pairs = list(_walk(left[2], _prints(left), distance))
        else:
            theirs = _prints(right)
            pairs = list(_forest((int(x), int(y)) for x, at in zip(left[2], _prints(left).T, strict=True)
                                 for y in right[2, _close(theirs, np.ascontiguousarray(at)[:, None], distance)]))
        import pandas as pd

        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return links.unionByName(rows.groupBy("code", "key", "i", "j").applyInPandas(compare, "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4,
                       seeds: Sequence[int] = (SEED,), share: int | None = None) -> DataFrame:
    """Fingerprint of each document and the component of near duplicates it belongs to.

    Copies with the same fingerprints become one node before the index is built, so groups of copies cost a row each.
    ``distance`` is over all fingerprints of a document, one a seed; ``share`` as in ``fingerprint_links``.

    Returns one row per input row: ``id_col, fingerprint`` (LONG, of the first seed), ``component_id`` (the smallest
    identifier that can be reached over links, the row's own included).

    * null and empty texts have fingerprint 0, which links like any other;
    * null identifiers are ignored in ``component_id``; it is null only if all identifiers of a component are;
    * repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    fps = [f"fp{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprints(t.as_py(), words, seeds) for t in batch.column("text")], np.int64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x) for x in found.T]], ["id", *fps])

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = shared_checkpoint(rows.mapInArrow(run, f"id {ids}, {', '.join(f'{x} long' for x in fps)}"))
    nodes = rows.groupBy(*fps).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    if len(fps) == 1:
        node = "fp0"
    else:  # numbered once, in a table that is read again
        node, nodes = "node", shared_checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    links = fingerprint_links(nodes.select(*{node: 0, **dict.fromkeys(fps)}), distance, prints=fps, node=node, share=share)
    roots = shared_checkpoint(components(links)).withColumnRenamed("node", "of")
    nodes = nodes.join(roots, F.col(node) == F.col("of"), "left")
    nodes = shared_checkpoint(nodes.select(*fps, "least", "copies", F.coalesce("root", node).alias("root")))
    groups = shared_checkpoint(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    nodes = shared_checkpoint(join_groups(nodes, groups, "root", "prints").select(*fps, "copies", "component_id"))
    found = join_groups(rows, nodes, fps, "copies")
    return found.select(F.col("id").alias(id_col), F.col("fp0").alias("fingerprint"), "component_id")
