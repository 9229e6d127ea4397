"""Conversation prefix trie: counts of every shared opening, summed from the leaves to the root by time-forward processing.

A node is a distinct sequence of first turns. Its key is the exclusive or of two 64-bit hashes of (turn, place) for each turn
of the sequence, so keys are running aggregates, and a parent's key is its child's without the last turn. Nodes are
aggregated before they are shuffled; the root and other common nodes never meet their conversations in one task.

Subtree totals go up in two rounds. Nodes with more than one part in ``SHARDS`` of all conversations are heavy; they are a
connected top of the trie, of at most ``SHARDS`` times the mean number of turns. What hangs below it are shards: each has at
most one part in ``SHARDS`` of the conversations, and they are dealt over all tasks. Nodes of a task are sorted by
reverse level, each takes the messages of its children from a priority queue that spills to disk, and sends its own totals
to its parent. The totals of shard roots are then summed by parent, and the heavy top is worked on in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, shared_table, shuffle_partitions

SHARDS = 512
#: Messages that a queue holds in memory; about 200 bytes each.
QUEUE_MAX = 500_000
#: Bytes of a piece of a node's list of conversations.
PIECE = 1 << 20

KEY = ["depth", "k1", "k2"]


def turn_steps(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Turns in the order of ``order_col`` (null first; ties by role, then text), as digests.

    Returns ``conv_id, place`` (from 1), ``n_own`` (turns of the conversation), ``digest, n_chars``. Null role and text are empty;
    rows without a conversation are left out. Texts are shuffled once, here.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    one = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("place", F.row_number().over(one).cast("long")).select(
        "conv_id", "place", F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"), F.length("text").cast("long").alias("n_chars")
    )
    return rows.withColumn("n_own", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))


def with_shared_openings(steps: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of the conversation at the start of their hundred, h = crc32(id) % ``most``.

    Returns ``conv_id, depth`` (from 1), ``digest, n_chars, last`` (the conversation ends here), and for every conversation one row of
    depth 0 with null digest. Openings are bounded, so they travel as an array of ``most`` - 1 turns at most.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    opening = F.sort_array(F.collect_list(F.struct("place", "digest", "n_chars")))
    bases = steps.where((F.col("conv_id") % every == 0) & (F.col("place") < most))
    bases = bases.groupBy(F.col("conv_id").alias("base")).agg(opening.alias("opening"))
    convs = steps.where("place = 1").select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    none = F.expr("cast(array() as array<struct<place: long, digest: binary, n_chars: long>>)")
    convs = convs.join(bases, "base", "left").select("conv_id", "n_own", "h", F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")).alias("opening"))
    convs = convs.withColumn("n_opening", F.size("opening").cast("long"))
    convs = convs.withColumn("n_all", F.col("n_opening") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    root = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars")))
    heads = convs.select("conv_id", "n_all", F.explode(F.concat(root, "opening")).alias("t"))
    heads = heads.select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.n_chars", (F.col("t.place") == F.col("n_all")).alias("last"))
    own = steps.where(F.col("place") > h).join(convs.select("conv_id", "h", "n_opening", "n_all"), "conv_id")
    depth = F.col("n_opening") + F.col("place") - F.col("h")
    return heads.unionByName(own.select("conv_id", depth.alias("depth"), "digest", "n_chars", (depth == F.col("n_all")).alias("last")))


class SpillingQueue:
    """A priority queue whose largest part lies in sorted files of the task's own temporary folder."""

    def __init__(self, most: int = QUEUE_MAX):
        self.most, self.heap, self.runs, self.count = most, [], [], 0

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.most:
            self._spill()
        heapq.heappush(self.heap, item)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # has no name, so nothing is left behind
        self.heap.sort()
        for k in range(0, len(self.heap), 10_000):
            pickle.dump(self.heap[k : k + 10_000], file)
        file.seek(0)
        self.heap = []
        self._advance(self._items(file))

    @staticmethod
    def _items(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    def _advance(self, items: Iterator[tuple]) -> None:
        if (head := next(items, None)) is not None:
            self.count += 1
            heapq.heappush(self.runs, (head, self.count, items))

    def pop(self, upto: tuple) -> tuple | None:
        """The least item if it starts with ``upto``."""
        spilled = self.runs and (not self.heap or self.runs[0][0] < self.heap[0])
        least = self.runs[0][0] if spilled else self.heap[0] if self.heap else None
        if least is None or least[: len(upto)] != upto:
            return None
        if spilled:
            self._advance(heapq.heappop(self.runs)[2])
            return least
        return heapq.heappop(self.heap)


_TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _forward(queue_max: int):
    """Totals of nodes that arrive by reverse level; ``n_children, n_leaves, saved_tokens`` hold what came from other shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(queue_max)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "p1", "p2", "n_convs", "n_chars", "top", *_TOTALS)]
            out = [[] for _ in _TOTALS]
            for depth, k1, k2, p1, p2, n_convs, n_chars, top, children, leaves, saved in zip(*columns, strict=True):
                own = (-depth, k1, k2)
                while (message := queue.pop(own)) is not None:
                    children += 1
                    leaves += message[3]
                    saved += message[4]
                leaves = leaves if children else 1
                saved += (n_convs - 1) * n_chars
                if not top:
                    queue.push((1 - depth, p1, p2, leaves, saved))
                for column, value in zip(out, (children, leaves, saved), strict=True):
                    column.append(value)
            names = [c for c in batch.schema.names if c not in _TOTALS]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(c, pa.int64()) for c in out]], [*names, *_TOTALS]
            )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one node become one piece: its conversations joined by commas."""
    at, ids, size, first = None, [], 0, 0
    names = [*KEY, "first", "piece"]

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows, total = [], 0
    for batch in batches:
        for *key, conv in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv_id")], strict=True):
            if key != at or size > PIECE:
                if at is not None:
                    rows.append((*at, first, ",".join(ids)))
                    total += size
                at, ids, size, first = key, [], 0, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if total > 4 * PIECE or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, total = [], 0
    if at is not None:
        rows.append((*at, first, ",".join(ids)))
    if rows:
        yield batch_of(rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces in their order; one digest is open at a time."""
    at, digest, rows = None, None, []

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "ends_sha256"]
        )

    for batch in batches:
        for *key, piece in zip(*[batch.column(c).to_pylist() for c in (*KEY, "piece")], strict=True):
            if key == at:
                digest.update(b",")
            else:
                if at is not None:
                    rows.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(piece.encode())
        if len(rows) >= 10_000:
            yield batch_of()
            rows = []
    if at is not None:
        rows.append((*at, digest.hexdigest()))
    if rows:
        yield batch_of()


def prefix_trie(steps: DataFrame, shards: int = SHARDS, queue_max: int = QUEUE_MAX) -> DataFrame:
    """The trie of conversations given by ``conv_id, depth, digest, n_chars, last``; every conversation has a row of depth 0.

    Returns one row per node: ``conv_id`` (smallest member; with ``depth`` it names the node and leads to its texts), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    * a conversation without turns is a member of the root alone; equal conversations share all nodes and end together;
    * turns are equal if role and text are, by 128 bits of SHA-256; sequences are equal by 128 bits of their turns' hashes;
    * an empty table has no root;
    * one conversation's turns are one task's work, streamed; a node's conversations are not.
    """
    n = shuffle_partitions(steps)
    h1, h2 = F.xxhash64("digest", "depth"), F.xxhash64(F.lit(1), "digest", "depth")
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumns({"h1": h1, "h2": h2})
    rows = rows.withColumns({"k1": F.bit_xor("h1").over(path), "k2": F.bit_xor("h2").over(path)})
    rows = shared_table(rows.select(
        "conv_id", *KEY, F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "n_chars", "last"
    ))
    stats = shared_table(rows.groupBy(*KEY).agg(F.min("conv_id").alias("node_conv"), F.count(F.lit(1)).alias("n_convs")))

    total = F.broadcast(stats.where("depth = 0").agg(F.max("n_convs").alias("__total")))  # one row
    joined = join_groups(rows.select("conv_id", *KEY, "p1", "p2", "n_chars"), stats, KEY, "n_convs").crossJoin(total)
    joined = joined.withColumn("heavy", F.col("n_convs") * shards > F.greatest(F.col("__total"), F.lit(shards)))
    light = F.when(~F.col("heavy"), F.struct("depth", "k1", "k2"))
    line = Window.partitionBy("conv_id").orderBy("depth")
    nodes = joined.withColumns({
        "shard": F.first(light, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "parent_conv_id": F.lag("node_conv").over(line),
    })
    nodes = shared_table(nodes.where("conv_id = node_conv").select(
        "conv_id", *KEY, "p1", "p2", "n_chars", "n_convs", "parent_conv_id", "shard", "heavy",
        ((F.col("depth") == 0) | (F.col("depth") == F.col("shard.depth"))).alias("top"),
    ))

    order = [F.col("depth").desc(), F.col("k1"), F.col("k2")]
    kept = ["conv_id", *KEY, "p1", "p2", "n_chars", "n_convs", "parent_conv_id", "top"]
    schema = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, n_chars long, n_convs long, parent_conv_id long, top boolean, n_children long, n_leaves long, saved_tokens long"
    nothing = {c: F.lit(0).cast("long") for c in _TOTALS}
    below = nodes.where(~F.col("heavy")).withColumns({"__shard": F.xxhash64("shard"), **nothing})
    below = below.repartition(n, "__shard").sortWithinPartitions(*order).select(*kept, *_TOTALS)
    below = shared_table(below.mapInArrow(_forward(queue_max), schema))
    messages = below.where("top AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    above = nodes.where("heavy").join(messages, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in _TOTALS})
    above = above.withColumn("top", F.col("depth") == 0).select(*kept, *_TOTALS)
    above = above.repartition(1).sortWithinPartitions(*order).mapInArrow(_forward(queue_max), schema)  # bounded: see SHARDS

    ends = rows.where("last").select(*KEY, "conv_id")
    pieces = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = pieces.mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, piece string")
    digests = pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first")
    digests = digests.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    return below.unionByName(above).join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *_TOTALS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
