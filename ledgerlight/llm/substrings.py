"""Exact duplicate substrings: sampled suffixes, range-partitioned and sorted by their leading bytes, compared with neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, shared_checkpoint, shared_table, shuffle_partitions

LENGTH = 200
#: Bytes of the leading gram of a sampled suffix.
GRAM = 48
#: Windows under one leading gram that a task sorts at once; the windows of more frequent ones are dealt out singly.
BUCKET_MAX = 100_000
#: Windows that are sorted in one go, and runs sampled for each splitter.
SORT_BLOCK, SAMPLE = 200_000, 100
WHOLE, PART, COPY, EDGE = 0, 1, 2, 3

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_BASE, 1 << i, 1 << 64)) for i in range(7)]
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) | 1 for i in range(256)], np.uint64)


def _gram_hashes(data: bytes) -> np.ndarray:
    """Mixed hash of the GRAM = 32 + 16 bytes from each position on."""
    n = len(data) - GRAM + 1
    part = _TABLE[np.frombuffer(data, np.uint8)]
    for i in range(5):
        step = 1 << i
        part = part[:-step] + part[step:] * _POWERS[i]
        if i == 3:
            half = part
    gram = part[:n] + half[32 : 32 + n] * _POWERS[5]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return gram ^ (gram >> np.uint64(29))


def _leads(data: bytes, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as signed numbers in the order of the bytes."""
    each = np.frombuffer(data, np.uint8)[places[:, None] + np.arange(8)]
    return (np.ascontiguousarray(each).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Windows of ``length`` bytes, as runs of neighbours that share their least gram: the suffix there is kept.

    The least gram of a window depends on its bytes alone, so equal windows, wherever they are, belong to runs of the
    same gram. Returns first and last window start, the suffix's leading bytes, gram hash, and whether the gram repeats in
    these data (then windows of one run may equal each other).
    """
    width = length - GRAM + 1
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = _gram_hashes(data)
    least, step = grams, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(grams) - width + 1
    least = np.minimum(least[:n], least[width - step : width - step + n])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], n) - 1
    names = least[first]
    low = np.flatnonzero(grams <= names.max())
    low = low[np.argsort(grams[low], kind="stable")]
    left, right = (np.searchsorted(grams[low], names, side) for side in ("left", "right"))
    at = low[left]
    repeated = right - left > 1
    for i in np.flatnonzero(repeated & (at < first)).tolist():
        same = low[left[i] : right[i]]
        at[i] = same[np.searchsorted(same, first[i])]
    return first, last, _leads(data, at), names, repeated


def _range(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (rows, in order) that are not above each key; keys and splitters compare column by column."""
    first, last = (np.searchsorted(splitters[:, 0], keys[0], side) for side in ("left", "right"))
    found, tied = last.astype(np.int32), np.flatnonzero(first < last)
    if len(tied):
        both = [np.concatenate([splitters[:, k], key[tied]]) for k, key in enumerate(keys)]
        is_key = np.arange(len(both[0])) >= len(splitters)
        order = np.lexsort((is_key, *both[::-1]))
        below = np.cumsum(~is_key[order])
        found[tied[order[is_key[order]] - len(splitters)]] = below[is_key[order]]
    return found


def _runs_of_rows(length: int, splitters: np.ndarray | None = None):
    names = ["uid", "lead", "gram", "content", "first", "last", "repeated"]
    types = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, bool]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] for _ in names]
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                first, last, leads, grams, repeated = runs(data, length)
                if not len(first):
                    continue
                ends = (last + length).tolist()
                content = [xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(first.tolist(), ends, strict=True)]
                content = np.array(content, np.uint64).view(np.int64)
                values = (np.full(len(first), uid), leads, grams.view(np.int64), content, first, last, repeated)
                for column, value in zip(found, values, strict=True):
                    column.append(value)
            if found[0]:
                columns = [np.concatenate(c).astype(t) for c, t in zip(found, types, strict=True)]
                ranges = np.zeros(len(columns[0]), np.int32) if splitters is None else _range([columns[k] for k in (1, 2, 3, 0)], splitters)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, ranges)], [*names, "range"])

    return run


_RUNS = "uid long, lead long, gram long, content long, first int, last int, repeated boolean, range int"


def sampled_splitters(rows: DataFrame, length: int, n: int) -> np.ndarray:
    """n - 1 splitters (lead, gram, content, uid) from about SAMPLE runs each, chosen by hashes: what they are changes only how
    even the ranges are."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = SAMPLE * n
    share = min(1.0, 4 * wanted * (length - GRAM) / 2 / max(1, size))  # a run for half a window of grams, with room
    texts = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 40)) < round(share * (1 << 40)))
    keys = ("lead", "gram", "content", "uid")
    found = texts.select("uid", "text").mapInArrow(_runs_of_rows(length), _RUNS).select(*keys)
    table = found.orderBy(F.xxhash64(*keys)).limit(wanted).toArrow()  # at most SAMPLE * n rows
    key = [table[c].to_numpy() for c in keys]
    order = np.lexsort(key[::-1])
    at = order[np.arange(1, n) * len(order) // n] if len(order) else order
    return np.stack([k[at] for k in key], axis=1).reshape(-1, 4)


_SORTED = ("lead", "gram", "content", "uid", "first", "last", "repeated")
_LABELLED = "kind int, size int, several boolean, lead long, gram long, content long, uid long, first int, last int, repeated boolean"


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs sorted by (lead, gram, content), each compared with its neighbours.

    Equal neighbours are WHOLE: all their windows repeat. Other runs of a gram that has several contents, or that repeats
    in its text, are PART; one of each WHOLE content goes along as a COPY to compare with. One run of the first and of the
    last content of a partition is an EDGE, which the neighbouring partitions decide. State: one run and its count.
    """
    held: dict | None = None  # the first run of the content that is still open
    size, before, opening = 0, False, True

    def out(rows: dict[str, np.ndarray], kind, size, several) -> pa.RecordBatch:
        n = len(rows["uid"])
        head = [np.broadcast_to(np.asarray(x, t), n) for x, t in ((kind, np.int32), (size, np.int32), (several, bool))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*head, *(rows[c] for c in _SORTED))], ["kind", "size", "several", *_SORTED])

    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _SORTED}
        n = len(rows["uid"])
        if not n:
            continue
        new_gram, new = np.zeros(n, bool), np.zeros(n, bool)
        for c in ("lead", "gram", "content"):
            differs = rows[c][1:] != rows[c][:-1]
            new[1:] |= differs
            new[0] |= held is None or rows[c][0] != held[c][0]
            if c != "content":
                new_gram[1:] |= differs
                new_gram[0] |= held is None or rows[c][0] != held[c][0]
        again = np.flatnonzero(~new)
        if len(again):
            yield out({c: v[again] for c, v in rows.items()}, WHOLE, 0, False)
        starts = np.flatnonzero(new)
        if not len(starts):
            size += n
            continue
        # groups that end here: the held one, then all but the last that start here
        heads = {c: v[starts] for c, v in rows.items()}
        sizes = np.diff(np.append(starts, n))
        linked = ~new_gram[starts]  # has the gram of the group before
        if held is not None:
            heads = {c: np.concatenate([held[c], v]) for c, v in heads.items()}
            sizes = np.concatenate([[size + starts[0]], sizes])
            linked = np.concatenate([[before], linked])
        ended = {c: v[:-1] for c, v in heads.items()}
        several = linked[:-1] | linked[1:]
        if len(several):
            repeated, equal = ended["repeated"], sizes[:-1] > 1
            kind = np.where(equal, WHOLE, np.where(several | repeated, PART, -1))
            copy = equal & several
            if opening:
                kind[0], copy[0], opening = EDGE, False, False
            for chosen, kinds in ((kind >= 0, kind), (copy, np.full(len(kind), COPY))):
                if chosen.any():
                    yield out({c: v[chosen] for c, v in ended.items()}, kinds[chosen], sizes[:-1][chosen], several[chosen])
        held, size, before = {c: v[-1:] for c, v in heads.items()}, int(sizes[-1]), bool(linked[-1])
    if held is not None:
        yield out(held, EDGE, size, before)


def label_runs(ranges: DataFrame, keep=lambda df: df) -> DataFrame:
    """Runs that repeat or may repeat in part, from ranges of _SORTED: ``kind, uid, lead, gram, first, last``.

    ``ranges`` has ordered partitions by (leading bytes, gram, content, row), so that even one gram or content may span
    several; each is sorted and neighbours are compared. What two ranges share is decided from their edges, two runs a range.
    ``keep`` may store the labels, which are read twice.
    """
    labels = keep(ranges.sortWithinPartitions("lead", "gram", "content").select(*_SORTED).mapInArrow(_label, _LABELLED))
    edges = labels.where(F.col("kind") == EDGE).drop("kind")
    contents = edges.groupBy("lead", "gram", "content").agg(
        F.sum("size").alias("total"), F.max("several").alias("some"), F.min(F.struct("uid", "first")).alias("one")
    )
    grams = contents.groupBy("lead", "gram").agg((F.max("some") | (F.count(F.lit(1)) > 1)).alias("more"))
    edges = edges.join(contents, ["lead", "gram", "content"]).join(grams, ["lead", "gram"])
    is_copy = F.col("more") & F.struct("uid", "first").eqNullSafe(F.col("one"))
    kinds = F.when(F.col("total") > 1, F.array(F.lit(WHOLE), F.when(is_copy, COPY))).when(
        F.col("more") | F.col("repeated"), F.array(F.lit(PART))
    )
    decided = edges.withColumn("kind", F.explode(F.array_compact(kinds)))
    columns = ("kind", "uid", "lead", "gram", "first", "last")
    return labels.where(F.col("kind") != EDGE).select(*columns).unionByName(decided.select(*columns))


def _cut(length: int):
    """Over (uid, text, runs): the bytes of every run; a text is encoded once."""
    names = ["kind", "uid", "lead", "gram", "large", "first", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for uid, text, runs_ in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for r in runs_:
                    values = (r["kind"], uid, r["lead"], r["gram"], r["large"], r["first"], data[r["first"] : r["last"] + length])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return run


def equal_windows(contents: list[bytes], groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, place) of all windows that equal another window of their group.

    Multikey quicksort, breadth first: windows are ordered by their first eight bytes, then those that tie by the next
    eight, until all differ or whole windows are equal.
    """
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    counts = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contents)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    buffer = np.frombuffer(b"".join(contents), np.uint8)
    word, step = buffer.astype(np.uint64), 1
    while step < 8:  # the number at each place is that of the eight bytes from there on
        word = (word[:-step] << np.uint64(8 * step)) | word[step:]
        step *= 2
    at, group = base[owner] + place, np.asarray(groups)[owner]
    rest = np.arange(len(at))
    for offset in [*range(0, length - 8, 8), length - 8]:
        key = word[at[rest] + offset]
        order = np.lexsort((key, group))
        rest, key, group = rest[order], key[order], group[order]
        new = np.ones(len(rest), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        tied = ~new
        tied[:-1] |= ~new[1:]
        rest, group = rest[tied], np.cumsum(new)[tied]
        if not len(rest):
            break
    return owner[rest], place[rest]


def _compare(length: int):
    """Over contents with the rows of a gram together: sort each gram's windows and compare neighbours in full."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        grams = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
        group = np.cumsum(np.concatenate(([0], (grams[1:] != grams[:-1]).any(1)))) if len(rows) else np.zeros(0, np.int64)
        owner, place = equal_windows([r[5] for r in rows], group, length) if rows else (np.zeros(0, np.int64),) * 2
        part = np.array([r[2] == PART for r in rows], bool)[owner]
        uid, start = (np.array([r[k] for r in rows], np.int64)[owner][part] for k in (3, 4))
        start = start + place[part]
        order = np.lexsort((start, uid))
        uid, start = uid[order], start[order]
        cut = np.flatnonzero((uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        first, last = (np.concatenate(x).astype(np.int64) for x in (([0], cut), (cut - 1, [len(uid) - 1]))) if len(uid) else (uid, uid)
        return pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(start[first]), pa.array(start[last] + length)], ["uid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, open_gram = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lead", "gram", "kind", "uid", "first", "data")), strict=True):
                if size >= SORT_BLOCK and row[:2] != open_gram:
                    yield spans(rows)
                    rows, size = [], 0
                open_gram = row[:2]
                rows.append(row)
                size += len(row[5]) - length + 1
        yield spans(rows)

    return run


def _single_windows(length: int):
    """Each window by itself, under the two halves of its 128-bit digest; ``last`` is negative in what is only to compare with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, uid, first, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "uid", "first", "data")), strict=True):
                n = len(data) - length + 1
                for at in range(0, n, 10_000):
                    places = np.arange(at, min(n, at + 10_000))
                    digests = b"".join(xxhash.xxh3_128_digest(data[j : j + length]) for j in places.tolist())
                    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    start = (first + places).astype(np.int32)
                    values = (halves[:, 0].copy(), halves[:, 1].copy(), np.zeros(len(places), np.int64), np.full(len(places), uid), start,
                              start if kind == PART else np.full(len(places), -1, np.int32), np.zeros(len(places), bool))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["lead", "gram", "content", "uid", "first", "last", "repeated"])

    return run


def _removal(length: int):
    """Over (id, text, spans): merge the spans, drop their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(4)]
            kept_bytes = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = sorted((s["start"], s["end"]) for s in spans.as_py() or ())
                kept, at, removed, count, reach = [], 0, 0, 0, -1
                for start, end in spans:
                    if start > reach:
                        kept.append(data[at:start])
                        count += 1
                        removed += end - start
                    elif end > reach:
                        removed += end - reach
                    reach = at = max(reach, end)
                kept = b"".join(kept) + data[at:]
                kept_bytes.append(kept)
                for column, value in zip(out, (len(data), removed, count, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns, pa.array(kept_bytes, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts elsewhere in the table.

    Sorting every suffix would move about eight times the input. Only the suffixes at the least 48-byte gram of each window
    are kept, about one in 77 bytes, each for the run of windows that it is least for; equal windows have equal least grams.
    Sampled splitters range-partition them by their leading bytes, ranges are sorted, and neighbours are compared, also
    across the boundaries of ranges: runs of windows with one content (leading bytes and two 64-bit hashes agree) repeat as
    a whole. Where contents of one gram differ, their bytes are fetched, their windows sorted by multikey quicksort, and
    neighbours compared in full. The windows of a gram with more than ``bucket_max`` of them are dealt out singly, and
    sorted and compared across boundaries by 128-bit digests.

    Returns one row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes).

    * null and empty texts have no bytes; texts shorter than ``length`` lose nothing; matches never cross rows;
    * rows are told apart by a row number, written once, so repeated and null identifiers are safe; copies of a row lose
      all but their last bytes, as each is the other's repeat; an empty table gives an empty result.
    """
    if length <= GRAM:
        raise ValueError(f"length has to be over {GRAM}")
    n = shuffle_partitions(docs)
    rows = shared_table(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ))
    splitters = sampled_splitters(rows, length, n)
    found = rows.select("uid", "text").mapInArrow(_runs_of_rows(length, splitters), _RUNS)
    labels = label_runs(found.repartitionById(n, "range"), shared_table)
    whole = labels.where(F.col("kind") == WHOLE).select(
        "uid", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("end")
    )

    open_runs = labels.where(F.col("kind") != WHOLE)
    grams = shared_checkpoint(open_runs.groupBy("lead", "gram").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("windows"), F.count(F.lit(1)).alias("runs")
    ))
    open_runs = join_groups(open_runs, grams, ["lead", "gram"], "runs").withColumn("large", F.col("windows") > bucket_max)
    by_text = open_runs.groupBy("uid").agg(F.collect_list(F.struct("kind", "lead", "gram", "large", "first", "last")).alias("runs"))
    texts = rows.repartition(n, "uid")
    contents = texts.join(by_text, "uid").select("uid", "text", "runs").mapInArrow(
        _cut(length), "kind int, uid long, lead long, gram long, large boolean, first long, data binary"
    )
    spans = (
        contents.where(~F.col("large"))
        .repartition(n, "lead", "gram")
        .sortWithinPartitions("lead", "gram")
        .mapInArrow(_compare(length), "uid long, start long, end long")
    )
    spans = whole.unionByName(spans)
    if not grams.where(F.col("windows") > bucket_max).isEmpty():
        singles = contents.where("large").mapInArrow(
            _single_windows(length), "lead long, gram long, content long, uid long, first int, last int, repeated boolean"
        )
        # Spark samples the splitters of digests
        singles = label_runs(singles.repartitionByRange(n, "lead", "gram", "uid")).where((F.col("kind") == WHOLE) & (F.col("last") >= 0))
        spans = spans.unionByName(singles.select(
            "uid", F.col("first").cast("long").alias("start"), (F.col("first") + length).cast("long").alias("end")
        ))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    ids = docs.schema[id_col].dataType.simpleString()
    return (
        texts.join(spans, "uid", "left")
        .select("id", "text", "spans")
        .mapInArrow(_removal(length), f"id {ids}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        .withColumnRenamed("id", id_col)
    )
