"""Periodic runs of words: Lyndon roots under both orders of the words, extended to both sides.

Texts are independent, so the work is one pass over the rows without a shuffle; a task holds the words of some rows at a
time. Within it three steps lead from words to runs:

1. ``_stretches``: a run of exponent 4 holds each of its word triples three times at equal distances. Stretches of a text
   that cannot satisfy this are left out; what remains is cut again until nothing changes. No run is lost.
2. ``lyndon_lengths``: the grouping phase of Baier's suffix sorter puts suffixes into groups by their longest Lyndon
   prefix. It is run once for the words' order and once for the reverse: every run has a Lyndon root under one of them
   that is the longest Lyndon word at its place.
3. ``_extended``: roots are extended to the right and left by longest common extensions (hashes of prefixes, binary
   search), and every run found is then compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WORD = re.compile(rf"[^{SPACE}]+")
#: Words that are worked on at a time; a longer text is worked on by itself.
BLOCK_WORDS = 500_000


def lyndon_lengths(word: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; symbols are integers from 0, the end is the least.

    Groups are worked on from the highest down. The places of a group look for the nearest place before them whose group is
    lower; those places move behind the rest of their own group, the further back the more places look at them, and
    their prefix grows by the prefixes that follow it.
    """
    n = len(word)
    at = np.argsort(np.asarray(word, np.int64), kind="stable").tolist()
    place = [0] * n  # of each suffix in ``at``
    group = [0] * n  # first slot of its group
    size, length = [0] * n, [1] * n  # by first slot
    last, first = None, 0
    for slot, i in enumerate(at):
        if word[i] != last:
            last, first = word[i], slot
        place[i] = slot
        group[i] = first
        size[first] += 1
    before = [-1] * n
    out = [0] * n
    high = n
    while high:
        low = group[at[high - 1]]
        members = at[low:high]
        if high - low > 1:
            members.sort()
        k = length[low]
        looked: dict[int, int] = {}
        for i in members:
            out[i] = k
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                looked[j] = looked.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, times in looked.items():
            by_times.setdefault(times, []).append(j)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_times[times]:
                g = group[j]
                size[g] -= 1
                end, slot = g + size[g], place[j]
                other = at[end]
                at[slot], at[end] = other, j
                place[other], place[j] = slot, end
                moved.setdefault(g, []).append(j)
            for g, places in moved.items():
                new = g + size[g]
                size[new], length[new] = len(places), length[g] + times * k
                for j in places:
                    group[j] = new
        high = low
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _stretches(codes: np.ndarray, part: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that a run can cover, ascending, and the stretch of each.

    A run of period q in a stretch of s words has q <= s / exponent, and each triple of it occurs ``times`` times in it, q
    apart. Triples without so many occurrences close together bound the stretches; hashes that collide only keep more.
    """
    at = np.arange(len(codes))
    times = min(exponent - 1, max(least, exponent) - 2)
    for _ in range(30):
        n = len(at)
        if n < 3:
            return at[:0], part[:0]
        c = codes[at].astype(np.uint64)
        whole = part[2:] == part[:-2]
        key = _mix(_mix(_mix(c[:-2]) + c[1:-1]) + c[2:]) ^ _mix(part[:-2])
        length = np.bincount(part)
        order = np.flatnonzero(whole)
        order = order[np.argsort(key[order], kind="stable")]
        good = np.zeros(n - 2, bool)
        if times <= 1:
            good[order] = True
        elif len(order) >= times:
            head, tail = order[: len(order) - times + 1], order[times - 1 :]
            near = (key[head] == key[tail]) & (part[head] == part[tail])
            near &= (tail - head) <= (times - 1) * (length[part[head]] // exponent)
            for k in range(times):
                good[order[k : len(order) - times + 1 + k][near]] = True
        keep = np.zeros(n, bool)
        for k in range(3):
            keep[k : n - 2 + k] |= good
        index = np.flatnonzero(keep)
        if not len(index):
            return at[:0], part[:0]
        new = np.concatenate([[0], np.cumsum((np.diff(index) > 1) | (np.diff(part[index]) != 0))])
        long = np.bincount(new)[new] >= max(least, exponent)
        index, new = index[long], new[long]
        if not len(index):
            return at[:0], part[:0]
        at, part = at[index], np.unique(new, return_inverse=True)[1]
        if len(at) > 0.95 * n:
            break
    return at, part


def _common(hashes: np.ndarray, powers: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix at ``a`` and ``b`` (``a`` before ``b``), ``most`` at most, by hashes of prefixes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = (hashes[a + mid] - hashes[a]) * powers[b - a] == hashes[b + mid] - hashes[b]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def _hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        powers = np.full(len(values) + 1, 0xD1342543DE82EF95, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])]), powers


def _true_run(w: np.ndarray, first: int, end: int, root: int, p: int) -> tuple[int, int]:
    """The run of period ``p`` through ``root`` within [first, end), compared word by word."""
    different = np.flatnonzero(w[first : end - p] != w[first + p : end]) + first
    k = np.searchsorted(different, root)
    start = different[k - 1] + 1 if k else first
    stop = (different[k] + p) if k < len(different) else end
    return int(start), int(stop)


def _extended(w: np.ndarray, part: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(stretch, start, end, period) of every run, by Lyndon roots; ``w``: words, ``part``: the stretch of each, in order."""
    n = len(w)
    first = np.searchsorted(part, np.arange(part[-1] + 1))
    end = np.append(first[1:], n)
    roots, periods = [], []
    for s, e in zip(first.tolist(), end.tolist(), strict=True):
        symbols, rank = np.unique(w[s:e], return_inverse=True)
        for ranks in (rank, len(symbols) - 1 - rank):
            p = np.asarray(lyndon_lengths(ranks.tolist()))
            i = np.flatnonzero(exponent * p <= e - s)
            i = i[i + p[i] < e - s]
            i = i[w[s + i] == w[s + i + p[i]]]
            roots.append(s + i)
            periods.append(p[i])
    i, p = np.concatenate(roots), np.concatenate(periods)
    if not len(i):
        return np.zeros((0, 4), np.int64)
    i, p = np.unique(np.stack([i, p]), axis=1)
    s, e = first[part[i]], end[part[i]]
    hashes, powers = _hashes(_mix(w.astype(np.uint64) + np.uint64(1)))
    with np.errstate(over="ignore"):
        right = _common(hashes, powers, i, i + p, e - i - p)
        hashes, powers = _hashes(_mix(w[::-1].astype(np.uint64) + np.uint64(1)))
        left = _common(hashes, powers, n - i - p, n - i, i - s)
    start, stop = i - left, i + p + right
    found = stop - start >= np.maximum(least, exponent * p)
    runs = np.unique(np.stack([part[i], start, stop, p, i])[:4, found], axis=1).T
    out = []
    for k, a, b, q in runs.tolist():
        inner = (w[a : b - q] == w[a + q : b]).all()
        sides = (a == first[k] or w[a - 1] != w[a + q - 1]) and (b == end[k] or w[b] != w[b - q])
        if inner and sides:
            out.append((k, a, b, q))
        else:  # two hashes collided
            for root in i[found & (start == a) & (stop == b) & (p == q)].tolist():
                a2, b2 = _true_run(w, int(first[k]), int(end[k]), root, q)
                if b2 - a2 >= max(least, exponent * q):
                    out.append((k, a2, b2, q))
    return np.unique(np.asarray(out, np.int64).reshape(-1, 4), axis=0)


def _batch(words: list[list[str]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.asarray([len(x) for x in words])
    if not sizes.sum():
        return found
    codes = pd.factorize(np.asarray([w for x in words for w in x], dtype=object))[0]
    at, part = _stretches(codes, np.repeat(np.arange(len(words)), sizes), least, exponent)
    if not len(at):
        return found
    text_of = np.repeat(np.arange(len(words)), sizes)
    offset = np.cumsum(sizes) - sizes
    for _, start, stop, period in _extended(codes[at], part, least, exponent).tolist():
        text = int(text_of[at[start]])
        found[text].append((int(at[start] - offset[text]), stop - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


_RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _runs_of_rows(least: int, exponent: int):
    def rows(ids: list, words: list[list[str]]) -> pa.RecordBatch:
        runs = _batch(words, least, exponent)
        collapsed = []
        for text, found in zip(words, runs, strict=True):
            kept = np.ones(len(text), bool)
            for start, length, period in found:
                kept[start + period : start + length] = False
            collapsed.append(" ".join(text if not found else [w for w, k in zip(text, kept.tolist(), strict=True) if k]))
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        column = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([len(x) for x in words], pa.int64()), column, pa.array(collapsed, pa.large_string())],
            ["id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                words.append(WORD.findall(batch.column("text")[k].as_py() or ""))
                ids.append(batch.column("id").slice(k, 1))
                size += len(words[-1])
                if size >= BLOCK_WORDS or len(words) >= 10_000:
                    yield rows(ids, words)
                    ids, words, size = [], [], 0
        if words:
            yield rows(ids, words)

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """Runs of words of every whole text, and the text without their repetitions.

    A run is a stretch of words with smallest period q, of ``max(least, exponent * q)`` words or more, that no neighbouring
    word extends. Words are ``[^\\x20\\x09-\\x0D]+``. Returns ``id_col, n_words, runs, collapsed``: runs by start, then period;
    ``collapsed`` drops every word that a run contains after the run's first period, and joins the rest by spaces.

    * null, empty and blank texts have no word and no run; their ``collapsed`` is empty;
    * rows are independent: repeated rows and identifiers give repeated rows, a null identifier stays null, other columns
      are not read; an empty table gives an empty result;
    * a text is held whole by one task, with about 100 bytes a word.
    """
    if exponent < 2 or least < 3:
        raise ValueError("an exponent under 2 or a run under 3 words has no root to extend")
    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runs_of_rows(least, exponent), f"id {ids}, {_RUNS}").withColumnRenamed("id", id_col)
