"""Nearest neighbours, runs of words and the conversation trie against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import neighbours, queries, runs, trie

# --- neighbours


def vector_rows():
    rng = np.random.default_rng(3)
    out = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(240)]
    hot = [float(x) for x in rng.standard_normal(16)]
    out += [(1000 + i, hot) for i in range(120)]  # a third of all rows, queries among them
    out += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [math.nan] * 16), (2004, [1.0, None] * 8), (2050, [math.inf] * 16), (None, hot)]
    out += [(3000, [2.0, 1.0]), (3001, [4.0, 2.0, 0.0]), (3050, [2.0, 1.0] + [0.0] * 14), (7, out[7][1])]
    return out


def brute_neighbours(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = np.asarray(list(v) + [0.0] * (16 - len(v)), np.float32).astype(float)
    out = []
    for i, v in usable.items():
        if i % 50 == 0:
            scores = [(-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j) for j, w in usable.items() if j != i]
            scores = sorted((round(s, 9), j) for s, j in scores)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("cells", [1, 40])
def test_neighbours(spark, cells, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_CELL", 240 // cells)
    monkeypatch.setattr(neighbours, "CODES", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    df = spark.createDataFrame([(*r, 1, 2) for r in vector_rows()], "vec_id long, embedding array<float>, uid int, cell int").repartition(5)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(brute_neighbours(vector_rows(), 5))
    if cells > 1:
        return
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(df, F.lit(None).cast("boolean")).count() == 0
    two = df.where("vec_id in (0, 1, 2)")
    assert [(r.query_id, r["rank"]) for r in neighbours.nearest(two, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_estimates_stay_within_their_bound():
    rng = np.random.default_rng(5)
    unit = neighbours._unit(rng.standard_normal((3000, 24)))
    space = neighbours._Space(unit[:100], 3, 512, 1)
    cell, code, length, fit, near = space.codes(unit.astype(np.float32))
    q = unit[:50].astype(np.float32)
    signs = np.unpackbits(code, axis=1, count=512) * 2.0 - 1
    estimate = (q @ space.rotation) @ signs.T * (length / fit / math.sqrt(512)) + q @ space.centres[cell].T
    error = neighbours.EPSILON * length * np.sqrt(np.maximum(0, 1 - fit**2) / 511) / fit + 1e-4
    assert (np.abs(estimate - unit[:50] @ unit.T) <= error).mean() > 0.9999
    assert (np.abs(estimate - unit[:50] @ unit.T) <= error / 8).mean() < 0.9  # and the bound is not vacuous


# --- runs


def brute_lyndon(w):
    return [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j))) for i in range(len(w))]


def brute_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            smaller = any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q))
            if j > i and j + q - i >= max(least, exponent * q) and not smaller:
                out.append((i, j + q - i, q))
            i = max(i + 1, j + 1 if j > i else 0)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_under_both_orders():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 14))]
        assert runs.lyndon_lengths(w) == brute_lyndon(w)
        turned = [3 - x for x in w]
        assert runs.lyndon_lengths(turned) == brute_lyndon(turned)
    assert runs.lyndon_lengths([]) == []


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        part = [str(rng.randint(0, 3)) for _ in range(rng.randint(1, 6))]
        words += part * rng.choice([1, 1, 2, 4, 5, 7]) + part[: rng.randint(0, len(part))]
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (3, 2), (4, 3), (10, 4), (3, 5)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 5))]
        assert runs._batch(texts, least, exponent) == [brute_runs(w, least, exponent) for w in texts]
    words = ["0"]
    while len(words) < 1024:
        words += ["1" if w == "0" else "0" for w in words]  # Thue-Morse
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 600:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for w in (words, words[:100] * 5, fibonacci[1], ["x"] * 700):
        assert runs._batch([w], least, exponent) == [brute_runs(w, least, exponent)]


def run_texts():
    rng = random.Random(9)
    out = [(i, " ".join(repetitive(rng) + [f"w{k}" for k in range(rng.randint(0, 8))])) for i in range(120)]
    out += [(200 + i, x) for i, x in enumerate([None, "", " \t\n ", "a", "a\x0bb c  a", "x " * 3000, "é ü " * 5])]
    return out + [(None, "a a a a a a a"), (5, "b b b b b b"), (5, "b b b b b b")]


def brute_op12(i, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = brute_runs(words, 6, 4)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (i, len(found), s, length, q, 1000 * length // q if found else None, *digests)


def test_op12(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_WORDS", 500)
    rows = [(*r, "en", 3) for r in run_texts()]
    spark.createDataFrame(rows, "doc_id long, text string, id string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path))
    assert got.dtypes[:6] == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint")]
    assert sorted(map(repr, (tuple(r)[:8] for r in got.collect()))) == sorted(repr(brute_op12(*r)) for r in run_texts())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert queries.op12_runs(spark, f"{tmp_path}/empty").count() == 0


# --- trie


def conversation_rows():
    rng = random.Random(4)
    out = []
    for c in [*range(0, 40), *range(100, 160), *range(305, 330), 7_000_000_001]:
        for turn in range(rng.randint(1, 7)):
            out.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["hi", "hello", "é" * 5, "long " * 20])))
    out += [(500 + c, t, "user", "the same") for c in range(60) for t in range(4)]  # a third end in one node
    out += [(900, t, "user", f"turn {t}") for t in range(300)]
    out += [(901, None, None, None), (901, 1, None, ""), (901, 1, "", None), (902, 3, "b", "x"), (902, 3, "a", "y"), (902, 3, "a", "y"), (None, 1, "user", "lost")]
    return out


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-math.inf if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute_trie(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    out = {}

    def visit(node):
        kids = [visit(k) for k in sorted(children[node])]
        leaves = sum(k[0] for k in kids) or 1
        saved = sum(k[1] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        first = (min(members[node]), len(node), parent, len(members[node]), len(kids), leaves, saved)
        out[node] = (*first, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    import sys

    sys.setrecursionlimit(10_000)
    visit(())
    return out.values()


@pytest.mark.parametrize("shards,queue_max", [(512, 500_000), (3, 4), (1, 2)])
def test_trie(spark, shards, queue_max, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 40)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 int").repartition(5)
    got = trie.prefix_trie(trie.with_shared_openings(trie.turn_steps(df)), shards, queue_max)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_trie(rebuilt(rows))))
    assert trie.prefix_trie(trie.with_shared_openings(trie.turn_steps(df.where("false")))).count() == 0


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "a") for c in range(1, 30)] + [(100, 0, "user", "b"), (101, 0, "user", "c")]
    assert any(not ts for ts in rebuilt(rows).values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(trie.with_shared_openings(trie.turn_steps(df))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_trie(rebuilt(rows))))


def test_queue_spills():
    rng = random.Random(2)
    queue, items = trie.SpillingQueue(7), [(rng.randint(0, 20), k) for k in range(500)]
    for item in items[:400]:
        queue.push(item)
    assert len(queue.heap) <= 7 and queue.runs
    out = [queue.pop(()) for _ in range(100)]
    for item in items[400:]:
        queue.push(item)
    assert queue.pop((-1,)) is None
    while (item := queue.pop(())) is not None:
        out.append(item)
    assert out[:100] == sorted(items[:400])[:100] and sorted(out) == sorted(items)
