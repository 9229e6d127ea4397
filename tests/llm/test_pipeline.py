"""The pipeline's stages against plain Python, each on its own input."""

import hashlib
import importlib.util
import random
import uuid
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.common import shared_folder
from ledgerlight.llm.simhash import fingerprints
from tests.llm.test_operators import lower, sentence

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)
import corpus_pipeline as cp


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    item = "a train with wagons leaves the quiet station at dawn and crosses two hills before it reaches the old stone bridge"
    texts = [sentence(i, 60) for i in range(40)] + [sentence(3, 60).upper(), sentence(4, 60), None, "", "... 123", sentence(50, 40) + " " + item]
    words = sentence(70, 200).split()
    texts += [" ".join(words), " ".join(words[:100] + ["garden"] + words[101:])]  # near copies
    docs = [(i, t, "en" if i % 4 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)] + [(5, sentence(60, 50), "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def one_of_each(rows):
    """Of each component of near duplicates the row with the smallest doc_id, by comparing all bits of all pairs."""
    prints = [fingerprints(t, 5, cp.NEAR_SEEDS) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in combinations(range(len(rows)), 2):
        xors = [(x ^ y) & (2**64 - 1) for x, y in zip(prints[a], prints[b], strict=True)]
        if sum(x.bit_count() for x in xors) <= 51:
            parent[find(a)] = find(b)
    groups = {}
    for n in range(len(rows)):
        groups.setdefault(find(n), []).append(rows[n])
    return sorted(min(members, key=lambda x: x[0]) for members in groups.values())


def test_empty_tables_and_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = {c: F.lit(1) for c in ("__row", "id", "key", "row", "norm", "salt", "node", "fp0", "text_hash", "item", "pool", "range", "label")}
    docs.withColumns(extra).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in "ab":
        bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        (bench if name == "a" else bench.where("false")).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    plain = cp.run(spark, sf_dir)
    more = cp.run(spark, f"{tmp_path}/a")
    assert set(more.columns) == set(plain.columns) | set(extra)
    assert sorted(map(tuple, more.select("doc_id", "text", "taken").collect())) == sorted(map(tuple, plain.select("doc_id", "text", "taken").collect()))
    assert cp.run(spark, f"{tmp_path}/b").count() == 0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in cp.STAGES]
    assert len(names) == 5 and cp.ORACLE_SQL is None
    before = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out_{name}"
        out.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language":
            assert sorted(map(str, after)) == sorted(map(str, [x for x in before if any(c.isalpha() for c in x[1] or "")]))
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[lower(t)] = max(i, best.get(lower(t), -1))
            assert sorted(after) == sorted((i, t) for i, t in before if best[lower(t)] == i)
        elif name == "near_dedup":
            assert sorted(after) == one_of_each(before) and len(after) < len(before)
        elif name == "decontaminate":
            assert sorted(after) == sorted(x for x in before if "wagons leaves" not in x[1])
        if name != names[-1]:
            assert docs.columns == columns
        else:
            assert docs.where("taken <= 0 or taken > 3 * size").count() == 0
            assert docs.groupBy("source").agg((F.abs(F.sum("taken") - F.first("target")) <= 1).alias("ok")).where("not ok").count() == 0
        before = after


def test_run_twice(spark, sf_dir):
    digest = lambda: hashlib.sha256(repr(sorted((r.doc_id, r.text, r.taken) for r in cp.run(spark, sf_dir).collect())).encode()).hexdigest()
    assert digest() == digest()


def test_near_copies_by_shingles(spark):
    """Nine in ten of the pairs with a Jaccard similarity of 0.8 and more are one group, strangers are none."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, pairs = [], []
    for g in range(400):
        text = rng.choices(words, k=rng.choice([40, 80, 150, 400]))
        other = list(text)
        for at in rng.sample(range(len(text)), rng.randint(1, max(1, len(text) // 60))):
            other[at] = rng.choice(words)
        both = shingles(text), shingles(other)
        similar = len(both[0] & both[1]) / len(both[0] | both[1])
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]
        pairs.append((2 * g + 1, similar))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    kept = {r.doc_id for r in cp.near(spark, spark.read.parquet(path), "").collect()}
    assert {2 * g for g in range(400)} <= kept
    alike = [i for i, similar in pairs if similar >= 0.8]
    assert len(alike) > 200 and sum(i not in kept for i in alike) >= 0.95 * len(alike)
