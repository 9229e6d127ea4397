"""What keeps a query's work from growing faster than its input."""

import datetime
import hashlib
import json
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ledgerlight.operators import cards, integrity, lineage, payouts, registry, similarity, validation
from ledgerlight.sources import adapters, views


def test_report_store_has_few_files(spark, tmp_path):
    names = [f"org{i % 3}/m {i}" for i in range(60)] + ["a__b", "x/ä%20 z"]
    bodies = ['{"score":\n 1.5}'] * 60 + ['{"score": 2, "model_id": "in/body"}', '{"score": 3}']
    rows = spark.createDataFrame([*zip(names, bodies), ("broken", "{"), ("none", None)], "name string, value string").repartition(3)
    adapters.write_report_store(rows, str(tmp_path / "store"))
    assert 0 < len([p for p in (tmp_path / "store").rglob("*") if p.is_file() and p.name.startswith("part-")]) <= 3
    got = {r.model_id: r.score for r in adapters.read_report_store(spark, str(tmp_path / "store"), packed=True).collect()}
    assert got == {**dict.fromkeys(names[:60], 1.5), "in/body": 2.0, "x/ä%20 z": 3.0}
    single = tmp_path / "single"
    single.mkdir()
    (single / "org__m1.json").write_text(json.dumps({"score": 4}))
    (single / "index.json").write_text("{}")
    assert [(r.model_id, r.score) for r in adapters.read_report_store(spark, str(single)).collect()] == [("org/m1", 4.0)]


def test_declared_files_are_opened_by_their_names(spark, tmp_path):
    bodies = {("a", "x.txt"): b"", ("a", "deep/er/y.bin"): bytes(range(256)) * 5, ("b=1", "ä %20 z.txt"): b"text" * 10}
    (tmp_path / "secret").write_bytes(b"s")
    root = f"file:{tmp_path}/root"
    integrity.write_files(spark.createDataFrame([(*k, bytearray(b)) for k, b in bodies.items()], "bundle string, path string, body binary"), root)
    assert {str(p.relative_to(tmp_path / "root")) for p in Path(tmp_path / "root").rglob("*") if p.is_file()} == {"/".join(k) for k in bodies}
    asked = [*bodies, *bodies, ("a", "deep"), ("a", "none"), ("a", "../../secret"), ("..", "secret"), ("", "secret"), ("a", None)]
    got = integrity.declared_files(spark.createDataFrame(asked, "bundle string, path string"), root).collect()
    assert sorted(map(tuple, got)) == sorted((*k, len(b), hashlib.sha256(b).hexdigest()) for k, b in bodies.items())


_ENTRIES = ('{"rank":1,"provider_id":"p","shard_id":"s","share":0.5}', '{"rank":1.0,"provider_id":"p","shard_id":"s","share":1}', '{"rank":1.5,"provider_id":"p","shard_id":"s","share":0.5}',
            '{"rank":0,"provider_id":"","shard_id":"s","share":-1}', '{"rank":"2","provider_id":"p","shard_id":"s","share":"0.5"}', '{"rank":null,"provider_id":null,"share":null}', '{"meta":[],"raw_score":true}',
            '7', 'null', '[]', '{}', '{"rank":1e400,"share":1e400}', '{"rank":1,"provider_id":"p","shard_id":"s","share":12345678901234567890123456789012345678901234567890}')
_PARTS = ('"usage":{"input_tokens":-1}', '"usage":{"input_tokens":1,"output_tokens":"x"}', '"usage":[]', '"usage":null', '"epsilon_dp":0.5', '"epsilon_dp":-0.5', '"signature":""', '"signature":7',
          '"license_refs":[{"license_id":"a","scope":"rag"}]', '"license_refs":[{"license_id":"a","scope":"rage"},3]', '"license_refs":{}', '"license_refs":null', '"proof_ref":{"offset":1.5}', '"meta":{}', '"meta":"x"',
          '"output_id":""', '"hash_model":"short"', '"hash_model":null', '"top_k":[]', '"top_k":{}', '"top_k":"x"', '"Schema":1')


def _odd_receipts():
    head = {"schema": '"royalty_receipt.v1"', "output_id": '"o"', "model_id": '"m"', "timestamp": '"t"', "attribution_scope": '"a"', "hash_model": '"12345678"', "hash_data_index": '"12345678"'}
    body = lambda top, extra="": "{" + ",".join([f'"{k}":{x}' for k, x in head.items() if f'"{k}"' not in extra] + ([] if '"top_k"' in extra else [f'"top_k":[{top}]']) + ([extra] if extra else [])) + "}"
    tops = [",".join(p) for a in _ENTRIES for p in ((a,), *((a, b) for b in _ENTRIES), (_ENTRIES[0], a, _ENTRIES[0]))]
    other = ['{"schema":"payouts.v1","provider_id":"p","period":"2024-01","amount":1.5,"currency":"EU"}', '{"schema":"payouts.v1","provider_id":"p","period":"2024-1","amount":1.5}',
             '{"schema":"payouts.v1","provider_id":"p","period":"2024-01","amount":1}', '{"schema":"trust_bundle.v1","period":"2024-01","created_at":"x","bundle_id":"b","inputs":{},"artifacts":{"a":null}}',
             '{"schema":"trust_bundle.v1","period":"2024-01","created_at":"x","bundle_id":"b","inputs":{"b":1},"artifacts":{"a":null}}', '{"schema":"x"}', '{}', "[1]", "1", ' \t{"schema":3}', "{", '"{"',
             '{"schema":"shapley.v1","request_id":"r","timestamp":"t","method":"m","top_k":[{"rank":1,"index":2,"label":"l","score_mean":1,"share":1,"score_lo95":null}]}',
             '{"schema":"shapley.v1","request_id":"r","timestamp":"t","method":"m","top_k":[{"rank":1,"index":null,"label":"l","score_mean":1,"share":1,"score_hi95":"x"}]}',
             '{"schema":"data_receipt.v1","id":"i","provider_id":"p","content_id":"c","timestamp":"t","period":"2024-01"}', '{"schema":"data_receipt.v1","id":"i","provider_id":" ","content_id":"c"}']
    return [body(t) for t in tops] + [body(_ENTRIES[0], p) for p in _PARTS] + [body(_ENTRIES[0], f"{p},{q}") for p in _PARTS for q in _PARTS if p.split(":")[0] != q.split(":")[0]] + other


def test_fixed_contract_tests_agree_with_the_rules(spark):
    rows = validation.parse(spark.createDataFrame([(x,) for x in _odd_receipts()], "value string"))
    schema = F.try_variant_get("record", "$.schema", "string")
    both = rows.select("value", "kind", validation.keeps_contract(F.col("record"), schema).alias("fast"), (F.size(validation.contract_issues(F.col("record"), schema)) == 0).alias("slow"),
                       F.regexp_extract(F.schema_of_variant("record"), "^[A-Z]+", 0).alias("outer")).collect()
    assert [r.value for r in both if bool(r.fast) != bool(r.slow)] == []
    assert {bool(r.fast) for r in both} == {True, False}
    assert [r.value for r in both if r.kind != (r.outer or "BROKEN")] == []


def test_lines_are_read_once(spark, tmp_path):
    spark.createDataFrame([(x,) for x in _odd_receipts()], "value string").write.text(str(tmp_path / "lines"))
    lines = spark.read.text(str(tmp_path / "lines"))
    parsed = validation.parse(lines).where("kind = 'OBJECT'")
    for df, scans in ((validation.profile_records(lines), 1), (parsed, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == scans and plan.count("parse_json") <= 1 and plan.count("parseJson") <= 1


def test_a_pair_of_blocks_is_worked_on_in_tiles(spark, monkeypatch):
    tasks = []
    plain = PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, fn, schema: tasks.append(fn) or plain(self, fn, schema))
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    similarity.top_m_similar(one.withColumnRenamed("id", "query_id"), one.withColumnRenamed("id", "shard_id"), 3, tile=500)
    vectors = np.random.default_rng(1).integers(-2, 3, (6_000, 4)) + 0.5
    queries, shards = (pd.DataFrame({c: np.arange(6_000), "vec": list(vectors)}) for c in ("query_id", "shard_id"))
    tracemalloc.start()
    found = tasks[0](queries, shards)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 6,000 x 500 scores are 24 MB, and some copies of them are needed
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for query, rows in list(found.groupby("query_id"))[::600]:
        scores = np.round(unit @ unit[query], 9)
        assert rows["shard_id"].tolist() == sorted(range(6_000), key=lambda i: (-scores[i], i))[:3]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_signals_are_looked_for_once(spark):
    rows = spark.createDataFrame([(1, "trained on org/set", None, None), (2, "", ["dataset:x"], '{"model_type": "g"}'), (3, None, None, None)], "doc_id long, card string, tags array<string>, config string")
    found = cards.provenance_signals(rows.repartition(2))
    assert sum(line.count("regexp_extract_all(") for line in _optimized(found)) <= 13  # each pattern, and the group of six of them
    assert {(r.doc_id, r.signal, r.value) for r in found.collect()} == {(1, "readme_dataset", "org/set"), (2, "tag", "x"), (2, "model_type", "g")}


def test_newest_reports_carry_the_columns_that_are_read(spark, tmp_path):
    schema = "model_id string, file_name string, reported_on date, score double, gaps array<string>"
    rows = [("a", "1", datetime.date(2024, 1, 1), 1.0, ["g"]), ("a", "2", None, None, None), ("b", "1", datetime.date(2024, 1, 1), 2.0, ["h"])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "reports"))
    found = registry.latest_reports(spark.read.parquet(str(tmp_path / "reports")), spark.createDataFrame([("a",)], "model_id string"), 2)
    assert sorted(map(tuple, found.select("model_id", "score", "gaps").collect())) == [("a", None, None), ("b", 2.0, ["h"])]
    assert not [line for line in _optimized(found.select("model_id", "score")) if "Relation" not in line and "gaps" in line]


def test_lines_outside_the_period_are_left_out_before_they_are_grouped(spark):
    rows = payouts.balanced_receipts(views.receipts(spark, "/root/testdata/sf0.001").where(payouts.in_period(F.col("timestamp"), "1997-06")))
    plan = _optimized(rows.select("sum_share", "entries"))
    place = lambda *words: next(i for i, line in enumerate(plan) if all(w in line for w in words))
    assert place("Aggregate", "collect_list") < place("Join Inner") < place("Filter", "o_orderdate")


def test_elements_are_looked_for_where_a_card_is_read(spark):
    odd = ["", "no heading", "# A\n# B\nb", "# A\nlong one\n## a\nx\n# A", "##  Données \r\ntext \n y\n", "#\n# \n#  \nbody\n##### E\nt", "x\n#### D\n\n\n", "# A\rB\nz", "#\tTab\n é\n#Tab\nq", "# A\n \n# b\n1\n# a\n22\n# B\n"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, card string").repartition(2)
    expected = {}
    for r in sorted(cards.card_sections(df).where("heading is not null and n_lines > 0").collect(), key=lambda r: r.section):
        expected[r.doc_id, r.heading.lower()] = len(r.body.strip(" "))
    found = df.select("doc_id", F.inline(cards._titles(F.split("card", "\n")))).collect()
    assert sorted((r.doc_id, r.heading, r.chars) for r in found) == sorted((*k, n) for k, n in expected.items())
    assert len(expected) == 8
    assert not [line for line in _optimized(cards.nec_mapper(df.select("doc_id", "card"))) if any(w in line for w in ("Window", "Aggregate", "Join "))]
    assert {(r.score, r.status) for r in cards.nec_mapper(spark.createDataFrame([(1, None)], "doc_id long, card string")).collect()} == {(0.0, "ABSENT")}


def test_steps_of_chains_need_no_whole_chains(spark, monkeypatch):
    bases = {"a": "b", "b": "a", "s": "s", "y": "a", "t": "s", "1": "2", "2": "3", "3": "4", "4": "5", "5": "6", "6": "7", "7": "8", "8": "6", "u": "none", "w": "u", "x": None, "v": "x", "p": "q", "q": "r", "r": "p"}
    models = spark.createDataFrame([(m, b, "o", 1.0, ["d"]) for m, b in bases.items()], "model_id string, base_model string, org string, score double, datasets array<string>")
    ids = {r.id: r.n for r in models.select("model_id").union(spark.createDataFrame([("none",)], "model_id string")).select(lineage.node_id("model", F.col("model_id")).alias("id"), F.col("model_id").alias("n")).collect()}
    chains = [r.bases for r in lineage.base_chain(models).collect()]
    monkeypatch.setattr(lineage, "stored", None)  # nothing is computed before it is asked for
    edges = lineage.lineage_edges(models, spark.createDataFrame([], "model_id string, dataset string, confidence double")).where("weight = 0.95").collect()
    assert sorted((ids[e.source], ids[e.target]) for e in edges) == sorted({p for c in chains for p in zip(c, c[1:])})
    assert len(edges) > 10


def test_keywords_are_searched_once_a_card(spark):
    low = spark.createDataFrame([(1, "a training dataset, naïve"), (2, ""), (3, "red teaming: naïv")], "doc_id long, low string").repartition(2)
    found = low.select("doc_id", cards._words_in(F.col("low"), ["naïve", "red team", "training data", "set,"]).alias("hits")).collect()
    assert {r.doc_id: r.hits for r in found} == {1: [0, 2, 3], 2: [], 3: [1]}
    plan = "\n".join(_optimized(cards.nec_mapper(low.withColumnRenamed("low", "card"))))
    assert "Contains(low" not in plan and plan.count("ArrowEvalPython") == 1
