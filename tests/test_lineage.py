"""Evidence that models inherit, and one graph of several sources."""

from ledgerlight.operators import cards, lineage

SIGNALS = "model_id string, signal string, value string, confidence double"


def test_signals_are_inherited_once_and_weaker(spark):
    rows = [("base", "readme_dataset", "org/a", 0.8), ("base", "known_dataset", "c4", 0.7), ("base", "tag", "t", 0.95), ("base", "readme_dataset", "org/a", 0.8), ("self", "known_dataset", "x", 0.7)]
    edges = spark.createDataFrame([("m", "base"), ("n", "base"), ("self", "self"), ("o", None), ("p", "nobody"), ("m", "base")], "model_id string, base_model string")
    got = {(r.model_id, r.signal, r.value, round(r.confidence, 6), r.source) for r in lineage.inherited_signals(spark.createDataFrame(rows, SIGNALS), edges).collect()}
    want = [("inherited_readme_dataset", "org/a", 0.64, "base_model:base"), ("inherited_known_dataset", "c4", 0.56, "base_model:base")]
    assert got == {(m, *w) for m in "mn" for w in want}


def test_provenance_counts_declared_and_inferred_sets_apart(spark):
    rows = [("m", "tag", "a", 0.95), ("m", "readme_dataset", "a", 0.8), ("m", "readme_dataset", "weak", 0.6), ("m", "known_dataset", "c4", 0.7), ("m", "training_section", "present", 1.0),
            ("base", "readme_dataset", "b", 0.6), *[("full", "tag", f"t{k}", 0.95) for k in range(9)], *[("full", "known_dataset", f"k{k}", 0.7) for k in range(9)], ("full", "training_section", "present", 1.0)]
    models = spark.createDataFrame([("m", "base", None), ("base", None, "mit"), ("full", "base", "mit"), ("none", None, None)], "model_id string, base_model string, license string")
    got = {r.model_id: r for r in lineage.provenance(models, spark.createDataFrame(rows, SIGNALS)).collect()}
    assert (got["m"].declared, got["m"].inferred, got["m"].provenance_score) == (["a"], ["b", "c4"], 0.6)  # .3 + .1 + .1 (base) + .1
    assert (got["base"].declared, got["base"].inferred, got["base"].provenance_score) == ([], [], 0.1)
    assert got["full"].provenance_score == 1.0 and len(got["full"].inferred) == 10
    assert (got["none"].declared, got["none"].has_training, got["none"].provenance_score) == ([], False, 0.0)
    assert lineage.provenance(models, spark.createDataFrame([], SIGNALS)).count() == 4


def test_provenance_of_cards(spark):
    rows = [("base", "# Training data\nWe used dataset: `org/base-set` and wikipedia.", [], None), ("m", "nothing here", ["dataset:org/own", "base_model:base"], None)]
    df = spark.createDataFrame(rows, "model_id string, card string, tags array<string>, config string")
    models = spark.createDataFrame([("m", "base", "mit"), ("base", None, None)], "model_id string, base_model string, license string")
    got = {r.model_id: r for r in lineage.provenance(models, cards.provenance_signals(df, key="model_id")).collect()}
    assert got["m"].declared == ["org/own"] and "wikipedia" in got["m"].inferred and not got["m"].has_training
    assert got["base"].has_training and "wikipedia" in got["base"].inferred


def test_trained_on_prefers_the_card(spark):
    mentions = spark.createDataFrame([("m", "C4", 0.5), ("m", "c4", 0.9), ("n", "x", 0.7)], "model_id string, dataset string, confidence double")
    declared = spark.createDataFrame([("m", [" c4", "new"]), ("o", [])], "model_id string, declared array<string>")
    assert sorted(tuple(r) for r in lineage.trained_on(mentions, declared).collect()) == [("m", "c4", 0.9), ("m", "new", 0.95), ("n", "x", 0.7)]


def graph(spark, claims=(), receipts=(), outreach=(), chains=(), nodes=(), edges=()):
    kinds = ("target_id string, parent string", "target_id string, absent_count int, severity string", "target_id string, status string, platform string",
             "model_id string, base_model string, declared array<string>, provenance_score double", "id string, type string, label string", "source string, target string, type string")
    return lineage.resolve_graph(*[spark.createDataFrame(list(rows), kind) for rows, kind in zip((claims, receipts, outreach, chains, nodes, edges), kinds, strict=True)])


def test_graph_of_three_sources(spark):
    nodes, edges = graph(
        spark, claims=[("A/Model", "b/base"), (None, "b/base"), ("a/model", None)], receipts=[("a/MODEL", 4, "HIGH")], outreach=[("a/model", "closed", "hub"), ("z", "sent", "hub")],
        chains=[("a/model", "B/BASE", ["Set", "x", None], 0.9), ("c/d", "plain", [], 0.1), ("e/f", None, [], 0.9)],
        nodes=[("M-1", "model", "A/MODEL"), ("D-1", "dataset", "Set"), ("O-1", "org", "old")], edges=[("M-1", "D-1", "trained_on"), ("M-1", "O-1", "owns"), ("M-1", "gone", "owns")],
    )
    by = {r.id: r for r in nodes.collect()}
    assert {r.id for r in by.values() if r.type == "model"} == {"A/Model", "b/base", "c/d", "e/f", "z"}
    assert (by["A/Model"].absent_count, by["A/Model"].outreach_status, by["A/Model"].provenance_score, by["A/Model"].has_report) == (4, "closed", 0.9, True)
    assert {by[i].label for i in by if by[i].type == "org"} == {"A", "b", "c", "e", "unknown", "old"}
    got = {(r.source, by[r.target].label, r.type, r.confidence) for r in edges.collect()}
    assert ("A/Model", "b/base", "finetuned_from", 0.95) in got  # not 0.85: the claim came first
    assert ("A/Model", "Set", "trained_on", 0.9) in got and ("A/Model", "old", "owns", 0.8) in got and ("z", "unknown", "belongs_to", 1.0) in got
    assert {(s, t) for s, t, kind, _ in got if kind == "undocumented_source"} == {("c/d", "Undocumented data (c/d)")}
    assert len([1 for _, _, kind, _ in got if kind == "belongs_to"]) == 5 and not any("plain" in (s, t) for s, t, *_ in got)


def test_graph_of_nothing(spark):
    nodes, edges = graph(spark)
    assert nodes.count() == edges.count() == 0


def test_ancestors_of_any_depth(spark):
    line = [(f"n{k}", f"n{k - 1}") for k in range(1, 40)]  # n0 is no model of the table
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("into", "b"), ("self", "self"), ("none", None)]
    df = spark.createDataFrame(line + ring, "model_id string, base_model string")
    got = {(r.model_id, r.ancestor): r.distance for r in lineage.ancestors(df).collect()}
    want = {(f"n{k}", f"n{j}"): k - j for k in range(1, 40) for j in range(k)}
    want |= {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("into", "b"): 1, ("into", "c"): 2, ("into", "a"): 3}
    assert got == want
    chains = {r.model_id: r.bases for r in lineage.base_chain(df, 3).collect()}
    assert (chains["n9"], chains["into"], chains["none"], chains["self"]) == (["n8", "n7", "n6"], ["b", "c", "a"], [], [])
    assert lineage.ancestors(df.where("false")).count() == 0
