"""Lineage graph of models, datasets and organisations, and target sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored


def node_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(kind[0]), F.lit("_"), F.substring(F.sha2(F.concat(F.lit(kind + ":"), F.lower(name)), 256), 1, 12))


def trained_on(mentions: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``model_id, dataset, confidence``: datasets that a card mentions with their confidence, and declared ones that no mention of
    the model has (names compared without case and outer space) with 0.95."""
    plain = F.lower(F.trim("dataset"))
    rows = mentions.select("model_id", "dataset", "confidence", F.lit(0).alias("place"))
    if declared is not None:
        rows = rows.unionByName(declared.select("model_id", F.explode("declared").alias("dataset"), F.lit(0.95).alias("confidence"), F.lit(1).alias("place")))
    best = F.min_by(F.struct("dataset", "confidence"), F.struct("place", -F.col("confidence"), F.col("dataset")))
    return rows.groupBy("model_id", plain.alias("__name")).agg(best.alias("b")).select("model_id", "b.*")


def lineage_edges(models: DataFrame, trained: DataFrame) -> DataFrame:
    """Edges ``(source, target, type, weight)``: owns, trained_on (weighted by the confidence of ``trained(model_id, dataset, confidence)``),
    finetuned_from (0.99 to the base, 0.95 along its chain), undocumented_source, inherited_opacity (a base without a score has 0)."""
    model = node_id("model", F.col("model_id"))
    edge = lambda df, source, target, kind, weight: df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), weight.cast("double").alias("weight"))
    owns = edge(models, node_id("org", F.col("org")), model, "owns", F.lit(1.0))
    used = edge(trained, model, node_id("dataset", F.col("dataset")), "trained_on", F.col("confidence"))
    used = used.groupBy("source", "target", "type").agg(F.max("weight").alias("weight"))
    based = models.where(F.col("base_model").isNotNull())
    tuned = edge(based, model, node_id("model", F.col("base_model")), "finetuned_from", F.lit(0.99))
    pairs = based.where("base_model <> model_id").select("model_id", "base_model").distinct()  # a pair is a step of a chain where a third model builds on it
    steps = pairs.join(pairs.toDF("user", "at"), (F.col("at") == F.col("model_id")) & (F.col("user") != F.col("base_model")), "left_semi")
    chained = edge(steps, model, node_id("model", F.col("base_model")), "finetuned_from", F.lit(0.95))
    bare = edge(models.where(F.size("datasets") == 0), model, node_id("dataset", F.lit("undocumented")), "undocumented_source", F.lit(0.5))
    clear = models.where(F.col("score") >= 0.3).select(F.col("model_id").alias("base_model"))  # what is not clear is opaque, unknown bases included
    opaque = based.where(F.coalesce("score", F.lit(0.0)) < 0.3).join(clear, "base_model", "left_anti")
    opacity = edge(opaque, model, node_id("model", F.col("base_model")), "inherited_opacity", F.lit(0.9))
    return reduce(DataFrame.unionByName, [owns, used, tuned, chained, bare, opacity]).distinct()


def lineage_nodes(models: DataFrame) -> DataFrame:
    node = lambda kind, col: (node_id(kind, col).alias("id"), F.lit(kind).alias("type"), F.lower(col).alias("label"))
    parts = [models.select(*node("model", F.col("model_id"))), models.select(*node("org", F.col("org"))), models.select(F.explode("datasets").alias("d")).select(*node("dataset", F.col("d")))]
    return reduce(DataFrame.unionByName, parts).distinct()


def merge_graph(*edges: DataFrame) -> DataFrame:
    """Edges of several sources; the first source wins for (source, target, type)."""
    ranked = [e.select("source", "target", "type", "weight", F.lit(i).alias("priority")) for i, e in enumerate(edges)]
    return reduce(DataFrame.unionByName, ranked).groupBy("source", "target", "type").agg(F.min_by("weight", "priority").alias("weight"), F.min("priority").alias("from_source"))


def _model_names(claims: DataFrame, receipts: DataFrame, outreach: DataFrame, chains: DataFrame, old_nodes: DataFrame) -> DataFrame:
    """``name, priority``: every writing of a model's name, by the order in which sources are read."""
    sources = [claims.select("target_id"), claims.select("parent"), receipts.select("target_id"), outreach.select("target_id"), chains.select("model_id"),
               chains.select("base_model").where("base_model like '%/%'"), old_nodes.where("type = 'model'").select("label")]
    rows = [df.toDF("name").where("length(name) > 0").withColumn("priority", F.lit(k)) for k, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(F.min("priority").alias("priority"))


def resolve_graph(claims: DataFrame, receipts: DataFrame, outreach: DataFrame, chains: DataFrame, old_nodes: DataFrame, old_edges: DataFrame,
                  below: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """One graph of an evidence ledger, provenance chains and an earlier graph: ``(nodes, edges)``.

    ``claims(target_id, parent)``, ``receipts(target_id, absent_count, severity)``, ``outreach(target_id, status, platform)``,
    ``chains(model_id, base_model, declared, provenance_score)``, ``old_nodes(id, type, label)``, ``old_edges(source, target, type)``.

    Names of models are one node if they agree without case; the node has the writing of the first source that names it. Nodes:
    ``id, type, label, org`` and what the sources say of a model. Edges: ``source, target, type, confidence``: claimed bases 0.95,
    declared datasets 0.9, bases of chains (names with an organisation) 0.85, chains without a declared dataset and with a score
    under ``below`` to a node of their own 0.7, edges of the earlier graph between known nodes 0.8; of equal ones the first counts.
    Every model belongs to its organisation (1.0), ``unknown`` where its name has none.
    """
    low = lambda c: F.lower(F.col(c))
    names = _model_names(claims, receipts, outreach, chains, old_nodes).groupBy(low("name").alias("low")).agg(F.min_by("name", F.struct("priority", "name")).alias("id"))
    node = lambda letter, label: F.concat(F.lit(f"{letter}-"), F.substring(F.sha2(label, 256), 1, 12))

    def known(df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the node of the model named in ``column``."""
        return df.withColumn("__low", low(column)).join(names.select(F.col("low").alias("__low"), F.col("id").alias(name)), "__low").drop("__low")

    said = lambda df, column, *fields: known(df, column, "id").groupBy("id").agg(*[F.max_by(c, F.coalesce(*[F.col(c).cast("string"), F.lit("")])).alias(c) for c in fields])
    models = names.drop("low")
    for df, column, fields in ((receipts.withColumn("has_report", F.lit(True)), "target_id", ("absent_count", "severity", "has_report")),
                               (outreach.select("target_id", F.col("status").alias("outreach_status"), F.col("platform").alias("outreach_platform")), "target_id", ("outreach_status", "outreach_platform")),
                               (chains, "model_id", ("provenance_score",))):
        models = models.join(said(df, column, *fields), "id", "left")
    org = F.when(F.col("id").contains("/"), F.split("id", "/")[0]).otherwise("unknown")
    models = models.withColumns({"org": org, "absent_count": F.coalesce("absent_count", F.lit(0)), "has_report": F.coalesce("has_report", F.lit(False))})

    edge = lambda df, source, target, kind, confidence, place: df.select(
        source.alias("source"), target.alias("target"), F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), F.lit(confidence).alias("confidence"), F.lit(place).alias("place")
    )
    at = known(chains, "model_id", "at")
    used = at.select("at", F.explode("declared").alias("dataset")).where(F.length("dataset") > 1)
    bare = at.where((F.coalesce(F.size("declared"), F.lit(0)) <= 0) & (F.col("provenance_score") < below)).select("at").distinct()
    ids = old_nodes.where("type <> 'model'").select("id", F.when(F.col("type") == "org", node("O", F.col("label"))).when(F.col("type") == "dataset", node("D", F.col("label"))).otherwise(F.col("id")).alias("node"))
    ids = ids.unionByName(known(old_nodes.where("type = 'model'").withColumnRenamed("id", "old"), "label", "node").select(F.col("old").alias("id"), "node")).groupBy("id").agg(F.min("node").alias("node"))
    old = old_edges.join(ids.select(F.col("id").alias("source"), F.col("node").alias("a")), "source").join(ids.select(F.col("id").alias("target"), F.col("node").alias("b")), "target")
    edges = [
        edge(known(known(claims.where("length(parent) > 0"), "target_id", "a"), "parent", "b"), F.col("a"), F.col("b"), "finetuned_from", 0.95, 0),
        edge(used, F.col("at"), node("D", F.col("dataset")), "trained_on", 0.9, 1),
        edge(known(at.where("base_model like '%/%'"), "base_model", "b"), F.col("at"), F.col("b"), "finetuned_from", 0.85, 1),
        edge(bare, F.col("at"), node("S", F.concat(F.lit("shadow-"), "at")), "undocumented_source", 0.7, 1),
        edge(old, F.col("a"), F.col("b"), F.col("type"), 0.8, 2),
        edge(models, F.col("id"), node("O", F.col("org")), "belongs_to", 1.0, 3),
    ]
    edges = reduce(DataFrame.unionByName, edges).groupBy("source", "target", "type").agg(F.min_by("confidence", "place").alias("confidence"))

    other = lambda df, kind, label, ident: df.select(ident.alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    rest = [
        other(models, "org", F.col("org"), node("O", F.col("org"))), other(used, "dataset", F.col("dataset"), node("D", F.col("dataset"))),
        other(bare, "shadow", F.concat(F.lit("Undocumented data ("), "at", F.lit(")")), node("S", F.concat(F.lit("shadow-"), "at"))),
        other(old_nodes.where("type = 'org'"), "org", F.col("label"), node("O", F.col("label"))), other(old_nodes.where("type = 'dataset'"), "dataset", F.col("label"), node("D", F.col("label"))),
        old_nodes.where("type not in ('model', 'org', 'dataset')").select("id", "type", "label"),
    ]
    rest = reduce(DataFrame.unionByName, rest).groupBy("id").agg(F.min("type").alias("type"), F.min("label").alias("label"))
    nodes = models.withColumns({"type": F.lit("model"), "label": F.col("id")}).unionByName(rest, allowMissingColumns=True)
    return nodes, edges


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "type", "n")
    return a.unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def graph_rates(models: DataFrame) -> DataFrame:
    """Models, those without a documented dataset and their rate in percent, models with a base, mean score in percent."""
    n, bare = F.count(F.lit(1)), F.count_if(F.size("datasets") == 0)
    return models.agg(
        n.alias("models"), bare.alias("undocumented"), F.round(100 * bare / F.greatest(n, F.lit(1)), 1).alias("undocumented_rate"), F.count("base_model").alias("with_base"),
        F.round(100 * F.avg("score"), 1).alias("mean_score"),
    )


def most_depended(models: DataFrame, n: int = 15) -> DataFrame:
    """Base models by the number of models that build on them, directly or along their chain."""
    used = ancestors(models, 5).withColumnRenamed("ancestor", "base_model")
    return used.groupBy("base_model").agg(F.count(F.lit(1)).alias("dependents")).orderBy(F.desc("dependents"), "base_model").limit(n)


def org_means(models: DataFrame) -> DataFrame:
    """Per organisation: mean compliance of all its models (a missing one is 0), and mean provenance in percent of those above 0."""
    shown = F.when(F.col("provenance_score") > 0, F.round(F.col("provenance_score") * 1_000_000).cast("long"))  # whole numbers, so that sums are exact
    return models.groupBy("org").agg(
        F.round(F.avg(F.coalesce("compliance_score", F.lit(0.0))), 1).alias("mean_compliance"), F.round(F.sum(shown) / (10_000 * F.count(shown)), 1).alias("mean_provenance"),
        F.count(F.lit(1)).alias("models"), F.count(shown).alias("with_provenance"),
    )


def shared_datasets(models: DataFrame, n: int = 20) -> DataFrame:
    """Datasets that at least two organisations use."""
    used = models.select("org", "model_id", F.explode(F.array_distinct("datasets")).alias("dataset"))
    rows = used.groupBy("dataset").agg(F.count_distinct("org").alias("orgs"), F.count_distinct("model_id").alias("models"))
    return rows.where("orgs >= 2").orderBy(F.desc("orgs"), F.desc("models"), "dataset").limit(n)


def opacity_cascades(models: DataFrame, n: int = 20) -> DataFrame:
    """Base models with a score under 0.4: models and organisations that build on them."""
    bases = models.where(F.col("score") < 0.4).select(F.col("model_id").alias("base_model"), F.col("score").alias("base_score"))
    rows = models.join(bases, "base_model").groupBy("base_model", "base_score").agg(F.count(F.lit(1)).alias("models"), F.count_distinct("org").alias("orgs"))
    return rows.orderBy(F.desc("models"), "base_model").limit(n)


def score_distribution(models: DataFrame) -> DataFrame:
    bucket = F.least(F.floor(F.col("score") / 0.2 + 1e-9), F.lit(4)).cast("int")
    return models.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("models"), F.round(F.avg("score"), 6).alias("mean_score"))


def redact_graph(nodes: DataFrame) -> DataFrame:
    """Public nodes: scores become transparent, partial or opaque."""
    level = F.when(F.col("score") >= 0.7, "transparent").when(F.col("score") >= 0.4, "partial").when(F.col("score") > 0, "opaque")
    return nodes.select("model_id", "org", level.alias("transparency"))


def ancestors(models: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(model_id, ancestor, distance)``: every base of each model along its chain, to any depth or to ``max_depth``.

    Pointers are doubled: a round joins the ancestors at the greatest distance so far with all of theirs, so a chain of n
    bases takes about log2(n) rounds. An ancestor that comes again on the way closes a cycle; it and what follows do not count,
    nor does the model itself. A base that is no model of the table ends the chain. Models have one base each.
    """
    step = models.where("base_model is not null and base_model <> model_id").select("model_id", F.col("base_model").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    every, reach = stored(step), 1
    while max_depth is None or reach < max_depth:
        far = every.where(F.col("distance") == reach).select("model_id", F.col("ancestor").alias("at"), F.col("distance").alias("before"))
        more = every.select(F.col("model_id").alias("at"), "ancestor", "distance")
        new = far.join(more, "at").select("model_id", "ancestor", (F.col("before") + F.col("distance")).alias("distance"))
        if max_depth is not None:
            new = new.where(F.col("distance") <= max_depth)
        both = every.unionByName(new.where("ancestor <> model_id")).groupBy("model_id", "ancestor").agg(F.min("distance").alias("distance"))
        before, every, reach = every, stored(both), 2 * reach
        if max_depth is None and every.count() == before.count():
            break
    return every


def base_chain(models: DataFrame, max_depth: int = 5) -> DataFrame:
    """Base models of each model in turn; the chain ends at a cycle, an unknown base or ``max_depth``."""
    bases = ancestors(models, max_depth).groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))).alias("b"))
    rows = models.select("model_id").join(bases, "model_id", "left")
    return rows.select("model_id", F.coalesce(F.transform("b", lambda x: x["ancestor"]), F.expr("cast(array() as array<string>)")).alias("bases"))


#: Signals that a model takes over from its base, and kinds of signals that make a declared or an inferred dataset.
INHERITED = ("readme_dataset", "known_dataset")
DECLARED = ("tag", "readme_dataset")
INFERRED = ("known_dataset", "inherited_readme_dataset", "inherited_known_dataset")


def inherited_signals(signals: DataFrame, edges: DataFrame, factor: float = 0.8) -> DataFrame:
    """Signals carried over base edges, with ``factor`` of their confidence.

    ``signals(model_id, signal, value, confidence)``, ``edges(model_id, base_model)``. Dataset signals of a base come to every model on it
    under the name ``inherited_...``; a model that is its own base inherits nothing.
    """
    base = signals.where(F.col("signal").isin(*INHERITED)).groupBy("model_id").agg(F.collect_set(F.struct("signal", "value", "confidence")).alias("s"))
    steps = edges.where("base_model is not null and base_model <> model_id").select("model_id", "base_model").distinct()
    got = steps.join(base.withColumnRenamed("model_id", "base_model"), "base_model").select("model_id", "base_model", F.explode("s").alias("s"))
    return got.select("model_id", F.concat(F.lit("inherited_"), "s.signal").alias("signal"), F.col("s.value").alias("value"), (F.col("s.confidence") * factor).alias("confidence"),
                      F.concat(F.lit("base_model:"), "base_model").alias("source"))


def dataset_sets(signals: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``model_id, declared, inferred, has_training``: sets of names by the kind of their signals, declared ones from ``threshold`` on."""
    of = lambda kinds, least: F.array_sort(F.collect_set(F.when(F.col("signal").isin(*kinds) & (F.col("confidence") >= least), F.col("value"))))
    return signals.groupBy("model_id").agg(
        of(DECLARED, threshold).alias("declared"), of(INFERRED, 0.0).alias("inferred"), F.bool_or(F.col("signal") == "training_section").alias("has_training")
    )


def provenance(models: DataFrame, signals: DataFrame) -> DataFrame:
    """Every model of ``models(model_id, base_model, license)`` with its own and inherited dataset sets and their score.

    0.3 for a training section, 0.1 for each declared dataset (0.3 at most), 0.1 for a licence, 0.1 for a base, 0.05 for each
    inferred dataset (0.2 at most); a model without any signal has empty sets.
    """
    every = signals.select("model_id", "signal", "value", "confidence").unionByName(inherited_signals(signals, models).drop("source"))
    none = F.expr("cast(array() as array<string>)")
    rows = models.select("model_id", "base_model", "license").join(dataset_sets(every), "model_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("declared", "inferred")} | {"has_training": F.coalesce("has_training", F.lit(False))})
    score = (
        F.when(F.col("has_training"), 0.3).otherwise(0.0) + F.least(F.lit(0.3), 0.1 * F.size("declared")) + F.when(F.length("license") > 0, 0.1).otherwise(0.0)
        + F.when(F.length("base_model") > 0, 0.1).otherwise(0.0) + F.least(F.lit(0.2), 0.05 * F.size("inferred"))
    )
    return rows.withColumn("provenance_score", F.round(F.least(F.lit(1.0), score), 6))


def scan_summary(models: DataFrame) -> DataFrame:
    return models.agg(F.count(F.lit(1)).alias("models"), F.count_if("has_training").alias("with_training"), F.count_if(F.size("datasets") > 0).alias("with_datasets"),
                      F.count("base_model").alias("with_base"), F.count("license").alias("with_license"), F.round(F.avg("score"), 6).alias("mean_score"))


def best_and_worst(models: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` models with the highest and the ``n`` with the lowest score."""
    pick = lambda order, end: models.orderBy(order, "model_id").limit(n).select(F.lit(end).alias("end"), "model_id", "score")
    return pick(F.desc_nulls_last("score"), "best").unionByName(pick(F.asc_nulls_last("score"), "worst"))


# Target sets


def normalize_target_id(target: Column) -> Column:
    """Lower-case id without ``gh:`` or ``hf:model:`` prefixes."""
    return F.lower(F.trim(F.element_at(F.split(target, ":"), -1)))


def target_org(target: Column) -> Column:
    """Organisation of an id: what is before ``/``, else ``unknown``."""
    name = normalize_target_id(target)
    return F.when(name.contains("/"), F.split(name, "/")[0]).otherwise("unknown")


def merge_targets(targets: DataFrame) -> DataFrame:
    """One row per (id, type): registry over models over datasets."""
    place = F.when(F.col("source") == "registry", 0).when(F.col("source") == "models", 1).otherwise(2)
    best = targets.groupBy(normalize_target_id(F.col("target_id")).alias("id"), "type").agg(
        F.min_by(F.struct("source", "downloads", "private"), F.struct(place, -F.col("downloads"))).alias("b")
    )
    return best.select("id", "type", "b.*")


def select_targets(targets: DataFrame, downloads: int, n: int) -> DataFrame:
    """Public targets with enough downloads, each id once with its highest count."""
    kept = targets.where((F.col("downloads") >= downloads) & ~F.col("private") & F.col("target_id").isNotNull())
    return kept.groupBy("target_id").agg(F.max("downloads").alias("downloads")).orderBy(F.desc("downloads"), "target_id").limit(n)


def new_targets(found: DataFrame, known: DataFrame) -> DataFrame:
    key = lambda df: df.select(normalize_target_id(F.col("target_id")).alias("id")).distinct()
    return key(found).join(key(known), "id", "left_anti")


def one_per_org(targets: DataFrame, excluded: DataFrame, least: int, n: int, allowed: DataFrame | None = None) -> DataFrame:
    """The most downloaded target of each organisation that is not excluded, and allowed where a list is given; names without an
    organisation do not count."""
    rows = targets.where((F.col("downloads") >= least) & F.col("target_id").contains("/")).withColumn("org", F.split("target_id", "/")[0]).join(excluded, "org", "left_anti")
    if allowed is not None:
        rows = rows.join(allowed, "org", "left_semi")
    best = rows.groupBy("org").agg(F.min_by(F.struct("target_id", "downloads"), F.struct(-F.col("downloads"), F.col("target_id"))).alias("b"))
    return best.select("org", "b.*").orderBy(F.desc("downloads"), "org").limit(n)


def search_targets(targets: DataFrame, reports: DataFrame) -> DataFrame:
    have = reports.select(normalize_target_id(F.col("model_id")).alias("id")).distinct().withColumn("r", F.lit(True))
    rows = targets.withColumn("id", normalize_target_id(F.col("target_id"))).join(have, "id", "left")
    return rows.groupBy("type", F.coalesce("r", F.lit(False)).alias("has_report")).agg(F.count(F.lit(1)).alias("targets"))
