"""Validation of JSON records: contracts, business rules, summaries.

Records stay VARIANT values, so that a share written as text is seen as text. NaN literals are parse errors.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROYALTY, DATA = "royalty_receipt.v1", "data_receipt.v1"
SHARE_TOLERANCE = 0.02
MONTH = r"^\d{4}-\d{2}$"
SHA256 = r"^[0-9a-f]{64}$"

# The contracts. Each field: type, then constraints; "!" marks a required field. Types: s string, i integer,
# n number, o object, a array. Constraints: min=, len= (least length), items= (least items), re=, in=, keys= (least keys).
CONTRACTS: dict[str, dict] = {
    "shapley.v1": {
        "schema": "s!", "request_id": "s!", "timestamp": "s!", "method": "s!", "top_k": "a!", "method_details": "o", "k": "i", "B": "i",
        "ci_samples": "i", "dp_epsilon": "n", "model_hash": "s", "pack_hash": "s", "signature": "s",
        "top_k[]": {"rank": "i!", "index": "i!", "label": "s!", "score_mean": "n!", "share": "n!", "score_lo95": "n?", "score_hi95": "n?"},
    },
    "payouts.v1": {
        "schema": "s!", "provider_id": "s! len=1", "period": f"s! re={MONTH}", "amount": "n!", "currency": "s len=3", "share_agg": "n min=0",
        "gross_revenue": "n min=0", "policies_applied": "a", "meta": "o",
    },
    ROYALTY: {
        "schema": "s!", "output_id": "s! len=1", "model_id": "s! len=1", "timestamp": "s!", "attribution_scope": "s! len=1", "top_k": "a! items=1",
        "hash_model": "s! len=8", "hash_data_index": "s! len=8", "request_id": "s", "usage": "o", "epsilon_dp": "n min=0", "signature": "s len=1",
        "license_refs": "a", "policy_applied": "a", "proof_ref": "o", "meta": "o",
        "top_k[]": {"rank": "i! min=1", "provider_id": "s! len=1", "shard_id": "s! len=1", "share": "n! min=0", "share_ci95_low": "n min=0",
                    "share_ci95_high": "n min=0", "raw_score": "n", "shapley_value": "n", "meta": "o"},
        "license_refs[]": {"license_id": "s! len=1", "scope": "s in=train|rag|fine-tune|other", "terms": "s"},
        "proof_ref{}": {"hashchain_id": "s", "offset": "i min=0"},
        "usage{}": {"input_tokens": "i min=0", "output_tokens": "i min=0"},
    },
    "trust_bundle.v1": {
        "schema": "s!", "period": f"s! re={MONTH}", "created_at": "s!", "bundle_id": "s! len=1", "inputs": "o! keys=1", "artifacts": "o! keys=1",
        "producer": "s", "version": "s", "stats": "o",
    },
    "trust_drift.v1": {
        "schema": "s!", "dataset_id": "s! len=1", "from": f"s! re={MONTH}", "to": f"s! re={MONTH}", "trust_before": "n!", "trust_after": "n!",
        "delta": "n!", "signals": "o!", "inputs": "a!", "model_id": "s", "engine": "o", "signature": "s", "meta": "o",
    },
    "spider_receipt.v1": {
        "schema": "s!", "id": "s! len=1", "content_id": "s! len=1", "period": f"s! re={MONTH}", "timestamp": "s!", "meta": "o!", "provider_id": "s",
        "provider_type": "s", "output_id": "s", "share": "n", "royalty_share": "n", "royalty_amount": "n", "provider_share_sum": "n",
        "total_royalties": "o",
    },
    DATA: {
        "schema": "s!", "id": "s! len=1", "provider_id": "s! len=1", "content_id": "s! len=1", "timestamp": "s!", "period": f"s! re={MONTH}",
        "provider_type": "s", "meta": "o",
    },
}
_TYPES = {"n": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}
_ISSUE = "array<struct<path:string,rule:string>>"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns`` computed once: filters are not pushed below a generator, so none of them computes a column again."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``record`` (VARIANT, null for broken lines) and ``kind`` (its outer type); blank lines go."""
    rows = once(lines.where(F.trim(column) != ""), record=F.try_parse_json(column))
    # the schema of a whole record is long, its first character is enough for the two types that have long ones
    outer = F.when(F.startswith(F.col(column), F.lit("{")), "OBJECT").when(F.startswith(F.col(column), F.lit("[")), "ARRAY")
    kind = F.coalesce(outer, F.regexp_extract(F.schema_of_variant("record"), "^[A-Z]+", 0))
    return rows.withColumn("kind", F.when(F.col("record").isNull(), "BROKEN").otherwise(kind))


def _get(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


_RULE = ("name", "kind", "required", "nullable", "len", "min", "re", "in", "items", "keys")


_RULES = "array<struct<name:string,kind:string,required:boolean,nullable:boolean,len:int,min:double,re:string,`in`:string,items:int,keys:int>>"


def _rules(fields: dict) -> list[dict]:
    rows = []
    for name, rule in fields.items():
        if isinstance(rule, str):
            kind, *limits = rule.split(" ")
            bounds = {k: float(v) if k == "min" else v if k in ("re", "in") else int(v) for k, v in (x.split("=", 1) for x in limits)}
            values = [name, "in" if kind[0] == "n" else kind[0], "!" in kind, kind.endswith("?"), *[bounds.get(k) for k in _RULE[4:]]]
            rows.append(dict(zip(_RULE, values, strict=True)))
    return rows


def _contracts() -> Column:
    """Literal MAP from schema to its rules: the plan holds data, not an expression per field."""
    known = {
        sid: {"top": _rules(c), "inner": [{"parent": n[:-2], "many": n.endswith("[]"), "rules": _rules(f)} for n, f in c.items() if isinstance(f, dict)]}
        for sid, c in CONTRACTS.items()
    }
    return F.from_json(F.lit(json.dumps(known)), f"map<string,struct<top:{_RULES},inner:array<struct<parent:string,many:boolean,rules:{_RULES}>>>>")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once for each time that ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _letter(value: Column) -> Column:
    """Type letter of a VARIANT, as in CONTRACTS; integers are numbers too."""
    return _bind(
        F.schema_of_variant(value),
        lambda kind: F.when(kind == "STRING", "s").when(kind.startswith("OBJECT"), "o").when(kind.startswith("ARRAY"), "a")
        .when((kind == "BIGINT") | kind.endswith(",0)"), "i").when(kind.rlike(_TYPES["n"]), "n").otherwise("-"),
    )


def _broken(members: Column, rules: Column, prefix: Column) -> Column:
    """ARRAY of (path, rule) for a MAP of an object's members.

    Lambdas are interpreted, so absent members and rules without limits end early.
    """
    none = F.expr(f"cast(array() as {_ISSUE})")

    def one(rule: Column) -> Column:
        return _bind(F.try_element_at(members, rule["name"]), lambda value: present(rule, value))

    def issue(rule: Column, name: str) -> Column:
        return F.struct(F.concat(prefix, rule["name"]).alias("path"), F.lit(name).alias("rule"))

    def present(rule: Column, value: Column) -> Column:
        return (
            F.when(value.isNull(), F.when(rule["required"], F.array(issue(rule, "required"))).otherwise(none))
            .when(rule["nullable"] & F.is_variant_null(value), none)
            .when(F.instr(rule["kind"], _letter(value)) == 0, F.array(issue(rule, "type")))
            .when(F.coalesce(*[rule[x].cast("string") for x in _RULE[4:]]).isNull(), none)
            .otherwise(limits(rule, value))
        )

    def limits(rule: Column, value: Column) -> Column:
        text, number = _get(value, "$", "string"), _get(value, "$", "double")
        tests = {
            "len": rule["len"].isNotNull() & (F.length(text) < rule["len"]),
            "min": rule["min"].isNotNull() & (number < rule["min"]),
            "re": rule["re"].isNotNull() & ~F.regexp_like(text, rule["re"]),
            "in": rule["in"].isNotNull() & ~F.array_contains(F.split(rule["in"], "[|]"), text),
            "items": rule["items"].isNotNull() & (F.size(_get(value, "$", "array<variant>")) < rule["items"]),
            "keys": rule["keys"].isNotNull() & (F.size(_get(value, "$", "map<string,variant>")) < rule["keys"]),
        }
        return F.array_compact(F.array(*[F.when(test, issue(rule, name)) for name, test in tests.items()]))

    return F.flatten(F.transform(rules, one))


def contract_issues(record: Column, schema_id: str | Column) -> Column:
    """ARRAY of (path, rule) that ``record`` breaks; empty if it keeps the contract, null for an unknown schema."""
    def part(members: Column, p: Column) -> Column:
        value = F.try_element_at(members, p["parent"])
        items = F.when(p["many"], _get(value, "$", "array<variant>")).when(value.isNotNull(), F.array(value))
        prefix = F.concat(p["parent"], F.when(p["many"], "[].").otherwise("."))

        def item(x: Column) -> Column:
            return _bind(_get(x, "$", "map<string,variant>"), checked)

        def checked(inside: Column) -> Column:
            odd = F.array(F.struct(F.rtrim(prefix, F.lit(".")).alias("path"), F.lit("type").alias("rule")))
            return F.when(inside.isNull() & p["many"], odd).otherwise(F.coalesce(_broken(inside, p["rules"], prefix), F.expr(f"cast(array() as {_ISSUE})")))

        return F.coalesce(F.flatten(F.transform(items, item)), F.expr(f"cast(array() as {_ISSUE})"))

    def parts(members: Column, contract: Column) -> Column:
        return F.concat(_broken(members, contract["top"], F.lit("")), F.flatten(F.transform(contract["inner"], lambda p: part(members, p))))

    rules = F.try_element_at(_contracts(), F.lit(schema_id) if isinstance(schema_id, str) else schema_id)
    return _bind(_get(record, "$", "map<string,variant>"), lambda m: _bind(rules, lambda c: parts(m, c)))


def _keeps(members: Column, fields: dict, inner: dict) -> Column:
    """Whether a STRUCT of an object's members keeps ``fields``; ``inner`` has the rules of its members' members."""
    tests = [_keeps_rule(members[r["name"]], r, {n[len(r["name"]) :]: f for n, f in inner.items() if n[:-2] == r["name"]}) for r in _rules(fields)]
    return reduce(lambda x, y: x & y, tests)


def _keeps_rule(value: Column, rule: dict, inner: dict) -> Column:
    kind = rule["kind"]
    wrong = lambda test: F.coalesce(~test, F.lit(True))  # noqa: E731  limits that cannot be told are kept
    if kind in ("a", "o"):  # the type is told by a cast, the schema of a list of objects is long
        (form, fields), *_ = [*inner.items(), (None, None)]
        shape = _struct(fields) if fields else "variant"
        typed = {"a": f"array<{shape}>", "o": shape if fields else "map<string,variant>"}[kind]

        def whole(x: Column) -> Column:
            tests = [x.isNotNull()]
            tests += [wrong(F.size(x) < rule[n]) for n in ("items", "keys") if rule[n] is not None]
            if form == "[]":
                tests += [F.forall(x, lambda e: e.isNotNull() & _keeps(e, fields, {}))]
            elif form == "{}":
                tests += [_keeps(x, fields, {})]
            return reduce(lambda a, b: a & b, tests)

        fits = _bind(_get(value, "$", typed), whole)
    else:
        named = F.schema_of_variant(value)
        if kind == "s":
            tests, text = [named == "STRING"], _get(value, "$", "string")
            tests += [wrong(F.length(text) < rule["len"])] if rule["len"] is not None else []
            tests += [wrong(~F.regexp_like(text, F.lit(rule["re"])))] if rule["re"] is not None else []
            tests += [wrong(~text.isin(*rule["in"].split("|")))] if rule["in"] is not None else []
        else:
            whole_number = lambda k: (k == "BIGINT") | k.endswith(",0)")
            number = lambda k: (k == "BIGINT") | k.startswith("DECIMAL") | k.startswith("DOUBLE") | k.startswith("FLOAT")
            tests = [_bind(named, whole_number if kind == "i" else number)]
            tests += [wrong(_get(value, "$", "double") < rule["min"])] if rule["min"] is not None else []
        fits = reduce(lambda a, b: a & b, tests)
    if rule["nullable"]:
        fits = F.is_variant_null(value) | fits
    return F.when(value.isNull(), F.lit(not rule["required"])).otherwise(fits)


def _struct(fields: dict) -> str:
    return "struct<" + ",".join(f"`{n}`:variant" for n, f in fields.items() if isinstance(f, str)) + ">"


def keeps_contract(record: Column, schema_id: str | Column) -> Column:
    """Whether ``contract_issues`` finds nothing (null for an unknown schema or no object): fixed tests, which stop at the first miss."""
    one = lambda sid: _bind(_get(record, "$", _struct(CONTRACTS[sid])), lambda m: _keeps(m, CONTRACTS[sid], {n: f for n, f in CONTRACTS[sid].items() if isinstance(f, dict)}))
    if isinstance(schema_id, str):
        return one(schema_id) if schema_id in CONTRACTS else F.lit(None).cast("boolean")
    return reduce(lambda case, sid: case.when(schema_id == sid, one(sid)), CONTRACTS, F.when(F.lit(False), F.lit(None).cast("boolean")))


def check_contract(records: DataFrame, schema_id: str) -> DataFrame:
    """Add ``contract_issues`` for one schema."""
    keeps = F.coalesce(keeps_contract(F.col("record"), schema_id), F.lit(False))
    none = F.expr(f"cast(array() as {_ISSUE})")
    return once(records, contract_issues=F.when(keeps, none).otherwise(contract_issues(F.col("record"), schema_id)))


def _code(code: str, level: str = "ERROR") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))


_CODES = "array<struct<code:string,level:string>>"
_NONE = f"cast(array() as {_CODES})"


def royalty_issues(record: Column) -> Column:
    """ARRAY of (code, level) by the rules of royalty receipts; the record itself is not checked against its contract."""
    schema = _get(record, "$.schema", "string")
    output_id = _get(record, "$.output_id", "string")
    top_k = _get(record, "$.top_k", "array<struct<share:variant,rank:variant>>")  # null for what is no object
    none = F.expr(_NONE)
    start = F.struct(
        none.alias("issues"), F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("total"), F.lit(0).alias("n")
    )

    def read(entry: Column) -> Column:
        """What the rules ask of an entry, computed once: its share and rank as numbers, and which of them it has."""
        is_number = lambda k: (k == "BIGINT") | k.startswith("DECIMAL") | k.startswith("DOUBLE") | k.startswith("FLOAT")
        return F.struct(
            entry.isNotNull().alias("is_object"), F.coalesce(_bind(F.schema_of_variant(entry["share"]), is_number), F.lit(False)).alias("numeric"),
            _get(entry["share"], "$", "double").alias("value"), _get(entry["rank"], "$", "long").alias("number"),
            (entry["rank"].isNotNull() & ~F.is_variant_null(entry["rank"])).alias("has_rank"),
        )

    def step(state: Column, e: Column) -> Column:
        good = e["is_object"] & e["numeric"]
        found = F.array_compact(F.array(
            F.when(~e["is_object"], _code("TOPK_NOT_OBJECT")),
            F.when(e["is_object"] & ~e["numeric"], _code("MISSING_SHARE")),
            F.when(good & (e["value"] < 0), _code("NEGATIVE_SHARE")),
            F.when(good & e["has_rank"] & (e["number"] < state["last"]), _code("RANK_NOT_MONOTONE")),
            F.when(good & e["has_rank"] & e["number"].isNull(), _code("RANK_NOT_INT", "WARN")),
        ))
        return F.struct(
            F.concat(state["issues"], found).alias("issues"),
            F.when(good, F.coalesce(e["number"], state["last"])).otherwise(state["last"]).alias("last"),
            (state["total"] + F.when(good, e["value"]).otherwise(0.0)).alias("total"),
            (state["n"] + F.when(good, 1).otherwise(0)).alias("n"),
        )

    def of_entries(es: Column) -> Column:
        """Entries that have all they need, in order of their ranks, are only summed."""
        plain = F.forall(es, lambda e: e["numeric"] & (e["value"] >= 0) & e["number"].isNotNull())
        ranks = F.transform(es, lambda e: e["number"])
        ordered = F.forall(F.zip_with(F.slice(ranks, F.lit(1), F.size(ranks) - 1), F.slice(ranks, F.lit(2), F.size(ranks) - 1), lambda x, y: x <= y), lambda x: x)
        total = F.aggregate(es, F.lit(0.0), lambda s, e: s + e["value"])
        summed = lambda x: finish(F.struct(none.alias("issues"), x.alias("total"), F.size(es).alias("n")))
        return F.when(F.coalesce(plain, F.lit(False)) & ordered, _bind(total, summed)).otherwise(F.aggregate(es, start, step, finish))

    def finish(state: Column) -> Column:
        finite = F.abs(state["total"]) < float("inf")
        last = F.array_compact(F.array(
            F.when((state["n"] > 0) & ~finite, _code("SHARE_NOT_FINITE")),
            F.when((state["n"] > 0) & finite & (F.abs(state["total"] - 1) > SHARE_TOLERANCE), _code("SUM_SHARE_NOT_1", "WARN")),
        ))
        return F.concat(state["issues"], last)

    first = F.array_compact(F.array(F.when(F.coalesce(output_id, F.lit("")) == "", _code("MISSING_OUTPUT_ID"))))
    issues = lambda top: F.when(F.coalesce(F.size(top) < 1, F.lit(True)), F.concat(first, F.array(_code("MISSING_TOPK")))).otherwise(
        F.concat(first, _bind(F.transform(top, read), of_entries)))
    return F.when(F.coalesce(schema != ROYALTY, F.lit(True)), F.array(_code("BAD_SCHEMA"))).otherwise(_bind(top_k, issues))


def data_receipt_issues(record: Column) -> Column:
    """Provider, content and timestamp have to be strings that are not blank."""
    issues = []
    for name, code in (("provider_id", "MISSING_PROVIDER_ID"), ("content_id", "MISSING_CONTENT_ID"), ("timestamp", "MISSING_TIMESTAMP")):
        value = _get(record, f"$.{name}", "variant")
        text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)) & (F.trim(_get(record, f"$.{name}", "string")) != "")
        issues.append(F.when(~F.coalesce(text, F.lit(False)), _code(code)))
    return F.array_compact(F.array(*issues))


def classify_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``issues`` and ``status`` (ERROR, WARN or VALID) to every line that is not blank; a line counts once.

    Contract errors end the checks of a record, except that data receipts only get a warning for them.
    """
    rows = parse(lines, column)
    rows = rows.withColumn("schema_id", F.when(F.col("kind") == "OBJECT", _get(F.col("record"), "$.schema", "string")))
    broken = ~F.coalesce(keeps_contract(F.col("record"), F.col("schema_id")), F.lit(False))
    data = F.col("schema_id") == DATA
    one = lambda code, level="ERROR": F.array(_code(code, level))
    warned = F.concat(one("SCHEMA_VALIDATE_DATA_WARN", "WARN"), data_receipt_issues(F.col("record")))
    by_rules = F.when(data, data_receipt_issues(F.col("record"))).when(F.col("schema_id") == ROYALTY, royalty_issues(F.col("record")))
    issues = (
        F.when(F.col("kind") == "BROKEN", one("JSON_DECODE_ERROR"))
        .when(F.col("kind") != "OBJECT", one("RECORD_NOT_OBJECT"))
        .otherwise(
            _bind(broken, lambda b: F.when(data & b, warned).when(b, one("SCHEMA_VALIDATE_ERROR")).otherwise(F.coalesce(by_rules, one("UNKNOWN_SCHEMA"))))
        )
    )
    rows = rows.withColumn("issues", issues)
    has = lambda level: F.exists("issues", lambda i: i["level"] == level)
    return rows.withColumn("status", F.when(has("ERROR"), "ERROR").when(has("WARN"), "WARN").otherwise("VALID"))


def validation_summary(classified: DataFrame) -> DataFrame:
    """One row: total, valid, errors, warns and the health grade A to D."""
    counts = classified.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("VALID", "valid"), ("ERROR", "errors"), ("WARN", "warns"))]
    )
    share = F.col("errors") / F.col("total")
    health = (
        F.when(F.col("total") == 0, "D").when((F.col("errors") == 0) & (F.col("warns") == 0), "A").when(share <= 0.01, "B").when(share <= 0.05, "C").otherwise("D")
    )
    return counts.withColumn("health", health)


def _each_issue(classified: DataFrame, *columns: str) -> DataFrame:
    """A row per issue. A plain explode makes Spark filter by size first, which computes the issues once more."""
    return classified.select(*columns, F.posexplode_outer("issues").alias("place", "i")).where(F.col("i").isNotNull())


def issue_counts(classified: DataFrame) -> DataFrame:
    """Issues per code; order them by (-n, code) at the sink."""
    return _each_issue(classified).groupBy("i.code").agg(F.count(F.lit(1)).alias("n"))


def bad_sample(classified: DataFrame, max_bad: int, order: str = "line_no") -> DataFrame:
    """The first issues in line order: a report of ``max_bad`` rows."""
    each = _each_issue(classified, order)
    return each.orderBy(order, "place").limit(max_bad).select(order, "place", "i.code", "i.level")


def qa_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts whose shares leave [0.99, 1.01], that have a negative share, or whose ranks are not in order."""
    total = F.aggregate("top_k", F.lit(0.0), lambda s, e: s + F.coalesce(e["share"], F.lit(0.0)))
    ranks = F.transform("top_k", lambda e: e["rank"])
    return receipts.agg(
        F.count(F.lit(1)).alias("receipts"),
        F.count_if((total < 0.99) | (total > 1.01)).alias("bad_sum"),
        F.count_if(F.exists("top_k", lambda e: e["share"] < 0)).alias("negative"),
        F.count_if(ranks != F.array_sort(ranks)).alias("unsorted"),
    )


def refine_receipts(receipts: DataFrame) -> DataFrame:
    """Normalise shares (8 decimals) where their sum misses 1 by over 0.02, order entries by rank where they are not.

    ``fixed_sum`` tells which rows had their shares changed.
    """
    total = F.aggregate("top_k", F.lit(0.0), lambda s, e: s + F.coalesce(e["share"], F.lit(0.0)))
    rows = receipts.withColumn("__total", total).withColumn("fixed_sum", (F.size("top_k") > 0) & (F.abs(F.col("__total") - 1) > SHARE_TOLERANCE))
    by_rank = F.array_sort("top_k", lambda a, b: F.coalesce(a["rank"], F.lit(0)) - F.coalesce(b["rank"], F.lit(0)))
    rows = rows.withColumn("top_k", by_rank)
    scaled = F.transform("top_k", lambda e: e.withField("share", F.round(e["share"] / F.col("__total"), 8)))
    change = F.col("fixed_sum") & (F.col("__total") > 0)
    return rows.withColumn("top_k", F.when(change, scaled).otherwise(F.col("top_k"))).drop("__total")


def check_spider_receipts(receipts: DataFrame) -> DataFrame:
    """Presence receipts by schema constant and identifier prefixes: counts of ok and failed rows."""
    ok = (
        (F.col("schema") == "spider_receipt.v2") & F.col("receipt_id").startswith("sr_sha256:") & F.col("content_id").startswith("cid:url_sha256:")
    )
    return receipts.agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def profile_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Counts over all lines: ``(what, name, n)`` for parsing, schemas, field names and signatures."""
    rows = parse(lines, column)
    said = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    schema = F.coalesce(_get(F.col("record"), "$.schema", "string"), F.lit("none"))
    signed = F.coalesce(_get(F.col("record"), "$.signature", "string"), F.lit("")) != ""
    fields = F.transform(F.map_keys(_get(F.col("record"), "$", "map<string,variant>")), lambda k: said("field", k))
    line = F.array(said("line", F.when(F.col("kind") == "BROKEN", "broken").otherwise("parsed")))
    of_object = F.concat(F.array(said("schema", schema), said("signed", F.when(signed, "yes").otherwise("no"))), fields)
    each = rows.select(F.inline_outer(F.when(F.col("kind") == "OBJECT", F.concat(line, of_object)).otherwise(line)))
    return each.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


def check_tables(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table and required column: whether it exists, rows of the table, nulls in the column; one scan a table."""
    out = None
    for name, (df, required) in tables.items():
        there = [c for c in required if c in df.columns]
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(there)])
        cells = [
            F.struct(F.lit(c).alias("column"), F.lit(c in there).alias("present"), (F.col(f"n_{there.index(c)}") if c in there else F.lit(None).cast("long")).alias("nulls"))
            for c in required
        ]
        rows = counts.select(F.lit(name).alias("table_name"), "rows", F.explode(F.array(*cells)).alias("c")).select("table_name", "rows", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out
