"""Personal data: fixed patterns plus weakly supervised spans."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint
from .spans import joined, pieces, positions, split_at, unmarked

# Base patterns. A match starts at the end of the one before it (\G) or where its first class starts, and the
# repeats are possessive: the same matches as the plain patterns, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates that only the method may add.
WRITTEN = (
    r"(?i)(?<![a-z0-9._+-])[a-z0-9._+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[a-z0-9-]++)++"
)
LOCAL = r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"

BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE,
    "written": WRITTEN, "local": LOCAL, "ssn": SSN, "iban": IBAN, "name": NAME,
}
KINDS = {k: i for i, k in enumerate(PATTERNS)}

# Fixed values of the labelers.
CONTEXT_FOR = {
    "email": r"(?i)e-?mail|contact|write|reach|courriel|kontakt|correo|escrib",
    "ip": r"(?i)\bip\b|host|server|address|adresse|login|client|direcci",
    "card": r"(?i)card|visa|master|amex|carte|karte|tarjeta|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell|appel|anruf|llam",
    "written": r"(?i)e-?mail|contact|write|reach|courriel|kontakt|correo",
    "local": r"(?i)phone|tel|call|mobile|fax|cell|number|appel|anruf|llam",
    "ssn": r"(?i)ssn|social|security|\bid\b|sozial|seguro",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta|transfer",
    "name": r"(?i)dear|by|from|with|name|sign|regards|lieb|cher|estimad",
}
CONTEXT_AGAINST = r"(?i)version|\bv\.?\s*$|isbn|issn|\bno\.?\s*$|order|invoice|item|sku|fig|page|section|total|\$\s*$|#\s*$"
#: Gazetteers, as patterns over the span: top-level domains, card issuers, country codes, area codes, bank countries.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5))",
    "phone": r"^\+(1|33|34|39|41|43|44|49)[^0-9]?",
    "written": r"(?i)(\.|dot\x20?[\])]\x20?)(com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$",
    "local": r"^\(?[2-9]",
    "ssn": r"^(?!000|666|9)",
    "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "name": r"(?i)(smith|jones|brown|miller|garc|mart|m[uü]ller|schmidt|dupont|durand|john|mary|anna|peter|paul|jean|marie|jos|carlos)",
}
VOTERS = ("form", "context", "known", "shape")
#: Features of a span that only the classifier sees.
TRAITS = ("size", "digits", "breaks", "before_it")
ROUNDS, PRIOR, THRESHOLD = 30, 0.5, 0.5


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a string of digits."""
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    """The checks of the base kinds; candidates of the other kinds pass."""
    number = digits(found)
    return (
        F.when(kind == "ip", found.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"))
        .when(kind == "card", F.length(number).between(12, 19) & luhn(number))
        .when(kind == "phone", F.length(number).between(9, 15))
        .otherwise(True)
    )


def _by_kind(kind: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in choices.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def votes(kind: Column, found: Column, before: Column) -> dict[str, Column]:
    """Labelers: 1 personal, -1 not personal, 0 no opinion. ``form`` is a check of the value, ``context`` the words
    before it, ``known`` a gazetteer, ``shape`` the variety of its characters."""
    number = digits(found)
    form = _by_kind(kind, {
        "email": F.when(found.rlike(r"^[^.][^@]*[^.]@[^-].*[^-]$") & ~found.contains(".."), 1).otherwise(-1),
        "ip": F.when(found.rlike(r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){3}$"), 1).otherwise(-1),
        "card": F.when(F.length(number).isin(13, 14, 15, 16, 19), 1).otherwise(-1),
        "phone": F.when(F.length(number).between(10, 13), 1).otherwise(0),
        "written": F.lit(1),
        "local": F.when(found.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"), 1).otherwise(-1),
        "ssn": F.when(found.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 1).otherwise(-1),
        "iban": F.when(F.length(F.replace(found, F.lit(" "), F.lit(""))).between(15, 34), 1).otherwise(-1),
        "name": F.lit(0),
    })
    context = F.when(before.rlike(CONTEXT_AGAINST), -1).when(
        _by_kind(kind, {k: before.rlike(v) for k, v in CONTEXT_FOR.items()}), 1
    )
    known = F.when(_by_kind(kind, {k: found.rlike(v) for k, v in GAZETTEER.items()}), 1).otherwise(-1)
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(found, "[^0-9A-Za-z]", ""), "")))
    shape = F.when(variety >= 5, 1).when(variety <= 3, -1)
    return {k: F.coalesce(v, F.lit(0)).cast("int") for k, v in zip(VOTERS, (form, context, known, shape), strict=True)}


def estimate(counts: dict[tuple, int], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Posterior of "personal" for each (kind, votes...) by expectation-maximisation.

    Two latent classes per kind; labelers are independent given the class. Reliabilities start above chance and
    are smoothed, so a kind with few candidates keeps the start values. The input has a row per distinct pattern,
    at most len(PATTERNS) * 3 ** len(VOTERS) of them.
    """
    posterior: dict[tuple, float] = {}
    for kind in sorted({key[0] for key in counts}):
        rows = {key[1:]: n for key, n in counts.items() if key[0] == kind}
        prior = PRIOR
        yes = [{1: 0.7, 0: 0.2, -1: 0.1} for _ in VOTERS]
        no = [{1: 0.2, 0: 0.3, -1: 0.5} for _ in VOTERS]
        for _ in range(rounds):
            post = {}
            for pattern in rows:
                a = math.log(prior) + sum(math.log(yes[i][v]) for i, v in enumerate(pattern))
                b = math.log(1 - prior) + sum(math.log(no[i][v]) for i, v in enumerate(pattern))
                post[pattern] = 1 / (1 + math.exp(min(700, b - a)))
            total = sum(rows.values())
            mass = sum(n * post[p] for p, n in rows.items())
            prior = min(0.99, max(0.01, (mass + 5) / (total + 10)))
            for i in range(len(VOTERS)):
                for v, start_yes, start_no in ((1, 7, 2), (0, 2, 3), (-1, 1, 5)):
                    yes[i][v] = (start_yes + sum(n * post[p] for p, n in rows.items() if p[i] == v)) / (10 + mass)
                    no[i][v] = (start_no + sum(n * (1 - post[p]) for p, n in rows.items() if p[i] == v)) / (10 + total - mass)
        posterior |= {(kind, *p): x for p, x in post.items()}
    return posterior


def traits(found: Column, before: Column) -> dict[str, Column]:
    """Of a span: its length (powers of two), share of digits (quarters), what breaks it, the kind of character before it.
    Each has a fixed number of values, as text."""
    inner = F.when(found.contains(" "), "space").when(found.contains("-"), "dash").when(found.contains("."), "dot").otherwise("none")
    last = F.right(before, F.lit(1))
    kind = F.when(last == "", "start").when(last.rlike(r"\p{L}"), "letter").when(last.rlike(r"[0-9]"), "digit").when(last.rlike(r"\s"), "space")
    return {
        "size": F.least(F.floor(F.log2(F.length(found))), F.lit(7)).cast("string"),
        "digits": F.floor(4 * F.length(digits(found)) / F.length(found)).cast("string"),
        "breaks": inner,
        "before_it": kind.otherwise("mark"),
    }


def names_of(key: tuple) -> list[str]:
    """Features of a row of the pattern table: kind, votes, traits."""
    return [key[0], *(f"{n}={x}" for n, x in zip((*VOTERS, *TRAITS), key[1:], strict=False))]


def train(counts: dict[tuple, int], posterior: dict[tuple, float], rounds: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Logistic span classifier on the soft labels: a weight per kind, per (labeler, vote) and per (trait, value).

    ``counts`` has a row for each pattern (kind, votes, traits); ``posterior`` one for each (kind, votes).
    """
    keys = sorted(counts)
    names = sorted({n for key in keys for n in names_of(key)})
    at = {n: i for i, n in enumerate(names)}
    weights = np.zeros(len(names))
    if keys:
        index = np.array([[at[n] for n in names_of(key)] for key in keys])
        share = np.array([counts[key] for key in keys], float) / sum(counts.values())
        label = np.array([posterior[key[: 1 + len(VOTERS)]] for key in keys])
        for _ in range(rounds):
            error = share * (label - 1 / (1 + np.exp(-weights[index].sum(1))))
            slope = np.bincount(index.ravel(), np.repeat(error, index.shape[1]), len(names))
            weights += rate * (slope - 1e-4 * weights)
    return dict(zip(names, weights.tolist(), strict=True))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Spans of personal data in whole texts.

    ``email``, ``ip``, ``card`` and ``phone`` are fixed patterns with their checks; these spans always stay. Further
    candidates (written-out addresses, local phone numbers, social security numbers, account numbers, titled names)
    are judged by weak supervision: regex, gazetteer and context labelers vote on every candidate of every kind,
    expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and a logistic
    classifier of kind, votes and traits of the span, trained on its posteriors, decides. Only the table of patterns, whose
    size has a fixed bound, comes to the driver.

    Returns one row per input row: ``id_col, n_email, n_ip, n_card, n_phone, n_added, n_spans, base_spans, spans`` with spans as
    ``kind:start:end`` (code points, end exclusive), by start, then kind, joined by commas.

    * null and empty texts have no spans; other columns of ``docs`` are ignored, whatever their names;
    * rows are told apart by a row number of their own, so repeated and null identifiers are safe;
    * an empty table gives an empty result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), unmarked(F.col(text_col)).alias("text")
    )
    rows = rows.select("uid", "id", *[split_at(F.col("text"), p).alias(k) for k, p in PATTERNS.items()])
    rows = rows.select("uid", "id", F.concat(*[pieces(k, F.col(k)) for k in PATTERNS]).alias("pieces"))
    rows = shared_checkpoint(rows)

    spans = positions(rows.where(F.size("pieces") > 0)).where(valid(F.col("kind"), F.col("found")))
    before = F.coalesce("before", F.lit(""))
    cast = votes(F.col("kind"), F.col("found"), before) | traits(F.col("found"), before)
    spans = shared_checkpoint(spans.select("uid", "kind", "start", "end", *[v.alias(k) for k, v in cast.items()]))

    counts = {tuple(r)[:-1]: r["count"] for r in spans.groupBy("kind", *cast).count().collect()}
    patterns: dict[tuple, int] = {}
    for key, n in counts.items():
        patterns[key[: 1 + len(VOTERS)]] = patterns.get(key[: 1 + len(VOTERS)], 0) + n
    weights = train(counts, estimate(patterns))
    table = F.create_map(*[F.lit(x) for name, w in (weights or {"": 0.0}).items() for x in (name, w)])
    features = [F.col("kind"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cast]]
    score = F.aggregate(F.transform(F.array(*features), lambda x: F.coalesce(table[x], F.lit(0.0))), F.lit(0.0), lambda total, x: total + x)
    base = F.col("kind").isin(*BASE)
    spans = spans.where(base | (1 / (1 + F.exp(-score)) >= threshold))

    found = spans.groupBy("uid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.count_if(~base).alias("n_added"),
        F.count(F.lit(1)).alias("n_spans"),
        joined(base, KINDS).alias("base_spans"),
        joined(F.lit(True), KINDS).alias("spans"),
    )
    return rows.select("uid", "id").join(found, "uid", "left").select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (*BASE, "added", "spans")],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
