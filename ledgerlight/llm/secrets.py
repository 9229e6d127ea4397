"""Secret scan: fixed patterns plus a randomness test battery with false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint
from .spans import INNER, joined, pieces, positions, split_at, unmarked

# Base patterns. Runs are matched possessively from their first character, which gives the same
# matches as the plain patterns in time linear in the text.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+)([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
ASSIGN_MIN = 12

#: Tokens that the battery sees: maximal runs of at least MIN_TOKEN characters. Shorter ones cannot be told
#: from words by these tests.
MIN_TOKEN = 16
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+={{0,2}}"

# The alphabets of the encodings, in their natural order. The first that holds every character
# of a token is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Sum of p^2 and of p^3 over English letters and their share in a-f: the word null where the corpus has no
#: ordinary token.
ENGLISH = (0.0655, 0.0054, 0.315)
#: Rate of digits, and of capitals inside mixed-case tokens, in ordinary tokens.
RARE = 0.02
#: The battery's level under randomness, the false-discovery rate, and histogram bins a decade of p.
ALPHA, FDR, BINS, LAST_BIN = 0.001, 0.05, 10, 400


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by the polynomial of Abramowitz and Stegun 26.2.17, absolute error below 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _normal_tail(z)).otherwise(1 - _normal_tail(-z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))


def _excess(count: Column, n: Column) -> Column:
    """Log of Chernoff's bound for ``count`` of ``n`` at the rate RARE."""
    share = F.least(count / n, F.lit(1 - 1e-9))
    bound = -n * (share * F.log(share / RARE) + (1 - share) * F.log((1 - share) / (1 - RARE)))
    return F.when(share > RARE, bound).otherwise(0.0)


def battery(tokens: DataFrame, word_null: DataFrame) -> DataFrame:
    """Add ``encoding, p_random, p_text`` to tokens (column ``found``).

    ``p_random`` is the Bonferroni p-value of three tests of uniform randomness over the inferred alphabet:
    chi-squared uniformity, the runs test about the alphabet's middle, lag-1 serial correlation.
    ``p_text`` bounds the chance that a word of the same length, drawn from the letter distribution of the
    corpus' ordinary tokens (``word_null``: one row with q = sum p^2, t = sum p^3, af = share of a-f), is as
    uniform, stays inside the alphabet and has as many digits and inner capitals.
    """
    body = F.rtrim("found", F.lit("="))
    mixed = ALPHABETS["base64"] + "-_"
    encoding = F.lit(None).cast("string")
    alphabet = F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS.items()):
        # '-' goes last so that it is literal inside the class
        chars = letters.replace("-", "") + ("-" if "-" in letters else "")
        fits = body.rlike(f"^[{chars}]+$")
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
    # The generators keep these columns from being computed again for every character below.
    rows = tokens.select("*", F.inline(F.array(F.struct(
        body.alias("body"), F.coalesce(encoding, F.lit("base64")).alias("encoding"), F.coalesce(alphabet, F.lit(mixed)).alias("alphabet")))))
    rows = rows.select("*", F.inline(F.array(F.struct(
        F.transform(F.split("body", ""), lambda c: F.instr(F.col("alphabet"), c)).alias("codes"),
        F.length("body").cast("double").alias("n"), F.length("alphabet").cast("double").alias("k")))))

    squares = F.aggregate(
        F.split("alphabet", ""),
        F.lit(0.0),
        lambda total, c: total + F.pow(F.length("body") - F.length(F.replace("body", c, F.lit(""))), F.lit(2)),
    )
    rows = rows.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n"))
    # Wilson-Hilferty: the cube root of chi2 / df is close to normal.
    df = F.col("k") - 1
    z_chi = (F.cbrt(F.col("chi2") / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

    halves = F.array_join(F.transform("codes", lambda x: F.when(x > F.col("k") / 2, "1").otherwise("0")), "")
    rows = rows.withColumn("halves", halves)
    length = F.length("halves")
    ones = length - F.length(F.replace(F.col("halves"), F.lit("1"), F.lit("")))
    steps = [(length - F.length(F.replace(F.col("halves"), F.lit(x), F.lit("")))) / 2 for x in ("01", "10")]
    expected = 2 * ones * (length - ones) / length + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (length - 1), F.lit(1e-9)))
    z_runs = (steps[0] + steps[1] + 1 - expected) / spread

    mean = (F.col("k") + 1) / 2
    variance = (F.col("k") * F.col("k") - 1) / 12
    lagged = F.zip_with(
        F.expr("slice(codes, 1, size(codes) - 1)"),
        F.expr("slice(codes, 2, size(codes) - 1)"),
        lambda x, y: (x - mean) * (y - mean),
    )
    z_serial = F.aggregate(lagged, F.lit(0.0), lambda total, x: total + x) / (variance * F.sqrt(F.col("n") - 1))

    rows = rows.withColumn("z_chi", z_chi).withColumn("z_runs", z_runs).withColumn("z_serial", z_serial)
    least = F.least(_upper(F.col("z_chi")), _two_sided(F.col("z_runs")), _two_sided(F.col("z_serial")))
    rows = rows.withColumn("p_random", F.least(F.lit(1.0), 3 * least))

    rows = rows.crossJoin(F.broadcast(word_null))  # one row
    n, k, q, t = (F.col(c) for c in "nkqt")
    text_mean = k * (1 + (n - 1) * q) - n
    pairs = 2 * n * (n - 1) * ((q - q * q) + 2 * (n - 2) * F.greatest(t - q * q, F.lit(0.0)))
    z_text = (F.col("chi2") - text_mean) / F.greatest(k / n * F.sqrt(pairs), F.lit(1e-9))
    without = lambda chars: F.length(F.regexp_replace("body", f"[{chars}]", ""))
    digits = n - without("0-9")
    capitals = n - without("A-Z")
    mixed_case = F.when((capitals > 0) & (without("a-z") < n), F.greatest(capitals - 1, F.lit(0))).otherwise(0)
    inside = F.when(F.lower("encoding") == "hex", F.log(F.greatest(F.col("af"), F.lit(1e-6))) * (n - digits)).otherwise(0.0)
    log_p = F.log(F.greatest(_upper(-z_text), F.lit(1e-300))) + inside + _excess(digits, n) + _excess(mixed_case, n)
    return rows.withColumn("p_text", F.exp(F.greatest(log_p, F.lit(-math.log(10) * LAST_BIN / BINS)))).drop(
        "codes", "halves", "alphabet", "body", "q", "t", "af"
    )


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """Benjamini-Hochberg thresholds on ``p_text`` for each length class (powers of two), from histograms.

    The histograms have LAST_BIN + 1 bins a class, whatever the number of tokens, so the running sums below are
    over a bounded table. A bin's upper end stands for all its p-values, which errs on the safe side.
    """
    bins = tested.groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("tokens"))
    smaller = Window.partitionBy("length_class").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("length_class")
    bins = bins.withColumn("rank", F.sum("tokens").over(smaller)).withColumn("all", F.sum("tokens").over(whole))
    bound = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS)))
    return bins.where(bound * F.col("all") / F.col("rank") <= fdr).groupBy("length_class").agg(F.min("bin").alias("cut"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Spans of secrets in whole texts.

    Kinds ``assign``, ``access`` and ``hex`` are fixed patterns. Kind ``random`` adds tokens that pass the
    randomness battery of their encoding and are discoveries among all tokens of their length class at the
    given false-discovery rate.

    Returns one row per input row: ``id_col, n_assign, n_access, n_hex, n_random, base_spans, spans`` with spans
    as ``kind:start:end`` (code points, end exclusive), by start, then kind, joined by commas.

    * null and empty texts have no spans; other columns of ``docs`` are ignored, whatever their names;
    * rows are told apart by a row number of their own, so repeated and null identifiers are safe;
    * an empty table gives an empty result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), unmarked(F.col(text_col)).alias("text")
    )
    rows = rows.select(
        "uid",
        "id",
        split_at(F.col("text"), ASSIGN, f"$1{INNER}$2").alias("assign"),
        split_at(F.col("text"), ACCESS).alias("access"),
        split_at(F.col("text"), HEX).alias("hex"),
        split_at(F.col("text"), TOKEN).alias("random"),
    )
    rows = rows.select("uid", "id", F.concat(*[pieces(k, F.col(k)) for k in KINDS]).alias("pieces"))
    rows = shared_checkpoint(rows)

    spans = positions(rows.where(F.size("pieces") > 0))
    value = F.element_at(F.split("found", INNER), 2)
    spans = spans.where((F.col("kind") != "assign") | (F.length(value) >= ASSIGN_MIN)).select(
        "uid", "kind", "start", "end", F.when(F.col("kind") == "random", F.col("found")).alias("found")
    )
    spans = shared_checkpoint(spans)

    tokens = spans.where(F.col("kind") == "random")
    ordinary = tokens.where(~F.col("found").rlike("[0-9]"))
    letters = [F.coalesce(F.sum(F.length("found") - F.length(F.replace(F.lower("found"), F.lit(c), F.lit("")))), F.lit(0)).alias(c)
               for c in "abcdefghijklmnopqrstuvwxyz"]
    counts = ordinary.agg(*letters).select(F.array(*[F.col(c).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x)
    counts = counts.withColumn("total", total)
    power = lambda e: F.aggregate("c", F.lit(0.0), lambda s, x: s + F.pow(x / F.col("total"), F.lit(e)))
    word_null = counts.select(
        F.when(F.col("total") > 0, power(2)).otherwise(ENGLISH[0]).alias("q"),
        F.when(F.col("total") > 0, power(3)).otherwise(ENGLISH[1]).alias("t"),
        F.when(F.col("total") > 0, F.expr("aggregate(slice(c, 1, 6), 0.0D, (s, x) -> s + x)") / F.col("total"))
        .otherwise(ENGLISH[2])
        .alias("af"),
    )

    tested = battery(tokens, word_null).where(F.col("p_random") > ALPHA)
    tested = tested.select(
        "uid", "kind", "start", "end",
        F.floor(F.log2("n")).cast("int").alias("length_class"),
        F.least(F.floor(-F.log10("p_text") * BINS), F.lit(LAST_BIN)).cast("int").alias("bin"),
    )
    tested = shared_checkpoint(tested)
    random = tested.join(F.broadcast(discoveries(tested, fdr)), "length_class").where(F.col("bin") >= F.col("cut"))
    spans = spans.where(F.col("kind") != "random").select("uid", "kind", "start", "end").unionByName(
        random.select("uid", "kind", "start", "end")
    )

    base = F.col("kind") != "random"
    found = spans.groupBy("uid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        joined(base, KINDS).alias("base_spans"),
        joined(F.lit(True), KINDS).alias("spans"),
    )
    return rows.select("uid", "id").join(found, "uid", "left").select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
