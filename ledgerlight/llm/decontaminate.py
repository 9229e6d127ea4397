"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, shared_table

#: Tokens of a window, literal tokens a template needs, tokens in a row that make a leak, tokens below which an item has to
#: stand by itself.
WINDOW, LITERALS, LEAK, SHORTEST = 8, 4, 13, 5
#: Lengths to which a window with few literals grows along its neighbours, and literals that a whole item of few needs.
LONGER, FEWEST = (13, 16, 24, 32, 48), 2
#: Characters of benchmark text of which hashes are broadcast at a time (about eight bytes a character at most); a longer
#: benchmark is taken in parts.
BROADCAST_CHARS = 10_000_000
#: Words a task remembers; lower-case words of the whole benchmark that are broadcast (eight bytes each), more are joined.
MEMO, VOCABULARY = 500_000, 4_000_000
#: Bytes of windows up to which they are broadcast to what was found in the documents; more are joined over SALTS.
TABLE_BYTES, SALTS = 32_000_000, 16

#: Before the tokens of a window that is looked for as it is.
EXACT = "= "

_BOUND = re.compile(r"[.!?:;\n\r\"“”«»|()\[\]{}<>]")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[%$€£°]")
NUMBER, NAME, UNIT, FIRST = 1, 2, 3, 4
PLACEHOLDER = {NUMBER: "<number>", NAME: "<name>", UNIT: "<unit>"}
# Words for numbers and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNIT_WORDS = frozenset(
    "% $ € £ ° percent dollar dollars euro euros cent cents pound pounds kg gram grams km meter meters metre metres mile "
    "miles foot feet inch inches liter liters litre litres gallon gallons second seconds minute minutes hour hours day "
    "days week weeks month months year years degree degrees mph kmh".split()
)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 50)], np.uint64)


def _word_hash(word: str) -> int:
    """64 bits of a lower-case word, out of the way of the placeholders."""
    return max(FIRST, xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))


class _Ids(dict):
    """Token -> place of its (id in templates, id as it is): hashes of words; 0 is a word that the benchmark's part does not have.

    ``every`` and ``literal`` have the hashes, sorted, of the part's words and of those among them that the whole benchmark
    writes in lower case; ``lower`` those of all such words of the benchmark: a capitalised word is a name if it is none of
    them. Where ``lower`` is None, ``row_lower`` has those that concern the text at hand, and names are not remembered.
    """

    def __init__(self, every: np.ndarray, literal: np.ndarray, lower: np.ndarray | None):
        super().__init__()
        self.literal = dict(zip(every.tolist(), _known(every, literal).tolist(), strict=True))  # a lookup tells both
        self.lower, self.row_lower = lower, frozenset()
        self.pairs, self.used = np.zeros((1 << 12, 2), np.uint64), 0

    def __missing__(self, token: str) -> int:
        low = token.lower()
        word = _word_hash(low)
        literal = self.literal.get(word)
        named = False
        if token[0].isdigit() or low in NUMBER_WORDS:
            found = NUMBER
        elif low in UNIT_WORDS:
            found = UNIT
        else:
            found = word if literal else 0
            named = not found and token[0].isupper()
            if named and not (word in self.row_lower if self.lower is None else _has(self.lower, word)):
                found = NAME
        if self.used == len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[self.used] = found, 0 if literal is None else word
        self.used += 1
        if self.lower is not None or not named:  # else another text may see it otherwise
            self[token] = self.used - 1
        return self.used - 1

    def of(self, tokens: list[str], row_lower=()) -> tuple[np.ndarray, np.ndarray]:
        """Ids in templates, ids as they are."""
        if self.used >= MEMO:
            self.clear()
            self.used = 0
        self.row_lower = frozenset(row_lower or ())
        places = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        both = self.pairs[places]  # after the places are known: the table may have grown
        return both[:, 0], both[:, 1]


def _has(hashes: np.ndarray, value: int) -> bool:
    at = hashes.searchsorted(np.uint64(value))
    return at < len(hashes) and int(hashes[at]) == value


def _joined(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Template ids and the places where they start (with the end): neighbours that are all names, numbers or units are one."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ids[1:] >= FIRST) | (ids[1:] == 0)
    starts = np.flatnonzero(new)
    return ids[starts], np.append(starts, len(ids))


def _windows(ids: np.ndarray, size: int, literals: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows without foreign words, and with enough literals if asked for, and their hashes."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    foreign = np.concatenate(([0], np.cumsum(ids == 0)))
    ok = foreign[size:] == foreign[:n]
    if literals:
        literal = np.concatenate(([0], np.cumsum(ids >= FIRST)))
        ok &= literal[size:] - literal[:n] >= min(LITERALS, size - 1)
    starts = np.flatnonzero(ok)
    return starts, _window_hash(ids, starts, size)


def _longest(ids: np.ndarray) -> int:
    """Tokens of the longest stretch without foreign words."""
    return int(np.diff(np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))).max()) - 1


def _window_hash(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashes = (ids[starts[:, None] + np.arange(size)] * _POWERS[:size]).sum(1, dtype=np.uint64)
    return hashes ^ (hashes >> np.uint64(29))


def _exact(tokens: list[str], start: int, size: int) -> tuple[str, list[str]]:
    return EXACT + " ".join(t.lower() for t in tokens[start : start + size]), []


def _alone(text: str, start: int, size: int) -> bool:
    """Whether the tokens from ``start`` on are a passage of their own: bounded by punctuation, line ends or the text's."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    before = text[spans[start - 1][1] : spans[start][0]] if start else "\n"
    last = start + size - 1
    after = text[spans[last][1] : spans[last + 1][0]] if last + 1 < len(spans) else "\n"
    return bool(_BOUND.search(before) and _BOUND.search(after))


def _template(tokens: list[str], ids: np.ndarray, bounds: np.ndarray, start: int, size: int) -> tuple[str, list[str]]:
    words, slots = [], []
    for k in range(start, start + size):
        token = " ".join(tokens[bounds[k] : bounds[k + 1]]).lower()
        if ids[k] < FIRST:
            words.append(PLACEHOLDER[int(ids[k])])
            slots.append(words[-1] + token)
        else:
            words.append(token)
    return " ".join(words), slots


def _words(rows: DataFrame, keep) -> DataFrame:
    """Distinct hashes ``word`` of the lower-cased words of ``text`` that ``keep`` (of the token) chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {t for text in batch.column("text").to_pylist() for t in _TOKEN.findall(text or "") if keep(t)}
            low = {_word_hash(t.lower()) for t in found}
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(low, np.uint64, len(low)).view(np.int64))], ["word"])

    return rows.select("text").mapInArrow(run, "word long").distinct()


def _written_low(token: str) -> bool:
    return token[0].isalpha() and (not token[0].isupper() or len(token) == 1)


def _capital(token: str) -> bool:
    return token[0].isupper()


def _sorted(words: DataFrame) -> np.ndarray:
    return np.sort(words.toArrow()["word"].to_numpy().view(np.uint64))


def _with_lower(rows: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``lower``: hashes of the capitalised words of ``text`` that ``vocabulary`` has.

    The words of a text are few; a word that very many texts have is counted before it meets its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [list({_word_hash(t.lower()) for t in _TOKEN.findall(x or "") if _capital(t)}) for x in batch.column("text").to_pylist()]
            words = [np.array(w, np.uint64).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(words, pa.list_(pa.int64()))], ["__row", "words"])

    rows = shared_table(rows.withColumn("__row", F.monotonically_increasing_id()))
    used = shared_table(rows.select("__row", "text").mapInArrow(run, "__row long, words array<long>").select("__row", F.explode("words").alias("word")))
    counts = shared_table(used.groupBy("word").count().join(vocabulary, "word", "left").select("word", "count", vocabulary["word"].isNotNull().alias("known")))
    found = join_groups(used, counts, "word", "count").where("known").groupBy("__row").agg(F.collect_list("word").alias("lower"))
    return rows.join(found, "__row", "left").select(*keys, "text", "lower")


def _item_windows(tokens: list[str], ids: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
    """Windows of one item: (place, size, hash, template, slots, template windows that make a leak, windows as they are in a row
    that do, whether one is enough, whether it has to stand by itself).

    Every window is kept as it is. Those with enough literals are kept as a template too; the others grow along their
    neighbours until they have enough, and the whole item is one where it never does.
    """
    if not tokens:
        return
    size = min(WINDOW, len(tokens))
    row = min(LEAK, len(tokens)) - size + 1
    for s, h in zip(*_windows(own, size, False), strict=True):
        yield int(s), size, h, *_exact(tokens, int(s), size), None, row, False, size < SHORTEST
    ids, bounds = _joined(ids)
    n = len(ids)
    if n < SHORTEST:
        return
    size = min(WINDOW, n)
    starts, found = _windows(ids, size)
    need = min(len(starts), min(LEAK, n) - size + 1)
    for s, h in zip(starts.tolist(), found, strict=True):
        yield s, size, h, *_template(tokens, ids, bounds, s, size), need, None, False, False
    literal = np.concatenate(([0], np.cumsum(ids >= FIRST)))
    grown = set()
    for s in sorted(set(range(n - size + 1)) - set(starts.tolist())):
        for longer in LONGER:
            at = min(s, n - longer)  # the last windows reach back
            if at >= 0 and literal[at + longer] - literal[at] >= LITERALS:
                grown.add((at, longer))
                break
    if not grown and not len(starts) and literal[n] >= FEWEST and n <= LONGER[-1]:
        grown.add((0, n))
    for s, longer in sorted(grown):
        if not (ids[s : s + longer] == 0).any():
            hashed = _window_hash(ids, np.array([s]), longer)[0]
            alone = bool(literal[s + longer] - literal[s] < LITERALS)
            yield s, longer, hashed, *_template(tokens, ids, bounds, s, longer), 1, None, True, alone


def _known(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(found):
        return np.zeros(len(found), bool)
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", broadcast_chars: int = BROADCAST_CHARS,
               vocabulary: int = VOCABULARY) -> DataFrame:
    """Documents that hold a benchmark passage, verbatim or with other numbers, names and units.

    Both sides become templates: numbers, units and capitalised words that the benchmark never writes in lower case
    turn into typed placeholders, neighbours of one type into one ("New York", "forty five"). Windows of 8 template tokens
    with 4 literals are joined by hash; windows with fewer literals grow along their neighbours (to 48 tokens at most) until
    they have 4, and an item that never does is one window, if it has 2 literals, looked for as a passage of its own
    (bounded by punctuation, line ends or the ends of the text). Per document, item and alignment the replaced values must
    be consistent: each benchmark value stands for one document value and the other way round. An alignment leaks if its
    windows reach 13 template tokens (the whole item where that is shorter). So does one of 13 tokens in a row that are the
    item's own, whatever the rest of it says.

    Returns one row per leaking document text and item: ``id_col, text_hash, item_col, n_windows, exact`` (verbatim, and no
    value was replaced).

    Windows are built by tasks; hashes of the words and windows of ``broadcast_chars`` characters of the benchmark are
    broadcast at a time, a longer benchmark takes several scans of the documents, with the same result. Its lower-case
    words, which tell names, are broadcast up to ``vocabulary``; more are joined with the words of the texts.

    * null and empty texts leak nothing; repeated items count once; items of fewer than 5 tokens are looked for as they
      are, as a passage of their own; items with under 2 literals are found only as they are;
    * repeated rows (same identifier and text) give one row; rows are keyed by identifier and text hash, so a
      null identifier is safe; empty tables give an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // broadcast_chars) + 1
    words = shared_table(_words(items, _written_low))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    if words.count() > vocabulary:
        lower = None
        rows, items = _with_lower(rows, words, ["id", "text_hash"]), _with_lower(items, words, ["item"])
    else:
        lower = _sorted(words)
        rows, items = (df.withColumn("lower", F.lit(None).cast("array<long>")) for df in (rows, items))
    out = None
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        found = _find_part(rows, chosen, words, lower)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("item", item_col).withColumnRenamed("id", id_col)


def _find_part(rows: DataFrame, items: DataFrame, words: DataFrame, lower: np.ndarray | None) -> DataFrame:
    spark = rows.sparkSession
    every = _words(items, lambda t: True)
    fixed = np.sort(np.array([_word_hash(w) for w in UNIT_WORDS | NUMBER_WORDS], np.uint64))
    literal = _sorted(every.join(words, "word", "left_semi"))
    literal = literal[~_known(literal, fixed)]
    names = spark.sparkContext.broadcast((_sorted(every), literal, lower))  # bounded by broadcast_chars and vocabulary

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Ids(*names.value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            taken, out = [], []
            for k, (text, low) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lower").to_pylist(), strict=True)):
                tokens = _TOKEN.findall(text)
                own = [(w[0], w[1], int(np.uint64(w[2]).view(np.int64)), *w[3:]) for w in _item_windows(tokens, *lookup.of(tokens, _unsigned(low)))]
                taken += [k] * len(own)
                out += own
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(taken, pa.int64())), *[pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]],
                ["item", "item_place", "size", "hash", "template", "item_slots", "need", "row", "enough", "alone"],
            )

    item = items.schema["item"].dataType.simpleString()
    table = shared_table(items.mapInArrow(
        build, f"item {item}, item_place long, size int, hash long, template string, item_slots array<string>, need int, row int, enough boolean, alone boolean"
    ))
    kinds: dict[tuple, list] = {}
    for batch in table.select(F.col("need").isNull().alias("plain"), "size", "alone", "hash").distinct().toArrow().to_batches():  # bounded by broadcast_chars
        plain, size, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("plain", "size", "alone"))
        hashes = batch.column("hash").to_numpy().view(np.uint64)
        for kind in set(zip(plain.tolist(), size.tolist(), alone.tolist(), strict=True)):
            chosen = (plain == kind[0]) & (size == kind[1]) & (alone == kind[2])
            kinds.setdefault(kind, []).append(hashes[chosen])
    windows = spark.sparkContext.broadcast({k: np.sort(np.concatenate(v)) for k, v in sorted(kinds.items())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Ids(*names.value)
        for batch in batches:
            rows, places, templates, slots = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                tokens = _TOKEN.findall(text)
                ids, own = lookup.of(tokens, _unsigned(batch.column("lower")[row].as_py()))
                ids, bounds = _joined(ids)
                longest = _longest(ids), _longest(own)
                for (plain, size, alone), hashed in windows.value.items():
                    if size > longest[plain]:
                        continue
                    starts, found = _windows(own if plain else ids, size, not plain and size == min(size, WINDOW) and not alone)
                    for start in starts[_known(found, hashed)].tolist():
                        last = start + size if plain else int(bounds[start + size])
                        first = start if plain else int(bounds[start])
                        if alone and not _alone(text, first, last - first):
                            continue
                        template, values = _exact(tokens, start, size) if plain else _template(tokens, ids, bounds, start, size)
                        rows.append(row)
                        places.append(start)
                        templates.append(template)
                        slots.append(values)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(taken), batch.column("text_hash").take(taken), pa.array(places, pa.int64()),
                 pa.array(templates, pa.string()), pa.array(slots, pa.list_(pa.string()))],
                ["id", "text_hash", "place", "template", "slots"],
            )

    ids = rows.schema["id"].dataType.simpleString()
    seen = rows.mapInArrow(run, f"id {ids}, text_hash long, place long, template string, slots array<string>")
    size = table.agg(F.sum(F.length("template") * 2 + 64)).first()[0] or 0
    table = table.drop("hash", "size", "alone")
    if size <= TABLE_BYTES:
        pairs = seen.join(F.broadcast(table), "template")
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = seen.withColumn("__salt", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["template", "__salt"])
    pairs = pairs.select(
        "id", "text_hash", "item", "need", "row", "enough", "item_place", (F.col("place") - F.col("item_place")).alias("shift"),
        F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")).alias("values"),
    ).distinct()
    # At most two windows per token of an item meet in one alignment, so the sets below are small. Windows of templates have
    # a ``need``, those of the item as it is have a ``row``.
    aligned = pairs.groupBy("id", "text_hash", "item", "shift", F.col("need").isNull().alias("plain")).agg(
        F.count_distinct("item_place").alias("n_windows"),
        F.count_distinct(F.when(~F.col("enough"), F.col("item_place"))).alias("n_dense"),
        F.max(F.when(~F.col("enough"), F.col("need"))).alias("need"),
        F.max("enough").alias("enough"),
        F.max("row").alias("row"),
        F.array_sort(F.collect_set("item_place")).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"),
    )
    same = F.forall("values", lambda v: v["theirs"] == v["ours"])
    one_way = F.size(F.array_distinct(F.transform("values", lambda v: v["theirs"]))) == F.size("values")
    other_way = F.size(F.array_distinct(F.transform("values", lambda v: v["ours"]))) == F.size("values")
    # the n-th place of a run is n - 1 after its first: places in order, ``row`` of them without a gap
    in_row = F.exists(
        F.transform("places", lambda x, i: F.coalesce(F.get("places", i + F.col("row") - 1) == x + F.col("row") - 1, F.lit(False))),
        lambda x: x,
    )
    reached = F.col("enough") | F.coalesce(F.col("n_dense") >= F.col("need"), F.lit(False))
    leaks = F.when(F.col("plain"), in_row).otherwise(reached & one_way & other_way)
    found = aligned.select("id", "text_hash", "item", "plain", "n_windows", same.alias("same"), leaks.alias("leaks"))
    templates = F.max(F.when(~F.col("plain"), F.struct("n_windows", "same")))
    found = found.groupBy("id", "text_hash", "item").agg(
        F.max(F.when(F.col("leaks"), F.col("n_windows"))).alias("n_windows"),
        (F.max(F.col("plain") & F.col("leaks")) & F.coalesce(templates["same"], F.lit(True))).alias("exact"),
        F.max("leaks").alias("leaks"),
    )
    return found.where("leaks").drop("leaks")


def _unsigned(words: list[int] | None) -> list[int]:
    return [w & 0xFFFFFFFFFFFFFFFF for w in words or ()]


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, **names).select(F.col(id_col).alias("__id"), "text_hash").distinct()
    keyed = F.xxhash64(F.col(text_col))
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["__id"]) & (keyed == leaks["text_hash"]), "left_anti")
