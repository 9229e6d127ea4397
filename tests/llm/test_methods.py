"""The methods of the operators against plain versions that look at everything."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, exact_dedup, extraction, langid, pii, quality, secrets, simhash, substrings
from tests.llm.test_operators import sentence


# Language


def plain_language(text, model):
    """Word-first backoff, one word at a time."""
    words = re.findall(r"[a-zß-öø-ÿœ]+", (text or "").lower())
    if not words:
        return "und", 0.0
    total = np.zeros(len(model["langs"]))
    for word in words:
        if word in model["words"]:
            total += model["word_scores"][model["words"][word]]
            continue
        padded, found = f" {word} ", []
        for i in range(len(padded) - 1):
            for k in (4, 3, 2, 1):
                if padded[i : i + k] in model["grams"][k]:
                    found.append(model["gram_scores"][model["grams"][k][padded[i : i + k]]])
                    break
        if found:
            total += np.mean(found, axis=0)
    odds = np.exp((total - total.max()) / math.sqrt(len(words)))
    return model["langs"][int(total.argmax())], 1 / odds.sum()


GERMAN = "der die und nicht haus wasser licht über grüne straße zwischen".split()


def labelled_texts(spark):
    pick = lambda words, i, n: " ".join(random.Random(i).choices(words, k=n))
    rows = [(i, sentence(i, 30), "en") for i in range(200)] + [(1000 + i, pick(GERMAN, i, 30), "de") for i in range(200)]
    rows += [(5000 + i, pick("zorp quix blem drax vunt".split(), i, 30), "xx") for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_against_plain_words(spark):
    model = langid.fit(labelled_texts(spark), "text", "lang")
    texts = ["wasser und haus", "the river zwischenlicht house", "Straßenlicht ganz unbekannt", "quixblem zorping", "a b c", "½ ² Ⅷ", "über½wasser", "x" * 40_000, ""]
    for text in texts:
        got, want = langid.predict(text, model), plain_language(text, model)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1]), text
    assert langid.predict("½ ² Ⅷ", model) == ("und", 0.0)
    assert langid.words_of("a½b x² Ⅷ a") == Counter({"a": 2, "b": 1, "x": 1})


def test_language_model_is_bounded_and_fair(spark):
    df = labelled_texts(spark)
    assert langid._sampled(df, "text", "lang", "doc_id", 20).groupBy("lang").count().collect().__len__() == 3
    assert {r["lang"]: r["count"] for r in langid._sampled(df, "text", "lang", "doc_id", 20).groupBy("lang").count().collect()} == {"en": 20, "de": 20, "xx": 3}
    small = langid.fit(df, "text", "lang", max_words=15, max_grams=30)
    assert len(small["words"]) <= 15 and langid.predict("zorp drax", small)[0] == "xx"  # the rare language has its share
    again = langid.fit(df.repartition(5), "text", "lang", max_words=15, max_grams=30)
    assert again["words"] == small["words"] and np.array_equal(again["gram_scores"], small["gram_scores"])
    copies = df.where("lang = 'en'").limit(1).crossJoin(spark.range(500)).select((F.col("id") + 9000).alias("doc_id"), "text", "lang")
    assert langid._sampled(df.unionByName(copies), "text", "lang", "doc_id", 50).where("lang = 'en'").distinct().count() > 5


# Quality


def test_quality_against_all_pairs(spark):
    rows = [(i, sentence(i, 30) + ("!!" if i % 2 else ""), i % 2, 10 * i if i % 5 else None) for i in range(60)]
    rows += [(100, None, None, 5), (101, "", 1, None), (102, sentence(5, 5000), 0, -3), (60, sentence(1, 30), 1, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, n_chars long").withColumn("meta_x", F.lit("y")).withColumn("score", F.lit(9))
    model = quality.fit(df)
    got = defaultdict(list)
    for r in quality.score_quality(df, model).collect():
        got[r.doc_id].append(r.score)
    for i, text, _, chars in rows[:3] + rows[-4:]:
        index, value = quality.features(text, (("meta_n_chars", chars),))
        total = model["b"] + sum(model["w"][j] * x for j, x in zip(index, value, strict=True))
        each = [(model["v"][j] * x) for j, x in zip(index, value, strict=True)]
        rest = np.zeros(quality.RANK)  # pairs, one feature after the other
        for v in each:
            total += float(v @ rest)
            rest = rest + v
        assert any(s == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) for s in got[i])
    few = quality.features("a b", (("meta_n_chars", 3.0),))
    brute = sum(float(model["v"][i] * x @ (model["v"][j] * y)) for (i, x), (j, y) in combinations(list(zip(*few, strict=True)), 2))
    score, _ = quality._sums(model, *few, np.zeros(len(few[0]), int), 1)
    assert score[0] == pytest.approx(model["b"] + model["w"][few[0]] @ few[1] + brute)


def test_quality_without_labels_scores_half(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 500)], "doc_id long, text string")
    model = quality.fit(df.withColumn("quality", F.lit(None).cast("int")))
    assert {r.score for r in quality.score_quality(df, model).collect()} == {0.5}
    strange = df.withColumn("n_chars", F.lit("no number"))
    assert quality.score_quality(strange, model).count() == 3


# Secrets: the battery


def plain_battery(token):
    body = token.rstrip("=")
    for name, letters in secrets.ALPHABETS.items():
        if all(c in letters for c in body):
            break
    else:
        name, letters = "base64", secrets.ALPHABETS["base64"] + "-_"
    k, n = len(letters), len(body)
    codes = [letters.index(c) + 1 for c in body]
    chi2 = sum((codes.count(i + 1) - n / k) ** 2 / (n / k) for i in range(k))
    df = k - 1
    z_chi = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    halves = [c > k / 2 for c in codes]
    ones, runs_ = sum(halves), 1 + sum(a != b for a, b in zip(halves, halves[1:], strict=False))
    expected = 2 * ones * (n - ones) / n + 1
    z_runs = (runs_ - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    mean, variance = (k + 1) / 2, (k * k - 1) / 12
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / (variance * math.sqrt(n - 1))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    return name, min(1.0, 3 * min(tail(z_chi), min(1, 2 * tail(abs(z_runs))), min(1, 2 * tail(abs(z_serial)))))


def test_battery_against_plain_tests(spark):
    rng = random.Random(4)
    tokens = ["".join(rng.choices(letters, k=n)) for letters in secrets.ALPHABETS.values() for n in (16, 24, 40, 100)]
    tokens += ["internationalisation", "aaaaaaaaaaaaaaaaaaaa", "abab" * 6, "A-b_c+d/E1" * 3, "0123456789abcdef" * 3]
    df = spark.createDataFrame([(t,) for t in tokens], "found string")
    null = spark.createDataFrame([secrets.ENGLISH], "q double, t double, af double")
    for r in secrets.battery(df, null).collect():
        name, p = plain_battery(r.found)
        assert r.encoding == name and r.p_random == pytest.approx(p, abs=1e-5), r.found
        assert 0 <= r.p_text <= 1


def test_discoveries_against_sorted_values(spark):
    rng = random.Random(5)
    bins = [(c, min(400, int(rng.expovariate(0.1 * (c - 2))))) for c in (4, 5, 6) for _ in range(300)] + [(7, 0)] * 20
    got = {r.length_class: r.cut for r in secrets.discoveries(spark.createDataFrame(bins, "length_class int, bin int")).collect()}
    for c in (4, 5, 6, 7):
        p = sorted(10 ** (-b / secrets.BINS) for k, b in bins if k == c)
        ok = [x for i, x in enumerate(p) if x * len(p) / max(j + 1 for j, y in enumerate(p) if y == x) <= secrets.FDR]
        assert got.get(c) == (round(-math.log10(max(ok)) * secrets.BINS) if ok else None)


# Personal data: expectation-maximisation and the classifier


def test_estimate_against_single_votes():
    counts = {("email", 1, 1, 1, 1): 40, ("email", 1, 0, 1, 1): 60, ("email", -1, -1, -1, 0): 30, ("email", 1, -1, 1, -1): 7, ("ip", 0, 0, 0, 0): 2}
    got = pii.estimate(counts, rounds=7)
    rows = [key[1:] for key, n in counts.items() for _ in range(n) if key[0] == "email"]  # one row a span
    prior, yes, no = 0.5, [{1: 0.7, 0: 0.2, -1: 0.1}] * 4, [{1: 0.2, 0: 0.3, -1: 0.5}] * 4
    for _ in range(7):
        post = []
        for r in rows:
            a, b = prior * math.prod(yes[i][v] for i, v in enumerate(r)), (1 - prior) * math.prod(no[i][v] for i, v in enumerate(r))
            post.append(a / (a + b))
        prior = min(0.99, max(0.01, (sum(post) + 5) / (len(rows) + 10)))
        start = ({1: 7, 0: 2, -1: 1}, {1: 2, 0: 3, -1: 5})
        yes = [{v: (start[0][v] + sum(p for p, r in zip(post, rows, strict=True) if r[i] == v)) / (10 + sum(post)) for v in (1, 0, -1)} for i in range(4)]
        no = [{v: (start[1][v] + sum(1 - p for p, r in zip(post, rows, strict=True) if r[i] == v)) / (10 + len(rows) - sum(post)) for v in (1, 0, -1)} for i in range(4)]
    for r, p in zip(rows, post, strict=True):
        assert got[("email", *r)] == pytest.approx(p)
    assert got[("email", 1, 1, 1, 1)] > 0.9 > 0.1 > got[("email", -1, -1, -1, 0)]


def test_classifier_learns_traits_too():
    votes = [("ssn", 1, 1, 1, 1), ("ssn", -1, -1, -1, -1)]
    traits = {1: ("3", "3", "dash", "space"), 0: ("5", "1", "none", "letter")}
    counts = {(*v, *traits[y]): 50 for y, v in zip((1, 0), votes, strict=True)}
    weights = pii.train(counts, {votes[0]: 0.95, votes[1]: 0.05})
    score = lambda key: 1 / (1 + math.exp(-sum(weights[n] for n in pii.names_of(key))))
    assert score((*votes[0], *traits[1])) > 0.85 and score((*votes[1], *traits[0])) < 0.15
    assert weights["breaks=dash"] > 0 > weights["breaks=none"]  # not the votes alone
    assert pii.train({}, {}) == {}


# Exact dedup


@pytest.mark.parametrize("parts", [1, 3, 10_000])
def test_dedup_with_and_without_salts(spark, parts):
    texts = ["Same Text"] * 60 + ["same text"] * 20 + [f"t{i % 7}" for i in range(40)] + ["x" * 70 + str(i % 3) for i in range(9)] + [None, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("norm", F.lit(1)).withColumn("salt", F.lit(2))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").lower()].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df.repartition(3), parts=parts).collect()}
    assert len(got) == len(texts)
    for text, members in groups.items():
        for i in members:
            want = (max(members), len(members), i == max(members), hashlib.sha256(text.encode()).hexdigest())
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want


# SimHash with several fingerprints


def test_several_fingerprints(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = [rng.choices(words, k=120) for _ in range(12)]
    rows = []
    for g, text in enumerate(texts):
        for c in range(4):
            new = list(text)
            for at in rng.sample(range(len(new)), c):
                new[at] = rng.choice(words)
            rows.append((10 * g + c, " ".join(new)))
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, distance=51, seeds=(42, 43, 44, 45), share=2).collect()}
    prints = {i: simhash.fingerprints(t, 5, (42, 43, 44, 45)) for i, t in rows}
    assert prints[0][0] == simhash.fingerprints(rows[0][1], 5, (42,))[0]
    parent = {i: i for i, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in combinations(prints, 2):  # all pairs, all bits
        xors = [(x ^ y) & (2**64 - 1) for x, y in zip(prints[a], prints[b], strict=True)]
        if sum(x.bit_count() for x in xors) <= 51:
            parent[find(a)] = find(b)
    roots = defaultdict(list)
    for i in prints:
        roots[find(i)].append(i)
    assert got == {i: min(v) for v in roots.values() for i in v}
    assert sum(got[10 * g + c] == 10 * g for g in range(12) for c in (1, 2, 3)) >= 33  # near copies are found
    assert all(v // 10 == k // 10 for k, v in got.items())  # and no strangers


@pytest.mark.parametrize("posting_max", [3, 50])
def test_long_postings_are_dealt_first(spark, posting_max):
    """One fingerprint's neighbours crowd a posting; its rows are dealt over salts before they meet their posting."""
    rng = random.Random(4)
    hot = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(300)]
    far = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in hot + far})
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, posting_max=posting_max).collect()
    parent = {v: v for v in values}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        parent[find(a)] = find(b)
    for a, b in combinations(values, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            assert find(a) == find(b)


# Repeated substrings


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_against_counts(seed):
    rng = random.Random(seed)
    contents = [bytes(rng.choices(b"ab", k=rng.randint(9, 60))) for _ in range(30)]
    groups = sorted(rng.randint(0, 5) for _ in contents)
    for length in (9, 16, 21):
        chosen = [(c, g) for c, g in zip(contents, groups, strict=True) if len(c) >= length]
        every = Counter((g, c[j : j + length]) for c, g in chosen for j in range(len(c) - length + 1))
        want = {(i, j) for i, (c, g) in enumerate(chosen) for j in range(len(c) - length + 1) if every[g, c[j : j + length]] > 1}
        owner, place = substrings.equal_windows([c for c, _ in chosen], np.array([g for _, g in chosen]), length)
        assert set(zip(owner.tolist(), place.tolist(), strict=True)) == want


def run_rows(contents):
    n = len(contents)
    gram = np.array([c // 10 for c in contents], np.int64)
    values = {"lead": gram * 0 + 3, "gram": gram, "content": np.array(contents, np.int64), "uid": np.arange(n), "first": np.zeros(n, np.int32),
              "last": np.zeros(n, np.int32), "repeated": np.zeros(n, bool)}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values.values()], list(values))


def test_labels_across_ranges(spark):
    rng = random.Random(8)
    contents = [11] * 40 + [12] * 3 + [13] + [21] * 9 + [31] + [41, 42, 43] + [51] * 2 + [61]
    rng.shuffle(contents)
    df = spark.createDataFrame(pa.Table.from_batches([run_rows(contents)]))
    for n in (1, 4, 16):
        got = defaultdict(Counter)
        for r in substrings.label_runs(df.repartitionByRange(n, "lead", "gram", "content", "uid")).collect():
            got[r.kind][contents[r.uid]] += 1
        assert got == {substrings.WHOLE: {11: 40, 12: 3, 21: 9, 51: 2}, substrings.PART: {13: 1, 41: 1, 42: 1, 43: 1}, substrings.COPY: {11: 1, 12: 1}}


def test_ranges_against_tuples():
    rng = np.random.default_rng(3)
    keys = rng.integers(-3, 3, (4, 500))
    splitters = np.array(sorted(map(tuple, rng.integers(-3, 3, (40, 4)).tolist())))
    want = [sum(tuple(s) <= k for s in splitters.tolist()) for k in map(tuple, keys.T.tolist())]
    assert substrings._range(list(keys), splitters).tolist() == want
    assert substrings._range(list(keys), splitters[:0]).tolist() == [0] * 500


def test_label_keeps_one_run():
    """A million rows of one gram in batches: every row leaves with its batch."""
    contents = np.repeat(np.arange(1000), 1000)
    table = pa.Table.from_batches([run_rows((contents % 10 + 10 * 0).tolist())]).sort_by([("gram", "ascending"), ("content", "ascending")])
    most, seen, last = 0, 0, 0
    for out in substrings._label(iter(table.to_batches(max_chunksize=10_000))):
        most, seen = max(most, out.num_rows), seen + out.num_rows
        last = out
    assert most <= 10_001 and seen == 1_000_000 + 8 and last.num_rows == 1  # copies of the inner contents, edges for the outer


# Extraction: two pages


def plain_common(a, b):
    """Size of the largest common subsequence of labels, by trying everything."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + plain_common(a[1:], b[1:])
    return max(plain_common(a[1:], b), plain_common(a, b[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_merge_against_all_alignments(seed):
    rng = random.Random(seed)
    pages = [[rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(2)]
    folded = [[x for i, x in enumerate(p) if not i or p[i - 1] != x] for p in pages]
    trees = [extraction._folded([[x, "1", [["#", "1", []]]] for x in p]) for p in pages]
    merged = extraction.merge(*trees)
    always = sum(1 for node in merged if node[1] in "1+")
    folded_twice = len(merged) < sum(map(len, folded)) - plain_common(*folded)
    assert always == plain_common(*folded) or folded_twice or trees[0] == trees[1]
    for page in pages:  # each page is a word of the expression
        pattern = "".join(f"(?:{node[0]})" + {"1": "", "?": "?", "+": "+", "*": "*"}[node[1]] for node in merged)
        assert re.fullmatch(pattern, "".join(page))


CASES = [
    '<div class="share-of-market"><p>Kept text</p></div>', '<section id="search"><p>Kept text</p></section>', '<p class="notice-period">Kept text</p>',
    '<h2 id="search-trees">Kept text</h2>', '<div class="related-work"><p>Kept text</p></div>', '<p>Kept <math><mi>t</mi><mi>e</mi></math>xt</p>',
    "<p data-x=a/b/>Kept text</p>", '<p><a href="x">Kept text</p><p>More words after an open link that go on</p>',
]


def test_names_that_only_sound_like_boilerplate(spark):
    rows = [(i, f"http://h{i}.example.org/", f"<body><article><h1>Title</h1><p>First words</p>{c}</article></body>") for i, c in enumerate(CASES)]
    gone = ["cookie-bar", "related-posts", "share-buttons", "sidebar", "comment-list", "ad-slot-3", "newsletter", "site-footer"]
    rows += [(100 + i, f"http://g{i}.example.org/", f'<body><article><p>First words</p><div class="{c}"><p>Gone</p></div></article></body>') for i, c in enumerate(gone)]
    got = {r.page_id: r.text for r in extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(len(CASES)):
        assert got[i].replace("Kept te xt", "Kept text").startswith("Title\nFirst words\nKept text"), CASES[i]
    assert {got[100 + i] for i in range(len(gone))} == {"First words"}


def test_hosts_with_few_pages(spark):
    page = "<body><div>Our shop since 1900</div><div><p>Story {0} with a number of words in it</p><p>It goes on {0}</p></div><div>All rights reserved</div></body>"
    rows = [(10 * n + i, f"http://n{n}.example.org/{i}", page.format(10 * n + i)) for n in (2, 3, 4) for i in range(n)]
    rows += [(900, "http://one.example.org/", page.format(900))]
    got = {r.page_id: r.text for r in extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows[:-1]:
        assert got[i] == f"Story {i} with a number of words in it\nIt goes on {i}"
    assert got[900].startswith("Our shop since 1900\nStory 900")  # nothing to compare with


# Decontamination


def plain_template(text, lower):
    out = []
    for t in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[%$€£°]", text):
        low = t.lower()
        if t[0].isdigit() or low in decontaminate.NUMBER_WORDS:
            kind = "number"
        elif low in decontaminate.UNIT_WORDS:
            kind = "unit"
        elif t[0].isupper() and low not in lower:
            kind = "name"
        else:
            out.append((low, None))
            continue
        if out and out[-1][0] == kind and out[-1][1] is not None:
            out[-1] = (kind, out[-1][1] + " " + low)
        else:
            out.append((kind, low))
    return out


def plain_leaks(doc, item, lower):
    """The template of an item, word by word at every place of the document, values as one-to-one maps."""
    d, i = plain_template(doc, lower), plain_template(item, lower)
    size = min(13, len(i))
    for a in range(len(i) - size + 1):
        for b in range(len(d) - size + 1):
            pairs = list(zip(i[a : a + size], d[b : b + size], strict=True))
            if all(x[0] == y[0] and (x[1] is None) == (y[1] is None) for x, y in pairs):
                values = {((x[0], x[1]), (y[0], y[1])) for x, y in pairs if x[1] is not None}
                if len({x for x, _ in values}) == len({y for _, y in values}) == len(values):
                    return True
    return False


def test_templates_against_every_place(spark):
    item = "a coach with 45 seats leaves Paris at dawn and carries 300 kg of mail over two hills before Anna sees the old bridge near Lyon"
    items = [item, "how many apples does Tom have left if he eats 3 of his 12 apples today", "every gardener in the northern village plants roses beside the quiet river"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swap = lambda *pairs: __import__("functools").reduce(lambda t, p: t.replace(*p), pairs, item)
    docs = [
        "so " + swap(("Paris", "New York"), ("Lyon", "San Diego"), ("Anna", "Mary Jane")) + " and more",
        swap(("45", "forty five"), ("300", "one thousand")), swap(("Paris", "ROME"), ("Lyon", "MILAN"), ("Anna", "EVA")),
        swap(("Paris", "Lyon")), items[1].replace("Tom", "Van Der Berg").replace("12", "20"), items[1].replace("left if he", "over when she"),
        "something else entirely, Paris and Lyon and 45", items[2].upper(), items[2].replace("roses", "tulips"), "", " ".join(f"Word{i}" for i in range(3000)),
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    lower = {t for x in items for t in re.findall(r"[^\W\d_]+", x) if not t[0].isupper()} | {"a"}
    want = {(d, i) for d, doc in enumerate(docs) for i, x in enumerate(items) if plain_leaks(doc, x, lower)} | {(7, 2)}
    assert {(0, 0), (1, 0), (2, 0), (4, 1)} <= want and not any(d in (5, 6, 8, 9, 10) for d, _ in want)
    found = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    for chars in (10, 60, 200):
        parts = decontaminate.find_leaks(df, bench, broadcast_chars=chars)
        assert sorted(map(tuple, parts.select(*found.columns).collect())) == sorted(map(tuple, found.collect()))


def test_vocabulary_that_is_joined_gives_the_same(spark):
    words = "a coach with red seats leaves the quiet station at dawn and carries mail over two hills near the Bridge".split()
    items = [(1, " ".join(words)), (2, "Then Anna gave the old Coach of Bruno two plums and walked home over the bridge again")]
    docs = [(1, items[0][1]), (2, items[1][1].replace("Anna", "Clara").replace("Bruno", "Dora")), (3, "The Coach of Anna"), (None, None), (5, ""), (6, items[1][1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (3, None)], "item_id long, text string")
    rows = lambda **k: sorted(map(str, decontaminate.find_leaks(df, bench, **k).collect()))
    want = rows()
    assert len(want) >= 2
    assert rows(vocabulary=0) == want == rows(vocabulary=0, broadcast_chars=50)


def test_windows_that_are_joined_give_the_same(spark, monkeypatch):
    item = "a coach with red seats leaves the quiet station at dawn and carries 45 sacks of mail over two hills"
    df = spark.createDataFrame([(k, item.replace("45", str(k))) for k in range(40)] + [(99, "no leak here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item + " near the bridge")], "item_id long, text string")
    want = sorted(map(str, decontaminate.find_leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", 0)
    assert sorted(map(str, decontaminate.find_leaks(df, bench).collect())) == want and len(want) >= 40


@pytest.mark.parametrize("item,doc,leaks", [
    # numbers, names and units nearly everywhere: the whole item, by itself
    ("How many miles in 5 km?", "How many feet in 70 meters?", True),
    ("How many miles in 5 km?", "we know how many feet in 70 meters there are", False),
    ("How many miles in 5 km?", "Tell us. How many feet in 70 meters? No.", True),
    # a value that stands for two others
    ("does 12 kg plus 30 kg make 12 kg again", "does 5 kg plus 7 kg make 5 kg again", True),
    ("does 12 kg plus 30 kg make 12 kg again", "does 5 kg plus 7 kg make 9 kg again", False),
    # windows grow along their neighbours
    ("when Anna met Bruno and Clara or Dora with Emil in Fulda near Gera she paid 5 euros", "x when Ida met Jan and Karl or Lena with Max in Nauen near Olpe she paid 9 euros y", True),
    ("when Anna met Bruno and Clara or Dora with Emil in Fulda near Gera she paid 5 euros", "x when Ida met Jan and Ida or Lena with Max in Nauen near Olpe she paid 9 euros y", False),
    ("12 kg 30 miles", "13 kg 31 miles", False),
])
def test_items_of_numbers_and_names(spark, item, doc, leaks):
    words = "how many in does plus make again when met and or with near she paid we know there are tell us no x y"
    bench = spark.createDataFrame([(1, item), (2, words)], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame([(1, doc)], "doc_id long, text string"), bench).where("item_id = 1")
    assert (found.count() == 1) == leaks



def test_crc_is_that_of_the_queries(spark):
    from ledgerlight.llm.queries import held_out

    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out(2, 4).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
