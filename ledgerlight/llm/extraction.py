"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, shuffle_partitions

#: Partial wrappers per host, bytes of wrappers that may be broadcast, pages from which a slot's statistics alone decide.
PARTS, BROADCAST_BYTES, MANY_PAGES = 32, 32_000_000, 5
#: A slot is no content if so few of its texts differ, or so many of its characters are links.
FIXED_SHARE, LINK_SHARE = 0.2, 0.5
#: Nesting that the wrapper tells apart; deeper elements count as this deep.
DEPTH = 40

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math mi mo mn mrow mtext msup msub msubsup mfrac msqrt mroot mover munder "
    "munderover mspace mstyle semantics".split()
)
SILENT = frozenset(
    "head title nav footer aside form button select option datalist iframe object audio video canvas svg dialog menu "
    "fieldset annotation annotation-xml".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body div section article main table ul ol dl td th blockquote".split())
SILENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments reply replies disqus share sharing social related recommended widget toolbar pagination "
    "pager copyright login signin signup search hidden contentinfo complementary dialog".split()
)
#: Words that may stand beside those above in the name of such an element, as in "cookie-bar" or "related-posts".
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary inner outer wrap wrapper container box bar block panel list "
    "item items section area region zone slot unit content body text link links button buttons icon icons form field post "
    "posts article articles story stories news header head title label small large mobile desktop sticky fixed js is the "
    "app ui module component holder row col column grid group print float level line show".split()
)
#: Of the words above those that are also names of sections in an article's own text, as anchors.
ANCHORS = frozenset("search notice alert share sharing related promotion menu dialog copyright hidden navigation login pager".split())
ROOTS = ("article", "main")
#: Elements that no word of a class, an identifier or a role silences.
NEVER_BY_WORDS = frozenset(("html", "body", *ROOTS))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _says(token: str) -> bool:
    """Whether a class, an identifier or a role is the name of boilerplate: all its words are names of such elements or go
    with them ("share-buttons", but not "share-of-market")."""
    words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
    return any(w in SILENT_WORDS for w in words) and all(w in SILENT_WORDS or w in BESIDE for w in words)


def _label(name: str, rest: str, rooted: bool) -> tuple[str, bool, bool]:
    """Element label (name, classes and id, without digits), whether it is boilerplate, and whether its names say so."""
    silent = name in SILENT
    if not rest or ("=" not in rest and "hidden" not in rest):
        return name, silent, False
    words, said = [], False
    for key, a, b, c in _NAMES.findall(rest):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            words += [w for w in _SPLIT.split(value) if w]
            said |= any(_says(t) for t in value.split() if not (key == "id" and rooted and t in ANCHORS))
        elif key == "style":
            silent |= "display:none" in value.replace(" ", "")
        elif key == "hidden" or value == "true":
            silent = True
    words = sorted({w for w in words if not any(ch.isdigit() for ch in w)})
    return ".".join([name, *words]), silent, said and name not in NEVER_BY_WORDS


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int, bool]]:
    """(path, text, characters in links, silent) of every block with text, in page order.

    A block ends wherever a block element starts or ends. End tags that HTML implies are supplied; character
    references are decoded and white space becomes one space. Words of a class, an identifier or a role silence an element
    only if it does not hold the main content, see ``_holders``.
    """
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # name, label, silent, elements around it that words silence
    found: list = []
    n_said = 0
    text: list[str] = []
    links = 0
    in_link = -1  # elements open around a link; it ends with the one it is in

    def flush() -> None:
        nonlocal links
        if text:
            joined = "".join(text)
            joined = " ".join((unescape(joined) if "&" in joined else joined).split())
            if joined:
                silent, said = stack[-1][2:] if stack else (False, ())
                found.append((tuple(x[1] for x in stack), joined, min(links, len(joined)), silent, said))
            text.clear()
        links = 0

    def pop_to(names: tuple[str, ...], scopes: frozenset) -> None:
        nonlocal in_link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                in_link = in_link if in_link <= i else -1
                return
            if stack[i][0] in scopes:
                return

    for match in _TOKEN.finditer(html or ""):
        token = match.group()
        if token[0] != "<" or token == "<":
            text.append(token)
            if in_link >= 0:
                links += len(token)
            continue
        name = match.group("name")
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = -1 if token[1] == "/" else len(stack)
            elif name == "br":
                text.append(" ")
            continue
        if token[1] == "/":
            if name not in VOID:
                pop_to((name,), frozenset())
            continue
        if name in VOID:
            flush()
            continue
        if name in ENDS_P:
            pop_to(("p",), SCOPES)
        if name in ENDS_ITSELF:
            pop_to(ENDS_ITSELF[name], frozenset(("ul", "ol", "dl", "table", "select")))
        flush()
        rooted = any(x[0] in ROOTS for x in stack)
        label, silent, said = _label(name, match.group("rest"), rooted)
        if name == "header":  # an article's own header is part of it
            silent |= not rooted
        silent |= bool(stack) and stack[-1][2]
        if _CLOSED.search(match.group("rest")):
            continue
        around = stack[-1][3] if stack else ()
        if said:
            n_said += 1
            around = (*around, n_said)
        stack.append((name, label, silent, around))
    flush()
    holders = _holders(found) if n_said else ()
    return [(path, text, links, silent or any(x not in holders for x in said)) for path, text, links, silent, said in found]


def _in_root(path: tuple[str, ...], roots: tuple[str, ...] = ROOTS) -> bool:
    return any(x == root or x.startswith(root + ".") for x in path for root in roots)


def _holders(found: list) -> set[int]:
    """Elements that words silence, but that hold the main content.

    From the outside inwards: while no article or main element with text is open, an element holds the main content if it
    has such an element in it or more than half of the page's text that is no link.
    """
    rows = [(_in_root(path), len(text) - links, said) for path, text, links, silent, said in found if not silent]
    total = sum(n for _, n, _ in rows)
    chars: dict[int, int] = {}
    rooted: set[int] = set()
    for root, n, said in rows:
        for x in said:
            chars[x] = chars.get(x, 0) + n
        if root:
            rooted.update(said)
    holders: set[int] = set()
    for x in sorted(chars):
        if any(root and holders.issuperset(said) for root, _, said in rows):
            break
        if x in rooted or chars[x] > total / 2:
            holders.add(x)
    return holders


# A wrapper is a list of [label, quantifier, children]; the label "#" is a text slot. Quantifiers: "1", "?", "+", "*".


def _tree(found: list) -> list:
    """Elements of one page as nodes; a "#" also holds the numbers of its blocks."""
    root: list = []
    open_path: list = []  # (label, node)
    for block, (path, *_) in enumerate(found):
        path = path[:DEPTH]
        same = 0
        while same < len(open_path) and same < len(path) - 1 and open_path[same][0] == path[same]:
            same += 1
        del open_path[same:]
        for label in path[same:]:
            siblings = open_path[-1][1][2] if open_path else root
            node = [label, "1", []]
            siblings.append(node)
            open_path.append((label, node))
        siblings = open_path[-1][1][2] if open_path else root
        if not siblings or siblings[-1][0] != "#":
            siblings.append(["#", "1", [], []])
        siblings[-1][3].append(block)
    return root


def page_wrapper(found: list) -> list:
    """The expression of one page: equal neighbours become repeated groups."""
    return _folded(_tree(found))


def _either(a: str, b: str) -> str:
    many = a in "+*" or b in "+*"
    none = a in "?*" or b in "?*"
    return ("*" if none else "+") if many else ("?" if none else "1")


def _folded(nodes: list) -> list:
    """Neighbours with one label become one repeated group whose members are aligned with each other."""
    out: list = []
    for label, quantifier, children, *_ in nodes:
        node = [label, quantifier, _folded(children)]
        if out and out[-1][0] == label:
            last = out[-1]
            last[2] = merge(last[2], node[2])
            last[1] = "*" if last[1] in "?*" and quantifier in "?*" else "+"
        else:
            out.append(node)
    return out


def merge(a: list, b: list) -> list:
    """Align two expressions by a longest common subsequence of labels: what both have is merged, what one lacks
    becomes optional, neighbours with one label become a repeated group."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append([a[i][0], _either(a[i][1], b[j][1]), merge(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], _either(a[i][1], "?"), a[i][2]])
            i += 1
        else:
            out.append([b[j][0], _either(b[j][1], "?"), b[j][2]])
            j += 1
    return _folded(out)


def match(found: list, wrapper: list) -> list[str | None]:
    """For every block of a page the slot of the wrapper that it fills, by its place in the wrapper; None if it fits none.

    Neighbours with one label are one group. The groups of an element and the children of its wrapper node are aligned in
    order so that most groups fit; of equal fits those win that use nodes every page has, and repeated nodes for groups of
    several.
    """
    filled: list[str | None] = [None] * len(found)

    def align(nodes: list, expected: list, place: str) -> None:
        runs: list = []  # (label, nodes)
        for node in nodes:
            if runs and runs[-1][0] == node[0]:
                runs[-1][1].append(node)
            else:
                runs.append((node[0], [node]))
        n, m = len(runs), len(expected)
        pairs = []
        if n == m and all(run[0] == node[0] for run, node in zip(runs, expected, strict=True)):
            pairs = [(i, i) for i in range(n)]
        else:
            fit = [[0] * m for _ in range(n)]
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    best[i][j] = max(best[i + 1][j], best[i][j + 1])
                    if runs[i][0] == expected[j][0]:
                        quantifier = expected[j][1]
                        fit[i][j] = 4 * (n + 1) + 2 * (quantifier in "1+") + ((quantifier in "+*") == (len(runs[i][1]) > 1))
                        best[i][j] = max(best[i][j], best[i + 1][j + 1] + fit[i][j])
            i = j = 0
            while i < n and j < m:
                if fit[i][j] and best[i][j] == best[i + 1][j + 1] + fit[i][j]:
                    pairs.append((i, j))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i][j + 1]:
                    j += 1
                else:
                    i += 1
        for i, j in pairs:
            for node in runs[i][1]:
                if node[0] == "#":
                    for block in node[3]:
                        filled[block] = f"{place}{j}"
                else:
                    align(node[2], expected[j][2], f"{place}{j}.")

    align(_tree(found), wrapper, "")
    return filled


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its expression."""
    for batch in batches:
        wrappers = [json.dumps(page_wrapper(blocks(html.as_py())), separators=(",", ":")) for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(wrappers, pa.string())], ["host", "wrapper"])


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page a hash of its open text, and per slot of the host's wrapper that it fills: characters, characters in links
    and a hash of the text."""
    wrappers: dict = {}
    for batch in batches:
        stats, pages = [], []
        for host, html, wrapper in zip(*(batch.column(c) for c in ("host", "html", "wrapper")), strict=True):
            found = blocks(html.as_py())
            each: dict = {}
            for slot, (_, text, links, silent) in zip(match(found, _cached(wrappers, host.as_py(), wrapper)), found, strict=True):
                if slot is not None and not silent:
                    row = each.setdefault(slot, [0, 0, []])
                    row[0] += len(text)
                    row[1] += links
                    row[2].append(text)
            total = sum(c for c, _, _ in each.values())
            pages.append(_hash("\n".join(text for _, text, _, silent in found if not silent)))
            stats.append([{"slot": k, "chars": c, "links": x, "text_hash": _hash("\n".join(t)), "share": c / total}
                          for k, (c, x, t) in each.items()])
        kind = pa.list_(pa.struct([("slot", pa.string()), ("chars", pa.int64()), ("links", pa.int64()), ("text_hash", pa.int64()), ("share", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(pages, pa.int64()), pa.array(stats, kind)], ["host", "page", "stats"])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def _cached(wrappers: dict, host: str, wrapper: pa.Scalar) -> list:
    if host not in wrappers:
        if len(wrappers) > 1000:
            wrappers.clear()
        wrappers[host] = json.loads(wrapper.as_py() or "[]")
    return wrappers[host]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (host, part, wrapper) sorted by host and part: align one after the other; state: one expression."""
    key, current = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([json.dumps(current, separators=(",", ":"))], pa.string())], ["host", "wrapper"]
        )

    for batch in batches:
        for host, part, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
            if key != (host, part):
                if key is not None:
                    yield out()
                key, current = (host, part), json.loads(wrapper)
            else:
                current = merge(current, json.loads(wrapper))
    if key is not None:
        yield out()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """From ``pages(host, html)``: ``(host, wrapper)``.

    All pages count. Equal expressions of a host are counted once before anything is aligned; what is left is aligned in
    PARTS partial wrappers per host, then those with each other, so one large host is no single task's work.
    """
    n = shuffle_partitions(pages)
    schema = "host string, wrapper string"
    kinds = shared_checkpoint(pages.mapInArrow(_page_rows, schema).distinct())
    kinds = kinds.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).cast("int"))
    ordered = ("host", "part", "wrapper")
    partial = kinds.select(*ordered).repartition(n, "host", "part").sortWithinPartitions(*ordered).mapInArrow(_fold, schema)
    partial = partial.select("host", F.lit(0).alias("part"), "wrapper")
    return partial.repartition(n, "host").sortWithinPartitions(*ordered).mapInArrow(_fold, schema)


def slot_kinds(pages: DataFrame) -> DataFrame:
    """From ``pages(host, html, wrapper)``: per host and slot that pages fill, whether it is ``fixed`` text.

    Exact counts over the host's distinct pages: pages with the same open text are one. A slot is fixed if few of its texts
    differ; with only two to four pages, if they have one text there that is less than half of each page.
    """
    seen = pages.select("host", "html", "wrapper").mapInArrow(
        _slot_rows, "host string, page long, stats array<struct<slot:string,chars:long,links:long,text_hash:long,share:double>>"
    )
    # copies of a page count once
    stats = seen.select("host", "page", F.explode("stats").alias("s")).select("host", "page", "s.*").distinct()
    texts = stats.groupBy("host", "slot", "text_hash").agg(
        F.count_distinct("page").alias("pages"), F.sum("links").alias("links"), F.sum("chars").alias("chars"), F.max("share").alias("share")
    )
    stats = texts.groupBy("host", "slot").agg(
        F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("texts"), (F.sum("links") / F.sum("chars")).alias("link_share"),
        F.max("share").alias("share"),
    )
    few = (F.col("pages") > 1) & (F.col("texts") == 1) & (F.col("share") < 0.5)
    fixed = F.when(F.col("pages") >= MANY_PAGES, F.col("texts") < FIXED_SHARE * F.col("pages")).otherwise(few)
    return stats.select("host", "slot", (fixed | (F.col("link_share") > LINK_SHARE)).alias("fixed"))


def main_text(html: str | None, wrapper: list | None, fixed: frozenset[str] | set[str]) -> str:
    """Text of the page's content slots, blocks joined by newlines.

    Every block is matched to a slot of the host's wrapper. Slots under menus, headers, footers, sidebars, notices, adverts,
    forms and comments are no content, nor are slots whose texts are fixed across the host's pages. If an article (or main)
    element holds most of the page's text that is not fixed, its slots are the content, fixed headings among them. If its
    texts are fixed but the longer part of the page, they are kept beside the slots that are not.
    """
    found = blocks(html)
    rows = [
        (path, text, slot not in fixed)
        for slot, (path, text, _, silent) in zip(match(found, wrapper or []), found, strict=True) if not silent
    ]
    kept = None
    for root in ROOTS:
        inside = [_in_root(path, (root,)) for path, _, _ in rows]
        if not any(inside):
            continue
        own = sum(len(text) for (_, text, _), here in zip(rows, inside, strict=True) if here)
        varying = sum(len(text) for (_, text, varies), here in zip(rows, inside, strict=True) if here and varies)
        rest = sum(len(text) for (_, text, varies), here in zip(rows, inside, strict=True) if varies and not here)
        if varying >= rest:
            return "\n".join(text for (_, text, _), here in zip(rows, inside, strict=True) if here)
        if kept is None and own >= rest:
            kept = inside
    kept = kept or [False] * len(rows)
    return "\n".join(text for (_, text, varies), here in zip(rows, kept, strict=True) if varies or here)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict = {}
    slots: dict = {}
    for batch in batches:
        texts = []
        for host, html, wrapper, fixed in zip(*(batch.column(c) for c in ("host", "html", "wrapper", "fixed")), strict=True):
            host = host.as_py()
            if host not in slots:
                if len(slots) > 1000:
                    slots.clear()
                slots[host] = frozenset(fixed.as_py() or ())
            texts.append(main_text(html.as_py(), _cached(wrappers, host, wrapper), slots[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col, url_col, text, n_chars`` (code points).

    Wrappers are inferred from all pages of a host, then every page is matched against its host's wrapper: once for the
    statistics of the slots, once for its text. The table of wrappers has a row a host; it
    is broadcast only if it has at most BROADCAST_BYTES characters, otherwise joined by host.

    * null and empty html give the empty text; pages with a null url or without a host share the host "";
    * repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    wrappers = shared_checkpoint(infer_wrappers(rows.select("host", "html")))

    def with_host(table: DataFrame, size: Column) -> DataFrame:
        chars = table.agg(F.sum(size)).first()[0] or 0
        return rows.join(F.broadcast(table) if chars <= BROADCAST_BYTES else table, "host", "left")

    kinds = slot_kinds(with_host(wrappers, F.length("wrapper")))
    fixed = kinds.groupBy("host").agg(F.collect_list(F.when(F.col("fixed"), F.col("slot"))).alias("fixed"))
    table = shared_checkpoint(wrappers.join(fixed, "host", "left"))
    joined = with_host(table, F.length("wrapper") + F.coalesce(F.length(F.array_join("fixed", "")), F.lit(0)))
    ids = pages.schema[id_col].dataType.simpleString()
    out = joined.select("id", "url", "host", "html", "wrapper", "fixed").mapInArrow(
        _extract, f"id {ids}, url string, text string, n_chars long"
    )
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
