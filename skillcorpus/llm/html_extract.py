"""HTML extraction with wrappers inferred as union-free regular expressions.

The token streams of a host's pages are aligned with each other: equal items stay, repeated runs become groups that may
repeat (``+``), items that some pages lack become optional (``?``), and text becomes slots. Shapes that are not alike make
templates of their own. A place in a template's wrapper is template text where all its pages agree on it, else data; the
data places that a page's items match are its main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcorpus.llm.url_filter import url_host
from skillcorpus.plans.storage import cut

# Element kinds of HTML, and names that mark what is not main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg math select button object".split()
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that only part text and do not tell where it stands.
FLAT = set("br hr p h1 h2 h3 h4 h5 h6 pre blockquote dd dt li td th tr tbody thead tfoot caption figcaption summary legend option".split())
#: A start tag of the left ends an open element of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = set("head nav header footer aside form menu dialog title".split())
NAMES = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus "
    "feedback footer guestbook header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion reactions "
    "related replies respond responses share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
ROLES = set("banner navigation complementary contentinfo search form dialog alert note menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_WITHIN = re.compile(r"(?:^|/)(?:article|main)(?:[./]|$)")
#: Lists, tables and figures that stand right in an article are parts of its text.
_FLOW = re.compile(r"(?:^|/)(?:article|main)(?:\.[^/]*)?(?:/(?:ul|ol|dl|table|figure))+$")

PARSED = ["host", "page", "sid", "shape", "h", "chars", "item", "texts"]
#: Shapes that one task aligns.
GROUP = 128


def label(tag: str, attrs: str) -> tuple[str, bool]:
    """An element's name in a wrapper (tag with its class), and whether it marks what is not main text."""
    out, name = tag in OUTSIDE, tag
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").strip().lower()
        if key.lower() == "class" and value:
            name = f"{tag}.{value.split()[0]}"
        words = {w.lower() for w in _WORD.findall(value)}
        out = out or bool(words & (ROLES if key.lower() == "role" else NAMES))
    return name, out and tag not in ("html", "body", "main")


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """The text blocks of a page in order: (slot, whether it stands outside main text, text).

    A slot is the path of the containers that a block stands in. Comments, markup, scripts, styles and form controls are no text.
    Character references are decoded after the markup is gone, and white space within a block becomes one space.
    """
    stack: list[tuple[str, str, bool]] = []
    found: list[tuple[str, bool, str]] = []
    parts: list[str] = []
    here = ("", False)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((*here, text))

    def place() -> tuple[str, bool]:
        return "/".join(n for t, n, _ in stack if t not in FLAT), any(o for _, _, o in stack)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag not in BLOCKS:
            if m[1] and m[1].lower() in ("iframe", "textarea", "object"):
                flush()
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if tag != "p" and tag not in CLOSES and stack and stack[-1][0] == "p" or tag == "p" and any(s[0] == "p" for s in stack[-1:]):
                stack.pop()
            for i in range(len(stack) - 1, -1, -1):
                if tag in CLOSES and stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] not in FLAT:
                    break
            stack.append((tag, *label(tag, m[4] or "")))
        here = place()
    parts.append(page[at:])
    flush()
    return found


def folded(slots: list[str]) -> tuple[list[str], list[list[int]]]:
    """A page's items, and for each item the numbers of the ``slots`` that it holds.

    A slot that follows itself is one item that repeats (``slot+``); so are the items of a listing, a run of slots of any length that
    follows itself: at once, if it has more than eight slots, else four times or more. What is shorter keeps its places, as its texts may be of unlike kinds.
    """
    names: list[str] = []
    held: list[list[int]] = []
    listed: list[int] = []  # the length of the listed run that an item is in
    where: dict[str, list[int]] = {}  # of each slot its places in names, ascending
    for k, slot in enumerate(slots):
        if names and names[-1] == slot:
            held[-1].append(k)
            continue
        names.append(slot)
        held.append([k])
        listed.append(0)
        where.setdefault(slot, []).append(len(names) - 1)
        again = True
        while again:
            again = False
            for before in where[names[-1]][-2::-1]:  # a run ends with the slot that it goes on after
                p = len(names) - 1 - before
                if 2 * p > len(names):
                    break
                times = 2 if p > 8 or all(x == p for x in listed[-2 * p : -p]) else 4
                if times * p <= len(names) and all(names[-p - 1 - q] == names[-1 - q] for q in range((times - 1) * p)):
                    for _ in range(times - 1):
                        for q in range(-p, 0):
                            held[q - p] += held[q]
                            where[names[q]].pop()
                        del names[-p:], held[-p:], listed[-p:]
                    listed[-p:] = [p] * p
                    again = True
                    break
    return [n + "+" * (len(h) > 1) for n, h in zip(names, held, strict=True)], held


def _longest(x: list[str], y: list[str], weight: np.ndarray | None = None) -> np.ndarray:
    """The common subsequence's length (or greatest weight, by ``y``) of each pair of ends of two lists."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(s, len(number)) for s in z], np.int64) for z in (x, y))
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32 if weight is None or int(weight.sum()) < 1 << 31 else np.int64)
    for i in range(len(x) - 1, -1, -1):
        best = np.maximum(table[i + 1, :-1], np.where(b == a[i], table[i + 1, 1:] + (1 if weight is None else weight), 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return table


def align(a: list[str], b: list[str]) -> list[str]:
    """Resolves the mismatches of two item lists into one that fits all that either fits.

    Items are ``slot`` with ``+`` (repeats) and ``?`` (optional). The longest common subsequence of slots stands, ``+`` or
    ``?`` wherever either list has it; what is in one list only becomes optional at its place.
    """
    x, y = [i.rstrip("+?") for i in a], [i.rstrip("+?") for i in b]
    same = next((k for k, (s, t) in enumerate(zip(x, y, strict=False)) if s != t), min(len(x), len(y)))  # what both begin with needs no table
    table = _longest(x[same:], y[same:])
    out, i, j = [], 0, 0
    optional = lambda s: s if s.endswith("?") else s + "?"
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            flags = a[i][len(x[i]) :] + b[j][len(y[j]) :]
            out.append(x[i] + "+" * ("+" in flags) + "?" * ("?" in flags))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and table[i + 1 - same, j - same] >= table[i - same, j + 1 - same]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    merged: list[str] = []  # a slot that alignment has put next to itself is a repeat
    for item in out:
        if merged and merged[-1].rstrip("+?") == item.rstrip("+?"):
            merged[-1] = item.rstrip("+?") + "+" + "?" * (merged[-1].endswith("?") and item.endswith("?"))
        else:
            merged.append(item)
    return merged


def match(items: list[str], wrapper: list[str]) -> list[int]:
    """For each of a page's items its place in the wrapper that was aligned from it, required places before optional ones."""
    x, y = [i.rstrip("+?") for i in items], [i.rstrip("+?") for i in wrapper]
    weight = np.array([len(x) + 1 + (not w.endswith("?")) for w in wrapper], np.int64)
    table = _longest(x, y, weight)
    places, i, j = [-1] * len(x), 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and table[i, j] == table[i + 1, j + 1] + weight[j]:
            places[i] = j
            i, j = i + 1, j + 1
        elif table[i, j] == table[i, j + 1]:
            j += 1
        else:
            i += 1
    return places


def likeness(a: list[str], b: list[str]) -> float:
    """How far two item lists are of one template: the share of the shorter's items that both have in order, outside ones aside; 0 if under half."""
    x, y = ([i.rstrip("+?") for i in z if not i.startswith("!")] for z in (a, b))
    if not x or not y:
        return float(not x and not y)
    share = int(_longest(x, y)[0, 0]) / min(len(x), len(y))
    return share if share >= 0.5 else 0.0


def _parsed(names: list[str]):
    """Each page's host, hash, shape (its items, a line each), by item the hash and the length of its text (null outside), and its texts with their items."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page in batch.column(0).to_pylist():
                found = blocks(page or "")
                items, held = folded([("!" if out else "") + slot for slot, out, _ in found])
                at = [0] * len(found)
                for i, members in enumerate(held):
                    for k in members:
                        at[k] = i
                inside = [k for k, (_, out, _) in enumerate(found) if not out]
                h = [None if item.startswith("!") else xxhash.xxh64_intdigest(" ".join(found[k][2] for k in sorted(members))) >> 1 for item, members in zip(items, held, strict=True)]
                chars = [None if item.startswith("!") else sum(len(found[k][2]) for k in members) for item, members in zip(items, held, strict=True)]
                shape = "\n".join(items)
                rows.append((xxhash.xxh64_intdigest(page or "") >> 1, xxhash.xxh64_intdigest(shape) >> 1, shape, h, chars, [at[k] for k in inside], [found[k][2] for k in inside]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), *batch.columns[2:]], names=[*PARSED, *names])

    return of


def _templates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Aligns a group's wrappers, the most frequent first, each with the one it is most like; ``to`` names the first of each template."""
    pdf = pdf.sort_values(["n", "id"], ascending=[False, True])
    found: list[list] = []
    to = []
    for ident, wrapper, n in zip(pdf["id"], pdf["wrapper"], pdf["n"], strict=True):
        items = wrapper.split("\n")
        like = [likeness(f[1], items) for f in found]
        best = int(np.argmax(like)) if like else -1
        if best < 0 or not like[best]:
            found.append([ident, items, 0])
            best = len(found) - 1
        else:
            found[best][1] = align(found[best][1], items)
        found[best][2] += n
        to.append(found[best][0])
    firsts = {f[0]: f for f in found}
    out = pd.DataFrame({"host": pdf["host"].to_numpy(), "id": pdf["id"].to_numpy(), "to": np.array(to, np.int64)})
    out["wrapper"] = ["\n".join(firsts[i][1]) if i in firsts else None for i in out["id"]]
    out["n"] = [int(firsts[i][2]) if i in firsts else 0 for i in out["id"]]
    return out


def templates(shapes: DataFrame) -> DataFrame:
    """``host, sid, shape, cid, wrapper``: for each shape (``host, sid, shape, n``) the wrapper of its template within the host.

    Shapes are aligned in groups of about ``GROUP`` a host, as many as its shapes need, and the groups' wrappers again in
    groups, until each host's are one group, or none are alike.
    """
    level = shapes.select("host", F.col("sid").alias("id"), F.col("shape").alias("wrapper"), "n")
    of = shapes.select("host", "sid", "shape", F.col("sid").alias("cid"))
    turn = 0
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
        before, most = sizes.agg(F.sum("k"), F.max("k")).first()
        part = F.pmod(F.xxhash64("wrapper", F.lit(turn)), F.ceil(F.col("k") / GROUP)).alias("part")
        grouped = level.join(sizes, "host").select("host", "id", "wrapper", "n", part).groupBy("host", "part")
        out = cut(grouped.applyInPandas(_templates, "host string, id long, to long, wrapper string, n long"), "templates")
        of = of.join(out.select("host", F.col("id").alias("cid"), "to"), ["host", "cid"]).select("host", "sid", "shape", F.col("to").alias("cid"))
        level = out.filter("wrapper is not null").select("host", "id", "wrapper", "n")
        turn += 1
        if before is None or most <= GROUP or level.count() == before:
            return of.join(level.select("host", F.col("id").alias("cid"), "wrapper"), ["host", "cid"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [match(s.split("\n"), w.split("\n")) for s, w in zip(batch.column("shape").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.select(["host", "sid", "cid", "wrapper"]).columns, pa.array(places, pa.list_(pa.int32()))], names=["host", "sid", "cid", "wrapper", "places"])


def repeated_story(slots: list[str], fixed: dict[int, int], total: int) -> set[int]:
    """Places of a template's container whose ``fixed`` text (place and characters) is most of ``total``, what the template's pages have in all."""
    out: set[int] = set()
    for p in fixed:
        within = {q for q in fixed if slots[q] == slots[p] or slots[q].startswith(f"{slots[p]}/")}
        if slots[p] not in ("", "html", "body", "html/body") and 2 * sum(fixed[q] for q in within) > total:
            out |= within
    return out


def main_items(wrapper: list[str], data: set[int], places: list[int], fixed: dict[int, int] | None = None, total: int = 0) -> list[int]:
    """Which items of a shape are main text, by their ``places`` in its template's wrapper, the places that hold ``data``, and the ``fixed`` ones (see ``repeated_story``).

    Under ``article`` or ``main``, data, and lists, tables and figures of the article's own; all there if nothing of it is
    data. A shape without such takes all its data, and a story that all pages repeat. If a template has no data, its pages differ outside their text only, and all of it is kept.
    """
    slots = [w.rstrip("+?") for w in wrapper]
    inside = {p for p, s in enumerate(slots) if not s.startswith("!") and _WITHIN.search(s)}
    main = {p for p in inside if p in data or _FLOW.search(slots[p])} if inside & data else inside
    told = data | repeated_story(slots, fixed or {}, total)
    shown = [i for i, p in enumerate(places) if p >= 0 and not slots[p].startswith("!")]
    return [i for i, p in enumerate(places) if p in main] or ([i for i, p in enumerate(places) if p in told] if data else shown)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("wrapper", "data", "places", "fixed", "all_chars"))
        keep = [main_items(w.split("\n"), set(d or ()), p, {x["place"]: x["chars"] for x in f or ()}, n or 0) for w, d, p, f, n in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.select(["host", "sid"]).columns, pa.array(keep, pa.list_(pa.int32()))], names=["host", "sid", "keep"])


def wrappers(parsed: DataFrame, alike: int = 3) -> DataFrame:
    """One row per shape of a host: ``host, sid, keep`` (its items of main text).

    All pages take part. Equal shapes are counted first, then aligned into the host's templates, and each shape's items are
    matched with its template's wrapper. A place in the wrapper is template text where all pages that have it agree on it
    (two different pages at least, in a template of ``alike`` or more), else data. A container that agrees but holds most of its template's text is
    a story that the site repeats, under stamps or counters that differ, and no template text; see ``main_items`` for what is kept.
    """
    pages = parsed.select("host", "sid", "page", "shape", "h", "chars").filter("shape <> ''")
    shapes = cut(pages.groupBy("host", "sid").agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("n")), "shapes")
    matched = cut(templates(shapes).mapInArrow(_matched, "host string, sid long, cid long, wrapper string, places array<int>"), "matched")
    at = matched.select("host", "sid", "cid", "places")
    different = pages.groupBy("host", "sid", "page").agg(F.first(F.arrays_zip("h", "chars")).alias("held")).join(at, ["host", "sid"])
    texts = different.select("host", "cid", "places", F.posexplode("held").alias("item", "x")).filter("x.h is not null").select("host", "cid", F.expr("places[item]").alias("place"), "x.h", "x.chars")
    judged = texts.groupBy("host", "cid", "place").agg((F.min("h") == F.max("h")).alias("same"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    sizes = different.groupBy("host", "cid").agg(F.count(F.lit(1)).alias("pages"))
    fixed = F.col("same") & (F.col("n") > 1) & (F.col("pages") >= alike)
    marked = judged.join(sizes, ["host", "cid"])
    kinds = (F.collect_list(F.when(~fixed, F.col("place"))).alias("data"), F.collect_list(F.when(fixed, F.struct("place", "chars"))).alias("fixed"), F.sum("chars").alias("all_chars"))
    kinds = marked.groupBy("host", "cid").agg(*kinds)  # as many as a wrapper has places
    return matched.join(kinds, ["host", "cid"], "left").select("host", "sid", "wrapper", "places", "data", "fixed", "all_chars").mapInArrow(_chosen, "host string, sid long, keep array<int>")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html``, with ``text``: its main text (empty if none; a column of this name is replaced).

    The page is parsed as a whole, once; blocks of main items are joined by one space in page order. Null pages are empty.
    Null URLs and such without ``://`` belong to the host of empty name. Repeated rows count each. Empty input gives no rows.
    """
    kept = [c for c in pages.columns if c not in (page, "text")]
    held = [f"__{i}" for i in range(len(kept))]
    rows = pages.select(F.col(page), url_host(F.col(url)), *(F.col(c).alias(h) for c, h in zip(kept, held, strict=True)))
    own = [T.StructField(h, pages.schema[c].dataType) for c, h in zip(kept, held, strict=True)]
    parsed = cut(rows.mapInArrow(_parsed(held), T.StructType([*T._parse_datatype_string("host string, page long, sid long, shape string, h array<long>, chars array<long>, item array<int>, texts array<string>").fields, *own])), "parsed")
    found = cut(wrappers(parsed), "wrappers")
    joined = parsed.select("host", "sid", "item", "texts", *held).join(found, ["host", "sid"], "left")
    text = F.array_join(F.filter("texts", lambda t, i: F.array_contains("keep", F.get("item", i))), " ")
    return joined.select(*(F.col(h).alias(c) for c, h in zip(kept, held, strict=True)), F.coalesce(text, F.lit("")).alias("text"))
