"""Operators that SQL cannot express, against plain Python over the same rows."""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcorpus.llm import decontamination, html_extract, jaccard_join, language_id, queries, sharding
from skillcorpus.sources.tables import table

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text: str | None) -> set:
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in rows}
    lists = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            lists[x].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for y in lists[x]:
                if y < k:
                    shared[y] += 1
        for y, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[y]) - n):
                a, b = find(k), find(y)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(seed: int, n_groups: int = 6, size: int = 25) -> list[tuple[int, str]]:
    """Groups of near copies at all distances, a passage that most documents share, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows: list[tuple[int, str]] = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randint(8, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w[at:at] = passage
            rows.append((0, " ".join(w)))
    rows += [(0, " ".join(passage + [word() for _ in range(rng.randint(1, 90))])) for _ in range(60)]
    rows += [(0, rows[0][1]), (0, rows[0][1].upper() + " "), (0, ""), (0, " \n"), (0, "One two"), (0, "one  TWO"), (0, "x")]
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_on_copies_and_common_passages(spark, seed, monkeypatch):
    rows = near_copies(seed)
    if seed == 2:  # so small that blocks are cut into several searches
        monkeypatch.setattr(jaccard_join, "TASK", 4000)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows)


def test_jaccard_join_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.op2_ngram_jaccard(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows)


def test_divide_skip_is_exact():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 40, 300).astype(np.uint64))
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(20, 300), replace=False), rng.integers(0, 1 << 40, rng.integers(0, 40)).astype(np.uint64)]) for _ in range(60)]
    links = jaccard_join.divide_skip(sets, np.arange(len(sets)))

    def components(pairs):
        p = list(range(len(sets)))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            p[find(a)] = find(b)
        groups = defaultdict(set)
        for i in range(len(sets)):
            groups[find(i)].add(i)
        return sorted(map(sorted, groups.values()))

    true = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    assert components(links) == components(true)
    assert all(tuple(sorted(x, reverse=True)) in set(true) for x in links)


def test_sharding_by_bytes(spark, sf_dir):
    rows = queries.op3_sampled_splitters(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    import zlib

    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        shards[r.shard].append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        assert abs(sum(r["size"] for r in s) - total / 40) <= largest
    # the same whatever the ranges are
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    docs = table(spark, sf_dir, "documents")
    assert key(sharding.shard(docs, 40, ranges=3, sample=50)) == key(sharding.shard(docs, 40, ranges=200, sample=20000)) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_sharding_of_one_hot_text(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "the same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = sharding.shard(docs, 10, sample=100).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 60


def test_language_id_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = queries.op5_output_codes(spark, sf).collect()
    out = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == len(truth) and len(out) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def grams(text: str) -> dict:
    """(order, feature) -> how often, from the bytes before each place one by one."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    x = [32, 32, 32, *map(fold, text.encode())]
    out = defaultdict(int)
    for i in range(3, len(x)):
        three = x[i] | x[i - 1] << 8 | x[i - 2] << 16
        four = three ^ (x[i - 3] * 0x01000193 & 0xFFFFFFFF)
        for order, salt, gram in ((0, 0x9E3779B1, three), (1, 0x85EBCA77, four)):
            out[order, (gram * salt & 0xFFFFFFFF) >> 32 - language_id.FEATURE_BITS] += 1
    return out


def test_language_id_against_plain_python(spark):
    rng = random.Random(4)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["ko", "la", "mu"], "cc": ["ti", "re", "sö"]}
    word = lambda k: "".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate([*sounds] * 12)] + [(90, "x", None), (91, "", None), (92, "12 !", None), (93, "Ka", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    draw = {r.doc_id: r.fold for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) % 2).alias("fold")).collect()}
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}

    langs, size = sorted(sounds), 1 << language_id.FEATURE_BITS
    code = language_id.codewords(3)
    count = {(k, f): defaultdict(float) for k in langs for f in (0, 1)}
    for i, text, k in rows:
        for key, n in grams(text).items() if k else ():
            count[k, draw[i]][key] += n / len(text.encode()) ** 0.5

    def weights(folds):
        share = []
        for k in langs:
            one = {key: sum(count[k, f].get(key, 0) for f in folds) + 0.05 for f0 in folds for key in count[k, f0]}
            total = [sum(v for (o, _), v in one.items() if o == order) + 0.05 * (size - sum(o == order for o, _ in one)) for order in (0, 1)]
            share.append(lambda key, one=one, total=total: one.get(key, 0.05) / total[key[0]])
        mean = lambda key, b, side: (v := [share[j](key) for j in range(3) if code[j, b] == side], sum(v) / len(v))[1]
        return lambda key, b: max(-4.0, min(4.0, float(np.log(mean(key, b, 1) / mean(key, b, -1)))))

    bits = range(code.shape[1])
    margin = np.zeros((2, 3, len(bits)))
    for half in (0, 1):
        w = weights([1 - half])
        for j, k in enumerate(langs):
            sums = [sum(v for (o, _), v in count[k, half].items() if o == order) for order in (0, 1)]
            margin[half, j] = [sum(v / sums[key[0]] * w(key, b) for key, v in count[k, half].items()) * code[j, b] for b in bits]
    scale, good = 1 / np.abs(margin).mean((0, 1)), np.maximum((margin > 0).mean((0, 1)) - 0.5, 0.01)
    w = weights([0, 1])
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        m = np.array([sum(n * w(key, b) for key, n in grams(text).items()) / len(text.encode()) for b in bits]) * scale * 2
        loss = np.array([(np.logaddexp(0, -m * c) * good / good.sum()).sum() for c in code])
        p = np.exp(-6 * (loss - loss.min()))
        assert got[i].lang_pred == langs[int(loss.argmin())] and got[i].score == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_codewords_are_apart():
    for n in (2, 3, 5, 7, 12, 40):
        code = language_id.codewords(n)
        gaps = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(gaps) >= max(1, code.shape[1] // 4)


def greedy_tiles(doc: list[str], item: list[str], k: int) -> int:
    """Tokens of ``item`` tiled by the textbook algorithm: search all unmarked matches, mark the longest, again and again."""
    dm, im, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and not im[q + n] and not dm[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        n, q, p = best
        if n < k:
            return covered
        for t in range(n):
            im[q + t] = dm[p + t] = True
        covered += n


@pytest.mark.parametrize("step", [1, 37, 1 << 20])
def test_string_tiling(spark, step, monkeypatch):
    monkeypatch.setattr(decontamination, "STEP", step)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(2))
    items = [(i, [word() for _ in range(rng.randint(1, 24))]) for i in range(12)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            part = list(rng.choice(items)[1])
            if rng.random() < 0.5:  # parts in another order
                cut = rng.randrange(len(part) + 1)
                part = part[cut:] + part[:cut]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((d, w))
    got = decontamination.leaks(spark.createDataFrame([(d, " ".join(w).upper()) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), threshold=0.6)
    want = {(d, i): c for d, w in docs for i, t in items if (c := greedy_tiles(w, t, min(5, len(t))) / len(t)) >= 0.6}
    assert {(r.doc_id, r.item_id): pytest.approx(r.coverage) for r in got.collect()} == want


def test_a_text_that_repeats_a_passage():
    """Pairs of positions are never all there at once, and tiling ends when the item is full."""
    doc, item = np.zeros(200_000, np.int64), np.zeros(56, np.int64)
    found = decontamination.matches(doc, np.arange(len(doc)), item, np.arange(len(item)), 5)
    assert found[:, 2].max() == 60 and len(found) == 200_055 and decontamination.tile(found, 5, 60) == [(0, 0, 60)]


def test_tiling_with_a_full_filter(spark, sf_dir, monkeypatch):
    one = {(r.doc_id, tuple(r.item_ids)) for r in queries.op9_string_tiling(spark, sf_dir).collect()}
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 15)
    assert {(r.doc_id, tuple(r.item_ids)) for r in queries.op9_string_tiling(spark, sf_dir).collect()} == one
    items = {r.item_id: " ".join(r.text.lower().split()) for r in table(spark, sf_dir, "benchmark").collect()}
    for r in table(spark, sf_dir, "documents").collect():
        inside = {i for i, t in items.items() if f" {t} " in f" {' '.join(r.text.lower().split())} "}
        assert inside <= set(dict(one)[r.doc_id])


def test_html_of_the_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in queries.op10_union_free_wrappers(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div)\b[^>]*>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><main><article><h2>A &lt;b&gt; title</h2><p>First <b>bold</b>&nbsp;word{0}.<p>Second
 line<aside>Related</aside><ul><li>one<li>two</ul><form><label>Mail</label><button>Send</button></form></article></main>
<section id="comments"><p>Nice post</p></section><aside class="sidebar">Links</aside><!-- <p>hidden</p> --><footer>&copy; site</footer></body></html>"""


def test_html_leaves_out_what_is_not_the_article(spark):
    rows = [(i, "http://h.example.com/p", PAGE.format(i)) for i in range(4)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"A <b> title First bold word{i}. Second line one two" for i in range(4)]


def test_html_without_article_takes_what_changes(spark):
    page = "<body><div class=top>Welcome to us</div><div class=story><p>Text number {0} is here and goes on</p><p>and more {0}</p></div><div class=end>All rights</div></body>"
    rows = [(i, "http://h.example.com/p", page.format(i)) for i in range(5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Text number {i} is here and goes on and more {i}" for i in range(5)}


def test_wrapper_alignment():
    assert html_extract.align(["a", "b", "c"], ["a", "c"]) == ["a", "b?", "c"]
    assert html_extract.align(["a", "c"], ["a", "b+", "c"]) == ["a", "b+?", "c"]
    assert html_extract.align(["a", "b+"], ["a", "b"]) == ["a", "b+"]
    assert html_extract.align([], ["a"]) == ["a?"]
