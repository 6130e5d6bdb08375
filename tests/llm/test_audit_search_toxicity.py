"""Source divergence, lexical search and toxicity against plain Python, and their edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from skillcorpus.llm import divergence, lexical_search, queries, terms, toxicity
from tests.conftest import differences

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta " * 60_000 + "gamma"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def random_docs(n, seed):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["Éa", "ß9", "x1"]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice([1, 3, 8, 20, 60])))
        out.append((i, rng.choice([text, text.title(), text.replace(" ", ", ")]), rng.choice(["en", "de"]), f"s{rng.randrange(5)}", len(text)))
    return out


ODD = [(9001, None, "en", "s1", None), (9002, "", None, None, 0), (9003, "!? 12", "zz", "a", 5), (9004, "!", "zz", "b", 1), (None, "waak wabk", "en", None, 9), (9005, LONG, "en", "s1", len(LONG)), (9005, LONG, "en", "s1", len(LONG))]


def test_words_are_cut_nowhere():
    text = ("é" * 37 + " Ab1 ").encode() * 60_000
    for digits, regex in ((True, rb"[0-9a-z\x80-\xff]+"), (False, rb"[a-z\x80-\xff]+")):
        assert [w for ws in terms.words(text, terms.table(digits)) for w in ws] == re.findall(regex, text.lower())
    assert [w for ws in terms.words(b"x" * (terms.PIECE + 9000), terms.table(True)) for w in ws] == [b"x" * (terms.PIECE + 9000)]
    assert list(terms.words(None, terms.table(True))) == []


# ---------------------------------------------------------------- lexical search


def searched(rows, items, k):
    """Scores of all documents by the stated formula."""
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(x))
    bags = [(r[0], Counter(cut(r[1]))) for r in rows if cut(r[1])]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(cut(text)) if bag[t])
            if s > 0:
                scores.append((-s, -math.inf if i is None else i))
        out += [(item, r, None if i == -math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block_terms", [1 << 20, 8])
def test_search_against_all_scores(spark, block_terms, monkeypatch):
    monkeypatch.setattr(lexical_search, "RANGE_ROWS", 40)
    rows = random_docs(400, 1) + ODD
    items = [(i, r[1]) for i, r in enumerate(random_docs(25, 2))] + [(77, None), (78, "?"), (79, "unknownword"), (80, "waak waak WAAK"), (80, "alpha")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "1 as term", "2 as norm")
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 7, block_terms=block_terms)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == Counter(searched(rows, items, 7))


def test_buckets_prune_and_lose_nothing():
    """Of a bucket only what reaches the threshold is returned, all of it, and a bucket of short vectors is passed over."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    w = rng.integers(1, 9000, 50)
    lists = [np.unique(rng.integers(0, 50, rng.integers(1, 20))) for _ in range(300)]
    tf = [rng.integers(1, 5, len(x)) for x in lists]
    m = rng.integers(50, 400, 300)
    norm = np.array([math.sqrt(sum(w[t] * float(lexical_search.impact(f, mm)) ** 2 for t, f in zip(ts, fs, strict=True))) for ts, fs, mm in zip(lists, tf, m, strict=True)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(m), *(pa.array([x.astype(np.int32) for x in y], pa.list_(pa.int32())) for y in (lists, tf)), pa.array(norm)], names=["doc_id", "m", "term", "tf", "norm"])
    bucket = lexical_search.Bucket(batch, w)
    for _ in range(40):
        query = lexical_search.Query(rng.choice(50, 6, replace=False), w)
        full = {i: sum(int(w[t]) * int(lexical_search.impact(f, m[i])) for t, f in zip(lists[i], tf[i], strict=True) if t in query.ids) for i in range(300)}
        for least in (1, sorted(full.values())[-40], max(full.values()), int(query.rest[0] * bucket.longest) + 10):
            ids, scores = bucket.search(query, max(least, 1))
            assert dict(zip(ids.tolist(), scores.tolist(), strict=True)) == {i: s for i, s in full.items() if s >= max(least, 1)}


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(spark.createDataFrame(ODD, DOCS), items.filter("false")).collect() == []


# ---------------------------------------------------------------- source divergence


@pytest.mark.parametrize("leaves", [1 << 20, 1])
def test_divergence_against_sql(spark, leaves, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = random_docs(300, 3) + ODD
    docs = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "1 as block", "2 as total")
    view = {"documents": pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")])}
    assert differences(divergence.divergence(docs, leaves=leaves), queries.ORACLES["op11_consed_trees"], "", view) == []


def test_trees_share_nodes_and_price_pairs_once():
    leaves = np.tile(np.array([[0, 0, 1, 2, 0, 0, 1, 2], [0, 0, 0, 0, 5, 0, 0, 0], [3, 0, 1, 2, 3, 0, 1, 2]]), (1, 128))
    forest = divergence.Forest(leaves)
    assert sum(map(len, forest.left)) + len(forest.values) < 40  # of 3 x 2,047 places
    which, a, b, places = forest.pairs(0, np.array([1, 2]))
    assert len(which) < 12 and places.sum() == 2 * leaves.shape[1]
    got = Counter()
    for w, x, y, n in zip(which, forest.values[a], forest.values[b], places, strict=True):
        got[int(w), int(x), int(y)] += int(n)
    assert got == Counter((w, int(x), int(y)) for w in (0, 1) for x, y in zip(leaves[0], leaves[w + 1], strict=True))
    at, a, b = forest.places(1, 2, 0)
    assert sorted(zip(at.tolist(), forest.values[a].tolist(), forest.values[b].tolist(), strict=True)) == [(i, 5, 3) for i in range(1024) if i % 8 == 4]
    one = divergence.Forest(np.array([[4], [7]]))
    assert [x.tolist() for x in one.pairs(0, np.array([1]))] == [[0], [0], [1], [1]] and one.places(0, 1, 0)[0].tolist() == [0]


def test_huge_counts_stay_exact():
    n = 10**13
    assert divergence.probabilities(np.array([0, n]), 3 * n, 5).tolist() == [1 + 10**9 // (3 * n + 5), 1 + 10**9 * (n + 1) // (3 * n + 5)]


def test_divergence_of_nothing(spark):
    out = divergence.divergence(spark.createDataFrame([], DOCS))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.collect() == []


# ---------------------------------------------------------------- toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    base = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "aliqua", "trashcan", "bin"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(base, k=rng.randrange(20, 200))
        toxic = int(rng.random() < 0.3)
        for _ in range(max(1, len(words) // 50) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "vilif" + rng.choice(["ax", "oz", "er", "un"])]))
        if rng.random() < 0.06:  # harmless with what follows it
            words.insert(0, "idiot proof")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_fold():
    text, n = toxicity.fold("1oser іdiot ѕtup1d l0ser $tupid! foo@bar 12 3 ａｂc na​ive x_1 café")
    assert text.split() == "ioser idiot stupid loser stupid fooabar 12 3 abc naive x 1 café loser stupld".split() and n == 13
    assert toxicity.fold(None) == ("  ", 0) and toxicity.fold(" \n!") == ("  ", 0)


def test_matcher_against_plain_search():
    weights, exceptions = {"idiot$": 2.0, "vil": 1.0, "bad$": 3.0}, ["idiot proof", "so bad", "village"]
    matcher, rng = toxicity.Matcher(weights, exceptions), random.Random(5)
    for _ in range(200):
        words = rng.choices(["idiot", "proof", "vile", "village", "so", "bad", "badly", "x", "devil"], k=rng.randrange(0, 12))
        want = []
        for i, w in enumerate(words):
            pairs = {w, " ".join(words[i : i + 2]), " ".join(words[max(0, i - 1) : i + 1])}
            if (w in ("idiot", "bad") or w.startswith("vil")) and not pairs & set(exceptions):
                want.append(w)
        folded = toxicity.fold(" ".join(words))[0]
        assert [folded[at + 1 :].split(" ")[0] for at, _, _ in sorted(matcher.hits(folded))] == want


def test_learns_entries_stems_and_exceptions(spark):
    rows, labels = toxic_rows(1500, 6)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.learn(docs, marks.filter(~out))
    assert {"idiot$", "moron$"} <= set(model["weights"]) and any(e.startswith("vil") for e in model["weights"]) and len(model["weights"]) < 6
    assert "idiot proof" in model["exceptions"]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).filter(out).collect()}
    truth = dict(labels)
    assert len(got) > 200 and sum(truth[i] == p for i, p in got.items()) / len(got) > 0.97
    odd = spark.createDataFrame([(1, "you M0R0N, ｉdiot and мoron", 5.0), (2, None, 1.0), (3, "", 1.0), (3, "", 1.0), (4, "lorem " * 50_000 + "moron", 1.0)], "doc_id long, text string, score double")
    scored = toxicity.score(odd, model).collect()
    assert {(r.doc_id, r.hits) for r in scored} == {(1, 3), (2, 0), (3, 0), (4, 1)} and len(scored) == 5
    by_id = {r.doc_id: r.score for r in scored}
    short = toxicity.score(spark.createDataFrame([(5, "lorem moron")], "doc_id long, text string"), model).first().score
    assert by_id[1] >= 0.5 > by_id[2] == by_id[3] and by_id[4] < short  # one hit weighs less in a longer text
    assert toxicity.score(docs.filter("false"), model).collect() == []


def test_scores_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert model["weights"] == {} and all(abs(r.score - share) < 1e-6 for r in toxicity.score(docs, model).collect())


def test_held_out_accuracy(spark):
    """On the table: what the labels say of rows that were not learned from."""
    sf_dir = "/root/testdata/sf0.01"
    found = queries.QUERIES["op13_toxic_lexicon"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (found["predicted"] == found["toxic"]).mean() > 0.95 and found["score"].between(0, 1).all()
