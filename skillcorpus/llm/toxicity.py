"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding undoes look-alike letters and digits in place of letters. Entries are whole words or beginnings of words with a weight,
the log of how much likelier they are in toxic texts; phrases in which an entry is harmless are exceptions. The weights of
a text's hits, alone and by the text's length, give its score. Entries, weights, exceptions and the curve of scores are learned from labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcorpus.plans.storage import cut

#: Labelled texts of each class that learning reads, about.
PER_LABEL = 12_000
#: Letters of a beginning of a word, at least and at most; share of the toxic texts that an entry is in at least; clean texts that an exception takes.
STEM, ENTRY_SHARE, EXCEPTION_TEXTS = (3, 10), 0.01, 5
#: Letters of other scripts that look like Latin ones, after lower-casing.
LOOKS = dict(zip("авсԁеһіјкӏморԛгѕтуѵԝхαβεηικνορτυχγωıɑɡ", "abcdehijklmopqrstyvwxabenikvoptuxywiag", strict=True))
#: Digits and signs that stand for letters within a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
_LOOKS = str.maketrans(LOOKS | dict.fromkeys("­​‌‍⁠﻿", ""))
_LEET = str.maketrans(LEET)
_SIGNS = re.compile(r"(?<=\w)[@$!|](?=\w)|(?<!\w)[@$](?=[^\W\d])")
_MIXED = re.compile(r"\d+[^\W\d]\w*|[^\W\d]+\d\w*")
_MARKS = re.compile(r"[̀-ͯ]+")
_REST = re.compile(r"[\W_]+")


def fold(text: str | None) -> tuple[str, int]:
    """A text's words, folded, each between spaces, and their number; a word with a 1 is there twice, also read as an l, and counts once."""
    out = (text or "").lower()
    if not out.isascii():
        out = _MARKS.sub("", unicodedata.normalize("NFKC", out)).translate(_LOOKS)
    if "@" in out or "$" in out or "!" in out or "|" in out:
        out = _SIGNS.sub(lambda m: LEET[m[0]], out)
    out = _REST.sub(" ", out)
    again: list[str] = []

    def letters(m: re.Match) -> str:
        if "1" in m[0]:
            again.append(m[0].replace("1", "l").translate(_LEET))
        return m[0].translate(_LEET)

    out = _MIXED.sub(letters, out).strip(" ")
    n = out.count(" ") + 1 if out else 0
    return f" {' '.join([out, *again])} ", n


class Matcher:
    """Finds entries (``word$`` a whole word, ``wor`` a beginning) and exceptions in folded texts."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]) -> None:
        self.machine = ahocorasick.Automaton()
        for e, w in weights.items():
            pattern = f" {e[:-1]} " if e.endswith("$") else f" {e}"
            self.machine.add_word(pattern, (len(pattern), w, e))
        for phrase in exceptions:
            pattern = f" {phrase} "
            self.machine.add_word(pattern, (len(pattern), None, phrase))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float, str]]:
        """Where, with which weight and which entry; not within an exception."""
        if not len(self.machine):
            return []
        found, spared = [], []
        for end, (size, weight, entry) in self.machine.iter(folded):
            (found.append((end - size + 1, weight, entry)) if weight is not None else spared.append((end - size + 1, end)))
        if spared:
            found = [f for f in found if not any(a <= f[0] < b for a, b in spared)]
        return found


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a text's sum of weights and its length give: one, the sum by length, the sum."""
    return np.stack([np.ones(len(weight)), np.log1p(100 * weight / (words + 10)), np.log1p(weight)], 1)


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve, drawn towards zero (but for the first)."""
    beta, pull = np.zeros(x.shape[1]), np.diag([1e-3, *[0.3] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ beta)
        beta += np.clip(step, -2, 2)
    return beta


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``word, toxic, clean``: texts of each label that have a word."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[label].update(set(fold(text)[0].split()))
    words = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts[::-1])], names=["word", "toxic", "clean"])


def _phrases(weights: dict[str, float]):
    """Rows ``phrase, toxic, clean``: hit words of beginnings, and hit words with the word before or after, by texts that have them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, counts = Matcher(weights, []), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, seen = fold(text)[0], set()
                for at, _, entry in matcher.hits(folded):
                    end = folded.index(" ", at + 1)
                    word = folded[at + 1 : end]
                    if not entry.endswith("$"):
                        seen.add(word)
                    if at:
                        seen.add(f"{folded[folded.rindex(' ', 0, at) + 1 : at]} {word}")
                    if end + 1 < len(folded):
                        seen.add(f"{word} {folded[end + 1 : folded.index(' ', end + 1)]}")
                counts[label].update(seen)
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in counts[::-1])], names=["phrase", "toxic", "clean"])

    return of


def _weighed(weights: dict[str, float], exceptions: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, exceptions)
        for batch in batches:
            weight, words = [], []
            for text in batch.column("text").to_pylist():
                folded, n = fold(text)
                weight.append(sum(w for _, w, _ in matcher.hits(folded)))
                words.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(weight, pa.float64()), pa.array(words, pa.int64()), batch.column("toxic")], names=["weight", "words", "toxic"])

    return of


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``): entries with weights, exceptions, the curve of scores.

    About ``per_label`` labels of each class are drawn by a hash of the id; equal texts of one label count once. A word, or a beginning
    of words, is an entry if texts with it are toxic so much more often than others that chance among all candidates would hardly give it
    (log-likelihood ratio), and if ``ENTRY_SHARE`` of the toxic texts have it, which a cluster of near copies does not reach; of a word and its beginnings the most telling one stays. Hit words and pairs of words that clean texts have at least as often
    as toxic ones, in ``EXCEPTION_TEXTS`` texts or more, are exceptions. The driver gets entries, exceptions and two numbers per drawn text.

    Null labels, ids without a text and labels other than 0 and 1 are passed over; a label that repeats counts once for its text. Without labels of both
    classes there are no entries, and all texts score the share of toxic labels (0 without labels).
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    spread = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(spread))
    share = F.when(F.col("toxic") == 1, min(spread, spread * per_label // sizes.get(1, 1))).otherwise(min(spread, spread * per_label // sizes.get(0, 1)))
    ids = cut(known.filter(draw < share).distinct(), "drawn")  # of a size that per_label bounds
    drawn = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    sample = cut(drawn.withColumn("hash", F.xxhash64("text")).dropDuplicates(["hash", "toxic"]).select("text", "toxic"), "labelled")

    words = cut(sample.mapInArrow(_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    t_all, c_all = (x or 0 for x in words.agg(F.sum("toxic"), F.sum("clean")).first())
    if not t_all or not c_all:
        n1 = sample.agg(F.avg("toxic")).first()[0]
        return {"weights": {}, "exceptions": [], "beta": [math.log(max(n1 or 0, 1e-9) / max(1 - (n1 or 0), 1e-9)), 0.0, 0.0]}
    size, p = F.length("word"), t_all / (t_all + c_all)
    begins = F.when(size > STEM[0], F.transform(F.sequence(F.lit(STEM[0]), F.least(size - 1, F.lit(STEM[1]))), lambda n: F.substring("word", F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    entries = words.filter(size >= STEM[0]).select(F.explode(F.concat(begins, F.array(F.concat("word", F.lit("$"))))).alias("entry"), "toxic", "clean").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    entries = cut(entries, "entries")
    n = F.col("t") + F.col("c")
    gain = 2 * (F.col("t") * F.log(F.col("t") / (n * p)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - p)))).otherwise(0.0))
    least = 2 * math.log(max(2, entries.filter("t + c >= 3").count())) + 2
    toxic_texts = sample.filter("toxic = 1").count()
    telling = entries.filter((F.col("t") > 0) & (F.col("t") >= ENTRY_SHARE * toxic_texts) & (F.col("t") * (1 - p) > 2 * F.col("c") * p)).withColumn("gain", gain).filter(F.col("gain") >= least)
    weights: dict[str, float] = {}
    taken: set[str] = set()  # entries and all their beginnings
    for r in sorted(telling.collect(), key=lambda r: (-r["gain"], -len(r["entry"]), r["entry"])):
        e = r["entry"]
        if e not in taken and not any(e[:k] in weights for k in range(STEM[0], len(e))):
            weights[e] = math.log((r["t"] + 0.5) / t_all) - math.log((r["c"] + 0.5) / c_all)
            taken.update(e[:k] for k in range(STEM[0], len(e) + 1))

    around = sample.mapInArrow(_phrases(weights), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    exceptions = [r["phrase"] for r in around.filter((F.col("c") >= EXCEPTION_TEXTS) & (F.col("t") / t_all <= F.col("c") / c_all)).collect()]
    seen = sample.mapInArrow(_weighed(weights, exceptions), "weight double, words long, toxic int").collect()
    x = features(np.array([r["weight"] for r in seen]), np.array([r["words"] for r in seen]))
    return {"weights": weights, "exceptions": sorted(exceptions), "beta": curve(x, np.array([r["toxic"] for r in seen], float)).tolist()}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``hits`` (entries found, exceptions left out); columns of these names are replaced.

    Of each row its whole text is read, and nothing else; null and empty texts have no hits and score as such. Repeated rows are scored each; an empty table
    gives no rows.
    """
    held = [c for c in docs.columns if c not in ("score", "hits")]
    shared, index = docs.sparkSession.sparkContext.broadcast(model), held.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        matcher, beta = Matcher(known["weights"], known["exceptions"]), np.array(known["beta"])
        for batch in batches:
            weight, words, hits = [], [], []
            for x in batch.column(index):
                folded, n = fold(x.as_py())
                found = matcher.hits(folded)
                weight.append(sum(w for _, w, _ in found))
                words.append(n)
                hits.append(len(found))
            p = 1 / (1 + np.exp(-np.clip(features(np.array(weight, float), np.array(words, float)) @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(hits, pa.int64())], names=[*batch.schema.names, "score", "hits"])

    slim = docs.select(*held)
    return slim.mapInArrow(of, T.StructType([*slim.schema, T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType())]))
