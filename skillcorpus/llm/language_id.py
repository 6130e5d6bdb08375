"""Language ID by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams tells the languages with
a 1 from those with a 0; decoding weighs the bits' losses by how well each bit did in training and takes the
codeword of least loss. A small gap to the second codeword is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcorpus.llm.shingles import chunks

#: Texts per language that training reads at most, and the tasks that count their n-grams.
TRAIN_PER_LANGUAGE, COUNTERS = 1500, 16
#: log2 of the number of n-gram features.
FEATURE_BITS = 15
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1 and -1, a row each.

    For up to 7 languages all ways to part them in two are used (2^(n-1) - 1 bits: any two codewords differ in 2^(n-2) of
    them). Beyond that they are rows of random bits, 15 log2 n of them, of which the best of 200 draws is kept.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1.0 if (m >> j) & 1 else -1.0 for m in range(1, 1 << (n - 1))] for j in range(n - 1)]
        return np.array([[-1.0] * len(bits[0]), *bits])
    rng = np.random.default_rng(11)
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(15 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]  # a bit that all languages share tells nothing
        gap = int(((code.shape[1] - code @ code.T + 2 * code.shape[1] * np.eye(n)) / 2).min())
        if gap > most:
            best, most = code, gap
    return best


def _fold() -> np.ndarray:
    """Bytes as features see them: letters and UTF-8 parts stand, A-Z lower-cased, all else is one space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each position its byte trigram and its 4-gram as hashed features; before a text stand spaces, whatever text precedes it."""
    x = _fold()[data].astype(np.uint32)
    before = []
    for back in (1, 2, 3):
        p = np.full_like(x, 32)
        p[back:] = x[:-back]
        for first in range(back):
            at = offsets[:-1] + first
            p[at[at < np.minimum(offsets[1:], len(x))]] = 32
        before.append(p)
    three = x | before[0] << np.uint32(8) | before[1] << np.uint32(16)
    out = []
    for salt, gram in ((0x9E3779B1, three), (0x85EBCA77, three ^ (before[2] * np.uint32(0x01000193)))):
        out.append((gram * np.uint32(salt)) >> np.uint32(32 - FEATURE_BITS))
    return out


def letters(column: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script."""
    found = np.zeros(len(column), bool)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    for first, data, offsets in chunks(column):
        sums = np.r_[0, np.cumsum(ascii_letter[data])]
        found[first : first + len(offsets) - 1] = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = column[int(i)].as_py()
        found[i] = bool(text) and any(c.isalpha() for c in text)
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, fold, counts``: for each training text's n-grams, summed over the batch by language and half."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        lang, fold = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, data, offsets in chunks(batch.column(2)):
            grams = features(data, offsets)
            for i in range(len(offsets) - 1):
                row = sums.setdefault((lang[first + i], fold[first + i]), np.zeros((2, 1 << FEATURE_BITS)))
                length = max(1, offsets[i + 1] - offsets[i])
                for j, g in enumerate(grams):  # a text counts by the root of its length
                    row[j] += np.bincount(g[offsets[i] : offsets[i + 1]], minlength=1 << FEATURE_BITS) / np.sqrt(length)
    keys = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["lang", "fold", "counts"])


class Model:
    """Languages, their codewords, and for each bit a weight per feature, a scale and a weight of the bit."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        """counts: by language, half of the training texts, n-gram order and feature."""
        self.langs, self.code = langs, codewords(len(langs))
        self.weights = self._fit(counts.sum(1))
        self.trust = np.ones(self.code.shape[1])
        self.scale = np.ones(self.code.shape[1])
        if len(langs) > 1:  # each half is judged by the other: margins of bits by language
            margins = []
            for half in (0, 1):
                w = self._fit(counts[:, 1 - half])
                share = counts[:, half] / np.maximum(counts[:, half].sum(-1, keepdims=True), 1e-9)
                margins.append(np.einsum("kjf,bjf->kb", share, w) * self.code)
            margins = np.array(margins)
            self.scale = 1 / np.maximum(np.abs(margins).mean((0, 1)), 1e-6)
            good = (margins > 0).mean((0, 1))
            self.trust = np.maximum(good - 0.5, 0.01) / np.maximum(good - 0.5, 0.01).sum()

    def _fit(self, counts: np.ndarray) -> np.ndarray:
        """Log odds of each feature between the two sides of a bit, both sides' languages weighing the same."""
        share = (counts + 0.05) / (counts + 0.05).sum(-1, keepdims=True)
        out = np.zeros((self.code.shape[1], *share.shape[1:]))
        for b in range(self.code.shape[1]):
            one, zero = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(one) and len(zero):
                out[b] = np.clip(np.log(one.mean(0) / zero.mean(0)), -4, 4)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts' bit margins: the best language, its share among all by loss (0 to 1), the gap to the second."""
        x = margins * self.scale * 2
        loss = np.stack([(np.logaddexp(0, -x * c) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ordered = np.sort(p, 1)
        return loss.argmin(1), ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and gaps of whole texts."""
        n, bits = len(column), self.code.shape[1]
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        margins = np.zeros((n, bits))
        table = np.ascontiguousarray(self.weights.transpose(1, 2, 0).astype(np.float32))  # order, feature, bit
        for first, data, offsets in chunks(column):
            full = offsets[1:] > offsets[:-1]
            starts = offsets[:-1][full]
            for order, gram in enumerate(features(data, offsets)):
                rows = np.zeros((len(offsets) - 1, bits))
                cuts = np.union1d(starts, np.arange(0, len(data), 1 << 14))  # pieces of texts, some at a time
                owner = np.flatnonzero(full)[np.searchsorted(starts, cuts, side="right") - 1]
                for a in range(0, len(cuts), 64):
                    s = cuts[a : a + 64]
                    to = cuts[a + 64] if a + 64 < len(cuts) else len(data)
                    np.add.at(rows, owner[a : a + 64], np.add.reduceat(table[order][gram[s[0] : to]], s - s[0], axis=0))
                margins[first : first + len(rows)] += rows / np.maximum(offsets[1:] - offsets[:-1], 1)[:, None]
        best, score, gap = self.decode(margins)
        known = letters(column)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, gap, 0.0)


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of one language and half, added up; a group has a row of each counting task at most."""
    total = sum(np.frombuffer(x.as_py()) for x in table.column("counts"))
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "fold": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Fits a model on about ``per_language`` texts of each language at most, those first by a hash of id and text.

    N-grams of this bounded sample are counted by ``COUNTERS`` tasks whatever the size of the input, and added up by language on the executors.
    The driver gets one row per language and half (512 KB) and makes the model of them. All languages take part. Rows without a language or
    a text do not; a repeated row counts each time it is drawn; where ids lack or repeat, texts part the draws. No rows give a model that knows nothing.
    """
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()  # as many as there are languages
    if not sizes:
        return Model([], np.zeros((0, 2, 2, 1 << FEATURE_BITS)))
    spread = 1 << 30
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(spread, int(spread * per_language / r["n"]))))])
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(3)), F.lit(spread))
    taken = labelled.filter(draw < F.coalesce(share[F.col(lang)], F.lit(0))).select(F.col(lang).alias("lang"), (draw % 2).cast("int").alias("fold"), F.col(text).cast("string").alias("text"))
    counted = taken.repartition(COUNTERS).mapInArrow(_counts, "lang string, fold int, counts binary")
    summed = counted.groupBy("lang", "fold").applyInArrow(_summed, "lang string, fold int, counts binary")
    langs = sorted(r["lang"] for r in sizes)
    counts = np.zeros((len(langs), 2, 2, 1 << FEATURE_BITS))
    for r in summed.collect():
        counts[langs.index(r["lang"]), r["fold"]] = np.frombuffer(r["counts"]).reshape(2, -1)
    return Model(langs, counts)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text", ambiguous_gap: float = 0.1) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score, ambiguous``; columns of these names are replaced.

    The whole text is read, and nothing else. ``lang_pred`` is ``und`` with score 0, and not ambiguous, where the text is null
    or has no letter, or where the model knows no language. Equal losses go to the language that is first in order of names; repeated
    rows and texts of any length are judged each and whole; an empty table gives no rows. ``ambiguous`` tells that the second codeword's share comes
    within ``ambiguous_gap`` of the first's.
    """
    held = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays, which workers read without this package
    index = held.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.__new__(Model)
        vars(known).update(shared.value)
        for batch in batches:
            langs, score, gap = known.predict(batch.column(index))
            flag = np.array([x != UNKNOWN for x in langs], bool) & (gap < ambiguous_gap)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    slim = docs.select(*held)
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return slim.mapInArrow(of, T.StructType([*slim.schema, *added]))
